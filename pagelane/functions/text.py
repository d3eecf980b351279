"""Column -> Column helpers for names, text hygiene and display values.

All of them are built from ``pyspark.sql.functions`` so they stay inside
whole-stage code generation; none needs Python at run time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelane.functions import fixed

# Characters Python's str.isspace() accepts. Java's ``\s`` is ASCII only
# and ``(?U)\s`` misses U+001C..U+001F, so the class is spelled out; the
# same spelling is valid in RE2 (DuckDB) which keeps the oracle honest.
PY_SPACE_CLASS = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}"
                  r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# White_Space without U+001C..U+001F (what number parsing trims).
UNICODE_SPACE_CLASS = (r"[\t\n\x{0b}\x{0c}\r \x{85}\x{a0}\x{1680}"
                       r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same sets as literal character strings, for btrim (no regex scan).
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")
UNICODE_SPACE_CHARS = PY_SPACE_CHARS.replace("\x1c\x1d\x1e\x1f", "")


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode white space at both ends (F2)."""
    return F.btrim(_col(c), F.lit(PY_SPACE_CHARS))


def unicode_trim(c) -> Column:
    return F.btrim(_col(c), F.lit(UNICODE_SPACE_CHARS))


def sanitize_name(c) -> Column:
    """Upload name hygiene (B8): keep letters, digits and ``._-``; ensure a
    case-sensitive ``.pdf`` ending."""
    kept = F.regexp_replace(_col(c), r"[^\p{L}\p{N}._-]", "")
    return F.when(kept.endswith(".pdf"), kept).otherwise(F.concat(kept, F.lit(".pdf")))


def sanitize_text(c, max_length: int | None = 1000) -> Column:
    """Free-text hygiene (B9): cut to ``max_length`` code points first (the rule
    for user input; None, for document texts, cuts nothing), then drop
    everything outside printable ASCII. Non-strings give NULL."""
    text = _col(c) if max_length is None else F.left(_col(c), F.lit(max(int(max_length), 0)))
    return F.regexp_replace(text, r"[^\x20-\x7E]", "")


def cut_characters(c, max_length: int = 1000) -> Column:
    """How many characters ``sanitize_text`` cuts off at ``max_length``."""
    return F.greatest(F.length(_col(c)) - F.lit(max(int(max_length), 0)), F.lit(0))


def path_stem(c) -> Column:
    """File name without its last suffix (``a.b.pdf`` -> ``a.b``, ``.pdf`` stays)."""
    return F.regexp_replace(_col(c), r"(?<=.)\.[^.]+$", "")


def output_name(name, requested=None) -> Column:
    """Markdown output name (B10): ``<stem>.md`` unless a name is requested;
    ``.md`` is appended when missing."""
    base_name = F.regexp_extract(_col(name), r"([^/]*)$", 1)
    chosen = F.concat(path_stem(base_name), F.lit(".md"))
    if requested is not None:
        chosen = F.coalesce(_col(requested), chosen)
    return F.when(chosen.endswith(".md"), chosen).otherwise(F.concat(chosen, F.lit(".md")))


def normalize_prompt(c) -> Column:
    """Custom prompt (B12): stripped, blank -> NULL."""
    return F.nullif(py_strip(c), F.lit(""))


def unsafe_folder(c) -> Column:
    """Folder-name rule (B13): empty, ``..`` or ``/`` is rejected."""
    col = _col(c)
    return (col == "") | col.contains("..") | col.contains("/")


def normalize_path(c) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute POSIX path, textually."""
    parts = F.split(_col(c), "/")
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(resolved, "/"))


def path_contained(path, base) -> Column:
    """The resolved path lies inside ``base`` on a path boundary."""
    p = normalize_path(path)
    b = normalize_path(base)
    return (p == b) | p.startswith(F.concat(F.regexp_replace(b, "/$", ""), F.lit("/")))


def content_hash(c) -> Column:
    """SHA-256 hex of UTF-8 text or raw bytes."""
    return F.sha2(_col(c), 256)


def strip_fence(c) -> Column:
    """strip; drop a leading ```json and a trailing ```; strip again.

    Written as anchored replacements (``\\A``/``\\z``) so each input is
    referenced once and the expression stays linear in size."""
    s = F.regexp_replace(py_strip(c), r"\A```json", "")
    s = F.regexp_replace(s, r"```\z", "")
    return py_strip(s)


def or_na(c) -> Column:
    """NULL or empty string print as ``N/A``."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit("N/A"))


def fmt2(c) -> Column:
    """Two decimals with Python ``format(x, '.2f')`` rounding (half-even on
    the binary value); NaN and infinities spelled as Python does."""
    x = _col(c)
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .otherwise(F.call_function("format_number", x, F.lit("0.00"))))


def money(c) -> Column:
    """``f"${x or 0:.2f}"`` -- NULL, 0 and -0 print ``$0.00``."""
    x = _col(c)
    guarded = F.when(x.isNull() | (x == 0), F.lit(0.0)).otherwise(x)
    word = F.when(F.isnan(guarded), F.lit("nan")).when(F.abs(guarded) == float("inf"), F.when(guarded > 0, F.lit("inf")).otherwise(F.lit("-inf")))
    return F.concat(F.lit("$"), F.coalesce(word, fmt2(guarded)))


# Patterns of the offline extractors.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
AMOUNT_PATTERN = r"\$[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?|\$[0-9]+(?:\.[0-9]+)?"
DATE_PATTERN = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"


def extract_emails(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(EMAIL_PATTERN), 0)


def extract_phones(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(PHONE_PATTERN), 0)


def extract_amounts(c) -> Column:
    """Money amounts as ARRAY<DOUBLE> (``$1,250.50`` -> 1250.5)."""
    found = F.regexp_extract_all(_col(c), F.lit(AMOUNT_PATTERN), 0)
    return F.transform(found, lambda x: F.regexp_replace(x, r"[$,]", "").try_cast("double"))


def extract_dates(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(DATE_PATTERN), 0)


def python_text(value: Column, kind: str) -> Column:
    """The text Python's ``repr`` gives for a value: quoted strings, True/False, None."""
    if kind == "string":
        escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
        for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            escaped = F.replace(escaped, F.lit(char), F.lit(code))
        double = value.contains("'") & ~value.contains('"')
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        text = F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)
    elif kind == "boolean":
        text = F.when(value, F.lit("True")).otherwise(F.lit("False"))
    else:
        text = value.cast("string")
    return F.when(value.isNull(), F.lit("None")).otherwise(text)


def sql_quote(text: str) -> str:
    """Literal for SQL text built by the library (single quotes doubled)."""
    return "'" + text.replace("'", "''") + "'"


__all__ = [name for name in dir() if not name.startswith("_")] + ["fixed"]
