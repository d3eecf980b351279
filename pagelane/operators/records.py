"""Response text -> validated, typed record.

Strictness that ``try_parse_json`` lacks (it ignores trailing text) is
restored with two wrapper parses; the record's fields come from one
``from_json`` with VARIANT fields. Each record schema is a declarative field
list; every field kind yields an acceptance predicate and a typed value,
following the lax-mode rules of the original record models:

=============  ============  ==========  =====================================
kind           missing key   JSON null   accepted
=============  ============  ==========  =====================================
str            NULL          NULL        string
float          NULL          NULL        number, boolean, numeric string
doctype        own type      invalid     one of the 7 class names
txtype         NULL          NULL        one of the 5 transaction types
txlist         []            invalid     array of valid transaction objects
strlist        []            NULL        array of strings
floatlist      []            NULL        array of float-acceptable values
dict           {}            NULL        object (kept as VARIANT)
=============  ============  ==========  =====================================

Only the schema chosen by the classified label is evaluated per row
(``CASE`` branches are lazy), so the cost is one schema per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelane.functions import fixed
from pagelane.functions.text import strip_fence, unicode_trim

SCHEMAS, TRANSACTION_FIELDS = fixed.SCHEMAS, fixed.TRANSACTION_FIELDS

# Struct column that carries each schema's record.
RECORD_COLUMNS = {
    "bank_statement": "bank_statement",
    "insurance_form": "insurance_form",
    "accident_claim": "accident_claim",
    "invoice": "invoice",
    "other": "general",
}

_SPARK_TYPES = {
    "str": "string", "float": "double", "doctype": "string", "txtype": "string",
    "strlist": "array<string>", "floatlist": "array<double>", "dict": "variant",
}
_TX_DDL = ", ".join(f"{n}: {_SPARK_TYPES[k]}" for n, k in TRANSACTION_FIELDS)
_SPARK_TYPES["txlist"] = f"array<struct<{_TX_DDL}>>"


def record_ddl(schema_type: str) -> str:
    return "struct<" + ", ".join(f"{n}: {_SPARK_TYPES[k]}" for n, k in SCHEMAS[schema_type]) + ">"


_NUMERIC_TYPES = ["BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"]
_DIGITS = r"[0-9](?:_?[0-9])*"
FLOAT_TEXT = (rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
              r"|(?i)^[+-]?(?:inf|infinity|nan)$")


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _float_words() -> Column:
    pairs = [("nan", "NaN"), ("+nan", "NaN"), ("-nan", "NaN"), ("inf", "Infinity"), ("+inf", "Infinity"),
             ("infinity", "Infinity"), ("+infinity", "Infinity"), ("-inf", "-Infinity"),
             ("-infinity", "-Infinity")]
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def _float_text_value(s: Column) -> Column:
    u = F.lower(F.regexp_replace(s, "_", ""))
    return F.coalesce(F.try_element_at(_float_words(), u), u).try_cast("double")


# Each rule takes a field's value ``x`` (VARIANT, NULL when the key is missing),
# its type name ``t`` (``schema_of_variant``) and, for lists, its ``cells``,
# and gives whether the value is accepted and the typed value. The arguments are
# plain columns, so the rules run in generated code.

def _float(x: Column, t: Column, cells: Column | None = None):
    text = unicode_trim(F.regexp_replace(F.try_variant_get(x, "$", "string"), f"^{BARE}", ""))
    ok = x.isNull() | F.when(t == "STRING", F.coalesce(text.rlike(FLOAT_TEXT), F.lit(False))) \
        .otherwise(t.isin(*_NUMERIC_TYPES, "BOOLEAN", "VOID") | t.startswith("DECIMAL"))
    value = F.when(t == "STRING", _float_text_value(text)).otherwise(F.try_variant_get(x, "$", "double"))
    return ok, value


def _str(x: Column, t: Column, cells: Column | None = None):
    s = F.when(t == "STRING", F.try_variant_get(x, "$", "string"))
    return x.isNull() | (t == "VOID") | ((t == "STRING") & _quoted(s)), s


def _enum(x: Column, t: Column, members, missing_value, null_ok: bool):
    s = F.when(t == "STRING", F.try_variant_get(x, "$", "string"))
    member = F.coalesce(s.isin(*members), F.lit(False))
    ok = x.isNull() | member
    if null_ok:
        ok = ok | (t == "VOID")
    value = F.when(x.isNull(), F.lit(missing_value)).when(member, s)
    return ok, value


def _array(x: Column) -> Column:
    return F.try_variant_get(x, "$", "array<variant>")


def _list_rule(null_ok: bool, empty: str):
    """Lists come as ``cells``: per element whether it is accepted and its typed value, made in one traversal."""
    def rule(x: Column, t: Column, cells: Column):
        ok = x.isNull() | F.coalesce(F.forall(cells, lambda c: c["ok"]), F.lit(False))
        if null_ok:
            ok = ok | (t == "VOID")
        value = F.when(x.isNull(), F.array().cast(empty)).otherwise(F.transform(cells, lambda c: c["v"]))
        return ok, value
    return rule


def _cells(kind: str, x: Column) -> Column:
    """``array<struct<ok, v>>`` of a list's elements; NULL if ``x`` is no list."""
    return F.transform(_array(x), {"strlist": _str_cell, "floatlist": _float_cell, "txlist": _tx_cell}[kind])


def _cell(ok: Column, value: Column) -> Column:
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), value.alias("v"))


def _str_cell(e: Column) -> Column:
    s = F.try_variant_get(e, "$", "string")
    return _cell((F.schema_of_variant(e) == "STRING") & _quoted(s), s)


def _float_cell(e: Column) -> Column:
    et = F.schema_of_variant(e)
    ok, value = _float(e, et)
    return _cell(e.isNotNull() & (et != "VOID") & ok, value)


def _tx_cell(e: Column) -> Column:
    """An object whose fields follow the transaction rules."""
    ok, values = F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False)), []
    for name, kind in TRANSACTION_FIELDS:
        field = _get(e, name)
        field_ok, value = _rule(kind, None)(field, F.schema_of_variant(field))
        ok = ok & F.coalesce(field_ok, F.lit(False))
        values.append(value.cast(_SPARK_TYPES[kind]).alias(name))
    return _cell(ok, F.struct(*values))


def _dict(x: Column, t: Column, cells: Column | None = None):
    is_obj = F.coalesce(t.startswith("OBJECT"), F.lit(False))
    ok = x.isNull() | (t == "VOID") | is_obj
    value = F.when(x.isNull(), F.parse_json(F.lit("{}"))).when(is_obj, x)
    return ok, value


def _rule(kind: str, own_type):
    if kind == "str":
        return _str
    if kind == "float":
        return _float
    if kind == "doctype":
        return lambda x, t, cells=None: _enum(x, t, fixed.DOCUMENT_TYPES, own_type, null_ok=False)
    if kind == "txtype":
        return lambda x, t, cells=None: _enum(x, t, fixed.TRANSACTION_TYPES, None, null_ok=True)
    if kind == "dict":
        return _dict
    return _list_rule(kind != "txlist", _SPARK_TYPES[kind])


def _raw_ddl(schema_type: str) -> str:
    """The record's fields as VARIANTs: NULL when the key is missing."""
    return "struct<" + ", ".join(f"{name}: variant" for name, _ in SCHEMAS[schema_type]) + ">"


#: Marks the strings that stand for the bare words NaN, Infinity and -Infinity (a private-use character).
BARE = "\ue000"
# A quote that no backslash escapes (an even number of them, up to a hundred, stands before it).
_QUOTE = r'(?<=(?<!\\)(?:\\\\){0,50})"'
_BARE_WORD = r"(?<![0-9A-Za-z_.+\-])(NaN|-?Infinity)(?![0-9A-Za-z_.+\-]|[ \t\r\n]*:)"


def bare_words(text: Column) -> Column:
    """``text`` with the number words that ``json.loads`` takes (``NaN``, ``Infinity``, ``-Infinity``) as marked strings.

    Every second piece between quotes is a string and stays; texts without such a word are not split."""
    def marked(piece: Column, at: Column) -> Column:
        return F.when(at % 2 == 1, piece).otherwise(F.regexp_replace(piece, _BARE_WORD, f'"{BARE}$1"'))
    rejoined = F.array_join(F.transform(F.split(text, _QUOTE, -1), marked), '"')
    return F.when(text.contains("NaN") | text.contains("Infinity"), rejoined).otherwise(text)


def bare_words_back(json_text: Column, instead: str = "$1") -> Column:
    """JSON text with marked strings as the bare words again, or as something else."""
    return F.regexp_replace(json_text, f'"{BARE}(NaN|-?Infinity)"', instead)


def _quoted(s: Column) -> Column:
    """Whether a string value was a string in the text, too."""
    return ~F.coalesce(s.startswith(BARE), F.lit(False))


def is_whole_json(text: Column) -> Column:
    """whether the whole text is one JSON value.

    ``try_parse_json`` ignores trailing text; the two wrapper parses fail on
    every trailing remainder (``x``, ``}``, ``]``, ``, {...}``), and together
    they imply the text itself is one value."""
    return (F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
            & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull())


def parse_json_strict(text: Column) -> Column:
    """VARIANT of ``text`` if the whole text is one JSON value, else NULL; bare number words are marked strings."""
    text = bare_words(text)
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    return F.when(whole, F.try_variant_get(wrapped, "$.v", "variant"))


def select_schema(label: Column) -> Column:
    """schema owned by the classified label; any other label -> ``other``."""
    return F.when(label.isin(*fixed.SCHEMA_TYPES), label).otherwise(F.lit("other"))


PAGE_FIELDS = ["schema_type", "parse_status", "record_type"] + [RECORD_COLUMNS[st] for st in fixed.SCHEMA_TYPES]
_STEP = "__pl"


def _barrier(df: DataFrame, names) -> DataFrame:
    """Columns ``names`` as the output of a one-row generator.

    The optimizer neither merges projections across it nor pushes a filter on
    its output below it, so the work behind ``names`` is done once per row,
    whatever later steps read or filter.
    """
    rest = [F.col(c) for c in df.columns if c not in names]
    once = df.select(*rest, F.explode(F.array(F.struct(*names))).alias(_STEP))
    return once.select(*rest, *[F.col(f"{_STEP}.{n}").alias(n) for n in names])


def _checked(df: DataFrame, st: str) -> DataFrame:
    """The selected schema's fields in steps: variants, their types, verdicts and values.

    Every step is a projection whose columns are read several times by the
    next, so Spark keeps the steps apart and compiles each; rows of other
    schemas skip them (``CASE`` is lazy).
    """
    fields, raw, types, rec = SCHEMAS[st], f"{_STEP}_raw_{st}", f"{_STEP}_type_{st}", f"{_STEP}_rec_{st}"
    lists, cells = {name: kind for name, kind in fields if kind.endswith("list")}, f"{_STEP}_list_{st}"
    mine = (F.col(f"{_STEP}_schema") == st) & F.col(f"{_STEP}_object")
    df = df.withColumn(raw, F.when(mine, F.from_json(F.col(f"{_STEP}_clean"), _raw_ddl(st))))
    df = df.withColumn(types, F.when(F.col(raw).isNotNull(), F.struct(
        *[F.schema_of_variant(F.col(raw)[name]).alias(name) for name, _ in fields])))
    if lists:  # elements once for verdict and value
        df = df.withColumn(cells, F.when(F.col(raw).isNotNull(), F.struct(*[
            F.when(F.col(types)[name].startswith("ARRAY"), _cells(kind, F.col(raw)[name])).alias(name) for name, kind in lists.items()])))
    found = [(name, kind, *_rule(kind, st)(F.col(raw)[name], F.col(types)[name], F.col(cells)[name] if name in lists else None))
             for name, kind in fields]
    checks = F.struct(*[F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), value.cast(_SPARK_TYPES[kind]).alias("v")).alias(name)
                        for name, kind, ok, value in found])
    return df.withColumn(rec, F.when(F.col(raw).isNotNull(), checks)).drop(raw, types, cells)


def parse_responses(df: DataFrame, response_col: str = "response", label_col: str = "document_type",
                    structured: bool | Column = True, with_markdown: bool = False) -> DataFrame:
    """F1-F12 on a frame of model answers: adds the ``PAGE_FIELDS`` columns
    (and, with ``with_markdown``, ``markdown`` and ``page_status``, G1-G8).

    ``schema_type``, ``parse_status`` (``ok``, ``empty``, ``disabled``,
    ``bad_json``, ``bad_schema``), ``record_type`` (the record's own
    ``document_type``) and one record struct per schema (only the selected one,
    only when ok). The response is never changed, so fallbacks return the
    original text (F12).
    """
    flag = structured if isinstance(structured, Column) else F.lit(bool(structured))
    response = F.col(response_col)
    empty = F.coalesce(response, F.lit("")) == ""
    step = df.select("*", select_schema(F.coalesce(F.col(label_col), F.lit("other"))).alias(f"{_STEP}_schema"),
                     F.coalesce(flag, F.lit(False)).alias(f"{_STEP}_structured"), empty.alias(f"{_STEP}_empty"))
    wanted = F.col(f"{_STEP}_structured") & ~F.col(f"{_STEP}_empty")
    step = step.withColumn(f"{_STEP}_clean", F.when(wanted, bare_words(strip_fence(response))))
    step = step.withColumn(f"{_STEP}_json", is_whole_json(F.col(f"{_STEP}_clean")))
    step = step.withColumn(f"{_STEP}_object", F.col(f"{_STEP}_json") & F.coalesce(F.col(f"{_STEP}_clean").startswith("{"), F.lit(False)))
    step = _barrier(step, [f"{_STEP}_{n}" for n in ("schema", "structured", "empty", "clean", "json", "object")])
    for st in fixed.SCHEMA_TYPES:
        step = _checked(step, st)

    valid, record_type = F.lit(False), F.lit(None).cast("string")
    for st in fixed.SCHEMA_TYPES:
        checks, mine = F.col(f"{_STEP}_rec_{st}"), F.col(f"{_STEP}_schema") == st
        ok = F.lit(True)
        for name, _ in SCHEMAS[st]:
            ok = ok & checks[name]["ok"]
        valid = F.when(mine, ok).otherwise(valid)
        record_type = F.when(mine, checks["document_type"]["v"]).otherwise(record_type)
    status = (F.when(F.col(f"{_STEP}_empty"), F.lit("empty")).when(~F.col(f"{_STEP}_structured"), F.lit("disabled"))
              .when(~F.col(f"{_STEP}_json"), F.lit("bad_json")).when(F.coalesce(valid, F.lit(False)), F.lit("ok"))
              .otherwise(F.lit("bad_schema")))
    step = step.select("*", F.col(f"{_STEP}_schema").alias(f"{_STEP}_out_schema_type"), status.alias(f"{_STEP}_out_parse_status"),
                       record_type.alias(f"{_STEP}_own_type"))
    ok = F.col(f"{_STEP}_out_parse_status") == "ok"
    records = []
    for st in fixed.SCHEMA_TYPES:
        checks = F.col(f"{_STEP}_rec_{st}")
        record = F.struct(*[checks[name]["v"].alias(name) for name, _ in SCHEMAS[st]])
        records.append(F.when(ok & (F.col(f"{_STEP}_schema") == st), record).alias(f"{_STEP}_out_{RECORD_COLUMNS[st]}"))
    outputs = [f"{_STEP}_out_{f}" for f in PAGE_FIELDS]
    step = step.select(*df.columns, *outputs[:2], F.when(ok, F.col(f"{_STEP}_own_type")).alias(outputs[2]), *records)
    step = _barrier(step, outputs).select(*df.columns, *[F.col(o).alias(f) for o, f in zip(outputs, PAGE_FIELDS)])
    if with_markdown:
        from pagelane.operators.render import render_markdown
        step = render_markdown(step, response_col)
    return step


def union_records(parsed: DataFrame, key_cols) -> DataFrame:
    """the five record kinds as one wide relation (one row per valid
    record), in one pass: a field comes from whichever record the row has."""
    owners: dict[str, list[str]] = {}
    for st in fixed.SCHEMA_TYPES:
        for name, _ in SCHEMAS[st]:
            owners.setdefault(name, []).append(RECORD_COLUMNS[st])
    fields = [F.coalesce(*[F.col(f"{col}.{name}") for col in cols]).alias(name) for name, cols in owners.items()]
    return parsed.filter(F.col("parse_status") == "ok").select(*key_cols, "schema_type", *fields)


def explode_transactions(parsed: DataFrame, key_cols) -> DataFrame:
    """one row per transaction of each valid statement, in order."""
    return (parsed
            .select(*key_cols, F.posexplode_outer("bank_statement.transactions").alias("txn_no", "txn"))
            .filter(F.col("txn_no").isNotNull()).select(*key_cols, "txn_no", "txn.*"))


def record_json(c) -> Column:
    """Record as JSON text, nulls kept, fields in declared order."""
    col = F.col(c) if isinstance(c, str) else c
    return F.to_json(col, {"ignoreNullFields": "false"})
