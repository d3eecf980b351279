"""Registered queries over text tables (B, C, D, E, H) and their oracles.

Roles of the driver tables: ``documents`` is extracted page text,
``conversations`` are documents whose turns are pages, ``pages`` are named
uploads (``url`` gives the file name, ``html`` the bytes).
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelane.functions import fixed
from pagelane.functions.text import (PY_SPACE_CHARS, content_hash, cut_characters, extract_amounts, extract_dates,
                                     extract_emails, extract_phones, normalize_prompt, output_name,
                                     sanitize_name, sanitize_text, sql_quote as q, unsafe_folder)
from pagelane.operators.answer_store import AnswerStore, answer_requests
from pagelane.operators.assemble import (assemble_documents, batch_summary, first_document, page_totals,
                                         status_message)
from pagelane.operators.balance import spread
from pagelane.operators.pages import explode_text_pages, page_counts, require_all_pages
from pagelane.operators.provider import KEYWORDS, keyword_classify
from pagelane.operators.ranges import deal_ranges, range_text_pages, text_ranges
from pagelane.operators.records import parse_responses
from pagelane.operators.routing import (choose_output, empty_response, extend_prompt, extraction_prompt,
                                        normalize_label, page_prompts, route_prompts)
from pagelane.session import ensure_checkpoint_dir
from pagelane.sources.files import write_markdown
from pagelane.sources.tables import read_table
from pagelane.streaming.assembly import assemble_stream, run_assembly

NL = "chr(10)"
USER_INPUT_CHARS = 1000  # the reference rule for user input


def _chars_sql(chars: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in chars)


PY_STRIP_SQL = _chars_sql(PY_SPACE_CHARS)


def _docs(spark, sf_dir, *cols) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select(*cols), ["doc_id"])


# --------------------------------------------------------------------------- B9
def text_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts, cleaned and not cut."""
    d = _docs(spark, sf_dir, "doc_id", "text")
    return d.select("doc_id", sanitize_text(F.col("text"), None).alias("clean_text"))


def text_sanitize_sql() -> str:
    return "SELECT doc_id, regexp_replace(text, '[^\\x20-\\x7E]', '', 'g') AS clean_text FROM documents"


def user_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule for user input: user turns cut to ``USER_INPUT_CHARS`` and
    cleaned, with the number of characters cut off."""
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    return c.select("conv_id", "turn", sanitize_text("text", USER_INPUT_CHARS).alias("clean_text"),
                    cut_characters("text", USER_INPUT_CHARS).alias("n_cut"))


def user_inputs_sql() -> str:
    return (f"SELECT conv_id, turn, regexp_replace(left(text, {USER_INPUT_CHARS}), '[^\\x20-\\x7E]', '', 'g') AS clean_text, "
            f"CAST(greatest(length(text) - {USER_INPUT_CHARS}, 0) AS INTEGER) AS n_cut FROM conversations WHERE role = 'user'")


# ------------------------------------------------------------ B8, B10, B13, C1
def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id"])
    base = F.regexp_extract("url", r"([^/]*)$", 1)
    folder = F.regexp_extract("url", r"^[a-z]+://[^/]+/(.*)/", 1)
    named = p.select("page_id", sanitize_name(base).alias("upload_name"), folder.alias("folder"),
                     content_hash("html").alias("html_sha256"))
    return named.select("page_id", "upload_name", output_name(F.col("upload_name")).alias("output_name"),
                        "folder", unsafe_folder("folder").alias("folder_rejected"), "html_sha256")


def upload_names_sql() -> str:
    return r"""
WITH b AS (
  SELECT page_id, html,
         regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^\p{L}\p{N}._-]', '', 'g') AS kept,
         regexp_extract(url, '^[a-z]+://[^/]+/(.*)/', 1) AS folder
  FROM pages
), n AS (
  SELECT *, CASE WHEN ends_with(kept, '.pdf') THEN kept ELSE kept || '.pdf' END AS upload_name FROM b
)
SELECT page_id, upload_name,
       CASE WHEN regexp_matches(upload_name, '^.+\.[^.]+$') THEN regexp_replace(upload_name, '\.[^.]+$', '')
            ELSE upload_name END || '.md' AS output_name,
       folder,
       (folder = '' OR contains(folder, '..') OR contains(folder, '/')) AS folder_rejected,
       sha256(html) AS html_sha256
FROM n"""


# --------------------------------------------------------------------------- C1
def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "doc_id", "text")
    return d.select("doc_id", content_hash("text").alias("text_sha256"), F.octet_length("text").alias("n_bytes"))


def document_hashes_sql() -> str:
    return "SELECT doc_id, sha256(text) AS text_sha256, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents"


# ------------------------------------------------------------------- B12 + E1
def custom_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    with_custom = c.select("conv_id", "turn",
                           F.when(F.col("role") == "user", normalize_prompt("text")).alias("custom_prompt"))
    return route_prompts(with_custom, "custom_prompt", classification=True)


def custom_prompts_sql() -> str:
    return f"""
WITH c AS (
  SELECT conv_id, turn,
         CASE WHEN role = 'user' THEN nullif(trim(text, {PY_STRIP_SQL}), '') END AS custom_prompt
  FROM conversations
)
SELECT conv_id, turn, custom_prompt,
       CASE WHEN coalesce(custom_prompt, '') <> '' THEN custom_prompt END AS extraction_prompt,
       CASE WHEN coalesce(custom_prompt, '') = '' THEN {q(fixed.CLASSIFICATION_PROMPT)} END AS classification_prompt
FROM c"""


# --------------------------------------------------------------------------- D1
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_text_pages(_docs(spark, sf_dir, "doc_id", "text"))


def text_pages_sql() -> str:
    return f"""
WITH s AS (SELECT doc_id, string_split(text, {NL}) AS parts FROM documents),
u AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS page_text FROM s)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS page_no, page_text,
       printf('page_%04d.png', i - 1) AS page_name
FROM u"""


# --------------------------------------------------------------------------- D3
def text_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_counts(explode_text_pages(_docs(spark, sf_dir, "doc_id", "text")))


def text_page_counts_sql() -> str:
    return f"SELECT doc_id, CAST(len(string_split(text, {NL})) AS BIGINT) AS page_count FROM documents"


# --------------------------------------------------------------------------- D2
def _conversation_pages(spark, sf_dir) -> DataFrame:
    return (read_table(spark, sf_dir, "conversations")
            .select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "role", "text")
            .withColumn("ok", F.col("role") != "system"))


def complete_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return require_all_pages(_conversation_pages(spark, sf_dir)).select(
        F.col("doc_id").alias("conv_id"), F.col("page_no").alias("turn"))


def complete_conversations_sql() -> str:
    return ("SELECT conv_id, turn FROM conversations "
            "WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")


# ---------------------------------------------------------------------- H1, H2
def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _conversation_pages(spark, sf_dir)
    return assemble_documents(pages, "doc_id", "page_no", "text").select(
        F.col("doc_id").alias("conv_id"), "n_pages", "markdown")


def conversation_documents_sql() -> str:
    return f"""
WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_pages,
       {q(fixed.DOC_HEADER)} || string_agg('# Page ' || CAST(k AS VARCHAR) || {NL} || {NL} || text || {q(fixed.PAGE_SEPARATOR)}, '' ORDER BY k) AS markdown
FROM p GROUP BY conv_id"""


# -------------------------------------------------------------- A6 with a commit
def written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's document through the committed sink, and what its file holds."""
    documents = conversation_documents(spark, sf_dir).select(F.concat(F.lit("conversation-"), F.col("conv_id").cast("string"), F.lit(".md")).alias("output_name"),
                                                             "markdown")
    folder = f"{ensure_checkpoint_dir(spark)}/documents-{uuid4().hex}"
    report = write_markdown(documents, folder)
    files = spark.read.text(f"{folder}/*.md", wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1).alias("name"), F.sha2("value", 256).alias("file_sha256"))
    return report.join(files, "name", "full").select("name", "ok", "error", "file_sha256")


def written_documents_sql() -> str:
    return f"""
WITH d AS ({conversation_documents_sql()})
SELECT 'conversation-' || conv_id || '.md' AS name, true AS ok, CAST(NULL AS VARCHAR) AS error, sha256(markdown) AS file_sha256 FROM d"""


# -------------------------------------------------------- D2, H1, H2 as a stream
def streamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the conversations as a stream of pages (system turns are failed pages), assembled in keyed state."""
    schema = read_table(spark, sf_dir, "conversations").schema
    counts = read_table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("_conv")).agg(F.count(F.lit(1)).cast("int").alias("n_pages"))
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations*.parquet")
    turns = turns.join(counts, F.col("conv_id") == F.col("_conv"))
    pages = turns.select("conv_id", "turn", "n_pages", "text", F.when(F.col("role") == "system", F.lit("ValueError: system turn")).alias("error"),
                         F.current_timestamp().alias("arrived"))
    return run_assembly(assemble_stream(pages, "arrived", "conv_id", "turn", "n_pages", "text", "error")).select(
        "conv_id", "status", "n_pages", "markdown", "error")


def streamed_documents_sql() -> str:
    return f"""
WITH d AS ({conversation_documents_sql()}),
bad AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'system' GROUP BY conv_id)
SELECT d.conv_id, CASE WHEN bad.turn IS NULL THEN 'complete' ELSE 'failed' END AS status,
       CASE WHEN bad.turn IS NULL THEN d.n_pages ELSE 0 END AS n_pages, CASE WHEN bad.turn IS NULL THEN d.markdown END AS markdown,
       'page ' || (bad.turn + 1) || ': ValueError: system turn' AS error
FROM d LEFT JOIN bad ON d.conv_id = bad.conv_id"""


# ---------------------------------------------------------------------- H4, H5
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = page_totals(_conversation_pages(spark, sf_dir))
    return batch_summary(totals, "doc_id", F.col("n_pages")).select(F.col("doc_id").alias("conv_id"), "pages", "documents",
                                                   "failed", "summary")


def batch_report_sql() -> str:
    return f"""
WITH good AS (
  SELECT conv_id, count(*) AS n FROM conversations
  WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id
), r AS (
  SELECT i.conv_id, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) i
  LEFT JOIN good g ON g.conv_id = i.conv_id
), a AS (
  SELECT conv_id, CAST(sum(n) AS BIGINT) AS pages, count(*) AS documents,
         CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed,
         grouping(conv_id) AS g
  FROM r GROUP BY ROLLUP (conv_id)
)
SELECT conv_id, pages, documents, failed,
       CASE WHEN g = 1 THEN printf('%d documents, %d pages, %d failed', documents, pages, failed)
            WHEN pages = 0 THEN {q(fixed.BATCH_FAILED)}
            ELSE printf('%d pages extracted', pages) END AS summary
FROM a"""


# --------------------------------------------------------------------------- H6
def first_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("name"))
    return first_document(p, "name")


def first_upload_sql() -> str:
    return "SELECT page_id, url AS name FROM pages ORDER BY url LIMIT 1"


# --------------------------------------------------------------------------- E3
def class_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of an order's status and the words of its priority: some with blanks or capitals, some no label at all."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    said = (F.when(F.col("o_orderstatus") == "F", F.lit("invoice")).when(F.col("o_orderstatus") == "O", F.lit("bill"))
            .otherwise(F.lit("receipt")))
    word = F.substring_index("o_orderpriority", "-", -1)
    answer = (F.when(word == "URGENT", F.upper(said)).when(word == "HIGH", F.concat(F.lit("\t"), F.initcap(said)))
              .when(word == "MEDIUM", F.concat(said, F.lit(" \n"))).when(word == "LOW", F.concat(said, F.lit(" "), F.lower(word)))
              .otherwise(F.lower(word)))
    return (o.select("o_orderkey", answer.alias("class_response"))
            .withColumn("document_type", normalize_label("class_response")))


def class_labels_sql() -> str:
    mapping = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.LABEL_MAP)
    return f"""
WITH w AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'bill' ELSE 'receipt' END AS said,
                  split_part(o_orderpriority, '-', 2) AS word FROM orders),
a AS (SELECT o_orderkey, CASE word WHEN 'URGENT' THEN upper(said) WHEN 'HIGH' THEN chr(9) || upper(said[1]) || said[2:]
                              WHEN 'MEDIUM' THEN said || ' ' || {NL} WHEN 'LOW' THEN said || ' ' || lower(word) ELSE lower(word) END AS class_response FROM w)
SELECT o_orderkey, class_response,
       CASE lower(trim(class_response, {PY_STRIP_SQL})) {mapping} ELSE {q(fixed.DEFAULT_LABEL)} END AS document_type
FROM a"""


# ---------------------------------------------------------------------- E4, E5
SEGMENT_CLASS = [("AUTOMOBILE", "accident_claim"), ("BUILDING", "insurance_form"),
                 ("FURNITURE", "invoice"), ("MACHINERY", "bank_statement")]


def _segment_class(col) -> F.Column:
    out = F.lit("receipt")
    for seg, cls in reversed(SEGMENT_CLASS):
        out = F.when(col == seg, F.lit(cls)).otherwise(out)
    return out


def custom_field_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    fields = F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("segment"), F.col("c_mktsegment"),
                                                         F.lit("name"), F.col("c_name"))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    typed = c.select("c_custkey", _segment_class(F.col("c_mktsegment")).alias("document_type"), fields.alias("f"))
    return typed.select("c_custkey", "document_type",
                        extend_prompt(extraction_prompt(F.col("document_type")), F.col("f")).alias("prompt"))


def custom_field_prompts_sql() -> str:
    by_type = {t: p for kind, t, p in fixed.PROMPT_ROWS if kind == "extraction"}
    seg = " ".join(f"WHEN {q(s)} THEN {q(c)}" for s, c in SEGMENT_CLASS)
    prompt = " ".join(f"WHEN {q(t)} THEN {q(p)}" for t, p in by_type.items())
    return f"""
WITH t AS (
  SELECT c_custkey, c_name, c_mktsegment, c_acctbal,
         CASE c_mktsegment {seg} ELSE 'receipt' END AS document_type FROM customer
)
SELECT c_custkey, document_type,
       CASE document_type {prompt} ELSE {q(fixed.GENERAL_DOCUMENT_PROMPT)} END
       || CASE WHEN c_acctbal > 0 THEN {q(fixed.CUSTOM_FIELDS_INTRO)} || '{{''segment'': ''' || c_mktsegment
               || ''', ''name'': ''' || c_name || '''}}' ELSE '' END AS prompt
FROM t"""


# -------------------------------------------------------------------------- E11
def keyword_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "doc_id", "text")
    return d.select("doc_id", keyword_classify(F.col("text")).alias("document_type"))


def keyword_classes_sql() -> str:
    scores, cases = _keyword_sql("text")
    return f"""
WITH s AS (SELECT doc_id, {scores} FROM documents)
SELECT doc_id, CASE {cases} ELSE 'other' END AS document_type FROM s"""


def _keyword_sql(text: str) -> tuple[str, str]:
    """Score columns of the classes and the CASE branches that choose one."""
    toks = rf"regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}_]+')"
    scores = []
    for cls, words in KEYWORDS:
        inlist = ", ".join(q(w) for w in words)
        scores.append(f"len(list_filter({toks}, lambda w: w IN ({inlist}))) AS s_{cls}")
    names = [cls for cls, _ in KEYWORDS]
    best = "greatest(" + ", ".join(f"s_{c}" for c in names) + ")"
    cases = " ".join(f"WHEN s_{c} = {best} AND {best} > 0 THEN '{c}'" for c in names)
    return ", ".join(scores), cases


# ---------------------------------------------------------------------- E12-15
def contact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "doc_id", "text")
    return d.select("doc_id", extract_emails("text").alias("emails"), extract_phones("text").alias("phones"),
                    extract_amounts("text").alias("amounts"), extract_dates("text").alias("dates"))


def contact_fields_sql() -> str:
    from pagelane.functions.text import AMOUNT_PATTERN, DATE_PATTERN, EMAIL_PATTERN, PHONE_PATTERN
    return f"""
SELECT doc_id,
       regexp_extract_all(text, {q(EMAIL_PATTERN)}) AS emails,
       regexp_extract_all(text, {q(PHONE_PATTERN)}) AS phones,
       list_transform(regexp_extract_all(text, {q(AMOUNT_PATTERN)}),
                      lambda x: TRY_CAST(regexp_replace(x, '[$,]', '', 'g') AS DOUBLE)) AS amounts,
       regexp_extract_all(text, {q(DATE_PATTERN)}) AS dates
FROM documents"""


# ---------------------------------------------------------------------- B1-B5
def upload_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads: the URL's last segment is the file name, the HTML
    bytes are the content; the admission rules give each its verdict."""
    from pagelane.operators.admission import verdict
    p = spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id"])
    name = F.regexp_extract("url", r"([^/]*)$", 1)
    v = verdict(name, F.octet_length("html").cast("long"), F.encode("html", "UTF-8"))
    return p.select("page_id", name.alias("name"), v["is_valid"].alias("is_valid"), v["reason"].alias("reason"))


def upload_verdicts_sql() -> str:
    return f"""
WITH u AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, html FROM pages)
SELECT page_id, name, reason = {q(fixed.MSG_VALID)} AS is_valid, reason FROM (
  SELECT page_id, name,
    CASE WHEN name IS NULL OR name = '' THEN {q(fixed.MSG_NOT_FOUND)}
         WHEN strlen(html) > {fixed.MAX_UPLOAD_BYTES} THEN {q(fixed.MSG_TOO_LARGE)}
         WHEN NOT ends_with(lower(name), '.pdf') THEN {q(fixed.MSG_BAD_TYPE)}
         WHEN NOT starts_with(html, '%PDF') THEN {q(fixed.MSG_BAD_MAGIC)}
         ELSE {q(fixed.MSG_VALID)} END AS reason
  FROM u)"""


# --------------------------------------------------------------------------- H7
def conversation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as an upload named ``conv_<id>.pdf``: its pages are
    the turns that survive D2; the status line follows H7."""
    joined = page_totals(_conversation_pages(spark, sf_dir))
    n = F.col("n_pages")
    name = F.concat(F.lit("conv_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return joined.select(F.col("doc_id").alias("conv_id"),
                         status_message(F.lit(True), F.lit(fixed.MSG_VALID), n, name, n > 0).alias("status"))


def conversation_status_sql() -> str:
    return f"""
WITH g AS (SELECT conv_id, count(*) AS n FROM conversations
           WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id),
i AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id,
  CASE WHEN coalesce(g.n, 0) = 0 THEN {q(fixed.STATUS_NO_PAGES)}
       ELSE '✅ Successfully processed ' || CAST(g.n AS VARCHAR) || ' pages from conv_' || CAST(i.conv_id AS VARCHAR) || '.pdf' END AS status
FROM i LEFT JOIN g ON g.conv_id = i.conv_id"""


# ------------------------------------------------------- B1-B5 + H7, all outcomes
def upload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads whose name, size, bytes and outcome follow the page id:
    every verdict of B1-B5 and every status line of H7 occurs."""
    from pagelane.operators.admission import verdict
    p = spread(read_table(spark, sf_dir, "pages").select("page_id", "html"), ["page_id"])
    k = F.col("page_id") % 10
    stem = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    name = F.when(k == 0, F.lit("")).when(k == 1, F.concat(stem, F.lit(".txt"))).otherwise(F.concat(stem, F.lit(".PDF")))
    size = F.octet_length("html").cast("long") * F.when(k == 2, F.lit(1_000_000)).otherwise(F.lit(1))
    body = F.when(k == 3, F.col("html")).otherwise(F.concat(F.lit("%PDF-1.4\n"), F.col("html")))
    content = F.when(k != 4, F.encode(body, "UTF-8"))
    u = p.select("page_id", name.alias("name"), verdict(name, size, content).alias("v"),
                 F.when(k == 5, F.lit(0)).otherwise(F.regexp_count("html", F.lit("<p>"))).alias("n"), k.alias("k"))
    status = status_message(F.col("v.is_valid"), F.col("v.reason"), F.col("n"), F.col("name"), F.col("k") != 6,
                            F.when(F.col("k") == 7, F.lit("RuntimeError: model failure")))
    return u.select("page_id", "name", F.col("v.is_valid").alias("is_valid"), F.col("v.reason").alias("reason"), status.alias("status"))


def upload_status_sql() -> str:
    return f"""
WITH u AS (
  SELECT page_id, page_id % 10 AS k, len(regexp_extract_all(html, '<p>')) AS p, strlen(html) AS bytes,
         CASE page_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'page_' || page_id || '.txt' ELSE 'page_' || page_id || '.PDF' END AS name
  FROM pages
), v AS (
  SELECT *, CASE WHEN k = 0 THEN 'File not found' WHEN k = 2 AND bytes * 1000000 > 50 * 1024 * 1024 THEN 'File too large (max 50MB)'
                 WHEN k = 1 THEN 'Invalid file type (PDF required)' WHEN k = 4 THEN 'Validation error: content unreadable'
                 WHEN k = 3 THEN 'Invalid PDF file format' ELSE 'Valid PDF file' END AS reason
  FROM u
)
SELECT page_id, name, reason = 'Valid PDF file' AS is_valid, reason,
       CASE WHEN reason <> 'Valid PDF file' THEN '❌ ' || reason
            WHEN k = 7 THEN '❌ Processing error: RuntimeError: model failure'
            WHEN k = 5 OR p = 0 THEN '❌ Failed to extract text from PDF. The file may be corrupted or contain only images.'
            WHEN k = 6 THEN '❌ Markdown file not generated. Processing may have failed.'
            ELSE '✅ Successfully processed ' || p || ' pages from ' || name END AS status
FROM v"""


# ------------------------------------------------------------------ E1, E4, E7
def prompt_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of the three flags with and without a custom prompt;
    the label a classification call would give follows the conversation."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    flags = (F.col("conv_id") * 3 + F.col("turn")) % 8
    label = F.element_at(F.array(*[F.lit(t) for t in fixed.DOCUMENT_TYPES]), (F.col("conv_id") % 7 + 1).cast("int"))
    pages = c.select("conv_id", "turn", flags.cast("int").alias("flags"), label.alias("document_type"),
                     F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), normalize_prompt("text")).alias("custom_prompt"))

    def on(bit):
        return F.col("flags").bitwiseAND(F.lit(bit)) > 0
    return page_prompts(pages, "document_type", "custom_prompt", on(1), on(2), on(4)).select(
        "conv_id", "turn", "flags", F.col("classification_prompt").isNotNull().alias("classified"), "page_prompt", "n_calls")


def prompt_routes_sql() -> str:
    types = ", ".join(q(t) for t in fixed.DOCUMENT_TYPES)
    prompt = " ".join(f"WHEN {q(t)} THEN {q(p)}" for kind, t, p in fixed.PROMPT_ROWS if kind == "extraction")
    return f"""
WITH c AS (
  SELECT conv_id, turn, ((conv_id * 3 + turn) % 8)::INTEGER AS flags, list_extract([{types}], (conv_id % 7 + 1)::INTEGER) AS label,
         CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN coalesce(trim(text, {PY_STRIP_SQL}), '') ELSE '' END AS custom
  FROM conversations
), d AS (SELECT *, flags & 1 > 0 AND flags & 4 > 0 AND custom = '' AS classified FROM c)
SELECT conv_id, turn, flags, classified,
       CASE WHEN custom <> '' THEN custom WHEN flags & 1 = 0 OR flags & 2 = 0 THEN {q(fixed.MARKDOWN_FALLBACK_PROMPT)}
            ELSE CASE CASE WHEN classified THEN label ELSE 'other' END {prompt} ELSE {q(fixed.GENERAL_DOCUMENT_PROMPT)} END END AS page_prompt,
       CASE WHEN classified THEN 2 ELSE 1 END AS n_calls
FROM d"""


# ------------------------------------------------------------- E8, E10, F12, G1
def page_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty and missing answers, bare fences, both structured flags and custom
    prompts: the page text is the rendering or the raw answer."""
    o = spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    key = F.col("o_orderkey")
    body = F.concat(F.lit('{"title": "'), F.col("o_orderpriority"), F.lit('"}'))
    answer = (F.when(key % 6 == 0, F.lit(None)).when(key % 6 == 1, F.lit("")).when(key % 6 == 2, F.concat(F.lit("```\n"), body, F.lit("\n```")))
              .otherwise(body))
    pages = o.select("o_orderkey", F.lit("other").alias("document_type"), empty_response(answer).alias("response"),
                     (key % 5 != 0).alias("manager_structured"), (key % 4 != 0).alias("call_structured"),
                     F.when(key % 7 == 0, F.lit("Describe it")).alias("custom_prompt"))
    parsed = parse_responses(pages, "response", "document_type", structured=F.col("manager_structured"), with_markdown=True)
    return parsed.select("o_orderkey", "parse_status", choose_output(
        F.col("call_structured"), F.col("custom_prompt"), F.col("markdown"), F.col("response")).alias("page_text"))


def page_choices_sql() -> str:
    return f"""
WITH a AS (
  SELECT o_orderkey AS k, o_orderpriority AS t, '{{"title": "' || o_orderpriority || '"}}' AS body FROM orders
), r AS (
  SELECT *, CASE WHEN k % 6 < 2 THEN '' WHEN k % 6 = 2 THEN '```' || {NL} || body || {NL} || '```' ELSE body END AS response,
         CASE WHEN k % 6 < 2 THEN 'empty' WHEN k % 5 = 0 THEN 'disabled' WHEN k % 6 = 2 THEN 'bad_json' ELSE 'ok' END AS parse_status
  FROM a
)
SELECT k AS o_orderkey, parse_status,
       CASE WHEN parse_status = 'ok' AND k % 4 <> 0 AND k % 7 <> 0
            THEN '# Document' || {NL} || {NL} || '**Title:** ' || t || {NL} || '**Date:** N/A' || {NL} || {NL} ELSE response END AS page_text
FROM r"""


# --------------------------------------------------------------------- E14, E15
def order_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and dates found in a sentence about each order."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    price = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(": $"), price, F.lit(" due "),
                    F.date_format("o_orderdate", "M/d/yyyy"), F.lit(", placed "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" ($7 fee)."))
    return o.select("o_orderkey", extract_amounts(text).alias("amounts"), extract_dates(text).alias("dates"))


def order_mentions_sql() -> str:
    return """
SELECT o_orderkey, [CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE), 7.0::DOUBLE] AS amounts,
       [strftime(o_orderdate, '%-m/%-d/%Y'), strftime(o_orderdate, '%Y-%m-%d')] AS dates FROM orders"""


# ------------------------------------------------------------- D1 as page ranges
RANGE_PAGES = 8


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents planned as ranges of ``RANGE_PAGES`` pages (lines), each with its text."""
    ranges = text_ranges(read_table(spark, sf_dir, "documents").select("doc_id", "text"), RANGE_PAGES)
    return ranges.select("doc_id", "n_pages", "first_page", "end_page", content_hash("range_text").alias("range_sha256"))


def page_ranges_sql() -> str:
    return f"""
WITH s AS (SELECT doc_id, string_split(text, {NL}) AS parts FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, parts, unnest(range(0, len(parts), {RANGE_PAGES})) AS first_page FROM s)
SELECT doc_id, len(parts)::INTEGER AS n_pages, first_page::INTEGER AS first_page,
       least(first_page + {RANGE_PAGES}, len(parts))::INTEGER AS end_page,
       sha256(array_to_string(list_slice(parts, first_page + 1, first_page + {RANGE_PAGES}), {NL})) AS range_sha256
FROM r"""


# ------------------------------------------------- E2, E9 with an answer store
ANSWER_BATCHES = 4


def _offline_call(rows: DataFrame) -> DataFrame:
    """E11 in the place of the model: the class of a page's text; a page without a letter fails."""
    failed = ~F.col("payload").rlike(r"\p{L}")
    return rows.select("key", F.when(~failed, keyword_classify(F.col("payload"))).alias("response"),
                       F.when(failed, F.lit("ValueError: no text")).alias("response_error"))


def _page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classification request per page, of documents dealt out as page ranges."""
    ranges = text_ranges(read_table(spark, sf_dir, "documents").select("doc_id", "text"), RANGE_PAGES)
    pages = range_text_pages(deal_ranges(ranges))
    return pages.select("doc_id", "page_no", F.col("page_text").alias("payload"), F.lit(fixed.CLASSIFICATION_PROMPT).alias("prompt"))


def _new_store(spark: SparkSession) -> AnswerStore:
    return AnswerStore(spark, f"{ensure_checkpoint_dir(spark)}/answers-{uuid4().hex}")


def answered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its class or its error; identical pages are asked once, in batches kept in a store."""
    answered = answer_requests(_page_requests(spark, sf_dir), _new_store(spark), _offline_call, "only", batches=ANSWER_BATCHES)
    return answered.select("doc_id", "page_no", F.col("response").alias("document_type"), "error")


def answered_pages_sql() -> str:
    scores, cases = _keyword_sql("page_text")
    return f"""
WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, {NL}), 1) AS i, unnest(string_split(text, {NL})) AS page_text FROM documents),
s AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS page_no, regexp_matches(page_text, '\\p{{L}}') AS good, {scores} FROM p)
SELECT doc_id, page_no, CASE WHEN good THEN CASE {cases} ELSE 'other' END END AS document_type,
       CASE WHEN NOT good THEN 'ValueError: no text' END AS error FROM s"""


def answer_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs over the same pages cost: the second makes only the calls that failed in the first."""
    store, requests = _new_store(spark), _page_requests(spark, sf_dir)
    for run in ("first", "second"):
        answer_requests(requests, store, _offline_call, run, batches=ANSWER_BATCHES)
    calls = store.calls().groupBy(F.substring_index("batch", ".", 1).alias("run")).agg(
        F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed"))
    runs = F.explode(F.array(F.lit("first"), F.lit("second"))).alias("run")
    asked = requests.agg(F.count(F.lit(1)).alias("requests")).select(runs, "requests")
    return asked.join(calls, "run", "left").select("run", "requests", F.coalesce("calls", F.lit(0)).alias("calls"),
                                                   F.coalesce("failed", F.lit(0)).alias("failed"))


def answer_calls_sql() -> str:
    return f"""
WITH p AS (SELECT unnest(string_split(text, {NL})) AS page_text FROM documents),
d AS (SELECT count(*) AS requests, count(DISTINCT page_text) AS pages,
             count(DISTINCT CASE WHEN NOT regexp_matches(page_text, '\\p{{L}}') THEN page_text END) AS failed FROM p)
SELECT 'first' AS run, requests, pages AS calls, failed FROM d
UNION ALL SELECT 'second', requests, failed, failed FROM d"""


QUERIES = {
    "page_ranges": (page_ranges, page_ranges_sql),
    "answered_pages": (answered_pages, answered_pages_sql),
    "answer_calls": (answer_calls, answer_calls_sql),
    "user_inputs": (user_inputs, user_inputs_sql),
    "upload_status": (upload_status, upload_status_sql),
    "prompt_routes": (prompt_routes, prompt_routes_sql),
    "page_choices": (page_choices, page_choices_sql),
    "order_mentions": (order_mentions, order_mentions_sql),
    "upload_verdicts": (upload_verdicts, upload_verdicts_sql),
    "conversation_status": (conversation_status, conversation_status_sql),
    "text_sanitize": (text_sanitize, text_sanitize_sql),
    "upload_names": (upload_names, upload_names_sql),
    "document_hashes": (document_hashes, document_hashes_sql),
    "custom_prompts": (custom_prompts, custom_prompts_sql),
    "text_pages": (text_pages, text_pages_sql),
    "text_page_counts": (text_page_counts, text_page_counts_sql),
    "complete_conversations": (complete_conversations, complete_conversations_sql),
    "conversation_documents": (conversation_documents, conversation_documents_sql),
    "batch_report": (batch_report, batch_report_sql),
    "written_documents": (written_documents, written_documents_sql),
    "streamed_documents": (streamed_documents, streamed_documents_sql),
    "first_upload": (first_upload, first_upload_sql),
    "class_labels": (class_labels, class_labels_sql),
    "custom_field_prompts": (custom_field_prompts, custom_field_prompts_sql),
    "keyword_classes": (keyword_classes, keyword_classes_sql),
    "contact_fields": (contact_fields, contact_fields_sql),
}
