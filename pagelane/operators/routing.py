"""Classification labels and prompt routing.

The label map (13 entries) and the prompt table (8 rows) are fixed-size,
so lookups are literal maps evaluated inside generated code: no join and
no exchange at all, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelane.functions import fixed
from pagelane.functions.text import py_strip, python_text
from pagelane.operators.records import SCHEMAS, TRANSACTION_FIELDS, _SPARK_TYPES


def _literal_map(pairs) -> Column:
    args = []
    for k, v in pairs:
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def normalize_label(c) -> Column:
    """Strip + lower, exact lookup in the 13 keys, default ``other``."""
    col = F.col(c) if isinstance(c, str) else c
    key = F.lower(py_strip(F.coalesce(col, F.lit(""))))
    return F.coalesce(F.try_element_at(_literal_map(fixed.LABEL_MAP), key), F.lit(fixed.DEFAULT_LABEL))


def extraction_prompt(document_type, custom_prompt=None, structured: bool = True) -> Column:
    """Custom prompt wins; else the class's prompt (General by default);
    with structured extraction off, the markdown fallback prompt."""
    dt = F.col(document_type) if isinstance(document_type, str) else document_type
    if structured:
        by_type = [(t, p) for kind, t, p in fixed.PROMPT_ROWS if kind == "extraction"]
        chosen = F.coalesce(F.try_element_at(_literal_map(by_type), dt), F.lit(fixed.GENERAL_DOCUMENT_PROMPT))
    else:
        chosen = F.lit(fixed.MARKDOWN_FALLBACK_PROMPT)
    if custom_prompt is not None:
        cp = F.col(custom_prompt) if isinstance(custom_prompt, str) else custom_prompt
        chosen = F.when(F.coalesce(cp, F.lit("")) != "", cp).otherwise(chosen)
    return chosen


def route_prompts(df: DataFrame, custom_col: str | None = "custom_prompt",
                  classification: bool = True) -> DataFrame:
    """``(extraction_prompt, classification_prompt)`` per row.

    custom prompt -> (custom, NULL); classification off -> (fallback, NULL);
    on and no custom -> (NULL, classification prompt).
    """
    custom = F.col(custom_col) if custom_col else F.lit(None).cast("string")
    has_custom = F.coalesce(custom, F.lit("")) != ""
    if classification:
        extraction = F.when(has_custom, custom)
        cls = F.when(~has_custom, F.lit(fixed.CLASSIFICATION_PROMPT))
    else:
        extraction = F.when(has_custom, custom).otherwise(F.lit(fixed.MARKDOWN_FALLBACK_PROMPT))
        cls = F.lit(None).cast("string")
    return (df.withColumn("extraction_prompt", extraction.cast("string"))
            .withColumn("classification_prompt", cls.cast("string")))


def page_prompts(df: DataFrame, label_col: str = "document_type", custom_col: str | None = "custom_prompt",
                 classification: Column | bool = True, manager_structured: Column | bool = True,
                 call_structured: Column | bool = True) -> DataFrame:
    """E1 + E4 + E7 per page: ``classification_prompt`` (NULL: no such call),
    ``page_prompt`` of the extraction call and ``n_calls``.

    Three flags, literals or columns. The manager's classification flag off
    gives the markdown fallback prompt; the call's structured flag off only
    skips the classification call, so the page counts as ``other``; the
    manager's structured flag off gives the fallback prompt for every label.
    """
    def flag(x):
        return x if isinstance(x, Column) else F.lit(bool(x))

    custom = F.col(custom_col) if custom_col else F.lit(None).cast("string")
    has_custom = F.coalesce(custom, F.lit("")) != ""
    classify = flag(classification) & ~has_custom & flag(call_structured)
    label = F.when(classify, F.coalesce(F.col(label_col), F.lit(fixed.DEFAULT_LABEL))).otherwise(F.lit(fixed.DEFAULT_LABEL))
    fallback = F.lit(fixed.MARKDOWN_FALLBACK_PROMPT)
    prompt = (F.when(has_custom, custom).when(~flag(classification), fallback)
              .when(~flag(manager_structured), fallback).otherwise(extraction_prompt(label)))
    return (df.withColumn("classification_prompt", F.when(classify, F.lit(fixed.CLASSIFICATION_PROMPT)))
            .withColumn("page_prompt", prompt)
            .withColumn("n_calls", F.when(classify, F.lit(2)).otherwise(F.lit(1))))


def _python_dict_text(m: Column, kind: str) -> Column:
    """Render MAP<STRING, ...> as Python's ``{'k': v, ...}`` text."""
    entries = F.transform(F.map_entries(m), lambda e: F.concat(
        python_text(e["key"], "string"), F.lit(": "), python_text(e["value"], kind)))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def extend_prompt(base: Column, custom_fields: Column, kind: str = "string") -> Column:
    """E5: append the additional-fields instruction when fields are given.
    ``kind`` is the type of the map's values: string, boolean or number."""
    return F.when(F.coalesce(F.size(custom_fields) > 0, F.lit(False)),
                  F.concat(base, F.lit(fixed.CUSTOM_FIELDS_INTRO), _python_dict_text(custom_fields, kind))
                  ).otherwise(base)


def empty_response(c) -> Column:
    """Missing answer text becomes ``''``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col, F.lit(""))


def choose_output(structured: Column, custom_prompt: Column, rendered: Column, raw: Column) -> Column:
    """parse+render only with structured extraction on and no custom prompt."""
    use_render = structured & (F.coalesce(custom_prompt, F.lit("")) == "")
    return F.when(use_render, rendered).otherwise(raw)


def prompt_table(spark: SparkSession) -> DataFrame:
    """The 8 constant prompts as ``(kind, document_type, prompt)``."""
    return spark.createDataFrame(fixed.PROMPT_ROWS, "kind string, document_type string, prompt string")


def schema_catalog(spark: SparkSession) -> DataFrame:
    """One row per field of each record schema (plus the nested transaction)."""
    rows = []
    for st, fields in list(SCHEMAS.items()) + [("transaction", TRANSACTION_FIELDS)]:
        for pos, (name, kind) in enumerate(fields):
            required = kind == "txlist" or (kind == "doctype")
            rows.append((st, pos, name, _SPARK_TYPES[kind], not required, fixed.FIELD_DESCRIPTIONS[st][pos]))
    return spark.createDataFrame(
        rows, "schema_type string, position int, field string, data_type string, nullable boolean, description string")


def prompt_lengths(spark: SparkSession) -> DataFrame:
    """Prompt characters per document class (all 7 enum members); classes
    without their own prompt use the General prompt."""
    classes = spark.createDataFrame([(t,) for t in fixed.DOCUMENT_TYPES], "document_type string")
    prompts = prompt_table(spark).filter(F.col("kind") == "extraction").select("document_type", "prompt")
    return (classes.join(F.broadcast(prompts), "document_type", "left")
            .select("document_type", F.length(F.coalesce("prompt", F.lit(fixed.GENERAL_DOCUMENT_PROMPT)))
                    .alias("prompt_chars")))


def run_id() -> Column:
    """8 hex characters identifying one run, made once on the driver and
    carried as a literal (never compared across runs)."""
    import secrets
    return F.lit(secrets.token_hex(4))
