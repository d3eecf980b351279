"""Model calls as Spark stages (E2, E7, E9) and the offline keyword
classifier (E11).

A provider is any picklable callable ``provider(payloads, prompts) ->
list[str | None]``, built once per partition (``factory()``) and called from
up to ``CONCURRENCY`` threads of the task, a page at a time, because one call
takes seconds and waits for the network. Every page is isolated: an exception
gives ``text=NULL, error=...`` for that page and the rest goes on. Answers are
not deterministic and a retried task calls the model again, so they are written
to the shared folder before anything reads them twice.
"""

from __future__ import annotations

import json
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from hashlib import sha256
from itertools import islice
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelane.functions import fixed
from pagelane.operators.answer_store import answer_key
from pagelane.operators.ranges import UNRENDERED, RangeReader, range_rows
from pagelane.session import ensure_checkpoint_dir
from pagelane.sources.files import read_document

CONCURRENCY = 4
_ROWS_PER_BATCH = 256


def provider_options() -> dict:
    """Options every provider receives: the system instruction and the
    generation settings (the prompt table's ``system`` row, E16)."""
    return {"system_instruction": fixed.SYSTEM_INSTRUCTION, "generation": dict(fixed.GENERATION_SETTINGS)}


def call_provider(df: DataFrame, factory: Callable[..., Callable], payload_col: str, prompt_col: str,
                  out_col: str = "response", partitions: int | None = None,
                  key_cols=("doc_id", "page_no"), options: dict | None = None,
                  concurrency: int = CONCURRENCY) -> DataFrame:
    """Run ``factory(**options)`` once per partition over ``(payload, prompt)``
    rows (``factory()`` when no options are given).

    Rows whose prompt is NULL are passed through without a call.
    ``partitions`` x ``concurrency`` bounds the calls in flight (explicit
    count, so AQE does not coalesce it away); pages of one document are spread
    by ``(doc_id, page_no)`` hashing.
    """
    import pandas as pd

    keys = [k for k in key_cols if k in df.columns]
    src = df
    if partitions:
        src = df.repartition(int(partitions), *keys) if keys else df.repartition(int(partitions))
    schema = src.schema.simpleString()[len("struct<"):-1]
    out_schema = f"{schema}, {out_col} string, {out_col}_error string"

    opts = dict(options or {})

    def run(batches):
        model = factory(**opts) if opts else factory()

        def one(pair):
            payload, prompt = pair
            if prompt is None or (isinstance(prompt, float) and pd.isna(prompt)):
                return None, None
            return _answer(model, payload, prompt)

        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                answers = list(pool.map(one, zip(pdf[payload_col], pdf[prompt_col])))
                pdf = pdf.copy()
                pdf[out_col] = [text for text, _ in answers]
                pdf[f"{out_col}_error"] = [error for _, error in answers]
                yield pdf

    return src.mapInPandas(run, out_schema)


def _answer(model, payload, prompt):
    """``(text, error)`` of one call."""
    try:
        answer = model([payload], [prompt])[0]
        return (None if answer is None else str(answer)), None
    except Exception as exc:
        return None, f"{type(exc).__name__}: {exc}"


def _answered_page(model, prompts, number, image):
    """``(page number, label, text, error)`` of one page: its one or two calls."""
    label = prompts.label(_answer(model, image, fixed.CLASSIFICATION_PROMPT)[0] if prompts.classify else None)
    text, error = _answer(model, image, prompts.prompt(label))
    return number, label, text or "", error


def _in_flight(pool, work, items, limit):
    """Results of ``work(item)`` in order, never more than ``limit`` items taken ahead."""
    items, waiting = iter(items), deque()
    for item in islice(items, limit):
        waiting.append(pool.submit(work, item))
    while waiting:
        yield waiting.popleft().result()
        for item in islice(items, 1):
            waiting.append(pool.submit(work, item))


class PagePrompts:
    """Which calls a page gets, in a task (see ``routing.page_prompts`` for the flags)."""

    def __init__(self, custom_prompt: str | None, classification: bool, manager_structured: bool, call_structured: bool):
        self.custom = custom_prompt
        self.classify = bool(classification and call_structured and not custom_prompt)
        self.fallback = not classification or not manager_structured
        self.labels = dict(fixed.LABEL_MAP)
        self.by_label = {t: prompt for kind, t, prompt in fixed.PROMPT_ROWS if kind == "extraction"}

    def label(self, said: str | None) -> str:
        return self.labels.get((said or "").strip().lower(), fixed.DEFAULT_LABEL)

    def prompt(self, label: str) -> str:
        if self.custom:
            return self.custom
        return fixed.MARKDOWN_FALLBACK_PROMPT if self.fallback else self.by_label.get(label, fixed.GENERAL_DOCUMENT_PROMPT)


class PageKeys(PagePrompts):
    """Store keys of a page's calls: as columns, and the same in a task."""

    def __init__(self, custom_prompt, classification, manager_structured, call_structured, options: dict | None = None):
        super().__init__(custom_prompt, classification, manager_structured, call_structured)
        self.options = dict(options or {})

    def classification(self, page_hash: Column) -> Column:
        prompt = F.lit(fixed.CLASSIFICATION_PROMPT if self.classify else None).cast("string")
        return answer_key(page_hash, prompt, self.options)

    def label_of(self, said: Column) -> Column:
        from pagelane.operators.routing import normalize_label
        return F.when(F.coalesce(said, F.lit("")) == "", F.lit(fixed.DEFAULT_LABEL)).otherwise(normalize_label(said))

    def extraction(self, page_hash: Column, label: Column) -> Column:
        if self.custom or self.fallback:
            return answer_key(page_hash, F.lit(self.prompt(fixed.DEFAULT_LABEL)), self.options)
        prompt = F.lit(fixed.GENERAL_DOCUMENT_PROMPT)
        for name, text in self.by_label.items():
            prompt = F.when(label == name, F.lit(text)).otherwise(prompt)
        return answer_key(page_hash, prompt, self.options)

    def key(self, page_hash: str, prompt: str) -> str:
        """``answer_key`` in a task."""
        parts = (page_hash, sha256(prompt.encode()).hexdigest(), json.dumps(self.options, sort_keys=True))
        return sha256("|".join(parts).encode()).hexdigest()


ANSWER_SCHEMA = "page_no int, document_type string, response string, error string"


def answer_documents(docs: DataFrame, renderer, factory, custom_prompt: str | None = None, classification: bool = True,
                     manager_structured: bool = True, call_structured: bool = True, options: dict | None = None,
                     partitions: int | None = None, concurrency: int = CONCURRENCY, doc_col: str = "doc_id",
                     content_col: str = "content") -> DataFrame:
    """D1 + E1-E9 in one Python stage: binary documents to answered pages.

    Renders a document's pages one after the other, classifies and extracts up
    to ``concurrency`` of them at a time and emits text only:
    ``(doc_id, page_no, document_type, response, error)``. A page whose call
    fails keeps its row with an empty response and the error; a document that
    cannot be rendered gives no page but one row with ``page_no = -1``.
    """
    import pandas as pd

    opts = dict(options or {})
    prompts = PagePrompts(custom_prompt, classification, manager_structured, call_structured)

    def run(batches):
        model = factory(**opts) if opts else factory()

        def one(numbered):
            return _answered_page(model, prompts, *numbered)

        def pages_of(content, pool):
            try:
                yield from _in_flight(pool, one, enumerate(renderer(content)), concurrency)
            except Exception as exc:  # one document fails, the batch goes on
                yield -1, None, None, f"{type(exc).__name__}: {exc}"

        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                for doc, content in zip(pdf[doc_col], pdf[content_col]):
                    rows = pages_of(content, pool)
                    while chunk := list(islice(rows, _ROWS_PER_BATCH)):
                        yield pd.DataFrame([(doc, *row) for row in chunk],
                                           columns=[doc_col, "page_no", "document_type", "response", "error"])

    doc_type = docs.schema[doc_col].dataType.simpleString()
    source = docs.select(doc_col, content_col)
    if partitions:
        source = source.repartition(int(partitions), doc_col)
    return source.mapInPandas(run, f"{doc_col} {doc_type}, {ANSWER_SCHEMA}")


def answer_ranges(ranges: DataFrame, renderer, factory, custom_prompt: str | None = None, classification: bool = True,
                  manager_structured: bool = True, call_structured: bool = True, options: dict | None = None,
                  concurrency: int = CONCURRENCY, doc_col: str = "doc_id", fetch: Callable = read_document) -> DataFrame:
    """``answer_documents`` over page ranges (``operators.ranges``): the pages of one document are answered by many tasks.

    A range that fails adds a row with ``page_no = -1`` to the pages before it."""
    import pandas as pd

    opts = dict(options or {})
    prompts = PagePrompts(custom_prompt, classification, manager_structured, call_structured)

    def run(batches):
        model, reader = factory(**opts) if opts else factory(), RangeReader(renderer, fetch)

        def one(numbered):
            return _answered_page(model, prompts, *numbered)

        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                for doc, first, end, given in range_rows(pdf, doc_col):
                    rows = []
                    try:
                        rows.extend(_in_flight(pool, one, reader.pages(doc, first, end, given), concurrency))
                    except Exception as exc:  # one range fails, the others go on
                        rows.append((UNRENDERED, None, None, f"{type(exc).__name__}: {exc}"))
                    yield pd.DataFrame([(doc, *row) for row in rows], columns=[doc_col, "page_no", "document_type", "response", "error"])

    columns = [doc_col, "first_page", "end_page", *(["_content"] if "_content" in ranges.columns else [])]
    doc_type = ranges.schema[doc_col].dataType.simpleString()
    return ranges.select(*columns).mapInPandas(run, f"{doc_col} {doc_type}, {ANSWER_SCHEMA}")


def hash_ranges(ranges: DataFrame, renderer, doc_col: str = "doc_id", fetch: Callable = read_document) -> DataFrame:
    """``(doc_id, first_page, end_page, page_no, page_hash, error)``: C1 of every rendered page; the images stay in the task."""
    import pandas as pd

    def run(batches):
        reader = RangeReader(renderer, fetch)
        names = [doc_col, "first_page", "end_page", "page_no", "page_hash", "error"]
        for pdf in batches:
            for doc, first, end, given in range_rows(pdf, doc_col):
                rows = []
                try:
                    for number, image in reader.pages(doc, first, end, given):
                        rows.append((doc, first, end, number, sha256(bytes(image)).hexdigest(), None))
                except Exception as exc:  # one range fails, the others go on
                    rows.append((doc, first, end, UNRENDERED, None, f"{type(exc).__name__}: {exc}"))
                yield pd.DataFrame(rows, columns=names)

    columns = [doc_col, "first_page", "end_page", *(["_content"] if "_content" in ranges.columns else [])]
    doc_type = ranges.schema[doc_col].dataType.simpleString()
    return ranges.select(*columns).mapInPandas(run, f"{doc_col} {doc_type}, first_page int, end_page int, page_no int, page_hash string, error string")


def answer_wanted_pages(ranges: DataFrame, renderer, factory, keys: PageKeys, concurrency: int = CONCURRENCY,
                        doc_col: str = "doc_id", fetch: Callable = read_document) -> DataFrame:
    """``(key, response, error)`` of the calls made for the ``wanted`` pages of each range.

    ``wanted`` holds ``(page_no, page_hash, class_response)``; a stored
    classification is not asked again. Ranges end with their last wanted page."""
    import pandas as pd

    opts = dict(keys.options)

    def run(batches):
        model, reader = factory(**opts) if opts else factory(), RangeReader(renderer, fetch)

        def one(page):
            (_, page_hash, said), image = page
            rows = []
            if keys.classify and said is None:
                said, error = _answer(model, image, fixed.CLASSIFICATION_PROMPT)
                rows.append((keys.key(page_hash, fixed.CLASSIFICATION_PROMPT), said if error else said or "", error))
            prompt = keys.prompt(keys.label(said))
            text, error = _answer(model, image, prompt)
            return rows + [(keys.key(page_hash, prompt), text if error else text or "", error)]

        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                for (doc, first, end, given), wanted in zip(range_rows(pdf, doc_col), pdf["wanted"]):
                    asked = {int(w["page_no"]): (w["page_no"], w["page_hash"], w["class_response"]) for w in wanted}
                    pages = ((asked[number], image) for number, image in reader.pages(doc, first, end, given) if number in asked)
                    rows = [row for found in _in_flight(pool, one, pages, concurrency) for row in found]
                    yield pd.DataFrame(rows, columns=["key", "response", "error"])

    columns = [doc_col, "first_page", "end_page", "wanted", *(["_content"] if "_content" in ranges.columns else [])]
    return ranges.select(*columns).mapInPandas(run, "key string, response string, error string")


def stage(df: DataFrame) -> DataFrame:
    """Persist model answers reliably (shared checkpoint folder) so later
    actions and retries never call the model again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def classify_pages(pages: DataFrame, factory, payload_col: str = "payload", partitions: int | None = None,
                   call_structured: bool = True, custom_col: str | None = None, options: dict | None = None,
                   classification: bool = True) -> DataFrame:
    """E2 + E3: classify a page only when the manager's classification and the
    call's structured flag are on and no custom prompt is given; failures and
    empty answers become ``other``."""
    from pagelane.operators.routing import normalize_label, page_prompts

    routed = page_prompts(pages.withColumn("_label", F.lit(None).cast("string")), "_label", custom_col,
                          classification, True, call_structured)
    with_prompt = routed.withColumnRenamed("classification_prompt", "_cls_prompt").drop("page_prompt", "n_calls", "_label")
    called = call_provider(with_prompt, factory, payload_col, "_cls_prompt", "class_response", partitions,
                           options=options)
    label = F.when(F.coalesce(F.col("class_response"), F.lit("")) == "", F.lit("other")) \
        .otherwise(normalize_label("class_response"))
    return called.withColumn("document_type", label).drop("_cls_prompt")


def extract_pages(pages: DataFrame, factory, payload_col: str = "payload", partitions: int | None = None,
                  manager_structured: bool = True, custom_col: str | None = None, options: dict | None = None,
                  classification: bool = True, call_structured: bool = True) -> DataFrame:
    """E4 + E7 + E8 + E9: second call with the routed prompt; the page text
    is ``coalesce(answer, '')`` and the error is kept beside it."""
    from pagelane.operators.routing import page_prompts

    routed = page_prompts(pages, "document_type", custom_col, classification, manager_structured, call_structured)
    with_prompt = routed.withColumnRenamed("page_prompt", "_ext_prompt").drop("classification_prompt", "n_calls")
    called = call_provider(with_prompt, factory, payload_col, "_ext_prompt", "response", partitions,
                           options=options)
    return called.withColumn("response", F.coalesce(F.col("response"), F.lit(""))).drop("_ext_prompt")


# FIXED VALUES: keywords per class, from the class descriptions of the
# classification prompt, in prompt order (ties go to the earlier class).
KEYWORDS = [
    ("bank_statement", ["bank", "account", "statement", "transaction", "balance", "deposit", "withdrawal"]),
    ("insurance_form", ["insurance", "policy", "insured", "premium", "coverage"]),
    ("accident_claim", ["accident", "incident", "collision", "vehicle", "injury", "claim"]),
    ("invoice", ["invoice", "bill", "receipt", "subtotal", "tax"]),
]


def _in_list(words):
    return lambda t: t.isin(*words)


def keyword_scores(tokens: Column) -> Column:
    """ARRAY<INT> of hits per class, in ``KEYWORDS`` order: lower-cased word
    tokens (runs of letters, digits, ``_``) found in the class's list."""
    return F.array(*[F.size(F.filter(tokens, _in_list(words))) for _, words in KEYWORDS])


def keyword_classify(text: Column) -> Column:
    """Class with the most keyword hits (ties: earlier class); none ->
    ``other``. Tokens and scores are bound once through one-element
    ``transform`` calls, so each is computed a single time per row."""
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    names = F.array(*[F.lit(cls) for cls, _ in KEYWORDS])

    def decide(scores: Column) -> Column:
        best = F.array_max(scores)
        return F.when(best > 0, F.element_at(names, F.array_position(scores, best).cast("int"))) \
            .otherwise(F.lit("other"))

    scored = F.transform(F.array(tokens), keyword_scores)
    return F.element_at(F.transform(scored, decide), 1)
