"""Page ranges (D1) and stored answers (E2, E7): spread, order, all-or-nothing, calls made."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pagelane.functions import fixed
from pagelane.operators import answer_store
from pagelane.operators.admission import admit_folder
from pagelane.operators.answer_store import AnswerStore, answer_document_ranges, answer_requests
from pagelane.operators.provider import PageKeys, answer_documents, answer_ranges, call_provider
from pagelane.operators.ranges import (count_document_pages, deal_ranges, plan_ranges, range_text_pages, render_ranges, text_ranges,
                                       whole_documents, with_contents)
from pagelane.plans.documents import process_documents

DOCS = "doc_id string, content binary"


def count_bytes(content):
    if bytes(content).startswith(b"closed"):
        raise ValueError("cannot open")
    return bytes(content).count(b"|") + 1


def render(content, first, end):
    """Pages are parts of the content; one that says so cannot be rendered, a short document gives too few."""
    parts = bytes(content).split(b"|")
    for number in range(first, end):
        if parts[number] == b"torn":
            raise ValueError("cannot rasterise")
        if parts[number] != b"missing":
            yield parts[number]


def render_with_task(content, first, end):
    from pyspark import TaskContext
    for payload in render(content, first, end):
        yield payload + b"@%d" % TaskContext.get().partitionId()




def documents(spark, rows):
    return spark.createDataFrame([(d, bytearray(c)) for d, c in rows], DOCS)


def test_a_long_document_is_spread_over_tasks(spark):
    long = b"|".join(b"p%d" % i for i in range(5000))
    docs = documents(spark, [("long", long), ("short", b"a|b"), ("closed", b"closed")])
    counts = count_document_pages(docs, count_bytes, content_col="content")
    found = {r.doc_id: (r.n_pages, r.error) for r in counts.collect()}
    assert found == {"long": (5000, None), "short": (2, None), "closed": (0, "ValueError: cannot open")}
    ranges = with_contents(plan_ranges(counts, 50), docs)
    pages = whole_documents(render_ranges(deal_ranges(ranges, 8), render_with_task), counts).collect()
    mine = sorted((r.page_no, bytes(r.payload).split(b"@")) for r in pages if r.doc_id == "long")
    assert [n for n, _ in mine] == list(range(5000)) and [p[0] for _, p in mine] == [b"p%d" % i for i in range(5000)]
    tasks = {int(p[1]) for _, p in mine}
    assert len(tasks) == 8  # every task has pages of the one document
    assert max(sum(int(p[1]) == t for _, p in mine) for t in tasks) < 2500
    assert [(r.page_no, r.error) for r in pages if r.doc_id == "closed"] == [(-1, "ValueError: cannot open")]


def test_one_failed_range_fails_its_document(spark):
    docs = documents(spark, [("torn", b"a|b|c|torn|e|f"), ("good", b"x|y|z"), ("short", b"u|v|missing"), ("empty", b"")])
    counts = count_document_pages(docs, count_bytes, content_col="content")
    ranges = deal_ranges(with_contents(plan_ranges(counts, 2), docs), 4)
    pages = whole_documents(render_ranges(ranges, render), counts)
    got = {}
    for r in pages.collect():
        got.setdefault(r.doc_id, []).append((r.page_no, None if r.payload is None else bytes(r.payload), r.error))
    assert sorted(got["good"]) == [(0, b"x", None), (1, b"y", None), (2, b"z", None)]
    assert got["torn"] == [(-1, None, "ValueError: cannot rasterise")]
    assert got["short"] == [(-1, None, "ValueError: 0 of 1 pages from page 2")]
    assert got["empty"] == [(0, b"", None)]


def test_text_ranges_hold_their_own_lines(spark):
    df = spark.createDataFrame([(1, "\n".join(map(str, range(25)))), (2, ""), (3, None)], "doc_id int, text string")
    ranges = text_ranges(df, 10)
    assert sorted((r.doc_id, r.first_page, r.end_page, r.n_pages) for r in ranges.collect()) == [
        (1, 0, 10, 25), (1, 10, 20, 25), (1, 20, 25, 25), (2, 0, 1, 1)]
    pages = {(r.doc_id, r.page_no): r.page_text for r in range_text_pages(deal_ranges(ranges, 3)).collect()}
    assert pages == {**{(1, i): str(i) for i in range(25)}, (2, 0): ""}


class Model:
    """Classifies and reads pages; writes every call to a file of its own process (tests run on one machine)."""

    folder = None

    def __init__(self, folder=None, **options):
        self.folder = folder

    def __call__(self, payloads, prompts):
        page = bytes(payloads[0]) if not isinstance(payloads[0], str) else payloads[0].encode()
        kind = b"class" if prompts[0] == fixed.CLASSIFICATION_PROMPT else b"text"
        with open(os.path.join(self.folder, str(os.getpid())), "ab") as f:
            f.write(kind + b" " + page + b"\n")
        if b"boom" in page:
            raise RuntimeError("no answer")
        return ["invoice" if kind == b"class" else f"{prompts[0] == fixed.INVOICE_PROMPT}:{page.decode()}"]


@pytest.fixture()
def calls(tmpdir_fresh):
    def taken():
        lines = []
        for name in os.listdir(tmpdir_fresh):
            with open(os.path.join(tmpdir_fresh, name), "rb") as f:
                lines += f.read().splitlines()
            os.truncate(os.path.join(tmpdir_fresh, name), 0)
        return sorted(lines)
    taken.options = {"folder": tmpdir_fresh}
    return taken


def new_store(spark):
    return AnswerStore(spark, tempfile.mkdtemp(prefix="pagelane-store-") + "/answers")


def test_keys_agree_in_tasks_and_columns(spark):
    keys = PageKeys(None, True, True, True, {"b": 1, "a": "x"})
    row = spark.createDataFrame([("h1", "invoice"), ("h1", "other")], "page_hash string, label string").select(
        "label", keys.classification(F.col("page_hash")).alias("c"), keys.extraction(F.col("page_hash"), F.col("label")).alias("e")).collect()
    for r in row:
        assert r.c == keys.key("h1", fixed.CLASSIFICATION_PROMPT) and r.e == keys.key("h1", keys.prompt(r.label))


def test_a_second_run_makes_no_calls(spark, calls):
    rows = [(i, n, f"page {i * 10 + n if n else 'cover'}") for i in range(6) for n in range(3)] + [(9, 0, None), (9, 1, "boom")]
    requests = spark.createDataFrame(rows, "doc_id int, page_no int, payload string").withColumn(
        "prompt", F.when(F.col("payload").isNotNull(), F.lit("Read it")))
    store = new_store(spark)

    def call(df):
        return call_provider(df, Model, "payload", "prompt", key_cols=("key",), options=calls.options)
    got = {(r.doc_id, r.page_no): (r.response, r.error) for r in answer_requests(requests, store, call, "a").collect()}
    assert len(got) == len(rows) and got[3, 2] == ("False:page 32", None) and got[9, 0] == (None, None)
    assert got[9, 1] == (None, "RuntimeError: no answer")
    made = calls()
    assert len(made) == 12 + 1 + 1 and made.count(b"text page cover") == 1  # identical pages once
    again = {(r.doc_id, r.page_no): (r.response, r.error) for r in answer_requests(requests, store, call, "b").collect()}
    assert again == got and calls() == [b"text boom"]  # only what failed
    more = requests.withColumn("prompt", F.lit("Something else"))
    answer_requests(more.filter("doc_id = 0"), store, call, "c").collect()
    assert len(calls()) == 3  # another prompt is another question


class Interrupted(AnswerStore):
    """Dies after two batches."""

    def append(self, answered, run, batch):
        if getattr(self, "done", 0) == 2:
            raise KeyboardInterrupt
        super().append(answered, run, batch)
        self.done = getattr(self, "done", 0) + 1


def test_a_killed_run_keeps_its_batches(spark, calls):
    docs = documents(spark, [(f"d{i}", b"|".join([b"cover"] + [b"p%d.%d" % (i, n) for n in range(9)])) for i in range(4)])
    counts = count_document_pages(docs, count_bytes, content_col="content")
    ranges = with_contents(plan_ranges(counts, 4), docs)
    path = new_store(spark).path
    with pytest.raises(KeyboardInterrupt):
        answer_document_ranges(ranges, render, Model, Interrupted(spark, path), "a", options=calls.options, batches=5, partitions=3)
    first = calls()
    kept = {r.key for r in AnswerStore(spark, path).answers().collect()}
    assert 0 < len(kept) <= len(first) < 74
    store = AnswerStore(spark, path)
    out = answer_document_ranges(ranges, render, Model, store, "b", options=calls.options, batches=5, partitions=3)
    got = {(r.doc_id, r.page_no): (r.document_type, r.response, r.error) for r in out.collect()}
    assert len(got) == 40 and got["d2", 0] == ("invoice", "True:cover", None) and got["d3", 5] == ("invoice", "True:p3.4", None)
    second = calls()
    assert len(second) == 2 * 37 - len(kept)  # 37 different pages, two calls each; only the missing ones
    assert not set(second) & {line for line in first if PageKeys(None, True, True, True, calls.options).key(
        __import__("hashlib").sha256(line.split(b" ", 1)[1]).hexdigest(),
        fixed.CLASSIFICATION_PROMPT if line.startswith(b"class") else fixed.INVOICE_PROMPT) in kept}
    answer_document_ranges(ranges, render, Model, store, "c", options=calls.options, batches=5, partitions=3).collect()
    assert calls() == []


def test_a_failed_classification_is_asked_again(spark, calls):
    docs = documents(spark, [("d", b"boom|fine")])
    ranges = with_contents(plan_ranges(count_document_pages(docs, count_bytes, content_col="content"), 8), docs)
    store = new_store(spark)
    got = {r.page_no: (r.document_type, r.response, r.error)
           for r in answer_document_ranges(ranges, render, Model, store, "a", options=calls.options).collect()}
    assert got == {0: (fixed.DEFAULT_LABEL, "", "RuntimeError: no answer"), 1: ("invoice", "True:fine", None)}
    assert len(calls()) == 4
    answer_document_ranges(ranges, render, Model, store, "b", options=calls.options).collect()
    assert calls() == [b"class boom", b"text boom"]


def test_ranges_answer_as_whole_documents_do(spark, calls):
    docs = documents(spark, [("a", b"|".join(b"x%d" % i for i in range(23))), ("b", b"boom|y")])
    whole = answer_documents(docs, lambda b: list(render(b, 0, count_bytes(b))), Model, options=calls.options)
    ranges = with_contents(plan_ranges(count_document_pages(docs, count_bytes, content_col="content"), 5), docs)
    parts = answer_ranges(deal_ranges(ranges, 4), render, Model, options=calls.options)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


class NoOptionModel:
    def __call__(self, payloads, prompts):
        return ["other" if prompts[0] == fixed.CLASSIFICATION_PROMPT else "text of " + bytes(payloads[0]).decode()]


def render_pdf(content, first, end):
    if b"BROKEN" in content:
        raise ValueError("cannot rasterise")
    return bytes(content)[4:].split(b"\f")[first:end]


def test_files_as_ranges_with_a_store(spark, tmpdir_fresh):
    for name, content in (("a.pdf", b"%PDF" + b"\f".join(b"page %d" % i for i in range(40))), ("b.pdf", b"%PDFBROKEN"), ("c.pdf", b"no pdf")):
        with open(os.path.join(tmpdir_fresh, name), "wb") as f:
            f.write(content)
    store = new_store(spark)
    for run in ("one", "two"):
        results, out = process_documents(admit_folder(spark, tmpdir_fresh), render_pdf, NoOptionModel, partitions=4, store=store, run=run,
                                         counter=lambda b: bytes(b).count(b"\f") + 1, pages_per_range=7)
        status = {os.path.basename(r.path): (r.n_pages, r.error) for r in results.collect()}
        assert status["a.pdf"] == (40, None) and status["b.pdf"] == (0, "ValueError: cannot rasterise")
        row = out.first()
        assert row.output_name == "a.md" and row.n_pages == 40
        assert row.markdown.index("# Page 1\n\ntext of page 0") < row.markdown.index("# Page 40\n\ntext of page 39")
        assert store.calls(run).count() == (80 if run == "one" else 0)
    with pytest.raises(ValueError):
        process_documents(admit_folder(spark, tmpdir_fresh), render_pdf, NoOptionModel, store=store)


def test_an_empty_store_and_no_requests(spark):
    store = new_store(spark)
    assert store.answers().count() == 0 and store.errors("x").count() == 0
    requests = spark.createDataFrame([], "doc_id int, payload string, prompt string")
    out = answer_requests(requests, store, lambda df: df.withColumn("response", F.lit("x")).withColumn("response_error", F.lit(None).cast("string")), "r")
    assert out.count() == 0 and out.columns == ["doc_id", "prompt", "response", "error"]
    assert answer_store.BATCHES > 1


def test_one_name_in_every_folder(spark):
    """A hot name is numbered by path over many ranges, once for every path."""
    from pagelane.plans.documents import numbered_names
    rows = [(f"/in/{i:04d}/scan.pdf",) for i in range(700)] + [(f"/in/{i}/only{i}.pdf",) for i in range(40)] + [("/in/a/two.pdf",), ("/in/b/two.pdf",)]
    got = {r.path: r.output_name for r in numbered_names(spark.createDataFrame(rows, "doc_id string").repartition(5)).collect()}
    assert len(got) == len(rows) == len(set(got.values()))
    for i in range(700):
        assert got[f"/in/{i:04d}/scan.pdf"] == ("scan.md" if i == 0 else f"scan-{i + 1}.md")
    assert got["/in/a/two.pdf"] == "two.md" and got["/in/b/two.pdf"] == "two-2.md" and got["/in/7/only7.pdf"] == "only7.md"
