"""Pages, assembly, batch results, provider isolation (D, E2/E7/E9, H)."""

import time

from pyspark.sql import functions as F

from pagelane.functions import fixed
from pagelane.operators.assemble import (assemble_documents, batch_results, batch_summary, document_parts, page_totals,
                                         status_message)
from pagelane.operators.pages import explode_rendered_pages, explode_text_pages, require_all_pages
from pagelane.operators.provider import classify_pages, extract_pages, stage


def test_assembly_layout_and_order(spark):
    rows = [(1, 1, ""), (1, 0, "A"), (2, 0, "X")]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, markdown string").repartition(3)
    docs = {r["doc_id"]: r for r in assemble_documents(df).collect()}
    sep = fixed.PAGE_SEPARATOR
    assert docs[1]["markdown"] == fixed.DOC_HEADER + "# Page 1\n\nA" + sep + "# Page 2\n\n" + sep
    assert docs[1]["n_pages"] == 2


def test_assembly_large_document_spans_runs(spark):
    df = spark.range(0, 1000).select(F.lit(7).alias("doc_id"), F.col("id").cast("int").alias("page_no"),
                                     F.col("id").cast("string").alias("markdown"))
    r = assemble_documents(df.orderBy(F.rand(1))).first()
    assert r["n_pages"] == 1000
    assert "# Page 1000\n\n999" in r["markdown"] and r["markdown"].index("# Page 2\n\n1") < r["markdown"].index("# Page 3\n\n2")


def test_document_parts_are_the_document(spark):
    """One document holds a third of all pages; its parts in order are its text."""
    df = spark.range(0, 1500).select(F.when(F.col("id") < 500, F.lit(0)).otherwise(F.col("id") % 100).alias("doc_id"), F.col("id"))
    df = df.select("doc_id", F.when(F.col("id") < 500, F.col("id")).otherwise(500 + F.floor(F.col("id") / 100)).cast("int").alias("page_no"),
                   F.concat(F.lit("p"), F.col("id").cast("string")).alias("markdown")).filter("doc_id = 0 or page_no < 507")
    first = df.filter("doc_id = 0 and page_no < 500")
    whole = assemble_documents(first).first()["markdown"]
    parts = document_parts(first, pages_per_part=64).orderBy("part_no").collect()
    assert len(parts) == 8 and "".join(p["markdown"] for p in parts) == whole


def test_totals_and_the_line_of_a_null_document(spark):
    pages = spark.createDataFrame([(None, True), (1, True), (1, True), (2, False), (2, True)], "doc_id int, ok boolean")
    totals = page_totals(pages)
    assert {r["doc_id"]: r["n_pages"] for r in totals.collect()} == {None: 1, 1: 2, 2: 0}
    lines = sorted(r["summary"] for r in batch_summary(totals, "doc_id", F.col("n_pages")).collect())
    assert lines == ["1 pages extracted", "2 pages extracted", "3 documents, 3 pages, 1 failed", fixed.BATCH_FAILED]


def test_require_all_pages_and_batch(spark):
    pages = spark.createDataFrame([(1, 0, True, "a"), (1, 1, False, "b"), (2, 0, True, "c"), (3, 0, True, "")],
                                  "doc_id int, page_no int, ok boolean, markdown string")
    good = require_all_pages(pages)
    assert sorted(r["doc_id"] for r in good.collect()) == [2, 3]
    inputs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    res = {r["doc_id"]: r["pages"] for r in batch_results(inputs, good).collect()}
    assert res == {1: [], 2: ["c"], 3: [""]}
    summ = {r["doc_id"]: r["summary"] for r in batch_summary(batch_results(inputs, good)).collect()}
    assert summ[1] == fixed.BATCH_FAILED and summ[None] == "3 documents, 2 pages, 1 failed"


def test_text_pages(spark):
    df = spark.createDataFrame([(1, "a\nb\n")], "doc_id int, text string")
    rows = explode_text_pages(df).orderBy("page_no").collect()
    assert [(r["page_no"], r["page_text"], r["page_name"]) for r in rows] == [
        (0, "a", "page_0000.png"), (1, "b", "page_0001.png"), (2, "", "page_0002.png")]


def test_rendered_pages_all_or_nothing(spark):
    def renderer(content):
        if content.startswith(b"bad"):
            raise ValueError("cannot render")
        return [content + bytes([i]) for i in range(3)]
    docs = spark.createDataFrame([(1, bytearray(b"good")), (2, bytearray(b"bad"))], "doc_id int, content binary")
    out = explode_rendered_pages(docs, renderer).collect()
    assert sorted(r["page_no"] for r in out if r["doc_id"] == 1) == [0, 1, 2]
    assert [(r["page_no"], r["error"] is not None) for r in out if r["doc_id"] == 2] == [(-1, True)]


class FakeModel:
    def __call__(self, payloads, prompts):
        out = []
        for payload, prompt in zip(payloads, prompts):
            if payload == "boom":
                raise RuntimeError("model failure")
            if prompt == fixed.CLASSIFICATION_PROMPT:
                out.append(" Invoice\n" if "inv" in payload else "")
            elif prompt == fixed.INVOICE_PROMPT:
                out.append('```json\n{"invoice_number": "' + payload + '"}\n```')
            else:
                out.append("raw:" + payload)
        return out


def test_provider_flow(spark):
    pages = spark.createDataFrame([(1, 0, "inv-1"), (1, 1, "boom"), (2, 0, "memo")],
                                  "doc_id int, page_no int, payload string")
    classified = classify_pages(pages, FakeModel, partitions=2)
    extracted = stage(extract_pages(classified, FakeModel, partitions=2))
    from pagelane.operators.records import parse_responses
    rows = {(r["doc_id"], r["page_no"]): r for r in parse_responses(extracted, with_markdown=True).collect()}
    assert rows[(1, 0)]["document_type"] == "invoice" and rows[(1, 0)]["parse_status"] == "ok"
    assert rows[(1, 1)]["response"] == "" and rows[(1, 1)]["response_error"].startswith("RuntimeError")
    assert rows[(1, 1)]["markdown"] == ""
    assert rows[(2, 0)]["document_type"] == "other"


def test_custom_prompt_skips_classification(spark):
    pages = spark.createDataFrame([(1, 0, "x", "Describe it")], "doc_id int, page_no int, payload string, custom string")
    c = classify_pages(pages, FakeModel, custom_col="custom")
    e = extract_pages(c, FakeModel, custom_col="custom").first()
    assert e["class_response"] is None and e["response"] == "raw:x"


def test_status_message(spark):
    df = spark.createDataFrame([(True, "Valid PDF file", 3, "a.pdf", True), (False, "File not found", 0, "b.pdf", False),
                                (True, "Valid PDF file", 0, "c.pdf", False), (True, "Valid PDF file", 2, "d.pdf", False)],
                               "v boolean, r string, n int, name string, out boolean")
    got = [r[0] for r in df.select(status_message(F.col("v"), F.col("r"), F.col("n"), F.col("name"), F.col("out"))).collect()]
    assert got == ["✅ Successfully processed 3 pages from a.pdf", "❌ File not found", fixed.STATUS_NO_PAGES,
                   fixed.STATUS_NO_OUTPUT]


class SlowModel:
    """Takes 0.2 s a call and fails on pages that say so."""

    def __call__(self, payloads, prompts):
        time.sleep(0.2)
        if b"boom" in bytes(payloads[0]):
            raise RuntimeError("model failure")
        return ["text " + bytes(payloads[0]).decode()]


def test_calls_of_a_task_overlap(spark):
    from pagelane.operators.provider import answer_documents
    docs = spark.createDataFrame([(1, bytearray(b"|".join(b"p%d" % i for i in range(24))))], "doc_id int, content binary").coalesce(1)

    def run(concurrency):
        began = time.time()
        rows = answer_documents(docs, lambda b: bytes(b).split(b"|"), SlowModel, custom_prompt="Read it", concurrency=concurrency).collect()
        assert [(r["page_no"], r["response"]) for r in rows] == [(i, f"text p{i}") for i in range(24)]
        return time.time() - began
    run(8)
    assert run(8) < run(1) - 2


def test_page_errors_do_not_spread(spark):
    from pagelane.operators.provider import answer_documents
    docs = spark.createDataFrame([(1, bytearray(b"a|boom|c")), (2, bytearray(b"x"))], "doc_id int, content binary")
    rows = {(r["doc_id"], r["page_no"]): (r["response"], r["error"])
            for r in answer_documents(docs, lambda b: bytes(b).split(b"|"), SlowModel, custom_prompt="Read it").collect()}
    assert rows[1, 0] == ("text a", None) and rows[1, 2] == ("text c", None) and rows[2, 0] == ("text x", None)
    assert rows[1, 1] == ("", "RuntimeError: model failure")
    assert "payload" not in answer_documents(docs, list, SlowModel).columns


def test_python_text_of_prompt_fields(spark):
    from pagelane.operators.routing import extend_prompt
    df = spark.createDataFrame([({"a": "O'Brien", "b": None, "c": 'x"y', "d": "q'\"z", "e": "l\nm\\"},)], "m map<string,string>")
    got = df.select(extend_prompt(F.lit(""), F.col("m")).alias("t")).first()["t"]
    assert got == fixed.CUSTOM_FIELDS_INTRO + str({"a": "O'Brien", "b": None, "c": 'x"y', "d": "q'\"z", "e": "l\nm\\"})
    flags = spark.createDataFrame([({"a": True, "b": False},)], "m map<string,boolean>")
    assert flags.select(extend_prompt(F.lit(""), F.col("m"), "boolean").alias("t")).first()["t"].endswith("{'a': True, 'b': False}")


class OptionEcho:
    def __init__(self, system_instruction=None, generation=None):
        self.tag = f"{len(system_instruction or '')}:{(generation or {}).get('max_output_tokens')}"

    def __call__(self, payloads, prompts):
        return [self.tag for _ in payloads]


def test_provider_receives_options(spark):
    from pagelane.operators.provider import call_provider, provider_options
    df = spark.createDataFrame([(1, 0, "x", "p")], "doc_id int, page_no int, payload string, prompt string")
    out = call_provider(df, OptionEcho, "payload", "prompt", options=provider_options()).first()
    assert out["response"] == f"{len(fixed.SYSTEM_INSTRUCTION)}:8192"
