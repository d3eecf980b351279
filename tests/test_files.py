"""Listings, admission, sinks and streaming on fixture folders."""

import os
import tempfile

from pyspark.sql import functions as F

from pagelane.functions import fixed
from pagelane.operators.admission import admit, admit_folder, admit_requested, quarantine
from pagelane.sources import files as S

PDF = b"%PDF-1.4\n%Test PDF content"


def _write(folder, name, data=b"", size=None):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        if size is not None:
            f.truncate(size)  # sparse file
            f.seek(0)
            f.write(data)
        else:
            f.write(data)
    return path


def _fixture_folder():
    d = tempfile.mkdtemp(prefix="pagelane-files-")
    _write(d, "ok.pdf", PDF)
    _write(d, "UPPER.PDF", PDF)
    _write(d, "x.Pdf", PDF)
    _write(d, "test.txt", b"Not a PDF")
    _write(d, "fake.pdf", b"Not a PDF file")
    _write(d, "large.pdf", PDF, size=fixed.MAX_UPLOAD_BYTES + 1)
    _write(d, "edge.pdf", PDF, size=fixed.MAX_UPLOAD_BYTES)
    _write(d, "big.txt", b"x", size=fixed.MAX_UPLOAD_BYTES + 10)
    _write(d, "a b é%20#.pdf", PDF)
    _write(d, "_u.pdf", PDF)
    _write(d, ".h.pdf", PDF)
    _write(d, "sub/s.pdf", PDF)
    for ext in ["txt", "py", "jpg", "md", "json"]:
        _write(d, f"mixed.{ext}", b"x")  # binaryFile does not list zero-byte files
    return d


def test_scan_and_discover(spark):
    d = _fixture_folder()
    names = sorted(r["name"] for r in S.scan_documents(spark, d).collect())
    assert names == sorted(["ok.pdf", "fake.pdf", "large.pdf", "edge.pdf", "a b é%20#.pdf"])
    found = sorted(r["name"] for r in S.discover_documents(spark, d).collect())
    assert "UPPER.PDF" in found and "x.Pdf" in found and "_u.pdf" not in found
    plan = S.scan_documents(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_admission_rules(spark):
    d = _fixture_folder()
    admitted = admit_folder(spark, d)
    got = {os.path.basename(r["path"]).replace("%20", " "): r["reason"] for r in admitted.collect()}
    assert got["ok.pdf"] == fixed.MSG_VALID
    assert got["UPPER.PDF"] == fixed.MSG_VALID
    assert got["test.txt"] == fixed.MSG_BAD_TYPE
    assert got["fake.pdf"] == fixed.MSG_BAD_MAGIC
    assert got["large.pdf"] == fixed.MSG_TOO_LARGE
    assert got["edge.pdf"] == fixed.MSG_VALID
    assert got["big.txt"] == fixed.MSG_TOO_LARGE
    kept = {os.path.basename(r["path"]): r["content"] is not None
            for r in admit_folder(spark, d, keep_content=True).select("path", "content").collect()}
    assert kept["ok.pdf"] and not kept["large.pdf"]
    ok, bad = quarantine(admitted)
    assert ok.count() + bad.count() == S.read_files(spark, d).select("path").count()


def test_size_filter_pushed_down(spark):
    d = _fixture_folder()
    df = S.read_files(spark, d).filter(F.col("length") <= fixed.MAX_UPLOAD_BYTES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "length" in plan


def test_requested_missing(spark):
    d = _fixture_folder()
    req = spark.createDataFrame([("ok.pdf",), ("missing.pdf",)], "name string")
    small = S.read_files(spark, d).filter(F.col("length") < 1000)
    got = {r["name"]: r["reason"] for r in admit_requested(req, small).collect()}
    assert got == {"ok.pdf": fixed.MSG_VALID, "missing.pdf": fixed.MSG_NOT_FOUND}


def test_inventory_and_outputs(spark):
    d = _fixture_folder()
    rep = {r["folder"]: r for r in S.inventory_report(spark, {"input": d, "missing": d + "/nope"}).collect()}
    assert rep["missing"]["exists"] is False and rep["missing"]["files"] == 0
    assert rep["input"]["pdfs"] >= 6
    names = [r["name"] for r in S.inventory_listing(spark, {"input": d}).collect()]
    assert names == sorted(names) and "ok.pdf" in names
    inv = {(r["folder"], r["ext"]): r["files"] for r in S.file_inventory(spark, {"input": d}).collect()}
    assert inv[("input", ".md")] == 1
    assert S.list_outputs(spark, d).count() == 1


def test_write_markdown_one_file_per_row(spark):
    out = tempfile.mkdtemp(prefix="pagelane-out-")
    docs = spark.createDataFrame([("a.md", "# A\n"), ("b.md", "é")], "output_name string, markdown string")
    S.write_markdown(docs, out)
    S.write_markdown(docs, out)  # replace if present
    assert sorted(os.listdir(out)) == ["a.md", "b.md"]
    assert open(os.path.join(out, "b.md"), encoding="utf-8").read() == "é"


def test_stage_documents(spark):
    work = tempfile.mkdtemp(prefix="pagelane-work-")
    inp = os.path.join(work, "input")
    os.makedirs(inp)
    _write(work, "stray.pdf", PDF)
    plan = S.stage_plan(spark, work, inp)
    res = S.stage_documents(plan).collect()
    assert [(r["name"], r["ok"]) for r in res] == [("stray.pdf", True)]
    assert os.path.exists(os.path.join(inp, "stray.pdf"))


def test_stream_documents(spark):
    from pagelane.streaming.documents import process_stream, stream_documents
    d = tempfile.mkdtemp(prefix="pagelane-stream-")
    _write(d, "ok.pdf", PDF)
    _write(d, "fake.pdf", b"Not a PDF file")
    _write(d, "UPPER.PDF", PDF)
    out = []

    def handle(batch, epoch):
        out.extend((os.path.basename(r["path"]), r["reason"]) for r in batch.select("path", "reason").collect())

    q = process_stream(stream_documents(spark, d), handle, tempfile.mkdtemp(prefix="pagelane-sck-"))
    q.awaitTermination(120)
    names = sorted(n for n, _ in out)
    assert "ok.pdf" in names and "UPPER.PDF" not in names
    assert dict(out)["fake.pdf"] == fixed.MSG_BAD_MAGIC


def test_streaming_load_windows(spark):
    from pagelane.streaming.documents import streaming_load_windows
    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(os.path.dirname(src) + "/events*.parquet")
    agg = streaming_load_windows(stream, width="1 day", watermark="1 hour")
    name = "load_windows_test"
    q = agg.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    streamed = spark.sql(f"select * from {name}").count()
    batch = spark.read.parquet(src).select(F.to_date("ts")).distinct().count()
    assert 0 < streamed <= batch


def fake_renderer(content):
    """Pages of a fixture 'PDF' are separated by form feeds."""
    body = bytes(content)
    if b"BROKEN" in body:
        raise ValueError("cannot rasterise")
    return [p for p in body[4:].split(b"\f")]


class InvoiceModel:
    def __call__(self, payloads, prompts):
        out = []
        for payload, prompt in zip(payloads, prompts):
            text = bytes(payload).decode()
            if prompt == fixed.CLASSIFICATION_PROMPT:
                out.append("invoice" if text.startswith("inv") else "other")
            elif prompt == fixed.INVOICE_PROMPT:
                out.append('```json\n{"invoice_number": "' + text + '", "total_amount": 2.675}\n```')
            else:
                out.append('{"title": "' + text + '"}')
        return out


def test_stream_documents_to_markdown(spark):
    from pagelane.streaming.documents import document_batch_handler, process_stream, stream_documents
    d = tempfile.mkdtemp(prefix="pagelane-docs-")
    out = tempfile.mkdtemp(prefix="pagelane-md-")
    res = tempfile.mkdtemp(prefix="pagelane-res-") + "/results"
    _write(d, "a.pdf", b"%PDFinv-1\fmemo")
    _write(d, "b.pdf", b"%PDFBROKEN")
    _write(d, "c.pdf", b"not a pdf")
    handler = document_batch_handler(fake_renderer, InvoiceModel, out, res)
    q = process_stream(stream_documents(spark, d), handler, tempfile.mkdtemp(prefix="pagelane-sck-"))
    q.awaitTermination(300)
    assert sorted(os.listdir(out)) == ["a.md"]
    md = open(os.path.join(out, "a.md"), encoding="utf-8").read()
    assert md.startswith(fixed.DOC_HEADER + "# Page 1\n\n# Invoice\n\n**Invoice Number:** inv-1\n")
    assert "**Total Amount:** $2.67" in md and "# Page 2\n\n# Document\n\n**Title:** memo\n" in md
    status = {os.path.basename(r["path"]): (r["n_pages"], r["status"]) for r in spark.read.parquet(res).collect()}
    assert status == {"a.pdf": (2, "✅ Successfully processed 2 pages from a.pdf"),
                      "b.pdf": (0, fixed.STATUS_ERROR + "ValueError: cannot rasterise"),
                      "c.pdf": (0, fixed.STATUS_REJECTED_PREFIX + fixed.MSG_BAD_MAGIC)}  # rejects are reported
    # A replayed batch adds no rows.
    handler(admit(S.read_files(spark, d)), 0)
    assert spark.read.parquet(res).count() == 3


def test_stage_documents_retry_and_failure(spark):
    work = tempfile.mkdtemp(prefix="pagelane-work2-")
    inp = os.path.join(work, "input")
    os.makedirs(inp)
    _write(work, "one.pdf", PDF)
    plan = S.stage_plan(spark, work, inp).cache()
    first = S.stage_documents(plan).collect()
    again = S.stage_documents(plan).collect()  # a replay finds the file already moved
    assert [r["ok"] for r in first] == [True] and [r["ok"] for r in again] == [True]
    bad = spark.createDataFrame([("file:" + work + "/nope.pdf", "nope.pdf", inp + "/nope.pdf")],
                                "path string, name string, target string")
    r = S.stage_documents(bad).first()
    assert r["ok"] is False and r["error"]


def test_batch_documents_from_folder(spark):
    from pagelane.plans.documents import process_documents
    d = tempfile.mkdtemp(prefix="pagelane-batch-")
    out = tempfile.mkdtemp(prefix="pagelane-batch-md-")
    _write(d, "x.pdf", b"%PDFinv-9\fnote")
    _write(d, "y.pdf", b"%PDFBROKEN")
    admitted = admit_folder(spark, d, "*.pdf", keep_content=True)
    results, documents = process_documents(admitted, fake_renderer, InvoiceModel, partitions=2)
    S.write_markdown(documents, out)
    assert sorted(os.listdir(out)) == ["x.md"]
    got = {os.path.basename(r["path"]): (r["n_pages"], r["n_failed_pages"], r["error"], r["status"][:3]) for r in results.collect()}
    assert got == {"x.pdf": (2, 0, None, "✅ S"), "y.pdf": (0, 0, "ValueError: cannot rasterise", "❌ P")}


class FailingModel:
    def __call__(self, payloads, prompts):
        if prompts[0] != fixed.CLASSIFICATION_PROMPT and b"bad" in bytes(payloads[0]):
            raise RuntimeError("no answer")
        return ["general prompt" if prompts[0] == fixed.GENERAL_DOCUMENT_PROMPT else
                "fallback prompt" if prompts[0] == fixed.MARKDOWN_FALLBACK_PROMPT else "other"]


def test_every_input_has_a_result(spark):
    from pagelane.plans.documents import process_documents
    d = tempfile.mkdtemp(prefix="pagelane-inputs-")
    for name, data in (("a.pdf", b"%PDFone\fbad"), ("b.pdf", b"%PDFbad"), ("c.pdf", b"junk"), ("d.PDF", b"%PDFx"), ("d.pdf", b"%PDFy"), ("e.txt", b"%PDF")):
        _write(d, name, data)
    _write(d, "f.pdf", PDF, size=fixed.MAX_UPLOAD_BYTES + 1)
    results, documents = process_documents(admit_folder(spark, d, keep_content=True), fake_renderer, FailingModel)
    rows = {os.path.basename(r["path"]): r for r in results.collect()}
    assert sorted(rows) == ["a.pdf", "b.pdf", "c.pdf", "d.PDF", "d.pdf", "e.txt", "f.pdf"]
    assert (rows["a.pdf"]["n_pages"], rows["a.pdf"]["n_failed_pages"], rows["a.pdf"]["error"]) == (2, 1, "RuntimeError: no answer")
    assert (rows["b.pdf"]["n_pages"], rows["b.pdf"]["n_failed_pages"]) == (1, 1)
    assert rows["f.pdf"]["status"] == fixed.STATUS_REJECTED_PREFIX + fixed.MSG_TOO_LARGE and rows["e.txt"]["n_pages"] == 0
    names = {os.path.basename(r["path"]): r["output_name"] for r in documents.collect()}
    assert sorted(names.values()) == ["a.md", "b.md", "d-2.md", "d.md"]  # one stem, two files


def test_structured_flags_choose_the_prompt(spark):
    from pagelane.plans.documents import process_documents
    d = tempfile.mkdtemp(prefix="pagelane-flags-")
    _write(d, "a.pdf", b"%PDFone")
    admitted = admit_folder(spark, d, keep_content=True)

    def text(**flags):
        return process_documents(admitted, fake_renderer, FailingModel, **flags)[1].first()["markdown"]
    assert "general prompt" in text(call_structured=False)
    assert "fallback prompt" in text(call_structured=False, manager_structured=False)
    assert "fallback prompt" in text(classification=False)


def test_file_uris_and_awkward_names(spark):
    work = tempfile.mkdtemp(prefix="pagelane-uri-")
    inp = os.path.join(work, "input")
    os.makedirs(inp)
    for name in ("x#1.pdf", "y%20z.pdf", "a b.pdf", "there.pdf"):
        _write(work, name, PDF)
    _write(inp, "there.pdf", b"%PDF old")
    report = {r["folder"]: r for r in S.inventory_report(spark, {"work": "file://" + work, "gone": "file://" + work + "/gone"}).collect()}
    assert report["work"]["exists"] and report["work"]["pdfs"] == 4 and not report["gone"]["exists"]
    assert [r["name"] for r in S.folder_names(spark, "file:" + work).collect()] == ["input"]
    moved = S.stage_documents(S.stage_plan(spark, "file://" + work, "file://" + inp))
    assert {r["name"]: r["ok"] for r in moved.collect()} == {"x#1.pdf": True, "y%20z.pdf": True, "a b.pdf": True, "there.pdf": False}
    assert moved.count() == 4  # reading the report again moves nothing
    assert sorted(os.listdir(inp)) == ["a b.pdf", "there.pdf", "x#1.pdf", "y%20z.pdf"]
    assert open(os.path.join(inp, "there.pdf"), "rb").read() == b"%PDF old"


def test_a_bad_name_does_not_stop_the_sink(spark):
    out = tempfile.mkdtemp(prefix="pagelane-out-")
    docs = spark.createDataFrame([("a.md", "A"), ("../b.md", "B"), (None, "C")], "output_name string, markdown string")
    assert sorted(r["ok"] for r in S.write_markdown(docs, out).collect()) == [False, False, True]
    assert os.listdir(out) == ["a.md"]
