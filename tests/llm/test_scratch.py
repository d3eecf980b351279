"""Scratch tables of the pair operators: gone once read, and no larger than the step needs."""

import os
import random

from pagelane.llm import op3_line_dedup as op3, op5_ngram_join as op5
from pagelane.llm.common import discard, shared_path, staged


def prose(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def documents(spark, seed, n=60):
    """Pairs of near copies that share a passage with all others."""
    rng = random.Random(seed)
    passage, rows = prose(rng, 30), []
    for i in range(n // 2):
        words = passage + prose(rng, 30)
        changed = words[:-1] + ["changed"]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    return spark.createDataFrame(rows + [(None, None), (n, ""), (0, "one two")], "doc_id long, text string")


def test_ngram_join_removes_what_it_has_read(spark):
    folder = os.path.dirname(shared_path(spark, "x").removeprefix("file:"))
    before = set(os.listdir(folder))
    found = op5.similarity_components(documents(spark, 1))
    left = {name.rsplit("-", 1)[0] if name.count("-") == 1 else "-".join(name.split("-")[:2]) for name in set(os.listdir(folder)) - before}
    assert not left & {"join-members", "join-groups", "join-grouped", "join-postings", "join-bitmaps", "join-pairs", "join-wanted",
                       "join-sets", "join-links", "join-mixed", "join-frequent"}, left
    assert found.filter("component_id < doc_id").count() == 30


def test_only_bands_of_several_lines_travel_on(spark):
    lines = op3._lines(documents(spark, 2), "doc_id", "text")
    signatures = staged(op3.line_signatures(lines), "lines-signed")
    held = {}
    for r in signatures.collect():
        for band in r["bands"]:
            held.setdefault(band, set()).add(bytes(r["key"]))
    shared = op3.shared_bands(signatures, [])
    counted = {r["band"]: r["count"] for r in shared.groupBy("band").count().collect()}
    assert counted == {band: len(keys) for band, keys in held.items() if len(keys) > 1}
    pairs = {(bytes(r["a"]), bytes(r["b"])) for r in op3.candidate_pairs(signatures, []).collect()}
    assert pairs == {(bytes(r["a"]), bytes(r["b"])) for r in op3.candidate_pairs(signatures.drop("bands"), [], shared).collect()}
    discard(signatures)
