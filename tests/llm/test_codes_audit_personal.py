"""Vector codes, filter audit and personal data on awkward fixtures, against brute force."""

import hashlib
import math
import os
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from pagelane.llm import op11_vector_codes as op11, op12_filter_audit as op12, op13_personal_data as op13
from pagelane.sources.tables import table_path

SF = "/root/testdata/sf0.001"


# --- op11 ---------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, v string, code string, part int, __label int, __salt int, error string"


def brute_codes(rows):
    """Codes, errors and codebooks by plain loops over all entries."""
    kept = [(i, [math.floor(x) * 256 if abs(x) > 2.0 ** 60 else math.floor(256 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    length = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == length]
    cuts = [(p * length // 16, (p + 1) * length // 16) for p in range(16)]
    books = [[v[a:b] for _, v, _ in kept[:64]] for a, b in cuts]

    def nearest(book, x):
        return min((sum((p - q) ** 2 for p, q in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(2):
        for p, (a, b) in enumerate(cuts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(books[p], v[a:b])[1], []).append(v[a:b])
            for e, vs in members.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    out, by_label = [], {}
    for i, v, label in kept:
        best = [nearest(books[p], v[a:b]) for p, (a, b) in enumerate(cuts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    fits = lambda x: x if x < 2 ** 63 else None
    return [(i, code, fits(error), fits(by_label[label])) for i, code, error, label in out], books


def coded(spark, rows):
    df = spark.createDataFrame([(i, v, label, "c", "c", 1, 2, 3, "c") for i, v, label in rows], VECTORS)
    kept = op11.kept_vectors(df)
    books, length = op11.train(kept)
    out = op11.with_label_error(op11.staged(op11.encode(kept, books, length), "codes-test")) if books else None
    return [] if out is None else [(r.vec_id, r.code, r.error, r.label_error) for r in out.collect()], books, out


def awkward_vectors(n=300, length=32, seed=2):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 5, 0.3) for _ in range(length)], i % 3 if i % 7 else None) for i in range(n)]
    rows += [(i, [0.5] * length, 1) for i in range(n, n + 120)]  # equal vectors
    rows += [(i, [-0.001 * (i % 4)] * length, None) for i in range(900, 930)]  # floors go down
    rows += [(3, [1.0] * length, 2), (None, [0.25] * length, 1), (None, [0.25] * length, 1)]  # repeated and null ids
    rows += [(-5, None, 1), (-4, [1.0, None] + [0.0] * (length - 2), 1), (-3, [float("nan")] * length, 1), (-2, [float("-inf")] * length, 1),
             (2000, [1.0] * (length - 1), 1), (2001, [], 1)]
    return rows


@pytest.mark.parametrize("broadcast", [10 ** 6, 0])
def test_vector_codes(spark, monkeypatch, broadcast):
    monkeypatch.setattr(op11, "BROADCAST_LABELS", broadcast)
    rows = awkward_vectors()
    got, books, out = coded(spark, rows)
    expected, brute_books = brute_codes(rows)
    assert books == brute_books
    assert sorted(got, key=str) == sorted(expected, key=str) and len(got) == len(expected)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"]
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert op11.digest(books) == hashlib.sha256(text.encode()).hexdigest()
    decoded = op11.decode(out, books).filter("vec_id = 17").first()
    part = [x / 256 for p in range(16) for x in books[p][int(decoded.code[2 * p:2 * p + 2], 16)]]
    assert list(decoded.v) == part


@pytest.mark.parametrize("length", [16, 19, 5])
def test_vector_codes_of_few_rows_and_odd_lengths(spark, length):
    rng = random.Random(length)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(length)], 0) for i in range(40)]
    got, books, _ = coded(spark, rows)
    expected, brute_books = brute_codes(rows)
    assert books == brute_books and sorted(got) == sorted(expected)


def test_vector_codes_of_large_components_and_no_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1.0, 1e9, -3e12, 1e17, 1e300]) * rng.uniform(1, 2) for _ in range(16)], i % 2) for i in range(90)]
    rows += [(100 + i, [rng.uniform(-1, 1) for _ in range(16)], 7) for i in range(60)]
    got, books, _ = coded(spark, rows)
    expected, brute_books = brute_codes(rows)
    assert books == brute_books and sorted(got) == sorted(expected)
    assert any(e is None for _, _, e, _ in got)
    empty = spark.createDataFrame([], VECTORS)
    assert op11.train(op11.kept_vectors(empty)) == ([], 0)


def test_empty_embeddings_query(spark, tmpdir_fresh):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmpdir_fresh}/embeddings.parquet")
    out = op11.op11_vector_codes(spark, tmpdir_fresh)
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_masks_spare_distances():
    """The masked search is exact, ties included, and computes far fewer distances than all pairs."""
    rng = np.random.default_rng(3)
    for kind, spread in ((np.int64, 200), (np.int64, 3), (object, 2 ** 70)):
        entries = [[int(x) * (spread // 3 if spread > 1000 else 1) for x in rng.integers(-min(spread, 200), min(spread, 200), 4)] for _ in range(64)]
        book = op11.Codebook(entries)
        x = np.array([[int(v) for v in rng.integers(-250, 250, 4)] for _ in range(500)], kind)
        code, far, computed = book.nearest(x)
        for row, c, f in zip(x.tolist(), code, far):
            assert (f, c) == min((sum((a - b) ** 2 for a, b in zip(row, e)), i) for i, e in enumerate(entries))
        if spread == 200:
            assert computed < 0.5 * 64 * len(x)


# --- op12 ---------------------------------------------------------------------------------------------------------

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def brute_audit(docs, labels):
    """Every order applied to every document, one filter after the other."""
    rows = []
    for i, text, source in docs:
        t = text or ""
        words = [w for w in BLANK.split(t) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        good = any(d == i and q == 1 for d, q, _ in labels if d is not None)
        toxic = any(d == i and x == 1 for d, _, x in labels if d is not None)
        rows.append((source or "", {f for f, bad in fails.items() if bad}, good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = {f: 0 for f in "ABCDE"}
        for order in permutations("ABCDE"):
            left = list(range(len(mine)))
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in mine[k][1]]
                earlier = set(range(len(mine))) - set(left)
                left = [k for k in left if k not in set(gone)]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in mine[k][1] for k in earlier),
                                                   sum(r[1] == {f} for r in mine), sum(mine[k][2] for k in gone), sum(mine[k][3] for k in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, part string, mask int, good int, words string, `E` string"
LABELS = "doc_id long, quality int, toxic int, part string, good int"


def audit_fixture(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", s, 1, "c", "c", 1, 5, "c", "c") for i, t, s in rows], DOCS)
    return docs, spark.createDataFrame([(*r, "c", 9) for r in labels], LABELS)


def test_filter_audit(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words[:rng.choice((20, 400))]) for _ in range(rng.choice((150, 199, 200, 260))))
        if rng.random() < 0.3:
            text = text.replace("w1", "W#" if rng.random() < 0.5 else "WW")
        if rng.random() < 0.3 and rows:
            text = rng.choice(rows)[1]
        rows.append((i, text, rng.choice(["a", "b", None, ""])))
    rows += [(200, None, "a"), (201, "", "a"), (None, "", "a"), (None, "", "z"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], "z"),
             (900, "é" * 100_000 + " X" * 300, "b"), (-1, rows[20][1], "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (77777, 1, 1)]
    docs, marks = audit_fixture(spark, rows, labels)
    got = sorted(tuple(r) for r in op12.audited_documents(docs, marks).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())
    assert got == brute_audit(rows, labels) and len(got) == 600 * len({r[2] or "" for r in rows})
    assert op12.audited_documents(docs.limit(0), marks).count() == 0
    assert op12.audited_documents(docs, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_potentials_give_shapley_values(spark):
    """Potentials of a random game of four players: differences to the grand one are averages over all orders."""
    rng = random.Random(5)
    worth = [0] + [rng.randrange(-50, 50) for _ in range(15)]
    found = spark.createDataFrame([(worth,)], "w array<long>").select(op12.potentials(op12.F.col("w"), 4).alias("p")).first().p
    for i in range(4):
        gains = 0
        for order in permutations(range(4)):
            before = sum(1 << j for j in order[:order.index(i)])
            gains += worth[before | 1 << i] - worth[before]
        assert found[15] - found[15 - (1 << i)] == gains


# --- op13 ---------------------------------------------------------------------------------------------------------

_PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
             r"\+[0-9][\x20().0-9-]+[0-9]"]
TEXTS = "doc_id long, text string, lang string, source string, n_chars long, found string, spans string"


def brute_base(text):
    out = []
    for kind, pattern in enumerate(_PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            good = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                    14 <= len(digits) <= 19 and luhn_sum(digits) % 10 == 0, 10 <= len(digits) <= 15)[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def luhn_sum(digits):
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits)))


def card(rng, n=16, prefix="4"):
    digits = prefix + "".join(rng.choice("0123456789") for _ in range(n - 1 - len(prefix)))
    return next(digits + c for c in "0123456789" if luhn_sum(digits + c) % 10 == 0)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    for alphabet in ("0123456789.. -+()@@abX%4 1", "12.", "1 -", "a@.b", "+1 (2)3.-4"):
        for _ in range(6000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert op13.base_spans(text) == brute_base(text), text


@pytest.mark.parametrize("text", ["1" * 400_000, "1 " * 60_000, "a" * 400_000 + "@", "+1" + "(" * 400_000, "1.2." * 20_000, "a@b." * 20_000, ":" * 300_000])
def test_long_runs_take_linear_time(text):
    import time
    start = time.time()
    op13.described(text)
    assert time.time() - start < 30


def planted_texts(rng, n):
    """Texts with one planted case each: (text, spans that are personal data, whether the base finds them)."""
    def prose():
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(12))
    out = []
    for i in range(n):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        ip = ".".join(str(rng.randrange(11, 255)) for _ in range(4))
        ten = "".join(rng.choice("0123456789") for _ in range(10))
        bad = card(rng)
        bad = bad[:-1] + str((int(bad[-1]) + 3) % 10)
        a, b = card(rng), card(rng, prefix="51")
        case = [([f"jo{i}.{i}@mail.example.com"], "", True), ([phone], "", True), ([ip], "", True), ([a], "", True), ([], bad, True),
                ([], "nothing here", True), ([], f"version 3.{ten[:3]}", True), ([a, b], None, False), ([phone, ip], None, False),
                ([f"jane{i} (at) example (dot) org"], "", False), ([f"call ({ten[:3]}) 555-{ten[:4]}"[5:]], "", False)][i % 11]
        spans, other, base = case
        out.append((f"{prose()} {' '.join(spans) if spans else other} {prose()}", spans, base))
    return out


def test_personal_data(spark):
    rng = random.Random(9)
    planted = planted_texts(rng, 440)
    rows = [(i, t) for i, (t, _, _) in enumerate(planted)]
    rows += [(1000, None), (1001, ""), (1002, "😀 a@b.co " * 3000), (None, "x@y.org"), (None, "x@y.org"), (5, rows[5][1]), (5, rows[3][1])]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "c", "c") for i, t in rows], TEXTS)
    out = op13.personal_data(df)
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == len(rows) and out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    expected = []
    for i, t in rows:
        base = brute_base(t or "")
        expected.append((i, *(sum(k == kind for k, _, _ in base) for kind in range(4)),
                         hashlib.sha256(op13.written(base).encode()).hexdigest(), op13.written(base)))
    assert [r[:-1] for r in got] == [r[:-1] for r in sorted(expected, key=str)]
    spans = {r[0]: r[-1] for r in got}
    for i, (t, wanted, _) in enumerate(planted):
        if i == 5:
            continue  # repeated id
        found = [t[int(s):int(e)] for _, s, e in (x.split(":") for x in spans[i].split(",") if x)]
        assert found == wanted, (t, found, wanted)
    assert op13.personal_data(df.limit(0)).count() == 0
    assert op13.personal_data(df.filter("doc_id = 1001")).first().spans == ""


def test_em_finds_reliabilities():
    """Votes drawn from known labelers: EM without truth comes near their reliabilities and separates the classes."""
    rng = np.random.default_rng(2)
    n, right = 20_000, (0.95, 0.8, 0.7, 0.65, 0.9)
    truth = rng.random(n) < 0.6
    said = np.stack([np.where(rng.random(n) < 0.15, 0, np.where((rng.random(n) < r) == truth, 1, 2)) for r in right], 1)
    patterns, counts = np.unique([op13.pattern_of(v) for v in said.tolist()], return_counts=True)
    model = op13.LabelModel(patterns.tolist(), counts.tolist())
    assert abs(model.prior - 0.6) < 0.03
    for (yes, no), r in zip(model.reliability().values(), right):
        assert abs(yes - 0.85 * r) < 0.03 and abs(no - 0.85 * r) < 0.03
    guessed = np.array([model.chance[op13.pattern_of(v)] >= 0.5 for v in said.tolist()])
    # No rule does better than Bayes' with the true reliabilities.
    odds = np.log(0.6 / 0.4) + sum(np.where(v == 1, 1, np.where(v == 2, -1, 0)) * np.log(r / (1 - r)) for v, r in zip(said.T, right))
    assert (guessed == truth).mean() > ((odds > 0) == truth).mean() - 0.003


def test_redaction():
    text = "mail a@b.co or +1 (200) 555-1234 now"
    assert op13.redacted(text, op13.written(op13.base_spans(text))) == "mail [EMAIL] or [PHONE] now"
    assert op13.redacted("abc", "") == "abc"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_base_counts_against_sql(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, coalesce(text, '') FROM read_parquet('{table_path(SF, 'documents')}')").fetchall()
    got = {r.doc_id: r for r in op13.op13_personal_data(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        base = brute_base(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(op13.written(base).encode()).hexdigest()
