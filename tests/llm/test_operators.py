"""Training-data operators on small fixtures with awkward rows, against brute force."""

import hashlib
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pagelane.llm import (op1_exact_dedup as op1, op2_exact_topk as op2, op3_line_dedup as op3, op4_mixing as op4, op5_ngram_join as op5,
                          op6_toxicity as op6, op7_language_id as op7, op8_warc as op8, op9_url_filters as op9, op10_packing as op10)
from pagelane.llm.common import shared_path
from pagelane.llm.components import connected_components

#: Names that operators use inside; a caller's columns of that name must not matter.
CLASHING = ["size", "h", "row", "local", "key", "pos", "line", "n", "gid", "place", "score", "owner", "shard", "target", "copies", "__x"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in BLANK.split(text or "") if w]


def texts():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "ba de ki lo mu ra se ti vo xu".split() for b in "na po ri su te".split()]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    lines = [prose(14) for _ in range(6)]
    other_line = lines[2].split()
    other_line[-1] = "zz"
    out = [None, "", " \t\n ", "one", "One", "one two", "one  two", base, base, base.replace(" ", "\n", 3), " ".join(near), prose(60),
           "\n".join(lines), "\n".join([prose(10), lines[2], " ".join(other_line), lines[4]]), "x " * 30_000, "x " * 30_000,
           prose(9_000), "1234 !!! --", "é" * 50, base + "\x0b\x1c end"]
    return out


def documents(spark, rows=None):
    if rows is None:
        rows = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2", "S", ""][i % 5]) for i, t in enumerate(texts())]
        rows += [rows[7], rows[7], (None, texts()[7], "en", "s1"), (None, None, None, None), (3, "another text of id three", "en", "s1")]
    return spark.createDataFrame([(i, t, lang, source, 7, *["c"] * len(CLASHING)) for i, t, lang, source in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark):
    docs = documents(spark).repartition(5)
    rows = op1.exact_duplicates(docs, max_trie_bytes=2_000).collect()  # far too small: both rounds spill
    groups = {}
    for r in documents(spark).collect():
        groups.setdefault(BLANK.sub(" ", r.text or ""), []).append(r.doc_id)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(rows) == docs.count()
    for sha, ids in by_hash.items():
        mine = [r for r in rows if r.text_sha256 == sha]
        keep = min((i for i in ids if i is not None), default=None)
        assert sorted(str(r.doc_id) for r in mine) == sorted(map(str, ids))
        assert {r.group_size for r in mine} == {len(ids)} and {r.keep_id for r in mine} == {keep}
        assert [r.doc_id for r in mine if r.kept] == [keep]
    assert op1.exact_duplicates(empty(spark)).count() == 0


def test_trie_spills_by_subtree():
    rng = random.Random(1)
    texts_ = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(3000)]
    owners = op1.SpillingOwners(max_bytes=4_000)
    links = {}
    for i, t in enumerate(texts_):
        owner = owners.add(t, i, (False, i, i), 1)
        if owner is not None:
            links[i] = owner
    found = {}
    for kind, *rest in owners.results():
        if kind == "link":
            links[rest[0]] = rest[1]
        else:
            found[rest[0]] = (rest[1][1], rest[2])
    assert owners.spilled
    for t in set(texts_):
        ids = [i for i, x in enumerate(texts_) if x == t]
        assert len({links[i] for i in ids}) == 1
        assert found[links[ids[0]]] == (ids[0], len(ids))
    assert len(found) == len(set(texts_))


def brute_top_k(rows, k, step):
    vectors = [(i, [int((64 * x) // 1) for x in v]) for i, v in rows
               if i is not None and v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    out = []
    for qi, (q, a) in enumerate(vectors):
        if q % step == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(op2, "TREE_ROWS", 60)
    monkeypatch.setattr(op2, "SAMPLE_ROWS", 40)
    monkeypatch.setattr(op2, "LEAF_ROWS", 8)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 3, 0.4) for _ in range(6)]) for i in range(400)]
    rows += [(i, [1.0] * 6) for i in range(400, 560)]  # equal vectors: more than a tree
    rows += [(600, None), (601, [1.0, None]), (602, [float("nan")] * 6), (603, [float("inf")] * 6), (None, [1.0] * 6), (604, [2.0, 2.0]), (605, []),
             (20, [0.5] * 6)]
    df = spark.createDataFrame([(i, v, 1, "c", "c") for i, v in rows], "vec_id long, embedding array<float>, label int, tree string, v string")
    rounded = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in op2.top_k(df, k=5, query_step=20).collect())
    assert got == brute_top_k(rounded, 5, 20)
    assert op2.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("large", [1e6, 3e7, 1e9, 1e15])
def test_exact_top_k_of_large_components(spark, monkeypatch, large):
    """Scores beyond floats and beyond longs still decide the ranks exactly; longs hold what they can."""
    monkeypatch.setattr(op2, "SAMPLE_ROWS", 40)
    monkeypatch.setattr(op2, "LEAF_ROWS", 8)
    rng = random.Random(6)
    rows = [(i, [rng.choice([1.0, -1.0, large, large + 1.0]) * rng.choice([1.0, 1.0, 0.5]) for _ in range(4)]) for i in range(150)]
    rows += [(i, rows[i % 7][1]) for i in range(150, 180)]  # repeated candidates
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = [(q, rank, i, max(-2 ** 63, min(2 ** 63 - 1, s))) for q, rank, i, s in brute_top_k(rows, 5, 20)]
    assert sorted(tuple(r) for r in op2.top_k(df, k=5, query_step=20).collect()) == expected


def test_m_tree_rules_out_nodes():
    import numpy as np
    rng = np.random.default_rng(0)
    vectors = np.concatenate([rng.integers(-3, 4, (200, 8)) + 40 * np.eye(8, dtype=int)[c] for c in range(8)]).astype(np.int64)
    limit = int((vectors ** 2).sum(1).max())
    space = op2.Space(8, limit, np.arange(len(vectors)), vectors, 4)
    tree = op2.Tree(space, np.arange(len(vectors)), vectors)
    seen = []
    real = op2._products
    try:
        op2._products = lambda a, b, m: seen.append(len(b)) or real(a, b, m)
        found = op2.search(space, tree, np.array([3]), vectors[3:4], np.array([-np.inf]), 5)
    finally:
        op2._products = real
    scores = vectors @ vectors[3]
    scores[3] = -10**9
    assert [(i, s) for _, i, s in found] == [(int(i), int(scores[i])) for i in np.lexsort((np.arange(len(scores)), -scores))[:5]]
    assert sum(seen) < len(vectors) / 2


def line_set(line):
    line = line.lower().strip(" \t\x0b\x0c\r")
    return frozenset(line[i:i + op3.CHARS] for i in range(max(1, len(line) - op3.CHARS + 1)))


def test_line_dedup(spark):
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts())])
    out = {r.doc_id: r for r in op3.dedup_lines(docs).collect()}
    places, sets = [], {}
    for i, t in enumerate(texts()):
        for pos, line in enumerate((t or "").split("\n")):
            if words_of(line):
                places.append((i, pos, line_set(line)))
    parent = {p[:2]: p[:2] for p in places}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(places, 2):
        if 100 * len(a[2] & b[2]) >= op3.PERCENT * len(a[2] | b[2]):
            x, y = sorted((find(a[:2]), find(b[:2])))
            parent[y] = x
    for i, t in enumerate(texts()):
        if t is None:
            assert out[i].text is None
            continue
        kept = [line for pos, line in enumerate(t.split("\n")) if (i, pos) not in parent or find((i, pos)) == (i, pos)]
        if words_of(t) and not words_of("\n".join(kept)):
            assert i not in out
        else:
            assert out[i].text == "\n".join(kept)
    assert op3.dedup_lines(docs).columns == docs.columns
    assert op3.dedup_lines(documents(spark)).count() > 0  # null and repeated ids
    assert op3.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_recall(spark):
    """Lines at a similarity just above the threshold are found."""
    rng = random.Random(8)
    rows, expected = [], 0
    for i in range(150):
        words = [f"w{rng.randrange(10**6):06d}" for _ in range(40)]
        changed = words[:]
        for at in rng.sample(range(40), 2):
            changed[at] = f"v{rng.randrange(10**6):06d}"
        rows += [(2 * i, " ".join(words), "en", "s"), (2 * i + 1, " ".join(changed), "en", "s")]
        a, b = line_set(rows[-2][1]), line_set(rows[-1][1])
        expected += 100 * len(a & b) >= op3.PERCENT * len(a | b)
    assert expected > 100
    assert 300 - op3.dedup_lines(documents(spark, rows)).count() >= 0.95 * expected


def test_line_dedup_reads_every_character(spark):
    """Lines with long words, without blanks or by tabs: as brute force over the shingles of all positions."""
    rng = random.Random(12)
    han = [chr(0x4E00 + rng.randrange(3000)) for _ in range(400)]
    lines = ["https://example.com/a/first-page", "https://example.com/b/other?q=17", "user_id=1", "user_id=2", "session_token=abc",
             "session_token=xyz", "alpha_one\tbeta\t1", "alpha_one\tgamma\t2", "internationally recognised", "internationally renowned"]
    for _ in range(12):
        base = "".join(rng.choice(han) for _ in range(60))
        lines += [base, base[:30] + "字" + base[31:], base[:8] + "".join(rng.choice(han) for _ in range(52))]
        path = "https://site.example/" + "".join(rng.choice("abcdefghij/") for _ in range(80))
        lines += [path, path[:-1] + "#", path[:40] + path[60:], "see " + path, path + " " + "".join(rng.choice("klmno") for _ in range(40))]
    lines = sorted(set(lines))

    def all_positions(line):
        return {line[i:i + 8] for i in range(max(1, len(line) - 7))}
    root = list(range(len(lines)))
    for (i, a), (j, b) in combinations(enumerate(map(all_positions, lines)), 2):
        if 100 * len(a & b) >= op3.PERCENT * len(a | b):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    kept = {r.doc_id for r in op3.dedup_lines(documents(spark, [(i, t, "en", "s") for i, t in enumerate(lines)])).collect()}
    assert kept == set(root) and 40 < len(kept) < len(lines) - 20


def test_line_dedup_has_one_similarity(spark):
    """Short words or long ones: a pair is judged by the same shingles."""
    base = "we go to the big red old car and see the cat sit by the tree with the fox and the dog on "
    lines = [base + "it", base + "me", "yesterday " + base + "it now", "yesterday " + base + "me now"]
    kept = {r.doc_id for r in op3.dedup_lines(documents(spark, [(i, t, "en", "s") for i, t in enumerate(lines)])).collect()}
    linked = {(i, j) for i, j in combinations(range(4), 2)
              if 100 * len(line_set(lines[i]) & line_set(lines[j])) >= op3.PERCENT * len(line_set(lines[i]) | line_set(lines[j]))}
    assert {(0, 1), (2, 3)} <= linked and kept == {i for i in range(4) if not any(j == i for _, j in linked)}


@pytest.mark.parametrize("shingles", [3, 8, 20, 300])
def test_line_dedup_recall_by_length(spark, shingles):
    """Lines of few shingles leave most arcs empty; of the pairs over the threshold at least 0.95 are found."""
    rng = random.Random(shingles)
    rows, expected = [], 0
    while expected < 60:
        n = shingles + op3.CHARS - 1
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        other = line + "".join(rng.choice("0123456789") for _ in range(max(1, shingles // 8))) if shingles > 3 else line.upper() + " "
        a, b = line_set(line), line_set(other)
        if 100 * len(a & b) >= op3.PERCENT * len(a | b):
            rows += [(2 * expected, line, "en", "s"), (2 * expected + 1, other, "en", "s")]
            expected += 1
    assert 120 - op3.dedup_lines(documents(spark, rows)).count() >= 0.95 * expected


@pytest.mark.parametrize("hot", [op3.HOT, 10**6])
def test_line_dedup_with_a_shared_passage(spark, monkeypatch, hot):
    """Similar lines in the middle of a bucket that many unlike lines share."""
    monkeypatch.setattr(op3, "HOT", hot)
    rng = random.Random(13)

    def prose(n):
        return [f"w{rng.randrange(10**8):08d}" for _ in range(n)]
    passage, rows = prose(32), []
    for _ in range(150):
        words = passage + prose(8)
        changed = words[:]
        for at in rng.sample(range(32, 40), 2):
            changed[at] = prose(1)[0]
        rows += [" ".join(words), " ".join(changed)]
    kept = [r.doc_id for r in op3.dedup_lines(documents(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect()]
    assert sorted(kept) == list(range(0, 300, 2))


def test_no_python_in_line_dedup(spark):
    docs = documents(spark)
    lines = op3._lines(docs, "doc_id", "text")
    signatures = op3.line_signatures(lines)
    pairs = op3.candidate_pairs(signatures, [])
    for df in (signatures, pairs, op3.verified_links(lines, pairs, []), op3.dedup_lines(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


def test_mixing(spark):
    docs = documents(spark)
    rows = op4.mix(docs).collect()
    sizes = [len(words_of(r.text)) for r in docs.collect()]
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    names = sorted({r.source for r in docs.collect() if r.source is not None}) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    source_sizes = {s: sum(len(words_of(r.text)) for r in docs.collect() if r.source == s) for s in names}
    total, open_, target = 1.5 * sum(sizes), set(names), {}
    while True:  # share, fix those above their cap, share the rest again
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * source_sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * source_sizes[s] for s in over}
        open_ -= over
    target |= {s: level * weights[s] for s in open_}
    by_source = {(r.source_size, round(r.target, 6)) for r in rows}
    assert by_source == {(source_sizes[s], round(target[s], 6)) for s in names}
    for s in names:
        mine = [r for r in rows if (r.source_size, round(r.target, 6)) == (source_sizes[s], round(target[s], 6))]
        largest = max(r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 3 * largest  # rows of one id go together
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in mine)
    again = op4.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    mixed = op4.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words_of(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert op4.mix(empty(spark)).count() == 0 and op4.mixed_documents(empty(spark)).count() == 0


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))]


@pytest.mark.parametrize("frequent", [16, 0])
def test_ngram_join(spark, monkeypatch, frequent):
    monkeypatch.setattr(op5, "FREQUENT", frequent)
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    common = " ".join(f"c{i}" for i in range(30))
    for i in range(60):  # chains of small changes, and documents that share a passage only
        start = [f"t{i // 12}x{j}" for j in range(60)]
        for _ in range(i % 12):
            start[rng.randrange(60)] = f"r{rng.randrange(1000)}"
        rows.append((100 + i, " ".join(start)))
        rows.append((1000 + i, common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([3, 5, 12])))))
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows]).repartition(4)
    got = [tuple(r) for r in op5.similarity_components(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_components(rows, 4, 85)))
    assert op5.similarity_components(empty(spark)).count() == 0
    kept = op5.one_per_group(docs, 5, 80)
    expected = [i for i, _, c in brute_components(rows, 5, 80) if i is None or c == i]
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, expected))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 4), (200, 201)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {201: 200}


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(["the", "house", "stands", "near", "water", "and", "trees"]) for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["florp", "grumnak", "grumnix"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic), "c"))
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "florp", None, None), (1002, "florp. " * 20_000, None, None), rows[0]]
    labels += [(0, 1, 1, "c"), (5000, 0, 1, "c"), (None, 0, 1, "c"), (7, None, None, "c")]
    docs = documents(spark, rows)
    label_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    out = op6.score_documents(docs, op6.train(docs, label_df)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held) > 50
    by_id = {r.doc_id: r for r in out}
    assert by_id[1002].predicted == 1 and by_id[1000].predicted == by_id[1001].predicted == 0
    none = op6.score_documents(docs, op6.train(docs, label_df.limit(0))).collect()
    assert {r.predicted for r in none} == {0} and op6.score_documents(empty(spark), op6.ToxicityModel({})).count() == 0


def test_toxicity_patterns():
    lexicon = op6.Lexicon({"florp": 3.0, "grum-": 2.0, "grumn-": 2.5})

    def patterns(text):
        symbols = [lexicon[w] for w in op6._TOKENS.findall(text.lower())]
        return [(op6.PATTERNS[p], w) for p, w in op6.matched_patterns(symbols)]
    assert patterns("A florp house. You are a grumnak!") == [("plain", 3.0), ("targeted", 2.5)]
    assert patterns("Not a florp here") == [("negated", 3.0)]
    assert patterns("Not one of the many florp") == [("plain", 3.0)]  # the negation has closed
    assert patterns("She said you florp, a florp") == [("reported", 6.0)]
    assert patterns("I will hurt you\nI hurt") == [("threat", 1.0), ("threat", 1.0)]
    assert patterns("you I will hurt") == [("targeted threat", 1.0)]


def test_language_id(spark):
    rng = random.Random(6)
    spoken = {"en": "the of and that with", "de": "der und nicht auf über", "fr": "les est une pour où", "es": "los una pero con qué", "xx": "жук дом лес"}
    rows = [(5 * i + j, " ".join(rng.choice(spoken[lang].split()) for _ in range(8)), lang, "s")
            for i in range(60) for j, lang in enumerate(spoken)]
    odd = [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 .. 34", "de", "s"), (None, "the of and", None, "s"),
           (903, "les est " * 300_000, None, "s"), rows[0]]
    docs = documents(spark, rows + odd)
    model = op7.train(docs)
    out = op7.identify(docs, model).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 50
    by_id = {r.doc_id: r for r in out}
    assert by_id[900].lang_pred == by_id[901].lang_pred == by_id[902].lang_pred == "und"
    assert by_id[903].lang_pred == "fr" and by_id[None].lang_pred == "en"
    kept = op7.identified_documents(docs)
    assert kept.columns == docs.columns and 900 not in {r.doc_id for r in kept.collect()}
    assert op7.identify(docs, op7.train(docs.withColumn("lang", F.lit(None).cast("string")))).filter("lang_pred != 'und'").count() == 0
    assert op7.identified_documents(empty(spark)).count() == 0


def spoken_rows(rng, n):
    """Rows of four invented languages, and words of a fifth one that shares their letters."""
    letters = {"en": ("thwr", "eoa"), "de": ("schk", "iue"), "fr": ("lmpv", "eai"), "es": ("dngb", "oau"), "zz": ("xqjz", "yow")}
    words = {lang: ["".join(rng.choice(p) for p in (a, b, a, b)[:rng.choice((2, 3, 4))]) for _ in range(60)] for lang, (a, b) in letters.items()}
    return words, [(4 * i + j, " ".join(rng.choice(words[lang]) for _ in range(rng.choice((3, 12, 40)))), lang, "s")
                   for i in range(n) for j, lang in enumerate(("en", "de", "fr", "es"))]


def test_text_of_no_learned_language_goes(spark):
    rng = random.Random(14)
    words, rows = spoken_rows(rng, 100)
    odd = [(1000 + i, " ".join(rng.choice(words["zz"]) for _ in range(n)), "en", "s") for i, n in enumerate((5, 20, 80))]
    odd += [(2000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)), "de", "s") for i, n in enumerate((40, 400, 4000))]
    odd += [(3000, "жук дом лес " * 5, "fr", "s"), (3001, "日本語の文章です", "fr", "s")]
    model = op7.train(documents(spark, rows))
    langs, scores = model.predict([r[1] for r in odd])
    assert all(score < op7.MIN_SCORE for score in scores), list(zip(langs, scores))
    kept = op7.identified_documents(documents(spark, rows)).collect()
    assert {r.doc_id for r in kept} == {r[0] for r in rows}
    assert sum(r.lang == rows[r.doc_id][2] for r in kept) >= 0.97 * len(rows)


def test_every_language_is_learned(spark, monkeypatch):
    """More than 64 languages, one of them rare; and one in which a share per million rounds to nothing."""
    rows = [(i, f"{chr(0x4E00 + i % 70) * 3} {chr(0x5E00 + i % 70) * 2}", f"l{i % 70:02d}", "s") for i in range(420)] + [(999, "ñandú ñu", "rare", "s"), (1001, "ñu", "rare", "s"), (1003, "ñandú", "rare", "s")]
    model = op7.train(documents(spark, rows))
    assert sorted(model.near) == sorted({r[2] for r in rows})
    assert op7.identify(documents(spark, rows), model).filter("lang_pred = 'rare'").count() == 3
    monkeypatch.setattr(op7, "SAMPLE_ROWS", 2)  # fewer than languages: one row of each
    docs = documents(spark, [(i, "aa bb", ("en", "de", "fr")[i % 3], "s") for i in range(300)])
    assert sorted(op7.train(docs).near) == ["de", "en", "fr"]


def test_few_lengths_stay_exact(spark):
    """The grid follows the number of distinct lengths, not the longest text."""
    rows = [(i, " ".join(["w"] * n), "en", "s") for i, n in enumerate([10, 11, 12, 13, 500, 501])]
    out = op10.pack(documents(spark, rows), n_buckets=6, max_lengths=100).collect()
    assert sorted((r.n_tokens, r.bucket_len) for r in out) == [(n, n) for n in (10, 11, 12, 13, 500, 501)]


def test_many_lengths_are_rounded_above_half_the_limit(spark):
    lengths = list(range(0, 40)) + [60, 61, 200, 333, 334, 900]
    docs = documents(spark, [(i, " ".join(["w"] * n), "en", "s") for i, n in enumerate(lengths)])
    rows = docs.select("doc_id", op10.word_count("text").alias("n_tokens"))
    values, counts = op10._histogram(rows, 30)
    assert len(values) <= 30 and sum(counts) == len(lengths) and values[:16] == list(range(16)) and values[-1] >= 900
    out = op10.pack(docs, n_buckets=4, max_lengths=30).collect()
    assert len(out) == len(lengths) and all(r.n_tokens <= r.bucket_len for r in out)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id long, url string, html string, id string, value string")


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n\r\n\r\n", "é\r\n\r\n" * 1000, "x" * 500_000, "<p>a</p>"]
    rows = [(i, f"https://host/p/{i}?q=1#f", h) for i, h in enumerate(html)] + [(1, "https://host/p/1", "<p>a</p>"), (None, None, "alone"),
                                                                                  (20, "http://x/\r\nWARC/1.1", "nl"), (None, "u", "<p>a</p>")]
    df = pages(spark, rows)
    path = shared_path(spark, "warc-test")
    op8.write_warc(df, path, records_per_file=7)
    captures = op8.assemble(op8.read_warc(spark, path)).collect()
    assert len(captures) == len(rows)
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    seen, by_record = [], {c.response.record_id: c for c in captures}
    for c in captures:
        page, r = c.page_id, c.response
        assert c.request is not None and c.metadata is not None and c.request.http.startswith("GET ")
        if r.type == "response":
            text = bytes(r.payload).decode()
            assert r.payload_digest == __import__("base64").b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
            assert page == (largest[text] if largest[text] >= 0 else None) and r.refers_to is None and c.refers_to is None
            seen.append((page, text))
        else:
            target = by_record[r.refers_to]
            text = bytes(target.response.payload).decode()
            assert target.response.type == "response" and target.page_id == c.refers_to == largest[text]
            assert c.metadata.payload_bytes == len(text.encode())
            seen.append((page, text))
    assert sorted(map(str, seen)) == sorted(str((i, h or "")) for i, _, h in rows)
    empty_path = shared_path(spark, "warc-test")
    op8.write_warc(df.limit(0), empty_path)
    assert op8.assemble(op8.read_warc(spark, empty_path)).count() == 0


def test_warc_files_are_bounded_by_bytes(spark):
    """Few large pages among small ones: no file holds much more than its bytes, and all captures come back."""
    import glob
    import gzip
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(200)] + [(1000 + i, "http://h/l", f"{i} " + "é" * 500_000) for i in range(6)]
    path = shared_path(spark, "warc-bytes")
    op8.write_warc(pages(spark, rows).coalesce(1), path, records_per_file=100, file_bytes=1_000_000)
    sizes = [len(gzip.open(f).read()) for f in glob.glob(f"{path.removeprefix('file:')}/*.gz")]
    assert len(sizes) > 6 and max(sizes) < 2_200_000
    captures = op8.assemble(op8.read_warc(spark, path)).collect()
    assert sorted((c.page_id, bytes(c.response.payload).decode()) for c in captures) == sorted((i, h) for i, _, h in rows)


def test_damaged_archives_are_noticed():
    import io
    with pytest.raises(ValueError):
        list(op8.records_of(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(op8.records_of(io.BytesIO(b"hello\r\n")))


def test_very_long_urls(spark):
    """A url of 20,000 parts and a host of 5,000 labels have no more keys than the list's patterns can match."""
    import time
    url, host = "http://long.example.com/" + "/".join(f"p{i}" for i in range(20_000)), "http://" + ".".join(["x"] * 5_000) + ".deep.org/a"
    captures = spark.createDataFrame([(1, url, 5), (2, host, 5), (3, "http://long.example.com/p0/p1/zz", 5)], "page_id long, url string, fetch_day int")
    entries = spark.createDataFrame([("l", "long.example.com/p0/p1/p2", "add", 0), ("m", "example.com", "add", 0), ("n", "x.deep.org", "add", 0)],
                                    "list string, pattern string, action string, day int")
    began = time.time()
    got = {r.page_id: r.lists for r in op9.evaluate(captures, entries).collect()}
    assert got == {1: "l,m", 2: "n", 3: "m"} and time.time() - began < 30
    keys = captures.select(op9.url_keys("url", 3, 3).alias("k")).select(F.size("k").alias("n")).collect()
    assert max(r.n for r in keys) <= 6


def test_url_filters(spark):
    rng = random.Random(7)
    hosts = ["a.b.example.com", "b.example.com", "example.com", "other.org", "solo"]
    captures = [(i, f"HTTP://u@{rng.choice(hosts).upper()}:80/{rng.choice(['', 'x', 'x/y', 'z//y'])}?q#f", rng.randrange(100)) for i in range(300)]
    captures += [(400, None, 5), (401, "not a url", 5), (402, "http://other.org", None), captures[0]]
    patterns = ["example.com", "b.example.com", "b.example.com/x", "other.org/x/y", "solo", "com"]
    entries = [(rng.choice(["l1", "l2"]), rng.choice(patterns), rng.choice(["add", "remove"]), rng.randrange(-20, 130)) for _ in range(60)]
    entries += [(None, "solo", "add", 1), ("l1", None, "add", 1), ("l1", "solo", "add", None)]
    got = op9.evaluate(spark.createDataFrame([(*c, "c") for c in captures], "page_id long, url string, fetch_day int, key string"),
                       spark.createDataFrame(entries, "list string, pattern string, action string, day int"), period_days=7).collect()

    def active(url, day):
        m = re.match(r"[a-z]+://(?:[^/@?#]*@)?([^/:?#]+)[^/?#]*([^?#]*)", (url or "").lower())
        if not m or day is None:
            return []
        path = [p for p in re.match(r"[A-Za-z]+://[^/?#]*([^?#]*)", url).group(1).split("/") if p]
        labels = m.group(1).split(".")
        keys = {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))} | {m.group(1) + "/" + "/".join(path[:i + 1]) for i in range(len(path))}
        out = set()
        for name, pattern in {e[:2] for e in entries if None not in e}:
            log = sorted((d, a) for n, p, a, d in entries if (n, p) == (name, pattern) and d is not None and d <= day)
            if pattern in keys and log and log[-1][1] == "add":
                out.add((name, pattern))
        return out
    expected = sorted((i, d if d is not None else -1, len(active(u, d)), ",".join(sorted({n for n, _ in active(u, d)}))) for i, u, d in captures)
    assert sorted((r.page_id, r.fetch_day if r.fetch_day is not None else -1, r.n_active, r.lists) for r in got) == expected
    assert all(r.blocked == (r.n_active > 0) for r in got) and sum(r.blocked for r in got) > 30


def best_padding(lengths, counts, k):
    n = len(lengths)
    best = {(0, 0): 0}
    for j in range(1, n + 1):
        for used in range(1, k + 1):
            best[j, used] = min((best[i, used - 1] + sum(counts[x] * (lengths[j - 1] - lengths[x]) for x in range(i, j))
                                 for i in range(j) if (i, used - 1) in best), default=10**18)
    return min(best[n, used] for used in range(1, k + 1) if (n, used) in best)


def test_optimal_boundaries():
    rng = random.Random(9)
    for _ in range(60):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 14)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 6)
        bounds = op10.optimal_boundaries(lengths, counts, k)
        assert len(bounds) <= k and bounds == sorted(bounds) and bounds[-1] == lengths[-1]
        padding = sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
        assert padding == best_padding(lengths, counts, k)


def test_packing(spark):
    docs = documents(spark)
    rows = op10.pack(docs, n_buckets=4, token_budget=200, shard_rows=3).collect()
    lengths = [len(words_of(r.text)) for r in docs.collect()]
    assert sorted(r.n_tokens for r in rows) == sorted(lengths)
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault((r.bucket_id, r.batch_id), []).append(r)
    for batch in batches.values():
        assert sorted(r.slot for r in batch) == list(range(len(batch))) and {r.batch_rows for r in batch} == {len(batch)}
        assert len(batch) == 1 or len(batch) * batch[0].bucket_len <= 200 or batch[0].bucket_len == 0
    for bucket in {b for b, _ in batches}:
        numbers = sorted(n for b, n in batches if b == bucket)
        assert numbers == list(range(len(numbers)))
    coarse = op10.pack(docs, n_buckets=4, max_lengths=5).collect()
    assert all(r.n_tokens <= r.bucket_len for r in coarse) and len(coarse) == len(rows)
    assert op10.pack(empty(spark)).count() == 0
