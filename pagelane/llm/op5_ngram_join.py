"""N-gram Jaccard join: grouped prefix join over word shingles.

Sets of 64-bit shingle hashes are built in tasks from whole texts. A pair can
only reach the similarity if it shares a token among the first
``n - ceil(t * n) + 1`` of each set under one global token order, so only these
prefixes are indexed. In the order, tokens found frequent come last (any choice
of them is right; they are the most frequent ones, at most ``MAX_FREQUENT``).

1. Documents with the same set are one member; members with the same prefix and
   size are one group, and only groups enter the inverted index.
2. Along every posting list, sorted by size, a group pairs with the nearest
   earlier group and with a leader of compatible size: a star, not all pairs.
   The pairs (and each group's other members) are verified by exact
   intersection, and the links give first components.
3. Posting lists that still touch several components are joined again, for
   groups of *different* components only, expanded to their members, under the
   size, position and bitmap filters; the pairs are verified. Pairs inside a component
   cannot change it, so none needs looking at and no link between components is
   lost.

The bitmap filter compares 512 parity bits of the sets: they differ in at most as
many bits as the sets in tokens, so it never drops a link, and members of a group
of near copies that are not similar enough to each other make no rows.

Full sets travel only for members of candidate pairs; they are computed again
from the texts instead of being stored.

Defined cases: null text and text without words give the empty set, linked with
nothing; fewer words than a shingle give one shingle of all words; rows with
equal ids are rows of their own; null ids are ignored by the minimum (a component
of null ids only has a null component_id); an empty table gives no rows; other
columns are not read. Sets are told apart by a 64-bit fingerprint and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelane.llm.common import discard, staged, table, text_or_empty
from pagelane.llm.components import connected_components

SHINGLE = 4
PERCENT = 85
FREQUENT = 16
MAX_FREQUENT = 1_000_000
MAX_LOOKUP = 4_000_000
LISTED_TOKENS = 64
_SEEN_SETS = 500_000
_CHUNK_BYTES = 1 << 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, np.uint64)  # one fixed number per byte value
_VALUES[65:91] = _VALUES[97:123]  # A-Z like a-z


def _powers(n: int, base: int, kept: dict = {}) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64; tables are kept."""
    table_ = kept.get(base)
    if table_ is None or len(table_) < n:
        size = max(n, _CHUNK_BYTES)
        table_ = np.full(size, base & (2**64 - 1), np.uint64)
        table_[0] = 1
        np.multiply.accumulate(table_, out=table_)
        kept[base] = table_
    return table_[:n]


_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 2**64)


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word in UTF-8 bytes, and where it starts.

    ``breaks`` are offsets at which a text ends and the next one starts. The
    hash of a word is a polynomial in its bytes; differences of running sums
    give it for all words of a chunk at once.
    """
    word = ~_BLANK[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # chunks of whole words
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _CHUNK_BYTES, "right")))
        low, high = starts[at], ends[to - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUES[data[low:high]] * _powers(high - low, _BASE), out=sums[1:])
        here, there = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[there] - sums[here]) * _powers(high - low, _BACK)[here] + (there - here).astype(np.uint64) * _MIX[0]
        at = to
    out ^= out >> np.uint64(32)
    out *= _MIX[1]
    out ^= out >> np.uint64(29)
    return out, starts


def shingle_sets(column: pa.BinaryArray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text (UTF-8 bytes, none null)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    done = 0
    while done < len(column):  # texts of some megabytes together
        to = max(done + 1, int(np.searchsorted(offsets, offsets[done] + 4 * _CHUNK_BYTES, "right")) - 1)
        low, high = offsets[done], offsets[to]
        ids, starts = word_hashes(data[low:high], offsets[done:to + 1] - low)
        mixed = np.zeros(max(0, len(ids) - k + 1), np.uint64)
        for i in range(k if len(mixed) else 0):
            mixed = (mixed ^ ids[i:len(ids) - k + 1 + i]) * _MIX[i % 4]
            mixed ^= mixed >> np.uint64(31)
        mixed = mixed.view(np.int64)
        words = np.searchsorted(starts, offsets[done:to + 1] - low)
        for begin, end in zip(words[:-1].tolist(), words[1:].tolist()):
            if end - begin >= k:
                tokens = np.sort(mixed[begin:end - k + 1])
                fresh = np.empty(len(tokens), bool)
                fresh[0] = True
                np.not_equal(tokens[1:], tokens[:-1], out=fresh[1:])
                yield tokens[fresh]
            elif end > begin:
                yield np.array([xxhash.xxh3_64_intdigest(ids[begin:end].tobytes(), seed=end - begin)], np.uint64).view(np.int64)
            else:
                yield np.empty(0, np.int64)
        done = to


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _prefix(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens in the global order: those not frequent by value, then the frequent by value."""
    want = prefix_length(len(tokens), percent)
    if not len(frequent):
        return tokens[:want]
    for some in (tokens[:2 * want + 64], tokens):
        at = np.minimum(np.searchsorted(frequent, some), len(frequent) - 1)
        common = frequent[at] == some
        rare = some[~common]
        if len(rare) >= want or len(some) == len(tokens):
            break
    return rare[:want] if len(rare) >= want else np.concatenate([rare, some[common][:want - len(rare)]])


def _sampled_tokens(k: int, percent: int):
    """Tokens for counting: of each set about twice its prefix, in hash order."""
    def run(batches):
        for batch in batches:
            parts = [tokens[:2 * prefix_length(len(tokens), percent) + 16] for tokens in shingle_sets(batch.column(0), k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64))], names=["token"])
    return run


BITMAP_LONGS = 8
_BITS = [f"b{i}" for i in range(BITMAP_LONGS)]
_MEMBER_DDL = "doc_id long, local long, n long, gid long, pg long, prefix binary, " + ", ".join(f"{b} long" for b in _BITS)


def parity_bitmap(tokens: np.ndarray) -> list[int]:
    """Every token flips one bit. The bits in which two bitmaps differ are no more than the tokens in which the sets differ."""
    counts = np.bincount(tokens & (64 * BITMAP_LONGS - 1), minlength=64 * BITMAP_LONGS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64).tolist()


def _may_link(x: str, y: str, percent: int):
    """Bitmap filter: whether sets with these sizes and bitmaps can reach the similarity."""
    differ = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in _BITS), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _members(k: int, percent: int, frequent_tokens):
    """Per document its set's size and fingerprint; the first of a set in the task carries the prefix."""
    def run(batches):
        frequent, seen = frequent_tokens.value, {}
        for batch in batches:
            out = []
            for doc_id, row, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), k)):
                n = len(tokens)
                gid = xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=n) - (1 << 63)
                if n and (gid, n) not in seen:
                    if len(seen) > _SEEN_SETS:
                        seen.clear()
                    seen[gid, n] = row
                    prefix = _prefix(tokens, frequent, percent).tobytes()
                    out.append((doc_id, row, n, gid, xxhash.xxh3_64_intdigest(prefix, seed=n) - (1 << 63), prefix, *parity_bitmap(tokens)))
                else:
                    out.append((doc_id, seen[gid, n] if n else row, n, gid, None, None, *[None] * BITMAP_LONGS))
            yield _rows(out, [("doc_id", pa.int64()), ("local", pa.int64()), ("n", pa.int64()), ("gid", pa.int64()),
                              ("pg", pa.int64()), ("prefix", pa.binary()), *[(b, pa.int64()) for b in _BITS]])
    return run


def _rows(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=pa.schema(fields))


def _index(batches):
    """Index rows of groups: token, group, size and position in one long, several members or not."""
    for batch in batches:
        tokens, reps, places, several = [], [], [], []
        for rep, n, many, prefix in zip(*(batch.column(i).to_pylist() for i in range(4))):
            prefix = np.frombuffer(prefix, np.int64)
            tokens.append(prefix)
            reps.append(np.full(len(prefix), rep, np.int64))
            places.append((np.int64(n) << 32) | np.arange(len(prefix), dtype=np.int64))
            several.append(np.full(len(prefix), many, bool))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, reps, places, several)],
                                             names=["token", "rep", "place", "several"])


_POSTING = [("token", pa.int64()), ("rep", pa.int64()), ("place", pa.int64()), ("leader", pa.int64()), ("previous", pa.int64())]


def _compatible(a: int, b: int, percent: int) -> bool:
    """Size and position filters for two places (size << 32 | position) of one token."""
    na, nb = a >> 32, b >> 32
    rest = min(na - (a & 0xFFFFFFFF), nb - (b & 0xFFFFFFFF))
    return 100 * min(na, nb) >= percent * max(na, nb) and (100 + percent) * rest >= percent * (na + nb)


def _star_postings(percent: int):
    """Rows of posting lists with more than one member, each with a leader and the row before it.

    Input is sorted by token and place; the state is the current leader and the
    last row, so a list may be as long as it likes.
    """
    def run(batches):
        token = first = leader = last = None
        for batch in batches:
            tokens = batch.column(0).to_numpy()
            several = batch.column(3).to_numpy(zero_copy_only=False)
            same = np.empty(len(tokens), bool)
            same[1:] = tokens[1:] == tokens[:-1]
            if len(tokens):
                same[0] = token is not None and tokens[0] == token
            following = np.append(same[1:], True)  # the batch's last row may go on: looked at like one that does
            out = []
            at = np.flatnonzero(same | following | several)
            reps, places = batch.column(1).to_numpy()[at].tolist(), batch.column(2).to_numpy()[at].tolist()
            for row, many in zip(zip(tokens[at].tolist(), reps, places), several[at].tolist()):
                if row[0] != token:
                    token, leader, last = row[0], row, row
                    first = row
                    if many:
                        out.append((*row, None, None))
                        first = None
                    continue
                if first is not None:
                    out.append((*first, None, None))
                    first = None
                near = last if _compatible(last[2], row[2], percent) else None
                if _compatible(leader[2], row[2], percent):
                    out.append((*row, leader[1], near and near[1]))
                else:
                    leader = row
                    out.append((*row, None, near and near[1]))
                last = row
            yield _rows(out, _POSTING)
    return run


def _wanted_sets(k: int, wanted):
    """Sets of the members that candidate pairs name (of all, if too many are named to be sent around)."""
    def run(batches):
        seen, names = set(), wanted.value if wanted else None
        for batch in batches:
            out = []
            for tokens in shingle_sets(batch.column(0), k):
                n = len(tokens)
                gid = xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=n) - (1 << 63)
                if not n or (gid, n) in seen:
                    continue
                if names is not None:
                    at = np.searchsorted(names, gid)
                    if at == len(names) or names[at] != gid:
                        continue
                if len(seen) > _SEEN_SETS:
                    seen.clear()
                seen.add((gid, n))
                out.append((gid, tokens.tobytes()))
            yield _rows(out, [("gid", pa.int64()), ("tokens", pa.binary())])
    return run


def _verify(percent: int):
    """Pairs whose exact intersection reaches the similarity."""
    def run(batches):
        for batch in batches:
            out = []
            for a, b, left, right in zip(*(batch.column(i) for i in range(4))):
                x, y = np.frombuffer(left.as_py(), np.int64), np.frombuffer(right.as_py(), np.int64)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a.as_py(), b.as_py()))
            yield _rows(out, [("a", pa.int64()), ("b", pa.int64())])
    return run


def _plausible(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the bitmap filter."""
    x, y = bitmaps.alias("x"), bitmaps.alias("y")
    return (pairs.join(x, F.col("a") == F.col("x.gid")).join(y, (F.col("b") == F.col("y.gid")))
            .filter(_may_link("x", "y", percent)).select("a", "b"))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among staged candidate pairs (a, b)."""
    spark = pairs.sparkSession
    names = staged(pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct(), "join-wanted")
    wanted = None
    if names.count() <= MAX_LOOKUP:
        wanted = spark.sparkContext.broadcast(np.sort(names.toPandas()["gid"].to_numpy(np.int64)))
    sets = texts.select("text").mapInArrow(_wanted_sets(k, wanted), "gid long, tokens binary")
    sets = staged(sets.groupBy("gid").agg(F.first("tokens").alias("tokens")), "join-sets")
    left = pairs.join(sets.select(F.col("gid").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("gid").alias("b"), F.col("tokens").alias("y")), "b")
    links = staged(both.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"), "join-links")
    discard(names, sets)
    return links


def _frequent_tokens(texts: DataFrame, k: int, percent: int):
    counts = texts.select("text").mapInArrow(_sampled_tokens(k, percent), "token long").groupBy("token").count()
    top = staged(counts.filter(F.col("count") > FREQUENT).orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).select("token"), "join-frequent")
    tokens = np.sort(top.toPandas()["token"].to_numpy(np.int64))
    discard(top)
    return texts.sparkSession.sparkContext.broadcast(tokens)


def similarity_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                        text_or_empty(text_col).cast("binary").alias("text"))
    frequent = _frequent_tokens(texts, k, percent)
    base = staged(texts.mapInArrow(_members(k, percent, frequent), _MEMBER_DDL), "join-members")
    firsts = base.filter("prefix IS NOT NULL")
    groups = staged(firsts.groupBy("pg", "n").agg(F.min("gid").alias("rep"), (F.min("gid") < F.max("gid")).alias("several"),
                                                  F.first("prefix").alias("prefix")), "join-groups")
    members = staged(firsts.select("pg", "n", "gid").distinct().join(groups.filter("several").select("pg", "n", "rep"), ["pg", "n"])
                     .select("rep", "gid"), "join-grouped")
    bitmaps = staged(firsts.groupBy("gid").agg(F.first("n").alias("n"), *[F.first(b).alias(b) for b in _BITS]), "join-bitmaps")
    named = staged(base.select("doc_id", "local", "n", "gid"), "join-named")
    discard(base)
    index = groups.select("rep", "n", "several", "prefix").mapInArrow(
        _index, "token long, rep long, place long, several boolean")
    postings = staged(index.repartition("token").sortWithinPartitions("token", "place", "rep").mapInArrow(
        _star_postings(percent), "token long, rep long, place long, leader long, previous long"), "join-postings")
    discard(groups)

    stars = (postings.select(F.explode(F.array("leader", "previous")).alias("a"), F.col("rep").alias("b"))
             .unionByName(members.select(F.col("rep").alias("a"), F.col("gid").alias("b"))))
    first_pairs = staged(_plausible(stars.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                                    .distinct(), bitmaps, percent), "join-pairs")
    links = _verified(first_pairs, texts, k, percent)
    roots = connected_components(links, "a", "b")

    more_pairs = _cross_pairs(postings, members, roots, bitmaps, percent, first_pairs)
    discard(postings, members, bitmaps, first_pairs)
    if not more_pairs.isEmpty():
        more = _verified(more_pairs, texts, k, percent)
        roots = connected_components(links.unionByName(more), "a", "b")
        discard(more)
    discard(links, more_pairs)
    return _labelled(named, roots)


def _cross_pairs(postings: DataFrame, members: DataFrame, roots: DataFrame, bitmaps: DataFrame, percent: int, known: DataFrame) -> DataFrame:
    """Candidate pairs of members of different components, from the lists that touch several, without the ``known`` ones."""
    expanded = postings.select("token", "rep", "place").join(members.withColumnRenamed("rep", "of"), F.col("rep") == F.col("of"), "left") \
        .select("token", "place", F.coalesce("gid", "rep").alias("gid"))
    rooted = expanded.join(roots, F.col("gid") == F.col("node"), "left").select(
        "token", "gid", F.shiftright("place", 32).alias("n"), (F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))).alias("pos"),
        F.coalesce("root", "gid").alias("root"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    # A member's tokens in prefix order, so that a pair is made at its first common token only. Members of
    # many such tokens go without, and distinct() takes their repeated pairs.
    listed = (rooted.join(mixed, "token", "left_semi").groupBy("gid")
              .agg(F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("at")).join(bitmaps, "gid"))
    few = F.when(F.size("at") <= LISTED_TOKENS, F.transform("at", lambda e: e["token"]))
    rooted = listed.select("gid", "root", "n", *_BITS, few.alias("tokens"), F.posexplode("at").alias("i", "e")).select(
        "gid", "root", "n", *_BITS, "e.token", "e.pos", F.when(F.col("tokens").isNotNull(), F.slice("tokens", F.lit(1), F.col("i"))).alias("before"))
    rooted = staged(rooted, "join-mixed")
    x, y = rooted.alias("x"), rooted.alias("y")
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    near = ((F.col("x.token") == F.col("y.token")) & (F.col("x.gid") < F.col("y.gid")) & (F.col("x.root") != F.col("y.root"))
            & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
            & ((100 + percent) * rest >= percent * (F.col("x.n") + F.col("y.n"))) & _may_link("x", "y", percent)
            & ~F.coalesce(F.arrays_overlap("x.before", "y.before"), F.lit(False)))
    pairs = x.join(y, near).select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b")).distinct()
    pairs = staged(pairs.join(known, ["a", "b"], "left_anti"), "join-pairs")
    discard(rooted)
    return pairs


def _labelled(base: DataFrame, roots: DataFrame) -> DataFrame:
    """Component ids, joined by the task-local first row of a set, so that copies do not meet at one key."""
    local = base.filter("n > 0").groupBy("local", "gid").agg(F.min("doc_id").alias("least"))
    rooted = staged(local.join(roots, F.col("gid") == F.col("node"), "left").select(
        F.col("local").alias("at"), "least", F.coalesce("root", "gid").alias("root")), "join-components")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    decided = rooted.select("at", "root").join(smallest, "root").select("at", "component_id")
    return base.join(decided, F.col("local") == F.col("at"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of the smallest id stays.

    Texts are compared by ``k``-word shingles. Rows whose id is null stay; of rows
    with equal ids in one component all stay, as the id does not tell them apart.
    """
    found = similarity_components(docs, k, percent)
    gone = staged(found.filter("component_id < doc_id").select("doc_id").distinct(), "join-gone")
    gone = gone.withColumnRenamed("doc_id", "__gone")
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))


SQL = None
