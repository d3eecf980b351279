"""Vector code compression: product codes, nearest entries by slice-and-intersect bitmasks.

Vectors are cut into ``PARTS`` equal parts; each part position has a codebook of at
most 64 entries, so a set of entries is one uint64. Per dimension of a part the
entries' coordinates are sorted, and beside the r-th one lies the mask of the first
r entries. The search of a part's nearest entry starts from an initial radius: the
distance to the best of a few entries, those next to it in each sorted dimension.
Every entry at most that far has each coordinate within the radius, so two binary
searches a dimension give a slice, two prefix masks its set of entries, and the AND
over the dimensions is a set that holds every nearest entry. Only its members'
exact distances are computed; the smallest one wins, ties to the lower index.

Training runs over every row: each round, tasks assign their rows and send the count
and the component sums of each entry they used; these meet by (part, entry), added
up in Python integers, and only the new codebooks (64 vectors in all) come to the
driver. The first codebook is the parts of the 64 smallest ids (a bounded sort).

Defined cases: rows whose vector is null or holds a null or non-finite component go,
and so do rows of another length than the row of the smallest id has; a length that
16 does not divide gives parts that differ by one component; null ids come last
and are coded too; of repeated ids the smaller vector comes first; fewer than 64 rows
give smaller codebooks; large components are computed in Python integers, so codes
and codebooks stay exact, and an error or label_error beyond a long is null; null
labels are one label; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelane.llm.common import staged, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
FINENESS = 256
_SLICE = 4_096
#: Labels whose sums are sent to every task (two numbers each); beyond that a salted join.
BROADCAST_LABELS = 100_000
_SALTS = 32


def part_bounds(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]


def _roots(squares: np.ndarray) -> np.ndarray:
    """Floors of the square roots."""
    if squares.dtype == object:
        return np.array([math.isqrt(s) for s in squares], object)
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


class Codebook:
    """Entries of one part, ready for slice-and-intersect searches."""

    def __init__(self, entries: list[list[int]]):
        self.entries = entries
        self.largest = max((abs(x) for e in entries for x in e), default=0)
        self.width = len(entries[0]) if entries else 0
        self._ready = {}

    def _in(self, kind):
        """Entries, sorted coordinates, order and prefix masks per dimension, as int64 or Python integers."""
        if kind not in self._ready:
            c = np.array(self.entries, kind).reshape(len(self.entries), self.width)
            order = [np.argsort(c[:, d], kind="stable") for d in range(self.width)]
            masks = []
            for o in order:
                prefix = np.zeros(len(o) + 1, np.uint64)
                prefix[1:] = np.bitwise_or.accumulate(np.uint64(1) << o.astype(np.uint64))
                masks.append(prefix)
            self._ready[kind] = c, [c[o, d] for d, o in enumerate(order)], order, masks
        return self._ready[kind]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry of each row, and how many distances were computed."""
        return self._nearest(x, self._kind(x))

    def _kind(self, x: np.ndarray):
        if x.dtype == object:
            return object
        reach = int(np.abs(x).max(initial=0)) + self.largest
        return np.int64 if reach * reach * max(1, self.width) < 1 << 62 else object

    def _nearest(self, x, kind):
        c, sorted_, order, masks = self._in(kind)
        x = x.astype(kind, copy=False)
        rows = len(x)
        if not self.width:
            return np.zeros(rows, np.int64), np.zeros(rows, kind), 0
        # Initial radius: the best of the entries next to the row in each dimension.
        best = None
        for d in range(self.width):
            at = np.minimum(np.searchsorted(sorted_[d], x[:, d]), len(c) - 1)
            far = ((x - c[order[d][at]]) ** 2).sum(1)
            best = far if best is None else np.minimum(best, far)
        radius = _roots(best)
        found = np.full(rows, np.uint64(0xFFFFFFFFFFFFFFFF))
        for d in range(self.width):
            low = np.searchsorted(sorted_[d], x[:, d] - radius, "left")
            high = np.searchsorted(sorted_[d], x[:, d] + radius, "right")
            found &= masks[d][high] & ~masks[d][low]
        bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(rows, 8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)  # by row, then by entry: no row is without one
        far = ((x[row] - c[entry]) ** 2).sum(1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(far, starts)
        hits = np.flatnonzero(far == np.repeat(least, np.diff(starts, append=len(row))))
        first = hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]
        return entry[first], least, len(row) + rows * self.width


def integer_vectors(column: pa.Array) -> np.ndarray:
    """floor(256 * x) of vectors of one length, as int64, or Python integers where they do not fit."""
    rows = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.empty((0, 0))
    scaled = np.floor(values * FINENESS)
    if np.abs(scaled).max(initial=0) < 2.0 ** 62:
        return scaled.astype(np.int64)
    # A double beyond 2 ** 1016 times 256 is infinite, so these are multiplied as integers.
    return np.array([[math.floor(x) * FINENESS if abs(x) >= 2.0 ** 53 else math.floor(x * FINENESS) for x in row] for row in values.tolist()],
                    object).reshape(values.shape)


def _slices(batches):
    """Slices of the Arrow batches, so that few rows are held as integers at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE):
            yield batch.slice(start, _SLICE)


def _sums(books, bounds):
    """Per task: part, entry, count and decimal component sums of the entries it used."""
    def run(batches):
        sums = {}
        for batch in _slices(batches):
            x = integer_vectors(batch.column("v"))
            for p, (start, end) in enumerate(bounds):
                part = x[:, start:end]
                codes, _, _ = books.value[p].nearest(part)
                kind = object if part.dtype == object or int(np.abs(part).max(initial=0)) * len(part) >= 1 << 62 else np.int64
                added = np.zeros((ENTRIES, end - start), kind)
                np.add.at(added, codes, part.astype(kind, copy=False))
                counts = np.bincount(codes, minlength=ENTRIES)
                for e in np.flatnonzero(counts).tolist():
                    total = sums.setdefault((p, e), [0] * (end - start + 1))
                    for k, value in enumerate([counts[e], *added[e]]):
                        total[k] += int(value)
        yield _sum_rows(sums)
    return run


def _sum_rows(sums) -> pa.RecordBatch:
    keys = sorted(sums)
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()),
         pa.array([[str(x) for x in sums[k]] for k in keys], pa.list_(pa.string()))], names=["part", "entry", "sums"])


def _added_sums(batches):
    """Sums of each (part, entry) of this task: it has all rows of its keys."""
    sums = {}
    for batch in batches:
        for p, e, values in zip(*(c.to_pylist() for c in batch.columns)):
            total = sums.setdefault((p, e), [0] * len(values))
            for k, value in enumerate(values):
                total[k] += int(value)
    yield _sum_rows(sums)


_SUMS_DDL = "part int, entry int, sums array<string>"


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (id, label, v) whose vector is whole."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.col(vector_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(whole).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))


def train(rows: DataFrame, rounds: int = ROUNDS) -> tuple[list[list[list[int]]], int]:
    """Codebooks (part, entry, integer components) and the vectors' length."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES)
    least = first.select(F.size("v")).limit(1).collect()
    if not least:
        return [], 0
    length = least[0][0]
    rows = rows.filter(F.size("v") == length)
    # Bounded: 64 vectors, and 64 sums of a part each round.
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").toArrow().column("v").combine_chunks()
    start = integer_vectors(first).tolist()
    bounds = part_bounds(length)
    books = [[v[a:b] for v in start] for a, b in bounds]
    for _ in range(rounds):
        sent = _sent(rows, books)
        sums = rows.select("v").mapInArrow(_sums(sent, bounds), _SUMS_DDL)
        total = sums.repartition("part", "entry").mapInArrow(_added_sums, _SUMS_DDL)
        for r in total.collect():
            n, *values = map(int, r.sums)
            books[r.part][r.entry] = [x // n for x in values]
        sent.destroy()
    return books, length


def _sent(rows: DataFrame, books):
    return rows.sparkSession.sparkContext.broadcast([Codebook(b) for b in books])


def digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all integer components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def _codes(books, bounds):
    def run(batches):
        for batch in _slices(batches):
            x = integer_vectors(batch.column("v"))
            codes, errors = np.zeros((len(x), len(bounds)), np.uint8), [0] * len(x)
            for p, (start, end) in enumerate(bounds):
                codes[:, p], far, _ = books.value[p].nearest(x[:, start:end])
                errors = [a + b for a, b in zip(errors, far.tolist())]
            text = codes.tobytes().hex()
            step = 2 * len(bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([text[i * step:(i + 1) * step] for i in range(len(x))], pa.string()),
                 pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())], names=["vec_id", "label", "code", "error"])
    return run


def encode(rows: DataFrame, books: list[list[list[int]]], length: int) -> DataFrame:
    """vec_id, label, code and error of the rows of that length."""
    label = rows.schema["label"].dataType.simpleString()
    return rows.filter(F.size("v") == length).mapInArrow(_codes(_sent(rows, books), part_bounds(length)),
                                                         f"vec_id long, label {label}, code string, error long")


def decode(codes: DataFrame, books: list[list[list[int]]], code_col: str = "code") -> DataFrame:
    """``codes`` with v: the vector of the code's entries."""
    parts = F.array(*[F.array(*[F.array(*[F.lit(x / FINENESS) for x in e]) for e in book]) for book in books])
    entry = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.get(
        F.get(parts, p), F.conv(F.substring(F.col(code_col), 2 * p + 1, F.lit(2)), 16, 10).cast("int")))
    return codes.withColumn("v", F.flatten(entry))


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` (written rows) with label_error: error summed over rows of the same label."""
    whole = F.count(F.lit(1)) == F.count("error")
    sums = codes.groupBy("label").agg(F.when(whole, F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")).alias("label_error"))
    sums = staged(sums.withColumnRenamed("label", "__label"), "vector-labels")
    same = F.col("label").eqNullSafe(F.col("__label"))
    if sums.count() <= BROADCAST_LABELS:
        return codes.join(F.broadcast(sums), same).drop("__label")
    sums = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("__salt"))
    codes = codes.withColumn("__row", F.pmod(F.xxhash64("vec_id", "code"), F.lit(_SALTS)).cast("int"))
    return codes.join(sums, same & (F.col("__row") == F.col("__salt"))).drop("__label", "__salt", "__row")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_vectors(table(spark, sf_dir, "embeddings"))
    books, length = train(rows)
    codes = with_label_error(staged(encode(rows, books, length), "vector-codes"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(number: int) -> str:
    """Assignment of every part to the codebook of round ``number`` and the codebook that follows from it."""
    return f"""
a{number} AS (SELECT v.vec_id, v.part, min(struct_pack(
                far := list_sum(list_transform(list_zip(v.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry := b.entry)) AS best
              FROM v JOIN b{number} b ON v.part = b.part GROUP BY v.vec_id, v.part),
m{number} AS (SELECT part, entry, list(floored ORDER BY pos) AS c FROM (
                SELECT v.part, a.best.entry AS entry, x.pos, CASE WHEN sum(v.c[x.pos]) % count(*) < 0
                         THEN sum(v.c[x.pos]) // count(*) - 1 ELSE sum(v.c[x.pos]) // count(*) END::BIGINT AS floored
                FROM v JOIN a{number} a ON v.vec_id = a.vec_id AND v.part = a.part, (SELECT unnest(range(1, 5)) AS pos) x
                GROUP BY v.part, a.best.entry, x.pos) GROUP BY part, entry),
b{number + 1} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{number} b LEFT JOIN m{number} m ON b.part = m.part AND b.entry = m.entry)"""


SQL = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, p AS part, list_slice(c, 4 * p + 1, 4 * p + 4) AS c FROM e, (SELECT unnest(range(16)) AS p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY entry < 64),
b0 AS (SELECT v.part, f.entry, v.c FROM f JOIN v ON f.vec_id = v.vec_id),{_round_sql(0)},{_round_sql(1)},{_round_sql(2)},
r AS (SELECT a.vec_id, string_agg(printf('%02x', a.best.entry), '' ORDER BY a.part) AS code, sum(a.best.far)::BIGINT AS error
      FROM a2 a GROUP BY a.vec_id)
SELECT r.vec_id, r.code, r.error, (sum(r.error) OVER (PARTITION BY e.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM r JOIN e ON r.vec_id = e.vec_id
"""
