"""Packing documents into token-budget batches of optimal length buckets.

The histogram of lengths (one row per distinct length, so at most as many rows
as the longest text has words) goes to the driver, where dynamic programming
chooses the bucket boundaries with the least total padding. With boundary b for
lengths (a, b], the padding is b * count - words, so each layer of the recursion
is a lower envelope of lines and takes one pass over the lengths. Only if there are more
than ``max_lengths`` distinct lengths, those above half that number are rounded up to
a grid that keeps the histogram within that size; the boundaries are then optimal for
the rounded lengths, and padding grows by less than the grid a document above it.

Documents of a bucket are numbered without bringing a bucket into one task:
they fall into shards by their hash (about ``shard_rows`` rows each, by the
histogram's counts), are numbered inside the shard, and the shard's offset is
added. Every ``token_budget // bucket_len`` numbers make a batch.

Defined cases: a null or empty text has length 0 and is packed like any other;
a text longer than the budget is a batch of its own; rows with equal or null ids
are packed once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pagelane.llm.common import staged, table, word_count

N_BUCKETS = 16
TOKEN_BUDGET = 65_536
MAX_LENGTHS = 1_000_000
SHARD_ROWS = 10_000


def optimal_boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least padding.

    ``lengths`` are distinct and ascending. Integers only, so the optimum is
    exact; the same input always gives the same boundaries.
    """
    n = len(lengths)
    if not n:
        return []
    rows, words = [0] * (n + 1), [0] * (n + 1)
    for i, (length, count) in enumerate(zip(lengths, counts)):
        rows[i + 1], words[i + 1] = rows[i] + count, words[i] + length * count
    best = [lengths[j - 1] * rows[j] - words[j] if j else 0 for j in range(n + 1)]
    choices = [[0] * (n + 1)]
    for _ in range(1, min(n_buckets, n)):
        layer, choice = best[:], [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # lines (slope, intercept, split) with falling slopes
        front = 0
        for j in range(1, n + 1):
            split = j - 1
            line = (-rows[split], best[split] + words[split], split)
            while len(hull) - front >= 2:
                (s1, c1, _), (s2, c2, _) = hull[-2], hull[-1]
                if (line[1] - c1) * (s1 - s2) <= (c2 - c1) * (s1 - line[0]):
                    hull.pop()
                else:
                    break
            hull.append(line)
            at = lengths[j - 1]
            while len(hull) - front >= 2 and hull[front + 1][0] * at + hull[front + 1][1] <= hull[front][0] * at + hull[front][1]:
                front += 1
            slope, intercept, split = hull[front]
            layer[j] = at * rows[j] - words[j] + slope * at + intercept
            choice[j] = split
        best = layer
        choices.append(choice)
    bounds, j = [], n
    for choice in reversed(choices):
        if not j:
            break
        bounds.append(lengths[j - 1])
        j = choice[j]
    return bounds[::-1]


def _bucket(length: Column, bounds: list[int]) -> Column:
    return sum((F.when(length > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)


def _histogram(lengths: DataFrame, max_lengths: int) -> tuple[list[int], list[int]]:
    """Distinct lengths and their counts, at most ``max_lengths`` of them."""
    histogram = staged(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")), "pack-histogram")
    size = histogram.agg(F.count(F.lit(1)).alias("distinct"), F.max("n_tokens").alias("longest")).first()
    if size["distinct"] > max_lengths:
        exact = max_lengths // 2
        grid = -(-(size["longest"] - exact) // (max_lengths - exact - 1))  # one number less for the length 0
        above = F.ceil((F.col("n_tokens") - exact) / grid) * grid + exact
        rounded = F.when(F.col("n_tokens") <= exact, F.col("n_tokens")).otherwise(above).cast("long")
        histogram = histogram.groupBy(rounded.alias("n_tokens")).agg(F.sum("n").alias("n"))
    pairs = histogram.toPandas().sort_values("n_tokens")
    return [int(x) for x in pairs["n_tokens"]], [int(x) for x in pairs["n"]]


def pack(docs: DataFrame, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, max_lengths: int = MAX_LENGTHS,
         shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, bucket_id, bucket_len, batch_id, slot, batch_rows."""
    lengths = staged(docs.select(F.col(id_col).alias("doc_id"), word_count(text_col).alias("n_tokens")), "pack-lengths")
    values, counts = _histogram(lengths, max_lengths)
    bounds = optimal_boundaries(values, counts, n_buckets) or [0]
    totals = [0] * len(bounds)
    at = 0
    for value, count in zip(values, counts):
        while value > bounds[at]:
            at += 1
        totals[at] += count
    per_batch = [max(1, token_budget // max(1, b)) for b in bounds]
    shards = [max(1, -(-n // shard_rows)) for n in totals]

    bucketed = lengths.select("doc_id", "n_tokens", _bucket(F.col("n_tokens"), bounds).alias("bucket_id"))
    sharded = bucketed.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), _pick(shards, F.col("bucket_id"))))
    sizes = sharded.groupBy("bucket_id", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket_id").orderBy("shard")) - F.col("n")
    offsets = sizes.select("bucket_id", "shard", before.alias("offset"))
    inside = F.row_number().over(Window.partitionBy("bucket_id", "shard").orderBy("doc_id", "n_tokens")) - 1
    numbered = sharded.withColumn("inside", inside).join(offsets, ["bucket_id", "shard"])
    number, size = F.col("offset") + F.col("inside"), _pick(per_batch, F.col("bucket_id"))
    batch = F.floor(number / size)
    return numbered.select(
        "doc_id", "n_tokens", "bucket_id", _pick(bounds, F.col("bucket_id")).alias("bucket_len"),
        batch.alias("batch_id"), (number - batch * size).alias("slot"),
        F.least(size, _pick(totals, F.col("bucket_id")) - batch * size).alias("batch_rows"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


SQL = None
