"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a fixed 60-bit hash of its id. A source's budget is met by
taking all documents whose hash is below a threshold, so no document is sorted:

1. words are summed by source and the 12 leading hash bits;
2. the first bucket whose running sum passes the budget is the boundary; only
   its documents are summed again, by the next 12 bits;
3. only the documents of that boundary bucket (about one in 16 million of a
   source) are looked at one by one, and the cut nearest to the budget wins.

Thresholds are nested: a larger budget takes a superset. A budget above the
source's size takes whole copies first, and the threshold decides on one more.

Defined cases: a null or empty text has size 0 and is never counted; null is a
source of its own, ordered last; rows with equal (or null) ids have equal
hashes and are taken together; an empty table gives an empty mix; columns other
than the id, the text and the source are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pagelane.llm.common import id_hash60, staged, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
_BITS = 12


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Id, source, size in words and hash of every document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       word_count(text_col).alias("size"), id_hash60(id_col).alias("h"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: its size and the words the mix should take of it.

    Weights repeat over the sources in code point order, null last. With caps,
    the target is ``min(cap, level * weight)``; the level follows from the
    running sums of the sources by the level at which each meets its cap, so no
    iteration is needed. The windows hold one row per source, never documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position + 1).cast("int"))
    ranked = per_source.select("source", "source_size", weight.alias("w"), F.row_number().over(order).alias("rk"))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double") * F.lit(float(share))
    cap = F.col("source_size") * F.lit(float(max_copies))
    ranked = ranked.select("*", total.alias("budget"), cap.alias("cap"), (cap / F.col("w")).alias("meets"))
    by_level = Window.orderBy("meets", "rk")
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("budget") - before) / rest
    leveled = ranked.select("*", level.alias("level")).withColumn("capped", F.col("meets") <= F.col("level"))
    water = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    return leveled.select("source", "source_size",
                          F.when(F.col("capped"), F.col("cap")).otherwise(water * F.col("w")).alias("target"))


def _boundary(frontier: DataFrame, budgets: DataFrame, shift: int) -> DataFrame:
    """First bucket of each source whose running sum passes the budget."""
    histogram = (frontier.groupBy("source", F.shiftright("h", shift).alias("bucket"))
                 .agg(F.sum("size").alias("words")))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    summed = (histogram.select("source", "bucket", "words", running.alias("run"))
              .join(budgets.withColumnRenamed("source", "b_source"), F.col("source").eqNullSafe(F.col("b_source")))
              .select("source", "bucket", (F.col("below") + F.col("run") - F.col("words")).alias("start"),
                      (F.col("below") + F.col("run")).alias("end"), "rest"))
    return (summed.filter((F.col("end") > F.col("rest")) & (F.col("start") <= F.col("rest")) & (F.col("end") > F.col("start")))
            .select("source", "bucket", F.col("start").alias("below"), "rest"))


def _inside(frontier: DataFrame, boundary: DataFrame, shift: int) -> DataFrame:
    edge = boundary.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"))
    return frontier.join(edge, F.col("source").eqNullSafe(F.col("b_source"))
                         & (F.shiftright("h", shift) == F.col("b_bucket"))).select("source", "size", "h")


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole copies, and the hash below which one more is taken.

    ``sizes`` should be a written table; it is read once per refinement step.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.select("source", "source_size", "target", whole.cast("long").alias("copies"))
    budgets = targets.select("source", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"),
                             F.lit(0).cast("long").alias("below")).filter(F.col("rest") > 0)
    frontier = sizes.filter("size > 0").select("source", "size", "h")
    first = staged(_boundary(frontier, budgets, 60 - _BITS), "mix-boundary")
    frontier = staged(_inside(frontier, first, 60 - _BITS), "mix-frontier")
    second = _boundary(frontier, first.select("source", "below", "rest"), 60 - 2 * _BITS)
    second = staged(second, "mix-boundary")
    last = _boundary(_inside(frontier, second, 60 - 2 * _BITS), second.select("source", "below", "rest"), 0)
    return _cut(staged(last, "mix-cut"), frontier, targets)


def _cut(last: DataFrame, frontier: DataFrame, targets: DataFrame) -> DataFrame:
    """Put the boundary document on the side that is nearer to the budget."""
    words = (frontier.groupBy(F.col("source").alias("w_source"), F.col("h").alias("w_h"))
             .agg(F.sum("size").alias("words")))
    nearer = (F.col("below") + F.col("words") - F.col("rest")) < (F.col("rest") - F.col("below"))
    cuts = (last.join(words, F.col("source").eqNullSafe(F.col("w_source")) & (F.col("bucket") == F.col("w_h")))
            .select(F.col("source").alias("c_source"),
                    F.when(nearer, F.col("bucket") + 1).otherwise(F.col("bucket")).alias("threshold")))
    return (targets.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left")
            .select("source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(0)).alias("threshold")))


def _copies(h: Column) -> Column:
    return F.col("copies") + F.when(h < F.col("threshold"), F.lit(1)).otherwise(F.lit(0))


def _plan(sizes: DataFrame, weights, share, max_copies) -> DataFrame:
    targets = staged(source_targets(sizes, weights, share, max_copies), "mix-targets")
    found = staged(thresholds(sizes, targets), "mix-thresholds")
    return found.withColumnRenamed("source", "t_source")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """Per document: size, source_size, target and taken (words the mix takes, repeats counted)."""
    sizes = staged(sized(docs), "mix-sizes")
    plan = _plan(sizes, weights, share, max_copies)
    return (sizes.join(plan, F.col("source").eqNullSafe(F.col("t_source")), "left")
            .select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("h"))).alias("taken")))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """The mix itself: the rows and columns of ``docs``, each as often as it is taken.

    Texts are not shuffled: the thresholds (a row per source) come to the documents.
    """
    plan = _plan(staged(sized(docs), "mix-sizes"), weights, share, max_copies)
    plan = plan.select("t_source", "copies", "threshold").select(
        F.col("t_source").alias("__t_source"), F.struct("copies", "threshold").alias("__cut"))
    times = F.col("__cut.copies") + F.when(id_hash60("doc_id") < F.col("__cut.threshold"), F.lit(1)).otherwise(F.lit(0))
    joined = docs.join(plan, docs["source"].cast("string").eqNullSafe(F.col("__t_source")), "left")
    repeated = F.array_repeat(F.lit(True), times.cast("int"))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(repeated).alias("__copy")).drop("__copy")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w,
             (sum(source_size) OVER ())::DOUBLE * 1.5e0 AS budget FROM r),
m AS (SELECT *, source_size * 2e0 AS cap, source_size * 2e0 / w AS meets FROM w),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY meets, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
             / sum(w) OVER (ORDER BY meets, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM m),
g AS (SELECT source, source_size,
             CASE WHEN meets <= level THEN cap
                  ELSE w * max(CASE WHEN meets > level THEN level END) OVER () END AS target FROM l),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM g),
x AS (SELECT d.*, t.source_size, t.target, t.copies, t.target - t.copies * t.source_size AS rest
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, h, any_value(rest) AS rest, sum(size) AS words FROM x WHERE size > 0 GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS run FROM k),
cut AS (SELECT source, CASE WHEN run - rest < rest - (run - words) THEN h + 1 ELSE h END AS threshold
        FROM c WHERE rest > 0 AND run > rest AND run - words <= rest)
SELECT x.doc_id, x.size, x.source_size, x.target,
       (x.size * (x.copies + CASE WHEN x.h < coalesce(cut.threshold, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x LEFT JOIN cut ON x.source IS NOT DISTINCT FROM cut.source
"""
