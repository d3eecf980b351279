"""Filter interaction audit by the Hart-Mas-Colell potential.

Filters are the players of a game per part of the corpus: a coalition is worth
the documents that fail one of its filters. One partial aggregate counts the
documents of a part by the set of filters they fail (its mask); from these cells,
at most 2 ** n a part, come the worths of all coalitions, and the same for
documents of good quality and for toxic ones.

Potentials are computed by recursion over the coalitions: that of the empty one
is 0, and P(S) = (v(S) + sum of P(S without i) over i in S) / |S|, kept as exact
integers by scaling with n!. The Shapley value of a filter is the potential of the
grand coalition minus the one without it, so scaled it is the number of documents
the filter removes, summed over all orders. Differences of worths between a
coalition and the one with the next filter are the steps of an order.

Filter E (an equal text has a smaller id) needs no pairs: a text's smallest id is a
partial aggregate by SHA-256, and a row passes if it joins that id by (text, id),
so copies of one text are spread by id.

Defined cases: null texts are empty texts, null sources the part ''; a row without
id is after all others and passes E; rows that agree in id and text are copies of
each other by no smaller id, so both pass E, and both count; a document is of good
quality or toxic if any label of its id says so; an empty table gives no rows (a
part exists by its documents); other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagelane.llm.common import WORD, table, text_or_empty

FILTERS = "ABCDE"
MIN_WORDS = 200
SYMBOLS = "[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SALTS = 64


def text_failures(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, part, digest of the text, and whether it fails the filters of its own text (A to D)."""
    text = text_or_empty(text_col)
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"),
                        text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    n, capitals = F.size("words"), F.length("text") - F.length(F.translate("text", _CAPITALS, ""))
    return words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                        (n < MIN_WORDS).alias("A"), (100 * F.size(F.array_distinct("words")) < 50 * n).alias("B"),
                        (100 * capitals > 2 * F.length("text")).alias("C"), F.col("text").rlike(SYMBOLS).alias("D"))


def repeated_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest, ...) with E: an equal text of ``texts`` (doc_id, digest) has a smaller id."""
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").select(
        F.col("digest").alias("__digest"), F.col("doc_id").alias("__first"))
    joined = rows.join(first, (F.col("digest") == F.col("__digest")) & (F.col("doc_id") == F.col("__first")), "left")
    return joined.select(*rows.columns, (F.col("doc_id").isNotNull() & F.col("__first").isNull()).alias("E"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic: whether a label of the id says quality or toxic 1; rows without id are dealt by salt."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("__good"), F.max((F.col("toxic") == 1).cast("int")).alias("__toxic"))
    salt = F.when(F.col("doc_id").isNull(), F.spark_partition_id() % _SALTS).otherwise(0)
    joined = rows.withColumn("__salt", salt).join(marks.withColumn("__zero", F.lit(0)),
                                                  (F.col("doc_id") == F.col("__id")) & (F.col("__salt") == F.col("__zero")), "left")
    return joined.select(*rows.columns, F.coalesce(F.col("__good"), F.lit(0)).alias("good"), F.coalesce(F.col("__toxic"), F.lit(0)).alias("toxic"))


def failure_cells(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Documents, good ones and toxic ones by part and mask (bit i: filter i fails)."""
    mask = sum((F.col(name).cast("int") * (1 << i) for i, name in enumerate(filters)), F.lit(0))
    return rows.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("docs"), F.sum("good").cast("long").alias("good"),
                                                        F.sum("toxic").cast("long").alias("toxic"))


def coalition_worths(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part: number of documents, and arrays over all coalitions (index: its mask) of what the coalition removes."""
    def worths(column: str) -> Column:
        hit = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(column)).otherwise(0)) for s in range(1 << len(filters))]
        return F.array(*hit).alias(column)
    return cells.groupBy("part").agg(F.sum("docs").alias("total"), worths("docs"), worths("good"), worths("toxic"))


def potentials(worth: Column, players: int) -> Column:
    """Array of n! times the potential of every coalition; subsets of a coalition have smaller masks, so come before it."""
    def one(known: Column, s: Column) -> Column:
        without = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s - (1 << i))).otherwise(0) for i in range(players)]
        whole = F.get(worth, s) * F.lit(factorial(players)) + sum(without[1:], without[0])
        return F.concat(known, F.array(F.call_function("div", whole, F.bit_count(s))))
    coalitions = F.sequence(F.lit(1), F.lit((1 << players) - 1))
    return F.reduce(coalitions, F.array(F.lit(0).cast("long")), one)


def audit(worths: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step."""
    n, grand = len(filters), (1 << len(filters)) - 1
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(filters))), ",")
    steps = (worths.withColumn("potential", potentials(F.col("docs"), n))
             .select("*", F.explode(orders).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")))
    head, own = F.substring("filter_order", F.lit(1), F.col("step") - 1), F.substring("filter_order", F.col("step"), F.lit(1))
    before = sum((F.when(F.contains(head, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    player = sum((F.when(own == f, 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    steps = steps.select("*", before.alias("before"), player.alias("player")).withColumn("after", F.col("before") + F.col("player"))

    def gained(column: str) -> Column:
        return F.get(column, F.col("after")) - F.get(column, F.col("before"))

    def without(column: str) -> Column:
        return F.get(column, F.lit(grand)) - F.get(column, F.lit(grand) - F.col("player"))
    return steps.select("part", "filter_order", "step", (F.col("total") - F.get("docs", F.col("after"))).alias("kept"),
                        gained("docs").alias("removed"), (F.get("docs", F.col("player")) - gained("docs")).alias("redundant"),
                        without("docs").alias("unique_fails"), gained("good").alias("good_lost"), gained("toxic").alias("toxic_lost"),
                        without("potential").alias("shapley"))


def audited_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty("text"), 256)).alias("digest"))
    rows = with_labels(repeated_texts(text_failures(docs), texts), labels)
    return audit(coalition_worths(failure_cells(rows)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Walks every order step by step over the documents' failure strings: no coalitions, worths or potentials.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
             CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
             || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) THEN 'E' ELSE '' END AS fails
      FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
      WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS head
      FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
w AS (SELECT c.part, s.filter_order, s.step, s.own, c.n, c.good, c.toxic, c.fails,
             c.fails <> '' AND translate(c.fails, s.head, '') <> c.fails AS earlier, contains(c.fails, s.own) AS failing FROM c, s),
r AS (SELECT part, filter_order, step, own,
             sum(CASE WHEN NOT earlier AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN NOT earlier AND failing THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN earlier AND failing THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN NOT earlier AND failing THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN NOT earlier AND failing THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM w GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
