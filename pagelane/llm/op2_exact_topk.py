"""Exact top-k inner product search with M-trees, best first.

Inner products become distances: with an extra component ``sqrt(M - |v|^2)`` for
candidates (M: the largest squared norm) and 0 for queries, the squared distance
is ``|q|^2 + M - 2 * score``, so the highest scores are the nearest points.

* A bounded sample (``SAMPLE_ROWS`` rows with the smallest hashes) gives pivots,
  and to every query a first score that its k-th result must reach.
* Every vector falls to its nearest pivot; a pivot's vectors are dealt by hash to
  trees of about ``TREE_ROWS`` vectors, so equal vectors may be any share of all.
* A tree is one row of a Parquet table: nodes with a routing object, a covering
  radius and the distance to the parent object, and per entry the vector and its
  distance to the node's object.
* Query blocks (``BLOCK_ROWS`` rows) meet the trees of the pivots whose radius
  they can reach. In a tree, a queue gives the nodes by their smallest lower bound
  over the block. Stored distances rule out nodes, then entries, before anything
  is computed for a query; all bounds have a slack far above rounding errors.
  Scores are integers, so the results are exact.

Defined cases: rows whose id or vector is null, or whose vector holds a null or
non-finite component, take no part; shorter vectors count as padded with zeros;
each row of a repeated query id is a query; rows with the query's id are not its
candidates; equal scores go to the smaller id; an empty table gives no rows;
other columns are not read. Scores are exact integers at any size of the components
(whole parts beyond a long count as the nearest long); they decide the ranks (up to 38
digits), and one that a long cannot hold is given as the nearest long.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pagelane.llm.common import staged, table

SCALE = 64
K = 20
QUERY_STEP = 20
SAMPLE_ROWS = 2_048
MAX_PIVOTS = 64
TREE_ROWS = 8_192
LEAF_ROWS = 64
BLOCK_ROWS = 512
#: Squared norms below which products are exact as floats, and as longs (with room for the rounding of the norms).
EXACT_FLOATS, EXACT_LONGS = 2.0 ** 52, 2.0 ** 61
_LEAST, _MOST, _DIGITS = -2 ** 63, 2 ** 63 - 1, 10 ** 38 - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) and its squared norm, for the rows that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    return rows.select("*", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("norm"))


def _matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Integer inner products; by floating point where that is exact, by Python integers where a long is too small."""
    if limit < EXACT_FLOATS:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if limit < EXACT_LONGS else a.astype(object) @ b.astype(object).T


def _not_above(scores: np.ndarray) -> np.ndarray:
    """Floats no larger than the integers, which may have more digits."""
    out = scores.astype(np.float64)
    return np.where(np.abs(out) < EXACT_FLOATS, out, np.nextafter(out, -np.inf))


def _small(matrix: np.ndarray) -> tuple[str, bytes]:
    """The matrix in the smallest integer type that holds it."""
    kind = np.min_scalar_type(-int(np.abs(matrix).max(initial=1)) - 1)
    return kind.str, matrix.astype(kind).tobytes()


class Space:
    """What all tasks share: bounds, the sample and the pivots (bounded sizes)."""

    def __init__(self, dim: int, limit: float, sample_ids: np.ndarray, sample: np.ndarray, n_pivots: int):
        self.dim, self.limit, self.sample_ids, self.sample = dim, limit, sample_ids, sample
        self.slack = 1e-5 * np.sqrt(float(limit)) + 1e-9
        chosen, far = [0], None
        while len(chosen) < min(n_pivots, len(sample)):  # each next pivot is the farthest from those before
            d = self.between(sample, sample[chosen[-1:]])[:, 0]
            far = d if far is None else np.minimum(far, d)
            if far.max() <= self.slack:
                break
            chosen.append(int(far.argmax()))
        self.pivots = sample[chosen]

    def extra(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, float(self.limit) - (v.astype(np.float64) ** 2).sum(1)))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of candidates; all lie on a sphere of squared radius ``limit``."""
        inner = a.astype(np.float64) @ b.astype(np.float64).T + np.outer(self.extra(a), self.extra(b))
        return np.sqrt(np.maximum(0.0, 2.0 * self.limit - 2.0 * inner))

    def to_queries(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Distances of queries (rows) from candidates (columns)."""
        norms = (q.astype(np.float64) ** 2).sum(1)[:, None]
        return np.sqrt(np.maximum(0.0, norms + float(self.limit) - 2.0 * (q.astype(np.float64) @ v.astype(np.float64).T)))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which a score lies; infinite where there is none yet."""
        norms = (q.astype(np.float64) ** 2).sum(1)
        with np.errstate(invalid="ignore"):
            return np.where(np.isinf(score), np.inf, np.sqrt(np.maximum(0.0, norms + float(self.limit) - 2.0 * score)) + self.slack)


class Tree:
    """An M-tree: root object, nodes, and entries sorted by distance to their node's object."""

    def __init__(self, space: Space, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((*vectors.T[:4], ids))
        ids, vectors = ids[order], vectors[order]
        n = len(ids)
        objects = vectors[np.unique(np.linspace(0, n - 1, max(1, n // LEAF_ROWS)).astype(int))]
        away = space.between(vectors, objects)
        nearest = away.argmin(1)
        rows, starts, self.radius, self.parent, chosen, entry = [], [0], [], [], [], []
        to_root = space.between(objects, objects[:1])[:, 0]
        for node in range(len(objects)):
            mine = np.flatnonzero(nearest == node)
            mine = mine[np.argsort(away[mine, node], kind="stable")]
            for page in range(0, len(mine), 2 * LEAF_ROWS):  # a full node is several pages
                part = mine[page:page + 2 * LEAF_ROWS]
                rows.append(part)
                starts.append(starts[-1] + len(part))
                entry.append(away[part, node])
                self.radius.append(float(entry[-1].max()))
                self.parent.append(float(to_root[node]))
                chosen.append(node)
        rows = np.concatenate(rows)
        self.ids, self.vectors, self.entry = ids[rows], vectors[rows], np.concatenate(entry)
        self.starts, self.objects, self.root = np.array(starts), objects[chosen], objects[:1]
        self.radius, self.parent = np.array(self.radius), np.array(self.parent)

    FIELDS = ("ids", "starts", "radius", "parent", "entry")

    def row(self, tree: int, pivot: int, reach: float) -> tuple:
        kind, vectors = _small(self.vectors)
        return (tree, pivot, reach, *(getattr(self, f).tobytes() for f in self.FIELDS), kind, vectors,
                self.objects.astype(np.int64).tobytes(), self.root.astype(np.int64).tobytes())

    @classmethod
    def of(cls, dim: int, values: list) -> "Tree":
        tree = cls.__new__(cls)
        for field, data, kind in zip(cls.FIELDS, values, (np.int64, np.int64, np.float64, np.float64, np.float64)):
            setattr(tree, field, np.frombuffer(data, kind))
        kind, vectors, objects, root = values[len(cls.FIELDS):]
        tree.vectors = np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.int64)
        tree.objects, tree.root = (np.frombuffer(x, np.int64).reshape(-1, dim) for x in (objects, root))
        return tree


_TREE_DDL = ("tree long, pivot int, reach double, ids binary, starts binary, radius binary, parent binary, entry binary, "
             "kind string, vectors binary, objects binary, root binary")


def search(space: Space, tree: Tree, query_ids: np.ndarray, queries: np.ndarray, first: np.ndarray, k: int) -> list[tuple]:
    """(query number, id, score) of the k best entries of the tree per query, of those that reach its first score."""
    n = len(queries)
    kind = np.int64 if space.limit < EXACT_LONGS else object
    best = [(np.empty(0, kind), np.empty(0, np.int64))] * n  # scores, ids
    kth = first.copy()
    reach = space.reach(queries, kth)
    from_root = space.to_queries(queries, tree.root)
    bound = np.abs(from_root - tree.parent) - tree.radius  # by stored distances only
    heap = [(float(b), j) for j, b in enumerate(bound.min(0))]
    heapq.heapify(heap)
    while heap:
        _, node = heapq.heappop(heap)
        active = np.flatnonzero(bound[:, node] <= reach)
        if not len(active):
            continue
        away = space.to_queries(queries[active], tree.objects[node:node + 1])[:, 0]
        near = away - tree.radius[node] <= reach[active]
        active, away = active[near], away[near]
        if not len(active):
            continue
        entries = slice(tree.starts[node], tree.starts[node + 1])
        possible = np.abs(away[:, None] - tree.entry[entries]) <= reach[active][:, None]
        wanted = np.flatnonzero(possible.any(0))
        if not len(wanted):
            continue
        ids = tree.ids[entries][wanted]
        scores = _products(queries[active], tree.vectors[entries][wanted], space.limit)
        hits = (scores >= kth[active][:, None]) & (ids != query_ids[active][:, None])
        for i in np.flatnonzero(hits.any(1)):
            q = active[i]
            all_scores = np.concatenate([best[q][0], scores[i, hits[i]]])
            all_ids = np.concatenate([best[q][1], ids[hits[i]]])
            top = _best(all_scores, all_ids, k)
            best[q] = all_scores[top], all_ids[top]
            if len(top) == k:
                kth[q] = max(kth[q], float(_not_above(best[q][0][-1:])[0]))
        reach[active] = space.reach(queries[active], kth[active])
    return [(q, int(i), int(s)) for q, (scores, ids) in enumerate(best) for s, i in zip(scores, ids)]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype != object:
        return np.lexsort((ids, -scores))[:k]
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def _assign(space):
    def run(batches):
        at = space.value
        for batch in batches:
            v = _matrix(batch.column(1).to_pylist(), at.dim)
            away = at.between(v, at.pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away.argmin(1), pa.int32()),
                                              pa.array(away.min(1) if len(v) else [], pa.float64())], names=["vec_id", "v", "pivot", "away"])
    return run


def _build(space):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(space.value, rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"], space.value.dim))
        columns = [c.split()[0] for c in _TREE_DDL.split(", ")]
        return pd.DataFrame([tree.row(int(rows["tree"].iloc[0]), int(rows["pivot"].iloc[0]), float(rows["away"].max()))], columns=columns)
    return run


def _block(space, reaches: dict[int, float], trees: dict[int, int], k: int):
    """A query block: ids, vectors, first scores, and the trees of all pivots that any of its queries may reach."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = space.value
        ids, q = rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"], at.dim)
        scores = _not_above(_products(q, at.sample, at.limit))
        scores[ids[:, None] == at.sample_ids] = -np.inf
        first = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
        reach = at.reach(q, first)
        away = at.to_queries(q, at.pivots)
        wanted = [p * 2**32 + t for p, radius in reaches.items() if (away[:, p] - radius <= reach + at.slack).any() for t in range(trees[p])]
        return pd.DataFrame([(int(rows["block"].iloc[0]), ids.tobytes(), *_small(q), first.tobytes(), wanted)],
                            columns=["block", "q_ids", "q_kind", "q", "first", "wanted"])
    return run


def _search(space, k: int):
    def run(batches):
        at = space.value
        for batch in batches:
            names = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                value = {name: column[i].as_py() for name, column in names.items()}
                query_ids = np.frombuffer(value["q_ids"], np.int64)
                tree = Tree.of(at.dim, [value[f] for f in (*Tree.FIELDS, "kind", "vectors", "objects", "root")])
                queries = np.frombuffer(value["q"], value["q_kind"]).reshape(-1, at.dim).astype(np.int64)
                found = search(at, tree, query_ids, queries, np.frombuffer(value["first"], np.float64), k)
                if found:
                    number, ids, scores = zip(*found)
                    number = np.array(number, np.int64)
                    scores = pa.array(scores, pa.int64()) if at.limit < EXACT_LONGS else pa.array([Decimal(max(-_DIGITS, min(_DIGITS, x))) for x in scores], pa.decimal128(38, 0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number + (np.int64(value["block"]) << 20)), pa.array(query_ids[number]), pa.array(ids, pa.int64()), scores],
                        names=["query", "query_id", "vec_id", "score"])
    return run


def _sample(rows: DataFrame) -> DataFrame:
    """The ``SAMPLE_ROWS`` rows with the smallest hashes, in their order.

    Tasks send hashes only, of which the last one cuts off; taken with their vectors, each task's first rows would go to the driver.
    """
    hashed = rows.select(F.xxhash64("vec_id", "v").alias("hash"), "vec_id", "v")
    last = hashed.select("hash").orderBy("hash").limit(SAMPLE_ROWS).agg(F.max("hash")).first()[0]
    taken = staged(hashed.filter(F.col("hash") <= last).orderBy("hash", "vec_id").limit(SAMPLE_ROWS), "topk-sample")
    return taken.orderBy("hash", "vec_id").select("vec_id", "v")


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``query_step``."""
    spark = vectors.sparkSession
    rows = staged(quantised(vectors, id_col, vector_col, scale), "topk-vectors")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("limit"), F.max(F.size("v")).alias("dim"),
                     F.count(F.when(F.col("vec_id") % query_step == 0, 1)).alias("queries")).first()
    if not stats["n"] or not stats["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, stats["dim"])
    sample = _sample(rows).toPandas()
    space = spark.sparkContext.broadcast(Space(dim, max(1.0, stats["limit"] * (1 + 1e-9)), sample["vec_id"].to_numpy(np.int64), _matrix(sample["v"], dim),
                                               min(MAX_PIVOTS, -(-stats["n"] // TREE_ROWS))))

    assigned = staged(rows.select("vec_id", "v").mapInArrow(_assign(space), "vec_id long, v array<long>, pivot int, away double"), "topk-assigned")
    pivots = {r["pivot"]: r for r in assigned.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()}
    trees = {p: -(-r["n"] // TREE_ROWS) for p, r in pivots.items()}
    share = F.element_at(F.create_map(*[F.lit(x) for pair in trees.items() for x in pair]), F.col("pivot"))
    dealt = assigned.withColumn("tree", F.col("pivot").cast("long") * 2**32 + F.pmod(F.xxhash64("vec_id", "v"), share))
    index = staged(dealt.groupBy("tree").applyInPandas(_build(space), _TREE_DDL), "topk-trees")

    n_blocks = -(-stats["queries"] // BLOCK_ROWS)
    queries = rows.filter(F.col("vec_id") % query_step == 0).select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).alias("block"))
    reaches = {p: r["away"] for p, r in pivots.items()}
    blocks = staged(queries.groupBy("block").applyInPandas(_block(space, reaches, trees, k), "block long, q_ids binary, q_kind string, q binary, first binary, wanted array<long>"),
                    "topk-blocks")
    # Both sides are shuffled: the planner takes a block for as small as its file, though there is one for each tree.
    pairs = blocks.select("block", "q_ids", "q_kind", "q", "first", F.explode("wanted").alias("tree")).join(index.hint("merge"), "tree")
    long = space.value.limit < EXACT_LONGS
    found = pairs.mapInArrow(_search(space, k), f"query long, query_id long, vec_id long, score {'long' if long else 'decimal(38,0)'}")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    score = F.col("score") if long else F.greatest(F.least("score", F.lit(Decimal(_MOST))), F.lit(Decimal(_LEAST))).cast("long")
    return found.select("*", rank.alias("rank")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
