"""Language ID by hierarchical discrimination.

A first layer of linear support vector machines predicts the language family; a
second layer, one-versus-one inside the predicted family, separates its
languages. Features are hashed letter n-grams (1 to 3, with word edges) of the
whole text, square-rooted counts of unit length.

The score is the product of the layers' mean votes and of a nearness, which falls
from 1 to 0 with the text's cross-entropy against the language's n-grams. Per
language, the excess over the median that 99 of 100 training rows do not reach
(each half of them measured against the other half) is the unit, and nearness is
0 from ``REACH`` units (``LEAST_REACH`` nats at least) on. So text of no learned
language scores low. A language of fewer than ``LEAST_ROWS`` sampled rows cannot
be measured and has nearness 1.

Training takes every language there is, and of each the rows with letters of the
smallest hashes: at most ``SAMPLE_PER_LANG``, and ``SAMPLE_ROWS`` in all (one row
of each language if there are more languages). Models grow with the square of
the number of families. Rows are featurised in Spark
tasks; only the sample's features come to the driver. Prediction runs over every
whole text in tasks with the few weight vectors.

Defined cases: a null text or one without letters is ``und`` with score 0; so is
every text when there is no training row; a language without a known family is a
family of its own; rows with equal ids are predicted one by one; other columns
are not read, or kept in ``identified_documents``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pagelane.llm.common import staged, table

FEATURES = 4096
SAMPLE_PER_LANG = 800
SAMPLE_ROWS = 8_000
REACH = 4.0
LEAST_REACH = 1.0
LEAST_ROWS = 8
MIN_SCORE = 0.2
UNKNOWN = "und"
_CHUNK = 1 << 20
_SLICE = 256  # rows whose vectors are held at a time

# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower(), lang)


_letters = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of a text's letter n-grams; None without letters."""
    counts = np.zeros(FEATURES)
    text = text or ""
    for start in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[start:start + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        codes[~_is_letter()[codes]] = 0
        codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        if len(codes) < 3:
            continue
        one, two, three = codes[:-2] * np.uint32(2654435761), codes[1:-1] * np.uint32(2246822519), codes[2:] * np.uint32(3266489917)
        for mixed in (two, one ^ (two >> np.uint32(3)), one + two ^ (three >> np.uint32(5))):
            mixed = mixed ^ (mixed >> np.uint32(15))
            counts += np.bincount((mixed * np.uint32(2654435769)) >> np.uint32(20), minlength=FEATURES)
    norm = np.sqrt(counts.sum())
    return (np.sqrt(counts) / norm).astype(np.float32) if norm else None


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 120) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss; y is -1 or 1, classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1.0 / (4.0 + penalty)
    w = before = np.zeros(x.shape[1], np.float32)
    for i in range(rounds):  # accelerated gradient steps
        at = w + (i / (i + 3.0)) * (w - before)
        slack = np.maximum(0, 1 - y * (x @ at))
        gradient = penalty * at - 2 * (x.T @ (share * y * slack))
        before, w = w, (at - step * gradient).astype(np.float32)
    return w


class OneVersusOne:
    """Pairwise linear SVMs over some classes; the class with the largest sum of votes wins."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, classes: list[str]):
        self.classes, self.pairs, weights = classes, [], []
        for i, a in enumerate(classes):
            for j in range(i + 1, len(classes)):
                rows = (labels == a) | (labels == classes[j])
                weights.append(train_svm(x if rows.all() else x[rows], np.where(labels[rows] == a, 1, -1).astype(np.float32)))
                self.pairs.append((i, j))
        self.weights = np.array(weights, np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class number and confidence of each row."""
        if len(self.classes) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        votes = np.zeros((len(x), len(self.classes)))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        for k, (i, j) in enumerate(self.pairs):
            first = 1 / (1 + np.exp(-3 * np.clip(margins[:, k], -20, 20)))
            votes[:, i] += first
            votes[:, j] += 1 - first
        best = votes.argmax(1)
        return best, votes[np.arange(len(x)), best] / (len(self.classes) - 1)


class Nearness:
    """How near texts are to one language: 1 up to the usual cross-entropy, 0 far beyond that of its training rows."""

    def __init__(self, x: np.ndarray):
        self.reach = None
        if len(x) < LEAST_ROWS:
            return
        shares = np.square(x, dtype=np.float64)
        excess = []
        for held in (0, 1):
            entropy = shares[held::2] @ self._costs(shares[1 - held::2])
            excess.append(entropy - np.median(entropy))
        self.costs = self._costs(shares)
        self.usual = float(np.median(shares @ self.costs))
        self.reach = max(LEAST_REACH, REACH * float(np.quantile(np.concatenate(excess), 0.99)))

    @staticmethod
    def _costs(shares: np.ndarray) -> np.ndarray:
        counts = shares.sum(0) + 0.5 / FEATURES
        return -np.log(counts / counts.sum())

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.reach is None:
            return np.ones(len(x))
        return np.clip(1 - (np.square(x, dtype=np.float64) @ self.costs - self.usual) / self.reach, 0, 1)


class LanguageModel:
    """Families first, then the languages of the predicted family, and how near the text is to its language."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        families = np.array([family_of(lang) for lang in langs], object)
        names = sorted(set(families))
        self.family = OneVersusOne(x, families, names) if names else None
        self.inside = []
        for name in names:
            rows = families == name
            self.inside.append(OneVersusOne(x[rows], langs[rows], sorted(set(langs[rows]))))
        self.near = {lang: Nearness(x[langs == lang]) for lang in sorted(set(langs))}

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        out, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.family is None:
            return out, scores
        for start in range(0, len(texts), _SLICE):
            vectors = {i: v for i in range(start, min(start + _SLICE, len(texts))) if (v := features(texts[i])) is not None}
            if not vectors:
                continue
            rows, x = np.array(list(vectors)), np.stack(list(vectors.values()))
            vectors.clear()
            family, sure = self.family.predict(x)
            for f in set(family.tolist()):
                mine = np.flatnonzero(family == f)
                lang, surer = self.inside[f].predict(x[mine])
                for l in set(lang.tolist()):
                    name, those = self.inside[f].classes[l], lang == l
                    near = self.near[name].of(x[mine[those]])
                    for m, p, q in zip(mine[those], surer[those], near):
                        out[rows[m]] = name
                        scores[rows[m]] = float(min(1.0, sure[m] * p * q))
        return out, scores


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _slices(batches):
    """A few rows of the Arrow batches at a time: only their texts and vectors are Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE):
            yield batch.slice(start, _SLICE)


def _featurise(batches):
    for batch in _slices(batches):
        vectors = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([None if v is None else v.astype(np.float16).tobytes() for v in vectors], pa.binary())],
            names=["lang", "x"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          folds: int = 3, fold: int = 1) -> LanguageModel:
    """Model learned from a bounded sample of the rows that are not held out."""
    rows = docs.filter(~held_out(id_col, folds, fold) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("id", "text"))
    langs = staged(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least")), "language-counts")
    number = langs.count()
    if not number:
        return LanguageModel(np.empty((0, FEATURES), np.float32), np.empty(0, object))
    each = max(1, min(SAMPLE_PER_LANG, SAMPLE_ROWS // number))
    # Rows that can be among the smallest hashes: a few more than needed, and the smallest one in any case.
    share = F.least(F.lit(1.0), F.lit(each + 6.0 * each ** 0.5 + 20.0) / F.col("n"))
    few = rows.join(F.broadcast(langs), "lang").filter((F.col("hash") == F.col("least")) | (F.col("hash") / 2.0 ** 64 + 0.5 <= share))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    sample = few.select("lang", "text", first.alias("at")).filter(F.col("at") <= each).select("lang", "text").mapInArrow(
        _featurise, "lang string, x binary")
    found = sample.filter("x IS NOT NULL").toPandas().sort_values(["lang", "x"])
    if not len(found):
        return LanguageModel(np.empty((0, FEATURES), np.float32), np.empty(0, object))
    names, vectors = found["lang"].to_numpy(object), found["x"].tolist()
    del found  # the driver holds the sample once, and one vector more
    x = np.empty((len(vectors), FEATURES), np.float32)
    for i in range(len(vectors)):
        x[i], vectors[i] = np.frombuffer(vectors[i], np.float16), None
    return LanguageModel(x, names)


def _predict(model):
    def run(batches):
        for batch in _slices(batches):
            langs, scores = model.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: LanguageModel, folds: int = 3, fold: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", folds, fold).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(sent), "doc_id long, held_out boolean, lang_pred string, score double")


def _relabel(model, text_at: int, lang_at: int, min_score: float):
    def run(batches):
        for batch in _slices(batches):
            langs, scores = model.value.predict(batch.column(text_at).to_pylist())
            columns = list(batch.columns)
            columns[lang_at] = pa.array(langs, pa.string())
            keep = pa.array([lang != UNKNOWN and score >= min_score for lang, score in zip(langs, scores)])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(keep)
    return run


def identified_documents(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows and columns of ``docs`` whose language is recognised, ``lang`` being the predicted one.

    Texts without letters, and those whose best language scores under ``min_score``, go.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    docs = docs.withColumn("lang", F.col("lang").cast("string"))
    return docs.mapInArrow(_relabel(sent, docs.columns.index("text"), docs.columns.index("lang"), min_score), docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


SQL = None
