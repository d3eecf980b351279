"""Toxicity by a weighted finite-state pattern grammar.

Three transducers are composed, each in one pass over a clause:

* the lexical one turns a word into a symbol: insult (with a weight), threat,
  target, negation, reporting verb, or other;
* the scope one tracks where in the clause a target was named, whether a
  negation is open (it closes after ``NEGATION_SCOPE`` words) and whether what
  follows is reported speech;
* the output one emits for each insult or threat the pattern it stands in:
  plain, targeted, negated or reported.

A clause is scored by its patterns, not by isolated words: per pattern, the
heaviest and the summed weight of the document's matched clauses are features of
a logistic score.

Insults are learned: words and word beginnings whose share among toxic training
documents is far above that among the others, by a likelihood-ratio test. The
pattern weights are fitted on other training documents than the lexicon, so that
chance entries of the lexicon don't count. Both use a bounded sample of labelled
rows (``SAMPLE_ROWS``, chosen by hash); scoring covers every whole text.

Defined cases: null or empty text has the score of a text without any match;
without labelled training rows, every score is 0.5 minus a bit (predicted 0);
ids with several labels count as toxic if any label says so; labels without a
document and documents without a label are fine; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelane.llm.common import table, text_or_empty
from pagelane.llm.op7_language_id import held_out

SAMPLE_ROWS = 20_000
LEXICON_SIZE = 3_000
MIN_EVIDENCE = 25.0
NEGATION_SCOPE = 3
_FOLDS, _HELD = 5, 0
_FLUSH = 200_000
_TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_PREFIXES = (2, 3, 4, 5, 6)

# Closed word classes in English, French, German and Spanish.
THREATS = frozenset("kill hurt die destroy hang burn shoot beat stab tuer mourir frapper töten sterben schlagen matar morir golpear".split())
TARGETS = frozenset("you your yours yourself u he she they him her them tu toi te vous ton ta du dich dir ihr euch dein deine tú ti usted ustedes".split())
NEGATIONS = frozenset("not never no nor neither nicht kein keine nie ne pas jamais aucun nunca ni tampoco".split())
REPORTS = frozenset("said says wrote writes quoted quotes called claimed sagte schrieb zitierte dit écrit cite dijo escribió citó".split())

OTHER, BOUNDARY, TARGET, NEGATION, REPORT, THREAT, INSULT = range(7)
PATTERNS = ("plain", "targeted", "negated", "reported", "threat", "targeted threat")


class Lexicon(dict):
    """Lexical transducer: word to (symbol, weight); answers are kept for the words seen lately."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > 500_000:
            self.clear()
        best = max((self.weights.get(f, 0.0) for f in word_features(word)), default=0.0)
        if best:
            symbol = INSULT, best
        elif len(word) == 1 and not word.isalpha():
            symbol = BOUNDARY, 0.0
        else:
            symbol = next((s for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
                           if word in words), OTHER), 0.0
        self[word] = symbol
        return symbol


def word_features(word: str) -> list[str]:
    """The whole word, and its beginnings marked by a dash."""
    return [word, *(word[:k] + "-" for k in _PREFIXES if len(word) > k)]


def matched_patterns(symbols: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """Scope and output transducers over a document's symbols: (pattern, clause weight) of each matched clause."""
    found: list[tuple[int, float]] = []
    clause: dict[int, float] = {}
    targeted = reported = False
    negated = 0
    for symbol, weight in symbols:
        if symbol == BOUNDARY:
            found.extend(clause.items())
            clause, targeted, reported, negated = {}, False, False, 0
            continue
        if symbol == TARGET:
            targeted = True
        elif symbol == NEGATION:
            negated = NEGATION_SCOPE + 1
        elif symbol == REPORT:
            reported = True
        elif symbol == INSULT:
            pattern = 3 if reported else 2 if negated else 1 if targeted else 0
            clause[pattern] = clause.get(pattern, 0.0) + weight
        elif symbol == THREAT and not (reported or negated):
            pattern = 5 if targeted else 4
            clause[pattern] = clause.get(pattern, 0.0) + 1.0
        negated = max(0, negated - 1)
    found.extend(clause.items())
    return found


def clause_features(text: str, lexicon: Lexicon) -> np.ndarray | None:
    """Heaviest clause and damped sum per pattern; None without a match."""
    symbols = [lexicon[w] for w in _TOKENS.findall(text.lower())]
    if not any(s[0] >= THREAT for s in symbols):
        return None
    out = np.zeros(2 * len(PATTERNS))
    for pattern, weight in matched_patterns(symbols):
        out[pattern] = max(out[pattern], weight)
        out[len(PATTERNS) + pattern] += weight
    out[len(PATTERNS):] = np.log1p(out[len(PATTERNS):])
    return out


class ToxicityModel:
    """Lexicon and pattern weights; ``score`` is a probability."""

    def __init__(self, weights: dict[str, float]):
        self.lexicon = Lexicon(weights)
        self.coefficients, self.bias = np.zeros(2 * len(PATTERNS)), -1e-6

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> None:
        """Logistic regression by Newton steps."""
        if not len(y):
            return
        x1 = np.hstack([x, np.ones((len(x), 1))])
        w = np.zeros(x1.shape[1])
        ridge = np.full(x1.shape[1], penalty * len(y))
        ridge[-1] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            gradient = x1.T @ (p - y) + ridge * w
            hessian = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(ridge)
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.coefficients, self.bias = w[:-1], float(w[-1])

    def score(self, text: str) -> float:
        x = clause_features(text, self.lexicon)
        z = self.bias + (0.0 if x is None else float(x @ self.coefficients))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _count_features(batches):
    """Documents per word feature, toxic and not: partial sums, flushed when many."""
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update({f for w in set(_TOKENS.findall(text.lower())) for f in word_features(w)})
            if len(counts[True]) + len(counts[False]) > _FLUSH:
                yield _counted(counts)
                counts = {True: Counter(), False: Counter()}
    yield _counted(counts)


def _counted(counts) -> pa.RecordBatch:
    names = list(counts[True].keys() | counts[False].keys())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[True][n] for n in names], pa.int64()),
                                       pa.array([counts[False][n] for n in names], pa.int64())], names=["feature", "pos", "neg"])


def _lexicon(sample: DataFrame, n_pos: int, n_neg: int) -> dict[str, float]:
    """Weighted word features by likelihood ratio, the strongest ``LEXICON_SIZE`` of them."""
    counted = (sample.mapInArrow(_count_features, "feature string, pos long, neg long").groupBy("feature")
               .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos >= 3"))
    a, b, total = F.col("pos"), F.col("neg"), n_pos + n_neg
    expected_pos, expected_neg = (a + b) * n_pos / total, (a + b) * n_neg / total
    evidence = 2 * (a * F.log(a / expected_pos) + F.when(b > 0, b * F.log(b / expected_neg)).otherwise(0.0))
    odds = F.log((a + 0.5) / (n_pos + 1)) - F.log((b + 0.5) / (n_neg + 1))
    strong = counted.select("feature", evidence.alias("g"), odds.alias("odds")).filter((F.col("g") >= MIN_EVIDENCE) & (F.col("odds") > 2))
    return {r["feature"]: r["odds"] for r in strong.orderBy(F.desc("g"), "feature").limit(LEXICON_SIZE).collect()}


def _matches(lexicon):
    def run(batches):
        for batch in batches:
            found = [clause_features(t, lexicon.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if x is None else x.tolist() for x in found], pa.list_(pa.float64()))], names=["toxic", "x"])
    return run


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Model learned from a bounded sample of the labelled rows that are not held out."""
    known = labels.filter(~held_out("doc_id", _FOLDS, _HELD) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("id"), (F.col("toxic") == 1).alias("toxic"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    # The SAMPLE_ROWS smallest hashes: 16 bytes a row, so small enough to send to every task.
    sample = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).join(
        sample, F.col("doc_id") == F.col("id")).select("toxic", "text", F.pmod(F.xxhash64("id"), F.lit(4)).alias("part"))
    for_words, for_patterns = rows.filter("part != 0").select("toxic", "text"), rows.filter("part = 0").select("toxic", "text")
    sizes = {r["toxic"]: r["count"] for r in for_words.groupBy("toxic").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return ToxicityModel({})
    model = ToxicityModel(_lexicon(for_words, sizes[True], sizes[False]))
    sent = docs.sparkSession.sparkContext.broadcast(model.lexicon)
    found = for_patterns.mapInArrow(_matches(sent), "toxic boolean, x array<double>").toPandas()
    none = [0.0] * (2 * len(PATTERNS))
    x = np.array([none if v is None else list(v) for v in found["x"]], float).reshape(-1, len(none))
    model.fit(x, found["toxic"].to_numpy(float))
    return model


def _scores(model):
    def run(batches):
        for batch in batches:
            scores = [model.value.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                                              pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                                             names=["doc_id", "held_out", "score", "predicted"])
    return run


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", _FOLDS, _HELD).alias("held_out"),
                       text_or_empty("text").alias("text"))
    return rows.mapInArrow(_scores(sent), "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


SQL = None
