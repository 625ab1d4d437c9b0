"""Toxicity scores from a classifier that identity terms must not sway."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.frames import table, without
from pairwright.plans.storage import Scratch

#: Labelled rows that the classifier learns from, at most: the only sample here.
SAMPLE = 6000
#: And as many of them, in the same order, as have so many features together, swapped twins included: what one task fits in about half a GB.
SAMPLE_FEATURES = 8_000_000
THRESHOLD = 0.3
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
#: Features that fewer sampled rows have are left at zero.
LEAST_ROWS = 4
ROUNDS = 300
#: Weights of the absolute weights, the squared weights and the swapped scores' changes in what :func:`fit` makes small.
SPARSE, SHRINK, FAIR = 5e-4, 2e-6, 1.0
#: A worker forgets its words beyond so many.
MEMO = 1 << 16

#: Terms that name groups of people, by kind and language. Those of one list stand for each other in a swap.
IDENTITY = [
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "black white asian latino arab african european american".split(),
    "muslim christian jewish hindu buddhist atheist catholic".split(),
    "muslims christians jews hindus buddhists atheists catholics".split(),
    "gay lesbian straight bisexual transgender queer".split(),
    "immigrants refugees foreigners citizens natives".split(),
    "disabled blind deaf autistic elderly young".split(),
    "frauen männer mädchen jungen".split(),
    "muslime christen juden hindus buddhisten".split(),
    "ausländer deutsche türken araber afrikaner".split(),
    "femmes hommes filles garçons".split(),
    "musulmans chrétiens juifs hindous bouddhistes".split(),
    "étrangers français arabes africains".split(),
    "mujeres hombres niñas niños".split(),
    "musulmanes cristianos judíos hindúes budistas".split(),
    "extranjeros españoles árabes africanos".split(),
]
_GROUP = {w: (g, i) for g, terms in enumerate(IDENTITY) for i, w in enumerate(terms)}
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


class Features(dict):
    """Word to the buckets of its features: the word, and its beginnings, which inflected words share."""

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= MEMO:
            self.clear()
        names = [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
        got = np.array([zlib.crc32(x.encode()) % BUCKETS for x in names], np.int32)
        if len(word) <= 64:
            self[word] = got
        return got


_FEATURES = Features()


class Relevant(dict):
    """Word to those of its buckets that a model weighs; for most words none."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        names = [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
        got = tuple(i for i in (zlib.crc32(x.encode()) % BUCKETS for x in names) if i in self.weights)
        if len(word) <= 64:
            self[word] = got
        return got

    def score(self, words: Counter) -> float:
        counts: dict[int, int] = {}
        for word, n in words.items():
            for i in self[word]:
                counts[i] = counts.get(i, 0) + n
        return sum(self.weights[i] * math.log1p(n) for i, n in sorted(counts.items()))


def vector(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: the logarithm of how often a feature occurs."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    parts = [_FEATURES[w] for w in words]
    flat = np.concatenate(parts)
    counts = np.repeat(np.fromiter(words.values(), np.float64, len(words)), [len(p) for p in parts])
    ids, at = np.unique(flat, return_inverse=True)
    return ids, np.log1p(np.bincount(at, counts)).astype(np.float32)


def swaps(words: Counter) -> list[Counter]:
    """The same words with every identity term replaced by another of its kind: by the next one, and by the one half the list on."""
    mine = [w for w in words if w in _GROUP]
    out = []
    for half in (False, True) if mine else ():
        other = Counter({w: n for w, n in words.items() if w not in _GROUP})
        for w in mine:
            group, at = _GROUP[w]
            terms = IDENTITY[group]
            other[terms[(at + (max(1, len(terms) // 2) if half else 1)) % len(terms)]] += words[w]
        out.append(other)
    return out


@dataclass
class Rows:
    """Sparse rows: bucket and value of each entry, and how many entries each row has."""

    ids: np.ndarray
    values: np.ndarray
    sizes: np.ndarray

    @property
    def n(self) -> int:
        return len(self.sizes)

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        ids = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int32)
        values = np.concatenate([v for _, v in parts]) if parts else np.zeros(0, np.float32)
        return Rows(ids, values, np.array([len(i) for i, _ in parts], np.int64))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """By row, of a value for each entry."""
        out, some = np.zeros(self.n, x.dtype), self.sizes > 0
        if some.any():
            out[some] = np.add.reduceat(x, (np.cumsum(self.sizes) - self.sizes)[some])
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.sums(w[self.ids] * self.values)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.ids, np.repeat(r, self.sizes) * self.values, width)


def fit(x: Rows, y: np.ndarray, pairs: Rows, fair: float = FAIR, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by accelerated proximal steps: buckets and weights that are not zero, and the bias.

    The rows are changed: what is too rare to count is dropped from them. Besides the log loss it pays for absolute weights (few features stay), and ``fair`` times the
    mean squared change of the score (before the logistic function) over ``pairs``, the differences
    between a row and its swapped twin.
    """
    n = max(1, x.n)
    often = np.bincount(x.ids, minlength=BUCKETS) >= LEAST_ROWS
    used = np.flatnonzero(often)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))

    def keep(rows: Rows) -> None:  # in place: the entries of rare features are not needed again
        own = often[rows.ids]
        rows.ids, rows.values, rows.sizes = place[rows.ids[own]], rows.values[own], rows.sums(own.astype(np.int64))

    width = len(used)
    keep(x)
    keep(pairs)
    positive = float(y.mean()) if len(y) else 0.0
    bias = float(np.log((positive + 1e-3) / (1 - positive + 1e-3)))
    if not width:
        return used, np.zeros(0), bias
    share = fair / pairs.n if pairs.n else 0.0
    probe = np.random.default_rng(0).standard_normal(width)
    size = 1.0
    for _ in range(12):  # the largest curvature, by power iteration
        probe = x.back(x.times(probe), width) / (4 * n) + (2 * share * pairs.back(pairs.times(probe), width) if share else 0)
        size = np.linalg.norm(probe) or 1.0
        probe /= size
    step = 0.9 / (size + SHRINK + 0.25)
    w, b = np.zeros(width), bias
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(ahead) + ahead_b, -40, 40)))
        slope = x.back(p - y, width) / n + SHRINK * ahead
        if share:
            slope += 2 * share * pairs.back(pairs.times(ahead), width)
        new = ahead - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * SPARSE, 0)
        new_b = ahead_b - step * float((p - y).mean())
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_b = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    own = np.flatnonzero(w)
    return used[own], w[own], b


def _featurise(batches):
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            words = words_of(x["text"])
            ids, values = vector(words)
            twins = []
            for other in swaps(words):
                both, signed = vector(other), {}
                for i, v in zip(ids.tolist(), values.tolist()):
                    signed[i] = signed.get(i, 0.0) + v
                for i, v in zip(both[0].tolist(), both[1].tolist()):
                    signed[i] = signed.get(i, 0.0) - v
                signed = {i: v for i, v in signed.items() if v}
                twins.append({"ids": list(signed), "vals": list(signed.values())})
            rows.append({"doc": x["doc"], "toxic": x["toxic"], "ids": ids, "vals": values, "twins": twins})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc", pa.string()), ("toxic", pa.int32()), ("ids", pa.list_(pa.int32())), ("vals", pa.list_(pa.float32())), ("twins", pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("vals", pa.list_(pa.float32()))])))]))


def _arrow_rows(ids, values) -> Rows:
    ids, values = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, values))
    return Rows(ids.flatten().to_numpy(), values.flatten().to_numpy(), ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))


def _fit_rows(fair: float):
    def run(batches):
        batches = list(batches)
        rows = pa.Table.from_batches(batches).sort_by("doc") if batches else None
        if rows is None or not rows.num_rows:
            return
        y, twins = rows["toxic"].to_numpy().astype(float), rows["twins"].combine_chunks().flatten()
        x, pairs = _arrow_rows(rows["ids"], rows["vals"]), _arrow_rows(twins.field("ids"), twins.field("vals"))
        del rows, twins, batches
        used, w, b = fit(x, y, pairs, fair)
        yield pa.RecordBatch.from_arrays([pa.array([used.tolist()]), pa.array([w.tolist()]), pa.array([b])], ["ids", "weights", "bias"])

    return run


@dataclass
class Model:
    ids: np.ndarray
    weights: np.ndarray
    bias: float
    taught: bool = True  # by a labelled row at least

    def relevant(self) -> Relevant:
        return Relevant(dict(zip(self.ids.tolist(), self.weights.tolist())))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fair: float = FAIR, features: int = SAMPLE_FEATURES) -> Model:
    """Learn from the labelled rows that are not held out: of them the ``sample`` with the smallest hash of the id, and of these,
    in that order, as many as have at most ``features`` features (one at least).

    Rows with a null label or id teach nothing; a doc that is labelled more than once is toxic if any
    label says so; of rows that repeat an id one counts, that with the smallest text. Null and empty texts are rows without
    features. One task fits the model; its data has the two documented bounds, so long texts mean fewer rows and never cut
    ones. Without any labelled row, and so with an empty table of documents or labels, every score is one half.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen = scratch.write(chosen, "chosen")
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = met.select(F.col("doc_id").cast("string").alias("doc"), "toxic", "text").mapInArrow(_featurise, "doc string, toxic int, ids array<int>, vals array<float>, twins array<struct<ids:array<int>,vals:array<float>>>")
    rows = stored = scratch.write(rows, "rows")
    size = F.size("ids") + F.aggregate("twins", F.lit(0), lambda n, t: n + F.size(t.ids))
    held, last = 0, None  # of at most ``sample`` rows
    for x in rows.select("doc", F.md5("doc").alias("h"), size.alias("n")).orderBy("h", "doc").collect():
        held += x.n
        if held > features and last is not None:
            rows = rows.filter(F.struct(F.md5("doc").alias("h"), "doc") <= F.struct(F.lit(last.h).alias("h"), F.lit(last.doc).alias("doc")))
            break
        last = x
    got = rows.coalesce(1).mapInArrow(_fit_rows(fair), "ids array<long>, weights array<double>, bias double").first()
    scratch.drop(chosen, stored)
    if got is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, taught=False)
    return Model(np.array(got.ids, np.int64), np.array(got.weights), got.bias)


def toxic_score(text: Column, model: Model, spark: SparkSession) -> Column:
    """Probability of label 1; the model's size is bounded by the number of buckets."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, bias = shared.value.relevant(), shared.value.bias
        for texts in parts:
            raw = np.array([bias + known.score(words_of(t)) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -700, 700))))

    return of(text)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score, predicted``, which replace columns of those names; all others stay. Null and empty texts get the
    prior's score. A score at the threshold is predicted toxic.

    A narrow pass over whole texts, without a shuffle: the work is linear in a text, whose distinct words are held. Repeated rows get
    equal scores, ids are not read, and an empty table gives an empty result.
    """
    out = without(docs, "score", "predicted")
    scored = out.withColumn("score", toxic_score(F.col(text_col), model, docs.sparkSession))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
