"""Quality classifier by attention-based multiple-instance learning: a text is a bag of passages, its label belongs to the bag."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, bounded, mix, steps, words, written

PASSAGE, BINS, DENSE = 64, 32, 13
FEATURES = DENSE + BINS
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Byte classes: 0 other, 1 upper case, 2 lower case, 3 digit, 4 sentence mark, 5 other ASCII sign, 6 line end, 7 beyond ASCII."""
    c = np.zeros(256, np.uint8)
    c[33:127] = 5
    c[65:91], c[97:123], c[48:58] = 1, 2, 3
    c[[ord(x) for x in ".,;:?'\"-()"]] = 4
    c[10], c[128:] = 6, 7
    return c


_CLASS = _classes()


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (64 words each, the last one shorter) of all rows, and each row's first passage (one entry more).

    A row without words has one passage that only says so.
    """
    h, starts, rows = words(data, at)
    count = np.diff(rows)
    bags = np.maximum(1, -(-count // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    x = np.zeros((first[-1], FEATURES), np.float32)
    empty = count == 0
    x[first[:-1][empty], DENSE - 1] = 1
    if not len(h):
        return x, first
    row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(h)) - rows[row]
    own = first[row] + inside // PASSAGE
    heads = np.flatnonzero(inside % PASSAGE == 0)
    who = own[heads]
    n = np.bincount(own, minlength=len(x))[who].astype(np.float32)
    begin = starts[heads]
    kind = _CLASS[data]
    size = np.add.reduceat(~SPACE[data], begin, dtype=np.int64).astype(np.float32)
    for k in range(1, 8):
        x[who, k - 1] = np.add.reduceat(kind == k, begin, dtype=np.int64) / size
    x[who, 7] = size / n / 8
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    x[who, 8] = np.add.reduceat(again, heads, dtype=np.int64) / n
    _, once = np.unique(h ^ mix(own.astype(np.uint64)), return_index=True)
    x[who, 9] = np.bincount(own[once], minlength=len(x))[who] / n
    x[who, 10] = n / PASSAGE
    x[who, 11] = np.log1p(bags[row[heads]]) / 4
    bins = np.bincount(own * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), minlength=len(x) * BINS).reshape(-1, BINS)
    x[who, DENSE:] = np.sqrt(bins[who] / n[:, None])
    return x, first


@dataclass(frozen=True)
class Settings:
    """sample: labelled documents that are learnt from at most; passages: passages that these may have in all. Documents are taken in the order
    of a hash of their ids, each with all its passages; one that would go beyond the bound is passed over."""

    sample: int = 4000
    passages: int = 60_000
    hidden: int = 24
    attention: int = 12
    rounds: int = 300
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7


@dataclass
class Model:
    """Encoder, gated attention and classifier; also the features' mean and spread. prior: the score where nothing could be learnt."""

    weights: dict[str, np.ndarray] | None
    mean: np.ndarray
    spread: np.ndarray
    prior: float

    def encode(self, x: np.ndarray, first: np.ndarray) -> tuple:
        w, x = self.weights, np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (t * g) @ w["a"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first[:-1]), np.diff(first)))
        a = a / np.repeat(np.add.reduceat(a, first[:-1]), np.diff(first))
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return x, h, t, g, a, z, 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(first) - 1, self.prior)
        return np.round(self.encode(x.astype(float), first)[-1].astype(float), 6)


def fit(bags: list[np.ndarray], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Learns from bags of passages and their labels (1 good, 0 not) by gradient steps over all of them."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(None, np.zeros(FEATURES), np.ones(FEATURES), prior)
    x = np.concatenate(bags).astype(float)
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    m = Model(None, x.mean(0), np.maximum(x.std(0), 1e-3), prior)
    rng = np.random.default_rng(s.seed)
    draw = lambda *n: rng.normal(0, 1 / np.sqrt(n[0]), n)
    w = {"W": draw(FEATURES, s.hidden), "b": np.zeros(s.hidden), "V": draw(s.hidden, s.attention), "U": draw(s.hidden, s.attention), "a": draw(s.attention), "c": draw(s.hidden), "d": np.zeros(1)}
    m.weights = w
    one, two = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    each = np.diff(first)
    for step in range(1, s.rounds + 1):
        z0, h, t, g, a, z, y = m.encode(x, first)
        e = (y - labels) / len(labels)
        dz = np.repeat(e[:, None] * w["c"], each, axis=0)
        da = (dz * h).sum(1)
        da = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), each))
        dtg = da[:, None] * w["a"]
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
        grad = {"W": z0.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ da, "c": z.T @ e, "d": e.sum(keepdims=True)}
        for k in w:
            d = grad[k] + s.decay * w[k]
            one[k] = 0.9 * one[k] + 0.1 * d
            two[k] = 0.999 * two[k] + 0.001 * d * d
            w[k] = w[k] - s.rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return m


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), usable: Column | None = None) -> Model:
    """Learns from the labels (doc_id, quality) of documents that `usable` admits; default: crc32(doc_id) mod 5 is not 0.

    A bounded sample (see Settings) is encoded by tasks; only passage features come to the driver. Several labels of a document count as the
    largest, several rows of it as the one with the smallest text. Null ids and labels are not used; other columns are not looked at. No
    labels, no documents or one class only: a constant score.
    """
    bounded(docs.sparkSession)
    usable = remainder(F.col("doc_id")) != 0 if usable is None else usable
    labelled = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & usable).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    sample = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in steps(batch.column(2)):
                x, first = passages(data, at)
                bags = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                columns = [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(np.diff(first)), pa.array(bags, pa.binary())]
                yield pa.record_batch(columns, ["doc_id", "quality", "size", "bag"])

    rows = sample.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text")
    bags = written(rows.mapInArrow(run, "doc_id long, quality int, size long, bag binary"), "bags")
    room, taken = s.passages, []
    for r in bags.select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.size <= room:
            room -= r.size
            taken.append((r.doc_id,))
    fitting = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long"))
    got = sorted(bags.join(fitting, "doc_id").collect(), key=lambda r: r.doc_id)
    return fit([np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in got], np.array([float(r.quality > 0) for r in got]), s)


def score(df: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows and columns and a score from 0 to 1 of the whole text (a column of that name is replaced).

    Only the text is looked at, so equal texts have equal scores; null counts as empty, and an empty text has the score of an empty passage.
    """
    bounded(df.sparkSession)
    kept = [c for c in df.columns if c != name]
    place = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in steps(batch.column(place)):
                part = batch.slice(i, j - i)
                yield pa.record_batch([*part.columns, pa.array(model.scores(*passages(data, at)), pa.float64())], names=[*kept, name])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, T.DoubleType())])
    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that learns from the labels of rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
