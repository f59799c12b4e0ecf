"""Language-model scores: cross-entropy difference of a target and a background bigram model over one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, written
from .tokens import default_path, token_ids, vocabulary_size


@dataclass(frozen=True)
class Models:
    """Both models have this order (2), smoothing and vocabulary. mu: weight of the unigram model in a bigram's; alpha: added to unigram counts.

    part_tokens: tokens of a part, the unit in which bigrams are counted and texts scored (a longer text is a part of its own);
    broadcast: ids of target documents that are broadcast at most (8 bytes each), more are joined by a shuffle.
    """

    mu: float = 20.0
    alpha: float = 0.1
    part_tokens: int = 4_000_000
    broadcast: int = 500_000


def tokenized(docs: DataFrame, path: str, m: Models) -> DataFrame:
    """part, doc_id, is_target and ids (the tokenizer's, as 2 or 4 bytes each) of all rows, in the shared folder: texts are tokenized once."""
    kind = _kind(path)
    names = ["part", "doc_id", "is_target", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = token_ids(text or "", path)
                if held and held + len(ids) > m.part_tokens:
                    part, held = part + 1, 0
                held += len(ids)
                rows.append((part, ids.astype(kind).tobytes()))
            parts, ids = zip(*rows, strict=True) if rows else ((), ())
            yield pa.record_batch([pa.array(parts, pa.int64()), batch.column(0), batch.column(2), pa.array(ids, pa.binary())], names)

    return written(docs.mapInArrow(run, "part long, doc_id long, is_target boolean, ids binary"), "tokens")


def _kind(path: str) -> str:
    return "<u2" if vocabulary_size(path) < 1 << 16 else "<u4"


def _bigrams(ids: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of all rows as history * 2^32 + token, and how many each row has (one a token). The vocabulary's size stands for a start."""
    each = [np.frombuffer(x.as_buffer(), _kind(path)) for x in ids]
    sizes = np.array([len(x) for x in each], np.int64)
    flat = np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64)
    history = np.concatenate([np.zeros(1, np.int64), flat[:-1]]) if len(flat) else flat
    begins = np.cumsum(sizes) - sizes
    history[begins[sizes > 0]] = vocabulary_size(path)
    return history << 32 | flat, sizes


def count(tokens: DataFrame, path: str) -> DataFrame:
    """part, key (bigram), t and b: how often it occurs in target documents and in all documents of a part."""
    schema = pa.schema([("part", pa.int64()), ("key", pa.int64()), ("t", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        own = None

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(held[0]), own)), *(pa.array(x) for x in held)], schema)

        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if own is not None and own != parts[i] and held:
                    yield out()
                    held = ()
                own = parts[i]
                key, sizes = _bigrams(batch.column(2)[i:j], path)
                target = np.repeat(batch.column(1)[i:j].to_numpy(zero_copy_only=False).astype(np.int64), sizes)
                key, t, b = (np.concatenate(x) for x in zip(held, (key, target, np.ones(len(key), np.int64)), strict=True)) if held else (key, target, np.ones(len(key), np.int64))
                key, at = np.unique(key, return_inverse=True)
                held = key, np.bincount(at, t, len(key)).astype(np.int64), np.bincount(at, b, len(key)).astype(np.int64)
        if held:
            yield out()

    return written(tokens.select("part", "is_target", "ids").mapInArrow(run, "part long, key long, t long, b long"), "counts")


def cross_entropy_difference(df: DataFrame, targets: DataFrame, tokenizer: str | None = None, m: Models = Models()) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a token) and score: target_loss - background_loss; lower is more like the target.

    df has doc_id and text; targets has the doc_ids of the target documents. The background is all documents. Both models are bigram models over the
    tokenizer's ids that occur at all, smoothed alike by their unigram models. A document's own bigrams are left out of both models' counts
    while it is scored, so target documents have no advantage from having been counted.

    Texts are tokenized once and cut into parts of bounded size. A part's bigrams are counted in its task, added up over all parts by key, and
    joined back to the parts that have them: a part is scored with those rows of the model that it needs, which come sorted before its
    texts. Only unigram counts, bounded by the tokenizer's vocabulary, pass through the driver.

    Null and empty texts have no tokens and score 0; null ids are never targets; repeated rows count and are scored as often as they occur;
    other columns are not looked at; an empty table gives no rows. A longer text only takes longer; its ids are held by one task.
    """
    spark = df.sparkSession
    bounded(spark)
    path = tokenizer or default_path()
    ids = targets.select(F.col("doc_id").cast("long").alias("target_id")).filter("target_id IS NOT NULL").distinct()
    if ids.count() <= m.broadcast:
        ids = F.broadcast(ids)
    docs = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, F.col("doc_id") == F.col("target_id"), "left")
    tokens = tokenized(docs.select("doc_id", "text", F.col("target_id").isNotNull().alias("is_target")), path, m)
    counts = count(tokens, path)
    model = written(counts.groupBy("key").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "bigrams")

    size = vocabulary_size(path) + 1
    one, over = ({c: np.zeros(size) for c in "tb"} for _ in range(2))
    for into, by in ((one, F.col("key").bitwiseAND((1 << 32) - 1)), (over, F.shiftright("key", 32))):
        for r in model.groupBy(by.alias("k")).agg(F.sum("t").alias("t"), F.sum("b").alias("b")).collect():
            into["t"][r.k], into["b"][r.k] = r.t, r.b
    vocabulary = max(1, int((one["b"] > 0).sum()))
    base = {c: (one[c] + m.alpha) / (one[c].sum() + m.alpha * vocabulary) for c in "tb"}
    shared = spark.sparkContext.broadcast((base, over))

    needed = counts.select("part", "key").join(model, "key").select("part", F.lit(0).alias("role"), "key", "t", "b")
    texts = tokens.select("part", F.lit(1).alias("role"), "doc_id", "is_target", "ids")
    rows = needed.unionByName(texts, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, over = shared.value
        own, pieces, known, found = None, [], np.zeros(0, np.int64), {}
        for batch in batches:
            part, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(role) != 0)) + 1).tolist(), len(part)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if part[i] != own:
                    own, pieces, known, found = part[i], [], np.zeros(0, np.int64), {}
                if role[i] == 0:
                    pieces.append([batch.column(k)[i:j].to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3, 4)])
                    continue
                if pieces:
                    known, t, b = (np.concatenate(x) for x in zip(*pieces, strict=True))
                    order = np.argsort(known)
                    known, found, pieces = known[order], {"t": t[order], "b": b[order]}, []
                key, sizes = _bigrams(batch.column(7)[i:j], path)
                target = batch.column(6)[i:j].to_numpy(zero_copy_only=False).astype(bool)
                at = np.searchsorted(known, key)
                history, token = key >> 32, key & ((1 << 32) - 1)
                row = np.repeat(np.arange(len(sizes)), sizes)
                own_counts = []
                for x in (at, history):
                    _, place, n = np.unique(row << 32 | x, return_inverse=True, return_counts=True)
                    own_counts.append(n[place])
                loss = {}
                for c in "tb":
                    less = np.repeat(target, sizes) if c == "t" else True
                    counted = found[c][at] if len(key) else np.zeros(0)
                    top = counted - np.where(less, own_counts[0], 0) + m.mu * base[c][token]
                    value = -np.log(top / (over[c][history] - np.where(less, own_counts[1], 0) + m.mu))
                    loss[c] = np.round(np.bincount(row, value, len(sizes)) / np.maximum(sizes, 1), 6)
                losses = [pa.array(x) for x in (loss["t"], loss["b"], np.round(loss["t"] - loss["b"], 6))]
                yield pa.record_batch([batch.column(5)[i:j], pa.array(sizes), *losses], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    columns = rows.select("part", "role", "key", "t", "b", "doc_id", "is_target", "ids")
    return columns.mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def op10_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; target: those that the labels call good."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)
