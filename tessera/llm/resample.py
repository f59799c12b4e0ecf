"""Importance resampling towards a target: hashed word n-grams of both sides, log ratios as weights, Gumbel noise, the highest scores drawn."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, steps, temporary, written


@dataclass(frozen=True)
class Resampling:
    """n: words of the longest feature; buckets: hash buckets; percent: share of the eligible documents that is drawn; least: words of an
    eligible document; seed: of the noise; chunk: words whose features one chunk of a long text owns; long: bytes from which on a text is cut.
    """

    n: int = 3
    buckets: int = 10_000
    percent: int = 5
    least: int = 20
    seed: int = 42
    chunk: int = 4096
    long: int = 1 << 16


# Fixed values of the contract: bytes of words (digits, a-z after lower-casing, all of other scripts).
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
_BLANK = np.uint32(zlib.crc32(b" "))
#: Bytes up to which words are hashed side by side; longer ones one by one.
SIDE_BY_SIDE = 32


@lru_cache(maxsize=None)
def _moves() -> np.ndarray:
    """[length, byte of the sum, its value]: what a byte of a checksum becomes when so many bytes (up to SIDE_BY_SIDE) follow."""
    table = np.empty((SIDE_BY_SIDE + 1, 4, 256), np.uint32)
    for k in range(4):
        table[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for i in range(1, SIDE_BY_SIDE + 1):
        table[i] = (table[i - 1] >> np.uint32(8)) ^ _CRC[table[i - 1] & np.uint32(255)]
    return table


def _moved(sums: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    """The checksums moved by the numbers of bytes that follow them (checksums are linear, so crc32(a + b) = moved(crc32(a), len(b)) ^ crc32(b))."""
    t, sums, rest = _moves(), sums.copy(), np.broadcast_to(np.asarray(by, np.int64), sums.shape).copy()
    some = np.arange(len(sums))
    while len(some):
        step, x = np.minimum(rest[some], SIDE_BY_SIDE), sums[some]
        sums[some] = t[step, 0, x & 255] ^ t[step, 1, (x >> 8) & 255] ^ t[step, 2, (x >> 16) & 255] ^ t[step, 3, x >> 24]
        rest[some] -= step
        some = some[rest[some] > 0]
    return sums


def word_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes with A-Z lowered; where words start and end; and the index of each row's first word (one entry more than rows)."""
    solid = np.concatenate([_WORD[_LOWER[data]], [False]])
    first, last = solid[:-1].copy(), solid[:-1] & ~solid[1:]
    first[1:] &= ~solid[:-2]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # words end with their row
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def _word_sums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    order = np.argsort(-sizes, kind="stable")
    begins, lengths = starts[order], sizes[order]
    sums = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    several = int(np.searchsorted(-lengths, -SIDE_BY_SIDE, "left"))  # the longer ones come first
    for j in range(min(SIDE_BY_SIDE, int(lengths[several])) if several < len(lengths) else 0):
        k = int(np.searchsorted(-lengths, -j, "left"))
        x = sums[several:k]
        sums[several:k] = (x >> np.uint32(8)) ^ _CRC[(x ^ data[begins[several:k] + j]) & np.uint32(255)]
    sums ^= np.uint32(0xFFFFFFFF)
    for i in range(several):
        sums[i] = zlib.crc32(data[begins[i] : begins[i] + lengths[i]].tobytes())
    out = np.empty(len(starts), np.uint32)
    out[order] = sums
    return out


def features(data: np.ndarray, at: np.ndarray, own: np.ndarray, s: Resampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some rows the buckets of all their features, the row of each, and the rows' words; only words before `own` start features, or count."""
    data = _LOWER[data]
    starts, ends, first = word_places(data, at)
    sizes = ends - starts
    held = np.diff(first)
    words = np.minimum(held, own)
    row = np.repeat(np.arange(len(held)), held)
    left = first[1:][row] - np.arange(len(starts))  # words from here to the row's end
    owned = np.arange(len(starts)) - first[:-1][row] < own[row]
    one = _word_sums(data, starts, sizes) if len(starts) else np.zeros(0, np.uint32)
    sums, rows, run = [one[owned]], [row[owned]], one
    for k in range(1, s.n):
        run = _moved(_moved(run[:-1], 1) ^ _BLANK, sizes[k:]) ^ one[k:] if len(run) > 1 else run[:0]
        some = (owned & (left > k))[: len(run)]
        sums.append(run[some])
        rows.append(row[: len(run)][some])
    return (np.concatenate(sums) % np.uint32(s.buckets)).astype(np.int64), np.concatenate(rows), words


def chunks(texts: DataFrame, s: Resampling = Resampling()) -> DataFrame:
    """row, doc_id, text and own of pieces of the texts: each has `chunk` words and the n - 1 words after them, and owns the former."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row, doc_id, text = (batch.column(k)[i : i + 1] for k in range(3))
                raw = text.cast(pa.binary())[0].as_py()
                data = np.frombuffer(raw, np.uint8)
                starts, ends, _ = word_places(data, np.array([0, len(data)]))
                for a in range(0, max(1, len(starts)), s.chunk):
                    b = min(len(starts), a + s.chunk)
                    piece = raw[starts[a] : ends[min(len(starts), b + s.n - 1) - 1]].decode() if len(starts) else ""
                    yield pa.record_batch([row, doc_id, pa.array([piece]), pa.array([b - a])], ["row", "doc_id", "text", "own"])

    return texts.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, text string, own long")


def bucket_counts(pieces: DataFrame, s: Resampling = Resampling()) -> np.ndarray:
    """How many features of the pieces (text, own) each bucket holds. A task hands on its own sums, one row for a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        for batch in batches:
            own = batch.column(1).to_numpy()
            for i, j, data, at in steps(batch.column(0)):
                total += np.bincount(features(data, at, own[i:j], s)[0], minlength=s.buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(s.buckets, np.int64)
    for r in pieces.select("text", "own").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the source, rounded down."""
    t, s, buckets = int(target.sum()), int(source.sum()), len(target)
    ratio = lambda a, b: ((float(a) + 1) * (float(s) + buckets)) / ((float(b) + 1) * (float(t) + buckets))
    return np.array([math.floor(1000 * math.log(ratio(int(a), int(b)))) for a, b in zip(target, source, strict=True)], np.int64)


def weighed(pieces: DataFrame, gain: np.ndarray, s: Resampling = Resampling()) -> DataFrame:
    """row, doc_id, n_words, n_features and weight of every piece."""
    sent = pieces.sparkSession.sparkContext.broadcast(gain)
    names = ["row", "doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(3).to_numpy()
            for i, j, data, at in steps(batch.column(2)):
                bucket, row, words = features(data, at, own[i:j], s)
                n = np.bincount(row, minlength=j - i)
                up = np.concatenate([np.zeros(1, np.int64), np.cumsum(sent.value[bucket[np.argsort(row, kind="stable")]])])
                end = np.cumsum(n)
                yield pa.record_batch([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(words), pa.array(n), pa.array(up[end] - up[end - n])], names)

    return pieces.select("row", "doc_id", "text", "own").mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of standard Gumbel noise, rounded down, from the first 32 bits of sha256(`seed:doc_id`)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame) -> DataFrame:
    """The rows with place, from 1: by falling score, ties by doc_id (null last). Rows are sorted over all tasks; only partitions' sizes are collected."""
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits that count its rows
    rows = written(scored.orderBy(F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("at", at), "sorted", keep=True)
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((r.part, before))
        before += r.n
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part long, before long"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(table, part == F.col("part")).withColumn("place", place).drop("at", "part", "before")


def resampled(df: DataFrame, target: DataFrame, s: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of df; rank is null for what is not drawn.

    Features are all runs of 1 to n words, counted by the hash bucket of their text, in all of df and in all target texts. A document's weight is the
    sum of its features' gains; with Gumbel noise added, the highest scores are a sample without replacement in proportion to the weights.

    Short texts are looked at where they are read. Long ones are cut once at word boundaries into chunks that carry the n - 1 words after
    those they own; chunks are dealt over all tasks, and counts and weights are summed by document. The buckets' counts are all
    that comes to the driver.

    Null and empty texts have no features and weight 0. Repeated rows count, and are drawn, as often as they occur; a null doc_id has the
    noise of an empty one and comes last among ties. No target text: all gains follow the source alone. An empty table gives no rows.
    Columns but doc_id and text are not looked at.
    """
    spark = df.sparkSession
    bounded(spark)
    own = F.lit((1 << 62)).alias("own")  # a whole text owns all its words
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        size = F.octet_length("text")
        cut = chunks(rows.filter(size > s.long), s)
        return rows.filter(size <= s.long).select("row", "doc_id", "text", own), written(cut.repartition("row", F.monotonically_increasing_id()), "chunks")

    rows = df.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    aims = target.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    with temporary(spark):
        short, long = pieces(rows)
        whole, cut = pieces(aims)
        gain = gains(bucket_counts(whole.unionByName(cut), s), bucket_counts(short.unionByName(long), s))
        whole = weighed(short, gain, s).drop("row")
        summed = weighed(long, gain, s).groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight"))).drop("row")
        weights = written(whole.unionByName(summed), "weights", keep=True)
        scored = weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), s.seed))
        eligible = F.col("n_words") >= s.least
        drawn = s.percent * weights.filter(eligible).count() // 100
        places = ranked(scored.filter(eligible))
    chosen = places.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    out = chosen.unionByName(scored.filter(~eligible).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark's texts; five in a hundred of those with 20 words or more are drawn."""
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
texts AS (SELECT true AS src, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
w AS MATERIALIZED (SELECT src, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
g AS MATERIALIZED (
  SELECT src, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS f FROM w),
d AS MATERIALIZED (SELECT DISTINCT f FROM g),
h AS (SELECT f, hex(encode(f)) AS x FROM d),
k AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: (16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM h, crc),
n AS MATERIALIZED (SELECT g.src, g.id, k.bucket, count(*) AS c FROM g JOIN k ON k.f = g.f GROUP BY 1, 2, 3),
b AS (SELECT r.bucket, coalesce(sum(c) FILTER (src), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (NOT src), 0)::DOUBLE AS t FROM (SELECT unnest(range(10000)) AS bucket) r LEFT JOIN n ON n.bucket = r.bucket GROUP BY 1),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM b) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000))))::BIGINT AS gain FROM b),
weight AS (SELECT n.id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM n JOIN gain ON gain.bucket = n.bucket WHERE src GROUP BY 1),
scored AS (
  SELECT w.id AS doc_id, len(ws) >= 20 AS ok, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weight ON weight.id = w.id WHERE src),
placed AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY ok ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * (SELECT count(*) FROM scored WHERE ok) // 100 THEN place END AS rank FROM placed
"""
