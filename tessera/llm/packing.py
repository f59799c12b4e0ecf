"""Packing by vector bin packing: examples go into sequences under limits on tokens, segments and loss-bearing tokens at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded
from .tokens import default_path, token_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, segment int"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold; pool: examples that wait to be chosen from in one task."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024
    pool: int = 1024


#: Limits that all bind on prose of a few hundred tokens whose first line bears no loss: a sequence of loss-bearing tokens alone has 16 places left for
#: others, and one in fifteen is full in pieces. (With 32 pieces none ever was; with 4 it costs 0.4 % of the places.)
PRODUCTION = Limits(segments=4, loss=1008)


class Packer:
    """Fills one sequence after another from a bounded pool of examples.

    Choice: of the pool's examples that fit, the one whose demand (tokens, one segment, loss tokens; each as a share of its limit) has the
    largest dot product with what is left in the sequence. If none fits, one of those that fill most of the rest when cut there is cut. What
    is longer than a sequence begins one of its own each time, so the pool holds short rests only.
    """

    def __init__(self, limits: Limits, base: int):
        self.limits, self.next = limits, base
        self.examples: list[tuple] = []  # (id, ids, tokens of the document before, loss from)
        self.demand = np.zeros((2 * limits.pool + 1, 3))
        self.n = 0
        self.out: list[tuple] = []

    def add(self, key, ids: np.ndarray, loss_from: int = 0) -> None:
        start = 0
        while len(ids) - start >= self.limits.tokens:
            length = min(self.limits.tokens, max(0, loss_from - start) + self.limits.loss)
            self._fill((key, ids, start, loss_from, length))
            start += length
        if start < len(ids):
            self._keep(key, ids[start:].copy() if start else ids, start, loss_from, len(ids))
        while self.n >= self.limits.pool:
            self._fill()

    def close(self) -> None:
        while self.n:
            self._fill()

    def _keep(self, key, ids, start, loss_from, total) -> None:
        """ids: those from `start` on of a document's `total`."""
        if self.n == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.examples.append((key, ids, start, loss_from, total))
        self.demand[self.n] = len(ids), 1, min(len(ids), max(0, total - loss_from))
        self.n += 1

    def _take(self, i: int) -> tuple:
        got, last = self.examples[i], self.examples.pop()
        self.n -= 1
        if i < self.n:
            self.examples[i] = last
            self.demand[i] = self.demand[self.n]
        return got

    def _piece(self, key, ids, start, loss_from, total, offset, segment) -> int:
        """Writes down a piece (these ids, from `start` on) and returns how many of its tokens bear loss."""
        loss = min(len(ids), max(0, start + len(ids) - loss_from))
        self.out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset, loss, segment))
        return loss

    def _fill(self, first: tuple | None = None) -> None:
        limit = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        left, offset, segment = limit.copy(), 0, 0
        if first:
            key, ids, start, loss_from, length = first
            loss = self._piece(key, ids[start : start + length], start, loss_from, len(ids), 0, 0)
            left -= length, 1, loss
            offset, segment = length, 1
        while self.n and left[0] >= 1 and left[1] >= 1:
            demand = self.demand[: self.n]
            product = demand @ (left / limit**2)
            room = np.minimum(np.minimum(demand[:, 0], left[0]), demand[:, 0] - demand[:, 2] + left[2])  # loss comes last in an example
            fits = (demand <= left).all(1)
            if not fits.any():
                fits = room == room.max()
            i = int(np.argmax(np.where(fits, product, -1.0)))
            length = int(room[i])
            if length < 1:
                break
            key, ids, start, loss_from, total = self._take(i)
            loss = self._piece(key, ids[:length], start, loss_from, total, offset, segment)
            left -= length, 1, loss
            offset, segment = offset + length, segment + 1
            if length < len(ids):
                self._keep(key, ids[length:], start + length, loss_from, total)
        self.next += 1


def first_line(text: Column) -> Column:
    """Characters of a text's first line and its end; 0 if there is no other line."""
    return F.coalesce(F.instr(text.cast("string"), "\n"), F.lit(0))


def pack(df: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(), end_id: int = 0, prompt_chars: Column | None = None) -> DataFrame:
    """Packs all rows (doc_id, text) into sequences. prompt_chars: how many leading characters bear no loss (null or absent: none do); the
    tokens of these characters alone are counted.

    One row per piece: where it starts in its document's ids (the tokenizer's ids and then end_id), its length, the crc32 of its ids, its
    sequence and the place there. Each task packs what it reads as it streams by: no shuffle, no group; a task leaves at most one sequence
    that is not nearly full. Sequence ids are the task's partition times 2^32 plus a count.

    Null and empty texts are one end_id. Repeated rows are packed as often as they occur; a null doc_id stays null; other columns are not
    looked at. An empty table gives no rows. A very long text fills sequences of its own; only its rest is mixed with others.
    """
    bounded(df.sparkSession)
    path = tokenizer or default_path()
    prompt = F.lit(0) if prompt_chars is None else F.coalesce(prompt_chars, F.lit(0))
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")), ("segment", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, TaskContext.get().partitionId() << 32)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True)) or [()] * len(schema)
            packer.out = []
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)

        for batch in batches:
            for key, text, chars in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                prompt = len(token_ids(text[:chars], path)) if text and chars > 0 else 0
                packer.add(key, np.append(token_ids(text or "", path), np.uint32(end_id)), prompt)
            if packer.out:
                yield flush()
        packer.close()
        if packer.out:
            yield flush()

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), prompt.cast("long").alias("p")).mapInArrow(run, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens, 1008 of them with loss (all but the first line's), and 4 pieces."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), limits=PRODUCTION, prompt_chars=first_line(F.col("text")))
