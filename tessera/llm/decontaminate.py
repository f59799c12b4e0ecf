"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, bounded, grams, mix, read_folder, scratch, steps, words

Q = 4
PAD, _STEP = np.uint64(0), np.uint64(0xD1342543DE82EF95)
FOUND = "doc_id long, item_id long, distance int, item_words int, first_word long, last_word long"


@dataclass(frozen=True)
class Search:
    """An item of n words is found where a run of words is at most floor(n * edits / 100) word edits away.

    walks, tables, bits: CGK walks, hash tables a walk, sampled places a table. At the greatest distance allowed a single aligned window is
    found with a probability of about 0.97 (tests measure it), and several shifted windows of a passage are tried.
    batch: documents that are searched together (what is found doesn't depend on it).
    least: items of fewer words are not searched; by default all are. slice_bytes: items' text that a task holds at once; more go in turns.
    """

    edits: int = 15
    walks: int = 3
    tables: int = 14
    batch: int = 256
    bits: int = 4
    least: int = 1
    slice_bytes: int = 8 << 20
    seed: int = 11


def cgk(x: np.ndarray, seed: int, length: int) -> np.ndarray:
    """Rows of word hashes to `length` rows of symbols: a walk repeats or passes each symbol by a coin that depends on step and symbol.

    Equal prefixes walk alike, and after an edit two walks meet again soon, so few places differ where few words do. Past the end: a pad.
    """
    n, width = x.shape
    flat = np.concatenate([x, np.zeros((n, 1), np.uint64)], axis=1).ravel()
    at = np.arange(n) * (width + 1)
    end = at + width
    coins = np.random.default_rng([seed, 3]).integers(1, 2**63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((length, n), np.uint64)
    for j in range(length):
        s = np.take(flat, at, out=out[j])
        at += ((s * coins[j]) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, end, out=at)
    return out


class Samples:
    """Which places of a walk each table looks at, for items of one size."""

    def __init__(self, size: int, s: Search):
        rng = np.random.default_rng([s.seed, size])
        self.places = [[np.sort(rng.choice(2 * size, min(s.bits, 2 * size), replace=False)) for _ in range(s.tables)] for _ in range(s.walks)]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Rows of words to their bucket in every table (a row each)."""
        out = np.empty((sum(map(len, self.places)), len(x)), np.uint64)
        k = 0
        for walk, tables in enumerate(self.places):
            y = cgk(x, walk, int(max(p[-1] for p in tables)) + 1)
            for p in tables:
                h = y[p[0]] + np.uint64(k + 1)
                for i in p[1:]:
                    h = h * _STEP + y[i]
                out[k] = mix(h)
                k += 1
        return out


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to any run of the text's words, and the run's end (exclusive; the first of several).

    Bit-parallel over the item's words, one step per word of the text.
    """
    m = len(item)
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item.tolist()):
        masks[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(text.tolist()):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = ((((eq & plus) + plus) ^ plus) | eq) & full
        ph, mh = (minus | ~(xh | plus)) & full, plus & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = (mh | ~(xv | ph)) & full, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def filter_by(size: int, edits: int) -> tuple[int, int]:
    """(q, need): an item of this size and a run of words within so many edits share `need` >= 1 of the item's runs of q words.

    By the q-gram lemma need is size - q + 1 - q * edits; q is the largest up to Q for which that is at least 1. q = 1 always does.
    """
    return next((q, size - q + 1 - q * edits) for q in range(Q, 0, -1) if size - q + 1 - q * edits >= 1)


class Index:
    """The items (id, word hashes) by size, with hash tables for each size, and bit tables of all their runs of q words."""

    def __init__(self, items: list[tuple[int, np.ndarray]], s: Search):
        self.search = s
        self.sizes: dict[int, tuple] = {}
        by_size: dict[int, list] = defaultdict(list)
        for key, x in items:
            if len(x) >= max(1, s.least):
                by_size[len(x)].append((key, x))
        runs: dict[int, list] = defaultdict(list)
        for size, group in sorted(by_size.items()):
            samples, buckets = Samples(size, s), defaultdict(list)
            for i, row in enumerate(samples.keys(np.stack([x for _, x in group])).T.tolist()):
                for k in set(row):
                    buckets[k].append(i)
            edits = size * s.edits // 100
            q, need = filter_by(size, edits)
            runs[q] += [grams(x, q) for _, x in group]
            self.sizes[size] = samples, np.array(sorted(buckets), np.uint64), dict(buckets), group, edits, q, need
        self.runs: dict[int, tuple] = {}
        for q, every in runs.items():
            known = np.unique(np.concatenate(every))
            shift = np.uint64(64 - max(16, int(len(known) * 64).bit_length()))
            table = np.zeros(1 << int(64 - shift), bool)
            table[known >> shift] = True
            self.runs[q] = known, shift, table
        self.gap = max((size + edits + 1 for size, (*_, edits, _, _) in self.sizes.items()), default=1)

    def hits(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """For each q at which words a run of q words starts that some item has."""
        out = {}
        for q, (known, shift, table) in self.runs.items():
            g = grams(h, q)
            at = np.flatnonzero(table[g >> shift])
            i = np.searchsorted(known, g[at])
            i[i == len(known)] = 0
            out[q] = at[known[i] == g[at]]
        return out

    def dense(self, at: dict[int, np.ndarray]) -> bool:
        """Whether some window holds as many hits as a match must."""
        for size, (*_, edits, q, need) in self.sizes.items():
            x = at[q]
            if len(x) >= need and (x[need - 1 :] - x[: len(x) - need + 1] < size + edits - q + 1).any():
                return True
        return False

    def find(self, docs: list[tuple[np.ndarray, dict[int, np.ndarray]]]) -> Iterator[tuple]:
        """document, item, distance, item's words, first and last word for every item found in documents (words h, hits by q).

        A window of an item's size is embedded only if it holds as many of the items' runs as a match must (see filter_by), so no match is
        lost and most of a clean text is passed over. Overlapping windows with one candidate are verified in one go over all their words;
        documents are kept so far apart that what is found in one does not depend on the others.
        """
        apart = np.zeros(self.gap, np.uint64)
        text = np.concatenate([x for h, _ in docs for x in (h, apart)] or [apart])
        lengths = np.array([len(h) for h, _ in docs], np.int64)
        begins = np.cumsum(lengths + self.gap) - lengths - self.gap
        hits = {q: np.concatenate([at[q] + b for (_, at), b in zip(docs, begins, strict=True)]) for q in self.runs}
        best: dict[tuple[int, int], tuple] = {}
        for size, (samples, known, buckets, group, edits, q, need) in self.sizes.items():
            reach, at = size + edits - q + 1, hits[q]
            if len(at) < need:
                continue
            first = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < reach)  # `need` hits close together
            mark = np.zeros(len(text) + 1, np.int32)
            np.add.at(mark, np.maximum(0, at[first + need - 1] - reach + 1), 1)
            np.add.at(mark, at[first] + 1, -1)
            windows = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            windows = windows[windows + size <= len(text)]
            candidates: set[tuple[int, int]] = set()
            for part in np.array_split(windows, len(windows) // 8192 + 1):
                if not len(part):
                    continue
                keys = samples.keys(text[part[:, None] + np.arange(size)])
                i = np.searchsorted(known, keys)
                i[i == len(known)] = 0
                for t, w in zip(*np.nonzero(known[i] == keys), strict=True):
                    candidates.update((c, int(part[w])) for c in buckets[int(keys[t, w])])
            spans: list[list[int]] = []  # candidate, document, first word, last word + 1
            for c, a in sorted(candidates):
                doc = int(np.searchsorted(begins, a, "right")) - 1
                low, high = max(int(begins[doc]), a - edits), min(int(begins[doc] + lengths[doc]), a + size + 2 * edits)
                if spans and spans[-1][:2] == [c, doc] and low <= spans[-1][3]:
                    spans[-1][3] = max(high, spans[-1][3])
                elif low < high:
                    spans.append([c, doc, low, high])
            for c, doc, low, high in spans:
                key, item = group[c]
                had = best.get((doc, key))
                if had and had[0] == 0:
                    continue
                distance, end = nearest(item, text[low:high])
                if distance <= edits and (not had or distance < had[0]):
                    length = nearest(item[::-1], text[low : low + end][::-1])[1]
                    begin = low - int(begins[doc])
                    best[doc, key] = distance, size, begin + end - length, begin + end - 1
        for (doc, key), found in sorted(best.items()):
            yield doc, key, *found


@lru_cache(maxsize=2)
def _index(uri: str, s: Search) -> tuple[list[int | None], Index]:
    """The ids of a slice's items (in a fixed order) and their index; items are numbered."""
    rows = read_folder(uri, ["item_id", "text"]).sort_by([("text", "ascending"), ("item_id", "ascending")])
    found = []
    for i, j, data, at in steps(rows.column("text").combine_chunks()) if rows.num_rows else ():
        h, _, row = words(data, at, LETTERS)
        found += [(i + r, h[row[r] : row[r + 1]]) for r in range(j - i)]
    return rows.column("item_id").to_pylist(), Index(found, s)


def contaminated(df: DataFrame, benchmark: DataFrame, s: Search = Search()) -> DataFrame:
    """One row for each document row and item that occurs in it: doc_id, item_id, distance in words, item_words, first_word and last_word.

    Words are runs without white space, A-Z as a-z; ASCII signs in them (as at a sentence's end) are not looked at. The items (item_id, text)
    are a table in the shared folder, in slices of bounded size, as many as there are; tasks read one slice, and the documents are searched
    once for each. Of several places of an item in a text the nearest is named, and of those the first.

    Null texts have no words; items without words are never found; a null doc_id or item_id stays null; items with equal ids are items of
    their own; repeated document rows give repeated rows. Texts of any length are searched whole; other columns are not looked at. No
    documents or no items give no rows.
    """
    spark = df.sparkSession
    bounded(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 + size // s.slice_bytes
    folder = scratch(spark, "items")
    items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))).repartition(slices, "slice").write.partitionBy("slice").parquet(folder)
    texts = df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in FOUND.split(", ")]
    out = None
    for k in range(slices):

        def run(batches: Iterator[pa.RecordBatch], uri=f"{folder}/slice={k}") -> Iterator[pa.RecordBatch]:
            ids, index = _index(uri, s)
            held: list[tuple] = []

            def searched() -> Iterator[pa.RecordBatch]:
                got = [(held[d][0], ids[n], *rest) for d, n, *rest in index.find([x[1:] for x in held])] if held else []
                held.clear()
                if got:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names)

            for batch in batches:
                for i, _, data, at in steps(batch.column(1)):
                    h, _, row = words(data, at, LETTERS)
                    own: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
                    for q, hits in index.hits(h).items():
                        owner = np.searchsorted(row, hits, "right") - 1
                        hits, owner = (x[hits + q <= row[owner + 1]] for x in (hits, owner))
                        found, cuts = np.unique(owner, return_index=True)
                        for r, x in zip(found.tolist(), np.split(hits, cuts[1:]), strict=False):
                            own[r][q] = x - row[r]
                    for r, at_q in sorted(own.items()):
                        at_q = {q: at_q.get(q, np.zeros(0, np.int64)) for q in index.runs}
                        if index.dense(at_q):
                            held.append((batch.column(0)[i + r].as_py(), h[row[r] : row[r + 1]].copy(), at_q))
                            if len(held) >= s.batch:
                                yield from searched()
            yield from searched()

        part = texts.mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it contains."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
