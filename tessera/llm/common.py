"""Shared pieces: bounded Arrow batches, word hashes over UTF-8 bytes, and the scratch tables of the library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shared import scratch, shared_dir, temporary, written

__all__ = ["LETTERS", "SPACE", "bounded", "fresh", "grams", "mix", "read_folder", "scratch", "shared_dir", "shingle_sets", "steps", "temporary", "text_bytes", "words", "written"]

#: Bytes of text that one numpy step handles at most (a single longer text is handled alone).
STEP_BYTES = 1 << 20
ARROW_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts small; a batch also ends after so many bytes, not only after 10,000 rows.

    The setting is read when a plan is executed, so it stays set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """The name, or the name with signs after it, that no column of df has (in whatever case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_folder(uri: str, columns: list[str]) -> pa.Table:
    """A table of bounded size from the shared folder, read by a task; a folder that is not there is an empty table of these string columns."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(uri)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(where, allow_not_found=True)) if f.base_name.endswith(".parquet"))
    if not files:
        return pa.table({c: pa.array([], pa.string()) for c in columns})
    return pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read(columns) for f in files])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and where each row starts (one more entry than rows)."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of bounded size: first row, last row + 1, bytes, row starts."""
    data, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[SPACE] = 0
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
#: As above, but ASCII signs are not looked at (they only keep their place).
LETTERS = _BYTE.copy()
LETTERS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        more[0] = 1
        _powers = np.cumprod(more, dtype=np.uint64)
    return _powers


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (maximal runs without x20, x09-x0D; A-Z as a-z) of all rows.

    Returns the hashes, the byte at which each word starts, and for each row the index of its first word (one entry more than rows).
    """
    none = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), none, np.zeros(len(at), np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = at[:-1][at[:-1] < len(data)]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), none, np.zeros(len(at), np.int64)
    value = table[data]
    gap = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, gap)
    value[starts[0] :] *= _power(int(gap.max()))[place]
    return mix(np.add.reduceat(value, starts)), starts, np.searchsorted(starts, at)


_C = np.uint64(0xD6E8FEB86659FD93)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (rows not regarded)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _C + h[i : i + n]
    return mix(out)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; fewer words count as one shingle; no words, none."""
    h, _, rows = words(data, at)
    g = grams(h, k)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        elif b > a:
            yield mix(grams(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield g[:0]
