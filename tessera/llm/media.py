"""Media columns: TIFF files held in a binary column, one row per page out. Strips or tiles; PackBits, LZW or deflate; predictors undone."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded

# Fixed values of the TIFF 6.0 format: tags, field type sizes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
USED = frozenset((WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT))
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


#: Bytes of samples that a byte of a file stands for at most (deflate's and LZW's limits are below); a page that claims more is broken.
MOST_RATIO = 1400


def packbits_decode(data: bytes, most: int = 1 << 62) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        k = data[i]
        i += 1
        if k < 128:
            out += data[i : i + k + 1]
            i += k + 1
        elif k > 128:
            out += data[i : i + 1] * (257 - k)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run >= 3:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, most: int = 1 << 62) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends; the width grows one code early."""
    out, table, width, held, bits, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        if len(out) >= most:
            break
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:
                table.append(last + entry[:1])
        out += entry
        last = entry
        size = len(table) + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return bytes(out)


def decompress(data: bytes, scheme: int, most: int = 1 << 62) -> bytes:
    """The data of a strip or tile, of which no more than `most` bytes are wanted."""
    if scheme == NONE:
        return data
    if scheme == PACKBITS:
        return packbits_decode(data, most)
    if scheme == LZW:
        return lzw_decode(data, most)
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(1, min(most, 1 << 62)))
    raise ValueError(f"TIFF compression {scheme} is not supported")


class Directory:
    """One image directory: its fields by tag."""

    def __init__(self, data: bytes, at: int, order: str):
        self.data, self.order, self.fields = data, order, {}
        (n,) = struct.unpack_from(order + "H", data, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = TYPE_SIZE.get(kind, 1) * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if kind in TYPE_CODE and tag in USED and tag not in self.fields:
                self.fields[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, where)
        (self.next,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)

    def one(self, tag: int, default: int) -> int:
        """A field's value, the same for all samples."""
        values = set(self.fields.get(tag) or (default,))
        if len(values) != 1 or not isinstance(value := values.pop(), int):
            raise ValueError(f"field {tag} has several values or none that is whole")
        return value


def directories(data: bytes) -> Iterator[Directory]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at and at not in seen:
        seen.add(at)
        d = Directory(data, at, order)
        yield d
        at = d.next


def _undo(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """Rows of pixels of samples; horizontal differences are summed up again, floating point bytes are put together again."""
    if predictor == 2:
        whole = block.view(f"{block.dtype.byteorder}u{block.dtype.itemsize}")
        return np.cumsum(whole, axis=1, dtype=whole.dtype).astype(whole.dtype, copy=False).view(block.dtype)
    if predictor == 3:
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        raw = np.cumsum(block.view(np.uint8).reshape(rows, columns * size, samples), axis=1, dtype=np.uint8)
        planes = raw.reshape(rows, size, columns * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes if order == ">" else planes[:, :, ::-1]).view(block.dtype.newbyteorder(order)).reshape(rows, columns, samples)
    return block


def page(d: Directory) -> np.ndarray:
    """The samples of one page: height x width x samples, of 1, 2, 4 or 8 bytes each. ValueError where the directory can't be right."""
    f, width, height, samples = d.fields, d.one(WIDTH, 0), d.one(HEIGHT, 0), d.one(SAMPLES, 1)
    bits, scheme, predictor, form = d.one(BITS, 1), d.one(COMPRESSION, NONE), d.one(PREDICTOR, 1), d.one(SAMPLE_FORMAT, 1)
    if form not in (1, 2, 3) or bits not in ((16, 32, 64) if form == 3 else (8, 16, 32, 64)):
        raise ValueError(f"{bits} bits a sample of format {form} are not supported")
    if predictor not in (1, 2, 3) or (predictor == 3) > (form == 3):
        raise ValueError(f"predictor {predictor} is not supported")
    tiled = TILE_AT in f
    w, h = (d.one(TILE_WIDTH, 0), d.one(TILE_HEIGHT, 0)) if tiled else (width, min(d.one(ROWS_PER_STRIP, height), height))
    if min(width, height, samples, w, h) < 1:
        raise ValueError(f"{width} x {height} pixels of {samples} samples in blocks of {w} x {h}")
    kind = np.dtype(f"{d.order}{' uif'[form]}{bits // 8}")
    planes = samples if d.one(PLANAR, 1) == 2 else 1
    each = samples // planes
    across, down = -(-width // w), -(-height // h)
    places, sizes = f[TILE_AT if tiled else STRIP_AT], f[TILE_BYTES if tiled else STRIP_BYTES]
    if len(places) != len(sizes) or len(places) != across * down * planes:
        raise ValueError(f"{across * down * planes} blocks are needed, {len(places)} are there")
    if max(width * height * samples, w * h * each) * kind.itemsize > MOST_RATIO * len(d.data):
        raise ValueError("the page is larger than its file's data can be")
    out = np.zeros((height, width, samples), kind)
    for k, (at, size) in enumerate(zip(places, sizes, strict=True)):
        plane, k = divmod(k, across * down)
        top, left = k // across * h, k % across * w
        rows = h if tiled else min(h, height - top)
        raw = decompress(d.data[at : at + size], scheme, rows * w * each * kind.itemsize)
        block = np.frombuffer(raw, kind, rows * w * each).reshape(rows, w, each)
        block = _undo(block, predictor, d.order)[: height - top, : width - left]
        out[top : top + rows, left : left + w, plane * each : (plane + 1) * each] = block
    return out


#: A page of a payload: 64 RGB pixels a row, so many rows at most.
ROW_BYTES, PAGE_ROWS, STRIP_ROWS = 192, 4096, 512


def encode_payload(payload: bytes, level: int = 6) -> bytes:
    """Bytes (a multiple of 192) as the 8-bit RGB samples of a TIFF: pages of 64 x 4096 pixels, deflated strips, horizontal predictor."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    for top in range(0, len(rows), PAGE_ROWS):
        image = rows[top : top + PAGE_ROWS]
        step = image.copy()
        step[:, 1:] -= image[:, :-1]
        strips = [zlib.compress(step[r : r + STRIP_ROWS].tobytes(), level) for r in range(0, len(image), STRIP_ROWS)]
        at = []
        for s in strips:
            at.append(len(out))
            out += s + b"\0" * (len(s) % 2)

        def array(code: str, values: list[int]) -> int:
            where = len(out)
            out.extend(struct.pack(f"<{len(values)}{code}", *values))
            return where

        n = len(strips)
        bits = array("H", [8, 8, 8, 0])
        places, sizes = (at[0], len(strips[0])) if n == 1 else (array("I", at), array("I", [len(s) for s in strips]))
        fields = [(WIDTH, 3, 1, 64), (HEIGHT, 4, 1, len(image)), (BITS, 3, 3, bits), (COMPRESSION, 3, 1, DEFLATE), (PHOTOMETRIC, 3, 1, 2), (STRIP_AT, 4, n, places), (SAMPLES, 3, 1, 3), (ROWS_PER_STRIP, 4, 1, STRIP_ROWS), (STRIP_BYTES, 4, n, sizes), (PLANAR, 3, 1, 1), (PREDICTOR, 3, 1, 2)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields))
        for tag, kind, count, value in fields:
            out += struct.pack("<HHII", tag, kind, count, value)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def texts_to_tiff(df: DataFrame) -> DataFrame:
    """doc_id and text to doc_id, n_bytes and media: the text's UTF-8 bytes, filled up with blanks to a positive multiple of 192, as a TIFF.

    A null text is an empty one; repeated rows each have their file; a null doc_id stays null; a text of any length is cut into pages.
    """
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for i in range(0, len(batch), 256):
                raw = [x.as_py() or b"" for x in texts[i : i + 256]]
                files = [encode_payload(x + b" " * (ROW_BYTES - len(x) if not x else -len(x) % ROW_BYTES)) for x in raw]
                yield pa.record_batch([ids[i : i + 256], pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PAGE = "page_no int, pages int, width int, height int, samples int, bits int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_tiff(df: DataFrame, pixels: bool = True) -> DataFrame:
    """Rows with a TIFF in column media to one row per page; the other columns are kept (names that clash with a page's give way to it).

    Columns payload_* carry what has been read of the file up to this page (a running digest and the last 16 bytes), so a file's last page
    has the whole file's; pages are decoded one at a time. feature: of this and earlier pages' samples, mean and spread by channel and a
    histogram of 8 bins, as whole numbers. A null file is one row, page_no null and the reason in error; so is a broken one, after the pages
    that could be read of it. A page is at most 1,400 times as large as its file; one that claims more is broken. Repeated rows each give
    their pages; no rows give none.
    """
    bounded(df.sparkSession)
    added = PAGE + (", image binary" if pixels else "")
    names = {x.split()[0] for x in added.split(", ")}
    kept = [c for c in df.columns if c != "media" and c not in names]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), added])

    def rows(data: bytes | None) -> Iterator[tuple]:
        try:
            if data is None:
                raise ValueError("no file")
            count_of = sum(1 for _ in directories(data))
            digest, total, tail, media = hashlib.sha256(), 0, b"", hashlib.sha256(data).hexdigest()
            sums, squares, count, bins = np.zeros(0), np.zeros(0), 0, np.zeros(8, np.int64)
            for k, d in enumerate(directories(data)):
                image = page(d)
                raw = image.tobytes()
                digest.update(raw)
                total, tail = total + len(raw), (tail + raw[-16:])[-16:]
                flat = image.reshape(-1, image.shape[2])
                if len(sums) != flat.shape[1]:
                    sums, squares, count = np.zeros(flat.shape[1]), np.zeros(flat.shape[1]), 0
                sums, squares, count = sums + flat.sum(0, dtype=float), squares + (flat.astype(np.float32) ** 2).sum(0, dtype=float), count + len(flat)
                bins = bins + np.bincount(np.frombuffer(raw, np.uint8) >> 5, minlength=8)
                mean = sums / count
                spread = np.sqrt(np.maximum(squares / count - mean**2, 0))
                feature = f"mean={','.join(f'{x:.3f}' for x in mean)};sd={','.join(f'{x:.3f}' for x in spread)};hist={','.join(map(str, bins))}"
                yield (k, count_of, image.shape[1], image.shape[0], image.shape[2], image.dtype.itemsize * 8, total, digest.hexdigest(), zlib.crc32(tail), len(data), media, feature, None, *([raw] if pixels else []))
        except (ValueError, KeyError, struct.error, zlib.error, IndexError, OverflowError) as e:
            yield (*[None] * 9, None if data is None else len(data), None, None, str(e)[:200], *([None] if pixels else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field(*x) for x in [("page_no", pa.int32()), ("pages", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())] + [("image", pa.binary())] * pixels]
        for batch in batches:
            media = batch.column(batch.num_columns - 1)
            for i in range(0, len(batch), 64):
                own, out = [], []
                for j in range(i, min(i + 64, len(batch))):
                    for r in rows(media[j].as_py()):
                        own.append(j)
                        out.append(r)
                take = batch.take(pa.array(own, pa.int64()))
                columns = list(zip(*out, strict=True))
                yield pa.record_batch([*(take.column(k) for k in range(batch.num_columns - 1)), *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=True))], names=[*kept, *(f.name for f in fields)])

    return df.select(*(F.col(f"`{c}`") for c in kept), "media").mapInArrow(run, schema)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a TIFF and read back; its last page carries what holds for the whole file."""
    files = texts_to_tiff(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = read_tiff(files, pixels=False)
    return pages.filter(F.col("page_no") == F.col("pages") - 1).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
