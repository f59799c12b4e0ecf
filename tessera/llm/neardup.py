"""N-gram Jaccard self-join: size-banded tiles, parity bitmaps that bound the overlap, exact intersection of sorted arrays."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bounded, mix, shingle_sets, steps, temporary, written


@dataclass(frozen=True)
class Join:
    """words: words of a shingle; percent: two sets link when 100 * intersection >= percent * union.

    chunk: rows of a tile's side, and partners of a pivot in one group, about; rounds: rounds in which only best partners of different
    components meet, before the round that leaves out nothing; broadcast: ids and pairs that are broadcast at most (24 bytes each).
    """

    words: int = 5
    percent: int = 80
    chunk: int = 512
    rounds: int = 1
    broadcast: int = 500_000


#: One set in so many is looked at to find very common tiles, of which there are at most so many.
SAMPLED, MOST_COMMON = 64, 100_000
#: One tile in so many is looked into for best partners, before all are.
SOME = 4
#: Pairs that a task remembers so as not to say them again.
TOLD = 500_000


@lru_cache(maxsize=8)
def _bands() -> list[int]:
    limits = [1]
    while limits[-1] < 1 << 40:
        limits.append(max(limits[-1] + 1, -(-3 * limits[-1] // 2)))
    return limits


@lru_cache(maxsize=4096)
def _cut(band: int, percent: int) -> tuple[int, int]:
    """How many elements linked sets of a band differ in at most, and into how many parts the hash range is cut there.

    More parts than differences: some are untouched. How many more: about as many as are empty by chance in the band's smallest sets.
    """
    limits = _bands()
    most = (100 - percent) * (limits[band + 1] - 1) // percent
    if most <= 8:
        return most, most + 2
    count = most + 1
    for _ in range(3):
        empty = count * exp(-limits[band] / count)
        count = most + 2 + int(empty + 4 * sqrt(empty))
    return most, count


def tile_keys(u: np.ndarray, j: Join) -> np.ndarray:
    """The tiles of a sorted set of 64-bit hashes. Any two sets that link, but are not equal, have a tile in common.

    A band holds sets whose smaller partner has a size within a factor of 1.5; a set is also in lower bands where a smaller partner may be.
    Partners in a band differ in at most `most` elements. The hash range is cut into more parts than that, so some parts are the same in both; a
    tile is a band, a part and the sum of the elements in it. Up to 8 differences two parts of most + 2 are the same, and all pairs of
    parts are tiles, so that short sets have no tile that common phrases fill. Empty parts make no tile, but where a set has so many
    that all unchanged parts might be empty; then the same holds for its partner, as these parts are empty in both. One difference: the
    tiles are the set, and the set without each of its elements.
    """
    limits, n, out = _bands(), len(u), []
    own = bisect_right(limits, n) - 1
    whole = mix(u)
    high = u >> np.uint64(32)
    for band in range(own, -1, -1):
        top = limits[band + 1] - 1
        if band < own and 100 * top < j.percent * n:
            break
        most, count = _cut(band, j.percent)
        if not most:
            continue
        if most == 1:
            total = whole.sum(dtype=np.uint64)
            out.append(mix(np.append(total - whole, total) + mix(np.array([band << 32], np.uint64))))
            continue
        ends = np.searchsorted(high, ((np.arange(count + 1, dtype=np.uint64) << np.uint64(32)) + np.uint64(count - 1)) // np.uint64(count))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(whole, dtype=np.uint64)])
        signature = mix((total[ends[1:]] - total[ends[:-1]]) + mix(np.arange(count, dtype=np.uint64) + np.uint64(band << 32)))
        filled = ends[1:] > ends[:-1]
        if count - int(filled.sum()) >= count - most:
            filled[:] = True
        if most <= 8:
            a, b = (np.array(x) for x in zip(*combinations(range(count), 2), strict=True))
            out.append(mix(signature[a] * np.uint64(3) + signature[b])[filled[a] | filled[b]])
        else:
            out.append(signature[filled])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity_bits(u: np.ndarray, each: int = 1) -> np.ndarray:
    """A bitmap of at least 64 bits, about `each` for an element: the parity of the elements that fall on each bit."""
    size = 1 << max(6, int(each * len(u) - 1).bit_length())
    return np.packbits((np.bincount((u & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_link(na, nb, differing, percent: int):
    """Whether sets of these sizes can link if at least so many elements differ."""
    overlap = (na + nb - differing) // 2
    return 100 * overlap >= percent * (na + nb - overlap)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _sid(u: np.ndarray) -> int:
    return int.from_bytes(blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(df: DataFrame, j: Join) -> DataFrame:
    """row (a number), doc_id, th (a hash of the text), n (size of the set) and sid (a hash of the set; null if empty) of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, k, data, at in steps(batch.column(1)):
                rows = [(len(u), _sid(u)) if len(u) else (0, None) for u in shingle_sets(data, at, j.words)]
                n, sid = zip(*rows, strict=True)
                yield pa.record_batch([batch.column(0)[i:k], batch.column(2)[i:k], pa.array(n, pa.int64()), pa.array(sid, pa.int64())], ["doc_id", "th", "n", "sid"])

    return _texts(df).mapInArrow(run, "doc_id long, th long, n long, sid long").withColumn("row", F.monotonically_increasing_id())


def tiled(df: DataFrame, nodes: DataFrame, j: Join) -> DataFrame:
    """sid and keys of the nodes (node_doc, node_th, node_sid). Keys are worked out anew each time: as a table they would take half as much as the texts.

    Rows of one id and text come as often as they are there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, at in steps(batch.column(1)):
                rows = [(i + k, _sid(u), tile_keys(u, j).view(np.int64)) for k, u in enumerate(shingle_sets(data, at, j.words)) if len(u)]
                if rows:
                    place, sid, keys = zip(*rows, strict=True)
                    at_ = pa.array(place)
                    yield pa.record_batch([batch.column(0).take(at_), batch.column(2).take(at_), pa.array(sid, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "sid", "keys"])

    # The join comes before the keys where it moves no text, else after them.
    ids = nodes.select("node_doc", "node_th")
    same = F.col("doc_id").eqNullSafe(F.col("node_doc")) & (F.col("th") == F.col("node_th"))
    schema = "doc_id long, th long, sid long, keys array<long>"
    if nodes.count() <= j.broadcast:
        return _texts(df).join(F.broadcast(ids), same, "left_semi").mapInArrow(run, schema).select("sid", "keys")
    return _texts(df).mapInArrow(run, schema).join(ids, same, "left_semi").select("sid", "keys")


def _texts(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def _sets(df: DataFrame, nodes: DataFrame, j: Join) -> DataFrame:
    """sid, n, bits, wide (2 bits an element) and set of the nodes (doc_id, th, sid): made anew from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, at in steps(batch.column(0)):
                rows = []
                for k, u in enumerate(shingle_sets(data, at, j.words)):
                    if len(u) and (sid := batch.column(1)[i + k].as_py()) == _sid(u):
                        rows.append((sid, len(u), parity_bits(u).tobytes(), parity_bits(u, 2).tobytes(), u.tobytes()))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["sid", "n", "bits", "wide", "set"])

    ids = nodes.select(F.col("doc_id").alias("node_doc"), F.col("th").alias("node_th"), "sid")
    if nodes.count() <= j.broadcast:
        ids = F.broadcast(ids)
    texts = _texts(df).join(ids, F.col("doc_id").eqNullSafe(F.col("node_doc")) & (F.col("th") == F.col("node_th"))).select("text", "sid")
    return written(texts.mapInArrow(run, "sid long, n long, bits binary, wide binary, set binary").dropDuplicates(["sid"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, j: Join) -> DataFrame:
    """The pairs (a, b) of sids whose sets link. a's set meets its partners in groups of about `chunk`, streamed in order; no group is held whole."""
    pairs = written(pairs, "pairs")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / j.chunk).alias("groups"))
    salted = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").alias("salt"))
    heads = salted.select("a", "salt").distinct()
    if pairs.count() <= j.broadcast:  # then sets are dealt out once, to their groups, and not first by sid
        salted, heads = F.broadcast(written(salted, "pairs")), F.broadcast(written(heads, "pairs"))
    partner = salted.join(sets, salted.b == sets.sid).select("a", "salt", F.lit(1).alias("role"), "b", "n", "bits", "set")
    head = heads.join(sets, heads.a == sets.sid).select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "n", "bits", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            found = []
            a, role, b, n, bits, sets_ = (batch.column(i) for i in (0, 2, 3, 4, 5, 6))
            for i in range(len(batch)):
                m, w = n[i].as_py(), np.frombuffer(bits[i].as_buffer(), np.uint64)
                if role[i].as_py() == 0:
                    own = (m, w, np.frombuffer(bytes(sets_[i].as_buffer()), np.uint64))
                    continue
                size = min(len(w), len(own[1]))
                differing = int(np.bitwise_count(fold(w, size) ^ fold(own[1], size)).sum())
                if may_link(m, own[0], differing, j.percent) and linked(own[2], np.frombuffer(sets_[i].as_buffer(), np.uint64), j.percent):
                    found.append(i)
            if found:
                yield pa.record_batch([a.take(pa.array(found)), b.take(pa.array(found))], ["a", "b"])

    rows = partner.unionByName(head).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return written(rows.mapInArrow(run, "a long, b long"), "links")


def _crossing(members: DataFrame, j: Join, best: bool) -> DataFrame:
    """Pairs of sids in a common tile, of different components so far, that the bitmaps don't rule out; best: in a tile only
    each sid's best partner, that with the fewest differing bits for their sizes.

    A tile is cut into `chunks` by a hash of sid, and each pair of chunks is a task's unit of its own. Only pairs that may link leave.
    """
    chunked = members.withColumn("chunk", F.pmod(F.xxhash64("sid"), "chunks").cast("int"))
    tiles = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
    tiles = tiles.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "sid", "comp", "n", "bits")

    def within(chunk, sid, comp, n, bits) -> Iterator[tuple[int, int]]:
        size = min(map(len, bits))
        b = np.stack([fold(x, size) for x in bits])
        second = chunk != chunk[0]
        two = bool(second.any())
        least, partner = np.full(len(sid), 2.0), np.full(len(sid), -1)
        for x in range(len(sid)):
            if two and second[x]:
                break
            y = np.flatnonzero(second) if two else np.arange(x + 1, len(sid))
            y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= j.percent * np.maximum(n[y], n[x]))]
            if not len(y):
                continue
            differing = np.bitwise_count(b[y] ^ b[x]).sum(1).astype(np.int64)
            allowed = may_link(n[y], n[x], differing, j.percent)
            y, share = y[allowed], differing[allowed] / (n[y] + n[x])[allowed]
            if not best:
                yield from ((min(sid[x], z), max(sid[x], z)) for z in sid[y].tolist())
            elif len(y):
                k = int(np.argmin(share))
                if share[k] < least[x]:
                    least[x], partner[x] = share[k], y[k]
                nearer = share < least[y]
                least[y[nearer]], partner[y[nearer]] = share[nearer], x
        for x in np.flatnonzero(partner >= 0).tolist():
            yield min(sid[x], sid[partner[x]]), max(sid[x], sid[partner[x]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: list) -> set:
            if len(held) < 2:
                return set()
            _, chunk, sid, comp, n, bits = zip(*held, strict=True)
            return set(within(np.array(chunk), np.array(sid), np.array(comp), np.array(n), bits))

        held: list = []
        told: set = set()  # what this task has said already: copies meet in many tiles
        for batch in batches:
            found: set = set()
            columns = [batch.column(i).to_pylist() for i in range(7)]
            bits = [np.frombuffer(x.as_buffer(), np.uint64).copy() for x in batch.column(7)]
            for key, a, b, chunk, sid, comp, n, w in zip(*columns, bits, strict=True):
                if held and held[0][0] != (key, a, b):
                    found |= pairs(held)
                    held = []
                held.append(((key, a, b), chunk, sid, comp, n, w))
            found -= told
            told = found if len(told) > TOLD else told | found
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])
        if found := pairs(held) - told:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    rows = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "chunk")
    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, j: Join = Join()) -> DataFrame:
    """doc_id and text to doc_id, th (xxhash64 of the text), n_shingles, component_id (the smallest doc_id that can be reached by links, its own
    included) and component_th (the smallest th of the rows of that id that can be reached).

    Equal sets are one node. Each node is first compared with one pivot, that with which it shares most tiles; what links is one component.
    Then only tiles that hold several components are looked into: in a round each node meets its best partner in each of some tiles, and at
    last each pair across components that bitmaps of two bits an element allow is checked exactly. So a group of copies costs a check per
    text, and no pair is left out. Sets are named by 64-bit hashes.

    A tile that very many sets of different components share (a passage in otherwise different texts of one size) is compared by bitmaps,
    chunk by chunk over all tasks; that grows with the square of its sets.

    Null or blank texts have an empty set and link with nothing: their component is their own id. Null ids are the largest. Rows that share an
    id are rows of their own. Texts of any length are taken whole; other columns are not looked at; no rows give no rows.
    """
    spark = df.sparkSession
    bounded(spark)
    with temporary(spark):
        known = written(_placed(df, j), "known", keep=True)
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "th")
    least = known.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(place).alias("least"))
    own = F.coalesce("least", place)
    return known.join(least, "comp", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), own["doc_id"].alias("component_id"), own["th"].alias("component_th"))


def _tiles(df: DataFrame, nodes: DataFrame, j: Join) -> DataFrame:
    """sid, key and pivot (the tile's least sid) of all tiles that several of the nodes' sets share; rows without their pivots.

    Very common tiles, found by a sample of sets, have their pivots broadcast and are not shuffled; how common is set so that they are
    few. All others are sorted by key, so a tile streams through its task. Which way a tile goes makes no difference to what comes out.
    """
    placed = tiled(df, nodes, j).select("sid", F.explode("keys").alias("key"))
    some = nodes.filter(F.pmod(F.xxhash64("node_sid"), F.lit(SAMPLED)) == 0)
    drawn = written(tiled(df, some, j).select(F.explode("keys").alias("key")).groupBy("key").count(), "drawn")
    total = drawn.agg(F.sum("count")).first()[0] or 0
    common = drawn.filter("key <> 0").filter(F.col("count") > max(j.chunk // SAMPLED, total // MOST_COMMON)).select(F.col("key").alias("common"))
    # One row more (a key that hardly any tile has; if one does, it goes this way too) keeps the tables from being empty: one plan for all inputs.
    zero = df.sparkSession.range(1)
    common = F.broadcast(written(common.union(zero), "common"))
    split = placed.join(common, F.col("key") == F.col("common"), "left")
    cold, often = split.filter("common IS NULL").select("sid", "key"), split.filter("common IS NOT NULL").select("sid", "key")
    hot = often.groupBy(F.col("key").alias("hot_key")).agg(F.min("sid").alias("pivot"))
    hot = F.broadcast(written(hot.filter("hot_key <> 0").union(zero.select("id", F.lit(0).cast("long"))), "hot"))
    hot = often.join(hot, F.col("key") == F.col("hot_key")).select("sid", "key", "pivot")
    least = F.first("sid").over(Window.partitionBy("key").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    return cold.withColumn("pivot", least).unionByName(hot).filter("sid <> pivot")


def _placed(df: DataFrame, j: Join) -> DataFrame:
    """doc_id, th, n and comp (one value for each component; null without a set) of all rows."""
    spark = df.sparkSession
    with temporary(spark):
        all_rows = written(signatures(df, j), "signatures", keep=True)
        # One row stands for all with the same set; so no key is shuffled more often than there are sets.
        node = F.min_by(F.struct("doc_id", "th"), "row").alias("node")
        nodes = written(all_rows.filter("sid IS NOT NULL").groupBy("sid").agg(node).select(F.col("node.doc_id").alias("node_doc"), F.col("node.th").alias("node_th"), F.col("sid").alias("node_sid")), "nodes", keep=True)
        tiles = written(_tiles(df, nodes, j), "tiles", keep=True)
        shared = tiles.select("sid").union(tiles.select("pivot")).distinct()
        sources = written(nodes.select(F.col("node_sid").alias("sid"), F.col("node_doc").alias("doc_id"), F.col("node_th").alias("th")).join(shared, "sid", "left_semi"), "owners", keep=True)
    sets = _sets(df, sources, j)

    stars = tiles.groupBy("sid", "pivot").count().groupBy("sid").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("a")).select("a", F.col("sid").alias("b"))
    links = _verified(stars, sets, j)
    members = tiles.select("key", "sid").union(tiles.select("key", F.col("pivot").alias("sid")).distinct())
    for k in range(j.rounds + 1):
        last = k == j.rounds
        roots = components(links)
        # Best partners are looked for in some of the tiles, as like sets share many; the last round looks into all.
        some = members if last else members.filter(F.pmod(F.xxhash64("key"), F.lit(SOME)) == 0)
        placed = some.join(roots, F.col("sid") == F.col("node"), "left").select("key", "sid", F.coalesce("root", "sid").alias("comp"))
        tile = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(F.count("*") / j.chunk).alias("chunks"))
        mixed = written(placed.join(tile.filter("x < y").select("key", "chunks"), "key"), "members")
        bits = sets.select("sid", "n", F.col("wide" if last else "bits").alias("bits"))
        links = links.union(_verified(_crossing(mixed.join(bits, "sid"), j, best=not last), sets, j))
    roots = written(components(links), "roots")

    known = all_rows.join(roots, F.col("sid") == F.col("node"), "left")
    return known.select("doc_id", "th", "n", F.coalesce("root", "sid").alias("comp"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their set of 4-word shingles and their component at a similarity of 0.85."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Join(words=4, percent=85))
    return found.select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.c + q.c - k)),
both_ AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM r JOIN both_ b ON r.y = b.x)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)
""".replace("WITH w AS", "WITH RECURSIVE w AS", 1)
