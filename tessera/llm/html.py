"""Main text of web pages by a site style tree: pages of a host are merged, branches that say little are cut from each page."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from heapq import nsmallest
from html import unescape
from urllib.parse import urlsplit
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, written

# Fixed values of HTML: elements whose content is no text of the page, that have no end tag, that begin a block; what an opening tag ends.
RAW = frozenset("script style noscript template textarea iframe svg title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body caption td th tr tbody thead tfoot".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
REPEATED = frozenset("p li dd dt tr td th blockquote pre h2 h3 h4 h5 h6 figure".split())
# Fixed values of this operator: tags and names that speak against a branch, and parts of names that speak for it all the same.
DOUBTED_TAGS = frozenset("nav footer aside form button select dialog menu".split())
DOUBTED_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disclaimer"
    " footer header login menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related search share"
    " sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
# Kinds that the text never holds, whatever a host's pages show: what readers enter and what they comment.
LEFT_OUT_TAGS = frozenset("form button select dialog".split())
LEFT_OUT_NAMES = frozenset("comment comments".split())
STATES = frozenset("has with without no is not show hide open closed enabled disabled layout".split())
OF_TEXT = frozenset("article post entry story content".split())
#: Elements nested deeper than this share the place of the one at this depth.
DEEPEST = 200

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS, _DIGITS = re.compile(r"[^a-z0-9]+"), re.compile(r"\d+")
_RAW_END = {tag: re.compile(f"</{tag}[^>]*>?", re.I) for tag in RAW}


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def doubted(names: str) -> bool:
    """Whether a class, id or role speaks against a branch: `cookie-notice` does; `has-sidebar`, `comments-open` and `article-header` do not."""
    for name in names.split():
        parts = set(_PARTS.split(name))
        found = parts & DOUBTED_NAMES
        if found and not parts & STATES and not (found == {"header"} and parts & OF_TEXT):
            return True
    return False


class _Node:
    """An element. Of siblings alike in tag and class each has its own place in the tree, but paragraphs, list items and the like share one.

    paths: the places of the elements around it, its own last. doubt: its tag or name speaks against it. fixed: it is of a kind that is left out.
    size: characters of text in it.
    """

    __slots__ = ("children", "doubt", "fixed", "inside", "name", "parent", "path", "paths", "seen", "size", "tag")

    def __init__(self, tag: str, names: str, parent: _Node | None):
        self.tag, self.name, self.seen, self.parent, self.size = tag, f"{tag}.{_DIGITS.sub('0', names)}", Counter(), parent, 0
        place = 0
        if parent and tag not in REPEATED:
            place = parent.seen[self.name]
            parent.seen[self.name] += 1
        self.path = _hash(str(parent.path) if parent else "", self.name, str(place))
        self.paths = [*parent.paths, self.path] if parent else []
        self.children: list[str] = []
        self.inside = bool(parent and parent.inside) or tag in ("article", "main")
        named = tag not in ("html", "body", "main") and doubted(names)
        self.doubt = tag in DOUBTED_TAGS or named or (tag == "header" and not self.inside)
        self.fixed = tag in LEFT_OUT_TAGS or (named and not LEFT_OUT_NAMES.isdisjoint(_PARTS.split(names)))
        if parent:
            parent.children.append(self.name)


def _signed(text: str) -> int:
    return crc32(text.encode("utf-8", "replace")) - (1 << 31)


def features(text: str, most: int = 2) -> list[int]:
    """Hashes of up to `most` runs of three words of a text, the same wherever the text stands: those at its words of smallest hash; a shorter text is one."""
    words = text.split(" ")
    if len(words) < 3:
        return [_signed(text)]
    own = [crc32(w.encode("utf-8", "replace")) for w in words[:-2]]
    return sorted({_signed(" ".join(words[i : i + 3])) for i in nsmallest(most, range(len(own)), key=own.__getitem__)})


def parse(html: str) -> tuple[list[dict], list[dict]]:
    """The text blocks in page order (text, paths of the elements around it, features) and the elements (path, paths, style, inner, doubt, fixed, size).

    White space within a block is one blank; character references are decoded; an element that is never closed ends with its parent. An inline
    element whose name speaks against it is a block of its own, while the text around it goes on. style: a hash of what stands directly
    below an element. Each character is looked at a fixed number of times, whatever tags, quotes or comments are left open.
    """
    root = _Node("", "", None)
    tags, nodes, elements, blocks = [""], [root], [], []
    texts: list[list[str]] = [[]]
    opened: Counter = Counter()

    def flush() -> None:
        words = unescape("".join(texts[-1])).split()
        texts[-1].clear()
        if words:
            text, node = " ".join(words), nodes[-1]
            blocks.append({"text": text, "paths": node.paths, "features": features(text)})
            node.children.append("#")
            while node is not None:
                node.size += len(text)
                node = node.parent

    def close(k: int) -> None:
        while len(tags) > k:
            if tags[-1] not in BLOCK and len(texts) > 1:
                flush()
                texts.pop()
            nodes.pop()
            opened[tags.pop()] -= 1

    def close_inline() -> None:
        while len(texts) > 1:
            close(next(k for k in range(len(tags) - 1, 0, -1) if tags[k] not in BLOCK))

    at, plain = 0, False
    while (lt := html.find("<", at)) >= 0:
        texts[-1].append(html[at:lt])
        following = html[lt + 1 : lt + 3]
        if following[:1] in ("!", "?") or (following[:1] == "/" and not following[1:].isalpha()):
            ends = ("-->", 3) if html.startswith("<!--", lt) else (">", 1)
            end = html.find(ends[0], lt + 2)
            at = len(html) if end < 0 else end + ends[1]
            continue
        if not following.lstrip("/")[:1].isascii() or not following.lstrip("/")[:1].isalpha():
            texts[-1].append("<")
            at = lt + 1
            continue
        m = None if plain else _TAG.match(html, lt)
        if m is None:  # quotes are left open up to the end: they count as plain signs from here on
            plain = True
            m = _PLAIN.match(html, lt)
        if m is None:
            at = len(html)
            break
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in BLOCK:
                if not opened[tag]:
                    flush()
                    continue
                close_inline()
                flush()
            if opened[tag]:
                for k in range(len(tags) - 1, 0, -1):
                    if tags[k] == tag:
                        close(k)
                        break
                    if tag not in BLOCK and tags[k] in BLOCK:
                        break
            continue
        if tag == "br":
            texts[-1].append(" ")
            continue
        if tag in BLOCK:
            close_inline()
            flush()
            ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] in ends:
                    close(k)
                    break
                if tags[k] in BLOCK and tags[k] not in ("p", *ends):
                    break
        if tag in RAW and not m[3].endswith("/"):
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])).lower() if m[3] else ""
        if tag in BLOCK or tag in DOUBTED_TAGS or (names and doubted(names)):
            node = nodes[-1]
            if len(nodes) < DEEPEST:
                node = _Node(tag, names, node)
                elements.append(node)
            elif tag not in BLOCK:
                continue
            tags.append(tag)
            nodes.append(node)
            opened[tag] += 1
            if tag not in BLOCK:
                texts.append([])
    if html[at:]:
        texts[-1].append(html[at:])
    close_inline()
    flush()
    merged: dict[tuple, dict] = {}
    for n in elements:
        style = _hash(*n.children) if n.children else 0
        inner = bool(n.children) and n.children != ["#"]
        own = merged.setdefault((n.path, style), {"path": n.path, "paths": n.paths, "style": style, "inner": inner, "doubt": n.doubt, "fixed": n.fixed, "size": 0})
        own["size"] += n.size
    return blocks, [merged[k] for k in sorted(merged)]


@dataclass(frozen=True)
class Tree:
    """least: pages with an element from which the trees' evidence about it counts; weight: share of presentation in an inner element's importance;
    cut: importance in its host's tree below which a branch goes; spread and doubted: the least spread (see evidence) of a branch that stays, without
    and with a tag or name that speaks against it; prior: what such a name says of the spread, and names: for how many pages' evidence that counts;
    most: share of its pages' text beyond which a name says nothing; broadcast: branches that are broadcast at most.
    """

    least: int = 8
    weight: float = 0.5
    cut: float = 0.25
    spread: float = 0.5
    doubted: float = 0.8
    prior: float = 0.2
    names: float = 50
    most: float = 0.75
    broadcast: int = 100_000


def evidence(parsed: DataFrame, places: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """path, pages and own (0 to 1) of every place in the tree of all hosts: one minus the mean entropy of its features, to the base of its pages.

    A feature (a run of three words) that one page has counts 0 of entropy, one that all pages have there counts 1; so menus and advertisements,
    however many different ones there are, come out low, and articles near 1. Pages with the same longest text are copies and count once.
    places: path and paths.
    """
    log = lambda n: F.log(n.cast("double"))
    pages = parsed.select("copy", F.explode(F.array_distinct(F.transform("nodes", lambda n: n["path"]))).alias("path")).distinct().groupBy("path").agg(F.count("*").alias("pages"))
    leaf = parsed.select("copy", F.explode("blocks").alias("b")).select("copy", F.try_element_at("b.paths", F.lit(-1)).alias("path"), F.explode("b.features").alias("f")).filter("path IS NOT NULL")
    spread = leaf.distinct().groupBy("path", "f").agg(F.count("*").alias("c")).groupBy("path").agg(F.sum("c").alias("n"), F.sum(F.col("c") * log(F.col("c"))).alias("s"))
    here = spread.join(pages, "path").join(places, "path").select("n", F.when(F.col("pages") > 1, F.col("s") / log(F.col("pages"))).otherwise(0.0).alias("h"), F.explode("paths").alias("path"))
    around = here.groupBy("path").agg((1 - F.sum("h") / F.sum("n")).alias("own"))
    own = F.when(F.col("pages") >= tree.least, F.coalesce("own", F.lit(1.0))).otherwise(1.0)
    return pages.join(around, "path", "left").select("path", "pages", own.alias("own"))


def importance(parsed: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """host, path, importance and named (a tag or name took part in it) of every element of the hosts' style trees.

    Presentation: the entropy, to the base of the number of pages, of what stands directly below the element. Content: over the texts below
    it, one minus the share of the host's other pages that have this text there, so what every page repeats counts 0 on hosts of any size.
    Elements that hold only text count by content alone.

    A host may have too few pages to show that its noise comes from a small stock; the tree of all hosts says so (see evidence). A name that speaks
    against an element is worth the evidence of some pages and asks for more spread: it decides where pages are few or the spread is middling. An
    element whose spread is too small is below the cut, and so is all in it if its name took part. Kinds that are left out always are, unless they hold most of their pages' text.
    """
    log = lambda n: F.log(n.cast("double"))
    elements = parsed.select("host", "chars", F.explode("nodes").alias("n")).select("host", "chars", "n.*")
    style = elements.groupBy("host", "path", "style").agg(
        F.count("*").alias("c"), F.max("inner").alias("inner"), F.max("doubt").alias("doubt"), F.max("fixed").alias("fixed"), F.first("paths").alias("paths"),
        F.sum("size").alias("size"), F.sum("chars").alias("chars"),
    )
    shape = style.groupBy("host", "path").agg(
        F.sum("c").alias("pages"), F.sum(F.col("c") * log(F.col("c"))).alias("s"), F.max("inner").alias("inner"), F.max("doubt").alias("doubt"), F.max("fixed").alias("fixed"),
        F.first("paths").alias("paths"), (F.sum("size") / F.greatest(F.sum("chars"), F.lit(1))).alias("mass"),
    )
    shape = written(shape, "shape")
    known = evidence(parsed, shape.groupBy("path").agg(F.first("paths").alias("paths")), tree).select("path", F.col("pages").alias("n"), "own")
    says = F.col("doubt") & (F.col("mass") <= tree.most)  # its name speaks against it
    weighed = (F.col("n") * F.col("own") + tree.names * tree.prior) / (F.col("n") + tree.names)
    shown = F.when(says & F.col("fixed"), tree.prior).when(says, weighed).otherwise(F.col("own"))
    needed = F.when(says, tree.doubted).otherwise(tree.spread)
    shape = written(shape.join(known, "path").withColumns({"trust": F.least(F.lit(1.0), shown / needed), "says": says}), "shape")
    doubts = shape.filter("says AND trust < 1").select("host", F.col("path").alias("around"), "trust")
    below = shape.select("host", "path", F.explode("paths").alias("around")).join(doubts, ["host", "around"])
    trust = below.groupBy("host", "path").agg(F.min("trust").alias("least"))

    own = F.array_distinct(F.transform("blocks", lambda b: F.struct(b["paths"].alias("paths"), F.xxhash64(b["text"]).alias("content"))))
    leaf = parsed.select("host", F.explode(own).alias("b")).groupBy("host", F.col("b.paths").alias("paths"), F.col("b.content").alias("content"))
    hosts = parsed.groupBy("host").agg(F.count("*").alias("of"))
    repeated = F.col("c") * (F.col("c") - 1) / F.greatest(F.col("of") - 1, F.lit(1))
    texts = leaf.agg(F.count("*").alias("c")).join(hosts, "host").select("host", F.explode("paths").alias("path"), "c", repeated.alias("r"))
    texts = texts.groupBy("host", "path").agg(F.sum("c").alias("t"), F.sum("r").alias("r"))

    share = lambda s, n: F.when(n > 1, F.greatest(F.lit(0.0), 1 - s / n / log(n))).otherwise(1.0)
    presentation, content = share(F.col("s"), F.col("pages")), F.coalesce(1 - F.col("r") / F.col("t"), F.lit(0.0))
    seen = F.when(F.col("inner"), tree.weight * presentation + (1 - tree.weight) * content).otherwise(content)
    seen = F.when(F.col("pages") >= tree.least, seen).otherwise(1.0)
    joined = shape.join(texts, ["host", "path"], "left").join(trust, ["host", "path"], "left")
    factor = F.least("trust", F.coalesce("least", F.lit(1.0)))
    return joined.select("host", "path", F.when(factor < 1, seen * tree.cut * factor).otherwise(seen).alias("importance"), F.col("least").isNotNull().alias("named"))


def low_branches(parsed: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """host, path and named of the deepest elements below the cut: those around an element at or above it are not among them."""
    known = written(importance(parsed, tree), "importance")
    high = known.filter(F.col("importance") >= tree.cut).select("host", "path")
    chains = parsed.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["paths"]))).alias("paths")).distinct()
    placed = chains.select("host", "paths", F.posexplode("paths").alias("at", "path")).join(high, ["host", "path"])
    around = placed.select("host", F.explode(F.slice("paths", F.lit(1), F.col("at"))).alias("path")).distinct()
    return known.filter(F.col("importance") < tree.cut).select("host", "path", "named").join(around, ["host", "path"], "left_anti")


def extract(df: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """page_id, url and html to page_id, url, text (blocks joined by line ends) and n_chars.

    A branch goes if its importance is below the cut and nothing important lies in it, in article and main as elsewhere. Where pages are few,
    tags and names count for more than what the trees show. A page of which nothing would be left (a copy) loses only branches whose name took part. Null html is an empty page; pages without url are one host;
    repeated rows each give a row; other columns are not looked at; no rows give no rows. Pages of any length are parsed whole in linear
    time; elements deeper than 200 levels count as part of the one at that level.
    """
    spark = df.sparkSession
    bounded(spark)
    block = pa.struct([("text", pa.string()), ("paths", pa.list_(pa.int64())), ("features", pa.list_(pa.int32()))])
    node = pa.struct(
        [("path", pa.int64()), ("paths", pa.list_(pa.int64())), ("style", pa.int64()), ("inner", pa.bool_()), ("doubt", pa.bool_()), ("fixed", pa.bool_()), ("size", pa.int64())]
    )

    def host(url: str | None) -> str:
        try:
            return (urlsplit(url or "").hostname or "").lower()
        except ValueError:
            return ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                got = [parse(x or "") for x in part.column(2).to_pylist()]
                hosts = [host(u) for u in part.column(1).to_pylist()]
                chars = [sum(len(x["text"]) for x in b) for b, _ in got]
                copies = [_hash(max((x["text"] for x in b), key=lambda t: (len(t), t), default="")) for b, _ in got]
                columns = [pa.array(hosts, pa.string()), pa.array(copies, pa.int64()), pa.array(chars, pa.int64()), pa.array([b for b, _ in got], pa.list_(block)), pa.array([n for _, n in got], pa.list_(node))]
                yield pa.record_batch([part.column(0), part.column(1), *columns], ["page_id", "url", "host", "copy", "chars", "blocks", "nodes"])

    pages = df.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    dom = pages.mapInArrow(
        run,
        "page_id long, url string, host string, copy long, chars long, blocks array<struct<text:string,paths:array<long>,features:array<int>>>,"
        " nodes array<struct<path:long,paths:array<long>,style:long,inner:boolean,doubt:boolean,fixed:boolean,size:long>>",
    )
    parsed = written(dom.withColumn("row", F.monotonically_increasing_id()), "dom")
    low = written(low_branches(parsed, tree), "noise")
    texts = parsed.select("row", "page_id", "url", "host", "blocks")
    if low.count() <= tree.broadcast:
        by_host = low.groupBy("host").agg(F.collect_list("path").alias("low"), F.collect_list(F.when(F.col("named"), F.col("path"))).alias("named"))
        joined = texts.join(F.broadcast(by_host), "host", "left")
    else:  # each page meets only its own low branches
        own = parsed.select("row", "host", F.explode(F.array_distinct(F.flatten(F.transform("blocks", lambda b: b["paths"])))).alias("path"))
        by_page = own.join(low, ["host", "path"]).groupBy("row").agg(F.collect_list("path").alias("low"), F.collect_list(F.when(F.col("named"), F.col("path"))).alias("named"))
        joined = texts.join(by_page, "row", "left")
    none = F.array().cast("array<bigint>")
    outside = lambda c: F.filter("blocks", lambda b: ~F.arrays_overlap(b["paths"], F.coalesce(c, none)))
    kept = outside("low")
    stays = F.when(F.size(kept) > 0, kept).otherwise(outside("named"))
    text = F.array_join(F.transform(stays, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
