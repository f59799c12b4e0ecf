"""HTML extraction, media columns, chat formatting, packing, archives and the pipeline: round trips, brute force, odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import time
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, html, media, packing, warc
from tessera.llm.queries import ORACLE_SQL, QUERIES
from tessera.llm.tokens import default_path, token_ids

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def norm(rows) -> list:
    return sorted(tuple(str(r[c]) for c in sorted(r.keys())) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = [r.asDict() for r in QUERIES[name](spark, SMALL).collect()]
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert norm(got) == norm(dict(zip(names, r, strict=True)) for r in cursor.fetchall())


# html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Home</a><li>News</ul></nav><div class="ad">Buy</div>
<article><h1>Big &amp; small</h1><p>One <b>bold
 text<br>line<p>Two&nbsp;&eacute; &#8364;<div class="cookie-notice">We use cookies</div><table><tr><td>c1<td>c2</table>
<section id="comments"><p>first!</section><form>Search <input name=q></form></article>
<aside>Related</aside><footer>&copy; us</footer>"""


def test_blocks_of_a_page():
    blocks, nodes = html.parse(PAGE)
    doubt = {n["path"] for n in nodes if n["doubt"]}
    assert [b["text"] for b in blocks if not doubt & set(b["paths"])] == ["Big & small", "One bold text line", "Two é €", "c1", "c2"]
    for broken in ("", "<", "<p", "a<b", "</p></x>", "<!-- x", "<script>x", "<p><p></div>t", "<ul><li>a<li>b</ul>c", "<p class='x>y'>t</p>"):
        html.parse(broken)
    assert [b["text"] for b in html.parse("<ul><li>a<li>b</ul>c<p>d")[0]] == ["a", "b", "c", "d"]
    assert [b["text"] for b in html.parse("a < b <1 </ >c <é>")[0]] == ["a < b <1 c <é>"]


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, '<a ">"' * 100_000, "<ul>" * 50_000 + "</ol>" * 50_000, "<!--" * 200_000, "<p><span class=ad>" * 20_000, "<div>x" * 30_000, "<p class='" * 90_000],
)
def test_open_tags_and_quotes_take_linear_time(page):
    start = time.process_time()
    html.parse(page)
    assert time.process_time() - start < 3


def texts_of(spark, pages: list[tuple]) -> dict:
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}


def test_wrappers_whose_names_look_doubtful_keep_their_text(spark):
    body = "<h1>Head {0}</h1><p>First {0}</p><p>x {0} <math><mi>y</mi></math> z</p>"
    wrappers = [
        "<body class='has-sidebar'><div>{}</div></body>",
        "<body><main class='with-sidebar'>{}</main></body>",
        "<body><article class='post comments-open'>{}</article></body>",
        "<body><article><div class='article-header'><h1>Head {0}</h1></div><p>First {0}</p><p>x {0} <math><mi>y</mi></math> z</p></article></body>",
        "<body><div class='notice'>{}</div><footer>by us</footer></body>",  # a doubted name overruled, as nearly all text is in it
    ]
    pages = [(100 * k + i, f"http://w{k}.test/{i}", w.format(i) if "{0}" in w else w.format(body.format(i))) for k, w in enumerate(wrappers) for i in range(12)]
    out = texts_of(spark, pages)
    assert all(t == f"Head {i % 100}\nFirst {i % 100}\nx {i % 100} y z" for i, t in out.items())


def test_each_branch_is_cut_by_importance_alone(spark):
    rows = "".join(f"<tr><td>row {k}</td></tr>" for k in range(4))
    page = (
        "<body><div class='a1'><div>Home</div><div>News</div></div><div class='a2'><table>{1}</table><p>Text {0} of the page</p><p>More {0} words</p>"
        "<div class='a3'>Share this text</div></div><div class='a4'><p>All rights reserved</p></div></body>"
    )
    pages = [(i, f"http://plain.test/{i}", page.format(i, rows)) for i in range(20)]
    want = {i: f"Text {i} of the page\nMore {i} words" for i in range(20)}
    assert texts_of(spark, pages) == want
    uncut = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), html.Tree(cut=0.0)).collect()
    assert all(r.text.startswith("Home\nNews\nrow 0") and r.text.endswith("reserved") for r in uncut)
    named = [(i, f"http://named.test/{i}", f"<article><h1>Head {i}</h1><p>Text {i} goes on</p><p>Buy <span class='ad'>now {i}</span> here</p></article><nav>n {i}</nav>") for i in range(20)]
    assert texts_of(spark, named) == {i: f"Head {i}\nText {i} goes on\nBuy here" for i in range(20)}


def brute_texts(pages: list[tuple], tree: html.Tree) -> dict:
    """The same trees in plain Python: that of all hosts, then host by host."""
    hosts = defaultdict(list)
    for key, url, page in pages:
        hosts[(urlsplit(url or "").hostname or "").lower()].append((key, *html.parse(page or "")))
    seen_on, features, chain = defaultdict(set), defaultdict(set), {}
    for _, blocks, nodes in (x for group in hosts.values() for x in group):
        copy = max((b["text"] for b in blocks), key=lambda t: (len(t), t), default="")
        for n in nodes:
            seen_on[n["path"]].add(copy)
            chain[n["path"]] = n["paths"]
        for b in blocks:
            for f in b["features"] if b["paths"] else ():
                features[b["paths"][-1], f].add(copy)
    weight, entropy = Counter(), Counter()
    for (p, _), copies in features.items():
        for q in chain[p]:
            weight[q] += len(copies)
            entropy[q] += len(copies) * math.log(len(copies)) / math.log(len(seen_on[p])) if len(seen_on[p]) > 1 else 0
    spread = {p: 1 - entropy[p] / weight[p] if len(on) >= tree.least and weight[p] else 1 for p, on in seen_on.items()}
    out = {}
    for group in hosts.values():
        styles, info, own, every = defaultdict(Counter), {}, Counter(), Counter()
        leaves = Counter()
        for _, blocks, nodes in group:
            size = sum(len(b["text"]) for b in blocks)
            for n in nodes:
                p = n["path"]
                styles[p][n["style"]] += 1
                inner, doubt, fixed, _ = info.get(p, (False, False, False, ()))
                info[p] = inner or n["inner"], doubt or n["doubt"], fixed or n["fixed"], n["paths"]
                own[p] += n["size"]
                every[p] += size
            leaves.update({(tuple(b["paths"]), b["text"]) for b in blocks})
        t, r = Counter(), Counter()
        for (paths, _), c in leaves.items():
            for p in paths:
                t[p] += c
                r[p] += c * (c - 1) / max(1, len(group) - 1)
        trust, spoken = {}, set()
        for p, (_, doubt, fixed, _) in info.items():
            mass = own[p] / max(1, every[p])
            says, n = doubt and mass <= tree.most, len(seen_on[p])
            weighed = (n * spread[p] + tree.names * tree.prior) / (n + tree.names)
            trust[p] = min(1, (tree.prior if fixed else weighed) / tree.doubted if says else spread[p] / tree.spread)
            spoken |= {p} if says and trust[p] < 1 else set()
        value, by_name = {}, {}
        for p, (inner, _, _, paths) in info.items():
            n = sum(styles[p].values())
            looks = max(0, 1 - sum(c * math.log(c) for c in styles[p].values()) / n / math.log(n)) if n > 1 else 1
            says = 1 - r[p] / t[p] if t[p] else 0
            doubts = [q for q in paths if q in spoken]
            by_name[p] = bool(doubts)
            factor = min([trust[p], *(trust[q] for q in doubts)])
            value[p] = (1 if n < tree.least else tree.weight * looks + (1 - tree.weight) * says if inner else says) * (tree.cut * factor if factor < 1 else 1)
        around = {q for paths, _ in leaves for k, p in enumerate(paths) if value[p] >= tree.cut for q in paths[: k + 1]}
        low = {p for p in value if value[p] < tree.cut and p not in around}
        named = {p for p in low if by_name[p]}
        for key, blocks, _ in group:
            left = [b["text"] for b in blocks if not low & set(b["paths"])] or [b["text"] for b in blocks if not named & set(b["paths"])]
            out[key] = "\n".join(left)
    return out


def test_style_tree_against_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    rng = random.Random(2)
    for i in range(300):  # layouts with and without names, repeated and own texts
        text = lambda k: f"<p>{rng.choice(['same words', f'own {i} {k}', 'often'])}</p>"  # noqa: B023, E731
        parts = "".join(f"<div class='{rng.choice(['x', 'comments', 'y sidebar', 'z'])}'>{''.join(text(k) for k in range(rng.randint(0, 4)))}</div>" for _ in range(rng.randint(0, 5)))
        pages.append((10_000 + i, f"http://r{i % 7}.test/", rng.choice(["<body>{}</body>", "<article>{}</article>", "<div>{}<footer>f</footer></div>"]).format(parts)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    for tree in (html.Tree(), html.Tree(broadcast=0, cut=0.4), html.Tree(names=0, spread=0.75), html.Tree(least=10**9)):
        assert {r.page_id: r.text for r in html.extract(df, tree).collect()} == brute_texts(pages, tree)


def test_the_trees_decide_and_names_only_where_they_are_in_doubt(spark):
    """A stock of 12 texts on 300 pages of 30 hosts goes without any name; texts of their own stay, whatever the element is called; on few pages the name decides."""
    rng = random.Random(3)
    own = lambda i, k: " ".join(rng.choice("bcdfg") + str(rng.randint(0, 9999)) for _ in range(30)) + f" {i} {k}"
    stock = [own(k, "stock") for k in range(12)]
    page = lambda i, extra, name: f"<body><div class='{name}'>{extra}</div><div class='x'><h1>Head {own(i, 1)}</h1><p>{own(i, 2)}</p></div></body>"
    url = lambda i: f"http://s{i % 30}.test/{i}"

    def kept(n, extra, name, tree=html.Tree()):
        rows = [(i, url(i), page(i, extra(i), name)) for i in range(n)]
        out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), tree).collect()
        assert all("Head" in r.text and len(r.text) > 300 for r in out)
        return sum(len(r.text.split("\n")) == 3 for r in out) / n

    from_stock, unique = lambda i: rng.choice(stock), lambda i: own(i, 0)
    assert kept(300, from_stock, "q") == 0  # no name speaks against it
    assert kept(300, unique, "q") == 1
    assert kept(300, from_stock, "ad") == 0 and kept(300, unique, "ad") == 1
    assert kept(300, from_stock, "ad", html.Tree(least=10**9)) == 1  # the trees off: the name alone is too little
    assert kept(20, unique, "ad") == 0 and kept(20, unique, "q") == 1
    assert kept(300, unique, "reader-comments") == 0


def test_on_the_bundled_pages_the_trees_need_no_names(spark):
    """The largest table: menus and footers go by what the trees show; without the trees all pages keep them."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    texts = lambda tree: {r.page_id: r.text for r in html.extract(pages, tree).collect()}
    with_names, without, off = texts(html.Tree()), texts(html.Tree(names=0, spread=0.6, doubted=0.6)), texts(html.Tree(least=10**9))
    assert with_names == without
    assert sum(with_names[i] != off[i] for i in off) == len(off)


def test_style_tree_cuts_what_a_host_repeats(spark):
    rng = random.Random(0)
    pages = [(i, "http://h.example/p", f"<body><div>Same words everywhere</div><div>{''.join(f'<p>{rng.random()}</p>' for _ in range(1 + i % 4))}</div></body>") for i in range(40)]
    pages += [(100, None, None), (101, "http://[bad", ""), (102, "http://one.example/", "<div>Same words everywhere</div>"), (102, "http://one.example/", "<div>Same words everywhere</div>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("text", F.lit(1))
    rows = html.extract(df).collect()
    assert len(rows) == 44
    by = defaultdict(list)
    for r in rows:
        by[r.page_id].append(r)
        assert r.n_chars == len(r.text)
    assert "Same" not in "".join(by[i][0].text for i in range(40)) and all(by[i][0].text for i in range(40))
    assert by[100][0].text == "" and [r.text for r in by[102]] == ["Same words everywhere"] * 2
    assert html.extract(df.limit(0)).count() == 0


def test_html_of_a_large_host_without_article(spark):
    links = "".join(f"<div class='m'><div>link {k}</div></div>" for k in range(16))
    paragraphs = lambda i: "".join(f"<div>page {i} says {k}</div>" for k in range(6))
    page = lambda i: f"<html><body><div class='menu-x'>{links}</div><div class='t'>{paragraphs(i)}</div></body></html>"
    article = lambda i: f"<html><body><main><div class='s'><div>share this</div></div><div class='t'>{paragraphs(i)}</div></main></body></html>"
    copies = [(5000 + i, f"https://copies.test/{i}", page(9)) for i in range(40)]
    pages = [(i, f"https://div.test/{i}", page(i)) for i in range(1200)] + [(2000 + i, f"https://main.test/{i}", article(i)) for i in range(20)] + copies
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    want = lambda i: "\n".join(f"page {i} says {k}" for k in range(6))
    assert all(out[i] == want(i) for i in range(1200))
    assert all(out[2000 + i] == want(i) for i in range(20))
    assert all(want(9) in out[5000 + i] for i in range(40))


# media


def tiff(pages: list[dict], order: str = "<") -> bytes:
    """A small TIFF writer for tests: each page has an array, a compression, strips or tiles, a predictor."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for p in pages:
        a = p["array"]
        h, w, n = a.shape
        tile = p.get("tile")
        rows = p.get("rows", h)
        blocks = []
        for plane in range(n if p.get("planar") == 2 else 1):
            b = a[:, :, plane : plane + 1] if p.get("planar") == 2 else a
            if tile:
                full = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile, b.shape[2]), a.dtype)
                full[:h, :w] = b
                blocks += [full[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
            else:
                blocks += [b[y : y + rows] for y in range(0, h, rows)]
        if p.get("predictor") == 2:
            blocks = [np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(a.dtype) for b in blocks]
        pack = {1: bytes, 8: zlib.compress, 32773: media.packbits_encode, 5: lzw_encode}[p["compression"]]
        data = [pack(b.astype(a.dtype.newbyteorder(order)).tobytes()) for b in blocks]
        at = []
        for d in data:
            at.append(len(out))
            out += d
        fields = {256: (4, [w]), 257: (4, [h]), 258: (3, [a.dtype.itemsize * 8] * n), 259: (3, [p["compression"]]), 277: (3, [n]), 284: (3, [p.get("planar", 1)]), 317: (3, [p.get("predictor", 1)])}
        fields |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, at), 325: (4, list(map(len, data)))} if tile else {273: (4, at), 278: (4, [rows]), 279: (4, list(map(len, data)))}
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            raw = struct.pack(f"{order}{len(values)}{'I' if kind == 4 else 'H'}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw
                raw = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    bits, table, width, word = [], {bytes([i]): i for i in range(256)}, 9, b""
    size = 258

    def put(code):
        bits.append(format(code, f"0{width}b"))

    put(256)
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        put(table[word])
        table[word + bytes([byte])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([byte])
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_tiff_variants_round_trip():
    rng = np.random.default_rng(0)
    for order in "<>":
        for kind in (np.uint8, np.uint16):
            for compression in (1, 5, 8, 32773):
                for extra in ({}, {"rows": 7}, {"tile": 16}, {"tile": 16, "planar": 2}, {"rows": 5, "predictor": 2}):
                    a = rng.integers(0, 4 if compression != 8 else 250, (37, 21, 3)).astype(kind)
                    pages = [{"array": a, "compression": compression, **extra}, {"array": a[:5, :9, :1], "compression": compression}]
                    got = [media.page(d) for d in media.directories(tiff(pages, order))]
                    assert np.array_equal(got[0], a) and np.array_equal(got[1], a[:5, :9, :1])
    long = rng.integers(0, 3, 90_000).astype(np.uint8).tobytes()
    assert media.lzw_decode(lzw_encode(long)) == long


def test_tiff_rows_and_broken_files(spark):
    a = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    good = tiff([{"array": a, "compression": 8}, {"array": a[:2], "compression": 5}])
    df = spark.createDataFrame([(1, bytearray(good)), (1, bytearray(good)), (2, None), (3, bytearray(b"no")), (4, bytearray(good[:40])), (5, bytearray(b""))], "id long, media binary").withColumn("width", F.lit("clash"))
    rows = media.read_tiff(df).collect()
    assert [(r.id, r.page_no) for r in rows] == [(1, 0), (1, 1), (1, 0), (1, 1), (2, None), (3, None), (4, None), (5, None)]
    assert bytes(rows[0].image) == a.tobytes() and rows[1].payload_sha256 == hashlib.sha256(a.tobytes() + a[:2].tobytes()).hexdigest()
    assert all(r.error for r in rows if r.page_no is None)
    assert media.read_tiff(df.limit(0)).count() == 0


def with_field(data: bytes, tag: int, value: int, kind: int = 4) -> bytes:
    """The file with a field of its first directory set to one value."""
    out = bytearray(data)
    (at,) = struct.unpack_from("<I", out, 4)
    for k in range(struct.unpack_from("<H", out, at)[0]):
        if struct.unpack_from("<H", out, at + 2 + 12 * k)[0] == tag:
            struct.pack_into("<HII", out, at + 4 + 12 * k, kind, 1, value)
    return bytes(out)


def test_impossible_directories_are_one_row_each(spark):
    a = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    good, tiles = tiff([{"array": a, "compression": 8}]), tiff([{"array": a, "compression": 5, "tile": 16}])
    bad = [with_field(good, t, v) for t in (256, 257, 258, 277, 278) for v in (0, 7, 2**31, 2**32 - 1) if (t, v) not in ((278, 7), (278, 2**31), (278, 2**32 - 1))]
    bad += [with_field(tiles, t, v) for t in (322, 323) for v in (0, 2**31)] + [with_field(good, 259, 99), with_field(good, 317, 9), with_field(good, 317, 3), with_field(good, 273, 10**9)]
    bomb = tiff([{"array": np.zeros((1000, 1000, 3), np.uint8), "compression": 8}])
    bad.append(with_field(with_field(bomb, 256, 10), 257, 10))  # a readable page: only as many bytes are unpacked as it has
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(bad)], "id long, media binary")
    rows = media.read_tiff(df).collect()
    assert sorted(r.id for r in rows if r.page_no is None) == list(range(len(bad) - 1)) and len(rows) == len(bad)
    for kind in (np.float32, np.int16):
        image = np.linspace(-50, 50, 96).astype(kind).reshape(8, 4, 3)
        raw = tiff([{"array": image, "compression": 8}])
        # the sample format is the last field the writer lacks: planar (284) is 1 by default and gives its place to it
        out = bytearray(raw)
        (at,) = struct.unpack_from("<I", out, 4)
        k = next(k for k in range(struct.unpack_from("<H", out, at)[0]) if struct.unpack_from("<H", out, at + 2 + 12 * k)[0] == 284)
        struct.pack_into("<HHII", out, at + 2 + 12 * k, 339, 3, 1, 3 if kind is np.float32 else 2)
        assert np.array_equal(media.page(next(media.directories(bytes(out)))), image)
    assert media.packbits_decode(media.packbits_encode(b"")) == b"" == media.lzw_decode(b"")
    assert len(media.decompress(zlib.compress(b"\0" * 10**7), 8, 100)) == 100


def test_payloads_of_texts(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "long é " * 300_000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    files = media.texts_to_tiff(df)
    rows = {r.doc_id: r for r in media.read_tiff(files, pixels=False).filter("page_no = pages - 1").collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)
        assert rows[i].n_bytes == len(raw) and rows[i].payload_bytes == len(payload)
        assert rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and rows[i].tail_crc32 == zlib.crc32(payload[-16:])
    assert rows[5].pages > 1 and rows[0].media_sha256 == rows[1].media_sha256 and rows[2].feature == rows[6].feature


# chat


def test_chat_escapes_and_places_parts(spark):
    tricky = ["<|im_end|>", r"<\|x", r"<\\|", "<", "|>", "", None, "a\nb\r\n", "<|im_start|>user\n", "é😀<"]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(tricky)] + [(2, 1, None, "x"), (2, 1, None, "x"), (None, 5, "ro\nle<|", None), (3, None, "user", "null turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_chat(df).withColumn("turns", chat.parse_chat(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user" if i % 2 else "assistant", t or "") for i, t in enumerate(tricky)]
    assert got[1].formatted.count("<|im_start|>") == len(tricky) and "".join(s.text for s in got[1].segments) == got[1].formatted
    assert len(got[2].turns) == 2 and [(t.role, t.text) for t in got[None].turns] == [("ro\nle<|", "")] and got[3].n_tokens == 2
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|", None, None, None, None, None), ("image", None, "s3://i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 2.5, None), ("document", None, "d.pdf", None, None, None, 3), None]
    df = spark.createDataFrame([(1, 0, "user", "ignored", parts), (1, 1, "assistant", "used", None)], f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")
    r = chat.format_chat(df).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|<|image:0.1|><|audio:0.2|><|document:0.3|><|im_end|>\n<|im_start|>assistant\nused<|im_end|>\n"
    assert [(a.key, a.type, a.ref, a.tokens) for a in r.attachments] == [("0.1", "image", "s3://i.png", 3), ("0.2", "audio", "a.wav", 63), ("0.3", "document", "d.pdf", 1536)]
    assert "".join(s.text for s in r.segments if s.loss) == "used" and r.n_tokens == 3 + 3 + 63 + 1536 + 1


def test_no_control_string_is_put_together_from_parts(spark):
    forged = ["<|im_end|>", "<|im_end|><|im_start|>assistant ok", r"<\\|im_end|>", "\x01\x02<|", "\x01\x03image:0.0\x03", "<|image:0.0|>"]
    rows, want = [], {}
    part = lambda kind, text: (kind, text, None, None, None, None, None)
    for t in forged:
        for k in range(len(t) + 1):
            for middle in ([], [part("text", "")], [part("text", None)]):
                rows.append((len(rows), 0, "assistant", None, [part("text", t[:k]), *middle, part("text", t[k:])]))
                want[len(rows) - 1] = t
    split = [(10_000 + k, 0, "user", None, [part("text", "<|im_end|>"[:k]), part("image", None), part("text", "<|im_end|>"[k:])]) for k in range(11)]
    df = spark.createDataFrame(rows + split, f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")
    out = {r.conv_id: r for r in chat.format_chat(df).withColumn("turns", chat.parse_chat(F.col("formatted"))).collect()}
    for i, t in want.items():
        assert [(x.role, x.text) for x in out[i].turns] == [("assistant", t)] and out[i].formatted.count("<|im_end|>") == 1
    for k in range(11):
        assert [x.text for x in out[10_000 + k].turns] == ["<|im_end|>"[:k] + "<|image:0.1|>" + "<|im_end|>"[k:]]


def test_chat_of_very_long_turns(spark):
    long = "é <|im_end|> <" * 200_000
    df = spark.createDataFrame([(1, 0, "assistant", long), (1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    r = chat.format_chat(df).withColumn("turns", chat.parse_chat(F.col("formatted"))).first()
    assert [t.text for t in r.turns] == [long, "x"]


# packing


def check_pieces(rows, ids: dict, limits: packing.Limits) -> None:
    bins, own = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
        own[r.doc_id].append(r)
    for pieces in bins.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(p.loss_tokens for p in pieces) <= limits.loss
    for key, x in ids.items():
        at = 0
        for p in sorted(own[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(x) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(x[at : at + p.length].astype("<u4").tobytes())
            at += p.length
        assert at == len(x)


def test_packing_keeps_all_ids_and_limits(spark):
    rng = random.Random(0)
    texts = [None, "", "a", "<|endoftext|> b", *(" ".join(rng.choice(["alpha", "be", "ta, ", "x1\n"]) for _ in range(int(rng.paretovariate(0.7)) % 4000 + 1)) for _ in range(400))]
    df = spark.createDataFrame([(i, t, rng.randint(0, 40)) for i, t in enumerate(texts)], DOCS + ", chars int").coalesce(2)
    ids = {i: np.append(token_ids(t or "", default_path()), np.uint32(0)) for i, t in enumerate(texts)}
    rows = packing.pack(df.withColumn("start", F.lit("clash")).withColumn("prompt_tokens", F.lit("clash"))).collect()
    check_pieces(rows, ids, packing.Limits())
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r.length)
    assert sum(sum(b) < 1024 and len(b) < 256 for b in bins.values()) <= 2  # one a task
    for tight in (packing.Limits(tokens=256, segments=4, loss=200, pool=64), packing.Limits(tokens=64, segments=8, loss=1, pool=8), packing.PRODUCTION):
        rows = packing.pack(df, limits=tight, prompt_chars=F.col("chars")).collect()
        check_pieces(rows, ids, tight)
        loss = {i: len(x) - (len(token_ids(t[:c], default_path())) if t and c else 0) for (i, x), t, c in zip(ids.items(), texts, [r.chars for r in df.collect()], strict=True)}
        own = Counter()
        for r in rows:
            own[r.doc_id] += r.loss_tokens
        assert own == Counter(loss)
    assert packing.pack(df.limit(0)).count() == 0
    twice = packing.pack(df.filter("doc_id = 2").union(df.filter("doc_id = 2"))).collect()
    assert len(twice) == 2


def plain_pack(examples, limit):
    """The rule in plain lists: (key, ids, loss_from) in order to (key, start, length, sequence, offset)."""
    waiting, out, sequence = [], [], 0

    def fill(first=None):
        nonlocal sequence
        left, offset = [limit.tokens, limit.segments, limit.loss], 0

        def place(key, start, length, loss_from):
            nonlocal offset
            out.append((key, start, length, sequence, offset))
            for i, x in enumerate((length, 1, min(length, max(0, start + length - loss_from)))):
                left[i] -= x
            offset += length

        if first:
            place(*first)
        while waiting and left[0] >= 1 and left[1] >= 1:
            need = [(end - start, 1, min(end - start, max(0, end - loss_from))) for _, start, end, loss_from in waiting]
            gain = [d[0] * left[0] / limit.tokens**2 + d[1] * left[1] / limit.segments**2 + d[2] * left[2] / limit.loss**2 for d in need]
            room = [min(d[0], left[0], d[0] - d[2] + left[2]) for d in need]
            fits = [i for i, d in enumerate(need) if all(x <= y for x, y in zip(d, left, strict=True))] or [i for i, r in enumerate(room) if r == max(room)]
            i = max(fits, key=lambda i: (gain[i], -i))
            if room[i] < 1:
                break
            key, start, end, loss_from = waiting[i]
            waiting[i] = waiting[-1]
            waiting.pop()
            length = room[i]
            place(key, start, length, loss_from)
            if start + length < end:
                waiting.append((key, start + length, end, loss_from))
        sequence += 1

    for key, n, loss_from in examples:
        start = 0
        while n - start >= limit.tokens:
            length = min(limit.tokens, max(0, loss_from - start) + limit.loss)
            fill((key, start, length, loss_from))
            start += length
        if start < n:
            waiting.append((key, start, n, loss_from))
        while len(waiting) >= limit.pool:
            fill()
    while waiting:
        fill()
    return out


@pytest.mark.parametrize("limit", [packing.PRODUCTION, packing.Limits(tokens=128, segments=3, loss=100, pool=16), packing.Limits(tokens=64, segments=64, loss=9, pool=5)])
def test_packing_is_that_of_a_plain_packer(limit):
    rng = random.Random(limit.tokens)
    examples = [(i, int(rng.paretovariate(0.8) * 20) % 3000 + 1, rng.choice([0, 0, 5, 60, 400])) for i in range(700)]
    packer = packing.Packer(limit, 0)
    for i, n, loss_from in examples:
        packer.add(i, np.arange(n, dtype=np.uint32), loss_from)
    packer.close()
    assert [(o[0], o[1], o[2], o[5], o[6]) for o in packer.out] == plain_pack(examples, limit)


def test_all_limits_of_the_packing_query_bind_and_little_is_padded(spark):
    """Full in tokens, in loss-bearing tokens or in pieces: each happens, and the choice keeps the tokens together at nearly 1024."""
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_packing"](spark, sf).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    tokens = [sum(r.length for r in b) for b in bins.values()]
    loss = [sum(r.loss_tokens for r in b) for b in bins.values()]
    pieces = [len(b) for b in bins.values()]
    # each of the three limits is what ends some sequences, by itself
    assert sum(t == 1024 and x < 1008 and n < 4 for t, x, n in zip(tokens, loss, pieces, strict=True)) > 20
    assert sum(t < 1024 and x == 1008 and n < 4 for t, x, n in zip(tokens, loss, pieces, strict=True)) > 0
    assert sum(t < 1024 and x < 1008 and n == 4 for t, x, n in zip(tokens, loss, pieces, strict=True)) > 5
    assert max(pieces) == 4 and max(loss) == 1008 and max(tokens) == 1024
    assert sum(tokens) / 1024 / len(tokens) > 0.98
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_pieces(rows, {i: np.append(token_ids(t or "", default_path()), np.uint32(0)) for i, t in docs.items()}, packing.PRODUCTION)


def test_token_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(default_path())
    for t in ("", "a", " a  b\n\n c ", "é😀漢字", "<|endoftext|>", "x" * 5000, " " * 3000 + "y", "1234 567's"):
        assert token_ids(t, default_path()).tolist() == own.encode(t, add_special_tokens=False).ids


# archives


def test_archives_round_trip_in_chunks(spark):
    long = "é" * 700_000
    rows = [(1, "http://a/1", "x" * 1000), (2, "http://a/2\r\nX: y", "x" * 1000), (3, None, None), (4, "u", ""), (5, "ü", "short"), (6, "u", "short"), (7, "v", long), (None, "n", "x" * 1000), (2, "http://a/2", "x" * 1000), (8, "w", "a\r\n\r\nb" * 400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit(1)).withColumn("n", F.lit(1)).repartition(3)
    index = warc.write_warc(warc.deduplicated(df), group_bytes=2000)
    chunks = warc.read_warc(index, chunk_bytes=100_000).collect()
    by = defaultdict(list)
    for c in chunks:
        by[c.page_id, c.url].append(c)
    assert len(by) == 10 and sum(c.last for c in chunks) == 10
    big = sorted(by[7, "v"], key=lambda c: c.chunk_no)
    assert [c.chunk_no for c in big] == list(range(14)) and b"".join(bytes(c.data) for c in big) == long.encode()
    assert big[-1].sha1_so_far == hashlib.sha1(long.encode()).hexdigest() and big[3].bytes_so_far == 400_000
    assert (by[1, "http://a/1"][0].record_type, by[1, "http://a/1"][0].refers_to) == ("revisit", 2)
    assert by[None, "n"][0].refers_to == 2 and by[2, "http://a/2"][0].record_type == "response" and by[6, "u"][0].record_type == "response"
    assert by[3, None][0].chunk_bytes == 0 and bytes(by[8, "w"][0].data) == b"a\r\n\r\nb" * 400
    empty = warc.write_warc(warc.deduplicated(df.limit(0)))
    assert warc.read_warc(empty).count() == 0
