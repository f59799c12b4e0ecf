"""URL filters, centroid clustering and importance resampling against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm import centroids, lines, resample, urls

CLASH = ["host", "path", "rule", "verdict", "best", "row", "own", "text_", "cluster", "n_words", "at", "part", "place", "v", "key"]


def extra(df):
    """Columns whose names clash with those that the operators use."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("?") for c in CLASH if c not in df.columns})


# URL filters


def test_stated_rules_fit_hosts_subdomains_and_paths(spark):
    rows = ["http://A.Example.org/x", "https://example.org/es/1", "http://b.example.org/es/?q", "http://notexample.org/es/1", "http://example.org/en/17#t", "x.com/de/", None, "ftp://com", "https://q.com/de/1", "http://q.com/fr/", "s://h.net://org/", "http://org?/x", "http://EXAMPLE.ORG"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(extra(df), m=urls.Mining(support=0.9)).collect()}
    assert got[0] == ("a.example.org", "/x", "org/", "allow")
    assert got[1][2:] == got[2][2:] == ("example.org/es/", "block")
    assert got[3] == ("notexample.org", "/es/1", "org/", "allow")
    assert got[4] == ("example.org", "/en/17", "example.org/en/1", "block")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7][:3] == ("com", "", None)
    assert got[8][2:] == ("com/de/", "block") and got[9][2:] == ("com/fr/", "allow")
    assert got[10][:3] == ("h.net:", "//org/", None)
    assert got[11][:3] == ("org", "", None) and got[12][:3] == ("example.org", "", None)


def rules_by_brute_force(labelled, m):
    """All token sets of all labelled urls, counted one by one."""
    alone, joint = Counter(), Counter()
    for ts, verdict in labelled:
        for n in range(1, len(ts) + 1):
            for c in itertools.combinations(sorted(ts[: m.width]), n):
                alone[c] += 1
                joint[c, verdict] += 1
    least = math.ceil(m.support * len(labelled))
    return [(c, v, k, k / alone[c]) for (c, v), k in joint.items() if k >= least and k / alone[c] >= m.confidence]


def test_mined_rules_and_matches_are_those_of_brute_force(spark):
    rng, m = random.Random(4), urls.Mining(support=0.03, confidence=0.7)
    url = lambda: f"http://{rng.choice(['www.', 'm.', ''])}{rng.choice(['casino', 'news', 'free-bets', 'bets'])}.{rng.choice(['com', 'net'])}/{rng.choice(['en', 'de'])}/{rng.randint(1, 99)}{rng.choice(['', '?utm=1', '?page=2&utm=x'])}"
    known = [url() for _ in range(300)]
    said = ["block" if ("casino" in u and "net" in u) or "bets.com" in u or rng.random() < 0.05 else "allow" for u in known]
    open_ = [*(url() for _ in range(80)), None, "no url", "http://", "http://casino.net/" + "a1/" * 3000 + "?" + "&".join(f"k{i}" for i in range(2000)), *["http://casino.net/en/5"] * 3]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(open_)], "page_id long, url string")
    labelled = spark.createDataFrame([*zip(known, said, strict=True), (None, "block"), ("http://casino.net/", None)], "url string, verdict string")
    split = {r.url: r.ts for r in labelled.select("url").unionByName(df.select("url")).filter("url IS NOT NULL").select("url", urls.tokens(urls.F.col("url")).alias("ts")).distinct().collect()}
    want = rules_by_brute_force([(split[u], v) for u, v in zip(known, said, strict=True)], m)
    index = urls.mined(labelled, m).collect()
    assert index and {(tuple(r.tokens), r.verdict, r.n) for r in index} <= {w[:3] for w in want}
    assert any(len(r.tokens) > 1 for r in index) and all(r.key in r.tokens for r in index)
    got = urls.judged(extra(df), (), labelled, m).collect()
    assert len(got) == len(open_)
    for r in got:
        fits = [w for w in want if set(w[0]) <= set(split.get(r.url, ()))]
        best = min(fits, key=lambda w: (-w[3], -w[2], len(w[0]), w[0], w[1]), default=None)
        assert (r.verdict, r.mined) == ((best[1], " ".join(best[0])) if best else ("allow", None)), r


def test_rules_are_mined_from_all_tokens_of_long_urls(spark):
    """What decides stands behind 40 path parts and 30 fields; the parts are nested and the fields always together, so nearly all subsets are alike."""
    parts, fields = ["p" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(40)], "&".join(f"f{i}=1" for i in range(30))
    url = lambda depth, *last: f"http://h.net/{'/'.join([*parts[:depth], *last])}?{fields}"
    rows = [(url(d, "spam", "x"), "block") for d in range(41)] + [(url(d, "spam"), "allow") for d in range(41)] + [(url(d, "x"), "allow") for d in range(41)] + [("http://h.net/", "allow"), ("http://h.net/", "block")]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    df = spark.createDataFrame([(1, url(40, "x", "spam")), (2, url(40, "x")), (3, url(7, "spam")), (4, "http://q.org/x/spam")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined, r.confidence) for r in urls.judged(df, (), labelled).collect()}
    assert got[1] == got[4] == ("block", "path:spam path:x", 1.0)
    assert got[2] == got[3] == ("allow", None, None)


def test_sets_grown_in_tables_decide_as_brute_force(spark):
    rng, m = random.Random(6), urls.Mining(support=0.01, confidence=0.7, width=1)
    url = lambda: "http://h.net/" + "/".join(w for w in "abcdefgh" if rng.random() < 0.6) + rng.choice(["", "?k=1", "?k=1&l=2"])
    known, open_ = [url() for _ in range(200)], [url() for _ in range(150)]
    said = ["block" if {"a", "c"} <= set(u[13:]) or rng.random() < 0.1 else rng.choice(["allow", "ask"]) if "h" in u[13:] else "allow" for u in known]
    labelled = spark.createDataFrame([*zip(known, said, strict=True)], "url string, verdict string")
    df = spark.createDataFrame([(i, u) for i, u in enumerate(open_)], "page_id long, url string")
    split = {r.url: r.ts for r in labelled.select("url").unionByName(df.select("url")).select("url", urls.tokens(F.col("url")).alias("ts")).distinct().collect()}
    want = rules_by_brute_force([(split[u], v) for u, v in zip(known, said, strict=True)], urls.Mining(m.support, m.confidence))
    index = urls.mined(labelled, m).collect()
    assert {(tuple(r.tokens), r.verdict, r.n, r.confidence) for r in index} <= set(want) and max(len(r.tokens) for r in index) > 3
    for r in urls.judged(df, (), labelled, m).collect():
        best = min((w for w in want if set(w[0]) <= set(split[r.url])), key=lambda w: (-w[3], -w[2], len(w[0]), w[0], w[1]), default=None)
        assert (r.verdict, r.mined, r.confidence) == ((best[1], " ".join(best[0]), best[3]) if best else ("allow", None, None)), r


def test_url_filters_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert [(r.rule, r.verdict, r.mined) for r in urls.judged(df).collect()] == [(None, "allow", None)] * 2
    assert urls.judged(df.limit(0)).count() == 0


# centroid clustering


def lloyd(vectors, k, rounds, scale=64, seed=1):
    """Whole numbers of any size, in plain Python."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    c = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, x, strict=True)) for x in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        where = assign()
        for j in range(len(c)):
            own = [v for (_, v), (i, _) in zip(kept, where, strict=True) if i == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    where = assign()
    sums = Counter()
    for j, d in where:
        sums[j] += d
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    return sorted(((i is None, i or 0), j, d, sums[j], sum(sums.values()), sha(c[j])) for (i, _), (j, d) in zip(kept, where, strict=True))


def as_rows(df):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("k", [3, 16, 400])
def test_clusters_are_those_of_plain_python(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in np.float32(rng.normal(i % 5, 0.4, 64))]) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(150)] + [rows[3], rows[3]]  # a vector that very many rows share; repeated rows
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [None, *[1.0] * 63]), (505, [float("nan"), *[1.0] * 63]), (506, [float("-inf"), *[1.0] * 63]), (None, [0.015625] * 64), (507, [-1e6] * 64)]
    df = extra(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(7)
    assert as_rows(centroids.clustered(df, centroids.Lloyd(k=k))) == lloyd(rows, k, 3)


def test_equally_near_centroids_and_empty_clusters(spark):
    c = np.array([[0, 0], [2, 0], [2, 0], [-9, 5]], np.int64)
    assert [x.tolist() for x in centroids.nearest(np.array([[1, 0], [2, 1], [0, 0]], np.int64), c)] == [[0, 1, 0], [1, 1, 0]]
    rows = [(i, [float(i // 10)] * 64) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert as_rows(centroids.clustered(df, centroids.Lloyd(k=9))) == lloyd(rows, 9, 3)


def test_no_vectors_give_no_rows_and_huge_ones_an_error(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert centroids.clustered(df).count() == 0 and centroids.clustered(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large for exact distances"):
        centroids.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


# importance resampling


def by_hand(docs, target, s=resample.Resampling()):
    def grams(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return ws, [zlib.crc32(" ".join(ws[i : i + k]).encode()) % s.buckets for k in range(1, s.n + 1) for i in range(len(ws) - k + 1)]

    source, aim = [grams(t) for _, t in docs], [grams(t) for _, t in target]
    a, b = Counter(x for _, g in source for x in g), Counter(x for _, g in aim for x in g)
    sa, sb = sum(a.values()), sum(b.values())
    gain = [math.floor(1000 * math.log(((b[i] + 1) * (sa + s.buckets)) / ((a[i] + 1) * (sb + s.buckets)))) for i in range(s.buckets)]
    rows = []
    for (i, _), (ws, g) in zip(docs, source, strict=True):
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in g)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws)])
    eligible = sorted((r for r in rows if r[5] >= s.least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(eligible[: s.percent * len(eligible) // 100], 1):
        r[4] = place
    return sorted(repr(tuple(r[:5])) for r in rows)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma7", "it's", "don't--stop", "ÉTÉ", "日本", "x" * 31, "y" * 32, "z" * 33, "w" * 200, "Q1", "\x7f", "a_b", "…", "\n", "9"]
    some = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", "1", ".", "\t"]) for _ in range(n))
    docs = [(i, some(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,"), (303, "v" * 300_000), (304, some(30_000)), (305, "a " * 60_000), (None, some(50)), (None, None)]
    docs += [(306, some(40))] * 40 + [(307 + i, docs[5][1]) for i in range(50)]
    return docs, [(i, some(30)) for i in range(20)] + [(20, None), (21, some(5000))]


@pytest.mark.parametrize("s", [resample.Resampling(), resample.Resampling(chunk=7, long=40, percent=37, buckets=97), resample.Resampling(n=1, chunk=1, long=0)])
def test_weights_and_draw_are_those_of_plain_python(spark, texts, s):
    docs, target = texts
    df = extra(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5)
    got = resample.resampled(df, spark.createDataFrame(target, "item_id long, text string"), s)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == by_hand(docs, target, s)


def test_chunks_cover_every_start_once_and_carry_the_words_after(spark):
    s = resample.Resampling(chunk=3, long=0)
    rows = spark.createDataFrame([(1, 5, "a b. c d e-f g"), (2, 6, "one"), (3, 7, "..")], "row long, doc_id long, text string")
    got = [(r.doc_id, r.text, r.own) for r in resample.chunks(rows, s).collect()]
    assert got == [(5, "a b. c d e", 3), (5, "d e-f g", 3), (5, "g", 1), (6, "one", 1), (7, "", 0)]


def test_resampling_of_nothing(spark):
    docs, target = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert resample.resampled(docs.limit(0), target).count() == 0
    assert sorted(repr(tuple(r)) for r in resample.resampled(docs, target.limit(0)).collect()) == by_hand([(1, "a b")], [])


# winnowing of lines


def line_docs(rng, n):
    """Documents of lines of 1 to 70 words, many of which come from a few passages, at any place of them."""
    line = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(rng.choice([1, 1, 5, 12, 30, 49, 50, 70])))
    shared = [[line() for _ in range(rng.randint(3, 14))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            passage = rng.choice(shared) if rng.random() < 0.5 else [line() for _ in range(rng.randint(1, 6))]
            a = rng.randint(0, len(passage) - 1)
            parts += passage[a : rng.randint(a + 1, len(passage))] + rng.choice([[], ["  "], ["one more"]])
        rows.append((i, "\n".join(parts)))
    return rows


def winnowed(text, least=50):
    """The positions that windows over a text's lines select, by the definition."""
    ls = [(i, hashlib.md5(x.encode()).digest(), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate(text.split("\n"))]
    ls, out = [x for x in ls if x[2]], set()
    for a in range(len(ls)):
        b, n = a, 0
        while b < len(ls) and n < least:
            n += ls[b][2]
            b += 1
        if n >= least:
            out.add(min(ls[a:b], key=lambda x: (x[1], -x[0]))[0])
    return out


def test_winnowing_selects_few_positions_and_drops_those_that_stand_alone(spark):
    rows = line_docs(random.Random(6), 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    split = lines._split(df)
    selected = lines.fingerprints(split)
    got = {(r.doc_id, r.line.pos) for r in selected.collect()}
    assert got == {(i, p) for i, t in rows for p in winnowed(t)}
    n, fps = split.count(), Counter(r.fp for r in selected.select("fp").collect())
    alone = sum(1 for c in fps.values() if c == 1)
    assert len(got) < 0.7 * n and 0 < alone < len(got)
    # with one fingerprint for all, all positions stay candidates: the fingerprint is what thins them out
    constant = selected.withColumn("fp", F.lit(b"x"))
    assert constant.groupBy("fp").count().filter("count > 1").agg(F.sum("count")).first()[0] == len(got) > len(got) - alone


def test_matches_end_where_the_texts_part_on_either_side(spark):
    word = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    core = [word("m", 20), word("n", 20), word("o", 20)]
    one = "\n".join([word("p", 9), word("x", 30), *core, word("y", 30), word("q", 9)])
    two = "\n".join([word("r", 9), word("x", 30), *core, word("y", 30), word("s", 9)])  # the same five lines between others
    three = "\n".join([*core[1:], word("z", 60)])  # 40 words of it only
    four = "\n".join([word("t", 3), core[2], word("y", 30), word("u", 70), core[0], core[1]])  # 50 words, and 40
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame([(1, one), (2, two), (3, three), (4, four)], "doc_id long, text string")).collect()}
    assert got[1] == one and got[3] == three
    assert got[2] == "\n".join([word("r", 9), word("s", 9)])
    assert got[4] == "\n".join([word("t", 3), word("u", 70), core[0], core[1]])
