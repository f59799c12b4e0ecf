"""URL filters: stated host and path rules, and association rules between URL tokens and verdicts, mined from labelled URLs by FP-growth."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, temporary, written

#: Rules of the query: verdict, host and start of the path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    """support: least share of the labelled URLs that hold a rule's tokens and its verdict; confidence: least share of those with the tokens that
    have the verdict; width: most tokens of a URL whose sets are listed at once (with more, which only changes the way, sets grow in tables); default:
    verdict where no rule fits.
    """

    support: float = 0.01
    confidence: float = 0.8
    width: int = 16
    default: str = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; empty where the url is null or has no `://`."""
    part = lambda k: F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def tokens(url: Column) -> Column:
    """The distinct tokens of a url: parts of the host, of the path (digits as one 0) and names of the query's fields, in that order."""
    host, path = host_and_path(url)
    split = lambda kind, c, by: F.transform(F.filter(F.split(c, by), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))
    names = F.transform(F.split(query, "[&;]"), lambda x: F.substring_index(x, "=", 1))
    names = F.transform(F.filter(names, lambda x: x != ""), lambda x: F.concat(F.lit("key:"), x))
    return F.array_distinct(F.concat(split("host:", host, r"[.-]"), split("path:", F.regexp_replace(path, r"[0-9]+", "0"), r"[/._-]"), names))


def stated(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path; of equally long ones that with the longer host) that fits, and its verdict; null if none does.

    One CASE over the rules: meant for lists that a person writes.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _held(baskets: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Sets of a base and one more token (tokens, verdict, n, all) that `least` URLs of a verdict hold, and the tokens that may go on to larger sets
    (base, x, all).

    Baskets have base (names) and whole (URLs that hold it), own (more tokens), verdict, n (URLs). A set of one verdict does not go on: it fits wherever a
    larger one does, and no larger one is surer. Nor does a token that all URLs with the base hold: sets count the same without it.
    """
    each = baskets.select("base", "whole", "verdict", "n", F.explode("own").alias("x")).groupBy("base", "whole", "x", "verdict").agg(F.sum("n").alias("n"))
    said = F.collect_list(F.when(F.col("n") >= least, F.struct("verdict", "n"))).alias("said")
    held = written(each.groupBy("base", "whole", "x").agg(F.sum("n").alias("all"), F.max("n").alias("most"), said).filter(F.col("most") >= least), "held")
    sets = held.select(F.array_sort(F.concat("base", F.array("x.name"))).alias("tokens"), F.explode("said").alias("v"), "all")
    return sets.select("tokens", "v.verdict", "v.n", "all"), held.filter((F.col("most") < F.col("all")) & (F.col("all") < F.col("whole"))).select("base", "x", "all")


def _grown(baskets: DataFrame, going: DataFrame, least: int) -> list[DataFrame]:
    """The sets of two tokens and more, as _held has them, from baskets whose own tokens may all go on and are in order, rarest first.

    FP-growth's conditional baskets as tables: each step adds a token to the bases and leaves the tokens after it, and equal baskets are one row. As a
    base holds the rarer tokens, what they imply is dropped at once, so long paths and fixed sets of fields do not have all their subsets listed.
    """
    found = []
    while True:
        rest = baskets.select("base", "verdict", "n", "own", F.posexplode("own").alias("i", "x")).select("base", "verdict", "n", "x", F.slice("own", F.col("i") + 2, F.size("own")).alias("own"))
        merged = rest.filter(F.size("own") > 0).groupBy("base", "x", "own", "verdict").agg(F.sum("n").alias("n")).join(going, ["base", "x"])
        longer = written(merged.select(F.concat("base", F.array("x.name")).alias("base"), F.col("all").alias("whole"), "own", "verdict", "n"), "baskets")
        if longer.isEmpty():
            return found
        sets, going = _held(longer, least)
        found.append(sets)
        goes = going.groupBy("base").agg(F.collect_list("x").alias("goes"))
        baskets = longer.join(goes, "base").select("base", "verdict", "n", F.array_sort(F.array_intersect("own", "goes")).alias("own"))


def _listed(baskets: DataFrame, least: int) -> list[DataFrame]:
    """The same sets by Spark's FP-growth, which lists all subsets of a basket that are frequent."""
    items = baskets.select(F.concat("own.name", F.array(F.concat(F.lit("verdict:"), F.col("verdict")))).alias("items"))
    n = items.count()
    if n < least:
        return []
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(items).freqItemsets
    sets = written(found.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    of = F.filter("items", lambda x: x.startswith("verdict:"))
    plain = sets.filter((F.size(of) == 0) & (F.size("items") > 1)).select(F.col("items").alias("tokens"), F.col("freq").alias("all"))
    joint = sets.filter((F.size(of) == 1) & (F.size("items") > 2)).select(
        F.array_except("items", of).alias("tokens"), F.substring(of[0], len("verdict:") + 1, 1 << 30).alias("verdict"), F.col("freq").alias("n")
    )
    return [joint.join(plain, "tokens").select("tokens", "verdict", "n", "all")]


def mined(labelled: DataFrame, m: Mining = Mining()) -> DataFrame:
    """Rules from labelled URLs (url, verdict): tokens, verdict, n (URLs with the tokens and the verdict), confidence, and key, the rarest token.

    A rule is a set of tokens that has a verdict with `support` and `confidence`; all tokens of a URL are looked at. Single tokens are counted first.
    Those that are frequent, not in all URLs and not of one verdict go on to sets: by Spark's FP-growth, or in tables if a URL has more than `width` of them.
    A rule is left out if one of its tokens can go without loss of confidence: the shorter rule fits wherever it does and comes first.
    URLs with null url or verdict are not used.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("url IS NOT NULL AND verdict IS NOT NULL")
    none = F.array().cast("array<string>").alias("base")
    with temporary(spark):
        urls = written(rows.select(tokens(F.col("url")).alias("own"), F.col("verdict").cast("string").alias("verdict")), "labelled")
        whole = urls.count()
        least = max(1, math.ceil(m.support * whole))
        own = F.transform("own", lambda x: F.struct(F.lit(0).cast("long").alias("often"), x.alias("name"))).alias("own")
        single, going = _held(urls.select(none, F.lit(whole).alias("whole"), own, "verdict", F.lit(1).cast("long").alias("n")), least)
        going = going.select("base", F.struct(F.col("all").alias("often"), "x.name").alias("x"), "all")
        # One row; as many tokens as URLs have on average, divided by the support, at most.
        goes = going.agg(F.array_sort(F.collect_list("x")).alias("goes"))
        both = urls.crossJoin(F.broadcast(goes)).select(F.array_intersect("own", "goes.name").alias("have"), "goes", "verdict").filter(F.size("have") > 1)
        baskets = written(both.select(F.filter("goes", lambda x: F.array_contains("have", x["name"])).alias("own"), "verdict"), "baskets")
        widest = baskets.agg(F.max(F.size("own"))).first()[0] or 0
        if widest > m.width:
            more = _grown(baskets.groupBy("own", "verdict").agg(F.count("*").alias("n")).withColumn("base", none), going, least)
        else:
            more = _listed(baskets, least)
        sets = reduce(DataFrame.unionByName, more, single)
        rules = sets.select("tokens", "verdict", "n", (F.col("n") / F.col("all")).alias("confidence"))
        rules = written(rules.filter(F.col("confidence") >= m.confidence), "rules")
        shorter = rules.select("tokens", "confidence", F.explode("tokens").alias("x")).select(F.col("tokens").alias("whole"), F.col("confidence").alias("own"), F.array_remove("tokens", F.col("x")).alias("tokens"))
        needless = shorter.join(rules.select("tokens", "confidence"), "tokens").filter("confidence >= own").select(F.col("whole").alias("tokens")).distinct()
        useful = rules.join(needless, "tokens", "left_anti")
        often = single.select(F.col("tokens")[0].alias("x"), "all").distinct()
        keys = useful.select("tokens", F.explode("tokens").alias("x")).join(often, "x").groupBy("tokens").agg(F.min_by("x", F.struct("all", "x")).alias("key"))
        return written(useful.join(keys, "tokens"), "index", keep=True)


def matched(urls: DataFrame, index: DataFrame) -> DataFrame:
    """url and best (tokens, verdict, confidence) for the distinct urls that a rule of the index fits.

    A rule is looked up by its rarest token and then compared whole. The first rule counts: by confidence, number of URLs, fewer tokens, order
    of tokens.
    """
    seen = urls.select("url").filter("url IS NOT NULL").distinct().select("url", tokens(F.col("url")).alias("own"))
    near = seen.select("url", "own", F.explode("own").alias("key")).join(index, "key").filter(F.size(F.array_except("tokens", "own")) == 0)
    first = F.struct((-F.col("confidence")).alias("a"), (-F.col("n")).alias("b"), F.size("tokens").alias("c"), F.col("tokens"), F.col("verdict"))
    best = near.groupBy("url").agg(F.min(first).alias("best"))
    return best.select("url", F.struct("best.tokens", "best.verdict", (-F.col("best.a")).alias("confidence")).alias("best"))


def judged(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, m: Mining = Mining()) -> DataFrame:
    """All rows and columns, and host, path, rule, verdict, mined (the tokens of the association rule that decided) and its confidence.

    Stated rules come first. URLs that none of them fits get the verdict of the best mined rule, or else the default. `labelled` (url,
    verdict) is what is mined; without it, the URLs of df that stated rules judge are the labels: what a blocked branch has in common is then looked
    for where no rule was written.

    Null urls and urls without `://` have empty host and path and get the default. Equal urls are judged once, and each row comes back; columns
    with the names of results are replaced; an empty table gives no rows. Only urls are read and shuffled here, no other column of wide tables.
    """
    spark = df.sparkSession
    results = ["host", "path", "rule", "verdict", "mined", "confidence"]
    base = df.drop(*results)
    host, path = host_and_path(F.col("url").cast("string"))
    name, verdict = stated(F.col("host"), F.col("path"), rules)
    rows = base.withColumns({"host": host, "path": path}).withColumn("rule", name).withColumn("verdict", verdict)
    with temporary(spark):
        index = mined(rows.select("url", "verdict") if labelled is None else labelled, m)
        best = written(matched(rows.filter("rule IS NULL").select(F.col("url").cast("string")), index), "judged", keep=True)
    key, found = fresh(rows, "matched_url"), fresh(rows, "best")
    joined = rows.join(best.select(F.col("url").alias(key), F.col("best").alias(found)), F.col("url").cast("string").eqNullSafe(F.col(key)) & F.col("rule").isNull(), "left")
    return joined.select(
        *(F.col(f"`{c}`") for c in base.columns), "host", "path", "rule",
        F.coalesce("verdict", f"{found}.verdict", F.lit(m.default)).alias("verdict"), F.array_join(f"{found}.tokens", " ").alias("mined"), F.col(f"{found}.confidence").alias("confidence"),
    )


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' urls judged by the stated rules, the rest by rules mined from what those judge (`labels` marks documents, not pages)."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


def _sql(m: Mining = Mining(), rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """All subsets of each labelled url's tokens are counted, whereas the operator looks them up in a tree; no rule is pruned but by the two limits."""
    cases = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{}}" for _, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])))
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = cases.format(*(f"'{h + p}'" for _, h, p in ordered))
    verdict = cases.format(*(f"'{v}'" for v, _, _ in ordered))
    split = lambda kind, c, by: f"list_transform(list_filter(regexp_split_to_array({c}, '{by}'), lambda x: x <> ''), lambda x: '{kind}' || x)"
    return rf"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
q AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS verdict, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)://[^?#]*\?([^#]*)', 1) ELSE '' END AS query FROM p),
t AS MATERIALIZED (SELECT *, list_distinct(list_concat({split('host:', 'host', '[.-]')}, {split('path:', "regexp_replace(path, '[0-9]+', '0', 'g')", '[/._-]')},
  list_transform(list_filter(list_transform(regexp_split_to_array(query, '[&;]'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'key:' || x))) AS ts FROM q),
e AS (SELECT page_id, verdict, ts, unnest(range(1, (1 << len(ts))::BIGINT)) AS pick FROM t WHERE rule IS NOT NULL),
s AS (SELECT verdict, array_to_string(list_sort(list_filter(ts, lambda x, i: (pick >> (i - 1)) & 1 = 1)), ' ') AS tokens, bit_count(pick) AS size FROM e),
c AS (SELECT tokens, size, count(*) AS n, count(*) FILTER (verdict = 'allow') AS n_allow, count(*) FILTER (verdict = 'block') AS n_block FROM s GROUP BY 1, 2),
r AS (SELECT tokens, size, 'allow' AS verdict, n_allow AS k, n_allow::DOUBLE / n AS confidence FROM c UNION ALL SELECT tokens, size, 'block', n_block, n_block::DOUBLE / n FROM c),
rules AS (SELECT * FROM r WHERE k >= ceil({m.support}::DOUBLE * (SELECT count(*) FROM t WHERE rule IS NOT NULL)) AND confidence >= {m.confidence}),
f AS (SELECT page_id, array_to_string(list_sort(list_filter(ts, lambda x, i: (pick >> (i - 1)) & 1 = 1)), ' ') AS tokens FROM (SELECT page_id, ts, unnest(range(1, (1 << len(ts))::BIGINT)) AS pick FROM t WHERE rule IS NULL)),
b AS (SELECT f.page_id, rules.*, row_number() OVER (PARTITION BY f.page_id ORDER BY confidence DESC, k DESC, size, string_split(rules.tokens, ' '), verdict) AS place FROM f JOIN rules ON rules.tokens = f.tokens)
SELECT t.page_id, t.host, t.path, t.rule, coalesce(t.verdict, b.verdict, '{m.default}') AS verdict, b.tokens AS mined, b.confidence FROM t LEFT JOIN b ON b.page_id = t.page_id AND b.place = 1
"""


OP11_SQL = _sql()
