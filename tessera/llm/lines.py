"""Line dedup by winnowing over line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import temporary, written

#: Words that a repeated run has at least.
MIN_WORDS = 50
#: Documents with deletions, and deleted lines in all, up to which the deletions are broadcast (at most about 30 MB); more are joined by a shuffle.
BROADCAST_DOCS, BROADCAST_LINES = 250_000, 2_500_000
WORD = r"[^\x20\x09-\x0D]+"


def _split(df: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), and pos, h (hash) and nw (words) of every line that has words; repeated rows are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), F.unhex(F.md5(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("nw")))
    docs = df.select("doc_id", F.xxhash64(text).alias("th"), F.filter(split, lambda x: x["nw"] > 0).alias("lines"))
    return docs.groupBy("doc_id", "th").agg(F.first("lines").alias("lines")).select("doc_id", "th", F.explode("lines").alias("x")).select("doc_id", "th", "x.*")


def fingerprints(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The positions that winnowing selects: doc_id, th, line (pos, h, nw and before, the words before it), fp (its hash), starts, left and right.

    From every line a window goes as far as it takes to hold min_words words, and selects the rightmost of its smallest line hashes; a line that
    several windows select is one position, and starts are these windows' beginnings. left and right: the lines around it in reach, those that end
    and begin less than min_words words away. Any passage of min_words words that two places share holds the same window, so both select the
    same line of it.
    """
    doc = Window.partitionBy("doc_id", "th")
    by, after = doc.orderBy("before"), doc.orderBy("behind").rangeBetween(0, min_words - 1)
    reach = by.rangeBetween(0, min_words - 1)
    whole = lines.withColumns({"behind": F.sum("nw").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("nw").over(doc)}).withColumn("before", F.col("behind") - F.col("nw"))
    line = F.struct("pos", "h", "nw", "before")
    chosen = whole.select("*", line.alias("line"), F.min(F.struct("h", -F.col("before"))).over(reach).alias("least"), F.lead(line).over(by).alias("next"))
    chosen = chosen.withColumn("selects", F.when(F.col("all") - F.col("before") >= min_words, -F.col("least")["col2"]))
    near = chosen.select(
        "doc_id", "th", "line", F.collect_list(F.struct("selects", "before")).over(by.rangeBetween(1 - min_words, 0)).alias("windows"),
        F.collect_list("line").over(by.rangeBetween(1 - min_words, -1)).alias("left"), F.collect_list("next").over(after).alias("right"),
    )
    starts = F.transform(F.filter("windows", lambda w: w["selects"] == F.col("line.before")), lambda w: w["before"])
    return near.select("doc_id", "th", "line", F.col("line.h").alias("fp"), starts.alias("starts"), "left", "right").filter(F.size("starts") > 0)


def _runs(positions: DataFrame, min_words: int) -> DataFrame:
    """Each position extended both ways: doc_id, th, fp, first and last (places of a run's ends) and run (a hash of its lines).

    To the left a position extends to each of its windows' beginnings, and from there line by line to the right: first to where the run has min_words
    words, then on while it would not have them without its first line. What is longer is put together from such runs.
    """
    own = lambda s: F.concat(F.filter("left", lambda x: x["before"] >= s), F.array("line"))
    words = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x["nw"].cast("int"))

    def extended(s: Column) -> Column:
        def upto(b: Column) -> Column:
            ls = F.concat(own(s), F.slice("right", F.lit(1), b))
            n = words(ls)
            enough = (n >= min_words) & ((b == 0) | (n - F.element_at(ls, -1)["nw"] < min_words) | (n - F.get(ls, F.lit(0))["nw"] < min_words))
            return F.when(enough, F.struct(F.get(ls, F.lit(0))["pos"].alias("first"), F.element_at(ls, -1)["pos"].alias("last"), F.xxhash64(F.transform(ls, lambda x: x["h"])).alias("run")))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size("right")), upto), lambda r: r.isNotNull())

    return positions.select("doc_id", "th", "fp", F.explode(F.flatten(F.transform("starts", extended))).alias("r")).select("doc_id", "th", "fp", "r.*")


def repeated_lines(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th (hash of the text) and removed (places of the lines in later copies of a run of lines, from 0)."""
    selected = written(fingerprints(_split(df), min_words), "fingerprints")
    # What is counted by fingerprint and by run is a table of its own, so that the joins may split what very many documents share.
    repeated = written(selected.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "repeated")
    # Positions with a fingerprint that others have are extended; runs of one fingerprint meet where they are alike: one row per run, never pairs.
    runs = written(_runs(selected.join(repeated, "fp", "left_semi"), min_words), "runs")
    place = F.struct("doc_id", "th", "first")
    heads = written(runs.groupBy("fp", "run").agg(F.min(place).alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n"), "heads")
    gone = runs.join(heads, ["fp", "run"]).filter(~F.col("head").eqNullSafe(place)).select("doc_id", "th", "first", "last")
    # Of the runs from one line the longest counts; overlapping ones are joined before a document's places are listed.
    ends = gone.groupBy("doc_id", "th", "first").agg(F.max("last").alias("last"))
    reach = F.max("last").over(Window.partitionBy("doc_id", "th").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    fresh = ends.select("doc_id", "th", F.greatest("first", F.coalesce(reach + 1, F.lit(0))).alias("first"), "last").filter("first <= last")
    return fresh.groupBy("doc_id", "th").agg(F.flatten(F.collect_list(F.sequence("first", "last"))).alias("removed"))


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All rows and columns; text without later copies of runs of lines, and two counts: lines before, lines taken out.

    A run of consecutive lines (blank ones don't count) with min_words words or more in all that occurs earlier (in the order of doc_id, then
    of a hash of the text, then of place), in this or another document, is deleted as far as the two go on alike in both directions. What
    occurs first stays. Lines are equal if all their characters are.

    Windows of min_words words select their smallest line hash as a fingerprint (see fingerprints), fewer positions than lines. Those whose
    fingerprint occurs once are dropped; the others are extended line by line to both sides, and what begins alike at an earlier position goes as far as the
    two go on alike. Copies meet by fingerprints and hashes of runs, never in pairs.

    Null texts stay null with 0 lines. Repeated rows (same id and text) are one document, and each row comes back with the same result;
    rows with one id and several texts are several documents. Null ids come first. An empty table gives no rows. Columns with the names in
    `counts` are replaced; all others are kept, whatever they are called.
    """
    with temporary(df.sparkSession):
        removed = written(repeated_lines(df, min_words), "removed", keep=True)
    size = removed.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("removed")), F.lit(0)).alias("lines")).first()
    if size.docs <= BROADCAST_DOCS and size.lines <= BROADCAST_LINES:
        removed = F.broadcast(removed)
    base = df.drop(*counts)
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = base.select(F.struct(*(F.col(f"`{c}`") for c in base.columns)).alias("row"), th.alias("row_th"))
    joined = rows.join(removed, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("row_th") == F.col("th")), "left")
    split = F.split("row.text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("removed")), lambda i: F.get(split, i))
    text = F.when(F.array_join(kept, "").rlike(WORD), F.array_join(kept, "\n")).otherwise(F.lit(""))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(text)
    return joined.select(
        *(text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in base.columns),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(split)).cast("long").alias(counts[0]),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias(counts[1]),
    )


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of runs of lines of 50 words or more."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM d),
n AS (SELECT doc_id, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM l),
c AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS aft, sum(nw) OVER (PARTITION BY doc_id)::BIGINT AS total FROM n WHERE nw > 0),
b AS (SELECT *, (aft - nw)::BIGINT AS bef FROM c),
w AS (
  SELECT doc_id, total - bef >= 50 AS ok, list(md5(line)) OVER f AS run, min(pos) OVER f AS lo, max(pos) OVER f AS hi FROM b WINDOW f AS (PARTITION BY doc_id ORDER BY bef RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, aft >= 50 AS ok, list(md5(line)) OVER f AS run, min(pos) OVER f AS lo, max(pos) OVER f AS hi FROM b WINDOW f AS (PARTITION BY doc_id ORDER BY aft RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
u AS (SELECT DISTINCT doc_id, lo, hi, array_to_string(run, ',') AS run FROM w WHERE ok),
h AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, lo) AS k FROM u),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM h WHERE k > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, string_agg(l.line, '' ORDER BY l.pos) AS flat FROM l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id),
g AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT o.doc_id, CASE WHEN g.n_removed IS NULL THEN o.text WHEN regexp_matches(coalesce(k.flat, ''), '[^\x20\x09-\x0D]') THEN k.text ELSE '' END AS text,
  CASE WHEN o.text IS NULL THEN 0 ELSE len(string_split(o.text, chr(10))) END::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed
FROM documents o LEFT JOIN kept k ON k.doc_id = o.doc_id LEFT JOIN g ON g.doc_id = o.doc_id
"""
