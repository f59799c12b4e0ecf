"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder and rereads it. docs has
doc_id and text and may have any other columns, which all stages but the last return as they are (n_chars follows the text). Rows are told
apart by a hash of id and text, so a decision about one row never takes another with the same id, and rows without id are judged like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, written
from tessera.llm.decontaminate import contaminated
from tessera.llm.lines import dedup_lines
from tessera.llm.neardup import Join, near_duplicates
from tessera.llm.packing import PRODUCTION, first_line, pack
from tessera.llm.quality import THRESHOLD, score, train


def _row_key(th: Column) -> Column:
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), th)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    """All columns as one, and the row's key, so that no column's name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _row_key(_text_hash()).alias("key"))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is not among the keys, which are broadcast if there are few (8 bytes each)."""
    keys = written(keys.select("key").distinct(), "keys")
    if keys.count() <= Join.broadcast:
        keys = F.broadcast(keys)
    return _keyed(docs).join(keys, "key", "left_anti").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier does not reject (score at least 0.3); a null text is judged as an empty one."""
    model, name = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), fresh(docs, "score")
    return score(docs, model, name).filter(F.col(name) >= THRESHOLD).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of runs of lines of 50 words or more; a document of which nothing else was there goes. n_chars follows the text."""
    before, out = fresh(docs, "n_before"), fresh(docs, "n_out")
    left = dedup_lines(docs, counts=(before, out)).filter((F.col(out) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col(out) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near-duplicates (five words, 0.8); rows without id have the largest.

    Repeated rows (same id and text) become one row. Texts without words have no near-duplicates.
    """
    groups = written(near_duplicates(docs, Join(words=5, percent=80)), "groups").withColumn("key", _row_key(F.col("th")))
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("component_th"))
    left = _without(docs, groups.filter(~first))
    twice = written(groups.filter(first).groupBy("key").count().filter("count > 1").select("key"), "twice")
    if not twice.limit(1).count():
        return left
    rows = _keyed(left)
    once = rows.join(twice, "key", "left_anti").select("row")
    return once.unionByName(rows.join(twice, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    found = contaminated(docs.select(_row_key(_text_hash()).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select(F.col("doc_id").alias("key")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; a first line bears no loss."""
    return pack(docs, limits=PRODUCTION, prompt_chars=first_line(F.col("text")))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_dup), ("benchmark decontamination", decontamination), ("packing", packing)]

#: SQL can't express the classifier, the tokenizer and the packing; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
