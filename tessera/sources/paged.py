"""A paged source as a Spark data source: pages are fetched in batches, and a batch without a new key ends the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    """Options: module and function of `fetch(page) -> list[dict]`, max_pages, batch, key. Rows: page, key, payload (JSON).

    The order of pages decides where the scan stops, so one source is one partition; sources run beside each other.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, key string, payload string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        import importlib
        import json

        fetch = getattr(importlib.import_module(self.options["module"]), self.options["function"])
        for page, row in scan(fetch, int(self.options.get("max_pages", 50)), int(self.options.get("batch", 3)), self.options.get("key", "url")):
            yield page, row.get(self.options.get("key", "url")), json.dumps(row, ensure_ascii=False)


def scan(fetch: Callable[[int], list[dict]], max_pages: int, batch: int = 3, key: str = "url") -> Iterator[tuple[int, dict]]:
    """Rows with a key not seen before, page by page; stops after a batch that brings none. A page that fails is an empty one; rows without key all stay."""
    seen: set = set()
    for first in range(1, max_pages + 1, batch):
        new = 0
        for page in range(first, min(first + batch, max_pages + 1)):
            try:
                rows = fetch(page)
            except Exception:  # noqa: BLE001  a source's failure on one page does not end the scan
                rows = []
            for row in rows:
                k = (row.get(key) or "").split("?")[0].split("#")[0].rstrip("/")
                if k and k in seen:
                    continue
                seen.add(k)
                new += 1
                yield page, row
        if not new:
            return


def paging_stats(rows: DataFrame, max_pages: int) -> DataFrame:
    """One row: pages with new rows, whether the last possible page still brought some, new rows by page."""
    per = rows.groupBy("page").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("pages"), F.coalesce(F.max("page") >= max_pages, F.lit(False)).alias("hit_cap"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "n")))).alias("new_by_page"))


def classify_run(df: DataFrame) -> DataFrame:
    """Adds verdict to source runs (pages, rows, blocked, errors, empty_pages): what to do about each."""
    verdict = F.when(F.col("rows") > 0, "ok").when(F.col("blocked") > 0, "blocked").when(F.col("errors") > 0, "error").when(F.col("empty_pages") == F.col("pages"), "no_inventory").otherwise("parser_broken")
    return df.withColumn("verdict", verdict)


def compare_runs(before: DataFrame, now: DataFrame, ratio: float = 0.80) -> DataFrame:
    """By source: rows before and now and whether it holds up (at least so large a share); a source that is missing now fails."""
    b, n = before.select("source", F.col("rows").alias("before")), now.select("source", F.col("rows").alias("now"))
    return b.join(n, "source", "left").withColumn("verdict", F.when(F.col("now").isNull(), "missing").when(F.col("now") >= ratio * F.col("before"), "ok").otherwise("fell"))
