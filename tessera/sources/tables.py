"""Stored tables: searches and their observations, reference prices, caches with an expiry, attempts. Files are never rewritten: a table is a list of
batches, and a change is a new list that takes the old one's place in one step."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators.history import unexpired
from ..operators.stats import upsert

_one_writer = threading.Lock()


class Conflict(Exception):
    """Another writer has changed the table since it was read, again and again."""


class Store:
    """Tables under one folder, each with `data/batch=<id>` folders and `versions/<n>` files that list the batches that count.

    A writer first writes its batch, then the next version, which it may create only if nobody else has: then it starts over from the newer
    one. A writer that dies in between leaves a batch that no version lists; readers see whole versions only, and go on reading the batches
    of theirs while the next is written. `vacuum` removes what no recent version lists. The folder's file system must refuse to rename
    onto a file that is there, as HDFS does.
    """

    def __init__(self, spark: SparkSession, root: str, tries: int = 8):
        self.spark, self.root, self.tries = spark, root.rstrip("/"), tries

    # files of a table

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self, path) -> list:
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []

    def version(self, name: str) -> int:
        """The number of the table's newest version; 0 if there is no table."""
        return max((int(p.getName()) for p in self._files(self._path(name, "versions")) if p.getName().isdigit()), default=0)

    def batches(self, name: str, version: int | None = None) -> list[str]:
        version = self.version(name) if version is None else version
        if not version:
            return []
        path = self._path(name, "versions", f"{version:012d}")
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _switch(self, name: str, before: int, batches: list[str]) -> bool:
        """Makes the list of batches version before + 1; False if that version is there already."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        new, own = self._path(name, "versions", f"{before + 1:012d}"), self._path(name, "versions", f".{uuid.uuid4().hex}")
        fs = own.getFileSystem(conf)
        stream = fs.create(own)
        stream.write(json.dumps(batches).encode())
        stream.close()
        try:
            with _one_writer:  # a local file system looks and renames in two steps
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), conf).rename(own, new, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            fs.delete(own, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise

    def _write(self, name: str, rows: DataFrame, by: list[str], kind: str = "rows") -> str:
        batch = f"{kind}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*by).parquet(f"{self.root}/{name}/data/batch={batch}")
        return batch

    def change(self, name: str, change: Callable[[DataFrame | None, list[str]], tuple[DataFrame | None, list[str]]], by: list[str] = []) -> None:  # noqa: B006
        """Replaces the table by what `change` makes of it: from its rows (with batch) and batches, new rows and the batches that stay.

        Done again from the newer version where another writer was first.
        """
        for _ in range(self.tries):
            version = self.version(name)
            old = self.batches(name, version)
            rows, kept = change(self._rows(name, old), old)
            if rows is None:
                new = []
            elif by and rows.isEmpty():  # without partitions it still says what the columns are
                new = [] if kept else [self._write(name, rows, [], "none")]
            else:
                new = [self._write(name, rows, by)]
            if self._switch(name, version, [*kept, *new]):
                return
        raise Conflict(f"{name}: {self.tries} times another writer was first")

    def append(self, name: str, rows: DataFrame, by: list[str] = []) -> None:  # noqa: B006
        """Adds rows as a batch; other writers' batches don't matter to it, so it is written once."""
        batch = self._write(name, rows, by)
        for _ in range(self.tries):
            version = self.version(name)
            if self._switch(name, version, [*self.batches(name, version), batch]):
                return
        raise Conflict(f"{name}: {self.tries} times another writer was first")

    def vacuum(self, name: str, keep: int = 2, hours: float = 24) -> int:
        """Removes batches that none of the newest `keep` versions lists and older version files; batches younger than `hours` may be a writer's and stay."""
        newest = self.version(name)
        listed = {b for v in range(max(1, newest - keep + 1), newest + 1) for b in self.batches(name, v)}
        fs = self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [p for p in self._files(self._path(name, "versions")) if p.getName().isdigit() and int(p.getName()) <= newest - keep]
        limit = datetime.now().timestamp() - hours * 3600
        gone = [p for p in self._files(self._path(name, "data")) if p.getName().removeprefix("batch=") not in listed and fs.getFileStatus(p).getModificationTime() / 1000 < limit]
        for p in [*old, *gone]:
            fs.delete(p, True)
        return len(gone)

    # rows

    def _rows(self, name: str, batches: list[str]) -> DataFrame | None:
        if not batches:
            return None
        at = f"{self.root}/{name}/data"
        batches = [b for b in batches if not b.startswith("none-")] or batches
        return self.spark.read.option("mergeSchema", "true").option("basePath", at).parquet(*(f"{at}/batch={b}" for b in batches))

    def read(self, name: str, schema: str | None = None, version: int | None = None) -> DataFrame | None:
        """The table's newest version, or an earlier one; without a table None, or no rows of the schema given."""
        rows = self._rows(name, self.batches(name, version))
        if rows is not None:
            return rows.drop("batch")
        return self.spark.createDataFrame([], schema) if schema else None

    def append_search(self, search: DataFrame, rows: DataFrame) -> None:
        """A search (one row, search_id) and its observations; columns may be added later and are null in older rows.

        Observations come first: those without a search are in no history.
        """
        rows = rows.withColumns({"city_part": F.regexp_replace(normalize(F.col("city")), "[^a-z0-9]+", "-"), "month_part": F.date_format("collected_at", "yyyy-MM")})
        self.append("observations", rows, ["city_part", "month_part"])
        self.append("searches", search)

    def searches(self, city: str | None = None, most: int = 20) -> DataFrame:
        df = self.read("searches")
        if city:
            df = df.filter(F.contains(normalize(F.col("city")), normalize(F.lit(city))))
        return df.orderBy(F.desc("created_at"), "search_id").limit(most)

    def search(self, search_id: str) -> tuple[DataFrame, DataFrame]:
        return self.read("searches").filter(F.col("search_id") == search_id), self.read("observations").filter(F.col("search_id") == search_id)

    def delete_search(self, search_id: str) -> None:
        """Both tables without a search; only batches that hold rows of it are written anew.

        The search goes first: observations without one are in no history, and a delete that broke off may be repeated.
        """

        def without(rows: DataFrame | None, batches: list[str]) -> tuple[DataFrame | None, list[str]]:
            if rows is None:
                return None, batches
            hit = [r.batch for r in rows.filter(F.col("search_id") == search_id).select("batch").distinct().collect()]
            left = rows.filter(F.col("batch").isin(hit) & ~F.col("search_id").eqNullSafe(F.lit(search_id))).drop("batch")
            return (left if hit else None), [b for b in batches if b not in hit]

        self.change("searches", without)
        self.change("observations", without, ["city_part", "month_part"])

    def put(self, name: str, rows: DataFrame, keys: list[str], order: str) -> None:
        """Adds rows to a small table; of each key the last by `order` stays."""
        self.change(name, lambda table, _: (rows if table is None else upsert(table.drop("batch"), rows, keys, order), []))

    def cached(self, kind: str, now: Column | datetime) -> DataFrame:
        """Entries of the identity cache that are valid now; a null payload is a remembered miss."""
        table = self.read("identity_cache", CACHE)
        return unexpired(table, kind, now if isinstance(now, Column) else F.lit(now))


CACHE = "kind string, key string, source string, url string, payload string, read_at timestamp_ntz, expires_at timestamp_ntz"


def municipalities(places: DataFrame, population: DataFrame, regions: tuple[str, ...] = ()) -> DataFrame:
    """name, region, key and population of municipalities, largest first; both feeds meet on 'Name - UF'."""
    key = F.concat_ws(" - ", "name", "region")
    p = population.select(F.col("label").alias("_l"), "population")
    df = places.join(p, key == F.col("_l"), "left").select("name", "region", normalize(F.col("name")).alias("key"), F.coalesce("population", F.lit(0)).alias("population"))
    return (df.filter(F.col("region").isin(*regions)) if regions else df).orderBy(F.desc("population"), "name")


def sample_listings(spark: SparkSession, city: str, price_min: float, price_max: float, rooms: int | None = None, n: int = 12, seed: int = 0) -> DataFrame:
    """Made-up listings inside the requested range, the same for the same seed."""
    price = F.round(F.lit(price_min) + F.rand(seed) * (price_max - price_min), 2)
    df = spark.range(n).select(F.col("id").alias("idx"), F.concat(F.lit("Sample "), F.col("id").cast("string")).alias("title"), F.lit(city).alias("city"), F.lit("sample").alias("source"), price.alias("price"), F.round(40 + F.rand(seed + 1) * 80, 1).alias("area"), F.lit(rooms or 2).alias("rooms"), F.concat(F.lit("https://sample.example/"), F.col("id").cast("string")).alias("url"))
    return df.withColumn("price_m2", F.round(F.col("price") / F.col("area"), 2))
