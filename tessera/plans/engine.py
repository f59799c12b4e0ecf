"""One method per analytic request over a store: a search, a building, histories, reference prices, export."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import History, Pairing, Refining, Rules
from ..functions.numbers import variation_percent
from ..functions.text import city_and_region, development_name, launch_flag, launch_name, list_key, normalize, url_key
from ..operators import dedup, export, grouping, history, lookup, quality, refine, stats
from ..schema import union_sources
from ..shared import written
from ..sources import catalogue, details
from ..sources.tables import Store

REGIONS = frozenset("AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split())


@dataclass(frozen=True)
class SearchRequest:
    """What a search asks for; city reads 'City, UF'."""

    city: str
    price_min: float
    price_max: float
    rooms: int | None = None
    baths: int | None = None
    districts: tuple[str, ...] = ()
    building_type: str | None = None

    def __post_init__(self):
        if self.city.rpartition(",")[2].strip().upper() not in REGIONS:
            raise ValueError("city must read 'City, UF' with a known region")
        if not 0 < self.price_min <= self.price_max:
            raise ValueError("price range is empty")


@dataclass
class SearchResult:
    """listings with group and score, one-row kpis, by_district, groups, funnel, sources."""

    listings: DataFrame
    kpis: DataFrame
    by_district: DataFrame
    groups: DataFrame
    funnel: DataFrame
    sources: DataFrame
    median_by_building: DataFrame
    extras: dict = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession, root: str, rules: Rules = Rules(), pairing: Pairing = Pairing(), refining: Refining = Refining(), past: History = History()):
        self.spark, self.store, self.rules, self.pairing, self.refining, self.past = spark, Store(spark, root), rules, pairing, refining, past

    def reference_price(self, city: str, rooms: int | None) -> float | None:
        table = self.store.read("reference_price")
        if table is None:
            return None
        row = stats.latest_reference(table.filter(F.col("rooms").eqNullSafe(F.lit(rooms)) | F.col("rooms").isNull())).filter(F.col("city_key") == normalize(F.lit(city))).orderBy(F.col("rooms").isNull()).limit(1).first()
        return row.reference if row else None

    def set_reference_price(self, city: str, rooms: int | None, price_m2: float, at: datetime) -> None:
        self.store.put("reference_price", self.spark.createDataFrame([(city, rooms, price_m2, at)], "city string, rooms int, price_m2 double, updated_at timestamp_ntz"), ["city", "rooms"], "updated_at")

    def search(self, request: SearchRequest, sources: dict[str, DataFrame]) -> SearchResult:
        """The whole chain: union, validation, filters, first by url, cross-source dedup, outlier cut, imputation, anomalies, places, names, groups.

        The order matters: centroids come after the outlier cut, coverage before centroids; kept rows and counted discards add up to the input.
        """
        rows = union_sources(list(sources.values()))
        checked = written(quality.with_reason(rows, {"rooms": request.rooms, "baths": request.baths, "price_min": request.price_min, "price_max": request.price_max}, self.rules), "checked")
        lost = [quality.funnel(checked)]
        count = lambda before, after, reason: self.spark.createDataFrame([(reason, before - after)], "reason string, n long")
        kept = checked.filter("reject_reason IS NULL").drop("reject_reason")
        steps = []
        if request.building_type:
            steps.append(("other_building_type", lambda df: quality.of_type(df, request.building_type)))
        if request.districts:
            steps.append(("outside_districts", lambda df: df.filter(quality.in_districts(list(request.districts)))))
        steps += [
            ("duplicate_url", quality.first_by_url),
            ("duplicate_sources", lambda df: dedup.deduplicate(df, self.pairing)),
            ("outlier", lambda df: stats.outlier_band(df, ["city", "rooms"], low=self.refining.low, high=self.refining.high, least=self.refining.group_least).filter(~F.col("outlier")).drop("group_median", "group_n", "outlier")),
            ("anomaly", lambda df: refine.refine(refine.impute(df.drop("score", "imputed"), sorted(sources), self.refining), sorted(sources), self.refining).filter(~F.col("rejected")).drop("rejected")),
        ]
        n = kept.count()
        for reason, step in steps:
            kept = written(step(kept), "kept")
            before, n = n, kept.count()
            lost.append(count(before, n, reason))
        covered = quality.coverage(kept)
        kept = stats.fill_centroids(kept)
        name = F.coalesce(F.nullif(F.col("dev_name"), F.col("title")), development_name(F.col("title")), launch_name(F.col("url")))
        kept = kept.withColumns({"dev_name": name, "is_launch": F.coalesce("is_launch", launch_flag(F.col("url"), F.concat_ws(" ", "title", "descr")))})
        reference = self.reference_price(request.city, request.rooms)
        kept = written(kept.withColumn("vs_reference", variation_percent(F.col("price_m2"), F.lit(reference).cast("double"))), "kept")
        grouped = written(grouping.group_listings(kept), "grouped")
        groups = written(grouping.summarize_groups(kept, grouped), "groups")
        linked = grouped.join(groups.select("root", "group_id"), "root", "left").select("idx", "group_id", F.col("link").alias("group_link"))
        listings = kept.drop("group_id", "group_link").join(linked, "idx", "left")
        status = quality.source_status(self.spark.createDataFrame([(s,) for s in sorted(sources)], "source string"), rows.groupBy("source").agg(F.count("*").alias("n")).withColumn("failed", F.lit(False)))
        return SearchResult(listings.orderBy("price_m2", "idx"), stats.kpis(kept), stats.by_requested_district(kept, list(request.districts)), grouping.order_groups(groups), quality.combined_funnel(*lost).filter("n > 0"), status, grouping.median_by_building(listings), {"coverage": covered, "reference": reference})

    def save(self, search_id: str, request: SearchRequest, result: SearchResult, at: datetime) -> None:
        k = result.kpis.first()
        row = [(search_id, request.city, float(request.price_min), float(request.price_max), request.rooms, request.baths, request.building_type, ",".join(request.districts), k.n, k["mean"], k.median, at)]
        search = self.spark.createDataFrame(row, "search_id string, city string, price_min double, price_max double, rooms int, baths int, building_type string, districts string, n long, mean double, median double, created_at timestamp_ntz")
        search = search.withColumn("district_key", list_key(F.split("districts", ",")))
        self.store.append_search(search, result.listings.withColumns({"search_id": F.lit(search_id), "city": F.lit(request.city), "collected_at": F.coalesce("collected_at", F.lit(at))}))

    def cached(self, request: SearchRequest, now: datetime) -> str | None:
        """The newest identical search of the last hour."""
        table = self.store.read("searches")
        if table is None:
            return None
        want = {"city": request.city, "price_min": float(request.price_min), "price_max": float(request.price_max), "rooms": request.rooms, "baths": request.baths, "building_type": request.building_type}
        same = table.filter(F.col("created_at") >= F.lit(now - timedelta(minutes=self.past.cache_minutes)))
        for c, v in want.items():
            same = same.filter(F.col(c).eqNullSafe(F.lit(v).cast(same.schema[c].dataType)))
        same = same.filter(F.col("district_key") == list_key(F.array(*[F.lit(d) for d in request.districts]).cast("array<string>")))
        row = same.agg(F.max_by("search_id", "created_at").alias("id")).first()
        return row.id

    def city_history(self, city: str, rooms: int | None = None) -> DataFrame:
        """Observations of a city in any spelling; with a region both must agree, without one the name alone."""
        searches = self.store.read("searches")
        have, want = city_and_region(F.col("city")), city_and_region(F.lit(city))
        same = (have["city"] == want["city"]) & (want["region"].isNull() | have["region"].isNull() | (have["region"] == want["region"]))
        spellings = searches.select("city").distinct().filter(same)
        return history.history_rows(self.store.read("observations"), searches, spellings, rooms)

    def evolution(self, city: str, rooms: int | None = None) -> DataFrame:
        return history.weekly_series(history.latest_per_period(self.city_history(city, rooms), "key", "seen_at", "idx"), "price_m2", [], self.past)

    def district_evolution(self, city: str, names: list[str] | None = None, rooms: int | None = None) -> DataFrame:
        return history.district_evolution(self.city_history(city, rooms), "key", "seen_at", "district", "price_m2", "idx", names, self.past)

    def compare_with_previous(self, result: SearchResult, previous_id: str) -> DataFrame:
        before = self.store.search(previous_id)[1].withColumn("key", url_key(F.col("url")))
        return history.snapshot_diff(result.listings.withColumn("key", url_key(F.col("url"))), before, "key", "price", "source", "idx", self.past)

    def _seen(self, rows: DataFrame) -> DataFrame:
        """One row a listing, the last seen; idx is made from its key, as searches may have used the same numbers for different listings."""
        seen = history.first_last_seen(rows, "key", "seen_at", "idx").withColumn("idx", F.xxhash64("key"))
        return written(history.with_activity(seen, ["source", "district"], self.past), "seen")

    def find(self, city: str, target: lookup.Target) -> tuple[DataFrame, DataFrame]:
        """Confirmed and probable listings of a building in a city's history, one row a listing."""
        seen = self._seen(self.city_history(city))
        return lookup.find_building(seen, target, written(grouping.group_listings(seen), "grouped"))

    def enrich(self, listings: DataFrame, pages: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
        """Listings with gaps filled from detail pages (url, html), which are read once and then remembered, and what was read."""
        return details.enriched(listings, pages, self.store, now)

    def references(self, wanted: DataFrame, pages: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
        """Official identities of wanted buildings (target_id, city, name) from catalogue pages (url, html) or what is remembered of them, and what was read.

        A row of the first is what Target takes as its reference.
        """
        return catalogue.official_references(wanted, pages, self.store, now)

    def dossier(self, city: str, group_id: str) -> DataFrame:
        """The listings of a building that some search stored under this id, as the city's history is grouped now; active ones first."""
        rows = self.city_history(city)
        seen = self._seen(rows)
        stored = rows.groupBy(F.xxhash64("key").alias("idx")).agg(F.collect_set("group_id").alias("group_ids"))
        return lookup.order_listings(lookup.dossier(seen, stored, written(grouping.group_listings(seen), "grouped"), group_id))

    def districts(self, city: str, typed: str = "", chosen: tuple[str, ...] = (), most: int = 12) -> DataFrame:
        """Districts of a city's history that hold the typed text and are not chosen yet, each in its preferred spelling."""
        rows = self.city_history(city).filter("district IS NOT NULL").select("district", "idx")
        return lookup.suggest(stats.preferred_spelling(rows, "district"), "spelling", typed, most, chosen)

    def searches(self, city: str | None = None, most: int = 20) -> DataFrame:
        """The newest stored searches, of all cities or of those whose name holds the text."""
        return self.store.searches(city, most)

    def stored_search(self, search_id: str) -> tuple[DataFrame, DataFrame]:
        """A stored search (no row if there is none) and its listings, the cheapest by area first."""
        search, rows = self.store.search(search_id)
        return search, rows.orderBy("price_m2", "idx")

    def delete_search(self, search_id: str) -> bool:
        """Removes a stored search and its listings; whether there was one."""
        there = self.store.search(search_id)[0].limit(1).count() > 0
        if there:
            self.store.delete_search(search_id)
        return there

    def export(self, result: SearchResult, path: str) -> None:
        reference = result.extras.get("reference")
        export.write_bundle({"listings": export.listings_table(result.listings, reference), "districts": export.districts_table(result.listings, reference), "summary": export.summary_table(result.listings, reference), "groups": result.groups, "parameters": export.parameters_table(self.spark, reference)}, path)
