"""Centroid clustering: plain Lloyd on whole numbers, so results don't depend on partitions or on the order of sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import temporary, written


@dataclass(frozen=True)
class Lloyd:
    """k centroids, rounds of moving them, components of a vector, units of the grid to one, seed of the first centroids, and the largest
    whole number that a component may become: squared distances of up to 64 such components stay below 2**63.
    """

    k: int = 16
    rounds: int = 3
    size: int = 64
    scale: int = 64
    seed: int = 1
    most: int = 1 << 27


def on_grid(df: DataFrame, s: Lloyd = Lloyd()) -> DataFrame:
    """vec_id and v (array of int), floor(scale * x) of each component x, of the vectors with `size` components, none null, NaN or infinite."""
    x = lambda c: c.cast("double")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(s.scale * x(c)))
    fits = F.forall(whole, lambda c: F.abs(c) <= s.most)
    checked = F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.concat(F.lit("a component is too large for exact distances: vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))))
    return df.select(F.col("vec_id").cast("long"), "embedding").filter((F.size("embedding") == s.size) & finite).select("vec_id", checked.alias("v"))


def first_centroids(kept: DataFrame, s: Lloyd = Lloyd()) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order (then of vec_id and components; null ids come last)."""
    key = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.col("vec_id").cast("string")), 256)
    top = kept.orderBy(key.asc_nulls_last(), "v").limit(s.k).collect()
    return np.array([r.v for r in top], np.int64).reshape(len(top), s.size)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest centroid (of equally near ones the first) and the squared distance, all in 64-bit integers."""
    distance = np.empty((len(x), len(centroids)), np.int64)
    for i, c in enumerate(centroids):
        difference = x - c
        distance[:, i] = np.einsum("ij,ij->i", difference, difference)
    cluster = distance.argmin(1)
    return cluster, distance[np.arange(len(x)), cluster]


def _matrix(v: pd.Series, size: int) -> np.ndarray:
    return np.concatenate(v.to_list()).astype(np.int64).reshape(len(v), size)


def moved(kept: DataFrame, centroids: np.ndarray, s: Lloyd = Lloyd()) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; those without vectors stay.

    Each task adds up its own vectors and hands on one row for each cluster and component, whatever number of vectors it has read.
    """
    sent = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for frame in frames:
            if len(frame):
                x = _matrix(frame["v"], s.size)
                cluster, _ = nearest(x, c)
                n += np.bincount(cluster, minlength=len(c))
                for i in np.unique(cluster):
                    total[i] += x[cluster == i].sum(0)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": np.repeat(some, s.size), "place": np.tile(np.arange(s.size), len(some)), "n": np.repeat(n[some], s.size), "total": total[some].ravel()})

    parts = kept.select("v").mapInPandas(run, "cluster int, place int, n long, total long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # k * size rows
        out[r.cluster, r.place] = r.total // r.n
    sent.unpersist()
    return out


def assigned(kept: DataFrame, centroids: np.ndarray, s: Lloyd = Lloyd()) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    sent = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cluster, distance = nearest(_matrix(frame["v"], s.size), sent.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": cluster.astype(np.int32), "distance": distance})

    return kept.select("vec_id", "v").mapInPandas(run, "vec_id long, cluster int, distance long")


def clustered(df: DataFrame, s: Lloyd = Lloyd()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for every vector that on_grid keeps.

    Vectors become whole numbers once, in a table of about a quarter of the floats' size that all rounds read. A round sends the centroids
    to the tasks and gets their sums back; no vector is shuffled, so vectors that very many rows share are no burden to one task.

    Null, short, long and non-finite vectors are left out; a component beyond 2**27 units of the grid raises an error, since its distance has
    no place in a long. Repeated rows are vectors of their own and may be first centroids of their own; a null vec_id is a first centroid
    only if there are too few others. Fewer vectors than k: as many centroids; no vectors: no rows. Columns but vec_id and embedding are
    not looked at.
    """
    spark = df.sparkSession
    with temporary(spark):
        kept = written(on_grid(df, s), "grid")
        centroids = first_centroids(kept, s)
        for _ in range(s.rounds if len(centroids) else 0):
            centroids = moved(kept, centroids, s)
        out = assigned(kept, centroids, s) if len(centroids) else spark.createDataFrame([], "vec_id long, cluster int, distance long")
        out = written(out, "clusters", keep=True)
    sums = {r.cluster: r.inertia for r in out.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(i, sums[i], sum(sums.values()), digest(c)) for i, c in enumerate(centroids) if i in sums]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with 64 finite components in 16 clusters after 3 rounds."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(s: Lloyd = Lloyd()) -> str:
    vector = f"list_transform(embedding, lambda x: CAST(floor({s.scale} * CAST(x AS DOUBLE)) AS BIGINT))"
    kept = f"len(embedding) = {s.size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {s.size}"
    near = "SELECT v.vec_id, v.v, arg_min(c.i, (d, c.i)) AS i, min(d) AS d FROM v, c{r} c, LATERAL (SELECT list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d) GROUP BY v.vec_id, v.v"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, {vector} AS v FROM embeddings WHERE {kept})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS i, v AS c FROM (SELECT sha256('{s.seed}:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {s.k}))",
    ]
    for r in range(s.rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({near.format(r=r)})",
            f"u{r} AS (SELECT i, p, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS q FROM (SELECT i, unnest(v) AS x, unnest(range(1, {s.size + 1})) AS p FROM a{r}) GROUP BY i, p)",
            f"m{r} AS (SELECT i, list(q ORDER BY p) AS c FROM u{r} GROUP BY i)",
            f"c{r + 1} AS MATERIALIZED (SELECT o.i, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON m.i = o.i)",
        ]
    return (
        "WITH " + ",\n".join(parts) + f",\nz AS MATERIALIZED ({near.format(r=s.rounds)})\n"
        "SELECT z.vec_id, z.i::INTEGER AS cluster, z.d AS distance, (sum(z.d) OVER (PARTITION BY z.i))::BIGINT AS cluster_inertia, (sum(z.d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM z JOIN c{s.rounds} c ON c.i = z.i"
    )


OP12_SQL = _sql()
