"""Catalogue: series clustering, embedding, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.plans import clustering
from dayloom.plans.catalog import query
from dayloom.plans.queries_features import series_rows
from dayloom.plans import standins
from dayloom.plans.standins import Tables
from dayloom.session import materialise


#: Best swaps tried after the rounds of the Euclidean medoids.
SWAPS = 20


def _series(t: Tables) -> DataFrame:
    """Series of the two years that facts are loaded for by default; every alignment of their days is allowed."""
    recent = series_rows(t).where(F.col("ds") > F.add_months(standins.newest_day(t), -24))
    return materialise(clustering.series_vectors(recent), "series")


@query("dtw_cluster")
def dtw_cluster(t: Tables) -> DataFrame:
    """Five clusters of the daily growth series under the soft warping distance."""
    return clustering.cluster_series(_series(t), 5)


@query("dtw_scan")
def dtw_scan(t: Tables) -> DataFrame:
    """Validity indices for three to nine clusters under the soft warping distance."""
    return clustering.scan_k(_series(t))


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("entity_id"), F.col("embedding").cast("array<double>").alias("values")
    )


@query("pam_cluster")
def pam_cluster(t: Tables) -> DataFrame:
    """Five medoid clusters of vectors under the Euclidean distance."""
    return clustering.cluster_series(_vectors(t), 5, distance="euclidean", swaps=SWAPS)


@query("pam_silhouette")
def pam_silhouette(t: Tables) -> DataFrame:
    """Five validity indices for three to nine medoid clusters."""
    return clustering.scan_k(_vectors(t), distance="euclidean", swaps=SWAPS)


def _points(t: Tables, components: int) -> DataFrame:
    return clustering.embed(_vectors(t), "entity_id", "values", components)


@query("embed_pca")
def embed_pca(t: Tables) -> DataFrame:
    """Two-dimensional embedding of vectors."""
    return _points(t, 2).select("entity_id", F.col("point")[0].alias("v1"), F.col("point")[1].alias("v2"))


@query("embed_cluster")
def embed_cluster(t: Tables) -> DataFrame:
    """Five medoid clusters on a five-dimensional embedding."""
    return clustering.cluster_series(_points(t, 5), 5, values="point", distance="euclidean", swaps=SWAPS)


@query("consensus_cluster")
def consensus_cluster(t: Tables) -> DataFrame:
    """Consensus of four algorithms over seeded resamples of the embedding."""
    points = materialise(_points(t, 2), "points")
    labelled, runs = clustering.base_runs(points, [5], reps=3)
    return clustering.consensus(materialise(labelled, "labels"), runs, 5).select("entity_id", "cluster")


@query("subset_search")
def subset_search(t: Tables) -> DataFrame:
    """Silhouette of the consensus for every algorithm subset and cluster count, best one marked."""
    points = materialise(_points(t, 2), "points")
    table, _, _ = clustering.subset_search(points)
    best = clustering.best_configuration(table).select("id", F.lit(True).alias("best"))
    return table.join(F.broadcast(best), "id", "left").na.fill({"best": False})
