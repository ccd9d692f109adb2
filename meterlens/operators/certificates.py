"""Checks of a finished grouping from its tables alone: what any right result fulfils, whichever starts it came from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlens.operators.clusters import (
    CompanyClusters,
    Scaling,
    label_column,
    scaled_points,
    silhouette_scores,
)

#: How far a center may lie from its members' mean, in scaled units: centers stop when they move less than this.
TOLERANCE = 1e-4


def _row(check: str, violations: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), F.coalesce(violations.cast("long"), F.lit(0)).alias("violations"))


def _gap(features: Sequence[str], scaling: Scaling, other) -> Column:
    """Squared distance in scaled units between a row's features and `other(feature)`."""
    parts = [((F.col(f).cast("double") - other(f)) / scaling.scale[f]) ** 2 for f in features]
    return reduce(Column.__add__, parts)


def nearest_centers(groups: CompanyClusters, features: Sequence[str], scaling: Scaling) -> DataFrame:
    """(company_id, is_nearest): whether no center lies nearer than that of the company's own cluster."""
    centers = groups.centers.select("cluster_number", *features).collect()  # at most k_max rows
    gaps = F.array(*[_gap(features, scaling, lambda f, c=c: F.lit(c[f])) for c in centers])
    own = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(centers) for x in (c["cluster_number"], i + 1)]), F.col("cluster_number"))
    return groups.assignments.select("company_id", (F.element_at(gaps, own) <= F.array_min(gaps) + 1e-9).alias("is_nearest"))


def center_checks(groups: CompanyClusters, features: Sequence[str], scaling: Scaling) -> DataFrame:
    """(check, violations) of the centers: members' means, sizes, names, stable numbers, and the cost of the chosen k."""
    members = groups.assignments.groupBy("cluster_number").agg(
        *[F.avg(f).alias(f"_mean_{f}") for f in features],
        F.count("*").alias("_members"),
        F.count_if(F.col("cluster_id") != F.concat(F.lit("Cluster "), F.col("cluster_number").cast("string"))).alias("_misnamed"),
        F.countDistinct("cluster_description").alias("_texts"),
        F.min("cluster_description").alias("_text"),
    )
    joined = groups.centers.join(members, "cluster_number", "full_outer")
    far = F.greatest(*[F.abs(F.col(f) - F.col(f"_mean_{f}")) / scaling.scale[f] for f in features]) > TOLERANCE + 1e-9
    along = W.orderBy("cluster_number")  # at most k_max rows
    before = lambda c: F.lag(c).over(along)
    ratio, week = F.col("peak_offpeak_ratio"), F.col("weekday_weekend_ratio")
    late = (ratio < before("peak_offpeak_ratio")) | ((ratio == before("peak_offpeak_ratio")) & (week < before("weekday_weekend_ratio")))
    flags = joined.withColumn("_late", late | (F.col("cluster_number") != F.row_number().over(along)))
    found = flags.agg(
        F.count_if(F.coalesce(far, F.lit(True))).alias("far"),
        F.count_if(~F.col("company_count").eqNullSafe(F.col("_members"))).alias("sizes"),
        F.count_if((F.col("_misnamed") > 0) | (F.col("_texts") != 1) | (F.col("_text") != F.col("cluster_description"))).alias("names"),
        F.count_if(F.coalesce("_late", F.lit(False))).alias("late"),
    )
    own = groups.centers.select("cluster_number", *[F.col(f).alias(f"_{f}") for f in features])
    spread = groups.assignments.join(F.broadcast(own), "cluster_number")  # at most k_max rows
    cost = spread.agg(F.sum(_gap(features, scaling, lambda f: F.col(f"_{f}")))).first()[0]
    chosen = [r["inertia"] for r in groups.evaluation.where("is_selected").collect()]
    wrong_cost = not chosen or abs(cost - chosen[0]) > 1e-6 * max(1.0, chosen[0])
    return found.select(
        F.inline(
            F.array(
                _row("center_is_members_mean", F.col("far")),
                _row("company_count_is_members", F.col("sizes")),
                _row("names_follow_numbers", F.col("names")),
                _row("numbers_in_stable_order", F.col("late")),
                _row("inertia_is_distance_to_centers", F.lit(int(wrong_cost))),
                _row("one_k_is_selected", F.lit(int(len(chosen) != 1))),
            )
        )
    )


def choice_checks(groups: CompanyClusters, features: Sequence[str], scaling: Scaling, sizes: Mapping[int, int]) -> DataFrame:
    """(check, violations) of the choice of k: the first silhouette maximum, its score, falling costs, the summary."""
    k = len(sizes)
    own = groups.assignments.select("company_id", (F.col("cluster_number") - 1).alias(label_column(k)))
    points = scaled_points(groups.assignments, features, scaling).join(own, "company_id")
    score = silhouette_scores(points, [k], {k: {n - 1: m for n, m in sizes.items()}})[k]
    e, whole = groups.evaluation, W.partitionBy()  # one row per k
    best = F.max("silhouette_score").over(whole)
    flags = e.withColumns(
        {
            "_first": F.min(F.when(F.col("silhouette_score") == best, F.col("k"))).over(whole),
            "_rise": F.col("inertia") > F.lag("inertia").over(W.orderBy("k")) * (1 + 1e-9),
        }
    )
    found = flags.agg(
        F.count_if(F.col("is_selected") != (F.col("k") == F.col("_first"))).alias("first"),
        F.count_if(F.col("is_selected") & (F.abs(F.col("silhouette_score") - score) > 1e-9)).alias("score"),
        F.count_if(F.col("is_elbow_choice")).alias("elbows"),
        F.count_if("_rise").alias("rises"),
        F.max(F.when(F.col("is_selected"), F.col("k"))).alias("k"),
    )
    s = groups.summary.first()
    counted = s["companies_clustered"] + s["companies_excluded"] == s["companies_total"] and s["companies_clustered"] == sum(sizes.values())
    bounds = (s["minimum_cluster_size"], s["maximum_cluster_size"]) == (min(sizes.values()), max(sizes.values()))
    return found.select(
        F.inline(
            F.array(
                _row("selected_k_is_first_maximum", F.col("first")),
                _row("silhouette_is_that_of_the_groups", F.col("score")),
                _row("one_elbow", (F.col("elbows") != 1).cast("int")),
                _row("cost_falls_with_k", F.col("rises")),
                _row("summary_has_the_selected_k", (F.col("k") != s["selected_k"]).cast("int")),
                _row("summary_counts_add_up", F.lit(int(not (counted and bounds)))),
            )
        )
    )


def grid_checks(sensitivity: DataFrame, companies: int) -> DataFrame:
    """(scaler, k, sizes_fit, score_in_range) of every scaler and k: sizes around the mean size, scores from -1 to 1."""
    share = F.lit(companies) / F.col("k")
    low, high = F.col("minimum_cluster_size"), F.col("maximum_cluster_size")
    return sensitivity.select(
        "scaler",
        "k",
        ((low >= 1) & (low <= share) & (high >= share) & (high <= companies - F.col("k") + 1)).alias("sizes_fit"),
        F.col("silhouette_score").between(-1, 1).alias("score_in_range"),
    )
