"""K-means rounds against plain passes over all rows, and the certificates against spoilt groupings."""

from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.operators import certificates, clusters, kmeans
from meterlens.settings import CLUSTER_FEATURES, Settings


def plain_passes(z, centers, tolerance=1e-4, most=300):
    """Passes over all rows until no center moves; (centers, cost, passes)."""
    for made in range(1, most + 1):
        label = ((z[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        moved = np.array([z[label == c].mean(0) if (label == c).any() else centers[c] for c in range(len(centers))])
        still = np.sqrt(((moved - centers) ** 2).sum(1)).max() <= tolerance
        centers = moved
        if still:
            break
    return centers, ((z[:, None] - centers[None]) ** 2).sum(2).min(1).sum(), made


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    return np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in ((0, 1, 300), (4, 0.5, 200), (-3, 2, 150), (9, 0.1, 50))])


@pytest.mark.parametrize("open_rows", [0, 1, 40, 400, 10_000])
def test_rounds_give_what_passes_over_all_rows_give(spark, cloud, open_rows):
    points = spark.createDataFrame([tuple(map(float, r)) for r in cloud], "a double, b double, c double").repartition(5)
    offset, scale = cloud.mean(0), cloud.std(0)
    z = (cloud - offset) / scale
    runs = [kmeans.Run(offset, scale, kmeans.starting_centers(z, k, seed)) for k in (1, 2, 4, 6) for seed in (1, 2)]
    # A center that no row is nearest to stays where it is.
    runs.append(kmeans.Run(offset, scale, np.array([[0.0, 0, 0], [1, 1, 1], [500, 500, 500]])))
    found = kmeans.fit_runs(points, ["a", "b", "c"], runs, open_rows=open_rows)
    for run, start in zip(found, runs):
        centers, cost, passes = plain_passes(z, start.centers)
        assert run.converged and run.passes == passes
        assert run.centers == pytest.approx(centers, abs=1e-9)
        assert run.cost == pytest.approx(cost, rel=1e-9)


def test_fewer_jobs_than_passes(spark, cloud, monkeypatch):
    points = spark.createDataFrame([tuple(map(float, r)) for r in cloud], "a double, b double, c double")
    rounds = []
    round_ = kmeans._round
    monkeypatch.setattr(kmeans, "_round", lambda *a: rounds.append(1) or round_(*a))
    runs = [kmeans.Run(np.zeros(3), np.ones(3), kmeans.starting_centers(cloud, 6, s)) for s in range(4)]
    found = kmeans.fit_runs(points, ["a", "b", "c"], runs, open_rows=200)
    assert len(rounds) < max(r.passes for r in found) / 2
    rounds.clear()
    kmeans.fit_runs(points, ["a", "b", "c"], runs)
    assert len(rounds) == 1


def test_a_pass_limit_and_no_rows(spark, cloud):
    points = spark.createDataFrame([tuple(map(float, r)) for r in cloud], "a double, b double, c double")
    run = kmeans.Run(np.zeros(3), np.ones(3), kmeans.starting_centers(cloud, 5, 3))
    for open_rows in (50, 10_000):
        found = kmeans.fit_runs(points, ["a", "b", "c"], [run], open_rows=open_rows, most_passes=2)[0]
        centers, cost, _ = plain_passes(cloud, run.centers, most=2)
        assert found.passes == 2 and found.centers == pytest.approx(centers) and found.cost == pytest.approx(cost)
    assert kmeans.fit_runs(points.limit(0), ["a", "b", "c"], [run])[0].cost is None


@pytest.fixture(scope="module")
def grouping(spark):
    rng = np.random.default_rng(5)
    middle = np.array([[1, 1, 1, 0.5, 1.2, 0.9], [2, 1, 2, 0.3, 0.9, 1.3], [1, 3, 0.5, 0.8, 1, 1]])
    matrix = np.concatenate([c + rng.normal(0, 0.05, size=(12, 6)) for c in middle])
    rows = [(f"Company {i}", *map(float, row), True) for i, row in enumerate(matrix)]
    schema = "company_id string, " + ", ".join(f"{f} double" for f in CLUSTER_FEATURES) + ", seasonality_reliable boolean"
    metrics = spark.createDataFrame(rows, schema)
    groups = clusters.company_clusters(spark, metrics, Settings(n_init=2, k_max=4))
    kept = dataclasses.replace(
        groups, **{n: spark.createDataFrame(t.collect(), t.schema) for n in ("assignments", "centers", "evaluation", "summary") for t in [getattr(groups, n)]}
    )
    return kept, clusters.fit_scaling(metrics, CLUSTER_FEATURES, "minmax")


def violations(table):
    return {r["check"]: r["violations"] for r in table.collect() if r["violations"]}


def checks(groups, scaling):
    sizes = {r["cluster_number"]: r["company_count"] for r in groups.centers.collect()}
    found = violations(certificates.center_checks(groups, CLUSTER_FEATURES, scaling))
    return found | violations(certificates.choice_checks(groups, CLUSTER_FEATURES, scaling, sizes))


def test_certificates_pass_a_right_grouping(grouping):
    groups, scaling = grouping
    assert checks(groups, scaling) == {}
    near = certificates.nearest_centers(groups, CLUSTER_FEATURES, scaling).collect()
    assert len(near) == 36 and all(r["is_nearest"] for r in near)
    grid = certificates.grid_checks(groups.scaler_sensitivity, 36).collect()
    assert len(grid) == 9 and all(r["sizes_fit"] and r["score_in_range"] for r in grid)


def test_certificates_find_spoilt_groupings(grouping):
    groups, scaling = grouping
    first = F.col("company_id") == "Company 0"
    number = F.when(first, F.col("cluster_number") % 3 + 1).otherwise(F.col("cluster_number"))
    moved = dataclasses.replace(groups, assignments=groups.assignments.withColumn("cluster_number", number))
    near = certificates.nearest_centers(moved, CLUSTER_FEATURES, scaling).where("NOT is_nearest").collect()
    assert [r["company_id"] for r in near] == ["Company 0"]
    assert {"center_is_members_mean", "company_count_is_members", "names_follow_numbers", "inertia_is_distance_to_centers",
            "silhouette_is_that_of_the_groups"} <= set(checks(moved, scaling))
    turned = groups.centers.withColumn("cluster_number", 4 - F.col("cluster_number"))
    assert "numbers_in_stable_order" in checks(dataclasses.replace(groups, centers=turned), scaling)
    worse = groups.evaluation.withColumn("is_selected", F.col("k") == 4)
    assert {"selected_k_is_first_maximum", "summary_has_the_selected_k"} <= set(
        checks(dataclasses.replace(groups, evaluation=worse), scaling)
    )
    none = groups.evaluation.withColumn("is_selected", F.lit(False))
    assert checks(dataclasses.replace(groups, evaluation=none), scaling)["one_k_is_selected"] == 1
    summary = groups.summary.withColumn("companies_excluded", F.lit(7))
    assert checks(dataclasses.replace(groups, summary=summary), scaling) == {"summary_counts_add_up": 1}
