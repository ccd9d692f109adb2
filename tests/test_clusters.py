from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.operators import clusters
from meterlens.settings import CLUSTER_FEATURES, Settings

FAST = Settings(n_init=2, k_max=4)


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(5)
    centers = np.array([[1, 1, 1, 0.5, 1.2, 0.9], [2, 1, 2, 0.3, 0.9, 1.3], [1, 3, 0.5, 0.8, 1, 1]])
    return np.concatenate([c + rng.normal(0, 0.05, size=(12, 6)) for c in centers])


@pytest.fixture(scope="module")
def metrics(spark, matrix):
    rows = [(f"Company {i}", *map(float, row), True) for i, row in enumerate(matrix)]
    rows.append(("No winter", 1.0, 1.0, 1.0, 0.5, 1.0, None, False))
    rows.append(("Infinite", float("inf"), 1.0, 1.0, 0.5, 1.0, 1.0, False))
    rows.append(("Not a number", 1.0, float("nan"), 1.0, 0.5, 1.0, 1.0, False))
    schema = "company_id string, " + ", ".join(f"{f} double" for f in CLUSTER_FEATURES) + ", seasonality_reliable boolean"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def eligible(metrics):
    return clusters.eligible_companies(metrics, CLUSTER_FEATURES)


def test_complete_rows_and_complement(metrics, eligible, matrix):
    assert eligible.count() == len(matrix)
    excluded = {r["company_id"] for r in clusters.excluded_companies(metrics, CLUSTER_FEATURES).collect()}
    assert excluded == {"No winter", "Infinite", "Not a number"}
    with pytest.raises(ValueError, match="summer_index"):
        clusters.eligible_companies(metrics.drop("summer_index"), CLUSTER_FEATURES)


def expected_scaling(matrix, name):
    if name == "standard":
        return matrix.mean(axis=0), matrix.std(axis=0)
    if name == "minmax":
        return matrix.min(axis=0), np.ptp(matrix, axis=0)
    return np.median(matrix, axis=0), np.subtract(*np.quantile(matrix, [0.75, 0.25], axis=0))


@pytest.mark.parametrize("name", clusters.SCALERS)
def test_scalers(eligible, matrix, name):
    scaling = clusters.fit_scaling(eligible, CLUSTER_FEATURES, name.upper())
    offset, scale = expected_scaling(matrix, name)
    assert [scaling.offset[f] for f in CLUSTER_FEATURES] == pytest.approx(list(offset))
    assert [scaling.scale[f] for f in CLUSTER_FEATURES] == pytest.approx(list(scale))
    assert scaling.restore("load_factor", (0.4 - offset[3]) / scale[3]) == pytest.approx(0.4)


def test_unknown_scaler_and_constant_feature(spark, eligible):
    with pytest.raises(ValueError, match="unknown"):
        clusters.fit_scaling(eligible, CLUSTER_FEATURES, "log")
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    for name in clusters.SCALERS:
        scaling = clusters.fit_scaling(flat, ["x"], name)
        assert [r[0] for r in flat.select(scaling.apply("x")).collect()] == [0.0, 0.0]


def test_k_range():
    assert clusters.k_values(30, Settings()) == list(range(2, 11))
    assert clusters.k_values(5, Settings()) == [2, 3, 4]
    with pytest.raises(ValueError):
        clusters.k_values(3, Settings())


def elbow(spark, pairs):
    table = clusters.elbow_choice(spark.createDataFrame(pairs, "k int, inertia double"))
    return [r["k"] for r in table.where("is_elbow_choice").collect()]


def test_elbow(spark):
    # Unit square: (0, 1), (1/4, 1/2), (1/2, 1/8), (3/4, 1/16), (1, 0). Distance to the chord x + y = 1 is
    # |x + y - 1| / sqrt(2): 0, 1/4, 3/8, 3/16, 0 over sqrt(2), so the third k.
    assert elbow(spark, list(zip([3, 5, 7, 9, 11], [170.0, 90.0, 30.0, 20.0, 10.0]))) == [7]
    assert elbow(spark, [(2, 10.0), (3, 1.0)]) == [2]
    assert elbow(spark, [(2, 5.0), (3, 5.0), (4, 5.0)]) == [2]


def test_silhouette_choice_takes_the_first_maximum(spark):
    table = spark.createDataFrame([(2, 0.5), (3, 0.7), (4, 0.7)], "k int, silhouette_score double")
    assert [r["k"] for r in clusters.silhouette_choice(table).where("is_silhouette_choice").collect()] == [3]


def silhouette(points, labels):
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        mates = labels == own
        if mates.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, mates].sum() / (mates.sum() - 1)
        b = min(d[i, labels == other].mean() for other in set(labels) if other != own)
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


@pytest.mark.parametrize("block_rows", [5, 8192])
def test_silhouette_is_exact_over_tiles(spark, eligible, matrix, block_rows):
    scaling = clusters.fit_scaling(eligible, CLUSTER_FEATURES, "minmax")
    number = F.substring_index("company_id", " ", -1).cast("int")
    points = (
        clusters.scaled_points(eligible, CLUSTER_FEATURES, scaling)
        .withColumn("label_3", (number / 12).cast("int"))
        .withColumn("label_2", F.when(number == 0, 1).otherwise(0))
    )
    sizes = clusters.cluster_sizes(points, [2, 3])
    assert sizes == {2: {0: 35, 1: 1}, 3: {0: 12, 1: 12, 2: 12}}
    got = clusters.silhouette_scores(points, [2, 3], sizes, block_rows)
    offset, scale = expected_scaling(matrix, "minmax")
    scaled = (matrix - offset) / scale
    assert got[3] == pytest.approx(silhouette(scaled, np.arange(36) // 12))
    assert got[2] == pytest.approx(silhouette(scaled, (np.arange(36) == 0).astype(int)))


def test_center_numbers_and_descriptions(spark):
    rows = [
        ("steady summer", 2.0, 1.5, 0.4, 0.9, 1.4, 0.8),
        ("peaky winter", 1.0, 1.0, 0.9, 0.2, 0.8, 1.3),
        ("mixed", 1.0, 0.9, 0.4, 0.2, 1.0, 1.0),
    ]
    centers = spark.createDataFrame(rows, "name string, " + ", ".join(f"{f} double" for f in CLUSTER_FEATURES))
    overall = dict(zip(CLUSTER_FEATURES, (1.5, 1.2, 0.6, 0.5, 1.0, 1.0)))
    got = clusters.describe_centers(clusters.number_centers(centers), overall).collect()
    assert {r["name"]: (r["cluster_number"], r["cluster_id"]) for r in got} == {
        "mixed": (1, "Cluster 1"),
        "peaky winter": (2, "Cluster 2"),
        "steady summer": (3, "Cluster 3"),
    }
    assert {r["name"]: r["cluster_description"] for r in got} == {
        "steady summer": "Summer peak – relatively steady profile – daytime and working-week consumption",
        "peaky winter": "Winter peak – peakier and variable load",
        "mixed": "Mixed profile",
    }


def test_pca_matches_svd(eligible, matrix):
    scaling = clusters.fit_scaling(eligible, CLUSTER_FEATURES, "minmax")
    points = clusters.scaled_points(eligible, CLUSTER_FEATURES, scaling)
    projection = clusters.pca_2d(points)
    offset, scale = expected_scaling(matrix, "minmax")
    centred = (matrix - offset) / scale
    centred = centred - centred.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    axes = vt[:2] * np.sign(vt[:2][range(2), np.abs(vt[:2]).argmax(axis=1)])[:, None]
    expected = {f"Company {i}": row for i, row in enumerate(centred @ axes.T)}
    for row in projection.apply(points).collect():
        assert (row["pca_1"], row["pca_2"]) == pytest.approx(tuple(expected[row["company_id"]]), abs=1e-9)
    assert projection.explained_variance == pytest.approx((s[:2] ** 2).sum() / (s**2).sum())


def test_company_clusters_invariants(spark, metrics, matrix):
    groups = clusters.company_clusters(spark, metrics, FAST)
    evaluation = groups.evaluation.orderBy("k").collect()
    costs = [r["inertia"] for r in evaluation]
    assert [r["k"] for r in evaluation] == [2, 3, 4] and costs == sorted(costs, reverse=True)
    assert all(-1 <= r["silhouette_score"] <= 1 for r in evaluation)
    assert sum(r["is_selected"] for r in evaluation) == 1 and sum(r["is_elbow_choice"] for r in evaluation) == 1
    # Three well separated groups of twelve.
    assert [r["k"] for r in evaluation if r["is_selected"]] == [3]
    assigned = groups.assignments.collect()
    assert len(assigned) == len(matrix)
    found = {}
    for row in assigned:
        found.setdefault(row["cluster_number"], set()).add(int(row["company_id"].split(" ")[1]) // 12)
    assert sorted(found) == [1, 2, 3] and all(len(v) == 1 for v in found.values())
    centers = groups.centers.collect()
    assert [r["company_count"] for r in centers] == [12, 12, 12]
    ratios = [r["peak_offpeak_ratio"] for r in centers]
    assert ratios == sorted(ratios)
    assert min(ratios) == pytest.approx(min(matrix[:12, 0].mean(), matrix[24:, 0].mean()))
    sensitivity = groups.scaler_sensitivity.collect()
    assert len(sensitivity) == 9 and all(r["minimum_cluster_size"] >= 1 for r in sensitivity)
    summary = groups.summary.first()
    assert (summary["companies_total"], summary["companies_clustered"], summary["companies_excluded"]) == (39, 36, 3)
    assert 0 < summary["pca_explained_variance_2d"] <= 1
    stats = {r["feature"]: r for r in groups.feature_stats.collect()}
    assert stats["load_factor"]["original_std"] == pytest.approx(matrix[:, 3].std(ddof=1))
