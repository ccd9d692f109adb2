"""Company groups: scaling, k-means over a range of k, silhouette, centers, PCA."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlens.functions.stats import exact_quantiles
from meterlens.functions.tiles import BLOCK_ROWS, TILE, into_tiles
from meterlens.operators.audits import required_columns
from meterlens.operators.kmeans import KMeansFit, multi_start_kmeans
from meterlens.settings import Settings

SCALERS = ("standard", "minmax", "robust")

_CHUNK = 512


def _complete(features: Sequence[str]) -> Column:
    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return F.coalesce(reduce(and_, [finite(F.col(f).cast("double")) for f in features]), F.lit(False))


def eligible_companies(metrics: DataFrame, features: Sequence[str]) -> DataFrame:
    required_columns(metrics, features)
    return metrics.where(_complete(features))


def excluded_companies(metrics: DataFrame, features: Sequence[str]) -> DataFrame:
    return metrics.where(~_complete(features)).select("company_id", *features)


@dataclass(frozen=True)
class Scaling:
    """Affine scaling per feature: (x - offset) / scale."""

    offset: Mapping[str, float]
    scale: Mapping[str, float]

    def apply(self, feature: str) -> Column:
        return (F.col(feature).cast("double") - self.offset[feature]) / self.scale[feature]

    def restore(self, feature: str, value: float) -> float:
        return value * self.scale[feature] + self.offset[feature]


def fit_scaling(df: DataFrame, features: Sequence[str], scaler: str) -> Scaling:
    """Scaling parameters: two numbers per feature. A constant feature is only shifted.

    standard: mean and population deviation; minmax: minimum and range; robust: median and
    interquartile range.
    """
    name = scaler.lower()
    if name == "robust":
        rows = exact_quantiles(df.select(*[F.col(f).cast("double").alias(f) for f in features]), features, [0.25, 0.5, 0.75])
        q = {(r["column"], r["probability"]): r["quantile"] for r in rows.collect()}
        offset = {f: q[f, 0.5] for f in features}
        scale = {f: q[f, 0.75] - q[f, 0.25] for f in features}
    elif name in ("standard", "minmax"):
        low, high = (F.avg, F.stddev_pop) if name == "standard" else (F.min, F.max)
        row = df.agg(
            *[low(F.col(f).cast("double")).alias(f"a_{f}") for f in features],
            *[high(F.col(f).cast("double")).alias(f"b_{f}") for f in features],
        ).first()
        offset = {f: row[f"a_{f}"] for f in features}
        scale = {f: row[f"b_{f}"] - (offset[f] if name == "minmax" else 0.0) for f in features}
    else:
        raise ValueError(f"unknown scaler: {scaler}")
    return Scaling(offset, {f: s if s > 0 else 1.0 for f, s in scale.items()})


def with_scaled_features(df: DataFrame, features: Sequence[str], scaling: Scaling) -> DataFrame:
    """Add the vector column ``features`` in scaled units."""
    values = F.array(*[scaling.apply(f) for f in features])
    return df.withColumn("features", array_to_vector(values))


def scaled_points(df: DataFrame, features: Sequence[str], scaling: Scaling) -> DataFrame:
    """(company_id, features vector) in scaled units."""
    return with_scaled_features(df, features, scaling).select("company_id", "features")


def feature_statistics(df: DataFrame, features: Sequence[str], scaling: Scaling) -> DataFrame:
    """Mean and deviation of each feature before and after scaling."""
    original = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    after = df.select(*[scaling.apply(f).alias(f) for f in features])
    before_stats = original.unpivot([], list(features), "feature", "x").groupBy("feature").agg(
        F.avg("x").alias("original_mean"), F.stddev_samp("x").alias("original_std")
    )
    after_stats = after.unpivot([], list(features), "feature", "x").groupBy("feature").agg(
        F.avg("x").alias("scaled_mean"), F.stddev_pop("x").alias("scaled_std_population")
    )
    return before_stats.join(after_stats, "feature")


def k_values(companies: int, settings: Settings) -> list[int]:
    if companies < 4:
        raise ValueError("fewer than four companies with complete metrics")
    return list(range(max(2, settings.k_min), min(settings.k_max, companies - 1) + 1))


def label_column(k: int) -> str:
    return f"label_{k}"


def with_labels(points: DataFrame, fits: Mapping[int, KMeansFit], scaled: Sequence[Column]) -> DataFrame:
    """Add the number of the nearest center, the first on a tie, under every k; ``scaled`` are the scaled features."""

    def nearest(centers: np.ndarray) -> Column:
        gaps = [reduce(Column.__add__, [(x - float(v)) * (x - float(v)) for x, v in zip(scaled, c)]) for c in centers]
        return F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))).cast("int") - 1

    return points.withColumns({label_column(k): nearest(fit.centers) for k, fit in fits.items()})


def cluster_sizes(labelled: DataFrame, ks: Sequence[int]) -> dict[int, dict[int, int]]:
    """Members per cluster for each k: at most sum(ks) numbers."""
    rows = (
        labelled.select(*[F.col(label_column(k)) for k in ks])
        .unpivot([], [label_column(k) for k in ks], "k", "label")
        .groupBy("k", "label")
        .count()
        .collect()
    )
    sizes: dict[int, dict[int, int]] = {k: {} for k in ks}
    for row in rows:
        sizes[int(row["k"].rsplit("_", 1)[1])][row["label"]] = row["count"]
    return sizes


def _distance_columns(ks: Sequence[int]) -> list[str]:
    return [f"d_{k}_{label}" for k in ks for label in range(k)]


def silhouette_scores(
    labelled: DataFrame, ks: Sequence[int], sizes: Mapping[int, Mapping[int, int]], block_rows: int = BLOCK_ROWS
) -> dict[int, float]:
    """Mean Euclidean silhouette for every k, exact for any number of companies.

    Distances are evaluated tile by tile inside the tasks; each tile returns, per member, the
    distance sum to every cluster of every k, so all labelings share one pass over the pairs.
    """
    columns = _distance_columns(ks)
    label_names = [label_column(k) for k in ks]

    def one_hot(labels: np.ndarray) -> np.ndarray:
        parts = [np.eye(k)[labels[:, i]] for i, k in enumerate(ks)]
        return np.concatenate(parts, axis=1)

    def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        squared = np.zeros((len(x), len(y)))
        for feature in range(x.shape[1]):
            squared += (x[:, feature][:, None] - y[:, feature][None, :]) ** 2
        return np.sqrt(squared)

    size = len(labelled.select("features").first()["features"])
    axes = [f"x{i}" for i in range(size)]

    def reduce_tile(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
        def matrix(names: Sequence[str]) -> np.ndarray:
            return np.column_stack([members.column(name).to_numpy() for name in names])

        points, hot = matrix(axes), one_hot(matrix(label_names))
        sums = np.zeros((len(points), len(columns)))
        side = members.column("side").to_numpy()
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        diagonal = key[1].as_py() == key[2].as_py()
        others = left if diagonal else right
        for start in range(0, len(left), _CHUNK):
            rows = left[start : start + _CHUNK]
            d = distances(points[rows], points[others])
            sums[rows] += d @ hot[others]
            if not diagonal:
                sums[others] += d.T @ hot[rows]
        kept = {name: members.column(name) for name in ("company_id", *label_names)}
        return pa.table(kept | {name: sums[:, i] for i, name in enumerate(columns)})

    point = vector_to_array("features")
    members = labelled.select(
        "company_id", F.lit(0).alias("group"), *[point[i].alias(axis) for i, axis in enumerate(axes)],
        *[F.col(name).cast("int").alias(name) for name in label_names],
    )
    schema = ", ".join(
        ["company_id string", *[f"{c} int" for c in label_names], *[f"{c} double" for c in columns]]
    )
    tiled = into_tiles(members, ["group"], "company_id", block_rows).groupBy("group", *TILE)
    summed = (
        tiled.applyInArrow(reduce_tile, schema)
        .groupBy("company_id", *label_names)
        .agg(*[F.sum(c).alias(c) for c in columns])
    )
    scores = []
    for k in ks:
        own_label = F.col(label_column(k))

        def mean_distance(label: int, k=k) -> Column:
            return F.col(f"d_{k}_{label}") / float(max(sizes[k].get(label, 0), 1))

        members_own = F.coalesce(*[F.when(own_label == j, F.lit(float(sizes[k].get(j, 0)))) for j in range(k)])
        own = F.coalesce(*[F.when(own_label == j, F.col(f"d_{k}_{j}")) for j in range(k)])
        a = F.when(members_own > 1, own / (members_own - 1))
        b = F.array_min(
            F.array_compact(
                F.array(*[F.when(own_label != j, mean_distance(j)) for j in range(k) if sizes[k].get(j, 0)])
            )
        )
        scores.append(F.avg(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))).alias(str(k)))
    row = summed.agg(*scores).first()
    return {k: row[str(k)] for k in ks}


def elbow_choice(evaluation: DataFrame) -> DataFrame:
    """Mark the k furthest from the chord of the inertia curve; the first k below three values.

    The table has one row per k, so the windows are over a handful of rows.
    """
    whole = W.partitionBy()
    k, inertia = F.col("k").cast("double"), F.col("inertia").cast("double")

    def unit(c: Column) -> Column:
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        return F.coalesce(F.try_divide(c - low, high - low), F.lit(0.0))

    placed = evaluation.withColumns({"_x": unit(k), "_y": unit(inertia), "_n": F.count("*").over(whole)})

    def at(role, column: str) -> Column:
        return role(column, "k").over(whole)

    x0, y0 = at(F.min_by, "_x"), at(F.min_by, "_y")
    dx, dy = at(F.max_by, "_x") - x0, at(F.max_by, "_y") - y0
    distance = F.try_divide(
        F.abs(dx * (F.col("_y") - y0) - dy * (F.col("_x") - x0)), F.sqrt(dx * dx + dy * dy)
    )
    ranked = placed.withColumn("_distance", F.when(F.col("_n") >= 3, F.coalesce(distance, F.lit(0.0))).otherwise(0.0))
    order = W.orderBy(F.col("_distance").desc(), F.col("k"))
    return ranked.withColumn("is_elbow_choice", F.row_number().over(order) == 1).drop("_x", "_y", "_n", "_distance")


def silhouette_choice(evaluation: DataFrame) -> DataFrame:
    """Mark the k with the highest silhouette, the smallest on a tie."""
    order = W.orderBy(F.col("silhouette_score").desc(), F.col("k"))
    return evaluation.withColumn("is_silhouette_choice", F.row_number().over(order) == 1)


def number_centers(centers: DataFrame) -> DataFrame:
    """Stable numbers and ids by peak ratio, then weekday ratio. One row per cluster."""
    order = W.orderBy("peak_offpeak_ratio", "weekday_weekend_ratio")
    return centers.withColumn("cluster_number", F.row_number().over(order)).withColumn(
        "cluster_id", F.concat(F.lit("Cluster "), F.col("cluster_number").cast("string"))
    )


def describe_centers(centers: DataFrame, overall: Mapping[str, float]) -> DataFrame:
    """Rule-based description of each center against the overall feature means."""
    c = F.col
    gap = c("summer_index") - c("winter_index")
    day_oriented = (c("peak_offpeak_ratio") >= overall["peak_offpeak_ratio"]) & (
        c("weekday_weekend_ratio") >= overall["weekday_weekend_ratio"]
    )
    steady = (c("load_factor") >= overall["load_factor"]) & (
        c("coefficient_of_variation") <= overall["coefficient_of_variation"]
    )
    peaky = (c("coefficient_of_variation") > overall["coefficient_of_variation"]) & (
        c("load_factor") < overall["load_factor"]
    )
    text = F.concat_ws(
        " – ",
        F.when((gap >= 0.20) & (c("summer_index") >= 1.10), "summer peak").when(
            (-gap >= 0.20) & (c("winter_index") >= 1.10), "winter peak"
        ),
        F.when(steady, "relatively steady profile"),
        F.when(day_oriented, "daytime and working-week consumption"),
        F.when(peaky, "peakier and variable load"),
    )
    capitalised = F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 1_000_000)))
    return centers.withColumn("cluster_description", F.when(text == "", "Mixed profile").otherwise(capitalised))


@dataclass(frozen=True)
class Projection:
    """Two principal axes of centred feature vectors."""

    means: Sequence[float]
    axes: np.ndarray
    explained_variance: float

    def apply(self, df: DataFrame) -> DataFrame:
        """Add ``pca_1`` and ``pca_2`` next to the vector column ``features``."""
        array = vector_to_array("features")

        def component(j: int) -> Column:
            parts = [(array[i] - mean) * float(self.axes[i, j]) for i, mean in enumerate(self.means)]
            return reduce(Column.__add__, parts)

        return df.withColumns({"pca_1": component(0), "pca_2": component(1)})


def pca_2d(points: DataFrame) -> Projection:
    """Two centred principal components. Each component's largest absolute loading is positive."""
    size = len(points.select("features").first()["features"])
    array = vector_to_array("features")
    row = points.agg(*[F.avg(array[i]).alias(str(i)) for i in range(size)]).first()
    means = [row[str(i)] for i in range(size)]
    centred = F.array(*[array[i] - mean for i, mean in enumerate(means)])
    model = PCA(k=2, inputCol="_centred", outputCol="_pca").fit(
        points.select(array_to_vector(centred).alias("_centred"))
    )
    loadings = model.pc.toArray()
    largest = np.abs(loadings).argmax(axis=0)
    signs = np.sign(loadings[largest, range(2)])
    return Projection(means, loadings * signs, float(sum(model.explainedVariance)))


@dataclass(frozen=True)
class CompanyClusters:
    """All tables of the grouping step."""

    assignments: DataFrame
    centers: DataFrame
    evaluation: DataFrame
    scaler_sensitivity: DataFrame
    excluded: DataFrame
    feature_stats: DataFrame
    summary: DataFrame


def _grids(
    eligible: DataFrame, scalers: Sequence[str], ks: Sequence[int], settings: Settings, block_rows: int
) -> dict[str, tuple[Scaling, dict[int, KMeansFit], dict, dict]]:
    """Per scaler its scaling, and for every k the best fit, silhouette and sizes."""
    kept = eligible.select("company_id", *settings.features).persist()
    scalings = {s: fit_scaling(kept, settings.features, s) for s in scalers}
    fits = multi_start_kmeans(kept, settings.features, scalings, ks, settings.n_init, settings.seed)
    out = {}
    for scaler, scaling in scalings.items():
        models = {k: fits[scaler, k] for k in ks}
        scaled = [scaling.apply(f) for f in settings.features]
        names = [label_column(k) for k in ks]
        points = with_labels(with_scaled_features(kept, settings.features, scaling), models, scaled)
        labelled = points.select("company_id", "features", *names)
        sizes = cluster_sizes(labelled, ks)
        out[scaler] = (scaling, models, silhouette_scores(labelled, ks, sizes, block_rows), sizes)
    kept.unpersist()
    return out


def _sensitivity_rows(spark: SparkSession, grids: Mapping[str, tuple], ks: Sequence[int]) -> DataFrame:
    return spark.createDataFrame(
        [
            (s, k, float(scores[k]), min(sizes[k].values()), max(sizes[k].values()))
            for s, (_, _, scores, sizes) in grids.items()
            if s in SCALERS
            for k in ks
        ],
        "scaler string, k int, silhouette_score double, minimum_cluster_size bigint, maximum_cluster_size bigint",
    )


def scaler_sensitivity(
    spark: SparkSession, eligible: DataFrame, ks: Sequence[int], settings: Settings, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Silhouette and cluster sizes for every scaler and k."""
    return _sensitivity_rows(spark, _grids(eligible, SCALERS, ks, settings, block_rows), ks)


def company_clusters(
    spark: SparkSession, metrics: DataFrame, settings: Settings, block_rows: int = BLOCK_ROWS
) -> CompanyClusters:
    """Group companies by their load-profile features.

    The selected k is the silhouette maximum under the configured scaler; the elbow and the
    results under the other scalers are reported. The driver holds model parameters and the
    evaluation table only.
    """
    features = settings.features
    eligible = eligible_companies(metrics, features)
    n = eligible.count()
    ks = k_values(n, settings)
    scalers = list(dict.fromkeys([*SCALERS, settings.scaler.lower()]))
    grids = _grids(eligible, scalers, ks, settings, block_rows)
    chosen = settings.scaler.lower()
    scaling, models, scores, sizes_by_k = grids[chosen]
    evaluation = spark.createDataFrame(
        [(k, float(models[k].cost), float(scores[k])) for k in ks],
        "k int, inertia double, silhouette_score double",
    )
    evaluation = silhouette_choice(elbow_choice(evaluation)).withColumn(
        "is_selected", F.col("is_silhouette_choice")
    )
    selected = min(ks, key=lambda k: (-scores[k], k))
    model = models[selected]

    overall = eligible.agg(*[F.avg(f).alias(f) for f in features]).first().asDict()
    raw_centers = spark.createDataFrame(
        [
            (label, *[scaling.restore(f, float(v)) for f, v in zip(features, center)])
            for label, center in enumerate(model.centers)
        ],
        "raw_cluster int, " + ", ".join(f"{f} double" for f in features),
    )
    centers = describe_centers(number_centers(raw_centers), overall)
    projection = pca_2d(scaled_points(eligible, features, scaling))
    names = centers.select(
        F.col("raw_cluster").alias(label_column(selected)), "cluster_number", "cluster_id", "cluster_description"
    )
    scaled = [scaling.apply(f) for f in features]
    labelled = with_labels(with_scaled_features(eligible, features, scaling), {selected: model}, scaled)
    assignments = (
        projection.apply(labelled)
        .drop("features")
        .join(F.broadcast(names), label_column(selected))  # at most k_max rows
        .drop(label_column(selected))
        .withColumns(
            {
                "seasonality_input_reliable": F.col("seasonality_reliable"),
                "sector_comparison_status": F.lit("sector_metadata_unavailable"),
            }
        )
    )
    sizes = assignments.groupBy("cluster_number", "cluster_id", "cluster_description").agg(
        F.count("*").alias("company_count")
    )
    centers = centers.drop("raw_cluster").join(sizes, ["cluster_number", "cluster_id", "cluster_description"])
    members = sizes_by_k[selected].values()
    summary = spark.createDataFrame(
        [
            (
                metrics.count(),
                n,
                len(features),
                settings.scaler,
                ks[0],
                ks[-1],
                selected,
                float(scores[selected]),
                min(members),
                max(members),
                projection.explained_variance,
            )
        ],
        "companies_total bigint, companies_clustered bigint, feature_count int, scaler string, k_tested_min int, "
        "k_tested_max int, selected_k int, selected_silhouette_score double, minimum_cluster_size bigint, "
        "maximum_cluster_size bigint, pca_explained_variance_2d double",
    ).withColumns(
        {
            "companies_excluded": F.col("companies_total") - F.col("companies_clustered"),
            "silhouette_choice": F.col("selected_k"),
            "elbow_choice": F.lit(evaluation.where("is_elbow_choice").first()["k"]),
        }
    )
    return CompanyClusters(
        assignments=assignments,
        centers=centers.orderBy("cluster_number"),
        evaluation=evaluation,
        scaler_sensitivity=_sensitivity_rows(spark, grids, ks),
        excluded=excluded_companies(metrics, features),
        feature_stats=feature_statistics(eligible, features, scaling),
        summary=summary,
    )
