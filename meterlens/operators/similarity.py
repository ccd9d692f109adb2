"""Similarity of the 24-hour profiles of the meters of a company."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions.tiles import BLOCK_ROWS, TILE, into_tiles
from meterlens.operators.profiles import imported
from meterlens.settings import Settings

HOURS = [f"h{hour:02d}" for hour in range(1, 25)]

# Fewer shared hours than this give no correlation (fixed value).
MINIMUM_SHARED_HOURS = 6

_CHUNK = 128


def profile_vectors(hourly: DataFrame) -> DataFrame:
    """Hourly import profiles as one row of 24 columns per (company, meter)."""
    slots = [
        F.max(F.when(F.col("hour_1_24") == hour, F.col("mean_kwh"))).alias(name)
        for hour, name in enumerate(HOURS, start=1)
    ]
    return imported(hourly).where(F.col("company_id").isNotNull()).groupBy("company_id", "meter_id").agg(*slots)


def _exact_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise correlation of aligned profiles over shared hours, two passes."""
    shared = ~np.isnan(left) & ~np.isnan(right)
    x, y = np.where(shared, left, np.nan), np.where(shared, right, np.nan)
    flat_x = np.nanmin(x, axis=1) == np.nanmax(x, axis=1)
    flat_y = np.nanmin(y, axis=1) == np.nanmax(y, axis=1)
    dx = np.nan_to_num(x - np.nanmean(x, axis=1, keepdims=True))
    dy = np.nan_to_num(y - np.nanmean(y, axis=1, keepdims=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (dx * dy).sum(axis=1) / np.sqrt((dx**2).sum(axis=1) * (dy**2).sum(axis=1))
    return np.where(flat_x & flat_y, 1.0, np.where(flat_x | flat_y, 0.0, np.clip(r, -1.0, 1.0)))


def _spread(values: np.ndarray) -> np.ndarray:
    """Largest minus smallest present value per row; infinite for rows without values."""
    high = np.where(np.isnan(values), -np.inf, values).max(axis=1)
    low = np.where(np.isnan(values), np.inf, values).min(axis=1)
    return np.abs(high - low)


def correlations(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix of profile correlations, NaN below the minimum of shared hours.

    Moments come from matrix products of profiles centred on their own mean. Pairs whose shared
    variance is too small for that form are redone in two passes.
    """
    has_l, has_r = (~np.isnan(left)).astype(float), (~np.isnan(right)).astype(float)

    def centred(values: np.ndarray) -> np.ndarray:
        count = np.maximum((~np.isnan(values)).sum(axis=1, keepdims=True), 1)
        return np.nan_to_num(values - np.nansum(values, axis=1, keepdims=True) / count)

    x, y = centred(left), centred(right)
    n = has_l @ has_r.T
    enough = n >= MINIMUM_SHARED_HOURS
    safe_n = np.maximum(n, 1)
    sum_x, sum_y = x @ has_r.T, has_l @ y.T
    var_x = (x**2) @ has_r.T - sum_x**2 / safe_n
    var_y = has_l @ (y**2).T - sum_y**2 / safe_n
    cov = x @ y.T - sum_x * sum_y / safe_n
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.clip(cov / np.sqrt(var_x * var_y), -1.0, 1.0)
    spread_l, spread_r = _spread(left), _spread(right)
    flat_l, flat_r = (spread_l == 0)[:, None], (spread_r == 0)[None, :]
    r = np.where(flat_l & flat_r, 1.0, np.where(flat_l | flat_r, 0.0, r))
    scale_x, scale_y = (x**2).sum(axis=1)[:, None], (y**2).sum(axis=1)[None, :]
    doubtful = enough & ~flat_l & ~flat_r & ((var_x <= 1e-6 * scale_x) | (var_y <= 1e-6 * scale_y))
    rows, cols = np.nonzero(doubtful)
    for start in range(0, len(rows), 100_000):
        i, j = rows[start : start + 100_000], cols[start : start + 100_000]
        r[i, j] = _exact_pairs(left[i], right[j])
    return np.where(enough, r, np.nan)


_PAIR_SCHEMA = "company_id string, total double, pairs bigint, lowest double"


def _reduce_tile(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
    company, tile_i, tile_j = (part.as_py() for part in key)
    side = members.column("side").to_numpy()
    values = np.column_stack([members.column(hour).to_numpy() for hour in HOURS])
    left = values[side == 0]
    diagonal = tile_i == tile_j
    right = left if diagonal else values[side == 1]
    total, pairs, lowest = 0.0, 0, np.inf
    for start in range(0, len(left), _CHUNK):
        # On the diagonal only members after the first of the chunk can form new pairs.
        first = start if diagonal else 0
        r = correlations(left[start : start + _CHUNK], right[first:])
        if diagonal:
            r[np.tril_indices(r.shape[0], 0, r.shape[1])] = np.nan
        known = r[~np.isnan(r)]
        if known.size:
            total += float(known.sum())
            pairs += int(known.size)
            lowest = min(lowest, float(known.min()))
    return pa.table(
        {
            "company_id": pa.array([company], pa.string()),
            "total": pa.array([total], pa.float64()),
            "pairs": pa.array([pairs], pa.int64()),
            "lowest": pa.array([lowest if pairs else None], pa.float64()),
        }
    )


def pairwise_profile_correlation(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean and minimum correlation over all meter pairs of each company."""
    tiles = into_tiles(vectors, ["company_id"], "meter_id", block_rows)
    reduced = tiles.groupBy("company_id", *TILE).applyInArrow(_reduce_tile, _PAIR_SCHEMA)
    return reduced.groupBy("company_id").agg(
        F.try_divide(F.sum("total"), F.sum("pairs")).alias("mean_pairwise_profile_correlation"),
        F.min("lowest").alias("minimum_pairwise_profile_correlation"),
    )


def meter_heterogeneity(
    meter_metrics: DataFrame, hourly: DataFrame, settings: Settings, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``company_meter_heterogeneity`` table."""
    companies = (
        imported(meter_metrics)
        .where(F.col("company_id").isNotNull())
        .groupBy("company_id")
        .agg(
            F.count("*").alias("meter_count"),
            (F.max("peak_offpeak_ratio") - F.min("peak_offpeak_ratio")).alias("_peak"),
            (F.max("load_factor") - F.min("load_factor")).alias("_load"),
        )
    )
    several = companies.where(F.col("meter_count") > 1).select("company_id")
    vectors = profile_vectors(hourly).join(several, "company_id", "left_semi")
    pairs = pairwise_profile_correlation(vectors, block_rows)
    single = F.col("meter_count") == 1
    mean, low = F.col("mean_pairwise_profile_correlation"), F.col("minimum_pairwise_profile_correlation")
    return companies.join(pairs, "company_id", "left").select(
        "company_id",
        "meter_count",
        mean,
        low,
        F.when(single, 0.0).otherwise(F.col("_peak")).alias("peak_ratio_range"),
        F.when(single, 0.0).otherwise(F.col("_load")).alias("load_factor_range"),
        F.when(single, "single_meter")
        .when(low >= settings.similar_correlation, "similar")
        .when(mean >= settings.partly_different_correlation, "partly_different")
        .otherwise("clearly_different")
        .alias("meter_profile_similarity"),
    )
