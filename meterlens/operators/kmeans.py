"""K-means from many starts at once, with as few Spark jobs as the rows near a border allow.

A row whose nearest center is nearer than the second nearest by twice a margin keeps its center while no center has moved
further than that margin (triangle inequality). So a round splits the rows of every run: those with a margin above the
run's radius are settled and only count as sums per center; the others, at most `open_rows` a run, go to the run's task as
rows. There the run makes as many passes as its radius covers, measuring the open rows only, which gives what passes
over all rows would give. Runs are independent groups of that round, so they spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = 2048
#: Margins are counted in bins whose edges are these powers of two.
_BINS = (-30, 20)


@dataclass
class KMeansFit:
    """Centers in scaled units and the summed squared distance of all rows to their nearest center."""

    centers: np.ndarray
    cost: float


@dataclass
class Run:
    """One start of k-means: its scaling, its centers now, and how far it has come.

    Tasks get runs as plain tuples of their first six members, which need no copy of this package to be read.
    """

    offset: np.ndarray
    scale: np.ndarray
    centers: np.ndarray
    radius: float = float("inf")
    passes: int = 0
    converged: bool = False
    cost: float | None = None

    def shipped(self) -> tuple:
        return (self.offset, self.scale, self.centers, self.radius, self.passes, self.converged)


def starting_centers(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ starting centers out of the given rows."""
    rng = np.random.default_rng(seed)
    chosen = [rows[rng.integers(len(rows))]]
    gap = ((rows - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        share = gap / gap.sum() if gap.sum() > 0 else None
        chosen.append(rows[rng.choice(len(rows), p=share)])
        gap = np.minimum(gap, ((rows - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _measured(z: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest center, squared distance to it, and margin of every row."""
    gaps = ((z[:, None, :] - centers[None]) ** 2).sum(2)
    label = gaps.argmin(1)
    own = gaps[np.arange(len(z)), label]
    if len(centers) == 1:
        return label, own, np.full(len(z), np.inf)
    second = np.partition(gaps, 1, axis=1)[:, 1]
    return label, own, (np.sqrt(second) - np.sqrt(own)) / 2


def _chunks(batches, features: Sequence[str]):
    for batch in batches:
        x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
        for low in range(0, len(x), _CHUNK):
            yield x[low : low + _CHUNK]


def _set_radii(points: DataFrame, features: Sequence[str], runs: Sequence[Run], open_rows: int) -> None:
    """The largest radius for each run that leaves at most `open_rows` rows open; counts of margins, one job for all runs."""
    shared = points.sparkSession.sparkContext.broadcast([run.shipped() for run in runs])
    width = _BINS[1] - _BINS[0] + 1

    def margins(batches):
        counts = np.zeros((len(shared.value), width), np.int64)
        for x in _chunks(batches, features):
            for number, (offset, scale, centers, *_) in enumerate(shared.value):
                margin = _measured((x - offset) / scale, centers)[2]
                level = np.clip(np.ceil(np.log2(np.maximum(margin, 2.0 ** _BINS[0]))), *_BINS) - _BINS[0]
                counts[number] += np.bincount(level.astype(np.int64), minlength=width)
        number, level = np.nonzero(counts)
        columns = [pa.array(number.astype(np.int32)), pa.array(level.astype(np.int32)), pa.array(counts[number, level])]
        yield pa.RecordBatch.from_arrays(columns, ["run", "level", "n"])

    found = points.select(*features).mapInArrow(margins, "run int, level int, n long").groupBy("run", "level")
    counts = np.zeros((len(runs), width), np.int64)
    for r in found.agg(F.sum("n").alias("n")).collect():
        counts[r["run"], r["level"]] = r["n"]
    for run, below in zip(runs, np.cumsum(counts, axis=1)):
        fits = np.flatnonzero(below <= open_rows)
        # A row's margin is at most its bin's upper edge; the topmost bin has none.
        run.radius = 0.0 if not len(fits) else float("inf") if fits[-1] == width - 1 else 2.0 ** (fits[-1] + _BINS[0])
    shared.destroy()


def _passes(run: Run, n: np.ndarray, sums: np.ndarray, cost: np.ndarray, z: np.ndarray, most: int, tolerance: float) -> Run:
    """Passes of one run until it converges, `most` are made or a center has left the radius.

    `n`, `sums` and `cost` are those of the settled rows by center: their number, and the sums of their differences to the
    center and of the squares of these. `z` are the open rows.
    """
    base = centers = run.centers
    k = len(base)
    made, converged = run.passes, run.converged
    moved_by = 0.0

    def figures(c: np.ndarray) -> tuple[np.ndarray, float]:
        label, own, _ = _measured(z, c) if len(z) else (np.zeros(0, np.int64), np.zeros(0), None)
        shift = c - base
        settled = cost - 2 * (shift * sums).sum(1) + n * (shift**2).sum(1)
        return label, float(own.sum() + settled.sum())

    while not converged and made < most and moved_by <= run.radius:
        label, _ = figures(centers)
        count = n + np.bincount(label, minlength=k)
        total = sums + n[:, None] * base
        np.add.at(total, label, z)
        moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
        made += 1
        converged = bool(np.sqrt(((moved - centers) ** 2).sum(1)).max() <= tolerance)
        centers = moved
        moved_by = float(np.sqrt(((centers - base) ** 2).sum(1)).max())
    covered = moved_by <= run.radius
    done = converged or made >= most
    # Centers that left the radius are measured in one more round.
    return Run(run.offset, run.scale, centers, 0.0, made, done, figures(centers)[1] if covered and done else None)


def _round(
    points: DataFrame, features: Sequence[str], runs: Sequence[Run], most_passes: int, tolerance: float
) -> list[Run]:
    """Every run taken as far as its radius covers, in one job."""
    shared = points.sparkSession.sparkContext.broadcast([run.shipped() for run in runs])
    axes = [f"s{i}" for i in range(len(features))]
    names = ["run", "center", "n", "cost", *axes]

    def split(batches):
        settled: dict[tuple[int, int], np.ndarray] = {}
        for x in _chunks(batches, features):
            for number, shipped in enumerate(shared.value):
                run = Run(*shipped)
                z = (x - run.offset) / run.scale
                if run.radius == float("inf"):
                    open_ = np.ones(len(z), bool)
                else:
                    label, own, margin = _measured(z, run.centers)
                    open_ = (margin <= run.radius) & (run.radius > 0)
                    for c in np.unique(label[~open_]).tolist():
                        mine = ~open_ & (label == c)
                        figures = np.array([mine.sum(), own[mine].sum(), *(z[mine] - run.centers[c]).sum(0)])
                        settled[number, c] = settled[number, c] + figures if (number, c) in settled else figures
                if open_.any():
                    m = int(open_.sum())
                    columns = [np.full(m, number, np.int32), np.full(m, -1, np.int32), np.ones(m), np.zeros(m), *z[open_].T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)
        if settled:
            keys, table = np.array(list(settled), np.int32), np.array(list(settled.values()))
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys.T.copy()), *map(pa.array, table.T.copy())], names)

    def advance(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        run = Run(*shared.value[key[0].as_py()])
        center = table.column("center").to_numpy()
        values = np.column_stack([table.column(c).to_numpy() for c in names[2:]])
        k = len(run.centers)
        sums = np.zeros((k, values.shape[1]))
        np.add.at(sums, center[center >= 0], values[center >= 0])
        z = values[center < 0, 2:]
        z = z[np.lexsort(z.T)]  # sums don't depend on the order in which rows arrive
        after = _passes(run, sums[:, 0], sums[:, 2:], sums[:, 1], z, most_passes, tolerance)
        cost = float("nan") if after.cost is None else after.cost
        columns = {"run": [key[0].as_py()], "centers": [after.centers.ravel().tolist()], "cost": [cost]}
        return pa.table(columns | {"passes": [after.passes], "converged": [after.converged]}, schema=out_schema)

    out_schema = pa.schema(
        [("run", pa.int32()), ("centers", pa.list_(pa.float64())), ("cost", pa.float64()), ("passes", pa.int32()), ("converged", pa.bool_())]
    )
    schema = "run int, center int, n double, cost double, " + ", ".join(f"{c} double" for c in axes)
    found = (
        points.select(*features)
        .mapInArrow(split, schema)
        .groupBy("run")
        .applyInArrow(advance, "run int, centers array<double>, cost double, passes int, converged boolean")
    )
    after = list(runs)
    for r in found.collect():
        old = runs[r["run"]]
        centers = np.array(r["centers"]).reshape(old.centers.shape)
        cost = None if np.isnan(r["cost"]) else r["cost"]
        after[r["run"]] = Run(old.offset, old.scale, centers, 0.0, r["passes"], r["converged"], cost)
    shared.destroy()
    return after


def fit_runs(
    points: DataFrame,
    features: Sequence[str],
    runs: Sequence[Run],
    open_rows: int = 1024,
    most_passes: int = 300,
    tolerance: float = 1e-4,
) -> list[Run]:
    """The runs at their end, each with the cost of the centers that it returns.

    A run ends when no center moves further than `tolerance`, or after `most_passes`. A center that loses all members
    stays where it is. Runs whose centers leave their radius get a new one and go on in the next round, at least one pass
    a round; where all rows fit, one round is all. The driver holds the centers of the runs, a task `open_rows` rows.
    """
    rows = points.count()
    runs = list(runs)
    if not rows:
        return runs
    while going := [i for i, run in enumerate(runs) if run.cost is None]:
        some = [runs[i] for i in going]
        if rows <= open_rows:
            for run in some:
                run.radius = float("inf")
        else:
            _set_radii(points, features, some, open_rows)
        for i, run in zip(going, _round(points, features, some, most_passes, tolerance)):
            runs[i] = run
    return runs


def multi_start_kmeans(
    points: DataFrame,
    features: Sequence[str],
    scalings: Mapping[str, object],
    ks: Sequence[int],
    n_init: int,
    seed: int,
    start_rows: int = 4096,
    **options,
) -> dict[tuple[str, int], KMeansFit]:
    """The cheapest of `n_init` runs for every scaling and k.

    `points` has the features in their own units. Runs start from k-means++ over `start_rows` rows, those with the lowest
    hash, with consecutive seeds.
    """
    raw = points.select(*[F.col(f).cast("double").alias(f) for f in features])
    sample = raw.orderBy(F.xxhash64(*features), *features).limit(start_rows).collect()
    rows = np.array([[r[f] for f in features] for r in sample])
    runs, owners = [], []
    for name, scaling in scalings.items():
        offset = np.array([scaling.offset[f] for f in features])
        scale = np.array([scaling.scale[f] for f in features])
        for k in ks:
            for start in range(n_init):
                runs.append(Run(offset, scale, starting_centers((rows - offset) / scale, k, seed + start)))
                owners.append((name, k))
    best: dict[tuple[str, int], KMeansFit] = {}
    for owner, run in zip(owners, fit_runs(raw, features, runs, **options)):
        if owner not in best or run.cost < best[owner].cost:
            best[owner] = KMeansFit(run.centers, run.cost)
    return best
