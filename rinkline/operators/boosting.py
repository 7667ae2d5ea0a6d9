"""Gradient-boosted regression trees with an L2 term and a leaf limit, grown best first from histograms.

Inputs are binned once and stored, a byte per feature. A round fits a tree to
the errors that are left: Spark adds up errors and rows by (node, feature, bin),
the driver sees only those sums and finds the best split of each node.

Best-first growth splits the leaf of highest gain until the tree has its leaves.
A split's gain depends on its node alone, so the nodes that such growth may reach
next are measured together: one aggregate serves all of them, and a tree takes
about as many aggregates as it has levels.

What tasks need of the model (trees since predictions were last stored) travels
with the job; predictions are stored every ``STORED_EVERY`` rounds.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkline.session import staged

#: Accuracy of the quantiles that bins are cut at; up to so many distinct values each has its own.
ACCURACY = 10_000
STORED_EVERY = 25


class Settings(NamedTuple):
    step_size: float = 0.1
    rounds: int = 100
    leaves: int = 31
    l2: float = 0.0
    least_rows: int = 20
    bins: int = 255
    depth: int | None = None


class Tree:
    """Nodes in the order they were made; an inner node sends bins up to ``cut`` to ``left``, others to the next node."""

    def __init__(self):
        self.feature, self.cut, self.left, self.value = [-1], [0], [0], [0.0]

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> int:
        left = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, left
        for value in values:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(value)
        return left

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row (rows x features)."""
        feature, cut, left = (np.array(x) for x in (self.feature, self.cut, self.left))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = left[at] + (bins[rows, feature[at]] > cut[at])
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


class Booster:
    """A fitted model: mean of the label, bin limits by feature, trees."""

    def __init__(self, features: list[str], base: float, limits: list[list[float]], trees: list[Tree]):
        self.features, self.base, self.limits, self.trees = features, base, limits, trees

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        """A value's bin is the number of limits below it."""
        return np.stack([np.searchsorted(lim, x, side="left").astype(np.uint8) for lim, x in zip(self.limits, columns)], axis=1)

    def predictor(self) -> Column:
        """The prediction as a column over the feature columns."""
        model = self

        @F.arrow_udf("double")
        def predicted(*columns: pa.Array) -> pa.Array:
            bins = model.bins([np.asarray(c, dtype=np.float64) for c in columns])
            return pa.array(sum((t.predict(bins) for t in model.trees), np.full(len(bins), model.base)))

        return predicted(*[F.col(f).cast("double") for f in self.features])

    def to_json(self) -> str:
        trees = [{"feature": t.feature, "cut": t.cut, "left": t.left, "value": t.value} for t in self.trees]
        return json.dumps({"features": self.features, "base": self.base, "limits": self.limits, "trees": trees})

    @classmethod
    def from_json(cls, text: str) -> Booster:
        held = json.loads(text)
        trees = []
        for found in held["trees"]:
            tree = Tree()
            tree.feature, tree.cut, tree.left, tree.value = (found[k] for k in ("feature", "cut", "left", "value"))
            trees.append(tree)
        return cls(held["features"], held["base"], held["limits"], trees)


class Split(NamedTuple):
    gain: float
    feature: int
    cut: int
    left: tuple[float, float]  # error sum and rows
    right: tuple[float, float]


def best_split(errors: np.ndarray, rows: np.ndarray, settings: Settings) -> Split | None:
    """The split of highest gain of one node's histograms (features x bins), the first of equal ones; None without a gain."""
    left_e, left_n = errors.cumsum(axis=1)[:, :-1], rows.cumsum(axis=1)[:, :-1]
    total_e, total_n = errors.sum(axis=1)[:, None], rows.sum(axis=1)[:, None]
    right_e, right_n = total_e - left_e, total_n - left_n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_e**2 / (left_n + settings.l2) + right_e**2 / (right_n + settings.l2) - total_e**2 / (total_n + settings.l2)
    gain[(left_n < settings.least_rows) | (right_n < settings.least_rows)] = -np.inf
    at = int(np.argmax(gain))
    feature, cut = np.unravel_index(at, gain.shape)
    if not gain[feature, cut] > 1e-12:
        return None
    pick = lambda e, n: (float(e[feature, cut]), float(n[feature, cut]))
    return Split(float(gain[feature, cut]), int(feature), int(cut), pick(left_e, left_n), pick(right_e, right_n))


def _leaf(sums: tuple[float, float], settings: Settings) -> float:
    return settings.step_size * sums[0] / (sums[1] + settings.l2)


def grow(measure, settings: Settings) -> Tree:
    """A tree of at most ``leaves`` leaves; ``measure(tree, nodes)`` gives the best split of each of some leaves of a tree.

    Growth is played through with what is known. Nodes that it reaches before
    their splits are measured are measured together, and it is played again.
    """
    known: dict[tuple, Split | None] = {}

    def play() -> tuple[Tree, dict[int, tuple]]:
        tree, paths, unknown = Tree(), {0: ()}, {}
        queue: list[tuple[float, int]] = []
        left_over = settings.leaves - 1

        def offer(node: int) -> None:
            if settings.depth is not None and len(paths[node]) >= settings.depth:
                return
            if paths[node] not in known:
                unknown[node] = paths[node]
            elif known[paths[node]]:
                heapq.heappush(queue, (-known[paths[node]].gain, node))

        offer(0)
        while queue and left_over:
            _, node = heapq.heappop(queue)
            split = known[paths[node]]
            first = tree.split(node, split.feature, split.cut, (_leaf(split.left, settings), _leaf(split.right, settings)))
            left_over -= 1
            paths[first], paths[first + 1] = (*paths[node], 0), (*paths[node], 1)
            if left_over:
                offer(first)
                offer(first + 1)
        return tree, unknown

    while True:
        tree, unknown = play()
        if not unknown:
            return tree
        nodes = sorted(unknown)
        known.update({unknown[n]: split for n, split in zip(nodes, measure(tree, nodes))})


def bin_limits(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to ``bins`` - 1 limits a feature: its values if there are few, else quantiles; the largest value is none."""
    points = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.col(f).cast("double"), F.array(*map(F.lit, points)), ACCURACY).alias(f) for f in features], *[F.max(F.col(f).cast("double")).alias(f"{f}_max") for f in features]).first()
    few = df.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    small = [f for f in features if few[f] <= bins * 2]
    values = df.agg(*[F.collect_set(F.col(f).cast("double")).alias(f) for f in small]).first() if small else {}
    out = []
    for f in features:
        own = sorted(set(values[f])) if f in small else None
        limits = own[:-1] if own is not None and len(own) <= bins else sorted({x for x in found[f] or [] if x < found[f"{f}_max"]})
        out.append(limits)
    return out


def fit(df: DataFrame, features: list[str], label: str, settings: Settings = Settings()) -> Booster:
    """Fit on a stored frame; features and label are numbers without nulls or NaN, other columns aren't read.

    An empty frame is refused.
    """
    if not 2 <= settings.bins <= 256:
        raise ValueError("bins must be 2 to 256: a bin is a byte")
    base = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if base is None:
        raise ValueError("there are no rows to fit on")
    model = Booster(features, base, bin_limits(df, features, settings.bins), [])
    width = len(features)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.bins([np.asarray(batch.column(i), dtype=np.float64) for i in range(width)])
            error = np.asarray(batch.column(width), dtype=np.float64) - base
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in bins], pa.binary()), pa.array(error)], ["bins", "error"])

    numbers = [F.col(c).cast("double").alias(c) for c in [*features, label]]
    rows = staged(df.select(*numbers).mapInArrow(binned, "bins binary, error double"), "binned")
    for _ in range(settings.rounds):
        since = model.trees[len(model.trees) - len(model.trees) % STORED_EVERY :]
        tree = grow(lambda tree, nodes, since=since: _measure(rows, since, tree, nodes, width, settings), settings)
        model.trees.append(tree)
        if len(model.trees) % STORED_EVERY == 0 and len(model.trees) < settings.rounds:
            rows = staged(_with_errors(rows, model.trees[-STORED_EVERY:], width), "binned")
    return model


def _unpacked(batch: pa.RecordBatch, width: int, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, width)
    error = np.asarray(batch.column(1), dtype=np.float64)
    for tree in trees:
        error = error - tree.predict(bins)
    return bins, error


def _with_errors(rows: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, error = _unpacked(batch, width, trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(error)], ["bins", "error"])

    return rows.mapInArrow(run, "bins binary, error double")


def _measure(rows: DataFrame, since: list[Tree], tree: Tree, nodes: list[int], width: int, settings: Settings) -> list[Split | None]:
    """Best splits of some leaves of ``tree``, from one aggregate over all rows."""
    shape = (len(nodes), width, settings.bins)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        errors, counts = np.zeros(np.prod(shape)), np.zeros(np.prod(shape), np.int64)
        for batch in batches:
            bins, error = _unpacked(batch, width, since)
            node = place[tree.leaves(bins)]
            bins, error, node = bins[node >= 0], error[node >= 0], node[node >= 0]
            slot = (node[:, None] * width + np.arange(width)) * settings.bins + bins
            errors += np.bincount(slot.ravel(), np.repeat(error, width), minlength=len(errors))
            counts += np.bincount(slot.ravel(), minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(errors[found]), pa.array(counts[found])], ["slot", "error", "n"])

    sums = rows.mapInArrow(add, "slot long, error double, n long").groupBy("slot").agg(F.sum("error").alias("error"), F.sum("n").alias("n")).toArrow()
    errors, counts = np.zeros(np.prod(shape)), np.zeros(np.prod(shape), np.int64)
    errors[sums["slot"].to_numpy()], counts[sums["slot"].to_numpy()] = sums["error"].to_numpy(), sums["n"].to_numpy()
    return [best_split(e, n, settings) for e, n in zip(errors.reshape(shape), counts.reshape(shape))]
