"""Approximate nearest neighbours by inner product with several shifted Hilbert orderings.

Every vector is projected to ``PLANE`` dimensions ``ORDERINGS`` times; each
projection, shifted by its own offset, is a cell on a Hilbert curve, and the
curve's keys order all vectors once per projection. An ordering is cut into
pages of neighbouring keys. A query looks at a window of pages around its own
key in those orderings in which it lies furthest from the centre (there a
neighbour's place tells most), scores what it finds on the original vectors
and merges the best of all windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rinkline.llm.common import staged

ORDERINGS, PLANE, CELL_BITS = 16, 2, 12
#: Orderings that a query looks at, and the share of an ordering in its window.
LOOKED_AT, SHARE = 4, 0.38
#: Pages of an ordering; a page longer than ``PAGE_ROWS`` is dealt to several tasks by a hash of the id.
PAGES, PAGE_ROWS, LEAST_ROWS = 64, 4096, 128
#: Scales and page limits are fitted on about so many vectors; all vectors are indexed.
FIT_VECTORS = 20_000
SEED = 23


class Curves(NamedTuple):
    planes: np.ndarray  # orderings x dimensions x PLANE
    centre: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    limits: np.ndarray  # orderings x (pages - 1)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below ``2**bits`` (points x dimensions).

    From the highest bit down, the bits of a cell are Gray-coded and the part of the
    curve below is reflected and its axes swapped as the entry corner demands.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> b) & 1 == 1, flip ^ ((1 << b) - 1), flip)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ flip) >> b) & 1
    return key


def fit(sample: np.ndarray, pages: int, seed: int = SEED) -> Curves:
    """Projections, scales and page limits from sampled vectors (rows)."""
    draw = np.random.default_rng(seed)
    dim = sample.shape[1]
    plane = min(PLANE, dim)
    planes = np.stack([np.linalg.qr(draw.standard_normal((dim, plane)))[0] for _ in range(ORDERINGS)])
    placed = np.einsum("nd,odp->onp", sample, planes)
    centre, scale = placed.mean(axis=1, keepdims=True), placed.std(axis=1, keepdims=True) + 1e-12
    curves = Curves(planes, centre, scale, draw.uniform(0, 2, (ORDERINGS, 1, plane)), np.zeros((ORDERINGS, 0)))
    keys, _ = place(curves, sample)
    return curves._replace(limits=np.quantile(keys, np.arange(1, pages) / pages, axis=1, method="lower").T.reshape(ORDERINGS, -1))


def place(curves: Curves, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hilbert keys (orderings x vectors) and distances from the centre in the projections."""
    at = (np.einsum("nd,odp->onp", vectors, curves.planes) - curves.centre) / curves.scale
    cells = np.clip((at + 6 + curves.shift) / 14 * (1 << CELL_BITS), 0, (1 << CELL_BITS) - 1).astype(np.int64)
    keys = np.stack([hilbert_keys(c, CELL_BITS) for c in cells])
    return keys, np.sqrt((at**2).sum(axis=2))


def page_of(curves: Curves, keys: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(limit, k, side="right") for limit, k in zip(curves.limits, keys, strict=True)])


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """(vec_id, v): vectors that take part, as doubles; of the given length, if one is given.

    Left out: null ids; null or empty vectors; vectors with a null, NaN or
    infinite component or only zeros; vectors of another length than the most
    frequent one (of equally frequent ones, the longest).
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: F.coalesce((x - x) == 0, F.lit(False)))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    if length is not None:
        return rows.where(F.size("v") == length)
    common = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("v") == (common["length"] if common else 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of ``vectors`` for each row of ``queries``.

    Both have vec_id and embedding; see ``usable`` for rows that take no part.
    Nearness is the inner product of the original vectors in doubles; ties go to
    the smaller vec_id; a query's own vec_id is no candidate, and a repeated
    vec_id is found once. With few vectors (below about ``LEAST_ROWS`` times three) windows cover all of
    them. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    every = staged(usable(vectors), "vectors")
    n = every.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = len(every.first()["v"])
    asked = usable(queries, length)
    pages = max(1, min(PAGES, n // LEAST_ROWS))
    cut = int(min(1.0, FIT_VECTORS / n) * (1 << 32))
    sample = every.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32)) < cut).select("v").toPandas()["v"]
    curves = fit(np.stack(sample.to_numpy()) if len(sample) else np.ones((1, length)), pages)
    width = min(pages, int(np.ceil(share * pages)) + 1)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                found = page_of(curves, place(curves, matrix(batch))[0])
                for o in range(ORDERINGS):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, o, np.int32)), pa.array(found[o].astype(np.int32)), *batch.columns], names=["ordering", "page", "vec_id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                keys, far = place(curves, matrix(batch))
                own = page_of(curves, keys)
                best = np.argsort(-far, axis=0, kind="stable")[:LOOKED_AT]
                for o in range(ORDERINGS):
                    rows = np.flatnonzero((best == o).any(axis=0))
                    if not len(rows):
                        continue
                    start = np.clip(own[o][rows] - width // 2, 0, pages - width)
                    page = (start[:, None] + np.arange(width)).ravel()
                    picked = batch.take(pa.array(np.repeat(rows, width)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(page), o, np.int32)), pa.array(page.astype(np.int32)), *picked.columns], names=["ordering", "page", "vec_id", "v"])

    kind = "ordering int, page int, vec_id long, v array<double>"
    indexed = every.mapInArrow(index, kind)
    # A page may hold a third of all vectors (equal ones have equal keys): its rows are dealt to as many tasks as it needs.
    shares = staged(indexed.groupBy("ordering", "page").agg(F.ceil(F.count("*") / PAGE_ROWS).cast("int").alias("shares")), "pages")
    shares = F.broadcast(shares)  # at most ORDERINGS * PAGES rows
    here = indexed.join(shares, ["ordering", "page"]).withColumn("share", F.pmod(F.xxhash64("vec_id"), F.col("shares")).cast("int")).drop("shares")
    there = asked.mapInArrow(ask, kind).join(shares, ["ordering", "page"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def score(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one) and len(two):
            one = one.sort_values("vec_id", kind="stable")
            ids, v, q = one["vec_id"].to_numpy(), np.stack(one["v"].to_numpy()), np.stack(two["v"].to_numpy())
            for lo in range(0, len(q), 256):
                rough = q[lo : lo + 256] @ v.T
                rough[two["vec_id"].to_numpy()[lo : lo + 256, None] == ids] = -np.inf
                least = np.partition(rough, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                slack = 1e-9 * (1 + np.abs(least))
                for i in range(len(rough)):
                    near = np.flatnonzero((rough[i] >= (least[i] - slack[i] if np.isfinite(least[i]) else -np.inf)) & np.isfinite(rough[i]))
                    # Rows are multiplied and summed alike, so equal vectors have equal scores.
                    exact = (v[near] * q[lo + i]).sum(axis=1)
                    best = np.argsort(-exact, kind="stable")[:k]
                    out.append(pd.DataFrame({"query_id": two["vec_id"].iloc[lo + i], "vec_id": ids[near][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    key = ["ordering", "page", "share"]
    found = here.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(score, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
