"""Compression of vectors to four byte codes, with an integer Walsh-Hadamard search for the nearest entry.

Components become integers, floor(1024 x). A vector is cut into ``PARTS`` equal
consecutive parts, each with a codebook of at most ``ENTRIES`` entries that are
fitted by ``ROUNDS`` rounds of assigning and averaging over all vectors.

Nearest entries are found in the transformed domain: parts and entries, padded
with zeros to a power of two D, go through the unnormalised Walsh-Hadamard
transform, whose rows are taken in sequency order. It keeps distances up to the
factor D, so the squared differences of the first coefficients bound D times the
squared distance from below, and an entry whose running sum is above the full sum
of another one is out. All sums are integers; the scaled distance that is left
divides by D exactly.

A round is one pass: a task adds up its own parts by entry, and Spark adds up the
tasks. Codebooks (at most 4 x 256 entries) are what the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline.llm.common import staged

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors that are compared with a codebook at once, and coefficients that are added up before the first elimination and between later ones.
ROWS_AT_ONCE, FIRST, STEP = 1024, 4, 4
#: Vectors with a component beyond this many bits take no part; up to it all sums of tasks fit 38 digits.
BITS = 90
_MOST = (1 << 63) - 1


def hadamard(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows by their number of sign changes."""
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def transformed(rows: np.ndarray) -> np.ndarray:
    """Rows padded with zeros to a power of two, transformed, coefficients in sequency order."""
    width = rows.shape[1]
    size = 1 << max(width - 1, 0).bit_length()
    return rows @ hadamard(size)[:, :width].T.astype(rows.dtype)


def fits_64_bits(size: int, *tables: np.ndarray) -> bool:
    """Whether sums of squared differences of transformed rows of ``size`` components stay within 64 bits."""
    most = max((abs(int(x)) for t in tables if t.size for x in (t.min(), t.max())), default=0)
    return 2 * most * size < 1 << 31


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of its nearest entry (the smaller of equally near ones) and the squared distance.

    64-bit integers where they suffice for sure, else Python's.
    """
    size = 1 << max(rows.shape[1] - 1, 0).bit_length()
    kind = np.int64 if fits_64_bits(size, rows, entries) else object
    book = transformed(entries.astype(kind))
    index, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), dtype=kind)
    for at in range(0, len(rows), ROWS_AT_ONCE):
        part = transformed(rows[at : at + ROWS_AT_ONCE].astype(kind))
        total = np.zeros((len(part), len(book)), dtype=kind)
        for k in range(min(FIRST, size)):
            total += (part[:, k, None] - book[None, :, k]) ** 2
        guess = total.argmin(axis=1)
        bound = ((part - book[guess]) ** 2).sum(axis=1)
        r, e = np.nonzero(total <= bound[:, None])
        total = total[r, e]
        for k in range(FIRST, size, STEP):
            total = total + ((part[r, k : k + STEP] - book[e, k : k + STEP]) ** 2).sum(axis=1)
            left = total <= bound[r]
            r, e, total = r[left], e[left], total[left]
        first = np.searchsorted(r, np.arange(len(part)))
        least = np.minimum.reduceat(total, first)
        best = np.flatnonzero(total == least[r])
        best = best[np.searchsorted(r[best], np.arange(len(part)))]
        index[at : at + len(part)] = e[best]
        error[at : at + len(part)] = least // size
    return index, error


def integers(values: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list array without nulls as integer rows, padded with zeros to a multiple of ``PARTS``."""
    flat = np.asarray(values.flatten(), dtype=np.float64).reshape(len(values), width)
    scaled = np.floor(flat * SCALE)  # a product with a power of two is exact
    if scaled.size and np.abs(scaled).max() >= 1 << 62:
        rows = np.array([int(x) for x in scaled.ravel()], dtype=object).reshape(scaled.shape)
    else:
        rows = scaled.astype(np.int64)
    return np.pad(rows, ((0, 0), (0, -width % PARTS)))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector isn't null or empty and holds finite components only, below 2**``BITS`` when scaled."""
    limit = F.lit(float(2**BITS / SCALE))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole)


class Codes:
    """The codebooks of ``fit``: one integer table of entries per part, for vectors of ``width`` components."""

    def __init__(self, width: int, books: list[np.ndarray]):
        self.width, self.books = width, books

    def sha256(self) -> str:
        numbers = (str(int(x)) for book in self.books for x in book.ravel())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def assign(self, values: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """By part: the vectors' own integers, their entries and squared distances."""
        cut = np.split(integers(values, self.width), PARTS, axis=1)
        found = [nearest(rows, book) for rows, book in zip(cut, self.books)]
        return cut, [i for i, _ in found], [e for _, e in found]


def _sums(kept: DataFrame, codes: Codes) -> DataFrame:
    """By slot (part, entry, position in a flat order): how many parts lie with the entry and the sum of their components."""
    shape = (PARTS, ENTRIES, codes.books[0].shape[1])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, dtype=object), np.zeros(shape[:2], dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cut, index, _ = codes.assign(batch.column(0))
            for p in range(PARTS):
                one = np.zeros(shape[1:], dtype=cut[p].dtype)
                np.add.at(one, index[p], cut[p])
                total[p] += one
                count[p] += np.bincount(index[p], minlength=ENTRIES)
        p, e = np.nonzero(count)
        if len(p):
            slots = (np.ravel_multi_index((p, e), shape[:2])[:, None] * shape[2] + np.arange(shape[2])).ravel()
            sums = pa.array([Decimal(int(x)) for x in total[p, e].ravel()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.repeat(count[p, e], shape[2])), sums], ["slot", "n", "total"])

    rows = kept.select("embedding").mapInArrow(add, "slot long, n long, total decimal(38,0)")
    return rows.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def fit(kept: DataFrame) -> Codes | None:
    """Codebooks over all of ``kept`` (see ``usable``); None if there is no vector.

    They begin as the vectors of the ``ENTRIES`` smallest vec_ids; rows of one id
    are ordered by their vectors, and rows without id come last. The vectors'
    length is that of the first one. An entry that no part lies with stays.
    """
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = kept.orderBy(*order).select(F.size("embedding")).first()
    if first is None:
        return None
    width = first[0]
    kept = kept.where(F.size("embedding") == width)
    seeds = [r[0] for r in kept.orderBy(*order).limit(ENTRIES).select("embedding").collect()]
    codes = Codes(width, np.split(integers(pa.array(seeds, pa.list_(pa.float64())), width), PARTS, axis=1))
    for _ in range(ROUNDS):
        books = [book.astype(object) for book in codes.books]
        span = books[0].shape[1]
        for slot, n, total in _sums(kept, codes).collect():
            entry, position = divmod(slot, span)
            books[entry // ENTRIES][entry % ENTRIES, position] = int(total) // n
        codes = Codes(width, [b.astype(np.int64) if all(abs(int(x)) < 1 << 62 for x in b.ravel()) else b for b in books])
    return codes


def encode(vectors: DataFrame, codes: Codes | None = None) -> DataFrame:
    """vec_id, label, code (two hex digits per part) and squared error of every vector, with the codebooks' hash.

    Vectors that aren't ``usable`` or are of another length than the codebooks' take no part; an error beyond 64 bits
    is null. A length that doesn't divide by ``PARTS`` is filled up with zero components.
    Every other row gives one, so repeated rows and null ids or labels stay; other columns aren't returned.
    """
    kept = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding")))
    codes = codes or fit(kept)
    kept = kept.where(F.size("embedding") == (codes.width if codes else -1))
    kind = dict(kept.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, index, errors = codes.assign(batch.column(2))
            text = [bytes(x).hex() for x in np.stack(index, axis=1).astype(np.uint8)]
            error = sum(errors)
            error = pa.array([int(x) if x <= _MOST else None for x in error], pa.int64()) if error.dtype == object else pa.array(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), error], ["vec_id", "label", "code", "error"])

    coded = kept.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")
    return coded.withColumn("codebooks_sha256", F.lit(codes.sha256() if codes else hashlib.sha256(b"").hexdigest()))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``encode``'s rows with the error summed over equal labels, nulls together (null where it passes 64 bits)."""
    coded = staged(coded, "codes")
    sums = coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error")
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"]), "left").drop("_label")
