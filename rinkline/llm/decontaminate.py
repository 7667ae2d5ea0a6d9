"""Benchmark decontamination: item-sized windows found by SimHash, verified by weighted shingles.

A benchmark item and every window of a document that is as long as the item
have a SimHash of ``BITS`` bits over their k-word shingles. The item hashes are
indexed by blocks of bits: if two hashes differ in at most ``RADIUS`` bits, some
block of the two differs in at most ``RADIUS // BLOCKS`` bits, and all such
variants of a block are looked up, so no window within the radius is missed.
What is found is verified by the weighted similarity of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline.llm.common import steps, texts_of
from rinkline.llm.words import mix, shingles_of, words_of

K = 5
SIMILARITY = 0.8
BITS, BLOCKS = 128, 8
BLOCK_BITS = BITS // BLOCKS
#: Two sets of weighted similarity 0.8 differ in 19.4 of 128 bits on average, with a deviation of 4.1.
RADIUS = 31
#: Items, and bytes of their texts, that are sent to every task at once; a larger benchmark goes block by block. A longer single item is a block.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 16 << 20
_VARIANTS = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), r)], dtype=np.uint16)


class Index(NamedTuple):
    ids: np.ndarray
    lengths: np.ndarray  # words of the item
    shingles: list[np.ndarray]  # sorted distinct
    counts: list[np.ndarray]
    known: np.ndarray  # all shingles, sorted
    weights: np.ndarray  # of the known shingles
    new_weight: float  # of a shingle that one item or none holds
    weighed: np.ndarray  # shingles of the whole benchmark that weigh otherwise, sorted
    weighs: np.ndarray
    owner: np.ndarray  # items by known shingle: owner[first[i]:first[i + 1]]
    first: np.ndarray
    hashes: np.ndarray  # items x BLOCKS
    table: list[tuple[np.ndarray, np.ndarray]]  # by block: sorted values and items


def bits_of(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the ``BITS`` bits of each shingle hash."""
    words = np.stack([mix(h ^ np.uint64(0xA5A5A5A5)), mix(h ^ np.uint64(0x5A5A5A5A5A))], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Blocks of 16 bits from the signs of weighted sums."""
    return np.ascontiguousarray(np.packbits(sums > 0, axis=1)).view(np.uint16)


def holders(benchmark: DataFrame, k: int = K) -> tuple[int, np.ndarray, np.ndarray]:
    """(items with words, shingles that several of them hold, how many hold each), sorted, from the whole benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                hashes, first = shingles_of(words_of(texts_of(batch)), k)
                held = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True) if b > a]
                own, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n, pa.int64()), pa.array(np.zeros(len(own), bool))], names=["shingle", "n", "total"])
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([True])], names=["shingle", "n", "total"])

    counts = benchmark.select("text").mapInArrow(run, "shingle long, n long, total boolean").groupBy("total", "shingle").agg(F.sum("n").alias("n"))
    table = counts.where("total OR n > 1").toArrow()
    total, shingle, n = (np.asarray(table.column(c).to_numpy()) for c in ("total", "shingle", "n"))
    total = total.astype(bool)
    shared, by = shingle[~total].astype(np.int64).view(np.uint64), n[~total].astype(np.int64)
    order = np.argsort(shared)
    return int(n[total].sum()), shared[order], by[order]


def build(ids: list, texts: list[str], k: int = K, held: tuple[int, np.ndarray, np.ndarray] | None = None) -> Index:
    """Index of items; an item without words can't be found. Weights fall with the number of items that hold a shingle.

    ``held`` (see ``holders``) has those numbers for the whole benchmark of which
    these items are a block; a shingle that isn't in it is held by one item.
    """
    words = words_of(pa.array(texts, pa.string()))
    hashes, first = shingles_of(words, k)
    used = [i for i in range(len(ids)) if first[i + 1] > first[i]]
    pairs = [np.unique(hashes[first[i] : first[i + 1]], return_counts=True) for i in used]
    shingles, counts = [p[0] for p in pairs], [p[1] for p in pairs]
    flat = np.concatenate(shingles) if used else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(used)), [len(s) for s in shingles]) if used else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    known, start = np.unique(flat[order], return_index=True)
    start = np.append(start, len(flat))
    number, by = len(used), np.diff(start)
    weigh, weighed = known, by
    if held is not None:
        number, weigh, weighed = held
        place = np.minimum(np.searchsorted(weigh, known), max(len(weigh) - 1, 0))
        by = np.where(weigh[place] == known, weighed[place], 1) if len(weigh) else np.ones(len(known), np.int64)
    weights = 1 + np.log(max(number, 1) / np.maximum(by, 1))
    new_weight = 1 + np.log(max(number, 1))
    # Shingles of other blocks weigh in the windows as their own items' do.
    weigh_of = 1 + np.log(max(number, 1) / np.maximum(weighed, 1))
    lengths = np.array([words.first[i + 1] - words.first[i] for i in used], dtype=np.int64)
    sums = [(bits_of(s) * (c * weights[np.searchsorted(known, s)])[:, None]).sum(axis=0) for s, c in zip(shingles, counts, strict=True)]
    blocks = packed(np.array(sums)) if used else np.zeros((0, BLOCKS), np.uint16)
    table = []
    for b in range(BLOCKS):
        value = (blocks[:, b][:, None] ^ _VARIANTS).ravel()
        owner = np.repeat(np.arange(len(used)), len(_VARIANTS))
        by = np.argsort(value, kind="stable")
        table.append((value[by], owner[by]))
    return Index(np.array([ids[i] for i in used]), lengths, shingles, counts, known, weights, new_weight, weigh, weigh_of, item[order], start, blocks, table)


def weight_of(index: Index, shingles: np.ndarray) -> np.ndarray:
    if not len(index.weighed):
        return np.full(len(shingles), index.new_weight)
    at = np.minimum(np.searchsorted(index.weighed, shingles), len(index.weighed) - 1)
    return np.where(index.weighed[at] == shingles, index.weighs[at], index.new_weight)


def near(index: Index, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) pairs within ``RADIUS`` bits: all of them, by the block index."""
    found = []
    for b, (value, owner) in enumerate(index.table):
        lo, hi = np.searchsorted(value, hashes[:, b]), np.searchsorted(value, hashes[:, b], side="right")
        held = hi - lo
        window = np.repeat(np.arange(len(hashes)), held)
        at = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(lo, held)
        found.append(window * len(index.ids) + owner[at])
    pair = np.unique(np.concatenate(found))
    window, item = pair // len(index.ids), pair % len(index.ids)
    apart = np.bitwise_count(hashes[window] ^ index.hashes[item]).sum(axis=1)
    return window[apart <= RADIUS], item[apart <= RADIUS]


def similarity(index: Index, item: int, window: np.ndarray) -> float:
    """Weighted Jaccard similarity (with repeats) of an item and a window's shingles."""
    own, counts = np.unique(window, return_counts=True)
    weight = weight_of(index, own)
    theirs, their_counts = index.shingles[item], index.counts[item]
    place = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
    matched = np.where(theirs[place] == own, np.minimum(counts, their_counts[place]), 0)
    shared = (matched * weight).sum()
    total = (counts * weight).sum() + (their_counts * index.weights[np.searchsorted(index.known, theirs)]).sum() - shared
    return float(shared / total)


def matches(index: Index, shingles: np.ndarray, words: int, least: float, k: int = K) -> list[tuple[int, int, int, float]]:
    """(item, first word, words, similarity) of the best window of each item that a document holds.

    Windows of an item's length are hashed wherever they share a shingle with an
    item of that length; a window that shares none has similarity zero.
    """
    if not len(index.known) or not len(shingles):
        return []
    at = np.minimum(np.searchsorted(index.known, shingles), len(index.known) - 1)
    anchors = np.flatnonzero(index.known[at] == shingles)
    if not len(anchors):
        return []
    held = index.first[at[anchors] + 1] - index.first[at[anchors]]
    spot = np.repeat(anchors, held)
    owners = index.owner[np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(index.first[at[anchors]], held)]
    spans = index.lengths[owners]
    best: dict[int, tuple[int, int, float]] = {}
    for length in np.unique(spans):
        size = max(length - k + 1, 1)  # shingles of a window
        places = np.unique(spot[spans == length])
        # Starts of all windows over an anchor; a document shorter than the item is one window.
        lo, hi = np.maximum(places - size + 1, 0), np.minimum(places, max(len(shingles) - size, 0))
        starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)]))
        base, stop = starts[0], min(starts[-1] + size, len(shingles))
        part = shingles[base:stop]
        weight = weight_of(index, part)
        for chunk in range(0, len(starts), 4096):
            now = starts[chunk : chunk + 4096] - base
            a, b = now[0], min(now[-1] + size, len(part))
            sums = np.zeros((b - a + 1, BITS), dtype=np.float64)
            np.cumsum(bits_of(part[a:b]) * weight[a:b, None], axis=0, out=sums[1:])
            windows = packed(sums[np.minimum(now + size, b) - a] - sums[now - a])
            for w, item in zip(*near(index, windows), strict=True):
                if index.lengths[item] != length:
                    continue
                score = similarity(index, item, part[now[w] : now[w] + size])
                if score >= least and score > best.get(item, (0, 0, 0.0))[2]:
                    best[item] = (int(base + now[w]), int(min(length, words)), score)
    return [(i, *best[i]) for i in sorted(best)]


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, k: int = K) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) for every document and item that it holds.

    All windows of every whole text count. Null and empty texts and items match
    nothing; items of fewer than k words are one shingle. Of equally similar windows the first is
    reported. Repeated documents are each reported, rows without doc_id with a
    null; repeated items likewise. Other columns are ignored. The items (text
    and id) are read by the driver in blocks of ``ITEMS_AT_ONCE`` items and
    ``BYTES_AT_ONCE`` at most; every block is held against all documents, with
    the weights of the whole benchmark.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    counts: list[tuple] = []
    parts, held, size = [], [], 0
    for row in items.toLocalIterator():
        more = len(row["text"].encode())
        if held and (len(held) == ITEMS_AT_ONCE or size + more > BYTES_AT_ONCE):
            # One block weighs by itself as the whole benchmark does.
            counts = counts or [holders(items, k)]
            parts.append(_against(docs, held, least, k, counts[0]))
            held, size = [], 0
        held.append(row)
        size += more
    parts.append(_against(docs, held, least, k, counts[0] if counts else None))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _against(docs: DataFrame, items: list, least: float, k: int, held: tuple[int, np.ndarray, np.ndarray] | None) -> DataFrame:
    ids, texts = [r["item_id"] for r in items], [r["text"] for r in items]
    built: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(build(ids, texts, k, held))
        index = built[0]
        for whole in batches:
            for batch in steps(whole):
                words = words_of(texts_of(batch))
                shingles, first = shingles_of(words, k)
                # One look at all texts of the step; only those with an anchor are searched.
                at = np.minimum(np.searchsorted(index.known, shingles), max(len(index.known) - 1, 0))
                hit = index.known[at] == shingles if len(index.known) else np.zeros(len(shingles), bool)
                rows = np.unique(np.searchsorted(first, np.flatnonzero(hit), side="right") - 1)
                out = []
                for d in rows:
                    found = matches(index, shingles[first[d] : first[d + 1]], int(words.first[d + 1] - words.first[d]), least, k)
                    out += [(batch.column(0)[int(d)].as_py(), index.ids[i], start, n, score) for i, start, n, score in found]
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, similarity double")
