"""N-gram Jaccard join: documents whose shingle sets are similar, and the groups they form.

Exact for every pair: no link between different sets is lost. The steps:

1. Each text becomes its set of k-word shingles. Equal sets are one node.
2. Shingles are hashed into groups, and a set's counts by group are a point.
   Two similar sets differ in at most d shingles, so with m > d groups some
   group holds the same shingles in both: (size class, group, hash of
   the group's shingles) routes both points to one place. m is chosen larger than
   that, and a set leaves its shortest groups out. Unrelated sets hardly
   ever meet there, whatever common lines or passages they share.
3. Every node is checked with the most complete set that it meets; what links
   forms components.
4. What still lies apart in one place goes into an R-tree over the
   count vectors; pairs whose summed minima reach the bound are verified.

An R-tree over all points alone would not do: counts of unrelated texts of one
length lie close together, so its boxes all overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkline.llm.common import only_ids, staged, steps, texts_of
from rinkline.llm.components import components
from rinkline.llm.count_tree import CountTree
from rinkline.llm.words import mix, shingles_of, words_of

#: Groups of the count vectors (powers of two) of sets from so many shingles on: the more groups, the more the counts
#: of unrelated sets differ, which by the bound tells them apart from about one group for every ten shingles on.
GROUPS = ((0, 64), (250, 256), (2500, 1024))
#: Pairs with one left side that one task checks, about.
PAIRS_A_TASK = 1000
#: Shingles of a block that is searched in one piece, about (eight bytes each); a set counts as so many at least, for its point.
BLOCK_SHINGLES, LEAST_SHINGLES = 2_000_000, 200
HOLDS, HOLDS_AND_ASKS, ASKS = 0, 1, 2
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, first = shingles_of(words_of(texts), k)
    for d in range(len(first) - 1):
        yield np.unique(hashes[first[d] : first[d + 1]])


def node_of(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    total = mix(s).sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * _P
    return int(mix(total).view(np.int64)[0])


#: Sizes of one class differ by so much at most (by den / num if that is more): the narrower, the longer the groups, and the more kinds of pairs.
CLASS = 1.5
#: Groups that are made beyond those that a set sends, as a share of them; a set leaves out its shortest ones.
SPARE = 0.35


@lru_cache(maxsize=64)
def edges_of(num: int, den: int) -> np.ndarray:
    """The least size of each class."""
    wide, edges = max(CLASS, den / num), [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * wide)))
    return np.array(edges)


@lru_cache(maxsize=1024)
def plan_of(kind: int, num: int, den: int) -> tuple[int, int, int, np.ndarray] | None:
    """Lowest and highest size, groups that must agree, and group bounds for a kind of pairs; None if only equal sets link.

    Kind 2c: both sizes in class c; kind 2c+1: one in class c and one in the next.
    """
    edges = edges_of(num, den)
    edge = int(edges[kind // 2 + 1])
    if kind % 2:
        low, high = -(-num * edge // den), (edge - 1) * den // num
        most = edge - 1 + high
    else:
        low, high, most = int(edges[kind // 2]), edge - 1, 2 * (edge - 1)
    differ = most * (den - num) // (den + num)
    if differ == 0 or low > high:
        return None
    # Enough groups beyond those that must differ that the ones left out hold all empty ones, but for rare sets.
    spare = max(ceil(2 * (differ + 1) * exp(-low / (differ + 1))) + 2, ceil(SPARE * (differ + 1)))
    m = differ + 1 + spare
    bounds = np.array([-(-(j << 64) // m) for j in range(1, m)], dtype=np.uint64)
    return low, high, m - differ, bounds


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Places where the set meets every set that it can link with.

    Of the groups that must agree, one less are left out: those with the fewest
    shingles (then of smallest content), which unrelated sets share by chance. The
    last of the agreeing groups in that order is left out by neither set.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.uint64)
    c = int(np.searchsorted(edges_of(num, den), n, side="right")) - 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(s ^ _R), out=sums[1:])
    out = []
    for kind in (2 * c - 1, 2 * c, 2 * c + 1):
        plan = plan_of(kind, num, den) if kind >= 0 else None
        if plan is None or not plan[0] <= n <= plan[1]:
            continue
        cut = np.concatenate(([0], np.searchsorted(s, plan[3]), [n]))
        held, content = np.diff(cut), sums[cut[1:]] - sums[cut[:-1]]
        group = np.lexsort((content, held))[plan[2] - 1 :]
        out.append(mix(content[group] * _P + group.astype(np.uint64) * _Q + np.array([kind], np.uint64) * _R + held[group].astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def counts_of(s: np.ndarray) -> np.ndarray:
    """The point of a set: its shingles by group, that is by the first bits of their hashes."""
    groups = max(g for least, g in GROUPS if len(s) >= least)
    return np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def measure(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, node, counts): size and identity of every text's set, and its point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                n, node, counts = zip(*((len(s), node_of(s), counts_of(s).astype("<u4").tobytes()) for s in sets_of(texts_of(batch), k)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(counts, pa.binary())], names=["doc_id", "n", "node", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, counts binary")


def meeting(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(place, node) of all places where at least two nodes meet.

    A task sends a set once, however many copies it reads.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in steps(whole):
                places, nodes = [], []
                for s in sets_of(texts_of(batch), k):
                    node = node_of(s)
                    if node not in seen:
                        seen.add(node)
                        places.append(signatures(s, num, den))
                        nodes.append(np.full(len(places[-1]), node, dtype=np.int64))
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places).view(np.int64)), pa.array(np.concatenate(nodes))], names=["place", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows in, rows whose place has another node out; only one row is carried over."""
        place, node, tied = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            place = np.concatenate((place, np.asarray(batch.column(0))))
            node = np.concatenate((node, np.asarray(batch.column(1))))
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1]) | (node[1:] != node[:-1])
            place, node = place[new], node[new]
            same = place[1:] == place[:-1]
            keep = np.zeros(len(place), bool)
            keep[0] = tied
            keep[1:] |= same
            keep[:-1] |= same
            if keep[:-1].any():
                yield pa.RecordBatch.from_arrays([pa.array(place[:-1][keep[:-1]]), pa.array(node[:-1][keep[:-1]])], names=["place", "node"])
            place, node, tied = place[-1:], node[-1:], bool(keep[-1])
        if tied:
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(node)], names=["place", "node"])

    sent = docs.select("text").mapInArrow(send, "place long, node long")
    return sent.repartition("place").sortWithinPartitions("place", "node").mapInArrow(meet, "place long, node long")


def texts_of_nodes(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, text) of the wanted nodes, each once, stored."""
    wanted = staged(wanted.join(nodes.select("node", F.col("rep").alias("doc_id")), "node"), "wanted")
    texts = only_ids(docs.select("doc_id", "text"), wanted.select("doc_id").distinct(), "doc_id", wanted.count())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                found = [node_of(s) for s in sets_of(texts_of(batch), k)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(1)], names=["node", "text"])

    # An id may stand on several texts: the set decides which one is meant.
    texts = texts.mapInArrow(keyed, "node long, text string").join(wanted.select("node"), "node", "left_semi")
    return staged(texts.dropDuplicates(["node"]), "texts")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) that are similar enough by their whole sets.

    Each text is fetched once per pair on the right and once per about
    ``PAIRS_A_TASK`` pairs on the left, so a set with very many partners is
    spread over tasks.
    """
    pairs = staged(pairs, "pairs")
    texts = texts_of_nodes(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), docs, nodes, k)
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).alias("shares"))
    dealt = pairs.join(share, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"))
    left = dealt.select("a", "share").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "share", F.lit(None).cast("long").alias("b"), "text")
    right = dealt.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "share", "b", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = None
        for whole in batches:
            for batch in steps(whole, "text"):
                links = []
                for a, b, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets_of(texts_of(batch), k), strict=True):
                    if b is None:
                        base = s
                    else:
                        shared = len(np.intersect1d(base, s, assume_unique=True))
                        if shared * den >= num * (len(base) + len(s) - shared):
                            links.append((a, b))
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = left.unionByName(right).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return staged(rows.mapInArrow(check, "a long, b long"), "links")


def first_pairs(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node with the most complete node it meets most often: the set of which most groups are met elsewhere.

    Copies with edits of their own meet their original in all groups but the
    edited ones, while the original is met in all.
    """
    degree = met.groupBy("node").count().join(nodes, "node").select("node", (F.col("count") / F.col("n")).alias("met"))
    best = met.join(degree, "node").groupBy("place").agg(F.max(F.struct("met", "node"))["node"].alias("hub"))
    often = met.join(best, "place").where("node <> hub").groupBy("node", "hub").count()
    return often.groupBy("node").agg(F.max(F.struct("count", "hub"))["hub"].alias("a")).select("a", F.col("node").alias("b"))


def tree_links(met: DataFrame, labels: DataFrame, nodes: DataFrame, measured: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between nodes that meet and lie in different components so far, by way of R-trees over count vectors.

    Nodes that meet, also by way of others, are a cluster, so that every pair is
    looked at once and not at every place where it meets. A cluster is cut into bands of
    size, and a band into blocks of bounded length: each task builds the tree of
    one block and asks it for the partners of another block's points. First only the
    points travel, and tell which nodes have a partner within the bound; then
    the texts of those, and the partners are verified on the whole sets, but for pairs
    that a block's links have joined by then.
    """
    named = met.join(labels, "node", "left").select("place", "node", F.coalesce("root", "node").alias("label"))
    apart = named.groupBy("place").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("lead")).where("lo <> hi").select("place", "lead")
    rest = staged(named.join(apart, "place").select("lead", "node", "label").distinct(), "apart")
    clusters = components(rest.select(F.col("lead").alias("a"), F.col("node").alias("b")))
    # A partner is at most den / num times as large: of the same band or the next one.
    band = F.floor(F.log("n") / F.lit(log(den / num) * 1.000001)).cast("int")
    points = rest.select("node", "label").distinct().join(clusters, "node").join(nodes, "node")
    points = staged(points.select(F.col("root").alias("cluster"), band.alias("band"), "node", "label", "n", "rep"), "points")

    counts = measured.select(F.col("doc_id").alias("rep"), "node", "counts").join(points.select("node", "rep"), ["node", "rep"], "left_semi").dropDuplicates(["node"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, lambda batch: ((None, np.frombuffer(c, dtype="<u4")) for c in batch.column(batch.num_columns - 1).to_pylist()), num, den):
            if found := sorted(block.near()):
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["node"])

    dealt = _dealt(points, counts.select("node", "counts"))
    close = staged(dealt.mapInArrow(near, "node long").distinct(), "close")
    points = points.join(close, "node", "left_semi")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            return ((s, counts_of(s)) for part in steps(batch) for s in sets_of(texts_of(part), k))

        for block in _blocks(batches, sets, num, den):
            if links := block.links():
                yield _pairs(links)

    dealt = _dealt(points, texts_of_nodes(points.select("node"), docs, nodes, k))
    return staged(dealt.mapInArrow(search, "a long, b long"), "links")


_KEY = ["cluster", "band", "asker", "holder"]


def _dealt(points: DataFrame, payload: DataFrame) -> DataFrame:
    """Rows (cluster, band, asker, holder, role, node, label, payload), each block together: a row holds, asks or does both."""
    guests = points.withColumn("band", F.col("band") - 1)

    def size(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("cluster", "band").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST_SHINGLES))) / BLOCK_SHINGLES).alias(name))

    blocks = size(points, "askers").join(size(points.unionByName(guests), "holders"), ["cluster", "band"])

    def share(of: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(of))

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))

    columns = [*_KEY, "role", "node", "label"]
    one = (F.col("askers") == 1) & (F.col("holders") == 1)
    home = points.withColumn("home", F.lit(True)).unionByName(guests.withColumn("home", F.lit(False)))
    role = F.when(one & F.col("home"), HOLDS_AND_ASKS).otherwise(HOLDS)
    holding = home.join(blocks, ["cluster", "band"]).withColumns({"holder": share("holders"), "asker": every("askers"), "role": role}).select(*columns)
    asking = points.join(blocks.where(~one), ["cluster", "band"]).withColumns({"asker": share("askers"), "holder": every("holders"), "role": F.lit(ASKS)}).select(*columns)
    rows = holding.unionByName(asking).join(payload, "node").select(*columns, *[c for c in payload.columns if c != "node"])
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "role")


def _blocks(batches: Iterator[pa.RecordBatch], read, num: int, den: int) -> Iterator[Block]:
    """The blocks of sorted rows one after the other; ``read`` gives the set (or None) and the point of each row of a batch."""
    at, block = None, None
    for batch in batches:
        *keys, role, node, label = (batch.column(i).to_pylist() for i in range(len(_KEY) + 3))
        for key, does, x, y, (s, point) in zip(zip(*keys, strict=True), role, node, label, read(batch), strict=True):
            if key != at:
                if block:
                    yield block
                at, block = key, Block(num, den)
            block.add(does, x, y, s, point)
    if block:
        yield block


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class Block:
    """Points that are held and points that ask; of a pair the smaller one asks, of equally large ones the one of smaller identity."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.held: list[tuple[int, int, np.ndarray | None, np.ndarray]] = []
        self.asking: list[tuple[int, int, np.ndarray | None, np.ndarray]] = []
        self.up: dict[int, int] = {}

    def add(self, role: int, node: int, label: int, s: np.ndarray | None, point: np.ndarray) -> None:
        row = (node, label, s, point)
        if role != ASKS:
            self.held.append(row)
        if role != HOLDS:
            self.asking.append(row)

    def root(self, label: int) -> int:
        while (up := self.up.get(label, label)) != label:
            self.up[label] = self.up.get(up, up)
            label = up
        return label

    def pairs(self) -> Iterator[tuple[tuple, tuple]]:
        """Asking and held points of different components whose bound reaches the similarity."""
        if not self.held or not self.asking:
            return
        # Groups are ranges of hashes: a fine point folds to a coarse one where the block has both.
        groups = min(len(x[3]) for x in self.held + self.asking)
        tree = CountTree(np.array([h[3].reshape(groups, -1).sum(axis=1) for h in self.held]), self.num, self.den)
        for one in self.asking:
            n = one[3].sum()
            for j in tree.search(one[3].reshape(groups, -1).sum(axis=1)):
                other = self.held[j]
                if (n, one[0]) < (other[3].sum(), other[0]) and self.root(one[1]) != self.root(other[1]):
                    yield one, other

    def near(self) -> set[int]:
        return {x[0] for pair in self.pairs() for x in pair}

    def links(self) -> list[tuple[int, int]]:
        out = []
        for one, other in self.pairs():
            shared = len(np.intersect1d(one[2], other[2], assume_unique=True))
            if shared * self.den >= self.num * (len(one[2]) + len(other[2]) - shared):
                out.append((one[0], other[0]))
                self.up[self.root(other[1])] = self.root(one[1])
        return out


def similar_groups(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Two documents link when den * shared >= num * union of their k-word shingle
    sets; a text of fewer words is one shingle, a null or empty text has none and
    links with nothing. component_id is the smallest doc_id reachable by links.
    A row without doc_id gets its size and a null component and links with
    nothing. Rows that repeat a doc_id with other texts each keep their own size
    and component. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = staged(measure(docs, k), "sets")
    nodes = staged(measured.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "nodes")
    met = staged(meeting(docs.where("doc_id IS NOT NULL"), k, num, den), "met")
    first = staged(first_pairs(met, nodes), "first")
    links = verified(first, docs, nodes, k, num, den)
    labels = staged(components(links), "labels")
    more = tree_links(met, labels, nodes, measured, docs, k, num, den)
    if not more.isEmpty():
        labels = staged(components(links.unionByName(more)), "labels")
    rooted = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    out = measured.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))
