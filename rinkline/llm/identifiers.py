"""Personal identifiers: exact base patterns, then bootstrapped extraction from their contexts.

The base finds emails, network addresses, card numbers and phone numbers by
fixed rules. Its finds are seeds: the words around them are lexical patterns,
and strings of a like shape that the base doesn't take (a phone number without
plus sign, a card number with a wrong digit, an address with "at") are
candidates. Patterns and instances form a graph that Spark scores in rounds: a
pattern is as good as the instances it extracts are known and as it is seldom
used elsewhere; a candidate is as good as the patterns that extract it.
Candidates of high score are added to the base's finds.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline.llm.common import staged, steps, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring, different seeds that a pattern needs, and scores from which patterns and candidates count.
ROUNDS, LEAST_SEEDS, PATTERN_SCORE, INSTANCE_SCORE = 3, 3, 0.5, 0.7

_ANY = re.compile("[0-9@]")
_LOCAL = re.compile("[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starts inside a run of digits can't match where the run's first digit doesn't: skipping them keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
#: Shapes of candidates: numbers of seven digits and more with marks between, and names at a host, also spelled out.
_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,3}[0-9]){6,18}(?![0-9])")
_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:@|[\x20]?[\[(]at[\])][\x20]?)[A-Za-z0-9-]{1,63}(?:(?:\.|[\x20]?[\[(]dot[\])][\x20]?)[A-Za-z0-9-]{1,63}){0,8}")
_WORD = re.compile("[^\x20\x09-\x0d]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; a name begins where its run before the sign does, so each sign is tried once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not _ANY.search(text):
        return found
    found["email"] = emails(text)
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found["phone"].append(m.span())
    return found


def written(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def instance_of(value: str) -> int:
    """Identity of an identifier: its letters, digits and signs, lower-cased."""
    plain = re.sub(r"[^a-z0-9@]", "", value.lower())
    return int.from_bytes(blake2b(plain.encode(), digest_size=8).digest(), "little", signed=True)


def occurrences(text: str, found: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """Seeds and candidates of a text with the patterns around them; a candidate overlaps no base span."""
    if not _ANY.search(text) and "(at)" not in text and "[at]" not in text:
        return []
    spans = [(a, b, k) for k in KINDS for a, b in found[k]]
    taken = sorted((a, b) for a, b, _ in spans)
    for shape, signs in ((_AT, ("@", "(at)", "[at]")), (_NUMBER, ("",))):
        new, i = [], 0
        for m in shape.finditer(text) if any(s in text for s in signs) else ():
            a, b = m.span()
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i == len(taken) or taken[i][0] >= b:
                new.append((a, b, "@" if shape is _AT else "#"))
        spans += new
        taken = sorted(taken + [(a, b) for a, b, _ in new])
    if not spans:
        return []
    words = [(*m.span(), m[0].lower()) for m in _WORD.finditer(text)]
    starts = [w[0] for w in words]
    uses = Counter(w[2] for w in words)
    uses.update(f"{x[2]} {y[2]}" for x, y in zip(words, words[1:], strict=False))
    out = []
    for a, b, kind in sorted(spans):
        before = bisect_right(starts, a) - 1
        if before >= 0 and words[before][0] < a < words[before][1]:
            # The identifier begins inside a word ("tel:555..."): the word's head is the context.
            head = text[words[before][0] : a].lower()
            left, inside = [head] if head else [], True
        else:
            before = bisect_left(starts, a)
            left, inside = [], False
        at = before - 1
        if inside:
            patterns = [{"pattern": f"head {left[0]}", "uses": 1}]
        else:
            patterns = []
            if at >= 0:
                patterns.append({"pattern": f"after {words[at][2]}", "uses": uses[words[at][2]]})
            if at >= 1:
                two = f"{words[at - 1][2]} {words[at][2]}"
                patterns.append({"pattern": f"after {two}", "uses": uses[two]})
        out.append({"start": a, "stop": b, "kind": kind, "instance": instance_of(text[a:b]), "patterns": patterns})
    return out


_OCCURRENCE = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("instance", pa.int64()), ("patterns", pa.list_(pa.struct([("pattern", pa.string()), ("uses", pa.int32())])))])
_BASE = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<struct<start:int,stop:int,kind:string,instance:long,patterns:array<struct<pattern:string,uses:int>>>>"


def base(docs: DataFrame) -> DataFrame:
    """Base counts, digest and spans of every row, with all seeds and candidates (``found``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                rows = []
                for text in texts_of(batch).to_pylist():
                    spans = base_spans(text)
                    text_spans = written([(k, a, b) for k in KINDS for a, b in spans[k]])
                    rows.append((*(len(spans[k]) for k in KINDS), sha256(text_spans.encode()).hexdigest(), text_spans, occurrences(text, spans)))
                cols = list(zip(*rows, strict=True))
                kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(_OCCURRENCE))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BASE)


def score_graph(edges: DataFrame, patterns: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns and candidates after some rounds.

    ``edges``: distinct (pattern, instance, kind), kind ``@`` or ``#`` for
    candidates; ``patterns``: (pattern, hits, uses). Each round is two
    aggregates over the edges, pre-aggregated before their shuffles; nothing of
    it is collected.
    """
    seed = {k: F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in KINDS}
    seeds = edges.where(F.col("kind").isin(*KINDS))
    candidates = edges.where(~F.col("kind").isin(*KINDS))
    by_seed = seeds.groupBy("pattern").agg(F.count("*").alias("seeds"), *[F.sum(seed[k]).alias(k) for k in KINDS])
    # Only patterns with enough different seeds can count; their candidates are the graph.
    good = staged(by_seed.where(F.col("seeds") >= LEAST_SEEDS).join(patterns, "pattern"), "seeded")
    graph = staged(candidates.join(good.select("pattern"), "pattern", "left_semi"), "graph")
    instances = None
    for _ in range(rounds):
        extra = graph if instances is None else graph.join(instances, ["instance", "kind"], "left")
        zero = F.lit(0.0)
        known = extra.groupBy("pattern").agg(F.count("*").alias("others"), *[F.sum(zero if instances is None else F.coalesce(f"score_{k}", zero)).alias(f"more_{k}") for k in KINDS])
        all_of = F.col("seeds") + F.coalesce("others", F.lit(0))
        scored = good.join(known, "pattern", "left").select(
            "pattern", "seeds", *[((F.col(k) + F.coalesce(f"more_{k}", zero)) / all_of * F.least(F.lit(1.0), F.col("hits") / F.col("uses"))).alias(k) for k in KINDS]
        )
        scored = scored.where(F.greatest(*KINDS) >= PATTERN_SCORE)
        # 1 - product of (1 - score) over the patterns that extract a candidate; a shape bars the kinds it can't be.
        fits = {k: F.col("kind") == ("@" if k == "email" else "#") for k in KINDS}
        miss = [F.exp(F.sum(F.when(fits[k], F.log1p(-F.least(F.col(k), F.lit(0.999999)))).otherwise(0.0))) for k in KINDS]
        instances = graph.join(scored, "pattern").groupBy("instance", "kind").agg(*[(1 - m).alias(f"score_{k}") for k, m in zip(KINDS, miss, strict=True)])
        instances = staged(instances, "instances")
    return scored, instances


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of ``docs`` (doc_id, text).

    The counts and the digest are those of the base; ``spans`` are all spans,
    the base's and the added ones. Null texts are empty. Rows without doc_id and
    repeated rows each give a row. Copies of a document add nothing to a
    pattern's support, which counts different identifiers. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = staged(base(docs).withColumn("row", F.monotonically_increasing_id()), "base")
    each = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("o")).select("row", "o.*")
    uses = each.select("row", "kind", "instance", F.explode("patterns").alias("p")).select("row", "kind", "instance", "p.pattern", "p.uses")
    edges = staged(uses.select("pattern", "instance", "kind").distinct(), "edges")
    # Uses are counted once per text and pattern, hits as often as there are identifiers.
    patterns = uses.groupBy("pattern", "row").agg(F.count("*").alias("hits"), F.max("uses").alias("uses")).groupBy("pattern").agg(F.sum("hits").alias("hits"), F.sum("uses").alias("uses"))
    _, scores = score_graph(edges, patterns)
    best = F.greatest(*[F.struct(F.col(f"score_{k}").alias("score"), F.lit(k).alias("as")) for k in KINDS])
    taken = scores.select("instance", "kind", best.alias("best")).where(F.col("best.score") >= INSTANCE_SCORE).select("instance", "kind", F.col("best.as").alias("as"))
    added = each.join(taken, ["instance", "kind"]).select("row", F.struct(F.col("as").alias("kind"), "start", "stop").alias("span"))
    # All spans of a row in kind order, then by start, as the base writes them.
    added = added.groupBy("row").agg(F.collect_list("span").alias("added"))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    parts = F.filter(F.split("base", ","), lambda s: s != "")
    base_keys = F.transform(parts, lambda s: F.struct(place[F.split(s, ":")[0]].alias("p"), F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("b"), s.alias("s")))
    more = F.transform(F.coalesce("added", F.expr("cast(array() as array<struct<kind:string,start:int,stop:int>>)")), lambda x: F.struct(place[x["kind"]].alias("p"), x["start"].alias("a"), x["stop"].alias("b"), F.concat_ws(":", x["kind"], x["start"], x["stop"]).alias("s")))
    out = rows.join(added, "row", "left")
    spans = F.array_join(F.transform(F.array_sort(F.concat(base_keys, more)), lambda x: x["s"]), ",")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))
