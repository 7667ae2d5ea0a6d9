"""Byte-level BPE in both directions, with a contiguous rank array per word.

A text is cut at special tokens and then into words as the tokenizer's byte-level
splitter does. A word is held as its part boundaries and the merge rank of every
two adjacent parts; the smallest rank (the leftmost of equal ones) is looked up,
the boundary between its parts is deleted and the ranks on either side are
refreshed, until no adjacent parts merge. Words longer than ``LONG`` bytes keep
their ranks in a heap instead, which does the same merges in the same order.

Ids travel as binary: unsigned 32-bit little endian, one after the other.
Null and empty texts have no ids; null ids decode to an empty text. Rows are
worked on one by one, so ties, repeated ids and null ids need no rule: every row
of the input gives one row. Columns other than those named are not returned.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline.llm.common import steps, texts_of

#: Bytes up to which a word's ranks are scanned as an array.
LONG = 256
#: Words that a worker process keeps, about, and the longest that is kept.
KEPT_WORDS, KEPT_LENGTH = 200_000, 64
#: Characters below this one stand in the splitting pattern themselves; others are replaced there by one of their kind.
PLAIN = 0x250
#: Words and ids that are worked on at once, so that a very long text needs no list of all its words.
AT_ONCE = 1 << 16
_NO_RANK = 1 << 62


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Kinds(dict):
    """Code point to a plain character of the kind that the tokenizer's splitter takes it for; each is probed once."""

    STANDS = {"letter": "é", "number": "0", "space": "\t", "other": "!"}

    def __init__(self, splitter):
        super().__init__()
        self.splitter = splitter

    def kind(self, char: str) -> str:
        """What ``a?1?!`` is cut into tells the kind of the character in the question marks' place."""
        if char == " ":
            return "space"
        spans = [span for _, span in self.splitter.pre_tokenize_str(f"a{char}1{char}!")]
        if spans[0] == (0, 2):
            return "letter"
        if spans[1] == (1, 4):
            return "number"
        return "other" if spans[-1] == (3, 5) else "space"

    def __missing__(self, point: int) -> str:
        char = chr(point)
        self[point] = char if point < PLAIN else self.STANDS[self.kind(char)]
        return self[point]


class Codec:
    """Encoder and decoder of one tokenizer file (byte-level BPE without normalizer, dropout or added prefix)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model, split = config["model"], config.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        if config.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{path} has a normalizer or model options that aren't supported")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        self.id = {as_bytes(token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        merges = (m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(as_bytes(a), as_bytes(b)): n for n, (a, b) in enumerate(merges)}
        self.bytes_of = {i: token for token, i in self.id.items()}
        special = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        if any(t[k] for t in config.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take in what is beside them")
        self.special = {t: np.uint32(i).tobytes() for t, i in special.items()}
        self.bytes_of.update({i: t.encode() for t, i in special.items()})
        longest_first = sorted(special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if special else lambda text: [text]
        self.kinds = Kinds(Tokenizer.from_file(path).pre_tokenizer)
        self.words = self._words()
        self.beyond = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]").search
        self.kept: dict[str, bytes] = {}

    def _words(self) -> re.Pattern:
        """The splitter's pattern over plain characters, whose kinds are the tokenizer's own."""
        of = {"letter": "", "number": "", "space": "", "other": ""}
        for point in range(PLAIN):
            of[self.kinds.kind(chr(point))] += re.escape(chr(point))
        letter, number, space = of["letter"], of["number"], of["space"]
        ends = "'s|'t|'re|'ve|'m|'ll|'d"
        return re.compile(f"{ends}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")

    def merged(self, word: bytes) -> list[int]:
        """Part boundaries that are left when no two adjacent parts merge any more."""
        bounds = list(range(len(word) + 1))
        rank = self.rank.get
        ranks = [rank((word[i : i + 1], word[i + 1 : i + 2]), _NO_RANK) for i in range(len(word) - 1)]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            i = ranks.index(least)
            del ranks[i], bounds[i + 1]
            if i < len(ranks):
                ranks[i] = rank((word[bounds[i] : bounds[i + 1]], word[bounds[i + 1] : bounds[i + 2]]), _NO_RANK)
            if i:
                ranks[i - 1] = rank((word[bounds[i - 1] : bounds[i]], word[bounds[i] : bounds[i + 1]]), _NO_RANK)
        return bounds

    def merged_long(self, word: bytes) -> list[int]:
        """The same for a long word: ranks wait in a heap, a part is known by where it starts."""
        n, rank = len(word), self.rank.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        ranks = [rank((word[i : i + 1], word[i + 1 : i + 2]), _NO_RANK) for i in range(n - 1)]
        heap = [(r, i) for i, r in enumerate(ranks) if r != _NO_RANK]
        heapq.heapify(heap)
        ranks.append(_NO_RANK)

        def refresh(i: int) -> None:
            j = after[i]
            ranks[i] = rank((word[i:j], word[j : after[j]]), _NO_RANK) if j < n else _NO_RANK
            if ranks[i] != _NO_RANK:
                heapq.heappush(heap, (ranks[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if ranks[i] != r:
                continue
            j = after[i]
            ranks[j] = _NO_RANK
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        bounds, i = [], 0
        while i < n:
            bounds.append(i)
            i = after[i]
        return [*bounds, n]

    def word(self, word: str) -> bytes:
        found = self.kept.get(word)
        if found is None:
            raw = word.encode()
            bounds = self.merged(raw) if len(raw) <= LONG else self.merged_long(raw)
            found = np.array([self.id[raw[a:b]] for a, b in zip(bounds, bounds[1:])], dtype="<u4").tobytes()
            if len(word) <= KEPT_LENGTH:
                if len(self.kept) >= KEPT_WORDS:
                    self.kept.clear()
                self.kept[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text; characters beyond the plain ones are cut at by their kinds."""
        out = []
        for part in self.cut(text):
            if part in self.special:
                out.append(self.special[part])
                continue
            if self.beyond(part):
                found = (part[m.start() : m.end()] for m in self.words.finditer(part.translate(self.kinds)))
            elif len(part) <= AT_ONCE:
                found = self.words.findall(part)
            else:
                found = (m.group() for m in self.words.finditer(part))
            found = iter(found)
            while some := list(islice(found, AT_ONCE)):
                kept = self.kept
                out.append(b"".join([kept.get(w) or self.word(w) for w in some]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that aren't UTF-8 become replacement characters, ids that aren't known are left out."""
        numbers, token, out = np.frombuffer(ids, dtype="<u4"), self.bytes_of, []
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in range(0, len(numbers), AT_ONCE):
            some = numbers[i : i + AT_ONCE].tolist()
            try:
                raw = b"".join([token[x] for x in some])
            except KeyError:
                raw = b"".join([token.get(x, b"") for x in some])
            out.append(decoder.decode(raw))
        return "".join([*out, decoder.decode(b"", True)])


_codecs: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """The worker process's codec of a tokenizer file."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ``ids`` (binary) of every row's whole text, without tokens that aren't in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path)
        for batch in chain.from_iterable(map(steps, batches)):
            ids = [codec.encode(t) for t in texts_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ``ids`` and the text they decode to, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path)
        for whole in batches:
            for batch in steps(whole, "ids"):
                texts = [codec.decode(x or b"") for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Encode, decode, and per row the number of ids and the SHA-256 of ids and of the decoded text."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    both = decode(encode(docs, tokenizer_path), tokenizer_path)
    return both.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
