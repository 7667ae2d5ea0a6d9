"""Token-ID files: a shared zstandard dictionary, one frame per document, an offset index.

A store is a folder with

- ``dictionary/``  one row: the dictionary's bytes and their SHA-256 (Parquet);
- ``shards/``      binary files, one per task that had rows;
- ``manifest/``    one row per shard that counts (Parquet): its place in document
  order, file name, documents, tokens and the dictionary's hash.

A shard is ``RKTOK001``, the 32 bytes of the dictionary's hash, the frames one
after the other, the index (per document, 32 bytes little endian: doc_id,
offset of the frame, tokens before it in the shard, bytes of the frame, tokens)
and last the index's position and number of entries (16 bytes). Any document is
read with its index entry and one range of bytes. Ids are unsigned 16-bit where
the vocabulary allows, else 32-bit; the manifest says which.

A task writes to a name of its own attempt and reports it; only reported files
enter the manifest, so repeated or lost tasks leave no trace in it.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rinkline import session
from rinkline.llm.common import steps, texts_of

MAGIC = b"RKTOK001"
END_ID = 1
#: The dictionary is fitted on about so many texts of at most so many characters (it serves short documents).
SAMPLE_TEXTS, SAMPLE_CHARS = 2000, 4000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Words whose ids a worker process keeps, about.
KEPT_WORDS = 200_000
_WORD = re.compile("[^\x20\x09-\x0d]+")
_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("before", "<u8"), ("size", "<u4"), ("tokens", "<u4")])
MANIFEST = "first_key string, last_key string, file string, documents long, tokens long, width int, dictionary_sha256 string"


# The parts of a tokenizer whose words can be cut without the library (its BPE still encodes them).
_KNOWN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KNOWN_CHARS = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))]
_CUT = re.compile("[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^a-zß-öø-ÿ0-9\x20\x09-\x0d]+")


def _byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level BPE: printable ones for themselves, others from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Kept(dict):
    """Results of a function by word: those of late are kept, those not used since two times ``KEPT_WORDS`` others are not."""

    def __init__(self, fn):
        super().__init__()
        self.fn, self.old = fn, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.fn(word)
        self[word] = found
        return found

    def age(self) -> None:
        if len(self) > KEPT_WORDS:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Ids of whole texts by the tokenizers library; those of its words are kept.

    That needs a tokenizer that parts text at white space and leaves no trace of
    it (``by_word``); for others every text is encoded as it is. With the known
    normalizer and splitter, texts of ASCII and precomposed Latin letters are cut
    here and only their pieces go to the library's BPE model, which spares most
    of its overhead a call; words of other texts take the library's whole path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        config = json.loads(self.tokenizer.to_str())
        steps_ = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        bare = not (config.get("post_processor") or config.get("truncation") or config.get("padding"))
        splits = steps_[0].get("type") == "Split" and steps_[0].get("invert") and steps_[0].get("behavior") == "Removed"
        self.by_word = bool(bare and splits and self._parts_at_space())
        known = self.by_word and (config.get("normalizer") or {}).get("normalizers") == _KNOWN_NORMALIZER and steps_[0].get("pattern") == {"Regex": _KNOWN_SPLIT}
        known = known and steps_[1].get("type") == "ByteLevel" and not steps_[1].get("add_prefix_space") and not steps_[1].get("use_regex") and not config["model"].get("ignore_merges")
        firsts = {t["content"][:1] for t in config["added_tokens"]}
        chars = [re.escape(c) for c in _KNOWN_CHARS if c not in firsts]
        self.simple = re.compile(f"[\x20\x09-\x0d{''.join(chars)}]*").fullmatch if known else None
        self.model, self.bytes_as = self.tokenizer.model, _byte_chars()
        self.kept, self.pieces = Kept(self._word), Kept(self._piece)

    def _parts_at_space(self) -> bool:
        probe = "a \tb\n\x0b\x0c\rc 's 12 .,' it's"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        return whole == [i for w in _WORD.findall(probe) for i in self.tokenizer.encode(w, add_special_tokens=False).ids]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype=self.kind).tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join([self.bytes_as[b] for b in piece.encode()])
        return b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(mapped)])

    def _word(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Serialised ids of each text."""
        if not self.by_word:
            return [x for i in range(0, len(texts), 16) for x in self._ids(texts[i : i + 16])]
        self.kept.age()
        self.pieces.age()
        word, piece, simple = self.kept.__getitem__, self.pieces.__getitem__, self.simple or (lambda t: False)
        return [b"".join(map(piece, _CUT.findall(t.lower()))) if simple(t) else b"".join(map(word, _WORD.findall(t))) for t in texts]


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The worker process's encoder, which keeps its words from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _dictionary(docs: DataFrame, tokenizer_path: str) -> tuple[bytes, str]:
    """Dictionary fitted on a bounded, seeded sample of short texts, and its SHA-256; empty if there are too few."""
    short = docs.where((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS)).select("text")
    total = short.count()
    share = min(1.0, SAMPLE_TEXTS / max(total, 1))
    cut = int(share * (1 << 32))
    picked = short.where(F.pmod(F.xxhash64("text"), F.lit(1 << 32)) < cut)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, samples = encoder_of(tokenizer_path), []
        for batch in batches:
            samples += encoder.encode(texts_of(batch).to_pylist())
        try:
            found = zstandard.train_dictionary(DICTIONARY_BYTES, sorted(samples)).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few or too small samples
            found = b""
        yield pa.RecordBatch.from_pydict({"bytes": pa.array([found], pa.binary())})

    rows = picked.repartition(1).mapInArrow(fit, "bytes binary").collect()
    data = bytes(rows[0][0]) if rows else b""
    return data, hashlib.sha256(data).hexdigest()


def _compressor(data: bytes, cls, **options):
    return cls(dict_data=zstandard.ZstdCompressionDict(data), **options) if data else cls(**options)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write a store at ``path`` in ascending doc_id order.

    Null texts are empty documents (only the end id). Rows without doc_id come
    first and are stored under the smallest 64-bit number; equal ids are ordered
    by text. Other columns are ignored. An empty table gives a store without shards.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    data, digest = _dictionary(docs, tokenizer_path)
    rows = spark.createDataFrame([(bytearray(data), digest)], "bytes binary, sha256 string")
    rows.coalesce(1).write.parquet(f"{path}/dictionary")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = out = None
        entries, at, before = [], 0, 0
        keys = [0, 0]
        for whole in batches:
            for batch in steps(whole):
                if out is None:
                    encoder = encoder_of(tokenizer_path)
                    squeeze = _compressor(data, zstandard.ZstdCompressor, level=LEVEL)
                    store, folder = fs.FileSystem.from_uri(f"{path}/shards") if "://" in path else (fs.LocalFileSystem(), f"{path.removeprefix('file:')}/shards")
                    store.create_dir(folder, recursive=True)
                    name = f"{uuid.uuid4().hex}.tok"
                    out = store.open_output_stream(f"{folder}/{name}")
                    out.write(MAGIC + bytes.fromhex(digest))
                    at = len(MAGIC) + 32
                ids = batch.column(0).to_pylist()
                end = np.asarray([end_id], dtype=encoder.kind).tobytes()
                for doc_id, one in zip(ids, encoder.encode(batch.column(1).to_pylist()), strict=True):
                    one += end
                    doc_id = -(1 << 63) if doc_id is None else doc_id
                    frame, tokens = squeeze.compress(one), len(one) // encoder.width
                    keys = [keys[0] if entries else doc_id, doc_id]
                    entries.append((doc_id, at, before, len(frame), tokens))
                    out.write(frame)
                    at += len(frame)
                    before += tokens
        if out is not None:
            out.write(np.array(entries, dtype=_ENTRY).tobytes())
            out.write(struct.pack("<QQ", at, len(entries)))
            out.close()
            yield pa.RecordBatch.from_pydict({"lo": [keys[0]], "hi": [keys[1]], "file": [name], "documents": [len(entries)], "tokens": [before], "width": pa.array([encoder.width], pa.int32())})

    # Texts are dealt by range before they are encoded: the sampling pass of the range partitioner reads, but doesn't encode.
    dealt = docs.repartitionByRange("doc_id", F.length("text"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.length("text"), F.xxhash64("text"))
    shards = dealt.mapInArrow(put, "lo long, hi long, file string, documents long, tokens long, width int")
    shards.withColumn("part", F.spark_partition_id()).withColumn("sha256", F.lit(digest)).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Shards in document order, each with the tokens before it (one small row per shard)."""
    rows = spark.read.parquet(f"{path}/manifest")
    return rows.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def dictionary(spark: SparkSession, path: str) -> tuple[bytes, str]:
    """The store's dictionary (at most ``DICTIONARY_BYTES``) after its hash is checked."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["bytes"])
    if hashlib.sha256(data).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary doesn't match its hash")
    return data, row["sha256"]


class Shard:
    """One shard opened for reading; ``ids(i)`` decompresses only that document."""

    def __init__(self, path: str, data: bytes, digest: str, width: int):
        store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        self.file = store.open_input_file(name)
        size = self.file.size()
        if self.file.read_at(8, 0) != MAGIC or self.file.read_at(32, 8).hex() != digest:
            raise ValueError(f"{name} isn't a shard made with this dictionary")
        at, n = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        self.index = np.frombuffer(self.file.read_at(n * _ENTRY.itemsize, at), dtype=_ENTRY)
        self.kind = f"<u{width}"
        self.open = _compressor(data, zstandard.ZstdDecompressor)

    def ids(self, i: int) -> np.ndarray:
        entry = self.index[i]
        frame = self.file.read_at(int(entry["size"]), int(entry["offset"]))
        return np.frombuffer(self.open.decompress(frame), dtype=self.kind).astype("<u4")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a store: doc_id, start, n_tokens, ids_crc32, stored bytes and, if asked for, the ids."""
    data, digest = dictionary(spark, path)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["sha256"] != digest:
                    raise ValueError("a shard names another dictionary")
                shard = Shard(f"{path}/shards/{row['file']}", data, digest, row["width"])
                for lo in range(0, len(shard.index), 512):
                    part = shard.index[lo : lo + 512]
                    ids = [shard.ids(i) for i in range(lo, lo + len(part))]
                    out = {
                        "doc_id": pa.array([None if d == -(1 << 63) else int(d) for d in part["doc_id"]], pa.int64()),
                        "start": pa.array(part["before"].astype(np.int64) + row["base"]),
                        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        "stored_bytes": pa.array(part["size"].astype(np.int64)),
                    }
                    if with_ids:
                        out["ids"] = pa.array(ids, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, stored_bytes long" + ", ids array<long>" * with_ids
    # A row per shard: each is opened by a task of its own.
    shards = manifest(spark, path)
    n = max(1, min(spark.read.parquet(f"{path}/manifest").count(), 10_000))
    return shards.repartition(n, "part").mapInArrow(get, schema)


def token_files(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and return what its files hold, one row per document."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    spark = session.on_one_machine(docs.sparkSession)
    path = session.new_path(spark, "tokens")
    write(docs, path, tokenizer_path)
    return read(spark, path)
