"""Language identification with error-correcting output codes.

Every learned language has a codeword of bits; for every bit one linear
classifier over hashed character n-grams (one to three letters) says whether
the text's language has that bit set. Decoding weighs each bit by how sure its
classifier is and takes the codeword with the least loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline.llm.common import steps, texts_of
from rinkline.llm.words import mix

#: Hashed n-grams.
FEATURES = 1 << 14
#: Labelled texts per language that the classifiers are fitted on, about (a seeded share of each language).
FIT_TEXTS = 2000
#: More labels than this are refused: the model sent to every task grows with them.
MOST_LANGUAGES = 256
#: Two codewords closer than this share of the bits' total loss are ambiguous.
MARGIN = 0.02
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # FEATURES x bits: log odds of an n-gram for the bit


def _letters() -> np.ndarray:
    """For every code point, its value if it is a letter, else 32."""
    if not _LETTER:
        table = np.full(0x110000, 32, dtype=np.uint32)
        points = [c for c in range(0x110000) if chr(c).isalpha()]
        table[points] = points
        _LETTER.append(table)
    return _LETTER[0]


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of the whole text's hashed n-grams, lower-cased, other than letters as one space; None without a letter."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    letter = points != 32
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate(([32], points[keep], [32])).astype(np.uint64)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = two[:-1] << np.uint64(21) | c[2:]
    grams = np.concatenate((c, two | np.uint64(1 << 63), three))
    # One multiplication spreads 63 bits over the top ones; hashing needs no more here.
    slots = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)
    return np.bincount(slots.astype(np.int64), minlength=FEATURES)


def codewords(k: int) -> np.ndarray:
    """+1/-1 codewords of ``k`` languages.

    Up to seven languages: the exhaustive code (every split in two, 2**(k-1)-1
    bits, any two rows differ in 2**(k-2)). Beyond: seeded random splits, of
    those drawn the ones that keep rows furthest apart.
    """
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        bits = np.arange(1, 1 << (k - 1))
        return np.array([[1 if r == 0 or not (b >> (r - 1)) & 1 else -1 for b in bits] for r in range(k)], dtype=float)
    length = int(np.ceil(10 * np.log2(k)))
    draw = np.random.default_rng(7)
    best, apart = None, -1
    for _ in range(50):
        code = draw.choice([-1.0, 1.0], size=(k, length))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        distances = (code.shape[1] - code @ code.T) / 2 + np.eye(k) * code.shape[1]
        if distances.min() > apart:
            best, apart = code, distances.min()
    return best


def train(labelled: DataFrame, fit_texts: int = FIT_TEXTS) -> Model:
    """Fit on rows (text, lang) with a language; about ``fit_texts`` texts of each language, chosen by a hash of the text.

    Only n-gram counts by language leave the tasks (``FEATURES`` numbers a language).
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], np.ones((0, 1)), np.zeros((FEATURES, 1)))
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, fit_texts / n) * (1 << 32))])
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 32)) < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = ngram_counts(text)
                if found is not None:
                    # Each text weighs alike, however long.
                    totals[lang] = totals.get(lang, 0) + found / found.sum()
        for lang, found in totals.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "slot": pa.array(at, pa.int32()), "n": found[at]})

    counts = picked.mapInArrow(count, "lang string, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    return fit_bits(counts)


def fit_bits(counts: pd.DataFrame) -> Model:
    """One log-odds classifier per codeword bit from n-gram counts by language (lang, slot, n)."""
    languages = sorted(counts["lang"].unique())
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((FEATURES, 1)))
    table = np.zeros((len(languages), FEATURES))
    table[[languages.index(x) for x in counts["lang"]], counts["slot"]] = counts["n"]
    table /= table.sum(axis=1, keepdims=True)
    codes = codewords(len(languages))
    smooth = 1e-5
    weights = np.zeros((FEATURES, codes.shape[1]))
    for b in range(codes.shape[1]):
        on, off = table[codes[:, b] > 0], table[codes[:, b] < 0]
        if len(on) and len(off):
            weights[:, b] = np.log(on.mean(axis=0) + smooth) - np.log(off.mean(axis=0) + smooth)
    return Model(languages, codes, weights)


def decode(model: Model, counts: np.ndarray) -> tuple[str, float, bool]:
    """Language, score (0 to 1) and ambiguity of one text's n-gram counts.

    A classifier's output is the mean log odds over the text's n-grams; a
    codeword's loss sums ``log(1 + exp(-2 * bit * output))`` over the bits, so
    unsure bits weigh little. The score is the softmax of the negative losses.
    Equal losses go to the language first by name.
    """
    if not model.languages:
        return UNKNOWN, 0.0, True
    outputs = counts @ model.weights / counts.sum()
    losses = np.logaddexp(0, -2 * model.codes * outputs).sum(axis=1)
    order = np.argsort(losses, kind="stable")
    best = order[0]
    chance = np.exp(losses[best] - losses)
    close = len(order) > 1 and losses[order[1]] - losses[best] < MARGIN * model.codes.shape[1]
    return model.languages[best], float(1 / chance.sum()), bool(close)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``, from the whole ``text`` alone.

    Null texts and texts without a letter are ``und`` with score 0 and are
    ambiguous; so is every text if no language was learned. Columns of the same
    names are replaced; all others, repeated rows included, stay as they are.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                found = []
                for text in texts_of(batch).to_pylist():
                    counts = ngram_counts(text)
                    found.append((UNKNOWN, 0.0, True) if counts is None else decode(model, counts))
                arrays = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*kept, "lang_pred", "score", "ambiguous"])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(predict, schema)
