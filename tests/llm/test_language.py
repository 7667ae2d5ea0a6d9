import random

import numpy as np
from pyspark.sql import functions as F

from rinkline.llm.language import FEATURES, codewords, decode, fit_bits, identify, ngram_counts, train

SYLLABLES = {"aa": ["ka", "lo", "mi", "tur"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["ção", "nha", "que", "os"], "dd": ["zh", "xi", "ang", "ou"], "ee": ["th", "ing", "ed", "ly"]}


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang))
    return out


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(texts(600, 1), "doc_id long, text string, lang string")
    model = train(df.where("doc_id % 4 <> 2"))
    got = identify(df.where("doc_id % 4 = 2"), model).collect()
    assert model.languages == sorted(SYLLABLES)
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_rows_and_clashing_columns(spark):
    model = train(spark.createDataFrame(texts(200, 2), "doc_id long, text string, lang string"))
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !? \n", "x"), (4, "schungein", "x"), (4, "schungein", "x"), (None, "kalomitur " * 20000, "x")]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert len(got) == 6 and got[0].__fields__ == ["doc_id", "text", "lang_pred", "score", "ambiguous"]
    found = sorted((str(r.doc_id), r.lang_pred, r.ambiguous) for r in got)
    assert [x[1] for x in found] == ["und", "und", "und", "bb", "bb", "aa"]
    assert all(r.score == 0.0 and r.ambiguous for r in got if r.lang_pred == "und")


def test_nothing_learned_and_empty_tables(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    model = train(empty)
    got = identify(spark.createDataFrame([(1, "words")], "doc_id long, text string"), model).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)
    assert identify(empty, model).collect() == []
    assert train(spark.createDataFrame([("a", None), (None, "x")], "text string, lang string")).languages == []


def test_prediction_reads_only_the_text(spark):
    df = spark.createDataFrame(texts(120, 3), "doc_id long, text string, lang string")
    model = train(df)
    one = {r.text: r.lang_pred for r in identify(df, model).collect()}
    two = identify(df.withColumn("lang", F.lit("zz")).withColumn("doc_id", -F.col("doc_id")), model).collect()
    assert all(one[r.text] == r.lang_pred for r in two)


def test_codewords_are_apart_and_wrong_bits_are_corrected():
    for k in (2, 3, 4, 7, 12, 40):
        code = codewords(k)
        apart = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        assert apart >= (1 if k == 2 else 2)
    counts = np.zeros(FEATURES, int)
    counts[0] = 1
    model = fit_bits(__import__("pandas").DataFrame({"lang": ["a", "b", "c", "d"], "slot": [1, 2, 3, 4], "n": [1.0] * 4}))
    weights = model.weights.copy()
    weights[0] = model.codes[2] * 3
    weights[0, 0] *= -0.2  # one classifier is wrong, but unsure
    assert decode(model._replace(weights=weights), counts)[0] == "c"


def test_ambiguity_and_case_and_spacing():
    model = fit_bits(__import__("pandas").DataFrame({"lang": ["a", "b"], "slot": [1, 2], "n": [1.0, 1.0]}))
    counts = np.zeros(FEATURES, int)
    counts[[1, 2]] = 1
    assert decode(model, counts)[2] and decode(model, counts)[0] == "a"
    assert (ngram_counts("Ab,  CD9e") == ngram_counts("ab cd e")).all()
    assert ngram_counts("12 34") is None
