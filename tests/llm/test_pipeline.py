import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from rinkline.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DATA = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stage = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token output"]

    spoken = staged(stage["language ID"](spark, docs, DATA), "t")
    assert spoken.columns == COLUMNS
    assert {r.doc_id for r in spoken.collect()} == {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}

    single = staged(stage["n-gram Jaccard join"](spark, spoken, DATA), "t")
    groups = brute.components({r.doc_id: r.text for r in spoken.collect()}, 5, 80, 100)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (n, c) in groups.items() if c == i or n == 0)

    clean = staged(stage["benchmark decontamination"](spark, single, DATA), "t")
    items = [set(brute.shingles(r.text, 5)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for r in single.collect():
        held = set(brute.shingles(r.text, 5))
        if any(i <= held for i in items):
            assert clean.where(F.col("doc_id") == r.doc_id).isEmpty()
        if not any(i & held for i in items):
            assert not clean.where(F.col("doc_id") == r.doc_id).isEmpty()

    mix = staged(stage["mixing sources"](spark, clean, DATA), "t")
    assert mix.columns == COLUMNS
    sizes, taken = {}, {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    for r in mix.collect():
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
    for s, want in brute.targets(sizes, 3).items():
        assert abs(taken.get(s, 0) - want) <= max(0.05 * want, 250)

    out = stage["token output"](spark, mix, DATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mix.collect())


def test_run_gives_what_the_stages_give(spark):
    one, two = P.run(spark, DATA), P.run(spark, DATA)
    assert one.count() > 0 and one.exceptAll(two).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_every_stage_stands_empty_and_null_rows(spark, stage):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    assert stage(spark, spark.createDataFrame([], schema), DATA).collect() == []
    rows = [(None, None, None, None, None), (1, "", None, None, None), (1, "words of text here now", None, "s", 1), (2, "long " * 30000, "en", "s", None)]
    stage(spark, spark.createDataFrame(rows, schema), DATA).collect()


def test_rows_without_id_and_rows_that_share_one_are_judged_by_themselves(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    text = " ".join(f"word{i}" for i in range(60))
    near, other = text.replace("word30", "changed"), " ".join(f"other{i}" for i in range(60))
    item = max((r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()), key=len)
    row = lambda i, t, source="s": (i, t, "en", source, 1)
    frame = lambda *rows: spark.createDataFrame(list(rows), schema).repartition(3)
    rows_of = lambda df: sorted(map(tuple, df.collect()), key=str)
    docs = frame(row(None, near), row(7, text), row(7, text), row(7, other), row(8, near), row(None, "a"), row(None, None), row(3, ""))
    assert rows_of(P.one_of_each_group(spark, docs, DATA)) == sorted([row(7, text), row(7, other), row(None, "a"), row(None, None), row(3, "")], key=str)
    docs = frame(row(None, near), row(None, near), row(None, text))
    assert len(P.one_of_each_group(spark, docs, DATA).collect()) == 1
    docs = frame(row(None, f"{other} {item} {other}"), row(9, item), row(9, other), row(None, other))
    assert rows_of(P.without_benchmark(spark, docs, DATA)) == sorted([row(9, other), row(None, other)], key=str)
