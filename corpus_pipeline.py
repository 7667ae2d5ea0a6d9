"""From raw documents to token files: five stages, each one operator of ``rinkline.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept; its result is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline.llm import decontaminate, jaccard_join, language, mixing, token_files
from rinkline.llm.common import staged, table

#: SQL can't express the language model, the shingle hashing or the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def with_rows(docs: DataFrame) -> DataFrame:
    """Documents with ``_row``, a number of its own for each row, stored: decisions go by it, since ids may be null or repeat."""
    return staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def as_documents(rows: DataFrame) -> DataFrame:
    """The rows' numbers as ids, and their texts: what the operators are asked about."""
    return rows.select(F.col("_row").alias("doc_id"), "text")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the codes tell clearly; texts without a letter and ambiguous ones go.

    The classifiers learn from the labelled documents; a missing label is filled
    with the prediction. If no document is labelled, only texts without a letter go.
    """
    model = language.train(docs)
    found = language.identify(docs, model)
    if model.languages:
        kept = found.where(~F.col("ambiguous")).withColumn("lang", F.coalesce("lang", "lang_pred"))
    else:
        kept = found.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return kept.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (five words, 80 percent), that of smallest id, no id last; texts without words stay.

    Of rows that repeat a document whole one stays. An id may stand on several texts: each is judged by itself.
    """
    rows = with_rows(docs)
    groups = jaccard_join.similar_groups(as_documents(rows), k=5, num=80, den=100)
    others = staged(groups.where("component_id <> doc_id").select(F.col("component_id").alias("group"), F.col("doc_id").alias("_row")), "others")
    members = others.unionByName(others.select("group", F.col("group").alias("_row")).distinct()).join(rows.select("_row", "doc_id"), "_row")
    kept = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"].alias("_row"))
    dropped = staged(members.select("_row").join(kept.select("_row"), "_row", "left_anti"), "dropped")
    return rows.join(dropped, "_row", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, judged row by row."""
    rows = with_rows(docs)
    found = decontaminate.contamination(as_documents(rows), table(spark, sf_dir, "benchmark"))
    dropped = staged(found.select(F.col("doc_id").alias("_row")).distinct(), "dropped")
    return rows.join(dropped, "_row", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's repetitions say, so not at all, once or more."""
    found = mixing.mix_sources(docs, mixing.repeating_weights).where("repetitions > 0")
    return found.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("repetitions"))).alias("_copy")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, as read back: a row for each document and repetition."""
    return token_files.token_files(docs)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("token output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = staged(docs, f"stage-{n + 1}")
    return docs
