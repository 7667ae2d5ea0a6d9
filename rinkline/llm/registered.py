"""The corpus queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rinkline.llm import bpe, collocations, decontaminate, fixity, identifiers, jaccard_join, language, licences, mixing, neighbours, passages, token_files, vector_codes
from rinkline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op1_collinear_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of at least 50 words that documents share, found by chains of seeds."""
    return passages.repeated_passages(table(spark, folder, "documents").select("doc_id", "text"))


#: The second replica of the pages: a flipped first byte in some bodies, some archives cut off at the end.
_HURT = "page_id % 61 = 5"
_CUT = "page_id % 1000 >= 990 AND page_id % 7000 < 1000"
_RECORD_SQL = (
    "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)"
    " || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10)"
    " || body || chr(13) || chr(10) || chr(13) || chr(10)"
)
_LEAVES_SQL = (
    "SELECT archive, page_id, sha256(rec) digest, strlen(rec) length,"
    " CAST(coalesce(sum(strlen(rec)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\""
)


@query(
    f"""WITH one AS ({_LEAVES_SQL} FROM (SELECT page_id, page_id // 1000 AS archive, {_RECORD_SQL} AS rec
          FROM (SELECT *, coalesce(html, '') AS body FROM pages))),
    two AS ({_LEAVES_SQL} FROM (SELECT page_id, page_id // 1000 AS archive, {_RECORD_SQL} AS rec
          FROM (SELECT *, CASE WHEN {_HURT} AND length(html) > 0 THEN '#' || substr(html, 2) ELSE coalesce(html, '') END AS body
                FROM pages WHERE NOT ({_CUT}))))
    SELECT archive, page_id, CASE WHEN two.page_id IS NULL THEN 'missing' WHEN one.digest <> two.digest THEN 'changed' ELSE 'moved' END AS status,
           one."offset" AS "offset", one.length AS length, one.digest AS digest, two."offset" AS other_offset, two.digest AS other_digest
    FROM one LEFT JOIN two USING (archive, page_id)
    WHERE two.page_id IS NULL OR one.digest <> two.digest OR one."offset" <> two."offset" """
)
def op2_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all pages on which a replica with flipped bytes and cut-off archives differs from the first."""
    pages = table(spark, folder, "pages").withColumn("archive", F.expr("page_id div 1000"))
    hurt = F.when(F.expr(_HURT) & (F.length("html") > 0), F.concat(F.lit("#"), F.expr("substr(html, 2)"))).otherwise(F.col("html"))
    record = [F.col("archive"), F.col("page_id").alias("record_id")]
    one = pages.select(*record, fixity.response_record(F.col("url"), F.col("page_id"), F.col("html")).alias("record"))
    two = pages.where(~F.expr(_CUT)).select(*record, fixity.response_record(F.col("url"), F.col("page_id"), hurt).alias("record"))
    return fixity.audit(fixity.leaves(one), fixity.leaves(two)).withColumnRenamed("record_id", "page_id")


@query()
def op3_simhash_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items, with the most similar window of each."""
    return decontaminate.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


@query()
def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes (weights 5, 2, 1 in turn, three epochs at most)."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs, mixing.repeating_weights).select("doc_id", "size", "source_size", "target", "taken", "repetitions")


@query()
def op5_bootstrapped_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Personal identifiers of every document: the base's counts and digest, and all spans with those learned from contexts."""
    return identifiers.find(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op6_count_vector_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's number of 4-word shingles and its component of links at 85 percent."""
    return jaccard_join.similar_groups(table(spark, folder, "documents").select("doc_id", "text"), k=4, num=85, den=100)


@query()
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written as dictionary-compressed files and read back from them."""
    return token_files.token_files(table(spark, folder, "documents"))


def _licence_sql() -> str:
    known = ", ".join(f"('{words}', '{name}')" for name, words in licences.SENTENCES.items())
    rules = ", ".join(f"('{licence}', ' {' .* '.join(order)} ')" for licence, order in licences.RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH known(words, name) AS (VALUES {known}), rules(licence, pattern) AS (VALUES {rules}),
    parts AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(coalesce(text, ''), '{licences.BREAK}') AS p FROM documents),
    cut AS (SELECT r, doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM parts),
    named AS (SELECT r, i, name FROM cut JOIN known ON words = trim(regexp_replace(translate(s, '{upper}', '{lower}'), '[^a-z0-9]+', ' ', 'g')) WHERE length(s) > 0),
    lines AS (SELECT r, string_agg(name, ' ' ORDER BY i) AS ids FROM named GROUP BY r),
    spread AS (SELECT r, ids, ' ' || replace(ids, ' ', '  ') || ' ' AS line FROM lines),
    hits AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM spread, rules WHERE regexp_matches(line, replace(pattern, ' .* ', ' .* ')) GROUP BY r)
    SELECT doc_id, ids AS sentence_ids, coalesce(licences, '') AS licences FROM parts JOIN lines USING (r) LEFT JOIN hits USING (r)"""


@query(_licence_sql())
def op8_licence_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with known licence sentences: their identifiers in order and the licences whose rules match."""
    found = licences.scan(table(spark, folder, "documents").select("doc_id", "text")).where(F.size("sentence_ids") > 0)
    return found.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


@query()
def op9_language_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from the documents that aren't held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.train(docs.where(~held_out).select("text", "lang"))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query()
def op10_hilbert_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest other vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query()
def op11_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE ids of every document and what they decode to, as digests."""
    return bpe.digests(table(spark, folder, "documents").select("doc_id", "text"))


def _phrase_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    c = collocations
    return f"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
    pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
    cut AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
    totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM cut GROUP BY lang),
    sizes AS (SELECT unnest(range(1, {c.LONGEST + 1})) AS k),
    grams AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM cut, sizes),
    f AS MATERIALIZED (SELECT lang, k, ws[i : i + k - 1] AS words, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {c.LEAST}),
    cuts AS (SELECT lang, words, a, unnest(range(1, k)) AS split FROM f WHERE k > 1),
    valued AS (SELECT c.*, l.a AS l, r.a AS r, CAST(2000000 * c.a::HUGEINT // (l.a + r.a) AS BIGINT) AS score
               FROM cuts c JOIN f l ON l.lang = c.lang AND l.words = c.words[1 : split] JOIN f r ON r.lang = c.lang AND r.words = c.words[split + 1 :]),
    lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, split) = 1),
    inner_ AS (SELECT lang, words, a, k, unnest(range(2, k)) AS s FROM f WHERE k > 2),
    inside AS (SELECT lang, words, a, s, unnest(range(1, k - s + 2)) AS i FROM inner_),
    held AS (SELECT lang, words[i : i + s - 1] AS words, max(a) AS longer FROM inside GROUP BY ALL),
    kept AS (SELECT lowest.*, array_to_string(words, ' ') AS phrase FROM lowest LEFT JOIN held USING (lang, words)
             WHERE longer IS NULL OR {c.DEN} * longer::HUGEINT < {c.NUM} * a::HUGEINT)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= {c.TOP}"""


@query(_phrase_sql())
def op12_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 phrases of each language that stand out most, with their exact counts."""
    return collocations.mine(table(spark, folder, "documents"))


def _codes_sql() -> str:
    v = vector_codes
    steps = []
    for i in range(v.ROUNDS + 1):
        near = f"""near{i} AS MATERIALIZED (SELECT rn, p, min(CAST(xx - 2 * list_inner_product(x, y) + list_inner_product(y, y) AS BIGINT) * {v.ENTRIES} + e) AS m
            FROM parts JOIN book{i} USING (p) GROUP BY rn, p)"""
        sums = f"""sums{i} AS (SELECT p, m % {v.ENTRIES} AS e, pos, CAST(sum(x[pos]) AS BIGINT) AS s, count(*) AS c
            FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS pos FROM near{i} JOIN parts USING (rn, p)) GROUP BY ALL)"""
        book = f"""book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(z, y) AS y FROM book{i} LEFT JOIN
            (SELECT p, e, list(CAST((s - (s % c + c) % c) // c AS DOUBLE) ORDER BY pos) AS z FROM sums{i} GROUP BY p, e) USING (p, e))"""
        steps += [near] if i == v.ROUNDS else [near, sums, book]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id, label, list_transform(embedding, lambda x: floor({v.SCALE} * x::DOUBLE)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT rn, p, x, list_inner_product(x, x) AS xx FROM
        (SELECT rn, p, v[p * (len(v) // {v.PARTS}) + 1 : (p + 1) * (len(v) // {v.PARTS})] AS x FROM kept, (SELECT unnest(range({v.PARTS})) AS p))),
    book0 AS (SELECT p, rn - 1 AS e, x AS y FROM parts WHERE rn <= {v.ENTRIES}),
    {", ".join(steps)},
    coded AS (SELECT rn, string_agg(printf('%02x', m % {v.ENTRIES}), '' ORDER BY p) AS code, CAST(sum(m // {v.ENTRIES}) AS BIGINT) AS error FROM near{v.ROUNDS} GROUP BY rn),
    digest AS (SELECT sha256(string_agg(array_to_string(y::BIGINT[], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{v.ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rn), digest"""


@query(_codes_sql())
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's code of four bytes, its squared error and the error of its label."""
    coded = vector_codes.encode(table(spark, folder, "embeddings"))
    return vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Language ID, near-copy removal, decontamination, mixing and token files over all documents."""
    return corpus_pipeline.run(spark, folder)
