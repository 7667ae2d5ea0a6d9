from pyspark.sql import functions as F

from rinkline.llm import fixity

SCHEMA = "archive long, record_id long, record binary"


def rows(n=300, archives=3):
    return [(i // (n // archives), i, f"record {i} ".encode() * (i % 5 + 1)) for i in range(n)]


def audit(spark, one, two):
    out = fixity.audit(*(fixity.leaves(spark.createDataFrame(x, SCHEMA).repartition(3)) for x in (one, two)))
    return sorted(((r.archive, r.record_id, r.status, r.offset, r.other_offset) for r in out.collect()), key=str)


def test_equal_replicas(spark):
    assert audit(spark, rows(), rows()[::-1]) == []


def test_changed_record_is_located(spark):
    two = [(a, i, b"X" + r[1:] if i == 157 else r) for a, i, r in rows()]
    offset = sum(len(r) for a, i, r in rows() if a == 1 and i < 157)
    assert audit(spark, rows(), two) == [(1, 157, "changed", offset, offset)]


def test_cut_off_and_extra_records_and_archives(spark):
    one, two = rows(), [r for r in rows() if r[1] < 298] + [(7, 900, b"more")]
    got = audit(spark, one, two)
    assert [(g[0], g[1], g[2]) for g in got] == [(2, 298, "missing"), (2, 299, "missing"), (7, 900, "extra")]


def test_lost_record_moves_those_after_it(spark):
    got = audit(spark, rows(), [r for r in rows() if r[1] != 195])
    assert [(g[1], g[2]) for g in got] == [(195, "missing")] + [(i, "moved") for i in range(196, 200)]


def test_nulls_repeats_empties(spark):
    one = [(None, None, None), (None, 1, b""), (0, 5, b"a"), (0, 5, b"a"), (0, 5, b"b")]
    assert audit(spark, one, one[::-1]) == []
    got = audit(spark, one, [(None, None, b"x"), (None, 1, b""), (0, 5, b"a"), (0, 5, b"b")])
    assert {(g[0], g[1], g[2]) for g in got} >= {(None, None, "changed"), (0, 5, "missing")}
    assert audit(spark, [], []) == []
    assert [g[2] for g in audit(spark, [], [(0, 1, b"a")])] == ["extra"]


def test_long_archives_have_several_tops(spark):
    one = [(0, i, str(i).encode()) for i in range(5000)]
    two = [(a, i, b"?" if i in (3, 4999) else r) for a, i, r in one]
    two = [(a, i, r.ljust(len(str(i)), b"?")) for a, i, r in two]
    assert [(g[1], g[2]) for g in audit(spark, one, two)] == [(3, "changed"), (4999, "changed")]


def test_nodes_cover_ranges_of_offsets(spark):
    nodes = fixity.tree(fixity.leaves(spark.createDataFrame(rows(), SCHEMA)))
    top = nodes.where(f"level = {fixity.LEVELS}").orderBy("archive").collect()
    assert [(t.archive, t.start, t.stop) for t in top] == [(a, 0, sum(len(r) for b, _, r in rows() if a == b)) for a in range(3)]
    assert nodes.where("level = 1").count() == 3 * 7


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumns({"place": F.lit("x"), "digest": F.lit("y"), "offset": F.lit(0), "parent": F.lit(1)})
    assert fixity.audit(fixity.leaves(df), fixity.leaves(df)).collect() == []


def test_record_bytes(spark):
    df = spark.createDataFrame([("http://é", 7, "<p>ä</p>"), (None, None, None)], "url string, page_id long, html string")
    got = [bytes(r[0]).decode() for r in df.select(fixity.response_record(F.col("url"), F.col("page_id"), F.col("html"))).collect()]
    assert got[0] == "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Target-URI: http://é\r\nContent-Length: 9\r\n\r\n<p>ä</p>\r\n\r\n"
    assert got[1].endswith("Content-Length: 0\r\n\r\n\r\n\r\n")
