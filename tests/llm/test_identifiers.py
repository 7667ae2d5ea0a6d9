import re
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from rinkline.llm import identifiers as I

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PIECES = ["1", "4111 1111 1111 1111", "4111-1111-1111-1112", "@", "a.b", ".", "+1 (555) 123-4567", " ", "10.0.0.255", "300.1.1.1", "-", "x", "000", "é", "٣"]


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(alphabet="aZ.@-+ ()0123456789%_é\n", max_size=40), st.lists(st.sampled_from(PIECES), max_size=9).map("".join)))
def test_base_equals_plain_patterns(text):
    assert I.base_spans(text) == {k: [m.span() for m in re.finditer(p, text) if holds(k, m[0])] for k, p in PATTERNS.items()}


def test_very_long_texts_take_linear_time():
    for text in ("1" * 300000, "a" * 300000 + "@", "a@" * 100000, "+1 " * 60000, "1." * 100000, "0" * 5000 + ".1.1.1"):
        I.occurrences(text, I.base_spans(text))


def rows():
    known = [(i, f"some words here phone: +1 (555) 123-{4000 + i} and the rest of it") for i in range(6)]
    mails = [(60 + i, f"contact joe{i}@example.com please") for i in range(4)]
    return known + mails + [(50, "please ring phone: (555) 987-6543 now"), (51, "the order 555 987 6543 22 is here"), (52, "contact bob@localhost"), (53, "see bob@elsewhere"), (54, None), (None, ""), (55, "contact jane@example.com"), (55, "contact jane@example.com")]


def found(spark, table):
    df = spark.createDataFrame([(*r, "x") for r in table], "doc_id long, text string, spans string").repartition(3)
    return I.find(df).collect()


def test_contexts_discover_unseen_identifiers(spark):
    got = found(spark, rows())
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows())
    assert (by[50].spans, by[50].n_phone, by[50].n_added) == ("phone:19:33", 0, 1)
    assert (by[52].spans, by[52].n_email, by[52].n_added) == ("email:8:21", 0, 1)
    assert by[51].spans == by[53].spans == by[54].spans == by[None].spans == ""
    assert by[0].spans == "phone:23:40" and by[0].base_sha256 == sha256(b"phone:23:40").hexdigest()
    assert by[54].base_sha256 == sha256(b"").hexdigest()


def test_copies_do_not_make_a_pattern(spark):
    table = [(i, "ring phone: +1 (555) 123-4000 today") for i in range(30)] + [(99, "ring phone: (555) 987-6543 today")]
    assert {r.n_added for r in found(spark, table)} == {0}


def test_base_spans_stay_and_order_is_by_kind(spark):
    r = found(spark, [(1, "10.0.0.1 then a@b.cc then +49 (30) 1234567 and 4111 1111 1111 1111")])[0]
    assert r.spans == "email:14:20,ip:0:8,card:47:66,phone:26:42"
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)


def test_empty_table(spark):
    assert found(spark, []) == []
