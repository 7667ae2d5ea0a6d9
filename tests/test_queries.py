"""Every registered query against its DuckDB twin on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
#: Queries whose result SQL can't give: boosted trees are tested on a small fixture instead.
WITHOUT_TWIN = {"trained_model_metrics", "scored_predictions"}
LIBRARY = {n: q for n, q in entry.queries().items() if not getattr(q, "__module__", "").startswith("rinkline.llm")}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(LIBRARY) - set(entry.oracle_sql()) == WITHOUT_TWIN


@pytest.mark.parametrize("name", sorted(set(LIBRARY) - WITHOUT_TWIN))
def test_query_equals_its_twin(spark, con, name):
    ok, message = oracle.compare(spark, con, FOLDER, name, LIBRARY[name], entry.oracle_sql()[name])
    assert ok, message
