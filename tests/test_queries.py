"""Every query of the library with a SQL twin gives the twin's rows; the others give rows."""

import compare
import pytest

from taxaflow.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, name):
    names, rows = compare.spark_rows(catalog.queries()[name](spark, SF))
    if name not in catalog.oracles():
        assert rows
        return
    assert (names, rows) == compare.duck_rows(catalog.oracles()[name], SF)


def test_entry_has_both_and_survives_without_the_subpackage(spark, monkeypatch):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    monkeypatch.setattr(e, "_llm", lambda: None)
    assert set(e.queries()) == set(NAMES)
    assert e.entry(spark).count() > 0
