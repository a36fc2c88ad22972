"""Every query of the catalogue against its SQL, and the entry points."""

import oracle
import pytest

import __spark_entry__ as entry
from recordweave.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert oracle.difference(catalog.QUERIES[name](spark, sf), catalog.SQL[name], oracle.connect(sf)) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "email", "email_type", "public_business"]
