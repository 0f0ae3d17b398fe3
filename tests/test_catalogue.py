import pytest
from conftest import DATA
from oracle import same

from skein.plans import catalogue

#: Graph loops whose many small jobs are slow; one of each kind is enough here.
SLOW = {"ppr_k_iters", "collect_deps"}


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - SLOW))
def test_matches_sql(spark, name):
    same(catalogue.QUERIES[name](spark, DATA), catalogue.ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
