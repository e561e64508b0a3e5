"""Every engine query against its SQL on the smallest tables."""
import pytest
from same import assert_same

from stratacohort.plans.oracle import ORACLES
from stratacohort.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["disease", "auc", "n_samples", "n_diseased", "n_healthy"]
