import os

import pytest

import oracle
from factlog.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    f = registry.QUERIES[name]
    if name not in registry.ORACLE_SQL:
        f(spark, SF).collect()
        return
    got, want = oracle.compare(spark, f, registry.ORACLE_SQL[name], SF, con)
    assert got[0] == want[0]
    wrong = [(a, b) for a, b in zip(got[1], want[1], strict=False) if a != b][:3]
    assert len(got[1]) == len(want[1]) and not wrong, (len(got[1]), len(want[1]), wrong)
