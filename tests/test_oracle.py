"""Every registered query against its DuckDB oracle on sf0.001 (the same
check the driver runs at sf0.01), plus the entry-point smoke check."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF_SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="test data missing")
def test_all_queries_match_oracle(spark):
    from oracle_check import check

    res = check(spark, SF_SMALL, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "ROWS_ONLY")}
    assert not bad, bad
