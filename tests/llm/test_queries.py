"""The registered queries of this subpackage against their SQL."""

import pytest

from tablevec.llm.queries import QUERIES
from tools.check import compare, duck


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, sf_dir, name):
    fn, sql = QUERIES[name]
    ok, message = compare(spark, duck(sf_dir), name, fn, sql, sf_dir)
    assert ok, message


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
