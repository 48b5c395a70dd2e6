import pytest

from oracle import assert_same
from pagewright.llm.oracles import ORACLE_SQL
from pagewright.llm.queries import QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_matches_its_sql(spark, tmp_path, name):
    assert_same(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE_SQL[name], tmp_path / "out")


def test_all_ten_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == [*range(1, 11)]
