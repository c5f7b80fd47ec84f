import duckdb
import pytest
from recurscan.llm import queries as own


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = own.queries()[name](spark, sf_dir).toPandas()
    want = c.execute(own.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None)))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in own.queries()) == list(range(1, 11))
