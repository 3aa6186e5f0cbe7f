"""Every query of the engine beside its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from statloom import registry
from tools.verify import TABLES, cell

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rel = duck.execute(registry.ORACLE_SQL[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    at = [have.index(c) for c in cols]
    want = sorted(tuple(cell(r[k]) for k in at) for r in rel.fetchall())
    assert sorted(tuple(cell(v) for v in r) for r in got.select(*[f"`{c}`" for c in cols]).collect()) == want


def test_put_formats_between_two_percentages_and_with_wide_keys(spark, tmp_path):
    duckdb.sql(f"""copy (select o.* replace (o_orderkey + 1000000 * i as o_orderkey, 1000 * i + 500.0 as o_totalprice, case when i % 7 = 0 then o_custkey + 1234567890 * i else o_custkey end as o_custkey)
      from (select * from '{SF}/orders.parquet' limit 1) o, range(1, 500) t(i)) to '{tmp_path}/orders.parquet'""")
    got = registry.QUERIES["prog_put_formats"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    rows = con.execute(f"select {', '.join(got.columns)} from ({registry.ORACLE_SQL['prog_put_formats']})").fetchall()
    assert len(rows) == 499 and sorted(map(tuple, got.collect())) == sorted(rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables_are_merged(spark):
    got = registry.QUERIES["merge_by_many_to_many_whole"](spark, SF)
    for table, key, name in (("events", "event_id", "x"), ("orders", "o_orderkey", "y")):
        whole = spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()
        assert got.select(name).dropna().distinct().count() == whole
