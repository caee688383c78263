import duckdb
import pytest

from provena.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    rows = got.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted([str(r[c]) for c in columns] for r in rows) == sorted([str(r[i]) for i in at] for r in want.fetchall())


def test_hard_filter_stays_above_the_limit(spark, sf_dir):
    from provena.operators import retrieve

    objects = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    top = retrieve.dense_topk(objects, "vec_id", "embedding", objects.first()["embedding"], 10).where("object_id % 2 = 0")
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("% 2) = 0") < plan.index("GlobalLimit")
    assert top.count() <= 10


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = registry.queries()["cohort_semi"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority)" in plan and "o_totalprice" not in plan
