"""Every query of the library against its SQL, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from tieplane.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values, names):
    def plain(v):
        return tuple(map(plain, v)) if isinstance(v, list) else repr(v)

    return sorted(tuple(plain(r[n]) for n in names) for r in values)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, con, name):
    df = catalog.queries()[name](spark, data)
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert rows(got, names) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["j7_radius_neighbours", "g2_rasterise_best_score", "u1_score_upsert", "j6_knn_prediction"])
def test_results_do_not_depend_on_partitions(spark, data, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = catalog.queries()[name](spark, data)
        seen.append(rows(df.collect(), sorted(df.columns)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_band_join_is_an_equi_join(spark, data):
    plan = catalog.queries()["j3_band_argmax"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
