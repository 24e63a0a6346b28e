"""A sample of the queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = ["g5_degree_stats", "p2_overlap_partition", "p5_test_edges", "l4_align_subs", "m2_sbm_blocks", "m7_ncv_dcbm_blocks", "m9_ecv_sbm_blocks", "s3_auc_loss", "a7_loss_table", "r2_method_accuracy", "e8_tile_matvec"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, SF)
    found = tables.execute(__spark_entry__.oracle_sql()[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == sorted(df.columns)
    assert plain(df.select(*[f"`{c}`" for c in order]).collect()) == plain(found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
