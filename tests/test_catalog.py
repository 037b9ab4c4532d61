"""A few queries of each kind against their SQL. The driver runs all of them."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from silvagrid import catalog

DATA = "/root/testdata/sf0.01"
NAMES = ["raster", "max_tree", "min_tree_owners", "forward_edges", "area", "contour_sides", "bitquad_counts", "bitquad_histogram", "bitquad_scalars", "contour_deltas", "compact_export", "pruning_min", "subtractive_filter", "saliency_ranked", "residual_saturated_reconstruct", "residual_tree_column_order_reconstruct", "alternating_filter", "viterbi_filter", "ultimate_opening", "ultimate_opening_mser", "pruned_max_tree_dual", "pruned_max_tree_image", "pruned_min_tree_dual"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(frame: pd.DataFrame, columns: list[str]):
    return sorted([tuple(None if pd.isna(x) else round(float(x), 5) + 0.0 for x in r) for r in frame[columns].itertuples(index=False)], key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, oracle, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), oracle.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
    spark.catalog.clearCache()


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
