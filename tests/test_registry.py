"""Every query with SQL against another engine on the small tables, and the entry module's contract."""

import duckdb
import pytest

from loxodrome.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["great_circle", "wrap_longitude", "project_mollweide", "unproject_albers", "quantile", "polygon_filter", "split_tracks_time", "split_antimeridian", "regrid_bilinear", "regrid_conservative", "hillshade", "truecolor", "v1_options", "format_lonlat", "contours", "contour_segments", "split_antimeridian"]


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(c.sql(registry.ORACLES[name]).df())


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
