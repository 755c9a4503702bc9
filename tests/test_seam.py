"""Points on Mollweide's edge meridian, where the last bit decides between both ends of the map, against another engine."""

import duckdb
import pytest

from loxodrome.plans import registry


@pytest.mark.parametrize("name", ["project_mollweide", "unproject_mollweide"])
def test_mollweide_on_its_edge_meridian(spark, tmp_path, name):
    c = duckdb.connect()
    # a user for each latitude such that the longitude is -160, half a turn from the query's centre
    c.sql(f"""copy (select e as event_id, timestamp '2024-01-01' as ts, (select u from range(36000) r(u) where (u * 37 + e * 13) % 36000 = 2000) as user_id, 'view' as event_type, 1e0 as value
      from range(0, 17900, 7) t(e)) to '{tmp_path}/events.parquet' (format parquet)""")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = c.sql(registry.ORACLES[name])
    got = sorted(tuple(r[k] for k in want.columns) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert len(got) == 2558 and got == sorted(want.fetchall())
