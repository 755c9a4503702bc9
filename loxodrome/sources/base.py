"""Points, tracks and a grid derived from ``events``, the same in both engines.

Longitudes and latitudes are whole-number arithmetic on ids; obs is the value, a gap
(NaN) for every 97th event.  The grid averages the values of all events over
18 x 36 cells; cells no event falls in are gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loxodrome.functions.sqltext import NAN

_LON = "CAST((user_id * 37 + event_id * 13) % 36000 AS DOUBLE) / 1e2 - 180e0"
_LAT = "CAST(event_id % 17900 AS DOUBLE) / 1e2 - 89.95e0"
_OBS = f"CASE WHEN event_id % 97 = 0 THEN {NAN} ELSE value END"


def _seconds(dialect: str) -> str:
    return "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6" if dialect == "spark" else "epoch_us(ts) / 1e6"


def points_sql(dialect: str) -> str:
    return f"SELECT event_id, user_id, event_type, {_LON} AS lon, {_LAT} AS lat, {_OBS} AS obs FROM events"


def track_sql(dialect: str) -> str:
    return f"SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, {_LON} AS lon, {_LAT} AS lat, {_seconds(dialect)} AS time, {_OBS} AS obs, event_type AS grp FROM events"


def _cells_sql(events: str) -> str:
    return f"""SELECT CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j, -85e0 + 10e0 * a.i AS lat, -175e0 + 10e0 * b.j AS lon, coalesce(c.z, {NAN}) AS z
 FROM range(18) a(i) CROSS JOIN range(36) b(j) LEFT JOIN (SELECT (event_id * 7) % 18 AS i, (user_id * 5 + event_id) % 36 AS j, avg(value) AS z FROM {events} GROUP BY 1, 2) c ON a.i = c.i AND b.j = c.j"""


def grid_sql() -> str:
    return _cells_sql("events")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("event_id", "user_id", "event_type", f"{_LON} AS lon", f"{_LAT} AS lat", f"{_OBS} AS obs")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = track_sql("spark").removesuffix(" FROM events").removeprefix("SELECT ")
    return spark.sql(f"SELECT {sql} FROM {{events}}", events=_events(spark, sf_dir))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_cells_sql("{events}"), events=_events(spark, sf_dir))
