"""The benchmark tables as observations: a cast per order, a level per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Runs unchanged in Spark and DuckDB. {days} is days since 1950-01-01, {order} the row order.
VIEW = """
select concat('P', cast(o_custkey % 50 as varchar(8))) as platform_code, o_orderkey as profile_no, o_orderdate as profile_timestamp,
 case when o_custkey % 89 = 0 then cast('NaN' as double) else {days} + cast(o_orderkey % 8 as double) / 8 end as profile_time,
 cast(o_custkey % 16 as double) * 0.5 - 4.0 as longitude,
 case when o_custkey % 97 = 0 then cast('NaN' as double) else cast(o_custkey % 12 as double) * 0.25 + 50.0 end as latitude,
 case o_orderstatus when 'F' then '1' when 'O' then '' else '4' end as time_qc,
 case when o_orderkey % 11 = 0 then '9' else '1' end as position_qc,
 case when l_discount < 0.02 then cast('NaN' as double) else l_quantity end as temp,
 case when o_orderkey % 7 = 0 then cast('NaN' as double) else l_extendedprice end as psal,
 case when l_tax < 0.01 then null else l_linenumber * 10.0 + l_tax * 100 end as pres,
 {order} as __order
from lineitem join orders on l_orderkey = o_orderkey
"""
SPARK = VIEW.format(days="cast(datediff(o_orderdate, date '1950-01-01') as double)", order="named_struct('f', '', 'r', o_orderkey * 100 + l_linenumber)")
DUCKDB = VIEW.format(days="cast(date_diff('day', date '1950-01-01', cast(o_orderdate as date)) as double)", order="o_orderkey * 100 + l_linenumber")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders")}
    return spark.sql(SPARK.replace("from lineitem join orders", "from {lineitem} join {orders}"), **tables)
