"""Schemas of the raw tables and the scan that reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LONG, _INT, _DOUBLE, _STRING, _STAMP = (
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.StringType(),
    T.TimestampNTZType(),
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(r_regionkey=_INT, r_name=_STRING),
    "nation": _schema(n_nationkey=_INT, n_name=_STRING, n_regionkey=_INT),
    "customer": _schema(
        c_custkey=_LONG, c_name=_STRING, c_nationkey=_INT, c_acctbal=_DOUBLE, c_mktsegment=_STRING
    ),
    "supplier": _schema(s_suppkey=_LONG, s_name=_STRING, s_nationkey=_INT, s_acctbal=_DOUBLE),
    "part": _schema(
        p_partkey=_LONG, p_name=_STRING, p_brand=_STRING, p_type=_STRING, p_size=_INT, p_retailprice=_DOUBLE
    ),
    "orders": _schema(
        o_orderkey=_LONG,
        o_custkey=_LONG,
        o_orderstatus=_STRING,
        o_totalprice=_DOUBLE,
        o_orderdate=_STAMP,
        o_orderpriority=_STRING,
    ),
    "lineitem": _schema(
        l_orderkey=_LONG,
        l_partkey=_LONG,
        l_suppkey=_LONG,
        l_linenumber=_INT,
        l_quantity=_DOUBLE,
        l_extendedprice=_DOUBLE,
        l_discount=_DOUBLE,
        l_tax=_DOUBLE,
        l_returnflag=_STRING,
        l_linestatus=_STRING,
        l_shipdate=_STAMP,
    ),
    "events": _schema(
        event_id=_LONG, ts=_STAMP, user_id=_LONG, event_type=_STRING, value=_DOUBLE, props=_STRING
    ),
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one table with its declared schema, so no file is opened to infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")
