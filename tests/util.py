from __future__ import annotations


def rows(df, *order):
    """All rows as tuples, sorted."""
    found = [tuple(r) for r in df.select(*order).collect()] if order else [tuple(r) for r in df.collect()]
    return sorted(found, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def table(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)
