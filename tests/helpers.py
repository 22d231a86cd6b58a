"""Small conveniences for tests."""

from pyspark.sql import functions as F


def one(spark, column):
    """Value of a column expression over literals."""
    return spark.range(1).select(column.alias("x")).first()["x"]


def text(spark, value):
    return F.lit(value).cast("string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)
