"""Silver tables: shared inputs written once, in the layout their readers need.

A table read by company is bucketed by its key, so that grouping, windows and joins on the key need no exchange and a lookup of some
companies is a filter on a stored column, which reaches the scan.  A table read by day is partitioned by month, so that a date range reads its months only
(``scans.calendar_between`` and ``scans.window_page`` add the filter on ``month`` where a table has that column).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.session import scaled_partitions, scratch_dir


def bucketed(df: DataFrame, name: str, key: str = "symbol", buckets: int | None = None, deal: bool = True) -> DataFrame:
    """``df`` as a table bucketed by ``key``, a file for each bucket.

    Rows that come from a table with the same buckets are in their places already; ``deal=False`` writes them where they are.
    """
    spark = df.sparkSession
    n = buckets or scaled_partitions(spark)
    table = f"silver_{name}_{uuid.uuid4().hex}"
    (df.repartition(n, key) if deal else df).write.bucketBy(n, key).option("path", scratch_dir(spark, table)).format("parquet").saveAsTable(table)
    return spark.table(table)


def by_month(df: DataFrame, name: str, day: str = "date", salt: int = 4) -> DataFrame:
    """``df`` with ``month`` (year * 100 + month, null without a day), a folder each; a hot month is dealt to ``salt`` tasks."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"silver-{name}")
    tagged = df.withColumn("month", F.year(day) * 100 + F.month(day))
    tagged.repartition("month", F.pmod(F.xxhash64(*df.columns), F.lit(salt))).write.partitionBy("month").parquet(path)
    return spark.read.schema(tagged.schema).parquet(path)


def bucketed_together(tables: dict[str, Callable[[], DataFrame]], key: str = "symbol") -> dict[str, DataFrame]:
    """Independent tables, planned and written at the same time, all with the same buckets: joins on ``key`` between them move no row."""
    with ThreadPoolExecutor(len(tables)) as pool:
        done = pool.map(lambda item: bucketed(item[1](), item[0], key), tables.items())
        return dict(zip(tables, done, strict=True))
