"""Stored panels: a table bucketed and sorted by code, written once for each state of its input.

Windows by code read it without an exchange: a bucket holds all rows of its codes, in
one file. The name of the table follows the input's files (path, length, time), so
a changed input is written anew and an old table is never read for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .columns import scratch


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the files below the paths: names, lengths and times."""
    found = []
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
        found += [f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in files]
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], key: str = "code", order: tuple[str, ...] = ("code", "date_idx"), buckets: int | None = None) -> DataFrame:
    """The table that build() gives for these input files, from the session's catalog,
    or written there first. Its files lie in the shared folder of spark.checkpoint.dir;
    a table whose files are gone is written again.

    buckets: spark.sql.shuffle.partitions unless given; for a large panel some hundred
    MB of rows a bucket. A key is in one bucket, so one code's history is one
    task's, as in any window by code."""
    table = f"stored_{name}_{fingerprint(spark, *inputs)}"
    if spark.catalog.tableExists(table):
        found = spark.table(table)
        if _present(spark, found):
            return found
        spark.sql(f"drop table {table}")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = build().repartition(n, key)  # the hash of a bucket: one file for each
    rows.write.bucketBy(n, key).sortBy(*order).option("path", scratch(spark, table)).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def _present(spark: SparkSession, table: DataFrame) -> bool:
    files = table.inputFiles()
    path = spark._jvm.org.apache.hadoop.fs.Path
    return bool(files) and all(path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f)) for f in files[:1])
