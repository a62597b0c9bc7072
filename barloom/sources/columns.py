"""Binary column files, instrument lists and typed records."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is
    unset, a local master (tests) gets a local one; a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_columns(panel: DataFrame, path: str, value: str = "close") -> None:
    """One record per code: [start row as float32][values as float32, NaN for missing]
    on the calendar, as Parquet rows (code, data); each code is one bounded group."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date_idx", kind="stable")
        body = np.concatenate([[pdf["date_idx"].iloc[0]], pdf[value].to_numpy(float)]).astype("<f4")
        return pd.DataFrame({"code": [pdf["code"].iloc[0]], "data": [body.tobytes()]})

    panel.select("code", "date_idx", F.col(value).cast("double").alias(value)).groupBy("code").applyInPandas(pack, "code string, data binary").write.parquet(path)


def unpack(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Calendar rows and values of one file; missing values are left out."""
    x = np.frombuffer(content, "<f4")
    rows = int(x[0]) + np.arange(len(x) - 1) if len(x) else np.zeros(0, int)
    there = ~np.isnan(x[1:]) if len(x) else np.zeros(0, bool)
    return rows[there], x[1:][there] if len(x) else x


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """(code, date_idx, value) from packed columns."""

    def run(batches):
        for pdf in batches:
            for code, data in zip(pdf["code"], pdf["data"], strict=True):
                rows, values = unpack(data)
                yield pd.DataFrame({"code": code, "date_idx": rows.astype("int32"), "value": values.astype("float32")})

    return spark.read.parquet(path).mapInPandas(run, "code string, date_idx int, value float")


def read_column_files(spark: SparkSession, path: str) -> DataFrame:
    """(code, date_idx, value) from <code>/<field>.day.bin files, read as binary files."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows, values = unpack(data)
                yield pd.DataFrame({"code": name.split("/")[-2], "date_idx": rows.astype("int32"), "value": values.astype("float32")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "code string, date_idx int, value float")


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """(code, start, stop) from tab-separated lines of one or three fields."""
    return spark.read.schema("code string, start date, stop date").option("sep", "\t").option("mode", "PERMISSIVE").csv(path)


def typed_records(raw: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Columns of the whitelist, in order, from rows(json): absent ones and junk are null."""
    names = list(schema)
    parsed = raw.select(F.from_json("json", ", ".join(f"`{n}` string" for n in names)).alias("r"))
    return parsed.select(*[F.col(f"r.`{n}`").try_cast(kind).alias(n) for n, kind in schema.items()])
