"""Exports: quoted CSV, JSON-safe rows, bounded stream logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

STREAM_CAP = 10_000


def write_csv(df: DataFrame, path: str) -> None:
    """RFC-4180 quoting with CRLF line ends; NULL and empty cells are empty."""
    df.write.mode("overwrite").options(
        header=True, quote='"', escape='"', lineSep="\r\n", nullValue="", emptyValue=""
    ).csv(path)


def csv_cell(c: Column) -> Column:
    s = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(s.rlike('[,"\n\r]'), quoted).otherwise(s), F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(*df.columns, F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in df.columns]).alias("line"))


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def trim_streams(log: DataFrame, by: str = "stream", order: str = "arrived_at", tie: str = "event_id", cap: int = STREAM_CAP) -> DataFrame:
    """Keep the newest ``cap`` rows of each stream (the retention rule itself).

    Spark limits each partition to ``cap`` candidates before the shuffle, so a busy stream sends at
    most ``cap`` rows per task.
    """
    rn = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order), F.desc(tie)))
    return log.withColumn("_rn", rn).where(F.col("_rn") <= cap).drop("_rn")
