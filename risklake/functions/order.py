"""Places of rows in one global order, found without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklake.session import discard, materialise

_ROW = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Written ``rows`` plus ``pos``, from 0 in ascending ``order`` (nulls first; ties in any order).

    Rows are dealt to ranges of the order and sorted there, so a hot leading key is cut wherever the later ones
    differ; what precedes a range is the sum of the counts of the ranges before it.
    """
    sort = [F.asc_nulls_first(c) for c in order]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(_ROW)), f"{name}-ranged")
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).agg(F.sort_array(F.collect_list(F.struct("_part", "_n"))).alias("parts"))
    base = F.transform("parts", lambda p, i: F.struct(p["_part"].alias("_part"), F.aggregate(F.slice("parts", 1, i), F.lit(0).cast("long"), lambda a, q: a + q["_n"]).alias("_base")))
    bases = parts.select(F.explode(base).alias("b")).select("b.*")  # as many rows as there are ranges
    out = materialise(ranged.join(bases, "_part").select(*rows.columns, (F.col("_at") + F.col("_base")).alias("pos")), name)
    discard(ranged)
    return out
