"""Even work for comparisons within groups: small groups whole, large ones as pairs of bounded tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, key: str, order: Column, rank: Column, reach: int, limit: int, joined: Column | None = None) -> DataFrame:
    """Add ``unit`` (long) and ``side`` (0 or 1) so that every pair of one ``key`` whose ranks differ by at most
    ``reach`` meets in some unit: two rows of side 0, or a row of side 0 and one of side 1.

    A group of at most ``limit`` rows is one unit of side 0. A larger one is cut into tiles of one ``rank`` and about
    ``limit`` rows, dealt by the hash ``order``, and each pair of tiles within reach is a unit of its own. Tiles beyond reach
    are never paired. Counts are pre-aggregated, so no task ever holds a large group. Rows of a large group that are ``joined`` need not
    meet each other, only the rest: their tiles are their own and never paired among themselves, so that many of them cost in
    proportion to their number.
    """
    # the lowest bit says joined
    rows = rows.withColumn("_rank", rank.cast("int") * 2 + (F.lit(0) if joined is None else joined.cast("int")))
    per_rank = rows.groupBy(key, "_rank").agg(F.count("*").alias("_n"))
    large = per_rank.groupBy(key).agg(F.sum("_n").alias("_all"), F.collect_list(F.struct("_rank", "_n")).alias("_ranks")).where(F.col("_all") > limit)
    tile = F.flatten(F.transform("_ranks", lambda r: F.transform(F.sequence(F.lit(0), F.floor((r["_n"] - 1) / limit).cast("int")), lambda s: F.struct(r["_rank"].alias("r"), s.alias("s"), (F.floor((r["_n"] - 1) / limit) + 1).alias("m")))))
    tiles = large.select(key, F.explode(tile).alias("t"), tile.alias("others"))
    near = lambda o: F.abs(F.shiftright(o["r"], 1) - F.shiftright(F.col("t.r"), 1)) <= reach
    both = lambda o: (o["r"].bitwiseAND(1) == 1) & (F.col("t.r").bitwiseAND(1) == 1)
    ahead = F.filter("others", lambda o: near(o) & ~both(o) & ((o["r"] > F.col("t.r")) | ((o["r"] == F.col("t.r")) & (o["s"] >= F.col("t.s")))))
    pairs = tiles.select(key, "t", F.explode(ahead).alias("o"))
    unit = F.xxhash64(key, "t.r", "t.s", "o.r", "o.s")
    same = F.col("t") == F.col("o")
    ends = pairs.select(key, unit.alias("unit"), F.explode(F.when(same, F.array(F.struct("t.*", F.lit(0).alias("side")))).otherwise(F.array(F.struct("t.*", F.lit(0).alias("side")), F.struct("o.*", F.lit(1).alias("side"))))).alias("e"))
    ends = ends.select(key, "unit", F.col("e.r").alias("_rank"), F.col("e.s").alias("_tile"), F.col("e.side").alias("side"))
    sized = per_rank.join(large.select(key), key, "left_semi").select(key, "_rank", (F.floor((F.col("_n") - 1) / limit) + 1).alias("_m"))
    heavy = rows.join(sized, [key, "_rank"]).withColumn("_tile", F.pmod(order, F.col("_m")).cast("int"))
    heavy = heavy.join(ends, [key, "_rank", "_tile"]).drop("_rank", "_tile", "_m")
    light = rows.join(large.select(key), key, "left_anti").drop("_rank").withColumn("unit", F.xxhash64(key)).withColumn("side", F.lit(0))
    return light.unionByName(heavy)
