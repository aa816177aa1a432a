"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get targets by weight, capped at a multiple of their size. Documents of a source are dealt to shards by a seeded
hash and laid end to end; a shard is a row of blocks of ``BLOCK`` words. The highest quotients claim/(2j - 1) win blocks
until the quotient falls to half a block, which awards each shard ``floor(claim / BLOCK + 1/2)`` blocks: the integer
quota in closed form, with no loop over seats. Whole passes over a shard come first; the rest of the quota is a seeded
systematic choice of its blocks, so what a document gives follows from its word range alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklake.session import materialise, tune

WEIGHTS = (1, 2, 3)
MOST = 3  # times its size that a source, and so a document, may count
BLOCK = 8
SHARD = 1 << 17  # words of a shard
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _number(text: Column) -> Column:
    """60 bits of a text's digest."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size)`` -> plus ``target``; one row per source, so the global order is over sources only.

    Sorted by how soon the cap binds, each source sees what is left after the capped ones before it; the first that stays below
    its cap fixes the level per unit of weight for all after it.
    """
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    rows = sizes.withColumn("w", w).withColumn("cap", cap).withColumn("soon", F.col("cap") / F.col("w"))
    order = Window.partitionBy().orderBy("soon", F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weight_left).withColumn("free", F.col("soon") > F.col("level"))
    level = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct("soon", F.col("source").isNull(), "source"))).over(every)
    rows = rows.withColumn("at", level)
    return rows.select("source", "source_size", F.when(F.col("at").isNull() | (F.col("soon") <= F.col("at")), F.col("cap")).otherwise(F.col("w") * F.col("at")).alias("target"))


def _chosen_words(x: Column) -> Column:
    """Words of the chosen blocks among the first ``x`` of a shard: every n-th block from a seeded start, ``r`` of ``n`` in all."""
    block, n, r, u = F.floor(x / BLOCK), F.col("n_blocks"), F.col("r"), F.col("u")
    upto = lambda b: F.floor((b + u) * r / n)  # noqa: E731  products stay below 2^53
    return BLOCK * (upto(block) - upto(F.lit(0))) + (upto(block + 1) - upto(block)) * (x % BLOCK)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs(doc_id, text, source)`` -> ``(doc_id, source, size, source_size, target, passes, taken)``, one row per input row.

    ``passes`` whole copies of the text and a part of one more make up ``taken`` words. A null source is a source of its own,
    after all others; null and empty texts have size nought and give nothing. Rows without an id are dealt by their text,
    repeated rows lie next to each other. Reruns agree, whatever the partitioning. Other columns are ignored; empty table: no rows.
    """
    name = F.when(F.col("doc_id").isNull(), F.concat(F.lit(f"{seed}|null|"), F.md5(F.coalesce("text", F.lit(""))))).otherwise(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string")))
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _number(name).alias("h")), "mix-sizes")
    # the key keeps null apart from every text, so joins and windows are plain equalities
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source"))
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    dealt = sized.withColumn("key", key).join(per_source.select(key.alias("key"), "source_size", "target"), "key")
    dealt = dealt.withColumn("shard", F.pmod(F.col("h"), F.floor(F.col("source_size") / SHARD) + 1))
    # dealt by shard, or the layout of the join (by source) would be kept and a hot source sorted in one task
    dealt = dealt.repartition("key", "shard")
    shard = Window.partitionBy("key", "shard")
    laid = shard.orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumn("end", F.sum("size").over(laid)).withColumn("words", F.sum("size").over(shard))
    quota = F.floor(F.col("target") * F.col("words") / F.col("source_size") / BLOCK + 0.5)
    rows = rows.withColumn("take", F.when(F.col("words") > 0, F.least(quota * BLOCK, F.col("words") * most)).otherwise(0))
    rows = rows.withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(0))
    rows = rows.withColumn("n_blocks", F.greatest(F.ceil(F.col("words") / BLOCK), F.lit(1)))
    rows = rows.withColumn("r", F.least(F.floor((F.col("take") - F.col("passes") * F.col("words") + BLOCK // 2) / BLOCK), F.col("n_blocks")))
    rows = rows.withColumn("u", F.pmod(_number(F.concat(F.lit(f"{seed}-block|"), "key", F.lit("|"), F.col("shard").cast("string"))), F.col("n_blocks")))
    part = _chosen_words(F.col("end")) - _chosen_words(F.col("end") - F.col("size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.col("passes").cast("long").alias("passes"), (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(tune(spark).read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN '{SEED}|null|' || md5(coalesce(text, '')) ELSE '{SEED}|' || doc_id::VARCHAR END), 1, 15))::BIGINT AS h
  FROM documents),
weighed AS (
  SELECT source, source_size, [1e0, 2e0, 3e0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * {MOST}e0 AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT *, cap / w AS soon,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))::DOUBLE
           / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) AS level
  FROM weighed),
lev AS (SELECT (SELECT level FROM levels WHERE soon > level ORDER BY soon, source ASC NULLS LAST LIMIT 1) AS lvl),
per_source AS (SELECT source, source_size, CASE WHEN lvl IS NULL OR soon <= lvl THEN cap ELSE w * lvl END AS target FROM levels, lev),
dealt AS (
  SELECT s.*, p.source_size, p.target, CASE WHEN s.source IS NULL THEN '0' ELSE '1' || s.source END AS key, h % (p.source_size // {SHARD} + 1) AS shard
  FROM sized s JOIN per_source p ON s.source IS NOT DISTINCT FROM p.source),
laid AS (
  SELECT *, sum(size) OVER (PARTITION BY key, shard ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS z, sum(size) OVER (PARTITION BY key, shard)::BIGINT AS words FROM dealt),
quota AS (
  SELECT *, CASE WHEN words > 0 THEN least(floor(target * words / source_size / {BLOCK} + 0.5e0)::BIGINT * {BLOCK}, words * {MOST}) ELSE 0 END AS take, greatest((words + {BLOCK - 1}) // {BLOCK}, 1) AS n FROM laid),
part AS (SELECT *, CASE WHEN words > 0 THEN take // words ELSE 0 END AS passes, ('0x' || substr(md5('{SEED}-block|' || key || '|' || shard::VARCHAR), 1, 15))::BIGINT % n AS u FROM quota),
rest AS (SELECT *, least((take - passes * words + {BLOCK // 2}) // {BLOCK}, n) AS r, z - size AS a FROM part)
SELECT doc_id, size, source_size, target,
  (passes * size
   + {BLOCK} * ((z // {BLOCK} + u) * r // n - u * r // n) + ((z // {BLOCK} + 1 + u) * r // n - (z // {BLOCK} + u) * r // n) * (z % {BLOCK})
   - {BLOCK} * ((a // {BLOCK} + u) * r // n - u * r // n) - ((a // {BLOCK} + 1 + u) * r // n - (a // {BLOCK} + u) * r // n) * (a % {BLOCK}))::BIGINT AS taken
FROM rest"""
