"""Cooldown of rule events as a parallel scan of step functions.

An event is kept when the rule's previous *kept* event lies more than the cooldown back, so the chain of kept events depends on
itself and a plain lag cannot find it. What a stretch of events does to the chain is a step function: from the time of the last event
kept before it to the last one kept after it. Step functions compose associatively. Events are placed in one order and cut
into blocks of equal count; each block's function is a short sorted array of (entry up to, last kept); a tree of group-bys composes
neighbours upwards, and the entries of all blocks are handed back down the same tree. A rule that holds most events is cut into as many
blocks as any others, and only block functions ever meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklake.functions.order import numbered
from risklake.session import discard, materialise

BLOCK = 256  # events of a block
FAN = 64  # functions composed in one row
NEVER = -(1 << 60)  # entry of a rule that has kept nothing yet
_STEPS = "array<struct<upto:bigint,stop:bigint>>"


def _after(steps: str, entry: str) -> str:
    """SQL: last kept time after a stretch, given the last one before it."""
    return f"coalesce(get(filter({steps}, s -> s.upto > {entry} + gap), 0).stop, {entry})"


#: SQL: the function of a block's sorted times, from its end; entries that lead to the same last event are one step
_OF_TIMES = f"""aggregate(reverse(events.us), cast(array() as {_STEPS}), (acc, x) ->
    get(transform(array(coalesce(get(filter(acc, a -> a.upto > x + gap), 0).stop, x)), v -> if(coalesce(get(acc, 0).stop = v, false), acc, concat(array(struct(x as upto, v as stop)), acc))), 0))"""
#: SQL: composition of a row's functions in order
_COMPOSED = f"""aggregate(kids, cast(array() as {_STEPS}), (acc, c) ->
    get(transform(array(concat(transform(acc, a -> struct(a.upto as upto, {_after('c.steps', 'a.stop')} as stop)), c.steps)), v -> filter(v, (a, i) -> coalesce(get(v, i + 1).stop <> a.stop, true))), 0))"""
#: SQL: entry of each of a row's functions, given the row's own
_ENTRIES = f"""aggregate(kids, struct(entry as cur, cast(array() as array<struct<block:bigint,entry:bigint>>) as out), (acc, c) ->
    struct({_after('c.steps', 'acc.cur')} as cur, concat(acc.out, array(struct(c.block as block, acc.cur as entry))) as out)).out"""
#: SQL: what a block keeps, given its entry
_KEPT = """aggregate(events, struct(entry as cur, cast(array() as array<bigint>) as out), (acc, v) ->
    if(v.us > acc.cur + gap, struct(v.us as cur, concat(acc.out, array(v.tie)) as out), acc)).out"""


def cooldown(matched: DataFrame, prior: DataFrame | None = None, order: Sequence[str] = ("ts", "event_id"), block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Rows with ``alert_id, cooldown_seconds`` and the ``order`` columns -> plus ``kept``.

    ``prior(alert_id, kept_at)`` is the last event kept by an earlier run, one row per rule; a rule without one keeps its first event.
    ``cooldown_seconds`` is the rule's; nought or less keeps everything. Of events at one time the first by the second order column counts.
    """
    ts, tie = order
    matched = materialise(matched, "cooldown-input")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    slim = matched.where("cooldown_seconds > 0").select("alert_id", (F.col("cooldown_seconds").cast("long") * 1_000_000).alias("gap"), us.alias("us"), F.col(tie).cast("long").alias("tie"))
    placed = numbered(slim, ["alert_id", "us", "tie"], "cooldown-order")
    blocks = placed.groupBy("alert_id", F.expr(f"pos div {block}").alias("block")).agg(F.max("gap").alias("gap"), F.sort_array(F.collect_list(F.struct("us", "tie"))).alias("events"))
    blocks = materialise(blocks.withColumn("steps", F.expr(_OF_TIMES)), "cooldown-blocks")
    last = (placed.agg(F.max("pos")).first()[0] or 0) // block
    level, tree = blocks.select("alert_id", "gap", "block", "steps"), []
    while last:
        grouped = level.groupBy("alert_id", F.expr(f"block div {fan}").alias("up")).agg(F.max("gap").alias("gap"), F.sort_array(F.collect_list(F.struct("block", "steps"))).alias("kids"))
        tree.append(materialise(grouped.withColumn("steps", F.expr(_COMPOSED)), "cooldown-level"))
        level, last = tree[-1].select("alert_id", "gap", F.col("up").alias("block"), "steps"), last // fan
    entries = level.select("alert_id", "block", F.lit(NEVER).alias("entry"))
    if prior is not None:
        entries = level.select("alert_id", "block").join(prior.select("alert_id", F.unix_micros(F.col("kept_at").cast("timestamp")).alias("_at")), "alert_id", "left").select("alert_id", "block", F.coalesce("_at", F.lit(NEVER)).alias("entry"))
    for step in reversed(tree):
        handed = step.join(entries.withColumnRenamed("block", "up"), ["alert_id", "up"])
        entries = handed.select("alert_id", F.explode(F.expr(_ENTRIES)).alias("e")).select("alert_id", "e.*")
    kept = blocks.join(entries, ["alert_id", "block"]).select("alert_id", F.explode(F.expr(_KEPT)).alias(tie)).withColumn("_kept", F.lit(True))
    kept = materialise(kept, "cooldown-kept")
    discard(placed, blocks, *tree)
    return matched.join(kept, ["alert_id", tie], "left").withColumn("kept", F.coalesce("_kept", F.col("cooldown_seconds") <= 0)).drop("_kept")


def last_kept(decided: DataFrame, ts: str = "ts") -> DataFrame:
    """``(alert_id, kept_at)`` after a run, the ``prior`` of the next one."""
    return decided.where("kept").groupBy("alert_id").agg(F.max(ts).alias("kept_at"))
