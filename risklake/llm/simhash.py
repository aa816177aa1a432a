"""Near-duplicate documents by SimHash: tiled exact comparison of 64-bit fingerprints.

Fingerprints of all documents are made in one pass without a shuffle. Comparison runs on distinct fingerprints. With a
radius of r, two linked fingerprints agree in at least one of r + 1 bit fields, so tiles are cut per (field, value): no
link is lost and no tile sees the whole corpus. Inside a tile rows are ordered by population count; numpy exclusive-or and bit
counts compare them exactly, and rows or tiles whose population counts differ beyond the radius are skipped. A tile hands
on a forest of its links (at most one per row); ``graph.components`` joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.llm.graph import components, forest
from risklake.llm.tiles import tiled
from risklake.llm.tokens import chunks
from risklake.session import discard, materialise, tune

SHINGLE = 3
RADIUS = 2
TILE = 512  # fingerprints of one tile
SLICE = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of one text; nought without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(joined)]])
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        to = min(at + SLICE, n)
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    """The last column is the text; the others are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts = batch.columns
            made = np.empty(len(texts), np.uint64)
            for lo, hi in chunks(texts):
                made[lo:hi] = [fingerprint(t, shingle) for t in texts.slice(lo, hi - lo).to_pylist()]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(made.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def _carried(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[dict[str, np.ndarray]]:
    """Batches as numpy columns, each ending where the (sorted) column changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(unit, unit[-1]))
        if cut:
            yield _columns([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and held[-1].column(column)[0].as_py() != unit[0]:
            yield _columns(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {name: table.column(name).to_numpy() for name in table.column_names}


def near_pairs(unit: np.ndarray, side: np.ndarray, pop: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one unit within the radius; rows come ordered by unit, side and population count."""
    left, right = [], []
    same = np.flatnonzero((unit[1:] != unit[:-1]) | (side[1:] != side[:-1])) + 1
    bounds = np.concatenate([[0], same, [len(unit)]])
    sizes = np.diff(bounds)
    # rows of one tile: compare each row with the d-th after it, for all tiles at once, while any reaches that far
    size_of = np.repeat(sizes, sizes)
    lone = np.repeat(~np.isin(unit[bounds[:-1]], unit[bounds[:-1]][side[bounds[:-1]] == 1]), sizes)  # units with a second side compare across only
    at = np.flatnonzero(lone & (size_of > 1))
    to_end = np.repeat(bounds[1:], sizes)
    step = 1
    while True:
        at = at[at + step < to_end[at]]
        at = at[pop[at + step] - pop[at] <= radius]  # ordered: once too far, always too far
        if not len(at):
            break
        hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
        left.append(hit)
        right.append(hit + step)
        step += 1
    for i in np.flatnonzero((side[bounds[:-2]] == 0) & (side[bounds[1:-1]] == 1) & (unit[bounds[:-2]] == unit[bounds[1:-1]])) if len(bounds) > 2 else []:
        a, b, c = bounds[i : i + 3]
        x, y = np.nonzero(np.bitwise_count(fp[a:b, None] ^ fp[None, b:c]) <= radius)
        left.append(a + x)
        right.append(b + y)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]).astype(np.int64), np.concatenate([empty, *right]).astype(np.int64)


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _carried(batches, "unit"):
            fp = part["fp"]
            x, y = near_pairs(part["unit"], part["side"], part["pop"], fp.view(np.uint64), radius)
            if len(x):
                a, b = forest(fp[x], fp[y])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``: links that connect exactly what all pairs within the radius connect."""
    fields = radius + 1
    width = -(-64 // fields)
    keys = F.array(*[F.xxhash64(F.lit(i), F.shiftrightunsigned("fp", i * width).bitwiseAND((1 << min(width, 64 - i * width)) - 1)) for i in range(fields)])
    rows = distinct.select("fp", F.bit_count("fp").alias("pop"), F.explode(keys).alias("field"))
    cut = tiled(rows, "field", F.xxhash64("fp"), F.col("pop"), radius, tile)
    placed = cut.select("unit", "side", "pop", "fp").repartition("unit").sortWithinPartitions("unit", "side", "pop")
    return placed.mapInArrow(_links(radius), "a long, b long")


def _roots(made: DataFrame, radius: int, tile: int) -> DataFrame:
    """``made(fp, ...)`` -> ``(fp, root)``: the class of every fingerprint, named by one of its own."""
    distinct = materialise(made.select("fp").distinct(), "simhash-distinct")
    roots = components(links(distinct, radius, tile))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp, component_id)``, one row per input row.

    Texts without words (null, empty) share fingerprint nought and link like any other. Rows with the same text or a null
    ``doc_id`` are fingerprinted alike; ``component_id`` is the smallest ``doc_id`` reachable, null if no row of the component has
    one. Other columns are ignored. Empty table: no rows.
    """
    made = materialise(docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "simhash-fp")
    least = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = _roots(made, radius, tile).join(least, "fp")
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(heads, "root").select("fp", "component_id")
    return made.join(named, "fp").select("doc_id", "fp", "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_keep(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of each component of ``docs``, all columns: that of the smallest (doc_id, text hash), null ids last.

    Rows listed more than once with the same id and text count as one. Names that begin with ``_sh_`` are reserved.
    """
    key = ["doc_id", "_sh_k1", "_sh_k2"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("_sh_k1", F.xxhash64(F.lit(1), text)).withColumn("_sh_k2", F.xxhash64(F.lit(2), text))
    made = materialise(rows.select(*key, "text").mapInArrow(_fingerprints(shingle), "doc_id long, _sh_k1 long, _sh_k2 long, fp long"), "simhash-fp")
    times = made.groupBy(*key, "fp").agg(F.count("*").alias("times"))
    return one_of_each(docs, rows, times.join(_roots(made, radius, tile), "fp"))


def one_of_each(docs: DataFrame, rows: DataFrame, rooted: DataFrame) -> DataFrame:
    """The row of ``docs`` that stays of each root: ``rows`` are ``docs`` with text hashes, ``rooted`` their keys with root and times."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_sh_k1", "_sh_k2")
    kept = rooted.groupBy("root").agg(F.min(F.struct(place.alias("place"), "times")).alias("m")).select(F.col("m.place.doc_id").alias("_sh_id"), F.col("m.place._sh_k1").alias("_sh_h1"), F.col("m.place._sh_k2").alias("_sh_h2"), F.col("m.times").alias("_sh_times"))
    kept = materialise(kept, "simhash-kept")
    met = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_sh_id")) & (F.col("_sh_k1") == F.col("_sh_h1")) & (F.col("_sh_k2") == F.col("_sh_h2")))
    alone = met.where("_sh_times = 1")
    repeated = met.where("_sh_times > 1").dropDuplicates(["_sh_id", "_sh_h1", "_sh_h2"])
    return alone.unionByName(repeated).select(*docs.columns)
