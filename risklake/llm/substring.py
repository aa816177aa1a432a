"""Substring dedup: repeated token windows by a compacted de Bruijn graph.

The graph's edges are windows of ``WINDOW`` words (k-mers of tokens, from their first k - 1 words to their last k - 1). Edges are not
listed one by one: each window is filed under its seed, the smallest hash among its ``SEED``-word stretches, and neighbouring
windows of a text with the same seed form one path of at most ``WINDOW - SEED + 1`` edges, written as a single row.
A path that occurs again whole cannot branch inside: all occurrences compact into one row by an equi-join on (seed, path).
Only where a repeated seed has differing paths, one of them single, does the graph branch, and there alone paths are opened into edges.
Source coordinates turn repeated paths and edges into spans of words.

Identity of windows rests on two independent 64-bit hashes (seed and window), of texts on 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.llm.tokens import Prefix, chunks, cut_words, text_bytes, word_hashes
from risklake.session import discard, materialise, tune

WINDOW = 35
SEED = 8
PATHS = "k1 long, k2 int, seed long, path long, start int, edges int"
EDGES = "seed long, edge long, times int, k1 long, k2 int, start int"
KEY = ["k1", "k2"]


def _leftmost_smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest (leftmost) of ``width`` values from each position on, by doubling."""
    best = np.arange(len(h))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        reach += step
    return best


def paths_of(buf: np.ndarray, offsets: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Paths of a chunk of texts: (text, seed hash, path hash, first window, number of windows)."""
    words = cut_words(buf, offsets)
    h = word_hashes(words)
    n = len(h) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    prefix = Prefix(h)
    kmers = prefix.windows(seed)
    at = _leftmost_smallest(kmers, window - seed + 1)[:n]
    whole = np.flatnonzero(words.doc[:n] == words.doc[window - 1 : window - 1 + n])
    if not len(whole):
        return paths_of(buf[:0], np.zeros(1, np.int64), window, seed)
    new = np.ones(len(whole), bool)
    new[1:] = (np.diff(whole) != 1) | (at[whole[1:]] != at[whole[:-1]])
    head = np.flatnonzero(new)
    first, last = whole[head], whole[np.append(head[1:], len(whole)) - 1]
    doc = words.doc[first]
    # where the seed lies inside the path is part of its identity, as is its length
    path = prefix.runs(first, last + window) ^ ((last - first + 1).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return doc, kmers[at[first]], path, first - words.first[doc], last - first + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _paths(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in chunks(texts):
                doc, s, p, first, n = paths_of(*text_bytes(texts.slice(lo, hi - lo)), window, seed)
                where = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), _signed(s), _signed(p), pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["k1", "k2", "seed", "path", "start", "edges"])

    return run


def _edges(window: int):
    """Opens chosen paths, given per text as arrays, into edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chosen = batch.column(2), batch.column(3)
            for lo, hi in chunks(texts):
                buf, offsets = text_bytes(texts.slice(lo, hi - lo))
                words = cut_words(buf, offsets)
                edges = Prefix(word_hashes(words)).windows(window)
                part = chosen.slice(lo, hi - lo)
                flat = part.flatten()
                doc = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy(zero_copy_only=False))
                seed, start, n, times = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                row = np.repeat(np.arange(len(doc)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = start[row].astype(np.int64) + step
                hashed = edges[words.first[doc[row]] + at] if len(row) else np.zeros(0, np.uint64)
                where = pa.array(doc[row] + lo)
                yield pa.RecordBatch.from_arrays([pa.array(seed[row]), _signed(hashed), pa.array(times[row], pa.int32()), batch.column(0).take(where), batch.column(1).take(where), pa.array(at, pa.int32())], ["seed", "edge", "times", "k1", "k2", "start"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(F.lit(1), text).alias("k1"), F.shiftright(F.xxhash64(F.lit(2), text), 32).cast("int").alias("k2"), text.alias("text"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` from ``keyed`` -> ``(k1, k2, start, n)``: runs of ``n`` repeated windows from word ``start`` of the texts with that key.

    A text that occurs twice repeats itself, so its windows are found like any other.
    """
    paths = materialise(docs.select(*KEY, "text").mapInArrow(_paths(window, seed), PATHS), "dbg-paths")
    # seeds that occur once settle their windows: no other window can equal them
    twice = paths.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    twice = materialise(twice, "dbg-twice")  # a table, not an aggregate: both sides of the join are then dealt anew and a hot seed is split
    again = materialise(paths.join(twice, "seed", "left_semi"), "dbg-again")
    discard(paths, twice)
    kinds = again.groupBy("seed", "path").agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "start", "edges")).alias("at"))
    kinds = materialise(kinds.select("seed", "path", F.least("times", F.lit(2)).cast("int").alias("times"), "at.*"), "dbg-kinds")
    compact = again.join(kinds.where("times > 1").select("seed", "path"), ["seed", "path"], "left_semi").select(*KEY, "start", F.col("edges").alias("n")).distinct()
    # branching: a seed with several paths of which one at least is single; one occurrence of each is opened
    branching = kinds.groupBy("seed").agg(F.count("*").alias("k"), F.min("times").alias("least")).where("k > 1 and least = 1").select("seed")
    opened = kinds.join(branching, "seed", "left_semi").groupBy(*KEY).agg(F.collect_list(F.struct("seed", "start", F.col("edges").alias("n"), "times")).alias("chosen"))
    edges = docs.select(*KEY, "text").join(opened, KEY).mapInArrow(_edges(window), EDGES)
    edges = materialise(edges, "dbg-edges")
    shared = edges.groupBy("seed", "edge").agg(F.sum("times").alias("t")).where("t > 1").select("seed", "edge")
    single = edges.where("times = 1").join(shared, ["seed", "edge"], "left_semi").select(*KEY, "start", F.lit(1).alias("n"))
    found = materialise(compact.unionByName(single), "dbg-found")
    discard(again, kinds, edges)
    return found


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, runs = batch.columns[0], batch.columns[1], batch.columns[2]
            sizes, removed, digests, spans, kept_texts = [], [], [], [], []
            for text, run_list in zip(texts, runs):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                keep = words
                cut: list[dict] = []
                if run_list.is_valid and len(run_list):
                    edge = np.zeros(len(words) + 1, np.int64)
                    start, n = (run_list.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    cut = [{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]
                    keep = [words[i] for i in np.flatnonzero(~gone)]
                kept = b" ".join(keep)
                sizes.append(len(words))
                removed.append(len(words) - len(keep))
                digests.append(hashlib.sha256(kept).hexdigest())
                spans.append(cut)
                kept_texts.append(kept.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, _SPANS), pa.array(kept_texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"],
            )

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, n_removed, kept_sha256, spans, kept)``, one row per input row.

    ``spans`` are the removed word ranges, ``kept`` the other words joined by a space. Null and empty texts have no words; texts
    shorter than a window lose nothing. Repeated rows, and rows whose text occurs elsewhere, lose all windows of it. Ids may be null
    or repeated, rows are told apart by text; other columns are ignored. Empty table: no rows.
    """
    if not 0 < seed <= window:
        raise ValueError("the seed must fit into the window")
    rows = keyed(docs)
    found = repeated_windows(rows, window, seed)
    runs = found.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return rows.join(runs, KEY, "left").select("doc_id", "text", "runs").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
