"""Near-duplicate documents of the pipeline: SimHash as op1 has it, and MinHash over word shingles, verified by exact Jaccard similarity.

Texts whose 64-bit fingerprints over 3-word shingles differ in at most 2 bits are linked (``simhash.links``). That finds about one in
five hundred pairs at a similarity of 0.8, so texts are linked by their 5-word shingles as well; components are those of both kinds of links.

Texts are lower-cased (A-Z) and cut into words; equal word sequences are one text. Every text gets ``BANDS`` x ``ROWS`` minima over its
``SHINGLE``-word shingles (a shorter text is one shingle). Texts that share a band are compared as lines are (``line_links``): with the
bucket's leader, then what is not connected yet in bounded tiles. At the threshold of 0.8 a pair shares a band with
probability 1 - (1 - 0.8^4)^20 = 0.99997.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklake.llm.graph import components
from risklake.llm.line_dedup import bands_type, bytes_of, columns_of, joined_bands, line_links, sketches
from risklake.llm.simhash import RADIUS, TILE, fingerprint, one_of_each
from risklake.llm.simhash import _roots as fingerprint_roots
from risklake.llm.tokens import Prefix, cut_words, word_hashes
from risklake.session import discard, materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4

_MULTIPLIERS = np.random.default_rng(13).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def _hashes(joined: bytes) -> np.ndarray:
    words = cut_words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
    n = len(words.start)
    return np.unique(Prefix(word_hashes(words)).windows(min(SHINGLE, n))) if n else np.zeros(1, np.uint64)


def hashed(text: str) -> np.ndarray:
    """Distinct hashes of the word shingles of a text; one of nought without words."""
    return _hashes(_words(text))


def shingled(text: str) -> set[int]:
    return set(hashed(text).tolist())


def _hashed_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of all texts one after the other, and where each text's begin."""
    made = [hashed(text) for text in texts]
    sizes = np.array([len(h) for h in made])
    return np.concatenate(made), np.cumsum(sizes) - sizes


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n, minima = np.empty(batch.num_rows, np.uint64), np.empty(batch.num_rows, np.int32), np.zeros((batch.num_rows, BANDS * ROWS), np.uint64)
        prints = np.empty(batch.num_rows, np.uint64)
        for i, text in enumerate(batch.column(3)):
            joined = _words(text.as_py())
            ids[i] = xxhash.xxh64_intdigest(joined, 42)
            prints[i] = fingerprint(text.as_py())
            h = _hashes(joined)
            n[i] = len(h)
            minima[i] = [(h * m).min() for m in _MULTIPLIERS]
        made = [pa.array(ids.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(n), bytes_of(sketches(minima)), columns_of(joined_bands(minima, BANDS, ROWS))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["doc_id", "_sh_k1", "_sh_k2", "h", "fp", "n", "sketch", "bands"])


def _print_links(made: DataFrame) -> DataFrame:
    """``made(h, fp, ...)`` -> ``(a, b)``: the texts of each class of fingerprints, linked to one of them."""
    texts = made.select("h", "fp").distinct().join(fingerprint_roots(made, RADIUS, TILE), "fp").select("h", "root")
    heads = texts.groupBy("root").agg(F.min("h").alias("b"))
    return texts.join(heads, "root").where("h <> b").select(F.col("h").alias("a"), "b")


def near_keep(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component of ``docs``, all columns: that of the smallest (doc_id, text hash), null ids last.

    Links are those of SimHash (op1's rule) and those of a Jaccard similarity of ``threshold`` or more.
    Rows listed more than once with the same id and text count as one. Names that begin with ``_sh_`` are reserved.
    """
    key = ["doc_id", "_sh_k1", "_sh_k2"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("_sh_k1", F.xxhash64(F.lit(1), text)).withColumn("_sh_k2", F.xxhash64(F.lit(2), text))
    made = materialise(rows.select(*key, "text").mapInArrow(_signed, f"doc_id long, _sh_k1 long, _sh_k2 long, h long, fp long, n int, sketch binary, bands {bands_type(BANDS)}"), "near-signed")

    def texts_of(wanted: DataFrame) -> DataFrame:
        # one row of each wanted text: ids first, texts only for those
        one = made.join(wanted, "h", "left_semi").groupBy("h").agg(F.min(F.struct("_sh_k1", "_sh_k2")).alias("k")).select("h", "k._sh_k1", "k._sh_k2")
        return rows.select("_sh_k1", "_sh_k2", "text").join(one, ["_sh_k1", "_sh_k2"]).select("h", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["h"])

    prints = materialise(_print_links(made), "near-prints")
    links = line_links(made, BANDS * ROWS, texts_of, threshold, shingled, hashed, _hashed_all)
    roots = components(links.unionByName(prints)).withColumnRenamed("node", "h")
    times = made.groupBy(*key, "h").agg(F.count("*").alias("times"))
    out = one_of_each(docs, rows, times.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")))
    discard(made, links, prints)
    return out
