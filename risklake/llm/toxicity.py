"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A text is cut into windows of whole words; each is compressed once with the ordinary dictionary and once with the toxic one.
Both hold the commonest ordinary words and stems; the toxic one then has every word and stem that marks toxic training text, by a
significance that a rare vocabulary reaches as well as a common one, and the ordinary one as many blank bytes, so lengths differ only
where markers help. The score is a logistic calibration of the differences of a text, on documents whose own words were left
out of the dictionaries. Everything is learnt from at most ``FIT_DOCS`` labelled documents outside the held-out fold; the score reads the
text alone, all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.session import discard, materialise, tune

FIT_DOCS = 6000
FOLDS = 5
WINDOW = 24  # bytes of a window, as far as whole words go
COMMON_BYTES = 12000
STEMS = (5, 6, 7)  # first characters of longer words, counted beside the words
SIGNIFICANT = 15.0  # log-likelihood ratio of a marker's document counts, at least
ODDS = 3.0  # a marker is so many times as frequent in toxic documents, at least
CROSS = 4  # parts of the sample; each is measured by dictionaries of the others for the calibration
LEVELS = (2, 3, 4, 5, 6, 7, 8, 10, 12)  # bytes saved from which windows are counted
LOSSES = (4, 6)  # bytes lost, the same for noise
FEATURES = 4 + len(LEVELS) + len(LOSSES) + 1
_FEATURE_COLUMNS = ", ".join(f"f{j} double" for j in range(FEATURES))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass(frozen=True)
class Distance:
    """Both dictionaries and the calibration. ``weights``: intercept, then one per feature."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def windows(text: str, size: int = WINDOW) -> Iterator[bytes]:
    held, n = [], 0
    for word in text.encode("utf-8", "surrogatepass").lower().split():
        if held and n + len(word) + 1 > size:
            yield b" %s " % b" ".join(held)
            held, n = [], 0
        held.append(word)
        n += len(word) + 1
    if held:
        yield b" %s " % b" ".join(held)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    log = max(15, (len(content) + WINDOW).bit_length())  # all of the dictionary is within reach
    params = zstandard.ZstdCompressionParameters(
        window_log=log, hash_log=log - 1, chain_log=log - 1, search_log=5, target_length=48, min_match=4, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    # raw content wants eight bytes at least
    data = zstandard.ZstdCompressionDict(content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data)


def measure(text: str | None, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> tuple[float, ...]:
    """Largest and second largest saving, shares of windows that save 4 and 6 bytes, log numbers of windows per level, per loss, and of all."""
    gains = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text or "")], np.int64)
    n = len(gains)
    top = np.sort(np.append(gains, [0, 0]))[::-1]
    counts = [np.count_nonzero(gains >= x) for x in LEVELS] + [np.count_nonzero(gains <= -x) for x in LOSSES] + [n]
    shares = [np.count_nonzero(gains >= x) / n if n else 0.0 for x in (4, 6)]
    return float(top[0]), float(top[1]), *shares, *np.log1p(counts).tolist()


def _measured(ordinary: bytes, toxic: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _compressor(ordinary), _compressor(toxic)
        for batch in batches:
            rows = np.array([measure(t.as_py(), a, b) for t in batch.column(1)], float).reshape(-1, FEATURES)
            columns = [batch.column(0), *(pa.array(np.ascontiguousarray(rows[:, j])) for j in range(FEATURES))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"f{j}" for j in range(FEATURES))])

    return run


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _terms(text: Column) -> Column:
    """Distinct words and stems of a text."""
    words = F.array_distinct(F.filter(F.split(_lower(text), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
    stems = F.flatten(F.transform(words, lambda w: F.array(*[F.when(F.char_length(w) > n, F.substring(w, 1, n)) for n in STEMS])))
    return F.array_distinct(F.concat(words, F.filter(stems, lambda w: w.isNotNull())))


def dictionaries(counts: DataFrame, toxic_docs: int, ordinary_docs: int) -> tuple[bytes, bytes]:
    """``counts(w, t, o)``: toxic and ordinary documents of each term -> the ordinary and the toxic dictionary.

    A marker is chosen by the significance of its own counts, never by its share of the strongest one's, and all that pass have room.
    """
    t, o, n = F.col("t"), F.col("o"), F.col("t") + F.col("o")
    odds = (t / toxic_docs) / ((o + 0.5) / ordinary_docs)
    expected = n * (toxic_docs / (toxic_docs + ordinary_docs))
    ratio = 2 * (t * F.log(t / expected) + F.when(o > 0, o * F.log(o / (n - expected))).otherwise(0.0))
    marked = counts.where("t >= 3").where((odds >= ODDS) & (t > expected)).withColumn("ratio", ratio).where(F.col("ratio") >= SIGNIFICANT)
    markers = [r.w for r in marked.orderBy(F.desc("ratio"), "w").collect()]
    common: list[str] = []
    size = 0
    for r in counts.where("o >= 3").where(odds <= 1.5).orderBy(F.desc("o"), "w").limit(COMMON_BYTES).collect():
        if size >= COMMON_BYTES:
            break
        common.append(r.w)
        size += len(r.w.encode()) + 1
    base = " ".join(reversed(common)).encode()  # the end of a dictionary is the cheapest to refer to
    tail = " ".join(reversed(markers)).encode()
    return base + b" " + b"\x01" * len(tail) + b" ", base + b" " + tail + b" "


def fit_distance(docs: DataFrame, labels: DataFrame, max_docs: int = FIT_DOCS) -> Distance | None:
    """Dictionaries and calibration from at most ``max_docs`` labelled documents (smallest hash) outside the held-out fold.

    ``None`` without labels of both kinds. Term counts are aggregated in Spark; the driver sees the chosen terms and a few numbers a document.
    The calibration measures each of ``CROSS`` parts by dictionaries of the others; a part without which one kind is missing is left out.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    part = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(CROSS)).cast("int")
    sample = materialise(docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("y", part.alias("part"), "text"), "toxicity-sample")
    docs_of = {(r.part, r.y): r["count"] for r in sample.groupBy("part", "y").count().collect()}
    totals = [sum(n for (_, y), n in docs_of.items() if y == kind) for kind in (0, 1)]
    if not all(totals):
        discard(sample)
        return None
    per_part = [F.count(F.when((F.col("y") == y) & (F.col("part") == p), 1)).alias(f"{'ot'[y]}{p}") for y in (0, 1) for p in range(CROSS)]
    counts = materialise(sample.select("y", "part", F.explode(_terms(F.col("text"))).alias("w")).groupBy("w").agg(*per_part), "toxicity-words")

    def learnt(without: int | None) -> tuple[bytes, bytes]:
        parts = [p for p in range(CROSS) if p != without]
        t, o = (sum((F.col(f"{kind}{p}") for p in parts[1:]), F.col(f"{kind}{parts[0]}")) for kind in "to")
        return dictionaries(counts.select("w", t.alias("t"), o.alias("o")), totals[1] - docs_of.get((without, 1), 0), totals[0] - docs_of.get((without, 0), 0))

    ordinary, toxic = learnt(None)
    rows = []
    for p in range(CROSS):
        if all(totals[y] > docs_of.get((p, y), 0) for y in (0, 1)):
            rows += sample.where(F.col("part") == p).select(F.col("y").alias("doc_id"), "text").mapInArrow(_measured(*learnt(p)), "doc_id int, " + _FEATURE_COLUMNS).collect()
    if not rows:  # every document of one kind is in one part: nothing can be left out
        rows = sample.select(F.col("y").alias("doc_id"), "text").mapInArrow(_measured(ordinary, toxic), "doc_id int, " + _FEATURE_COLUMNS).collect()
    discard(sample, counts)
    table = np.array([tuple(r) for r in rows], float)
    table = table[np.lexsort(table.T[::-1])]
    return Distance(ordinary, toxic, calibrate(table[:, 1:], table[:, 0]))


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps, on standardised features with a small ridge."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[1:] / sd
    return (float(w[0] - slope @ mean), *slope.tolist())


def toxicity(docs: DataFrame, model: Distance | None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, held_out, score, predicted)``, one row per input row, no shuffle.

    Null and empty texts have no windows and get the calibration's value for that. Without a model every score is nought. Repeated rows
    score alike; a null id counts as held out; other columns are ignored.
    """
    fold = held_out(F.col("doc_id"))
    if model is None:
        return docs.select("doc_id", fold.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    measured = docs.select("doc_id", "text").mapInArrow(_measured(model.ordinary, model.toxic), "doc_id long, " + _FEATURE_COLUMNS)
    z = F.lit(model.weights[0])
    for j, w in enumerate(model.weights[1:]):
        z = z + F.col(f"f{j}") * w
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))
    return measured.select("doc_id", fold.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, fit_distance(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
