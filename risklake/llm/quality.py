"""Document quality: base counts, and a linear-chain conditional random field over the lines of a text.

Each line with a word is labelled content or boilerplate by Viterbi decoding; a document stays when at least
``CONTENT_SHARE`` of its words lie in content lines. The field is fitted on a bounded sample of labelled documents
(``FIT_DOCS`` documents, of each a run of ``FIT_LINES`` lines at a seeded place), every line taking its document's label; scoring covers
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.llm.tokens import Prefix, chunks, cut_words, mix, text_bytes, word_hashes
from risklake.session import tune

FIT_DOCS = 1500
FIT_LINES = 40
FIT_ROUNDS = 150
STICKY = 1.5  # the pairwise weights stay within this, so one line can still change the label
CONTENT_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FEATURES = ["bias", "words", "symbols", "upper", "digits", "repeats", "closed", "marks", "copy", "word_length"]

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_LOWER = np.zeros(256, bool)
_IS_LOWER[97:123] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~")] = True
_IS_CLOSE = np.zeros(256, bool)
_IS_CLOSE[list(b".!?")] = True


@dataclass(frozen=True)
class ChainField:
    """Weights of a two-label chain: label 1 is content. ``emit`` scores content against boilerplate."""

    emit: tuple[float, ...]
    stay: float  # weight of keeping the label between neighbouring lines

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi labels of one text's lines."""
        score = (features @ np.array(self.emit)).tolist()
        back: list[tuple[bool, bool]] = []
        zero = one = 0.0
        for i, s in enumerate(score):
            if i:
                zero_from_one, one_from_zero = one > zero + self.stay, zero > one + self.stay
                zero, one = max(zero + self.stay, one), max(one + self.stay, zero)
                back.append((zero_from_one, one_from_zero))
            one += s
        label = one >= zero
        out = [label]
        for zero_from_one, one_from_zero in reversed(back):
            label = (not one_from_zero) if label else zero_from_one
            out.append(label)
        return np.array(out[::-1][: len(score)], bool)


#: without any labels: symbols, capitals, repeats and other marks speak for boilerplate
PRIOR = ChainField((2.0, 0.5, -12.0, -4.0, -2.0, -4.0, 0.3, -2.0, -1.0, 0.0), 0.5)


@dataclass
class Measured:
    """Counts per text and features per line (lines with a word only) of one chunk."""

    counts: np.ndarray  # n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    features: np.ndarray
    line_words: np.ndarray
    first_line: np.ndarray


def _per(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[end] - total[start]


def measure(buf: np.ndarray, offsets: np.ndarray) -> Measured:
    words = cut_words(buf, offsets)
    h = word_hashes(words)
    lo, hi = offsets[:-1], offsets[1:]
    lead = (buf & 0xC0) != 0x80
    word_points = _per(lead, words.start, words.end)
    n = len(lo)
    n_words = words.counts
    word_chars = np.bincount(words.doc, word_points, n).astype(np.int64)
    symbols = _IS_SYMBOL[buf]
    # words inside a 3-word sequence that the text holds more than once
    grams = Prefix(h).windows(3)
    inside = words.doc[: len(grams)] == words.doc[2:] if len(h) > 2 else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    keyed = mix(grams[at] ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keyed, kind="stable")
    k = keyed[order]
    twin = np.zeros(len(k), bool)
    if len(k):
        eq = k[1:] == k[:-1]
        twin[1:] |= eq
        twin[:-1] |= eq
    covered = np.zeros(len(h) + 3, bool)
    found = at[order[twin]]
    for d in range(3):
        covered[found + d] = True
    n_repeat = np.bincount(words.doc, covered[: len(h)], n).astype(np.int64)
    # lines: cut at newlines and text ends
    newline = np.flatnonzero(buf == 10)
    cut = np.unique(np.concatenate([lo, newline + 1]))
    cut = cut[cut < len(buf)]
    line_end = np.append(cut[1:], len(buf))
    line_doc = np.searchsorted(hi, cut, "right")
    word_lo, word_hi = np.searchsorted(words.start, cut), np.searchsorted(words.start, line_end)
    full = word_hi > word_lo
    cut, line_end, line_doc, word_lo, word_hi = cut[full], line_end[full], line_doc[full], word_lo[full], word_hi[full]
    body_end = line_end - ((line_end > cut) & (buf[np.maximum(line_end - 1, 0)] == 10))
    raw = buf.tobytes()
    digest = xxhash.xxh3_128_intdigest
    seen: set[tuple[int, int]] = set()
    copy = np.zeros(len(cut), bool)
    for i, (d, s, e) in enumerate(zip(line_doc.tolist(), cut.tolist(), body_end.tolist())):
        key = (d, digest(raw[s:e]))
        if key in seen:
            copy[i] = True
        else:
            seen.add(key)
    n_dup = np.bincount(line_doc, copy, n).astype(np.int64)
    # line features
    size = word_hi - word_lo
    chars = np.maximum(_per(word_points, word_lo, word_hi), 1)
    upper, lower = _per(_IS_UPPER[buf], cut, line_end), _per(_IS_LOWER[buf], cut, line_end)
    line_of = np.repeat(np.arange(len(cut)), size)
    distinct = np.zeros(len(cut))
    if len(line_of):
        pair = mix(h[words_in(word_lo, size)] ^ mix(line_of.astype(np.uint64) + np.uint64(7)))
        _, where = np.unique(pair, return_index=True)
        distinct = np.bincount(line_of[where], minlength=len(cut))
    last = buf[words.end[word_hi - 1] - 1] if len(cut) else np.zeros(0, np.uint8)
    features = np.stack(
        [
            np.ones(len(cut)), np.log1p(size) / 5, _per(symbols, cut, line_end) / chars, upper / np.maximum(upper + lower, 1), _per(_IS_DIGIT[buf], cut, line_end) / chars,
            1 - distinct / np.maximum(size, 1), _IS_CLOSE[last], _per(_IS_MARK[buf], cut, line_end) / np.maximum(size, 1), copy, np.minimum(chars / np.maximum(size, 1), 30) / 10,
        ],
        axis=1,
    ).astype(float)
    features[:, 7] = np.minimum(features[:, 7], 3)
    counts = np.stack([n_words, word_chars, _per(symbols, lo, hi), n_dup, n_repeat], axis=1)
    return Measured(counts, features, size, np.searchsorted(line_doc, np.arange(n + 1)))


def words_in(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first, first + 1, ... of each run, in one array."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


def _score(model: ChainField):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            counts, content = [], []
            for lo, hi in chunks(texts):
                m = measure(*text_bytes(texts.slice(lo, hi - lo)))
                counts.append(m.counts)
                for a, b in zip(m.first_line[:-1].tolist(), m.first_line[1:].tolist()):
                    content.append(int(m.line_words[a:b][model.decode(m.features[a:b])].sum()) if b > a else 0)
            table = np.concatenate(counts) if counts else np.zeros((0, 5), np.int64)
            columns = [batch.column(0), *(pa.array(np.ascontiguousarray(table[:, j])) for j in range(5)), pa.array(content, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words"])

    return run


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long"


def seeded_start(doc_id: int, lines: int) -> int:
    """First line of the run that represents a document: anywhere in it, decided by its id; 0 where the run holds all lines."""
    return xxhash.xxh64_intdigest(str(doc_id)) % max(1, lines - FIT_LINES + 1)


def _line_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        rows = []
        for lo, hi in chunks(texts):
            m = measure(*text_bytes(texts.slice(lo, hi - lo)))
            ends = zip(batch.column(0).slice(lo, hi - lo).to_pylist(), m.first_line[:-1].tolist(), m.first_line[1:].tolist())
            for doc_id, a, b in ends:
                a += seeded_start(doc_id, b - a)
                rows.append(m.features[a : min(b, a + FIT_LINES)].ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "features"])


def fit_field(docs: DataFrame, labels: DataFrame, max_docs: int = FIT_DOCS) -> ChainField:
    """Fit the chain on at most ``max_docs`` labelled documents (those of smallest hash), ``FIT_LINES`` neighbouring lines each, from any part of the text.

    Labels are per document and partly wrong; maximum likelihood with a weight penalty sees through that. No labelled rows,
    or only one kind: ``PRIOR``.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "label").limit(max_docs)
    sample = docs.where("text is not null").join(chosen, "doc_id").select("doc_id", "text", "label")
    # a label may have several rows of one id: keep the bound
    rows = sample.mapInArrow(_line_features, "doc_id long, label int, features array<double>").orderBy("doc_id", F.hash("features")).limit(max_docs).collect()
    sequences = [(np.array(r.features).reshape(-1, len(FEATURES)), r.label) for r in rows if r.features]
    if len({y for _, y in sequences}) < 2:
        return PRIOR
    return train(sequences)


def train(sequences: list[tuple[np.ndarray, int]]) -> ChainField:
    """Gradient ascent (Adam) on the conditional likelihood of constant label chains, all sequences at once."""
    n, steps = len(sequences), max(len(x) for x, _ in sequences)
    x = np.zeros((n, steps, len(FEATURES)))
    mask = np.zeros((n, steps), bool)
    y = np.array([label for _, label in sequences], float)
    for i, (f, _) in enumerate(sequences):
        x[i, : len(f)], mask[i, : len(f)] = f, True
    weight = 1.0 / mask.sum(axis=1)  # a document counts once, however many lines it has
    theta = np.array([*PRIOR.emit, PRIOR.stay])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for round_no in range(1, FIT_ROUNDS + 1):
        score, stay = x @ theta[:-1], theta[-1]
        # forward and backward log messages of label 1 and 0
        forward = np.zeros((steps, n, 2))
        forward[0, :, 1] = score[:, 0]
        for t in range(1, steps):
            a0, a1 = forward[t - 1, :, 0], forward[t - 1, :, 1]
            forward[t, :, 0] = np.logaddexp(a0 + stay, a1)
            forward[t, :, 1] = np.logaddexp(a0, a1 + stay) + score[:, t]
            forward[t][~mask[:, t]] = forward[t - 1][~mask[:, t]]
        log_z = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
        backward = np.zeros((steps, n, 2))
        kept = np.zeros(n)
        for t in range(steps - 2, -1, -1):
            b0, b1 = backward[t + 1, :, 0], backward[t + 1, :, 1] + score[:, t + 1]
            backward[t, :, 0] = np.logaddexp(b0 + stay, b1)
            backward[t, :, 1] = np.logaddexp(b0, b1 + stay)
            off = ~mask[:, t + 1]
            backward[t][off] = backward[t + 1][off]
            pair = np.exp(forward[t, :, 0] + stay + b0 - log_z) + np.exp(forward[t, :, 1] + stay + b1 - log_z)
            kept += np.where(off, 0, pair)
        p1 = np.exp(forward[:, :, 1] + backward[:, :, 1] - log_z).T
        residual = np.where(mask, y[:, None] - p1, 0) * weight[:, None]
        grad = np.append(np.einsum("nt,ntf->f", residual, x), ((mask.sum(axis=1) - 1 - kept) * weight).sum()) / n - 0.0005 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.25 * (m / (1 - 0.9**round_no)) / (np.sqrt(v / (1 - 0.99**round_no)) + 1e-8)
        theta[-1] = np.clip(theta[-1], 0, STICKY)
    return ChainField(tuple(theta[:-1].tolist()), float(theta[-1]))


def quality_scores(docs: DataFrame, model: ChainField) -> DataFrame:
    """``docs(doc_id, text)`` -> base counts, ``content_words``, ``base_failed`` and ``kept``, one row per input row.

    Null and empty texts have no words and fail the base rule. A row is judged by its own text alone, so repeated rows and
    null ids are judged like any other; other columns are ignored. Empty table: no rows.
    """
    scored = docs.select("doc_id", "text").mapInArrow(_score(model), SCORED)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_words") >= CONTENT_SHARE * F.col("n_words")))


def _keep(model: ChainField):
    score = _score(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(batch.schema.get_field_index("text"))], ["doc_id", "text"])
            c = {name: col.to_numpy() for name, col in zip(SCORED.replace(" long", "").split(", "), next(score(iter([pair]))).columns) if name != "doc_id"}
            keep = (c["n_words"] >= MIN_WORDS) & (100 * c["n_repeat_words"] <= MAX_REPEAT_PERCENT * c["n_words"]) & (c["content_words"] >= CONTENT_SHARE * c["n_words"])
            yield batch.filter(pa.array(keep))

    return run


def quality_keep(docs: DataFrame, model: ChainField) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_scores`` keeps; no shuffle."""
    return docs.mapInArrow(_keep(model), docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_scores(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")
