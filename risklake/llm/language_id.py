"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is fixed and public (byte-level pieces, ``VOCABULARY``); only the pieces' probabilities are learnt, one set per language, by
expectation-maximisation: the words of all training texts are counted in Spark, and each round sums, by forward and backward
passes, how often every piece is expected over all segmentations of every word. A text's likelihood is the product over its words, and that of
a word the sum over all ways to cut ``" " + word`` into pieces, by the forward algorithm. Sets are smoothed with that of all languages.

What reaches the driver and the tasks is one number per piece and language; word counts stay in Spark.

A word is a run of visible bytes; one of more than ``UNIT`` bytes is cut there, so memory and steps are bounded for very long words. Null
texts and texts without a letter are ``und`` with score 0, so is everything if there is nothing to learn from. Rows without id are scored,
but neither learnt from nor held out. Equal likelihoods go to the first language by name. Repeated rows count as often as they are there
and are scored alike; other columns are ignored; empty table: no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.llm.tokens import chunks, cut_words, powers, text_bytes, word_hashes
from risklake.session import discard, materialise, tune

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
FOLDS, TEST_FOLD = 4, 2
ROUNDS = 3
SMOOTHING = 2000.0  # pieces' worth of the set of all languages that is added to each
UNIT = 512  # bytes of a word cut at a time
LATTICE_BYTES = 64 << 10  # bytes of words whose lattice is held at a time
SHORT = 20  # bytes of a word up to which probabilities are summed as they are; e^-700 is far below what so many bytes can have
SLOT_BITS = 18
KNOWN_SCORES = 1 << 22  # scores of words (one per language) a task remembers before it starts afresh
UNDECIDED = "und"
FINE = float(1 << 20)  # expected counts are summed as whole multiples of 1 / FINE, so that the order of sums does not matter

_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SLOT_SHIFT = np.uint64(64 - SLOT_BITS)
_BYTE = np.random.default_rng(1912).integers(1, 2**63, 256, dtype=np.uint64)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ANY_LETTER = regex.compile(r"\p{L}")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces that can occur in a word with a blank before it, and every single byte."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return sorted({p for p in pieces if not set(p[1:]) & set(b"\t\n\x0b\x0c\r ")} | {bytes([b]) for b in range(256)})


class Lattice:
    """All pieces at all places of some words: edges from one place to a later one of the same word.

    Pieces are found by hash, in a table by the hash's first bits; the few that share a slot are searched in order.
    """

    def __init__(self, pieces: list[bytes]):
        of_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            of_length.setdefault(len(piece), []).append(i)
        self.lengths = sorted(of_length)
        hashes, ids = np.zeros(len(pieces), np.uint64), np.arange(len(pieces))
        for n, own in of_length.items():
            buf = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8)
            hashes[own] = self._hashes(np.arange(0, len(buf), n), n, *self._sums(buf))
        slot = (hashes >> _SLOT_SHIFT).astype(np.int64)
        self.key, self.id = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1)
        self.key[slot], self.id[slot] = hashes, ids
        times = np.bincount(slot, minlength=1 << SLOT_BITS)
        self.id[times > 1] = -2
        order = np.argsort(hashes[times[slot] > 1])
        self.shared, self.shared_id = hashes[times[slot] > 1][order], ids[times[slot] > 1][order]

    @staticmethod
    def _sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * powers(_STEP, len(buf) + 1)[: len(buf)], dtype=np.uint64, out=sums[1:])
        return sums, powers(_STEP_INVERSE, len(buf) + 1)

    @staticmethod
    def _hashes(at: np.ndarray, n: int, sums: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        return ((sums[at + n] - sums[at]) * inverse[at] + np.uint64(n)) * _SPREAD

    def _found(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> _SLOT_SHIFT).astype(np.int64)
        found = np.where((self.key[slot] == h) | (self.id[slot] == -2), self.id[slot], -1)
        many = np.flatnonzero(found == -2)
        if len(many):
            near = np.minimum(np.searchsorted(self.shared, h[many]), len(self.shared) - 1)
            found[many] = np.where(self.shared[near] == h[many], self.shared_id[near], -1)
        return found

    def edges(self, buf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(start, size, piece, word)`` of each edge, start being a byte of ``buf``."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        room = np.cumsum(sizes)[word] - np.arange(len(buf))
        sums, inverse = self._sums(buf)
        at, found = np.arange(len(buf)), []
        for n in self.lengths:
            at = at[room[at] >= n]
            if not len(at):
                break
            ids = self._found(self._hashes(at, n, sums, inverse))
            hit = ids >= 0
            found.append((at[hit], np.full(int(hit.sum()), n), ids[hit]))
        start, size, piece = (np.concatenate(part) for part in zip(*found))
        return start, size, piece, word[start]


def forward(begin: np.ndarray, end: np.ndarray, depth: np.ndarray, weight: np.ndarray, roots: np.ndarray, places: int, logs: bool) -> np.ndarray:
    """Sum over all paths from a root to each place of the product of weights; both as logarithms with ``logs``.

    ``depth`` is the distance of an edge's end from its root.
    """
    order = np.lexsort((end, depth))
    begin, end, weight = begin[order], end[order], weight[order]
    total = np.full((places, *weight.shape[1:]), -np.inf if logs else 0.0)
    total[roots] = 0 if logs else 1
    deepest = int(depth.max(initial=0))
    cuts = np.searchsorted(depth[order], np.arange(1, deepest + 2))
    heads_of = np.concatenate([[True], end[1:] != end[:-1]])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        heads = np.flatnonzero(heads_of[lo:hi])
        if logs:
            paths = total[begin[lo:hi]] + weight[lo:hi]
            top = np.maximum.reduceat(paths, heads)
            width = np.diff(np.append(heads, hi - lo))
            total[end[lo:hi][heads]] = top + np.log(np.add.reduceat(np.exp(paths - np.repeat(top, width, axis=0)), heads))
        else:
            total[end[lo:hi][heads]] = np.add.reduceat(total[begin[lo:hi]] * weight[lo:hi], heads)
    return total


@dataclass(frozen=True)
class Pieces:
    """Languages by name, log probabilities (piece, language), and log shares of the languages among training texts."""

    pieces: list[bytes]
    languages: list[str]
    logs: np.ndarray
    shares: np.ndarray


def batches_of(words: list[bytes], limit: int = LATTICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """``(which, bytes, sizes, logs)`` of about ``limit`` bytes of words, short and long ones apart; sums over long ones need logarithms."""
    sizes = np.array([len(w) for w in words])
    for which, logs in ((np.flatnonzero(sizes <= SHORT), False), (np.flatnonzero(sizes > SHORT), True)):
        ends, at = np.cumsum(sizes[which]), 0
        while at < len(which):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            chosen = which[at:to]
            yield chosen, np.frombuffer(b"".join(words[i] for i in chosen.tolist()), np.uint8), sizes[chosen], logs
            at = to


def word_scores(lattice: Lattice, logs: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log likelihood of each word (row) per language."""
    out, odds = np.empty((len(words), logs.shape[1])), np.exp(logs)
    for which, buf, sizes, far in batches_of(words):
        start, size, piece, word = lattice.edges(buf, sizes)
        first = np.cumsum(sizes) - sizes
        # a word of n bytes has n + 1 places
        total = forward(start + word, start + size + word, start + size - first[word], (logs if far else odds)[piece], first + np.arange(len(sizes)), len(buf) + len(sizes), far)
        whole = total[first + sizes + np.arange(len(sizes))]
        out[which] = whole if far else np.log(whole)
    return out


def expected(lattice: Lattice, logs: np.ndarray, words: list[bytes], language: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Expected uses of pieces over all segmentations of words of known languages: ``(language, piece, uses)``, one per edge."""
    odds = np.exp(logs)
    for which, buf, sizes, far in batches_of(words):
        start, size, piece, word = lattice.edges(buf, sizes)
        own, n = language[which], times[which]
        weight = (logs if far else odds)[piece, own[word]]
        first = np.cumsum(sizes) - sizes
        last, place, places = first + sizes, np.arange(len(sizes)), len(buf) + len(sizes)
        begin, end = start + word, start + size + word
        before = forward(begin, end, start + size - first[word], weight, first + place, places, far)
        mirror = first[word] + last[word] + 2 * word  # the same paths from the ends of the words
        after = forward(mirror - end, mirror - begin, last[word] - start, weight, first + place, places, far)[mirror - end]
        whole = before[last + place][word]
        share = np.exp(before[begin] + weight + after - whole) if far else before[begin] * weight * after / whole
        yield own[word], piece, share * n[word]


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct words of a chunk of texts: text, distinct word and hash of each occurrence's word, and the words themselves."""
    buf, offsets = text_bytes(column)
    words = cut_words(buf, offsets)
    if len(words.start) and int((words.end - words.start).max()) > UNIT:
        pieces = -(-(words.end - words.start) // UNIT)
        owner = np.repeat(np.arange(len(pieces)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = words.start[owner] + nth * UNIT
        words.end, words.start, words.doc = np.minimum(start + UNIT, words.end[owner]), start, words.doc[owner]
        hashes = np.array([hash(buf[s:e].tobytes()) for s, e in zip(words.start, words.end)], np.int64).view(np.uint64)
    else:
        hashes = word_hashes(words)
    distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    return words.doc, which, distinct, sample, [b" " + raw[s:e] for s, e in zip(words.start[sample].tolist(), words.end[sample].tolist())]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, text)`` -> ``(lang, word, n)``, added up within chunks."""
    for batch in batches:
        for lo, hi in chunks(batch.column(1)):
            names, code = np.unique(np.array(batch.column(0)[lo:hi].to_pylist(), object), return_inverse=True)
            doc, which, distinct, _, words = units(batch.column(1)[lo:hi])
            if len(words):
                pair, n = np.unique(code[doc] * len(distinct) + which, return_counts=True)
                made = [pa.array(names[pair // len(distinct)], pa.string()), pa.array([words[i] for i in (pair % len(distinct)).tolist()], pa.binary()), pa.array(n)]
                yield pa.RecordBatch.from_arrays(made, ["lang", "word", "n"])


def _expecting(pieces: list[bytes], logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, sums = Lattice(pieces), np.zeros(logs.size)
        for batch in batches:
            for lang, piece, uses in expected(lattice, logs, batch.column(1).to_pylist(), batch.column(0).to_numpy(), batch.column(2).to_numpy()):
                sums += np.bincount(piece * logs.shape[1] + lang, np.round(uses * FINE), logs.size)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], ["cell", "uses"])

    return run


def smoothed(uses: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log probabilities from expected uses (piece, language)."""
    every = uses.sum(axis=1) + 1
    background = every / every.sum()
    return np.round(np.log((uses + smoothing * background[:, None]) / (uses.sum(axis=0) + smoothing)), 9)


def fit_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> Pieces | None:
    """Piece probabilities of every language from all rows of ``docs(doc_id, text, lang)`` with id, text and language outside the test fold.

    ``None`` if there is no such row. The numbers of languages and pieces bound what is collected.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(fold(F.col("doc_id")) != TEST_FOLD)
    shares = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not shares:
        return None
    languages, pieces = sorted(shares), read_vocabulary(vocabulary)
    words = known.select("lang", "text").mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    code = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
    words = materialise(words.select(code[F.col("lang")].alias("lang"), "word", "n"), "language-words")
    logs = np.full((len(pieces), len(languages)), -np.log(len(pieces)))
    for _ in range(rounds):
        sums = words.mapInArrow(_expecting(pieces, logs), "cell long, uses double").groupBy("cell").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros(logs.size)
        for r in sums:
            uses[r.cell] = r.uses / FINE
        logs = smoothed(uses.reshape(logs.shape))
    discard(words)
    count = np.array([shares[x] for x in languages], float)
    return Pieces(pieces, languages, logs, np.log(count / count.sum()))


class Scorer:
    """Scores of words, remembered within a task."""

    def __init__(self, model: Pieces):
        self.lattice, self.logs = Lattice(model.pieces), model.logs
        self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros((0, model.logs.shape[1]))

    def of(self, hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
        """One row per word; ``hashes`` ascend."""
        near = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[near] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            if self.scores.size > KNOWN_SCORES:
                self.hashes, self.scores, new = self.hashes[:0], self.scores[:0], np.arange(len(hashes))
            made = word_scores(self.lattice, self.logs, [words[i] for i in new.tolist()])
            at = np.searchsorted(self.hashes, hashes[new])
            self.hashes, self.scores = np.insert(self.hashes, at, hashes[new]), np.insert(self.scores, at, made, axis=0)
        return self.scores[np.searchsorted(self.hashes, hashes)]


def lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    buf, offsets = text_bytes(column)
    seen = np.concatenate([[0], np.cumsum(_LETTER[buf])])[offsets]
    out = np.diff(seen) > 0
    for i in np.flatnonzero(~out).tolist():
        out[i] = _ANY_LETTER.search(column[i].as_py() or "") is not None
    return out


def _scored(model: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        names = np.array([*model.languages, UNDECIDED], object)
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                texts = batch.column(1)[lo:hi]
                doc, which, hashes, _, words = units(texts)
                sums = np.tile(model.shares, (hi - lo, 1))
                if len(words):
                    of_word = scorer.of(hashes, words)[which]
                    sums += np.stack([np.bincount(doc, of_word[:, k], hi - lo) for k in range(sums.shape[1])], axis=1)
                best = sums.argmax(axis=1)
                score = np.round(1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), 6)
                none = ~lettered(texts)
                best[none], score[none] = len(model.languages), 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Pieces | None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, held_out, lang_pred, score)``, one row per input row, no shuffle; score is the language's posterior."""
    out = F.coalesce(fold(F.col("doc_id")) == TEST_FOLD, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select("doc_id", out, F.lit(UNDECIDED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(model), "doc_id long, lang_pred string, score double").select("doc_id", out, "lang_pred", "score")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit_pieces(docs))
