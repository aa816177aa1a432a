"""Fill-in-the-middle: texts cut twice at token bounds and put into prefix-suffix-middle order.

A token is a run of visible characters with the blanks before it, or the blanks that end a text. The bytes of a chunk of texts get
character classes (blank, first byte of a character, further byte; each also as the last byte of its token) and a wavelet matrix over
them. Rank queries per class add up to the token bounds, or the characters, before a place; bisection on those sums finds the two
places where a text is cut, for all texts of the chunk at once. Where and whether a text is cut comes from a keyed hash of its id.

Null texts are empty; a text without tokens, one that holds a marker and one that the hash leaves out stay as they are (``plain``).
Both cuts may meet (empty middle) or lie at an end. A null id is hashed as an empty one; rows are handled one by one, so repeated
rows come out alike, an empty table gives none and other columns are ignored. A very long text is a chunk of its own: memory is linear
in the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.llm.tokens import CHUNK_BYTES, chunks, text_bytes
from risklake.session import tune

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
MARKERS = (b"<P>", b"<S>", b"<M>")
BLANK, FIRST, FURTHER = 0, 1, 2
LAST = 4  # added to the class of the last byte of a token
BITS = 3
ENDS = (BLANK + LAST, FIRST + LAST, FURTHER + LAST)
STARTS = (BLANK, FIRST, BLANK + LAST, FIRST + LAST)  # one for each character
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_CLASS = np.full(256, FIRST, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
_CLASS[0x80:0xC0] = FURTHER


class BitVector:
    """Bits in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(self.rank(np.array([len(bits)]))[0])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Symbols of ``bits`` bits, one bit vector for each, highest bit first; each level puts the zeros of the last one first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.bits = [], bits
        for b in reversed(range(bits)):
            ones = (symbols >> b & 1).astype(bool)
            self.levels.append(BitVector(ones))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``at``."""
        lo, hi = np.zeros_like(at), at
        for b, level in zip(reversed(range(self.bits)), self.levels):
            if symbol >> b & 1:
                lo, hi = level.zeros + level.rank(lo), level.zeros + level.rank(hi)
            else:
                lo, hi = lo - level.rank(lo), hi - level.rank(hi)
        return hi - lo

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)

    def shortest(self, symbols: tuple[int, ...], wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest place in ``lo`` to ``hi`` before which ``wanted`` of the symbols occur, by bisection on ranks."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            enough = self.count(symbols, mid) >= wanted
            hi = np.where(open_ & enough, mid, hi)
            lo = np.where(open_ & ~enough, mid + 1, lo)
        return lo


def classes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class of each byte. A token ends before a blank that follows a visible byte, and with its text."""
    out = _CLASS[buf]
    visible = out != BLANK
    last = np.zeros(len(buf), bool)
    last[:-1] = visible[:-1] & ~visible[1:]
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return out + LAST * last.astype(np.uint8)


def draws(doc_id: int | None, seed: int) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def _cut(seed: int, fim_percent: int, spm_percent: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(1), limit):
                ids = batch.column(0)[lo:hi]
                yield _rearranged(ids, batch.column(1)[lo:hi], seed, fim_percent, spm_percent)

    return run


def _rearranged(ids: pa.Array, texts: pa.Array, seed: int, fim_percent: int, spm_percent: int) -> pa.RecordBatch:
    buf, offsets = text_bytes(texts)
    start, end = offsets[:-1], offsets[1:]
    matrix = WaveletMatrix(classes(buf, offsets), BITS)
    ended = matrix.count(ENDS, offsets)
    tokens = np.diff(ended)
    h = np.array([draws(i, seed) for i in ids.to_pylist()], np.int64).reshape(-1, 4)
    a, b = h[:, 0] % (tokens + 1), h[:, 1] % (tokens + 1)
    cuts = [matrix.shortest(ENDS, ended[:-1] + k, start, end) for k in (np.minimum(a, b), np.maximum(a, b))]
    chars = [matrix.count(STARTS, at) for at in (start, *cuts)]
    raw, form, output = buf.tobytes(), [], []
    for i, (s, x, y, e) in enumerate(zip(start.tolist(), cuts[0].tolist(), cuts[1].tolist(), end.tolist())):
        text = raw[s:e]
        if s == e or h[i, 2] % 100 >= fim_percent or any(m in text for m in MARKERS):
            form.append("plain")
            output.append(text)
            continue
        prefix, middle, suffix = raw[s:x], raw[x:y], raw[y:e]
        spm = h[i, 3] % 100 < spm_percent
        form.append("spm" if spm else "psm")
        output.append(b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle if spm else b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle)
    plain = np.array([f == "plain" for f in form], bool)
    sizes = [pa.array(np.diff(chars, axis=0)[k], pa.int64(), mask=plain) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([ids, pa.array(tokens, pa.int64()), pa.array(form, pa.string()), *sizes, pa.array(output, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row per input row, no shuffle.

    ``n`` counts tokens. Of a hundred hashes ``fim_percent`` are cut, and ``spm_percent`` of those put the suffix first
    (``<S>suffix<P>prefix<M>middle``), the rest the prefix (``<P>prefix<S>suffix<M>middle``).
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(seed, fim_percent, spm_percent, CHUNK_BYTES), OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from what came out and its form."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "spm", F.concat(part[2], part[3], part[1])).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(tune(spark).read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w, [('0x' || s[8 * i + 1:8 * i + 8])::UBIGINT FOR i IN range(4)] AS h FROM d),
c AS (SELECT *, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS x, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS y,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:x], '') AS prefix, array_to_string(w[x + 1:y], '') AS middle, array_to_string(w[y + 1:], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(output) AS output_sha256, sha256(prefix || middle || suffix) AS restored_sha256
FROM o"""
