"""Fuzzy line dedup by MinHash over character shingles.

Every different line with a visible character gets ``BANDS`` x ``ROWS`` minima over its ``SHINGLE``-character shingles (a shorter line is one
shingle), the number of its different shingles, and a sketch: four bits of each minimum. Lines that share a band are candidates.
They are first compared by number and sketch, which excludes a similar pair with a probability below ``MISS``: these travel with
the bands, and a line that can be similar to none of its bucket goes no further. What is left is verified by
exact Jaccard similarity of the shingle sets, and only then are texts fetched. Each line is compared with the smallest of its
bucket; then, in buckets that hold lines not connected yet, all pairs of such lines in bounded tiles. Links are joined by
distributed union-find (``graph.components``); of each component the first line stays.

At the threshold of 0.8 a pair shares a band with probability 1 - (1 - 0.8^5)^16 = 0.998, at 0.9 above 0.9999. Equal lines are always linked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.llm.graph import components, forest
from risklake.llm.simhash import _carried
from risklake.llm.tiles import tiled
from risklake.llm.tokens import mix
from risklake.session import discard, free_shuffles, materialise, tune

SHINGLE = 4  # characters; a power of two, hashed by doubling. One changed character breaks so many shingles
THRESHOLD = 0.8
BANDS, ROWS = 16, 5
TILE = 256
FEW = 24  # lines of a tile up to which pairs are compared one by one
SLICE = 4096  # shingles of a larger tile counted at a time
CHUNK = 1 << 17  # characters hashed at a time
PRODUCTS = 1 << 16  # products of shingles and a multiplier held at a time
CHARACTERS = 1 << 19  # characters of pairs or tiles compared at a time
PAIRED = 1 << 19  # shingles of pairs sorted at a time
BITS = 4096  # of a line's bitmap, which excludes pairs before they are sorted
LINES = 1024  # bitmaps made at a time
COMPARED = 1 << 12  # pairs of bitmaps compared at a time
AT_ONCE = 3  # bands shuffled at a time
DEALT = 1 << 16  # lines a task deals out at a time
PART = 200_000  # lines of buckets that a task compares
WHOLE = 4096  # lines of a bucket up to which numbers and sketches are compared in that task; what is left of it may still be cut into tiles
MISS = 1e-6
NIBBLES = 0x1111111111111111  # the lowest bit of each four
SEEN = 1 << 20  # lines a task remembers to have signed before it starts afresh
BROADCAST_LINES = 1 << 20  # candidate line ids (8 bytes each, 16 with a root) up to which they go to every executor
ROW_KEY = ["doc_id", "k1", "k2"]
MEMBERS = "band long, a long, h long, n int, sketch binary, near boolean"
BLANK = " \t\n\x0b\x0c\r"

_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_DOUBLED = [np.uint64(pow(int(_BASE), 1 << i, 1 << 64)) for i in range(SHINGLE.bit_length() - 1)]


def shingle_hashes(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of joined lines, and where each line's begin. A line shorter than a shingle has one hash, over itself."""
    h = points.astype(np.uint64)
    h += np.uint64(1)
    # beyond a line's end come zeros, so a short line is hashed alone: pad it to a shingle
    lack = np.maximum(SHINGLE - lengths, 0)
    if lack.any():
        h = np.insert(h, np.repeat(np.cumsum(lengths), lack), np.uint64(0))
    end = np.cumsum(lengths + lack)
    width = 1
    for base in _DOUBLED:
        wide = h[:-width] * base
        wide += h[width:]
        h, width = wide, width * 2
    inside = np.ones(len(h) + SHINGLE - 1, bool)  # hashes across two lines are left out
    for back in range(1, SHINGLE):
        inside[end - back] = False
    count = lengths + lack - (SHINGLE - 1)
    return mix(h[inside[: len(h)]]), np.cumsum(count) - count


def joined_bands(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band hashes per row of minima."""
    x = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(minima), 1))
    for r in range(rows):
        x = mix(x * _BASE ^ minima[:, r::rows])
    return x


def sketches(minima: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen to a number."""
    bits = mix(minima) >> np.uint64(60)
    wide = np.zeros((len(minima), -(-minima.shape[1] // 16) * 16), np.uint64)
    wide[:, : minima.shape[1]] = bits
    return np.bitwise_or.reduce(wide.reshape(len(minima), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)


def most_different(minima: int, threshold: float, miss: float = MISS) -> int:
    """Largest number of unequal fours of bits that a similar pair has, but for a probability of ``miss``."""
    equal = threshold + (1 - threshold) / 16
    tail = 0.0
    for k in range(minima, -1, -1):
        tail += math.comb(minima, k) * (1 - equal) ** k * equal ** (minima - k)
        if tail > miss:
            return k
    return 0


def signature(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima of each line (row), and the number of its different shingles."""
    h, first = shingle_hashes(points, lengths)
    size = np.diff(np.append(first, len(h)))
    minima = np.empty((len(_MULTIPLIERS), len(first)), np.uint64)
    for cut in _cuts(size, PRODUCTS):
        lo, at = first[cut.start], first[cut] - first[cut.start]
        part = h[lo : lo + size[cut].sum()]
        product = np.empty_like(part)
        for m, least in zip(_MULTIPLIERS, minima):
            np.minimum.reduceat(np.multiply(part, m, out=product), at, out=least[cut])
    # sorted by line, then by 44 bits of the hash: a rare collision makes a number one too small, which candidates allow for
    ordered = np.repeat(np.arange(len(lengths), dtype=np.uint64) << np.uint64(44), size)
    ordered |= h >> np.uint64(20)
    ordered.sort()
    new = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    return minima.T, np.diff(np.searchsorted(new, np.append(first, len(h)))) + (first == 0)


def line_id(line: str) -> int:
    """Spark's ``xxhash64`` of the line, as a signed long."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return h if h < 1 << 63 else h - (1 << 64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> a row for each line that the task has not signed yet."""
    seen, lines, held = set(), {}, 0
    for batch in batches:
        for text in batch.column(0):
            for line in (text.as_py() or "").split("\n"):
                if line.strip(BLANK) and (h := line_id(line)) not in seen:
                    if len(seen) >= SEEN:
                        seen = set()
                    seen.add(h)
                    lines[h] = line
                    held += len(line)
                    if held >= CHUNK:
                        yield _signatures(lines)
                        lines, held = {}, 0
    if lines:
        yield _signatures(lines)


def _signatures(lines: dict[int, str]) -> pa.RecordBatch:
    points = np.frombuffer("".join(lines.values()).encode("utf-32-le", "surrogatepass"), "<u4")
    minima, n = signature(points, np.array([len(x) for x in lines.values()]))
    columns = [pa.array(list(lines), pa.int64()), pa.array(n, pa.int32()), bytes_of(sketches(minima)), columns_of(joined_bands(minima, BANDS, ROWS))]
    return pa.RecordBatch.from_arrays(columns, ["h", "n", "sketch", "bands"])


def columns_of(rows: np.ndarray) -> pa.StructArray:
    """A struct of each row's numbers, so that a reader of some reads no others."""
    columns = np.ascontiguousarray(rows.T).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], [f"b{i}" for i in range(len(columns))])


def bands_type(bands: int) -> str:
    return f"struct<{', '.join(f'b{i}: bigint' for i in range(bands))}>"


def bytes_of(rows: np.ndarray) -> pa.Array:
    """Each row's numbers as bytes."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (8 * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def numbers(column: pa.Array) -> np.ndarray:
    """What ``bytes_of`` made, a row each."""
    if not len(column):
        return np.zeros((0, 1), np.uint64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64).reshape(len(column), -1)


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def similar(a: set[str], b: set[str], threshold: float) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    return jaccard(a, b) >= threshold


def hashed_all(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lines one after the other, and where each line's begin; a hash may be there more than once."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    return shingle_hashes(points, np.array([len(x) for x in lines], np.int64))


def similar_pairs(lines: list[str], a: np.ndarray, b: np.ndarray, threshold: float, shingled: Callable[[str], set], all_hashes: Callable[[list[str]], tuple]) -> np.ndarray:
    """Which index pairs of ``lines`` are similar.

    Each line gets a bitmap of its hashes: bits that differ are at most the shingles that differ, so too many exclude a pair.
    Hashes shared are then counted by sorting, on 44 bits of each; if those collide, a pair so near the threshold that two
    collisions could decide it is compared by its sets.
    """
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    h, first = all_hashes(lines)
    each = np.diff(np.append(first, len(h)))
    ordered = np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(44), each)
    ordered |= h >> np.uint64(20)
    ordered.sort()
    ordered = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
    size = np.bincount((ordered >> np.uint64(44)).astype(np.int64), minlength=len(lines))
    start = np.cumsum(size) - size
    whole = np.sort(h)
    whole = whole[np.concatenate([[True], whole[1:] != whole[:-1]])] >> np.uint64(20)
    slack = 2 if (whole[1:] == whole[:-1]).any() else 0
    # numbers alone decide most of what is not similar
    todo = np.flatnonzero(np.minimum(size[a], size[b]) + slack >= threshold * np.maximum(size[a], size[b]))
    bits = bitmaps(ordered, start, size)
    most = (1 - threshold) / (1 + threshold) + 1e-9
    for lo in range(0, len(todo), COMPARED):
        at = todo[lo : lo + COMPARED]
        differ = np.bitwise_count(bits[a[at]] ^ bits[b[at]]).sum(axis=1, dtype=np.int64)
        todo[lo : lo + COMPARED] = np.where(differ <= (size[a[at]] + size[b[at]] + 2 * slack) * most, at, -1)
    todo = todo[todo >= 0]
    ordered &= np.uint64((1 << 44) - 1)
    for cut in _cuts(size[a[todo]] + size[b[todo]], PAIRED):
        at = todo[cut]
        ends = np.stack([a[at], b[at]], axis=1).ravel()
        long = size[ends]
        first = np.cumsum(long) - long
        value = ordered[np.repeat(start[ends] - first, long) + np.arange(int(long.sum()))]
        value |= np.repeat(np.arange(len(ends), dtype=np.uint64) >> np.uint64(1) << np.uint64(44), long)
        value.sort()
        twice = value[1:][value[1:] == value[:-1]] >> np.uint64(44)
        both = np.bincount(twice.astype(np.int64), minlength=len(at))
        total = size[a[at]] + size[b[at]]
        out[at] = (both - slack) / (total - both + 2 * slack) >= threshold
        if slack:
            for i in at[~out[at] & ((both + 2) / np.maximum(total - both - 4, 1) >= threshold)]:
                out[i] = similar(shingled(lines[a[i]]), shingled(lines[b[i]]), threshold)
    return out


def bitmaps(ordered: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row of ``BITS`` bits for each line: those that some bits of its hashes (44 bits each, below the line's number) name."""
    out = np.empty((len(size), BITS // 64), np.uint64)
    bit = (ordered & np.uint64(BITS - 1)).astype(np.int64)
    for lo in range(0, len(size), LINES):
        n = min(LINES, len(size) - lo)
        flat = np.zeros((n, BITS), bool)
        cut = slice(start[lo], start[lo + n - 1] + size[lo + n - 1])
        flat[np.repeat(np.arange(n), size[lo : lo + n]), bit[cut]] = True
        out[lo : lo + n] = np.packbits(flat, axis=1).view(np.uint64)
    return out


def _cuts(weights: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of about ``limit`` in weight, one item at least."""
    total, at = np.concatenate([[0], np.cumsum(weights)]), 0
    while at < len(weights):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield slice(at, to)
        at = to


def _verify(threshold: float, shingled: Callable[[str], set], all_hashes: Callable[[list[str]], tuple]):
    """Pairs with both texts; those of one leader come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            weights = sum(pc.utf8_length(batch.column(c)).to_numpy().astype(np.int64) for c in (2, 3))
            for cut in _cuts(weights, CHARACTERS):
                leads = np.concatenate([[True], a[cut][1:] != a[cut][:-1]])
                lines = batch.column(2).slice(cut.start, cut.stop - cut.start).filter(pa.array(leads)).to_pylist()
                to = np.arange(cut.stop - cut.start) + len(lines)
                lines += batch.column(3).slice(cut.start, cut.stop - cut.start).to_pylist()
                ok = similar_pairs(lines, np.cumsum(leads) - 1, to, threshold, shingled, all_hashes)
                yield pa.RecordBatch.from_arrays([pa.array(a[cut][ok]), pa.array(b[cut][ok])], ["a", "b"])

    return run


def hashed(line: str) -> np.ndarray:
    """Distinct shingle hashes of one line."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.unique(shingle_hashes(points, np.array([len(points)]))[0])


def similarities(lines: list[str], hashes: Callable[[str], np.ndarray] = hashed) -> np.ndarray:
    """Jaccard similarity of all pairs of a tile: shared shingles are counted by products of slices of the line-by-shingle matrix."""
    sets = [hashes(line) for line in lines]
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    row, column = row[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        a, b = np.searchsorted(column, [lo, lo + SLICE])
        part = np.zeros((len(sets), SLICE), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    np.fill_diagonal(both, sizes)
    return both / (sizes[:, None] + sizes[None, :] - both)


def alike(lines: list[str], side: np.ndarray, threshold: float, hashes: Callable[[str], np.ndarray] = hashed) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a tile (or across its two sides) that are similar."""
    across = side.any()
    if len(lines) > FEW:
        like = np.triu(similarities(lines, hashes) >= threshold, 1)
        if across:
            like &= side[:, None] != side[None, :]
        return np.nonzero(like)
    sets = [hashes(line) for line in lines]
    pairs = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
        if not (across and side[i] == side[j]) and min(len(a), len(b)) >= threshold * max(len(a), len(b)) and (both := len(np.intersect1d(a, b, assume_unique=True))) / (len(a) + len(b) - both) >= threshold
    ]
    return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)


def _verify_tiles(threshold: float, most: int, shingled: Callable[[str], set], hashes: Callable[[str], np.ndarray], all_hashes: Callable[[list[str]], tuple]):
    """The pairs of a tile, or across two, that number and sketch allow; a forest of what is similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _carried(batches, "unit"):
            unit, text, h = part["unit"], part["text"], part["h"]
            met = [np.zeros((2, 0), np.int64), *meetings(unit, part["side"], part["root"], part["n"].astype(np.int64), _stacked(part["sketch"]), threshold, most)]
            x, y = np.concatenate(met, axis=1)
            sizes = _sizes(unit)
            of = np.repeat(np.arange(len(sizes)), sizes)
            # where most lines may be similar to many, the product of matrices costs less than pairs
            dense = np.bincount(of[x], minlength=len(sizes)) > FEW * sizes
            left, right = [], []
            start = np.cumsum(sizes) - sizes
            for i in np.flatnonzero(dense):
                lo, hi = start[i], start[i] + sizes[i]
                p, q = alike(text[lo:hi].tolist(), part["side"][lo:hi], threshold, hashes)
                left.append(h[lo:hi][p])
                right.append(h[lo:hi][q])
            pairs = np.flatnonzero(~dense[of[x]])
            pairs = pairs[np.argsort(of[x[pairs]], kind="stable")]
            x, y = x[pairs], y[pairs]
            length = np.array([len(t) for t in text])
            for cut in _cuts(length[x] + length[y], CHARACTERS):
                used, at = np.unique(np.concatenate([x[cut], y[cut]]), return_inverse=True)
                p, q = at[: cut.stop - cut.start], at[cut.stop - cut.start :]
                ok = similar_pairs(text[used].tolist(), p, q, threshold, shingled, all_hashes)
                left.append(h[x[cut][ok]])
                right.append(h[y[cut][ok]])
            if left:
                a, b = forest(np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _stacked(column: np.ndarray) -> np.ndarray:
    """Rows of numbers from their bytes."""
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def few(wanted: DataFrame) -> DataFrame:
    """Ids, sent to every executor if there are few of them; otherwise joined by shuffle."""
    return F.broadcast(wanted) if wanted.count() <= BROADCAST_LINES else wanted


def texts_of_lines(docs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    def texts(wanted: DataFrame) -> DataFrame:
        lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text")).select(F.xxhash64("text").alias("h"), "text")
        return lines.join(few(wanted), "h", "left_semi").dropDuplicates(["h"])

    return texts


def close(a: np.ndarray, b: np.ndarray, n: np.ndarray, sketch: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """Of index pairs, those that number and sketch allow to be similar."""
    out = np.minimum(n[a], n[b]) + 1 >= threshold * np.maximum(n[a], n[b])
    at = np.flatnonzero(out)
    x = sketch[a[at]] ^ sketch[b[at]]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    out[at] = np.bitwise_count(x & np.uint64(NIBBLES)).sum(axis=1) <= most
    return out


def meetings(unit: np.ndarray, side: np.ndarray, root: np.ndarray, n: np.ndarray, sketch: np.ndarray, threshold: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows, ordered by unit, that may be similar: of one unit, of different roots (and sides, if there are two)."""
    if not len(unit):
        return
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1, [len(unit)]])
    end = np.repeat(bounds[1:], np.diff(bounds))
    across = np.repeat(np.maximum.reduceat(side, bounds[:-1]) > 0, np.diff(bounds))
    at, step = np.arange(len(unit)), 1
    while True:  # each row with the one ``step`` further on, for all units at once
        at = at[at + step < end[at]]
        if not len(at):
            return
        to = at + step
        some = (root[at] != root[to]) & (~across[at] | (side[at] != side[to]))
        a, b = at[some], to[some]
        good = close(a, b, n, sketch, threshold, most)
        yield a[good], b[good]
        step += 1


def hopeful(unit: np.ndarray, side: np.ndarray, root: np.ndarray, n: np.ndarray, sketch: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """Rows of whole units, ordered by unit, that may be similar to another row of their unit, of another root (and side, if there are two)."""
    out = np.zeros(len(unit), bool)
    for a, b in meetings(unit, side, root, n, sketch, threshold, most):
        out[a] = out[b] = True
    return out


def _hopeful(threshold: float, most: int):
    """Hopeful rows of each unit. What is left of a unit is named by its rows, so that units with the same rows have one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _carried(batches, "unit"):
            keep = hopeful(part["unit"], part["side"], part["root"], part["n"].astype(np.int64), _stacked(part["sketch"]), threshold, most)
            unit, side, h, root, n = (part[c][keep] for c in ("unit", "side", "h", "root", "n"))
            if not len(unit):
                continue
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            own = mix(h.view(np.uint64) + side.astype(np.uint64) * _BASE)
            name = mix(np.add.reduceat(own, first) ^ mix(np.bitwise_xor.reduceat(mix(own + _BASE), first)))
            name = np.repeat(name, np.diff(np.append(first, len(unit))))
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(side), pa.array(h), pa.array(root), pa.array(n), pa.array(part["sketch"][keep], pa.binary())], ["unit", "side", "h", "root", "n", "sketch"])

    return run


def _dealt(parts: int):
    """Signed lines ``(h, n, sketch)`` and some of their bands -> rows ``(part, body)``: of each part of the buckets, (band, id, number, sketch) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= DEALT:
                    yield _bodies(held, parts)
                    held, size = [], 0
        if held:
            yield _bodies(held, parts)

    return run


def _bodies(batches: list[pa.RecordBatch], parts: int) -> pa.RecordBatch:
    h, n, sketch, *bands = (c.combine_chunks() for c in pa.Table.from_batches(batches).columns)
    band = np.column_stack([c.to_numpy().view(np.uint64) for c in bands])
    own = np.column_stack([h.to_numpy().view(np.uint64), n.to_numpy().astype(np.uint64), numbers(sketch)])
    part = (mix(band.ravel()) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)  # small ones are ordered by radix
    order = np.argsort(part, kind="stable")
    body = np.column_stack([band.ravel()[order], own[order // band.shape[1]]])
    filled, first = np.unique(part[order], return_index=True)
    offsets = np.append(first, len(body)) * (8 * body.shape[1])
    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(filled), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
    return pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), blobs.cast(pa.binary())], ["part", "body"])


def _members(threshold: float, most: int, width: int, whole: int):
    """Whole parts of the buckets -> lines that may be similar to another of their bucket, with the smallest id of those and whether it may be that one.

    A bucket of more than ``whole`` lines is handed on as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = [np.frombuffer(x, np.uint64).reshape(-1, width) for batch in batches for x in batch.column(1).to_pylist()]
        if not bodies:
            return
        rows = np.concatenate(bodies)
        del bodies
        order = np.argsort(band := np.ascontiguousarray(rows[:, 0]))
        rows = rows[order[_shared(band[order])]]  # most lines are alone in their bucket
        if not len(rows):
            return
        order = np.lexsort((rows[:, 1].view(np.int64), rows[:, 0]))
        band, h = rows[order, 0], rows[order, 1]
        new = np.concatenate([[True], (band[1:] != band[:-1]) | (h[1:] != h[:-1])])  # a line signed by two tasks is one
        order, band = order[new], band[new]
        order = order[_shared(band)]
        rows = rows[order]
        if not len(rows):
            return
        large = np.repeat(sizes := _sizes(rows[:, 0]), sizes) > whole
        small = np.flatnonzero(~large)
        picked = large.copy()
        zero = np.zeros(len(small), np.int8)
        picked[small] = hopeful(rows[small, 0], zero, rows[small, 1], rows[small, 2].astype(np.int64), rows[small, 3:], threshold, most)
        rows = rows[picked]
        if not len(rows):
            return
        sizes = _sizes(rows[:, 0])
        lead = np.repeat(np.cumsum(sizes) - sizes, sizes)  # ordered by id
        own, n = np.arange(len(rows)), rows[:, 2].astype(np.int64)
        near = (lead != own) & close(lead, own, n, rows[:, 3:], threshold, most)
        signed = rows.view(np.int64)
        for lo in range(0, len(rows), 1 << 14):
            cut = slice(lo, lo + (1 << 14))
            columns = [pa.array(signed[cut, 0]), pa.array(signed[lead[cut], 1]), pa.array(signed[cut, 1]), pa.array(n[cut].astype(np.int32)), bytes_of(rows[cut, 3:]), pa.array(near[cut])]
            yield pa.RecordBatch.from_arrays(columns, ["band", "a", "h", "n", "sketch", "near"])

    return run


def _sizes(ordered: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values."""
    return np.diff(np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]]))


def _shared(ordered: np.ndarray) -> np.ndarray:
    """Whether an ordered value is there more than once."""
    sizes = _sizes(ordered)
    return np.repeat(sizes > 1, sizes)


def bucket_members(signed: DataFrame, threshold: float, most: int) -> list[DataFrame]:
    """Written ``signed`` -> written ``(band, a, h, n, sketch, near)``, some bands in each: the lines of each bucket that may be similar to another of it.

    Numbers and sketches travel with the bands, so that chance meetings, which grow faster than the lines, end in the task
    that sees them. Bands go ``AT_ONCE`` at a time, each time freeing what was shuffled.
    """
    bands = [f"bands.{c}" for c in signed.schema["bands"].dataType.names]
    width = (signed.select((F.octet_length("sketch") / 8).cast("int")).first() or (1,))[0]
    parts = max(1, -(-signed.count() * AT_ONCE // PART))
    steps = []
    for low in range(0, len(bands), AT_ONCE):
        dealt = signed.select("h", "n", "sketch", *bands[low : low + AT_ONCE]).mapInArrow(_dealt(parts), "part int, body binary").repartition(parts, "part")
        step = materialise(dealt.mapInArrow(_members(threshold, most, 3 + width, WHOLE), MEMBERS), "line-members")
        free_shuffles(signed.sparkSession)
        steps.append(step)
    return steps


def line_links(signed: DataFrame, minima: int, texts_of: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD, shingled: Callable[[str], set] = shingles, hashes: Callable[[str], np.ndarray] = hashed, all_hashes: Callable[[list[str]], tuple] = hashed_all) -> DataFrame:
    """Written ``signed(h, n, sketch, bands)`` -> verified links ``(a, b)`` between ids of different lines; an id may be there more than once.

    ``minima`` is their number in a sketch; ``texts_of`` gives ``(h, text)`` of wanted ids, each once.
    """
    most = most_different(minima, threshold)
    steps = bucket_members(signed, threshold, most)
    members = steps[0]
    for more in steps[1:]:
        members = members.unionByName(more)
    near = materialise(members.where("near").select("a", F.col("h").alias("b")).distinct(), "line-near")
    # whoever is not near the leader may yet be compared with another
    texts = materialise(texts_of(members.select("h").distinct()), "line-texts")
    checked = _verified(near, texts, threshold, shingled, all_hashes)
    # a bucket whose members are all connected by now is done; so is one of two members, compared already. Of buckets with the
    # same members one is enough
    roots = materialise(components(checked).withColumnRenamed("node", "h"), "line-roots")
    placed = materialise(members.drop("a", "near").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")), "line-placed")
    discard(near, checked, *steps)
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h")).alias("y")).where("lo <> hi and n > 2")
    mixed = mixed.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band")
    open_ = materialise(placed.join(mixed, "band", "left_semi"), "line-rest")
    discard(placed)
    # in a large bucket, lines of the root that most have need not meet each other, and lines of very different sizes none at all
    chief = open_.groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg(F.max_by("root", F.struct("c", "root")).alias("chief"), F.sum("c").alias("c")).where(F.col("c") > TILE).select("band", "chief")
    chief = materialise(chief, "line-chief")
    large = materialise(open_.join(chief, "band").withColumn("joined", F.col("root") == F.col("chief")).drop("chief"), "line-large")
    # the number of shingles may be one too small: as if the ratio were a little lower
    size = F.floor(F.log(F.col("n") + 1.0) / -math.log(threshold * 0.98))
    columns = ["unit", "side", "h", "root", "n", "sketch"]
    cut = tiled(large, "band", F.xxhash64("h", F.lit(5)), size, 1, TILE, F.col("joined")).select(*columns)
    cut = cut.unionByName(open_.join(chief, "band", "left_anti").withColumn("unit", F.xxhash64("band")).withColumn("side", F.lit(0)).select(*columns))
    cut = cut.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(_hopeful(threshold, most), "unit long, side int, h long, root long, n int, sketch binary")
    units = materialise(cut.distinct(), "line-units")
    discard(open_, chief, large)
    more = units.join(texts, "h").repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(_verify_tiles(threshold, most, shingled, hashes, all_hashes), "a long, b long")
    # the roots of the first links stand for those
    out = materialise(roots.where("h <> root").select(F.col("h").alias("a"), F.col("root").alias("b")).unionByName(more), "line-links")
    discard(roots, texts, units)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, shingled: Callable[[str], set], all_hashes: Callable[[list[str]], tuple]) -> DataFrame:
    """The pairs ``(a, b)`` that are similar, written."""
    met = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("h").alias("b"), F.col("text").alias("t")), "b")
    return materialise(met.select("a", "b", "s", "t").sortWithinPartitions("a").mapInArrow(_verify(threshold, shingled, all_hashes), "a long, b long"), "line-checked")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("k1", F.xxhash64(F.lit(1), text)).withColumn("k2", F.xxhash64(F.lit(2), text))


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``keyed`` docs -> ``(doc_id, k1, k2, gone)``: sorted numbers of the lines to remove, for rows that lose any.

    Of each component the line of the smallest (doc_id, text hash, line number) stays, null ids last. Rows with the same id and
    text are one document listed more than once: they keep and lose the same lines.
    """
    signed = materialise(docs.select("text").mapInArrow(_signed, f"h long, n int, sketch binary, bands {bands_type(BANDS)}"), "lines-signed")
    links = line_links(signed, BANDS * ROWS, texts_of_lines(docs), threshold)
    discard(signed)
    roots = materialise(components(links).withColumnRenamed("node", "h"), "line-roots")
    discard(links)
    lines = docs.select(*ROW_KEY, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "x")).where(F.ltrim("x", F.lit(BLANK)) != "")
    place = F.struct(F.col("doc_id").isNull().alias("last"), *ROW_KEY, "line")
    named = materialise(lines.select(F.xxhash64("x").alias("h"), place.alias("place")).join(few(roots), "h", "left").select(F.coalesce("root", "h").alias("root"), "place"), "line-places")
    kept = materialise(named.groupBy("root").agg(F.min("place").alias("kept"), F.count("*").alias("n")).where("n > 1").select("root", "kept"), "line-kept")
    gone = named.join(kept, "root").where(F.col("place") != F.col("kept"))
    out = materialise(gone.groupBy(*[F.col(f"place.{k}").alias(k) for k in ROW_KEY]).agg(F.array_sort(F.collect_set("place.line")).alias("gone")), "line-gone")
    discard(roots, named, kept)
    return out


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> its columns with ``text`` less the repeated lines, plus ``n_lines`` and ``n_gone``, one row per input row.

    Lines are split at newlines; blank lines always stay. A text that loses nothing is returned as it is, a null text
    stays null, a text of which no line is left becomes empty. Columns named like the added ones are replaced. Empty table: no rows.
    A very long line is signed in a chunk of its own; a very long text is read line by line. Of lines with equal places (repeated rows)
    all stay or all go.
    """
    rows = keyed(docs.drop("k1", "k2", "gone", "n_lines", "n_gone"))
    gone = repeated_lines(rows, threshold)
    # null ids are matched by their text alone
    met = rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["k1"] == gone["k1"]) & (rows["k2"] == gone["k2"]), "left").select(*[rows[c] for c in rows.columns], gone["gone"])
    parts = F.split("text", "\n")
    left = F.array_join(F.transform(F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: ~F.array_contains("gone", p["i"])), lambda p: p["x"]), "\n")
    return met.withColumn("n_lines", F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")).withColumn("n_gone", F.coalesce(F.size("gone"), F.lit(0)).cast("long")).withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)).drop("gone", "k1", "k2")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_gone", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
