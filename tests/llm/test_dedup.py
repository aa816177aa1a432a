from __future__ import annotations

import numpy as np
import pytest

from risklake.llm import line_dedup, simhash, substring
from risklake.llm.graph import components, forest
from risklake.llm.queries import QUERIES
from tests.llm import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_simhash_equals_all_pairs(spark):
    docs = fx.awkward_docs()
    got = simhash.simhash_components(fx.clashing(spark.createDataFrame(docs, fx.SCHEMA))).collect()
    classes = fx.near_classes([(d[0], d[1]) for d in docs])
    least = {}
    for d, (_, c) in zip(docs, classes):
        least[c] = min((x for x in (least.get(c), d[0]) if x is not None), default=None)
    want = sorted(((d[0], f if f < 1 << 63 else f - (1 << 64), least[c]) for d, (f, c) in zip(docs, classes)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("tile", [2, 5, 512])
def test_simhash_tiles_lose_no_link(spark, tile):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = list({int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 63, (30, 2))})
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), tile=tile)
    roots = {r.node: r.root for r in components(links).collect()}
    parent = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = fx.find(parent, i), fx.find(parent, j)
                parent[max(a, b)] = min(a, b)
    want = {}
    for i, p in enumerate(prints):
        want.setdefault(fx.find(parent, i), []).append(p)
    assert {p: roots.get(p, p) for p in prints} == {p: min(g) for g in want.values() for p in g}


def test_simhash_keep_leaves_one_of_each(spark):
    docs = fx.awkward_docs()
    kept = simhash.simhash_keep(spark.createDataFrame(docs, fx.SCHEMA)).select("doc_id", "text").collect()
    classes = fx.near_classes([(d[0], d[1]) for d in docs])
    assert len(kept) == len({c for _, c in classes})
    least = {}
    for d, (_, c) in zip(docs, classes):
        least.setdefault(c, []).append(d[0])
    assert sorted((r.doc_id for r in kept), key=repr) == sorted((min((i for i in ids if i is not None), default=None) for ids in least.values()), key=repr)


def test_near_stage_equals_all_jaccard_pairs(spark):
    import corpus_pipeline

    rng = __import__("random").Random(6)
    docs = [d for d in fx.awkward_docs() if d[0] is not None]
    for i in range(60):
        w = fx.phrase(rng, 150).split()
        docs.append((1000 + 2 * i, " ".join(w), "en", "a", 1))
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "Other"
        docs.append((1001 + 2 * i, " ".join(w), "en", "a", 1))
    sets = []
    for d in docs:
        w = fx.words((d[1] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = fx.find(parent, i), fx.find(parent, j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(docs):
        c = fx.find(parent, i)
        least[c] = min(least.get(c, d[0]), d[0])
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, fx.SCHEMA), SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(least.values())


def test_components_of_a_long_chain(spark):
    n = 300
    order = np.random.default_rng(1).permutation(n)
    edges = [(int(a), int(b)) for a, b in zip(range(n - 1), range(1, n))]
    got = {r.node: r.root for r in components(spark.createDataFrame([edges[i] for i in order if i < n - 1], "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n), 0)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_keeps_connections():
    a, b = forest(np.array([5, 9, 2, 7]), np.array([9, 2, 3, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {3: 2, 5: 2, 9: 2, 8: 7}


@pytest.mark.parametrize("k, seed", [(35, 8), (5, 2), (7, 7), (6, 1)])
def test_substring_equals_window_count(spark, k, seed):
    docs = fx.awkward_docs()
    df = fx.clashing(spark.createDataFrame(docs, fx.SCHEMA))
    out = substring.remove_repeats(df, k, seed).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=repr) == fx.substring_dedup([(d[0], d[1]) for d in docs], k)
    for r in out:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(s.end - s.start >= k for s in r.spans)
        assert len(fx.words(r.kept)) == r.n_words - r.n_removed


def test_lines_equal_all_pairs(spark):
    docs = [d for d in fx.awkward_docs() if d[0] is not None]
    docs = list({d[0]: d for d in docs}.values())  # the plain version knows unique ids only
    docs += [(500 + i, f"a line that is nearly the same every time, number {i % 7}\nand {fx.phrase(__import__('random').Random(i % 5), 20)}", "en", "a", 1) for i in range(60)]
    out = line_dedup.dedup_lines(fx.clashing(spark.createDataFrame(docs, fx.SCHEMA)))
    got = {r.doc_id: (r.text, r.n_gone) for r in out.select("doc_id", "text", "n_gone").collect()}
    want = dict(fx.fuzzy_lines([(d[0], d[1]) for d in docs], 0.8))
    assert {i: t for i, (t, _) in got.items()} == want
    assert len(got) == len(docs)


def test_short_lines_that_differ_by_one_character(spark):
    pairs = [("Printed in the reading room on the 3rd of May, sheet 7", "Printed in the reading room on the 3rd of May, sheet 9"), ("Subscribe to our weekly letter; issue 41 is out now", "Subscribe to our weekly letter; issue 42 is out now"), ("All visitors sign the book at gate 5 before noon", "All visitors sign the book at gate 6 before noon")]
    docs = [(i, x) for i, x in enumerate(x for p in pairs for x in p)]
    got = {r.doc_id: r.n_gone for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i % 2 for i in range(6)}


def test_lines_of_awkward_rows(spark):
    docs = fx.awkward_docs()
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, fx.SCHEMA)).collect()
    assert len(out) == len(docs)
    twins = [r.text for r in out if r.doc_id == 13]
    assert len(twins) == 2 and twins[0] == twins[1]  # one document listed twice
    assert [r.text for r in out if r.doc_id == 4] == [None]
    kept = [line for r in out if r.doc_id is not None and r.doc_id != 13 for line in set((r.text or "").split("\n")) if line.strip()]
    assert len(kept) == len(set(kept))


def test_tiles_of_lines_find_what_the_leader_misses(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "TILE", 3)
    rng = __import__("random").Random(4)
    base = fx.phrase(rng, 40)
    # a drifting family: neighbours are alike, the ends are not
    lines, w = [], base.split()
    for i in range(25):
        w = w[:]
        w[(3 * i) % len(w)] = f"n{i}x"
        lines.append(" ".join(w))
    docs = [(i, x) for i, x in enumerate(lines)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(fx.fuzzy_lines(docs, 0.8))


def test_chance_meetings_of_lines_go_no_further(spark, monkeypatch):
    rng = __import__("random").Random(8)
    stems = ["tion", "the", "her", "and", "ou", "st", "ly", "er"]
    lines = list(dict.fromkeys("".join(rng.choice(stems) + " " * (rng.random() < 0.4) for _ in range(rng.randrange(30, 120))).strip() for _ in range(600)))
    lines += [f"{x} {i % 10}" for i, x in enumerate(lines[:20])]
    written = {}

    def counted(df, name, made=line_dedup.materialise):
        out = made(df, name)
        written.setdefault(name, []).extend(out.collect() if name in ("lines-signed", "line-members") else [])
        return out

    monkeypatch.setattr(line_dedup, "materialise", counted)
    docs = [(i, x) for i, x in enumerate(lines)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(fx.fuzzy_lines(docs, 0.8))
    times = __import__("collections").Counter(b for b, _ in {(b, r.h) for r in written["lines-signed"] for b in r.bands})
    meetings = sum(n for n in times.values() if n > 1)
    assert meetings > 2000
    assert 0 < len(written["line-members"]) < meetings / 2


@pytest.mark.parametrize("tile", [3, 256])
def test_members_of_buckets_equal_all_pairs(tile):
    rng = np.random.default_rng(5)
    width, most = 2, line_dedup.most_different(32, 0.8)
    rows = []
    for band in range(40):
        base = rng.integers(0, 1 << 63, width, dtype=np.uint64)
        for h in rng.choice(1000, rng.integers(1, 7), replace=False):
            sketch = base if rng.random() < 0.5 else rng.integers(0, 1 << 63, width, dtype=np.uint64)
            rows += [[band, h, rng.integers(50, 80), *sketch]] * rng.integers(1, 3)
    rows = np.array(rows, np.uint64)[rng.permutation(len(rows))]
    batch = line_dedup.pa.RecordBatch.from_arrays([line_dedup.pa.array([0, 0]), line_dedup.pa.array([x.tobytes() for x in (rows[:50], rows[50:])])], ["part", "body"])
    got = {(r["band"], r["a"], r["h"], r["near"]) for b in line_dedup._members(0.8, most, 3 + width, tile)([batch]) for r in b.to_pylist()}

    def alike(x, y):
        unequal = sum((int(x[k]) >> s & 15) != (int(y[k]) >> s & 15) for k in (3, 4) for s in range(0, 64, 4))
        return min(x[2], y[2]) + 1 >= 0.8 * max(x[2], y[2]) and unequal <= most

    want = set()
    for band in range(40):
        all_ = sorted({tuple(r.tolist()) for r in rows if r[0] == band}, key=lambda r: r[1])
        kept = [x for x in all_ if len(all_) > tile or any(x is not y and alike(x, y) for y in all_)] if len(all_) > 1 else []
        want |= {(band, kept[0][1], x[1], x is not kept[0] and alike(x, kept[0])) for x in kept}
    assert got == want


def test_similar_pairs_equal_sets(monkeypatch):
    monkeypatch.setattr(line_dedup, "PAIRED", 300)
    rng = __import__("random").Random(11)
    lines = ["", "a", "ab", "abc", "abcd", "abcde", "\0", "\0\0", "\ud800 alone", "naïve 🙂🙂🙂🙂 line"]
    for _ in range(80):
        w = fx.phrase(rng, rng.randrange(1, 25)).split()
        lines.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
            lines.append(" ".join(w))
    a, b = map(np.ravel, np.meshgrid(np.arange(len(lines)), np.arange(len(lines))))

    def plain(x, y):
        x, y = ({t[i : i + 4] for i in range(max(1, len(t) - 3))} for t in (x, y))
        return 5 * len(x & y) >= 4 * len(x | y)

    got = line_dedup.similar_pairs(lines, a, b, 0.8, line_dedup.shingles, line_dedup.hashed_all)
    assert got.tolist() == [plain(lines[i], lines[j]) for i, j in zip(a, b)]


def test_pairs_that_cannot_be_similar_are_not_sorted(monkeypatch):
    rng = __import__("random").Random(5)
    lines = [" ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    lines += [x[: len(x) * k // 10] for x in lines[:20] for k in (6, 7, 9)] + ["", "a"]
    a, b = map(np.ravel, np.meshgrid(np.arange(len(lines)), np.arange(len(lines))))
    sorted_, sets = [], []

    def cuts(weights, limit, made=line_dedup._cuts):
        sorted_.append(len(weights))
        return made(weights, limit)

    monkeypatch.setattr(line_dedup, "_cuts", cuts)
    monkeypatch.setattr(line_dedup, "LINES", 7)
    monkeypatch.setattr(line_dedup, "COMPARED", 100)
    got = line_dedup.similar_pairs(lines, a, b, 0.8, lambda x: sets.append(x) or line_dedup.shingles(x), line_dedup.hashed_all)
    every = [line_dedup.shingles(x) for x in lines]
    want = [line_dedup.similar(every[i], every[j], 0.8) for i, j in zip(a, b)]
    assert got.tolist() == want
    assert sum(want) <= sorted_[0] < sum(want) * 1.5
    assert not sets  # nothing collides, so none needs its sets


def test_texts_of_candidates_are_fetched_once(spark):
    docs = [(i, f"a line of a family, all the same but for what is at its end {i % 9}\nand {fx.phrase(__import__('random').Random(i % 5), 20)}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    signed = line_dedup.materialise(df.select("text").mapInArrow(line_dedup._signed, f"h long, n int, sketch binary, bands {line_dedup.bands_type(line_dedup.BANDS)}"), "signed")
    calls = []

    def texts(wanted, made=line_dedup.texts_of_lines(df)):
        calls.append(sorted(r.h for r in wanted.collect()))
        return made(wanted)

    links = line_dedup.line_links(signed, line_dedup.BANDS * line_dedup.ROWS, texts).collect()
    assert len(calls) == 1 and len(calls[0]) == len(set(calls[0]))
    ids = {line_dedup.line_id(x) for _, t in docs for x in t.split("\n") if x.startswith("a line")}
    assert {r.a for r in links} | {r.b for r in links} >= ids


def test_tiles_compare_lines_that_are_not_connected(monkeypatch):
    lines = [f"the same line with a number at its end, {i}" for i in range(6)] + [f"another family of lines, number {i} of them" for i in range(4)]
    signed = line_dedup._signatures(dict(enumerate(lines))).to_pylist()
    compared = []

    def counted(texts, a, b, *more, made=line_dedup.similar_pairs):
        compared.extend(zip(a, b))
        return made(texts, a, b, *more)

    monkeypatch.setattr(line_dedup, "similar_pairs", counted)
    roots = [0, 0, 0, 0, 0, 5, 6, 6, 6, 6]  # of the first family one is not connected yet
    rows = [{"unit": 1, "side": 0, "h": r["h"], "root": roots[r["h"]], "n": r["n"], "sketch": r["sketch"], "text": lines[r["h"]]} for r in signed]
    schema = line_dedup.pa.schema([("unit", "int64"), ("side", "int32"), ("h", "int64"), ("root", "int64"), ("n", "int32"), ("sketch", "binary"), ("text", "string")])
    run = line_dedup._verify_tiles(0.8, line_dedup.most_different(80, 0.8), line_dedup.shingles, line_dedup.hashed, line_dedup.hashed_all)
    links = [(r["a"], r["b"]) for b in run(iter([line_dedup.pa.RecordBatch.from_pylist(rows, schema)])) for r in b.to_pylist()]
    assert sorted(links) == [(i, 0) for i in range(1, 6)]
    assert 0 < len(compared) <= 5


def test_lines_of_each_blank_and_their_number(spark):
    docs = [(0, None), (1, ""), (2, "\n"), (3, " \t\x0b\n\r\x0c\na line with words"), (4, "\xa0\n\u2003 \na line with words\n\xa0")]
    got = {r.doc_id: (r.n_lines, r.n_gone, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: (0, 0, None), 1: (1, 0, ""), 2: (2, 0, "\n"), 3: (3, 0, docs[3][1]), 4: (4, 2, "\xa0\n\u2003 ")}


@pytest.mark.parametrize("call", [simhash.simhash_components, simhash.simhash_keep, substring.remove_repeats, line_dedup.dedup_lines])
def test_empty_tables(spark, call):
    assert call(spark.createDataFrame([], fx.SCHEMA)).count() == 0


def test_queries_over_small_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op2_substring_dedup"](spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert fx.rows_of(got) == fx.substring_dedup(docs, 35)
    ones = QUERIES["op1_simhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in ones} == {i: f"{fx.fingerprint(t):016x}" for i, t in docs}
    assert QUERIES["op10_line_dedup"](spark, SF).count() == len(docs)
