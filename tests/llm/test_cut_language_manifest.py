"""Fill-in-the-middle, language identification and the Merkle manifest against plain re-statements."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklake.llm import fill_middle, language_id, merkle
from risklake.llm.queries import ORACLE_SQL
from tests.llm import fixtures as fx

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def odd_texts():
    rng = random.Random(5)
    odd = ["", " ", "\n\n", "a", " a", "a ", "a<P>b", "<S", "x <M> y", "é 😀 ß\x0b\x0cend ", None, "w" * 5000, "P>S>M> <P <S <M", "\x00 \x00a"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(odd * 4)] + [(None, "no id here at all", "en", "s", 1)] * 2
    return rows + [(500 + i, "".join(rng.choice("ab \n\té😀") for _ in range(rng.randrange(200))), "en", "s", 1) for i in range(150)]


# ---------------------------------------------------------------- fill in the middle


def plain_fill(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    x, y = sorted(v % (len(units) + 1) for v in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    a, b, c = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@pytest.mark.parametrize("chunk", [64, 1 << 21])
def test_fill_middle_equals_plain_cutting(spark, monkeypatch, chunk):
    rows = odd_texts() + fx.awkward_docs()
    monkeypatch.setattr(fill_middle, "CHUNK_BYTES", chunk)
    docs = fx.clashing(spark.createDataFrame(rows, fx.SCHEMA))
    got = fill_middle.fill_middle(docs)
    assert fx.rows_of(got) == sorted((plain_fill(r[0], r[1]) for r in rows), key=repr)
    back = got.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert fx.rows_of(back) == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    assert {r.form for r in got.collect()} == {"plain", "spm", "psm"}


def test_fill_middle_sql_on_odd_texts(spark):
    rows = [r for r in odd_texts() + fx.awkward_docs() if "\x00" not in (r[1] or "")]
    docs = spark.createDataFrame(rows, fx.SCHEMA)
    got = fill_middle.fill_middle(docs)
    got = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256))
    assert fx.rows_of(got) == sorted(fx.duck(documents=docs).execute(ORACLE_SQL["op11_fill_middle"]).fetchall(), key=repr)


def test_fill_middle_of_an_empty_table(spark):
    assert fill_middle.fill_middle(spark.createDataFrame([], fx.SCHEMA)).count() == 0


def test_fill_middle_of_a_very_long_text(spark):
    text = "word " * 400_000 + "é" * 100_000
    for i in range(40):
        got = fill_middle.fill_middle(spark.createDataFrame([(i, text)], "doc_id long, text string")).first()
        if got.form != "plain":
            break
    assert tuple(got) == plain_fill(i, text)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_wavelet_matrix_ranks(n):
    symbols = np.random.default_rng(n).integers(0, 7, n).astype(np.uint8)
    matrix = fill_middle.WaveletMatrix(symbols, 3)
    at = np.arange(n + 1)
    for s in range(8):
        want = np.concatenate([[0], np.cumsum(symbols == s)])
        assert (matrix.rank(s, at) == want).all()
    every = np.concatenate([[0], np.cumsum(np.isin(symbols, (1, 5)))])
    wanted = np.arange(every[-1] + 1)
    found = matrix.shortest((1, 5), wanted, np.zeros_like(wanted), np.full_like(wanted, n))
    assert (found == np.searchsorted(every, wanted)).all()


# ---------------------------------------------------------------- Merkle manifest


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def plain_tree(level):
    proofs, owners = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        up, above = [], []
        for k in range(0, len(level), 3):
            run = level[k : k + 3]
            for j in range(len(run)):
                for o in owners[k + j]:
                    proofs[o].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H("".join(run)))
            above.append([o for own in owners[k : k + 3] for o in own])
        level, owners = up, above
    return level[0], proofs


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda t: t[:3])
    trees = [plain_tree([t[2] for t in by[s]]) for s in sources]
    root, top = plain_tree([t[0] for t in trees])
    out = []
    for s, (subroot, proofs), above in zip(sources, trees, top):
        for (_, _, leaf, r), proof in zip(by[s], proofs):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = plain_leaf(r, r[1].replace("\n", "") if cut and r[1] is not None else r[1])
            for left, right in proof + above:
                now = H(left + now + right)
            out.append((r[0], leaf, subroot, root, H("".join(a + b for a, b in proof + above)), now, now == root))
    return sorted(out, key=repr)


def manifest_rows(spark, docs):
    made = merkle.manifest(docs).withColumn("f", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    x = merkle.hexed
    return fx.rows_of(made.select("doc_id", x(F.col("leaf")), x(F.col("subroot")), x(F.col("root")), F.sha2(merkle.proof_text(F.col("proof")), 256), "f", F.col("f") == x(F.col("root"))))


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_manifest_equals_plain_trees(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rng = random.Random(8)
    rows = fx.awkward_docs() + [(1000 + i, f"t{i}\nu", None, rng.choice(["big", "big", "big", "é", "Z", "z", "", f"one{i}"]), i) for i in range(120)]
    got = manifest_rows(spark, fx.clashing(spark.createDataFrame(rows, fx.SCHEMA)))
    assert got == plain_manifest(rows)
    assert any(r[-1] for r in got) and any(not r[-1] for r in got)


def test_manifest_sql_on_awkward_rows(spark):
    docs = spark.createDataFrame([r for r in fx.awkward_docs() if r[0] != 12], fx.SCHEMA)
    assert manifest_rows(spark, docs) == sorted(fx.duck(documents=docs).execute(ORACLE_SQL["op13_merkle_manifest"]).fetchall(), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "a\nb", "en", "s", i) for i in range(n)]
    assert manifest_rows(spark, spark.createDataFrame(rows, fx.SCHEMA)) == (plain_manifest(rows) if rows else [])


def test_a_changed_proof_does_not_lead_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "abc"[i % 3], i) for i in range(30)], fx.SCHEMA)
    made = merkle.manifest(docs)
    step = F.struct(F.col("proof")[0]["r"].alias("l"), F.col("proof")[0]["l"].alias("r"))  # neighbours on the wrong side
    swapped = F.concat(F.array(step), F.expr("slice(proof, 2, size(proof))"))
    assert made.where(merkle.folded(F.col("leaf"), swapped) == merkle.hexed(F.col("root"))).where("proof[0].l <> proof[0].r").count() == 0
    assert made.where(merkle.folded(F.col("leaf"), F.col("proof")) == merkle.hexed(F.col("root"))).count() == 30


# ---------------------------------------------------------------- language identification


def cuttings(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        for rest in cuttings(word[n:]):
            yield [word[:n], *rest]


def small_model():
    pieces = sorted({bytes([b]) for b in b" abcn"} | {b" a", b"ab", b"abc", b"bc", b" ab", b"an", b"ana", b"nan", b" banana"})
    logs = np.log(np.random.default_rng(4).dirichlet(np.ones(len(pieces)), 2).T)
    return pieces, logs


@pytest.mark.parametrize("short", [0, 5, 20])
def test_words_sum_over_all_segmentations(monkeypatch, short):
    pieces, logs = small_model()
    words = [b" banana", b" abcabc", b" a", b" c", b" abab"]
    monkeypatch.setattr(language_id, "SHORT", short)
    got = language_id.word_scores(language_id.Lattice(pieces), logs, words)
    for w, row in zip(words, got):
        for k in range(2):
            want = sum(math.exp(sum(logs[pieces.index(p), k] for p in cut)) for cut in cuttings(w) if all(p in pieces for p in cut))
            assert row[k] == pytest.approx(math.log(want))


@pytest.mark.parametrize("short", [0, 5, 20])
def test_expected_uses_are_those_of_all_segmentations(monkeypatch, short):
    monkeypatch.setattr(language_id, "SHORT", short)
    pieces, logs = small_model()
    words, times, language = [b" banana", b" abcabc", b" a"], np.array([2, 1, 5]), np.array([0, 1, 1])
    got = np.zeros(logs.shape)
    for lang, piece, uses in language_id.expected(language_id.Lattice(pieces), logs, words, language, times):
        np.add.at(got, (piece, lang), uses)
    want = np.zeros(logs.shape)
    for w, n, k in zip(words, times, language):
        cuts = [[pieces.index(p) for p in cut] for cut in cuttings(w) if all(p in pieces for p in cut)]
        odds = np.array([math.exp(sum(logs[p, k] for p in cut)) for cut in cuts])
        for cut, share in zip(cuts, odds / odds.sum()):
            for p in cut:
                want[p, k] += n * share
    assert got == pytest.approx(want)


def test_long_words_need_not_fit_one_lattice(monkeypatch):
    monkeypatch.setattr(language_id, "UNIT", 7)
    import pyarrow as pa

    doc, which, hashes, _, words = language_id.units(pa.array(["abcdefghijklmnopq x", None, "", "hijklmn x"]))
    assert [words[i] for i in which] == [b" abcdefg", b" hijklmn", b" opq", b" x", b" hijklmn", b" x"]
    assert doc.tolist() == [0, 0, 0, 0, 3, 3]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op12_language_id(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    met = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = met.where("lang = lang_pred").count()
    assert right >= 0.98 * met.count() > 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got.collect())


def test_language_of_awkward_rows(spark):
    train = [(i, t, lang, "s", 1) for i in range(40) for t, lang in (("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"))]
    rows = train + [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "12 + 34 !", "en", "s", 1), (None, "der Hund", "xx", "s", 1), (903, "the cat", None, "s", 1), (903, "the cat", None, "s", 1), (904, "é", None, "s", 1), (905, "x" * 200_000, None, "s", 1)]
    docs = fx.clashing(spark.createDataFrame(rows, fx.SCHEMA))
    model = language_id.fit_pieces(docs)
    assert model.languages == ["de", "en"]
    got = defaultdict(list)
    for r in language_id.identify(docs, model).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert all(got[i][0] == ("und", 0.0) for i in (900, 901, 902))
    assert got[None][0][0] == "de" and got[903][0] == got[903][1] and got[903][0][0] == "en"
    assert got[904][0][0] in ("de", "en") and got[905][0][0] in ("de", "en")
    assert sorted(p for p, _ in got[0]) == ["de", "en"]
    none = language_id.fit_pieces(docs.where("lang is null"))
    assert none is None and {tuple(r)[2:] for r in language_id.identify(docs, none).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert language_id.fit_pieces(docs.limit(0)) is None
