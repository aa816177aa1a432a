"""Awkward small tables, and plain re-statements of the operators' contracts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def phrase(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_docs():
    """Nulls in every column, empty and blank texts, repeated rows and ids, a long text, copies and near copies."""
    rng = random.Random(11)
    base = phrase(rng, 120)
    near = base.replace(" w1", " w2", 1)
    lines = "\n".join(f"{phrase(rng, 14)} end." for _ in range(6))
    rows = [
        (1, base, "en", "a", 3), (2, base, "en", "a", 3), (3, near, None, "b", None), (3, near, None, "b", None), (3, lines, "en", None, 1), (None, base, "en", None, 1),
        (None, None, None, None, None), (None, "", "en", "c", 0), (4, None, "de", "a", 0), (5, "", "de", "", 0), (6, " \n\t ", "de", "b", 0), (7, lines + "\n" + lines, "fr", "c", 9),
        (8, lines.replace("end", "End"), "fr", "c", 9), (9, "one", "en", "a", 3), (10, "Two words", "en", "a", 9), (11, "É é " + base + " 😀 token", "fr", "b", 9), (12, phrase(rng, 30_000), "en", "a", 9),
        (13, "same " * 300, "en", "a", 9), (13, "same " * 300, "en", "a", 9), (14, "\n\n\nlast line", "en", "b", 9), (15, base + " " + phrase(rng, 40), "en", "a", 9),
    ]
    return rows + [(100 + i, phrase(rng, rng.randrange(0, 90)), "en", rng.choice("abc"), 0) for i in range(40)]


def clashing(df):
    """The same rows with columns named like those the operators make on their way."""
    from pyspark.sql import functions as F

    for name in ("k1", "k2", "_k1", "_k2", "fp", "h", "gone", "unit", "side", "size", "key", "root", "node", "kept", "n_lines", "bands", "line", "_id"):
        df = df.withColumn(name, F.lit("x"))
    return df


def duck(**tables):
    con = duckdb.connect()
    for name, df in tables.items():
        rows = df.collect()
        kinds = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER"}
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {kinds[k]}' for c, k in df.dtypes)})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", [tuple(r) for r in rows])
    return con


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_classes(docs):
    """(doc_id, text) -> list of (fingerprint, class) with all pairs compared."""
    prints = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    return [(prints[i], find(parent, i)) for i in range(len(docs))]


def substring_dedup(docs, k):
    split = [words(t) for _, t in docs]
    seen = Counter(" ".join(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for (doc_id, _), w in zip(docs, split):
        gone = {j for i in range(len(w) - k + 1) if seen[" ".join(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def base_quality(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    repeat = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat), failed


def fuzzy_lines(docs, similarity):
    """(doc_id, text) with unique ids -> text left of each, all line pairs compared exactly."""
    from risklake.llm.line_dedup import shingles

    visible = lambda line: bool(line.strip(" \t\n\x0b\x0c\r"))
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0))
    lines = list(dict.fromkeys(x for _, t in docs for x in (t or "").split("\n") if visible(x)))
    parent, holders = list(range(len(lines))), defaultdict(list)
    sets = [shingles(x) for x in lines]
    for a, s in enumerate(sets):
        shared = Counter(b for g in s for b in holders[g])
        for b, n in shared.items():
            if n / (len(s) + len(sets[b]) - n) >= similarity:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
        for g in s:
            holders[g].append(a)
    group = {x: find(parent, i) for i, x in enumerate(lines)}
    first = {}
    for doc_id, t in order:
        for j, x in enumerate((t or "").split("\n")):
            if visible(x):
                first.setdefault(group[x], (doc_id, j))
    left = []
    for doc_id, t in docs:
        parts = (t or "").split("\n")
        keep = [x for j, x in enumerate(parts) if not visible(x) or first[group[x]] == (doc_id, j)]
        left.append((doc_id, t if t is None or len(keep) == len(parts) else "\n".join(keep)))
    return left
