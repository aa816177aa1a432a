"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every ``K`` consecutive words are hashed; of each ``SPAN - K + 1`` neighbouring hashes the smallest (leftmost) is kept as a
fingerprint, for documents and items alike. Two texts that share ``SPAN`` consecutive words therefore share a fingerprint
inside them: fingerprints are joined and each match is extended word by word to the left and right. A run of ``SPAN`` or more
equal words is a hit. Items shorter than ``SPAN`` words are one window each and are found by the hash of exactly so many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.session import materialise, tune

SPAN = 10
K = 5
BROADCAST_BYTES = 16 << 20  # item fingerprints up to this size go to every executor; more are joined by shuffle
SENTINEL = -1
RUN = 4096  # words of a text handled at a time
BACK, AHEAD = SPAN - 1, 2 * SPAN - K  # words kept before and from a fingerprint on
_POSITION = (1 << 31) - 1

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does just that where every character is a single byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def item_words(text: Column) -> Column:
    split = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(split, "")


def _tail(array: Column, drop: int) -> Column:
    """The array without its first elements; ``slice`` takes no length beyond the end badly."""
    return F.slice(array, F.lit(drop + 1), F.greatest(F.size(array) - drop, F.lit(0)))


def _pairs(left: str, right: str, drop: int, f) -> Column:
    """``f`` of each element and the one ``drop`` further on (null beyond the end)."""
    return F.zip_with(F.col(left), _tail(F.col(right), drop), f)


def runs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``hw`` (word hashes of a text) -> one row per ``RUN`` words: ``n`` (words of the text), ``run`` (where they begin), ``base`` (place of the row's first word), ``hw``.

    Rows overlap so that every ``SPAN`` words, and what surrounds the fingerprints in them, lie inside one row. A text without words has one row.
    """
    n = F.size("hw")
    cut = lambda at: F.struct(
        at.alias("run"),
        F.greatest(at - BACK, F.lit(0)).alias("base"),
        F.transform(F.sequence(F.greatest(at - BACK, F.lit(0)), F.least(at + RUN + AHEAD, n) - 1), lambda i: F.get("hw", i)).alias("hw"),
    )
    whole = F.array(F.struct(F.lit(0).alias("run"), F.lit(0).alias("base"), F.col("hw")))
    parts = F.when(n <= RUN, whole).otherwise(F.transform(F.sequence(F.lit(0), n - 1, F.lit(RUN)), cut))
    return texts.select(*keys, n.alias("n"), F.explode_outer(parts).alias("r")).select(*keys, "n", "r.run", "r.base", "r.hw")


def seeds(texts: DataFrame, words: str = "hw") -> DataFrame:
    """Add ``grams`` (hash of the ``K`` = 5 words from each position) and ``kept`` (winnowed: position in the low 31 bits).

    Built by doubling: pairs, fours, then five words; minima of two, four, then six. The low bits hold the position, so the
    smallest value is the leftmost smallest hash. Near the end of a text fewer words are hashed and compared, which only adds seeds.
    """
    both, least = lambda a, b: F.xxhash64(a, b), lambda a, b: F.least(a, b)
    texts = texts.withColumn("g", _pairs(words, words, 1, both)).withColumn("g", _pairs("g", "g", 2, both)).withColumn("grams", _pairs("g", words, 4, both)).drop("g")
    texts = texts.withColumn("v", F.transform("grams", lambda g, i: g.bitwiseAND(~_POSITION).bitwiseOR(i)))
    texts = texts.withColumn("m2", _pairs("v", "v", 1, least)).withColumn("m4", _pairs("m2", "m2", 2, least)).withColumn("m6", _pairs("m4", "m2", 4, least))
    none = F.array().cast("array<long>")
    return texts.withColumn("kept", F.when(F.size(words) >= SPAN, F.array_distinct("m6")).otherwise(none)).drop("v", "m2", "m4", "m6")


def _equal_run(a: Column, b: Column) -> Column:
    """Number of equal elements before the first difference (or the end of the shorter array)."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _before(at: Column) -> Column:
    """The ``BACK`` words before a position, nearest first; null beyond the start. Single reads: a slice would copy the whole row."""
    return F.transform(F.array(*[F.lit(i) for i in range(1, BACK + 1)]), lambda i: F.get("hw", at - i))


def _after(at: Column) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in range(AHEAD)]), lambda i: F.get("hw", at + i))


def _marks(around: bool, sentinel: Column) -> Column:
    """Fingerprints of a row as structs (position in the text, hash, words around it if wanted), and one more (``SENTINEL``) for the text."""
    at = lambda v: v.bitwiseAND(_POSITION).cast("int")
    words = lambda p: [_before(p).alias("before"), _after(p).alias("after")] if around else []
    none = [F.lit(None).cast("array<long>").alias(c) for c in (("before", "after") if around else ())]
    found = F.transform("kept", lambda v: F.struct((F.col("base") + at(v)).alias("p"), F.get("grams", at(v)).alias("fp"), *words(at(v))))
    last = F.struct(F.lit(SENTINEL).alias("p"), F.lit(None).cast("long").alias("fp"), *none)
    return F.when(sentinel, F.array_append(found, last)).otherwise(found)


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """``items(item_id, text)`` -> fingerprints of the items of ``SPAN`` words or more, each with its surroundings."""
    words = items.select("item_id", F.transform(item_words(F.col("text")), lambda w: F.xxhash64(w)).alias("hw"))
    # explode_outer: a plain explode would have its "not empty" test, and with it all the hashing, pushed below and done twice
    each = seeds(runs(words, ["item_id"])).select("item_id", F.explode_outer(_marks(True, F.lit(False))).alias("m")).where("m is not null")
    return each.select("m.fp", "item_id", F.col("m.before").alias("item_left"), F.col("m.after").alias("item_right")).distinct()


def short_items(items: DataFrame) -> DataFrame:
    words = items.select("item_id", F.transform(item_words(F.col("text")), lambda w: F.xxhash64(w)).alias("hw")).where(F.size("hw").between(1, SPAN - 1))
    return words.select(F.size("hw").alias("k"), _chained(F.col("hw")).alias("fp"), "item_id").distinct()


def _chained(words: Column) -> Column:
    """One hash of a short list of words."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda h, w: F.xxhash64(h, w))


def short_grams(rows: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """``(s, e, fp)`` of every so many consecutive words, with the hash that ``_chained`` gives."""
    rows = rows.withColumn("c", F.transform("hw", lambda w: F.xxhash64(F.lit(0).cast("long"), w)))
    found = []
    for k in range(1, max(lengths) + 1):
        if k > 1:
            rows = rows.withColumn("c", _pairs("c", "hw", k - 1, lambda h, w: F.xxhash64(h, w)))
        if k in lengths:
            rows = rows.withColumn(f"c{k}", F.col("c"))
            inside = F.filter(F.transform(f"c{k}", lambda h, i: F.struct(i.alias("i"), h.alias("fp"))), lambda x: x["i"] <= F.size("hw") - k)  # noqa: B023
            found.append(F.transform(inside, lambda x: F.struct((F.col("base") + x["i"]).alias("s"), (F.col("base") + x["i"] + k).alias("e"), F.lit(k).alias("k"), x["fp"].alias("fp"))))  # noqa: B023
    return rows.select(*keys, F.explode_outer(F.concat(*found)).alias("g")).where("g is not null").select(*keys, "g.*")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``, ``items(item_id, text)`` -> ``(doc_id, n_words, n_hit, items, contaminated, k1, k2)``.

    One row per input row; ``items`` are the ids found, sorted as strings (a null id marks words but is not listed). Null and
    empty texts have no words and are clean, so are all documents when there are no items. Rows are told apart by ``doc_id`` and
    the text's two hashes ``k1``, ``k2``; exact repeats of a row are counted together and given back as often. Other columns
    are ignored. One pass over the documents: a sentinel row carries each through the join. A very long text is handled in overlapping
    runs of ``RUN`` words: beside its list of word hashes nothing is held for the whole of it. Several items with the same words are all
    listed; ties of fingerprints go to the leftmost.
    """
    items = items.select("item_id", "text")
    fingerprints = materialise(benchmark_seeds(items), "bench-seeds")
    short = materialise(short_items(items), "bench-short")
    lengths = sorted(r.k for r in short.select("k").distinct().collect())  # at most SPAN - 1 values
    small = 8 * (BACK + AHEAD + 4) * fingerprints.count() <= BROADCAST_BYTES
    key = ["doc_id", "k1", "k2"]
    text = F.coalesce("text", F.lit(""))
    worded = docs.select("doc_id", F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"), item_words(F.col("text")).alias("words"))
    hashed = runs(worded.select(*key, F.transform("words", lambda w: F.xxhash64(w)).alias("hw")), key)
    marked = seeds(hashed).select(*key, "n", "run", F.explode_outer(_marks(small, F.col("run") == 0)).alias("m")).select(*key, "n", "run", "m.*")
    if small:
        met = marked.join(F.broadcast(fingerprints), "fp", "left").where("p < 0 or item_right is not null")
    else:  # fingerprints alone are shuffled; what lies around those that are met is read from their rows afterwards
        hits = marked.where("p >= 0").select(*key, "run", "p", "fp").join(fingerprints, "fp")
        hits = materialise(hits.select(*[F.col(k).alias(f"_{k}") for k in [*key, "run"]], "p", "item_id", "item_left", "item_right"), "bench-hits")
        rows = hashed.dropDuplicates([*key, "run"])
        met = rows.join(hits, [rows[k].eqNullSafe(hits[f"_{k}"]) for k in [*key, "run"]]).select(*key, "n", "p", "item_id", "item_left", "item_right", _before(F.col("p") - F.col("base")).alias("before"), _after(F.col("p") - F.col("base")).alias("after"))
        met = met.unionByName(hashed.where("run = 0").select(*key, "n", F.lit(SENTINEL).alias("p")), allowMissingColumns=True)
    real = F.col("p") >= 0
    ahead, back = F.when(real, _equal_run(F.col("after"), F.col("item_right"))), F.when(real, _equal_run(F.col("before"), F.col("item_left")))
    found = met.select(*key, "item_id", "p", F.when(~real, F.col("n")).alias("n_words"), back.alias("back"), ahead.alias("ahead"))
    found = found.where((F.col("p") < 0) | ((F.col("ahead") >= K) & (F.col("back") + F.col("ahead") >= SPAN)))
    found = found.select(*key, "item_id", "n_words", (F.col("p") - F.col("back")).alias("s"), (F.col("p") + F.col("ahead")).alias("e"))
    if lengths:
        grams = short_grams(hashed, key, lengths)
        found = found.unionByName(grams.join(short, ["k", "fp"]).select(*key, "item_id", "s", "e"), allowMissingColumns=True)
    # hits of one document: first each stretch once, then their union
    sums = found.groupBy(*key).agg(
        F.count("n_words").alias("times"), F.max("n_words").alias("n_words"), F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "e"))).alias("stretches"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    # stretches in order; each adds what lies beyond the furthest end so far
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["far"]), F.lit(0))).alias("n"), F.greatest(acc["far"], x["e"]).alias("far"))
    hit = F.aggregate(F.sort_array("stretches"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("far")), step, lambda acc: acc["n"])
    out = sums.select(*key, F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_copy"))
    return out.select("doc_id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"), "k1", "k2")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item window (names that begin with ``_dc_`` are reserved)."""
    bad = materialise(contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("_dc_id"), F.col("k1").alias("_dc_1"), F.col("k2").alias("_dc_2")).distinct(), "contaminated")
    text = F.coalesce("text", F.lit(""))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_dc_id")) & (F.xxhash64(F.lit(1), text) == F.col("_dc_1")) & (F.xxhash64(F.lit(2), text) == F.col("_dc_2")), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(tune(spark).read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: the definition itself, without fingerprints: every item window against every document window
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bk AS (SELECT *, least(len(w), {SPAN}) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT rid, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM m WHERE item_id IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)"""
