"""Merkle manifest of a table, with an inclusion proof for every row.

Each row is a leaf; each source has a ternary tree over its leaves in id order, and the roots of those trees are the leaves of one more
tree. Trees grow by runs: ``3 ** DEPTH`` neighbouring nodes are gathered in one row, which computes ``DEPTH`` levels at once. Every node
other than the root is then a row that knows an ancestor (its parent at first) and the segment up to it, a list of (hashes left, hashes
right) per level. Pointer jumping doubles the distance: the segment of a node is followed by its ancestor's, whose ancestor
becomes its own, until every leaf has reached the root. Leaves never point at leaves, so the side that is looked up holds
inner nodes only and shrinks threefold for every level of distance.

Places of leaves come from a range sort with counts per (source, range), so a source that holds most rows is still sorted by all tasks.
Digests are hashed as hex text and kept as 32 bytes.

Repeated rows are leaves of their own, next to each other. Leaves of one id are ordered by hash; a null id comes first, like a null
source. Empty texts and sources differ from null ones in the leaf. A tampered text is one without its newlines; a null id is never tampered
with. Empty table: no rows. Other columns are ignored. A very long text is hashed where it is read and goes no further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.session import discard, materialise, tune

FANOUT = 3
DEPTH = 6
TOP = -1  # tree over the roots of the sources
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_ROW = (1 << 33) - 1


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_of(text: Column) -> Column:
    """Digest of a row whose text is ``text``."""
    return digest(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]))


def placed(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``pos`` (from 0 within its group, in ``order``) and ``n`` (size of the group)."""
    sort = [F.asc_nulls_first(c) for c in group + order]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(_ROW)), f"{name}-ranged")
    # one row per group and range: as many as there are groups and ranges together
    per = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    total = per.groupBy(*group).agg(F.sum("_n").alias("n"), F.sort_array(F.collect_list(F.struct("_part", "_n", "_first"))).alias("parts"))
    part = F.transform("parts", lambda p, i: F.struct(p["_part"].alias("_part"), (F.aggregate(F.slice("parts", 1, i), F.lit(0).cast("long"), lambda a, q: a + q["_n"]) - p["_first"]).alias("_base")))
    bases = materialise(total.select(*group, "n", F.explode(part).alias("p")).select(*group, "n", "p.*"), f"{name}-bases")
    same = [ranged[c].eqNullSafe(bases[c]) for c in [*group, "_part"]]
    out = ranged.join(bases, same).select(*[ranged[c] for c in rows.columns], (ranged["_at"] + bases["_base"]).alias("pos"), bases["n"])
    out = materialise(out, name)
    discard(ranged, bases)
    return out


def _upper(level: str) -> str:
    """SQL of the level above an array of digests."""
    return f"transform(sequence(0L, (size({level}) - 1) div {FANOUT}), i -> unhex(sha2(array_join(transform(slice({level}, int(i * {FANOUT} + 1), {FANOUT}), x -> lower(hex(x))), ''), 256)))"


def _steps(level: str, j: int) -> str:
    """SQL of the nodes of level ``j`` of a run: place, digests of the neighbours on the left and on the right in the same three."""
    def near(d: int) -> str:
        return f"if(i + {d} >= 0 and i div {FANOUT} = (i + {d}) div {FANOUT} and i + {d} < size({level}), get({level}, i + {d}), X'')"

    left, right = ", ".join(near(-k) for k in reversed(range(1, FANOUT))), ", ".join(near(k) for k in range(1, FANOUT))
    nodes = f"transform({level}, (d, i) -> struct(level + {j} as level, run * {FANOUT ** (DEPTH - j)} + i as pos, struct(concat({left}) as l, concat({right}) as r) as step))"
    return f"if(n > {FANOUT**DEPTH} or size({level}) > 1, {nodes}, null)"  # a root has no step


def height_of(n: int) -> int:
    """Levels above the leaves of a tree of ``n``."""
    return sum(FANOUT**k < n for k in range(40))


def grow(leaves: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``leaves(tree, pos, digest, n)`` -> roots ``(tree, digest)`` and nodes ``(tree, level, pos, step, height)``, height being the tree's.

    ``most`` is the number of leaves of the largest tree: it says how many rounds of ``DEPTH`` levels there are.
    """
    width, level, rest, written = FANOUT**DEPTH, 0, leaves.select("tree", "pos", "digest", "n"), []
    while True:
        run = F.expr(f"pos div {width}")
        made = rest.groupBy("tree", "n", run.alias("run")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("s")).select("tree", "n", "run", F.lit(level).alias("level"), F.col("s.digest").alias("a0"))
        for j in range(DEPTH):  # where one node is left of a whole tree, it is passed on
            made = made.withColumn(f"a{j + 1}", F.expr(f"if(n > {width} or size(a{j}) > 1, {_upper(f'a{j}')}, a{j})"))
        steps = F.expr(f"flatten(array_compact(array({', '.join(_steps(f'a{j}', j) for j in range(DEPTH))})))")
        height = level + F.expr(f"size(filter(array({', '.join(str(FANOUT**k) for k in range(DEPTH))}), x -> x < n))")
        # the height is known in the last round of a tree; in earlier ones it is only said that it lies above
        height = F.when(F.col("n") <= width, height).otherwise(F.lit(1 << 30))
        written.append(materialise(made.select("tree", "n", "run", F.col(f"a{DEPTH}")[0].alias("digest"), height.alias("height"), steps.alias("nodes")), f"{name}-{level}"))
        if most <= width:
            break
        rest = written[-1].where(F.col("n") > width).select("tree", F.col("run").alias("pos"), "digest", F.expr(f"(n + {width - 1}) div {width}").alias("n"))
        most, level = -(-most // width), level + DEPTH
    every = written[0]
    for more in written[1:]:
        every = every.unionByName(more)
    roots = materialise(every.where(F.col("n") <= width).select("tree", "digest"), f"{name}-roots")
    return roots, every.select("tree", "height", F.explode("nodes").alias("v")).select("tree", "v.*", "height")


def linked(nodes: DataFrame) -> DataFrame:
    """Each node with its parent as its first ancestor; the root of a source's tree is a leaf of the tree on top."""
    last = (F.col("tree") != TOP) & (F.col("level") + 1 == F.col("height"))
    parent = F.when(last, F.struct(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"))).otherwise(
        F.struct(F.col("tree"), (F.col("level") + 1).alias("level"), F.expr(f"pos div {FANOUT}").alias("pos")))
    return nodes.select("tree", "level", "pos", F.array("step").alias("path"), parent.alias("up")).select("tree", "level", "pos", "path", "up.tree", "up.level", "up.pos").toDF("tree", "level", "pos", "path", "up_tree", "up_level", "up_pos")


def jump(rows: DataFrame, inner: DataFrame) -> DataFrame:
    """Rows with ``path`` and ``up_*``: the path goes on by the ancestor's own, where it is not the root yet."""
    held = [c for c in rows.columns if c not in ("path", "up_tree", "up_level", "up_pos")]
    ahead = inner.select(*[F.col(c).alias(f"_{c}") for c in ("tree", "level", "pos", "path", "up_tree", "up_level", "up_pos")])
    met = rows.join(ahead, (F.col("up_tree") == F.col("_tree")) & (F.col("up_level") == F.col("_level")) & (F.col("up_pos") == F.col("_pos")), "left")
    path = F.when(F.col("_path").isNotNull(), F.concat("path", "_path")).otherwise(F.col("path"))
    return met.select(*held, path.alias("path"), *[F.coalesce(f"_{c}", c).alias(c) for c in ("up_tree", "up_level", "up_pos")])


def manifest(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, source, lang, n_chars, text)`` -> ``(doc_id, leaf, subroot, root, proof, tampered)``, one row per input row.

    ``proof`` lists (l, r) per level from the leaf to the root: the digests left and right of the path. ``tampered`` is the leaf of
    the tampered text, null where nothing was tampered with. Digests are binary.
    """
    text = F.col("text")
    edited = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    rows = docs.select("doc_id", "source", leaf_of(text).alias("leaf"), F.when(edited, leaf_of(F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"), F.monotonically_increasing_id().alias("rid"))
    rows = materialise(rows, "manifest-rows")
    leaves = placed(rows, ["source"], ["doc_id", "leaf", "rid"], "manifest-leaves")
    discard(rows)
    sources = placed(leaves.groupBy("source").agg(F.first("n").alias("leaves")), [], ["source"], "manifest-sources")
    most, count = (r := sources.agg(F.max("leaves").alias("m"), F.max("n").alias("n")).first()).m or 0, r.n or 0
    trees = materialise(leaves.join(sources.select(F.col("source").alias("s"), F.col("pos").alias("tree")), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source", "rid"), "manifest-trees")
    subroots, low = grow(trees.withColumnRenamed("leaf", "digest"), most, "manifest-low")
    top, high = grow(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(count).cast("long").alias("n")), count, "manifest-high")
    root = (top.first() or [None, b""])[1]
    inner = materialise(linked(low.unionByName(high)), "manifest-nodes")
    alone = F.col("n") == 1  # such a leaf is the root of its source
    place = F.when(alone, F.struct(F.lit(TOP).cast("long").alias("t"), F.col("tree").alias("p"))).otherwise(F.struct(F.col("tree").alias("t"), F.col("pos").alias("p")))
    walk = trees.join(subroots.select(F.col("tree").alias("_s"), F.col("digest").alias("subroot")), F.col("tree") == F.col("_s")).select(
        "doc_id", "leaf", "subroot", "tampered", F.array().cast("array<struct<l:binary,r:binary>>").alias("path"), place["t"].alias("up_tree"), F.lit(0).alias("up_level"), place["p"].alias("up_pos"))
    far, depth, steps = 0, height_of(most) + height_of(count), [inner]
    while far < depth:  # a leaf has come ``far`` levels, an inner node's ancestor is one more away
        last = 2 * far + 1 >= depth
        walk = jump(walk, inner)
        if last:
            break
        walk = materialise(walk, "manifest-walk")
        # from here on leaves look up nodes of level 2 * far + 1 or more
        needed = inner.where((F.col("tree") == TOP) | (F.col("level") > 2 * far))
        inner = materialise(jump(needed, inner.where((F.col("tree") == TOP) | (F.col("level") > 3 * far + 1))), "manifest-nodes")
        discard(*steps)
        steps, far = [walk, inner], 2 * far + 1
    return walk.select("doc_id", "leaf", "subroot", F.lit(bytes(root)).alias("root"), F.col("path").alias("proof"), "tampered")


def proof_text(proof: Column) -> Column:
    return F.array_join(F.transform(proof, lambda s: F.concat(hexed(s["l"]), hexed(s["r"]))), "")


def folded(leaf: Column, proof: Column) -> Column:
    """Root (hex) that a leaf leads to with the siblings of ``proof``."""
    return F.aggregate(proof, hexed(leaf), lambda acc, s: F.sha2(F.concat(hexed(s["l"]), acc, hexed(s["r"])), 256))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest(tune(spark).read.parquet(f"{sf_dir}/documents.parquet"))
    made = made.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return made.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == hexed(F.col("root"))).alias("verified"),
    )


def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if c == "text" else c) for c in FIELDS) + ")"


#: CRC-32 bit by bit: each byte is mixed in, then eight shifts (marked by -1)
_SQL_CRC = """xor(list_reduce(flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')]),
 lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295::BIGINT)"""
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, {_sql_leaf('text')} AS leaf, {_sql_leaf("replace(text, chr(10), '')")} AS edited, coalesce({_SQL_CRC} % 2 = 0, false) AS touched FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d),
low AS (SELECT tree, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, lvl, n, pos // 3),
sub AS (SELECT tree, h FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, tree AS pos, h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, n, pos // 3),
near AS (SELECT rid, false AS up, l.lvl, l.pos, l.h, p.pos // (3 ** l.lvl)::BIGINT AS own FROM p JOIN low l ON l.tree = p.tree AND l.n > 1 AND l.pos // 3 = p.pos // (3 ** (l.lvl + 1))::BIGINT
  UNION ALL SELECT rid, true, g.lvl, g.pos, g.h, p.tree // (3 ** g.lvl)::BIGINT FROM p JOIN high g ON g.n > 1 AND g.pos // 3 = p.tree // (3 ** (g.lvl + 1))::BIGINT),
step AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY up, lvl) AS k, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < own), '') AS l, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > own), '') AS r FROM near GROUP BY rid, up, lvl),
proof AS (SELECT rid, string_agg(l || r, '' ORDER BY k) AS t, max(k) AS steps FROM step GROUP BY rid),
fold AS (SELECT rid, 0::BIGINT AS k, CASE WHEN touched THEN edited ELSE leaf END AS h FROM d
  UNION ALL SELECT f.rid, s.k, sha256(s.l || f.h || s.r) FROM fold f JOIN step s ON s.rid = f.rid AND s.k = f.k + 1)
SELECT p.doc_id, p.leaf, sub.h AS subroot, root.h AS root, sha256(coalesce(proof.t, '')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM p JOIN sub USING (tree) LEFT JOIN proof USING (rid) JOIN fold f ON f.rid = p.rid AND f.k = coalesce(proof.steps, 0) JOIN (SELECT h FROM high WHERE n = 1) root ON true"""
