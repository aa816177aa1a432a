"""Secret scan over an incremental blob ledger, in DataFrame operations only.

Every historical version of a file is addressed by the SHA-256 of its content. The ledger records which (blob, rule version) pairs
were scanned and what was found; a run scans unseen pairs only, each blob once, and joins findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.session import materialise, tune


@dataclass(frozen=True)
class Rule:
    """``pattern`` as Java and RE2 both read it; a match counts if capture ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run of the class matches greedily to its end, so the length can be part of the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED
LEDGER = "blob string, rule string, spans array<struct<start:int,end:int>>"
_SPANS = "array<struct<start:int,end:int>>"


def _spans(rule: Rule, text: Column) -> Column:
    """Code-point spans of a rule's matches: the pieces between matches give where each begins."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    pieces = F.split(text, rule.pattern)
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.char_length(x))
    at = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.struct((total(F.slice(pieces, F.lit(1), i)) + total(F.slice(found, F.lit(1), i - 1))).alias("start"), F.char_length(F.get(found, i - 1)).alias("n"), F.char_length(F.get(value, i - 1)).alias("size")))
    kept = F.filter(at, lambda x: x["size"] >= rule.least)
    spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["n"]).alias("end")))
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(_SPANS)).cast(_SPANS)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions(text)`` and a ledger -> ledger rows for the pairs not in it yet, one per blob and rule with findings or not.

    A blob is scanned once however many paths and versions hold it; a null text is the empty blob. An empty table adds nothing.
    """
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("todo", keys)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    each = [F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"), _spans(r, F.col("text")).alias("spans"))) for r in rules]
    return blobs.select("blob", F.explode_outer(F.array_compact(F.array(*each))).alias("f")).select("blob", "f.rule", "f.spans")


def findings_by_path(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths(..., text)`` -> its columns but the text, plus ``found``: array of (start, rank, kind, end), ordered."""
    rank = {r.key: (i, r.kind) for i, r in enumerate(rules)}
    hits = ledger.where(F.col("rule").isin(list(rank)) & (F.size("spans") > 0))
    number = F.create_map(*[x for k, (i, _) in rank.items() for x in (F.lit(k), F.lit(i))])
    kind = F.substring_index("rule", "@", 1)
    rows = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(number, F.col("rule")).alias("rank"), kind.alias("kind"), s["end"].alias("end")))
    per_blob = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(rows))).alias("found"))
    named = paths.withColumn("blob", blob_of(F.col("text"))).drop("text")
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return named.join(per_blob, "blob", "left").withColumn("found", F.coalesce("found", empty))


def scan(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of every path and the ledger carried on: ``(paths + blob + found, ledger)``.

    Repeated rows and null ids are rows like any other, one result each; only ``text`` is read.
    """
    fresh = scan_blobs(paths, ledger, rules)
    carried = materialise(fresh if ledger is None else ledger.select("blob", "rule", "spans").unionByName(fresh), "secret-ledger")
    return findings_by_path(paths, carried, rules), carried


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, _ = scan(docs)
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    return found.select("doc_id", *[_count(r.kind) for r in BASE], F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"), F.array_join(F.transform("found", label), ",").alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _sql_rule(rule: Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, s, s + length(m[i]) AS e FROM (
      SELECT rid, m, i, v, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {rule.group}) AS v FROM d))
    ) WHERE length(v[i]) >= {rule.least}"""


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_sql_rule(r, i) for i, r in enumerate(RULES))}),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
        string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""
