"""Personal data replaced by surrogates, in DataFrame operations only.

Mails, network addresses, phone and card numbers and titled names are found, reduced to a canonical form (so one entity written
in several ways stays one) and mapped to a surrogate by a keyed SHA-256: same type, same format, same validity of card check
digits, names of the title's gender in the name's script. Surrogates that meet each other or a real entity of the corpus are drawn again
until all are distinct. The map is per entity, the corpus is joined to it, so an entity reads the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.session import discard, materialise, tune

SECRET = "replace-me"  # the key; keep your own outside the code
MAX_DRAWS = 40

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ADDRESS = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|(?<!\w)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)"
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr")
PERSON = rf"(?<!\p{{L}})(?:{'|'.join(FEMALE + MALE)})\.?\x20\p{{Lu}}[\p{{L}}'-]+(?:\x20\p{{Lu}}[\p{{L}}'-]+)?"
ENTITY = "|".join([EMAIL, ADDRESS, PHONE, CARD, PERSON])
#: a cheap necessary condition: a mail sign, a digit, or a title
HINT = rf"[@0-9]|{'|'.join(FEMALE + MALE)}"
KINDS = ("email", "phone", "ip", "card", "person")

SYLLABLES = {
    "latin": ("ba", "co", "da", "el", "fi", "gra", "hol", "ju", "ka", "lin", "mo", "nor", "pe", "ri", "sto", "tam", "vi", "wes"),
    "cyrillic": ("ба", "во", "га", "до", "ел", "жи", "зо", "ка", "лин", "мо", "нор", "пе", "ри", "сто", "там", "ви"),
    "greek": ("αλ", "βα", "γε", "δη", "ελ", "θε", "κα", "λι", "μο", "νι", "πε", "ρα", "σο", "τα"),
}
ENDINGS = {"latin": {"m": "n", "f": "a"}, "cyrillic": {"m": "н", "f": "а"}, "greek": {"m": "ος", "f": "α"}}


def _kind(v: Column) -> Column:
    return (
        F.when(F.contains(v, F.lit("@")), "email").when(v.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(F.left(v, F.lit(1)).isin("+", "("), "phone").when(v.rlike("^[0-9]"), "card").otherwise("person")
    )


def _female(v: Column) -> Column:
    return v.rlike(rf"^(?:{'|'.join(FEMALE)})[.\x20]")


def _names(v: Column) -> Column:
    return F.slice(F.split(v, r"\x20"), F.lit(2), F.lit(2))


def _keys(v: Column) -> Column:
    """Canonical keys of one found entity, ``type:form``; a person has one per name."""
    kind = _kind(v)
    given = F.when(_female(v), "given_f:").otherwise("given_m:")
    names = _names(v)
    person = F.when(F.size(names) == 2, F.array(F.concat(given, F.lower(F.get(names, 0))), F.concat(F.lit("surname:"), F.lower(F.get(names, 1))))).otherwise(F.array(F.concat(F.lit("surname:"), F.lower(F.get(names, 0)))))
    digits = F.regexp_replace(v, r"\D", "")
    plain = F.when(kind == "email", F.lower(v)).when(kind == "ip", v).otherwise(digits)
    return F.when(kind == "person", person).otherwise(F.array(F.concat(kind, F.lit(":"), plain)))


def found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def _byte(seed: Column, i: Column | int) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    block = F.sha2(F.concat_ws("|", seed, F.floor(i / 32).cast("string")), 256)
    return F.conv(F.substr(block, (2 * (i % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _luhn(digits: Column) -> Column:
    """Check sum, from the right; nought for a valid number."""
    d = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    value = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10


def _syllable(seed: Column, syllables: tuple[str, ...]):
    listed = F.array(*[F.lit(x) for x in syllables])
    return lambda i: F.get(listed, _byte(seed, i) % len(syllables))


def _draw(secret: str) -> Column:
    """Surrogate of ``key`` (``type``, ``form``) at ``draw``."""
    seed = F.concat_ws("|", F.lit(secret), "key", F.col("draw").cast("string"))
    form, kind = F.col("form"), F.col("type")
    letters = lambda i: F.char(97 + _byte(seed, i) % 26)
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    last_dot = F.length(form) - F.length(F.substring_index(form, ".", -1))
    mail = F.array_join(F.transform(chars, lambda c, i: F.when(i >= last_dot, c).when(c.between("a", "z"), letters(i)).when(c.between("0", "9"), (_byte(seed, i) % 10).cast("string")).otherwise(c)), "")
    octet = lambda i: (_byte(seed, i) % 254 + 1).cast("string")
    two = F.substring_index(form, ".", 2)
    ip = (
        F.when(form.rlike(r"^(10|127)\."), F.concat_ws(".", F.substring_index(form, ".", 1), octet(1), octet(2), octet(3)))
        .when(form.rlike(r"^(192\.168|172\.(1[6-9]|2\d|3[01]))\."), F.concat_ws(".", two, octet(2), octet(3)))
        .otherwise(F.concat_ws(".", (_byte(seed, 0) % 100 + 11).cast("string"), octet(1), octet(2), octet(3)))
    )
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(i == 0, c).otherwise((_byte(seed, i) % 10).cast("string"))), "")
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    card = F.concat(body, F.when(_luhn(form) == 0, check).otherwise((check + 1) % 10).cast("string"))
    script = F.when(form.rlike(r"\p{IsCyrillic}"), "cyrillic").when(form.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    # after some draws names grow, so that the supply never ends
    parts = F.sequence(F.lit(0), F.lit(1) + _byte(seed, 30) % 2 + F.floor(F.col("draw") / 3).cast("int"))
    name = F.lit(None).cast("string")
    for s, syllables in SYLLABLES.items():
        stem = F.array_join(F.transform(parts, _syllable(seed, syllables)), "")
        end = F.when(kind == "given_f", ENDINGS[s]["f"]).when(kind == "given_m", ENDINGS[s]["m"]).otherwise("")
        name = F.when(script == s, F.concat(stem, end)).otherwise(name)
    return F.when(kind == "email", mail).when(kind == "ip", ip).when(kind == "phone", digits).when(kind == "card", card).otherwise(name)


def surrogate_map(keys: DataFrame, secret: str = SECRET) -> DataFrame:
    """``keys(key)`` distinct -> ``(key, surrogate)``: distinct within a type, and never a real form of that type."""
    real = keys.select("key", F.substring_index("key", ":", 1).alias("type"), F.expr("substring(key, instr(key, ':') + 1)").alias("form"))
    table = materialise(real.withColumn("draw", F.lit(0)).withColumn("surrogate", _draw(secret)), "pii-map")
    for _ in range(MAX_DRAWS):
        first = table.groupBy("type", "surrogate").agg(F.min("key").alias("first"))
        forms = table.select("type", F.col("form").alias("surrogate"), F.lit(True).alias("taken"))
        judged = table.join(first, ["type", "surrogate"]).join(forms, ["type", "surrogate"], "left")
        bad = (F.col("key") != F.col("first")) | F.col("taken").isNotNull()
        judged = materialise(judged.select("key", "type", "form", "draw", "surrogate", bad.alias("bad")), "pii-map")
        discard(table)
        table = judged
        if table.where("bad").isEmpty():
            return table.select("key", "surrogate")
        moved = table.withColumn("draw", F.when(F.col("bad"), F.col("draw") + 1).otherwise(F.col("draw")))
        moved = materialise(moved.withColumn("surrogate", F.when(F.col("bad"), _draw(secret)).otherwise(F.col("surrogate"))).drop("bad"), "pii-map")
        discard(table)
        table = moved
    raise RuntimeError("surrogates still collide; more draws are needed")


def _cased(name: Column, like: Column) -> Column:
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(name)).otherwise(F.concat(F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2))))


def _rendered(v: Column, mapped: str) -> Column:
    """The surrogate of an occurrence in that occurrence's own format."""
    kind, keys, names = _kind(v), _keys(v), _names(v)
    get = lambda k: F.try_element_at(F.col(mapped), k)
    one = get(F.get(keys, 0))
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    mail = F.when(v == F.lower(v), one).otherwise(F.array_join(F.zip_with(chars, F.filter(F.split(one, ""), lambda c: c != ""), lambda a, b: F.when(a != F.lower(a), F.upper(b)).otherwise(b)), ""))
    put = F.aggregate(
        chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda a, c: F.when(c.between("0", "9"), F.struct(F.concat(a["out"], F.substr(one, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n"))),
        lambda a: a["out"],
    )
    called = F.array_join(F.zip_with(names, F.transform(keys, get), lambda a, b: _cased(b, a)), " ")
    person = F.concat(F.substring_index(v, " ", 1), F.lit(" "), called)
    return F.when(kind == "email", mail).when(kind == "ip", one).when(kind == "person", person).otherwise(put)


def replace_pii(docs: DataFrame, secret: str = SECRET) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, text, entities)``, one row per input row; ``entities`` lists the kinds found, in order.

    Texts without entities (null and empty ones too) pass unchanged and are not shuffled. Entity lists depend on the text alone and are joined by
    its hashes, so ids may be null or repeated; equal rows get equal results. Other columns are ignored. Empty table: no rows.
    """
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2"))
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ENTITY), F.lit(False))
    marked, clean = rows.where(has), rows.where(~has)
    named = materialise(marked.select("k1", "k2", F.explode_outer(F.array_distinct(F.flatten(F.transform(found(F.col("text")), _keys)))).alias("key")).distinct(), "pii-keys")
    table = surrogate_map(named.select("key").distinct(), secret)
    per_text = named.join(table, "key").groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("key", "surrogate"))).alias("mapped"))
    met = marked.join(per_text, ["k1", "k2"]).select("doc_id", "text", "mapped", found(F.col("text")).alias("found"), F.split("text", ENTITY).alias("pieces"))
    new = F.transform("found", lambda v: _rendered(v, "mapped"))
    text = F.array_join(F.flatten(F.zip_with("pieces", new, lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")
    done = met.select("doc_id", text.alias("text"), F.transform("found", _kind).alias("entities"))
    return done.unionByName(clean.select("doc_id", "text", F.array().cast("array<string>").alias("entities")))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_pii(tune(spark).read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "text", *[_n(k) for k in KINDS])


def _n(kind: str) -> Column:
    return F.size(F.filter("entities", lambda e: e == kind)).cast("long").alias(f"n_{kind}")
