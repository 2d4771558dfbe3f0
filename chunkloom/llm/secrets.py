"""Secret scans: patterns per text, and weak parts of credentials that count only near each other.

Column expressions and joins only. Places come without a matching API: what stands between matches (split) and the
matches themselves (extract) alternate, so ends are running sums of both lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Table, let


def any_case(words: str) -> str:
    """A pattern for words in either case of its ASCII letters, without flags (whose folding differs between engines)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_IS = r"""["']?\x20*[:=]\x20*["']?"""

# The three base kinds, as text patterns, with the characters that a match (assign: its value) needs.
BASE = {
    "assign": (f"({any_case('password|passwd|secret|token|api_?key')}){_IS}([A-Za-z0-9+/_.=-]+)", 8),
    "access": ("AKIA[A-Z0-9]+", 16),
    "hex": ("[0-9a-f]+", 32),
}
# Parts that are weak on their own. A short value (4 to 7 characters) of a base assignment is one, too.
WEAK = {
    "id": f"({any_case('client_?id|access_?key_?id|user_?name|user_?id|account_?id|login')}){_IS}([A-Za-z0-9+/_.@=-]+)",
    "key": f"({any_case('pwd|passphrase|credential|private_?key|auth_?key|access_?key')}){_IS}([A-Za-z0-9+/_.=-]+)",
    "run": "[A-Za-z0-9+/]+",
    "endpoint": f"({any_case('https?|ftps?|ssh|postgres|postgresql|mysql|mongodb|redis|amqp')})://[^{SPACE}\"'<>]+",
}
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "secret", "id", "endpoint")
#: Parts belong together if so many code points or fewer lie between them. Least value of a weak part; length of a bare key.
SCOPE, VALUE, RUN = 200, 4, 40


def running(x: Column) -> Column:
    """Running sums of an array, in blocks, so that an array of n takes about n * (256 + n / 65536) steps."""
    add = lambda acc, v: F.concat(acc, F.array(F.coalesce(F.element_at(acc, -1), F.lit(0)) + v))
    sums = lambda a: F.aggregate(a, F.array().cast("array<int>"), lambda acc, v: F.when(F.size(acc) == 0, F.array(v)).otherwise(add(acc, v)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 256).cast("int")), lambda k: sums(F.slice(x, k * 256 + 1, 256)))

    def joined(b: Column) -> Column:
        ends = sums(F.transform(b, lambda s: F.element_at(s, -1)))
        return let(ends, lambda e: F.flatten(F.transform(b, lambda s, k: F.transform(s, lambda v: v + F.when(k == 0, 0).otherwise(F.get(e, k - 1))))))

    return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(let(blocks, joined))


def spans(text: Column, pattern: str, value: int = 0) -> Column:
    """start, end and n of all matches, leftmost first, in code points; n: the length of the match, or of a group's value."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(value)) if value else None

    def placed(m: Column) -> Column:
        between = F.split(text, pattern, -1)
        sizes = let(between, lambda b: F.transform(m, lambda x, k: F.length(F.get(b, k)) + F.length(x)))
        of = lambda n: let(running(sizes), lambda e: F.transform(m, lambda x, k: F.struct((F.get(e, k) - F.length(x)).alias("start"), F.get(e, k).alias("end"), n(x, k).alias("n"))))
        return of(lambda x, k: F.length(x)) if values is None else let(values, lambda v: of(lambda x, k: F.length(F.get(v, k))))

    return let(found, lambda m: F.when(F.size(m) == 0, nothing()).otherwise(placed(m)))


def nothing() -> Column:
    return F.array().cast("array<struct<start:int,end:int,n:int>>")


def _at_least(pattern: str, n: int) -> str:
    """For a pattern that ends in a greedy run: only its matches of n characters or more (a shorter one hides none)."""
    lead = len(pattern.split("[", 1)[0])
    return f"{pattern[:-1]}{{{n - lead},}}"


def _parts(text: Column) -> Column:
    """Base spans, and weak parts, of one text."""
    as_kind = lambda x, kind: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"))
    assign, least = BASE["assign"]
    tokens = _at_least(WEAK["run"], RUN)
    # a pattern is only tried on texts with a character string that all its matches have
    named = text.contains(":") | text.contains("=")
    have = lambda test, found: F.when(test, found).otherwise(nothing())
    mixed = lambda x: x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]")

    def of(a: Column) -> Column:
        pick = lambda s, keep, kind: F.transform(F.filter(s, keep), lambda x: as_kind(x, kind))
        base = F.concat(pick(a, lambda x: x["n"] >= least, "assign"), *[pick(have(test, spans(text, _at_least(*BASE[k]))), lambda x: x["n"] > 0, k) for k, test in (("access", text.contains("AKIA")), ("hex", F.lit(True)))])
        runs = F.filter(spans(text, tokens), lambda x: (x["n"] == RUN) & mixed(F.substring(text, x["start"] + 1, F.lit(RUN))))
        weak = F.concat(
            pick(a, lambda x: (x["n"] < least) & (x["n"] >= VALUE), "secret"),
            pick(have(named, spans(text, WEAK["key"], 2)), lambda x: x["n"] >= VALUE, "secret"),
            F.transform(runs, lambda x: as_kind(x, "secret")),
            pick(have(named, spans(text, WEAK["id"], 2)), lambda x: x["n"] >= VALUE, "id"),
            F.transform(have(text.contains("://"), spans(text, WEAK["endpoint"])), lambda x: as_kind(x, "endpoint")),
        )
        return F.struct(F.array_sort(base).alias("base"), weak.alias("weak"))

    return let(have(named, spans(text, assign, 2)), of)


def _linked(found: DataFrame) -> DataFrame:
    """(doc, row, start, rank, end): weak parts with their complement in scope.

    A weak secret needs an identifier or endpoint, a weak identifier a secret, an endpoint both. Parts are joined on
    stretches of their text, a part with its scope around it in each stretch that it touches. Rows of one key and text have the same
    parts, which are joined once, however many rows there are.
    """
    rank = {k: F.lit(KINDS.index(k)) for k in KINDS}
    once = found.where("size(weak) > 0").groupBy("doc", "row").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    part = once.select("doc", "row", F.explode(F.concat(F.col("base"), F.col("weak"))).alias("x")).select("doc", "row", "x.*")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE))).alias("bin")
    asks = part.where(F.col("rank").isin(*map(KINDS.index, ("secret", "id", "endpoint")))).select("*", bins(F.col("start") - SCOPE, F.col("end") + SCOPE))
    gives = part.select("doc", "row", F.col("rank").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"), bins(F.col("start"), F.col("end")))
    role = F.when(F.col("r").isin(KINDS.index("access"), KINDS.index("id")), "id").when(F.col("r") == rank["endpoint"], "endpoint").otherwise("secret")
    near = asks.join(gives.withColumn("role", role), ["doc", "row", "bin"]).where(f"s <= end + {SCOPE} and e >= start - {SCOPE}")
    has = near.groupBy("doc", "row", "start", "rank", "end").agg(*[F.max((F.col("role") == k).cast("int")).alias(f"has_{k}") for k in ("id", "endpoint", "secret")])
    ok = F.when(F.col("rank") == rank["secret"], (F.col("has_id") + F.col("has_endpoint")) > 0).when(F.col("rank") == rank["id"], F.col("has_secret") > 0).otherwise((F.col("has_secret") + F.col("has_id")) > 1)
    return has.where(ok).select("doc", "row", "start", "rank", "end")


def find_secrets(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans): arrays of (start, rank, end) in code points, end exclusive; KINDS[rank] is the kind.

    base: matches of the base patterns that are long enough, by start, then kind. spans: these and the weak parts that
    have their complement within SCOPE. Spans of different kinds may overlap. A null or empty text has none. Rows come back one for one,
    null and repeated keys too; only key and text are read. One pass over the texts; what is joined are parts.
    """
    doc = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("key"), doc.alias("doc"), F.xxhash64(text).alias("row"), _parts(F.coalesce(F.col(text), F.lit(""))).alias("x"))
    found = Table(rows.select("key", "doc", "row", "x.base", "x.weak"), "secrets").df
    added = _linked(found).groupBy("doc", "row").agg(F.collect_set(F.struct("start", "rank", "end")).alias("added"))
    all_ = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return found.join(added, ["doc", "row"], "left").select(F.col("key").alias(key), "base", all_.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"])), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    counts = [count(rank).alias(f"n_{kind}") for rank, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    q = lambda s: s.replace("'", "''")

    def matches(name: str, pattern: str, group: int = 0) -> str:
        p = q(pattern)
        return f"""{name} AS (SELECT doc_id, t, m, n, e - length(m) AS start, e AS "end" FROM (
            SELECT doc_id, t, m, n, sum(length(b) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
            SELECT doc_id, t, generate_subscripts(ms, 1) AS k, unnest(ms) AS m, unnest(list_transform(vs, lambda v: length(v))) AS n, unnest(bs[1:len(ms)]) AS b FROM (
            SELECT doc_id, t, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS bs FROM d))))"""

    least = BASE["assign"][1]
    part = lambda kind, source, where="true": f"""SELECT doc_id, start, {KINDS.index(kind)} AS rank, "end" FROM {source} WHERE {where}"""
    text = lambda t, o: f"""coalesce(string_agg(['{"','".join(KINDS)}'][rank + 1] || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, rank, "end"), '') AS {o} FROM {t}"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{matches("a", BASE["assign"][0], 2)}, {matches("b", _at_least(*BASE["access"]))}, {matches("c", _at_least(*BASE["hex"]))},
{matches("k", WEAK["key"], 2)}, {matches("i", WEAK["id"], 2)}, {matches("r", _at_least(WEAK["run"], RUN))}, {matches("p", WEAK["endpoint"])},
base AS ({part("assign", "a", f"n >= {least}")} UNION ALL {part("access", "b")} UNION ALL {part("hex", "c")}),
weak AS ({part("secret", "a", f"n < {least} AND n >= {VALUE}")} UNION {part("secret", "k", f"n >= {VALUE}")} UNION {part("id", "i", f"n >= {VALUE}")} UNION {part("endpoint", "p")}
  UNION {part("secret", "r", f"n = {RUN} AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')")}),
parts AS (SELECT *, CASE WHEN rank IN (1, 4) THEN 'id' WHEN rank = 5 THEN 'endpoint' ELSE 'secret' END AS role FROM (FROM base UNION ALL FROM weak)),
has AS (SELECT w.doc_id, w.start, w.rank, w."end", bool_or(role = 'id') AS i, bool_or(role = 'endpoint') AS p, bool_or(role = 'secret') AS s
  FROM weak w JOIN parts x ON w.doc_id = x.doc_id AND x.start <= w."end" + {SCOPE} AND x."end" >= w.start - {SCOPE} GROUP BY ALL),
added AS (SELECT doc_id, start, rank, "end" FROM has WHERE CASE rank WHEN 3 THEN i OR p WHEN 4 THEN s ELSE i AND s END),
bs AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, {text("base", "s")} GROUP BY doc_id),
al AS (SELECT doc_id, {text("(FROM base UNION ALL FROM added)", "s")} GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(bs.s, '')) AS base_sha256, coalesce(al.s, '') AS spans FROM documents LEFT JOIN bs USING (doc_id) LEFT JOIN al USING (doc_id)"""


ORACLE = _sql()
