"""Quality rules, line first: lines that fail a rule go, then documents that lose too much text.

All of it is column expressions over one text: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, let

BLANKS = f"[{SPACE}]+"
SYMBOLS = "#*$%&|<>"

# What marks a line as boilerplate (any case), and the signs that part the items of a menu.
BOILERPLATE = "all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings|notice)|uses cookies|accept cookies|enable javascript|subscribe to our|sign up for our|click here|read more|back to top|skip to content|share (this|on)|follow us on|powered by|lorem ipsum"
MENU = "|»›•·>"

#: The rules' bounds: symbols in hundredths of a line's characters; exclamation and question marks for each
#: word; menu signs, at least, and in hundredths of its words; words from which a line must vary, and
#: different words in hundredths; words up to which boilerplate fails a line; words that a document may lose in hundredths.
BOUNDS = {"symbols": 10, "marks": 1, "signs": 3, "menu": 20, "long": 10, "varied": 25, "boilerplate": 40, "lost": 50}


def words(text: Column) -> Column:
    """The words of a text in order: runs of other than the six ASCII blanks."""
    return let(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, BLANKS)))


def occurrences(text: Column, characters: str) -> Column:
    """How many of some ASCII characters a text has."""
    return F.regexp_count(text, F.lit("[" + "".join(f"\\{c}" for c in characters) + "]")).cast("long")


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that a text has twice or more, the first included.

    Windows are compared by a 64-bit hash and sorted with their places, so a text of n words takes n log n.
    """
    grams = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def places(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, h: F.coalesce(F.get(s, i)["h"] == h, F.lit(False))
        twice = let(placed, lambda s: F.filter(s, lambda x, i: ((i > 0) & same(s, F.greatest(i - 1, F.lit(0)), x["h"])) | same(s, i + 1, x["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    cover = lambda acc, i: F.struct((acc["n"] + (i + 3 - F.greatest(i, acc["end"])).cast("long")).alias("n"), (i + 3).alias("end"))
    count = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), F.aggregate(places(g), start, cover, lambda acc: acc["n"])).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(count)


def signs(text: Column) -> Column:
    """What a text has at all, so that no line is asked for what the text has not: symbols (how many), marks, menu, boilerplate."""
    have = lambda x, parts: reduce(or_, [x.contains(p) for p in parts])
    beginnings = [x.split("(")[0] for x in re.split(r"\|(?![^(]*\))", BOILERPLATE)]
    return F.struct(occurrences(text, SYMBOLS).alias("symbols"), have(text, "!?").alias("marks"), have(text, MENU).alias("menu"), let(F.lower(text), lambda x: have(x, beginnings)).alias("boilerplate"))


def line_fails(line: Column, w: Column, has: Column) -> Column:
    """Whether a line (w: its words, has: signs() of its text) breaks a rule of punctuation, navigation, boilerplate or repetition; a line without words doesn't."""
    b = BOUNDS
    n = F.size(w)
    menu = F.size(F.filter(w, lambda x: (F.length(x) == 1) & F.lit(MENU).contains(x)))
    return (n > 0) & (
        ((has["symbols"] > 0) & (occurrences(line, SYMBOLS) * 100 > (F.length(line) - F.regexp_count(line, F.lit(f"[{SPACE}]"))) * b["symbols"]))
        | (has["marks"] & (occurrences(line, "!?") > n * b["marks"]))
        | (has["menu"] & let(menu, lambda m: (m >= b["signs"]) & (m * 100 >= n * b["menu"])))
        | ((n >= b["long"]) & (F.size(F.array_distinct(w)) * 100 < n * b["varied"]))
        | (has["boilerplate"] & (n <= b["boilerplate"]) & F.lower(line).rlike(BOILERPLATE))
    )


def measures(text: Column) -> Column:
    """All figures of a text as a struct, with the text that stays and the verdict; null counts as empty.

    A line's end parts words, too, so a text's words are those of its lines: texts are split once, by lines and then words.
    """
    text = F.coalesce(text, F.lit(""))

    def figures(lines: Column, w: Column, has: Column) -> Column:
        spoken = F.transform(F.filter(lines, lambda x: x["n"] > 0), lambda x: x["line"])
        stays = F.array_join(F.transform(F.filter(lines, lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(text) - F.regexp_count(text, F.lit(f"[{SPACE}]"))).cast("long").alias("word_chars"),
            has["symbols"].alias("n_symbols"),
            let(spoken, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.aggregate(lines, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["bad"], x["n"]).otherwise(0)).alias("n_lost"),
            F.when(F.exists(lines, lambda x: x["bad"]), stays).otherwise(text).alias("kept_text"),
        )

    def marked(lines: Column, has: Column) -> Column:
        return F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.size(x["w"]).alias("n"), line_fails(x["line"], x["w"], has).alias("bad")))

    def of(lines: Column) -> Column:
        all_words = F.flatten(F.transform(lines, lambda x: x["w"]))
        return let(signs(text), lambda has: let(marked(lines, has), lambda x: let(all_words, lambda w: figures(x, w, has))))

    def verdict(f: Column) -> Column:
        base = (f["n_words"] < 50) | (f["n_repeat_words"] * 100 > f["n_words"] * 50)
        lost = f["n_lost"] * 100 > f["n_words"] * BOUNDS["lost"]
        return F.struct(*[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base.alias("base_failed"), (~base & ~lost).alias("kept"), f["kept_text"].alias("kept_text"))

    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("w")))
    return let(let(lines, of), verdict)


def assess(df: DataFrame, *, text: str = "text", into: str = "quality") -> DataFrame:
    """The table with a struct column `into` (underscores are added if the name is taken): the figures of each text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_text (the text
    without the lines that fail) and kept: not base_failed, and no more words lost with the lines than BOUNDS
    allows. Null, empty and blank texts have zeros, fail the base and aren't kept. Row by row, so repeated
    rows, null keys and other columns come back as they are.
    """
    return df.withColumn(fresh(df, into), measures(F.col(text)))


def clean(df: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows that are kept, with the lines that fail taken out of their texts; columns as they were."""
    name = fresh(df, "quality")
    kept = F.filter(F.array(measures(F.col(text))), lambda x: x["kept"])  # exploded, so that figures are taken once for test and text
    out = df.select("*", F.explode(kept).alias(name))
    return out.select(*[F.col(name)["kept_text"].alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def op3_quality(spark, sf_dir: str) -> DataFrame:
    found = assess(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *[F.col("quality")[c].alias(c) for c in names])


def _sql() -> str:
    b = BOUNDS
    blank = "[ \\t-\\r]+"
    split = lambda x: f"list_filter(string_split_regex({x}, '{blank}'), lambda q: q <> '')"
    count = lambda x, s: f"(length({x}) - length(translate({x}, '{s}', '')))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {split("t")} AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS line FROM w),
lw AS (SELECT doc_id, line, {split("line")} AS q FROM l),
lost AS (SELECT doc_id, sum(len(q)) AS n_lost FROM lw WHERE len(q) > 0 AND (
    {count("line", SYMBOLS)} * 100 > length(regexp_replace(line, '{blank}', '', 'g')) * {b["symbols"]}
    OR {count("line", "!?")} > len(q) * {b["marks"]}
    OR (len(list_filter(q, lambda x: length(x) = 1 AND contains('{MENU}', x))) >= {b["signs"]} AND len(list_filter(q, lambda x: length(x) = 1 AND contains('{MENU}', x))) * 100 >= len(q) * {b["menu"]})
    OR (len(q) >= {b["long"]} AND len(list_distinct(q)) * 100 < len(q) * {b["varied"]})
    OR (len(q) <= {b["boilerplate"]} AND regexp_matches(lower(line), '{BOILERPLATE}'))) GROUP BY doc_id),
a AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{blank}', '', 'g')) AS word_chars, {count("t", SYMBOLS)} AS n_symbols,
    len(list_filter(ls, lambda x: regexp_matches(x, '[^ \\t-\\r]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^ \\t-\\r]')))) AS n_dup_lines,
    coalesce(n_repeat, 0) AS n_repeat_words, coalesce(n_lost, 0) AS n_lost FROM w LEFT JOIN r USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT n_lost * 100 > n_words * {b["lost"]} AS kept FROM a"""


ORACLE = _sql()
