import random
import re
from collections import Counter

from chunkloom.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    lost = sum(len(WORD.findall(x)) for x in lines if fails(x))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base, not base and not 2 * lost > len(w))


def fails(line):
    w = WORD.findall(line)
    menu = sum(len(x) == 1 and x in q.MENU for x in w)
    return bool(w) and (
        sum(c in q.SYMBOLS for c in line) * 10 > len("".join(w))
        or sum(c in "!?" for c in line) > len(w)
        or (menu >= 3 and 5 * menu >= len(w))
        or (len(w) >= 10 and 4 * len(set(w)) < len(w))
        or (len(w) <= 40 and bool(re.search(q.BOILERPLATE, line.lower())))
    )


def texts():
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["wörd", "the", "of", "état", "x%"]) + str(rng.randrange(60)) for _ in range(n)) + "."
    out = [None, "", " \n\t\r", "a", "a b", "a a a", "a b a b a b", "ein Wort\n\nein Wort", "x" * 5000, prose(60), prose(60) + "\n" + prose(60)]
    out += ["\n".join([prose(60), "Home | News | About | Contact", "READ!! THIS!! NOW!!", "w%%% x&&& y***", "All rights reserved", "go " * 30]), " | ".join(["item"] * 60)]
    out += [prose(rng.randrange(1, 200)) + "\n" + " ".join(["go"] * rng.randrange(40)) for _ in range(30)]
    return out + [prose(20_000), " ".join(["ab", "cd"] * 30), prose(55) + "\n" + "B! " * 40]


def test_like_brute_force(spark):
    rows = [(i if i % 4 else None, t, "extra") for i, t in enumerate(texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    got = q.assess(df)
    assert got.columns == ["doc_id", "text", "quality", "quality_"]
    for r in got.collect():
        x = r.quality_
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept) == brute(r.text), r.text
        assert x.kept_text == "\n".join(y for y in (r.text or "").split("\n") if not fails(y))


def test_clean_keeps_columns_and_takes_lines_out(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = q.clean(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [i for i, t, _ in rows if brute(t)[-1]]
    assert not any("Home |" in r.text for r in got.collect())
    assert q.clean(df.limit(0)).count() == 0
