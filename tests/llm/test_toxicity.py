import random
import zlib

import pytest

from chunkloom.llm import toxicity as tx


def prose(rng, n=80):
    return " ".join("".join(rng.choice(["ba", "ko", "li", "mu", "ne"]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def with_words(rng, text, words):
    out = text.split()
    for w in words:
        out.insert(rng.randrange(len(out) + 1), w)
    return " ".join(out)


def corpus(n=900):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        text, toxic = prose(rng), int(rng.random() < 0.25)
        if toxic:
            text = with_words(rng, text, rng.choice([["idiot", "you", "scum"], ["zorgl" + rng.choice(["a", "em", "utix"]) for _ in range(3)]]))
        rows.append((i, text, "xx"))
        labels.append((i, toxic))
    copied = with_words(rng, prose(rng), ["moron", "trash"])  # a group of near copies of a toxic text
    for i in range(n, n + 200):
        rows.append((i, with_words(rng, copied, [prose(rng, 1)]), "xx"))
        labels.append((i, 1))
    rows += [(n + 300, None, None), (n + 301, "", "xx"), (None, " \n", "xx"), (n + 302, "I will kill you. " * 3000, "xx")]
    return rows, labels


def test_held_out_accuracy_and_whole_results(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, labels[0], (5000, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = tx.op2_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    right = sum(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth)
    assert right >= 0.98 * sum(r.doc_id in truth for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (None, 1200, 1201))


def test_labels_that_are_missing_leave_the_starting_model(spark):
    df = spark.createDataFrame([("a b", 0)], "text string, toxic int")
    for d in (df, df.limit(0)):
        model = tx.fit(d)
        assert model.terms == tx.starting_terms() and len(model.coefficients) == 5
    assert tx.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


@pytest.fixture(scope="module")
def reader():
    return tx.Reader(tx.Model(tx.starting_terms() | {"vequ*": (tx.INSULT, 2.0)}))


def test_grammar(reader):
    score = lambda s: reader.clause(s.lower().split())[0]
    assert score("such an idiot") == 2 and score("you are an idiot") == 2.5
    assert score("you are not an idiot") == pytest.approx(0.75)
    assert score("they said you idiot") == pytest.approx(1.25)
    assert score("not one two three idiot") == 2  # out of the negation's reach
    assert score("kill the process") == 0 and score("i will kill you") == pytest.approx(1.25)
    assert score("vequatine") == 2 and score("calm words") == 0


def test_clauses_and_word_starts(reader):
    assert reader.figures("idiotic? Trash! all good")[4] == 1  # idiotic is no listed word
    assert reader.figures("He is an idiot. She is a clown, yes.")[4] == 2
    assert reader.figures("reveque vequ")[4] == 1
    assert reader.figures(None) == reader.figures("") == (0.0, 0.0, 0.0, 0.0, 0)


MACHINES = (tx.INSULTING, tx.THREATENING, tx.TARGETING, tx.NEGATED, tx.REPORTED)


def side_by_side(kinds):
    """The score of a clause by the five machines one beside the other, from what each of them is meant to do."""
    counts, waits, target, negated, spoken = 0.0, [], False, 0, False
    for kind, weight in kinds:
        worth = weight * (0.3 if negated else 1) * (0.5 if spoken else 1)
        if kind == tx.INSULT:
            counts += worth
        if kind == tx.THREAT:
            if target:
                counts += worth
            else:
                waits.append(worth)
        if kind == tx.TARGET:
            target = True
            counts += sum(waits)
            waits = []
        negated = 3 if kind == tx.NEGATION else max(negated - 1, 0)
        spoken = spoken or kind == tx.SPOKEN
    return counts * (1.25 if target else 1)


def test_composed_table_like_the_machines_side_by_side(reader):
    rng = random.Random(1)
    by = {tx.OTHER: ["calm", "word"], tx.INSULT: tx.INSULTS, tx.THREAT: tx.THREATS, tx.TARGET: tx.TARGETS, tx.NEGATION: tx.NEGATIONS, tx.SPOKEN: tx.SPEECH}
    for _ in range(4000):
        words = [rng.choice(by[rng.choice([0, 0, 1, 2, 3, 4, 5])]) for _ in range(rng.randrange(12))]
        assert reader.clause(words)[0] == pytest.approx(side_by_side([reader.classed(w) for w in words])), words


def test_machines_compose():
    both = tx.NEGATED @ tx.REPORTED
    assert both.states == 8 and sorted(set(both.factor)) == [0.15, 0.3, 0.5, 1.0]
    assert tx.GRAMMAR.states == 16  # of 32 pairs; target and threat meet the first target together
    late = tx.REPORTED @ tx.NEGATED @ tx.TARGETING @ tx.THREATENING @ tx.INSULTING  # in any order
    walk = lambda m, kinds: [s := 0] + [s := m.step.get((s, c), s) for c in kinds]
    kinds = [tx.THREAT, tx.NEGATION, tx.TARGET, tx.INSULT, tx.SPOKEN, tx.INSULT, tx.THREAT]
    for m in (tx.GRAMMAR, late):
        table = m.table()
        assert [round(table[s * tx.CLASSES + c][1], 3) for s, c in zip(walk(m, kinds), kinds)] == [0, 0, 0, 0.3, 0, 0.5, 0.5]


def test_classes_are_learnt_from_company(spark):
    rng = random.Random(2)
    rows = []
    for k in range(1200):
        kind = k % 6
        extra = {0: "zorgl you", 1: "zorgl pump", 2: "nixo idiot", 3: "idiot", 4: "quoth ab cd ef moron", 5: "moron"}[kind]
        rows.append((prose(rng, 30).replace(".", "") + ". " + extra + ". " + prose(rng, 30), int(kind in (0, 3, 5))))
    model = tx.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert model.terms["nixo"][0] == tx.NEGATION and model.terms["quoth"][0] == tx.SPOKEN


def test_a_term_that_is_toxic_with_a_target_only_becomes_a_threat(spark):
    model = tx.Model({"zorgl": (tx.INSULT, 2.0), "vex*": (tx.INSULT, 1.5)} | tx.starting_terms())
    rows = [(1, ["t+zorgl", "t+vex*"])] * 60 + [(0, ["t-zorgl"])] * 60 + [(1, ["t-vex*"])] * 40 + [(0, ["nword"])] * 90
    tx._classed(model, spark.createDataFrame(rows, "toxic int, company array<string>"))
    assert model.terms["zorgl"] == (tx.THREAT, 2.0) and model.terms["vex*"] == (tx.INSULT, 1.5)
    score = lambda s: tx.Reader(model).clause(s.split())[0]
    assert score("zorgl pump") == 0 and score("zorgl you") == 2.5 and score("you zorgl") == 2.5


def test_clashing_columns_repeated_rows_and_ties(spark, tmp_path):
    rows, labels = corpus(300)
    docs = spark.createDataFrame([*rows, *rows[:50]], "doc_id long, text string, source string").withColumns({c: tx.F.lit("n") for c in ("key", "score", "toxic", "order", "clauses")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, *labels[:40]], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = tx.op2_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 50
    again = tx.op2_toxicity(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    tied = docs.select("text").withColumn("toxic", tx.F.when(tx.F.col("text").contains("idiot"), 1).otherwise(0)).withColumn("order", tx.F.lit(1))
    assert tx.fit(tied, order="order", n_toxic=20, n_clean=40) == tx.fit(tied.repartition(7), order="order", n_toxic=20, n_clean=40)
    assert tx.score(docs, tx.Model(tx.starting_terms())).columns == ["doc_id", "score", "clauses"]
