"""Toxicity: a weighted finite-state grammar over clauses, with terms and weights learnt from labels.

A text is read by a cascade of transducers. The lexicon, an automaton over characters, turns words into classes with
weights: insult, threat, target, negation, speech. Five small weighted machines over these classes are composed into one table,
which a clause is walked through word by word:

    insult    an insult counts with its weight
    threat    a threat waits until the clause has named a target, and counts at once after that; one without a target never counts
    target    a clause with a target ends in a state that raises all it counts
    negation  what follows a negation within three words counts less
    speech    what follows a word of reported speech counts less, to the end of the clause

The score of a clause is what its path gives; a document's score is a logistic function of its clauses' scores.

Word lists give the machines a start. What is not in them is learnt: words and word beginnings that mark
labelled texts, chosen so that few of them cover all (so texts copied many times can't fill the list), insults or threats by
the company they keep; and words before them that labels say weaken them, as negation or speech.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, slices, small_batches

# The words that the grammar starts with.
INSULTS = "idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash filth imbecile cretin dumbass asshole bastard retard clown pig vermin freak ugly dumb jerk".split()
THREATS = "kill hurt destroy beat punch stab shoot burn hang smash strangle".split()
TARGETS = "you your yours u they them she he him her these those everyone people".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't won't without neither nor hardly".split()
SPEECH = "said says say told claims claimed reported reports wrote writes quoted according alleged called".split()

#: Labelled rows to fit on, at most, of each label (those of least hash); what a learnt term must add: toxic texts that
#: fewer than DEEP terms cover, at least so many and so large a share; candidates looked at.
FIT_TOXIC, FIT_CLEAN, LEAST, SHARE, DEEP, CANDIDATES = 3000, 6000, 3, 0.01, 3, 3000
#: Expected number of terms that pass by chance. Lengths of word beginnings. Score from which a text counts as toxic.
CHANCE, LENGTHS, THRESHOLD = 0.5, range(4, 9), 0.7

OTHER, INSULT, THREAT, TARGET, NEGATION, SPOKEN = range(6)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass(frozen=True)
class Machine:
    """A weighted transducer over word classes.

    An arc, from a state by a word's class, leads to the next state (the same one if `step` has none) and says what becomes of the word's
    weight: `gain` of it counts, `hold` of it waits, and an arc in `free` makes all that waits count. `factor`: what a state
    gives to the weight of the word that is read in it; `final`: what the state where a clause ends gives to all that counts.
    """

    states: int
    step: dict[tuple[int, int], int] = field(default_factory=dict)
    gain: dict[tuple[int, int], float] = field(default_factory=dict)
    hold: dict[tuple[int, int], float] = field(default_factory=dict)
    free: frozenset[tuple[int, int]] = frozenset()
    factor: tuple[float, ...] = ()
    final: tuple[float, ...] = ()

    def of(self, values: tuple[float, ...], state: int) -> float:
        return values[state] if values else 1.0

    def __matmul__(self, other: Machine) -> Machine:
        """Both machines as one: pairs of states that can be reached, what counts or waits in either, factors of both."""
        arcs, numbers, pairs = {}, {(0, 0): 0}, [(0, 0)]
        for a, b in pairs:
            for c in range(CLASSES):
                to = self.step.get((a, c), a), other.step.get((b, c), b)
                if to not in numbers:
                    numbers[to] = len(pairs)
                    pairs.append(to)
                arcs[numbers[a, b], c] = a, b, numbers[to]
        both = lambda x, y: {k: v for k, (a, b, _) in arcs.items() if (v := x.get((a, k[1]), 0.0) + y.get((b, k[1]), 0.0))}
        free = frozenset(k for k, (a, b, _) in arcs.items() if (a, k[1]) in self.free or (b, k[1]) in other.free)
        product = lambda x, y: tuple(self.of(x, a) * other.of(y, b) for a, b in pairs)
        return Machine(len(pairs), {k: n for k, (_, _, n) in arcs.items()}, both(self.gain, other.gain), both(self.hold, other.hold), free, product(self.factor, other.factor), product(self.final, other.final))

    def table(self) -> list[tuple[int, float, float, bool]]:
        """For each state and class, one after another: the next state, what counts, what waits, whether what waits counts."""
        return [(self.step.get((s, c), s), self.gain.get((s, c), 0.0) * self.of(self.factor, s), self.hold.get((s, c), 0.0) * self.of(self.factor, s), (s, c) in self.free) for s in range(self.states) for c in range(CLASSES)]


CLASSES = 6
INSULTING = Machine(1, gain={(0, INSULT): 1.0})
THREATENING = Machine(2, {(0, TARGET): 1}, gain={(1, THREAT): 1.0}, hold={(0, THREAT): 1.0}, free=frozenset({(0, TARGET)}))
TARGETING = Machine(2, {(0, TARGET): 1}, final=(1.0, 1.25))
#: Three words long; any word but a negation counts down.
NEGATED = Machine(4, {(s, c): 3 if c == NEGATION else max(s - 1, 0) for s in range(4) for c in range(CLASSES)}, factor=(1.0, 0.3, 0.3, 0.3))
REPORTED = Machine(2, {(0, SPOKEN): 1}, factor=(1.0, 0.5))
GRAMMAR = INSULTING @ THREATENING @ TARGETING @ NEGATED @ REPORTED
TABLE = GRAMMAR.table()


@dataclass
class Model:
    """Terms: a word, or a beginning with a star, to class and weight; coefficients of a document's figures, constant first."""

    terms: dict[str, tuple[int, float]]
    coefficients: list[float] = field(default_factory=lambda: [-4.0, 1.5, 1.0, 1.0, -0.5])


def starting_terms() -> dict[str, tuple[int, float]]:
    out = {}
    for words, kind, weight in ((TARGETS, TARGET, 0.0), (NEGATIONS, NEGATION, 0.0), (SPEECH, SPOKEN, 0.0), (THREATS, THREAT, 1.0), (INSULTS, INSULT, 2.0)):
        out |= dict.fromkeys(words, (kind, weight))
    return out


class Reader:
    """Runs the cascade. An Aho-Corasick automaton finds where scoring words may start; only their clauses are read word by word."""

    def __init__(self, model: Model):
        import ahocorasick

        self.terms = model.terms
        self.starts = {k[:-1]: v for k, v in model.terms.items() if k.endswith("*")}
        self.longest = max(map(len, self.starts), default=0)
        self.find = ahocorasick.Automaton()
        for term, (kind, _) in model.terms.items():
            if kind in (INSULT, THREAT):
                self.find.add_word(term.rstrip("*"), len(term.rstrip("*")))
        self.any = len(self.find) > 0
        if self.any:
            self.find.make_automaton()

    def classed(self, word: str) -> tuple[int, float]:
        if found := self.terms.get(word):
            return found
        for n in range(min(len(word), self.longest), 0, -1):
            if found := self.starts.get(word[:n]):
                return found
        return OTHER, 0.0

    def clause(self, words: list[str]) -> tuple[float, set[str]]:
        """The score of a clause, and the terms that it is due to: one walk through the composed table."""
        state, counts, waits, met = 0, 0.0, 0.0, set()
        for word in words:
            kind, weight = self.classed(word)
            state, gain, hold, free = TABLE[state * CLASSES + kind]
            waits += weight * hold
            if free:
                counts, waits = counts + waits, 0.0
            counts += weight * gain
            if kind == INSULT:
                met.add(word[:4])
        return counts * GRAMMAR.of(GRAMMAR.final, state), met

    def clauses(self, text: str | None) -> list[list[str]]:
        """The words of the clauses that hold an insult or a threat."""
        if not text or not self.any:
            return []
        text = text.lower()
        hits = [end - n + 1 for end, n in self.find.iter(text)]
        hits = [a for a in hits if a == 0 or not text[a - 1].isalnum()]
        if not hits:
            return []
        edges = [0, *(m.end() for m in _CLAUSE.finditer(text)), len(text) + 1]
        return [_WORD.findall(text[edges[k] : edges[k + 1]]) for k in np.unique(np.searchsorted(edges, hits, "right") - 1).tolist()]

    def company(self, text: str | None) -> set[str]:
        """What stands with scoring words: t+ or t- and a scoring term, with or without a target in its clause; n and each word up to three before one, s and those further before."""
        out = set()
        for words in self.clauses(text):
            kinds = [self.classed(w)[0] for w in words]
            at = [k for k, c in enumerate(kinds) if c in (INSULT, THREAT)]
            if not at:
                continue
            sign = "+" if TARGET in kinds else "-"
            out |= {f"t{sign}{self.term(words[k])}" for k in at}
            out |= {("n" if at[0] - k <= 3 else "s") + words[k] for k in range(at[0]) if kinds[k] == OTHER}
        return out

    def term(self, word: str) -> str:
        """The term that gives a word its class."""
        return word if word in self.terms else next(word[:n] + "*" for n in range(min(len(word), self.longest), 0, -1) if word[:n] in self.starts)

    def figures(self, text: str | None) -> tuple[float, float, float, float, int]:
        """Of a text: log of all clauses' scores, the best clause's, log of different terms, log of its length if any; and the clauses that score."""
        scores, met = [], set()
        for words in self.clauses(text):
            score, terms = self.clause(words)
            if score > 0:
                scores.append(score)
                met |= terms
        return math.log1p(sum(scores)), max(scores, default=0.0), math.log1p(len(met)), math.log1p(len(text) / 1000) if scores else 0.0, len(scores)


def _features(texts: Iterator[str]) -> Iterator[tuple[int, list[str]]]:
    """Of each text a hash that near copies mostly share, and its words and word beginnings; x2 and x3: if it has two or three of them."""
    for text in texts:
        words = _WORD.findall((text or "").lower())
        near = min(zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4)))
        found: Counter[str] = Counter()
        for word, n in Counter(words).items():
            if len(word) > 2:
                found[word] += n
            for k in LENGTHS:
                if len(word) >= k:
                    found[word[:k] + "*"] += n
        yield near, [f"{t}x{k}" if k > 1 else t for t, n in found.items() for k in range(1, min(n, 3) + 1)]


def _log_tail(k: int, n: int, p: float) -> float:
    """Log of the chance of k or more of n at chance p each (bounded above by Chernoff's bound)."""
    if k <= n * p:
        return 0.0
    q = k / n
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def _learnt(sample: DataFrame) -> dict[str, tuple[int, float]]:
    """Terms from rows (toxic, near, features), of bounded number."""
    each = sample.dropDuplicates(["toxic", "near"])
    n_toxic, n_clean = (each.where(f"toxic = {k}").count() for k in (1, 0))
    if not n_toxic or not n_clean:
        return {}
    counts = each.select("toxic", F.explode("features").alias("term")).groupBy("term").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).where(f"pos >= {LEAST}")
    counts = Table(counts, "counts").df
    rate = n_toxic / (n_toxic + n_clean)
    neg = F.col("n") - F.col("pos")
    likelier = F.col("pos") * F.log(F.col("pos") / (F.col("n") * rate)) + F.when(neg > 0, neg * F.log(neg / (F.col("n") * (1 - rate)))).otherwise(0.0)
    best = counts.where(F.col("pos") > F.col("n") * min(0.9, 2 * rate)).orderBy(-likelier, "term").limit(CANDIDATES).collect()
    bound = math.log(CHANCE / max(counts.count(), 1))
    good = {r.term: r for r in best if _log_tail(r.pos, r.n, rate) < bound}
    if not good:
        return {}
    wanted = F.array(*map(F.lit, good))
    rows = each.where("toxic = 1").select(F.array_intersect("features", wanted).alias("x")).collect()
    holds: dict[str, list[int]] = {t: [] for t in good}
    for k, r in enumerate(rows):
        for t in r.x:
            holds[t].append(k)
    left, chosen = np.full(len(rows), DEEP), []
    plain = {t: re.sub(r"x[23]$", "", t) if t[-2:] in ("x2", "x3") else t for t in good}
    while holds:
        gain = {t: int((left[h] > 0).sum()) - 4 * (good[t].n - good[t].pos) for t, h in holds.items()}
        best_ = max(gain, key=lambda t: (gain[t], len(plain[t]), t))
        if gain[best_] < max(LEAST, SHARE * n_toxic):
            break
        left[holds.pop(best_)] -= 1
        term = plain[best_]
        chosen.append(term)
        beginning = term.rstrip("*")
        holds = {t: h for t, h in holds.items() if not (plain[t] == term or (term.endswith("*") and t.startswith(beginning)) or beginning.startswith(plain[t].rstrip("*")))}
    out = {}
    for r in counts.where(F.col("term").isin(chosen)).collect() if chosen else []:
        odds = math.log((r.pos + 0.5) / (n_toxic + 1)) - math.log((r.n - r.pos + 0.5) / (n_clean + 1))
        out[r.term] = (INSULT, min(max(odds / 2, 0.3), 3.0))
    return out


def _classed(model: Model, found: DataFrame) -> None:
    """Give learnt terms the class that their company shows; found: (toxic, company) of each text that was learnt from.

    A term whose texts are toxic with a target in the clause, and without one no more than others, is a threat. A word that
    stands before scoring words mostly where the text isn't toxic, by more than chance, weakens: as negation within three
    words, as speech before that.
    """
    each = found.where("size(company) > 0")
    texts = each.groupBy("toxic").count().collect()
    n = sum(r["count"] for r in texts)
    rate = sum(r["count"] for r in texts if r.toxic) / n if n else 0.0
    if not 0 < rate < 1:
        return
    counts = each.select("toxic", F.explode("company").alias("x")).groupBy("x").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    counts = Table(counts, "company").df
    seen = {r.x: (r.pos, r.n) for r in counts.where("x like 't%'").collect()}  # two for each term
    for term, (kind, weight) in list(model.terms.items()):
        with_, without = (seen.get(f"t{s}{term}", (0, 0)) for s in "+-")
        if kind == INSULT and term not in INSULTS and without[1] >= LEAST and without[0] <= without[1] * rate and with_[0] > 2 * rate * with_[1]:
            model.terms[term] = THREAT, weight
    least = math.log(n) / -math.log(rate)  # fewer can't pass
    before = counts.where(f"x not like 't%' and n - pos >= {least} and pos < n * {rate}").orderBy((F.col("pos") - F.col("n")).asc(), "x").limit(CANDIDATES).collect()
    bound = math.log(CHANCE / max(counts.count(), 1))
    for r in before:
        if r.x[1:] not in model.terms and _log_tail(r.n - r.pos, r.n, 1 - rate) < bound:
            model.terms[r.x[1:]] = (NEGATION if r.x[0] == "n" else SPOKEN), 0.0


def _logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> list[float]:
    """Coefficients, the constant first and not held back, by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[strength] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def fit(labelled: DataFrame, *, text: str = "text", toxic: str = "toxic", order: str | None = None, n_toxic: int = FIT_TOXIC, n_clean: int = FIT_CLEAN) -> Model:
    """A model from labelled texts; of each label those `n` rows at most that come first by the column `order` (or a hash of the text), ties by text.

    Labels are 1 and 0; rows with other labels or none are left out. Where one label is missing, the starting lists and coefficients hold.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(toxic).isin(0, 1)).select(F.col(toxic).cast("int").alias("toxic"), F.col(text).alias("text"), (F.col(order) if order else F.xxhash64(text)).alias("order"))
    some = [rows.where(f"toxic = {k}").orderBy("order", "text").limit(n) for k, n in ((1, n_toxic), (0, n_clean))]
    texts = Table(some[0].unionByName(some[1]), "labelled").df

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            near, features = zip(*_features(part.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near, pa.int64()), pa.array(features, pa.list_(pa.string()))], names=["toxic", "near", "features"])

    sample = Table(texts.select("toxic", "text").mapInArrow(seen, "toxic int, near long, features array<string>"), "features")
    model = Model(_learnt(sample.df) | starting_terms())
    sample.drop()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sorted(reader.company(t)) for t in part.column(1).to_pylist()], pa.list_(pa.string()))], names=["toxic", "company"])

    _classed(model, Table(texts.select("toxic", "text").mapInArrow(met, "toxic int, company array<string>"), "company").df)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for part in slices(batches, 1):
            x = [reader.figures(t)[:4] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in x], pa.float64()) for k in range(4))], names=["toxic", *"abcd"])

    found = texts.select("toxic", "text").mapInArrow(measured, "toxic int, a double, b double, c double, d double").toPandas()
    if found.toxic.nunique() == 2:
        model.coefficients = _logistic(found[[*"abcd"]].to_numpy(), found.toxic.to_numpy(float))
    return model


def score(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score double from 0 to 1, clauses long): how likely each whole text is toxic, and how many clauses say so.

    A null, empty or blank text has the score of a text without any matched clause. Rows come back one for one, null and repeated keys too;
    only key and text are read.
    """
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for part in slices(batches, 1):
            x = [reader.figures(t) for t in part.column(1).to_pylist()]
            z = np.array([r[:4] for r in x]).reshape(-1, 4) @ np.array(model.coefficients[1:]) + model.coefficients[0]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array([r[4] for r in x], pa.int64())], names=["key", "score", "clauses"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"key {df.schema[key].dataType.simpleString()}, score double, clauses long").withColumnRenamed("key", key)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out)
    by = F.xxhash64("doc_id").alias("order")
    some = [labels.where(f"toxic = {k}").select("doc_id", "toxic", by).orderBy("order").limit(n) for k, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # no more rows than the two bounds
    model = fit(documents.join(chosen, "doc_id"), order="order")
    return score(documents, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "clauses")
