"""Toxicity by a lexicon, misspellings of its terms, and the context of each hit (operator 9).

The lexicon is learned: words far more frequent in documents labelled toxic.  A trie of its terms is walked together with the
Levenshtein automaton of the word at hand, as one automaton whose states are made when first met; so misspelled terms are found without
comparing words with terms.  A window around a hit tells quotation from abuse.  A logistic model over the hits gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as TY

from corpusloom.llm.common import documents, query, text_of

#: Labelled rows the lexicon and the model are fitted on: a bounded sample, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Most terms of a lexicon, labelled documents a term must be in, and least log-odds of a term.
MOST_TERMS, LEAST_DOCS, LEAST_ODDS = 1000, 3, 2.5
#: Terms from this length on are also found with one error.
FUZZY_LENGTH = 5
#: Characters on each side of a hit that tell whether it is quoted, and what a quoted hit counts.
WINDOW, QUOTED_SHARE = 80, 0.25

WORD = re.compile(r"\w+(?:[*@$!]\w+)*")
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"


class TermAutomaton:
    """Which lexicon term a word is, at most one error (insertion, deletion, substitution) away.

    A state is the set of (trie node, errors so far) that the read part of a word can have led to.  States are numbered as they
    appear, and most words fall into the empty state after a few letters.
    """

    def __init__(self, terms: list[str]):
        self.terms, self.child, self.term_at = list(terms), [{}], {}
        self.limit = [0]
        for k, term in enumerate(self.terms):
            node, errors = 0, int(len(term) >= FUZZY_LENGTH)
            self.limit[0] = max(self.limit[0], errors)
            for ch in term:
                node = self.child[node].setdefault(ch, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.limit.append(0)
                self.limit[node] = max(self.limit[node], errors)
            self.term_at[node] = k
        self.letters = {ch for c in self.child for ch in c}
        self.states: dict[frozenset, int] = {}
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.sets: list[frozenset] = []
        self.dead = self._state(set())
        self.start = self._state({(0, 0)})

    def _state(self, reached: set) -> int:
        todo = list(reached)
        while todo:  # a letter of the term may be missing
            node, e = todo.pop()
            for c in self.child[node].values():
                if e < self.limit[c] and (c, e + 1) not in reached:
                    reached.add((c, e + 1))
                    todo.append((c, e + 1))
        key = frozenset(reached)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [(e, self.term_at[n]) for n, e in key if n in self.term_at and e <= int(len(self.terms[self.term_at[n]]) >= FUZZY_LENGTH)]
            self.found.append(min(ends) if ends else None)
        return self.states[key]

    def _step(self, state: int, ch: str) -> int:
        reached = set()
        for node, e in self.sets[state]:
            for letter, c in self.child[node].items():
                if letter == ch:
                    reached.add((c, e))
                elif e < self.limit[c]:
                    reached.add((c, e + 1))
            if e < self.limit[node]:
                reached.add((node, e + 1))
        return self._state(reached)

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, term number) of the nearest term, or None."""
        state, dead, letters = self.start, self.dead, self.letters
        for ch in word:
            ch = ch if ch in letters else ""  # letters of no term act alike
            after = self.next[state].get(ch)
            if after is None:
                after = self.next[state][ch] = self._step(state, ch)
            if after == dead:
                return None
            state = after
        return self.found[state]


class Matches(dict):
    """Match of each word met; a cache."""

    def __init__(self, automaton: TermAutomaton, never: frozenset[str] = frozenset()):
        super().__init__()
        self.automaton, self.never = automaton, never

    def __missing__(self, word):
        if len(self) > 2_000_000:
            self.clear()
        hit = self.automaton.match(word)
        self[word] = hit = None if hit and hit[0] and word in self.never else hit
        return hit


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit is quotation: in a line that begins with >, or with an open quotation mark before it and a closing one after it."""
    line = text.rfind("\n", 0, start) + 1
    if text[line:line + 12].lstrip().startswith(">"):
        return True
    left, right = text[max(line, start - WINDOW):start], text[end:end + WINDOW].split("\n", 1)[0]
    straight = left.count('"')
    if straight % 2 and '"' in right:
        return True
    opened = max((left.rfind(o) for o in OPENING[1:]), default=-1)
    closed = max((left.rfind(c) for c in CLOSING[1:] if c not in OPENING), default=-1)
    return opened > closed and any(c in right for c in CLOSING[1:])


@dataclass
class Model:
    """Terms with their log-odds, words that are near a term but harmless, and the weights of the features."""

    terms: list[str] = field(default_factory=list)
    odds: list[float] = field(default_factory=list)
    harmless: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=list)
    base: float = 0.0

    def matches(self) -> Matches:
        return Matches(TermAutomaton(self.terms), self.harmless)

    def features(self, text: str, matches: Matches) -> list[float]:
        """Sums of log-odds of exact, misspelled and quoted hits, the terms hit, and the length."""
        low = text.lower()
        words = WORD.findall(low)
        exact = fuzzy = aside = 0.0
        terms = set()
        if any([matches[w] for w in words]):
            for m in WORD.finditer(low):
                hit = matches[m.group()]
                if hit is None:
                    continue
                errors, term = hit
                if quoted(low, m.start(), m.end()):
                    aside += self.odds[term]
                elif errors:
                    fuzzy += self.odds[term]
                else:
                    exact += self.odds[term]
                    terms.add(term)
        counted = exact + QUOTED_SHARE * aside
        return [1.0, float(np.log1p(counted)), float(np.log1p(fuzzy)), float(np.log1p(len(terms))), float(np.log(len(words) + 20.0))]

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.base)
        return 1.0 / (1.0 + np.exp(-np.clip(features @ np.array(self.weights), -30, 30)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS,
          most_terms: int = MOST_TERMS, least_docs: int = LEAST_DOCS, least_odds: float = LEAST_ODDS) -> Model:
    """Learn from labelled rows outside the held-out fifth: at most ``rows`` of them, in the order of a hash of their ids.

    The lexicon holds the ``most_terms`` words that mark toxic texts most, of those in at least ``least_docs`` of them with log odds of ``least_odds`` or more.
    Several labels of one id count as their largest; ids and labels that are null are left out.  Without a toxic label the lexicon is empty.
    """
    known = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter(f"_id is not null and _y is not null")
             .filter(~held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y")))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # bounded, so it may be broadcast
    marked = docs.select(F.col(doc_id).alias("_id"), text_of(text).alias("_t")).join(F.broadcast(sample), "_id").select("_y", "_t")

    def count(batches):
        both: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                both[y > 0].update(set(WORD.findall(t.lower())))
                n[y > 0] += 1
        words = list(both[0].keys() | both[1].keys())
        yield pa.record_batch({"word": pa.array([None, *words], pa.string()), "clean": pa.array([n[0], *(both[0][w] for w in words)], pa.int64()),
                               "toxic": pa.array([n[1], *(both[1][w] for w in words)], pa.int64())})

    per_word = marked.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    try:
        total = per_word.filter("word is null").select("clean", "toxic").first()
        if not total or not total["toxic"]:
            return Model()
        n0, n1 = total["clean"], total["toxic"]
        odds = F.log((F.col("toxic") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n0 + 1.0))
        found = (per_word.filter(F.col("word").isNotNull() & (F.col("toxic") >= least_docs)).withColumn("odds", odds).filter(F.col("odds") >= least_odds)
                 .orderBy(F.desc(F.col("odds") * F.log("toxic")), "word").limit(most_terms).collect())
        model = Model([r["word"] for r in found], [round(r["odds"], 4) for r in found], base=n1 / (n0 + n1))

        def near(batches):
            matches = model.matches()
            for b in batches:
                hits = [w for w in b.column(0).to_pylist() if (h := matches[w]) and h[0]]
                yield pa.record_batch({"word": pa.array(hits, pa.string())})

        clean = per_word.filter("word is not null and clean > 0").select("word").mapInArrow(near, "word string")
        model.harmless = frozenset(r[0] for r in clean.collect())  # near a term, of a bounded sample
    finally:
        per_word.unpersist()
    table = marked.mapInArrow(lambda batches: _features(batches, model), "y int, x array<double>").toArrow()
    x, y = np.array(table.column("x").to_pylist()).reshape(-1, 5), table.column("y").to_numpy() > 0
    model.weights = logistic(x, y.astype(float)).tolist()
    return model


def _features(batches, model: Model):
    matches = model.matches()
    for b in batches:
        yield pa.record_batch({"y": b.column(0).cast(pa.int32()), "x": pa.array([model.features(t, matches) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))})


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` between 0 and 1; whole texts are read, null counts as empty, and an empty text has a score too.

    A column of that name in ``docs`` is replaced, unless it is the text, which is an error.
    """
    if score == text:
        raise ValueError("the score needs a column of its own")
    docs = docs.drop(score)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a bounded lexicon
    schema = TY.StructType([*docs.schema.fields, TY.StructField(score, TY.DoubleType())])

    def run(batches):
        model = held.value
        matches = model.matches()
        for b in batches:
            x = np.array([model.features(t or "", matches) for t in b.column(text).to_pylist()]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], names=[*b.schema.names, score])

    return docs.mapInArrow(run, schema)


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
