"""Toxicity by a weighted finite-state grammar of clauses.

A text is read as symbols: insult, threat, target, negation, reported speech, end of clause, other. Small transducers
(one keeps the target seen in this clause, one a negation within reach, one reported speech) are composed into one
machine, whose state is the tuple of theirs; an insult or a threat emits the path it was reached by. A text is scored by
the weighted counts of its paths, not by isolated words: the weights of the paths are learned, so negated or reported
matches may count less or not at all.

The insult lexicon is learned too: words and word beginnings that are in mostly toxic texts, beyond chance, among the labelled ones,
seen in several different surroundings, so that the words of one much-copied text do not enter. All features that pass by
documents take part in the vote by surroundings; only what the vote leaves is bounded. Threat, target, negation and
reporting words are short fixed lists.

Parameters that bound the fit: ``TRAIN_ROWS`` labelled documents outside the held-out fold, drawn by a hash of doc_id, and
``MAX_LEXEMES`` features with the strongest evidence by surroundings. Every text is scored whole.

* null and empty texts: no match; scored by the intercept
* repeated label rows: the largest label counts; null labels and null ids are not learned from
* no labels to learn from: no lexicon, score 0
* repeated rows: each is returned; empty table: no rows
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodica.llm.common import Scratch

TRAIN_ROWS = 20_000
MAX_LEXEMES = 4_000
MIN_SURROUNDINGS = 6
#: Log likelihood ratio against the share of toxic texts; of a million features by chance about one passes.
MIN_EVIDENCE = 14.0
MOSTLY = 0.9
STEMS = range(3, 9)
NEGATION_REACH = 3
#: Slots of the filter by which workers skip features that are no candidates; its size does not depend on their number.
SLOTS = 1 << 22

# Fixed word lists (English, German, French, Spanish).
THREATS = "kill hurt hang burn shoot stab töten umbringen verletzen tuer frapper matar golpear".split()
TARGETS = "you your yourself they them he she du dich dein ihr euch tu toi vous ton ustedes usted tú ellos".split()
NEGATIONS = "not never no isn aren wasn don doesn nicht kein keine niemals pas jamais nunca jamás".split()
REPORTS = "said says wrote writes quoted called reported sagte schrieb zitiert dit écrit dijo escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
_TOKENS = re.compile(r"[^\W\d_]+|[.!?;\n]+")


def tokens(text: str | None) -> list[str]:
    return _TOKENS.findall((text or "").lower())


@dataclass(frozen=True)
class Transducer:
    """A small machine: number of states and next state for (state, symbol); it starts in state 0."""

    states: int
    step: dict[tuple[int, int], int]

    def next(self, state: int, symbol: int) -> int:
        return self.step.get((state, symbol), state)


#: Does the clause name a target?
TARGETED = Transducer(2, {(0, TARGET): 1, (0, END): 0, (1, END): 0})
#: Is a negation within reach? Counts down with every symbol.
NEGATED = Transducer(
    NEGATION_REACH + 1,
    {(s, NEGATION): NEGATION_REACH for s in range(NEGATION_REACH + 1)}
    | {(s, x): max(0, s - 1) for s in range(NEGATION_REACH + 1) for x in (OTHER, INSULT, THREAT, TARGET, REPORT)}
    | {(s, END): 0 for s in range(NEGATION_REACH + 1)},
)
#: Is the clause reported speech?
REPORTED = Transducer(2, {(0, REPORT): 1, (1, END): 0})


class Grammar:
    """The composed machine as two tables: next state and emitted path (-1: none) for (state, symbol)."""

    def __init__(self, parts: tuple[Transducer, ...] = (TARGETED, NEGATED, REPORTED)) -> None:
        states = list(product(*(range(p.states) for p in parts)))
        number = {s: i for i, s in enumerate(states)}
        self.next = [[number[tuple(p.next(v, x) for p, v in zip(parts, s, strict=True))] for x in range(7)] for s in states]
        self.emit = [[self._path(s, x) for x in range(7)] for s in states]
        self.n_paths = 16

    @staticmethod
    def _path(state: tuple[int, ...], symbol: int) -> int:
        if symbol not in (INSULT, THREAT):
            return -1
        target, negated, reported = (int(v > 0) for v in state)
        return (symbol == THREAT) * 8 + target * 4 + negated * 2 + reported

    def counts(self, symbols: Iterator[int]) -> list[int]:
        found, state = [0] * self.n_paths, 0
        for symbol in symbols:
            path = self.emit[state][symbol]
            if path >= 0:
                found[path] += 1
            state = self.next[state][symbol]
        return found


@dataclass
class Lexicon:
    """Symbols of words: fixed lists, learned words and learned word beginnings."""

    words: frozenset[str]
    stems: frozenset[str]
    _seen: dict[str, int] = field(default_factory=dict)

    def __getstate__(self):
        return self.words, self.stems

    def __setstate__(self, state) -> None:
        self.words, self.stems, self._seen = *state, {}

    def symbol(self, word: str) -> int:
        known = self._seen.get(word)
        if known is None:
            if len(self._seen) > 500_000:
                self._seen.clear()
            known = self._seen[word] = self._look_up(word)
        return known

    def _look_up(self, word: str) -> int:
        if word[0] in ".!?;\n":
            return END
        if word in self.words or any(word[:k] in self.stems for k in STEMS if k <= len(word)):
            return INSULT
        for listed, symbol in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            if word in listed:
                return symbol
        return OTHER


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked with a star."""
    return [word, *(word[:k] + "*" for k in STEMS if k <= len(word))]


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({f for w in set(tokens(text)) for f in features_of(w)})
        names = list(counts[1])
        # A feature without a toxic text in this batch still counts against itself elsewhere.
        names += [f for f in counts[0] if f not in counts[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([counts[y][f] for f in names], pa.int64()) for y in (1, 0))],
            ["feature", "toxic", "clean"],
        )


def _surroundings(taken: np.ndarray):
    """Features whose slot is taken, with the words around their first place in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            seen = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = ["", *tokens(text), ""]
                met: dict[str, str] = {}  # the first place in this text only: a text speaks once for a feature
                for i in range(1, len(words) - 1):
                    word = words[i]
                    possible = known.get(word)
                    if possible is None:
                        if len(known) > 500_000:
                            known.clear()
                        possible = known[word] = tuple(f for f in features_of(word) if taken[zlib.crc32(f.encode()) % SLOTS])
                    for f in possible:
                        if f not in met:
                            met[f] = words[i - 1] + " " + words[i + 1]
                seen.update((f, around, toxic) for f, around in met.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[i] for s in seen], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32()))],
                ["feature", "around", "toxic"],
            )

    return run


def _path_counts(grammar: Grammar, lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grammar.counts(map(lexicon.symbol, tokens(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int64())), batch.column("toxic")], ["paths", "toxic"]
            )

    return run


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Texts of at most ``rows`` labelled documents outside the held-out fold: text, toxic."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # The chosen ids are bounded by ``rows``, so they may be sent to every executor.
    return docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _beyond_chance(counts: DataFrame, share: float) -> DataFrame:
    """Features (feature, toxic, clean, evidence) of mostly toxic texts."""
    texts = F.col("toxic") + F.col("clean")

    def surprise(seen: Column, part: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (texts * F.lit(part)))).otherwise(F.lit(0.0))

    evidence = surprise(F.col("toxic"), share) + surprise(F.col("clean"), 1 - share)
    mostly = (F.col("toxic") >= MIN_SURROUNDINGS) & (F.col("toxic") >= texts * F.lit(MOSTLY))
    return counts.withColumn("evidence", evidence).filter(mostly & (F.col("evidence") >= MIN_EVIDENCE))


def learn_lexicon(scratch: Scratch, sample: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    share = n_toxic / (n_toxic + n_clean)
    totals = (
        sample.mapInArrow(_feature_counts, "feature string, toxic long, clean long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    candidates = scratch.table(_beyond_chance(totals, share).select("feature"))
    slot = F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(SLOTS)).alias("slot")
    taken = np.zeros(SLOTS, dtype=bool)
    taken[candidates.select(slot).distinct().toPandas()["slot"].to_numpy(dtype=np.int64)] = True
    # Once more with one vote for each surrounding, so that a text with many copies speaks once.
    around = sample.mapInArrow(_surroundings(taken), "feature string, around string, toxic int")
    votes = (
        around.join(candidates, "feature", "left_semi")
        .distinct()
        .groupBy("feature")
        .agg(F.sum("toxic").cast("long").alias("toxic"), F.sum(1 - F.col("toxic")).cast("long").alias("clean"))
    )
    strongest = _beyond_chance(votes, share).orderBy(F.desc("evidence"), "feature").limit(MAX_LEXEMES)
    chosen = {r.feature for r in strongest.collect()}
    stems = frozenset(f[:-1] for f in chosen if f.endswith("*"))
    return Lexicon(frozenset(f for f in chosen if not f.endswith("*")), stems)


def learn_weights(paths: np.ndarray, toxic: np.ndarray, ridge: float = 0.5, rounds: int = 25) -> np.ndarray:
    """Logistic regression on log counts by Newton steps; the intercept comes last."""
    x = np.hstack([np.log1p(paths), np.ones((len(paths), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w -= np.linalg.solve(hessian, x.T @ (p - toxic) + penalty * w)
    return w


@dataclass
class Model:
    grammar: Grammar
    lexicon: Lexicon
    weights: np.ndarray | None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        paths = np.array([self.grammar.counts(map(self.lexicon.symbol, tokens(t))) for t in texts]).reshape(len(texts), -1)
        z = np.log1p(paths) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    scratch = Scratch(spark, "toxicity")
    sample = scratch.table(training_sample(docs, labels, rows))
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    grammar = Grammar()
    if not sizes.get(1) or not sizes.get(0):
        return Model(grammar, Lexicon(frozenset(), frozenset()), None)
    lexicon = learn_lexicon(scratch, sample, sizes[1], sizes[0])
    table = sample.mapInArrow(_path_counts(grammar, lexicon), "paths array<long>, toxic int").toPandas()
    weights = learn_weights(np.stack(table["paths"].to_numpy()).astype(float), table["toxic"].to_numpy().astype(float))
    return Model(grammar, lexicon, weights)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(spark, docs, labels, rows)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return read.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model = fit(spark, docs, labels, rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
