"""Language identification with interpolated Kneser-Ney character models.

Training counts the 5-grams of letters per language in Spark; continuation counts of the lower orders follow from them by
grouping. The model is a set of sorted arrays of 64-bit n-gram hashes, one per order, with the log probability under every
language at once (a seen n-gram is stored fully interpolated, an unseen one backs off with the weight of its context).
A text goes to the language with the lowest cross-entropy per letter.

Parameters that bound the fit: ``sample_rows`` documents per language (chosen by a hash of doc_id), of which one in
``CALIBRATION_SHARE`` sets the rejection threshold of its language and is left out of the counts, if ``MIN_COUNTED`` others
remain; a language with fewer is learned from all its documents and rejects none. Every text is scored whole. Text is lower-cased; every run of other characters than letters counts as one space.

* null text or no letter: ``und``, score 0, not rejected
* rejected: the best cross-entropy is higher than that of ``1 - REJECT_SHARE`` of the calibration texts of the language,
  with a margin; ``lang_pred`` still names the nearest language
* ties: the first language in alphabetical order
* repeated rows: each is returned; null lang: no training row; nothing to learn from: all ``und``
* empty table: no rows
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodica.llm import kernels as K
from episodica.llm.common import Scratch

ORDER = 5
SAMPLE_ROWS = 1500
CALIBRATION_SHARE = 5
MIN_COUNTED = 20
REJECT_SHARE = 0.002
REJECT_MARGIN = 0.5  # nats per letter
#: Counts of more languages than this are joined by a shuffle.
MAX_BROADCAST_LANGUAGES = 10_000
#: Letters beyond which a longer text does not make the score surer.
SCORE_LETTERS = 60
PIECE_LETTERS = 1 << 20

_IS_LETTER: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _IS_LETTER[0]


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, with 0 for each run of other characters, and 0 at both ends."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letter_table()[points], points, 0)
    points = np.concatenate([[0], points, [0]]).astype(np.uint32)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    return points[keep]


def has_letter(points: np.ndarray) -> bool:
    return len(points) > 1


def _values(points: np.ndarray) -> np.ndarray:
    return K.mix(points.astype(np.uint64) + np.uint64(0x51ED))


class Table:
    """A sorted array of hashes; a search starts from the bucket of the upper bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64(2**64 - 1))
        self.bits = max(1, int(np.ceil(np.log2(len(hashes) + 1))))
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.starts = np.searchsorted(self.hashes[:-1], edges).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        at = self.starts[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        behind = np.flatnonzero(self.hashes[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < h[behind]]
        return np.where((self.hashes[at] == h) & (at < len(self.hashes) - 1), at, -1)


@dataclass
class Model:
    """languages; by order (from 1): table of n-grams, log probability and log back-off weight of each by language."""

    languages: list[str]
    tables: list[Table]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray  # log probability of a letter never seen
    limits: np.ndarray | None = None

    def letter_scores(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sum of log probabilities under every language for the stretches of points that begin at starts."""
        rolling = K.Rolling(_values(points), K._WORD_BASES[0])
        n = len(points)
        doc_start = np.repeat(starts, np.diff(np.append(starts, n)))
        ends = np.arange(1, n + 1)
        room = np.minimum(ends - doc_start, ORDER)  # the order that fits before each letter
        total = np.zeros((n, len(self.languages)), dtype=np.float32)
        open_ = np.arange(n)
        for order in range(ORDER, 0, -1):
            fits = open_[room[open_] >= order]
            if not len(fits):
                continue
            e = ends[fits]
            at = self.tables[order - 1].find(rolling(e - order, e))
            hit = at >= 0
            total[fits[hit]] += self.logp[order - 1][at[hit]]
            missed = fits[~hit]
            if order > 1 and len(missed):
                e = ends[missed]
                context = self.tables[order - 2].find(rolling(e - order, e - 1))
                known = context >= 0
                total[missed[known]] += self.backoff[order - 2][context[known]]
            elif order == 1:
                total[missed] += self.floor
            left = np.zeros(n, dtype=bool)
            left[open_] = True
            left[fits[hit]] = False
            open_ = np.flatnonzero(left)
        return np.add.reduceat(total.astype(np.float64), starts, axis=0)

    def cross_entropy(self, texts: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy in nats per letter of each text under every language; texts have a letter each."""
        sums = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        for low, high in K.row_pieces(offsets, PIECE_LETTERS):
            if high - low == 1 and sizes[low] > PIECE_LETTERS:
                for at in range(0, sizes[low], PIECE_LETTERS):  # a very long text: the pieces add up
                    piece = texts[low][at : at + PIECE_LETTERS]
                    sums[low] += self.letter_scores(piece, np.zeros(1, np.int64))[0]
            else:
                sums[low:high] = self.letter_scores(np.concatenate(texts[low:high]), offsets[low:high] - offsets[low])
        return -sums / sizes[:, None]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            points = letters(text)
            if has_letter(points):
                points = np.concatenate([np.zeros(ORDER - 2, np.uint32), points])
                if len(points) >= ORDER:
                    grams, n = np.unique(np.lib.stride_tricks.sliding_window_view(points, ORDER), axis=0, return_counts=True)
                    for gram, c in zip(grams, n, strict=True):
                        counts[lang, gram.tobytes()] += int(c)
        rows = [(lang, gram, c) for (lang, gram), c in counts.items()]
        yield pa.RecordBatch.from_pydict(
            {"lang": [r[0] for r in rows], "gram": [r[1] for r in rows], "n": [r[2] for r in rows]},
            pa.schema([("lang", pa.string()), ("gram", pa.binary()), ("n", pa.int64())]),
        )


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` labelled documents of each language outside the held-out fold."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # Languages are counted apart, so that no text moves: every task draws its own rows.
    sizes = Scratch(docs.sparkSession, "languages").table(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST_LANGUAGES else sizes
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) * F.col("rows")
    drawn = rows.select("doc_id", "lang", "text").join(sizes, "lang").filter(draw < F.lit(sample_rows * 1_000_000))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(CALIBRATION_SHARE))
    return drawn.select("lang", "text", (part == 0).alias("calibrates"))


def build(counts: pd.DataFrame, languages: list[str]) -> Model:
    """Interpolated Kneser-Ney from the counts (lang, gram, n) of the highest order."""
    column = {lang: i for i, lang in enumerate(languages)}
    grams = np.frombuffer(b"".join(counts["gram"]), np.uint32).reshape(-1, ORDER)
    where, n = counts["lang"].map(column).to_numpy(), counts["n"].to_numpy().astype(np.float64)
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for order in range(ORDER, 0, -1):
        unique, inverse = np.unique(grams, axis=0, return_inverse=True)
        table = np.zeros((len(unique), len(languages)))
        np.add.at(table, (inverse.reshape(-1), where), n)
        levels.insert(0, (unique, table))
        # Below the highest order an n-gram counts the letters seen before it.
        place, lang = np.nonzero(table)
        grams, where, n = unique[place][:, 1:], lang, np.ones(len(place))
    hashes = [K.word_sequence_hashes(_values(u.ravel()))(np.arange(0, u.size, o), np.arange(o, u.size + 1, o)) for o, (u, _) in enumerate(levels, 1)]
    tables = [Table(h) for h in hashes]
    logp: list[np.ndarray] = []
    backoff: list[np.ndarray] = []
    lower = None
    vocabulary = len(levels[0][0]) + 1
    for order, ((unique, table), index) in enumerate(zip(levels, tables, strict=True), 1):
        ones, twos = (table == 1).sum(), (table == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.75
        if order == 1:
            total, kinds = table.sum(axis=0), (table > 0).sum(axis=0)
            rest = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            p = np.maximum(table - discount, 0) / np.maximum(total, 1) + rest / vocabulary
            floor = np.log(rest / vocabulary)
            p = p[index.order]
        else:
            below = tables[order - 2]
            prefix = below.find(K.word_sequence_hashes(_values(unique[:, :-1].ravel()))(np.arange(0, unique.shape[0] * (order - 1), order - 1), np.arange(order - 1, unique.shape[0] * (order - 1) + 1, order - 1)))
            suffix = below.find(K.word_sequence_hashes(_values(unique[:, 1:].ravel()))(np.arange(0, unique.shape[0] * (order - 1), order - 1), np.arange(order - 1, unique.shape[0] * (order - 1) + 1, order - 1)))
            # A context that begins a text may be missing below; it then has no weight of its own.
            total, kinds = np.zeros((len(levels[order - 2][0]) + 1, len(languages))), np.zeros((len(levels[order - 2][0]) + 1, len(languages)))
            np.add.at(total, prefix, table)
            np.add.at(kinds, prefix, table > 0)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            weight[-1] = 1.0
            backoff.append(np.log(weight[:-1]).astype(np.float32))
            p = np.where(total[prefix] > 0, np.maximum(table - discount, 0) / np.maximum(total[prefix], 1), 0)
            p = p + weight[prefix] * np.where((suffix >= 0)[:, None], lower[suffix], 1 / vocabulary)
            p = p[index.order]
        lower = p
        logp.append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
    return Model(languages, tables, logp, backoff, floor.astype(np.float32))


def fit(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    sample = Scratch(spark, "language").table(training_sample(docs, sample_rows))
    left = F.count_if(~F.col("calibrates") & F.col("text").rlike(r"\p{L}"))
    sample = sample.join(F.broadcast(sample.groupBy("lang").agg((left >= MIN_COUNTED).alias("enough"))), "lang")
    sample = sample.select("lang", "text", (F.col("calibrates") & F.col("enough")).alias("calibrates"))
    grams = sample.filter("NOT calibrates").mapInArrow(_gram_counts, "lang string, gram binary, n long")
    counts = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    counts["gram"] = counts["gram"].map(bytes)
    model = build(counts.sort_values(["lang", "gram"]), sorted(counts["lang"].unique()))
    seen = sample.filter("calibrates").mapInArrow(_own_entropy(pickle.dumps(model)), "lang string, h double").toPandas()
    limits = seen.groupby("lang")["h"].quantile(1 - REJECT_SHARE) + REJECT_MARGIN
    model.limits = np.array([limits.get(lang, np.inf) for lang in model.languages])
    return model


def _own_entropy(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        for batch in batches:
            pairs = [(lang, letters(t)) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            pairs = [p for p in pairs if has_letter(p[1]) and p[0] in model.languages]
            if pairs:
                h = model.cross_entropy([p[1] for p in pairs])
                own = [float(h[i, model.languages.index(p[0])]) for i, p in enumerate(pairs)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array(own)], ["lang", "h"])

    return run


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())]
)


def _predict(model_bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = pickle.loads(model_bytes.value)
        for batch in batches:
            texts = [letters(t) for t in batch.column("text").to_pylist()]
            n = len(texts)
            lang, score, entropy, rejected = ["und"] * n, np.zeros(n), [None] * n, np.zeros(n, dtype=bool)
            own = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            if own:
                h = model.cross_entropy([texts[i] for i in own])
                best = h.argmin(axis=1)
                size = np.minimum([len(texts[i]) for i in own], SCORE_LETTERS)
                odds = np.exp(-(h - h.min(axis=1, keepdims=True)) * size[:, None])
                for j, i in enumerate(own):
                    lang[i], score[i] = model.languages[best[j]], 1 / odds[j].sum()
                    entropy[i] = float(h[j, best[j]])
                    rejected[i] = entropy[i] > model.limits[best[j]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score), pa.array(entropy, pa.float64()), pa.array(rejected)],
                schema=_RESULT,
            )

    return run


def language_id(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, entropy (nats per letter), rejected."""
    model = spark.sparkContext.broadcast(pickle.dumps(fit(spark, docs, sample_rows)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, entropy double, rejected boolean")
