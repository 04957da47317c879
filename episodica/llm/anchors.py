"""Windows that occur more than once, found by minimisers: what byte and word substring dedup share.

A window is a fixed number of units (bytes or words) of one document. Its minimiser is a short stretch in it that depends
on its content alone, so equal windows have equal minimisers at equal places. Consecutive windows with one minimiser
form a segment. Three steps use this:

1. every segment sends the hash of its minimiser; hashes that no other segment has are done, as are their windows
2. segments with a shared minimiser travel whole to the task of that minimiser, where whole contents are compared
3. what is found returns to its document as spans of units

A minimiser with more than ``heavy`` segments would fill one task. Its windows go one by one as 128-bit digests instead,
which partial aggregates per task reduce before the shuffle and a join that may be split brings back. Step 3 and both
branches of step 2 read one exchange of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from episodica.llm import kernels as K
from episodica.llm.common import ROW_KEY, Scratch, per_key, row_key

#: Above this many segments the windows of a minimiser go one by one.
HEAVY_SEGMENTS = 20_000
#: A piece of a very long document; windows that lie across a cut belong to one piece only.
PIECE_UNITS = 1 << 22


@dataclass(frozen=True)
class Runs:
    """Segments of some texts: text number, first window, last window + 1, minimiser place and hash."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    anchor: np.ndarray


@dataclass(frozen=True)
class Units:
    """How texts are cut: the unit, the window and the length of the minimiser, in units."""

    words: bool
    window: int
    gram: int

    def load(self, data: np.ndarray, offsets: np.ndarray) -> "Loaded":
        return Loaded(self, data, offsets)


class Loaded:
    """Some texts in units: hashes of stretches, and the bytes behind a range of units."""

    def __init__(self, units: Units, data: np.ndarray, offsets: np.ndarray) -> None:
        self.units, self.data = units, data
        self.words = K.Words(data, offsets) if units.words else None
        self.offsets = self.words.offsets if units.words else offsets

    def rolling(self, low: int, high: int, which: int = 0) -> K.Rolling:
        if self.words is None:
            return K.byte_hashes(self.data[low:high], which)
        data, starts, ends = self.data, self.words.starts[low:high], self.words.ends[low:high]
        if not len(starts):
            return K.word_sequence_hashes(np.zeros(0, np.uint64), which)
        begin = starts[0]
        hashes = K.byte_hashes(data[begin : ends[-1]], which)(starts - begin, ends - begin)
        return K.word_sequence_hashes(hashes, which)

    def body(self, low: int, high: int) -> bytes:
        if self.words is None:
            return self.data[low:high].tobytes()
        return self.data[self.words.starts[low] : self.words.ends[high - 1]].tobytes()

    def runs(self) -> Iterator[tuple[int, K.Rolling, Runs]]:
        """Segments piece by piece, with the unit at which the piece begins; places count from there."""
        window, gram, offsets = self.units.window, self.units.gram, self.offsets
        low = 0
        while low < offsets[-1]:
            high = min(low + PIECE_UNITS, int(offsets[-1]))
            cut = np.clip(offsets, low, high)
            rolling = self.rolling(low, high)
            text, first, last, place = K.minimiser_runs(rolling.all_of(gram), cut - low, window, gram)
            yield low, rolling, Runs(text, first, last, place, rolling(place, place + gram))
            if high == offsets[-1]:
                return
            low = high - window + 1


def _pieces(batch: pa.RecordBatch, units: Units) -> Iterator[tuple[int, Loaded]]:
    data, offsets = K.text_buffer(batch.column("text"))
    for low, high in K.row_pieces(offsets):
        begin, end = offsets[low], offsets[high]
        yield low, units.load(data[begin:end], offsets[low : high + 1] - begin)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _occurrences(units: Units) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, rk = (batch.column(c).to_numpy() for c in ROW_KEY)
            for low, loaded in _pieces(batch, units):
                for _, _, runs in loaded.runs():
                    # A text of few words over and over has one minimiser very often: one row with its number.
                    order = np.lexsort((runs.anchor, runs.text))
                    text, anchor = runs.text[order], runs.anchor[order]
                    new = np.ones(len(order), dtype=bool)
                    new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
                    first = np.flatnonzero(new)
                    rows = text[first] + low
                    columns = did[rows], rk[rows], _signed(anchor[first]), np.diff(np.append(first, len(order)))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*ROW_KEY, "anchor", "n"])

    return scan


def _emit_segments(units: Units) -> Callable:
    """Segments whose minimiser is shared but not heavy."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, rk = (batch.column(c).to_numpy() for c in ROW_KEY)
            shared = batch.column("light")
            for low, loaded in _pieces(batch, units):
                out: dict[str, list] = {c: [] for c in ("anchor", *ROW_KEY, "start", "lead", "body")}
                for base, _, runs in loaded.runs():
                    for i in np.flatnonzero(_wanted(runs, shared, low)):
                        text, first = runs.text[i], int(runs.first[i]) + base
                        last = int(runs.last[i]) + base - 1 + units.window
                        out["anchor"].append(int(_signed(runs.anchor[i : i + 1])[0]))
                        out["did"].append(int(did[low + text]))
                        out["rk"].append(int(rk[low + text]))
                        out["start"].append(first - int(loaded.offsets[text]))
                        out["lead"].append(int(runs.place[i]) + base - first)
                        out["body"].append(loaded.body(first, last))
                if out["body"]:
                    yield pa.RecordBatch.from_pydict(out, SEGMENT_ARROW)

    return emit


def _emit_windows(units: Units) -> Callable:
    """The windows of heavy minimisers, as digests."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, rk = (batch.column(c).to_numpy() for c in ROW_KEY)
            heavy = batch.column("heavy")
            for low, loaded in _pieces(batch, units):
                for base, rolling, runs in loaded.runs():
                    pick = np.flatnonzero(_wanted(runs, heavy, low))
                    if not len(pick):
                        continue
                    n = runs.last[pick] - runs.first[pick]
                    begin = np.repeat(runs.first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    text = np.repeat(runs.text[pick], n)
                    second = loaded.rolling(base, base + int(begin.max()) + units.window, 1)
                    columns = [
                        _signed(rolling(begin, begin + units.window)), _signed(second(begin, begin + units.window)),
                        did[low + text], rk[low + text], (begin + base - loaded.offsets[text]).astype(np.int32),
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", *ROW_KEY, "start"])

    return emit


def _wanted(runs: Runs, lists: pa.ListArray, low: int) -> np.ndarray:
    """Which segments have a minimiser in the list of their own text."""
    keep = np.zeros(len(runs.text), dtype=bool)
    bounds = np.flatnonzero(np.diff(runs.text)) + 1 if len(runs.text) else []
    for part in np.split(np.arange(len(runs.text)), bounds):
        if len(part):
            own = lists[low + int(runs.text[part[0]])].values
            if own is not None and len(own):
                keep[part] = np.isin(_signed(runs.anchor[part]), own.to_numpy())
    return keep


SEGMENT_ARROW = pa.schema(
    [("anchor", pa.int64()), ("did", pa.int64()), ("rk", pa.int64()), ("start", pa.int32()), ("lead", pa.int32()), ("body", pa.binary())]
)
_KEY = "did long, rk long"


def grouped(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted segments re-cut so that each batch holds whole minimisers and not much more than the limits."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < most_rows and sum(b.nbytes for b in held) < most_bytes:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        anchors = whole.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchors == anchors[-1], True)) if len(anchors) else 0
        if cut:
            yield whole.slice(0, cut)
            held = [whole.slice(cut)]
        else:
            held = [whole]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def with_spans(
    spark: SparkSession,
    docs: DataFrame,
    units: Units,
    compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    other_documents: bool,
    name: str,
    heavy: int = HEAVY_SEGMENTS,
) -> DataFrame:
    """Every row as (did, rk, text, starts, ends): the spans of units that its repeated windows cover.

    compare: takes sorted segments, whole minimisers together, and gives (did, rk, start, end). other_documents: a window
    counts where a document with a smaller doc_id has it; else where it starts anywhere else.
    """
    scratch = Scratch(spark, name)
    keyed = docs.select(*row_key(), "text")
    occurrences = scratch.table(keyed.mapInArrow(_occurrences(units), f"{_KEY}, anchor long, n long"))
    shared = (
        per_key(occurrences, ["anchor"], F.sum("n").alias("n"), F.min("did").alias("low"), F.max("did").alias("high"))
        .filter("low <> high" if other_documents else "n > 1")
        .select("anchor", (F.col("n") > heavy).alias("is_heavy"))
    )
    marks = scratch.table(
        occurrences.join(shared, "anchor")
        .groupBy(*ROW_KEY)
        .agg(
            F.collect_set(F.when(~F.col("is_heavy"), F.col("anchor"))).alias("light"),
            F.collect_set(F.when(F.col("is_heavy"), F.col("anchor"))).alias("heavy"),
        )
    )
    texts = keyed.repartition(*ROW_KEY)

    def marked(kind: str) -> DataFrame:
        chosen = marks.filter(F.size(kind) > 0).select(*ROW_KEY, kind)
        return texts.join(chosen.hint("shuffle_hash"), ROW_KEY)

    segments = (
        marked("light")
        .mapInArrow(_emit_segments(units), f"anchor long, {_KEY}, start int, lead int, body binary")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
    )
    found = segments.mapInArrow(compare, f"{_KEY}, start int, end int")

    windows = marked("heavy").mapInArrow(_emit_windows(units), f"h1 long, h2 long, {_KEY}, start int")
    at = F.struct(*ROW_KEY, "start")
    first = per_key(windows, ["h1", "h2"], F.min(at).alias("first"), F.max(at).alias("final"))
    first = first.filter("first.did <> final.did" if other_documents else "first <> final")
    again = windows.join(first, ["h1", "h2"])
    if other_documents:
        again = again.filter("did > first.did")
    found = found.union(again.select(*ROW_KEY, "start", (F.col("start") + units.window).alias("end")))

    spans = found.groupBy(*ROW_KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.select(*ROW_KEY, F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    return texts.join(spans.hint("shuffle_hash"), ROW_KEY, "left")
