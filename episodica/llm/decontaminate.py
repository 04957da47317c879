"""Benchmark decontamination: size-partitioned MinHash containment, verified by exact shingle containment.

A short item inside a long document has a tiny similarity with the whole of it, so items are put into classes by their
number of shingles (doubling bounds) and each class reads a document as overlapping stretches of twice its bound: an item
that lies in the document lies whole in one stretch, and 80 percent of its shingles there are a similarity of about a
fifth or more, whatever the length of the document. Minima of small blocks are computed once for every coordinate and
joined for larger classes, so each class costs half of the one before. A stretch and an item that share a (coordinate,
value) pair are a candidate; with ``COORDINATES`` of them a stretch at the lowest such similarity is missed with a
probability of about 1e-6. Candidates are confirmed by counting the item's distinct shingles in the whole document.

Documents are never shuffled. Tasks make the shingles and minima of the items and store them. They come in blocks of a
bounded number of items and shingles; each block passes the driver on its way to the executors, meets all documents, and
is released before the next, so a large benchmark takes more passes, not more memory.

* null and empty items match nothing; null and empty documents have no match
* texts with fewer words than a shingle are one shingle: such an item is found in documents that are equal to it in words
* words are compared in lower case (A-Z); repeated items and rows are each reported; null item_id is kept
* very long documents are read whole; empty tables: no rows
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from episodica.llm import kernels as K
from episodica.llm.common import Scratch, Shared

SHINGLE_WORDS = 5
PERCENT = 80
COORDINATES = 64
#: Bound of the smallest size class. Blocks are as small as the smallest class that has items.
SMALLEST = 2
#: Items of one pass over the documents, and their shingles.
ITEMS_PER_PASS, SHINGLES_PER_PASS = 20_000, 4_000_000

_random = np.random.Generator(np.random.Philox(11))
_A, _B = (_random.integers(0, 2**32, size=(COORDINATES, 1), dtype=np.uint32) | np.uint32(1) for _ in range(2))


def coordinate_values(shingles: np.ndarray) -> np.ndarray:
    """Hash of each shingle under each coordinate: a table (coordinate, shingle)."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    values = _A * low
    values += _B * high
    return values


@dataclass
class Items:
    """The items of one pass: ids, sorted distinct shingles and minima of each, and by size class the minima in one sorted array."""

    ids: list[int | None]
    sets: list[np.ndarray]
    minima: list[np.ndarray]

    def __post_init__(self) -> None:
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_bound: dict[int, list[int]] = {}
        for i, found in enumerate(self.sets):
            if len(found):
                bound = SMALLEST
                while bound < len(found):
                    bound *= 2
                by_bound.setdefault(bound, []).append(i)
        for bound, members in sorted(by_bound.items()):
            keys = np.concatenate([_keys(self.minima[i]) for i in members])
            owner = np.repeat(np.array(members), COORDINATES)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            likely = np.zeros(1 << 20, dtype=bool)
            likely[_slot(keys)] = True
            self.classes[bound] = keys, owner, likely

    def candidates(self, shingles: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """Pairs (text, item) with a common minimum. bounds: shingle offsets of the texts, text: number of each shingle."""
        found: set[tuple[int, int]] = set()
        if not len(shingles) or not self.classes:
            return found
        block = min(self.classes)  # blocks end where a text ends
        within = np.arange(len(shingles)) - np.repeat(bounds[:-1], np.diff(bounds))
        starts = np.flatnonzero(within % block == 0)
        owner = text[starts]
        minima = np.empty((COORDINATES, len(starts)), dtype=np.uint32)
        for at in range(0, len(starts), 256):  # keeps the table of hashes in cache
            low = starts[at]
            high = starts[at + 256] if at + 256 < len(starts) else len(shingles)
            minima[:, at : at + 256] = np.minimum.reduceat(coordinate_values(shingles[low:high]), starts[at : at + 256] - low, axis=1)
        bound, largest = block, max(self.classes)
        while bound <= largest:
            # minima: stretches of ``bound`` shingles; two neighbours of one text make a stretch that holds any item.
            follow = np.append(owner[1:] == owner[:-1], False)
            wide = minima.copy()
            pair = np.flatnonzero(follow)
            wide[:, pair] = np.minimum(minima[:, pair], minima[:, pair + 1])
            if bound in self.classes:
                self._look_up(self.classes[bound], wide, owner, found)
            # Every second stretch of each text, twice as wide.
            first = np.append(True, owner[1:] != owner[:-1])
            rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
            keep = rank % 2 == 0
            minima, owner, bound = wide[:, keep], owner[keep], bound * 2
        return found

    @staticmethod
    def _look_up(known, minima: np.ndarray, owner: np.ndarray, found: set[tuple[int, int]]) -> None:
        keys, items, likely = known
        all_keys = _keys(minima)
        rows, columns = np.nonzero(likely[_slot(all_keys)])
        picked = all_keys[rows, columns]
        low, high = np.searchsorted(keys, picked, side="left"), np.searchsorted(keys, picked, side="right")
        for c, a, b in zip(columns[high > low], low[high > low], high[high > low], strict=True):
            for item in items[a:b]:
                found.add((int(owner[c]), int(item)))


def _keys(minima: np.ndarray) -> np.ndarray:
    """(coordinate, value) as one number."""
    coordinate = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
    return minima.astype(np.uint64) + (coordinate[:, None] if minima.ndim == 2 else coordinate)


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of rows: first row, shingles in order, shingle offsets."""
    data, offsets = K.text_buffer(texts)
    for low, high in K.row_pieces(offsets):
        begin, end = offsets[low], offsets[high]
        words = K.Words(data[begin:end], offsets[low : high + 1] - begin)
        yield low, *K.shingles(words.hashes(fold_ascii=True), words.offsets, SHINGLE_WORDS)


_SHINGLED = pa.schema([("item_id", pa.int64()), ("shingles", pa.list_(pa.int64())), ("minima", pa.list_(pa.int64()))])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingle hashes of each item, and their minimum under each coordinate."""
    for batch in batches:
        for low, h, b in _word_hashes(batch.column("text")):
            n = len(b) - 1
            sets = [np.unique(h[b[i] : b[i + 1]]) for i in range(n)]
            minima = [coordinate_values(s).min(axis=1).astype(np.int64) if len(s) else [] for s in sets]
            columns = [pa.array(c, pa.list_(pa.int64())) for c in ([s.view(np.int64) for s in sets], minima)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(low, n), *columns], schema=_SHINGLED)


def item_passes(spark: SparkSession, benchmark: DataFrame) -> Iterator[Items]:
    """Blocks of a bounded number of items and shingles.

    Tasks make shingles and minima and store them; the driver reads finished hashes and holds two blocks at most.
    """
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    shingled = Scratch(spark, "items").table(named.mapInArrow(_shingled, "item_id long, shingles array<long>, minima array<long>"))
    ids, sets, minima, size = [], [], [], 0
    for row in shingled.toLocalIterator():
        ids.append(row.item_id)
        sets.append(np.array(row.shingles, np.int64).view(np.uint64))
        minima.append(np.array(row.minima, np.uint32))
        size += len(row.shingles)
        if len(ids) >= ITEMS_PER_PASS or size >= SHINGLES_PER_PASS:
            yield Items(ids, sets, minima)
            ids, sets, minima, size = [], [], [], 0
    if ids:
        yield Items(ids, sets, minima)


def matches(items: Items, texts: pa.Array, percent: int) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of every item of which a text holds at least ``percent`` of the shingles."""
    for low, shingles, bounds in _word_hashes(texts):
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for row, item in sorted(items.candidates(shingles, text, bounds)):
            own = items.sets[item]
            shared = int(np.isin(own, shingles[bounds[row] : bounds[row + 1]]).sum())
            if 100 * shared >= percent * len(own):
                yield low + row, item, shared


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item_shingles", pa.int64()), ("n_shared", pa.int64())]
)


def contaminated_pairs(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, item_id, n_item_shingles, n_shared) for every document that holds an item."""
    rows, scratch = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), Scratch(spark, "leaks")
    result = spark.createDataFrame([], "doc_id long, item_id long, n_item_shingles long, n_shared long")
    for items in item_passes(spark, benchmark):
        sent = Shared(spark, items)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                hits = list(matches(known, batch.column("text"), percent))
                columns = [
                    [ids[r] for r, _, _ in hits],
                    [known.ids[i] for _, i, _ in hits],
                    [len(known.sets[i]) for _, i, _ in hits],
                    [n for _, _, n in hits],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_RESULT)

        # The rows of a block are stored, so its broadcast can go before the next one comes.
        result = result.union(scratch.table(rows.mapInArrow(find, result.schema)))
        sent.release()
    return result


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    scratch, passes = Scratch(spark, "clean"), item_passes(spark, benchmark)
    items = next(passes, None)
    while items is not None:
        sent = Shared(spark, items)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[r for r, _, _ in matches(known, batch.column("text"), percent)]] = False
                yield batch.filter(pa.array(clean))

        docs, items = docs.mapInArrow(keep, docs.schema), next(passes, None)
        if items is not None:
            # What a block leaves is stored, so its broadcast can go before the next one comes.
            docs = scratch.table(docs)
            sent.release()
    return docs
