"""Substring dedup on words: super-k-mers sorted by minimiser.

Consecutive windows of 50 words that share a minimiser travel as one packed string (``anchors``) to the task of that
minimiser. There words become exact numbers, windows are sorted by a hash of those numbers, neighbours are compared word
by word, and each run of equal windows is counted with its smallest doc_id. A word goes if a window that covers it also
starts in a document with a smaller doc_id; windows are judged on the input.

* null, empty or short text (fewer words than a window): nothing goes
* ties: the smallest doc_id keeps its words; a null doc_id is the smallest; copies within one document stay
* repeated rows of one doc_id and text count as one document
* very long texts: cut into overlapping pieces; every window belongs to one piece
* empty table: no rows
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from episodica.llm import kernels as K
from episodica.llm.anchors import HEAVY_SEGMENTS, Units, grouped, with_spans
from episodica.llm.common import NULL_ID

WINDOW = 50
MINIMISER_WORDS = 8
MOST_ROWS, MOST_BYTES = 20_000, 8 << 20


def window_classes(ids: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort windows by content. Returns the order and the places in it at which a new class begins."""
    hashes = K.word_sequence_hashes(K.mix(ids.astype(np.uint64) + np.uint64(1)))(starts, starts + window)
    order = np.argsort(hashes, kind="stable")
    sorted_hashes, sorted_starts = hashes[order], starts[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    same = np.flatnonzero(~new)
    for k in range(window):
        if (ids[sorted_starts[same] + k] != ids[sorted_starts[same - 1] + k]).any():  # equal hashes of different words
            table = ids[starts[:, None] + np.arange(window)]
            _, classes = np.unique(table, axis=0, return_inverse=True)
            classes = classes.reshape(-1)
            order = np.argsort(classes, kind="stable")
            new[1:] = classes[order][1:] != classes[order][:-1]
            break
    return order, np.flatnonzero(new)


def compare_windows(window: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, MOST_ROWS, MOST_BYTES):
            split = [body.split() for body in batch.column("body").to_pylist()]
            counts = np.array([len(words) for words in split])
            ids = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode().indices.to_numpy()
            n = counts - window + 1
            row = np.repeat(np.arange(len(n)), n)
            begin = np.cumsum(counts) - counts
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            order, classes = window_classes(ids, begin[row] + offset, window)
            did = batch.column("did").to_numpy()
            sizes = np.diff(np.append(classes, len(order)))
            smallest = np.repeat(np.minimum.reduceat(did[row[order]], classes), sizes)
            gone = np.zeros(len(order), dtype=bool)
            gone[order] = did[row[order]] > smallest
            # Runs of removed windows of one segment become one span.
            new = gone.copy()
            new[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
            last = gone.copy()
            last[:-1] &= ~gone[1:] | (row[1:] != row[:-1])
            s, e = np.flatnonzero(new), np.flatnonzero(last)
            if len(s):
                start = batch.column("start").to_numpy()[row[s]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(did[row[s]]), pa.array(batch.column("rk").to_numpy()[row[s]]),
                        pa.array((start + offset[s]).astype(np.int32)), pa.array((start + offset[e] + window).astype(np.int32)),
                    ],
                    ["did", "rk", "start", "end"],
                )

    return compare


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.small_batches(batches):
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": []}
        rows = zip(*(batch.column(c) for c in ("did", "text", "starts", "ends")), strict=True)
        for did, text, starts, ends in rows:
            words = (text.as_py() or "").encode().split()
            removed = 0
            if starts.is_valid:
                gone = K.mark(len(words), starts.values.to_numpy(), ends.values.to_numpy())
                removed = int(gone.sum())
                words_kept = [w for w, g in zip(words, gone, strict=True) if not g]
            else:
                words_kept = words
            key = did.as_py()
            out["doc_id"].append(None if key == NULL_ID else key)
            out["n_words"].append(len(words))
            out["n_removed"].append(removed)
            out["kept_text"].append(b" ".join(words_kept).decode())
        yield pa.RecordBatch.from_pydict(
            out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
        )


def window_dedup(
    spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = MINIMISER_WORDS, heavy: int = HEAVY_SEGMENTS
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    joined = with_spans(spark, docs, Units(True, window, gram), compare_windows(window), True, "windows", heavy)
    return joined.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string")
