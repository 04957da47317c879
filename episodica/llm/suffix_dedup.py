"""Substring dedup on bytes: repeated 400-byte strings by column-wise construction.

Inserting one symbol per document each round takes as many rounds as the longest document has bytes if documents are
aligned at an end. Here documents are cut into segments aligned at a shared minimiser (``anchors``), so a collection has
at most 2 * 400 columns, and equal strings stand in equal columns. Each round inserts one symbol per segment: the
collection's Burrows-Wheeler order (segments sorted by what they hold up to this column, read backwards) is updated by a
stable sort by the new symbol, and the length of the common part with the neighbour before by a range minimum. A string
of 400 bytes that ends in a column is repeated if the common part with either neighbour in the order is 400 or more.
Columns are read one after the other; the segments come from Spark's external sort, a few megabytes at a time.

* null and empty texts, texts shorter than the string: nothing goes
* the same string twice in one document counts; overlaps count; all copies go, the first one too
* repeated rows of one doc_id and text count as one document
* very long texts: cut into overlapping pieces; every string belongs to one piece
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

LENGTH = 400
MINIMISER_BYTES = 128
MOST_ROWS, MOST_BYTES = 16_000, 8 << 20


def repeated_columns(group: np.ndarray, lead: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, int]:
    """For each segment and column: does the string of ``length`` bytes that starts there recur in its group?

    group: ascending numbers. lead: the place of the minimiser in each segment. Returns a table (column, segment) and the
    column in which minimisers begin.
    """
    n = len(bodies)
    sizes = np.array([len(b) for b in bodies])
    middle = int(lead.max())
    begin = middle - lead
    end = begin + sizes
    width = int(end.max())
    flat = np.zeros((n, width), dtype=np.uint8)
    for i, body in enumerate(bodies):
        flat[i, begin[i] : end[i]] = np.frombuffer(body, np.uint8)
    columns = np.ascontiguousarray(flat.T)
    del flat

    order = np.arange(n)
    common = np.zeros(n + 1, dtype=np.int32)  # with the one before, up to the last column; the end stands for none
    out = np.zeros((width, n), dtype=bool)
    base = group.astype(np.int32) * 257
    for c in range(width):
        inside = (begin[order] <= c) & (c < end[order])
        symbol = np.where(inside, columns[c][order].astype(np.int32) + 1, 0)
        key = base[order] + symbol
        by = np.argsort(key, kind="stable")
        key = key[by]
        together = np.zeros(n, dtype=bool)
        together[1:] = (key[1:] == key[:-1]) & inside[by][1:]
        fresh = np.zeros(n + 1, dtype=np.int32)
        here = np.flatnonzero(together)
        low, high = by[here - 1], by[here]
        near = high - low == 1
        fresh[here[near]] = common[high[near]] + 1
        if not near.all():
            far, low, high = here[~near], low[~near], high[~near]
            breaks = np.concatenate([[0], np.cumsum(common == 0)])
            apart = breaks[high + 1] > breaks[low + 1]  # somewhere between nothing is shared
            fresh[far[apart]] = 1
            far, low, high = far[~apart], low[~apart], high[~apart]
            if len(far):
                bounds = np.stack([low + 1, high + 1], axis=1).ravel()
                fresh[far] = np.minimum.reduceat(common, bounds)[::2] + 1
        order, common = order[by], fresh
        if c >= length - 1:
            out[c - length + 1, order] = np.maximum(common[:-1], common[1:]) >= length
    return out, middle


def compare_columns(length: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, MOST_ROWS, MOST_BYTES):
            anchor, lead, start, did, rk = (batch.column(c).to_numpy() for c in ("anchor", "lead", "start", "did", "rk"))
            members: dict[tuple, dict] = {}
            for i, body in enumerate(batch.column("body").to_pylist()):
                members.setdefault((int(anchor[i]), int(lead[i]), body), {})[(did[i], rk[i], start[i])] = None
            kinds = list(members)
            per_anchor: dict[int, int] = {}
            for a, _, _ in kinds:
                per_anchor[a] = per_anchor.get(a, 0) + 1
            several = [k for k in kinds if per_anchor[k[0]] > 1]
            spans = {k: ([0], [len(k[2])]) for k in kinds if len(members[k]) > 1}  # copies of one whole segment
            if several:
                numbers = {a: j for j, a in enumerate(dict.fromkeys(k[0] for k in several))}
                group = np.array([numbers[k[0]] for k in several])
                leads = np.array([k[1] for k in several])
                table, middle = repeated_columns(group, leads, [k[2] for k in several], length)
                for j, k in enumerate(several):
                    if k not in spans:
                        s, e = K.spans_of(table[:, j])
                        if len(s):
                            shift = middle - k[1]
                            spans[k] = (s - shift, e - 1 - shift + length)
            out: dict[str, list] = {"did": [], "rk": [], "start": [], "end": []}
            for k, (starts, ends) in spans.items():
                for d, r, at in members[k]:
                    for s, e in zip(starts, ends, strict=True):
                        out["did"].append(d)
                        out["rk"].append(r)
                        out["start"].append(at + s)
                        out["end"].append(at + e)
            if out["did"]:
                yield pa.RecordBatch.from_pydict(
                    out, pa.schema([("did", pa.int64()), ("rk", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
                )

    return compare


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
    )
    for batch in K.small_batches(batches):
        out: dict[str, list] = {c: [] for c in schema.names}
        rows = zip(*(batch.column(c) for c in ("did", "text", "starts", "ends")), strict=True)
        for did, text, starts, ends in rows:
            data = (text.as_py() or "").encode()
            removed = runs = 0
            kept = data
            if starts.is_valid:
                gone = K.mark(len(data), starts.values.to_numpy(), ends.values.to_numpy())
                removed, runs = int(gone.sum()), len(K.spans_of(gone)[0])
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            key = did.as_py()
            for column, value in zip(schema.names, (None if key == NULL_ID else key, len(data), removed, runs, kept), strict=True):
                out[column].append(value)
        yield pa.RecordBatch.from_pydict(out, schema)


def suffix_dedup(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = MINIMISER_BYTES, heavy: int = HEAVY_SEGMENTS
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes)."""
    joined = with_spans(spark, docs, Units(False, length, gram), compare_columns(length), False, "suffix", heavy)
    return joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
