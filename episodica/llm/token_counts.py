"""Token counts by section: whole documents are encoded once, token spans are mapped to sections.

A byte-level vocabulary splits a text into tokens whose bytes put together are the text, so the byte span of each token
follows from the running sum of token lengths. Sections are the lines of a text, a line break belonging to the line it
ends. Token spans and section spans are two sorted lists of intervals; they are joined by binary search. A token that
crosses a boundary counts for the section that holds its first byte, so the counts of the sections add up to the count of
the document; ``n_crossing`` tells how many tokens did.

* null or empty text: no sections, no tokens
* special token strings in a text are ordinary text
* repeated rows: each is returned; very long texts are encoded whole; empty table: no rows
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from episodica.llm.common import Shared

_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()),
        ("n_crossing", pa.int64()), ("section_tokens", pa.list_(pa.int32())),
    ]
)


class Counter:
    """Encoder of one rank file, with the byte length of every token."""

    def __init__(self, ranks_file: str, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def count(self, text: str | None) -> tuple[int, int, np.ndarray, int]:
        """Bytes, tokens, tokens of each section, tokens that cross a boundary."""
        data = (text or "").encode()
        if not data:
            return 0, 0, np.zeros(0, np.int32), 0
        ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        sections = np.append(0, breaks[breaks < len(data)])
        first = np.searchsorted(sections, starts, side="right") - 1
        last = np.searchsorted(sections, ends - 1, side="right") - 1
        counts = np.bincount(first, minlength=len(sections)).astype(np.int32)
        return len(data), len(ids), counts, int((first != last).sum())


_COUNTERS: dict[str, Counter] = {}


def _counter(spec: Shared) -> Counter:
    """The encoder of this worker, made once."""
    if spec.id not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[spec.id] = Counter(*spec.value)
    return _COUNTERS[spec.id]


def token_counts(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, n_sections, n_crossing, section_tokens.

    ranks_path: a rank file of fixed size (under a megabyte), read once and broadcast. pattern: how text is split first.
    """
    with open(ranks_path, encoding="ascii") as file:
        spec = Shared(spark, (file.read(), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec)
        for batch in batches:
            found = [counter.count(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([len(f[2]) for f in found], pa.int64()),
                    pa.array([f[3] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.list_(pa.int32())),
                ],
                schema=_RESULT,
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    types = "doc_id long, n_bytes long, n_tokens long, n_sections long, n_crossing long, section_tokens array<int>"
    return rows.mapInArrow(run, types)
