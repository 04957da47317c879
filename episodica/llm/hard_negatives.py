"""Hard-negative mining by a secondary sort of packed pair scores.

Every anchor is scored against all rows: rows are dealt into blocks that fit a worker's memory, and the anchors stream
past each block. A block hands on, per anchor, only keys that the result can need: the best rows of the anchor's label,
and once the positives are known, the best rows of other labels inside each positive's window. Each is the exact top of
its block, so nothing is lost, and the shuffle holds a fixed number of keys per anchor and block instead of all pairs.

A key packs (anchor, descending score, kind, id) into bytes that sort in this order, positives before negatives of one
score. ``repartitionAndSortWithinPartitions`` deals keys by anchor and sorts them, spilling where it has to; an iterator
reads them in order. A positive opens a window; a negative that lies in an open window is emitted with it; a window closes
once the scores fall below it or it is full. An anchor's rows are never held.

Components become floor(scale * x) in doubles. Scores are exact integers: matrix products in doubles as long as they stay
below 2**53, else whole numbers; scores beyond 64 bits count as the largest ones of 64 bits.

* null label, null vector, null or non-finite component, null vec_id: the row takes no part
* vectors of different length: missing components count as 0; an empty vector scores 0
* ties in score: the smaller vec_id first; a positive score of 0 or less opens the window that its bounds allow
* repeated rows: each takes a place of its own among positives and negatives; equal anchors are mined once; rows of the
  anchor's vec_id are not its partners
* empty table, no anchors: no rows; extra columns are not read
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodica.llm.common import Scratch, ship_code

#: Bytes of vectors (as 32-bit numbers) that a block of rows holds, and scores that are computed at once.
BLOCK_BYTES = 64 * 1024 * 1024
SCORES_AT_ONCE = 1 << 21

POSITIVE, NEGATIVE = 0, 1
#: Big-endian numbers, shifted so that their bytes ascend in the order of the key; twin tells anchors of one id apart.
KEY = np.dtype([("anchor", ">u8"), ("twin", ">u8"), ("score", ">u8"), ("kind", "u1"), ("row", ">u8")])
HALF = np.uint64(1 << 63)
NAMED = 16


def pack(anchor, twin, score, kind: int, row) -> np.ndarray:
    """Keys of signed 64-bit arrays; descending scores ascend as bytes."""
    keys = np.zeros(len(row), KEY)
    for name, values in (("anchor", anchor), ("twin", twin), ("row", row)):
        keys[name] = np.asarray(values, np.int64).view(np.uint64) ^ HALF
    keys["score"] = ~(np.asarray(score, np.int64).view(np.uint64) ^ HALF)
    keys["kind"] = kind
    return keys


def unpack(key: bytes) -> tuple[int, int, int, int, int]:
    """anchor, twin, score, kind and row of one key."""
    anchor, twin, score, kind, row = np.frombuffer(key, KEY)[0].item()
    return anchor - 2**63, twin - 2**63, 2**63 - 1 - score, kind, row - 2**63


def as_binary(keys: np.ndarray) -> pa.Array:
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * KEY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(keys.tobytes())])


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest negative score with low * score <= 100 * negative <= high * score."""
    return -(-low * score // 100), high * score // 100


def matrix(lists: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * component), as wide as the longest vector; 32-bit numbers where they hold the values."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0))
    made = np.zeros((len(sizes), width))
    made[np.arange(width) < sizes[:, None]] = flat
    return made.astype(np.float32) if not len(flat) or np.abs(flat).max() < 2**24 else made


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b, as 64-bit numbers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width].astype(np.float64), b[:, :width].astype(np.float64)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.array([[int(x) for x in r] for r in a], dtype=object) @ np.array([[int(x) for x in r] for r in b], dtype=object).T
    return np.clip(whole, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def first(places: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k entries of each place, higher scores and then smaller ids first."""
    order = np.lexsort((ids, -scores, places))
    sorted_places = places[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_places, sorted_places)
    return order[rank < k]


class Block:
    """Rows held by a task, against which anchors are scored."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors

    def best(self, allowed: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, column) of the first k allowed scores of each anchor."""
        places, columns = np.nonzero(allowed)
        if scores.shape[1] > 8 * k and len(places) > 32 * len(scores):
            # The k-th best score bounds what can count; ties stay in.
            least = np.partition(np.where(allowed, scores, np.iinfo(np.int64).min), -k, axis=1)[:, -k]
            places, columns = np.nonzero(allowed & (scores >= least[:, None]))
        chosen = first(places, scores[places, columns], ids[columns], k)
        return places[chosen], columns[chosen]

    def keys(self, anchors: dict, config: dict) -> Iterator[np.ndarray]:
        """Packed keys that the block offers for some anchors: positives while no windows are known, else negatives."""
        n, at_once = len(anchors["id"]), max(1, min(len(self.ids), 1 << 14))
        step = max(1, SCORES_AT_ONCE // at_once)
        for begin in range(0, n, step):
            part = slice(begin, begin + step)
            own, twin, label = anchors["id"][part], anchors["twin"][part], anchors["label"][part]
            windows = anchors["windows"][begin : begin + step]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for left in range(0, len(self.ids), at_once):
                columns = slice(left, left + at_once)
                scores = products(anchors["vectors"][part], self.vectors[columns])
                ids = self.ids[columns]
                same = self.labels[columns] == label[:, None]
                other = ids != own[:, None]
                if windows[0] is None:
                    groups = [(0, same & other, config["positives"])]
                else:
                    negative = ~same & other
                    groups = []
                    for k in range(max(map(len, windows))):
                        bounds = [window(w[k], config["low"], config["high"]) if k < len(w) else (1, 0) for w in windows]
                        low, high = np.array(bounds, np.int64).T[:, :, None]
                        groups.append((k, negative & (scores >= low) & (scores <= high), config["negatives"]))
                for k, allowed, most in groups:
                    places, at = self.best(allowed, scores, ids, most)
                    found.append((np.full(len(places), k), places, scores[places, at], left + at))
            if not found:
                continue
            group, places, scores, at = (np.concatenate([f[i] for f in found]) for i in range(4))
            most = config["positives"] if windows[0] is None else config["negatives"]
            chosen = first(group * len(own) + places, scores, self.ids[at], most)
            # One row may be among the first of several windows.
            pairs = np.unique(places[chosen] * len(self.ids) + at[chosen], return_index=True)[1]
            chosen = chosen[pairs]
            kind = POSITIVE if windows[0] is None else NEGATIVE
            yield pack(own[places[chosen]], twin[places[chosen]], scores[chosen], kind, self.ids[at[chosen]])


def block_keys(batches: Iterator[pa.RecordBatch], config: dict) -> Iterator[pa.RecordBatch]:
    """Rows of each block come before its anchors; the rows are held, the anchors stream."""
    number, held, block = None, [], None
    for batch in batches:
        values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "anchor", "id", "twin", "label")}
        changes = np.flatnonzero((np.diff(values["block"]) != 0) | (np.diff(values["anchor"].astype(np.int8)) != 0)) + 1
        for start, stop in zip([0, *changes], [*changes, batch.num_rows], strict=True):
            if start == stop:
                continue
            if values["block"][start] != number:
                number, held, block = values["block"][start], [], None
            part = batch.slice(start, stop - start)
            ids, labels = values["id"][start:stop], values["label"][start:stop]
            vectors = matrix(part.column("vector"), config["scale"])
            if not values["anchor"][start]:
                held.append((ids, labels, vectors))
                continue
            if block is None and held:
                block = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), stacked([h[2] for h in held]))
                held = []
            if block is not None:
                anchors = {"id": ids, "twin": values["twin"][start:stop], "label": labels, "vectors": vectors}
                anchors["windows"] = part.column("windows").to_pylist()
                for keys in block.keys(anchors, config):
                    yield pa.RecordBatch.from_arrays([as_binary(keys)], names=["key"])


def sorted_by_key(keys: RDD, partitions: int) -> RDD:
    """Keys dealt by anchor and sorted within their partitions."""
    return keys.map(lambda key: (key, None)).repartitionAndSortWithinPartitions(
        partitions, partitionFunc=lambda key: zlib.crc32(key[:NAMED])
    )


def first_of_each(keys: Iterator[tuple[bytes, None]], k: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """The first k rows of each anchor: anchor, twin, their scores and ids."""
    named, scores, ids = None, [], []
    for key, _ in keys:
        if key[:NAMED] != named:
            if named is not None:
                yield (*unpack(known)[:2], scores, ids)
            named, known, scores, ids = key[:NAMED], key, [], []
        if len(ids) < k:
            _, _, score, _, row = unpack(key)
            scores.append(score)
            ids.append(row)
    if named is not None:
        yield (*unpack(known)[:2], scores, ids)


def mined(keys: Iterator[tuple[bytes, None]], config: dict) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Positives open windows, negatives in them are emitted; only the open windows of one anchor are held."""
    named, windows = None, []
    for key, _ in keys:
        if key[:NAMED] != named:
            named, windows = key[:NAMED], []
        anchor, _, score, kind, row = unpack(key)
        if kind == POSITIVE:
            windows.append([row, score, *window(score, config["low"], config["high"]), 0])
            continue
        for opened in windows:
            positive, positive_score, low, high, _ = opened
            if low <= score <= high:
                opened[4] += 1
                yield anchor, positive, opened[4], row, positive_score, score
        windows = [w for w in windows if score >= w[2] and w[4] < config["negatives"]]


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: id, label, vector."""
    finite = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")
    )
    return named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def hard_negatives(
    spark: SparkSession,
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor: a condition on ``id``. An anchor's positives are its first rows of the same label by score; for each, the
    first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are returned.
    """
    ship_code(spark)
    scratch = Scratch(spark, "negatives")
    config = {"positives": positives, "negatives": negatives, "low": low, "high": high, "scale": scale}
    # The number given here is stored, so a recomputed task deals rows to the same blocks.
    clean = usable(rows, id_col, label_col, vector_col).withColumn("dealt", F.xxhash64(F.monotonically_increasing_id()))
    clean = scratch.table(clean)
    twin = F.xxhash64("label", "vector").alias("twin")
    anchors = scratch.table(clean.filter(is_anchor).select("id", "label", "vector", twin).dropDuplicates(["id", "label", "vector"]))

    size = clean.agg(F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0)).alias("components")).head()
    blocks = max(math.ceil(4 * size.components / BLOCK_BYTES), 2 * spark.sparkContext.defaultParallelism)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def offered(wanted: DataFrame) -> DataFrame:
        """Keys that the blocks offer to anchors (id, twin, label, vector, windows)."""
        none = F.lit(None).cast("array<long>").alias("windows")
        held = clean.select(
            F.pmod("dealt", F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("anchor"), "id", F.lit(0).cast("long").alias("twin"), "label", none, "vector"
        )
        streamed = wanted.select(
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("anchor"), "id", "twin", "label", "windows", "vector"
        )
        dealt = held.union(streamed).repartition(blocks, "block").sortWithinPartitions("block", "anchor")
        return scratch.table(dealt.mapInArrow(lambda batches: block_keys(batches, config), "key binary"))

    near = offered(anchors.withColumn("windows", F.lit(None).cast("array<long>")))
    per_anchor = sorted_by_key(near.rdd.map(lambda r: bytes(r.key)), partitions).mapPartitions(lambda keys: first_of_each(keys, positives))
    opened = scratch.table(spark.createDataFrame(per_anchor, "id long, twin long, windows array<long>, ids array<long>", verifySchema=False))

    far = offered(anchors.join(opened.select("id", "twin", "windows"), ["id", "twin"]))

    def positive_keys(row) -> list[bytes]:
        n = len(row.ids)
        keys = pack([row.id] * n, [row.twin] * n, row.windows, POSITIVE, row.ids)
        return [keys[i].tobytes() for i in range(n)]

    keys = opened.rdd.flatMap(positive_keys).union(far.rdd.map(lambda r: bytes(r.key)))
    found = sorted_by_key(keys, partitions).mapPartitions(lambda keys: mined(keys, config))
    types = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(found, types, verifySchema=False)
