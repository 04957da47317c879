"""MinHash near-dedup by an inverted join over signature coordinates.

1. Every document becomes the set of its word shingles, a signature of ``COORDINATES`` minima and a digest of the set.
   Documents with equal sets are one representative from here on.
2. A representative is posted under each (coordinate, value) pair. Two sets of similarity s agree in a share s of the
   coordinates; pairs that agree in fewer than ``MATCHES`` are not candidates. So it is enough to merge, for each
   representative, the ``COORDINATES - MATCHES + 1`` rarest of its lists (prefix); lists with one entry are skipped, and
   so are the long lists that unlike documents share through one common passage.
3. Candidates in two passes. First each representative meets its hub, the most central entry of its lists, in an exact
   comparison of whole sets; the links found join most of a dense group of copies. Then entries of one list that are
   still in different components meet each other, all but those that an exact bound rules out: what both share with
   their hub, and which of their other shingles a second set has, limits what they can share with each other. So a dense
   group costs in proportion to its size, and no link that could join two components is left out.
4. Components of confirmed links; the smallest doc_id of each stays.

With 64 coordinates and 36 matches a pair of similarity 0.8 is missed with a probability of about 4e-6, one of 0.85 with
8e-9; every link is confirmed by exact intersection of the whole sets.

* null, empty or blank text: empty set, linked with nothing
* fewer words than a shingle: the whole sequence is one shingle
* ties and repeated rows: rows that share a doc_id are one vertex; a null doc_id is the smallest
* empty table: no rows
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from episodica.llm import kernels as K
from episodica.llm.common import ROW_KEY, Scratch, components, id_of, per_key, row_key

COORDINATES = 64
MATCHES = 36
PREFIX = COORDINATES - MATCHES + 1
#: Parts of the hash space in which a set and its hub count what they share: the upper bits of a shingle's hash.
SPREAD_BITS = 6
SPREAD = 1 << SPREAD_BITS

_random = np.random.Generator(np.random.Philox(7))
_A, _B = (_random.integers(0, 2**32, size=(COORDINATES, 1), dtype=np.uint32) | np.uint32(1) for _ in range(2))


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's hash over the set."""
    low, high = shingle_set.astype(np.uint32), (shingle_set >> np.uint64(32)).astype(np.uint32)
    best = np.full(COORDINATES, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        part = _A * low[at : at + 2048]
        part += _B * high[at : at + 2048]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted distinct shingles of each row."""
    data, offsets = K.text_buffer(batch.column("text"))
    for low, high in K.row_pieces(offsets):
        begin, end = offsets[low], offsets[high]
        words = K.Words(data[begin:end], offsets[low : high + 1] - begin)
        hashes, bounds = K.shingles(words.hashes(fold_ascii=True), words.offsets, k)
        for i in range(high - low):
            yield low + i, np.unique(hashes[bounds[i] : bounds[i + 1]])


def _sketch(k: int):
    schema = pa.schema(
        [("did", pa.int64()), ("rk", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for _, found in shingle_sets(batch, k):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("rk"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                schema=schema,
            )

    return sketch


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coordinate = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            data, _ = K.text_buffer(part.column("sig"))
            values = np.frombuffer(data.tobytes(), np.uint32).reshape(-1, COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column("rep").to_numpy(), COORDINATES)), pa.array((values + coordinate).ravel())],
                ["rep", "token"],
            )


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for _, s in shingle_sets(batch, k)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(found, pa.large_binary()).cast(pa.binary())], ["rep", "shingles"])

    return sets


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (
            np.frombuffer(K.text_buffer(batch.column(c))[0].tobytes(), np.uint32).reshape(-1, COORDINATES) for c in ("sig_a", "sig_b")
        )
        yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= MATCHES))


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _against_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The size of each set, of its hub's and of what they share, in all and by part, and the shingles that the hub does not have."""
    for batch in batches:
        sizes, hub_sizes, inside, spread, outside = [], [], [], [], []
        for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
            other = np.setdiff1d(x, y, assume_unique=True)
            sizes.append(len(x))
            hub_sizes.append(len(y))
            inside.append(len(x) - len(other))
            parts = [np.bincount((s >> np.uint64(64 - SPREAD_BITS)).astype(np.int64), minlength=SPREAD) for s in (x, other)]
            spread.append(parts[0] - parts[1])
            outside.append(other.view(np.int64))
        columns = [pa.array(c, pa.int64()) for c in (sizes, hub_sizes, inside)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), *columns, pa.array(spread, pa.list_(pa.int32())), pa.array(outside, pa.list_(pa.int64()))],
            ["rep", "hub", "n", "n_hub", "inside", "spread", "outside"],
        )


def _with_both(df: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    """Pairs (a, b) with a column of both ends."""
    for side in ("a", "b"):
        df = df.join(table.select(F.col("rep").alias(side), F.col(column).alias(f"{name}_{side}")), side)
    return df


def postings(scratch: Scratch, reps: DataFrame) -> DataFrame:
    """Entries (rep, token, weight) of the lists that are merged: the prefix of each representative, no lists of one.

    weight: how central a representative is, the sum of the logarithms of the lengths of all its lists.
    """
    tokens = reps.select("rep", "sig").mapInArrow(_tokens, "rep long, token long")
    lists = per_key(tokens, ["token"], F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = Window.partitionBy("rep")
    ranked = tokens.join(lists, "token").select(
        "rep", "token",
        F.row_number().over(own.orderBy("n", "token")).alias("rank"),
        F.count(F.lit(1)).over(own).alias("shared"),
        F.round(F.sum(F.log("n")).over(own), 6).alias("weight"),
    )
    prefix = F.col("rank") + COORDINATES - F.col("shared") <= PREFIX
    return scratch.table(ranked.filter(prefix).select("rep", "token", "weight"))


def hubs(entries: DataFrame) -> DataFrame:
    """For each representative (a) its hub (b): the most central entry of its lists, and then the hub of that one.

    Not every list of a dense group holds its most central entry; the second step brings the group to one hub.
    """
    central = entries.groupBy("token").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("top"))
    chosen = entries.join(central, "token").groupBy("rep").agg(F.max("top").alias("top"))
    first = chosen.select(F.col("rep").alias("a"), (-F.col("top.rep")).alias("h"))
    return first.join(first.select(F.col("a").alias("h"), F.col("h").alias("b")), "h").select("a", "b")


def unjoined_pairs(scratch: Scratch, entries: DataFrame, against: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs of entries that share a list, are in different components and can be linked at all.

    Two sets with one hub share in each part of the hash space at most what the one with less shares with the hub there, and
    of the shingles that the hub does not have, those that occur in a second set of the hub. Pairs below the needed size
    by that are left out; the bound is exact. A pair comes from the first list that its ends share.
    """
    labelled = entries.join(labels, entries.rep == labels.v, "left").select("token", "rep", F.coalesce("c", "rep").alias("comp"))
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    open_lists = scratch.table(labelled.join(mixed.select("token"), "token"))
    reps = open_lists.groupBy("rep").agg(F.array_sort(F.collect_list("token")).alias("tokens"))

    sizes = against.join(reps.select("rep"), "rep")
    strays = sizes.select("hub", "rep", F.explode("outside").alias("shingle"))
    twice = strays.groupBy("hub", "shingle").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high")
    solid = strays.join(twice, ["hub", "shingle"]).groupBy("rep").agg(F.count(F.lit(1)).alias("beyond"))
    bounds = sizes.join(solid, "rep", "left").join(reps, "rep")
    bounds = bounds.select("rep", "hub", "n", "inside", "spread", F.coalesce("beyond", F.lit(0)).alias("beyond"), "tokens")
    rows = scratch.table(open_lists.join(bounds, "rep"))

    met = rows.alias("x").join(
        rows.alias("y"),
        F.expr(f"""
            x.token = y.token AND x.rep < y.rep AND x.comp <> y.comp
            AND (x.hub <> y.hub OR {100 + percent} * (least(x.inside, y.inside) + least(x.beyond, y.beyond)) >= {percent} * (x.n + y.n))
            AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
            AND x.token = array_min(array_intersect(x.tokens, y.tokens))
            AND (x.hub <> y.hub OR {100 + percent} * (least(x.beyond, y.beyond)
                + aggregate(zip_with(x.spread, y.spread, (p, q) -> least(p, q)), 0L, (s, v) -> s + v)) >= {percent} * (x.n + y.n))
        """),
    )
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def near_dedup(spark: SparkSession, docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; then did and rk, the row key."""
    scratch = Scratch(spark, "near")
    keyed = docs.select(*row_key(), "text")
    sketches = scratch.table(
        keyed.mapInArrow(_sketch(k), "did long, rk long, n_shingles long, digest binary, sig binary")
    )
    reps = scratch.table(
        sketches.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min(F.struct(*ROW_KEY)).alias("at"), F.first("sig").alias("sig"))
        .select("digest", F.col("at.did").alias("rep"), F.col("at.rk").alias("rk"), "sig")
    )
    entries = postings(scratch, reps)
    wanted = scratch.table(reps.join(entries.select("rep").distinct(), "rep").select("rep", "rk", "sig"))
    texts = keyed.join(wanted.select(F.col("rep").alias("did"), "rk", "rep").hint("shuffle_hash"), ROW_KEY).select("rep", "text")
    sets = scratch.table(texts.mapInArrow(_sets(k), "rep long, shingles binary"))

    against = scratch.table(
        _with_both(hubs(entries), sets, "shingles", "set").mapInArrow(
            _against_hub, "rep long, hub long, n long, n_hub long, inside long, spread array<int>, outside array<long>"
        )
    )
    linked = f"rep <> hub AND {100 + percent} * inside >= {percent} * (n + n_hub)"
    links = scratch.table(against.filter(linked).select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    labels = components(scratch, links)
    pairs = unjoined_pairs(scratch, entries, against, labels, percent)
    agreeing = scratch.table(_with_both(pairs, wanted, "sig", "sig").mapInArrow(_agreeing, "a long, b long"))
    more = _with_both(agreeing, sets, "shingles", "set").mapInArrow(_confirmed(percent), "a long, b long")
    # Members of one class need one link each to its smallest member.
    same_id = sketches.join(reps.select("digest", "rep"), "digest").filter("did <> rep")
    copies = same_id.select(F.col("rep").alias("a"), F.col("did").alias("b"))
    final = components(scratch, links.union(more).union(copies))
    return (
        sketches.join(final, sketches.did == final.v, "left")
        .withColumn("component", F.coalesce("c", "did"))
        .select(
            id_of(F.col("did")).alias("doc_id"),
            "n_shingles",
            id_of(F.col("component")).alias("component_id"),
            (F.col("did") == F.col("component")).alias("kept"),
            *ROW_KEY,
        )
    )


def one_of_each_group(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = near_dedup(spark, docs, k, percent).filter("kept").select(*ROW_KEY).distinct()
    rows = docs.select(*row_key(), F.struct("*").alias("row"))
    return rows.join(kept.hint("shuffle_hash"), ROW_KEY, "left_semi").select("row.*")
