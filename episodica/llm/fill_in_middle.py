"""Fill-in-middle transformation with pyarrow.compute over whole batches.

The texts of a batch are split into units (lines, each with its line break) as one list array. Its flattened values keep
the number of their text (the parent) and get an ordinal within it. Two cuts per text divide the ordinals into prefix,
middle and suffix; the values of each role are filtered out, put back into one list per text and joined to a piece. The
pieces and sentinels are then joined in the order of the form: ``psm`` (prefix, suffix, middle) or ``spm`` (suffix,
prefix, middle). A text stays ``plain`` if it is empty, if it contains a sentinel, or if the draw says so.

Draws follow from a SHA-256 of seed and doc_id alone, so repeated tasks and repeated rows agree. ``restore`` undoes the
transformation from output and form alone: texts with a sentinel are plain, so the first occurrence of each sentinel in
an output is the one put in.

* null and empty texts: no units, plain, output empty
* null doc_id: drawn as the empty string
* very long texts: whole; batches are cut by bytes, a text is never cut
* repeated rows: each is returned; empty table: no rows; extra columns are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodica.llm.common import ship_code, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that are transformed at once; a longer text is a batch of its own.
BATCH_BYTES = 2 * 1024 * 1024

_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()), ("output", pa.string()),
    ]
)
_TYPES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int) -> Column:
    """Four unsigned 32-bit numbers: the first hexadecimal groups of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def chained(*parts) -> pa.Array:
    """Strings put together element by element."""
    return pc.binary_join_element_wise(*parts, large(""))


def joined(values: pa.Array, parents: np.ndarray, rows: int) -> pa.Array:
    """The values of each parent joined to one string; parents ascend."""
    offsets = np.searchsorted(parents, np.arange(rows + 1))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values), large(""))


def transform(texts: pa.Array, h: np.ndarray, rate: int, spm_rate: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text; h: its four draws as a row."""
    texts, rows = pc.fill_null(pc.cast(texts, pa.large_string()), ""), len(texts)
    parts = pc.split_pattern(texts, "\n")
    values = pc.list_flatten(parts)
    parents = pc.list_parent_indices(parts).to_numpy()
    starts = np.searchsorted(parents, np.arange(rows))
    ordinal = np.arange(len(parents)) - starts[parents]
    # Every part but the last of a text gets its line break back; an empty last part is no unit.
    last = np.append(parents[1:] != parents[:-1], True)
    breaks = pc.if_else(pa.array(last), large(""), large("\n"))
    empty = last & (pc.binary_length(values).to_numpy() == 0)
    units = chained(values, breaks)
    n = np.bincount(parents[~empty], minlength=rows)

    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    role = (ordinal >= cuts[parents, 0]).astype(np.int8) + (ordinal >= cuts[parents, 1])
    pieces = [joined(pc.filter(units, pa.array(role == k)), parents[role == k], rows) for k in range(3)]
    prefix, middle, suffix = pieces

    marked = np.zeros(rows, dtype=bool)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, sentinel).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[:, 2] % 100 >= rate)
    spm = h[:, 3] % 100 < spm_rate

    psm_text = chained(large(PREFIX), prefix, large(SUFFIX), suffix, large(MIDDLE), middle)
    spm_text = chained(large(SUFFIX), suffix, large(PREFIX), prefix, large(MIDDLE), middle)
    output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(spm), spm_text, psm_text))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    lengths = [pc.if_else(pa.array(plain), None, pc.cast(pc.utf8_length(piece), pa.int64())) for piece in (prefix, middle)]
    return [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *lengths, pc.cast(output, pa.string())]


def fill_in_middle(
    spark: SparkSession, docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7, with_restored: bool = False
) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output.

    rate: how many of 100 documents are transformed; spm_rate: how many of 100 of those have the form spm.
    with_restored: add the text rebuilt from output and form, in the same pass and worker.
    """
    ship_code(spark)
    more = [pa.field("restored", pa.string())] if with_restored else []
    schema = pa.schema([*_RESULT, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                h = pc.list_flatten(part.column("h")).to_numpy().reshape(-1, 4)
                found = transform(part.column("text"), h, rate, spm_rate)
                if with_restored:
                    found.append(originals(found[-1], found[1]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", draws(seed))
    return rows.mapInArrow(run, f"{_TYPES}, restored string" if with_restored else _TYPES)


def after(texts: pa.Array, sentinel: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first occurrence of a sentinel; without one, all is before."""
    parts = pc.split_pattern(texts, sentinel, max_splits=1)
    sizes = pc.list_value_length(parts).to_numpy()
    flat, starts = pc.list_flatten(parts), np.cumsum(sizes) - sizes
    whole = pa.array(np.where(sizes == 2, starts + 1, -1), mask=sizes != 2)
    return flat.take(pa.array(starts)), pc.fill_null(flat.take(whole), "")


def originals(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts behind outputs."""
    outputs = pc.cast(outputs, pa.large_string())
    body, middle = after(outputs, MIDDLE)
    psm_prefix, psm_suffix = after(after(body, PREFIX)[1], SUFFIX)
    spm_suffix, spm_prefix = after(after(body, SUFFIX)[1], PREFIX)
    psm = chained(psm_prefix, middle, psm_suffix)
    spm = chained(spm_prefix, middle, spm_suffix)
    texts = pc.if_else(pc.equal(forms, "plain"), outputs, pc.if_else(pc.equal(forms, "spm"), spm, psm))
    return pc.cast(texts, pa.string())


def restore(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with one column more: ``restored``, the text rebuilt from output and form."""
    ship_code(spark)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "output", BATCH_BYTES):
                made = originals(part.column("output"), part.column("form"))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*names, "restored"])

    return rows.mapInArrow(run, f"{_TYPES}, restored string")
