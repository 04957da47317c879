"""Byte-level BPE by prefix tables, hard-negative mining and the fill-in-middle transformation."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from episodica.llm import byte_bpe, fill_in_middle, hard_negatives
from episodica.llm.common import vocabulary_file
from episodica.llm.queries import byte_pattern
from tests.llm.conftest import by_id, corpus

RANKS = vocabulary_file("byte_bpe_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files")
PARTS = "a b aa th the \n \t 1 23 's 'll ' é 漢 😀 \x1c \x85 　 <|endoftext|> ing ABC zzz !? ... \U00018eb8 ՘".split(" ") + [" ", "  "]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("test", pat_str=byte_pattern(), mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.Vocabulary(byte_bpe.read_ranks(RANKS)), byte_pattern())


def mixed(rng: random.Random, most: int) -> str:
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(most)))


@needs_vocabulary
def test_byte_bpe_equals_the_library(spark, docs, library):
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n", "a" * 30_000, "ab" * 9000, " " * 5000, *corpus(3), *(mixed(rng, 40) for _ in range(400))]
    rows = docs(*texts, *[(7, texts[7])] * 2, ids=F.lit("x"), decoded=F.lit(1))
    got = byte_bpe.encode(spark, rows, RANKS, byte_pattern())
    assert got.count() == len(texts) + 2
    for i, row in by_id(got).items():
        text = texts[i] or ""
        assert row.ids == library.encode_ordinary(text) and bytes(row.decoded) == text.encode()
    assert byte_bpe.encode(spark, rows.filter("false"), RANKS, byte_pattern()).count() == 0


@needs_vocabulary
def test_every_token_is_reached_and_encodes_to_itself(codec):
    tokens = codec.vocabulary.ranks
    assert all(codec.vocabulary.reached)
    for token, rank in list(tokens.items())[::50]:
        assert codec.walk(codec.fill(token, [])) == [rank]


@needs_vocabulary
def test_generations_of_the_memo_change_nothing(monkeypatch, codec):
    texts = [t or "" for t in corpus(8)]
    whole = [i.tolist() for i in codec.encode(texts)]
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 5)
    monkeypatch.setattr(byte_bpe, "MEMO_PAIRS", 3)
    assert [codec.encode([t])[0].tolist() for t in texts] == whole


@needs_vocabulary
def test_appends_and_edits_equal_a_new_encoding(codec, library):
    rng = random.Random(6)
    for _ in range(300):
        table = byte_bpe.PrefixTable.of(codec, mixed(rng, 60))
        for _ in range(4):
            at, removed, added = rng.randrange(len(table.text) + 1), rng.randrange(5), mixed(rng, 4)
            if rng.random() < 0.3:
                at, removed = len(table.text), 0
            expected = table.text[:at] + added + table.text[at + removed :]
            table.replace(at, removed, added)
            fresh = byte_bpe.PrefixTable.of(codec, expected)
            assert table.text == expected and table.ids() == library.encode_ordinary(expected)
            assert (table.starts, table.last) == (fresh.starts, fresh.last)


@needs_vocabulary
def test_stored_tables_are_edited_near_the_edit(spark, docs, library):
    text = "the cat sat on the mat and " * 400
    tables = byte_bpe.prefix_tables(spark, docs(text, "", None, "x" * 50), RANKS, byte_pattern())
    edits = spark.createDataFrame(
        [(0, 5000, 3, "dog"), (1, None, None, "new text"), (2, 0, 9, None), (3, None, 0, "y z")], "doc_id long, at int, removed int, added string"
    )
    got = by_id(byte_bpe.edit(spark, tables.join(edits, "doc_id"), RANKS, byte_pattern()))
    expected = {0: text[:5000] + "dog" + text[5003:], 1: "new text", 2: "", 3: "x" * 50 + "y z"}
    for i, row in got.items():
        assert row.text == expected[i] and row.ids == library.encode_ordinary(expected[i])
    assert got[0].n_fresh < 40 and got[3].n_fresh <= 6


def brute_negatives(rows, every, positives=5, negatives=3):
    used = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found, seen = [], set()
    for anchor in used:
        if anchor[0] % every or (anchor[0], anchor[1], tuple(anchor[2])) in seen:
            continue
        seen.add((anchor[0], anchor[1], tuple(anchor[2])))
        others = sorted((-sum(x * y for x, y in zip(anchor[2], v)), i, label) for i, label, v in used if i != anchor[0])
        for score, positive in [(-s, i) for s, i, label in others if label == anchor[1]][:positives]:
            hard = [(i, -s) for s, i, label in others if label != anchor[1] and 50 * score <= -100 * s <= 95 * score]
            found += [(anchor[0], positive, k, i, score, s) for k, (i, s) in enumerate(hard[:negatives], 1)]
    return sorted(found)


def vectors(seed, n=240):
    rng, rows = random.Random(seed), []
    for i in range(n):
        v = [rng.choice([0.0, 0.1, -0.2, 0.5, rng.gauss(0, 0.3)]) for _ in range(rng.choice([4, 4, 4, 3, 0]))]
        # One vector fills a third of the rows.
        v = [0.5, 0.1, 0.0, -0.2] if i % 3 == 0 else v
        v = {41: [0.1, float("nan")], 43: None, 47: [None, 1.0], 59: [float("inf")]}.get(next((k for k in (41, 43, 47, 59) if i % k == 0), 0), v)
        rows.append((rng.choice([None, 10, i]) if i % 53 == 0 else i, rng.choice([0, 1, 2, None]) if i % 9 == 0 else i % 3, v))
    return rows + rows[:20]


@pytest.mark.parametrize("scores_at_once", [200, 1 << 21])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, scores_at_once):
    monkeypatch.setattr(hard_negatives, "SCORES_AT_ONCE", scores_at_once)
    rows = vectors(3)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    df = df.withColumn("id", F.lit("x")).withColumn("key", F.lit(1)).withColumn("block", F.lit(2))
    got = hard_negatives.hard_negatives(spark, df, F.col("id") % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 5)
    assert hard_negatives.hard_negatives(spark, df.filter("false"), F.col("id") % 5 == 0).count() == 0
    assert hard_negatives.hard_negatives(spark, df, F.col("id") < 0).count() == 0


def test_keys_sort_as_their_numbers():
    rng = random.Random(2)
    rows = [(rng.choice([-5, 0, 7, 2**62]), rng.choice([-(2**63), 3]), rng.choice([-9, 0, 0, 4, 2**60]), rng.randrange(2), rng.randrange(-3, 9)) for _ in range(300)]
    keys = [hard_negatives.pack([a], [t], [s], kind, [r])[0].tobytes() for a, t, s, kind, r in rows]
    assert [hard_negatives.unpack(k) for k in keys] == rows
    expected = sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3], r[4]))
    assert [hard_negatives.unpack(k) for k in sorted(keys)] == expected


def test_the_iterator_holds_open_windows_only():
    config = {"low": 50, "high": 95, "negatives": 3}
    rows = [(1, 0, 100, 0, 5), (1, 0, 96, 1, 9), (1, 0, 95, 1, 8), (1, 0, 80, 0, 4), (1, 0, 76, 1, 7), (1, 0, 60, 1, 6), (1, 0, 55, 1, 3), (1, 0, 40, 1, 2), (1, 0, 0, 0, 1), (2, 0, 9, 1, 1)]
    keys = (bytes(hard_negatives.pack([a], [t], [s], kind, [r])[0].tobytes()) for a, t, s, kind, r in rows)
    assert list(hard_negatives.mined(((k, None) for k in keys), config)) == [
        (1, 5, 1, 8, 100, 95), (1, 5, 2, 7, 100, 76), (1, 4, 1, 7, 80, 76), (1, 5, 3, 6, 100, 60), (1, 4, 2, 6, 80, 60),
        (1, 4, 3, 3, 80, 55),
    ]


def test_products_stay_exact():
    rng = np.random.default_rng(1)
    for size in (1 << 10, 1 << 28, 1 << 40):
        a, b = (rng.integers(-size, size, (3, 5)).astype(np.float64) for _ in range(2))
        expected = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
        assert hard_negatives.products(a, b).tolist() == expected
    assert hard_negatives.products(np.ones((2, 0)), np.ones((3, 4))).tolist() == [[0] * 3] * 2


def expected_middle(i: int | None, text: str | None, rate: int = 100):
    text, h = text or "", hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("rate", [100, 40])
def test_fill_in_middle_equals_a_plain_loop(spark, docs, monkeypatch, rate):
    monkeypatch.setattr(fill_in_middle, "BATCH_BYTES", 3000)
    rng = random.Random(5)
    texts = [None, "", "\n", "a", "a\n", "\n\nb", "<P>x\ny", "x<\nS>", "é\nü\n漢\n", "<\n<S\n<P\nM>", "line\n" * 20_000]
    texts += ["".join(rng.choice(["a", "\n", "é", "<", "P", "S>", "xyz ", "<S"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    df = docs(*texts, (None, "a\nb\nc"), (3, "a"), n=F.lit("x"), form=F.lit(0), h=F.lit(1))
    got = fill_in_middle.fill_in_middle(spark, df, rate=rate).collect()
    assert len(got) == len(texts) + 2 and {r.form for r in got} == {"plain", "psm", "spm"}
    for row in got:
        text = "a\nb\nc" if row.doc_id is None else texts[row.doc_id]
        assert tuple(row)[1:] == expected_middle(row.doc_id, text, rate)
    for made in (
        fill_in_middle.restore(spark, fill_in_middle.fill_in_middle(spark, df, rate=rate)),
        fill_in_middle.fill_in_middle(spark, df, rate=rate, with_restored=True),
    ):
        for row in made.collect():
            assert row.restored == ("a\nb\nc" if row.doc_id is None else texts[row.doc_id] or "")
    assert fill_in_middle.fill_in_middle(spark, df.filter("false")).count() == 0


def test_slices_cut_batches_by_bytes():
    from episodica.llm.common import slices

    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 5, 30, 1, 1)] + [None, "b" * 9]})
    assert [s.num_rows for s in slices(batch, "text", 10)] == [2, 1, 3, 1]
    assert list(slices(batch.slice(0, 0), "text", 10)) == []
