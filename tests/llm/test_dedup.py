"""Exact, near, line and substring dedup against brute force on small corpora, and their edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from episodica.llm import exact_dedup, line_dedup, near_dedup, suffix_dedup, window_dedup
from episodica.llm.common import Scratch, components
from tests.llm.conftest import by_id, corpus, prose

SEEDS = (1, 2)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("seed", SEEDS)
def test_exact_dedup_equals_brute_force(docs, seed):
    texts = corpus(seed) + ["a b", "ab", "a  b\n", "A B"]
    got = by_id(exact_dedup.exact_dedup(docs(*texts)))
    groups: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append(i)
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(ids), i == keep, sha(norm.encode()))


def test_exact_dedup_spreads_one_text_over_many_tasks(spark, docs):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    row = exact_dedup.exact_dedup(df).agg(F.min("group_size"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).head()
    assert tuple(row) == (3000, 0, 1)
    plan = exact_dedup.sorted_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Python" not in plan and "Arrow" not in plan


def shingle_set(text: str | None, k: int) -> set:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.mark.parametrize("seed", SEEDS)
def test_near_dedup_equals_brute_force(spark, docs, seed):
    texts = corpus(seed, 60)
    sets = [shingle_set(t, 4) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = by_id(near_dedup.near_dedup(spark, docs(*texts)))
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), label[i], label[i] == i)


def test_near_dedup_in_a_group_of_near_copies(spark, docs):
    """A dense group whose members are linked with some others only, around the threshold."""
    import random

    rng = random.Random(5)
    base = prose(rng, 120).split(" ")
    texts = []
    for _ in range(80):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", "z", str(rng.random())])
        texts.append(" ".join(words))
    sets = [shingle_set(t, 4) for t in texts]
    label = list(range(len(texts)))
    for _ in range(8):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = by_id(near_dedup.near_dedup(spark, docs(*texts)))
    assert [got[i].component_id for i in range(len(texts))] == label


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([(100, 101), (101, 100), (200, 200)], "a long, b long")
    labels = {r.v: r.c for r in components(Scratch(spark, "t"), edges.union(more)).collect()}
    assert all(labels[v] == 0 for v in range(61)) and (labels[101], labels[200]) == (100, 200)


def test_one_of_each_group_keeps_all_columns(spark, docs):
    text = "a b c d e f g h i j k l m n o p q r s t"
    left = near_dedup.one_of_each_group(spark, docs((5, text), (3, text), (7, None), (8, "other words"), rep=F.lit(1), did=F.lit(2)))
    assert left.columns[-2:] == ["rep", "did"] and sorted(r.doc_id for r in left.collect()) == [3, 7, 8]


@pytest.mark.parametrize("min_lines", (1, 2, 3))
def test_line_dedup_equals_brute_force(spark, docs, min_lines):
    texts = ["a\nb\nc\nd", "x\na\nb\nc", "b\nc\nb\nc\nb", "", None, "a\nb\nc\nd", "\n\n\n", "d\na\nb", "q"]
    got = by_id(line_dedup.line_dedup(spark, docs(*texts), min_lines))
    seen: set = set()
    for i, text in enumerate(texts):
        lines = text.split("\n") if text is not None else []
        gone = [False] * len(lines)
        for p in range(len(lines) - min_lines + 1):
            window = tuple(lines[p : p + min_lines])
            if window in seen:
                gone[p : p + min_lines] = [True] * min_lines
            seen.add(window)
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        r = got[i]
        assert (r.n_lines, r.n_removed, r.n_runs, r.kept_sha256) == (len(lines), sum(gone), runs, sha(kept.encode()))


def test_line_dedup_deletes_long_single_lines(spark, docs):
    """A passage on one line between different neighbours, or alone in its document, goes; a short line stays."""
    passage, shorter = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(49))
    texts = [f"a\n{passage}\nb", f"c\n{passage}\nd\n{passage}", passage, f"e\n{shorter}\nf", f"g\n{shorter}\nh", "x" * 120, "x" * 120]
    got = {r.doc_id: r.text for r in line_dedup.delete_repeated_lines(spark, docs(*texts)).collect()}
    assert got == {0: texts[0], 1: "c\nd", 2: "", 3: texts[3], 4: texts[4], 5: texts[5], 6: texts[6]}
    counts = by_id(line_dedup.line_dedup(spark, docs(*texts)))
    assert [(counts[i].n_removed, counts[i].n_runs) for i in range(3)] == [(0, 0), (2, 2), (1, 1)]
    as_sql = by_id(line_dedup.line_dedup(spark, docs(*texts), long_words=None))
    assert not any(r.n_removed for r in as_sql.values())


def test_line_dedup_returns_documents_and_runs_no_python(spark, docs):
    df = docs((2, "a\nb\nmine"), (1, "a\nb\nyours"), (3, None), gone=F.lit("x"), kept=F.lit(0))
    left = line_dedup.delete_repeated_lines(spark, df)
    assert left.columns == df.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: "a\nb\nyours", 2: "mine", 3: None}
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("heavy", (20_000, 1))
def test_window_dedup_equals_brute_force(spark, docs, heavy):
    texts, k = corpus(3), 10
    got = by_id(window_dedup.window_dedup(spark, docs(*texts), k, 3, heavy))
    first: dict = {}
    split = [(t or "").encode().split() for t in texts]
    for i, words in enumerate(split):
        for p in range(len(words) - k + 1):
            first.setdefault(tuple(words[p : p + k]), i)
    for i, words in enumerate(split):
        gone = [False] * len(words)
        for p in range(len(words) - k + 1):
            if first[tuple(words[p : p + k])] < i:
                gone[p : p + k] = [True] * k
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(words), sum(gone), kept)


@pytest.mark.parametrize("heavy", (20_000, 1))
def test_suffix_dedup_equals_brute_force(spark, docs, heavy):
    texts, n = corpus(4), 40
    got = by_id(suffix_dedup.suffix_dedup(spark, docs(*texts), n, 12, heavy))
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + n] for b in data for p in range(len(b) - n + 1))
    for i, b in enumerate(data):
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = [True] * n
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), sum(gone), spans, kept)


def test_pieces_of_a_long_text_agree(spark, docs, monkeypatch):
    """A text longer than a piece gives the same result as in one piece (segments are read in this process)."""
    import numpy as np

    from episodica.llm import anchors

    text = (corpus(9)[4] * 6).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    units = anchors.Units(False, 50, 12)

    def windows(piece: int) -> set:
        monkeypatch.setattr(anchors, "PIECE_UNITS", piece)
        loaded = units.load(data, offsets)
        return {
            (w + low, int(a))
            for low, _, runs in loaded.runs()
            for first, last, a in zip(runs.first, runs.last, runs.anchor, strict=True)
            for w in range(first, last)
        }

    assert windows(200) == windows(1 << 20) and len(windows(200)) == len(text) - 49


OPERATORS = {
    "exact": lambda s, d: exact_dedup.exact_dedup(d),
    "near": near_dedup.near_dedup,
    "suffix": suffix_dedup.suffix_dedup,
    "line": line_dedup.line_dedup,
    "window": window_dedup.window_dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, docs, name):
    """Nulls, empty tables, repeated rows and clashing columns give one row for each row."""
    run = OPERATORS[name]
    assert run(spark, docs("x").filter("false")).count() == 0
    text = "w " * 60 + "\nend\nof text"
    clash = {c: F.lit(1) for c in ("did", "rk", "rep", "norm", "at", "kept", "starts", "anchor", "component")}
    rows = run(spark, docs((None, text), (1, text), (1, text), (2, None), (3, ""), **clash)).collect()
    assert Counter(r.doc_id for r in rows) == {None: 1, 1: 2, 2: 1, 3: 1}


def test_exact_dedup_runs_no_python_and_sorts(spark, docs):
    plan = exact_dedup.exact_dedup(docs("a b", "ab", None))._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan
    assert "SortAggregate" in plan and "rangepartitioning" in plan


def test_lines_do_not_carry_their_text(spark, docs):
    """Every line of a long text would otherwise hold a copy of it."""
    long = "\n".join(f"line number {i} of a very long text with some words" for i in range(20_000))
    got = by_id(line_dedup.line_dedup(spark, docs(long, long + "\nmore", "short")))
    assert [(got[i].n_lines, got[i].n_removed) for i in range(3)] == [(20_000, 0), (20_001, 20_000), (1, 0)]
