"""Every stage of the pipeline on odd rows, and on an empty table."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from episodica.llm.common import vocabulary_file
from tests.llm.conftest import prose

needs_vocabulary = pytest.mark.skipif(not os.path.exists(vocabulary_file("word_bpe_49k.json")), reason="no vocabulary files")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels of documents not among the given ones, so that words are learned; two benchmark items."""
    rng, rows, path = random.Random(3), [], tmp_path_factory.mktemp("tables")
    for i in range(600):
        words, toxic = prose(rng, 30).split(" "), i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(["badword", "vilething"])
        rows.append((1000 + i, " ".join(words), int(toxic)))
    spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, "which river runs by the old stone mill of the town"), (2, None), (None, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), [r[:2] for r in rows if not r[2]][:100] + [r[:2] for r in rows if r[2]][:60]


def odd_rows(rng):
    body = [prose(rng, 12) for _ in range(8)]
    whole = "\n".join(body)
    long = "\n".join(prose(rng, 20) for _ in range(4000))
    near = prose(rng, 200).split(" ")
    changed = [*near[:100], "other", *near[101:]]
    return {
        "null": (1, None), "empty": (2, ""), "blank": (3, " \n\t"), "body": (4, whole), "copy": (5, whole), "part": (6, f"start here\n{body[2]}\n{body[3]}\nend here"),
        "near": (7, " ".join(near)), "near copy": (8, " ".join(changed)), "leak": (9, f"{prose(rng, 30)} which river runs by the old stone mill of the town {prose(rng, 9)}"),
        "long": (10, long), "repeated": (11, "one and two"), "again": (11, "one and two"), "nameless": (None, prose(rng, 25)),
    }


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, "en", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, n_chars long")
    # Columns with names that operators use inside.
    return df.withColumn("kept", F.lit(True)).withColumn("row", F.lit(1)).withColumn("toxic", F.lit(5)).withColumn("item_id", F.lit("x"))


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stage_on_odd_rows(spark, folder, name):
    path, learned = folder
    given = odd_rows(random.Random(5))
    df = frame(spark, [*given.values(), *learned])
    left = STAGES[name](spark, df, path)
    assert left.columns == df.columns
    rows = [r for r in left.collect() if r.doc_id is None or r.doc_id < 1000]
    ids = sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    every = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11]
    gone = {"toxicity": [], "line_dedup": [5, 11], "near_dedup": [5, 8], "decontaminate": [9]}[name]
    expected = list(every)
    for i in gone:
        expected.remove(i)
    if name == "line_dedup":
        # Rows equal in id and text count as one document; a short line by itself stays.
        expected = [i for i in every if i != 5]
    if name == "near_dedup":
        assert set(ids) == set(expected)
    else:
        assert ids == expected
    text = {r.doc_id: r.text for r in rows}
    if name == "line_dedup":
        assert text[6] == "start here\nend here" and text[4] == given["body"][1] and text[10] == given["long"][1] and text[1] is None
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    else:
        assert all(text[i] == t for i, t in given.values() if i in text)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stage_on_an_empty_table(spark, folder, name):
    df = frame(spark, [(1, "x")]).filter("false")
    left = STAGES[name](spark, df, folder[0])
    assert left.columns == df.columns and left.count() == 0


@needs_vocabulary
def test_encoding_of_odd_rows(spark, folder):
    given = odd_rows(random.Random(5))
    df = frame(spark, list(given.values()))
    rows = STAGES["bpe"](spark, df, folder[0]).collect()
    assert len(rows) == len(given) and all(r.n_tokens == len(r.ids) for r in rows)
    found = {r.doc_id: r.n_tokens for r in rows}
    assert found[1] == found[2] == found[3] == 0 and found[10] > 80_000
    assert STAGES["bpe"](spark, df.filter("false"), folder[0]).count() == 0
