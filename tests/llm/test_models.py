"""BPE, language, decontamination, toxicity, token counts and the pipeline."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from episodica.llm import bpe, decontaminate, language, token_counts, toxicity
from episodica.llm.common import documents, vocabulary_file
from episodica.llm.queries import byte_pattern
from tests.llm.conftest import by_id, corpus, prose

needs_vocabulary = pytest.mark.skipif(not os.path.exists(vocabulary_file("word_bpe_49k.json")), reason="no vocabulary files")

ODD = (
    "é é ΑΣ İ ß ﬁ 's 'LL ' ½ ٣ 漢字 　 \x85 \x1c ​ <|startoftext|> <|endoftext|> <|end 😀 👩‍👩‍👧 aaaa !!!! ??? ǅ ẞ naïve".split(" ")
    + ["x" * 300, "\n", "  ", "the", "ing"]
)


@needs_vocabulary
def test_bpe_equals_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary_file("word_bpe_49k.json")
    rng = random.Random(3)
    texts = [None, "", " \n", "aaaaaaa " * 50, "ab" * 5000, *corpus(5)]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randrange(20))) for _ in range(200)]
    got = by_id(bpe.encode(spark, docs(*texts, ids=F.lit(1)), path))
    library = tokenizers.Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False)


@needs_vocabulary
def test_bpe_memo_may_start_anew(monkeypatch):
    codec = bpe.Codec(bpe.read_vocabulary(vocabulary_file("word_bpe_49k.json")))
    texts = corpus(6)
    whole = [i.tolist() for i in codec.encode_batch(texts)]
    monkeypatch.setattr(bpe, "MEMO_PIECES", 0)
    assert [codec.encode_batch([t])[0].tolist() for t in texts] == whole


@needs_vocabulary
def test_token_counts_follow_token_bytes(spark, docs):
    texts = [None, "", "one line", "first\nsecond\n\nfourth\n", "ünï\ncödé <|endoftext|>", "a\n\n\n\n b", "x " * 5000]
    path = vocabulary_file("byte_bpe_50k.tiktoken")
    got = by_id(token_counts.token_counts(spark, docs(*texts, n_tokens=F.lit(0)), path, byte_pattern()))
    with open(path, encoding="ascii") as file:
        encoding = token_counts.Counter(file.read(), byte_pattern()).encoding
    for i, text in enumerate(texts):
        at, crossing, counts = 0, 0, {}
        data = (text or "").encode()
        for token in encoding.encode_ordinary(text or ""):
            size = len(encoding.decode_single_token_bytes(token))
            first, last = data[:at].count(b"\n"), data[: at + size - 1].count(b"\n")
            counts[first] = counts.get(first, 0) + 1
            crossing += first != last
            at += size
        n = data.count(b"\n") + (not data.endswith(b"\n")) if data else 0
        assert got[i].section_tokens == [counts.get(k, 0) for k in range(n)]
        assert (got[i].n_bytes, got[i].n_tokens, got[i].n_sections, got[i].n_crossing) == (len(data), sum(counts.values()), n, crossing)


def grams(text: str | None) -> set:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_decontamination_equals_brute_force(spark, docs):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (1, 3, 5, 6, 7, 9, 12, 20, 37, 60, 150)] + [None, ""]
    texts: list[str | None] = [None, "", items[1]]
    for item in items[2:11]:
        words = item.split(" ")
        edited = list(words)
        edited[0] = edited[-1] = "other"
        for body in (words, edited, words[: len(words) // 2]):
            texts.append(" ".join([prose(rng, rng.randrange(400)), *body, prose(rng, rng.randrange(3000))]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = {
        (d, i, len(grams(item)), len(grams(item) & grams(text)))
        for d, text in enumerate(texts)
        for i, item in enumerate(items)
        if grams(item) and 100 * len(grams(item) & grams(text)) >= 80 * len(grams(item))
    }
    pairs = decontaminate.contaminated_pairs(spark, docs(*texts, item_id=F.lit(1)), benchmark)
    assert {tuple(r) for r in pairs.collect()} == expected
    clean = decontaminate.without_contaminated(spark, docs(*texts), benchmark)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {e[0] for e in expected}
    assert decontaminate.contaminated_pairs(spark, docs(*texts), benchmark.filter("false")).count() == 0
    assert decontaminate.contaminated_pairs(spark, docs("x").filter("false"), benchmark).count() == 0


def test_items_come_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 2)
    benchmark = spark.createDataFrame([(i, f"item number {i} of some") for i in range(5)], "item_id long, text string")
    assert [len(p.ids) for p in decontaminate.item_passes(spark, benchmark)] == [2, 2, 1]
    # A document longer than one piece of the text buffer, and one for each block.
    long = " ".join(f"w{i}" for i in range(700_000)) + " item number 3 of some"
    df = docs(*[f"so item number {i} of some" for i in range(5)], long, "none of these")
    pairs = decontaminate.contaminated_pairs(spark, df, benchmark)
    assert sorted((r.doc_id, r.item_id) for r in pairs.collect()) == [*((i, i) for i in range(5)), (5, 3)]
    assert [r.doc_id for r in decontaminate.without_contaminated(spark, df, benchmark).collect()] == [6]


def test_language_on_held_out_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = language.language_id(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9 and all(0 <= r.score <= 1 for r in got)


def test_language_model_is_a_distribution():
    import pandas as pd

    points = language.letters("the cat sat on the mat that the rat ate")
    points = np.concatenate([np.zeros(3, np.uint32), points])
    grams_seen, n = np.unique(np.lib.stride_tricks.sliding_window_view(points, language.ORDER), axis=0, return_counts=True)
    model = language.build(pd.DataFrame({"lang": "en", "gram": [g.tobytes() for g in grams_seen], "n": n}), ["en"])
    letters = np.unique(points)
    for context in ("the ", "zzzz", " sat"):
        start = np.array([ord(c) if c != " " else 0 for c in context], np.uint32)
        total = np.exp(model.floor[0])  # one letter outside the vocabulary
        for letter in letters:
            stretch = np.append(start, letter)
            whole, before = (model.letter_scores(s, np.zeros(1, np.int64))[0, 0] for s in (stretch, start))
            total += np.exp(whole - before)
        assert 0.9 < total < 1.1


def test_language_edges(spark, docs):
    df = docs((1, None), (2, "123 !"), (None, "some text"), (4, ""), (4, ""))
    got = language.language_id(spark, df).collect()
    assert sorted(r.lang_pred for r in got if r.doc_id in (1, 2, 4)) == ["und"] * 4
    unlabelled = language.language_id(spark, df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    assert language.language_id(spark, df.filter("false")).count() == 0


def test_a_language_with_few_documents_is_learned(spark):
    """All its documents fall into the calibration part by their hash."""
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(language.CALIBRATION_SHARE))
    rows = spark.range(3000).withColumnRenamed("id", "doc_id").filter(~language.held_out())
    few, many = rows.filter(part == 0).limit(2), rows.filter(part != 0).limit(40)
    docs = few.select("doc_id", F.lit("żółć gęślą jaźń").alias("text"), F.lit("pl").alias("lang")).union(
        many.select("doc_id", F.lit("the cat sat on the mat"), F.lit("en"))
    )
    got = language.language_id(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 42 and all(r.lang_pred == r.lang and not r.rejected for r in got)


def test_grammar_paths():
    grammar = toxicity.Grammar()
    lexicon = toxicity.Lexicon(frozenset({"idiot"}), frozenset({"scu"}))

    def paths(text: str) -> dict[int, int]:
        found = grammar.counts(map(lexicon.symbol, toxicity.tokens(text)))
        return {i: n for i, n in enumerate(found) if n}

    assert paths("an idiot") == {0: 1}
    assert paths("you idiot, scummy") == {4: 2}
    assert paths("you are here. an idiot") == {0: 1}
    assert paths("not an idiot") == {2: 1} and paths("not one two three idiot") == {0: 1}
    assert paths("he said you idiot") == {5: 1}
    assert paths("kill you. kill them now, I will burn") == {8: 2, 12: 1}
    assert paths("") == {}


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        words = prose(rng, 30).split(" ")
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(["badword", "vilething", "meanest" + rng.choice("abcd")])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(spark, docs, labels).filter("held_out").collect()
    assert all(r.predicted == rows[r.doc_id][2] for r in got) and len(got) > 100
    left = toxicity.without_toxic(spark, docs, labels)
    clean, stayed = {r[0] for r in rows if not r[2]}, {r.doc_id for r in left.collect()}
    assert left.columns == docs.columns and clean <= stayed and len(stayed - clean) <= 3


def test_one_long_copied_toxic_text_does_not_crowd_out_the_insults(spark):
    """Its words give more features than the lexicon may hold; the words of the other toxic texts are still learned."""
    rng = random.Random(6)
    copied = " ".join("".join(rng.choice("bcdfghjklmnp") for _ in range(10)) for _ in range(900))
    rows = []
    for i in range(1200):
        words, toxic = prose(rng, 30).split(" "), i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(["badword", "vilething"])
        rows.append((i, copied, 1) if i % 3 == 1 else (i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert len({f for w in copied.split(" ") for f in toxicity.features_of(w)}) > toxicity.MAX_LEXEMES
    lexicon = toxicity.fit(spark, docs, labels).lexicon
    assert {"badword", "vilething"} <= lexicon.words and not lexicon.words & set(copied.split(" "))
    got = [r for r in toxicity.toxicity(spark, docs, labels).filter("held_out").collect() if rows[r.doc_id][1] != copied]
    assert all(r.predicted == rows[r.doc_id][2] for r in got) and len(got) > 100


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(spark, docs((1, None), (1, None), (None, "x"), (2, "")), labels).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 4
    assert toxicity.toxicity(spark, docs("x").filter("false"), labels).count() == 0


@needs_vocabulary
def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = documents(spark, sf_dir)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    rows = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), before.schema)
        assert docs.columns == before.columns and 0 < docs.count() <= rows
        rows = docs.count()
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert encoded.count() == rows and encoded.filter("n_tokens <> size(ids)").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()) == sorted(
        r.doc_id for r in encoded.select("doc_id").collect()
    )


@needs_vocabulary
def test_codecs_on_empty_tables_and_repeated_rows(spark, docs):
    df = docs((1, "the same text"), (1, "the same text"), (None, "another"), ids=F.lit("x"), n_bytes=F.lit("y"))
    for made in (
        bpe.encode(spark, df, vocabulary_file("word_bpe_49k.json")),
        token_counts.token_counts(spark, df, vocabulary_file("byte_bpe_50k.tiktoken"), byte_pattern()),
    ):
        assert sorted(str(r.doc_id) for r in made.collect()) == ["1", "1", "None"]
        assert made.filter("doc_id = 1").distinct().count() == 1
    for encode in (bpe.encode, lambda *a: token_counts.token_counts(*a[:2], vocabulary_file("byte_bpe_50k.tiktoken"), byte_pattern())):
        assert encode(spark, df.filter("false"), vocabulary_file("word_bpe_49k.json")).count() == 0


def test_texts_beyond_one_piece_and_clashing_columns(spark, monkeypatch):
    """A text longer than a piece scores as the sum of its pieces; columns named like results are not read."""
    monkeypatch.setattr(language, "PIECE_LETTERS", 500)
    rng = random.Random(2)
    rows = [(i, prose(rng, 40), "en") for i in range(60)] + [(100 + i, "żółć gęślą jaźń " * 12, "pl") for i in range(60)]
    rows += [(500, "the of and to " * 2000, None), (501, "gęślą jaźń żółć " * 2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("score", "held_out", "lang_pred", "entropy", "rejected", "toxic", "predicted", "calibrates", "rows"):
        df = df.withColumn(name, F.lit("x"))
    got = by_id(language.language_id(spark, df))
    assert (got[500].lang_pred, got[501].lang_pred) == ("en", "pl") and len(got) == len(rows)
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _, _ in rows[:120]], "doc_id long, toxic int")
    scored = by_id(toxicity.toxicity(spark, df, labels))
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored.values())


def test_the_language_sample_moves_no_text(spark, sf_dir):
    sample = language.training_sample(documents(spark, sf_dir), 50)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
