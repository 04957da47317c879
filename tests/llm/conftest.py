from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is that it was for on are with as his they at be this from red blue green stone river".split()
TYPES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts, or from (doc_id, text) pairs."""

    def make(*rows, **more):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        shaped = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in pairs]
        df = spark.createDataFrame(shaped, TYPES)
        for name, value in more.items():
            df = df.withColumn(name, value)
        return df

    return make


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def corpus(seed: int, n: int = 40, least: int = 0, most: int = 160) -> list[str | None]:
    """Random texts with copies, near copies, shared passages, repeated passages, nulls and empty texts."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    texts: list[str | None] = [None, "", " \t\n", "one", passage, "ü" * 450]
    while len(texts) < n:
        kind = rng.randrange(6)
        known = [t for t in texts if t]
        if kind == 0:
            text = rng.choice(known)
        elif kind == 1:
            words = rng.choice(known).split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 2:
            text = f"{prose(rng, rng.randrange(30))}\n{passage} {prose(rng, rng.randrange(30))}"
        elif kind == 3:
            part = prose(rng, 60)
            text = f"{part} {prose(rng, 5)} {part}"
        else:
            text = "\n".join(prose(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(1, 14)))
        texts.append(text)
    return texts


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}
