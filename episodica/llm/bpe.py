"""BPE encoding and decoding with batched merge rounds in numpy.

A vocabulary file in the tokenizers format with a word-end suffix gives the rules: special tokens split the raw text; the
rest is brought to NFC, letters become lower-case one by one; a pattern picks the pieces between white space; each piece
becomes its UTF-8 bytes in the printable alphabet of byte-level vocabularies, the last one with the suffix.

All pieces of a batch that were not met before lie in one flat array of symbol ids. Each round looks up every neighbouring
pair of one piece by binary search over the sorted pair keys, takes the lowest rank of each piece and merges that pair
wherever it stands, left to right. Rounds go on until no piece has a mergeable pair; finished pieces leave. Results are
kept per piece up to a fixed size; texts are then put together from the arrays of their pieces.

* null and empty texts, texts without a piece: no tokens
* special token strings in a text are their tokens, as in the file
* very long texts are encoded whole; a very long piece merges like any other
* repeated rows: each is returned; empty table: no rows
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from episodica.llm.common import Shared

#: The memo starts anew after a batch that takes it beyond one of these.
MEMO_PIECES, MEMO_IDS = 200_000, 2_000_000

def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the others take the next characters from 256 on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def lower_each(text: str) -> str:
    """Lower-case every character by itself: a final sigma is a sigma like any other."""
    return text.replace("Σ", "σ").lower()


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, vocabulary = data["model"], data["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.text_of = {i: t for t, i in vocabulary.items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # The file's \s is the Unicode property; the regex module spells it out.
        self._pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        alphabet = byte_alphabet()
        self._first = np.array([vocabulary[c] for c in alphabet], dtype=np.int64)
        self._last = np.array([vocabulary[c + self.suffix] for c in alphabet], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        _, first = np.unique(keys, return_index=True)
        self._keys, self._ranks, self._made = keys[first], first, made[first]
        self._forget()

    def _forget(self) -> None:
        """Start the memo anew: number of each piece, and the ids of all pieces in one array."""
        self._memo: dict[str | int, int] = {}
        self._flat, self._starts, self._sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over a flat array of symbols; word numbers the piece of each, ascending."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self._keys)
        while len(symbols):
            same = word[1:] == word[:-1]
            keys = np.where(same, symbols[:-1] << 32 | symbols[1:], -1)
            at = np.minimum(np.searchsorted(self._keys, keys), none - 1)
            rank = np.append(np.where(self._keys[at] == keys, self._ranks[at], none), none)
            at = np.append(at, 0)
            starts = np.flatnonzero(np.append(True, ~same))
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = best < none
            if not open_.all():
                done.append((symbols[~open_], word[~open_]))
            hit = (rank == best) & open_
            # Of overlapping occurrences (a a a) every second one from the left merges.
            places = np.flatnonzero(hit)
            if len(places):
                chain = np.append(True, np.diff(places) > 1)
                run_start = np.maximum.accumulate(np.where(chain, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run_start) % 2 == 0]
            symbols = symbols.copy()
            symbols[places] = self._made[at[places]]
            keep = open_.copy()
            keep[places + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return symbols, word
        symbols, word = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Token ids of each piece."""
        if not pieces:
            return []
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(b) for b in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self._first[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self._last[data[ends]]
        ids, word = self.merge(symbols, np.repeat(np.arange(len(pieces)), sizes))
        return np.split(ids, np.searchsorted(word, np.arange(1, len(pieces))))

    def pieces(self, text: str | None) -> list[str | int]:
        """The pieces of a text in order; a special token is its id."""
        found: list[str | int] = []
        parts = self._split.split(text or "") if self._split else [text or ""]
        for part in parts:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                # White space only separates pieces, so collapsing it would change nothing.
                found.extend(self._pieces.findall(lower_each(unicodedata.normalize("NFC", part))))
        return found

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.pieces(t) for t in texts]
        if len(self._memo) > MEMO_PIECES or len(self._flat) > MEMO_IDS:
            self._forget()
        memo = self._memo
        fresh = list(dict.fromkeys(p for pieces in split for p in pieces if p not in memo))
        if fresh:
            words = [p for p in fresh if isinstance(p, str)]
            made = self.encode_pieces(words) + [np.array([p]) for p in fresh if not isinstance(p, str)]
            names = words + [p for p in fresh if not isinstance(p, str)]
            memo.update(zip(names, range(len(memo), len(memo) + len(names)), strict=True))
            sizes = np.array([len(ids) for ids in made])
            self._starts = np.concatenate([self._starts, len(self._flat) + np.cumsum(sizes) - sizes])
            self._sizes = np.concatenate([self._sizes, sizes])
            self._flat = np.concatenate([self._flat, *made]).astype(np.int32)
        out = []
        for pieces in split:
            number = np.fromiter(map(memo.__getitem__, pieces), np.int64, len(pieces))
            sizes = self._sizes[number]
            shift = self._starts[number] - (np.cumsum(sizes) - sizes)
            out.append(self._flat[np.repeat(shift, sizes) + np.arange(sizes.sum())])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """A file without a decoder joins its tokens with spaces; special tokens stay."""
        text_of = self.text_of
        return " ".join([text_of[i] for i in ids.tolist()])


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_CODECS: dict[str, Codec] = {}


def _codec(spec: Shared) -> Codec:
    """The codec of this worker, made once."""
    if spec.id not in _CODECS:
        _CODECS.clear()
        _CODECS[spec.id] = Codec(spec.value)
    return _CODECS[spec.id]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, ids, decoded (the decoded text of the ids). vocabulary: the path of the file.

    The file has a fixed size of a few megabytes; it is read once and broadcast.
    """
    spec = Shared(spark, read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = codec.encode_batch(part.column("text").to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                decoded = pa.array([codec.decode(i) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), flat), decoded], schema=_SCHEMA
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
