"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

Encoding a prefix gives one token sequence, and every beginning of that sequence is the encoding of the bytes it covers.
So each byte prefix of a piece has one valid last token: the token t that ends there and may follow the last token of the
prefix before t. ``last`` keeps this token for every prefix; the tokens of a piece are read from its end backwards. An
automaton over all tokens names the candidates, and a pair may stand side by side if no merge across its boundary would
have come before the merges that made the two (``Vocabulary.judge``).

A table of prefixes can be kept: appended bytes only add entries, and after an edit the entries before it stay, pieces
are split anew from shortly before it, and from the first old piece start after it everything is taken over
(``prefix_tables``, ``edit``).

The rank file and the split pattern are parameters; the pattern has to cover every character. As in the usual encoder a
piece that is a token of the file is that token, even one that merges never reach. Special token strings are ordinary text.

* null and empty texts: no tokens; decoded empty
* very long texts and pieces: encoded whole, in time linear in their bytes
* repeated rows: each is returned; empty table: no rows; extra columns are not read
"""

from __future__ import annotations

import base64
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from episodica.llm.common import Shared, ship_code, slices

#: What workers keep at most: pieces and their bytes in each of two generations, and judged pairs.
MEMO_PIECES, MEMO_BYTES, MEMO_PAIRS = 150_000, 8_000_000, 400_000
#: Bytes of text that are encoded at once; a longer text is a batch of its own.
BATCH_BYTES = 2 * 1024 * 1024
#: A match of the split pattern depends on so many characters after its end at most.
LOOKAHEAD = 2

# Letters and numbers that came after Unicode 16, whose classes the usual encoder of rank files goes by.
# In its eyes these code points (hexadecimal, first-last) are neither letters nor numbers.
NEWER_LETTERS_AND_NUMBERS = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6
187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81
1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e
2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, encoding="ascii") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Vocabulary:
    """Tokens by rank, and for each token the pair that its last merge joins.

    left and right hold -1 for single bytes. ``reached`` is false for tokens that no sequence of merges makes. Given
    left, right and reached, as made by another instance, they are taken as they are.
    """

    def __init__(self, ranks: dict[bytes, int], made: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[int, bool] = {}
        if made is None:
            self.left, self.right, self.reached = [-1] * size, [-1] * size, [False] * size
            self._find_splits()
        else:
            self.left, self.right, self.reached = (m.tolist() for m in made)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.left, np.int32), np.array(self.right, np.int32), np.array(self.reached, bool)

    def _find_splits(self) -> None:
        """In rank order: a token is reached if lower tokens leave its bytes as one pair."""
        for token, rank in sorted(self.ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                self.reached[rank] = True
                continue
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
                if a < rank and b < rank and self.reached[a] and self.reached[b] and self._stands(a, b, rank):
                    self.left[rank], self.right[rank], self.reached[rank] = a, b, True
                    break

    def _stands(self, a: int, b: int, limit: int) -> bool:
        """Whether merges of ranks below the limit leave tokens a and b as they are, side by side.

        The merges that made a and b are undone from the last on. Of equal ranks the left merge comes first. Whatever
        pair faces the boundary at a time must not join to a token that would have been made by then.
        """
        tokens, ranks, left, right = self.tokens, self.ranks, self.left, self.right
        while True:
            across = ranks.get(tokens[a] + tokens[b], limit)
            if across < limit:
                return False
            a_made, b_made = left[a] >= 0, left[b] >= 0
            if a_made and (a > b or not b_made):
                limit, a = min(limit, a), right[a]
            elif b_made:
                limit, b = min(limit, b + 1), left[b]
            else:
                return True

    def judge(self, a: int, b: int) -> bool:
        """Whether b may follow a; kept in ``pairs`` under a << 32 | b."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        stands = self.pairs[a << 32 | b] = self._stands(a, b, len(self.tokens))
        return stands


def _replaced(pattern: str, names: dict[str, str]) -> str:
    for name, to in names.items():
        pattern = pattern.replace(name, to)
    return pattern


class Codec:
    """Encoder and decoder of one vocabulary and split pattern."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.tokens = vocabulary, vocabulary.tokens
        self.sizes = [len(t) for t in self.tokens]
        # The \s of the pattern is the Unicode property; the regex module spells it out.
        spelt = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        ends = [[f"\\U{int(x, 16):08x}" for x in span.split("-")] for span in NEWER_LETTERS_AND_NUMBERS.split()]
        newer = "".join("-".join(e) for e in ends)
        self._newer = regex.compile(f"[{newer}]")
        least = min(int(span.split("-")[0], 16) for span in NEWER_LETTERS_AND_NUMBERS.split())
        self._beyond = re.compile(f"[{chr(least)}-\U0010ffff]")
        self._usual = regex.compile(spelt)
        self._exact = regex.compile(regex.sub(r"\\p\{([LN])\}", lambda m: rf"[\p{{{m[1]}}}--[{newer}]]", spelt), regex.V1)
        # For ASCII texts the classes are short ranges, which the standard module reads faster.
        ranges = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}
        plain = re.sub(r"\[[^\]]*\]", lambda m: _replaced(m[0], ranges), pattern)
        plain = _replaced(plain, {name: f"[{span}]" for name, span in ranges.items()})
        self._ascii = re.compile(plain, re.ASCII) if r"\p" not in plain.lower() else None
        self._automaton = ahocorasick.Automaton()
        for token, rank in vocabulary.ranks.items():
            if token and vocabulary.reached[rank]:
                self._automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self._automaton.make_automaton()
        self._forget()

    def _forget(self) -> None:
        """Start anew: the ids of each piece as the bytes of 32-bit numbers, in a young and an old generation."""
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._memo_bytes = 0

    def splitter(self, text: str) -> regex.Pattern | re.Pattern:
        """The split pattern; its slower forms only where a text needs them."""
        if text.isascii():
            return self._ascii or self._usual
        if not self._beyond.search(text) or not self._newer.search(text):
            return self._usual
        return self._exact

    def pieces(self, text: str) -> list[str]:
        found = self.splitter(text).findall(text)
        if sum(map(len, found)) != len(text):
            raise ValueError("the split pattern leaves characters out")
        return found

    def fill(self, data: bytes, last: array | list[int]) -> array | list[int]:
        """``last`` for all prefixes of a piece; entries that are there already stay."""
        end = len(last) - 1
        pairs, judge, add = self.vocabulary.pairs, self.vocabulary.judge, last.append
        begin = max(0, len(last) - self.vocabulary.longest + 1)
        # Of the tokens that end at one byte the automaton names the longest first.
        for at, (token, size) in self._automaton.iter(data.decode("latin-1"), begin):
            if at > end:
                if size <= at:
                    stands = pairs.get(last[at - size] << 32 | token)
                    if stands is None:
                        stands = judge(last[at - size], token)
                    if not stands:
                        continue
                add(token)
                end = at
        if len(last) != len(data):
            raise ValueError("the rank file lacks a single byte")
        return last

    def table(self, piece: str, known: array | None = None) -> array:
        """The prefix table of a piece; known: entries for its first bytes."""
        data = piece.encode()
        last = self.fill(data, known if known is not None else array("i"))
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            last[-1] = whole
        return last

    def walk(self, last: array | list[int]) -> list[int]:
        """The tokens of a table, from its end backwards. Tables put one after the other can be read as one."""
        ids, at, sizes = [], len(last) - 1, self.sizes
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= sizes[token]
        ids.reverse()
        return ids

    def learn(self, pieces: Iterable[str]) -> None:
        """Keep the ids of new pieces. In byte order neighbours share beginnings, and with them entries of their tables."""
        ranks, memo, old = self.vocabulary.ranks, self._memo, self._old
        before, last = b"", []
        for data, piece in sorted((p.encode(), p) for p in pieces):
            ids = old.get(piece)
            if ids is None:
                whole = ranks.get(data)
                if whole is None:
                    same = 0
                    for x, y in zip(before, data):
                        if x != y:
                            break
                        same += 1
                    del last[same:]
                    before = data
                    ids = array("i", self.walk(self.fill(data, last))).tobytes()
                else:
                    ids = array("i", (whole,)).tobytes()
            memo[piece] = ids
            self._memo_bytes += len(piece) + len(ids)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self._memo) > MEMO_PIECES or self._memo_bytes > MEMO_BYTES:
            # Pieces that come again move over to the young generation, the others go with the old one.
            self._memo, self._old, self._memo_bytes = {}, self._memo, 0
        split = [self.pieces(text or "") for text in texts]
        known = self._memo
        self.learn(filterfalse(known.__contains__, set().union(*split)))
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), dtype=np.int32) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class PrefixTable:
    """A text, the starts of its pieces (in characters) and the last token of every byte prefix of each piece."""

    def __init__(self, codec: Codec, text: str, starts: list[int], last: array) -> None:
        self.codec, self.text, self.starts, self.last = codec, text, starts, last

    @classmethod
    def of(cls, codec: Codec, text: str | None) -> PrefixTable:
        made = cls(codec, "", [], array("i"))
        made.replace(0, 0, text or "")
        return made

    def ids(self) -> list[int]:
        return self.codec.walk(self.last)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), 0, more)

    def replace(self, at: int, removed: int, added: str) -> int:
        """Put ``added`` in the place of so many characters from ``at`` on; returns for how many bytes entries were made.

        A piece stays if neither it nor the characters its match depends on are touched. The piece behind those may keep
        the entries before the edit, but for the last, which may be a token that only stands for the whole piece.
        """
        at = min(max(at, 0), len(self.text))
        removed = min(max(removed, 0), len(self.text) - at)
        old, starts, last = self.text, self.starts, self.last
        new = old[:at] + added + old[at + removed :]
        ends = [*starts[1:], len(old)] if starts else []
        kept = bisect_right(ends, at - LOOKAHEAD)
        position = ends[kept - 1] if kept else 0
        shift, resume = len(added) - removed, at + len(added)
        later = {s: i for i, s in enumerate(starts) if s >= at + removed}

        byte_at = len(old[:position].encode())
        table, made_starts, fresh = last[:byte_at], starts[:kept], 0
        first, rest = True, None
        for match in self.codec.splitter(new).finditer(new, position):
            start = match.start()
            if start >= resume and start - shift in later:
                rest = later[start - shift]
                break
            known = array("i")
            if first and kept < len(starts):
                same = len(old[position : min(at, ends[kept], match.end())].encode())
                known = last[byte_at : byte_at + max(0, same - 1)]
            first = False
            size = len(known)
            piece = self.codec.table(match.group(), known)
            fresh += len(piece) - size
            table.extend(piece)
            made_starts.append(start)
        if rest is not None:
            table.extend(last[len(old[: starts[rest]].encode()) :])
            made_starts.extend(s + shift for s in starts[rest:])
        self.text, self.starts, self.last = new, made_starts, table
        return fresh


_CODECS: dict[str, Codec] = {}


def _codec(spec: Shared) -> Codec:
    """The codec of this worker, made once."""
    if spec.id not in _CODECS:
        _CODECS.clear()
        ranks, made, pattern = spec.value
        _CODECS[spec.id] = Codec(Vocabulary(ranks, made), pattern)
    return _CODECS[spec.id]


def _shared(spark: SparkSession, ranks_path: str, pattern: str) -> Shared:
    """The vocabulary of fixed size (about a megabyte) for all workers; its splits are found once."""
    ship_code(spark)
    ranks = read_ranks(ranks_path)
    return Shared(spark, (ranks, Vocabulary(ranks).arrays(), pattern))


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def _encoded(keys: pa.Array, ids: list[np.ndarray], decoded: list[bytes]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
    lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
    return pa.RecordBatch.from_arrays([keys, lists, pa.array(decoded, pa.binary())], schema=_ENCODED)


def encode(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, ids, decoded (the bytes that the ids stand for)."""
    spec = _shared(spark, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                ids = codec.encode(part.column("text").to_pylist())
                yield _encoded(part.column("doc_id"), ids, [codec.decode(i) for i in ids])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


_TABLE = "doc_id long, text string, starts array<int>, last array<int>"


def prefix_tables(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, text, starts and last, to be stored for later appends and edits."""
    spec = _shared(spark, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                made = PrefixTable.of(codec, part.column("text")[0].as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([made.text], pa.string()),
                        pa.array([made.starts], pa.list_(pa.int32())), pa.array([np.array(made.last)], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "text", "starts", "last"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _TABLE)


def edit(spark: SparkSession, rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Apply one edit to each stored table: columns of ``prefix_tables`` and at, removed, added (an append has at null).

    Returns the new table, its ids and n_fresh: the bytes for which entries were made, which depends on the edit and
    the pieces it touches, not on the text.
    """
    spec = _shared(spark, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for batch in batches:
            for row in range(batch.num_rows):
                given = batch.slice(row, 1).to_pylist()[0]
                table = PrefixTable(codec, given["text"] or "", given["starts"] or [], array("i", given["last"] or []))
                at = len(table.text) if given["at"] is None else given["at"]
                fresh = table.replace(at, given["removed"] or 0, given["added"] or "")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([given["doc_id"]], pa.int64()), pa.array([table.text], pa.string()),
                        pa.array([table.starts], pa.list_(pa.int32())), pa.array([np.array(table.last)], pa.list_(pa.int32())),
                        pa.array([table.ids()], pa.list_(pa.int32())), pa.array([fresh], pa.int64()),
                    ],
                    names=["doc_id", "text", "starts", "last", "ids", "n_fresh"],
                )

    named = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "starts", "last",
        F.col("at").cast("int").alias("at"), F.col("removed").cast("int").alias("removed"), F.col("added").cast("string").alias("added"),
    )
    return named.mapInArrow(run, f"{_TABLE}, ids array<int>, n_fresh long")
