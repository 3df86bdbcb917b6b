"""Byte-level BPE encoding and decoding in linear time.

Merging pairs until none is left costs more than linear time in the length of a piece.  Here the
tokens that begin at each byte are found with an Aho-Corasick automaton (bytes stand as Latin-1
characters), and the encoder walks through the piece with the longest of them.  A token may follow
another only if merging the bytes of both gives just these two; that test is remembered per pair.
Where no token fits, the encoder steps back, marks the place as dead and tries the next shorter
token.  A row of tokens in which all neighbours are compatible is the one that merging would give.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from proseforge.llm.common import map_texts, one_per_worker

#: Entries that a worker remembers of pieces (twice as many: recent and older ones) and of pairs.
PIECES, PAIRS = 100_000, 150_000
#: Largest vocabulary file that is broadcast, in bytes.
VOCABULARY_BYTES = 32_000_000


class Vocabulary:
    """Token bytes by rank, with the tables that encoding needs; tables fill as they are used."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing[:5]}")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.of_byte = [ranks[bytes([i])] for i in range(256)]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self._own: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids by merging pairs of lowest rank; only for the bytes of one or two tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            joined = [self.ranks.get(a + b, -1) for a, b in zip(parts, parts[1:])]
            possible = [r for r in joined if r >= 0]
            if not possible:
                break
            at = joined.index(min(possible))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def own(self, token: int) -> bool:
        """Whether merging the bytes of the token gives the token."""
        known = self._own.get(token)
        if known is None:
            known = self._own[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self.own(right) and self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._pairs[key] = known
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, -1 if there is none."""
        known = self._shorter.get(token)
        if known is None:
            text, known = self.bytes_of[token], -1
            for size in range(len(text) - 1, 0, -1):
                rank = self.ranks.get(text[:size])
                if rank is not None and self.own(rank):
                    known = rank
                    break
            self._shorter[token] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest = [self.of_byte[b] for b in piece]
        # Ends ascend, so what is written last for a start is the longest token there.
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length] = token
        longest.append(-1)
        bytes_of, pairs, ids, dead = self.bytes_of, self._pairs, [], bytearray(size + 1)
        at, token, last = 0, longest[0], -1
        while at < size:
            end = at
            while token >= 0:
                end = at + len(bytes_of[token])
                if not dead[end]:
                    if last < 0:
                        fits = self.own(token)
                    else:
                        fits = pairs.get((last, token))
                        if fits is None:
                            fits = self.compatible(last, token)
                    if fits:
                        break
                token = self.shorter(token)
            if token >= 0:
                ids.append(token)
                at, last, token = end, token, longest[end]
            else:
                dead[at] = 1
                token = ids.pop()
                at -= len(bytes_of[token])
                last = ids[-1] if ids else -1
        return ids

    def packed(self, piece: str) -> bytes:
        """Ids of one piece, remembered unless the piece is long."""
        found = self._older.pop(piece, None)
        if found is None:
            found = struct.pack(f"<{len(ids)}I", *ids) if (ids := self.encode_piece(piece.encode())) else b""
        if len(piece) <= 64:
            if len(self._pieces) >= PIECES:
                self._older, self._pieces = self._pieces, {}
            self._pieces[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pieces = self.split(text)
        found = list(map(self._pieces.get, pieces))
        if None in found:
            known, packed = self._pieces, self.packed
            found = [x if x is not None else (known.get(p) or packed(p)) for x, p in zip(found, pieces)]
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from a file with one base64 token and its rank per line."""
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Shipped:
    """A vocabulary file on its way to the workers: its bytes as a broadcast variable, and their digest."""

    def __init__(self, df: DataFrame, raw: bytes):
        self.raw = df.sparkSession.sparkContext.broadcast(raw)
        self.digest = hashlib.sha256(raw).hexdigest()


def vocabulary(sent: Shipped, pattern: str) -> Vocabulary:
    return one_per_worker(("bpe", sent.digest, pattern), lambda: Vocabulary(read_ranks(sent.raw.value), pattern))


def shipped(df: DataFrame, path: str) -> Shipped:
    """The vocabulary file for the workers; its size is checked."""
    with open(path, "rb") as file:
        raw = file.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary file may have {VOCABULARY_BYTES} bytes")
    return Shipped(df, raw)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens``.

    Every match of ``pattern`` is encoded by itself; there are no special tokens.  A null text counts
    as empty and has no ids.  Rows that repeat are encoded each.  Other columns are kept as they are
    (``keep`` names fewer); one called ``ids`` or ``n_tokens`` is replaced.
    """
    sent = shipped(df, path)
    added = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def work(texts: list[str | None]) -> dict[str, list]:
        words = vocabulary(sent, pattern)
        ids = [words.encode(t) for t in texts]
        return {"ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

    return map_texts(df, text, df.columns if keep is None else keep, added, work)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode every text, decode the ids, and add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Nulls, empty texts, repeated rows and clashing names: as in ``encode``; the digests of an empty
    text are those of no bytes.
    """
    sent = shipped(df, path)
    added = T.StructType([
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ])

    def work(texts: list[str | None]) -> dict[str, list]:
        words, made = vocabulary(sent, pattern), {name: [] for name in added.names}
        for t in texts:
            ids = words.encode(t)
            made["n_tokens"].append(len(ids) // 4)
            made["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            made["decoded_sha256"].append(hashlib.sha256(words.decode(ids)).hexdigest())
        return made

    return map_texts(df, text, df.columns if keep is None else keep, added, work)
