"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 6).

A text is cut into pre-tokens by the vocabulary's published pattern, every distinct pre-token is encoded once per Python
worker, and the ids of a text are the joined ids of its pre-tokens. A pre-token is encoded by backtracking:

* its UTF-8 bytes are read as Latin-1, so that an Aho-Corasick automaton over the vocabulary finds the tokens at every
  position in one pass, and the longest is tried first;
* a token may follow another only if byte-pair merging would really leave that border between them. The answer depends
  on the two tokens alone, so it is memoised (`Vocabulary.adjacent`);
* if no token fits, the last one is taken back and its next shorter prefix is tried; a position found to be a dead end is
  never entered again. Each position is left at most once, which keeps the work linear.

The result equals merging the pairs in order of rank. Strings that look like special tokens are plain text.
"""

from __future__ import annotations

import base64
import functools
import os
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.arrow import arrow_column

#: The pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens a worker remembers before it starts anew; only memory and speed depend on it, never a result.
REMEMBERED = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabularies keep a file. Callers may pass any other path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary(dict):
    """Maps a pre-token to its packed int32 ids; unknown pre-tokens are encoded on first use."""

    def __init__(self, path: str):
        import ahocorasick

        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.ranks = ranks
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.find = regex.compile(PATTERN).findall

    def split_of(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; a token of one byte is its own left and right half."""
        if token not in self.halves:
            raw = self.bytes_of[token]
            parts = [bytes([b]) for b in raw]
            while len(parts) > 2:  # merge by rank, stopping before the merge that yields the token itself
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
        return self.halves[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merging leaves a border between these two tokens: no merge across it comes before their own."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        before = 1 << 40  # only merges of a lower rank would have been applied by now
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < before:
                return False
            # undo the later of the two last merges: first of the side that was merged last
            if left > right:
                before, inner = left, self.split_of(left)[1]
                if inner != left:
                    left = inner
                    continue
                before, inner = right + 1, self.split_of(right)[0]
                if inner == right:
                    return True
                right = inner
            else:
                before, inner = right + 1, self.split_of(right)[0]
                if inner != right:
                    right = inner
                    continue
                before, inner = left, self.split_of(left)[1]
                if inner == left:
                    return True
                left = inner

    def next_shorter(self, token: int) -> int:
        """The longest proper prefix of a token that is a token itself, or -1."""
        if token not in self.shorter:
            raw = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.ranks), -1)
        return self.shorter[token]

    def encode_bytes(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        longest = [0] * len(raw)
        lengths = self.bytes_of
        for end, token in self.automaton.iter(raw.decode("latin-1")):  # ends rise, so the longest stays
            longest[end + 1 - len(lengths[token])] = token
        dead = bytearray(len(raw) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(raw):
            while token >= 0:
                end = at + len(lengths[token])
                if not dead[end] and (not out or self.adjacent(out[-1], token)):
                    break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(raw) else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(lengths[token])
                token = self.next_shorter(token)
        return out

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
            self.fits.clear()
        packed = np.array(self.encode_bytes(piece.encode("utf-8", "replace")), dtype=np.int32).tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def pack(self, text: str) -> bytes:
        """All ids of a text as int32 in native order."""
        return b"".join(map(self.__getitem__, self.find(text)))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker and path: the file that came with the job, or the one at the path itself."""
    try:
        sent = SparkFiles.get(os.path.basename(path))
    except AssertionError:  # no session: the function is used by itself
        sent = path
    return Vocabulary(sent if os.path.exists(sent) else path)


_SENT: set[tuple[str, str]] = set()


def _sent(path: str) -> str:
    """The path of a vocabulary, once its file is on its way to all executors: they need no folder in common with the driver."""
    spark = SparkSession.getActiveSession()
    if spark is not None and (spark.sparkContext.applicationId, path) not in _SENT:
        spark.sparkContext.addFile(path)
        _SENT.add((spark.sparkContext.applicationId, path))
    return path


def _ids(texts: pa.Array, path: str) -> pa.Array:
    pack = vocabulary(path).pack
    parts = [pack(text) if text else b"" for text in texts.to_pylist()]
    offsets = np.fromiter(accumulate((len(p) // 4 for p in parts), initial=0), dtype=np.int32, count=len(parts) + 1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))


def _count(texts: pa.Array, path: str) -> pa.Array:
    pack = vocabulary(path).pack
    return pa.array([len(pack(text)) // 4 if text else 0 for text in texts.to_pylist()], type=pa.int64())


def token_ids(text: Column | str, path: str | None = None) -> Column:
    """ARRAY<INT> of the text's ids, without special tokens. A null or empty text gives an empty array, never null."""
    return arrow_column(functools.partial(_ids, path=_sent(path or vocabulary_path())), T.ArrayType(T.IntegerType()), text)


def token_count(text: Column | str, path: str | None = None) -> Column:
    """BIGINT number of ids of a text; 0 where the text is null or empty."""
    return arrow_column(functools.partial(_count, path=_sent(path or vocabulary_path())), T.LongType(), text)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """`df` with a column of ids. Rows are kept one to one, in place, without a shuffle.

    Null, empty: empty array. Repeated rows: each encoded. Very long texts: encoded whole. An empty table: an empty table
    with the column. An existing column `out` is replaced (Spark's rule for `withColumn`); other columns are untouched.
    """
    return df.withColumn(out, token_ids(F.col(text), path))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.sources.tables import table

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
