"""Encoding of texts with a public byte-level BPE vocabulary.

Bytes are read as Latin-1 characters, so that an Aho-Corasick automaton over str can find every token in a piece of text.
From the longest token at each place, the encoder goes ahead as long as each token is compatible with the one before it,
and backtracks to shorter tokens where it isn't. Compatibility of two adjacent tokens - that the merges of the vocabulary,
applied to their joint bytes, give just these two - is looked up in a memo. The result is that of the merges themselves, and
each place of a piece is given up once at most, so that time is linear in the length of the piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces and pairs a worker remembers; a full memo is emptied. Neither changes a result.
MEMO = 400_000


class BacktrackEncoder:
    """Exact byte-level BPE by backtracking over longest matches."""

    def __init__(self, rank_file: bytes):
        import ahocorasick
        import regex

        self.words = regex.compile(PATTERN).findall
        self.ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.text_of = {rank: token for token, rank in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.memo: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}

    def _merged(self, text: str) -> list[str]:
        """The merges applied one by one, lowest rank first: the definition that compatibility rests on."""
        parts = list(text)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[a, b] = self._merged(self.text_of[a] + self.text_of[b]) == [self.text_of[a], self.text_of[b]]
        return known

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if it is a single byte."""
        known = self.shorter.get(token)
        if known is None:
            text, known = self.text_of[token], -1
            for n in range(len(text) - 1, 0, -1):
                if (known := self.ranks.get(text[:n], -1)) >= 0:
                    break
            self.shorter[token] = known
        return known

    def piece(self, text: str) -> list[int]:
        """The tokens of one piece, given as Latin-1."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest, width = [-1] * n, [0] * n
        for end, rank in self.automaton.iter(text):
            size = len(self.text_of[rank])
            if size > width[end + 1 - size]:
                longest[end + 1 - size], width[end + 1 - size] = rank, size
        dead, out, at, token = bytearray(n + 1), [], 0, longest[0]
        while at < n or token >= 0:
            end = at + len(self.text_of[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    break
                token = longest[at]
                continue
            token = self._next_shorter(token)
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= len(self.text_of[token])
                token = self._next_shorter(token)
        return out

    def encode(self, text: str) -> list[int]:
        """Token ids of a text without special tokens; their strings are ordinary text."""
        memo, out = self.memo, []
        for word in self.words(text):
            ids = memo.get(word)
            if ids is None:
                ids = tuple(self.piece(word.encode("utf-8", "replace").decode("latin-1")))
                if len(word) < 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = ids
            out.extend(ids)
        return out


_encoders: dict[int, BacktrackEncoder] = {}


def rank_file(vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    return (Path(folder) / f"{vocabulary}.tiktoken").read_bytes()


def encoder(data: bytes) -> BacktrackEncoder:
    """One encoder a worker process and vocabulary."""
    key = hash(data)
    if key not in _encoders:
        _encoders[key] = BacktrackEncoder(data)
    return _encoders[key]


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, ids (array of int): the token ids of every text. Null and empty texts have an empty list, white space has
    its tokens, texts are encoded whole however long, and every input row gives one row. The vocabulary file (about a
    megabyte, whatever the data) is read on the driver and broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(rank_file(vocabulary, folder))
    schema = T.StructType([documents.select(key).schema[0], T.StructField("ids", T.ArrayType(T.IntegerType(), False), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            offsets, flat = [0], []
            for t in batch.column(1).to_pylist():
                if t:
                    flat.extend(enc.encode(t))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, schema)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, n_tokens: as token_ids, but only how many; 0 for null and empty texts."""
    return token_ids(documents, key, text, vocabulary, folder).select(key, F.size("ids").cast("bigint").alias("n_tokens"))
