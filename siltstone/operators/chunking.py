"""Chunks of markdown and transcripts for a model's window, in tokens of four bytes. Blocks are kept whole where they fit."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values, in tokens.
TARGET, LEAST, MOST, OVERLAP, CHARS = 6000, 500, 8000, 200, 4

_item = re.compile(r"[-*+] |\d+[.)] ")


def tokens(text: str) -> int:
    return -(-len(text.encode("utf-8", "replace")) // CHARS)


@dataclass
class _Pack:
    """Pieces gathered into chunks."""

    done: list[str]
    held: list[str]
    size: int = 0

    def close(self) -> None:
        if self.held:
            self.done.append("".join(self.held))
        self.held, self.size = [], 0

    def add(self, text: str, size: int, glue: str) -> None:
        self.held += [glue, text] if self.held else [text]
        self.size += size


def hard_split(text: str, limit: int = TARGET) -> list[str]:
    width = limit * CHARS
    return [text[at : at + width] for at in range(0, len(text), width)]


def blocks(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of a markdown text: code, header, list and paragraph blocks in order; blank lines between them are dropped."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    lines = [ln[:-1] if ln.endswith("\r") else ln for ln in lines]
    listed = [bool(_item.match(ln.lstrip())) for ln in lines]
    at = 0
    while at < len(lines):
        start, line = at, lines[at]
        bare = line.lstrip()
        at += 1
        if bare.startswith("```"):
            while at < len(lines) and not lines[at].lstrip().startswith("```"):
                at += 1
            at = min(at + 1, len(lines))
            kind = "code"
        elif line.startswith("#"):
            kind = "header"
        elif listed[start]:
            kind = "list"
            while at < len(lines):
                blank = not lines[at].strip()
                goes_on = listed[at] or (not blank and lines[at][:1] in (" ", "\t")) or (blank and at + 1 < len(lines) and listed[at + 1])
                if not goes_on:
                    break
                at += 1
        elif bare:
            kind = "paragraph"
            while at < len(lines) and lines[at].strip() and not lines[at].startswith("#") and not lines[at].lstrip().startswith("```") and not listed[at]:
                at += 1
        else:
            continue
        yield kind, "\n".join(lines[start:at])


def _pack_blocks(text: str) -> list[str]:
    pack = _Pack([], [])
    for kind, block in blocks(text):
        size = tokens(block)
        if kind == "code":
            if pack.held and pack.size + size <= MOST:
                pack.add(block, size, "\n\n")
            else:
                pack.close()
                pack.done.append(block)
        elif kind == "header":
            if pack.size >= LEAST:
                pack.close()
            pack.add(block, size, "\n\n")
        elif pack.size + size <= TARGET:
            pack.add(block, size, "\n\n")
        elif size > MOST:
            parts = hard_split(block)
            if pack.held and pack.size + tokens(parts[0]) <= MOST:
                pack.add(parts.pop(0), 0, "\n\n")
            pack.close()
            pack.done += parts
        else:
            pack.close()
            pack.add(block, size, "")
    pack.close()
    return pack.done


def _absorb_small(chunks: list[str]) -> list[str]:
    out: list[str] = []
    for chunk in chunks:
        if out and tokens(chunk) < LEAST and tokens(out[-1]) + tokens(chunk) <= MOST:
            out[-1] += "\n\n" + chunk
        else:
            out.append(chunk)
    if len(out) > 1 and tokens(out[0]) < LEAST and tokens(out[0]) + tokens(out[1]) <= MOST:
        out[:2] = [out[0] + "\n\n" + out[1]]
    return out


def _overlapped(chunks: list[str]) -> list[str]:
    width = OVERLAP * CHARS
    return chunks[:1] + [before[-width:] + "\n" + chunk for before, chunk in zip(chunks, chunks[1:])]


def chunk_markdown(text: str) -> list[str]:
    if not text:
        return []
    if tokens(text) <= TARGET:
        return [text]
    return _overlapped(_absorb_small(_pack_blocks(text))) or [text]


def chunk_transcript(text: str) -> list[str]:
    """Turns of a transcript packed to the target size; a turn beyond the largest size is cut hard."""
    if tokens(text) <= TARGET:
        return [text]
    turns = [t for t in re.split(r"(?=\[USER\]:)", text) if t]
    if len(turns) == 1 and not text.startswith("[USER]:"):
        return _overlapped(_absorb_small(hard_split(text)))
    pack = _Pack([], [])
    for turn in turns:
        size = tokens(turn)
        if size > MOST:
            pack.close()
            pack.done += hard_split(turn)
            continue
        if pack.size + size > TARGET:
            pack.close()
        pack.add(turn, size, "")
    pack.close()
    return _overlapped(_absorb_small(pack.done))


def chunks(rows: DataFrame, key: str, text: str, by: Callable[[str], list[str]] = chunk_markdown) -> DataFrame:
    """key, chunk_no, chunk, tokens of every row; null texts have no chunks. Texts are cut whole, one at a time."""
    schema = T.StructType([rows.select(key).schema[0], T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, i, c, tokens(c)) for k, t in zip(*(c.to_pylist() for c in batch.columns)) for i, c in enumerate(by(t))]
            for at in range(0, len(out), 4096):
                cols = list(zip(*out[at : at + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=schema.names)

    return rows.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)
