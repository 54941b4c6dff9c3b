"""Parsers of external layouts: version-control logs, chat transcripts, source code and tool traces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of name-status lines.
CHANGES = {"A": "add", "M": "modify", "D": "delete", "R": "rename", "C": "copy"}


def name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with change_type and file_path of lines like "M<tab>path" or "R100<tab>old<tab>new"; other lines drop out, a
    rename or copy is of the new path."""
    parts = F.split(line, "\t")
    code = F.substring(F.element_at(parts, 1), 1, 1)
    kind = F.lit(None).cast("string")
    for letter, name in CHANGES.items():
        kind = F.when(code == letter, name).otherwise(kind)
    out = lines.where(F.col(line).rlike("^[AMDRC][0-9]*\t.+")).withColumn("change_type", kind)
    return out.withColumn("file_path", F.element_at(parts, -1))


def git_log(text: DataFrame, column: str = "text") -> DataFrame:
    """commit_hash, author, created_at, commit_message, change_type, file_path of a log written with record separators (0x1e)
    between commits, unit separators (0x1f) between hash, author, epoch and subject, and name-status lines after them."""
    records = text.select(F.explode(F.split(column, "\x1e")).alias("r")).where("trim(r) <> ''")
    head = F.split(F.element_at(F.split("r", "\n"), 1), "\x1f")
    rows = records.select(
        F.trim(F.element_at(head, 1)).alias("commit_hash"), F.element_at(head, 2).alias("author"), F.timestamp_seconds(F.element_at(head, 3).cast("bigint")).alias("created_at"),
        F.element_at(head, 4).alias("commit_message"), F.explode_outer(F.filter(F.slice(F.split("r", "\n"), 2, 1_000_000), lambda x: x != "")).alias("line"),
    )
    return name_status(rows).drop("line")


def transcript_lines(jsonl: DataFrame, column: str = "value") -> DataFrame:
    """jsonl rows that are chat messages, as "[USER]: text" and the like; rows that aren't messages drop out."""
    body = F.from_json(column, "type string, role string, message struct<role:string, content:string>, content string")
    rows = jsonl.withColumn("__m", body)
    role = F.upper(F.coalesce("__m.message.role", "__m.role", "__m.type"))
    text = F.coalesce("__m.message.content", "__m.content")
    return rows.withColumn("line", F.concat(F.lit("["), role, F.lit("]: "), text)).where(role.isin("USER", "ASSISTANT", "SYSTEM") & text.isNotNull()).drop("__m")


def tool_name(line: Column) -> Column:
    """The tool that a line of a transcript tells of; null for other lines."""
    t = F.trim(line)
    marked = F.trim(F.regexp_extract(t, "^\\[(?:TOOL|Tool):([^\\]]*)\\]$", 1))
    called = F.regexp_extract(t, "^(?:tool_call|Tool):\\s*(\\S+)", 1)
    json = F.when(t.contains("function_call") | t.contains("tool_use"), F.trim(F.regexp_extract(t, '"name"\\s*:\\s*"([^"]*)"', 1)))
    return F.coalesce(F.nullif(marked, F.lit("")), F.nullif(called, F.lit("")), F.nullif(json, F.lit("")))


def tool_calls(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, tool: the tools of a transcript in order."""
    lines = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.select(key, "pos", tool_name(F.col("line")).alias("tool")).where("tool is not null")


_ITEM = re.compile(r"(?:pub(?:\((?:crate|super)\))? )?(?:async |unsafe |default |extern \"C\" )*(?P<kind>fn|struct|enum|trait|const|static|type|impl(?=[ <]))(?P<rest>.*)$")
_NAMED = re.compile(r" ([^\s(<{;:=]+)")
_PATHS = re.compile(r"(?<![\w:])([^\W\d_a-z]\w*)::")

#: What kinds of items are called; others aren't listed.
SYMBOL_TYPES = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "const": "const", "static": "const", "type": "type_alias", "impl": "impl"}


def _impl_target(rest: str) -> str | None:
    """The type an impl block is of: what follows ` for `, else the first name after generic parameters."""
    depth, at = 0, 0
    rest = rest.lstrip()
    if rest.startswith("<"):
        for at, c in enumerate(rest):
            depth += (c == "<") - (c == ">")
            if not depth:
                break
        rest = rest[at + 1 :].lstrip()
    named = re.match(r"[^ {<]+", rest.split(" for ", 1)[-1].strip())
    return named and named[0]


def rust_symbols(text: str) -> list[tuple[str, str, str, int, str, str | None, list[str]]]:
    """(name, kind, signature, line, visibility, parent, dependencies) of a source text, line by line. Functions and constants
    inside an impl block have its type as parent, as long as its braces are open; comments and attributes are skipped."""
    out, depth, owner, owner_depth = [], 0, None, 0
    for no, line in enumerate(text.split("\n"), 1):
        code = line.strip()
        for c in code:
            depth += (c == "{") - (c == "}")
            if c == "}" and depth < owner_depth:
                owner = None
        m = None if not code or code.startswith(("//", "#")) else _ITEM.match(code)
        if not m:
            continue
        kind, name = SYMBOL_TYPES[m["kind"]], None
        if kind == "impl":
            name = owner = _impl_target(m["rest"]) or owner
            owner_depth = depth
        elif named := _NAMED.match(m["rest"]):
            name = named[1]
        if not name or name == "_":
            continue
        seen = "crate" if code.startswith("pub(crate)") else "public" if code.startswith("pub") else "private"
        parent = owner if kind in ("function", "const") else None
        uses = sorted(set(_PATHS.findall(code))) if kind in ("function", "impl") else []
        out.append((name, kind, code.split("{", 1)[0].strip(), no, seen, parent, uses))
    return out


def symbols(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, symbol_name, symbol_type, signature, line_number, visibility, parent_symbol, dependencies of every file."""
    schema = T.StructType([T.StructField(path, T.StringType()), T.StructField("symbol_name", T.StringType()), T.StructField("symbol_type", T.StringType()), T.StructField("signature", T.StringType()), T.StructField("line_number", T.IntegerType()), T.StructField("visibility", T.StringType()), T.StructField("parent_symbol", T.StringType()), T.StructField("dependencies", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
        for batch in batches:
            rows = [(p, *s) for p, t in zip(*(c.to_pylist() for c in batch.columns)) if t for s in rust_symbols(t)]
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names)

    return files.select(path, text).mapInArrow(run, schema)


def impact(symbols_: DataFrame, name: str) -> DataFrame:
    """role, path, symbol_name, risk: where a symbol is defined, who depends on it, and how risky a change is by the number of
    the latter: none low, up to three medium, more high."""
    defs = symbols_.where(F.col("symbol_name") == name).select(F.lit("definition").alias("role"), "path", "symbol_name")
    users = symbols_.where(F.array_contains("dependencies", name)).select(F.lit("caller").alias("role"), "path", "symbol_name")
    n = users.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, "low").when(F.col("n") <= 3, "medium").otherwise("high").alias("risk"))
    return defs.unionByName(users).join(F.broadcast(n))
