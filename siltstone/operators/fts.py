"""Full-text search: tokens, weighted term frequencies and a web-search query syntax.

A document has fields of weights A, B, C; words are lower-cased runs of letters, digits and underscores (no stemming). The
rank of a document is the sum over its matched terms of weight * (1 + ln(tf)) by field. Queries: words are all required,
OR joins alternatives, a leading - excludes, quotes make a phrase.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the field classes.
FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


@dataclass(frozen=True)
class WebQuery:
    """groups: all must match, each by one of its alternatives (a tuple of words is a phrase). excluded: none may match."""

    groups: tuple[tuple[tuple[str, ...], ...], ...]
    excluded: tuple[tuple[str, ...], ...]


def parse(query: str) -> WebQuery:
    groups: list[list[tuple[str, ...]]] = []
    excluded: list[tuple[str, ...]] = []
    joined = False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word == "OR" and not minus:
            joined = bool(groups)
            continue
        words = tuple(w for w in re.split(r"[^\w]+", (phrase or word).lower()) if w)
        if not words:
            continue
        if minus:
            excluded.append(words)
        elif joined:
            groups[-1].append(words)
        else:
            groups.append([words])
        joined = False
    return WebQuery(tuple(map(tuple, groups)), tuple(excluded))


def tokens(text: Column) -> Column:
    """Words in lower case; the dotted capital I is read as i, whose lower case else depends on the engine."""
    return F.filter(F.split(F.lower(F.translate(text, "İ", "i")), "[^\\p{L}\\p{N}_]+"), lambda w: w != "")


def _holds(words: Column, phrase: tuple[str, ...]) -> Column:
    if len(phrase) == 1:
        return F.array_contains(words, phrase[0])
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return text.contains(" " + " ".join(phrase) + " ")


def matches(words: Column, query: WebQuery) -> Column:
    out = F.lit(bool(query.groups))
    for group in query.groups:
        out = out & _any(words, group)
    return out & ~_any(words, query.excluded)


def _any(words: Column, phrases: tuple[tuple[str, ...], ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | _holds(words, p)
    return out


def rank(fields: dict[str, Column], query: WebQuery) -> Column:
    """fields: token arrays by weight class."""
    terms = sorted({w for g in query.groups for phrase in g for w in phrase})
    out = F.lit(0.0)
    for cls, words in fields.items():
        for term in terms:
            n = F.size(F.filter(F.coalesce(words, F.array()), lambda w: w == term))
            out = out + F.when(n > 0, FIELD_WEIGHTS[cls] * (1 + F.log(n.cast("double")))).otherwise(0.0)
    return out


def search(rows: DataFrame, key: str, fields: dict[str, str], query: str, limit: int | None = 20) -> DataFrame:
    """key, score of the rows that match, best first. fields: columns by weight class. A scan with a filter: words are taken
    apart only for rows that hold some term as a substring, and top-k needs no shuffle of texts."""
    q = parse(query)
    first = [w for g in q.groups[:1] for phrase in g for w in phrase]
    near = F.lit(False)
    for w in first:
        for column in fields.values():
            near = near | F.coalesce(F.lower(column).contains(w), F.lit(False))
    toks = {cls: tokens(F.coalesce(F.col(column), F.lit(""))) for cls, column in fields.items()}
    every = F.concat(*toks.values())
    out = rows.where(near).where(matches(every, q)).select(key, rank(toks, q).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def union_search(tables: dict[str, tuple[DataFrame, str, dict[str, str]]], query: str, limit: int = 3) -> DataFrame:
    """entity_type, id, score: the best of each table, then the best of those."""
    out = None
    for name, (rows, key, fields) in tables.items():
        each = search(rows, key, fields, query, limit).select(F.lit(name).alias("entity_type"), F.col(key).alias("id"), "score")
        out = each if out is None else out.unionByName(each)
    return out.orderBy(F.desc("score"), "entity_type", "id").limit(limit)


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, positions: an inverted index, to be written bucketed by term."""
    words = rows.select(key, F.posexplode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("pos", "term"))
    return words.groupBy("term", key).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def _followed(starts: Column, later: Column, n: int) -> Column:
    return F.filter(starts, lambda s: F.array_contains(later, s + n))


def index(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """term, field, key, tf, positions of the fields (columns by weight class): an inverted index over several fields, to be
    written bucketed or partitioned by a hash of the term."""
    out = None
    for cls, column in fields.items():
        each = postings(rows, key, column).withColumn("field", F.lit(cls))
        out = each if out is None else out.unionByName(each)
    return out


def search_index(indexed: DataFrame, key: str, query: str, limit: int | None = 20) -> DataFrame:
    """key, score as search gives them, from an index: only postings of the query's terms are read, which is a filter the scan
    takes over, and a document's few postings meet in one row. Phrases go by positions within a field."""
    q = parse(query)
    wanted = sorted({w for phrases in (*q.groups, q.excluded) for p in phrases for w in p})
    scored = {w for group in q.groups for p in group for w in p}
    if not q.groups:
        return indexed.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    hits = indexed.where(F.col("term").isin(*wanted))
    weight = F.coalesce(*(F.when(F.col("field") == c, F.lit(w)) for c, w in FIELD_WEIGHTS.items()))
    share = F.when(F.col("term").isin(*scored), weight * (1 + F.log(F.col("tf").cast("double")))).otherwise(0.0)
    docs = hits.groupBy(key).agg(F.sum(share).alias("score"), F.collect_list(F.struct("term", "field", "positions")).alias("p"))

    def holds(phrase: tuple[str, ...]) -> Column:
        of = lambda w, field: F.flatten(F.transform(F.filter("p", lambda x: (x["term"] == w) & (x["field"] == field)), lambda x: x["positions"]))
        if len(phrase) == 1:
            return F.exists("p", lambda x: x["term"] == phrase[0])
        out = F.lit(False)
        for field in FIELD_WEIGHTS:
            starts = of(phrase[0], field)
            for n, word in enumerate(phrase[1:], 1):
                starts = _followed(starts, of(word, field), n)
            out = out | (F.size(starts) > 0)
        return out

    fits = F.lit(True)
    for group in q.groups:
        some = F.lit(False)
        for phrase in group:
            some = some | holds(phrase)
        fits = fits & some
    for phrase in q.excluded:
        fits = fits & ~holds(phrase)
    out = docs.where(fits).select(key, "score")
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)
