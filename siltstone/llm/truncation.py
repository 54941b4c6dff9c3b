"""Texts cut off before their end.

All texts give a vocabulary trie, kept as a table of its nodes: how often a word ends at a node and how often longer words
go on from it. All inner places of the texts tell what follows a word: more of the sentence, the end of a sentence, or the
bare end of a line. A text is flagged if its final word is an unknown proper prefix of known words, if the corpus goes on
after its last words where it ends, if a structure is left open, or, with weaker signs, if it has just the length at which
texts of its source pile up.

Only counts of what occurs at the end of some text are needed. A bit table of a fixed size says what that is, so each task
counts little more than it has to, and only sums are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bits import bit_table, bits_for
from siltstone.plans.lineage import cut

#: A final word is the beginning of a longer one if longer words go on from it so many times as often as it stands alone.
#: In prose, where bare ends are rare, fewer suffice.
PREFIX_RATIO, PROSE_PREFIX_RATIO = 20, 2

#: Places that are added to those seen of a word.
USUAL_PLACES = 6

#: Counters, and words, that a task holds before it hands them on.
HELD = 400_000

#: A source's closing lines: those of this share of its texts, and of at least so many.
CLOSING_SHARE, CLOSING_TEXTS, MOST_CLOSING = 0.12, 4, 200

_token = re.compile(r"\d+(?:\.\d+)+(?!\w)|\w+")
_tokens_and_gaps = re.compile(r"(\d+(?:\.\d+)+(?!\w)|\w+)")
_letter = re.compile(r"\w")
_digits = re.compile(r"\d+")
_MARKERS = ("[…]", "[...]", "(…)", "(...)", "…", "...")
_sentence_end = re.compile(r"[.?!。！？।؟…]")
_list_line = re.compile(r"\s*(?:[-*+•]|\d+[.)]|\[[ x]\])\s")
_link_line = re.compile(r"\w{2,10}://\S+\s*$")
_log_line = re.compile(r"\s*\[?\d{4}-\d\d-\d\d[T ]?")
_partial_escape = re.compile(r"(?:&#?\w{0,7}|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|%[0-9A-Fa-f]?|\\)$")
_fence = re.compile(r"^\s*```", re.M)


def _line_kind(line: str, entity_type: str | None, inside_code: bool) -> str:
    if inside_code:
        return "code"
    if entity_type == "git_commit":
        return "subject"
    bare = line.lstrip("> \t")
    if bare.startswith("#"):
        return "heading"
    if bare.startswith("|"):
        return "table"
    if _list_line.match(bare):
        return "list"
    if _link_line.match(bare):
        return "link"
    if _log_line.match(bare):
        return "log"
    return "prose"


def _word(token: str) -> str:
    return token if token.isalpha() else _digits.sub("0", token)


def _shape(token: str) -> str:
    if token.isdigit():
        return "0"
    if "_" in token or (not token.isupper() and not token[1:].islower() and len(token) > 1):
        return "name"
    return "word" if len(token) > 1 else "letter"


def _hash(key: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key.encode("utf-8", "replace"))


def _nodes(word: str) -> list[int]:
    """The keys of the trie's nodes on the way to a word, the word's own last; each letter is hashed once."""
    import xxhash

    state, out = xxhash.xxh64(b"n\t"), []
    for letter in word:
        state.update(letter.encode("utf-8", "replace"))
        out.append(state.intdigest())
    return out


LEVELS, KINDS, SHAPES = "bsuh", ("prose", "code", "subject", "heading", "table", "list", "link", "log"), ("0", "name", "word", "letter")
#: By level and kind of line.
_SEEDS = {level: np.array([_hash(f"{level}\t{kind}") for kind in KINDS], dtype=np.uint64) for level in LEVELS}
_SHAPE_HASH = np.array([_hash("shape\t" + s) for s in SHAPES], dtype=np.uint64)
_NOTHING = _hash("")


def _joined(*parts: np.ndarray) -> np.ndarray:
    """One key of several."""
    out = np.zeros_like(parts[-1])
    for p in parts:
        out = (out ^ p) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _keys(kind: np.ndarray, w3: np.ndarray, w2: np.ndarray, w1: np.ndarray, shape: np.ndarray) -> list[np.ndarray]:
    """What stands before a place, from the most to the least telling: the line's kind with the last word and the one before
    it, with the last word and the one before that, with the last word, and with its shape."""
    b, s, u, h = (_SEEDS[level][kind] for level in LEVELS)
    return [_joined(b, w2, w1), _joined(s, w3, w1), _joined(u, w1), _joined(h, _SHAPE_HASH[shape])]


MIDDLE, STOP, BARE = 0, 1, 2


def _follows(gap: str, at_end: bool) -> int:
    """What comes after a word, from the characters up to the next word."""
    line_end = gap.find("\n")
    here = gap if line_end < 0 else gap[:line_end]
    if _sentence_end.search(here) and (line_end >= 0 or at_end or re.search(r"[.?!。！？।؟…][\"'”’»)\]`*_]*\s", here) or re.search(r"[。！？।]", here)):
        return STOP
    return BARE if line_end >= 0 or at_end else MIDDLE


def closing_lines(documents: DataFrame) -> DataFrame:
    """source, closing: the last one or two lines that many texts of a source share; sources sign what they hand on. A closing has at most MOST_CLOSING characters, so the ends of texts suffice."""
    blank = F.lit(" \t\r\n\u000b\f\u00a0\u2003\u3000")
    once = lambda c, then: F.element_at(F.transform(F.array(c), then), 1)
    # Blanks at the end are taken off a short end where that leaves enough, and off the whole text elsewhere.
    near = F.rtrim(F.right("text", F.lit(4 * MOST_CLOSING)), blank)
    enough = lambda s: (F.length(s) > 2 * MOST_CLOSING + 4) | (F.length("text") <= 4 * MOST_CLOSING)
    end = once(near, lambda s: F.right(F.when(enough(s), s).otherwise(F.rtrim("text", blank)), F.lit(2 * MOST_CLOSING + 4)))
    lines = lambda s: F.array(F.substring_index(s, "\n", -1), F.substring_index(s, "\n", -2))
    last = once(F.replace(end, F.lit("\r\n"), F.lit("\n")), lambda s: F.filter(lines(s), lambda x: (x != "") & (F.length(x) <= MOST_CLOSING)))
    rows = documents.where("text is not null and source is not null").select("source", F.array_distinct(last).alias("lasts"))
    totals = rows.groupBy("source").agg(F.count("*").alias("texts"))
    counts = rows.select("source", F.explode("lasts").alias("closing")).groupBy("source", "closing").agg(F.count("*").alias("k")).where(F.col("k") >= CLOSING_TEXTS)
    return counts.join(totals, "source").where(F.col("k") >= CLOSING_SHARE * F.col("texts")).select("source", "closing")


class _Tail:
    """The end of a text, taken apart."""

    __slots__ = ("body", "trail", "marked", "kind", "words", "open", "stop", "w1")

    def __init__(self, text: str, closings: tuple[str, ...], entity_type: str | None):
        body = text.replace("\r\n", "\n").rstrip()
        for closing in closings:
            if body.endswith("\n" + closing):
                body = body[: -len(closing)].rstrip()
                break
        marker = next((m for m in _MARKERS if body.endswith(m)), "")
        self.marked = bool(marker)
        self.body = body = body[: -len(marker)].rstrip() if marker else body
        inside = "```" in body and len(_fence.findall(body)) % 2 == 1
        start = body.rfind("\n") + 1
        line = body[start:]
        self.kind = _line_kind(line, entity_type, inside)
        tokens = self._last_tokens(body)
        found = _letter.search(body[:-65:-1]) or _letter.search(body[::-1])
        self.trail = body[len(body) - found.start() :] if found else body[-20:]
        self.w1 = tokens[-1] if tokens else ""
        self.words = [_word(t) for t in ["", "", *tokens][-3:]]
        ticks = line.replace("```", "").count("`") % 2 == 1
        cells = self.kind == "table" and (not line.rstrip().endswith("|") or self._fewer_cells(body, line))
        self.open = inside or ticks or cells or body.endswith("�") or bool(_partial_escape.search(body[-12:]))
        self.stop = bool(_sentence_end.search(self.trail)) or self._closed(line)

    @staticmethod
    def _last_tokens(body: str) -> list[str]:
        """The last words of a text, three at least if it has them, each of them whole, however long they are."""
        reach = 256
        while True:
            at = max(0, len(body) - reach)
            tokens = _token.findall(body, at)
            if not at or len(tokens) > 4:  # the first ones may have been cut by the reach
                return tokens
            reach *= 8

    @staticmethod
    def _fewer_cells(body: str, line: str) -> bool:
        above = body[: len(body) - len(line)].rstrip("\n").rsplit("\n", 1)[-1]
        return above.lstrip("> ").startswith("|") and above.count("|") > line.count("|")

    def _closed(self, line: str) -> bool:
        if line.strip() == "```" or (self.kind == "table"):
            return True
        return any(ord(c) > 0x2190 and not c.isalnum() and c not in "，、；：（「『" for c in self.trail)


TAIL_SCHEMA = "doc_id bigint, source string, chars bigint, bytes bigint, whole bigint, marked boolean, open boolean, stop boolean, dotted boolean, kind string, w1 string, keys array<bigint>, node bigint, dot bigint"


def tails(documents: DataFrame, closings) -> DataFrame:
    """One row for each text that isn't blank, with what its end shows and the keys of the counts that judge it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        for batch in batches:
            rows, ends = [], []
            for doc, text, source, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None or not text.strip():
                    continue
                t = _Tail(text, closings.value.get(source, ()), kind)
                dotted = t.stop and t.trail == "." and not t.marked and t.kind == "prose"
                judged_by = not t.stop and bool(t.w1)
                if judged_by:
                    ends.append((KINDS.index(t.kind), *(_hash(w) for w in t.words), SHAPES.index(_shape(t.words[2]))))
                rows.append([doc, source, len(t.body), len(t.body.encode("utf-8", "replace")), len(text), t.marked, t.open, t.stop, dotted, t.kind, t.w1, judged_by, signed(_hash("n\t" + t.w1)), signed(_hash("d\t" + t.w1)) if dotted else None])
            if ends:
                kind, w3, w2, w1, shape = zip(*ends)
                words = (np.array(w, dtype=np.uint64) for w in (w3, w2, w1))
                drawn = iter(np.stack(_keys(np.array(kind), *words, np.array(shape)), axis=1).view(np.int64).tolist())
            for row in rows:
                row[11] = next(drawn) if row[11] else []
            cols = list(zip(*rows)) if rows else [[]] * 14
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in TAIL_SCHEMA.split(", ")])

    return documents.select("doc_id", "text", "source", "entity_type").mapInArrow(run, TAIL_SCHEMA)


def _by_source(closings: DataFrame) -> dict[str, tuple[str, ...]]:
    """Few for each source, by the share they must have: at most 2 / CLOSING_SHARE of at most 200 characters."""
    out: dict[str, list[str]] = {}
    for source, closing in closings.toLocalIterator():
        out.setdefault(source, []).append(closing)
    return {k: tuple(sorted(v, key=len, reverse=True)) for k, v in out.items()}


def corpus_counts(documents: DataFrame, wanted, bits: int, closings) -> DataFrame:
    """key, middle, stop, bare: over all texts, how often what a key names is followed by more, by the end of a sentence
    or by the bare end of a line. For a node of the vocabulary trie: how often longer words go on from it (middle) and how
    often a word ends there (stop), the last word of a text left out. Texts are taken apart one by one; words become numbers,
    and all that is counted is counted for a batch of texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(wanted.value, dtype=np.uint8)
        vocabulary, gaps, held = _Vocabulary(), _Gaps(), _Tally()

        def asked(keys: np.ndarray) -> np.ndarray:
            place = keys >> np.uint64(64 - bits)
            return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in batches:
            words, codes, kinds, sizes = [], [], [], []
            for text, source, entity_type in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None or not text.strip():
                    continue
                tail = _Tail(text, closings.value.get(source, ()), entity_type)
                parts = _tokens_and_gaps.split(tail.body)
                if len(parts) < 3:
                    continue
                follows = list(map(gaps.__getitem__, parts[2::2]))
                last = STOP if tail.stop else BARE if tail.marked else _follows(parts[-1], True)
                follows[-1] = last | LAST
                kinds += _kinds_of_words(tail.body, parts, follows, entity_type)
                words += map(vocabulary.__getitem__, parts[1::2])
                codes += follows
                sizes.append(len(follows))
            if not words:
                continue
            word, code, kind = np.array(words), np.array(codes, dtype=np.uint8), np.array(kinds)
            follows, is_last = (code & 3).astype(np.int64), code & LAST > 0
            vocabulary.seen(word, word[is_last])
            hashes, shapes, dots = vocabulary.arrays()
            # What any word is followed by, by kind of line; most words end no text, and nothing more is asked of them.
            pair, inverse = np.unique(kind * len(hashes) + word, return_inverse=True)
            of_kind, of_word = pair // len(hashes), pair % len(hashes)
            counts = np.bincount(inverse * 3 + follows, minlength=3 * len(pair)).reshape(-1, 3)
            none = np.full(len(pair), _NOTHING, dtype=np.uint64)
            by_word, by_shape = _keys(of_kind, none, none, hashes[of_word], shapes[of_word])[2:]
            ends = asked(by_word)
            held.add(by_word[ends], counts[ends])
            held.add(by_shape[(some := asked(by_shape))], counts[some])
            at = np.flatnonzero(ends[inverse])
            begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
            before = lambda k: np.where(at - k >= begins[at], hashes[word[np.maximum(at - k, 0)]], np.uint64(_NOTHING))
            pairs, skips = _keys(kind[at], before(2), before(1), hashes[word[at]], shapes[word[at]])[:2]
            for keys in (pairs, skips):
                some = asked(keys)
                held.add(keys[some], np.eye(3, dtype=np.int64)[follows[at[some]]])
            at = np.flatnonzero((code & DOT > 0) & ~is_last)
            at = at[asked(dots[word[at]])]
            held.add(dots[word[at]], np.eye(3, dtype=np.int64)[np.where(follows[at] == STOP, STOP, MIDDLE)])
            if len(vocabulary) > HELD:
                vocabulary.settle(held, asked)
            if held.size > HELD:
                yield held.batch()
        vocabulary.settle(held, asked)
        yield held.batch()

    parts = documents.select("text", "source", "entity_type").mapInArrow(run, "key bigint, middle bigint, stop bigint, bare bigint")
    return parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("middle", "stop", "bare")))


#: Besides what follows, the code of a word tells whether its gap ends the line, begins with a dot, or ends the text.
LINE_END, DOT, LAST = 4, 8, 16


class _Gaps(dict):
    """The codes of what stands between words."""

    def __missing__(self, gap: str) -> int:
        if len(self) > HELD:
            self.clear()
        self[gap] = code = MIDDLE if gap == " " else _follows(gap, False) | ("\n" in gap) * LINE_END | (gap[:1] == ".") * DOT
        return code


def _kinds_of_words(body: str, parts: list[str], codes: list[int], entity_type: str | None) -> list[int]:
    """The kind of line of each word; parts are the words of body and the gaps around them."""
    fenced, inside, line_start, out = "```" in body, False, 0, []
    line, n = 0, len(codes)
    firsts = [0, *(i + 1 for i, code in enumerate(codes) if code & LINE_END)]
    at, done = len(parts[0]), 0
    for first, following in zip(firsts, [*firsts[1:], n]):
        if first >= n:
            break
        at += sum(map(len, parts[2 * done + 1 : 2 * first + 1]))
        done, line = first, body.rfind("\n", 0, at) + 1
        if fenced and body.count("```", line_start, line) % 2:
            inside = not inside
        line_start, stop = line, body.find("\n", line)
        out += [KINDS.index(_line_kind(body[line : stop if stop >= 0 else len(body)], entity_type, inside))] * (following - first)
    return out


class _Vocabulary(dict):
    """Numbers of words, with what keys are made of, and how often each was seen other than as a text's last word."""

    def __init__(self):
        self.hashes, self.shapes, self.dots, self.times = [], [], [], np.zeros(0, dtype=np.int64)

    def __missing__(self, token: str) -> int:
        self[token] = no = len(self.hashes)
        word = _word(token)
        self.hashes.append(_hash(word))
        self.shapes.append(SHAPES.index(_shape(word)))
        self.dots.append(_hash("d\t" + token))
        return no

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.hashes, dtype=np.uint64), np.array(self.shapes), np.array(self.dots, dtype=np.uint64)

    def seen(self, words: np.ndarray, last: np.ndarray) -> None:
        times = np.bincount(words, minlength=len(self.hashes)) - np.bincount(last, minlength=len(self.hashes))
        times[: len(self.times)] += self.times
        self.times = times

    def settle(self, tally: _Tally, asked: Callable[[np.ndarray], np.ndarray]) -> None:
        """Hands on the counts of the trie's nodes that are asked for, and forgets all words."""
        keys, counts = [], []
        for token, n in zip(self, self.times.tolist()):
            if n:
                nodes = _nodes(token)
                keys += nodes
                counts += [(n, 0, 0)] * (len(nodes) - 1) + [(0, n, 0)]
            if len(keys) > HELD:
                self._hand_on(tally, asked, keys, counts)
        self._hand_on(tally, asked, keys, counts)
        self.clear()
        self.__init__()

    @staticmethod
    def _hand_on(tally: _Tally, asked: Callable[[np.ndarray], np.ndarray], keys: list, counts: list) -> None:
        if keys:
            found = np.array(keys, dtype=np.uint64)
            some = asked(found)
            tally.add(found[some], np.array(counts, dtype=np.int64)[some])
        keys.clear()
        counts.clear()


class _Tally:
    """Sums of counts by key."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        self.waiting += len(keys)
        if self.waiting > HELD:
            self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros(0, dtype=np.uint64)
        counts = np.concatenate([c for _, c in self.parts]) if self.parts else np.zeros((0, 3), dtype=np.int64)
        unique, inverse = np.unique(keys, return_inverse=True)
        sums = np.stack([np.bincount(inverse, counts[:, j], minlength=len(unique)).astype(np.int64) for j in range(3)], axis=1)
        self.parts, self.size, self.waiting = [(unique, sums)], len(unique), 0

    def batch(self) -> pa.RecordBatch:
        self._merge()
        keys, counts = self.parts[0]
        self.parts, self.size = [], 0
        cols = [pa.array(keys.view(np.int64)), *(pa.array(np.ascontiguousarray(counts[:, j])) for j in range(3))]
        return pa.RecordBatch.from_arrays(cols, names=["key", "middle", "stop", "bare"])


def length_piles(ends: DataFrame) -> DataFrame:
    """source, unit, length: lengths (characters or bytes of the text without closing lines, or characters with them) at
    which texts of a source pile up: six at least, and three more than eight times what lengths around it have on average."""
    units = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("chars", "bytes", "whole"))), F.array("chars", "bytes", "whole"))).alias("unit", "length")
    counts = ends.select(F.coalesce("source", F.lit("")).alias("source"), units).groupBy("source", "unit", "length").agg(F.count("*").alias("k"))
    around = counts.select("source", "unit", F.floor(F.col("length") / 64).alias("part"), "length", "k")
    parts = around.groupBy("source", "unit", "part").agg(F.sum("k").alias("part_k"))
    beside = parts.select("source", "unit", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"), "part_k").groupBy("source", "unit", "part").agg(F.sum("part_k").alias("near"))
    return around.where("k >= 6").join(beside, ["source", "unit", "part"]).where(((F.col("k") - 3) * 191 >= 8 * (F.col("near") - F.col("k"))) & (F.col("length") >= 64)).select("source", "unit", "length")


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, source, cut_off for each text that isn't null, empty or blank; others are no cases and get no row. Texts are
    read whole. Ties (as many endings as continuations) count as complete. Null sources are one source."""
    sc = documents.sparkSession.sparkContext
    closings = sc.broadcast(_by_source(closing_lines(documents)))
    ends = cut(tails(documents, closings))
    keys = ends.select(F.explode(F.concat("keys", F.when(~F.col("stop"), F.array("node")).otherwise(F.slice("keys", 1, 0)), F.when(F.col("dot").isNotNull(), F.array("dot")).otherwise(F.slice("keys", 1, 0)))).alias("key")).distinct()
    keys = cut(keys)
    bits = bits_for(keys.count())
    wanted = sc.broadcast(bit_table(keys, bits))
    counts = cut(corpus_counts(documents, wanted, bits, closings))
    bare = ends.where(~F.col("stop"))
    evidence = bare.select("doc_id", F.posexplode("keys").alias("level", "key")).join(counts, "key")
    # The text's own end is among the bare ends.
    others = (F.col("bare") - 1).alias("bare")
    support = evidence.select("doc_id", "level", "middle", "stop", others).where(F.col("middle") + F.col("stop") + F.col("bare") >= 3)
    seen = F.struct("middle", "stop", "bare", "level")
    best = support.groupBy("doc_id").agg(F.min_by(seen, "level").alias("e"), F.max(F.when(F.col("level") == 3, seen)).alias("shape"))
    node = counts.select(F.col("key").alias("node"), F.col("middle").alias("longer"), F.col("stop").alias("same"))
    dot = counts.select(F.col("key").alias("dot"), F.col("middle").alias("inner_dots"), F.col("stop").alias("final_dots"))
    piles = length_piles(ends)
    units = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("chars", "bytes", "whole"))), F.array("chars", "bytes", "whole"))).alias("unit", "length")
    at_pile = bare.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), units).join(piles, ["source", "unit", "length"]).select("doc_id").distinct().withColumn("piled", F.lit(True))
    rows = ends.join(best, "doc_id", "left").join(node, "node", "left").join(dot, "dot", "left").join(at_pile, "doc_id", "left")
    rows = rows.withColumn("piled", F.coalesce("piled", F.lit(False)))
    nothing = lambda c: F.coalesce(c, F.lit(0))
    # A word that hardly ever stands alone where longer words go on is the beginning of one of these; numbers tell nothing.
    in_word = (nothing("longer") > 0) & (nothing("same") * F.when(F.col("kind") == "prose", PROSE_PREFIX_RATIO).otherwise(PREFIX_RATIO) <= nothing("longer")) & ~F.col("w1").rlike("^[0-9.]+$")
    of = lambda e: F.col(f"{e}.middle") + F.col(f"{e}.stop") + F.col(f"{e}.bare")
    # Few places say little about a word: outside of prose USUAL_PLACES more are added that are like those of words of its shape.
    usual = F.when(F.col("kind") == "prose", 0.0).otherwise(F.coalesce(F.col("shape.bare") / of("shape"), F.lit(0.0)))
    share = (F.col("e.bare") + USUAL_PLACES * usual) / (of("e") + F.when(F.col("kind") == "prose", 0).otherwise(USUAL_PLACES))
    # Prose hardly ever ends bare, other lines often do: there a few bare ends outweigh the places where the text goes on.
    goes_on = F.when(F.col("e").isNull(), F.col("kind") == "prose").otherwise(share < F.when(F.col("kind") == "prose", 0.5).otherwise(0.08))
    inside_path = F.col("dotted") & (nothing("inner_dots") >= 3) & (nothing("final_dots") == 0)
    verdict = F.col("open") | F.when(F.col("stop"), inside_path).otherwise(F.col("piled") | in_word | goes_on)
    return rows.select("doc_id", "source", F.coalesce(verdict, F.lit(False)).alias("cut_off"), "kind", "piled", in_word.alias("in_word"), "open", "e", "w1", "marked", inside_path.alias("inside_path"), "same", "longer")


def cut_off(documents: DataFrame) -> DataFrame:
    """doc_id of the texts that were cut inside a word or sentence."""
    return judged(documents).where("cut_off").select("doc_id")


def source_shares(documents: DataFrame) -> DataFrame:
    """source, records, cut_off, share: for each source, null included, how many of all its records were cut off."""
    verdicts = judged(documents).select("source", F.col("cut_off").cast("bigint").alias("cut_off"))
    cuts = verdicts.groupBy(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none")).agg(F.sum("cut_off").alias("cut_off"))
    records = documents.groupBy(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none")).agg(F.count("*").alias("records"))
    return records.join(cuts, ["s", "none"], "left").select(
        F.when(~F.col("none"), F.col("s")).alias("source"), "records", F.coalesce("cut_off", F.lit(0)).alias("cut_off"), (F.coalesce("cut_off", F.lit(0)) / F.col("records")).alias("share")
    )
