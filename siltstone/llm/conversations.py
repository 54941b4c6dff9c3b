"""Conversations rebuilt from message rows.

Message rows become turns, turns become export fragments (pages of a bounded number of turns that overlap by a few
turns), and fragments are put together again by suffix-prefix matches of their message hashes: matches form an overlap
graph, unambiguous paths through it are merged, and a session whose fragments don't form exactly one path has a gap.
Whoever has export fragments of their own hands them to `assemble` or `judged` as they are; everything after the pages is the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.lineage import cut

#: Spellings of roles, in lower case with spaces, dashes and dots read as underscores.
ROLE_SPELLINGS = {
    "user": ("user", "human", "end_user", "enduser", "customer", "prompter", "usr", "client"),
    "assistant": ("assistant", "ai", "bot", "model", "gpt", "chatbot", "asst", "agent", "ai_assistant", "llm"),
    "system": ("system", "sys", "developer", "system_prompt"),
    "tool": ("tool", "tool_result", "function", "tool_use", "tool_call", "tool_output", "function_call", "function_result"),
}

#: Characters that show nothing, besides Unicode white space.
INVISIBLE = "\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\ufe00-\\ufe0f\\ufeff\\u001c-\\u001f"

#: Turns of a fragment besides its overlap, and overlapping turns. A fragment is the largest thing one task holds; pages are
#: short, so that not only the longest sessions have several.
PAGE_TURNS, OVERLAP_TURNS = 32, 2


def role_class(role: Column) -> Column:
    """user, assistant, system or tool; null for a role that names nobody."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(role, "(?U)^\\s+|\\s+$", "")), "[\\s.\\-]+", "_")
    named = F.create_map(*(F.lit(x) for name, spelt in ROLE_SPELLINGS.items() for s in spelt for x in (s, name)))
    return F.try_element_at(named, plain)


def has_text(content: Column) -> Column:
    """Whether anything but white space and zero-width characters is in content; false for null."""
    return F.coalesce(content.rlike(f"(?U)[^\\s{INVISIBLE}]"), F.lit(False))


def unique_messages(messages: DataFrame) -> DataFrame:
    """session_id, role, who (the role's class), created_at, content_key, id, said: one row for each distinct message of a
    session, under its smallest id; rows without session_id belong to no session. Contents are compared by their SHA-256,
    so that no text is shuffled."""
    rows = messages.where(F.col("session_id").isNotNull()).select(
        "session_id", "role", role_class(F.col("role")).alias("who"), "created_at", "id",
        F.sha2("content", 256).alias("sha"), has_text(F.col("content")).alias("said"),
    )
    rows = rows.withColumn("content_key", F.unhex("sha")).drop("sha")
    # Rows are grouped by their own values; a hash before these makes the sort one of numbers.
    keys = ["session_id", "role", "created_at", "content_key"]
    return rows.groupBy(F.xxhash64(*keys).alias("__h"), *keys, "who").agg(F.min("id").alias("id"), F.max("said").alias("said")).drop("__h")


def turns(messages: DataFrame) -> DataFrame:
    """unique_messages with speaker (user or assistant; null for other rows) and flawed (no time, or a role that names nobody)."""
    return unique_messages(messages).select(
        "session_id", "created_at", "id",
        F.when(F.col("who").isin("user", "assistant") & F.col("said"), F.col("who")).alias("speaker"),
        (F.col("created_at").isNull() | F.col("who").isNull()).alias("flawed"),
        F.xxhash64("session_id", "id", "created_at", "role", "content_key").alias("message_hash"),
    )


def export_fragments(turn_rows: DataFrame, page: int = PAGE_TURNS, overlap: int = OVERLAP_TURNS) -> DataFrame:
    """fragment_id, session_id, turns (array of message_hash, speaker, id in order): the user and assistant turns of each
    session by created_at, then id, on pages of at most `page` turns, each followed by the first turns of the session's next
    page, `overlap` or `page` of them at most. Rows are range-partitioned by session and time, so a session of any size is
    spread over tasks, and no group is larger than a page. A fragment is named by what it holds."""
    overlap = min(overlap, page)
    kept = turn_rows.where(F.col("speaker").isNotNull() & F.col("created_at").isNotNull())
    key = ["session_id", "created_at", "id", "message_hash"]
    placed = kept.select(*key, "speaker").repartitionByRange(*key).sortWithinPartitions(*key).withColumn("row", F.monotonically_increasing_id())
    # The row of a partition is in the lower 33 bits. A turn is on its own page, and at the end of the one before if it is among the first.
    of_task = placed.withColumns({"task": F.expr("row >> 33"), "row": F.expr("row & 8589934591")})
    first = F.expr(f"greatest(0, (row - {overlap}) div {page})")
    rows = of_task.select(*key, "speaker", "task", "row", F.explode(F.sequence(first, F.expr(f"row div {page}"))).alias("page_no"))
    held = F.array_sort(F.collect_list(F.struct("created_at", "id", "message_hash", "speaker")))
    own = F.max(F.expr(f"row div {page} = page_no"))
    pages = rows.groupBy("session_id", "task", "page_no").agg(held.alias("turns"), own.alias("own"), (F.min("row") == 0).alias("opens_task")).where("own").drop("own")
    plain = F.transform("turns", lambda t: F.struct(t.message_hash.alias("message_hash"), t.speaker.alias("speaker"), t.id.alias("id")))
    pages = cut(pages.withColumn("turns", plain))
    # What a task begins with also ends the last page of the task before, if its session came from there: a row for each task.
    heads = pages.where("opens_task").select("session_id", F.col("task").alias("next_task"), F.slice("turns", 1, overlap).alias("next"))
    earlier = pages.select("session_id", "task", "page_no").join(F.broadcast(heads), "session_id").where("task < next_task")
    last = earlier.groupBy("session_id", "next_task").agg(F.max(F.struct("task", "page_no")).alias("m")).select("session_id", "next_task", "m.*")
    tails = last.join(heads, ["session_id", "next_task"]).select("session_id", "task", "page_no", "next")
    whole = pages.join(F.broadcast(tails), ["session_id", "task", "page_no"], "left").select("session_id", F.concat("turns", F.coalesce("next", F.slice("turns", 1, 0))).alias("turns"))
    return whole.select(F.xxhash64("session_id", "turns.message_hash").alias("fragment_id"), "session_id", "turns")


def _ends(fragments: DataFrame, longest: int) -> DataFrame:
    """session_id, fragment_id, n, heads and tails (the first and last `longest` message hashes): one for each different
    fragment of a session; of equal ones that with the smallest id."""
    h = F.col("turns.message_hash")
    rows = fragments.select(
        "session_id", "fragment_id", F.size("turns").alias("n"), F.xxhash64(h).alias("chain"),
        F.slice(h, 1, longest).alias("heads"), F.expr(f"slice(turns.message_hash, greatest(1, size(turns) - {longest - 1}), {longest})").alias("tails"),
    )
    one = F.min(F.struct("fragment_id", "n", "heads", "tails")).alias("m")
    return rows.where("n > 0").groupBy("session_id", "chain").agg(one).select("session_id", "m.*")


def overlap_graph(nodes: DataFrame, longest: int = OVERLAP_TURNS) -> DataFrame:
    """session_id, src, dst, overlap of nodes (session_id, fragment_id, n, heads, tails): dst begins with the last `overlap`
    message hashes of src (the longest such match, up to `longest`), and both the best continuation of src and the best
    origin of dst are unambiguous. Fragments are compared within their session by hash equality only."""
    upto = lambda most: F.explode(F.sequence(F.lit(1), F.least(most, F.lit(longest)))).alias("len")
    ends = nodes.where("n > 1").select("session_id", F.col("fragment_id").alias("src"), "tails", upto(F.col("n") - 1))
    ends = ends.select("session_id", "src", "len", F.xxhash64(F.expr("slice(tails, size(tails) - len + 1, len)")).alias("key"))
    # A fragment that is wholly its predecessor's overlap still continues it.
    starts = nodes.select("session_id", F.col("fragment_id").alias("dst"), "heads", upto(F.col("n"))).select("session_id", "dst", "len", F.xxhash64(F.expr("slice(heads, 1, len)")).alias("key"))
    hits = ends.join(starts, ["session_id", "len", "key"]).where("src <> dst").groupBy("session_id", "src", "dst").agg(F.max("len").alias("overlap"))
    hits = cut(hits)

    def unambiguous(edges: DataFrame, side: str, other: str) -> DataFrame:
        best = edges.groupBy("session_id", side).agg(F.max(F.struct("overlap", other)).alias("top"))
        second = edges.join(best, ["session_id", side]).where(f"overlap = top.overlap and {other} <> top.{other}").select("session_id", side).distinct()
        return best.join(second, ["session_id", side], "left_anti").select("session_id", side, F.col(f"top.{other}").alias(other), "top.overlap")

    return unambiguous(hits, "src", "dst").join(unambiguous(hits, "dst", "src").drop("overlap"), ["session_id", "src", "dst"])


def merge_paths(nodes: DataFrame, edges: DataFrame, most_nodes: int) -> DataFrame:
    """session_id, fragment_id, path_head, place, first: the path each of the nodes (session_id, fragment_id, n) is on, its
    place there and the number of turns before its own, by pointer doubling, so that a path of n fragments takes log2(n)
    rounds. Fragments on a ring have no head and come out with a null place."""
    back = edges.select("session_id", F.col("dst").alias("fragment_id"), F.col("src").alias("ptr"), F.col("overlap"))
    sizes = nodes.select("session_id", F.col("fragment_id").alias("ptr"), F.col("n").alias("n_before"))
    steps = back.join(sizes, ["session_id", "ptr"]).select("session_id", "fragment_id", "ptr", F.lit(1).alias("dist"), (F.col("n_before") - F.col("overlap")).cast("bigint").alias("first"))
    state = cut(steps)
    for _ in range(max(1, math.ceil(math.log2(max(2, most_nodes))))):
        up = state.select("session_id", F.col("fragment_id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("first").alias("first2"))
        state = cut(state.join(up, ["session_id", "ptr"], "left").select(
            "session_id", "fragment_id", F.coalesce("ptr2", "ptr").alias("ptr"),
            (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), (F.col("first") + F.coalesce("first2", F.lit(0))).alias("first"),
        ))
    inner = edges.select("session_id", F.col("dst").alias("ptr"), F.lit(True).alias("inner"))
    onward = state.join(inner, ["session_id", "ptr"], "left").select("session_id", "fragment_id", F.col("ptr").alias("path_head"), F.when(F.col("inner").isNull(), F.col("dist")).alias("place"), "first")
    begun = nodes.select("session_id", "fragment_id").join(back.select("session_id", "fragment_id"), ["session_id", "fragment_id"], "left_anti")
    return onward.unionByName(begun.select("session_id", "fragment_id", F.col("fragment_id").alias("path_head"), F.lit(0).alias("place"), F.lit(0).cast("bigint").alias("first")))


def _contained(fragments: DataFrame, nodes: DataFrame) -> DataFrame:
    """session_id, fragment_id of the nodes whose message hashes all follow each other in a longer fragment."""
    known = fragments.join(nodes.select("session_id", "fragment_id"), ["session_id", "fragment_id"], "left_semi")
    hashes = known.select("session_id", "fragment_id", F.col("turns.message_hash").alias("h"))
    first = nodes.select("session_id", "fragment_id", "n", F.element_at("heads", 1).alias("key"))
    places = hashes.select("session_id", F.col("fragment_id").alias("outer_id"), F.size("h").alias("outer_n"), F.posexplode("h").alias("pos", "key"))
    # Only places where a shorter fragment may begin and has room meet the hashes themselves.
    hits = first.join(places, ["session_id", "key"]).where("n < outer_n and pos + n <= outer_n").select("session_id", "fragment_id", "outer_id", "pos")
    both = hits.join(hashes, ["session_id", "fragment_id"]).join(hashes.select("session_id", F.col("fragment_id").alias("outer_id"), F.col("h").alias("around")), ["session_id", "outer_id"])
    return both.where(F.expr("slice(around, pos + 1, size(h))") == F.col("h")).select("session_id", "fragment_id").distinct()


def assemble(fragments: DataFrame, longest: int = OVERLAP_TURNS) -> DataFrame:
    """session_id, fragment_id, place, first, own, whole of fragments (fragment_id, session_id, turns): their order along the
    merged path of their session, with how many turns come before a fragment's and how many of its turns the next one
    doesn't repeat. whole is false for every fragment of a session whose fragments don't form exactly one path: one that has
    a gap, a fork or a ring. Equal fragments of a session count once, and one that lies within another adds nothing; a
    fragment without turns or session is none. An empty input gives an empty result."""
    every = cut(_ends(fragments.where(F.col("session_id").isNotNull()), longest))
    several = every.groupBy("session_id").agg(F.count("*").alias("fragments")).where("fragments > 1")
    # A fragment that is alone in its session can neither be continued nor lie within another.
    many = every.join(several.select("session_id"), "session_id", "left_semi")
    within = _contained(fragments, many)
    nodes = cut(every.join(within, ["session_id", "fragment_id"], "left_anti"))
    most = several.agg(F.max("fragments")).first()[0] or 1
    edges = cut(overlap_graph(nodes, longest))
    paths = merge_paths(nodes, edges, most)
    paths = cut(paths.join(nodes.select("session_id", "fragment_id", "n"), ["session_id", "fragment_id"]).join(edges.select("session_id", F.col("src").alias("fragment_id"), "overlap"), ["session_id", "fragment_id"], "left"))
    one = (F.min("path_head") == F.max("path_head")) & (F.count("place") == F.count("*"))
    whole = paths.groupBy("session_id").agg(one.alias("whole"))
    return paths.join(whole, "session_id").select("session_id", "fragment_id", "place", "first", (F.col("n") - F.coalesce("overlap", F.lit(0))).alias("own"), "whole")


def judged(fragments: DataFrame, longest: int = OVERLAP_TURNS) -> tuple[DataFrame, DataFrame]:
    """(verdicts, placed) of export fragments: verdicts has session_id and sound, for each session of some fragment, placed is
    what assemble gives. A session is sound if its fragments form one path without a gap, and the conversation along it begins
    with the user, ends with the assistant and has no two user turns in a row. Neighbours are always together in some
    fragment, since fragments repeat the first turns of the next."""
    placed = cut(assemble(fragments, longest))
    speakers = F.col("turns.speaker")
    two_users = F.array_join(F.transform(speakers, lambda s: F.when(s == "user", "u").otherwise("a")), "").contains("uu")
    shapes = fragments.select("session_id", "fragment_id", two_users.alias("two_users"), F.element_at(speakers, 1).alias("opens"), F.element_at(speakers, -1).alias("closes"))
    spoken = placed.join(shapes, ["session_id", "fragment_id"])
    sound = F.min("whole") & ~F.max("two_users") & (F.min(F.struct(F.coalesce("place", F.lit(0)), "opens"))["opens"] == "user") & (F.max(F.struct(F.coalesce("place", F.lit(0)), "closes"))["closes"] == "assistant")
    return spoken.groupBy("session_id").agg(sound.alias("sound")), placed


def conversations(messages: DataFrame, page: int = PAGE_TURNS, overlap: int = OVERLAP_TURNS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sessions of session_messages, as (verdicts, fragments, placed). verdicts: session_id, kept, one row for each session.
    A session is dropped if a row of it has no created_at or a role that names nobody, if it has no turn, doesn't begin
    with the user, doesn't end with the assistant, has two user turns in a row, or can't be assembled without a gap.
    Rows without session_id belong to none. Ties in time go by id; repeated rows count once. Extra columns are ignored."""
    fragments = cut(export_fragments(turns(messages), page, overlap))
    sound, placed = judged(fragments, overlap)
    flawed = messages.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.max(F.col("created_at").isNull() | role_class(F.col("role")).isNull()).alias("flawed"))
    verdicts = flawed.join(sound, "session_id", "left").select("session_id", (~F.col("flawed") & F.coalesce("sound", F.lit(False))).alias("kept"))
    return verdicts, fragments, placed


def left_out(messages: DataFrame, page: int = PAGE_TURNS) -> DataFrame:
    """session_id of the sessions that conversations() drops."""
    return conversations(messages, page)[0].where(~F.col("kept")).select("session_id")


def conversation_turns(messages: DataFrame, page: int = PAGE_TURNS, overlap: int = OVERLAP_TURNS) -> DataFrame:
    """session_id, turn_no (from 0), speaker, id of every kept session. Numbers come from the merged path, so that no session
    meets in one task as a whole."""
    verdicts, fragments, placed = conversations(messages, page, overlap)
    kept = placed.join(verdicts.where("kept").select("session_id"), "session_id").select("session_id", "fragment_id", "first", "own")
    whole = fragments.join(kept, ["session_id", "fragment_id"])
    each = whole.select("session_id", "first", F.posexplode(F.expr("slice(turns, 1, own)")).alias("i", "t"))
    return each.select("session_id", (F.col("first") + F.col("i")).alias("turn_no"), "t.speaker", "t.id")
