"""Packing of sections into a context of a limited size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET_BYTES = 32_000


def pack_sections(sections: DataFrame, by: str, budget: int = BUDGET_BYTES, partial: bool = False) -> DataFrame:
    """by, section, used: of each context's sections (by, priority, section, bytes), in the order of priority, those that
    still fit; one that doesn't is skipped, and smaller ones after it may fit. With partial, the first that doesn't fit gets
    what is left, and nothing comes after it. A context has few sections, so each is folded in one row."""
    held = sections.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("priority", "section", F.col("bytes").cast("bigint").alias("bytes")))).alias("s"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.expr("cast(array() as array<struct<section:string,used:bigint>>)").alias("took"), F.lit(False).alias("full"))

    def step(acc, s):
        room = F.lit(budget).cast("bigint") - acc["used"]
        amount = F.when(acc["full"], 0).when(s["bytes"] <= room, s["bytes"]).otherwise(F.when(F.lit(partial), room).otherwise(0)).cast("bigint")
        took = F.when(amount > 0, F.concat(acc["took"], F.array(F.struct(s["section"].alias("section"), amount.alias("used"))))).otherwise(acc["took"])
        return F.struct((acc["used"] + amount).alias("used"), took.alias("took"), (acc["full"] | (F.lit(partial) & (s["bytes"] > room))).alias("full"))

    return held.select(by, F.explode(F.aggregate("s", start, step, lambda a: a["took"])).alias("t")).select(by, "t.section", "t.used")


def optimize(rows: DataFrame, key: str, text: str, most_bytes: int) -> DataFrame:
    """key, text, bytes_before, bytes_after, saved: white space cleaned up, then cut to the size at a whole character."""
    from siltstone.functions.scores import savings_percent
    from siltstone.functions.text import cleanup_whitespace, truncate_bytes

    clean = cleanup_whitespace(F.col(text))
    cut = F.when(F.octet_length(clean) > most_bytes, F.concat(truncate_bytes(clean, most_bytes), F.lit("\n[truncated]"))).otherwise(clean)
    out = rows.where(F.col(text).isNotNull()).select(key, F.octet_length(text).cast("bigint").alias("bytes_before"), cut.alias("text"))
    out = out.withColumn("bytes_after", F.octet_length("text").cast("bigint"))
    return out.withColumn("saved", savings_percent(F.col("bytes_before"), F.col("bytes_after")))


#: Sections of a session's context in their order, with their headers and how many lines each may have.
SECTIONS = {
    "core_memories": ("CORE MEMORIES", 50), "global_memories": ("GLOBAL MEMORIES", 50), "unresolved_episodes": ("UNRESOLVED ISSUES", 10), "errored_sessions": ("RECENT ERRORS", 5),
    "project_patterns": ("PROJECT PATTERNS", 10), "proven_procedures": ("PROVEN PROCEDURES", 10), "global_patterns": ("GLOBAL PATTERNS", 5), "reflections": ("RECENT REFLECTIONS", 3),
    "recent_sessions": ("RECENT SESSIONS", 5), "code_snippets": ("CODE SNIPPETS", 5), "review_due": ("REVIEW DUE", 5),
}
#: Headings of a guide in their order.
GUIDE = ("Critical Rules", "Project Info", "Conventions", "Preferences", "Cross-Project Knowledge", "Active Issues", "Key Procedures", "Knowledge Health", "Usage")


def session_context(lines: DataFrame, projects: DataFrame, budget: int = BUDGET_BYTES) -> DataFrame:
    """project_id, section, priority, text, entity_ids of the sections that fit, in their order, for each project (column id).
    lines: project_id (null for those of all projects), section, place, line, entity_id; the first lines of a section count, by
    place. A section that doesn't fit is left out as a whole, and smaller ones after it may fit."""
    from pyspark.sql import Window

    named = F.create_map(*(F.lit(x) for s, (header, _) in SECTIONS.items() for x in (s, header)))
    order = F.create_map(*(x for n, s in enumerate(SECTIONS) for x in (F.lit(s), F.lit(n))))
    most = F.create_map(*(x for s, (_, m) in SECTIONS.items() for x in (F.lit(s), F.lit(m))))
    ids = projects.select(F.col("id").alias("project_id")).distinct()
    w = Window.partitionBy("project_id", "section").orderBy("place", "entity_id")
    first = lines.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most[F.col("section")])
    # Lines of all projects are few: at most what the sections allow.
    own = first.where("project_id is not null").join(ids, "project_id", "left_semi")
    every = first.where("project_id is null").drop("project_id").join(F.broadcast(ids))
    held = F.array_sort(F.collect_list(F.struct("n", "line", "entity_id")))
    whole = own.select("project_id", "section", "n", "line", "entity_id").unionByName(every.select("project_id", "section", "n", "line", "entity_id"))
    rows = whole.groupBy("project_id", "section").agg(held.alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    rows = rows.select("project_id", "section", order[F.col("section")].alias("priority"), F.concat(F.lit("\n=== "), named[F.col("section")], F.lit(" ===\n"), body, F.lit("\n")).alias("text"), F.transform("l", lambda x: x["entity_id"]).alias("entity_ids"))
    kept = pack_sections(rows.withColumn("bytes", F.octet_length("text")), "project_id", budget).select("project_id", "section")
    return rows.join(kept, ["project_id", "section"])


def guide(sections: DataFrame, title: str, most_bytes: int) -> DataFrame:
    """project_id, text: a guide of each project from its sections (project_id, heading, body) in the order of GUIDE, after a
    title. The first section that doesn't fit is cut at a whole character if more than 80 bytes are left for it, and ends the
    guide."""
    from siltstone.functions.text import truncate_bytes

    place = F.create_map(*(x for n, h in enumerate(GUIDE) for x in (F.lit(h), F.lit(n))))
    held = F.array_sort(F.collect_list(F.struct(place[F.col("heading")].alias("p"), "heading", "body")))
    rows = sections.where(F.coalesce(F.length("body"), F.lit(0)) > 0).groupBy("project_id").agg(held.alias("s"))
    start = F.struct(F.lit(f"# {title}\n").alias("text"), F.lit(False).alias("full"))

    def step(acc, s):
        head = F.concat(F.lit("\n## "), s["heading"], F.lit("\n\n"))
        block = F.concat(head, s["body"], F.lit("\n"))
        used = F.octet_length(acc["text"])
        fits = used + F.octet_length(block) <= most_bytes
        room = F.lit(most_bytes) - used - F.octet_length(head) - 10
        part = _prefix_bytes(s["body"], room)
        tail = F.when(F.lit(most_bytes) - used - 20 > 80, F.concat(head, part, F.lit("\n...\n"))).otherwise("")
        return F.struct(F.when(acc["full"], acc["text"]).when(fits, F.concat(acc["text"], block)).otherwise(F.concat(acc["text"], tail)).alias("text"), (acc["full"] | ~fits).alias("full"))

    return rows.select("project_id", F.aggregate("s", start, step, lambda a: a["text"]).alias("text"))


def _prefix_bytes(text, limit):
    """The longest prefix of at most `limit` bytes (a column) that ends with a whole character."""
    raw = F.encode(text, "UTF-8")
    out = F.lit("")
    for back in range(3, -1, -1):
        part = F.substring(raw, F.lit(1), limit - back).cast("string")
        out = F.when(F.is_valid_utf8(part), part).otherwise(out)
    return F.when(F.octet_length(text) <= limit, text).otherwise(out)
