"""Writes of single tables: new records, commits, resolutions, memories, sessions, work units, weights, rules and the audit log.
Each gives the table's new state, or the rows to append; where rows meet, they meet by key in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a record gets that doesn't say it, by type.
DEFAULTS = {"knowledge_item": {"kind": "artifact"}, "episode": {"kind": "discovery", "resolved": False}, "procedure": {}, "reflection": {"kind": "session_end"}}
SEVERITIES = ("critical", "high", "medium", "low")


def _at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def inserted(rows: DataFrame, new: DataFrame, entity_type: str, as_of: str, most: int | None = None) -> DataFrame:
    """rows with the new records added: an id of their own where they have none (drawn from their values, so that equal records
    of one moment are one), defaults where a value is null, and the time. With `most`, a larger batch is refused."""
    if most is not None and new.count() > most:
        raise ValueError(f"more than {most} records at once")
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in new.columns if not isinstance(new.schema[c].dataType.jsonValue(), dict)]
    own = F.left(F.sha2(F.concat_ws("\x1f", F.lit(as_of), *values), 256), F.lit(26))
    out = new.withColumn("id", F.coalesce("id", own) if "id" in new.columns else own).dropDuplicates(["id"])
    for name, value in DEFAULTS[entity_type].items():
        if name in rows.columns:
            out = out.withColumn(name, F.coalesce(name, F.lit(value)) if name in out.columns else F.lit(value))
    stamps = {c: _at(as_of) for c in ("created_at", "updated_at") if c in rows.columns and c not in out.columns}
    return rows.unionByName(out.withColumns({**stamps, **({"needs_embedding": F.lit(True)} if "needs_embedding" in rows.columns else {})}), allowMissingColumns=True).select(*rows.columns)


def commit_rows(commits: DataFrame, as_of: str) -> DataFrame:
    """One row for each commit and file of commits (project_id, commit_hash, commit_message, files: array of file_path,
    change_type, lines_added, lines_removed); missing line counts are 0. A commit recorded twice has its rows twice."""
    each = commits.select("project_id", "commit_hash", "commit_message", F.explode("files").alias("f"))
    zero = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(0)).alias(c)
    return each.select("project_id", "commit_hash", "commit_message", "f.file_path", "f.change_type", zero("lines_added"), zero("lines_removed"), _at(as_of).alias("created_at"))


def set_where(rows: DataFrame, ids: DataFrame, values: dict[str, Column], key: str = "id") -> DataFrame:
    """rows with values set where the key is listed; ids that aren't there change nothing."""
    hit = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    out = rows.join(hit, key, "left")
    return out.withColumns({c: F.when(F.col("__hit").isNotNull(), v).otherwise(F.col(c)) for c, v in values.items()}).select(*rows.columns)


def resolve_episodes(episodes: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    return set_where(episodes, ids, {"resolved": F.lit(True), "updated_at": _at(as_of)})


def merge_memories(state: DataFrame, changes: DataFrame) -> DataFrame:
    """state after changes (id, value, confidence): a value that isn't given stays, and each change confirms the memory."""
    new = changes.groupBy("id").agg(F.max("value").alias("__value"), F.max("confidence").alias("__confidence"), F.count("*").alias("__n"))
    out = state.join(new, "id", "left")
    kept = {"value": F.coalesce("__value", "value"), "confidence": F.coalesce("__confidence", "confidence"), "confirmations": F.col("confirmations") + F.coalesce("__n", F.lit(0))}
    return out.withColumns(kept).select(*state.columns)


def record_contradictions(state: DataFrame, events: DataFrame) -> DataFrame:
    """state with a contradiction more for each event (id)."""
    n = events.groupBy("id").agg(F.count("*").alias("__n"))
    return state.join(n, "id", "left").withColumn("contradictions", F.col("contradictions") + F.coalesce("__n", F.lit(0))).select(*state.columns)


def ensure_sessions(sessions: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """sessions (id, status, created_at) with those of incoming (id) that weren't there, as active ones."""
    new = incoming.select("id").where("id is not null").distinct().join(sessions.select("id"), "id", "left_anti")
    return sessions.unionByName(new.withColumns({"status": F.lit("active"), "created_at": _at(as_of)}), allowMissingColumns=True)


def transcript_texts(messages: DataFrame) -> DataFrame:
    """session_id, transcript_text: the contents of each session in order, a line each, for a search over sessions. A session's
    text is one row by definition; the caller bounds what it hands in."""
    held = F.array_sort(F.collect_list(F.struct("created_at", "id", "content")))
    rows = messages.where("session_id is not null and content is not null").groupBy("session_id").agg(held.alias("m"))
    return rows.select("session_id", F.array_join(F.transform("m", lambda x: x["content"]), "\n").alias("transcript_text"))


def work_unit_status(units: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """units after changes (id, status), of several for a unit the last by name; a completed one gets its time."""
    new = changes.groupBy("id").agg(F.max("status").alias("__status"))
    out = units.join(new, "id", "left").withColumn("status", F.coalesce("__status", "status"))
    done = F.col("__status") == "completed"
    stamps = {"completed_at": F.when(done, _at(as_of)).otherwise(F.col("completed_at")), "updated_at": F.when(F.col("__status").isNotNull(), _at(as_of)).otherwise(F.col("updated_at"))}
    return out.withColumns(stamps).select(*units.columns)


def link_sessions(sessions: DataFrame, links: DataFrame) -> DataFrame:
    """sessions with the work unit of links (id, work_unit_id); a session that isn't linked keeps its own."""
    new = links.groupBy("id").agg(F.max("work_unit_id").alias("__unit"))
    return sessions.join(new, "id", "left").withColumn("work_unit_id", F.coalesce("__unit", "work_unit_id")).select(*sessions.columns)


def upsert_weights(state: DataFrame, learned: DataFrame) -> DataFrame:
    """query_type, signal, weight, samples: learned rows replace those of the same type and signal."""
    old = state.join(learned.select("query_type", "signal"), ["query_type", "signal"], "left_anti")
    return old.unionByName(learned.select(*state.columns))


def merge_error_groups(state: DataFrame, seen: DataFrame) -> DataFrame:
    """state after groups (fingerprint, title, target, event_count, first_seen, last_seen) were seen: counts add up, and a
    resolved group that is seen again is open."""
    new = seen.select("fingerprint", *(F.col(c).alias(f"__{c}") for c in ("title", "target", "event_count", "first_seen", "last_seen")))
    out = state.join(new, "fingerprint", "full")
    again = F.col("__event_count").isNotNull()
    return out.select(
        "fingerprint", F.coalesce("title", "__title").alias("title"), F.coalesce("target", "__target").alias("target"),
        (F.coalesce("event_count", F.lit(0)) + F.coalesce("__event_count", F.lit(0))).alias("event_count"),
        F.least("first_seen", "__first_seen").alias("first_seen"), F.greatest("last_seen", "__last_seen").alias("last_seen"),
        F.when(again, F.lit("open")).otherwise(F.col("status")).alias("status"),
    )


def audited(log: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """log with events (actor, action, entity_type, entity_id) added at a time."""
    return log.unionByName(events.withColumn("created_at", _at(as_of)), allowMissingColumns=True)


def by_severity(episodes: DataFrame) -> DataFrame:
    """Episodes from critical to low, those without a known severity last; of equal ones the newest first."""
    place = F.coalesce(*(F.when(F.col("severity") == s, F.lit(n)) for n, s in enumerate(SEVERITIES)), F.lit(len(SEVERITIES)))
    return episodes.orderBy(place, F.desc_nulls_last("created_at"), "id")


def edges_of_items(edges: DataFrame, items: DataFrame, project: str | None = None) -> DataFrame:
    """edges that leave an item (id, project_id), of a project where one is given."""
    own = items if project is None else items.where(F.col("project_id") == project)
    return edges.join(own.select(F.col("id").alias("source")).distinct(), "source", "left_semi")


def search_metrics(searches: DataFrame, milliseconds: str) -> DataFrame:
    """One row: searches, avg_ms (whole, rounded down) and max_ms; 0 without searches."""
    total = searches.agg(F.count("*").alias("searches"), F.coalesce(F.sum(milliseconds), F.lit(0)).alias("t"), F.coalesce(F.max(milliseconds), F.lit(0)).alias("max_ms"))
    return total.select("searches", F.expr("case when searches > 0 then cast(t as bigint) div searches else 0 end").alias("avg_ms"), "max_ms")
