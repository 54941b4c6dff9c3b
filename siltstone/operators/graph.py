"""Operators on directed weighted edges (source, target, relation, weight)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.lineage import cut

#: Relations that tell a cause.
CAUSAL = ("led_to", "caused", "triggered", "caused_by", "resolved_by", "preceded_by")
DECAY, LEAST_WEIGHT = 0.95, 0.05


def edges_of(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Edges that leave a node, reach it or both, heaviest first."""
    out, into = F.col("source") == node, F.col("target") == node
    cond = {"outgoing": out, "incoming": into, "both": out | into}[direction]
    return edges.where(cond).orderBy(F.desc("weight"), "source", "target", "relation")


def explore(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, min_weight: float = 0.0, relation: str | None = None) -> DataFrame:
    """seed, node, depth, score: nodes reached from each seed (column node), breadth first along outgoing edges, heaviest
    first. A node is reached once, by the earliest parent, and its score is the product of weights along that path, which
    needn't be the best path. A level is one join; what was reached is cut from the lineage each time."""
    usable = edges.where((F.col("weight") >= min_weight) & (F.lit(True) if relation is None else F.col("relation") == relation))
    usable = cut(usable.groupBy("source", "target").agg(F.max("weight").alias("weight")))
    start = seeds.select(F.col("node").alias("seed"), "node").distinct()
    none = F.expr("cast(array() as array<struct<w:double,node:string>>)")
    front = start.withColumns({"depth": F.lit(0), "score": F.lit(1.0), "order": none})
    reached = cut(front)
    front = reached
    for depth in range(1, min(max_depth, 10) + 1):
        # A node's order is that of its parent, then its weight and name: arrays compare as a rank over the level would.
        step = front.join(usable.withColumnRenamed("source", "node"), "node")
        step = step.select("seed", F.col("target").alias("node"), (F.col("score") * F.col("weight")).alias("score"), F.concat("order", F.array(F.struct((-F.col("weight")).alias("w"), F.col("target").cast("string").alias("node")))).alias("order"))
        step = step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
        front = step.groupBy("seed", "node").agg(F.min(F.struct("order", "score")).alias("m")).select("seed", "node", F.lit(depth).alias("depth"), "m.score", "m.order")
        front = cut(front)
        if front.isEmpty():
            break
        reached = cut(reached.unionByName(front))
    return reached.where("depth > 0").select("seed", "node", "depth", "score")


def causal_chain(edges: DataFrame, starts: DataFrame, hops: int = 5, reverse: bool = False) -> DataFrame:
    """start, hop, node, score: for each start (column node) the chain that takes at each hop the heaviest causal edge to a
    node it hasn't met, with the product of the weights; of equal weights the smallest node counts. A chain ends where every
    causal edge leads back to itself. A start without a causal edge has no row."""
    rows = edges.where(F.col("relation").isin(*CAUSAL)).select(F.col("target" if reverse else "source").alias("at"), F.col("source" if reverse else "target").alias("next"), "weight")
    usable = cut(rows.groupBy("at", "next").agg(F.max("weight").alias("weight")))
    state = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"), F.lit(1.0).alias("score")).distinct()
    out = None
    for hop in range(1, hops + 1):
        # The choice is a combining aggregate: of a start's edges only the best so far leaves a task.
        onward = state.join(usable, "at").where(~F.array_contains("path", F.col("next")))
        best = onward.groupBy("start").agg(F.min(F.struct((-F.col("weight")).alias("w"), "next", "path", "score")).alias("e"))
        state = cut(best.select("start", F.col("e.next").alias("at"), F.concat("e.path", F.array("e.next")).alias("path"), (F.col("e.score") * -F.col("e.w")).alias("score")))
        each = state.select("start", F.lit(hop).alias("hop"), F.col("at").alias("node"), "score")
        out = each if out is None else out.unionByName(each)
    return out


def edge_decay(edges: DataFrame) -> DataFrame:
    """Edges after one round of decay, without those that became too light."""
    return edges.withColumn("weight", F.col("weight") * DECAY).where(F.col("weight") >= LEAST_WEIGHT)


def transfer_edges(edges: DataFrame, replaced: DataFrame) -> DataFrame:
    """Edges of superseded items (old_id, new_id) moved to what replaced them; edges that fall together are merged, and
    those between an item and what replaced it go."""
    to = replaced.groupBy("old_id").agg(F.max("new_id").alias("new_id"))
    out = edges
    for side in ("source", "target"):
        out = out.join(to.select(F.col("old_id").alias(side), F.col("new_id").alias("__new")), side, "left").withColumn(side, F.coalesce("__new", side)).drop("__new")
    return out.where("source <> target").groupBy("source", "target", "relation").agg(F.max("weight").alias("weight"), F.sum("usage_count").alias("usage_count"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node is connected with, by alternating star contractions; the number of
    rounds grows with the log of the longest path, and no node's neighbours are gathered."""
    links = cut(edges.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).where("u <> v").distinct())
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        if new.count() == links.count() and new.exceptAll(links).isEmpty():
            break
        links = new
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def propagate(pairs: list[tuple[str, str, float]], rounds: int = 20) -> dict[str, int]:
    """Labels of nodes by asynchronous label propagation in the order of their names: a node takes the label with the most
    weight among its neighbours, of equals the smallest."""
    near: dict[str, dict[str, float]] = {}
    for a, b, w in pairs:
        near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + w
        near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0.0) + w
    names = sorted(near)
    label = {n: i for i, n in enumerate(names)}
    for _ in range(rounds):
        changed = False
        for n in names:
            weight: dict[int, float] = {}
            for m, w in near[n].items():
                weight[label[m]] = weight.get(label[m], 0.0) + w
            best = min(weight, key=lambda x: (-weight[x], x))
            changed |= best != label[n]
            label[n] = best
        if not changed:
            break
    return label


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node, cluster: the order-dependent labels, exactly. What isn't connected can't exchange labels, so each connected
    component is labelled on its own, and its cluster is named by its smallest member. A component must fit one task; for
    graphs with a giant component use synchronous_labels."""
    comp = cut(components(edges))
    rows = edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("w")).where("a <> b")
    rows = rows.join(comp.withColumnRenamed("node", "a"), "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label = propagate(list(pdf[["a", "b", "w"]].sort_values(["a", "b"]).itertuples(index=False, name=None)), rounds)
        first: dict[int, str] = {}
        for n in sorted(label):
            first.setdefault(label[n], n)
        return pd.DataFrame({"node": list(label), "cluster": [first[v] for v in label.values()]})

    return rows.groupBy("component").applyInPandas(run, "node string, cluster string")


def synchronous_labels(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node, cluster: all nodes take their new label at once; the scalable kind of label propagation, with other results."""
    pairs = edges.select("source", "target", "weight").where("source <> target")
    both = cut(pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")).groupBy("source", "target").agg(F.sum("weight").alias("weight")))
    labels = cut(both.select(F.col("source").alias("node"), F.col("source").alias("cluster")).distinct())
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "target"), "target").groupBy(F.col("source").alias("node"), "cluster").agg(F.sum("weight").alias("w"))
        new = cut(votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "cluster")).alias("m")).select("node", F.col("m.cluster").alias("cluster")))
        if new.exceptAll(labels).isEmpty():
            break
        labels = new
    return labels


def cluster_groups(labels: DataFrame) -> DataFrame:
    """cluster, members, size: members in order, largest cluster first. Clusters are named by a member, so none is lost."""
    return labels.groupBy("cluster").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count("*").alias("size")).orderBy(F.desc("size"), "cluster")


def evolution_chain(rows: DataFrame, most: int = 50) -> DataFrame:
    """root, id, version: the chain from each record that replaces none through superseded_by, at most `most` versions; of
    two records replaced by the same one, both lead to it. A ring has no root and gives nothing."""
    link = rows.where("superseded_by is not null and superseded_by <> id").groupBy("id").agg(F.max("superseded_by").alias("next"))
    link = cut(link)
    state = rows.select("id").distinct().join(link.select(F.col("next").alias("id")).distinct(), "id", "left_anti").join(link.select("id"), "id", "left_semi").select(F.col("id").alias("root"), "id", F.lit(1).alias("version"))
    out = state = cut(state)
    for version in range(2, most + 1):
        state = cut(state.join(link, "id").select("root", F.col("next").alias("id"), F.lit(version).alias("version")))
        if state.isEmpty():
            break
        out = out.unionByName(state)
    return out


def leaves_of(tree: DataFrame, most_levels: int = 10) -> DataFrame:
    """node, leaf: the leaves under each node of a tree (id, parent_id); a leaf is its own."""
    inner = tree.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    leaves = tree.select("id").join(inner, "id", "left_anti").select(F.col("id").alias("node"), F.col("id").alias("leaf"))
    up = tree.where("parent_id is not null").select(F.col("id").alias("node"), "parent_id")
    out = level = leaves
    for _ in range(most_levels):
        level = cut(level.join(up, "node").select(F.col("parent_id").alias("node"), "leaf"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def session_edges(items: DataFrame, session: str) -> DataFrame:
    """Edges from items to the session that produced them."""
    return items.where(F.col(session).isNotNull()).select(F.col("id").alias("source"), F.col(session).alias("target"), F.lit("produced_by").alias("relation"), F.lit(1.0).alias("weight"))
