"""Consolidating pairwise matches into groups.

Minimum labels travel along edges, pointer jumping flattens the resulting trees, and the graph is then contracted to
its roots: every round writes its tables to the shared folder, and rounds end when no edge joins two roots, which is
when no label would change. Later rounds see only the roots that still have edges, so a long chain costs a few rounds
on shrinking tables, not one round per link; ids that point at a root take no part in further jumps.

Hot keys: an id that most edges or labels name is found by a sketch, taken while its table is written, and its rows meet
a broadcast of the few hot ids' labels (:func:`claimlake.operators.skew.join_by_key`); the others take the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimlake.operators.skew import heavy_of, join_by_key, sketch
from claimlake.plans.scratch import Scratch

#: An id is hot where at least so many rows name it; fewer do not hold up a task. Only the plan depends on it.
HOT_ROWS = 100_000


def match_edges(relations: DataFrame, kind: str) -> DataFrame:
    """Distinct undirected edges ``(a, b)``, ``a <= b``, of relations of one kind.

    Case and outer blanks of ``relation`` do not count. A row lacking a side (null or blank) joins nothing. Repeated
    rows and pairs in both orders fall together.
    """
    wanted = relations.where(F.lower(F.trim("relation")) == kind)
    for side in ("left_id", "right_id"):
        wanted = wanted.where(F.length(F.trim(side)) > 0)
    return wanted.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).distinct()


def _hot(seen: list | None, n: int) -> list:
    return heavy_of([x for x in seen or [] if x["count"] >= HOT_ROWS], n)


def _live(scratch: Scratch, rows: DataFrame) -> tuple[str, DataFrame, int, int, list]:
    """Write ``rows(id, parent, rooted)``: path, frame, rows, those that are not rooted, and the hot parents of these."""
    waiting = F.when(~F.col("rooted"), F.col("parent"))
    path, rows, seen = scratch.write_observing(rows, n=F.count("*"), left=F.count_if(~F.col("rooted")), hot=sketch(waiting))
    return path, rows, seen["n"], seen["left"], _hot(seen["hot"], seen["left"])


def _flatten(scratch: Scratch, parents: DataFrame) -> tuple[list[str], DataFrame, int]:
    """Pointer jumping: replace each parent by its parent until all point at roots. ``parents(id, parent)``.

    Returns the paths written, the flat rows and their number.
    An id whose parent is known to point at a root, or to be one, is rooted by the jump and rests from then on.
    """
    path, rows, n, left, hot = _live(scratch, parents.withColumn("rooted", F.col("id") == F.col("parent")))
    paths = [path]
    while left:
        up = rows.select(F.col("id").alias("parent"), F.col("parent").alias("grand"), F.col("rooted").alias("known"))
        jumped = join_by_key(rows.where(~F.col("rooted")).select("id", "parent"), up, "parent", hot, "inner")
        path, jumped, _, left, hot = _live(scratch, jumped.select("id", F.col("grand").alias("parent"), F.col("known").alias("rooted")))
        paths.append(path)
        rows = rows.where("rooted").unionByName(jumped)
    return paths, rows.select("id", "parent"), n


def connected_groups(edges: DataFrame) -> DataFrame:
    """``(id, group_id)`` for every id on an edge ``(a, b)``; ``group_id`` is the smallest id of its component.

    * An id that is only matched with itself forms its own group.
    * Ids of any orderable type; null ids must not occur (:func:`match_edges` drops them). Other columns are ignored.
    * No edges: an empty result.

    Skew: a hub's edges are first reduced by ``min`` with partial aggregation; joins to labels, which are unique per id,
    split off hot ids. No neighbour list is ever gathered. All rounds run while the plan is built.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    ends_of = {"n": F.count("*"), "a": sketch(F.col("a")), "b": sketch(F.col("b"))}
    graph_path, graph, seen = scratch.write_observing(edges.select("a", "b"), **ends_of)
    # layers: (id, parent) maps of the rounds; each maps the roots of the round before
    layers = []
    while True:
        ends = graph.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near")), F.struct(F.col("b").alias("id"), F.col("a").alias("near")))).alias("e")).select("e.*")
        smallest = ends.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("parent"))
        paths, parents, n = _flatten(scratch, smallest)
        layers.append((paths, parents, n))
        left = parents.select(F.col("id").alias("a"), F.col("parent").alias("ra"))
        right = parents.select(F.col("id").alias("b"), F.col("parent").alias("rb"))
        hot_a, hot_b = (_hot(seen[k], seen["n"]) for k in ("a", "b"))
        halved = join_by_key(graph.where("a != b"), left, "a", hot_a, "inner").select("b", "ra").distinct()
        contracted = join_by_key(halved, right, "b", hot_b, "inner").where("ra != rb")
        contracted = contracted.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        new_path, graph, seen = scratch.write_observing(contracted, **ends_of)
        scratch.drop(graph_path)
        graph_path = new_path
        if not seen["n"]:
            break
    scratch.drop(graph_path)
    # from the last round back: the roots of round k get their final root from round k + 1, where they had edges
    groups = layers[-1][1]
    for _, parents, n in reversed(layers[:-1]):
        final = groups.select(F.col("id").alias("parent"), F.col("parent").alias("root"))
        told = parents.agg(sketch(F.col("parent")).alias("hot")).first()["hot"] if n >= HOT_ROWS else []
        groups = join_by_key(parents, final, "parent", _hot(told, n)).select("id", F.coalesce("root", "parent").alias("parent"))
    _, groups = scratch.write(groups.withColumnRenamed("parent", "group_id"))
    scratch.drop(*(p for paths, *_ in layers for p in paths))
    return groups


def consolidate(relations: DataFrame, kind: str = "corroborates") -> DataFrame:
    """``(fact_id, group_id)`` of every id in a usable relation of ``kind``; see :func:`connected_groups`."""
    return connected_groups(match_edges(relations, kind)).withColumnRenamed("id", "fact_id")
