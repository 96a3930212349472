"""Graph operators over edge tables (src, dst)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discarded, stored


def endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind): start nodes have no incoming edge, end nodes no outgoing one; without any, the smallest or the largest
    id is taken."""
    start = nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit("start").alias("kind"))
    end = nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit("end").alias("kind"))
    bounds = nodes.agg(F.min("id").alias("start"), F.max("id").alias("end"))
    n = start.unionByName(end).agg(F.count_if(F.col("kind") == "start").alias("starts"), F.count_if(F.col("kind") == "end").alias("ends"))
    spare = bounds.crossJoin(n)  # one row each
    spare = [spare.where(f"{k}s = 0 and {k} is not null").select(F.col(k).alias("id"), F.lit(k).alias("kind")) for k in ("start", "end")]
    return start.unionByName(end).unionByName(spare[0]).unionByName(spare[1])


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    lost = [edges.join(nodes.select(F.col("id").alias(c)), c, "left_anti") for c in ("src", "dst")]
    return lost[0].unionByName(lost[1], allowMissingColumns=True).distinct()


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have both a way in and a way out, taken to the point where that holds for all left:
    cycles of any length and what lies between them."""
    now = stored(edges.select("src", "dst").distinct(), "edges")
    n = now.count()
    while n:
        step = now
        for _ in range(3):  # so many layers between two tables
            both = step.select(F.col("src").alias("id")).intersect(step.select(F.col("dst").alias("id")))
            step = step.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi")
        old, now = now, stored(step, "edges")
        discarded(old)
        before, n = n, now.count()
        if n == before:
            break
    return now


def _spread(edges: DataFrame, marks: DataFrame, within: str | None = None) -> DataFrame:
    """(id, mark) after the largest marks have gone along the edges as far as they do; with ``within``, a column of marks,
    only to nodes of an equal value of it."""
    now = stored(marks, "marks")
    state = now.agg(F.sum(F.xxhash64("id", "mark").cast("decimal(38,0)"))).first()[0]
    while state is not None:
        held = now.select(F.col("id").alias("src"), "mark", *([F.col(within).alias("from_color")] if within else []))
        sent = edges.join(held, "src").where("mark is not null")
        keep = [within] if within else []
        to = now.select("id", *keep)
        arrived = sent.join(to, sent["dst"] == to["id"])
        if within:
            arrived = arrived.where(F.col("from_color") == F.col(within))
        arrived = arrived.groupBy("id").agg(F.max("mark").alias("new"))
        after = stored(now.join(arrived, "id", "left").select("id", F.greatest("mark", "new").alias("mark"), *keep), "marks")
        changed = after.agg(F.sum(F.xxhash64("id", "mark").cast("decimal(38,0)"))).first()[0]
        discarded(now)
        now = after
        if changed == state:
            break
        state = changed
    return now


#: Edges of a graph that one task solves; larger ones go in rounds over tables.
SMALL = 100_000


def _strong(edges: list[tuple]) -> dict:
    """Node -> largest node of its strongly connected component, for nodes on cycles: depth-first, with a stack of ours."""
    out: dict = {}
    for u, v in edges:
        out.setdefault(u, []).append(v)
        out.setdefault(v, [])
    order, low, held, on, found = {}, {}, [], {}, {}
    for root in out:
        todo = [] if root in order else [(root, iter(out[root]))]
        while todo:
            u, rest = todo[-1]
            if u not in order:
                order[u] = low[u] = len(order)
                on[u] = len(held)
                held.append(u)
            v = next(rest, None)
            if v is not None:
                if v not in order:
                    todo.append((v, iter(out[v])))
                elif v in on:
                    low[u] = min(low[u], order[v])
                continue
            todo.pop()
            if todo:
                low[todo[-1][0]] = min(low[todo[-1][0]], low[u])
            if low[u] == order[u]:
                part = held[on[u] :]
                del held[on[u] :]
                for x in part:
                    del on[x]
                if len(part) > 1 or u in out[u]:
                    found.update(dict.fromkeys(part, max(part)))
    return found


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [pair for b in batches for pair in zip(b["src"].tolist(), b["dst"].tolist(), strict=True)]
        found = _strong(rows)
        yield pd.DataFrame({"id": list(found), "cycle": list(found.values())})

    return edges.select("src", "dst").coalesce(1).mapInPandas(run, f"id {kind}, cycle {kind}")


def _single(pairs: DataFrame, by: str) -> bool:
    """Whether no two of the distinct edges share an end."""
    return pairs.groupBy(by).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _orbits(pairs: DataFrame) -> DataFrame:
    """(id, cycle) of the nodes on cycles where each node has one way out at most, in as many rounds as the logarithm of the
    longest path.

    jump is the node that 2 ** round steps lead to, mark the largest node among those passed. Nodes that no jump of the others
    reaches are on no cycle and go, as do those whose path ends; where all stay, the jumps permute the nodes, so all are on
    cycles, and marks that don't grow any more have gone all the way round. Once SMALL nodes are left, they are one task's work.
    """
    now = stored(pairs.select(F.col("src").alias("id"), F.col("dst").alias("step"), F.col("dst").alias("jump"), F.col("src").alias("mark"), F.lit(True).alias("grown")), "jumps")
    n = now.count()
    while n > SMALL:
        to = now.select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("mark").alias("more"))
        both = stored(now.join(to, "jump").select("id", "step", F.col("far").alias("jump"), F.greatest("mark", "more").alias("mark"), (F.col("more") > F.col("mark")).alias("grown")), "jumps")
        after = stored(both.join(both.select(F.col("jump").alias("id")).distinct(), "id", "left_semi"), "jumps")
        discarded(now, both)
        before, now = n, after
        n, grown = now.agg(F.count("*"), F.count_if("grown")).first()
        if n == before and not grown:
            return now.select("id", F.col("mark").alias("cycle"))
    return _in_one_task(now.select(F.col("id").alias("src"), F.col("step").alias("dst")))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(id, cycle) of the nodes that reach themselves, whatever the length; cycle is the largest id of the strongly
    connected component. A graph of up to SMALL edges, which are counted, is one task's work, and so is what rounds leave.

    A larger one whose nodes have one way out at most, or one way in, goes by jumps that double. In any other, ends are
    trimmed away; then colours go forward (each node's largest ancestor) and, within a colour, backward from the
    node that gave it: what is reached is one component. The rest goes another round. Every round is a written table.
    """
    found = None
    pairs = edges.select("src", F.col("dst").cast(edges.schema["src"].dataType).alias("dst")).where("src is not null and dst is not null").distinct()
    pairs = stored(pairs, "pairs")  # the edges are made once
    if pairs.count() <= SMALL:
        return _in_one_task(pairs)
    if _single(pairs, "src"):
        return _orbits(pairs)
    if _single(pairs, "dst"):
        return _orbits(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    left = trimmed(pairs)
    while not left.isEmpty():
        if left.count() <= SMALL:
            last = _in_one_task(left)
            return last if found is None else found.unionByName(last)
        nodes = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
        color = _spread(left, nodes.select("id", F.col("id").alias("mark"))).select("id", F.col("mark").alias("color"))
        back = left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reached = _spread(back, color.select("id", F.when(F.col("id") == F.col("color"), F.col("color")).alias("mark"), "color"), "color")
        part = stored(reached.where("mark is not null").select("id", F.col("color").alias("cycle")), "parts")
        inner = left.join(part.select(F.col("id").alias("src"), F.col("cycle").alias("a")), "src").join(part.select(F.col("id").alias("dst"), F.col("cycle").alias("b")), "dst").where("a = b")
        real = stored(part.join(inner.select(F.col("a").alias("cycle")).distinct(), "cycle", "left_semi").select("id", "cycle"), "cycles")
        found = real if found is None else found.unionByName(real)
        done = part.select("id")
        left = trimmed(left.join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(done.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    return edges.sparkSession.createDataFrame([], edges.select(F.col("src").alias("id"), F.col("src").alias("cycle")).schema) if found is None else found


def illegal_cycles(edges: DataFrame) -> DataFrame:
    """The nodes on cycles where no edge of the whole table is a feedback one; with any such edge all cycles are legal.
    edges: (src, dst, type)."""
    if not edges.where(F.col("type").isin("feedback", "feedback_flow")).isEmpty():
        return on_cycles(edges.limit(0))
    return on_cycles(edges)


def neighbours(refs: DataFrame) -> DataFrame:
    """(id, uses, used_by): sorted distinct references of each node and, reversed, the nodes that refer to it."""
    pairs = refs.where("dst is not null").select("src", "dst").distinct()
    uses = pairs.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("uses"))
    used = pairs.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("used_by"))
    none = F.array().cast("array<string>")
    return uses.join(used, "id", "full_outer").select("id", F.coalesce(F.col("uses").cast("array<string>"), none).alias("uses"), F.coalesce(F.col("used_by").cast("array<string>"), none).alias("used_by"))
