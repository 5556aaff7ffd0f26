"""Positions for drawing: closed forms, a force layout over a quadtree, and barycentric positions inside a polygon."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.transforms import ranked_ids
from graphloom.plans import drop_saved, running_total, save
from graphloom.plans.fixpoint import rounds


def circular(graph: Graph, radius: float = 1.0) -> DataFrame:
    """(id, x, y) on a circle in the order of ids."""
    n = max(1, graph.vertices.count())
    angle = 2 * math.pi * F.col("new") / n
    return ranked_ids(graph).select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def shell(graph: Graph, shells: DataFrame) -> DataFrame:
    """(id, x, y): vertices of (id, shell) on concentric circles."""
    placed = running_total(shells, ["shell"], [F.col("id")], F.lit(1).cast("long"), "k")
    n = shells.groupBy("shell").agg(F.count(F.lit(1)).alias("n"))
    angle = 2 * math.pi * F.col("k") / F.col("n")
    return placed.join(n, "shell").select("id", (F.col("shell") * F.cos(angle)).alias("x"), (F.col("shell") * F.sin(angle)).alias("y"))


def multipartite(layers: DataFrame, gap: float = 1.0) -> DataFrame:
    """(id, x, y): vertices of (id, layer) in a column a layer, in the order of ids and centred on y = 0."""
    placed = running_total(layers.select("id", "layer"), ["layer"], [F.col("id")], F.lit(1).cast("long"), "k")
    n = layers.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(n, "layer").select("id", (F.col("layer") * gap).alias("x"), ((F.col("k") - (F.col("n") - 1) / 2) * gap).alias("y"))


def random_layout(graph: Graph, seed: int = 0, width: float = 1.0, height: float = 1.0) -> DataFrame:
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    return graph.vertices.select("id", (u(0) * width).alias("x"), (u(1) * height).alias("y"))


def repulsion(points: DataFrame, strength: float, theta: float = 0.5, levels: int | None = None) -> DataFrame:
    """(id, px, py): what pushes each of ``points`` (id, x, y in the unit square) from all others, strength / distance.

    Points are counted in the cells of a quadtree. A point starts at the four
    quarters of the square and goes down by a level at a time: a cell that seems
    smaller than ``theta``, or holds one point, pushes as a whole from its
    centre, others are opened. Points that share a cell of the last level (by
    default two more than the logarithm of their number) push as that cell, and
    distances below its side count as that, so that no push is without bound.
    """
    levels = levels or min(20, math.ceil(math.log(max(2, points.count()), 4)) + 2)
    at = lambda c: F.least(F.floor(F.col(c) * (1 << levels)), F.lit((1 << levels) - 1))
    deep = points.select("x", "y", at("x").alias("gx"), at("y").alias("gy"), F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"))
    cell = [F.expr(f"shiftright({g}, {levels} - level)").alias(g) for g in ("gx", "gy")]
    cells = save(deep.groupBy("level", *cell).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("m")), "cells")
    below = lambda n: cells.where(F.col("level") == n).select(F.shiftright("gx", 1).alias("ux"), F.shiftright("gy", 1).alias("uy"), "gx", "gy", "cx", "cy", "m")
    front, pushes = points.select("id", "x", "y", F.lit(0).cast("long").alias("ux"), F.lit(0).cast("long").alias("uy")), None
    for n in range(1, levels + 1):
        down = F.broadcast(below(n)) if n <= 6 else below(n)  # 4,096 cells at most
        seen = front.join(down, ["ux", "uy"])
        dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
        d2 = dx * dx + dy * dy
        whole = (F.col("m") == 1) | (F.lit(0.25**n) < theta * theta * d2) | F.lit(n == levels)
        near = F.greatest(d2, F.lit(0.25**levels))
        part = seen.where(whole).select("id", (strength * F.col("m") * dx / near).alias("px"), (strength * F.col("m") * dy / near).alias("py"))
        pushes = part if pushes is None else pushes.unionByName(part)
        front = seen.where(~whole).select("id", "x", "y", F.col("gx").alias("ux"), F.col("gy").alias("uy"))
    return pushes.groupBy("id").agg(F.sum("px").alias("px"), F.sum("py").alias("py"))


def spring(graph: Graph, iterations: int = 20, seed: int = 0, theta: float = 0.5) -> DataFrame:
    """(id, x, y) in the unit square: attraction along edges, repulsion by Barnes and Hut's quadtree.

    A round is linear in edges and, but for a logarithm, in vertices. Vertices
    move by at most the heat of the round, which falls to nothing.
    """
    n = max(1, graph.vertices.count())
    k = (1.0 / n) ** 0.5
    arcs = save(graph.both_ways().where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("w")), "arcs")
    turn = [0]

    def step(state: DataFrame) -> DataFrame:
        heat = 0.1 * (1 - turn[0] / max(1, iterations))
        turn[0] += 1
        push = repulsion(state, k * k, theta)
        a, b = state.select(F.col("id").alias("src"), "x", "y"), state.select(F.col("id").alias("dst"), F.col("x").alias("u"), F.col("y").alias("v"))
        ex, ey = F.col("u") - F.col("x"), F.col("v") - F.col("y")
        length = F.sqrt(ex * ex + ey * ey)
        pull = arcs.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * ex * length / k).alias("qx"), F.sum(F.col("w") * ey * length / k).alias("qy"))
        fx, fy = F.col("px") + F.coalesce("qx", F.lit(0.0)), F.col("py") + F.coalesce("qy", F.lit(0.0))
        size = F.greatest(F.sqrt(fx * fx + fy * fy), F.lit(1e-9))
        move = F.least(size, F.lit(heat)) / size
        clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
        return state.join(push, "id").join(pull, "id", "left").select("id", clip(F.col("x") + fx * move).alias("x"), clip(F.col("y") + fy * move).alias("y"))

    return rounds(random_layout(graph, seed), step, iterations)


def tutte(graph: Graph, boundary: DataFrame, radius: float = 1.0, tolerance: float = 1e-8, max_iter: int = 100_000) -> DataFrame:
    """(id, x, y): ``boundary`` (id, place) on a circle in the order of places, every other vertex at the mean of its neighbours.

    Conjugate gradients over the edge table, both axes side by side, scaled by
    degrees: a round is one join of the inner edges with what moves. It ends
    when no inner vertex is ``tolerance`` * ``radius`` off its mean. Weights,
    directions and loops do not count; pieces without a boundary stay at the
    centre. ValueError for fewer than three, repeated or unknown boundary
    vertices.
    """
    boundary = save(boundary.select("id", "place"), "boundary")
    n, distinct = boundary.agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    if n < 3 or distinct < n or not boundary.join(graph.vertices, "id", "left_anti").isEmpty():
        raise ValueError("a boundary is three or more different vertices of the graph")
    placed = running_total(boundary.withColumn("g", F.lit(0)), ["g"], [F.col("place"), F.col("id")], F.lit(1).cast("long"), "k")
    angle = 2 * math.pi * F.col("k") / n
    fixed = save(placed.select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y")), "fixed")
    arcs = save(graph.both_ways().where("src <> dst").select("src", "dst").distinct().join(fixed.select(F.col("id").alias("src")), "src", "left_anti"), "arcs")
    inner = graph.vertices.select("id").distinct().join(fixed, "id", "left_anti")
    degree = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("d"))
    pull = arcs.join(fixed.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("rx"), F.sum("y").alias("ry"))
    inside = save(arcs.join(fixed.select(F.col("id").alias("dst")), "dst", "left_anti"), "inside")
    state = inner.join(degree, "id", "left").na.fill(1.0, ["d"]).join(pull, "id", "left").na.fill(0.0, ["rx", "ry"])
    state = state.select("id", "d", *(F.lit(0.0).alias(c) for c in "xy"), "rx", "ry", *((F.col(f"r{c}") / F.col("d")).alias(f"p{c}") for c in "xy"))
    last = None
    for _ in range(max_iter):
        got = inside.join(state.select(F.col("id").alias("dst"), "px", "py"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("px").alias("sx"), F.sum("py").alias("sy"))
        lead = state.join(got, "id", "left").withColumns({f"q{c}": F.col("d") * F.col(f"p{c}") - F.coalesce(f"s{c}", F.lit(0.0)) for c in "xy"}).drop("sx", "sy")
        saved = save(lead, "gradients")
        off = F.max(F.greatest(*(F.abs(F.col(f"r{c}")) / F.col("d") for c in "xy")))
        row = saved.agg(off, *(F.sum(F.col(f"r{c}") * F.col(f"r{c}") / F.col("d")) for c in "xy"), *(F.sum(F.col(f"p{c}") * F.col(f"q{c}")) for c in "xy")).first()
        if last is not None:
            drop_saved(last)
        last = saved
        if row[0] is None or row[0] <= tolerance * radius:
            return fixed.unionByName(saved.select("id", "x", "y"))
        step = [row[1 + i] / row[3 + i] if row[3 + i] else 0.0 for i in (0, 1)]
        moved = saved.withColumns({c: F.col(c) + step[i] * F.col(f"p{c}") for i, c in enumerate("xy")} | {f"r{c}": F.col(f"r{c}") - step[i] * F.col(f"q{c}") for i, c in enumerate("xy")})
        new = moved.agg(*(F.sum(F.col(f"r{c}") * F.col(f"r{c}") / F.col("d")) for c in "xy")).first()
        again = [new[i] / row[1 + i] if row[1 + i] else 0.0 for i in (0, 1)]
        state = moved.withColumns({f"p{c}": F.col(f"r{c}") / F.col("d") + again[i] * F.col(f"p{c}") for i, c in enumerate("xy")}).drop("qx", "qy")
    raise RuntimeError(f"not settled after {max_iter} rounds")
