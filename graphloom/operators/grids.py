"""Graphs of cells in a plane: a table (row, col, data), moves from cell to cell, and a rule for which moves are allowed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph

ROOK = [(-1, 0), (1, 0), (0, -1), (0, 1)]
BISHOP = [(-1, -1), (-1, 1), (1, -1), (1, 1)]
QUEEN = ROOK + BISHOP
KNIGHT = [(r, c) for r in (-2, -1, 1, 2) for c in (-2, -1, 1, 2) if abs(r) != abs(c)]

Rule = Callable[[Column, Column], Column]


def always(here: Column, there: Column) -> Column:
    return F.lit(True)


def into(*values: object) -> Rule:
    """Moves into cells of these values only."""
    return lambda here, there: there.isin(*values)


def avoiding(*values: object) -> Rule:
    """Moves into cells of other values only; a null is none of the values."""
    return lambda here, there: F.coalesce(~there.isin(*values), F.lit(True))


def from_cells(cells: DataFrame, may_move: Rule = always, moves: list[tuple[int, int]] = ROOK, directed: bool = False, wrap: bool = False) -> Graph:
    """Vertices (id, data) with id = row * columns + col, and an edge of weight 1 for each allowed move.

    Rows and columns count from 0 and a cell occurs once; columns is the largest
    col and one. Cells without a row or col are left out. An undirected edge
    stands where a move is allowed one way at least. With ``wrap`` the plane is a
    torus: the last row and column lead to the first, and a move that comes back
    to its own cell is no edge. One equi-join, with as many rows as cells times
    moves.
    """
    cells = cells.where("row is not null and col is not null")
    last = cells.agg(F.max("row"), F.max("col")).first()
    rows, columns = (last[0] or 0) + 1, (last[1] or 0) + 1
    at = cells.select((F.col("row") * columns + F.col("col")).cast("long").alias("id"), "row", "col", "data")
    steps = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in moves)))
    moved = at.select("id", "row", "col", "data", steps.alias("by")).select(F.col("id").alias("src"), F.col("data").alias("here"), (F.col("row") + F.col("by.r")).alias("row"), (F.col("col") + F.col("by.c")).alias("col"))
    if wrap:
        moved = moved.withColumns({"row": F.pmod("row", F.lit(rows)), "col": F.pmod("col", F.lit(columns))})
    ends = at.select(F.col("id").alias("dst"), F.col("data").alias("there"), "row", "col")
    edges = moved.join(ends, ["row", "col"]).where(may_move(F.col("here"), F.col("there"))).select("src", "dst")
    if wrap:
        edges = edges.where("src <> dst").distinct()
    if not directed:
        edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return Graph(at.select("id", "data"), edges.withColumn("weight", F.lit(1).cast("long")), directed)


def places(graph: Graph, columns: int) -> DataFrame:
    """(id, row, col) of the vertices of such a graph."""
    return graph.vertices.select("id", F.floor(F.col("id") / columns).alias("row"), F.pmod("id", F.lit(columns)).alias("col"))
