"""Weighted assignment by auction: all who have nothing bid at once, prices rise, and the least raise shrinks from phase to phase.

Persons are the rows of the smaller side, things those of the larger one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.plans import drop_saved, save

#: The least raise of a phase is this part of the one before.
SHRINK = 5


def _bids(arcs: DataFrame, state: DataFrame, raise_: int, alone: int) -> DataFrame:
    """(thing, bid: price, person, left) of those who own nothing; ``left`` is what their best choice leaves them."""
    free = arcs.join(state.where("owner is not null").select(F.col("owner").alias("person")), "person", "left_anti")
    worth = free.join(state.select("thing", "price"), "thing").select("person", "thing", "price", (-F.col("cost") - F.col("price")).alias("left"))
    by = Window.partitionBy("person").orderBy(F.desc("left"), "thing")
    two = worth.withColumn("k", F.row_number().over(by)).where("k <= 2")  # a limit for each person goes before the shuffle too
    first, second = F.col("k") == 1, F.col("k") == 2
    best = two.groupBy("person").agg(F.max(F.when(first, F.struct("thing", "price", "left"))).alias("x"), F.max(F.when(second, F.col("left"))).alias("next"))
    bid = F.col("x.price") + F.col("x.left") - F.coalesce("next", F.col("x.left") - alone) + raise_
    return best.select(F.col("x.thing").alias("thing"), bid.alias("price"), "person", F.col("x.left").alias("left"))


def _phase(arcs: DataFrame, state: DataFrame, n: int, most: int, raise_: int, max_rounds: int) -> DataFrame:
    """Rounds of bids until each of ``n`` persons owns a thing."""
    highest = state.agg(F.max("price")).first()[0]
    least = -(2 * n * (most + raise_) + highest)
    for _ in range(max_rounds):
        bids = save(_bids(arcs, state, raise_, most), "bids")
        seen = bids.agg(F.count(F.lit(1)).alias("n"), F.min("left").alias("left")).first()
        if seen["n"] == 0:
            return state
        if seen["left"] < least:  # no chain of exchanges leads from this person to a thing that is free
            raise ValueError("no assignment gives every row of the smaller side a partner")
        won = bids.groupBy("thing").agg(F.max(F.struct("price", "person")).alias("w"))
        new = state.join(won, "thing", "left").select("thing", F.coalesce("w.price", "price").alias("price"), F.coalesce("w.person", "owner").alias("owner"))
        old, state = state, save(new, "prices")
        drop_saved(old, bids)
    raise RuntimeError(f"bids are still made after {max_rounds} rounds")


def _offers(arcs: DataFrame, state: DataFrame, floor: int, raise_: int) -> DataFrame:
    """(thing, price, person, left) of the unowned things above ``floor``: a person who would do better with it at that price, or null."""
    left = state.join(arcs.withColumnRenamed("person", "owner"), ["owner", "thing"]).select(F.col("owner").alias("person"), (-F.col("cost") - F.col("price")).alias("has"))
    idle = state.where(F.col("owner").isNull() & (F.col("price") > floor)).select("thing")
    worth = arcs.join(idle, "thing", "left_semi").join(left, "person").select("thing", "person", "cost", (-F.col("cost") - F.col("has")).alias("worth"))
    by = Window.partitionBy("thing").orderBy(F.desc("worth"), "person")
    two = worth.withColumn("k", F.row_number().over(by)).where("k <= 2")
    first, second = F.col("k") == 1, F.col("k") == 2
    best = two.groupBy("thing").agg(F.max(F.when(first, F.struct("worth", "person", "cost"))).alias("x"), F.max(F.when(second, F.col("worth"))).alias("next"))
    taken = F.col("x.worth") - raise_ > floor
    price = F.when(taken, F.greatest(F.lit(floor), F.coalesce(F.col("next") - raise_, F.lit(floor)))).otherwise(floor)
    found = best.select("thing", price.alias("price"), F.when(taken, F.col("x.person")).alias("person"), F.col("x.cost").alias("cost"))
    return found.select("thing", "price", "person", (-F.col("cost") - F.col("price")).alias("left"))


def _settle(arcs: DataFrame, state: DataFrame, raise_: int, max_rounds: int) -> DataFrame:
    """Rounds in which things that nobody owns offer themselves for less, until none costs more than the cheapest owned one."""
    floor = state.where("owner is not null").agg(F.min("price")).first()[0]
    for _ in range(max_rounds):
        offers = save(_offers(arcs, state, floor, raise_), "offers")
        if offers.isEmpty():
            return state
        dropped = offers.where("person is null").select("thing", "price", F.lit(None).cast(arcs.schema["person"].dataType).alias("now"))
        best = offers.where("person is not null").groupBy("person").agg(F.max(F.struct("left", "thing", "price")).alias("x"))
        moved = best.select(F.col("x.thing").alias("thing"), F.col("x.price").alias("price"), F.col("person").alias("now"))
        changed = dropped.unionByName(moved).withColumnRenamed("price", "to")
        gone = moved.select(F.col("now").alias("owner"), F.lit(True).alias("gone"))
        new = state.join(changed, "thing", "left").join(gone, "owner", "left")
        owner = F.coalesce("now", F.when(F.col("gone").isNull(), F.col("owner")))
        old, state = state, save(new.select("thing", F.coalesce("to", "price").alias("price"), owner.alias("owner")), "prices")
        drop_saved(old, offers)
    raise RuntimeError(f"things still offer themselves after {max_rounds} rounds")


def assignment_with_prices(costs: DataFrame, maximise: bool = False, max_rounds: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``assignment``, and (side, id, price) that proves them best.

    The prices of two ends never sum to more than the cost of their arc (less,
    with ``maximise``), those of the larger side are not positive (negative),
    and all prices sum to the total of the pairs, but for less than 1; as costs
    are whole numbers no assignment is better.
    """
    kind = costs.schema["cost"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"costs are whole numbers, not {kind}")
    sign = -1 if maximise else 1
    known = costs.where("left is not null and right is not null and cost is not null")
    one = save(known.groupBy("left", "right").agg((sign * F.min(sign * F.col("cost").cast("long"))).alias("cost")), "costs")
    n, m = (one.select(c).distinct().count() for c in ("left", "right"))
    flipped = n > m
    sides = ("right", "left") if flipped else ("left", "right")
    turned = one.select(F.col(sides[0]).alias("left"), F.col(sides[1]).alias("right"), (sign * F.col("cost")).alias("cost"))
    small = min(n, m)
    scale = small + 1
    most = (one.agg(F.max(F.abs("cost"))).first()[0] or 0) * scale + 1
    if 16 * scale * most >= 1 << 62:
        raise ValueError("costs times the square of the number of rows exceed 62 bits")
    arcs = save(turned.select(F.col("left").alias("person"), F.col("right").alias("thing"), (F.col("cost") * scale).alias("cost")), "arcs")
    none = F.lit(None).cast(arcs.schema["person"].dataType)
    state = save(arcs.select("thing").distinct().select("thing", F.lit(0).cast("long").alias("price"), none.alias("owner")), "prices")
    raise_ = most
    while small:
        raise_ = max(1, raise_ // SHRINK)
        state = _phase(arcs, state, small, most, raise_, max_rounds)
        if n != m:
            state = _settle(arcs, state, raise_, max_rounds)
        low = state.where("owner is not null").agg(F.min("price")).first()[0]
        last = raise_ == 1
        kept = F.col("owner") if last else none
        old, state = state, save(state.select("thing", (F.greatest("price", F.lit(low)) - low).alias("price"), kept.alias("owner")), "prices")
        drop_saved(old)
        if last:
            break
    ours = state.where("owner is not null").select(F.col("owner").alias(sides[0]), F.col("thing").alias(sides[1]))
    pairs = ours.join(one, ["left", "right"]).select("left", "right", "cost")
    worth = arcs.join(state, "thing").groupBy(F.col("person").alias("id")).agg(F.min(F.col("cost") + F.col("price")).alias("price"))
    parts = worth.select(F.lit(sides[0]).alias("side"), "id", "price").unionByName(state.select(F.lit(sides[1]).alias("side"), F.col("thing").alias("id"), (-F.col("price")).alias("price")))
    return pairs, parts.select("side", "id", (F.col("price") * (sign / scale)).alias("price"))


def assignment(costs: DataFrame, maximise: bool = False) -> DataFrame:
    """(left, right, cost): a partner for every row of the smaller side, no row in two pairs, at the least total cost (greatest, with ``maximise``).

    ``costs`` is (left, right, cost), ends of one type and whole costs of any
    sign; pairs that are missing cannot be made, rows with a null are left out
    and of repeated pairs the better counts. An empty table gives no pairs.
    ValueError if no assignment exists. Which of equally good ones is returned
    is not defined, but every run of the same table gives the same.

    Costs are scaled by more than the number of rows, so that a last phase whose
    least raise is 1 ends at the exact optimum. On tables with unequal sides the
    things that are left over then offer themselves to others, until none costs
    more than the cheapest owned one. A round costs a join of the arcs
    of those without a partner and a top two for each of them; the number of
    rounds grows with the competition for the same partners.
    """
    return assignment_with_prices(costs, maximise)[0]
