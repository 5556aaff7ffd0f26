"""Graph generators: ranges and arithmetic, so any size is made in parallel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph, canonical
from graphloom.plans import drop_saved, running_total, save


def _graph(vertices: DataFrame, edges: DataFrame, directed: bool = False) -> Graph:
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.lit(1).cast("long").alias("weight"))
    return Graph(vertices, (edges if directed else canonical(edges)).distinct(), directed)


def _steps(spark: SparkSession, n: int, *to: Column, keep: Column | None = None, directed: bool = False) -> Graph:
    ids = spark.range(n)
    edges = ids.select(F.col("id").alias("src"), F.explode(F.array(*(c.cast("long") for c in to))).alias("dst")).where("dst is not null and src <> dst")
    return _graph(ids, edges if keep is None else edges.where(keep), directed)


ID = F.col


def path(spark: SparkSession, n: int, directed: bool = False) -> Graph:
    return _steps(spark, n, ID("id") + 1, keep=F.col("dst") < n, directed=directed)


def cycle(spark: SparkSession, n: int, directed: bool = False) -> Graph:
    return _steps(spark, n, (ID("id") + 1) % n, directed=directed)


def star(spark: SparkSession, n: int) -> Graph:
    """Centre 0."""
    return _steps(spark, n, F.lit(0))


def wheel(spark: SparkSession, n: int) -> Graph:
    """Hub 0, rim 1 .. n - 1."""
    rim = F.when(F.col("id") > 0, F.col("id") % (n - 1) + 1)
    return _steps(spark, n, F.lit(0), rim)


def complete(spark: SparkSession, n: int, directed: bool = False) -> Graph:
    ids = spark.range(n)
    pairs = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("dst")).where("src <> dst" if directed else "src < dst")
    return _graph(ids, pairs, directed)


def complete_bipartite(spark: SparkSession, m: int, n: int) -> Graph:
    pairs = spark.range(m).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(m), F.lit(m + n - 1))).alias("dst"))
    return _graph(spark.range(m + n), pairs)


def circulant(spark: SparkSession, n: int, jumps: list[int]) -> Graph:
    return _steps(spark, n, *((ID("id") + j) % n for j in jumps))


def grid(spark: SparkSession, rows: int, cols: int, torus: bool = False) -> Graph:
    """Vertex row * cols + col."""
    r, c = F.floor(F.col("id") / cols), F.col("id") % cols
    right = F.when(c + 1 < cols, F.col("id") + 1)
    down = F.when(r + 1 < rows, F.col("id") + cols)
    if torus:
        right, down = r * cols + (c + 1) % cols, ((r + 1) % rows) * cols + c
    return _steps(spark, rows * cols, right, down)


def hypercube(spark: SparkSession, dims: int) -> Graph:
    return _steps(spark, 1 << dims, *(F.col("id").bitwiseXOR(F.lit(1 << i)) for i in range(dims)))


def binary_tree(spark: SparkSession, depth: int) -> Graph:
    n = (1 << (depth + 1)) - 1
    return _steps(spark, n, 2 * ID("id") + 1, 2 * ID("id") + 2, keep=F.col("dst") < n)


def kary_tree(spark: SparkSession, n: int, k: int) -> Graph:
    """n vertices; the parent of v is (v - 1) div k."""
    return _steps(spark, n, F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / k)))


def ladder(spark: SparkSession, n: int, circular: bool = False, moebius: bool = False) -> Graph:
    """Rails 0 .. n - 1 and n .. 2n - 1; circular closes both, moebius crosses them."""
    i, upper = F.col("id") % n, F.col("id") >= n
    on = F.when(i + 1 < n, F.col("id") + 1)
    if circular:
        on = F.when(i + 1 < n, F.col("id") + 1).otherwise(F.when(upper, n).otherwise(0))
    if moebius:
        on = F.when(i + 1 < n, F.col("id") + 1).otherwise(F.when(upper, 0).otherwise(n))
    return _steps(spark, 2 * n, on, F.when(~upper, F.col("id") + n))


def petersen(spark: SparkSession, n: int = 5, k: int = 2) -> Graph:
    """Generalised Petersen graph: outer cycle, spokes, inner steps of k."""
    i, inner = F.col("id") % n, F.col("id") >= n
    return _steps(spark, 2 * n, F.when(inner, n + (i + k) % n).otherwise((i + 1) % n), F.when(~inner, F.col("id") + n))


def turan(spark: SparkSession, n: int, parts: int) -> Graph:
    """Complete multipartite with parts as equal as can be (by id modulo parts)."""
    g = complete(spark, n)
    return g.with_edges(g.edges.where(F.col("src") % parts != F.col("dst") % parts))


def crown(spark: SparkSession, n: int) -> Graph:
    g = complete_bipartite(spark, n, n)
    return g.with_edges(g.edges.where(F.col("dst") != F.col("src") + n))


def barbell(spark: SparkSession, n: int, between: int = 0) -> Graph:
    """Two complete graphs of n, joined by a path of ``between`` vertices."""
    ids = spark.range(2 * n + between)
    side = F.when(F.col("id") < n, 0).when(F.col("id") >= n + between, 2).otherwise(1)
    pairs = ids.select(F.col("id").alias("src"), side.alias("s"), F.explode(F.sequence(F.col("id"), F.when(side == 0, F.lit(n - 1)).when(side == 2, F.lit(2 * n + between - 1)).otherwise(F.col("id")))).alias("dst")).where("src < dst")
    chain = spark.range(n - 1, n + between).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return _graph(ids, pairs.select("src", "dst").unionByName(chain))


def lollipop(spark: SparkSession, n: int, tail: int) -> Graph:
    chain = spark.range(n - 1, n + tail - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return _graph(spark.range(n + tail), complete(spark, n).edges.select("src", "dst").unionByName(chain))


def caveman(spark: SparkSession, cliques: int, size: int) -> Graph:
    """Cliques in a ring; the last vertex of each is linked to the first of the next."""
    ids = spark.range(cliques * size)
    first = F.floor(F.col("id") / size) * size
    inside = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id"), first + size - 1)).alias("dst")).where("src < dst")
    ring = spark.range(cliques).select((F.col("id") * size + size - 1).alias("src"), ((F.col("id") + 1) % cliques * size).alias("dst"))
    return _graph(ids, inside.unionByName(ring.where("src <> dst")))


def _unit(seed: int, *of: Column | str) -> Column:
    """A uniform number in (0, 1) by a hash: the same on any cluster."""
    return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)


def _drawn(spans: DataFrame, seed: int, chunk: int = 64) -> DataFrame:
    """(src, dst): each dst of lo..hi - 1 of each (src, lo, hi, p) with probability p, independently.

    Geometric skips lead from one drawn column to the next, so the work follows
    the edges and not the pairs. A span draws ``chunk`` skips a round and goes
    on in the next round until it has passed its end.
    """
    certain = spans.where("p >= 1 and lo < hi").select("src", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("dst"))
    front = save(spans.where("p > 0 and p < 1 and lo < hi").withColumn("at", F.col("lo") - 1), "spans")
    parts, turn = [certain], 0
    while not front.isEmpty():
        skip = lambda i: F.floor(F.log(_unit(seed, "src", "lo", F.lit(turn), i)) / F.log(1 - F.col("p"))) + 1  # noqa: E731, B023
        ends = F.aggregate(
            F.transform(F.sequence(F.lit(1), F.lit(chunk)), skip),
            F.array(F.col("at")),
            lambda found, x: F.concat(found, F.array(F.least(F.element_at(found, -1) + x, F.col("hi")))),
        )
        drawn = save(front.withColumn("ends", ends), "drawn")
        parts.append(drawn.select("src", "hi", F.explode(F.slice("ends", 2, chunk)).alias("dst")).where("dst < hi").select("src", "dst"))
        front = drawn.select(*(F.element_at("ends", -1).alias(c) if c == "at" else F.col(c) for c in front.columns)).where("at < hi")
        turn += 1
    return reduce(DataFrame.unionByName, parts)


def gnp(spark: SparkSession, n: int, p: float, seed: int, directed: bool = False) -> Graph:
    """Every pair is an edge with probability p: the same graph on any cluster."""
    rows = spark.range(n)
    lo = F.lit(0).cast("long") if directed else F.col("id") + 1
    spans = rows.select(F.col("id").alias("src"), lo.alias("lo"), F.lit(n).cast("long").alias("hi"), F.lit(float(p)).alias("p"))
    return _graph(rows, _drawn(spans, seed).where("src <> dst"), directed)


def gnm(spark: SparkSession, n: int, m: int, seed: int, directed: bool = False) -> Graph:
    """Exactly m edges (all pairs, if there are fewer), every set of m pairs alike.

    Pairs are numbered and numbers drawn until m differ; the m first in an
    order by hash stay. Where more than half of the pairs are wanted, all are
    ordered, which is at most twice the result.
    """
    pairs = n * (n - 1) if directed else n * (n - 1) // 2
    m, most = min(m, pairs), m + m // 2 + 16
    if 2 * m > pairs:
        found = spark.range(pairs).select(F.col("id").alias("i"))
    else:
        while True:
            found = save(spark.range(most).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(pairs)).alias("i")).distinct(), "numbers")
            if found.count() >= m:
                break
            most *= 2
    placed = running_total(found.withColumn("g", F.lit(0)), ["g"], [F.xxhash64(F.lit(seed + 1), "i"), F.col("i")], F.lit(1).cast("long"), "k")
    i = F.col("i")
    if directed:
        src, dst = F.floor(i / (n - 1)), i % (n - 1)
        ends = [src.alias("src"), (dst + (dst >= src).cast("long")).alias("dst")]
    else:
        near = F.floor((1 + F.sqrt(1 + 8 * i.cast("double"))) / 2).cast("long")  # may be off by one where the root is rounded
        dst = near + F.when(near * (near - 1) / 2 > i, -1).when(near * (near + 1) / 2 <= i, 1).otherwise(0)
        ends = [(i - (dst * (dst - 1) / 2).cast("long")).alias("src"), dst.alias("dst")]
    return _graph(spark.range(n), placed.where(F.col("k") < m).select(*ends), directed)


def rewired(graph: Graph, turns: int, seed: int) -> Graph:
    """A simple undirected graph of the same degrees: edges in random pairs swap ends.

    In a turn the edges are paired by hash; a pair a-b, c-d becomes a-d, c-b
    where that makes no loop and no edge that is there or that another pair
    makes too. Weights become 1.
    """
    edges = save(canonical(graph.edges).where("src <> dst").select("src", "dst").distinct(), "edges")
    for turn in range(turns):
        h = F.xxhash64(F.lit(seed), F.lit(turn), "src", "dst")
        placed = running_total(edges.withColumn("g", F.lit(0)), ["g"], [h, F.col("src"), F.col("dst")], F.lit(1).cast("long"), "at")
        flip = (F.xxhash64(F.lit(seed + 1), F.lit(turn), "src", "dst") % 2) == 0
        turned = placed.select(F.floor(F.col("at") / 2).alias("pair"), "at", F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("s"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("d"))
        two = turned.groupBy("pair").agg(F.min_by("s", "at").alias("a"), F.min_by("d", "at").alias("b"), F.max_by("s", "at").alias("c"), F.max_by("d", "at").alias("e"), F.count(F.lit(1)).alias("n"))
        two = save(two, "swaps")
        ends = lambda x, y: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
        made = two.where("n = 2 and a <> e and c <> b").select("pair", F.explode(F.array(ends("a", "e"), ends("c", "b"))).alias("x")).select("pair", "x.*")
        alone = made.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("pair").alias("pair")).where("n = 1")
        good = alone.join(edges, ["src", "dst"], "left_anti").groupBy("pair").agg(F.count(F.lit(1)).alias("ok")).where("ok = 2").select("pair", F.lit(True).alias("swap"))
        chosen = two.join(good, "pair", "left")
        swap = F.array(ends("a", "e"), ends("c", "b"))
        stay = F.when(F.col("n") == 2, F.array(ends("a", "b"), ends("c", "e"))).otherwise(F.array(ends("a", "b")))
        new = save(chosen.select(F.explode(F.when(F.col("swap"), swap).otherwise(stay)).alias("x")).select("x.*"), "edges")
        drop_saved(edges, two)
        edges = new
    return graph.with_edges(edges.withColumn("weight", F.lit(1).cast("long")), False)


def regular(spark: SparkSession, n: int, d: int, seed: int, turns: int = 10) -> Graph:
    """Every vertex has d neighbours: a circulant graph, rewired. Needs d < n and n * d even."""
    if not 0 <= d < n or n * d % 2:
        raise ValueError("needs 0 <= d < n and an even n * d")
    ids = spark.range(n)
    steps = F.explode(F.array(*(F.lit(j).cast("long") for j in [*range(1, d // 2 + 1), *([n // 2] if d % 2 else [])]))) if d else None
    if steps is None:
        return _graph(ids, ids.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0))
    ring = ids.select(F.col("id").alias("src"), steps.alias("j")).select("src", ((F.col("src") + F.col("j")) % n).alias("dst"))
    return rewired(_graph(ids, ring), turns, seed)


def geometric(spark: SparkSession, n: int, radius: float, seed: int) -> Graph:
    """Points in the unit square (data: struct of x and y), linked within ``radius``; a point meets those of its cell and the cells around."""
    points = save(spark.range(n).select("id", _unit(seed, "id", F.lit(0)).alias("x"), _unit(seed, "id", F.lit(1)).alias("y")), "points")
    cell = [F.floor(F.col(c) / radius).alias(f"c{c}") for c in "xy"]
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = points.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), *cell, around.alias("o"))
    a = a.select("src", "ax", "ay", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    b = points.select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), *cell)
    near = a.join(b, ["cx", "cy"]).where("src < dst").where((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 <= radius**2)
    return _graph(points.select("id", F.struct("x", "y").alias("data")), near.select("src", "dst"))


def kronecker(spark: SparkSession, initiator: list[list[float]], power: int, edges: int, seed: int) -> Graph:
    """Stochastic Kronecker graph: each edge picks a cell of the initiator a level. Loops and repeats are dropped."""
    k, flat = len(initiator), [x for row in initiator for x in row]
    src = dst = F.lit(0).cast("long")
    for level in range(power):
        u, cell, below = _unit(seed, "id", F.lit(level)) * sum(flat), F.lit(0), 0.0
        for x in flat[:-1]:
            below += x
            cell = cell + (u >= below).cast("int")
        src, dst = src * k + F.floor(cell / k), dst * k + cell % k
    return _graph(spark.range(k**power), spark.range(edges).select(src.alias("src"), dst.alias("dst")).where("src <> dst"), True)


def rmat(spark: SparkSession, scale: int, edges: int, seed: int, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> Graph:
    """R-MAT: 2^scale vertices; each edge picks a quadrant a level. Loops and repeats are dropped."""
    bits = []
    for level in range(scale):
        u = F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
        bits.append(((u >= a + b).cast("long"), ((u >= a) & (u < a + b) | (u >= a + b + c)).cast("long")))
    src = sum((s * (1 << i) for i, (s, _) in enumerate(bits)), F.lit(0).cast("long"))
    dst = sum((d * (1 << i) for i, (_, d) in enumerate(bits)), F.lit(0).cast("long"))
    return _graph(spark.range(1 << scale), spark.range(edges).select(src.alias("src"), dst.alias("dst")).where("src <> dst"), True)


def block_model(spark: SparkSession, sizes: list[int], p_in: float, p_out: float, seed: int) -> Graph:
    """Stochastic block model; blocks are consecutive ids. Each pair of blocks is drawn at its own probability."""
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    blocks = F.explode(F.array(*(F.struct(F.lit(e - s).cast("long").alias("lo"), F.lit(e).cast("long").alias("hi")) for e, s in zip(ends, sizes))))
    rows = spark.range(sum(sizes)).select(F.col("id").alias("src"), blocks.alias("b"))
    own = (F.col("src") >= F.col("b.lo")) & (F.col("src") < F.col("b.hi"))
    spans = rows.select("src", F.greatest(F.col("src") + 1, "b.lo").alias("lo"), F.col("b.hi").alias("hi"), F.when(own, float(p_in)).otherwise(float(p_out)).alias("p"))
    return _graph(spark.range(sum(sizes)), _drawn(spans, seed))


def nested_block_model(spark: SparkSession, n: int, branching: list[int], p: list[float], seed: int) -> Graph:
    """Hierarchical block model: level i splits each block of consecutive ids into branching[i] equal ones.

    Two vertices whose smallest common block is of level i are linked with
    probability p[i]; p[-1] counts within the smallest blocks. ``n`` is a
    multiple of the number of those.
    """
    widths = [n]
    for b in branching:
        if widths[-1] % b:
            raise ValueError("n must be a multiple of the number of blocks")
        widths.append(widths[-1] // b)
    here, parts = F.col("id"), []
    for i, w in enumerate(widths):
        own = F.floor(here / w) * w + w  # the end of the vertex's block of this level
        inner = F.floor(here / widths[i + 1]) * widths[i + 1] + widths[i + 1] if i + 1 < len(widths) else here + 1
        parts.append(F.struct(inner.cast("long").alias("lo"), own.cast("long").alias("hi"), F.lit(float(p[i])).alias("p")))
    spans = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(*parts)).alias("s")).select("src", "s.*")
    return _graph(spark.range(n), _drawn(spans, seed))


def degree_corrected_block_model(spark: SparkSession, sizes: list[int], edges: int, inside: float, seed: int, exponent: float = 2.5) -> Graph:
    """Block model of uneven degrees: within a block the k-th vertex is drawn by weight k^(-1 / (exponent - 1)).

    Each of ``edges`` draws picks its first block by size, keeps it for the
    second end with probability ``inside`` and else picks any by size. Loops
    and repeats are dropped.
    """
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    n, shape = ends[-1], 1 - 1 / (exponent - 1)
    block = lambda u: sum(((u * n >= e).cast("int") for e in ends[:-1]), F.lit(0))
    of = lambda values, b: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), b + 1)
    vertex = lambda b, u: of([e - s for e, s in zip(ends, sizes)], b) + F.least(F.floor(of(sizes, b) * u ** (1 / shape)), of(sizes, b) - 1)
    first = block(_unit(seed, "id", F.lit(0)))
    second = F.when(_unit(seed, "id", F.lit(1)) < inside, first).otherwise(block(_unit(seed, "id", F.lit(2))))
    pairs = spark.range(edges).select("id", first.alias("a"), second.alias("b"))
    pairs = pairs.select(vertex(F.col("a"), _unit(seed, "id", F.lit(3))).alias("src"), vertex(F.col("b"), _unit(seed, "id", F.lit(4))).alias("dst"))
    return _graph(spark.range(n), pairs.where("src <> dst"))


def preferential_attachment(spark: SparkSession, n: int, m: int, seed: int) -> Graph:
    """Every new vertex copies the end of a random earlier edge slot, which is attachment by degree; slots resolve by pointer jumping."""
    from graphloom.plans.fixpoint import fixpoint

    slots = spark.range(m, n).select("id", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    slots = slots.select(((F.col("id") - m) * m + F.col("j")).alias("slot"), F.col("id").alias("src"))
    h = F.pmod(F.xxhash64(F.lit(seed), "slot"), 2 * (F.col("slot") - F.col("slot") % m) + m)
    start = slots.select("slot", "src", F.when(h < m, h).when((h - m) % 2 == 0, F.floor((h - m) / 2 / m) + m).alias("dst"), F.when((h >= m) & ((h - m) % 2 == 1), F.floor((h - m) / 2)).alias("at"))

    def step(state: DataFrame) -> DataFrame:
        other = state.select(F.col("slot").alias("k"), F.col("dst").alias("d2"), F.col("at").alias("a2"))
        both = state.join(other, state["at"] == other["k"], "left")
        return both.select("slot", "src", F.coalesce("dst", "d2").alias("dst"), F.when(F.col("dst").isNull() & F.col("d2").isNull(), F.col("a2")).alias("at"))

    return _graph(spark.range(n), fixpoint(start, step, "at is not null").select("src", "dst").where("src <> dst"))


def small_world(spark: SparkSession, n: int, k: int, p: float, seed: int) -> Graph:
    """Ring of k nearest neighbours, the far end of each edge rewired with probability p."""
    ring = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("j"))
    u = F.pmod(F.xxhash64(F.lit(seed), "src", "j"), F.lit(1 << 30)) / float(1 << 30)
    other = F.pmod(F.xxhash64(F.lit(seed + 1), "src", "j"), F.lit(n))
    return _graph(spark.range(n), ring.select("src", F.when(u < p, other).otherwise((F.col("src") + F.col("j")) % n).alias("dst")).where("src <> dst"))


def recursive_tree(spark: SparkSession, n: int, seed: int) -> Graph:
    """Every vertex hangs on a random earlier one."""
    return _steps(spark, n, F.when(F.col("id") > 0, F.pmod(F.xxhash64(F.lit(seed), "id"), F.greatest("id", F.lit(1)))))


def configuration_model(degrees: DataFrame, seed: int) -> DataFrame:
    """(src, dst): stubs of (id, degree) paired in a random order; loops and repeats stay, an odd last stub is left over."""
    stubs = degrees.where("degree > 0").select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("degree").cast("long"))).alias("j"), F.lit(0).alias("g"))
    placed = running_total(stubs, ["g"], [F.xxhash64(F.lit(seed), "id", "j"), F.col("id"), F.col("j")], F.lit(1).cast("long"), "at")
    pairs = placed.groupBy(F.floor(F.col("at") / 2).alias("pair")).agg(F.min_by("id", "at").alias("src"), F.max_by("id", "at").alias("dst"), F.count(F.lit(1)).alias("n"))
    return pairs.where("n = 2").select("src", "dst")
