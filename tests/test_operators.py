"""Operators that SQL does not express, on small graphs against brute force and by their laws."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import from_edges
from graphloom.operators import centrality, community, connectivity, dag, generators, health, layout, model, paths, structure, transforms
from graphloom.plans import connected_components, running_total

EDGES = [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (2, 3, 8), (3, 4, 3), (5, 6, 1), (6, 7, 1), (5, 7, 7), (8, 8, 2)]


def graph(spark, edges, directed):
    return from_edges(spark.createDataFrame(edges, "src long, dst long, weight long"), directed)


def random_edges(seed, n=12, m=20):
    r = random.Random(seed)
    return sorted({(min(a, b), max(a, b)): (min(a, b), max(a, b), r.randint(1, 9)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m))}.values())


def adjacency(edges, directed=False):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})
        if not directed:
            out[b][a] = w
    return out


def distances(adj, source):
    dist = {source: 0}
    for _ in adj:
        for a in list(dist):
            for b, w in adj[a].items():
                if dist[a] + w < dist.get(b, 1e9):
                    dist[b] = dist[a] + w
    return dist


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(120)] + [(500, i) for i in range(501, 560)] + [(None, 3), (900, 900)]
    out = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert out == {i: 0 for i in range(121)} | {i: 500 for i in range(500, 560)} | {900: 900}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_running_total_with_a_hot_group_and_nulls(spark):
    rows = [("hot", i, i % 5) for i in range(300)] + [(None, i, 1) for i in range(20)] + [("x", 1, 7)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    want, total = {}, {}
    for g, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        want[g, k] = total.get(g, 0)
        total[g] = want[g, k] + v
    assert {(r["g"], r["k"]): r["before"] for r in running_total(df, ["g"], [F.col("k")], F.col("v"), "before", 7).collect()} == want


@pytest.mark.parametrize("directed", [False, True])
def test_shortest_paths(spark, directed):
    g = graph(spark, EDGES, directed)
    adj = adjacency(EDGES, directed)
    out = {(r["source"], r["id"]): r["dist"] for r in paths.sssp(g, g.vertices).collect()}
    assert out == {(s, t): float(d) for s in adj for t, d in distances(adj, s).items()}
    path = [r["id"] for r in paths.shortest_path(g, 0, 4).orderBy("step").collect()]
    assert path == [0, 2, 1, 3, 4]
    assert paths.shortest_path(g, 0, 7).count() == 0


def test_negative_cycle(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, -3), (2, 0, 1)], True)
    with pytest.raises(ValueError, match="negative cycle"):
        paths.sssp(g, g.vertices.where("id = 0"))


@pytest.mark.parametrize("seed", [1, 2])
def test_cores_bridges_and_forests(spark, seed):
    edges = random_edges(seed)
    g, adj = graph(spark, edges, False), adjacency(edges)
    left, core, k = {a: {b for b in n if b != a} for a, n in adj.items()}, {}, 0
    while left:
        a = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[a]))
        core[a] = k
        for b in left.pop(a):
            left[b].discard(a)
    assert {r["id"]: r["core"] for r in connectivity.core_numbers(g).collect()} == core

    def parts(es):
        lab = {a: a for a in adj}
        for _ in adj:
            for a, b, _w in es:
                lab[a] = lab[b] = min(lab[a], lab[b])
        return len(set(lab.values()))

    cut = {(a, b) for a, b, w in edges if a != b and parts([e for e in edges if e[:2] != (a, b)]) > parts(edges)}
    assert {(r["src"], r["dst"]) for r in connectivity.bridges(g).collect()} == cut
    want, lab = 0, {a: a for a in adj}
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if lab[a] != lab[b]:
            want += w
            lab = {x: lab[a] if y == lab[b] else y for x, y in lab.items()}
    forest = structure.spanning_forest(g).collect()
    assert sum(r["weight"] for r in forest) == want and len(forest) == len(adj) - parts(edges)


def test_strong_components(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (3, 4, 1), (4, 3, 1), (5, 0, 1)], True)
    assert {r["id"]: r["component"] for r in connectivity.strong_components(g).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_dag(spark):
    g = graph(spark, [(0, 1, 2), (0, 2, 1), (1, 3, 1), (2, 3, 5), (3, 4, 1), (2, 4, 1)], True)
    assert {r["id"]: r["generation"] for r in dag.generations(g).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    assert {r["id"]: r["n_paths"] for r in dag.path_counts(g, 0).collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3}
    assert dag.longest_path_length(g).first()[0] == 7.0
    assert {tuple(r) for r in transforms.transitive_reduction(g).edges.select("src", "dst").collect()} == {(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)}
    with pytest.raises(ValueError, match="cycle"):
        dag.generations(graph(spark, [(0, 1, 1), (1, 0, 1)], True))


def test_betweenness(spark):
    edges = [e for e in random_edges(3, 9, 14) if e[0] != e[1]]
    adj = adjacency([(a, b, 1) for a, b, _ in edges])
    want = dict.fromkeys(adj, 0.0)
    for s, t in itertools.combinations(adj, 2):
        found = []
        todo = [[s]]
        while todo and not found:
            found = [p for p in todo if p[-1] == t]
            todo = [[*p, b] for p in todo for b in adj[p[-1]] if b not in p]
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found)
    g = graph(spark, [(a, b, 1) for a, b, _ in edges], False)
    out = {r["id"]: r["score"] for r in centrality.betweenness(g).collect()}
    assert out.keys() == want.keys() and all(abs(out[v] - want[v]) < 1e-9 for v in want)


def test_pagerank_sums_to_one(spark):
    out = centrality.pagerank(graph(spark, EDGES, True)).agg(F.sum("score")).first()[0]
    assert abs(out - 1) < 1e-9


def test_matching_colouring_and_independent_sets(spark):
    edges = [e for e in random_edges(4, 15, 30) if e[0] != e[1]]
    g, adj = graph(spark, edges, False), adjacency(edges)
    pairs = [(r["src"], r["dst"]) for r in structure.maximal_matching(g).collect()]
    used = {x for p in pairs for x in p}
    assert len(used) == 2 * len(pairs) and all(a in used or b in used for a, b, _ in edges)
    color = {r["id"]: r["color"] for r in structure.greedy_coloring(g).collect()}
    assert color.keys() == adj.keys() and all(color[a] != color[b] for a, b, _ in edges) and max(color.values()) <= max(map(len, adj.values()))
    chosen = {r["id"] for r in structure.maximal_independent_set(g).collect()}
    assert not any(a in chosen and b in chosen for a, b, _ in edges) and all(a in chosen or chosen & set(adj[a]) for a in adj)


def test_stable_marriage(spark):
    r = random.Random(1)
    left = {a: r.sample(range(10, 16), 6) for a in range(6)}
    right = {b: r.sample(range(6), 6) for b in range(10, 16)}
    df = structure.stable_marriage(
        spark.createDataFrame([(a, b, i) for a, p in left.items() for i, b in enumerate(p)], "left long, right long, rank int"),
        spark.createDataFrame([(b, a, i) for b, p in right.items() for i, a in enumerate(p)], "right long, left long, rank int"),
    )
    wife = {x["left"]: x["right"] for x in df.collect()}
    man = {b: a for a, b in wife.items()}
    assert len(wife) == 6 == len(man)
    assert not any(left[a].index(b) < left[a].index(wife[a]) and right[b].index(a) < right[b].index(man[b]) for a in left for b in right)


def test_communities_of_two_cliques(spark):
    g = generators.barbell(spark, 6)
    for found in (community.louvain(g), community.label_propagation(g)):
        names = {r["id"]: r["community"] for r in found.collect()}
        assert len({names[i] for i in range(6)}) == 1 and len({names[i] for i in range(6, 12)}) == 1 and len(set(names.values())) == 2
    assert community.clique_percolation(g, 4).select("id", "community").distinct().count() == 12


def test_generators(spark):
    for g, v, e in ((generators.petersen(spark), 10, 15), (generators.hypercube(spark, 4), 16, 32), (generators.ladder(spark, 5, circular=True), 10, 15), (generators.ladder(spark, 5, circular=True, moebius=True), 10, 15), (generators.complete(spark, 7), 7, 21)):
        assert (g.vertices.count(), g.edges.count()) == (v, e)
    a, b = generators.gnp(spark, 200, 0.1, 5).edges, generators.gnp(spark, 200, 0.1, 5).edges
    n = a.count()
    assert a.exceptAll(b).count() == 0 and abs(n - 1990) < 250
    assert generators.gnp(spark, 50, 0.0, 1).edges.count() == 0 and generators.gnp(spark, 50, 1.0, 1).edges.count() == 1225
    tree = generators.preferential_attachment(spark, 200, 1, 1)
    assert structure.predicates(tree).first()["is_tree"]


def test_model(spark):
    g = graph(spark, EDGES, False)
    with pytest.raises(ValueError, match="not a vertex"):
        model.add_edges(g, spark.createDataFrame([(0, 99, 1)], "src long, dst long, weight long"))
    more = model.add_edges(g, spark.createDataFrame([(99, 0, 1)], "src long, dst long, weight long"), ensure=True)
    assert more.vertices.count() == g.vertices.count() + 1 and more.edges.where("src = 0 and dst = 99").count() == 1
    assert {r["id"]: r["degree"] for r in model.degrees(g).collect()}[8] == 2


def test_health_and_layout(spark):
    g = generators.cycle(spark, 8)
    assert tuple(health.diameter_and_radius(g).first()) == (4.0, 4.0)
    assert abs(health.assortativity(g).first()[0]) < 1e-9
    assert health.sampled_diameter(g).first()[0] == 4
    for placed in (layout.circular(g), layout.spring(g, 3), layout.random_layout(g)):
        assert placed.count() == 8 and placed.where("x is null or y is null or isnan(x)").count() == 0
    e = {r["id"]: r["efficiency"] for r in health.local_efficiency(generators.complete(spark, 4)).collect()}
    assert e == dict.fromkeys(range(4), 1.0)


def test_sketched_reachability(spark):
    g = generators.path(spark, 60, directed=True)
    out = {r["id"]: r["descendants"] for r in connectivity.reachability_estimates(g).collect()}
    assert all(abs(out[i] - (59 - i)) <= max(2, 0.1 * (59 - i)) for i in range(60))


def test_negative_weights_by_potentials(spark):
    rows = [(0, 1, 4), (0, 2, 3), (1, 3, -2), (2, 1, -2), (3, 4, 0), (4, 2, 5), (5, 0, -7)]
    g = from_edges(spark.createDataFrame(rows, "src long, dst long, weight long"), True)
    want = {tuple(r) for r in paths.sssp(g, g.vertices).select("source", "id", "dist").collect()}
    assert {tuple(r) for r in paths.johnson(g).collect()} == want
    loop = from_edges(spark.createDataFrame([(0, 1, 1), (1, 0, -2)], "src long, dst long, weight long"), True)
    with pytest.raises(ValueError, match="negative cycle"):
        paths.johnson(loop)


def test_searches_of_no_depth_and_deep_estimates(spark):
    chain = from_edges(spark.createDataFrame([(i, i + 1) for i in range(70)], "src long, dst long"), True)
    start = chain.vertices.where("id = 0")
    assert [tuple(r)[:2] for r in paths.bfs(chain, start, max_depth=0).collect()] == [(0, 0)]
    assert paths.bfs(chain, start, max_depth=3).count() == 4
    with pytest.raises(RuntimeError, match="still found"):
        paths.bfs(chain, start, max_rounds=3)
    found = {r["id"]: r["descendants"] for r in connectivity.reachability_estimates(chain).collect()}
    assert all(abs(found[i] - (70 - i)) <= 5 for i in range(71))


def test_scores_that_do_not_settle_are_an_error(spark):
    g = from_edges(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 1)], "src long, dst long"), True)
    for measure in (centrality.pagerank, centrality.hits, centrality.eigenvector, centrality.katz, centrality.alpha):
        with pytest.raises(RuntimeError, match="not settled"):
            measure(g, max_iter=1, tolerance=1e-12)


def test_maximal_cliques(spark):
    r = random.Random(3)
    pairs = {(a, b) for a in range(12) for b in range(a + 1, 12) if r.random() < 0.55} | {(20, 21)}
    near = lambda a, b: (min(a, b), max(a, b)) in pairs
    ids = [*range(12), 20, 21, 30]
    all_ = [set(c) for k in range(1, 13) for c in itertools.combinations(ids, k) if all(near(a, b) for a, b in itertools.combinations(c, 2))]
    want = {tuple(sorted(c)) for c in all_ if not any(c < d for d in all_)}
    g = from_edges(spark.createDataFrame(list(pairs), "src long, dst long"), False, vertices=spark.createDataFrame([(i,) for i in ids], "id long"))
    found = [tuple(x["members"]) for x in community.maximal_cliques(g).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    whole = community.maximal_cliques(generators.complete(spark, 30)).collect()
    assert [x["members"] for x in whole] == [list(range(30))]
