"""Graph operators on small graphs, and against plain Python on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import communities, graph, topics


def asof():
    return F.lit("2025-01-10 00:00:00").cast("timestamp")


def edges(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "a string, b string")


def nodes(spark, rows):
    return spark.createDataFrame([(i, n, s, None) for i, n, s in rows], "id string, name string, source_captured_ids array<string>, created_at timestamp")


def test_undirected(spark):
    links = spark.createDataFrame([("x", "x"), ("x", "y"), ("Y", "x"), ("x", "ghost"), (None, "x")], "source string, target string")
    n = spark.createDataFrame([("x",), ("y",), ("alone",)], "id string")
    assert [tuple(r) for r in graph.undirected(links, n).collect()] == [("x", "y")]


def test_bridge_and_tag_exclusion(spark):
    n = nodes(spark, [("n1", "a", ["c1"]), ("n2", "b", []), ("n3", "c", ["c2"]), ("n4", "d", None)])
    e = edges(spark, [("n1", "n2"), ("n2", "n3"), ("n3", "n4")])
    caps = lambda ta, tb: spark.createDataFrame([("g", "c1", ta), ("g", "c2", tb)], "grp string, id string, tags array<string>")
    assert [tuple(r)[1:] for r in graph.two_hop_bridges(caps(["x"], ["y"]), n, e).collect()] == [("c1", "c2", "n1", "n2", "n3")]
    assert graph.two_hop_bridges(caps(["X"], ["x"]), n, e).isEmpty()
    assert graph.two_hop_bridges(caps(None, None), n, e).count() == 1


def test_paths(spark):
    n = nodes(spark, [(f"n{i}", f"N{i}", []) for i in range(1, 5)])
    e = edges(spark, [("n1", "n2"), ("n2", "n3"), ("n3", "n4")])
    seeds = spark.createDataFrame([("n1",)], "id string")
    got = {r["id"]: r["path"] for r in graph.shortest_paths(graph.distances(e, seeds), n).collect()}
    assert got["n4"] == ["N4", "N3", "N2", "N1"] and got["n1"] == ["N1"]
    assert "n4" not in {r["id"] for r in graph.distances(e, seeds, 2).collect()}


def test_pagerank(spark):
    e = edges(spark, [("A", "B"), ("B", "C"), ("C", "D")])
    r = {x["id"]: x["rank"] for x in graph.personalized_pagerank(e, spark.createDataFrame([("g", "A")], "grp string, id string"), iterations=20).collect()}
    assert r["B"] > r["C"] > r["D"] and r["A"] > r["D"] and abs(sum(r.values()) - 1) < 1e-9
    pair = edges(spark, [("A", "B")])
    r = {x["id"]: x["rank"] for x in graph.personalized_pagerank(pair, spark.createDataFrame([("g", "A"), ("g", "B")], "grp string, id string"), iterations=5).collect()}
    assert abs(r["A"] - r["B"]) < 0.02
    assert graph.personalized_pagerank(pair, spark.createDataFrame([], "grp string, id string"), iterations=2).isEmpty()


def test_depth_and_implicit(spark):
    n = nodes(spark, [("hub", "h", ["c"]), ("s1", "s", ["c1", "c2"]), ("s2", "t", ["c1", "c2", ""]), ("one", "o", ["c1"]), ("p", "p", []), ("q", "q", []), ("r", "r", [])])
    got = {r["id"]: r["depth"] for r in graph.depth_profile(n, edges(spark, [("hub", "p"), ("hub", "q"), ("hub", "r")])).collect()}
    assert got == {"hub": "deep", "s1": "shallow", "s2": "shallow"}
    e = edges(spark, [("A", "X"), ("A", "Y"), ("B", "X"), ("B", "Y")])
    c = spark.createDataFrame([("g", x) for x in "ABXY"], "grp string, id string")
    assert {tuple(r)[1:] for r in graph.implicit_pairs(c, e).collect()} == {("A", "B", 2), ("X", "Y", 2)}
    assert ("A", "B", 2) not in {tuple(r)[1:] for r in graph.implicit_pairs(c, e.union(edges(spark, [("A", "B")]))).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_components_and_modularity_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    ids = [f"v{i:02d}" for i in range(14)]
    pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(12)})
    parent = {i: i for p in pairs for i in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    e = edges(spark, pairs)
    assert {r["id"]: r["component"] for r in graph.components(e).collect()} == {i: root(i) for i in parent}
    # by component or at once, greedy modularity gives the same communities
    whole = communities.greedy_modularity(pairs, len(pairs))
    assert {r["id"]: r["community"] for r in communities.detect(e).collect()} == whole
    assert all(root(i) == root(c) for i, c in whole.items())


def test_communities(spark):
    e = edges(spark, [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2")])
    m = communities.detect(e)
    got = {}
    for r in m.collect():
        got.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == [["a1", "a2", "a3"], ["b1", "b2"]]
    n = nodes(spark, [(i, f"name {i}", ["c1", "c2"]) for i in ("a1", "a2", "a3", "b1", "b2")])
    rows = {r["community"]: r for r in communities.describe(m, n, e, asof(), min_nodes=3).collect()}
    assert list(rows) == ["a1"] and rows["a1"]["n_captures"] == 2 and rows["a1"]["evolution"] == "shrinking"
    assert communities.detect(e.limit(0)).isEmpty()


def test_large_component_is_propagated(spark):
    e = edges(spark, [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2")])
    got = {r["id"]: r["community"] for r in communities.detect(e, component_edges=2).collect()}
    assert got["a1"] == got["a2"] == got["a3"] and got["b1"] == got["b2"] != got["a1"]


def test_absorption_and_hierarchy(spark):
    e = edges(spark, [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("a3", "p"), ("x", "y")])
    m = spark.createDataFrame([("a1", "a1"), ("a2", "a1"), ("a3", "a1"), ("p", "p"), ("x", "x"), ("y", "x")], "id string, community string")
    got = {r["id"]: r["topic"] for r in communities.absorbed(m, e).collect()}
    assert got == {"a1": "a1", "a2": "a1", "a3": "a1", "p": "a1", "x": "other", "y": "other"}
    stars = [(f"s{k}", f"s{k}-{i:02d}") for k in (1, 2) for i in range(13)] + [("s1", "s2")]
    h = communities.hierarchy(edges(spark, stars)).collect()
    sizes = {}
    for r in h:
        sizes[r["topic"]] = sizes.get(r["topic"], 0) + 1
    assert len(sizes) >= 2 and max(sizes.values()) < 28


def test_votes_and_cross_edges(spark):
    n = spark.createDataFrame([("n1", 5, ["c1"]), ("n2", 9, ["c1"]), ("n3", 1, ["c1", "c2"])], "id string, val int, source_captured_ids array<string>")
    t = spark.createDataFrame([("n1", "A"), ("n2", "B"), ("n3", "Z")], "id string, topic string")
    assert {r["capture_id"]: r["topic"] for r in topics.capture_votes(n, t, "Z").collect()} == {"c1": "B"}
    cross = topics.cross_topic_edges(edges(spark, [("n1", "n2"), ("n1", "n3"), ("n2", "ghost")]), t)
    assert {tuple(r) for r in cross.collect()} == {("A", "B", 1), ("A", "Z", 1)}


def test_strong_edges(spark):
    rows = [("v", f"x{i}", f"x{j}", 100 - i - j) for i in range(8) for j in range(i + 1, 8)]
    df = spark.createDataFrame(rows, "view string, a string, b string, n int")
    got = topics.strong_edges(df, ["view"]).collect()
    assert len(got) < len(rows) and {x for r in got for x in (r["a"], r["b"])} == {f"x{i}" for i in range(8)}
    assert topics.strong_edges(df.limit(3), ["view"]).count() == 3


def test_one_algorithm_for_every_size(spark):
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample([f"v{i:02d}" for i in range(40)], 2))) for _ in range(90)})
    whole = communities.greedy_modularity(pairs, len(pairs))
    for least in (1, 1_000):
        assert {r["id"]: r["community"] for r in communities.detect(edges(spark, pairs), component_edges=least).collect()} == whole


@pytest.mark.parametrize("seed", range(20))
def test_modularity_against_all_pairs(seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample([f"v{i:02d}" for i in range(25)], 2))) for _ in range(60)})
    group, m = {x: {x} for p in pairs for x in p}, len(pairs)
    degree = {x: sum(x in p for p in pairs) for x in group}
    while True:
        sums = {g: sum(degree[x] for x in xs) for g, xs in group.items()}
        of = {x: g for g, xs in group.items() for x in xs}
        between = {}
        for a, b in pairs:
            k = tuple(sorted((of[a], of[b])))
            between[k] = between.get(k, 0) + 1
        best = min(((sums[a] * sums[b] - 2 * m * n, a, b) for (a, b), n in between.items() if a != b), default=(0,))
        if best[0] >= 0:
            break
        group[best[1]] |= group.pop(best[2])
    assert communities.greedy_modularity(pairs, m) == of


def test_communities_in_rounds_against_greedy(spark):
    import random

    from loamgraph.operators import communities

    rng = random.Random(5)
    graphs = {
        "triangle and edge": [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2")],
        "two stars": [(f"{s}00", f"{s}{i:02d}") for s in "xy" for i in range(1, 15)] + [("x03", "y05")],
        "ring": [(f"r{i:02d}", f"r{(i + 1) % 24:02d}") for i in range(24)],
        "groups": sorted({tuple(sorted(rng.sample(range(g * 8, g * 8 + 8), 2))) for g in range(6) for _ in range(18)} | {tuple(sorted((rng.randrange(48), rng.randrange(48)))) for _ in range(20)}),
    }
    rows = [(f"{k}:{min(str(a), str(b))}", f"{k}:{max(str(a), str(b))}") for k, es in graphs.items() for a, b in es if a != b]
    e = spark.createDataFrame(sorted(set(rows)), "a string, b string")
    many = communities.detect_in_rounds(e)
    got = {r["id"]: r["community"] for r in many.collect()}
    exact = communities.detect(e)
    assert set(got) == {r["id"] for r in exact.collect()} and all(got[c] == c and c == min(i for i in got if got[i] == c) for c in set(got.values()))
    assert all(i.split(":")[0] == c.split(":")[0] for i, c in got.items())
    assert len({c for i, c in got.items() if i.startswith("triangle")}) == 2
    stars = [c for i, c in got.items() if i.startswith("two")]
    assert len(set(stars)) >= 2 and max(stars.count(c) for c in stars) < 28
    assert communities.modularity(many, e) >= 0.95 * communities.modularity(exact, e) > 0.5
    assert communities.detect_in_rounds(e.limit(0)).isEmpty()
    parts = communities.hierarchy(e, split_over=10, in_rounds=True)
    assert parts.count() == len(got)


def test_ranks_within_components_are_those_of_the_iteration(spark, monkeypatch):
    monkeypatch.setattr(graph, "RANKED_A_TASK", 40)
    monkeypatch.setattr(graph, "RANKED_AT_ONCE", 30)
    pairs = [("a", "b"), ("b", "c"), ("b", "d"), ("d", "e"), ("a", "e"), ("p", "q"), ("q", "r"), ("x", "y")]
    edges = spark.createDataFrame(pairs, "a string, b string")
    seeds = spark.createDataFrame([("g", "a"), ("g", "p"), ("g", "alone"), ("h", "e"), ("h", "a"), ("i", "c"), ("j", "alone")], "grp string, id string")
    want = {(r["grp"], r["id"]): r["rank"] for r in graph.personalized_pagerank(edges, seeds, iterations=7).collect()}
    asked = spark.createDataFrame([(g, i) for g in "ghij" for i in "abcdepqrxy"], "grp string, id string")
    ranks = graph.component_ranks(edges, seeds, asked, iterations=7)
    got = {(r["grp"], r["id"]): r["rank"] for r in ranks.collect()}
    assert got.keys() == {k for k in want if k[1] != "alone"} and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    listed = spark.createDataFrame([(i,) for i in "abdeqrx"], "id string")
    out = spark.createDataFrame([("g", "a"), ("h", "b")], "grp string, id string")
    top = {(r["grp"], r["id"]) for r in graph.component_ranks(edges, seeds, best=2, listed=listed, left_out=out, iterations=7).collect()}
    open_ = {k: v for k, v in got.items() if k[1] in "abdeqrx" and k not in {("g", "a"), ("h", "b")}}
    near = lambda k: [v for o, v in open_.items() if o[0] == k[0] and (o[1] < "p") == (k[1] < "p")]
    assert top == {k for k, v in open_.items() if sum(o > v + 1e-11 for o in near(k)) < 2}
