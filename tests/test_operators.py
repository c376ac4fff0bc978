"""Operators on small inputs with results known by hand."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions.hashing import trailing_zeros
from siltstone.operators import cluster, graph, itemsets, recommend, relational, similarity, sketch
from siltstone.plans import catalogue

BASKETS = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "b"), (3, "c"), (4, "a"), (4, "c"), (4, "c")]
WANTED = {("a",): 3, ("b",): 3, ("c",): 3, ("a", "b"): 2, ("a", "c"): 2, ("b", "c"): 2}
TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


@pytest.mark.parametrize("mine", [itemsets.frequent_itemsets, itemsets.vertical_itemsets, itemsets.fpgrowth_itemsets, itemsets.son_itemsets])
def test_itemsets(spark, mine):
    found = mine(spark.createDataFrame(BASKETS, "basket long, item string"), 2).collect()
    assert {tuple(r["itemset"]): r["support"] for r in found} == WANTED
    assert all(r["size"] == len(r["itemset"]) for r in found)


@pytest.mark.parametrize("mine", [itemsets.frequent_itemsets, itemsets.vertical_itemsets, itemsets.fpgrowth_itemsets, itemsets.son_itemsets])
def test_itemsets_of_nothing(spark, mine):
    assert mine(spark.createDataFrame([], "basket long, item string"), 2).count() == 0


def test_vertical_chunks(spark):
    rng = random.Random(5)
    rows = [(b, f"i{i}") for b in range(60) for i in range(6) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "basket long, item string")
    held = {b: {i for x, i in rows if x == b} for b, _ in rows}
    names = sorted({i for _, i in rows})
    want = {}
    for k in range(1, 7):
        for s in itertools.combinations(names, k):
            n = sum(set(s) <= h for h in held.values())
            if n >= 8:
                want[s] = n
    got = {tuple(r["itemset"]): r["support"] for r in itemsets.vertical_itemsets(df, 8, chunk=7).collect()}
    assert got == want


@pytest.mark.parametrize(("sent", "chunk"), [(10**6, 7), (10**6, 20_000), (0, 7)])
def test_chunks_by_bits(spark, monkeypatch, sent, chunk):
    """Mined and counted by bits: chunks that end inside batches, items that a chunk lacks, a row that occurs twice, all candidates sent or none. One row per candidate and task is shuffled, not one per basket."""
    monkeypatch.setattr(itemsets, "SENT", sent)
    rng = random.Random(9)
    held = {b: {f"i{i}" for i in range(8) if rng.random() < (0.6 if i < 5 else 0.1)} for b in range(90)}
    pairs = spark.createDataFrame([(b, i) for b, x in held.items() for i in x] * 2, "basket long, item string")
    names = sorted({i for x in held.values() for i in x})
    want = {s: n for k in range(1, 9) for s in itertools.combinations(names, k) if (n := sum(set(s) <= x for x in held.values())) >= 9}
    b = itemsets.baskets(pairs)
    candidates = itemsets.son_candidates(b, 9, chunk)
    assert want.keys() <= {tuple(r["itemset"]) for r in candidates.collect()}
    found = itemsets.son_itemsets(pairs, 9, candidates=candidates)
    assert {tuple(r["itemset"]): r["support"] for r in found.collect()} == want
    assert all(r["size"] == len(r["itemset"]) for r in found.collect())


def test_basket_filter_is_strict(spark):
    df = spark.createDataFrame(BASKETS, "basket long, item string")
    assert {r["basket"] for r in itemsets.baskets(df, 2).collect()} == {2}


def test_itemset_text():
    assert itemsets.report([("b",), ("a", "b"), ("a",)]) == "('a'),('b')\n\n('a', 'b')"


def test_betweenness_of_a_path(spark):
    path = edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    for found in (graph.edge_betweenness(path), graph.betweenness_by_joins(path), graph.edge_betweenness(path, bound=1)):
        assert {(r["a"], r["b"]): r["betweenness"] for r in found.collect()} == {("a", "b"): 3.0, ("b", "c"): 4.0, ("c", "d"): 3.0}


def test_communities_of_two_triangles(spark):
    df = edges(spark, TRIANGLES)
    found = {(r["a"], r["b"]): r["betweenness"] for r in graph.edge_betweenness(df).collect()}
    assert found[("c", "d")] == 9.0 == max(found.values())
    labels = graph.girvan_newman(df)
    spread = graph.girvan_newman(df, local_work=20)  # the whole graph by tasks, its triangles on the driver
    assert sorted(labels.collect()) == sorted(spread.collect())
    assert sorted(r["members"] for r in graph.communities(labels).collect()) == [["a", "b", "c"], ["d", "e", "f"]]
    assert {r["node"] for r in graph.vertices(df).collect()} == set("abcdef")
    assert {r["label"] for r in graph.connected(df).collect()} == {"a"}
    assert {r["node"]: r["degree"] for r in graph.degrees(df).collect()} == {"a": 2, "b": 2, "c": 3, "d": 3, "e": 2, "f": 2}


@pytest.mark.parametrize(("items", "least", "block", "dense"), [(14, 6, 2048, 1e-4), (14, 6, 4, 0), (40, 2, 4, 2)])
def test_graphs_with_copies(spark, monkeypatch, items, least, block, dense):
    """Nodes of one set as a class give what all nodes give, whether classes meet as blocks or by their items."""
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "DENSE", dense)
    monkeypatch.setattr(graph, "PART", 3)
    rng = random.Random(items + block)
    sets = [rng.sample(range(items), rng.choice((least - 1, least, least + 1, 7))) for _ in range(25)] + [[*range(least + 1)]]
    nodes = {i: set(sets[min(i, 25) if i < 32 else rng.randrange(26)]) for i in range(60)}
    pairs = spark.createDataFrame([(i, x) for i, held in nodes.items() for x in held] * 2 + [(99, None), (None, 1), (98, 1)], "node long, item long")
    want = sorted((a, b) for a in nodes for b in nodes if a < b and len(nodes[a] & nodes[b]) >= least)
    t = graph.twins(pairs, least)
    assert t.sizes.count() < len({x for e in want for x in e})
    assert sorted(map(tuple, graph.co_graph(pairs, least).collect())) == want
    plain = spark.createDataFrame(want, "a long, b long")
    by_node = lambda df: sorted(map(tuple, t.members.join(df, "c").drop("c", "n").collect()))
    assert sorted(t.members.select("node").collect()) == sorted(graph.vertices(plain).collect())
    assert by_node(graph.twin_degrees(t)) == sorted(map(tuple, graph.degrees(plain).collect()))
    assert by_node(graph.twin_components(t)) == sorted(map(tuple, graph.connected(plain).collect()))
    for rounds in (1, 4):
        assert sorted(graph.twin_label_propagation(t, rounds).collect()) == sorted(graph.label_propagation(plain, rounds).collect())
    q = graph.modularity(plain, graph.connected(plain)).first()["q"]
    assert graph.twin_modularity(t, graph.twin_components(t)).first()["q"] == pytest.approx(q, abs=1e-12)
    paths = sum(x.agg({"paths": "sum"}).first()[0] for x in graph.path_levels(plain))
    between = {(a, b): x for a, b, x in graph.edge_betweenness(plain).collect()}
    for bound in (1_000_000, 0):
        assert graph.twin_path_count(t, bound) == paths
        assert {(a, b): x for a, b, x in graph.expand(t, graph.twin_betweenness(t, bound)).collect()} == pytest.approx(between)


def test_graphs_without_edges(spark):
    t = graph.twins(spark.createDataFrame([(1, 2), (2, 3)], "node long, item long"), 2)
    assert not any(df.count() for df in (graph.co_graph(t.members.select("node", F.col("c").alias("item")), 1), graph.twin_degrees(t), graph.twin_components(t), graph.twin_label_propagation(t), graph.twin_betweenness(t), graph.twin_betweenness(t, 0)))
    assert graph.twin_path_count(t) == graph.twin_path_count(t, 0) == 0


def test_betweenness_of_random_graphs(spark):
    """Both forms against the shares of all shortest paths, found one by one."""
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample("abcdefghij", 2))) for _ in range(14)})
    next_to = {v: [a if b == v else b for a, b in pairs if v in (a, b)] for v in {x for p in pairs for x in p}}
    want = dict.fromkeys(pairs, 0.0)
    for s, t in itertools.combinations(sorted(next_to), 2):
        paths = [[s]]
        while paths and paths[0][-1] != t and not any(p[-1] == t for p in paths):
            paths = [[*p, w] for p in paths for w in next_to[p[-1]] if w not in p]
        paths = [p for p in paths if p[-1] == t]
        for p in paths:
            for e in itertools.pairwise(p):
                want[tuple(sorted(e))] += 1 / len(paths)
    df = edges(spark, pairs)
    for found in (graph.edge_betweenness(df), graph.betweenness_by_joins(df)):
        got = {(r["a"], r["b"]): r["betweenness"] for r in found.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[e], want[e]) for e in want)


def test_girvan_newman_against_its_definition(spark):
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample("abcdefgh", 2))) for _ in range(12)})
    left, best = set(pairs), None
    degree = {v: sum(v in p for p in pairs) for p in pairs for v in p}

    def groups():
        label = {v: v for v in degree}
        for _ in label:
            for a, b in left:
                label[a] = label[b] = min(label[a], label[b])
        return label

    while left:
        found = graph.edge_betweenness(edges(spark, sorted(left))).collect()
        left.remove(min(((-round(r["betweenness"], 9), (r["a"], r["b"])) for r in found))[1])
        label = groups()
        q = sum((tuple(sorted((i, j))) in pairs) - degree[i] * degree[j] / (2 * len(pairs)) for i in label for j in label if i != j and label[i] == label[j])
        if best is None or q > best[0] + 1e-9:
            best = (q, label)
    assert {r["node"]: r["label"] for r in graph.girvan_newman(edges(spark, pairs)).collect()} == best[1]


def test_girvan_newman_in_tables(spark):
    df = edges(spark, [("a", "b"), ("c", "d")])
    assert sorted(graph.girvan_newman(df).collect()) == sorted(graph.girvan_newman(df, bound=1).collect())
    assert graph.girvan_newman(df.limit(0)).count() == 0


def test_modularity(spark):
    df = edges(spark, TRIANGLES)
    labels = spark.createDataFrame([(x, "l" if x < "d" else "r") for x in "abcdef"], "node string, label string")
    k, m = {"a": 2, "b": 2, "c": 3, "d": 3, "e": 2, "f": 2}, 7
    has = {frozenset(e) for e in TRIANGLES}
    want = sum((frozenset((x, y)) in has) - k[x] * k[y] / (2 * m) for x in k for y in k if x != y and (x < "d") == (y < "d")) / (2 * m)
    assert graph.modularity(df, labels).first()["q"] == pytest.approx(want)


def test_pearson(spark):
    rows = [("i", u, float(u)) for u in (1, 2, 3)] + [("j", u, 2.0 * u) for u in (1, 2, 3)] + [("k", u, 5.0) for u in (1, 2)]
    found = recommend.pearson(spark.createDataFrame(rows, "k string, other long, stars double")).collect()
    assert [(r["a"], r["b"], round(r["sim"], 9)) for r in found] == [("i", "j", 1.0)]


def test_symmetric_forms_agree(spark):
    model = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9), (2, 3, 0.1)], "a long, b long, sim double")
    lists = {r["k"]: [(x["o"], -x["s"]) for x in r["neighbours"]] for r in recommend.symmetric_full_outer(model).collect()}
    assert lists == {1: [(3, 0.9), (2, 0.5)], 2: [(1, 0.5), (3, 0.1)], 3: [(1, 0.9), (2, 0.1)]}
    assert recommend.symmetric(model).count() == 6


def test_numbered(spark):
    values = random.Random(2).sample(range(10**6), 500)
    df = spark.createDataFrame([(v,) for v in values * 2], "v long")
    assert [(r["v"], r["x"]) for r in similarity.numbered(df, "v").orderBy("v").collect()] == [(v, i) for i, v in enumerate(sorted(values))]
    assert similarity.numbered(df.limit(0), "v").count() == 0


def test_exact_pairs(spark):
    sets = {1: {1, 2, 3}, 2: {2, 3, 4}, 3: {9}, 4: {1, 2, 3}}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s] + [(1, 1)], "id long, x long")
    got = {(r["a"], r["b"]): r["sim"] for r in similarity.exact_pairs(df, 0.5).collect()}
    assert got == {(1, 2): 0.5, (1, 4): 1.0, (2, 4): 0.5}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    assert {(r["a"], r["b"]) for r in similarity.jaccard(pairs, df, 0.6).collect()} == {(1, 4)}


def test_signatures(spark):
    rng = random.Random(8)
    sets = {i: {rng.randrange(5000) for _ in range(n)} for i, n in enumerate((1, 3, 40, 2500, 7))}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s] + [(1, None), (9, None)], "id long, x long").repartition(3)
    want = {(i, k): min(((1 + (k * 7919 + 17) % 10007) * x + (k * 104729 + 31) % 10009) % 4999 for x in s) for i, s in sets.items() for k in range(60)}
    assert {(r["id"], r["i"]): r["h"] for r in similarity.signatures(df, 60, 4999).collect()} == want
    assert similarity.signatures(df.limit(0), 60, 4999).count() == 0


def test_minhash_recall(spark):
    """The registered number of hashes finds pairs just above the least similarity, and those found have their exact one."""
    rng = random.Random(6)
    rows = []
    for k in range(60):
        common = rng.sample(range(4999), 6)
        rows += [(2 * k + side, x) for side in (0, 1) for x in {*common, *rng.sample(range(4999), 38)}]
    df = spark.createDataFrame(rows, "id long, x long").persist()
    exact = {(r["a"], r["b"]): r["sim"] for r in similarity.exact_pairs(df, 0.05).collect()}
    found = {(r["a"], r["b"]): r["sim"] for r in similarity.similar_pairs(df, 4999, catalogue.HASHES).collect()}
    assert len(exact) >= 60 and all(exact[p] == s for p, s in found.items())
    assert len(found) > 0.85 * len(exact)


def test_bloom(spark):
    cities = spark.createDataFrame([("Lyon",), ("Graz",), ("",), (None,), ("Graz",)], "city string")
    bits, m = sketch.bloom_build(cities, "city")
    assert m == 100 and 5 <= bits.count() <= 10
    assert {r["k"]: r["hit"] for r in sketch.bloom_probe(cities, "city", bits, m).collect()} == {"Lyon": 1, "Graz": 1, "": 0}


def test_bloom_answers_every_row(spark):
    rows = spark.createDataFrame([(3, "Lyon"), (1, "Lyon"), (2, None), (4, "")], "n long, city string")
    bits, m = sketch.bloom_build(spark.createDataFrame([("Lyon",)], "city string"), "city")
    assert sorted(map(tuple, sketch.bloom_probe_rows(rows, "n", "city", bits, m).collect())) == [(1, 1), (2, 0), (3, 1), (4, 0)]


def test_long_keys_and_ids(spark):
    """Keys of a hundred thousand characters, and ids beyond 2^32."""
    from siltstone.functions.hashing import text_mod

    key = "añ" * 50_000
    assert spark.createDataFrame([(key,)], "k string").select(text_mod(F.col("k"), 1009)).first()[0] == int.from_bytes(key.encode(), "big") % 1009
    rows = spark.range(2**62, 2**62 + 500).select("id")
    assert sketch.reservoir(rows, "id").count() == 100


def test_jaccard_gate(spark):
    ratings = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 9)], "k string, other long")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    assert [tuple(r) for r in recommend.jaccard_gate(pairs, ratings).collect()] == [("a", "b")]


@pytest.mark.parametrize("far", [0, 2**40])
def test_meeting(spark, monkeypatch, far):
    """A row for each common element and pair, with ids beyond four bytes, lists in parts, repeated rows, and no shuffle per pair."""
    monkeypatch.setattr(similarity, "TAIL", 3)
    rng = random.Random(7)
    rows = [(rng.randrange(30) + far * (i % 2), rng.randrange(12), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows + [(None, 1, 0.0), (1, None, 0.0)], "id long, x long, s double")
    want = sorted((a, b, u, v) for a, x, u in rows for b, y, v in rows if a < b and x == y)
    assert sorted(map(tuple, similarity.meeting(df, "s").select("a", "b", "sa", "sb").collect())) == want
    met = similarity.meeting(df.select("id", "x"))
    assert sorted(map(tuple, met.collect())) == sorted((a, b) for a, b, _, _ in want)
    counted = met.groupBy("a", "b").count()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    sets = df.select("id", "x").where("id is not null and x is not null").distinct()
    every = {(r["a"], r["b"]): r["sim"] for r in similarity.exact_pairs(sets, 1e-3).collect()}
    held = {i: {x for j, x, _ in rows if i == j} for i, _, _ in rows}
    assert every == pytest.approx({(a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a in held for b in held if a < b and held[a] & held[b]})
    near = spark.createDataFrame(list(every), "a long, b long")
    got = sorted(map(tuple, similarity.share_band(near, sets, 24, 12, 2).collect()))
    assert got == sorted(set(map(tuple, similarity.candidates(similarity.bands(sets, 24, 12)).collect())) & set(every))


@pytest.mark.parametrize(("kind", "hashes", "modulus", "rows", "keys"), [("long", 60, 200, 2, 10**6), ("string", 61, 200, 3, 10**6), ("long", 60, 200, 2, 100), ("long", 24, 2**33, 2, 50)])
def test_bands_are_packed(spark, monkeypatch, kind, hashes, modulus, rows, keys):
    """Pairs by packed bands are those of the join, whether tasks hold whole bands or parts; no row per band is shuffled. Both orders of similar_pairs() agree."""
    rng = random.Random(hashes + keys)
    held = [(i, x) for i in range(200) for x in rng.sample(range(200), rng.choice((1, 3, 10, 90)))] + [(None, 1), (5, None)] + [(1000 + i, 7) for i in range(40)] * 2
    df = spark.createDataFrame([(i if i is None or kind == "long" else str(i), x) for i, x in held], f"id {kind}, x long")
    monkeypatch.setattr(similarity, "KEYS", keys)
    want = sorted(map(tuple, similarity.candidates(similarity.bands(df, hashes, modulus, rows)).collect()))
    found = similarity.band_pairs(df, hashes, modulus, rows)
    assert sorted(map(tuple, found.collect())) == want
    assert "band" not in found._jdf.queryExecution().executedPlan().toString()
    every = sorted(map(tuple, similarity.jaccard(similarity.candidates(similarity.bands(df, hashes, modulus, rows)), df.where("id is not null and x is not null"), 0.05).collect()))
    for cheap in (0, 10**6):
        monkeypatch.setattr(similarity, "CHEAP", cheap)
        assert sorted(map(tuple, similarity.similar_pairs(df, modulus, hashes, rows).collect())) == every


def test_pearson_of_pairs(spark):
    rng = random.Random(1)
    rows = [(k, o, float(rng.randrange(1, 6))) for k in range(12) for o in range(30) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "k long, other long, stars double")
    every = {(r["a"], r["b"]): r["sim"] for r in recommend.pearson(df).collect()}
    asked = spark.createDataFrame([p for p in every if sum(p) % 2], "a long, b long")
    assert {(r["a"], r["b"]): r["sim"] for r in recommend.pearson(df, asked).collect()} == pytest.approx({p: s for p, s in every.items() if sum(p) % 2})


def test_trailing_zeros(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (8,), (1,)], "h long").select(trailing_zeros(F.col("h"))).collect()] == [1, 3, 0]


def test_weighted_estimate(spark):
    rows = [("w", f"city{i % 7}") for i in range(50)]
    plain = spark.createDataFrame(rows, "start string, k string")
    counted = plain.groupBy("start", "k").agg(F.count("*").alias("c"))
    assert sketch.fm_estimate(plain, ["start"], "k").collect() == sketch.fm_estimate(counted, ["start"], "k", "c").collect()


def test_keys_of_equal_sums(spark):
    """Keys that all hashes take alike are one row to hash, counted apart; null and empty keys count, and aren't hashed; a null group goes."""
    rows = [("w", "ad"), ("w", "ad"), ("w", "ad"), ("w", "bxb"), ("w", "cvc"), ("w", ""), ("w", None), ("v", ""), (None, "a")]
    df = spark.createDataFrame(rows, "start string, k string")
    sums = sketch.fm_sums(df.where("start = 'w'").groupBy("start", "k").agg(F.count("*").alias("n_rows")), ["start"]).collect()
    assert sorted((r["truth"], r["n_rows"], r["s"] is None) for r in sums) == [(1, 3, False), (2, 2, False), (2, 2, True)]
    found = {r["start"]: (r["truth"], r["estimate"]) for r in sketch.fm_estimate(df, ["start"], "k").collect()}
    zeros = lambda h: (h & -h).bit_length() - 1 if h else 1
    es = []
    for i in range(100):
        r = [zeros(sum(ord(c) * (i + j) for j, c in enumerate(k)) % 4) for k in ("ad", "bxb", "cvc")]
        es.append(2 ** (max(r) - min(r)))
    assert found == {"w": (5, -(-sum(sorted(es)[1:-1]) // 98)), "v": (1, None)}
    assert sketch.fm_estimate(df.where("false"), [], "k").collect()[0][0] == 0


def test_top_tags_keep_ties(spark):
    tags = spark.createDataFrame([(t,) for t in "aaabbbccdde"], "t string")
    assert {(r["tag"], r["n"]) for r in sketch.top_tags(tags, "t", 2).collect()} == {("a", 3), ("b", 3), ("c", 2), ("d", 2)}


def test_statistics_of_one_cluster(spark):
    stats = cluster.statistics(spark.createDataFrame([(1, [0.0]), (1, [2.0])], "c long, v array<double>"))
    assert [tuple(r) for r in stats.select("n", "s", "ss").collect()] == [(2, 2.0, 4.0)]
    assert [tuple(r) for r in cluster.vectors(stats).select("centre", "sd").collect()] == [([1.0], [1.0])]


def plain_kmeans(points, k):
    """points {id: v} -> {id: cluster}, by the definition."""
    if not points:
        return {}
    ids = sorted(points)
    seeds = [points[ids[0]]]
    while len(seeds) < k:
        far = max(ids, key=lambda i: (min(math.dist(points[i], s) for s in seeds), -i))
        seeds.append(points[far])
    near = lambda v: min(range(k), key=lambda c: (math.dist(v, seeds[c]), c))
    of = dict.fromkeys(ids, -1)
    for _ in range(10):
        new = {i: near(points[i]) for i in ids}
        changed = sum(new[i] != of[i] for i in ids)
        of = new
        for c in set(of.values()):
            own = [points[i] for i in ids if of[i] == c]
            seeds[c] = [sum(x) / len(own) for x in zip(*own, strict=True)]
        if changed <= max(len(ids) / 50, 100):
            break
    return {i: near(points[i]) for i in ids}


def plain_bfr(rounds, k, sampled):
    """Rounds {id: v} -> ({id: cluster}, report), point by point."""
    stats = lambda vs: [len(vs), [sum(x) for x in zip(*vs, strict=True)], [sum(y * y for y in x) for x in zip(*vs, strict=True)]]

    def near(v, clusters):
        best, at = 2 * math.sqrt(len(v)), -1
        for i, (n, s, ss) in enumerate(clusters):
            if n > 1:
                d = math.sqrt(sum((x - y / n) ** 2 / max(1e-10, z / n - (y / n) ** 2) for x, y, z in zip(v, s, ss, strict=True)))
                if d < best:
                    best, at = d, i
        return at

    def put(v, to):
        to[0], to[1], to[2] = to[0] + 1, [a + b for a, b in zip(to[1], v, strict=True)], [a + b * b for a, b in zip(to[2], v, strict=True)]

    def groups(points, size):
        of = plain_kmeans(points, size)
        return [[i for i in of if of[i] == c] for c in sorted(set(of.values()))]

    ds, cs, rs, where, report, seen = [], [], {}, {}, [], 0
    for points in rounds:
        seen += len(points)
        if not report:
            for g in groups({i: v for i, v in points.items() if i in sampled}, k):
                where |= dict.fromkeys(g, ("ds", len(ds)))
                ds.append(stats([points[i] for i in g]))
            for g in groups({i: v for i, v in points.items() if i not in sampled}, 5 * k):
                if len(g) > 1:
                    where |= dict.fromkeys(g, ("cs", len(cs)))
                    cs.append(stats([points[i] for i in g]))
                else:
                    rs[g[0]] = points[g[0]]
        else:
            for i, v in sorted(points.items()):
                for kind, clusters in (("ds", ds), ("cs", cs)):
                    if (at := near(v, clusters)) >= 0:
                        put(v, clusters[at])
                        where[i] = (kind, at)
                        break
                else:
                    rs[i] = v
            if len(rs) > 50 * k and len(rs) > seen / 100:
                left = {}
                for g in groups(rs, 5 * k):
                    if len(g) == 1:
                        left[g[0]] = rs[g[0]]
                        continue
                    n, s, ss = stats([rs[i] for i in g])
                    at = near([x / n for x in s], cs)
                    if at < 0:
                        at = len(cs)
                        cs.append([n, s, ss])
                    else:
                        for i in g:
                            put(rs[i], cs[at])
                    where |= dict.fromkeys(g, ("cs", at))
                rs = left
        report.append((len(report) + 1, len(ds), sum(x[0] for x in ds), len(cs), sum(x[0] for x in cs), len(rs)))
    names, extra = {}, len(ds)
    for i, (n, s, _) in enumerate(cs):
        at = near([x / n for x in s], ds)
        names[i], extra = (at, extra) if at >= 0 else (extra, extra + 1)
    return {i: c if kind == "ds" else names[c] for i, (kind, c) in where.items()} | dict.fromkeys(rs, -1), report


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_bfr_against_its_definition(spark, spread):
    rng = random.Random(3)
    rows = [(i, [10.0 * (i % 3) + rng.gauss(0, spread), rng.gauss(0, spread), float(rng.random() < 0.1) * rng.gauss(0, 40)]) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    sampled = {r["id"] for r in df.where(F.pmod(F.xxhash64("id"), F.lit(10)) == 0).collect()}
    b = cluster.Bfr(2, sequential=True)
    for k in range(3):
        b.round(df.where(F.col("id") % 3 == k))
    want, report = plain_bfr([{i: v for i, v in rows if i % 3 == k} for k in range(3)], 2, sampled)
    assert b.report == report
    assert {r["id"]: r["c"] for r in b.result().collect()} == want
    assert any(r[5] for r in report)


def test_bfr(spark):
    rng = random.Random(3)
    rows = [(i, [10.0 * (i % 3) + rng.gauss(0, 0.3), rng.gauss(0, 0.3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    b = cluster.Bfr(3)
    for k in range(2):
        b.round(df.where((F.col("id") >= 300 * k) & (F.col("id") < 300 * (k + 1))))
    found = {r["id"]: r["c"] for r in b.result().collect()}
    assert sorted(found) == list(range(600))
    assert sum(r for r in (b.report[-1][2], b.report[-1][4], b.report[-1][5])) == 600
    of = [max(set(x), key=x.count) for x in ([found[i] for i in range(c, 600, 3)] for c in range(3))]
    assert len(set(of)) == 3 and sum(found[i] == of[i % 3] for i in range(600)) > 540


def test_maximin_and_kmeans(spark):
    df = spark.createDataFrame([(i, [float(100 * (i % 2) + i / 100)]) for i in range(20)], "id long, v array<double>")
    assert cluster.maximin(df, 2) == [[0.0], [100.19]]
    found = cluster.kmeans(df, 2).collect()
    groups = {r["c"]: set() for r in found}
    for r in found:
        groups[r["c"]].add(r["id"] % 2)
    assert sorted(map(sorted, groups.values())) == [[0], [1]]
    assert math.isclose(df.limit(1).select(cluster.distance(F.col("v"), F.array(F.lit(3.0)))).first()[0], 3.0)


def test_exploration(spark):
    words = spark.createDataFrame([("The cat, the dog! (cat)",), (None,), ("",)], "text string")
    assert [tuple(r) for r in relational.top_words(words, "text", ["the"], 5).collect()] == [("cat", 2), ("dog", 1)]
    rows = spark.createDataFrame([("b1", 4.0), ("b1", 2.0), ("b2", 5.0)], "item string, stars double")
    items = spark.createDataFrame([("b1", "X, Y"), ("b2", "Y"), ("b3", None)], "item string, categories string")
    assert [tuple(r) for r in relational.category_avg(rows, items, 2).collect()] == [("Y", 11 / 3), ("X", 3.0)]


def test_maximin_sends_a_row_per_task(spark):
    """Seeds as by definition, equal vectors under several ids among the points, in one pass without a nested transform per seed."""
    rng = random.Random(2)
    vs = [[rng.random() * 9 for _ in range(7)] for _ in range(40)]
    rows = [(i, vs[i % 40]) for i in range(120)]
    seeds = [rows[0][1]]
    while len(seeds) < 9:
        seeds.append(max(rows, key=lambda r: (min(math.sqrt(sum((x - y) ** 2 for x, y in zip(r[1], s, strict=True))) for s in seeds), -r[0]))[1])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    assert cluster.maximin(df, 9) == seeds
    assert cluster.maximin(df.limit(0), 3) == []


def test_rounds_read_their_own_files(spark, tmp_path):
    from siltstone.sources import io

    for name in ("chunk=1", "chunk=0", "_other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.txt").write_text(f"{name[-1:] if name[-1] in '01' else 9},1.0")
    found = io.parts(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in found] == ["chunk=0", "chunk=1"]
    assert [tuple(r) for r in io.vector_chunks(spark, found[1], 2).collect()] == [(1, [1.0], "chunk=1")]
