import random

import pytest
from pyspark.sql import functions as F

from gridtrack.operators import chains, intervals, links, paths
from gridtrack.operators.components import components
from gridtrack.operators.elements import find_elements
from gridtrack.operators.unionfind import smallest_members
from tests.grids import MICRO, key, micro_raster, random_graph, searched_paths

import numpy as np


def test_classes_of_index_pairs():
    got = smallest_members(7, np.array([5, 3, 6]), np.array([3, 1, 6]))
    assert got.tolist() == [0, 1, 2, 1, 4, 1, 6]


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_components_equal_union_of_sets(spark, monkeypatch, block):
    """A long chain, a hub and scattered pairs, in two scopes that share node numbers."""
    rnd = random.Random(5)
    edges = [(0, i, i + 1) for i in range(0, 60)] + [(0, 1000, 1000 + i) for i in range(1, 80)]
    edges += [(1, a, b) for a, b in ((rnd.randrange(120), rnd.randrange(120)) for _ in range(90)) if a != b]
    rnd.shuffle(edges)
    if block == 7:
        monkeypatch.setattr("gridtrack.operators.components._contract", _uncontracted)
    table = spark.createDataFrame(edges, "scope bigint, a bigint, b bigint").repartition(6)
    got = {(x.scope, x.node): x.root for x in components(table).collect()}
    group = {}
    for scope, a, b in edges:
        merged = group.get((scope, a), {a}) | group.get((scope, b), {b})
        for node in merged:
            group[scope, node] = merged
    assert got == {(scope, node): min(members) for (scope, node), members in group.items()}


def _uncontracted(edges):
    """Edges only turned so that the root is the smaller end: the rounds must do all the work."""
    scope, a, b = edges.columns
    return edges.select(F.col(scope).alias("scope"), F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))


def graph_tables(spark, graphs):
    """Many random graphs as one edge table; each keeps to its own element numbers."""
    rows = []
    for i, graph in enumerate(graphs):
        shift = i * 100
        rows += [(a + shift, b + shift, w) for a, out in graph.items() for b, w in out]
    return spark.createDataFrame(rows, "src bigint, dst bigint, weight int")


def expected_paths(graphs, rule):
    edges, roots = set(), set()
    for i, graph in enumerate(graphs):
        shift = i * 100
        linked = {n for a, out in graph.items() for b, _ in out for n in (a, b)}
        kept, found = searched_paths({n: graph[n] for n in linked}, 3, rule)
        edges |= {(a + shift, b + shift, w) for a, b, w in kept}
        roots |= {(a + shift, b + shift, n, d) for a, b, n, d in found}
    return edges, roots


@pytest.mark.parametrize("rule", ["last_within_length", "min_distance"])
@pytest.mark.parametrize("frames_per_round", [64, 3, 2, 1])
def test_pruning_equals_a_search_from_every_root(spark, rule, frames_per_round):
    graphs = [random_graph(random.Random(seed)) for seed in range(60)]
    config = MICRO.with_options(path_rule=rule, frames_per_round=frames_per_round)
    got = paths.prune(graph_tables(spark, graphs), config)
    edges, roots = expected_paths(graphs, rule)
    assert {tuple(x) for x in got.edges.collect()} == edges
    assert {tuple(x) for x in got.roots.collect()} == roots


@pytest.mark.parametrize("rule", ["last_within_length", "min_distance"])
def test_plan_kernel_on_many_graphs(rule):
    for seed in range(800):
        graph = random_graph(random.Random(seed))
        links = sorted((a, b, w) for a, out in graph.items() for b, w in out)
        plans, hops = intervals.plan(tuple(np.array([x[i] for x in links], dtype=np.int64) for i in range(3)), intervals.Plans.none(), rule)
        own = plans.needs(rule)
        deep = plans.depth >= 3
        taken, beyond = intervals.follow(intervals.Hops(hops), np.column_stack([plans.node, own])[deep])
        kept = sorted({(int(a), int(b), int(w)) for a, _, b, w, _ in hops[taken]})
        target = np.where(own == intervals.FALLBACK, plans.end, plans.light_end)
        distance = np.where(own == intervals.FALLBACK, plans.distance, plans.depth - 1 + own)
        roots = [tuple(map(int, x)) for x in zip(plans.node[deep], target[deep], plans.depth[deep], distance[deep])]
        assert (kept, roots) == searched_paths(graph, 3, rule)


def long_graph(seed, frames):
    """One component over many frames, in which many paths end early."""
    rnd = random.Random(seed)
    graph = {}
    for f in range(1, frames):
        for k in range(1, 4):
            graph[key(f, k)] = [(key(f + 1, j), rnd.choice([1, 1, 1, 2, 3])) for j in range(1, 4) if k == j == 1 or rnd.random() < 0.3]
    graph |= {key(frames, k): [] for k in range(1, 4)}
    return graph


@pytest.mark.parametrize("rule", ["last_within_length", "min_distance"])
def test_long_series_in_short_intervals(spark, rule):
    graphs = [long_graph(seed, 41 + seed) for seed in range(4)]
    config = MICRO.with_options(path_rule=rule, frames_per_round=3)
    table = graph_tables(spark, graphs)
    got = paths.prune(table, config)
    edges, roots = expected_paths(graphs, rule)
    assert {tuple(x) for x in got.edges.collect()} == edges
    assert {tuple(x) for x in got.roots.collect()} == roots
    listed = {}
    for x in paths.root_paths(table, config).collect():
        listed.setdefault(x.root, {})[x.step] = x.node
    assert {root: (steps[len(steps)], len(steps)) for root, steps in listed.items()} == {r: (end, n) for r, end, n, _ in roots}
    assert all((steps[i], steps[i + 1]) in {(a, b) for a, b, _ in edges} for steps in listed.values() for i in range(1, len(steps)))


def test_rounds_grow_with_the_logarithm_of_the_series(spark, monkeypatch):
    made = []
    keep = paths.stage
    monkeypatch.setattr(paths, "stage", lambda df, name: made.append(name) or keep(df, name))
    rounds = {}
    for frames in (16, 256, 4096):
        made.clear()
        chain = spark.range(1, frames).selectExpr("shiftleft(id, 32) | 1 AS src", "shiftleft(id + 1, 32) | 1 AS dst", "1 AS weight")
        clusters = paths.prune(chain, MICRO.with_options(frames_per_round=16))
        assert clusters.edges.count() == frames - 1
        assert clusters.roots.agg(F.max("n_nodes")).first()[0] == frames
        rounds[frames] = sum(name.startswith("interval-") and name != "interval-links" for name in made)
    # four tables for each doubling: summaries and jumps up, ends and states down
    assert rounds == {16: 0, 256: 16, 4096: 32}


@pytest.mark.parametrize("frames_per_round", [16, 1])
def test_path_choice_and_listing(spark, frames_per_round):
    a, b, c1, c2 = key(1, 1), key(2, 1), key(3, 1), key(3, 2)
    config = MICRO.with_options(frames_per_round=frames_per_round)

    def listed(weights, **options):
        table = spark.createDataFrame(
            [(a, b, weights[0]), (b, c1, weights[1]), (b, c2, weights[2])], "src bigint, dst bigint, weight int")
        rows = paths.root_paths(table, config.with_options(**options)).orderBy("root", "step").collect()
        return [(x.root, x.node) for x in rows]

    assert listed((1, 1, 2)) == [(a, a), (a, b), (a, c2)]
    assert listed((1, 1, 2), path_rule="min_distance") == [(a, a), (a, b), (a, c1)]
    assert listed((3, 3, 3)) == [(a, a), (a, b), (a, c1)]


def test_behaviours_and_chains(spark):
    a, b, c, d, e, f = (key(i, 1) for i in range(1, 7))
    b2, d2 = key(2, 2), key(4, 2)
    table = spark.createDataFrame(
        [(a, b, 1), (b, c, 1), (b2, c, 1), (c, d, 1), (c, d2, 1), (d, e, 1), (e, f, 1)], "src bigint, dst bigint, weight int")
    got = {x.node: x.behaviour for x in paths.behaviours(table).collect()}
    assert got == {a: "N", b: "N", b2: "N", c: "B", d: "N", d2: "N", e: "N", f: "N"}
    up = {x.node: (x.end, x.steps, x.n_links) for x in chains.chain_ends(table, chains.UP).collect()}
    assert up[f] == (c, 3, 2) and up[d2] == (c, 1, 2) and up[c] == (c, 0, 2) and up[b] == (a, 1, 0)
    starts = spark.createDataFrame([(f,), (a,)], "node bigint")
    members = chains.chain_members(table, starts, chains.UP).orderBy("start", "step").collect()
    assert [(x.start, x.step, x.node) for x in members] == [(f, 1, e), (f, 2, d), (f, 3, c)]
    down = chains.chain_members(table, starts, chains.DOWN).orderBy("start", "step").collect()
    assert [(x.start, x.step, x.node) for x in down] == [(a, 1, b), (a, 2, c)]


def test_links_use_box_pixels_and_isolated_elements_go(spark):
    block = [[220] * 4 + [0] * 4 for _ in range(4)] + [[0] * 8]
    shifted = [[0] + [220] * 4 + [0] * 3 for _ in range(4)] + [[0] * 8]
    far = [[0] * 8] * 4 + [[220] * 8]
    raster = micro_raster(spark, [block, shifted, far])
    found = find_elements(raster, MICRO)
    graph = links.build_graph(found.accepted, found.pixels, MICRO, raster)
    assert [(x.overlap_px, x.pct, x.area, x.weight) for x in graph.edges.collect()] == [(12, 0.75, 192.0, 3)]
    assert {x.id for x in graph.nodes.collect()} == {"F1CE1", "F2CE1"}
    counts = {x.frame: tuple(x)[1:] for x in links.frame_counts(found.accepted, graph.edges, raster.frames).collect()}
    assert counts == {2: (2, 1, 1, 1), 3: (1, 0, 0, 1)}


def test_gap_in_time_breaks_links_only_on_request(spark):
    block = [[220] * 6 for _ in range(3)]
    raster = micro_raster(spark, [block, block, block])
    late = raster.frames.withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, if(frame = 3, 5, 0))"))
    gappy = type(raster)(raster.pixels, raster.rows, raster.cols, late)
    found = find_elements(gappy, MICRO)

    def linked(config):
        return {x.dst >> 32 for x in links.build_graph(found.accepted, found.pixels, config, gappy).edges.collect()}

    assert linked(MICRO) == {2, 3}
    assert linked(MICRO.with_options(require_contiguous_time=True)) == {2}
