import random

from pyspark.sql import functions as F

from gridtrack.operators import candidates, systems
from gridtrack.operators.elements import find_elements
from gridtrack.operators.candidates import assign_candidates
from gridtrack.operators.lifecycle import SystemView, Walk
from gridtrack.plans import pipeline
from tests.grids import MICRO, key, micro_raster, random_graph

CONFIG = MICRO.with_options(outer_area=100, inner_area=40, minimum_duration=2, maximum_duration=24)
SMALL, PLAIN, COLD = (10, 0, 0), (200, 150, 10), (200, 150, 60)


def view(nodes, edges):
    """``nodes``: {node: (area, outer part, inner part)}."""
    parents, children = {}, {}
    for a, b in sorted(edges):
        children.setdefault(a, []).append(b)
        parents.setdefault(b, []).append(a)
    return SystemView(*({n: v[i] for n, v in nodes.items()} for i in range(3)), parents, children)


def chain(*kinds):
    nodes = {key(i, 1): kind for i, kind in enumerate(kinds, 1)}
    ids = sorted(nodes)
    return view(nodes, list(zip(ids, ids[1:])))


def visiting_order(v):
    return list(Walk(v, CONFIG).run().placed)


def test_visiting_order_takes_new_parents_first():
    a, b, c, d, e = key(1, 1), key(1, 2), key(2, 1), key(2, 2), key(3, 1)
    v = view(dict.fromkeys((a, b, c, d, e), SMALL), [(a, c), (b, c), (b, d), (c, e)])
    assert visiting_order(v) == [a, c, b, d, e]


def test_children_of_a_node_with_a_new_parent_are_found_before_it():
    a, b, c, e, f = key(1, 1), key(1, 2), key(2, 1), key(3, 1), key(3, 2)
    v = view(dict.fromkeys((a, b, c, e, f), SMALL), [(a, c), (b, c), (c, e), (c, f)])
    assert visiting_order(v) == [a, c, b, f, e]


def test_stage_flags():
    walk = Walk(chain(SMALL, COLD, SMALL, PLAIN, (200, 50, 0)), CONFIG)
    got = [walk._flags(n) for n in sorted(walk.view.area)]
    assert got == [(False, False, "D"), (True, True, "M"), (False, False, "I"), (True, False, "I"), (False, False, "I")]


def placed(v):
    """Per candidate: core and body frames in visiting order, shield count, duration, top frame."""
    out = {}
    for node, spot in Walk(v, CONFIG).run().placed.items():
        if spot.candidate:
            core, body, _ = out.setdefault(spot.candidate.number, ([], [], spot.candidate))
            body.append((node >> 32, spot.stage))
            if spot.core:
                core.append(node >> 32)
    return [(core, body, c.shield_count, c.duration, c.top_frame) for _, (core, body, c) in sorted(out.items())]


def test_core_run_is_one_candidate():
    assert placed(chain(COLD, COLD, COLD)) == [([1, 2, 3], [(1, "I"), (2, "M"), (3, "M")], 3, 3, 3)]


def test_nodes_after_the_top_frame_open_candidates():
    assert placed(chain(COLD, SMALL, SMALL)) == [
        ([1], [(1, "I")], 1, 1, 1), ([], [(2, "I"), (3, "I")], 0, 0, 0)]


def test_core_after_body_counts_but_keeps_the_shield_count():
    assert placed(chain(SMALL, PLAIN, COLD, COLD)) == [
        ([3, 4], [(1, "I"), (2, "I"), (3, "M"), (4, "M")], 2, 2, 4)]


def test_parent_found_late_joins_the_body_of_its_child():
    a, b, c = key(1, 1), key(1, 2), key(2, 1)
    late_small = view({a: COLD, b: SMALL, c: COLD}, [(a, c), (b, c)])
    assert placed(late_small) == [([1, 2], [(1, "I"), (2, "M"), (1, "I")], 2, 2, 2)]
    late_plain = view({a: SMALL, b: PLAIN, c: COLD}, [(a, c), (b, c)])
    assert placed(late_plain) == [([2], [(1, "I"), (2, "M")], 1, 1, 2)], "a shield without core is dropped here"
    late_core = view({a: SMALL, b: COLD, c: COLD}, [(a, c), (b, c)])
    assert placed(late_core) == [([2, 1], [(1, "I"), (2, "M"), (1, "M")], 0, 1, 2)]


def test_second_core_of_a_frame_does_not_lengthen_the_candidate():
    a, c, d = key(1, 1), key(2, 1), key(2, 2)
    assert placed(view({a: COLD, c: COLD, d: COLD}, [(a, c), (a, d)])) == [
        ([1, 2, 2], [(1, "I"), (2, "M"), (2, "M")], 2, 2, 2)]


def tables(spark, systems_):
    """Node and link tables of ``(nodes, edges)`` systems, with 0.9 as every eccentricity."""
    nodes = [(min(n), node, *map(float, v)) for n, _ in systems_ for node, v in n.items()]
    links = [(min(n), a, b) for n, edges in systems_ for a, b in edges]
    return (
        spark.createDataFrame(nodes, "component bigint, node bigint, area double, outer_part double, inner_part double")
        .withColumn("eccentricity", F.lit(0.9)),
        spark.createDataFrame(links, "component bigint, src bigint, dst bigint"))


def detected(spark, systems_, config=CONFIG, full_links=None):
    """Stages and complexes as ``{node: stage}`` and sorted member lists."""
    nodes, links = tables(spark, systems_)
    spots, books = assign_candidates(nodes, links, config)
    joined = systems.join_candidates(spots, books, links if full_links is None else full_links, config)
    stages = {x.node: x.stage for x in systems.member_stages(nodes, spots, joined).collect()}
    complexes = {}
    for x in systems.confirmed_complexes(nodes, spots, joined, config).collect():
        complexes.setdefault(x.feature_id, []).append(x.node)
    return stages, sorted(map(sorted, complexes.values()))


def line(offset, *kinds):
    nodes = {key(i, offset): kind for i, kind in enumerate(kinds, 1)}
    ids = sorted(nodes)
    return nodes, list(zip(ids, ids[1:]))


def test_duration_gate(spark):
    cases = [line(1, COLD, COLD, COLD), line(2, COLD), line(3, PLAIN, PLAIN, PLAIN), line(4, SMALL, COLD, COLD, SMALL)]
    _, complexes = detected(spark, cases)
    assert complexes == [[key(i, 1) for i in (1, 2, 3)], [key(i, 4) for i in (1, 2, 3)]]
    assert detected(spark, cases, CONFIG.with_options(minimum_duration=3))[1] == [[key(i, 1) for i in (1, 2, 3)]]


def test_dropped_members_after_a_lasting_core_decay(spark):
    a, b, c, d = key(1, 1), key(1, 2), key(2, 1), key(2, 2)
    # d is a shield without core, met through b after c and its frame are already known elsewhere
    system = ({a: COLD, b: SMALL, c: COLD, d: PLAIN}, [(a, c), (b, c), (b, d)])
    stages, complexes = detected(spark, [system])
    assert stages[a] == "I" and stages[c] == "M" and len(complexes) == 1
    assert set(stages) >= {a, b, c}


def test_candidates_linked_in_the_full_graph_are_joined(spark):
    """Two cores apart in visiting order but linked end to start."""
    schema = "component bigint, node bigint, cand bigint, core boolean, stage string"
    n = [key(i, 1) for i in range(1, 5)]
    spots = spark.createDataFrame([(n[0], x, 1 if i < 2 else 2, True, "M") for i, x in enumerate(n)], schema)
    books = spark.createDataFrame([(n[0], 1, 2), (n[0], 2, 2)], "component bigint, cand bigint, duration bigint")
    edge = "src bigint, dst bigint"
    linked = spark.createDataFrame([(n[1], n[2])], edge)
    apart = spark.createDataFrame([(n[0], n[2])], edge)
    config = CONFIG.with_options(minimum_duration=3)
    got = systems.join_candidates(spots, books, linked, config).orderBy("cand").collect()
    assert [(x.cand, x.run, x.last_core) for x in got] == [(1, 1, n[3]), (2, 1, n[3])]
    assert systems.join_candidates(spots, books, apart, config).isEmpty()


def test_shape_gate_looks_at_the_largest_grown_member(spark):
    nodes, links = tables(spark, [line(1, COLD, COLD, (300, 150, 60))])
    nodes = nodes.withColumn("eccentricity", F.when(F.col("area") == 300, 0.2).otherwise(0.9))
    spots, books = assign_candidates(nodes, links, CONFIG)
    joined = systems.join_candidates(spots, books, links, CONFIG)
    assert systems.confirmed_complexes(nodes, spots, joined, CONFIG).isEmpty()
    relaxed = CONFIG.with_options(eccentricity_min=0.1)
    assert systems.confirmed_complexes(nodes, spots, joined, relaxed).count() == 3


def test_paged_walk_equals_grouped_walk(spark):
    """Random systems, walked in one page and in pages of one element number."""
    cases = []
    for seed in range(5):
        rnd = random.Random(seed)
        graph = random_graph(rnd)
        edges = [(a, b) for a, out in graph.items() for b, _ in out]
        linked = {n for e in edges for n in e}
        reach, grown = {min(linked)}, True
        while grown:
            more = {n for e in edges if reach & set(e) for n in e} - reach
            grown, reach = bool(more), reach | more
        cases.append(({n + seed * 100: rnd.choice([SMALL, PLAIN, COLD, COLD]) for n in sorted(reach)},
                      [(a + seed * 100, b + seed * 100) for a, b in edges if a in reach]))

    def outcome(config):
        spots, books = assign_candidates(*tables(spark, cases)[:2], config)
        return ({tuple(x) for x in spots.where("cand is not null").collect()}, {tuple(x) for x in books.collect()})

    whole, paged = outcome(CONFIG), outcome(CONFIG.with_options(page_nodes=4))
    assert whole == paged and len(whole[0]) > 20


def test_systems_of_one_page_take_one_round(spark, monkeypatch):
    """A zigzag between the last frame of one block of frames and the first of the next."""
    made, original = [], candidates.stage
    monkeypatch.setattr(candidates, "stage", lambda rows, name: made.append(name) or original(rows, name))
    late, early = candidates.PAGE_FRAMES, candidates.PAGE_FRAMES - 1
    nodes = {key(f, i): (SMALL, PLAIN, COLD)[i % 3] for f in (early, late) for i in range(1, 7)}
    edges = [(key(early, i), key(late, k)) for i in range(1, 7) for k in (i - 1, i) if k]
    spots, _ = assign_candidates(*tables(spark, [(nodes, edges)]), CONFIG)
    walk = Walk(view(nodes, edges), CONFIG).run()
    assert {x.node: x.cand for x in spots.collect()} == {
        n: spot.candidate.number if spot.candidate else None for n, spot in walk.placed.items()}
    assert made.count("page-walk") == 1


def test_criteria_areas_are_the_largest_cold_part(spark):
    rows = [[225] * 8 for _ in range(6)]
    for r, c in ((0, 0), (0, 1), (1, 0), (3, 3), (3, 4), (3, 5), (3, 6), (2, 1)):
        rows[r][c] = 210
    rows[1][1] = 230
    raster = micro_raster(spark, [rows])
    for tile in (2, 512):
        config = MICRO.with_options(outer_area=100, inner_area=16, outer_temperature=228, inner_temperature=213, tile=tile)
        found = find_elements(raster, config)
        got = systems.criteria_areas(found.accepted, found.pixels, config).first()
        assert (got.outer_part, got.inner_part) == (47 * 16.0, 4 * 16.0)
        part = systems.criterion_b_pixels(found.accepted, found.pixels, config).collect()
        assert {(x.r, x.c) for x in part} == {(3, 3), (3, 4), (3, 5), (3, 6)}


def storm(frames, width=6, cold=True):
    out = []
    for f in range(frames):
        rows = [[0] * 16 for _ in range(8)]
        for r in range(1, 7):
            for c in range(1 + f, 1 + f + width):
                rows[r][c] = 205 if cold and 2 <= r <= 5 and 2 + f <= c <= width - 1 + f else 225
        out.append(rows)
    return out


def test_full_run_finds_a_complex(spark):
    config = MICRO.with_options(outer_area=300, inner_area=100, minimum_duration=3, maximum_duration=6)
    run = pipeline.analyse(micro_raster(spark, storm(5)), config)
    rows = run.systems.members.orderBy("kind", "seq").collect()
    assert [(x.kind, x.seq, x.id, x.stage, x.behaviour) for x in rows] == [
        (kind, i, f"F{i}CE1", "I" if i == 1 else "M", "N") for kind in ("MCC", "MCS") for i in range(1, 6)]
    warm = pipeline.analyse(micro_raster(spark, storm(5, cold=False)), config)
    assert {x.kind for x in warm.systems.members.collect()} == {"MCS"}


def test_short_systems_are_no_systems(spark):
    run = pipeline.analyse(micro_raster(spark, storm(3)), MICRO)
    assert run.clusters.edges.count() == 2 and run.systems.members.isEmpty()


def test_stages_are_set_once_unless_overwritten(spark, tmp_path):
    from gridtrack.sinks import stored, tables

    schema = "node bigint, stage string"
    path = str(tmp_path / "nodes")
    stored.create(spark.createDataFrame([(1, "I"), (2, "M")], schema), path, tables.NODE_KEYS, tables.NODE_PARTS)
    new = spark.createDataFrame([(2, "D"), (3, "D")], schema)
    assert {tuple(x) for x in tables.store_nodes(path, new).collect()} == {(1, "I"), (2, "M"), (3, "D")}
    assert {tuple(x) for x in tables.store_nodes(path, new, overwrite=True).collect()} == {(1, "I"), (2, "D"), (3, "D")}
