"""Pruning: from every element, one path to the deepest frame it reaches.

Links join consecutive frames only, so a path over ``L`` elements has a
distance of ``L - 1`` plus its excess, the sum of ``weight - 1``.  Among the
elements reached in the deepest frame the default rule takes the last one whose
excess is at most 1 and, where none is, the first one.  Of several shortest
paths to it the one that keeps its heavy links late wins, then the one through
lower element numbers; that is the order in which a shortest-path search from
the root settles them.

What a root needs from a child is one of three things only: the best end with
excess 0, the best end with excess 1, or the fallback end.  Each is one value
and one successor per element, so the union of all roots' paths is linear in
the number of links although every element is a root.

The frames of a component are cut into intervals of ``frames_per_round`` frames,
counted from its last one.  Every interval is summarised by itself; summaries of
neighbours are joined to those of twice as many frames, and then handed down
again as the plans at the end of every interval, so the number of rounds grows
with the logarithm of the series.  With them all intervals are planned at once.
The paths are marked the other way round, with jumps in place of summaries.  A
group is what one component has in one interval, or at the ends of one, so its
size is bounded by the grid and not by the length of the series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.config import TrackConfig
from gridtrack.operators import intervals
from gridtrack.operators.components import components
from gridtrack.operators.elements import node_frame
from gridtrack.operators.intervals import CLEAN, FALLBACK, NOWHERE, ONE_HEAVY, Hops, Pairs, Plans
from gridtrack.session import ship_package, stage


def graph_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes of ``edges(src, dst)``."""
    plain = edges.select(F.lit(0).cast("bigint").alias("scope"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return components(plain).select("node", F.col("root").alias("component"))


def component_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


@dataclass(frozen=True)
class Clusters:
    """``edges(src, dst, weight)`` kept by pruning and ``roots(root, target, n_nodes, distance)``."""

    edges: DataFrame
    roots: DataFrame


def prune(edges: DataFrame, config: TrackConfig) -> Clusters:
    """Union of the chosen paths of all roots, and one row per root that has one."""
    plans, n = plan_intervals(edges, config)
    found = stage(_in_intervals(_choose(config), CHOICE_SCHEMA, plans, _wanted(plans, n, config)), "paths")
    return Clusters(
        found.where("not is_root").select("src", "dst", "weight"),
        found.where("is_root").select(F.col("src").alias("root"), F.col("dst").alias("target"), "n_nodes", "distance"))


# --- tables of intervals -------------------------------------------------------------------------

#: ``item`` numbers the intervals of a component from its end, or stretches of several of them
KEYS = "component bigint, item int"
LINKS = ("src", "dst", "weight")
PLAN_COLUMNS = "depth int, clean_end bigint, light_end bigint, end bigint, distance int, heavy_at int, rank int"
#: pairs have a ``last`` element; rows without are plans, with the order of their weights in ``rank``
SUMMARY_SCHEMA = f"{KEYS}, node bigint, last bigint, length int, clean boolean, one_at int, {PLAN_COLUMNS}"
AFTER_SCHEMA = f"{KEYS}, node bigint, {PLAN_COLUMNS}"
NEXT_HOPS = [f"{x}{need} {kind}" for need in range(3) for x, kind in (("child", "bigint"), ("weight", "int"), ("next", "int"))]
PLAN_SCHEMA = f"{AFTER_SCHEMA}, {', '.join(NEXT_HOPS)}"
#: where a state leaves; rows without a ``node`` are states that roots of the interval itself need
JUMP_SCHEMA = f"{KEYS}, node bigint, need int, to bigint, to_need int"
STATE_SCHEMA = f"{KEYS}, node bigint, need int"
CHOICE_SCHEMA = "component bigint, is_root boolean, src bigint, dst bigint, weight int, n_nodes int, distance int"
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _table(schema: str, component: int | None, item: int | None, **columns) -> pa.Table:
    """Rows of one group; columns that are not given are null."""
    size = len(next(iter(columns.values())))
    columns |= {"component": np.full(size, component or 0), "item": np.full(size, item or 0)}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: _column(columns[name]).cast(_ARROW[kind]) if name in columns else pa.nulls(size, _ARROW[kind])
                     for name, kind in fields})


def _column(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def _arrays(table: pa.Table | None, names) -> list[np.ndarray]:
    if table is None:
        return [np.zeros(0, dtype=np.int64) for _ in names]
    return [table.column(x).to_numpy().astype(np.int64) for x in names]


def _plans(table: pa.Table | None) -> Plans:
    return Plans.joined([Plans(*_arrays(table, [f.name for f in intervals.fields(Plans)]))])


def _plan_table(schema: str, component: int, item: int, plans: Plans, **more) -> pa.Table:
    return _table(schema, component, item, **dict(zip([f.name for f in intervals.fields(Plans)], plans.columns())), **more)


def _summary(table: pa.Table) -> tuple[Pairs, Plans]:
    is_pair = pc.is_valid(table.column("last"))
    pairs = table.filter(is_pair)
    columns = _arrays(pairs, ("node", "last", "clean", "one_at", "distance", "rank"))
    by = np.argsort(columns[0], kind="stable")
    first, last, clean, one_at, distance, order = (c[by] for c in columns)
    length = pairs.column("length")[0].as_py() if pairs.num_rows else 0
    return Pairs(length, first, last, clean == 1, one_at, distance, order), _plans(table.filter(pc.invert(is_pair)))


def _summary_table(component: int, item: int, pairs: Pairs, plans: Plans) -> pa.Table:
    return pa.concat_tables([
        _table(SUMMARY_SCHEMA, component, item, node=pairs.first, last=pairs.last, length=np.full(pairs.first.size, pairs.length),
               clean=pairs.clean, one_at=pairs.one_at, distance=pairs.distance, rank=pairs.order),
        _plan_table(SUMMARY_SCHEMA, component, item, plans)])


def _group(*tables: pa.Table | None) -> tuple[int, int]:
    table = next(t for t in tables if t is not None and t.num_rows)
    return table.column("component")[0].as_py(), table.column("item")[0].as_py()


def _in_intervals(kernel: Callable, schema: str, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """``kernel`` on the rows of every interval of both tables."""
    ship_package(left.sparkSession)
    if right is None:
        return left.groupBy("component", "item").applyInArrow(lambda table: kernel(table, None), schema)
    return left.groupBy("component", "item").cogroup(right.groupBy("component", "item")).applyInArrow(kernel, schema)


def _halved(table: DataFrame) -> DataFrame:
    return table.withColumn("half", F.col("item") % 2).withColumn("item", F.expr("item div 2"))


# --- plans -----------------------------------------------------------------------------------------

def plan_intervals(edges: DataFrame, config: TrackConfig) -> tuple[DataFrame, int]:
    """Plans of all elements with a child, and the most intervals that a component has."""
    members = stage(graph_components(edges), "members")
    owned = edges.select("src", "dst", "weight").join(members.withColumnRenamed("node", "src"), "src")
    last = owned.groupBy("component").agg(F.max(node_frame("dst")).alias("last"))
    # interval 0 holds the links that end in the last frames of their component
    links = stage(owned.join(last, "component").select(
        "component", F.floor((F.col("last") - node_frame("dst")) / config.frames_per_round).cast("int").alias("item"), *LINKS), "interval-links")
    n = (links.agg(F.max("item")).first()[0] or 0) + 1
    after = _after(links, n, config) if n > 1 else None
    rule = config.path_rule

    def plan(links: pa.Table, after: pa.Table | None) -> pa.Table:
        if not links.num_rows:
            return _table(PLAN_SCHEMA, None, None, node=[])
        plans, hops = intervals.plan(tuple(_arrays(links, LINKS)), _plans(after), rule)
        place = np.searchsorted(plans.node, hops[:, 0])
        more = {}
        for need in range(3):
            mine = hops[:, 1] == need
            has = np.zeros(plans.node.size, dtype=bool)
            has[place[mine]] = True
            for name, column in (("child", 2), ("weight", 3), ("next", 4)):
                values = np.zeros(plans.node.size, dtype=np.int64)
                values[place[mine]] = hops[mine, column]
                more[f"{name}{need}"] = pa.array(values, mask=~has)
        return _plan_table(PLAN_SCHEMA, *_group(links), plans, **more)

    return stage(_in_intervals(plan, PLAN_SCHEMA, links, after), "plans"), n


def _after(links: DataFrame, n: int, config: TrackConfig) -> DataFrame:
    """Plans at the end of every interval: summaries of 1, 2, 4, ... intervals, then back down."""
    rule = config.path_rule

    def summarise(links: pa.Table, _) -> pa.Table:
        return _summary_table(*_group(links), *intervals.summary(tuple(_arrays(links, LINKS)), rule))

    def join(late: pa.Table, early: pa.Table) -> pa.Table:
        # without an earlier half nothing ends where this stretch begins
        if not (late.num_rows and early.num_rows):
            return _table(SUMMARY_SCHEMA, None, None, node=[])
        return _summary_table(*_group(late), *intervals.joined_summary(_summary(early), _summary(late), rule))

    def hand_down(late: pa.Table, after: pa.Table) -> pa.Table:
        component, item = _group(late, after)
        known = _plans(after)
        parts = [_plan_table(AFTER_SCHEMA, component, 2 * item, known)]
        if late.num_rows:
            parts.append(_plan_table(AFTER_SCHEMA, component, 2 * item + 1, intervals.plans_before(_summary(late), known, rule)))
        return pa.concat_tables(parts)

    levels = [stage(_in_intervals(summarise, SUMMARY_SCHEMA, links), "interval-summaries")]
    while 2 ** len(levels) < n:
        half = _halved(levels[-1])
        levels.append(stage(_in_intervals(join, SUMMARY_SCHEMA, half.where("half = 0").drop("half"), half.where("half = 1").drop("half")), "interval-summaries"))
    after = links.sparkSession.createDataFrame([], AFTER_SCHEMA)
    for level in reversed(levels):
        late = _halved(level).where("half = 0").drop("half")
        after = stage(_in_intervals(hand_down, AFTER_SCHEMA, late, after), "interval-ends")
    return after


# --- paths -----------------------------------------------------------------------------------------

def _hops(plans: pa.Table) -> Hops:
    """Next hops of an interval by element and kind of path."""
    parts = []
    for need in range(3):
        some = plans.filter(pc.is_valid(plans.column(f"child{need}")))
        node, child, weight, following = _arrays(some, ("node", f"child{need}", f"weight{need}", f"next{need}"))
        parts.append(np.column_stack([node, np.full(node.size, need), child, weight, following]))
    rows = np.concatenate(parts)
    return Hops(rows[np.lexsort((rows[:, 1], rows[:, 0]))])


def _root_states(plans: pa.Table, config: TrackConfig) -> np.ndarray:
    known = _plans(plans)
    return np.column_stack([known.node, known.needs(config.path_rule)])[known.depth >= config.min_mcs_duration]


def _wanted(plans: DataFrame, n: int, config: TrackConfig) -> DataFrame | None:
    """States in which paths from earlier intervals enter each one."""
    if n == 1:
        return None

    def jump(plans: pa.Table, _) -> pa.Table:
        hops = _hops(plans)
        through, own = intervals.jumps(hops), intervals.follow(hops, _root_states(plans, config))[1]
        return _jump_table(*_group(plans), through, own)

    def join(late: pa.Table, early: pa.Table) -> pa.Table:
        (later, own), (through, states) = _jumps(late), _jumps(early)
        component, item = _group(late, early)
        return _jump_table(component, item, _through(through, later),
                           np.unique(np.concatenate([own, _through(states, later, whole=False)]), axis=0))

    def hand_down(early: pa.Table, wanted: pa.Table) -> pa.Table:
        component, item = _group(early, wanted)
        states = np.column_stack(_arrays(wanted, ("node", "need")))
        through, own = _jumps(early)
        late = np.unique(np.concatenate([own, _through(states, through, whole=False)]), axis=0)
        if not early.num_rows:  # a stretch of one half begins where its only half does
            late = states
            return _state_table(component, 2 * item, late)
        return pa.concat_tables([_state_table(component, 2 * item + 1, states), _state_table(component, 2 * item, late)])

    levels = [stage(_in_intervals(jump, JUMP_SCHEMA, plans), "interval-jumps")]
    while 2 ** len(levels) < n:
        half = _halved(levels[-1])
        levels.append(stage(_in_intervals(join, JUMP_SCHEMA, half.where("half = 0").drop("half"), half.where("half = 1").drop("half")), "interval-jumps"))
    wanted = plans.sparkSession.createDataFrame([], STATE_SCHEMA)
    for level in reversed(levels):
        early = _halved(level).where("half = 1").drop("half")
        wanted = stage(_in_intervals(hand_down, STATE_SCHEMA, early, wanted), "interval-states")
    return wanted


def _jumps(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    through = pc.is_valid(table.column("node"))
    return (np.column_stack(_arrays(table.filter(through), ("node", "need", "to", "to_need"))),
            np.column_stack(_arrays(table.filter(pc.invert(through)), ("to", "to_need"))))


def _jump_table(component: int, item: int, through: np.ndarray, own: np.ndarray) -> pa.Table:
    return pa.concat_tables([
        _table(JUMP_SCHEMA, component, item, node=through[:, 0], need=through[:, 1], to=through[:, 2], to_need=through[:, 3]),
        _table(JUMP_SCHEMA, component, item, to=own[:, 0], to_need=own[:, 1])])


def _state_table(component: int, item: int, states: np.ndarray) -> pa.Table:
    return _table(STATE_SCHEMA, component, item, node=states[:, 0], need=states[:, 1])


def _through(states: np.ndarray, jumps: np.ndarray, whole: bool = True) -> np.ndarray:
    """Where the last two columns of ``states`` jump to, behind the first two or alone."""
    code = 4 * jumps[:, 0] + jumps[:, 1]
    by = np.argsort(code)
    left, right = intervals.matches(4 * states[:, -2] + states[:, -1], code[by])
    ends = jumps[by][right][:, 2:]
    return np.column_stack([states[left][:, :2], ends]) if whole else ends


def _choose(config: TrackConfig) -> Callable:
    rule = config.path_rule

    def choose(plans: pa.Table, wanted: pa.Table | None) -> pa.Table:
        if not plans.num_rows:
            return _table(CHOICE_SCHEMA, None, None, src=[])
        component, _ = _group(plans)
        known, hops, roots = _plans(plans), _hops(plans), _root_states(plans, config)
        states = np.concatenate([roots, np.column_stack(_arrays(wanted, ("node", "need")))])
        kept = np.unique(hops.rows[intervals.follow(hops, states)[0]][:, [0, 2, 3]], axis=0)
        own, deep = known.needs(rule), known.depth >= config.min_mcs_duration
        target = np.where(own == FALLBACK, known.end, known.light_end)[deep]
        distance = np.where(own == FALLBACK, known.distance, known.depth - 1 + own)[deep]
        return pa.concat_tables([
            _table(CHOICE_SCHEMA, component, None, is_root=np.zeros(len(kept), dtype=bool), src=kept[:, 0], dst=kept[:, 1], weight=kept[:, 2]),
            _table(CHOICE_SCHEMA, component, None, is_root=np.ones(target.size, dtype=bool), src=known.node[deep], dst=target,
                   n_nodes=known.depth[deep], distance=distance)])

    return choose


# --- the paths themselves ---------------------------------------------------------------------

def root_paths(edges: DataFrame, config: TrackConfig) -> DataFrame:
    """``(root, step, node)``: the chosen path of every root, one row per element on it.

    The first ``2 ** k`` elements of all paths and hops over ``2 ** k`` elements
    give the next ``2 ** k`` ones, so every row is made once and the rounds grow with the
    logarithm of the longest path.
    """
    plans, _ = plan_intervals(edges, config)
    own = _own_need(config.path_rule)
    hops = stage(plans.select("node", F.explode(F.array(*[
        F.struct(F.lit(need).alias("need"), F.col(f"child{need}").alias("to"), F.col(f"next{need}").alias("to_need"))
        for need in range(3)])).alias("hop")).select("node", "hop.*").where("to is not null"), "hops")
    listed = [stage(plans.where(F.col("depth") >= config.min_mcs_duration).select(
        F.col("node").alias("root"), F.lit(1).alias("step"), "node", own.alias("need")), "listed")]
    length = 1
    while True:
        known = reduce(DataFrame.unionByName, listed)
        more = stage(known.join(hops, ["node", "need"]).select(
            "root", (F.col("step") + length).alias("step"), F.col("to").alias("node"), F.col("to_need").alias("need")), "listed")
        if more.isEmpty():
            return known.select("root", "step", "node")
        listed.append(more)
        length *= 2
        second = hops.select(F.col("node").alias("to"), F.col("need").alias("to_need"), F.col("to").alias("far"), F.col("to_need").alias("far_need"))
        hops = stage(hops.join(second, ["to", "to_need"]).select("node", "need", F.col("far").alias("to"), F.col("far_need").alias("to_need")), "hops")


def _own_need(rule: str):
    if rule == "min_distance":
        return F.lit(FALLBACK)
    return (
        F.when(F.col("light_end") == NOWHERE, FALLBACK)
        .when(F.col("clean_end") == F.col("light_end"), CLEAN)
        .otherwise(ONE_HEAVY)
    )


def pruned_nodes(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return ends.distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, n_parents, n_children)`` for every node of ``edges``."""
    arrivals = edges.select(F.col("dst").alias("node"), F.lit(1).alias("p"), F.lit(0).alias("c"))
    leavings = edges.select(F.col("src").alias("node"), F.lit(0).alias("p"), F.lit(1).alias("c"))
    return arrivals.unionByName(leavings).groupBy("node").agg(
        F.sum("p").alias("n_parents"), F.sum("c").alias("n_children"))


def behaviours(edges: DataFrame) -> DataFrame:
    """``N`` plain, ``M`` merge, ``S`` split, ``B`` both, per node of the pruned graph."""
    merges, splits = F.col("n_parents") > 1, F.col("n_children") > 1
    return degrees(edges).withColumn(
        "behaviour",
        F.when(merges & splits, "B").when(merges, "M").when(splits, "S").otherwise("N"),
    )
