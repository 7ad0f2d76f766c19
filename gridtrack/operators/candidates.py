"""Running the visiting-order rules over all systems.

Systems are walked page by page: a page is a whole system of at most ``page_nodes``
members, or a block of frames and element numbers of a larger one.  A round loads
the page of every system that holds its newest open discovery plus the states of
its direct neighbours, walks until the order leaves the page, and writes the
changed states back.  No task ever holds more than a page; all systems of one page
take one round together, wherever their members lie.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.config import TrackConfig
from gridtrack.operators.elements import node_frame, node_number
from gridtrack.operators.lifecycle import Candidate, Placed, SystemView, Walk
from gridtrack.session import stage, unstage

PAGE_FRAMES = 16
NODE, CANDIDATE, MARK = 0, 1, 2

RESULT_SCHEMA = (
    "kind int, component bigint, node bigint, push bigint, visited boolean, cand bigint, core boolean, "
    "stage string, shield_count bigint, duration bigint, top bigint, top_frame int, "
    "seen_large boolean, next_push bigint, next_cand bigint"
)
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
RESULT_TYPES = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in RESULT_SCHEMA.split(", "))])


def assign_candidates(nodes: DataFrame, links: DataFrame, config: TrackConfig) -> tuple[DataFrame, DataFrame]:
    """``(placed, candidates)`` of all systems.

    ``nodes(component, node, area, outer_part, inner_part)`` and pruned
    ``links(component, src, dst)`` give ``placed(component, node, cand, core,
    stage)`` and ``candidates(component, cand, shield_count, duration, top)``.
    """
    found = walk_pages(nodes, links, config)
    placed = found.where(F.col("kind") == NODE).select("component", "node", "cand", "core", "stage")
    books = found.where(F.col("kind") == CANDIDATE).select("component", "cand", "shield_count", "duration", "top")
    return placed, books


def _view(members: pa.Table, links: pa.Table) -> SystemView:
    ids = members.column("node").to_pylist()
    values = [dict(zip(ids, members.column(x).to_pylist())) for x in ("area", "outer_part", "inner_part")]
    parents: dict[int, list[int]] = {}
    children: dict[int, list[int]] = {}
    for src, dst in sorted(zip(links.column("src").to_pylist(), links.column("dst").to_pylist())):
        children.setdefault(src, []).append(dst)
        parents.setdefault(dst, []).append(src)
    return SystemView(*values, parents, children)


def _books(walk: Walk) -> dict[int, Candidate]:
    return {p.candidate.number: p.candidate for p in walk.placed.values() if p.candidate}


def _rows(component: int, walk: Walk, nodes, books: dict[int, Candidate]) -> pa.Table:
    rows = []
    for node in nodes:
        spot = walk.placed.get(node)
        rows.append({
            "kind": NODE, "node": node, "push": walk.pushed.get(node), "visited": spot is not None,
            "cand": spot.candidate.number if spot and spot.candidate else None,
            "core": spot.core if spot else None, "stage": spot.stage if spot else None})
    rows += [{"kind": CANDIDATE, "cand": b.number, "shield_count": b.shield_count, "duration": b.duration,
              "top": b.top, "top_frame": b.top_frame} for b in books.values()]
    rows.append({"kind": MARK, "seen_large": walk.seen_large, "next_push": walk.next_push,
                 "next_cand": walk.next_candidate})
    return pa.Table.from_pylist([{"component": component, **row} for row in rows], schema=RESULT_TYPES)


# --- pages -------------------------------------------------------------------------------------

STATE = ("push", "visited", "cand", "core", "stage")
BOOK = ("shield_count", "duration", "top", "top_frame")
MARKS = ("seen_large", "next_push", "next_cand")


def walk_pages(nodes: DataFrame, links: DataFrame, config: TrackConfig) -> DataFrame:
    """The walk in rounds of one page per system, with all state in stage tables."""
    # a system of no more members than a page has is one page, so its walk is one round
    paged = stage(
        nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > config.page_nodes)
        .select("component", F.lit(True).alias("paged")), "paged-systems")

    def page(node: str):
        block = max(1, config.page_nodes // PAGE_FRAMES)
        own = F.shiftleft(F.floor(node_frame(node) / PAGE_FRAMES), 32).bitwiseOR(F.floor(node_number(node) / block))
        return F.when(F.col("paged"), own).otherwise(F.lit(0).cast("bigint"))

    near = stage(
        links.select("component", F.col("src").alias("at"), "src", "dst")
        .unionByName(links.select("component", F.col("dst").alias("at"), "src", "dst"))
        .join(paged, "component", "left").select("component", "at", "src", "dst", page("at").alias("page")), "page-links")
    fixed = stage(
        nodes.join(paged, "component", "left")
        .select("component", "node", "area", "outer_part", "inner_part", page("node").alias("page")), "page-nodes")
    kinds = dict(x.split() for x in RESULT_SCHEMA.split(", "))
    first = fixed.groupBy("component").agg(F.min("node").alias("node"))

    def nothing(names):
        return [F.lit(None).cast(kinds[x]).alias(x) for x in names]

    changed = stage(
        first.select(F.lit(NODE).alias("kind"), "component", "node", F.lit(0).cast("bigint").alias("push"),
                     F.lit(False).alias("visited"), *nothing(("cand", "core", "stage")), *nothing(BOOK), *nothing(MARKS))
        .unionByName(first.select(
            F.lit(MARK).alias("kind"), "component", *nothing(("node",)), *nothing(STATE), *nothing(BOOK),
            F.lit(False).alias("seen_large"), F.lit(1).cast("bigint").alias("next_push"),
            F.lit(1).cast("bigint").alias("next_cand"))), "walk-start")
    record = changed
    while True:
        states, books, marks = (record.where(F.col("kind") == k) for k in (NODE, CANDIDATE, MARK))
        known = fixed.join(states.select("component", "node", *STATE), ["component", "node"], "left")
        open_nodes = known.where("push is not null and not visited")
        top = open_nodes.groupBy("component").agg(F.max_by("page", "push").alias("page"))
        turn = stage(top.join(marks.select("component", *MARKS), "component"), "turns")
        if turn.isEmpty():
            return record
        elsewhere = (
            open_nodes.join(turn.select("component", "page"), ["component", "page"], "left_anti")
            .groupBy("component").agg(F.max("push").alias("elsewhere"))
        )
        here = near.join(turn.select("component", "page"), ["component", "page"], "left_semi")
        # the page itself, members without a link included, and the neighbours of its members
        around = (
            here.select("component", F.col("src").alias("node"))
            .unionByName(here.select("component", F.col("dst").alias("node")))
            .unionByName(fixed.join(turn.select("component", "page"), ["component", "page"], "left_semi").select("component", "node"))
        )
        frames = states.where("core").groupBy("component", "cand").agg(
            F.collect_set(node_frame("node")).alias("core_frames"))
        loaded = (
            known.join(around, ["component", "node"], "left_semi")
            .join(turn.withColumnRenamed("page", "turn_page"), "component")
            .withColumn("own", F.col("page") == F.col("turn_page"))
            .join(books.select("component", "cand", *BOOK), ["component", "cand"], "left")
            .join(frames, ["component", "cand"], "left").join(elsewhere, "component", "left")
        )
        changed = stage(_walk_page(loaded, here, config), "page-walk")
        before, record = record, stage(_latest(record, changed), "walk-record")
        unstage(before, changed, turn)


def _latest(record: DataFrame, changed: DataFrame) -> DataFrame:
    """``record`` with the rows of ``changed`` replaced or added."""
    keys = ["kind", "component", F.coalesce("node", "cand", F.lit(0)).alias("item")]
    touched = changed.select(*keys)
    kept = record.withColumn("item", F.coalesce("node", "cand", F.lit(0))).join(
        touched, ["kind", "component", "item"], "left_anti").drop("item")
    return kept.unionByName(changed)


def _walk_page(loaded: DataFrame, links: DataFrame, config: TrackConfig) -> DataFrame:
    def walk(key: tuple, members: pa.Table, inner: pa.Table) -> pa.Table:
        rows = members.to_pylist()
        walker = Walk(_view(members, inner), config)
        marks = rows[0]
        walker.seen_large = marks["seen_large"]
        walker.next_push, walker.next_candidate = marks["next_push"], marks["next_cand"]
        elsewhere = -1 if marks["elsewhere"] is None else marks["elsewhere"]
        own = {row["node"] for row in rows if row["own"]}
        books: dict[int, Candidate] = {}
        for row in rows:
            if row["push"] is not None:
                walker.pushed[row["node"]] = row["push"]
            if row["visited"]:
                spot = Placed(None, bool(row["core"]), row["stage"])
                if row["cand"] is not None:
                    spot.candidate = books.setdefault(row["cand"], Candidate(
                        row["cand"], row["shield_count"], row["duration"], row["top"], row["top_frame"],
                        set(row["core_frames"] or ())))
                walker.placed[row["node"]] = spot
        walker.pending = sorted((n for n in walker.pushed if n in own and n not in walker.placed), key=walker.pushed.get)
        before = {n: n in walker.placed for n in walker.pushed}
        while walker.pending:
            node = walker.pending[-1]
            if node not in own or walker.pushed[node] < elsewhere:
                break
            walker.visit(walker.pending.pop())
        touched = [n for n in walker.pushed if n not in before or before[n] != (n in walker.placed)]
        books.update(_books(walker))
        return _rows(key[0].as_py(), walker, touched, books)

    left = loaded.select(
        F.col("component").alias("system"), "node", "area", "outer_part", "inner_part", *STATE, *BOOK, *MARKS,
        "core_frames", "own", "elsewhere")
    right = links.select(F.col("component").alias("system"), "src", "dst").distinct()
    return left.groupBy("system").cogroup(right.groupBy("system")).applyInArrow(walk, RESULT_SCHEMA)
