"""Small rasters and graphs for the tests, and slow but obvious answers for them."""

import heapq
import itertools

from gridtrack.config import TrackConfig
from gridtrack.operators.raster import Raster

MICRO = TrackConfig(xres=4, yres=4, area_min=96, min_overlap=48, t_bb_max=243)


def micro_raster(spark, frames, lat0=0.0, lon0=0.0):
    """Raster of small arrays; frame numbers start at 1, the time step is one hour."""
    pixels, stamps = [], []
    height, width = len(frames[0]), len(frames[0][0])
    for number, rows in enumerate(frames, 1):
        stamps.append((number, f"2009-08-31 {number - 1:02d}:00:00"))
        pixels += [(number, r, c, tb) for r, row in enumerate(rows) for c, tb in enumerate(row) if tb]
    return Raster(
        pixels=spark.createDataFrame(pixels, "frame int, r int, c int, tb int")
        .selectExpr("frame", "r", "c", "cast(tb as smallint) tb"),
        rows=spark.createDataFrame([(r, lat0 + r) for r in range(height)], "r int, lat double"),
        cols=spark.createDataFrame([(c, lon0 + c) for c in range(width)], "c int, lon double"),
        frames=spark.createDataFrame(stamps, "frame int, t string")
        .selectExpr("frame", "cast(t as timestamp_ntz) ts"),
    )


def flood_labels(points):
    """First raster point of each point's region, by flood fill."""
    points, label = set(points), {}
    for start in sorted(points):
        if start in label:
            continue
        label[start], todo = start, [start]
        while todo:
            f, r, c = todo.pop()
            for near in ((f, r + 1, c), (f, r - 1, c), (f, r, c + 1), (f, r, c - 1)):
                if near in points and near not in label:
                    label[near] = start
                    todo.append(near)
    return label


def key(frame, number):
    return frame << 32 | number


def random_graph(rnd):
    """Layered graph: ``{node: [(child, weight)]}``."""
    frames, weights = rnd.randint(3, 7), rnd.choice([[1, 2, 3], [1, 1, 1, 2], [2, 3], [1, 2], [3]])
    nodes = [key(f, k) for f in range(1, frames + 1) for k in range(1, rnd.randint(1, 4) + 1)]
    density = rnd.choice([0.3, 0.5, 0.8])
    return {
        a: [(b, rnd.choice(weights)) for b in nodes if b >> 32 == (a >> 32) + 1 and rnd.random() < density]
        for a in nodes
    }


def searched_paths(children, min_nodes, rule):
    """Kept links and root rows from one shortest-path search per root."""
    kept, roots = set(), []
    weight = {(a, b): w for a, links in children.items() for b, w in links}
    for root in sorted(children):
        order, path, cost = itertools.count(), {root: [root]}, {root: 0}
        settled, heap = {}, [(0, next(order), root)]
        while heap:
            distance, _, node = heapq.heappop(heap)
            if node in settled:
                continue
            settled[node] = distance
            for child, w in sorted(children[node]):
                if child not in settled and distance + w < cost.get(child, float("inf")):
                    cost[child], path[child] = distance + w, path[node] + [child]
                    heapq.heappush(heap, (distance + w, next(order), child))
        length = max(map(len, path.values()))
        if length < min_nodes:
            continue
        ends = sorted(n for n in path if len(path[n]) == length)
        if rule == "min_distance":
            end = min(ends, key=lambda n: (settled[n], n))
        else:
            end = ([n for n in ends if settled[n] <= length] or ends[:1])[-1]
        kept.update((a, b, weight[a, b]) for a, b in zip(path[end], path[end][1:]))
        roots.append((root, end, length, settled[end]))
    return sorted(kept), roots
