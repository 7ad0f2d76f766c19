"""The registered queries as plain SQL, for checking results with another engine.

Regions and components are found by recursive minimum propagation and paths by
enumerating all of them, so the checks share no method with the operators.
The life-cycle rules walk every system with the stack, its members and its
candidates as lists in the row of each step.
"""

from __future__ import annotations

KEY = 4294967296

def _kernel(size: str) -> str:
    """Inverse of the cubic B-spline filter on a mirrored line, in closed form."""
    return f"""
        SELECT i, CASE WHEN j < n THEN j ELSE m - j END AS src,
               sum(-6 * z / (1 - z * z) * (pow(z, abs(i - j)) + pow(z, m - abs(i - j))) / (1 - pow(z, m))) AS h
        FROM (SELECT {size} AS n, 2 * ({size} - 1) AS m, sqrt(3.0::DOUBLE) - 2 AS z,
                     unnest(range({size})) AS i FROM dims),
             (SELECT unnest(range(2 * ({size} - 1))) AS j FROM dims)
        GROUP BY 1, 2"""


def _taps(line: str, place: str, source: str, size: str) -> str:
    return f"""
        SELECT {line}, CASE WHEN spot < n THEN spot ELSE m - spot END AS cell, tap
        FROM (SELECT {line}, n, m, CAST(((floor({place}) + k - 1) % m + m) % m AS BIGINT) AS spot,
                     CASE k WHEN 0 THEN pow(1 - t, 3) / 6 WHEN 1 THEN (4 - 6 * t * t + 3 * t * t * t) / 6
                            WHEN 2 THEN (1 + 3 * t + 3 * t * t - 3 * t * t * t) / 6 ELSE pow(t, 3) / 6 END AS tap
              FROM (SELECT *, {place} - floor({place}) AS t, {size} AS n, 2 * ({size} - 1) AS m, unnest(range(4)) AS k
                    FROM {source}, dims))"""


# name -> (tables it needs, body); listed in dependency order
PARTS: dict[str, tuple[list[str], str]] = {
    "cells": ([], """
        SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) + 1 AS frame,
               CAST(event_id % 16 AS INTEGER) AS r,
               CAST((event_id // 16) % greatest(16, (SELECT count(*) FROM events) // 640) AS INTEGER) AS c,
               min(value) AS low, sum(value) AS total
        FROM events GROUP BY 1, 2, 3"""),
    "grid": (["cells"], """
        SELECT frame, TIMESTAMP '2024-01-01 00:00:00' + (frame - 1) * INTERVAL 1 DAY AS ts, r, c,
               5 + r * 0.25::DOUBLE AS lat, -5 + c * 0.25::DOUBLE AS lon,
               CAST(200 + floor(low) AS BIGINT) AS tb
        FROM cells"""),
    "px": (["grid"], "SELECT frame, r, c, tb FROM grid WHERE tb <= 220 AND tb <> 0"),
    "frames": (["grid"], "SELECT DISTINCT frame, ts FROM grid"),
    "lab": (["px"], f"""
        SELECT frame, r, c, r::BIGINT * {KEY} + c AS l FROM px
        UNION
        SELECT n.frame, n.r, n.c, lab.l FROM lab JOIN px n
          ON n.frame = lab.frame AND abs(n.r - lab.r) + abs(n.c - lab.c) = 1
         AND lab.l < n.r::BIGINT * {KEY} + n.c"""),
    "reg": (["lab", "px"], """
        SELECT px.frame, px.r, px.c, px.tb, min(lab.l) AS label
        FROM px JOIN lab USING (frame, r, c) GROUP BY ALL"""),
    "box": (["reg"], """
        SELECT frame, label, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, count(*) AS region_px
        FROM reg GROUP BY frame, label"""),
    "st": (["box", "px"], """
        SELECT b.frame, b.label, b.r0, b.r1, b.c0, b.c1, count(*) AS n_px, count(*) * 16.0::DOUBLE AS area,
               min(tb)::DOUBLE AS tmin, max(tb)::DOUBLE AS tmax, avg(tb) AS bt_avg, var_pop(tb) AS bt_var,
               min(tb)::DOUBLE / max(tb) * 100 AS cf,
               CAST(b.r0 + round(sum(tb * (r - b.r0))::DOUBLE / sum(tb)::DOUBLE) AS INTEGER) AS center_r,
               CAST(b.c0 + round(sum(tb * (c - b.c0))::DOUBLE / sum(tb)::DOUBLE) AS INTEGER) AS center_c,
               (count(*) * 16 >= 80 OR min(tb)::DOUBLE / max(tb) < 0.93) AS accepted
        FROM box b JOIN px p ON p.frame = b.frame AND p.r BETWEEN b.r0 AND b.r1 AND p.c BETWEEN b.c0 AND b.c1
        GROUP BY b.frame, b.label, b.r0, b.r1, b.c0, b.c1"""),
    "shape": (["box"], """
        SELECT frame, label, r1 - r0 + 1 AS height, c1 - c0 + 1 AS width,
               least((c1 - c0 + 1) / (r1 - r0 + 1 + 0.001::DOUBLE), (r1 - r0 + 1) / (c1 - c0 + 1 + 0.001::DOUBLE)) AS eccentricity
        FROM box"""),
    "placed": (["st", "shape", "frames"], """
        SELECT st.*, f.ts, s.eccentricity, 5 + center_r * 0.25::DOUBLE AS center_lat, -5 + center_c * 0.25::DOUBLE AS center_lon,
               5 + r0 * 0.25::DOUBLE AS min_lat, 5 + r1 * 0.25::DOUBLE AS max_lat,
               -5 + c0 * 0.25::DOUBLE AS min_lon, -5 + c1 * 0.25::DOUBLE AS max_lon
        FROM st JOIN shape s USING (frame, label) JOIN frames f USING (frame)"""),
    "el": (["placed"], f"""
        SELECT *, 'F' || frame || 'CE' || ce_no AS id, frame::BIGINT * {KEY} + ce_no AS node
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY frame ORDER BY label) AS INTEGER) AS ce_no
              FROM placed WHERE accepted)"""),
    "cep": (["el", "px"], """
        SELECT e.frame, e.ce_no, e.node, p.r, p.c, p.tb
        FROM el e JOIN px p ON p.frame = e.frame AND p.r BETWEEN e.r0 AND e.r1 AND p.c BETWEEN e.c0 AND e.c1"""),
    "pairs": (["cep", "el"], """
        SELECT a.node AS src, b.node AS dst, n AS overlap_px, n * 16.0::DOUBLE AS area,
               greatest(n::DOUBLE / a.n_px, n::DOUBLE / b.n_px) AS pct
        FROM (SELECT p.node AS s, q.node AS d, count(*) AS n FROM cep p JOIN cep q
              ON q.frame = p.frame + 1 AND q.r = p.r AND q.c = p.c GROUP BY 1, 2) o
        JOIN el a ON a.node = o.s JOIN el b ON b.node = o.d"""),
    "edges": (["pairs"], """
        SELECT *, CAST(CASE WHEN pct >= 0.95 THEN 1 WHEN pct >= 0.90 THEN 2 ELSE 3 END AS INTEGER) AS weight
        FROM pairs WHERE pct >= 0.90 OR area >= 48"""),
    "walk": (["edges"], """
        SELECT DISTINCT node AS root, node, 1 AS n, 0 AS dist, '' AS heavy, [node] AS path
        FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
        UNION ALL
        SELECT w.root, e.dst, w.n + 1, w.dist + e.weight, e.weight || w.heavy, list_append(w.path, e.dst)
        FROM walk w JOIN edges e ON e.src = w.node"""),
    "shortest": (["walk"], """
        SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY dist, heavy DESC, path) = 1"""),
    "deepest": (["shortest"], """
        SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY root) AS deep FROM shortest) WHERE n = deep AND deep >= 3"""),
    "chosen": (["deepest"], """
        SELECT * FROM deepest QUALIFY row_number() OVER (
          PARTITION BY root ORDER BY dist > n, CASE WHEN dist <= n THEN -node ELSE node END) = 1"""),
    "chosen_min": (["deepest"], """
        SELECT * FROM deepest QUALIFY row_number() OVER (PARTITION BY root ORDER BY dist, node) = 1"""),
    "pruned": (["chosen", "edges"], """
        SELECT DISTINCT e.src, e.dst, e.weight
        FROM (SELECT path, unnest(range(1, n)) AS i FROM chosen) p JOIN edges e ON e.src = path[i] AND e.dst = path[i + 1]"""),
    "touch": (["pruned"], "SELECT src AS a, dst AS b FROM pruned UNION SELECT dst, src FROM pruned"),
    "spread": (["touch"], """
        SELECT DISTINCT a AS node, a AS component FROM touch
        UNION
        SELECT t.b, s.component FROM spread s JOIN touch t ON t.a = s.node WHERE s.component < t.b"""),
    "comp": (["spread"], "SELECT node, min(component) AS component FROM spread GROUP BY node"),
    "deg": (["pruned"], """
        SELECT node, CAST(sum(p) AS BIGINT) AS n_parents, CAST(sum(k) AS BIGINT) AS n_children
        FROM (SELECT dst AS node, 1 AS p, 0 AS k FROM pruned UNION ALL SELECT src, 0, 1 FROM pruned) GROUP BY node"""),
    "behave": (["deg"], """
        SELECT *, CASE WHEN n_parents > 1 AND n_children > 1 THEN 'B' WHEN n_parents > 1 THEN 'M'
                       WHEN n_children > 1 THEN 'S' ELSE 'N' END AS behaviour FROM deg"""),
    "mem": (["comp", "el"], """
        SELECT 'MCS' AS kind, component AS feature_id, e.*,
               CAST(row_number() OVER (PARTITION BY component ORDER BY e.node) AS INTEGER) AS seq
        FROM comp JOIN el e USING (node)
        WHERE component IN (SELECT component FROM comp GROUP BY component HAVING count(*) > 3)"""),
    "cold": (["cep", "el"], """
        SELECT node, level, r, c FROM cep JOIN (VALUES (0, 218), (1, 212)) v(level, t) ON tb < t
        WHERE node IN (SELECT node FROM el WHERE area >= 160)"""),
    "coldlab": (["cold"], f"""
        SELECT node, level, r, c, r::BIGINT * {KEY} + c AS l FROM cold
        UNION
        SELECT n.node, n.level, n.r, n.c, x.l FROM coldlab x JOIN cold n
          ON n.node = x.node AND n.level = x.level AND abs(n.r - x.r) + abs(n.c - x.c) = 1
         AND x.l < n.r::BIGINT * {KEY} + n.c"""),
    "coldreg": (["coldlab"], "SELECT node, level, r, c, min(l) AS label FROM coldlab GROUP BY ALL"),
    "coldsize": (["coldreg"], "SELECT node, level, label, count(*) AS n FROM coldreg GROUP BY ALL"),
    "wnode": (["mem", "pruned", "coldsize"], """
        SELECT m.feature_id AS component, m.node, m.area, m.eccentricity,
               m.area >= 160 AS large,
               m.area >= 160 AND coalesce(k.outer_part, 0) >= 160 AS shield,
               m.area >= 160 AND coalesce(k.outer_part, 0) >= 160 AND coalesce(k.inner_part, 0) >= 48 AS core,
               coalesce(p.parents, []::BIGINT[]) AS parents, coalesce(c.children, []::BIGINT[]) AS children
        FROM mem m
        LEFT JOIN (SELECT node, max(n) FILTER (level = 0) * 16.0::DOUBLE AS outer_part,
                          max(n) FILTER (level = 1) * 16.0::DOUBLE AS inner_part FROM coldsize GROUP BY node) k USING (node)
        LEFT JOIN (SELECT dst AS node, list(src ORDER BY src) AS parents FROM pruned GROUP BY dst) p USING (node)
        LEFT JOIN (SELECT src AS node, list(dst ORDER BY dst) AS children FROM pruned GROUP BY src) c USING (node)"""),
    # one row per system and visited member: the stack, and all members and candidates so far
    "visit": (["wnode"], f"""
        SELECT component, 0 AS step, [min(node)] AS pending, [min(node)] AS pushed,
               []::STRUCT(node BIGINT, cand INTEGER, core BOOLEAN, stage VARCHAR)[] AS spots, false AS seen, 1 AS fresh,
               []::STRUCT(number INTEGER, shields INTEGER, duration INTEGER, top_frame BIGINT, frames BIGINT[])[] AS cands
        FROM wnode GROUP BY component
        UNION ALL
        SELECT component, step + 1, pending[:-2] || newly, pushed || newly,
               list_append(spots, {{'node': node, 'cand': CASE WHEN opens THEN fresh WHEN keeps THEN found END,
                                    'core': core AND (opens OR keeps),
                                    'stage': CASE WHEN opens THEN 'I' WHEN NOT keeps THEN NULL WHEN core THEN 'M'
                                                  WHEN rule = 3 THEN 'I' WHEN seen THEN 'I' ELSE 'D' END}}),
               seen, fresh + opens::INTEGER,
               CASE WHEN opens THEN list_append(cands, {{'number': fresh, 'shields': shield::INTEGER, 'duration': core::INTEGER,
                                                         'top_frame': CASE WHEN core THEN frame ELSE 0 END,
                                                         'frames': CASE WHEN core THEN [frame] ELSE []::BIGINT[] END}})
                    ELSE list_transform(cands, lambda k: CASE WHEN k.number IS DISTINCT FROM found THEN k ELSE
                      {{'number': k.number,
                        'shields': k.shields + (CASE WHEN rule = 1 AND core THEN NOT known WHEN core THEN false
                                                     WHEN known OR rule = 2 OR keeps THEN shield ELSE false END)::INTEGER,
                        'duration': k.duration + (core AND (rule = 3 OR rule = 1 AND NOT known))::INTEGER,
                        'top_frame': CASE WHEN core AND NOT (rule = 1 AND known) THEN greatest(k.top_frame, frame) ELSE k.top_frame END,
                        'frames': CASE WHEN core AND keeps THEN list_append(k.frames, frame) ELSE k.frames END}} END) END
        FROM (
          SELECT *, rule = 4 OR (rule = 1 AND NOT core AND NOT known AND (frame > top_frame OR top_frame = 0)) AS opens,
                 (rule = 1 AND (core OR known)) OR (rule = 2 AND (core OR known OR NOT shield))
                 OR (rule = 3 AND (core OR top_frame = 0 OR frame <= top_frame)) AS keeps
          FROM (
            SELECT *, coalesce(own.top_frame, 0) AS top_frame, coalesce(list_contains(own.frames, frame), false) AS known
            FROM (
              SELECT *, list_filter(cands, lambda k: k.number = found)[1] AS own
              FROM (
                SELECT *, coalesce(after_core, before_body, after_body) AS found,
                       CASE WHEN after_core IS NOT NULL THEN 1 WHEN before_body IS NOT NULL THEN 2
                            WHEN after_body IS NOT NULL THEN 3 ELSE 4 END AS rule
                FROM (
                  SELECT v.* EXCLUDE (seen), n.node, n.core, n.shield, n.node // {KEY} AS frame, v.seen OR n.large AS seen,
                         list_filter(n.children, lambda x: NOT list_contains(v.pushed, x))
                         || list_filter(n.parents, lambda x: NOT list_contains(v.pushed, x)) AS newly,
                         list_sort(list_filter(v.spots, lambda x: x.cand IS NOT NULL AND x.core AND list_contains(n.parents, x.node)))[1].cand AS after_core,
                         list_sort(list_filter(v.spots, lambda x: x.cand IS NOT NULL AND list_contains(n.children, x.node)))[1].cand AS before_body,
                         list_sort(list_filter(v.spots, lambda x: x.cand IS NOT NULL AND list_contains(n.parents, x.node)))[1].cand AS after_body
                  FROM visit v JOIN wnode n ON n.component = v.component AND n.node = v.pending[-1]
                  WHERE len(v.pending) > 0)))))"""),
    "visited": (["visit"], "SELECT component, spots, cands FROM visit WHERE len(pending) = 0"),
    "spot": (["visited"], "SELECT component, x.node, x.cand, x.core, x.stage FROM (SELECT component, unnest(spots) AS x FROM visited)"),
    "book": (["visited", "spot"], """
        SELECT b.component, b.cand, b.duration, c.first_core, c.last_core
        FROM (SELECT component, x.number AS cand, x.duration FROM (SELECT component, unnest(cands) AS x FROM visited)) b
        LEFT JOIN (SELECT component, cand, min(node) AS first_core, max(node) AS last_core FROM spot WHERE core GROUP BY 1, 2) c
          USING (component, cand)"""),
    "runs": (["book", "edges"], """
        SELECT *, max(CASE WHEN continued THEN NULL ELSE cand END) OVER (PARTITION BY component ORDER BY cand) AS run
        FROM (SELECT b.*, coalesce(EXISTS (SELECT 1 FROM book a JOIN edges e ON e.src = a.last_core AND e.dst = b.first_core
                                           WHERE a.component = b.component AND a.cand = b.cand - 1), false) AS continued
              FROM book b)"""),
    "joined": (["runs"], """
        SELECT r.component, r.cand, r.run, l.last_core
        FROM runs r JOIN (SELECT component, run, max(last_core) AS last_core FROM runs GROUP BY component, run
                          HAVING sum(duration) BETWEEN 1 AND 24 AND max(last_core) IS NOT NULL) l USING (component, run)"""),
    "staged": (["wnode", "spot", "joined"], """
        SELECT * FROM (
          SELECT w.node, coalesce(s.stage, CASE WHEN w.node > e.first_end THEN 'D' END) AS stage
          FROM wnode w LEFT JOIN spot s USING (node)
          LEFT JOIN (SELECT component, min(last_core) AS first_end FROM joined GROUP BY component) e ON e.component = w.component)
        WHERE stage IS NOT NULL"""),
    "body": (["spot", "joined", "wnode"], """
        SELECT s.node, s.stage, j.component, j.run, w.area, w.eccentricity
        FROM spot s JOIN joined j ON j.component = s.component AND j.cand = s.cand JOIN wnode w ON w.node = s.node"""),
    "complexes": (["body"], """
        SELECT node, feature_id FROM body JOIN (
          SELECT component, run, min(node) AS feature_id FROM body GROUP BY component, run
          HAVING arg_max(eccentricity, (area, -node)) FILTER (stage IN ('M', 'D') AND area > 0) BETWEEN 0.2 AND 1.0) USING (component, run)"""),
    "cmem": (["complexes", "el", "staged"], """
        SELECT 'MCC' AS kind, c.feature_id, e.*, s.stage,
               CAST(row_number() OVER (PARTITION BY c.feature_id ORDER BY e.node) AS INTEGER) AS seq
        FROM complexes c JOIN el e USING (node) LEFT JOIN staged s USING (node)"""),
    "coarse": ([], """
        SELECT ts, y, x, sum(cents)::DOUBLE / count(*) / 1367.879441171::DOUBLE - 2 AS value
        FROM (SELECT date_trunc('day', ts) + (hour(ts) // 3 * 3) * INTERVAL 1 HOUR AS ts,
                     event_id % 16 // 4 AS y,
                     (event_id // 16) % greatest(16, (SELECT count(*) FROM events) // 640) // 4 AS x,
                     CAST(round(value * 100) AS BIGINT) AS cents FROM events)
        GROUP BY 1, 2, 3"""),
    "dense": (["coarse"], """
        SELECT t.ts, y.y, x.x, k.value, (k.value IS NULL OR k.value < 0) AS missing
        FROM (SELECT DISTINCT ts FROM coarse) t, (SELECT DISTINCT y FROM coarse) y, (SELECT DISTINCT x FROM coarse) x
        LEFT JOIN coarse k ON k.ts = t.ts AND k.y = y.y AND k.x = x.x"""),
    "dims": (["coarse"], "SELECT max(y) + 1 AS ny, max(x) + 1 AS nx FROM coarse"),
    "feather": (["dense", "dims"], """
        SELECT d.ts, d.y, d.x, d.missing,
               CASE WHEN d.missing THEN coalesce(w.value, n.value, e.value, s.value, d.value) ELSE d.value END AS value
        FROM dense d CROSS JOIN dims
        LEFT JOIN dense w ON w.ts = d.ts AND w.y = d.y AND w.x = (d.x - 1 + nx) % nx AND NOT w.missing
        LEFT JOIN dense n ON n.ts = d.ts AND n.y = (d.y - 1 + ny) % ny AND n.x = d.x AND NOT n.missing
        LEFT JOIN dense e ON e.ts = d.ts AND e.y = d.y AND e.x = (d.x + 1) % nx AND NOT e.missing
        LEFT JOIN dense s ON s.ts = d.ts AND s.y = (d.y + 1) % ny AND s.x = d.x AND NOT s.missing"""),
    "rowpos": (["grid", "dims"], """
        SELECT r, (ny - 1) * (greatest(least(lat, 5 + ((ny - 1) * 4 + 1.5) * 0.25), 5.375) - 5.375) / ((ny - 1)::DOUBLE) AS p
        FROM (SELECT DISTINCT r, lat FROM grid), dims"""),
    "colpos": (["grid", "dims"], """
        SELECT c, (nx - 1) * (greatest(least(lon, -5 + ((nx - 1) * 4 + 1.5) * 0.25), -4.625) + 4.625) / ((nx - 1)::DOUBLE) AS q
        FROM (SELECT DISTINCT c, lon FROM grid), dims"""),
    "bilinear": (["feather", "rowpos", "colpos"], """
        SELECT a.ts, r, c,
               CASE WHEN (1 - wy) * (1 - wx) = 0 THEN 0 ELSE (1 - wy) * (1 - wx) * a.value END
             + CASE WHEN (1 - wy) * wx = 0 THEN 0 ELSE (1 - wy) * wx * b.value END
             + CASE WHEN wy * (1 - wx) = 0 THEN 0 ELSE wy * (1 - wx) * g.value END
             + CASE WHEN wy * wx = 0 THEN 0 ELSE wy * wx * h.value END AS value
        FROM (SELECT r, floor(p) AS ry, p - floor(p) AS wy FROM rowpos)
        CROSS JOIN (SELECT c, floor(q) AS cx, q - floor(q) AS wx FROM colpos)
        JOIN feather a ON a.y = ry AND a.x = cx
        LEFT JOIN feather b ON b.ts = a.ts AND b.y = a.y AND b.x = a.x + 1
        LEFT JOIN feather g ON g.ts = a.ts AND g.y = a.y + 1 AND g.x = a.x
        LEFT JOIN feather h ON h.ts = a.ts AND h.y = a.y + 1 AND h.x = a.x + 1"""),
    "kernel_y": (["dims"], _kernel("ny")),
    "kernel_x": (["dims"], _kernel("nx")),
    "coef": (["feather", "kernel_y", "kernel_x"], """
        SELECT f.ts, a.i AS y, b.i AS x, sum(coalesce(f.value, 0) * a.h * b.h) AS value
        FROM feather f JOIN kernel_y a ON a.src = f.y JOIN kernel_x b ON b.src = f.x GROUP BY 1, 2, 3"""),
    "taps_r": (["rowpos", "dims"], _taps("r", "p", "rowpos", "ny")),
    "taps_c": (["colpos", "dims"], _taps("c", "q", "colpos", "nx")),
    "rain": (["cep", "frames", "bilinear"], """
        SELECT p.frame, p.ce_no, p.node, p.r, p.c, b.value AS rain
        FROM cep p JOIN frames f USING (frame) JOIN bilinear b ON b.ts = f.ts AND b.r = p.r AND b.c = p.c
        WHERE b.value <> 0"""),
    "wetsum": (["rain"], """
        SELECT node, sum(rain) AS t, count(*) * 16.0::DOUBLE AS a, max(rain) AS hi, min(rain) AS lo FROM rain GROUP BY node"""),
    "wet": (["mem", "wetsum"], """
        SELECT m.*, coalesce(t, 0) AS precip_total, coalesce(a, 0) AS precip_area,
               coalesce(hi, 0) AS precip_max, coalesce(lo, 0) AS precip_min
        FROM mem m LEFT JOIN wetsum w USING (node)"""),
    "cwet": (["cmem", "wetsum"], """
        SELECT m.*, coalesce(t, 0) AS precip_total, coalesce(a, 0) AS precip_area,
               coalesce(hi, 0) AS precip_max, coalesce(lo, 0) AS precip_min
        FROM cmem m LEFT JOIN wetsum w USING (node)"""),
    "creport": (["cwet"], """
        SELECT kind, feature_id, min(ts) AS start, max(ts) AS "end", arg_min(ts, seq) AS maturity,
               count(*) FILTER (stage = 'M')::DOUBLE AS mature_hours, coalesce(avg(area) FILTER (stage = 'M'), 0) AS avg_area,
               max(area) AS max_area, arg_max(ts, (area, -seq)) AS max_area_ts,
               arg_max(eccentricity, (area, -seq)) AS max_area_eccentricity,
               arg_max(center_lat, (area, -seq)) AS max_area_lat, arg_max(center_lon, (area, -seq)) AS max_area_lon,
               0.0::DOUBLE AS speed, min(precip_min) AS min_rate, max(precip_max) AS max_rate,
               coalesce(sum(precip_total) FILTER (precip_total > 0), 0) AS precip_total,
               coalesce(avg(precip_total) FILTER (precip_total > 0), 0) AS avg_precip,
               coalesce(avg(precip_max) FILTER (stage = 'M' OR stage IS NULL), 0) AS avg_max_rate,
               coalesce(avg(precip_min) FILTER (stage = 'M' OR stage IS NULL), 0) AS avg_min_rate,
               avg(precip_area) AS avg_precip_area, avg(precip_area / area) * 100 AS precip_area_pct,
               (epoch(max(ts)) - epoch(min(ts))) / 3600 + 1 AS duration_hours
        FROM cwet GROUP BY kind, feature_id"""),
    "member_rain": (["rain", "mem"], "SELECT id, rain FROM rain JOIN mem USING (node)"),
    "feature_rain": (["rain", "mem"], """
        SELECT kind, feature_id, rain.r, rain.c, sum(rain) AS rain FROM rain JOIN mem USING (node)
        WHERE rain >= 0 GROUP BY ALL HAVING sum(rain) <> 0"""),
    "life": (["mem"], """
        SELECT kind, feature_id, min(ts) AS start, max(ts) AS "end", count(DISTINCT ts) AS n_times,
               epoch(min(ts) FILTER (ts > first_ts))::BIGINT - epoch(min(ts))::BIGINT AS step_sec
        FROM (SELECT *, min(ts) OVER (PARTITION BY feature_id) AS first_ts FROM mem) GROUP BY kind, feature_id"""),
    "sizes": (["mem"], "SELECT kind, feature_id, avg(area) AS mean_area FROM mem GROUP BY kind, feature_id"),
    "report": (["wet"], """
        SELECT kind, feature_id, min(ts) AS start, max(ts) AS "end", arg_min(ts, seq) AS maturity,
               count(*)::DOUBLE AS mature_hours, avg(area) AS avg_area, max(area) AS max_area,
               arg_max(ts, (area, -seq)) AS max_area_ts, arg_max(eccentricity, (area, -seq)) AS max_area_eccentricity,
               arg_max(center_lat, (area, -seq)) AS max_area_lat, arg_max(center_lon, (area, -seq)) AS max_area_lon,
               0.0::DOUBLE AS speed, min(precip_min) AS min_rate, max(precip_max) AS max_rate,
               coalesce(sum(precip_total) FILTER (precip_total > 0), 0) AS precip_total,
               coalesce(avg(precip_total) FILTER (precip_total > 0), 0) AS avg_precip,
               avg(precip_max) AS avg_max_rate, avg(precip_min) AS avg_min_rate,
               avg(precip_area) AS avg_precip_area, avg(precip_area / area) * 100 AS precip_area_pct,
               (epoch(max(ts)) - epoch(min(ts))) / 3600 + 1 AS duration_hours
        FROM wet GROUP BY kind, feature_id"""),
}

def _needs(names: list[str]) -> list[str]:
    wanted, queue = set(), list(names)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue += PARTS[name][0]
    return [name for name in PARTS if name in wanted]


def _query(needs: str, select: str) -> str:
    names = _needs(needs.split())
    if not names:
        return select.strip()
    parts = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in names)
    return f"WITH RECURSIVE {parts}\n{select.strip()}"


def _key(frame: str, no: str, node: str) -> str:
    return f"CAST({node} // {KEY} AS INTEGER) AS {frame}, CAST({node} % {KEY} AS INTEGER) AS {no}"


def _clock(seconds: str) -> str:
    return f"printf('%02d:%02d:%02d', {seconds} // 3600, {seconds} % 3600 // 60, {seconds} % 60)"


EDGE_ENDS = f"{_key('src_frame', 'src_no', 'src')}, {_key('dst_frame', 'dst_no', 'dst')}"
CLOCK = _clock("s")
SECONDS = "hour({0}) * 3600 + minute({0}) * 60 + second({0})"
UNIT = "['minutes', 'hours', 'days', 'months', 'years'][{0} % 5 + 1]"


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _bins(source: str, value: str, keys: str, bins: int) -> str:
    match = " AND ".join(f"v.{k} = l.{k}" for k in keys.split(", "))
    cols = ", ".join(f"l.{k}" for k in keys.split(", "))
    return f"""
        SELECT {cols}, b AS bin, round(a + b * w, 6) AS low, round(a + (b + 1) * w, 6) AS high,
               count({value}) AS n, round(count({value})::DOUBLE / any_value(l.total), 6) AS share
        FROM (SELECT *, (z - a) / {bins} AS w, unnest(range({bins}))::INTEGER AS b
              FROM (SELECT {keys}, count(*) AS total,
                           CASE WHEN min({value}) = max({value}) THEN min({value}) - 0.5 ELSE min({value}) END AS a,
                           CASE WHEN min({value}) = max({value}) THEN max({value}) + 0.5 ELSE max({value}) END AS z
                    FROM {source} GROUP BY {keys})) l
        LEFT JOIN {source} v ON {match} AND v.{value} >= a + b * w
             AND (v.{value} < a + (b + 1) * w OR b = {bins - 1})
        GROUP BY {cols}, a, w, b"""


ORACLE: dict[str, str] = {
    "grid_raster": _query("grid", "SELECT * FROM grid"),
    "mask_threshold": _query("px", "SELECT * FROM px"),
    "clip_domain": _query("px", """
        SELECT * FROM px WHERE 5 + r * 0.25 >= 5.5 AND 5 + r * 0.25 < 8.0 AND -5 + c * 0.25 >= -4.25 AND -5 + c * 0.25 < -2.0"""),
    "nearest_axis": _query("grid", """
        (SELECT 'lat' AS axis, r AS line, lat AS value FROM grid ORDER BY abs(lat - 6.1), r LIMIT 1) UNION ALL
        (SELECT 'lon', c, lon FROM grid ORDER BY abs(lon - -3.875), c LIMIT 1)"""),
    "time_filter": _query("grid", """
        SELECT frame, count(*) AS n_cells FROM grid
        WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' GROUP BY frame"""),
    "lon_normalize": """
        SELECT c_custkey, CASE WHEN (c_custkey % 721)::DOUBLE / 2 > 180 THEN (c_custkey % 721)::DOUBLE / 2 - 360
                               ELSE (c_custkey % 721)::DOUBLE / 2 END AS lon FROM customer""",
    "label_components": _query("reg", "SELECT * FROM reg"),
    "label_components_tiled": _query("reg", "SELECT * FROM reg"),
    "element_bbox": _query("box", "SELECT * FROM box"),
    "element_stats": _query("st", f"""
        SELECT frame, label, n_px, area, tmin, tmax, {_rounded('bt_avg', 'bt_var', 'cf')} FROM st"""),
    "element_stats_component": _query("reg", """
        SELECT frame, label, count(*) AS n_px, count(*) * 16.0::DOUBLE AS area, min(tb)::DOUBLE AS tmin,
               max(tb)::DOUBLE AS tmax, round(avg(tb), 6) AS bt_avg, round(var_pop(tb), 6) AS bt_var,
               round(min(tb)::DOUBLE / max(tb) * 100, 6) AS cf FROM reg GROUP BY frame, label"""),
    "element_shape": _query("shape", f"SELECT frame, label, height, width, {_rounded('eccentricity')} FROM shape"),
    "element_center": _query("placed", """
        SELECT frame, label, ts, center_r, center_c, center_lat, center_lon, min_lat, max_lat, min_lon, max_lon FROM placed"""),
    "element_accept": _query("st", "SELECT frame, label, accepted FROM st"),
    "element_ids": _query("el", "SELECT frame, ce_no, id, label, n_px, area FROM el"),
    "element_reject": _query("placed", f"""
        SELECT frame, ts, label, n_px, area, tmin, tmax, {_rounded('bt_avg', 'bt_var', 'cf', 'eccentricity')}
        FROM placed WHERE NOT accepted"""),
    "element_pixels": _query("cep", "SELECT frame, ce_no, r, c, tb FROM cep"),
    "element_pixel_list": _query("cep", """
        SELECT frame, ce_no, CAST(row_number() OVER (PARTITION BY node ORDER BY r, c) AS INTEGER) AS seq, r, c,
               5 + r * 0.25::DOUBLE AS lat, -5 + c * 0.25::DOUBLE AS lon, tb FROM cep"""),
    "netcdf_round_trip": _query("cep frames", """
        SELECT frame, ce_no, ts, r, c, 5 + r * 0.25::DOUBLE AS lat, -5 + c * 0.25::DOUBLE AS lon, tb::DOUBLE AS tb
        FROM cep JOIN frames USING (frame)"""),
    "overlap_pairs": _query("pairs", f"SELECT {EDGE_ENDS}, overlap_px, {_rounded('pct')}, area FROM pairs"),
    "edges_weighted": _query("edges", f"SELECT {EDGE_ENDS}, overlap_px, {_rounded('pct')}, area, weight FROM edges"),
    "isolated_removed": _query("el edges", """
        SELECT frame, ce_no, id FROM el WHERE node IN (SELECT src FROM edges UNION SELECT dst FROM edges)"""),
    "frame_counts": _query("el edges frames", f"""
        SELECT greatest(f.frame, 2) AS frame, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total,
               CAST(sum(coalesce(k, 0)) AS BIGINT) AS linked, CAST(sum(coalesce(d, 0)) AS BIGINT) AS n_linked,
               CAST(sum(coalesce(n, 0)) - sum(coalesce(k, 0)) AS BIGINT) AS rejected
        FROM frames f LEFT JOIN (SELECT frame, count(*) AS n FROM el GROUP BY 1) USING (frame)
        LEFT JOIN (SELECT CAST(dst // {KEY} AS INTEGER) AS frame, count(*) AS k, count(DISTINCT dst) AS d FROM edges GROUP BY 1)
          USING (frame) GROUP BY 1"""),
    "graph_json": _query("el edges", f"""
        SELECT id, ts, e.area, tmax, tmin, center_lat, center_lon, {_rounded('eccentricity', 'cf')},
               'F' || (src // {KEY}) || 'CE' || (src % {KEY}) AS edge
        FROM el e JOIN edges ON dst = node"""),
    "edge_classes": _query("edges", "SELECT weight, count(*) AS n_edges FROM edges GROUP BY weight"),
    "contiguous_links": _query("edges", f"SELECT {EDGE_ENDS}, weight FROM edges"),
    "path_depth": _query("chosen", "SELECT root, node AS target, n AS n_nodes, dist AS distance FROM chosen"),
    "path_depth_min_distance": _query("chosen_min", "SELECT root, node AS target, n AS n_nodes, dist AS distance FROM chosen_min"),
    "root_path_list": _query("chosen", """
        SELECT root, CAST(step AS INTEGER) AS step, path[step] AS node
        FROM (SELECT root, path, unnest(range(1, n + 1)) AS step FROM chosen)"""),
    "pruned_edges": _query("pruned", f"SELECT {EDGE_ENDS}, weight FROM pruned"),
    "components": _query("comp", "SELECT node, component FROM comp"),
    "merge_split": _query("behave", "SELECT * FROM behave"),
    "criteria_area": _query("coldsize", """
        SELECT node, coalesce(max(n) FILTER (level = 0), 0) * 16.0::DOUBLE AS outer_part,
               coalesce(max(n) FILTER (level = 1), 0) * 16.0::DOUBLE AS inner_part FROM coldsize GROUP BY node"""),
    "criterion_pixels": _query("coldreg coldsize cep", """
        SELECT g.node, g.r, g.c, p.tb FROM coldreg g JOIN cep p USING (node, r, c)
        JOIN (SELECT node, arg_max(label, (n, -label)) AS label FROM coldsize WHERE level = 1 GROUP BY node) b USING (node, label)
        WHERE level = 1"""),
    "mcs_members": _query("mem behave", """
        SELECT feature_id, kind, seq, frame, ce_no, id, behaviour FROM mem JOIN behave USING (node)"""),
    "mcc_members": _query("cmem behave", """
        SELECT feature_id, kind, seq, frame, ce_no, id, behaviour, stage FROM cmem JOIN behave USING (node)"""),
    "node_stage": _query("staged", "SELECT node, stage FROM staged"),
    "complex_report": _query("creport", f"""
        SELECT kind, feature_id, start, "end", maturity, max_area_ts, {_rounded(
            'mature_hours', 'avg_area', 'max_area', 'max_area_eccentricity', 'max_area_lat', 'max_area_lon', 'speed',
            'min_rate', 'max_rate', 'precip_total', 'avg_precip', 'avg_max_rate', 'avg_min_rate', 'avg_precip_area',
            'precip_area_pct', 'duration_hours')} FROM creport"""),
    "asof_bucket": """
        SELECT event_id, date_trunc('day', ts) + (hour(ts) // 3 * 3) * INTERVAL 1 HOUR AS bucket FROM events""",
    "regrid_feather": _query("feather", """
        SELECT ts, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(value, 6) AS value, missing FROM feather"""),
    "regrid_bilinear": _query("bilinear", "SELECT ts, r, c, round(value, 6) AS value FROM bilinear"),
    "regrid_cubic": _query("coef taps_r taps_c", """
        SELECT ts, r, c, round(sum(a.tap * b.tap * value), 6) AS value
        FROM coef JOIN taps_r a ON a.cell = y JOIN taps_c b ON b.cell = x GROUP BY ts, r, c"""),
    "element_precip": _query("el wetsum", """
        SELECT id, round(coalesce(t, 0), 6) AS precip_total, coalesce(a, 0)::DOUBLE AS precip_area,
               round(coalesce(hi, 0), 6) AS precip_max, round(coalesce(lo, 0), 6) AS precip_min
        FROM el LEFT JOIN wetsum USING (node)"""),
    "precip_late_attach": _query("el wetsum", """
        SELECT id, CASE WHEN frame % 2 = 0 THEN -1.0::DOUBLE ELSE round(coalesce(t, 0), 6) END AS precip_total,
               coalesce(a, 0)::DOUBLE AS precip_area,
               round(coalesce(hi, 0), 6) AS precip_max, round(coalesce(lo, 0), 6) AS precip_min
        FROM el LEFT JOIN wetsum USING (node)"""),
    "stored_rain": _query("el wetsum", """
        SELECT id, CASE WHEN frame % 2 = 0 THEN -1.0::DOUBLE ELSE round(coalesce(t, 0), 6) END AS precip_total,
               coalesce(a, 0)::DOUBLE AS precip_area,
               round(coalesce(hi, 0), 6) AS precip_max, round(coalesce(lo, 0), 6) AS precip_min
        FROM el LEFT JOIN wetsum USING (node)"""),
    "stored_stages": _query("behave", f"""
        SELECT m.mode, node, CASE WHEN new_row THEN 'X' WHEN mode = 'overwrite' AND f % 3 <> 1 THEN 'X' ELSE behaviour END AS behaviour,
               CASE WHEN new_row OR mode = 'overwrite' THEN coalesce(fresh, CASE WHEN NOT new_row THEN known END) ELSE coalesce(known, fresh) END AS stage
        FROM (SELECT node, behaviour, node // {KEY} AS f, f % 5 = 0 AS new_row, CASE WHEN f % 2 = 0 THEN 'I' END AS known,
                     CASE WHEN f % 3 = 0 THEN 'M' END AS fresh FROM behave),
             (VALUES ('once'), ('overwrite')) m(mode)
        WHERE NOT new_row OR f % 3 <> 1"""),
    "feature_duration": _query("life", """
        SELECT *, epoch("end")::BIGINT - epoch(start)::BIGINT + step_sec AS duration_sec FROM life"""),
    "duration_summary": _query("life", """
        SELECT kind, round(avg(d), 6) AS avg_duration_sec, max(d) AS longest_sec, min(d) AS shortest_sec, count(*) AS n_features
        FROM (SELECT kind, epoch("end")::BIGINT - epoch(start)::BIGINT + step_sec AS d FROM life) GROUP BY kind"""),
    "feature_area": _query("sizes", f"SELECT kind, feature_id, {_rounded('mean_area')} FROM sizes"),
    "average_feature_size": _query("sizes", "SELECT kind, round(avg(mean_area), 6) AS avg_size FROM sizes GROUP BY kind"),
    "avg_time_of_day": f"""
        SELECT event_type, s AS avg_sec, {CLOCK} AS avg_clock
        FROM (SELECT event_type, CAST(floor(avg({SECONDS.format('ts')})) AS BIGINT) AS s FROM events GROUP BY event_type)""",
    "size_histogram": _query("sizes", _bins("sizes", "mean_area", "kind", 10)),
    "value_histogram": _bins("events", "value", "event_type", 10),
    "precip_islands": _query("wet", """
        SELECT kind, feature_id, run, hour, round(sum(rain), 6) AS rain FROM (
          SELECT *, CAST(sum(turn) OVER (PARTITION BY feature_id ORDER BY seq) AS INTEGER) AS run FROM (
            SELECT kind, feature_id, seq, CAST(hour(ts) AS INTEGER) AS hour, precip_total AS rain,
                   CASE WHEN hour(ts) = lag(hour(ts)) OVER (PARTITION BY feature_id ORDER BY seq) THEN 0 ELSE 1 END AS turn
            FROM wet)) GROUP BY ALL
        UNION ALL
        SELECT kind, feature_id, runs + 1, NULL, round(rain, 6) FROM (
          SELECT kind, feature_id, CAST(sum(turn) AS INTEGER) AS runs, sum(rain) AS rain FROM (
            SELECT kind, feature_id, precip_total AS rain,
                   CASE WHEN hour(ts) = lag(hour(ts)) OVER (PARTITION BY feature_id ORDER BY seq) THEN 0 ELSE 1 END AS turn
            FROM wet) GROUP BY ALL)"""),
    "precip_minmax": _query("mem wetsum", """
        SELECT kind, feature_id, id, round(lo, 6) AS min_rate, round(hi, 6) AS max_rate
        FROM mem LEFT JOIN wetsum USING (node)"""),
    "element_speed": _query("mem touch", """
        SELECT a.kind, a.feature_id, a.id, round(coalesce(min(abs(
                 CASE WHEN a.center_lat = b.center_lat THEN 1.0 ELSE a.center_lat - b.center_lat END
               / CASE WHEN a.center_lon = b.center_lon THEN 1.0 ELSE a.center_lon - b.center_lon END
               * 111.0 * 1000 / 3600)), 0), 6) AS speed
        FROM mem a LEFT JOIN touch t ON t.a = a.node LEFT JOIN mem b ON b.node = t.b AND b.feature_id = a.feature_id
        GROUP BY a.kind, a.feature_id, a.id"""),
    "feature_report": _query("report", f"""
        SELECT kind, feature_id, start, "end", maturity, max_area_ts, {_rounded(
            'mature_hours', 'avg_area', 'max_area', 'max_area_eccentricity', 'max_area_lat', 'max_area_lon', 'speed',
            'min_rate', 'max_rate', 'precip_total', 'avg_precip', 'avg_max_rate', 'avg_min_rate', 'avg_precip_area',
            'precip_area_pct', 'duration_hours')} FROM report"""),
    "summary_report": _query("report wet", f"""
        SELECT kind, n_features, avg_start, avg_end, {_rounded(
            'avg_duration_hours', 'avg_size', 'avg_precip_area', 'avg_max_size', 'avg_speed', 'max_speed', 'min_speed',
            'avg_min_rate', 'avg_max_rate', 'avg_precip', 'avg_total_precip', 'precip_area_pct')}
        FROM (SELECT kind, count(*) AS n_features, avg(duration_hours) AS avg_duration_hours,
                     {_clock("s1")} AS avg_start,
                     {_clock("s2")} AS avg_end,
                     avg(avg_area) AS avg_size, avg(max_area) AS avg_max_size,
                     0.0::DOUBLE AS avg_speed, 0.0::DOUBLE AS max_speed, 0.0::DOUBLE AS min_speed,
                     coalesce(avg(avg_precip) FILTER (precip_total > 0), 0) AS avg_precip,
                     coalesce(avg(precip_total) FILTER (precip_total > 0), 0) AS avg_total_precip
              FROM (SELECT *, CAST(floor(avg({SECONDS.format('start')}) OVER (PARTITION BY kind)) AS BIGINT) AS s1,
                           CAST(floor(avg({SECONDS.format('"end"')}) OVER (PARTITION BY kind)) AS BIGINT) AS s2 FROM report)
              GROUP BY kind, s1, s2)
        JOIN (SELECT kind, avg(precip_area) AS avg_precip_area, avg(precip_min) AS avg_min_rate,
                     avg(precip_max) AS avg_max_rate, avg(precip_area / area) * 100 AS precip_area_pct
              FROM wet GROUP BY kind) USING (kind)"""),
    "size_classes": _query("mem", """
        SELECT kind, feature_id, id, ts, area,
               CASE WHEN area < 80000 THEN 'small' WHEN area < 160000 THEN 'medium' ELSE 'large' END AS size_class FROM mem"""),
    "size_limits": _query("life mem", """
        SELECT kind, feature_id, start - step_sec * INTERVAL 1 SECOND AS from_ts, "end" + step_sec * INTERVAL 1 SECOND AS to_ts,
               min_area, max_area
        FROM life JOIN (SELECT feature_id, min(area) AS min_area, max(area) + 1000 AS max_area FROM mem GROUP BY 1) USING (feature_id)"""),
    "precip_share": _query("wet", """
        SELECT kind, feature_id, id, ts, center_lat, center_lon,
               round(area / sum(area) OVER (PARTITION BY feature_id) * 30000, 6) AS marker,
               round(precip_area / area * 100, 6) AS coverage_pct,
               CASE WHEN area >= 2400 THEN CAST(floor(precip_area / area * 100) AS BIGINT) || '%' END AS label FROM wet"""),
    "accum_range": _query("rain frames", """
        SELECT r, c, round(sum(rain), 6) AS rain FROM rain JOIN frames USING (frame)
        WHERE rain >= 0 AND ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00' GROUP BY r, c"""),
    "accum_running": _query("rain", """
        SELECT frame, r, c, round(rain, 6) AS rain, round(sum(rain) OVER (PARTITION BY r, c ORDER BY frame), 6) AS running
        FROM (SELECT frame, r, c, sum(rain) AS rain FROM rain WHERE rain >= 0 GROUP BY ALL)"""),
    "asof_events": """
        SELECT e.event_id, arg_max(b.event_id, (b.ts, b.event_id)) AS purchase_id, arg_max(b.value, (b.ts, b.event_id)) AS paid, max(b.ts) AS paid_at
        FROM events e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b
          ON b.user_id = e.user_id AND b.ts <= e.ts AND e.ts - b.ts <= INTERVAL 2 DAY
        WHERE e.event_type <> 'purchase' GROUP BY e.event_id""",
    "element_precip_asof": _query("el cep frames bilinear", """
        SELECT id, round(coalesce(sum(value), 0), 6) AS precip_total, count(value) * 16.0::DOUBLE AS precip_area,
               round(coalesce(max(value), 0), 6) AS precip_max, round(coalesce(min(value), 0), 6) AS precip_min
        FROM el LEFT JOIN (
          SELECT p.node, b.value FROM cep p JOIN (
            SELECT f.frame, arg_max(s.ts, s.odd) AS ts
            FROM frames f JOIN (SELECT DISTINCT ts, CASE WHEN day(ts) % 2 = 0 THEN ts - INTERVAL 37 MINUTE ELSE ts END AS odd
                                FROM bilinear WHERE hour(ts) <> 0 OR day(ts) % 4 <> 0) s
              ON s.odd <= f.ts AND f.ts - s.odd <= INTERVAL 210 MINUTE GROUP BY f.frame) m USING (frame)
          JOIN bilinear b ON b.ts = m.ts AND b.r = p.r AND b.c = p.c WHERE b.value <> 0) x USING (node)
        GROUP BY id"""),
    "accum_feature": _query("rain mem", """
        SELECT kind, feature_id, rain.r, rain.c, round(sum(rain), 6) AS rain FROM rain JOIN mem USING (node)
        WHERE rain >= 0 GROUP BY ALL"""),
    "element_precip_histogram": _query("member_rain", _bins("member_rain", "rain", "id", 5)),
    "feature_precip_histogram": _query("feature_rain", _bins("feature_rain", "rain", "kind, feature_id", 10)),
    "masked_frames": _query("px", """
        SELECT frame, CAST(level AS INTEGER) AS level, count(*) AS n_px
        FROM px JOIN (SELECT unnest([190, 200, 210, 220, 230, 240, 250]) AS level) ON tb < level GROUP BY ALL"""),
    "frame_composite": _query("cep", "SELECT frame, r, c, min(tb) AS tb FROM cep GROUP BY ALL"),
    "valid_date": """
        SELECT o_orderkey, CASE length(t) WHEN 10 THEN try_strptime(t, '%Y%m%d%H') IS NOT NULL
                                          WHEN 12 THEN try_strptime(t, '%Y%m%d%H%M') IS NOT NULL ELSE false END AS valid
        FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d%H')
                WHEN 1 THEN strftime(o_orderdate, '%Y%m%d%H%M') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M')
                ELSE lpad(CAST(o_orderkey * 104729 % 10000000000 AS VARCHAR), 10, '2') END AS t FROM orders)""",
    "time_step_class": f"""
        SELECT *, CASE
            WHEN unit = 'minutes' AND step = 60 THEN 'hourly' WHEN unit = 'minutes' AND step = 1440 THEN 'daily'
            WHEN unit = 'minutes' AND step BETWEEN 40320 AND 44640 THEN 'monthly'
            WHEN unit = 'minutes' AND step BETWEEN 525600 AND 527040 THEN 'annual'
            WHEN unit = 'hours' AND step BETWEEN 0 AND 1 THEN 'hourly' WHEN unit = 'hours' AND step = 24 THEN 'daily'
            WHEN unit = 'hours' AND step BETWEEN 672 AND 744 THEN 'monthly'
            WHEN unit = 'hours' AND step BETWEEN 8760 AND 8784 THEN 'annual'
            WHEN unit = 'days' AND step = 1 THEN 'daily' WHEN unit = 'days' AND step BETWEEN 28 AND 31 THEN 'monthly'
            WHEN unit = 'days' AND step BETWEEN 365 AND 366 THEN 'annual'
            WHEN unit = 'months' AND step = 1 THEN 'monthly' WHEN unit = 'months' AND step = 12 THEN 'annual'
            WHEN unit = 'years' AND step = 1 THEN 'annual' END AS step_class
        FROM (SELECT l_orderkey, l_linenumber, {UNIT.format('l_orderkey')} AS unit,
                     CAST(l_quantity AS INTEGER) * CASE WHEN l_linenumber % 2 = 0 THEN 24 ELSE 1 END AS step FROM lineitem)""",
    "model_time": f"""
        SELECT o_orderkey, CASE {UNIT.format('o_custkey')}
            WHEN 'minutes' THEN b + q * INTERVAL 15 SECOND WHEN 'hours' THEN b + q * INTERVAL 15 MINUTE
            WHEN 'days' THEN b + q * INTERVAL 6 HOUR WHEN 'months' THEN b + (q // 4) * INTERVAL 1 MONTH
            ELSE b + (q // 4) * INTERVAL 1 YEAR END AS ts
        FROM (SELECT o_orderkey, o_custkey, date_trunc('hour', o_orderdate) AS b, o_custkey % 50 AS q FROM orders)""",
    "time_pattern": """
        SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '*' || strftime(o_orderdate, '%H') || '*' AS pattern FROM orders""",
    "missing_files": """
        SELECT ts FROM (SELECT unnest(generate_series(date_trunc('day', min(o_orderdate)), max(o_orderdate), INTERVAL 6 HOUR)) AS ts FROM orders)
        WHERE ts NOT IN (SELECT date_trunc('hour', o_orderdate) FROM orders)""",
    "element_file_names": _query("el", """
        SELECT 'cloudElements' || strftime(ts, '%Y-%m-%d_%H:%M:%S') || id || '.nc' AS name, ts, frame, ce_no FROM el"""),
    "compare_nodes": _query("placed", """
        SELECT frame, ce_no, CASE WHEN s IS NULL THEN 'left' ELSE 'right' END AS only_in FROM (
          SELECT coalesce(a.frame, b.frame) AS frame, coalesce(a.ce_no, b.ce_no) AS ce_no, a.frame AS d, b.frame AS s
          FROM (SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY label) AS INTEGER) AS ce_no FROM placed WHERE accepted) a
          FULL JOIN (SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY label) AS INTEGER) AS ce_no FROM placed
                     WHERE area >= 160 OR tmin / tmax < 0.92) b ON a.frame = b.frame AND a.ce_no = b.ce_no)
        WHERE d IS NULL OR s IS NULL"""),
    "compare_runs": _query("cep reg", """
        SELECT frame, ce_no, count(*) FILTER (d <> 0) AS n_different,
               CAST(coalesce(max(abs(d)) FILTER (d <> 0), 0) AS INTEGER) AS max_difference
        FROM (SELECT coalesce(a.frame, b.frame) AS frame, coalesce(a.ce_no, b.ce_no) AS ce_no,
                     coalesce(a.tb, 0) - coalesce(b.tb, 0) AS d
              FROM cep a FULL JOIN (
                SELECT reg.frame, ce_no, r, c, tb FROM reg JOIN (
                  SELECT frame, label, CAST(row_number() OVER (PARTITION BY frame ORDER BY label) AS INTEGER) AS ce_no
                  FROM reg GROUP BY frame, label
                  HAVING count(*) * 16 >= 80 OR min(tb)::DOUBLE / max(tb) < 0.93) USING (frame, label)) b
              ON a.frame = b.frame AND a.ce_no = b.ce_no AND a.r = b.r AND a.c = b.c)
        GROUP BY frame, ce_no"""),
}


def _chain(direction: str) -> tuple[str, str]:
    here, there = ("dst", "src") if direction == "up" else ("src", "dst")
    return here, f"SELECT {here} AS node, min({there}) AS nxt FROM pruned GROUP BY {here} HAVING count(*) = 1"


def _chain_sql() -> dict[str, str]:
    _, up = _chain("up")
    _, down = _chain("down")
    base = "SELECT src AS node FROM pruned UNION SELECT dst FROM pruned"
    step = "SELECT w.start, w.step + 1, h.nxt FROM trail w JOIN hop h ON h.node = w.node"
    trail = f"trail AS (SELECT node AS start, 0::BIGINT AS step, node FROM ({base}) UNION ALL {step})"
    ancestors = _query("pruned deg", f"""
        , hop AS ({up}), {trail}
        SELECT t.start AS node, t.node AS "end", t.step AS steps, d.n_parents AS n_links
        FROM trail t JOIN deg d ON d.node = t.node WHERE t.node NOT IN (SELECT node FROM hop)""")
    descendants = _query("pruned", f", hop AS ({down}), {trail} SELECT start, step, node FROM trail WHERE step > 0")
    return {"ancestors_chain": ancestors, "descendants_chain": descendants}


ORACLE.update(_chain_sql())
