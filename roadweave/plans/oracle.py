"""Oracle SQL (DuckDB) for the road queries: derived tables as CTEs, then one statement a query."""

VERTEX = """
wid AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w, count(*) AS n FROM part),
road_vertex AS (
  SELECT CAST(p_partkey AS BIGINT) AS vertex_id, CAST(p_partkey % w AS BIGINT) AS x, CAST(floor(p_partkey / w) AS BIGINT) AS y,
         CAST(p_size AS BIGINT) AS p_size, CAST(48700000 + floor(p_partkey / w) * 900 AS INT) AS lat, CAST(9100000 + (p_partkey % w) * 1350 AS INT) AS lng
  FROM part CROSS JOIN wid)"""
EDGE = VERTEX + """,
road_edge AS (
  SELECT CAST(row_number() OVER (ORDER BY a.vertex_id, b.vertex_id) - 1 AS BIGINT) AS edge_id, a.vertex_id AS tail, b.vertex_id AS head,
         10 + (7 * a.p_size + 3 * b.p_size) % 50 AS travel_time, 100 + (11 * a.p_size + 13 * b.p_size) % 400 AS length,
         20 + (5 * a.p_size + b.p_size) % 80 AS capacity, 1 + (a.p_size + b.p_size) % 3 AS num_lanes
  FROM road_vertex AS a CROSS JOIN (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dx, dy)) AS o
  JOIN road_vertex AS b ON b.x = a.x + o.dx AND b.y = a.y + o.dy)"""
OD = """,
od AS (SELECT o_orderkey AS od_id, (o_custkey * 13 + 5) % n AS origin, (o_orderkey * 7 + 3) % n AS destination, o_orderdate AS departure
       FROM orders CROSS JOIN wid WHERE o_orderkey % 100 = 0)"""
POI = """,
poi AS (SELECT s_suppkey AS poi_id, (s_suppkey * 37 + 11) % n AS vertex_id FROM supplier CROSS JOIN wid)"""
POPULATION = """,
population AS (SELECT (c_custkey * 17 + 5) % n AS vertex_id, CAST(sum(1 + c_custkey % 9) AS BIGINT) AS population FROM customer CROSS JOIN wid GROUP BY 1)"""
ZONE = """,
zone AS (SELECT vertex_id, CAST(floor(y / 8) * 1000 + floor(x / 8) AS BIGINT) AS zone_id FROM road_vertex)"""
SOURCES = "(SELECT DISTINCT s FROM (VALUES (CAST(0 AS BIGINT)), (17), (101), (150)) AS t(s))"


def sp(sources: str = SOURCES, weight: str = "travel_time") -> str:
    return f""",
sp(src, id, d) USING KEY (src, id) AS (
  SELECT s, s, CAST(0 AS BIGINT) FROM {sources}
  UNION
  SELECT n.src, n.v, min(n.d)
  FROM (SELECT s.src, e.head AS v, s.d + e.{weight} AS d FROM sp AS s JOIN road_edge AS e ON s.id = e.tail
        LEFT JOIN recurring.sp AS r ON r.src = s.src AND r.id = e.head WHERE r.d IS NULL OR s.d + e.{weight} < r.d) AS n
  GROUP BY n.src, n.v)"""


def q(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()} {select}"


ORIGINS = "(SELECT DISTINCT origin AS s FROM od)"
POPULATED = "(SELECT vertex_id AS s FROM population)"
PARENT = """,
parent AS (SELECT a.src, e.head AS id, min(e.edge_id) AS edge_id FROM sp AS a JOIN road_edge AS e ON a.id = e.tail
  JOIN sp AS b ON b.src = a.src AND b.id = e.head AND b.d = a.d + e.travel_time GROUP BY a.src, e.head)"""
WALK = PARENT + """,
walk(od_id, src, id, edge_id) AS (
  SELECT o.od_id, o.origin, e.tail, p.edge_id FROM od AS o JOIN parent AS p ON p.src = o.origin AND p.id = o.destination
  JOIN road_edge AS e ON e.edge_id = p.edge_id WHERE o.origin <> o.destination
  UNION ALL
  SELECT w.od_id, w.src, e.tail, p.edge_id FROM walk AS w JOIN parent AS p ON p.src = w.src AND p.id = w.id
  JOIN road_edge AS e ON e.edge_id = p.edge_id WHERE w.id <> w.src)"""
#: Test flows on edges, used for costs and objectives: x in tenths of the capacity.
FLOW = """,
ef AS (SELECT edge_id, CAST(travel_time AS DOUBLE) AS t, CAST(length AS DOUBLE) AS len, CAST(greatest(capacity, 1) AS DOUBLE) AS c,
              CAST((edge_id * 7) % 9 AS DOUBLE) / 10 * capacity AS x, CAST((edge_id * 5) % 9 AS DOUBLE) / 10 * capacity AS s,
              CAST((edge_id * 3) % 9 AS DOUBLE) / 10 * capacity AS y FROM road_edge)"""
OPP = """,
opp AS (SELECT vertex_id, count(*) AS n FROM poi GROUP BY 1)"""
RANKED = "(SELECT src, id, d, row_number() OVER (PARTITION BY src ORDER BY d, id) - 1 AS rank FROM sp)"
GREAT = "2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a}))"


def great(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"(pow(sin(radians(({lat2} - {lat1}) / 1e6) / 2), 2) + cos(radians({lat1} / 1e6)) * cos(radians({lat2} / 1e6)) * pow(sin(radians(({lng2} - {lng1}) / 1e6) / 2), 2))"
    return GREAT.format(a=a)


ORACLES = {
    "src1_edges": q(EDGE, "SELECT edge_id, tail, head, travel_time, length, capacity, num_lanes FROM road_edge"),
    "g1_project": q(EDGE, "SELECT edge_id, tail, head, travel_time, -1 AS speed_limit FROM road_edge"),
    "g2_degree": q(EDGE, "SELECT vertex_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT tail AS vertex_id, 1 AS o, 0 AS i FROM road_edge UNION ALL SELECT head, 0, 1 FROM road_edge) GROUP BY 1"),
    "g2_contains_edge": q(EDGE + OD, "SELECT DISTINCT od.origin AS tail, od.origin + 1 AS head FROM od JOIN road_edge e ON e.tail = od.origin AND e.head = od.origin + 1"),
    "g3_unique_edge": q(EDGE, "SELECT tail, head, min(edge_id) AS edge_id FROM (SELECT tail, head, edge_id FROM road_edge UNION ALL SELECT tail, head, edge_id + 1000000 FROM road_edge WHERE edge_id % 3 = 0) GROUP BY 1, 2 HAVING count(*) = 1"),
    "g4_edit_edges": q(EDGE, "SELECT edge_id, tail, CASE WHEN edge_id % 7 = 1 THEN tail ELSE head END AS head FROM road_edge WHERE edge_id % 5 <> 0 UNION ALL SELECT (SELECT max(edge_id) FROM road_edge WHERE edge_id % 5 <> 0) + row_number() OVER (ORDER BY tail, head), tail, head FROM (SELECT tail, tail + 2 AS head FROM road_edge WHERE edge_id % 50 = 0)"),
    "g6_permute": q(EDGE, "SELECT edge_id, n - 1 - tail AS tail, n - 1 - head AS head FROM road_edge CROSS JOIN wid"),
    "g7_induced_subgraph": q(EDGE, ", kept AS (SELECT vertex_id AS orig_id, row_number() OVER (ORDER BY vertex_id) - 1 AS vertex_id FROM road_vertex WHERE (x + y) % 4 <> 0) SELECT edge_id, a.vertex_id AS tail, b.vertex_id AS head, travel_time FROM road_edge JOIN kept a ON a.orig_id = tail JOIN kept b ON b.orig_id = head"),
    "g8_reverse": q(EDGE, "SELECT edge_id, head AS tail, tail AS head, travel_time FROM road_edge"),
    "g9_validate": q(EDGE, "SELECT edge_id, tail, head FROM road_edge WHERE head % 10 = 3 OR tail % 10 = 3"),
    "g13_id_map": q(EDGE + OD, ", kept AS (SELECT vertex_id AS orig_id, row_number() OVER (ORDER BY vertex_id) - 1 AS vertex_id FROM road_vertex WHERE (x + y) % 4 <> 0) SELECT od_id, a.vertex_id AS origin, b.vertex_id AS destination FROM od JOIN kept a ON a.orig_id = origin JOIN kept b ON b.orig_id = destination"),
    "g14_compact_ids": q(VERTEX, "SELECT vertex_id AS orig_id, row_number() OVER (ORDER BY vertex_id) - 1 AS local_id FROM road_vertex WHERE p_size % 3 = 1"),
    "g15_merge_networks": q(EDGE, ", v AS (SELECT vertex_id, lat - lat % 1800 AS lat, lng - lng % 2700 AS lng FROM road_vertex), m AS (SELECT vertex_id, min(vertex_id) OVER (PARTITION BY lat, lng) AS new FROM v) SELECT edge_id, a.new AS tail, b.new AS head FROM road_edge JOIN m a ON a.vertex_id = tail JOIN m b ON b.vertex_id = head WHERE a.new <> b.new"),
    "g16_study_area": q(VERTEX, "SELECT vertex_id FROM road_vertex WHERE x BETWEEN 2 AND 11 AND y BETWEEN 3 AND 9"),
    "g17_metric_switch": q(EDGE, "SELECT edge_id, tail, head, length AS travel_time FROM road_edge"),
    "g10_scc": q(EDGE, """,
de AS (SELECT tail, head FROM road_edge WHERE (head > tail AND tail % 5 <> 0) OR (head < tail AND tail % 3 <> 0)),
reach(a, b) AS (SELECT vertex_id, vertex_id FROM road_vertex UNION SELECT r.a, e.head FROM reach r JOIN de e ON e.tail = r.b)
SELECT f.a AS vertex_id, min(f.b) AS component FROM reach f JOIN reach g ON g.a = f.b AND g.b = f.a GROUP BY 1"""),
    "g12_components": q(EDGE, """,
ue AS (SELECT tail, head FROM road_edge WHERE (tail + head) % 3 = 0), se AS (SELECT tail, head FROM ue UNION SELECT head, tail FROM ue),
cc(id, c) USING KEY (id) AS (SELECT vertex_id, vertex_id FROM road_vertex UNION SELECT n.id, min(n.c) FROM (SELECT e.head AS id, cc.c FROM cc JOIN se e ON e.tail = cc.id JOIN recurring.cc r ON r.id = e.head WHERE cc.c < r.c) n GROUP BY 1)
SELECT id AS vertex_id, c AS component FROM cc"""),
    "sp1_one_to_all": q(EDGE + sp(), "SELECT src AS source, id AS vertex_id, d AS distance FROM sp"),
    "sp4_parents": q(EDGE + sp() + PARENT, "SELECT sp.src AS source, sp.id AS vertex_id, sp.d AS distance, p.edge_id AS parent_edge FROM sp LEFT JOIN parent p ON p.src = sp.src AND p.id = sp.id"),
    "sp2_point_to_point": q(EDGE + OD + sp(ORIGINS), "SELECT od_id, origin, destination, d AS distance FROM od LEFT JOIN sp ON src = origin AND id = destination"),
    "sp4_path_cost": q(EDGE + OD + sp(ORIGINS) + WALK, "SELECT od_id, CAST(sum(travel_time) AS BIGINT) AS cost, count(*) AS hops FROM walk JOIN road_edge USING (edge_id) GROUP BY 1"),
    "sp5_bounded": q(EDGE + sp(), "SELECT src AS source, id AS vertex_id, d AS distance FROM sp WHERE d <= 150"),
    "sp7_dag": q(EDGE + """,
dag AS (SELECT * FROM road_edge WHERE head > tail),
dp(src, id, d) USING KEY (src, id) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT n.src, n.v, min(n.d) FROM (SELECT s.src, e.head AS v, s.d + e.travel_time AS d FROM dp s JOIN dag e ON s.id = e.tail LEFT JOIN recurring.dp r ON r.src = s.src AND r.id = e.head WHERE r.d IS NULL OR s.d + e.travel_time < r.d) n GROUP BY 1, 2)""", "SELECT src AS source, id AS vertex_id, d AS distance FROM dp"),
    "sp22_dijkstra_rank": q(EDGE + OD + sp(ORIGINS), f"SELECT od_id, origin, destination, rank FROM od JOIN {RANKED} ON src = origin AND id = destination"),
    "sp12_respecting": q(EDGE, "SELECT least(tail, head) AS low, greatest(tail, head) AS high, min(travel_time) FILTER (tail < head) AS up_weight, min(travel_time) FILTER (tail > head) AS down_weight FROM road_edge GROUP BY 1, 2"),
    "j2_triangles": q(EDGE, ", a AS (SELECT tail, head FROM road_edge WHERE head > tail UNION SELECT tail, tail + 2 FROM road_edge WHERE head = tail + 1 AND tail % 2 = 0) SELECT x.tail AS low, x.head AS mid, y.head AS high FROM a x JOIN a y ON x.tail = y.tail AND x.head < y.head JOIN a z ON z.tail = x.head AND z.head = y.head"),
    "j5_poi_to_vertex": q(VERTEX + POI, f""",
p AS (SELECT poi_id, v.lat + (poi_id * 37) % 800 - 400 AS lat, v.lng + (poi_id * 53) % 1200 - 600 AS lng FROM poi JOIN road_vertex v USING (vertex_id)),
r AS (SELECT poi_id, v.vertex_id, {great('p.lat', 'p.lng', 'v.lat', 'v.lng')} AS m, row_number() OVER (PARTITION BY poi_id ORDER BY CAST(p.lng - v.lng AS BIGINT) * (p.lng - v.lng) + CAST(p.lat - v.lat AS BIGINT) * (p.lat - v.lat), v.vertex_id) AS k FROM p CROSS JOIN road_vertex v)
SELECT poi_id, vertex_id FROM r WHERE k = 1 AND m <= 45"""),
    "j6_mutual_nn": q(VERTEX, f""",
b AS (SELECT vertex_id AS id, lat + (vertex_id * 37) % 900 - 450 AS lat, lng + (vertex_id * 53) % 1300 - 650 AS lng FROM road_vertex WHERE vertex_id % 3 <> 1),
w AS (SELECT a.vertex_id AS left_id, b.id AS right_id, CAST(a.lng - b.lng AS BIGINT) * (a.lng - b.lng) + CAST(a.lat - b.lat AS BIGINT) * (a.lat - b.lat) AS d2 FROM road_vertex a JOIN b ON abs(a.lat - b.lat) < 2000 AND {great('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 60),
l AS (SELECT left_id, min(right_id) AS right_id FROM (SELECT *, rank() OVER (PARTITION BY left_id ORDER BY d2) AS k FROM w) WHERE k = 1 GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT right_id, min(left_id) AS left_id FROM (SELECT *, rank() OVER (PARTITION BY right_id ORDER BY d2) AS k FROM w) WHERE k = 1 GROUP BY 1 HAVING count(*) = 1)
SELECT l.left_id, l.right_id FROM l JOIN r ON l.left_id = r.left_id AND l.right_id = r.right_id"""),
    "j8_point_in_polygon": q(VERTEX, """ SELECT vertex_id AS point_id, CAST(k AS BIGINT) AS area_id FROM road_vertex JOIN (SELECT unnest(range(0, 4)) AS k) a ON true
WHERE (x >= k * 3 AND x < k * 3 + 8 AND y >= k * 3 AND y < k * 3 + 8) AND NOT (x >= k * 3 + 2 AND x < k * 3 + 6 AND y >= k * 3 + 2 AND y < k * 3 + 6)
   OR (x >= k * 3 + 3 AND x < k * 3 + 5 AND y >= k * 3 + 3 AND y < k * 3 + 5)"""),
    "j13_moore_ring": q(VERTEX, """,
t AS (SELECT vertex_id AS target_id, x AS cell_x, y AS cell_y FROM road_vertex WHERE p_size % 10 = 0), m AS (
SELECT v.vertex_id AS query_id, greatest(abs(v.x - t.cell_x), abs(v.y - t.cell_y)) AS ring, target_id FROM road_vertex v JOIN t ON abs(v.x - t.cell_x) <= 2 AND abs(v.y - t.cell_y) <= 2)
SELECT query_id, ring, target_id FROM (SELECT *, min(ring) OVER (PARTITION BY query_id) AS least FROM m) WHERE ring = least"""),
    "k1_closest_poi": q(EDGE + OD + POI + sp(ORIGINS), "SELECT src AS source, id AS poi_vertex, d AS distance, rank FROM (SELECT src, id, d, CAST(row_number() OVER (PARTITION BY src ORDER BY d, id) AS INT) AS rank FROM sp SEMI JOIN poi ON poi.vertex_id = sp.id) WHERE rank <= 4"),
    "k6_prefix_counts": q(VERTEX + POI, "SELECT (n - 1 - vertex_id) AS rank, CAST(coalesce(sum(p) OVER (ORDER BY n - 1 - vertex_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before FROM (SELECT vertex_id, CASE WHEN vertex_id IN (SELECT vertex_id FROM poi) THEN 1 ELSE 0 END AS p FROM road_vertex) CROSS JOIN wid"),
    "k7_ball": q(EDGE + sp(), "SELECT src AS source, id AS vertex_id, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, id) AS k FROM sp) WHERE k <= 25"),
    "k8_checksum": q(EDGE + OD + POI + sp(ORIGINS), "SELECT count(*) AS n, CAST(sum(d) AS BIGINT) AS total FROM (SELECT src, d, row_number() OVER (PARTITION BY src ORDER BY d, id) AS rank FROM sp SEMI JOIN poi ON poi.vertex_id = sp.id) WHERE rank <= 4"),
    "d3_poi_counts": q(VERTEX + POI, "SELECT vertex_id % 50 AS vertex_id, count(*) AS n FROM poi GROUP BY 1"),
    "d4_formula_probability": q(EDGE + POI + POPULATION + OPP + sp(POPULATED), """,
o AS (SELECT src, id, d, coalesce(n, 0) AS n FROM sp LEFT JOIN opp ON opp.vertex_id = id),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY src ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, max(CASE WHEN id = src THEN n END) OVER (PARTITION BY src) AS own, (SELECT sum(n) + 1 FROM opp) AS S FROM o),
e AS (SELECT src, id, CAST(own + 1 AS DOUBLE) AS s, CAST(b - own AS DOUBLE) AS i, CAST(n AS DOUBLE) AS d, CAST(S AS DOUBLE) AS S2 FROM w WHERE id <> src AND n > 0)
SELECT src AS source, id AS vertex_id, round(((1 - pow(0.9, s + i)) / (s + i) - (1 - pow(0.9, s + i + d)) / (s + i + d)) / ((1 - pow(0.9, s)) / s) / (1 - ((1 - pow(0.9, S2)) / (1 - pow(0.9, s))) * (s / S2)), 9) AS probability FROM e"""),
    "d5_intervening": q(EDGE + OD + POI + OPP + sp(ORIGINS), """,
o AS (SELECT src, id, d, coalesce(n, 0) AS n FROM sp LEFT JOIN opp ON opp.vertex_id = id),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY src ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, max(CASE WHEN id = src THEN n END) OVER (PARTITION BY src) AS own FROM o)
SELECT od_id, CAST(CASE WHEN id = src THEN 0 ELSE b - own END AS BIGINT) AS between_ FROM w JOIN od ON src = origin AND id = destination"""),
    "d7_choose_given_skip": q(EDGE + OD + POI + OPP + sp(ORIGINS), """,
r AS (SELECT src, id, n, sum(n) OVER (PARTITION BY src ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM sp JOIN opp ON opp.vertex_id = id)
SELECT od_id AS trip_id, src AS source, id AS destination FROM r JOIN od ON origin = src WHERE (od_id * 31) % (SELECT sum(n) FROM opp) >= hi - n AND (od_id * 31) % (SELECT sum(n) FROM opp) < hi"""),
    "d12_trip_filter": q(VERTEX + OD + ZONE, "SELECT od_id, a.zone_id AS origin_zone, b.zone_id AS destination_zone, (od_id * 997) % 604800 AS departure FROM od JOIN zone a ON a.vertex_id = origin JOIN zone b ON b.vertex_id = destination WHERE (od_id * 997) % 604800 >= 100000 AND (od_id * 997) % 604800 < 400000 AND od_id % 200 = 0"),
    "d13_matrix_sampling": q(VERTEX + OD + ZONE, """,
f AS (SELECT a.zone_id AS o, b.zone_id AS d, count(*) AS flow FROM od JOIN zone a ON a.vertex_id = origin JOIN zone b ON b.vertex_id = destination GROUP BY 1, 2),
c AS (SELECT o, d, flow, sum(flow) OVER (ORDER BY o, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM f)
SELECT k AS draw_id, o AS origin_zone, d AS destination_zone FROM (SELECT unnest(range(0, 200)) AS k) JOIN c ON (k * 7919) % (SELECT sum(flow) FROM f) >= hi - flow AND (k * 7919) % (SELECT sum(flow) FROM f) < hi"""),
    "d15_od_by_rank": q(EDGE + OD + sp(ORIGINS), f"SELECT od_id AS trip_id, src AS source, id AS destination FROM {RANKED} r JOIN od ON origin = src AND rank = od_id % 64"),
    "d16_od_by_distance": q(EDGE + OD + sp(ORIGINS), "SELECT od_id AS trip_id, src AS source, id AS destination, d AS distance FROM (SELECT od_id, src, id, d, row_number() OVER (PARTITION BY od_id ORDER BY d, id) AS k FROM sp JOIN od ON origin = src AND d >= od_id % 300) WHERE k = 1"),
    "d17_total_length": q(EDGE + OD + sp(ORIGINS), "SELECT od_id, distance FROM (SELECT od_id, d AS distance, coalesce(sum(d) OVER (ORDER BY od_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM od JOIN sp ON src = origin AND id = destination) WHERE b < 3000"),
    "d19_mean_distance": q(EDGE + POI + POPULATION + OPP + sp(POPULATED), """,
x AS (SELECT src, d, row_number() OVER (PARTITION BY src ORDER BY d, id, c) - 1 AS rank FROM (SELECT src, id, d, unnest(range(0, n)) AS c FROM sp JOIN opp ON opp.vertex_id = id))
SELECT rank, round(sum(population * d) / sum(population), 6) AS expected_distance FROM x JOIN population ON vertex_id = src GROUP BY 1"""),
    "j11_raster_radiation": q(VERTEX + POPULATION, """,
g AS (SELECT x, y, population AS p FROM population JOIN road_vertex USING (vertex_id)),
n AS (SELECT s.x AS sx, s.y AS sy, d.x, d.y, s.p AS s, d.p AS d, abs(s.x - d.x) + abs(s.y - d.y) AS man, greatest(abs(s.x - d.x), abs(s.y - d.y)) AS che, (s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y) AS r2 FROM g s JOIN g d ON abs(s.x - d.x) <= 5 AND abs(s.y - d.y) <= 5),
k AS (SELECT *, CAST(round(0.92387953251128675613 * sqrt(r2)) AS BIGINT) AS h, CAST(round(0.38268343236508977173 * sqrt(r2)) AS BIGINT) AS a FROM n WHERE r2 BETWEEN 1 AND 25),
t AS (SELECT k.sx, k.sy, k.x, k.y, any_value(k.s) AS s, any_value(k.d) AS d, CAST(sum(m.d) - any_value(CASE WHEN k.man <= h + a AND k.che <= h THEN k.d ELSE 0 END) AS DOUBLE) AS big FROM k JOIN n m ON m.sx = k.sx AND m.sy = k.sy AND m.man <= k.h + k.a AND m.che <= k.h AND m.r2 <= 25 GROUP BY 1, 2, 3, 4)
SELECT sx AS source_x, sy AS source_y, x, y, round(s * d / (big * (d + big)), 9) AS probability FROM t"""),
    "a1_aon_flows": q(EDGE + OD + sp(ORIGINS) + WALK, "SELECT edge_id, count(*) AS vol FROM walk GROUP BY 1"),
    "a1_checksum": q(EDGE + OD + sp(ORIGINS), "SELECT count(*) AS trips, CAST(sum(d) AS BIGINT) AS checksum FROM od JOIN sp ON src = origin AND id = destination"),
    "a4_bpr": q(EDGE + FLOW, "SELECT edge_id, round(t * (1 + (x / c) * (x / c)), 6) AS value, round(2 * t * x / (c * c), 6) AS first, round(2 * t / (c * c), 6) AS second, round(t * (x + x * (x / c) * (x / c) / 3), 6) AS anti FROM ef"),
    "a4_davidson": q(EDGE + FLOW, "SELECT edge_id, round(t * (1 + 0.01 * x / (c - x)), 6) AS value, round(0.01 * t * c / ((c - x) * (c - x)), 6) AS first, round(0.02 * t * c / ((c - x) * (c - x) * (c - x)), 6) AS second, round(t * (x - 0.01 * (c * ln(c - x) + x)), 6) AS anti FROM ef"),
    "a4_mdavidson": q(EDGE + FLOW, """,
z AS (SELECT edge_id, t, c, 1.5 * x AS x, 0.95 * c AS q, least(1.5 * x, 0.95 * c) AS m FROM ef),
v AS (SELECT *, t * (1 + 0.01 * m / (c - m)) + CASE WHEN x > q THEN 0.01 * t * c / ((c - q) * (c - q)) * (x - q) ELSE 0 END AS value, t * (1 + 0.01 * q / (c - q)) AS at_q FROM z)
SELECT edge_id, round(value, 6) AS value, round(0.01 * t * c / ((c - m) * (c - m)), 6) AS first, round(CASE WHEN x > q THEN 0.0 ELSE 0.02 * t * c / ((c - x) * (c - x) * (c - x)) END, 6) AS second, round(t * (m - 0.01 * (c * ln(c - m) + m)) + CASE WHEN x > q THEN (x - q) * (value + at_q) / 2 ELSE 0 END, 6) AS anti FROM v"""),
    "a4_inverse": q(EDGE + FLOW, "SELECT edge_id, round(len * (155 / (x + 1) + 0.85), 6) AS value, round(-155 * len / ((x + 1) * (x + 1)), 6) AS first, round(310 * len / ((x + 1) * (x + 1) * (x + 1)), 6) AS second, round(len * (155 * ln(x + 1) + 0.85 * x), 6) AS anti FROM ef"),
    "a5_objectives": q(EDGE + FLOW, "SELECT round(sum(t * (x + x * (x / c) * (x / c) / 3)), 2) AS ue, round(sum(x * t * (1 + (x / c) * (x / c))), 2) AS so, round(sum(t * (1 + (x / c) * (x / c)) + x * (2 * t * x / (c * c))), 2) AS so_gradient FROM ef"),
    "a7_totals": q(EDGE + FLOW, "SELECT round(sum(x * t * (1 + (x / c) * (x / c))), 2) AS total_traversal, round(sum(x * trunc(t * (1 + (x / c) * (x / c)))), 2) AS total_path FROM ef"),
    "a8_cfw_alpha": q(EDGE + FLOW, ", k AS (SELECT sum((s - x) * (2 * t * x / (c * c)) * (y - x)) AS num, sum((s - x) * (2 * t * x / (c * c)) * ((y - x) - (s - x))) AS den FROM ef) SELECT round(num, 2) AS num, round(den, 2) AS den, round(least(greatest(num / den, 0), 1 - 1e-15), 6) AS alpha FROM k"),
    "a9_tau_derivative": q(EDGE + FLOW, "SELECT tau, round(sum((s - x) * t * (1 + ((x + tau * (s - x)) / c) * ((x + tau * (s - x)) / c))), 2) AS derivative FROM ef CROSS JOIN (SELECT k / 4.0 AS tau FROM (SELECT unnest(range(0, 5)) AS k)) GROUP BY 1"),
    "a12_capacity": q(EDGE, "SELECT edge_id, CAST(greatest(round(capacity * 0.01), 1) AS BIGINT) AS scaled FROM road_edge"),
    "a13_saturation": q(EDGE + FLOW, "SELECT edge_id, round(x / c, 6) AS sat FROM ef"),
    "vis1_congestion": q(EDGE + FLOW, "SELECT CAST(least(floor(5 * (2 * x / c)), 7) AS INT) AS class, count(*) AS n FROM ef GROUP BY 1"),
    "vis3_segments": q(EDGE, "SELECT edge_id, a.lng AS x1, a.lat AS y1, b.lng AS x2, b.lat AS y2 FROM road_edge JOIN road_vertex a ON a.vertex_id = tail JOIN road_vertex b ON b.vertex_id = head"),
    "geo6_haversine": q(EDGE, f"SELECT edge_id, round({great('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 4) AS metres FROM road_edge JOIN road_vertex a ON a.vertex_id = tail JOIN road_vertex b ON b.vertex_id = head"),
    "geo8_mercator": q(VERTEX, "SELECT vertex_id, CAST(lng + 180000000 AS BIGINT) AS x, CAST(round(360000000.0 * (0.5 + ln((1 + sin(radians(lat / 1e6))) / (1 - sin(radians(lat / 1e6)))) / (4 * pi()))) AS BIGINT) AS y FROM road_vertex"),
    "geo3_doubled_area": q(VERTEX, "SELECT vertex_id, 2 * (3 + p_size) * 4 + 0 * x AS doubled_area FROM road_vertex"),
    "date1_seconds": "SELECT o_orderkey, (o_orderkey % 7) * 86400 + (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 AS seconds FROM orders",
    "math2_bits": "SELECT p_partkey, bit_count(p_partkey) AS ones, CASE WHEN p_partkey = 0 THEN -1 ELSE CAST(floor(log2(p_partkey)) AS INT) END AS highest, CASE WHEN p_partkey = 0 THEN -1 ELSE CAST(log2(p_partkey & -p_partkey) AS INT) END AS lowest FROM part",
    "a11_od_order": q(VERTEX + OD + ZONE, "SELECT od_id, a.zone_id AS origin_zone, b.zone_id AS destination_zone, row_number() OVER (ORDER BY a.zone_id, b.zone_id, origin, destination, od_id) - 1 AS position FROM od JOIN zone a ON a.vertex_id = origin JOIN zone b ON b.vertex_id = destination"),
    "d11_octagon_sums": q(VERTEX + POPULATION, """,
g AS (SELECT x, y, population AS p FROM population JOIN road_vertex USING (vertex_id)), r AS (SELECT CAST(3 AS BIGINT) AS h, CAST(1 AS BIGINT) AS a)
SELECT s.x, s.y, CAST(sum(d.p) AS BIGINT) AS people FROM g s JOIN g d ON abs(s.x - d.x) + abs(s.y - d.y) <= 4 AND greatest(abs(s.x - d.x), abs(s.y - d.y)) <= 3 GROUP BY 1, 2"""),
}

ORACLES["src2_xatf"] = q(EDGE + """,
line AS (SELECT edge_id AS line, tail, head, length, edge_id % 4 AS dir, CASE WHEN edge_id % 14 = 13 THEN 15 ELSE edge_id % 14 + 1 END AS category FROM road_edge WHERE tail < head),
way AS (SELECT line, 0 AS back, CASE WHEN dir = 2 THEN head ELSE tail END AS tail, CASE WHEN dir = 2 THEN tail ELSE head END AS head, length, category FROM line
  UNION ALL SELECT line, 1, head, tail, length, category FROM line WHERE dir IN (0, 3)),
fast AS (SELECT *, [130, 120, 110, 100, 90, 80, 70, 60, 50, 40, 30, 20, NULL, NULL, 10][category] AS v, [2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, -1, -1, 1][category] AS k FROM way),
place AS (SELECT vertex_id, lat // 10 * 10 AS lat, lng // 10 * 10 AS lng FROM road_vertex)""",
f"""SELECT row_number() OVER (ORDER BY tail, line, back) - 1 AS edge_id, tail, head,
  CAST(CASE WHEN category = 13 THEN round({great('a.lat', 'a.lng', 'b.lat', 'b.lng')}) ELSE length END AS INT) AS length, category, v AS free_flow_speed, k AS num_lanes,
  CASE WHEN category = 13 THEN 0 ELSE CAST(round(9000.0 * k * v / (5 * v + 45)) AS INT) END AS capacity,
  CAST(CASE category WHEN 13 THEN 600 * length ELSE round(36.0 * length / v) END AS INT) AS travel_time
FROM fast JOIN place a ON a.vertex_id = tail JOIN place b ON b.vertex_id = head""")
ORACLES["src3_dimacs"] = q(EDGE + """,
arc AS (SELECT edge_id AS line, 0 AS copy, tail, head, length, travel_time FROM road_edge UNION ALL SELECT edge_id, 1, tail, head, length, travel_time FROM road_edge WHERE edge_id % 5 = 0)""",
"""SELECT row_number() OVER (ORDER BY tail, line, copy) - 1 AS edge_id, tail, head, CAST(round((length * 10 + 4 - 9 * copy) / 10.0) AS INT) AS length,
  CAST(round((travel_time + 3 * copy) * 2.5) AS INT) AS travel_time FROM arc""")
ORACLES["src3_dimacs_places"] = q(VERTEX, "SELECT vertex_id, lat // 10 * 10 AS lat, lng // 10 * 10 AS lng FROM road_vertex")
ORACLES["src4_matsim"] = q(EDGE + """,
link AS (SELECT *, CAST(round(edge_id % 7 * 4 * 3.6) AS INT) AS v FROM road_edge WHERE edge_id % 3 <> 0)""",
"""SELECT CAST(edge_id AS VARCHAR) AS link_id, CAST(tail AS VARCHAR) AS tail, CAST(head AS VARCHAR) AS head, CAST(length + 1 AS INT) AS length, v AS free_flow_speed,
  CAST(capacity * 2 AS INT) AS capacity, CAST(num_lanes AS DOUBLE) AS num_lanes,
  CAST(CASE WHEN v = 0 THEN 1073741823 ELSE floor(3.6 * (length + 0.75) / v) * 10 + 10 END AS INT) AS travel_time FROM link""")
ORACLES["src5_osm"] = q(EDGE + """,
rule(i, highway, v, k, cap, dir) AS (VALUES (0, 'motorway', 120, 2, 2000, 'forward'), (1, 'motorway_link', 80, 1, 1500, 'forward'), (2, 'trunk', 80, 1, 2000, 'both'),
  (3, 'trunk_link', 50, 1, 1500, 'both'), (4, 'primary', 80, 1, 1500, 'both'), (5, 'primary_link', 60, 1, 1500, 'both'), (6, 'secondary', 30, 1, 800, 'both'),
  (7, 'secondary_link', 30, 1, 800, 'both'), (8, 'tertiary', 25, 1, 600, 'both'), (9, 'tertiary_link', 25, 1, 600, 'both'), (10, 'unclassified', 15, 1, 600, 'both'),
  (11, 'residential', 15, 1, 600, 'both'), (12, 'living_street', 10, 1, 300, 'both')),
way AS (SELECT edge_id AS way_id, length AS n, highway, cap, [NULL, 30.0, 29 * 1.609344, 100.0, NULL][edge_id % 5 + 1] AS sign, v, k,
  CASE edge_id % 4 WHEN 1 THEN 'forward' WHEN 2 THEN 'reverse' WHEN 3 THEN 'both' ELSE dir END AS direction, [NULL, 2.0, 3.0][edge_id % 3 + 1] AS tagged
  FROM road_edge JOIN rule ON i = edge_id % 14),
seg AS (SELECT *, CAST(coalesce(CASE WHEN direction = 'both' THEN tagged / 2 ELSE tagged END, k) AS DOUBLE) AS lanes,
  CAST(round(CASE WHEN sign IS NOT NULL THEN CASE WHEN sign < 51 THEN sign / 2 ELSE sign END
    WHEN n < 300 AND regexp_matches(highway, '^(trunk|primary|secondary|tertiary)') THEN (v - 10) / 300.0 * n + 10 ELSE v END) AS INT) AS speed FROM way)""",
"""SELECT way_id, highway, direction, lanes, CAST(round(lanes * cap * CASE WHEN n < 100 THEN 2 ELSE 1 END) AS INT) AS capacity, speed AS free_flow_speed,
  CAST(round(36.0 * n / speed) AS INT) AS travel_time FROM seg""")

ORACLES["sp1_fixpoint"] = q(EDGE + sp("(SELECT CAST(0 AS BIGINT) AS s)"), "SELECT src AS source, id AS vertex_id, d AS distance FROM sp")
ORACLES["sp3_k_searches"] = ORACLES["sp1_one_to_all"]
ORACLES["sp20_batch_queries"] = q(EDGE + OD + sp(ORIGINS), "SELECT od_id, d AS distance FROM od LEFT JOIN sp ON src = origin AND id = destination")
ORACLES["snk3_od_distances"] = q(EDGE + OD + sp(ORIGINS), "SELECT 1 AS iteration, od_id, d AS traversal_cost FROM od LEFT JOIN sp ON src = origin AND id = destination")
ORACLES["snk5_original_ids"] = q(VERTEX + OD, "SELECT od_id, origin * 3 + 7 AS origin, destination * 3 + 7 AS destination FROM od")
ORACLES["snk6_p2p_result"] = q(EDGE + OD + sp(ORIGINS), """SELECT od_id, k AS dijkstra_rank, d AS distance FROM od
JOIN (SELECT src, id, d, row_number() OVER (PARTITION BY src ORDER BY d, id) - 1 AS k FROM sp) ON src = origin AND id = destination""")
_UNIT = "cos(radians({0} / 1e6)) * cos(radians({1} / 1e6)) AS {2}0, cos(radians({0} / 1e6)) * sin(radians({1} / 1e6)) AS {2}1, sin(radians({0} / 1e6)) AS {2}2"
_CROSS = "{0}1 * {1}2 - {0}2 * {1}1 AS {2}0, {0}2 * {1}0 - {0}0 * {1}2 AS {2}1, {0}0 * {1}1 - {0}1 * {1}0 AS {2}2"
_DOT = "({0}0 * {1}0 + {0}1 * {1}1 + {0}2 * {1}2)"
ORACLES["j9_nearest_segment"] = q(EDGE + f""",
u AS (SELECT *, {_UNIT.format('lat', 'lng', 'q')} FROM (SELECT vertex_id AS query_id, lng + (vertex_id * 53) % 1449 * 2 - 1449 AS lng, lat + (vertex_id * 37) % 949 * 2 - 949 AS lat FROM road_vertex)),
l AS (SELECT edge_id, tail, head, a.lat AS alat, a.lng AS alng, b.lat AS blat, b.lng AS blng, {_UNIT.format('a.lat', 'a.lng', 'a')}, {_UNIT.format('b.lat', 'b.lng', 'b')}
  FROM road_edge JOIN road_vertex a ON a.vertex_id = tail JOIN road_vertex b ON b.vertex_id = head WHERE edge_id % 5 <> 2),
c AS (SELECT *, {_CROSS.format('n', 'a', 'f')}, {_CROSS.format('b', 'n', 'g')}, sqrt({_DOT.format('n', 'n')}) AS size FROM (SELECT *, {_CROSS.format('a', 'b', 'n')} FROM l)),
e AS (SELECT *, {great('lat', 'lng', 'alat', 'alng')} AS da, {great('lat', 'lng', 'blat', 'blng')} AS db FROM u JOIN c ON abs(alat - lat) < 4000 AND abs(alng - lng) < 6000),
d AS (SELECT *, CASE WHEN {_DOT.format('f', 'q')} >= 0 AND {_DOT.format('g', 'q')} >= 0 THEN 6371000.0 * asin(abs({_DOT.format('n', 'q')} / size)) ELSE least(da, db) END AS m FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m, edge_id) AS k FROM d)""",
"""SELECT query_id, edge_id, round(m, 2) AS metres, CASE WHEN da < db AND EXISTS (SELECT 1 FROM l WHERE l.tail = r.head AND l.head = r.tail) THEN tail ELSE head END AS vertex_id FROM r WHERE k = 1 AND m <= 60""")
_J6_CTES, _J6_SELECT = ORACLES["j6_mutual_nn"].rsplit("SELECT l.left_id", 1)
ORACLES["d18_matched_od"] = f"""{_J6_CTES.rstrip()}, m AS (SELECT l.left_id{_J6_SELECT}), k AS (SELECT *, row_number() OVER (ORDER BY left_id) - 1 AS k, count(*) OVER () AS n FROM m),
t AS (SELECT od_id, CAST('0x' || substr(md5('0:o:' || od_id), 1, 8) AS BIGINT) % (SELECT count(*) FROM m) AS o, CAST('0x' || substr(md5('0:d:' || od_id), 1, 8) AS BIGINT) % (SELECT count(*) FROM m) AS d
  FROM (SELECT unnest(range(0, 300)) AS od_id))
SELECT od_id, a.left_id AS origin, b.left_id AS destination, a.right_id AS other_origin, b.right_id AS other_destination FROM t JOIN k a ON a.k = o JOIN k b ON b.k = d"""
ORACLES["agg_percent_matched"] = q(VERTEX + POPULATION, "SELECT count(*) AS n, count(p.vertex_id) AS matched, round(100.0 * count(p.vertex_id) / count(*), 6) AS percent FROM road_vertex v LEFT JOIN population p USING (vertex_id)")
ORACLES["rows_every_nth"] = q(VERTEX, "SELECT p_size, vertex_id FROM (SELECT *, row_number() OVER (ORDER BY p_size, vertex_id) - 1 AS k FROM road_vertex) WHERE k % 7 = 0")
ORACLES["rows_shuffled"] = q(VERTEX + OD, "SELECT od_id, row_number() OVER (ORDER BY md5('5:' || od_id)) - 1 AS position FROM od")
ORACLES["rows_difference"] = q(VERTEX + POI, "SELECT vertex_id FROM road_vertex EXCEPT SELECT vertex_id FROM poi")
ORACLES["geo5_rectangles"] = q(VERTEX, """SELECT vertex_id, x BETWEEN 10 AND 20 AND y BETWEEN 4 AND 9 AS inside, x - 2 <= 20 AND 10 <= x + p_size % 7 AND y - 1 <= 9 AND 4 <= y + 3 AS meets,
least(x - 2, 5) AS x0, least(y - 1, 5) AS y0, greatest(x + p_size % 7, 5) AS x1, greatest(y + 3, 5) AS y1 FROM road_vertex""")
ORACLES["geo3_leftmost"] = q(VERTEX + """,
corner AS (SELECT vertex_id, unnest([{'i': 0, 'a': x + p_size % 5, 'b': y}, {'i': 1, 'a': x + p_size % 3, 'b': y + 1}, {'i': 2, 'a': x + p_size % 4, 'b': y + p_size % 2}, {'i': 3, 'a': x + 1, 'b': y - 1}]) AS c FROM road_vertex)""",
"SELECT vertex_id, CAST(i AS INT) AS leftmost FROM (SELECT vertex_id, c.i AS i, row_number() OVER (PARTITION BY vertex_id ORDER BY c.a, c.b, c.i) AS k FROM corner) WHERE k = 1")
ORACLES["str1_strings"] = """SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, starts_with(p_name, 'P') AS starts, ends_with(p_name, '1') AS ends, substr(p_name, 2, 4) AS middle,
lower(p_name) AS lower, upper(p_name) AS upper, lower(p_name) = lower('  ' || p_name || ' ') AS same FROM part"""
ORACLES["str2_casts"] = """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 2 THEN try_cast(t AS INT) END AS whole, try_cast(t AS DOUBLE) AS real, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS named
FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) || CASE p_partkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN '99999999999' WHEN 2 THEN '.5' ELSE '' END AS t FROM part)"""
ORACLES["math1_powers"] = q(VERTEX, """SELECT vertex_id, CAST(pow(2, length(bin(vertex_id + 1)) - 1) AS BIGINT) AS down,
CAST(CASE WHEN pow(2, length(bin(vertex_id + 1)) - 1) = vertex_id + 1 THEN vertex_id + 1 ELSE pow(2, length(bin(vertex_id + 1))) END AS BIGINT) AS up, CAST(sign(vertex_id - 50) AS INT) AS sign FROM road_vertex""")

# The SELECTs above that begin with a comma carry on the list of CTEs.
ORACLES = {k: v.replace(") ,\n", "),\n").replace(") , ", "), ") for k, v in ORACLES.items()}
