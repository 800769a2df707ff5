"""Graph operators over edge tables.

``edges(src, dst, w)`` holds both directions of an undirected graph unless said otherwise;
``nodes(id)`` lists all nodes, isolated ones too. What a join can express is SQL (triangles are
three-way joins on sorted wedges); what needs the whole matrix of a graph is a grouped map over
``functions.graph_kernels``, one task for each graph.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graph_kernels, source_kernels
from .base import SqlOperator
from .cluster import cut, ship

_DEG = "SELECT src AS u, count(*) AS k, sum(w) AS s FROM {edges} WHERE src <> dst GROUP BY src"

# Every edge from the end of lower degree to that of higher degree: a hub starts few wedges, and each
# triangle is met once. Its corners each get two, as the walk goes round either way.
_LOW = f"SELECT e.src, e.dst, e.w FROM {{edges}} e JOIN ({_DEG}) x ON e.src = x.u JOIN ({_DEG}) y ON e.dst = y.u WHERE e.src <> e.dst AND (x.k < y.k OR (x.k = y.k AND e.src < e.dst))"
_ONCE = f"SELECT a.src AS p, a.dst AS q, b.dst AS r, @CBRT(a.w * b.w * c.w) AS tw FROM ({_LOW}) a JOIN ({_LOW}) b ON a.src = b.src JOIN ({_LOW}) c ON c.src = a.dst AND c.dst = b.dst"
_TRI = f"SELECT u, count(*) * 2 AS t, sum(tw) * 2 AS tw FROM (SELECT p AS u, tw FROM ({_ONCE}) i UNION ALL SELECT q, tw FROM ({_ONCE}) j UNION ALL SELECT r, tw FROM ({_ONCE}) k) z GROUP BY u"

degrees = SqlOperator("Degree and strength of every node (BG24, BG120).",
    f"SELECT id, coalesce(k, 0) AS degree, round(coalesce(s, 0), 6) AS strength FROM {{nodes}} n LEFT JOIN ({_DEG}) d ON n.id = d.u")
degrees_dir = SqlOperator("In-, out- and total degree and strength of a directed graph (BG23, BG119).",
    "SELECT id, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree, round(coalesce(i.s, 0), 6) AS in_strength, round(coalesce(o.s, 0), 6) AS out_strength FROM {nodes} n LEFT JOIN (SELECT dst, count(*) AS k, sum(w) AS s FROM {edges} GROUP BY dst) i ON n.id = i.dst LEFT JOIN (SELECT src, count(*) AS k, sum(w) AS s FROM {edges} GROUP BY src) o ON n.id = o.src")
signed_strengths = SqlOperator("Positive and negative strength, the diagonal left out (BG121).",
    "SELECT id, round(coalesce(sum(CASE WHEN w > 0 THEN w END), 0), 6) AS positive, round(coalesce(sum(CASE WHEN w < 0 THEN -w END), 0), 6) AS negative FROM {nodes} n LEFT JOIN (SELECT src, w FROM {edges} WHERE src <> dst) e ON n.id = e.src GROUP BY id")
density_und = SqlOperator("Nodes, edges of the upper triangle with the diagonal, and density (BG26, G1).",
    "SELECT n, k, round(k * 2e0 / (n * n - n), 9) AS density FROM (SELECT count(*) AS n FROM {nodes}) a CROSS JOIN (SELECT count(*) AS k FROM {edges} WHERE src <= dst) b")
density_dir = SqlOperator("Nodes, edges and density of a directed graph (BG25, G1).",
    "SELECT n, k, round(k * 1e0 / (n * n - n), 9) AS density FROM (SELECT count(*) AS n FROM {nodes}) a CROSS JOIN (SELECT count(*) AS k FROM {edges}) b")
clustering = SqlOperator("Clustering coefficient, binary and weighted by cube roots (BG15, BG17, G2).",
    f"SELECT id, round(coalesce(CASE WHEN k > 1 THEN t * 1e0 / (k * k - k) END, 0), 6) AS c_bin, round(coalesce(CASE WHEN k > 1 THEN tw / (k * k - k) END, 0), 6) AS c_wei FROM {{nodes}} n LEFT JOIN ({_DEG}) d ON n.id = d.u LEFT JOIN ({_TRI}) t ON n.id = t.u")
transitivity = SqlOperator("Transitivity, binary and weighted (BG126, BG128).",
    f"SELECT round(sum(coalesce(t, 0)) * 1e0 / sum(k * k - k), 6) AS t_bin, round(sum(coalesce(tw, 0)) / sum(k * k - k), 6) AS t_wei FROM ({_DEG}) d LEFT JOIN ({_TRI}) t ON d.u = t.u")
_DIR = """
WITH a AS (SELECT DISTINCT src, dst FROM {edges} WHERE src <> dst),
s AS (SELECT src, dst, count(*) AS w FROM (SELECT src, dst FROM a UNION ALL SELECT dst AS src, src AS dst FROM a) x GROUP BY src, dst),
k AS (SELECT src AS u, sum(w) AS k FROM s GROUP BY src), f AS (SELECT src AS u, count(*) AS m FROM s WHERE w = 2 GROUP BY src),
t AS (SELECT x.src AS u, sum(x.w * y.w * z.w) / 2e0 AS t FROM s x JOIN s y ON x.dst = y.src JOIN s z ON y.dst = z.dst AND z.src = x.src WHERE x.src <> y.dst GROUP BY x.src),
c AS (SELECT id, coalesce(t.t, 0) AS t, coalesce(k, 0) * (coalesce(k, 0) - 1) - 2 * coalesce(m, 0) AS p FROM {nodes} n LEFT JOIN k ON n.id = k.u LEFT JOIN f ON n.id = f.u LEFT JOIN t ON n.id = t.u)"""
clustering_dir = SqlOperator("Clustering coefficient of a directed binary graph (BG14).", _DIR + " SELECT id, round(CASE WHEN t > 0 THEN t / p ELSE 0 END, 6) AS c FROM c")
transitivity_dir = SqlOperator("Transitivity of a directed binary graph (BG125).", _DIR + " SELECT round(sum(t) * 1e0 / sum(p), 6) AS t FROM c")
# Weighted directed triangles: sums of both directions' cube roots, each triple of a node once.
_DIRW = """
WITH a AS (SELECT src, dst, w FROM {edges} WHERE src <> dst AND w <> 0),
s AS (SELECT src, dst, sum(r) AS r, count(*) AS b FROM (SELECT src, dst, @CBRT(w) AS r FROM a UNION ALL SELECT dst AS src, src AS dst, @CBRT(w) FROM a) x GROUP BY src, dst),
k AS (SELECT src AS u, sum(b) AS k FROM s GROUP BY src), f AS (SELECT src AS u, count(*) AS m FROM s WHERE b = 2 GROUP BY src),
t AS (SELECT x.src AS u, sum(x.r * y.r * z.r) / 2e0 AS t FROM s x JOIN s y ON x.dst = y.src JOIN s z ON y.dst = z.dst AND z.src = x.src WHERE x.src <> y.dst GROUP BY x.src),
c AS (SELECT id, coalesce(t.t, 0) AS t, coalesce(k, 0) * (coalesce(k, 0) - 1) - 2 * coalesce(m, 0) AS p FROM {nodes} n LEFT JOIN k ON n.id = k.u LEFT JOIN f ON n.id = f.u LEFT JOIN t ON n.id = t.u)"""
clustering_wd = SqlOperator("Clustering coefficient of a directed weighted graph (BG16).", _DIRW + " SELECT id, round(CASE WHEN t > 0 THEN t / p ELSE 0 END, 6) AS c FROM c")
transitivity_wd = SqlOperator("Transitivity of a directed weighted graph (BG127).", _DIRW + " SELECT round(sum(t) / nullif(sum(p), 0), 6) AS t FROM c")
clustering_sign = SqlOperator(
    "Clustering coefficient of a signed weighted graph, of positive and of negative weights: triangles of cube roots over open pairs of weights (BG18).",
    """
WITH a AS (SELECT src, dst, CASE WHEN w > 0 THEN 1 ELSE -1 END AS sign, abs(w) AS w FROM {edges} WHERE src <> dst AND w <> 0),
k AS (SELECT src AS u, sign, count(*) AS k FROM a GROUP BY src, sign),
t AS (SELECT x.src AS u, x.sign, sum(@CBRT(x.w * y.w * z.w)) AS t FROM a x JOIN a y ON x.dst = y.src AND x.sign = y.sign JOIN a z ON y.dst = z.dst AND z.src = x.src AND x.sign = z.sign WHERE x.src <> y.dst GROUP BY x.src, x.sign),
c AS (SELECT k.u, k.sign, CASE WHEN k > 1 THEN coalesce(t, 0) / (k * (k - 1)) ELSE 0 END AS c FROM k LEFT JOIN t ON k.u = t.u AND k.sign = t.sign)
SELECT id, round(coalesce(max(CASE WHEN sign = 1 THEN c END), 0), 6) AS c_pos, round(coalesce(max(CASE WHEN sign = -1 THEN c END), 0), 6) AS c_neg FROM {nodes} n LEFT JOIN c ON n.id = c.u GROUP BY id""",
)
assortativity = SqlOperator(
    "Correlation of degrees, and of strengths, over the edges (BG5, BG6, G3).",
    f"""
WITH d AS ({_DEG}), e AS (SELECT x.k * 1e0 AS a, y.k * 1e0 AS b, x.s AS sa, y.s AS sb FROM {{edges}} e JOIN d x ON e.src = x.u JOIN d y ON e.dst = y.u WHERE src < dst),
m AS (SELECT avg(a * b) AS ab, avg((a + b) / 2) AS h, avg((a * a + b * b) / 2) AS q, avg(sa * sb) AS sab, avg((sa + sb) / 2) AS sh, avg((sa * sa + sb * sb) / 2) AS sq FROM e)
SELECT round((ab - h * h) / nullif(q - h * h, 0), 6) AS r_bin, round((sab - sh * sh) / nullif(sq - sh * sh, 0), 6) AS r_wei FROM m""",
)
assortativity_dir = SqlOperator(
    "Degree correlation of a directed graph: out-in, in-out, out-out, in-in (BG5).",
    """
WITH o AS (SELECT src AS u, count(*) * 1e0 AS k FROM {edges} GROUP BY src), i AS (SELECT dst AS u, count(*) * 1e0 AS k FROM {edges} GROUP BY dst),
e AS (SELECT coalesce(so.k, 0) AS so, coalesce(si.k, 0) AS si, coalesce(to_.k, 0) AS to_, coalesce(ti.k, 0) AS ti FROM {edges} e LEFT JOIN o so ON e.src = so.u LEFT JOIN i si ON e.src = si.u LEFT JOIN o to_ ON e.dst = to_.u LEFT JOIN i ti ON e.dst = ti.u),
p AS (SELECT 1 AS mode, so AS a, ti AS b FROM e UNION ALL SELECT 2, si, to_ FROM e UNION ALL SELECT 3, so, to_ FROM e UNION ALL SELECT 4, si, ti FROM e),
m AS (SELECT mode, avg(a * b) AS ab, avg((a + b) / 2) AS h, avg((a * a + b * b) / 2) AS q FROM p GROUP BY mode)
SELECT mode, round((ab - h * h) / nullif(q - h * h, 0), 6) AS r FROM m""",
)
local_assortativity = SqlOperator("Mean difference of strength to the neighbours, scaled by its total (BG61, positive weights).",
    f"WITH d AS ({_DEG}), m AS (SELECT e.src AS u, avg(abs(x.s - y.s)) AS gap FROM {{edges}} e JOIN d x ON e.src = x.u JOIN d y ON e.dst = y.u WHERE src <> dst GROUP BY e.src) SELECT u AS id, round(gap / (SELECT sum(gap) FROM m), 9) AS share FROM m")
path_statistics = SqlOperator("Mean distance, efficiency, eccentricity of each source, over the pairs reached (BG12, BG116, G4).",
    "SELECT a, round(avg(d * 1e0), 6) AS mean_distance, round(avg(1e0 / d), 6) AS mean_inverse, CAST(max(d) AS INT) AS eccentricity, count(*) AS reached FROM {distances} WHERE d > 0 GROUP BY a")
edge_overlap = SqlOperator(
    "Neighbourhood overlap of linked nodes: shared neighbours over all neighbours, the two left out (BG35, BG34).",
    f"""
WITH d AS ({_DEG}), c AS (SELECT e.src, e.dst, count(b.dst) AS shared FROM {{edges}} e LEFT JOIN {{edges}} a ON e.src = a.src AND a.dst <> e.dst AND a.dst <> e.src LEFT JOIN {{edges}} b ON b.src = e.dst AND b.dst = a.dst WHERE e.src < e.dst GROUP BY e.src, e.dst)
SELECT c.src, c.dst, shared, round(CASE WHEN x.k + y.k - 2 - shared > 0 THEN shared * 1e0 / (x.k + y.k - 2 - shared) ELSE 0 END, 6) AS overlap FROM c JOIN d x ON c.src = x.u JOIN d y ON c.dst = y.u""",
)
matching_index = SqlOperator(
    "Matching index of node pairs with shared neighbours: twice the shared over the links of both, their own link left out (BG71, BG72).",
    f"""
WITH d AS ({_DEG}), c AS (SELECT a.src AS i, b.src AS j, count(*) AS n FROM {{edges}} a JOIN {{edges}} b ON a.dst = b.dst AND a.src < b.src GROUP BY a.src, b.src),
l AS (SELECT src AS i, dst AS j FROM {{edges}})
SELECT c.i, c.j, round(2e0 * n / (x.k + y.k - 2 * CASE WHEN l.i IS NULL THEN 0 ELSE 1 END), 6) AS matching FROM c JOIN d x ON c.i = x.u JOIN d y ON c.j = y.u LEFT JOIN l ON c.i = l.i AND c.j = l.j""",
)
topological_overlap = SqlOperator(
    "Topological overlap of node pairs with shared neighbours, one step (BG50).",
    f"""
WITH d AS ({_DEG}), c AS (SELECT a.src AS i, b.src AS j, count(*) AS n FROM {{edges}} a JOIN {{edges}} b ON a.dst = b.dst AND a.src < b.src GROUP BY a.src, b.src), l AS (SELECT src AS i, dst AS j FROM {{edges}})
SELECT c.i, c.j, round((n + CASE WHEN l.i IS NULL THEN 0 ELSE 1 END) * 1e0 / (least(x.k, y.k) + 1 - CASE WHEN l.i IS NULL THEN 0 ELSE 1 END), 6) AS overlap FROM c JOIN d x ON c.i = x.u JOIN d y ON c.j = y.u LEFT JOIN l ON c.i = l.i AND c.j = l.j""",
)
rich_club = SqlOperator(
    "Rich club: density among nodes of degree over k (BG112, BG113).",
    f"""
WITH d AS ({_DEG}), g AS (SELECT @SERIES(CAST(1 AS BIGINT), top) AS k FROM (SELECT max(k) AS top FROM d) z), n AS (SELECT g.k, count(d.u) AS nk FROM g LEFT JOIN d ON d.k > g.k GROUP BY g.k),
m AS (SELECT least(x.k, y.k) AS lo FROM {{edges}} e JOIN d x ON e.src = x.u JOIN d y ON e.dst = y.u WHERE src <> dst), c AS (SELECT g.k, count(m.lo) AS ek FROM g LEFT JOIN m ON m.lo > g.k GROUP BY g.k)
SELECT n.k, nk, ek, round(ek * 1e0 / nullif(nk * (nk - 1), 0), 6) AS r FROM n JOIN c ON n.k = c.k""",
)
rich_club_wei = SqlOperator(
    "Weighted rich club: weight among nodes of degree k or more over the same number of heaviest edges (BG114, BG115).",
    f"""
WITH d AS ({_DEG}), g AS (SELECT @SERIES(CAST(1 AS BIGINT), top) AS k FROM (SELECT max(k) AS top FROM d) z), r AS (SELECT w, row_number() OVER (ORDER BY w DESC) AS p, sum(w) OVER (ORDER BY w DESC ROWS UNBOUNDED PRECEDING) AS top FROM {{edges}} WHERE src <> dst),
m AS (SELECT least(x.k, y.k) AS lo, w FROM {{edges}} e JOIN d x ON e.src = x.u JOIN d y ON e.dst = y.u WHERE src <> dst), c AS (SELECT g.k, count(*) AS ek, sum(w) AS sw FROM g JOIN m ON m.lo >= g.k GROUP BY g.k)
SELECT c.k, ek, round(sw, 6) AS weight, round(sw / top, 6) AS r FROM c JOIN r ON r.p = c.ek""",
)
_MOD = "SELECT e.src AS u, m.module, sum(e.w) AS s FROM {edges} e JOIN {modules} m ON e.dst = m.id WHERE e.src <> e.dst GROUP BY e.src, m.module"
participation = SqlOperator("Participation coefficient over given modules (BG90, BG91).",
    f"SELECT u AS id, round(1 - sum(s * s) / (sum(s) * sum(s)), 6) AS p FROM ({_MOD}) x GROUP BY u")
diversity = SqlOperator("Entropy of links over modules (BG31).",
    f"SELECT u AS id, round(-sum(s / total * ln(s / total)) / ln((SELECT count(DISTINCT module) FROM {{modules}}) * 1e0), 6) AS h FROM (SELECT u, s, sum(s) OVER (PARTITION BY u) AS total FROM ({_MOD}) x) y WHERE s > 0 GROUP BY u")
module_zscore = SqlOperator("Within-module degree z-score; 0 without spread (BG77).",
    f"SELECT id, module, round(coalesce((s - avg(s) OVER (PARTITION BY module)) / nullif(stddev_samp(s) OVER (PARTITION BY module), 0), 0), 6) AS z FROM (SELECT m.id, m.module, coalesce(x.s, 0) AS s FROM {{modules}} m LEFT JOIN ({_MOD}) x ON m.id = x.u AND m.module = x.module) y")
module_order = SqlOperator("Nodes in order of module, then degree; the outline of each module (BG49, BG109, O4).",
    f"SELECT id, module, pos, min(pos) OVER (PARTITION BY module) AS first_pos, max(pos) OVER (PARTITION BY module) AS last_pos FROM (SELECT m.id, m.module, CAST(row_number() OVER (ORDER BY m.module, coalesce(k, 0) DESC, m.id) AS INT) AS pos FROM {{modules}} m LEFT JOIN ({_DEG}) d ON m.id = d.u) x")
agreement = SqlOperator("Number of partitions, and their weight, in which two nodes share a community (BG2, BG3).",
    "SELECT a.id AS i, b.id AS j, count(*) AS n, round(sum(a.weight), 6) AS weight FROM {partitions} a JOIN {partitions} b ON a.part = b.part AND a.community = b.community AND a.id < b.id GROUP BY a.id, b.id")
partition_distance = SqlOperator(
    "Variation of information and normalised mutual information of two labelings (BG92).",
    """
WITH n AS (SELECT count(*) * 1e0 AS n FROM {labels}), xy AS (SELECT x, y, count(*) / max(n) AS p FROM {labels}, n GROUP BY x, y), px AS (SELECT x, sum(p) AS p FROM xy GROUP BY x), py AS (SELECT y, sum(p) AS p FROM xy GROUP BY y),
h AS (SELECT (SELECT -sum(p * ln(p)) FROM px) AS hx, (SELECT -sum(p * ln(p)) FROM py) AS hy, (SELECT -sum(p * ln(p)) FROM xy) AS hxy)
SELECT round((2 * hxy - hx - hy) / ln(n), 6) AS vi, round(2 * (hx + hy - hxy) / (hx + hy), 6) AS mi FROM h, n""",
)
joint_degree = SqlOperator("Joint histogram of in- and out-degree, with the side of the diagonal (BG51).",
    "SELECT in_degree, out_degree, count(*) AS n, CASE WHEN in_degree = out_degree THEN 'balanced' WHEN out_degree > in_degree THEN 'out' ELSE 'in' END AS side FROM {degrees} GROUP BY in_degree, out_degree")
flow_coefficient = SqlOperator("Flow coefficient: paths in-v-out between nodes that aren't linked, over n(n - 1) of the neighbours (BG44).",
    """
WITH a AS (SELECT DISTINCT src, dst FROM {edges} WHERE src <> dst), nb AS (SELECT u, count(DISTINCT v) AS n FROM (SELECT src AS u, dst AS v FROM a UNION ALL SELECT dst, src FROM a) x GROUP BY u),
f AS (SELECT i.dst AS u, count(*) AS flow FROM a i JOIN a o ON i.dst = o.src AND i.src <> o.dst LEFT JOIN a d ON d.src = i.src AND d.dst = o.dst WHERE d.src IS NULL GROUP BY i.dst)
SELECT nb.u AS id, coalesce(flow, 0) AS flow, round(CASE WHEN n > 1 THEN coalesce(flow, 0) * 1e0 / (n * n - n) ELSE 0 END, 6) AS fc FROM nb LEFT JOIN f ON nb.u = f.u""")  # fmt: skip
threshold_absolute = SqlOperator("Edges off the diagonal of at least ``thr`` (BG123, F19).", "SELECT src, dst, w FROM {edges} WHERE src <> dst AND w >= $thr", thr=2)
threshold_proportional = SqlOperator("The strongest share p of all possible undirected edges (BG124, F19).",
    "SELECT src, dst, w FROM (SELECT src, dst, w, row_number() OVER (ORDER BY w DESC, src, dst) AS r FROM {edges} WHERE src < dst) x WHERE r <= round((SELECT count(*) * (count(*) - 1) FROM {nodes}) * $p / 2)", p=0.02)
weight_conversion = SqlOperator("Weights as binary, divided by the largest, and as lengths (BG129).",
    "SELECT src, dst, 1 AS binary_w, round(w * 1e0 / (SELECT max(abs(w)) FROM {edges}), 6) AS normal_w, round(1e0 / w, 6) AS length FROM {edges} WHERE w <> 0")
triad_census = SqlOperator(
    "Connected triples of a directed graph by class: edges among the three and mutual pairs, closed or open (BG78, BG80 as counts by pattern).",
    """
WITH a AS (SELECT DISTINCT src, dst FROM {edges} WHERE src <> dst), p AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS w FROM a GROUP BY 1, 2),
t AS (SELECT x.u AS i, x.v AS j, y.v AS k, x.w + y.w + coalesce(z.w, 0) AS arcs, (x.w - 1) + (y.w - 1) + (coalesce(z.w, 1) - 1) AS mutual, CASE WHEN z.w IS NULL THEN 2 ELSE 3 END AS sides FROM p x JOIN p y ON x.u = y.u AND x.v < y.v LEFT JOIN p z ON z.u = x.v AND z.v = y.v
 UNION ALL SELECT x.u, x.v, y.v, x.w + y.w, x.w - 1 + y.w - 1, 2 FROM p x JOIN p y ON x.v = y.u LEFT JOIN p z ON z.u = x.u AND z.v = y.v WHERE z.w IS NULL
 UNION ALL SELECT x.u, y.u, x.v, x.w + y.w, x.w - 1 + y.w - 1, 2 FROM p x JOIN p y ON x.v = y.v AND x.u < y.u LEFT JOIN p z ON z.u = x.u AND z.v = y.u WHERE z.w IS NULL)
SELECT CAST(sides AS INT) AS sides, CAST(arcs AS INT) AS arcs, CAST(mutual AS INT) AS mutual, count(*) AS n FROM t GROUP BY 1, 2, 3""",
)
walk_counts = SqlOperator("Walks of two and three steps between nodes (BG43).",
    "WITH w2 AS (SELECT a.src, b.dst, count(*) AS n FROM {edges} a JOIN {edges} b ON a.dst = b.src GROUP BY a.src, b.dst) SELECT 2 AS q, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS walks FROM w2 UNION ALL SELECT 3, count(*), CAST(sum(n) AS BIGINT) FROM (SELECT w2.src, c.dst, sum(w2.n) AS n FROM w2 JOIN {edges} c ON w2.dst = c.src GROUP BY w2.src, c.dst) x")
spatial_edges = SqlOperator("Line segments of edges between placed nodes (BG1).",
    "SELECT e.src, e.dst, round(a.x, 6) AS x0, round(a.y, 6) AS y0, round(b.x, 6) AS x1, round(b.y, 6) AS y1 FROM {edges} e JOIN {places} a ON e.src = a.unit JOIN {places} b ON e.dst = b.unit WHERE e.src < e.dst")
rentian_boxes = SqlOperator("Nodes inside given boxes and edges that leave them (BG105, BG106).",
    "WITH i AS (SELECT box, unit FROM {boxes} JOIN {places} ON x > x0 AND x < x1 AND y > y0 AND y < y1), n AS (SELECT box, count(*) AS nodes FROM i GROUP BY box), c AS (SELECT i.box, count(*) AS crossing FROM i JOIN {edges} e ON i.unit = e.src LEFT JOIN i j ON j.box = i.box AND j.unit = e.dst WHERE j.unit IS NULL GROUP BY i.box) SELECT n.box, nodes, coalesce(crossing, 0) AS crossing FROM n LEFT JOIN c ON n.box = c.box")
pajek_lines = SqlOperator("Lines of a Pajek file: vertices, then edges with weights (BG130, S16).",
    "SELECT 0 AS part, id AS a, CAST(0 AS BIGINT) AS b, concat(CAST(id AS VARCHAR(20)), ' \"', CAST(id AS VARCHAR(20)), '\"') AS line FROM {nodes} UNION ALL SELECT 1, src, dst, concat(CAST(src AS VARCHAR(20)), ' ', CAST(dst AS VARCHAR(20)), ' ', CAST(CAST(w AS BIGINT) AS VARCHAR(20))) FROM {edges} WHERE src <= dst")


def dense(edges: DataFrame, nodes: DataFrame, kernel: str, schema: str, **params) -> DataFrame:  # noqa: ANN003
    """Applies a matrix kernel to each graph of ``edges(g, src, dst, w)`` with ``nodes(g, id)``. A
    kernel takes (A, ids, rng, **params) and returns columns of ``schema``; randomness is seeded by
    graph. One task holds one graph: meant for graphs of a few thousand nodes, any number of them."""
    ship(edges.sparkSession)
    fn = getattr(graph_kernels, kernel)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(right["id"].unique())
        a = np.zeros((len(ids), len(ids)))
        place = pd.Series(range(len(ids)), index=ids)
        if len(left):
            a[place[left["src"]].to_numpy(), place[left["dst"]].to_numpy()] = left["w"].to_numpy(float)
        rng = np.random.default_rng(zlib.crc32(str(key[0]).encode()))
        out = pd.DataFrame(dict(zip(names[1:], fn(a, ids, rng, **params), strict=True)))
        out.insert(0, names[0], key[0])
        return out

    return edges.groupBy("g").cogroup(nodes.groupBy("g")).applyInPandas(run, schema)


def by_sources(edges: DataFrame, nodes: DataFrame, kernel: str, schema: str, whole: bool = False, loops: bool = False, seeded: bool = False, **params) -> DataFrame:  # noqa: ANN003
    """Applies a kernel of ``functions.source_kernels`` to each graph of ``edges(g, src, dst, w)`` with
    ``nodes(g, id)`` as sources. Sources are dealt to as many parts as there are cores, twice over;
    a part gets all arcs, 24 bytes each, and writes its rows as they come. Partial sums of parts are
    left to the caller. A kernel that needs the ``whole`` graph at once gets it in one task, as
    arcs; loops are kept where said, and randomness is seeded by graph."""
    spark = edges.sparkSession
    ship(spark)
    fn = getattr(source_kernels, kernel)
    parts = 1 if whole else 2 * spark.sparkContext.defaultParallelism
    text = dict(edges.dtypes)["g"] == "string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    out = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def rows(g, got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        t = pa.Table.from_batches(got)
        src, dst, w = (t.column(k).to_numpy() for k in ("src", "dst", "w"))
        arc = ~np.isnan(w)
        ids, at = np.unique(np.r_[src, dst[arc]], return_inverse=True)
        u, v = at[: len(src)], at[len(src) :]
        arcs = source_kernels.Arcs(len(ids), u[arc], v, w[arc], loops)
        more = {"rng": np.random.default_rng(zlib.crc32(str(g).encode()))} if seeded else {}
        for columns in fn(arcs, ids, np.unique(u[~arc]), **more, **params):
            for k in range(0, len(columns[0]), 200_000):
                part = [pa.array(np.asarray(c[k : k + 200_000])) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(g, kinds["string" if text else "long"]), len(part[0])), *(x.cast(f.type) for x, f in zip(part, list(out)[1:], strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []
        for b in batches:
            g = b.column(0).to_pylist() if b.num_rows else []
            ends = [0, *(k for k in range(1, len(g)) if g[k] != g[k - 1]), len(g)]
            for lo, hi in zip(ends, ends[1:], strict=False):
                if got and hi > lo and g[lo] != now:
                    yield from rows(now, got)
                    got = []
                if hi > lo:
                    now = g[lo]
                    got.append(b.slice(lo, hi - lo))
        if got:
            yield from rows(now, got)

    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    own = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    long = lambda c: F.col(c).cast("long")
    table = edges.select("g", long("src").alias("src"), long("dst").alias("dst"), F.col("w").cast("double").alias("w"), every)
    table = table.unionByName(nodes.select("g", long("id").alias("src"), long("id").alias("dst"), F.lit(float("nan")).alias("w"), own))
    return table.repartitionById(parts, F.col("part")).drop("part").sortWithinPartitions("g").mapInArrow(run, schema)


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Components and their sizes by minimum labels with pointer jumping (BG48): every round is two
    joins, written to the checkpoint folder; ends when no label changes."""
    labels = nodes.select("id", F.col("id").alias("label"))
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    before = None
    while True:
        near = both.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("id") == F.col("src"), "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = hooked.select(F.col("id").alias("j_id"), F.col("label").alias("j_label"))
        labels = cut(hooked.join(jump, F.col("label") == F.col("j_id")).select("id", F.col("j_label").alias("label")))
        now = labels.agg(F.sum("label")).first()[0]
        if now == before:
            break
        before = now
    return labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label").select("id", F.col("label").alias("component"), "size")


def hop_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Hop distances (a, b, d) from every source to the nodes it reaches, itself included (BG10, BG11,
    BG28, BG104): breadth first from blocks of sources, whose pairs are written as they are found
    and never joined."""
    arcs = edges.select(F.lit(0).cast("long").alias("g"), "src", "dst", F.lit(1.0).alias("w")).distinct()
    found = by_sources(arcs, sources.select(F.lit(0).cast("long").alias("g"), "id"), "hop_pairs", "g long, a long, b long, d int")
    return found.drop("g")


def core_numbers(edges: DataFrame) -> DataFrame:
    """Largest k for which a node is in the k-core (BG52-BG55) of ``edges`` in both directions.

    Starting with degrees, a node takes the largest h such that h of its neighbours have a value
    of h or more; values only fall, and where none does they are the core numbers. A round is one
    join and one window; the neighbours of a node are sorted on disk where they don't fit."""
    arcs = cut(edges.select("src", "dst").where("src <> dst").distinct())
    core = cut(arcs.groupBy("src").agg(F.count("*").alias("coreness")).withColumnRenamed("src", "id"))
    total = core.agg(F.sum("coreness")).first()[0]
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("coreness")))
    while True:
        ranked = arcs.join(core, F.col("dst") == F.col("id")).select("src", F.least(rank.cast("long"), "coreness").alias("h"))
        core = cut(ranked.groupBy("src").agg(F.max("h").alias("coreness")).withColumnRenamed("src", "id"))
        now = core.agg(F.sum("coreness")).first()[0]
        if now == total:
            return core
        total = now
