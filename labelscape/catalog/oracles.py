"""Plain SQL for the catalogue's queries, written from the definitions and independent of the library.

Distances are brute-force over all pairs; clustering is a recursive query that merges the nearest pair
per step. Every text runs on the given tables alone.
"""

from __future__ import annotations

CELLS = """cells AS (SELECT c_custkey AS cell_id, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y,
  c_mktsegment AS celltype FROM customer)"""
VECTORS = """pts AS (SELECT vec_id AS cell_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS VARCHAR) AS celltype FROM embeddings)"""
PARTS = """pts AS (SELECT p_partkey AS cell_id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 40 AS y,
  p_brand AS celltype FROM part)"""
SAMPLED = """sampled AS (SELECT cells.*, r_name AS sample FROM cells JOIN nation ON n_nationkey = y
  JOIN region ON n_regionkey = r_regionkey)"""
SETS = """sets AS (SELECT p_type AS pathway, p_brand AS gene, CAST(COUNT(*) AS DOUBLE) AS weight FROM part GROUP BY ALL)"""
GENES = "genes AS (SELECT DISTINCT p_brand AS gene FROM part)"
PAIRS = """raw_pairs AS (SELECT ligand, lead(ligand) OVER (ORDER BY ligand) AS receptor, n FROM
    (SELECT p_brand AS ligand, COUNT(*) AS n FROM part GROUP BY 1)),
  pairs AS (SELECT ligand || '|' || receptor || '|1' AS pair_id, ligand, receptor,
    CASE WHEN MAX(n) OVER () = MIN(n) OVER () THEN 1.0
      ELSE (n - MIN(n) OVER ()) / CAST(MAX(n) OVER () - MIN(n) OVER () AS DOUBLE) END AS prior
    FROM raw_pairs WHERE receptor IS NOT NULL)"""


def expr(gene: str = "p_brand") -> str:
    return f"""expr AS (SELECT o_custkey AS cell_id, {gene} AS gene, SUM(l_quantity) AS value FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def dist(a: str = "a", b: str = "b", axes: str = "xy") -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in axes) + ")"


def near(points: str = "pts", axes: str = "xy", targets: str | None = None, label: str = "celltype") -> str:
    return f"""nn AS (SELECT a.cell_id, a.{label} AS source, b.{label} AS target, MIN({dist(axes=axes)}) AS dist
  FROM {points} a CROSS JOIN {targets or points} b GROUP BY ALL)"""


MEAN = "m AS (SELECT source, target, AVG(dist) AS value FROM nn GROUP BY ALL)"


def r(column: str, name: str | None = None) -> str:
    return f"ROUND({column}, 6) + 0.0 AS {name or column}"


def query(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(c for c in ctes if c) + f"\n{select}"


MATRIX = f"SELECT source, target, {r('value')} FROM m"


def profiles(axis: str = "row") -> str:
    own, other = ("source", "target") if axis == "row" else ("target", "source")
    return f"""p AS (SELECT a.{own} AS i, b.{own} AS j, sqrt(SUM((a.value - b.value) * (a.value - b.value))) AS d
  FROM m a JOIN m b ON a.{other} = b.{other} GROUP BY ALL)"""


def clustered(method: str = "average", axis: str = "row", groups: bool = False, source: str = "m") -> str:
    """CTEs ``gm``, ``gp``, ``st`` and ``coph`` (grp, row, col, h): agglomerative merging from a matrix.

    ``source`` has (grp,) source, target, value. ``w`` is a leaf's weight when every merge halves both
    sides' weights.
    """
    own, other = ("source", "target") if axis == "row" else ("target", "source")
    grp = "grp" if groups else "0"
    link = {"average": "AVG(gp.d)", "single": "MIN(gp.d)", "complete": "MAX(gp.d)", "weighted": "SUM(a.w * b.w * gp.d)"}
    if method in link:
        best = f"""SELECT a.grp, a.cl AS ca, b.cl AS cb, {link[method]} AS d
      FROM st a JOIN st b ON a.grp = b.grp AND a.cl < b.cl JOIN gp ON gp.grp = a.grp AND gp.i = a.leaf AND gp.j = b.leaf
      GROUP BY ALL"""
    else:
        weight = "s.w" if method == "median" else "1.0 / s.n"
        scale = "sqrt(2.0 * a.n * b.n / (a.n + b.n)) * " if method == "ward" else ""
        centre = f"""(SELECT s.grp, s.cl, s.n, gm.k, SUM({weight} * gm.value) AS c FROM st s
        JOIN gm ON gm.grp = s.grp AND gm.own = s.leaf GROUP BY ALL)"""
        best = f"""SELECT a.grp, a.cl AS ca, b.cl AS cb, {scale}sqrt(SUM((a.c - b.c) * (a.c - b.c))) AS d
      FROM {centre} a JOIN {centre} b ON a.grp = b.grp AND a.k = b.k AND a.cl < b.cl
      GROUP BY a.grp, a.cl, b.cl, a.n, b.n"""
    return f"""gm AS (SELECT {grp} AS grp, {own} AS own, {other} AS k, value FROM {source}),
gp AS (SELECT a.grp, a.own AS i, b.own AS j, sqrt(SUM((a.value - b.value) * (a.value - b.value))) AS d
  FROM gm a JOIN gm b ON a.grp = b.grp AND a.k = b.k GROUP BY ALL),
st AS (SELECT grp, 0 AS step, own AS leaf, own AS cl, CAST(0 AS DOUBLE) AS h, CAST(1 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS n,
    '' AS ca, '' AS cb FROM (SELECT DISTINCT grp, own FROM gm)
  UNION ALL
  SELECT s.grp, s.step + 1, s.leaf, CASE WHEN s.cl = b.cb THEN b.ca ELSE s.cl END, b.d,
    CASE WHEN s.cl IN (b.ca, b.cb) THEN s.w / 2 ELSE s.w END,
    CASE WHEN s.cl IN (b.ca, b.cb) THEN b.na + b.nb ELSE s.n END, b.ca, b.cb
  FROM st s JOIN (SELECT q.*, (SELECT MAX(n) FROM st z WHERE z.grp = q.grp AND z.cl = q.ca) AS na,
      (SELECT MAX(n) FROM st z WHERE z.grp = q.grp AND z.cl = q.cb) AS nb
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY d, ca, cb) AS rn FROM ({best})) q WHERE rn = 1) b
    ON b.grp = s.grp),
coph AS (SELECT a.grp, a.leaf AS row, b.leaf AS col, ARG_MIN(a.h, a.step) AS h FROM st a
  JOIN st b ON a.grp = b.grp AND a.step = b.step AND a.cl = b.cl GROUP BY ALL),
smap AS (SELECT grp, row, col, h, h / MAX(h) OVER (PARTITION BY grp) AS value FROM coph)"""


MAP = f"SELECT row, col, {r('value')} FROM smap"

# ------------------------------------------------------------------ shared pieces of larger queries

SUMMARY = """sizes AS (SELECT celltype, COUNT(*) AS n FROM cells GROUP BY 1),
held AS (SELECT e.gene, c.celltype, SUM(value) AS total, SUM(CASE WHEN value > {cut} THEN 1 ELSE 0 END) AS above
  FROM expr e JOIN cells c USING (cell_id) GROUP BY ALL),
grid AS (SELECT g.gene, s.celltype, COALESCE(total, 0) AS total, COALESCE(above, 0) AS above, n
  FROM (SELECT DISTINCT gene FROM expr) g CROSS JOIN sizes s LEFT JOIN held USING (gene, celltype)),
shares AS (SELECT gene, celltype, CASE WHEN SUM(total) OVER (PARTITION BY gene) = 0 THEN 0.0
    ELSE total / SUM(total) OVER (PARTITION BY gene) END AS share, above / CAST(n AS DOUBLE) AS detected FROM grid),
raws AS (SELECT *, share * sqrt(detected) AS raw FROM shares),
summary AS (SELECT *, CASE WHEN MAX(raw) OVER g = MIN(raw) OVER g THEN CASE WHEN MAX(raw) OVER g > 0 THEN 1.0 ELSE 0.0 END
    ELSE (raw - MIN(raw) OVER g) / (MAX(raw) OVER g - MIN(raw) OVER g) END AS normalized
  FROM raws WINDOW g AS (PARTITION BY gene))"""

TOPOLOGY = """tsizes AS (SELECT celltype, COUNT(*) AS n FROM cells GROUP BY 1),
topo AS (SELECT g.gene, s.celltype, 1 - COALESCE(COUNT(e.cell_id), 0) / CAST(ANY_VALUE(s.n) AS DOUBLE) AS value
  FROM (SELECT DISTINCT gene FROM expr) g CROSS JOIN tsizes s
  LEFT JOIN (SELECT e.gene, c.celltype, e.cell_id FROM expr e JOIN cells c USING (cell_id) WHERE e.value > 50) e
    ON e.gene = g.gene AND e.celltype = s.celltype GROUP BY g.gene, s.celltype)"""

KNN = """edges AS (SELECT cell_id, neighbor FROM (SELECT a.cell_id, b.cell_id AS neighbor,
    ROW_NUMBER() OVER (PARTITION BY a.cell_id ORDER BY {d}, b.cell_id) AS rn
  FROM {points} a JOIN {points} b ON a.cell_id <> b.cell_id) WHERE rn <= {k})"""


def knn(points: str, k: int, rank: bool = False) -> str:
    if rank:
        return f"""ranked AS (SELECT * FROM (SELECT a.cell_id, b.cell_id AS neighbor, ROW_NUMBER() OVER (PARTITION BY a.cell_id ORDER BY {dist()}, b.cell_id) AS rank
  FROM {points} a JOIN {points} b ON a.cell_id <> b.cell_id) WHERE rank <= {k})"""
    return KNN.format(points=points, k=k, d=dist())


def within(points: str, setting: str, radius: float, name: str = "graph") -> str:
    return f"""{name} AS (SELECT {setting} AS setting, a.cell_id AS s, b.cell_id AS t FROM {points} a
  JOIN {points} b ON a.cell_id <> b.cell_id AND {dist()} <= {radius})"""


def falling(n: str, k: int) -> str:
    return "(" + " * ".join(f"({n} - {i})" for i in range(k)) + ")"


def enriched(points: str) -> str:
    """Edges of ``graph`` between labels, and mean and spread when labels are dealt anew: e edges, eq of them on the same pair of points,
    of edge pairs f with one source, g with one target, h from end to start, the others apart."""
    n, a, b = "n", "na", "nb"
    same = f"""(e + eq) * {falling(a, 2)} / {falling(n, 2)} + (f + g + h) * {falling(a, 3)} / {falling(n, 3)} + rest * {falling(a, 4)} / {falling(n, 4)}"""
    other = f"""e * {a} * {b} / {falling(n, 2)} + f * {a} * {falling(b, 2)} / {falling(n, 3)} + g * {falling(a, 2)} * {b} / {falling(n, 3)}
    + rest * {falling(a, 2)} * {falling(b, 2)} / {falling(n, 4)}"""
    return f"""ends AS (SELECT setting, p, CAST(SUM(o) AS DOUBLE) AS o, CAST(SUM(i) AS DOUBLE) AS i FROM (SELECT setting, s AS p, 1 AS o, 0 AS i FROM graph
    UNION ALL SELECT setting, t, 0, 1 FROM graph) GROUP BY ALL),
  turned AS (SELECT a.setting, CAST(COUNT(b.s) AS DOUBLE) AS eq FROM graph a LEFT JOIN graph b ON a.setting = b.setting AND a.s = b.t AND a.t = b.s GROUP BY 1),
  shapes AS (SELECT setting, SUM(o) AS e, SUM(o * o - o) AS f, SUM(i * i - i) AS g, 2 * (SUM(o * i) - ANY_VALUE(eq)) AS h, ANY_VALUE(eq) AS eq
    FROM ends JOIN turned USING (setting) GROUP BY 1),
  sizes AS (SELECT celltype, CAST(COUNT(*) AS DOUBLE) AS n FROM {points} GROUP BY 1),
  seen AS (SELECT setting, a.celltype AS source, b.celltype AS target, COUNT(*) AS edges FROM graph JOIN {points} a ON a.cell_id = s
    JOIN {points} b ON b.cell_id = t GROUP BY ALL),
  moments AS (SELECT setting, source, target, e * CASE WHEN source = target THEN {falling(a, 2)} ELSE {a} * {b} END / {falling(n, 2)} AS expected,
      CASE WHEN source = target THEN {same} ELSE {other} END AS square
    FROM (SELECT shapes.*, e * e - e - eq - f - g - h AS rest, x.celltype AS source, y.celltype AS target, x.n AS na, y.n AS nb,
      (SELECT SUM(n) FROM sizes) AS n FROM shapes CROSS JOIN sizes x CROSS JOIN sizes y)),
  enriched AS (SELECT setting, source, target, COALESCE(edges, 0) AS edges, expected,
      CASE WHEN square - expected * expected > 1e-9 * GREATEST(square, 1) THEN sqrt(square - expected * expected) ELSE 0 END AS spread
    FROM moments LEFT JOIN seen USING (setting, source, target))"""


ENRICHED = f"""SELECT {{setting}}source, target, CAST(edges AS BIGINT) AS edges, {r('expected')}, {r('spread')},
  {r('CASE WHEN spread > 0 THEN (edges - expected) / spread END', 'z')} FROM enriched"""


DENSE = """full_expr AS (SELECT c.cell_id, c.celltype, g.gene, COALESCE(e.value, 0) AS value
  FROM cells c CROSS JOIN (SELECT DISTINCT p_brand AS gene FROM part) g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene)"""

SOME = DENSE.replace("FROM part)", "FROM part WHERE p_brand < 'Brand#3')")
# two-sided tail of the standard normal distribution: near 0 x**(2n+1) sqrt(pi) / (2 gamma(n + 1.5)) are the terms of its series; farther out
# the density over z + 1 / (z + 2 / (z + 3 / ...))
TAIL = """CASE WHEN z <= 2 THEN 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 201),
  lambda n: exp((2 * n + 1) * ln(GREATEST(z, 1e-300) / sqrt(2)) + ln(sqrt(pi()) / 2) - lgamma(n + 1.5))))
  ELSE 2 * exp(-z * z / 2) / sqrt(2 * pi()) / list_reduce(list_prepend(CAST(z AS DOUBLE), list_transform(range(200, 0, -1), lambda k: CAST(k AS DOUBLE))),
    lambda t, k: z + k / t) END"""

SCALED = """lim AS (SELECT gene, MIN(value) AS lo, LEAST(QUANTILE_CONT(value, 0.99), MAX(value)) AS hi,
    QUANTILE_CONT(value, 0.75) FILTER (value > 0) AS thr FROM full_expr GROUP BY 1),
scaled AS (SELECT cell_id, celltype, gene, value, CASE WHEN hi = lo THEN CASE WHEN hi = 0 THEN 0.0 ELSE 1.0 END
    ELSE (LEAST(value, hi) - lo) / (hi - lo) END AS s, CASE WHEN value > thr THEN 1 ELSE 0 END AS act
  FROM full_expr JOIN lim USING (gene))"""

CONTACT = """agg AS (SELECT p.pair_id, l.celltype AS sender, q.celltype AS receiver, COUNT(*) AS cross_edge_count,
    AVG(l.s * q.s) AS strength, AVG(CAST(l.act * q.act AS DOUBLE)) AS coverage
  FROM pairs p JOIN scaled l ON l.gene = p.ligand JOIN edges e ON e.cell_id = l.cell_id
  JOIN scaled q ON q.gene = p.receptor AND q.cell_id = e.neighbor GROUP BY ALL),
cgrid AS (SELECT p.pair_id, a.celltype AS sender, b.celltype AS receiver, COALESCE(cross_edge_count, 0) AS cross_edge_count,
    COALESCE(strength, 0) AS strength, COALESCE(coverage, 0) AS coverage
  FROM pairs p CROSS JOIN (SELECT DISTINCT celltype FROM cells) a CROSS JOIN (SELECT DISTINCT celltype FROM cells) b
  LEFT JOIN agg ON agg.pair_id = p.pair_id AND agg.sender = a.celltype AND agg.receiver = b.celltype),
climit AS (SELECT pair_id, receiver, MIN(strength) AS lo, QUANTILE_CONT(strength, 0.99) AS hi FROM cgrid GROUP BY ALL),
cscale AS (SELECT QUANTILE_CONT(CAST(cross_edge_count AS DOUBLE), 0.99) AS scale FROM
  (SELECT DISTINCT sender, receiver, cross_edge_count FROM cgrid WHERE sender <> receiver AND cross_edge_count > 0)),
cnorm AS (SELECT g.*, CASE WHEN hi = lo THEN CASE WHEN hi = 0 THEN 0.0 ELSE 1.0 END
    ELSE (LEAST(strength, hi) - lo) / (hi - lo) END AS norm, LEAST(1.0, cross_edge_count / scale) AS support
  FROM cgrid g JOIN climit USING (pair_id, receiver) CROSS JOIN cscale),
contact AS (SELECT pair_id, sender, receiver, cross_edge_count, strength AS contact_strength_raw,
    norm AS contact_strength_normalized, coverage AS contact_coverage, support AS edge_support,
    CASE WHEN cross_edge_count >= 20 THEN sqrt(norm * coverage) * support ELSE 0.0 END AS local_contact FROM cnorm)"""

CONTACT_CTES = (CELLS, expr(), PAIRS, knn("cells", 6), DENSE, SCALED, CONTACT)

GIVEN_MAP = f"{near('cells')}, {MEAN}, given_map AS (SELECT source AS row, target AS col, value / MAX(value) OVER () AS value FROM m)"

SCORES = """scores AS (SELECT *, exp((ln(GREATEST(sender_anchor, 0) + 1e-8) + ln(GREATEST(receiver_anchor, 0) + 1e-8)
    + ln(GREATEST(structure_bridge, 0) + 1e-8) + ln(GREATEST(sender_expr, 0) + 1e-8)
    + ln(GREATEST(receiver_expr, 0) + 1e-8) + ln(GREATEST(local_contact, 0) + 1e-8)) / 6) * prior_confidence AS LR_score FROM (
  SELECT p.pair_id, p.ligand, p.receptor, c.sender AS sender_celltype, c.receiver AS receiver_celltype,
    '{origin}' AS anchor_source_ligand, '{origin}' AS anchor_source_receptor, '{origin}' AS structure_map_source,
    LEAST(GREATEST(1 - a.value, 0), 1) AS sender_anchor, LEAST(GREATEST(1 - b.value, 0), 1) AS receiver_anchor,
    1 - CASE WHEN c.sender = c.receiver THEN 0 ELSE g.value END AS structure_bridge,
    COALESCE(u.normalized, 0) AS sender_expr, COALESCE(v.normalized, 0) AS receiver_expr, c.local_contact,
    c.contact_strength_raw, c.contact_strength_normalized, c.contact_coverage, c.cross_edge_count,
    p.prior AS prior_confidence
  FROM pairs p JOIN contact c USING (pair_id) JOIN {topo} a ON a.gene = p.ligand AND a.celltype = c.sender
  JOIN {topo} b ON b.gene = p.receptor AND b.celltype = c.receiver
  JOIN {smap} g ON g.row = c.sender AND g.col = c.receiver
  LEFT JOIN summary u ON u.gene = p.ligand AND u.celltype = c.sender
  LEFT JOIN summary v ON v.gene = p.receptor AND v.celltype = c.receiver))"""

GIVEN_SCORES = (*CONTACT_CTES, TOPOLOGY, GIVEN_MAP, SUMMARY.format(cut=0),
                SCORES.format(origin="precomputed", topo="topo", smap="given_map"))

SCORE_SELECT = "SELECT pair_id, ligand, receptor, sender_celltype, receiver_celltype, anchor_source_ligand, " \
    "anchor_source_receptor, structure_map_source, cross_edge_count, " + ", ".join(r(c) for c in (
        "sender_anchor", "receiver_anchor", "structure_bridge", "sender_expr", "receiver_expr", "local_contact",
        "contact_strength_raw", "contact_strength_normalized", "contact_coverage", "prior_confidence", "LR_score")) + " FROM scores"


def entity_rows(cloud: str) -> tuple[str, ...]:
    """CTEs ending in ``smap`` (grp = entity): every entity added to the cells' matrix, then clustered.

    ``cloud`` is a CTE name with entity, x, y, weight.
    """
    return (
        near("cells"), MEAN,
        f"""outward AS (SELECT entity, target, SUM(d * weight) / SUM(weight) AS value FROM (
  SELECT a.entity, a.x, a.y, a.weight, b.celltype AS target, MIN({dist()}) AS d
  FROM (SELECT entity, x, y, SUM(weight) AS weight FROM {cloud} GROUP BY ALL) a CROSS JOIN cells b GROUP BY ALL) GROUP BY ALL)""",
        f"""inward AS (SELECT source, entity, AVG(d) AS value FROM (
  SELECT a.cell_id, a.celltype AS source, b.entity, MIN({dist()}) AS d
  FROM cells a CROSS JOIN (SELECT DISTINCT entity, x, y FROM {cloud}) b GROUP BY ALL) GROUP BY ALL)""",
        """whole AS (SELECT e.entity AS grp, m.source, m.target, m.value FROM m CROSS JOIN (SELECT DISTINCT entity FROM outward) e
  UNION ALL SELECT entity, entity, target, value FROM outward
  UNION ALL SELECT entity, source, entity, value FROM inward
  UNION ALL SELECT DISTINCT entity, entity, entity, 0.0 FROM outward)""",
        clustered(groups=True, source="whole"))


def visium(agg: str, symmetric: str) -> str:
    ctes = [CELLS, expr("p_type"), "sp AS (SELECT e.gene, e.value, c.* FROM expr e JOIN cells c USING (cell_id))",
            f"""nng AS (SELECT a.gene AS source, a.cell_id, a.value AS w, b.gene AS target, MIN({dist()}) AS dist
  FROM sp a CROSS JOIN sp b GROUP BY ALL)""",
            f"""unit AS (SELECT MEDIAN(d) AS unit FROM (SELECT a.cell_id, MIN({dist()}) AS d FROM cells a
  JOIN cells b ON a.cell_id <> b.cell_id GROUP BY ALL))""", agg,
            """directed AS (SELECT g.source, g.target, CASE WHEN g.source = g.target THEN 0.0 ELSE f.value / unit END AS value
  FROM (SELECT a.gene AS source, b.gene AS target FROM (SELECT DISTINCT gene FROM expr) a CROSS JOIN (SELECT DISTINCT gene FROM expr) b) g
  LEFT JOIN far f USING (source, target) CROSS JOIN unit)"""]
    if symmetric == "none":
        return query(*ctes, select=f"SELECT source, target, {r('value')} FROM directed")
    both = "LEAST(a.value, b.value)" if symmetric == "min" else "(a.value + b.value) / 2"
    return query(*ctes, select=f"""SELECT a.source, a.target, {r(both, 'value')} FROM directed a
  JOIN directed b ON a.source = b.target AND a.target = b.source""")


WEIGHTED_Q = """far AS (SELECT source, target, MIN(dist) AS value FROM (SELECT source, target, dist,
    SUM(w) OVER (PARTITION BY source, target ORDER BY dist RANGE UNBOUNDED PRECEDING) AS cum,
    SUM(w) OVER (PARTITION BY source, target) AS total FROM nng WHERE source <> target) WHERE cum >= {q} * total GROUP BY ALL)"""

ACTIVITY = """act AS (SELECT c.cell_id, t.pathway, COALESCE(s.total, 0) / t.den AS value FROM cells c
  CROSS JOIN (SELECT pathway, SUM(abs(weight)) AS den FROM sets GROUP BY 1) t
  LEFT JOIN (SELECT e.cell_id, sets.pathway, SUM(e.value * sets.weight) AS total FROM expr e JOIN sets USING (gene) GROUP BY ALL) s
    ON s.cell_id = c.cell_id AND s.pathway = t.pathway)"""


def robust(source: str, name: str) -> str:
    return f"""{name}_lim AS (SELECT pathway, QUANTILE_CONT(value, 0.01) AS lo, QUANTILE_CONT(value, 0.99) AS hi FROM {source} GROUP BY 1),
{name} AS (SELECT cell_id, pathway, CASE WHEN hi = lo THEN CASE WHEN hi = 0 THEN 0.0 ELSE 1.0 END
    ELSE (LEAST(GREATEST(value, lo), hi) - lo) / (hi - lo) END AS value FROM {source} JOIN {name}_lim USING (pathway))"""


UNIT_SCALE = """SELECT cell_id, pathway, ROUND(CASE WHEN MAX(value) OVER g = MIN(value) OVER g
    THEN CASE WHEN MAX(value) OVER g > 0 THEN 1.0 ELSE 0.0 END
    ELSE (value - MIN(value) OVER g) / (MAX(value) OVER g - MIN(value) OVER g) END, 6) + 0.0 AS value
  FROM {source} WINDOW g AS (PARTITION BY pathway)"""

RANKS = """ranked AS (SELECT cell_id, gene, (RANK() OVER (PARTITION BY cell_id ORDER BY value)
    + (COUNT(*) OVER (PARTITION BY cell_id, value) - 1) / 2.0) / COUNT(*) OVER (PARTITION BY cell_id) AS rank FROM full_expr)"""

SCHEDULE = (0.95, 0.90, 0.80, 0.70, 0.60, 0.50)
# QUANTILE_CONT needs a constant fraction, so the schedule is written out
KEPT = "cuts AS (" + " UNION ALL ".join(
    f"SELECT pathway, CAST({q} AS DOUBLE) AS q, QUANTILE_CONT(value, {q}) AS cut FROM scaled_act WHERE value > 0 GROUP BY 1"
    for q in SCHEDULE) + """),
hits AS (SELECT c.pathway, c.q, c.cut, COUNT(*) AS n FROM cuts c JOIN scaled_act a ON a.pathway = c.pathway AND a.value >= c.cut AND a.value > 0
  GROUP BY ALL HAVING COUNT(*) >= 50),
chosen AS (SELECT pathway, MAX(q) AS q, ARG_MAX(cut, q) AS cut, ARG_MAX(n, q) AS n FROM hits GROUP BY 1),
kept AS (SELECT a.* FROM scaled_act a JOIN chosen c USING (pathway) WHERE a.value >= c.cut AND a.value > 0)"""
POINT_CTES = (CELLS, expr(), SETS, ACTIVITY, robust("act", "scaled_act"), KEPT)


def gene_aggregate(method: str, name: str = "agg_rows") -> str:
    rows = f"{name}_in AS (SELECT pathway, celltype, value, weight FROM sets JOIN topo USING (gene))"
    mean = "SUM(value * weight) / SUM(weight)"
    if method == "mean":
        return f"{rows}, {name} AS (SELECT pathway, celltype, {mean} AS value FROM {name}_in GROUP BY ALL)"
    cum = f"""{name}_cum AS (SELECT *, SUM(weight) OVER (PARTITION BY pathway, celltype ORDER BY value RANGE UNBOUNDED PRECEDING) AS cum,
    SUM(weight) OVER (PARTITION BY pathway, celltype) AS total FROM {name}_in)"""
    if method == "weighted_median":
        return f"""{rows}, {cum}, {name} AS (SELECT pathway, celltype, MIN(value) FILTER (cum >= 0.5 * total) AS value
  FROM {name}_cum GROUP BY ALL)"""
    return f"""{rows}, {cum}, {name}_lim AS (SELECT pathway, celltype, MIN(value) FILTER (cum >= 0.1 * total) AS lo,
    MIN(value) FILTER (cum >= 0.9 * total) AS hi FROM {name}_cum GROUP BY ALL),
  {name} AS (SELECT pathway, celltype, {mean} AS value FROM {name}_in JOIN {name}_lim USING (pathway, celltype)
    WHERE value BETWEEN lo AND hi GROUP BY ALL)"""


HOLEY = """m AS (SELECT source, target, CASE WHEN CAST(target AS INT) - CAST(source AS INT) < 2 THEN value END AS value
  FROM (SELECT source, target, AVG(dist) AS value FROM nn GROUP BY ALL))"""
WEIGHTED = """shifted AS (SELECT *, x - 50 - LEAST(MIN(x - 50) OVER (), 0) AS weight FROM cells),
pts AS (SELECT * FROM shifted WHERE weight > {cut})"""
WEIGHTED_MEAN = """m AS (SELECT source, target, SUM(dist * weight) / SUM(weight) AS value FROM nn JOIN pts USING (cell_id) GROUP BY ALL)"""
REGION = f"""sm AS (SELECT sample, source, target, AVG(dist) AS value FROM (SELECT a.sample, a.cell_id, a.celltype AS source,
    b.celltype AS target, MIN({dist()}) AS dist FROM sampled a JOIN sampled b ON a.sample = b.sample GROUP BY ALL)
  WHERE sample IN (SELECT sample FROM sampled GROUP BY 1 HAVING COUNT(*) >= 100) GROUP BY ALL)"""
# absent pairs are 1 and the diagonal is 0, on the labels of both stages
STAGED = """staged AS (SELECT *, CASE WHEN sample < 'B' THEN 'early' ELSE 'late' END AS stage FROM sm),
st AS (SELECT stage, source, target, AVG(value) AS value FROM staged
  WHERE NOT (stage = 'early' AND 'BUILDING' IN (source, target)) AND NOT (stage = 'late' AND source = 'MACHINERY' AND target = 'FURNITURE') GROUP BY ALL),
lab AS (SELECT source AS name FROM st UNION SELECT target FROM st),
sg AS (SELECT e.stage, a.name AS source, b.name AS target, CASE WHEN a.name = b.name THEN 0.0 ELSE COALESCE(st.value, 1.0) END AS value
  FROM (SELECT DISTINCT stage FROM st) e CROSS JOIN lab a CROSS JOIN lab b
  LEFT JOIN st ON st.stage = e.stage AND st.source = a.name AND st.target = b.name)"""
ENDS = """ends AS (SELECT sample, source, target, value FROM sm WHERE sample IN ((SELECT MIN(sample) FROM sm), (SELECT MAX(sample) FROM sm))),
lab AS (SELECT source AS name FROM ends UNION SELECT target FROM ends),
grid AS (SELECT e.sample, a.name AS source, b.name AS target, CASE WHEN a.name = b.name THEN 0.0 ELSE COALESCE(m.value, 1.0) END AS value
  FROM (SELECT DISTINCT sample FROM ends) e CROSS JOIN lab a CROSS JOIN lab b
  LEFT JOIN ends m ON m.sample = e.sample AND m.source = a.name AND m.target = b.name)"""
PICKED = "picked AS (SELECT DISTINCT o_custkey AS cell_id FROM orders WHERE o_totalprice > 450000)"
TRANSCRIPTS = """cloud AS (SELECT p_type AS entity, x, y, CAST(COUNT(*) AS DOUBLE) AS weight FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN cells ON o_custkey = cell_id GROUP BY ALL)"""
TYPE_CLOUD = "cloud AS (SELECT gene AS entity, x, y, value AS weight FROM expr JOIN cells USING (cell_id))"


def structure(method: str, axis: str = "row", points: str = VECTORS) -> str:
    return query(points, near(), MEAN, clustered(method, axis), select=MAP, recursive=True)


DENDROGRAM = """merges AS (SELECT DISTINCT step, ca, cb, h FROM st WHERE step > 0),
size AS (SELECT COUNT(DISTINCT leaf) AS k FROM st),
leaves AS (SELECT leaf, ROW_NUMBER() OVER (ORDER BY leaf) - 1 AS id FROM (SELECT DISTINCT leaf FROM st)),
born AS (SELECT m.step, m.h, c.cl, COALESCE((SELECT k - 1 + MAX(p.step) FROM merges p, size WHERE p.step < m.step AND p.ca = c.cl GROUP BY k),
    (SELECT id FROM leaves WHERE leaf = c.cl)) AS child FROM merges m, (SELECT step, ca AS cl FROM merges UNION ALL SELECT step, cb FROM merges) c
  WHERE c.step = m.step),
kids AS (SELECT step, child, k - 1 + step AS parent, CASE WHEN child = MIN(child) OVER (PARTITION BY step) THEN 'left' ELSE 'right' END AS side
  FROM born, size),
walk AS (SELECT k + k - 2 AS node, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS VARCHAR) AS side, 0 AS depth FROM size
  UNION ALL SELECT kids.child, kids.parent, kids.side, walk.depth + 1 FROM walk JOIN kids ON kids.parent = walk.node)
SELECT w.node AS node_id, w.parent AS parent_id, w.side, l.leaf AS name, ROUND(COALESCE(m.h, 0.0), 6) + 0.0 AS dist,
  CASE WHEN w.depth > 0 THEN ROUND(pow(0.5, w.depth - 1), 6) + 0.0 END AS score
FROM walk w LEFT JOIN leaves l ON l.id = w.node LEFT JOIN (SELECT step, h, k FROM merges, size) m ON m.k - 1 + m.step = w.node"""

ORACLES: dict[str, str] = {
    "searcher_findee_2d": query(VECTORS, near(), MEAN, select=MATRIX),
    "searcher_findee_3d": query(VECTORS, near(axes="xyz"), MEAN, select=MATRIX),
    "searcher_findee_brand": query(PARTS, near(), MEAN, select=MATRIX),
    "searcher_findee_segment": query(CELLS, near("cells"), MEAN, select=MATRIX),
    "nearest_label_per_point": query(VECTORS, near(), select=f"SELECT cell_id, source, target, {r('dist')} FROM nn"),
    "profile_distance_rows": query(VECTORS, near(), MEAN, profiles(), select=f"SELECT i AS label_a, j AS label_b, {r('d', 'value')} FROM p"),
    "profile_distance_cols": query(VECTORS, near(), MEAN, profiles("col"), select=f"SELECT i AS label_a, j AS label_b, {r('d', 'value')} FROM p"),
    "structure_map_row": structure("average"),
    "structure_map_col": structure("average", "col"),
    **{f"structure_map_{m}": structure(m) for m in ("single", "complete", "weighted", "ward", "centroid", "median")},
    "structure_map_brand": structure("average", points=PARTS),
    "cophenetic_correlation": query(VECTORS, near(), MEAN, clustered(), recursive=True, select=f"""SELECT {r('CORR(gp.d, coph.h)', 'correlation')}
  FROM gp JOIN coph ON gp.i = coph.row AND gp.j = coph.col WHERE gp.i < gp.j"""),
    "group_mean_cophenetic": query(
        VECTORS, near(), HOLEY, "filled AS (SELECT source, target, COALESCE(value, AVG(value) OVER (PARTITION BY target), AVG(value) OVER (), 0) AS value FROM m)",
        clustered(source="filled"), select=MAP, recursive=True),
    "dendrogram_scores": query(VECTORS, near(), MEAN, clustered(axis="col"), recursive=True, select="").rstrip() + ",\n" + DENDROGRAM,
    "finite_block": query(VECTORS, near(), HOLEY, "kept AS (SELECT * FROM m WHERE source NOT IN (SELECT source FROM m WHERE value IS NULL))",
                          select=f"SELECT source, target, {r('value')} FROM kept WHERE target NOT IN (SELECT target FROM kept WHERE value IS NULL)"),
    "weighted_searcher_findee": query(CELLS, WEIGHTED.format(cut=0), near(), WEIGHTED_MEAN, select=MATRIX),
    "weighted_structure_map": query(CELLS, WEIGHTED.format(cut=10), near(), WEIGHTED_MEAN, clustered(), select=MAP, recursive=True),
    "two_table_distance": query(CELLS, """sup AS (SELECT s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y, r_name AS celltype
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""", near("cells", targets="sup"), MEAN, select=MATRIX),
    "split_by_distance": query(CELLS, f"""d AS (SELECT a.cell_id, MIN({dist()}) AS dist FROM cells a CROSS JOIN cells b
  WHERE a.celltype = 'MACHINERY' AND b.celltype = 'BUILDING' GROUP BY ALL)""", select="""SELECT c.cell_id, CASE WHEN c.celltype <> 'MACHINERY' THEN c.celltype
  WHEN d.dist < (SELECT MEDIAN(dist) FROM d) THEN 'MACHINERY_close' ELSE 'MACHINERY_far' END AS label FROM cells c LEFT JOIN d USING (cell_id)"""),
    "knn_edges": query(VECTORS, knn("pts", 8), select="SELECT cell_id, neighbor FROM edges"),
    "radius_edges": query(PARTS, select=f"""SELECT a.cell_id, b.cell_id AS neighbor, {r(dist(), 'dist')} FROM pts a
  JOIN pts b ON a.cell_id <> b.cell_id AND {dist()} <= 0.25"""),
    "nn_scale": query(VECTORS, select=f"""SELECT {r('MEDIAN(d)', 'scale')} FROM (SELECT a.cell_id, MIN({dist()}) AS d FROM pts a
  JOIN pts b ON a.cell_id <> b.cell_id GROUP BY ALL)"""),
    "label_enrichment": query(PARTS, within("pts", "'all'", 0.25), enriched("pts"), select=ENRICHED.format(setting="")),
    "label_proximity": query(CELLS, knn("cells", 6), "graph AS (SELECT 'all' AS setting, cell_id AS s, neighbor AS t FROM edges)", enriched("cells"),
                             select=f"""SELECT LEAST(source, target) AS label_a, GREATEST(source, target) AS label_b, CAST(SUM(edges) AS BIGINT) AS edges,
  {r('SUM(expected)', 'expected')}, {r('log2((SUM(edges) + 1) / (SUM(expected) + 1))', 'log_ratio')} FROM enriched GROUP BY ALL"""),
    "enrichment_sweep": query(CELLS, knn("cells", 8, rank=True), """settings AS (SELECT UNNEST([4, 6, 8]) AS k)""", within("cells", "'r=0.5'", 0.5, "g1"), within("cells", "'r=1.5'", 1.5, "g2"),
                              """graph AS (SELECT 'k=' || k AS setting, cell_id AS s, neighbor AS t FROM ranked JOIN settings ON rank <= k
  UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2)""", enriched("cells"), select=ENRICHED.format(setting="setting, ")),
    "niche_smooth": query(CELLS, expr(), knn("cells", 6), select=f"""SELECT l.cell_id, e.gene, {r('SUM(e.value) / 7', 'value')}
  FROM (SELECT * FROM edges UNION ALL SELECT cell_id, cell_id FROM cells) l JOIN expr e ON e.cell_id = l.neighbor GROUP BY ALL HAVING SUM(e.value) <> 0"""),
    "wmda": query(CELLS, expr(), "sp AS (SELECT e.gene, e.value, c.x, c.y FROM expr e JOIN cells c USING (cell_id))",
                  "ctr AS (SELECT gene, SUM(x * value) / SUM(value) AS x, SUM(y * value) / SUM(value) AS y FROM sp GROUP BY 1)",
                  select=f"""SELECT a.gene AS source, b.gene AS target, {r(f'SUM(a.value * {dist()}) / SUM(a.value)', 'value')} FROM sp a CROSS JOIN ctr b GROUP BY ALL"""),
    "ewnn": query(CELLS, expr(), "sp AS (SELECT e.gene, e.value, c.x, c.y FROM expr e JOIN cells c USING (cell_id) WHERE value > 120)",
                  select=f"""SELECT a.gene AS source, b.gene AS target, {r(f'MIN({dist()} / (sqrt(a.value) * sqrt(b.value))) + 1e-8', 'value')}
  FROM sp a CROSS JOIN sp b GROUP BY ALL"""),
    "visium_distance": visium(WEIGHTED_Q.format(q=0.9), "min"),
    "visium_mean_directed": visium("far AS (SELECT source, target, SUM(dist * w) / SUM(w) AS value FROM nng WHERE source <> target GROUP BY ALL)", "none"),
    "visium_unweighted": visium("far AS (SELECT source, target, MEDIAN(dist) AS value FROM nng WHERE source <> target GROUP BY ALL)", "mean"),
    "nn_weighted_gene": query(CELLS, expr("p_type"), "sp AS (SELECT e.gene, e.value, c.* FROM expr e JOIN cells c USING (cell_id))",
                              select=f"""SELECT source, target, {r('SUM(d * w) / SUM(w)', 'value')} FROM (SELECT a.gene AS source, a.cell_id, a.value AS w,
  b.gene AS target, MIN({dist()}) AS d FROM sp a CROSS JOIN sp b GROUP BY ALL) GROUP BY ALL"""),
    "expression_summary": query(CELLS, expr(), SUMMARY.format(cut=0), select=f"""SELECT gene, celltype, {r('share')}, {r('detected')}, {r('raw')},
  {r('normalized')} FROM summary"""),
    "expression_rank": query(CELLS, expr(), DENSE, RANKS, select=f"SELECT cell_id, gene, {r('rank')} FROM ranked"),
    "rank_label_means": query(CELLS, expr(), DENSE, RANKS, select=f"""SELECT celltype, gene, {r('AVG(rank)', 'rank')} FROM ranked
  JOIN cells USING (cell_id) GROUP BY celltype, gene"""),
    "normalized_label_means": query(
        CELLS, expr(), """logged AS (SELECT cell_id, gene, ln(1 + value * 10000 / SUM(value) OVER (PARTITION BY cell_id)) AS value FROM expr)""",
        DENSE.replace("JOIN expr e", "JOIN logged e"),
        """scored AS (SELECT celltype, gene, LEAST((value - AVG(value) OVER g) / COALESCE(NULLIF(STDDEV_SAMP(value) OVER g, 0), 1), 10) AS value
  FROM full_expr WINDOW g AS (PARTITION BY gene))""",
        select=f"SELECT celltype, gene, {r('AVG(value)', 'value')} FROM scored GROUP BY celltype, gene"),
    "normalize_log_scale": query(
        "expr AS (SELECT user_id AS cell_id, event_type AS gene, SUM(value) AS value FROM events GROUP BY ALL)",
        """logged AS (SELECT cell_id, gene, ln(1 + CASE WHEN SUM(value) OVER (PARTITION BY cell_id) = 0 THEN value
    ELSE value * 10000 / SUM(value) OVER (PARTITION BY cell_id) END) AS value FROM expr)""",
        """dense AS (SELECT c.cell_id, g.gene, COALESCE(l.value, 0) AS value FROM (SELECT DISTINCT cell_id FROM expr) c
  CROSS JOIN (SELECT DISTINCT gene FROM expr) g LEFT JOIN logged l ON l.cell_id = c.cell_id AND l.gene = g.gene)""",
        select=f"""SELECT cell_id, gene, {r('LEAST((value - AVG(value) OVER g) / COALESCE(NULLIF(STDDEV_SAMP(value) OVER g, 0), 1), 10)', 'value')}
  FROM dense WINDOW g AS (PARTITION BY gene)"""),
    "counts_per_gene": query(expr(), select=f"SELECT gene, {r('SUM(value)', 'count')} FROM expr GROUP BY ALL"),
    "entity_points": query(CELLS, expr("p_type"), """d AS (SELECT c.*, g.gene, COALESCE(e.value - 60, 0) AS value FROM cells c
  CROSS JOIN (SELECT DISTINCT gene FROM expr) g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene)""",
                           "s AS (SELECT *, value - LEAST(MIN(value) OVER (PARTITION BY gene), 0) AS weight FROM d)",
                           select=f"SELECT cell_id, {r('x')}, {r('y')}, celltype, gene AS entity, {r('weight')} FROM s WHERE weight > 0"),
    "entity_to_cell": query(CELLS, expr("p_type"), TYPE_CLOUD, *entity_rows("cloud"), recursive=True, select=f"""SELECT grp AS entity, col AS celltype,
  {r('value')} FROM smap WHERE row = grp AND col <> grp"""),
    "entity_structuremap": query(
        CELLS, expr("p_type"), TYPE_CLOUD, f"""nnw AS (SELECT a.entity AS source, a.x, a.y, a.weight, b.entity AS target, MIN({dist()}) AS d
  FROM cloud a CROSS JOIN cloud b GROUP BY ALL)""", "m AS (SELECT source, target, SUM(d * weight) / SUM(weight) AS value FROM nnw GROUP BY ALL)",
        clustered(), select=MAP, recursive=True),
    "transcript_by_cell": query(CELLS, TRANSCRIPTS, *entity_rows("cloud"), recursive=True, select=f"""SELECT grp AS gene, col AS celltype,
  {r('value')} FROM smap WHERE row = grp AND col <> grp"""),
    "lr_contact": query(*CONTACT_CTES, select="SELECT pair_id, sender, receiver, cross_edge_count, " + ", ".join(r(c) for c in (
        "contact_strength_raw", "contact_strength_normalized", "contact_coverage", "edge_support", "local_contact")) + " FROM contact"),
    "lr_scores": query(*GIVEN_SCORES, select=SCORE_SELECT),
    "lr_top_pairs": query(*GIVEN_SCORES, select=f"""SELECT lr_pair, {r('best', 'best_score')} FROM (SELECT ligand || '→' || receptor AS lr_pair, MAX(LR_score) AS best
  FROM scores GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)"""),
    "lr_summary_matrix": query(*GIVEN_SCORES, select=f"""SELECT ligand || '→' || receptor AS lr_pair, sender_celltype || '→' || receiver_celltype AS sender_receiver,
  {r('MAX(LR_score)', 'value')} FROM scores WHERE ligand || '→' || receptor IN (SELECT lr_pair FROM (SELECT ligand || '→' || receptor AS lr_pair, MAX(LR_score) AS best
  FROM scores GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)) GROUP BY ALL"""),
    "lr_hotspots": query(
        *GIVEN_SCORES, "best AS (SELECT * FROM scores ORDER BY LR_score DESC, pair_id, sender_celltype, receiver_celltype LIMIT 1)",
        """roles AS (SELECT 'sender' AS role, ligand AS feature, sender_celltype AS lab, best.* FROM best
  UNION ALL SELECT 'receiver', receptor, receiver_celltype, best.* FROM best)""",
        "cut AS (SELECT gene, QUANTILE_CONT(s, 0.9) AS cut FROM scaled GROUP BY 1)",
        select=f"""SELECT c.cell_id, {r('c.x', 'x')}, {r('c.y', 'y')}, c.celltype, role, feature, {r('s', 'score')}, sender_celltype, receiver_celltype, ligand, receptor
  FROM roles JOIN scaled ON scaled.gene = feature AND scaled.celltype = lab JOIN cut ON cut.gene = feature JOIN cells c USING (cell_id) WHERE s >= cut"""),
    "lr_target_consistency": query(
        *GIVEN_SCORES, "prior_t AS (SELECT p_brand AS ligand, p_type AS target, CAST(SUM(p_size) AS DOUBLE) AS w FROM part GROUP BY ALL)",
        """sig AS (SELECT c_mktsegment AS rec, p_type AS gene, AVG(l_quantity) AS s FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
  HAVING AVG(l_quantity) > (SELECT AVG(l_quantity) FROM lineitem))""",
        """hit AS (SELECT p.ligand, s.rec, SUM(p.w * s.s) / ANY_VALUE(t.total) AS support FROM prior_t p JOIN sig s ON s.gene = p.target
  JOIN (SELECT ligand, SUM(w) AS total FROM prior_t GROUP BY 1) t ON t.ligand = p.ligand GROUP BY ALL)""",
        """sup AS (SELECT s.pair_id, s.sender_celltype, s.receiver_celltype, s.LR_score, COALESCE(support, 0) AS v FROM scores s
  LEFT JOIN hit ON hit.ligand = s.ligand AND hit.rec = s.receiver_celltype)""",
        """scl AS (SELECT *, CASE WHEN MAX(v) OVER () = MIN(v) OVER () THEN CASE WHEN MAX(v) OVER () = 0 THEN 0.0 ELSE 1.0 END
    ELSE (v - MIN(v) OVER ()) / (MAX(v) OVER () - MIN(v) OVER ()) END AS t FROM sup)""",
        select=f"""SELECT pair_id, sender_celltype, receiver_celltype, {r('t', 'target_support')},
  {r('sqrt(LR_score * t)', 'topology_and_target_supported')} FROM scl"""),
    "lr_scores_recomputed": query(
        *CONTACT_CTES, TYPE_CLOUD, *entity_rows("cloud"),
        "etopo AS (SELECT grp AS gene, col AS celltype, value FROM smap WHERE row = grp AND col <> grp)",
        clustered().replace("gm", "bm").replace("gp", "bp").replace("st ", "bst ").replace("coph", "bcoph").replace("smap", "bmap"),
        SUMMARY.format(cut=0), SCORES.format(origin="recompute", topo="etopo", smap="bmap"), recursive=True, select=SCORE_SELECT),
    "pathway_activity_rank": query(
        CELLS, expr(), SETS, DENSE, RANKS, "act AS (SELECT cell_id, pathway, SUM(rank * abs(weight)) / SUM(abs(weight)) AS value FROM ranked JOIN sets USING (gene) GROUP BY ALL)",
        select=UNIT_SCALE.format(source="act")),
    "pathway_activity_sum": query(CELLS, expr(), SETS, ACTIVITY, select=UNIT_SCALE.format(source="act")),
    "pathway_activity_scaled": query(CELLS, expr(), SETS, ACTIVITY, robust("act", "scaled_act"), select=f"SELECT cell_id, pathway, {r('value')} FROM scaled_act"),
    "pathway_activity_smoothed": query(
        CELLS, expr(), SETS, ACTIVITY, robust("act", "scaled_act"), knn("cells", 6),
        select=f"""SELECT l.cell_id, a.pathway, {r('AVG(a.value)', 'value')} FROM (SELECT * FROM edges UNION ALL SELECT cell_id, cell_id FROM cells) l
  JOIN scaled_act a ON a.cell_id = l.neighbor GROUP BY ALL"""),
    **{f"pathway_gene_{n}": query(CELLS, expr(), SETS, TOPOLOGY, gene_aggregate(m), select=f"SELECT pathway, celltype, {r('value')} FROM agg_rows")
       for n, m in (("median", "weighted_median"), ("trimmed", "weighted_trimmed_mean"), ("mean", "mean"))},
    "pathway_points": query(*POINT_CTES, select=f"""SELECT cell_id, {r('x')}, {r('y')}, celltype, pathway AS entity, {r('value', 'weight')}
  FROM kept JOIN cells USING (cell_id)"""),
    "pathway_points_highest": query(
        CELLS, expr(), "cuts AS (SELECT gene, QUANTILE_CONT(value, 0.9999) AS cut FROM expr WHERE value > 0 GROUP BY 1)",
        """placed AS (SELECT e.*, cut, SUM(CASE WHEN value >= cut THEN 1 ELSE 0 END) OVER (PARTITION BY gene) AS enough,
    ROW_NUMBER() OVER (PARTITION BY gene ORDER BY value DESC, cell_id) AS place FROM expr e JOIN cuts USING (gene))""",
        select=f"""SELECT cell_id, {r('x')}, {r('y')}, celltype, gene AS entity, {r('value', 'weight')} FROM placed JOIN cells USING (cell_id)
  WHERE CASE WHEN enough >= 60 THEN value >= cut ELSE place <= 60 END"""),
    "pathway_diagnostics": query(*POINT_CTES, select=f"""SELECT pathway, n AS retained_cell_count, {r('q', 'retained_quantile')},
  'intrinsic' AS activity_mode FROM chosen"""),
    "pathway_mode_summary": query(
        *POINT_CTES, TOPOLOGY, gene_aggregate("weighted_median", "ga"), gene_aggregate("mean", "gb"),
        select=f"""SELECT pathway, a.lab AS aggregate_best_celltype, {r('a.v', 'aggregate_best_distance')}, b.lab AS activity_best_celltype,
  {r('b.v', 'activity_best_distance')}, c.n AS retained_cell_count, {r('c.q', 'retained_quantile')}, 'intrinsic' AS activity_mode,
  'gene_topology_aggregate' AS primary_pathway_mode, 'precomputed' AS structure_map_source
  FROM (SELECT pathway, FIRST(celltype ORDER BY value, celltype) AS lab, MIN(value) AS v FROM ga GROUP BY 1) a
  JOIN (SELECT pathway, FIRST(celltype ORDER BY value, celltype) AS lab, MIN(value) AS v FROM gb GROUP BY 1) b USING (pathway) JOIN chosen c USING (pathway)"""),
    "pathway_topology_activity": query(
        *POINT_CTES, "cloud AS (SELECT pathway AS entity, x, y, value AS weight FROM kept JOIN cells USING (cell_id))", *entity_rows("cloud"),
        recursive=True, select=f"SELECT grp AS pathway, col AS celltype, {r('value')} FROM smap WHERE row = grp AND col <> grp"),
    "pathway_topology_structuremap": query(
        CELLS, expr(), SETS, TOPOLOGY, gene_aggregate("weighted_median"),
        "pm AS (SELECT pathway AS source, celltype AS target, value FROM agg_rows)", clustered(source="pm"), select=MAP, recursive=True),
    "cluster_merge_hit_rate": query(
        CELLS, select=f"""SELECT 'urgent' AS "column", {r("AVG(CASE WHEN cell_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 1.0 ELSE 0.0 END)", 'hit_rate')} FROM cells
  UNION ALL SELECT 'big', {r("AVG(CASE WHEN cell_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 1.0 ELSE 0.0 END)", 'hit_rate')} FROM cells"""),
    "sample_matrices": query(CELLS, SAMPLED, REGION, select=f"SELECT sample, source, target, {r('value')} FROM sm"),
    "sample_structure_maps": query(CELLS, SAMPLED, REGION, "gs AS (SELECT sample AS grp, source, target, value FROM sm)",
                                   clustered(groups=True, source="gs"), recursive=True, select=f"SELECT grp AS sample, row, col, {r('value')} FROM smap"),
    "sample_mean_matrix": query(CELLS, SAMPLED, REGION, select=f"""SELECT source, target, CASE WHEN COUNT(value) = (SELECT COUNT(DISTINCT sample) FROM sm)
  THEN ROUND(AVG(value), 6) + 0.0 END AS value FROM sm GROUP BY ALL"""),
    "sample_drift": query(CELLS, SAMPLED, REGION, ENDS, select=f"""SELECT a.source, {r('AVG(abs(b.value - a.value))', 'mean_abs_delta')} FROM grid a JOIN grid b USING (source, target)
  WHERE a.sample = (SELECT MIN(sample) FROM sm) AND b.sample = (SELECT MAX(sample) FROM sm) GROUP BY ALL"""),
    "stage_mean": query(CELLS, SAMPLED, REGION, STAGED, select=f"SELECT stage, source, target, {r('value')} FROM sg"),
    "stage_drift": query(CELLS, SAMPLED, REGION, STAGED, select=f"""SELECT source, target, {r('b.value - a.value', 'delta')}, {r('abs(b.value - a.value)', 'abs_delta')}
  FROM (SELECT * FROM sg WHERE stage = 'early') a JOIN (SELECT * FROM sg WHERE stage = 'late') b USING (source, target)"""),
    "label_pairs": query(CELLS, SAMPLED, REGION, "gs AS (SELECT sample AS grp, source, target, value FROM sm)",
                         clustered(groups=True, source="gs"), recursive=True, select=f"SELECT grp AS sample, row, col, {r('value')} FROM smap WHERE row < col"),
    "expression_rank_subset": query(CELLS, expr(), SOME, RANKS, select=f"SELECT cell_id, gene, {r('rank')} FROM ranked"),
    "pathway_activity_rank_subset": query(
        CELLS, expr(), SETS, SOME, RANKS, """part_act AS (SELECT cell_id, pathway, SUM(rank * abs(weight)) / SUM(abs(weight)) AS value FROM ranked JOIN sets USING (gene) GROUP BY ALL),
  act AS (SELECT c.cell_id, p.pathway, COALESCE(a.value, 0) AS value FROM cells c CROSS JOIN (SELECT DISTINCT pathway FROM sets) p
    LEFT JOIN part_act a ON a.cell_id = c.cell_id AND a.pathway = p.pathway)""",
        select=UNIT_SCALE.format(source="act")),
    "rank_sum": query(
        CELLS, """rk AS (SELECT celltype, y < 12 AS low, x, COUNT(*) OVER (PARTITION BY celltype, x) AS t, RANK() OVER (PARTITION BY celltype ORDER BY x)
    + (COUNT(*) OVER (PARTITION BY celltype, x) - 1) / 2.0 AS rk FROM cells)""",
        """ag AS (SELECT celltype, SUM(CASE WHEN low THEN 1 ELSE 0 END) AS n1, SUM(CASE WHEN low THEN 0 ELSE 1 END) AS n2, SUM(CASE WHEN low THEN rk ELSE 0 END) AS s,
    SUM(CAST(t AS DOUBLE) * t - 1) AS ties FROM rk GROUP BY 1)""",
        select=f"""SELECT celltype, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {r('s - n1 * (n1 + 1) / 2.0', '"W"')},
  {r('z')}, {r(TAIL, 'p_value')} FROM (SELECT *, GREATEST(abs(s - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) - 0.5, 0)
    / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM ag)"""),
    "transcript_by_cell_counts": query(CELLS, select="""SELECT p_type AS gene, c.celltype, CAST(COUNT(*) AS BIGINT) AS count FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN (SELECT * FROM cells WHERE celltype < 'H') c ON c.cell_id = o_custkey GROUP BY ALL"""),
    "batch_sums": query(CELLS, select=f"""SELECT source, target, {r('SUM(dist)', 'total')}, CAST(COUNT(*) AS BIGINT) AS n FROM (
  SELECT a.cell_id, a.celltype AS source, b.celltype AS target, MIN({dist()}) AS dist FROM cells a CROSS JOIN cells b GROUP BY ALL) GROUP BY ALL"""),
    "arriving_targets": query(CELLS, near("cells"), MEAN, select=MATRIX),
    "circle_data": query(CELLS, near("cells"), MEAN, clustered(), """pc AS (SELECT a.celltype AS row, b.col, AVG(CASE WHEN a.x > b.mean THEN 1.0 ELSE 0.0 END) * 150 AS percent
  FROM cells a CROSS JOIN (SELECT celltype AS col, AVG(x) AS mean FROM cells GROUP BY 1) b GROUP BY ALL)""", recursive=True,
        select=f"""SELECT row, col, {r('value')}, {r('percent')}, {r('pow(LEAST(GREATEST(percent / 100, 0), 1), 0.5) * 100', 'area')}
  FROM smap JOIN pc USING (row, col)"""),
    "pathway_hotspots": query(
        CELLS, expr(), SETS, ACTIVITY, robust("act", "scaled_act"), TOPOLOGY, gene_aggregate("weighted_median"),
        "best AS (SELECT pathway FROM agg_rows GROUP BY 1 HAVING MIN(value) IS NOT NULL ORDER BY MIN(value), pathway LIMIT 1)",
        "own AS (SELECT * FROM scaled_act WHERE pathway IN (SELECT pathway FROM best))",
        select=f"""SELECT o.cell_id, {r('c.x', 'x')}, {r('c.y', 'y')}, c.celltype, o.pathway, {r('o.value', 'score')},
  {r('(SELECT MAX(value) FROM own)', 'retained_quantile')}, (SELECT COUNT(*) FROM own) AS retained_cell_count, 'all' AS activity_mode
  FROM own o JOIN cells c USING (cell_id) WHERE o.value >= (SELECT QUANTILE_CONT(value, 0.9) FROM own)"""),
    "selection_filter": query(CELLS, PICKED, select=f"SELECT cell_id, {r('x')}, {r('y')}, celltype FROM cells WHERE cell_id IN (SELECT cell_id FROM picked)"),
    "landmark_union": query(CELLS, PICKED, """pts AS (SELECT * FROM cells UNION ALL SELECT cell_id, x, y, 'Landmark' FROM cells
  WHERE cell_id IN (SELECT cell_id FROM picked))""", near(), MEAN, select=MATRIX),
}
