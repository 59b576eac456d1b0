"""SQL with the same results as the registered queries, for checking them."""

from __future__ import annotations

# (label, table, key column, {property key: (type tag, text expression)})
_VERTEX_TABLES = [
    ("customer", "customer", "c_custkey",
     {"name": ("String", "c_name"), "segment": ("String", "c_mktsegment"),
      "balance": ("Double", "c_acctbal")}),
    ("order", "orders", "o_orderkey",
     {"status": ("String", "o_orderstatus"), "priority": ("String", "o_orderpriority"),
      "day": ("Date", "CAST(o_orderdate AS DATE)")}),
    ("part", "part", "p_partkey",
     {"name": ("String", "p_name"), "brand": ("String", "p_brand"),
      "size": ("Integer", "p_size")}),
    ("supplier", "supplier", "s_suppkey",
     {"name": ("String", "s_name"), "balance": ("Double", "s_acctbal")}),
    ("nation", "nation", "n_nationkey", {"name": ("String", "n_name")}),
    ("region", "region", "r_regionkey", {"name": ("String", "r_name")}),
]


def _tag(name: str) -> str:
    return ("java.sql." if name in ("Date", "Timestamp") else "java.lang.") + name


def _text(kind: str, expression: str) -> str:
    if kind == "Double":
        expression = f"CAST({expression} AS DECIMAL(18,2))"
    return f"CAST({expression} AS VARCHAR)"


def _id(label: str, key: str) -> str:
    return f"'{label}_' || {key}"


_V = " UNION ALL ".join(
    f"SELECT {_id(label, key)} AS id, '{label}' AS label FROM {table}"
    for label, table, key, _ in _VERTEX_TABLES
)

_VP = " UNION ALL ".join(
    f"SELECT {_id(label, key)} AS id, '{name}' AS key, '{_tag(kind)}' AS type,"
    f" {_text(kind, expression)} AS value FROM {table} WHERE {expression} IS NOT NULL"
    for label, table, key, columns in _VERTEX_TABLES
    for name, (kind, expression) in columns.items()
)

_E = """
SELECT 'placed_' || o_orderkey AS id, 'placed' AS label,
       'customer_' || o_custkey AS src, 'order_' || o_orderkey AS dst FROM orders
UNION ALL
SELECT DISTINCT 'contains_' || l_orderkey || '_' || l_partkey, 'contains',
       'order_' || l_orderkey, 'part_' || l_partkey FROM lineitem
UNION ALL
SELECT DISTINCT 'supplies_' || l_suppkey || '_' || l_partkey, 'supplies',
       'supplier_' || l_suppkey, 'part_' || l_partkey FROM lineitem
UNION ALL
SELECT 'lives_in_' || c_custkey, 'lives_in',
       'customer_' || c_custkey, 'nation_' || c_nationkey FROM customer
UNION ALL
SELECT 'based_in_' || s_suppkey, 'based_in',
       'supplier_' || s_suppkey, 'nation_' || s_nationkey FROM supplier
UNION ALL
SELECT 'in_region_' || n_nationkey, 'in_region',
       'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation
"""

_EP = """
SELECT 'placed_' || o_orderkey AS id, 'day' AS key, 'java.sql.Date' AS type,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS value FROM orders
UNION ALL
SELECT 'contains_' || l_orderkey || '_' || l_partkey, 'weight', 'java.lang.Long',
       CAST(CAST(SUM(l_quantity) AS BIGINT) AS VARCHAR)
FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL
SELECT 'supplies_' || l_suppkey || '_' || l_partkey, 'shipments', 'java.lang.Long',
       CAST(COUNT(*) AS VARCHAR)
FROM lineitem GROUP BY l_suppkey, l_partkey
"""

_RV = "SELECT DISTINCT 'user_' || user_id AS id, 'user' AS label FROM events"
_RE = """
SELECT 'event_' || event_id AS id, event_type AS label, 'user_' || user_id AS src,
       'user_' || json_extract_string(props, '$.k') AS dst,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp
FROM events
"""

_TV = " UNION ALL ".join(
    f"SELECT {_id(label, key)} AS id, '{label}' AS label FROM {table}"
    for label, table, key, _ in _VERTEX_TABLES
    if label != "region"
)
_TE = f"""
SELECT id, label,
       CASE WHEN label IN ('supplies', 'lives_in') THEN dst ELSE src END AS src,
       CASE WHEN label IN ('supplies', 'lives_in') THEN src ELSE dst END AS dst
FROM ({_E}) WHERE label <> 'in_region'
"""

_COMMERCE = f"v AS MATERIALIZED ({_V}), e AS MATERIALIZED ({_E})"
_TRADE = f"v AS MATERIALIZED ({_TV}), e AS MATERIALIZED ({_TE})"
_REFERS = f"v AS MATERIALIZED ({_RV}), e AS MATERIALIZED ({_RE})"
_VERTEX_PROPERTIES = f"vp AS ({_VP})"
_EDGE_PROPERTIES = f"ep AS ({_EP})"

_NO_V = "label NOT IN ('supplier', 'region')"
_NO_E = "label NOT IN ('supplies', 'lives_in')"
_FLAT = "id, key, type, value"


def _commerce(body: str, *more: str) -> str:
    return f"WITH {', '.join((_COMMERCE, *more))} {body}"


def _refers(body: str, *more: str) -> str:
    return f"WITH {', '.join((_REFERS, *more))} {body}"


def _degree(endpoint: str) -> str:
    return f"SELECT {endpoint} AS id, COUNT(*) AS degree FROM e GROUP BY {endpoint}"


def _result(operator: str, tag: str, rows: str, column: str) -> str:
    return (
        f"SELECT id, '_$${operator}' AS key, 'java.lang.{tag}' AS type,"
        f" CAST({column} AS VARCHAR) AS value FROM ({rows})"
    )


def _pagerank(graph: str, reset: float, rounds: int, column: str = "r") -> str:
    """Chained rounds over the edges between vertices, then scaling."""
    steps = [
        "k AS MATERIALIZED (SELECT e.src, e.dst FROM e WHERE src IN (SELECT id FROM v)"
        " AND dst IN (SELECT id FROM v))",
        "w AS MATERIALIZED (SELECT k.src, k.dst, 1.0::DOUBLE / o.n AS w FROM k JOIN"
        " (SELECT src, COUNT(*) AS n FROM k GROUP BY src) o ON k.src = o.src)",
        "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS r FROM v)",
    ]
    for i in range(1, rounds + 1):
        steps.append(
            f"r{i} AS MATERIALIZED (SELECT v.id, {reset}::DOUBLE +"
            f" {1 - reset}::DOUBLE * COALESCE(m.s, 0) AS r FROM v LEFT JOIN"
            f" (SELECT w.dst, SUM(r{i - 1}.r * w.w) AS s FROM w JOIN r{i - 1}"
            f" ON w.src = r{i - 1}.id GROUP BY w.dst) m ON v.id = m.dst)"
        )
    return (
        f"WITH {graph}, {', '.join(steps)} SELECT id, ROUND(r * (SELECT COUNT(*)"
        f" FROM v) / (SELECT SUM(r) FROM r{rounds}), 6) AS rank FROM r{rounds}"
    )


_PLACED_COMPONENTS = """
SELECT v.id, COALESCE(g.component, v.id) AS component FROM v LEFT JOIN (
  SELECT m.id, c.component FROM (
    SELECT 'order_' || o_orderkey AS id, o_custkey FROM orders
    UNION ALL SELECT DISTINCT 'customer_' || o_custkey, o_custkey FROM orders) m
  JOIN (SELECT o_custkey, LEAST('customer_' || o_custkey,
               MIN('order_' || o_orderkey)) AS component
        FROM orders GROUP BY o_custkey) c USING (o_custkey)) g ON v.id = g.id
"""

_LINKS = """
k AS MATERIALIZED (SELECT src, dst FROM e WHERE src IN (SELECT id FROM v)
                   AND dst IN (SELECT id FROM v)),
both_ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM k
                           UNION SELECT dst, src FROM k)
"""
_WEAK = """
reach(id, other) AS (SELECT id, id FROM v
  UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways
  ON reach.other = both_ways.a)
"""
_STRONG = """
reach(id, other) AS (SELECT id, id FROM v
  UNION SELECT reach.id, k.dst FROM reach JOIN k ON reach.other = k.src)
"""
_WEAK_RESULT = "SELECT id, MIN(other) AS component FROM reach GROUP BY id"
_STRONG_RESULT = """
SELECT f.id, MIN(f.other) AS component FROM reach f
JOIN reach g ON f.id = g.other AND f.other = g.id GROUP BY f.id
"""
# Every cycle passes through nations.  ``came`` and ``went`` hold the nations a vertex
# is reached from, and reaches, with no nation in between; ``far`` closes that over
# nations.  A vertex lies on a cycle if a nation it reaches leads to one it is reached
# from, and then all three are in one component.
_TRADE_STRONG = """
t AS MATERIALIZED (SELECT e.label, e.src, e.dst FROM e WHERE src IN (SELECT id FROM v)
                   AND dst IN (SELECT id FROM v)),
c1 AS MATERIALIZED (SELECT dst AS id, src AS n FROM t WHERE label = 'lives_in'),
c2 AS MATERIALIZED (SELECT DISTINCT t.dst AS id, n FROM t JOIN c1 ON t.src = c1.id WHERE label = 'placed'),
c3 AS MATERIALIZED (SELECT DISTINCT t.dst AS id, n FROM t JOIN c2 ON t.src = c2.id WHERE label = 'contains'),
c4 AS MATERIALIZED (SELECT DISTINCT t.dst AS id, n FROM t JOIN c3 ON t.src = c3.id WHERE label = 'supplies'),
w4 AS MATERIALIZED (SELECT src AS id, dst AS n FROM t WHERE label = 'based_in'),
w3 AS MATERIALIZED (SELECT DISTINCT t.src AS id, n FROM t JOIN w4 ON t.dst = w4.id WHERE label = 'supplies'),
w2 AS MATERIALIZED (SELECT DISTINCT t.src AS id, n FROM t JOIN w3 ON t.dst = w3.id WHERE label = 'contains'),
w1 AS MATERIALIZED (SELECT DISTINCT t.src AS id, n FROM t JOIN w2 ON t.dst = w2.id WHERE label = 'placed'),
step AS MATERIALIZED (SELECT DISTINCT c4.n AS a, w4.n AS b FROM c4 JOIN w4 USING (id)),
far(a, b) AS (SELECT id, id FROM v WHERE label = 'nation'
  UNION SELECT far.a, step.b FROM far JOIN step ON far.b = step.a),
main AS MATERIALIZED (SELECT f.a AS n, MIN(f.b) AS name FROM far f
  JOIN far g ON f.a = g.b AND f.b = g.a GROUP BY f.a),
came AS (SELECT id, id AS n FROM v WHERE label = 'nation' UNION ALL FROM c1
  UNION ALL FROM c2 UNION ALL FROM c3 UNION ALL FROM c4),
went AS (SELECT id, id AS n FROM v WHERE label = 'nation' UNION ALL FROM w1
  UNION ALL FROM w2 UNION ALL FROM w3 UNION ALL FROM w4),
lies AS MATERIALIZED (SELECT went.id, MIN(main.name) AS name FROM went
  JOIN far ON went.n = far.a JOIN came ON came.id = went.id AND came.n = far.b
  JOIN main ON main.n = went.n GROUP BY went.id)
"""
_TRADE_STRONG_RESULT = """
SELECT v.id, COALESCE(s.component, v.id) AS component FROM v LEFT JOIN lies ON v.id = lies.id
LEFT JOIN (SELECT name, MIN(id) AS component FROM lies GROUP BY name) s ON lies.name = s.name
"""
_SMALLEST = """
best(id, component) USING KEY (id) AS (SELECT id, id FROM v
  UNION (SELECT both_ways.b, MIN(best.component) FROM best
         JOIN both_ways ON best.id = both_ways.a
         JOIN recurring.best AS kept ON kept.id = both_ways.b
         WHERE best.component < kept.component GROUP BY both_ways.b))
"""


def _recursive(graph: str, reach: str, body: str) -> str:
    return f"WITH RECURSIVE {graph}, {_LINKS}, {reach} {body}"


def _json(kind: str) -> str:
    """Rows as JSON, built per table since property lists differ."""
    if kind == "v":
        parts = []
        for label, table, key, columns in _VERTEX_TABLES:
            lists = ", ".join(
                f"['{name}', '{_tag(tag)}', CAST({expression} AS VARCHAR)]"
                for name, (tag, expression) in columns.items()
            )
            stamp = (
                "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"
                if label == "order"
                else "CAST(NULL AS VARCHAR)"
            )
            parts.append(
                f"SELECT {stamp} AS timestamp, 'commerce' AS datasource,"
                f" {_id(label, key)} AS id, '{label}' AS label,"
                f" [{lists}] AS properties FROM {table}"
            )
        fields = ("timestamp", "datasource", "id", "label", "properties")
        rows = " UNION ALL ".join(parts)
    else:
        fields = ("timestamp", "datasource", "id", "label", "properties", "src", "dst")
        rows = (
            "SELECT CAST(NULL AS VARCHAR) AS timestamp, 'commerce' AS datasource, e.id,"
            " e.label, CASE WHEN ep.key IS NULL THEN CAST([] AS VARCHAR[][]) ELSE"
            " [[ep.key, ep.type, ep.value]] END AS properties, e.src, e.dst"
            f" FROM ({_E}) e LEFT JOIN ({_EP}) ep ON e.id = ep.id"
        )
    packed = ", ".join(f"{f} := {f}" for f in fields)
    return (
        f"SELECT id, CAST(to_json(struct_pack({packed})) AS VARCHAR) AS json"
        f" FROM ({rows})"
    )


_LIFTED = """
SELECT v.id,
  TRY_CAST(s.value AS INTEGER) AS size, ROUND(TRY_CAST(b.value AS DOUBLE), 2) AS balance,
  d.value AS day, r.value AS brand, TRY_CAST(n.value AS INTEGER) AS name
FROM v
LEFT JOIN (SELECT * FROM vp WHERE key = 'size') s ON v.id = s.id
LEFT JOIN (SELECT * FROM vp WHERE key = 'balance') b ON v.id = b.id
LEFT JOIN (SELECT * FROM vp WHERE key = 'day') d ON v.id = d.id
LEFT JOIN (SELECT * FROM vp WHERE key = 'brand') r ON v.id = r.id
LEFT JOIN (SELECT * FROM vp WHERE key = 'name') n ON v.id = n.id
"""

_SUMMARY = """
SELECT 'vertex_label' AS section, label AS key, COUNT(*) AS value FROM v GROUP BY label
UNION ALL SELECT 'edge_label', label, COUNT(*) FROM e GROUP BY label
UNION ALL SELECT 'edge_count', 'contains', COUNT(*) FROM e WHERE label = 'contains'
UNION ALL SELECT 'out_degree', src, COUNT(*) FROM e GROUP BY src
"""

_DOMINANT = """
SELECT key, type FROM (
  SELECT key, type, ROW_NUMBER() OVER (PARTITION BY key ORDER BY COUNT(*) DESC, type) AS n
  FROM (SELECT key, type FROM vp UNION ALL SELECT key, type FROM ep)
  GROUP BY key, type) WHERE n = 1
"""

_UPSERTED = """
SELECT id, label, CAST(CASE WHEN label = 'customer' THEN 1 WHEN label IN ('order', 'part')
  THEN 3 WHEN label = 'supplier' THEN 2 ELSE 1 END AS INTEGER) AS n_properties FROM v
UNION ALL SELECT DISTINCT 'user_' || user_id, 'user', 1 FROM events
"""

_TYPED = """
SELECT id, key,
  CASE WHEN type = 'java.lang.String' THEN value END AS as_string,
  CASE WHEN type = 'java.lang.Integer' THEN TRY_CAST(value AS INTEGER) END AS as_int,
  CASE WHEN type = 'java.lang.Double' THEN ROUND(TRY_CAST(value AS DOUBLE), 2) END
    AS as_double,
  CASE WHEN type = 'java.sql.Date' THEN value END AS as_date
FROM vp
"""

_FILTERED = f"fe AS (SELECT * FROM e WHERE {_NO_E})"
_FILTERED_DEGREE = "SELECT dst AS id, COUNT(*) AS degree FROM fe GROUP BY dst"
_CUSTOMERS_AND_ORDERS = "SELECT * FROM c WHERE id LIKE 'customer%' OR id LIKE 'order%'"


ALL: dict[str, str] = {
    "graph_count": _commerce(
        "SELECT (SELECT COUNT(*) FROM v) AS V, (SELECT COUNT(*) FROM e) AS E"
    ),
    "vertex_label_count": _commerce("SELECT label, COUNT(*) AS cnt FROM v GROUP BY label"),
    "edge_label_count": _commerce("SELECT label, COUNT(*) AS cnt FROM e GROUP BY label"),
    "edge_label_filtered_count": _commerce(
        "SELECT COUNT(*) AS cnt FROM e WHERE label = 'contains'"
    ),
    "graph_summary": _commerce(_SUMMARY),
    "read_vertices_excluding": _commerce(f"SELECT id, label FROM v WHERE {_NO_V}"),
    "read_edges_excluding": _commerce(
        f"SELECT id, label, src, dst FROM e WHERE {_NO_E}"
    ),
    "vertex_headers": _commerce("SELECT 'commerce' AS datasource, id, label FROM v"),
    "edge_timestamps": _refers(
        "SELECT id, CAST(year(CAST(timestamp AS TIMESTAMP)) AS INTEGER) AS year,"
        " timestamp FROM e"
    ),
    "drop_dangling_edges": _commerce(
        "SELECT id, src, dst FROM e WHERE src IN (SELECT id FROM fv)"
        " AND dst IN (SELECT id FROM fv)",
        f"fv AS (SELECT id FROM v WHERE {_NO_V})",
    ),
    "in_degree": _commerce(_degree("dst")),
    "out_degree": _commerce(_degree("src")),
    "in_degree_zero_filled": _commerce(
        "SELECT v.id, COALESCE(d.degree, 0) AS degree FROM v LEFT JOIN d ON v.id = d.id",
        f"d AS ({_degree('dst')})",
    ),
    "out_degree_zero_filled": _commerce(
        "SELECT v.id, COALESCE(d.degree, 0) AS degree FROM v LEFT JOIN d ON v.id = d.id",
        f"d AS ({_degree('src')})",
    ),
    "in_degree_excluding_labels": _commerce(_FILTERED_DEGREE, _FILTERED),
    "in_degree_refers": _refers(_degree("dst")),
    "degree_view_join": _commerce(
        "SELECT v.id, COALESCE(d.degree, 0) AS degree FROM v LEFT JOIN d ON v.id = d.id",
        f"d AS ({_degree('src')})",
    ),
    "pagerank": _pagerank(_COMMERCE, 0.15, 10),
    "pagerank_alt_params": _pagerank(_COMMERCE, 0.01, 20),
    # The graph has paths of at most two edges: ranks are exact after three rounds.
    "pagerank_tol": _pagerank(_COMMERCE, 0.15, 10),
    "pagerank_refers": _pagerank(_REFERS, 0.15, 10),
    "pagerank_trade": _pagerank(_TRADE, 0.15, 10),
    # The ranks' error falls to a fifth in each round; after 30 it is below any digit.
    "pagerank_tol_trade": _pagerank(_TRADE, 0.8, 30),
    "pagerank_push_trade": _pagerank(_TRADE, 0.8, 30),
    "typed_variants": f"""
WITH p AS ({_VP} UNION ALL {_EP})
SELECT id, key,
  CASE type WHEN 'java.lang.String' THEN 'STRING' WHEN 'java.lang.Double' THEN 'DOUBLE'
    WHEN 'java.sql.Date' THEN 'DATE' ELSE 'BIGINT' END AS kind,
  CASE WHEN type IN ('java.lang.Double', 'java.lang.Integer', 'java.lang.Long')
    THEN ROUND(TRY_CAST(value AS DOUBLE), 2) END AS number,
  CASE WHEN type = 'java.sql.Date' THEN TRY_CAST(value AS DATE) END AS day,
  CASE WHEN type = 'java.lang.String' THEN value END AS text
FROM p""",
    "json_variants": """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  props IS NOT NULL AND json_valid(props) AS is_json FROM events""",
    "property_map_round_trip": f"SELECT {_FLAT} FROM ({_VP})",
    "property_map_lookup": f"""
SELECT v.id, p.value AS name FROM ({_V}) v
LEFT JOIN (SELECT id, value FROM ({_VP}) WHERE key = 'name') p ON v.id = p.id""",
    "wide_typed_table": f"""
SELECT v.id,
  MAX(CASE WHEN key = 'balance' THEN ROUND(CAST(value AS DOUBLE), 2) END) AS balance,
  MAX(CASE WHEN key = 'brand' THEN value END) AS brand,
  MAX(CASE WHEN key = 'day' THEN CAST(value AS DATE) END) AS day,
  MAX(CASE WHEN key = 'name' THEN value END) AS name,
  MAX(CASE WHEN key = 'priority' THEN value END) AS priority,
  MAX(CASE WHEN key = 'segment' THEN value END) AS segment,
  MAX(CASE WHEN key = 'size' THEN CAST(value AS INTEGER) END) AS size,
  MAX(CASE WHEN key = 'status' THEN value END) AS status
FROM ({_V}) v LEFT JOIN ({_VP}) p ON v.id = p.id GROUP BY v.id""",
    "connected_components": _commerce(_PLACED_COMPONENTS),
    "connected_components_commerce": _recursive(
        _COMMERCE, _SMALLEST, "SELECT id, component FROM best"
    ),
    "connected_components_refers": _recursive(_REFERS, _WEAK, _WEAK_RESULT),
    "strongly_connected_components": _recursive(_REFERS, _STRONG, _STRONG_RESULT),
    # Without cycles each vertex is a component of its own.
    "strongly_connected_components_commerce": _commerce(
        "SELECT id, id AS component FROM v"
    ),
    "strongly_connected_components_trade": (
        f"WITH RECURSIVE {_TRADE}, {_TRADE_STRONG} {_TRADE_STRONG_RESULT}"
    ),
    "component_listing": _recursive(_REFERS, _WEAK, _WEAK_RESULT),
    "component_sizes": _commerce(
        f"SELECT component, COUNT(*) AS size FROM ({_PLACED_COMPONENTS}) GROUP BY component"
    ),
    "flatten_properties": _VP,
    "flatten_edge_properties": _EP,
    "drop_keys_vertices": (
        f"WITH {_VERTEX_PROPERTIES} SELECT {_FLAT} FROM vp"
        " WHERE key NOT IN ('name', 'balance')"
    ),
    "drop_keys_edges": (
        f"WITH {_EDGE_PROPERTIES} SELECT {_FLAT} FROM ep WHERE key <> 'weight'"
    ),
    "set_in_degree_property": _commerce(
        f"SELECT {_FLAT} FROM vp UNION ALL "
        + _result("indegree", "Long", _degree("dst"), "degree"),
        _VERTEX_PROPERTIES,
    ),
    "set_out_degree_property": _commerce(
        f"SELECT {_FLAT} FROM vp UNION ALL "
        + _result("outdegree", "Long", _degree("src"), "degree"),
        _VERTEX_PROPERTIES,
    ),
    "set_pagerank_property": (
        "SELECT id, '_$$pagerank' AS key, 'java.lang.Double' AS type, rank FROM ("
        + _pagerank(_COMMERCE, 0.15, 10)
        + ")"
    ),
    "set_component_property": _recursive(
        _REFERS, _WEAK, _result("component", "String", _WEAK_RESULT, "component")
    ),
    "set_scomponent_property": _recursive(
        _REFERS, _STRONG, _result("scomponent", "String", _STRONG_RESULT, "component")
    ),
    "rerun_replaces_property": _commerce(
        _result("indegree", "Long", _FILTERED_DEGREE, "degree"), _FILTERED
    ),
    "append_property": _commerce(
        f"SELECT {_FLAT} FROM vp UNION ALL SELECT id, 'n_chars', 'java.lang.Integer',"
        " CAST(length(id) AS VARCHAR) FROM v",
        _VERTEX_PROPERTIES,
    ),
    "append_long_properties": _commerce(
        f"SELECT {_FLAT} FROM vp"
        " UNION ALL SELECT id, 'in', 'java.lang.Long', CAST(degree AS VARCHAR)"
        f" FROM ({_degree('dst')})"
        " UNION ALL SELECT id, 'out', 'java.lang.Long', CAST(degree AS VARCHAR)"
        f" FROM ({_degree('src')})",
        _VERTEX_PROPERTIES,
    ),
    "replace_property_lists": _commerce(
        "SELECT d.id, 'n_out' AS key, 'java.lang.Long' AS type,"
        " CAST(d.degree AS VARCHAR) AS value"
        f" FROM ({_degree('src')}) d JOIN v ON d.id = v.id"
    ),
    "property_key_catalogue": (
        f"WITH {_VERTEX_PROPERTIES} SELECT key, type, COUNT(*) AS cnt FROM vp"
        " GROUP BY key, type"
    ),
    "dominant_property_type": (
        f"WITH {_VERTEX_PROPERTIES}, {_EDGE_PROPERTIES} {_DOMINANT}"
    ),
    "top_property_type": (
        f"WITH {_VERTEX_PROPERTIES} SELECT type, COUNT(*) AS cnt FROM vp"
        " GROUP BY type ORDER BY cnt DESC, type LIMIT 1"
    ),
    "find_by_property": (
        "SELECT 'customer_' || c_custkey AS id FROM customer"
        " WHERE c_mktsegment = 'HOUSEHOLD'"
    ),
    "lift_typed_property": _commerce(_LIFTED, _VERTEX_PROPERTIES),
    "typed_values": f"WITH {_VERTEX_PROPERTIES} {_TYPED}",
    "upsert_merge": _commerce(_UPSERTED),
    "store_read_excluding": _commerce(
        f"SELECT id, label, src, dst FROM e WHERE {_NO_E}"
    ),
    "job_in_degree": _commerce(
        f"SELECT {_FLAT} FROM vp UNION ALL "
        + _result("indegree", "Long", _degree("dst"), "degree"),
        _VERTEX_PROPERTIES,
    ),
    "job_pagerank": (
        f"WITH {_VERTEX_PROPERTIES} SELECT {_FLAT} FROM vp UNION ALL"
        " SELECT id, '_$$pagerank', 'java.lang.Double',"
        " CAST(CAST(rank AS DECIMAL(18,6)) AS VARCHAR) FROM ("
        + _pagerank(_COMMERCE, 0.15, 10)
        + ")"
    ),
    "job_scomponent": (
        f"WITH RECURSIVE {_TRADE}, {_TRADE_STRONG}, {_VERTEX_PROPERTIES}"
        f" SELECT {_FLAT} FROM vp WHERE id NOT LIKE 'region%' UNION ALL "
        + _result("scomponent", "String", _TRADE_STRONG_RESULT, "component")
    ),
    "job_component_excluding": _commerce(
        f"SELECT {_FLAT} FROM vp UNION ALL "
        + _result("component", "String", _CUSTOMERS_AND_ORDERS, "component"),
        f"c AS ({_PLACED_COMPONENTS})",
        _VERTEX_PROPERTIES,
    ),
    "job_drop_keys": (
        f"WITH {_VERTEX_PROPERTIES} SELECT {_FLAT} FROM vp WHERE key <> 'name'"
    ),
    "table_round_trip": _commerce("SELECT label, COUNT(*) AS cnt FROM v GROUP BY label"),
    "table_from_query": _commerce(
        "SELECT id, src, dst FROM e WHERE label <> 'contains'"
    ),
    "global_view": _commerce("SELECT id, label FROM v"),
    "export_json": _json("v"),
    "export_json_edges": _json("e"),
}
