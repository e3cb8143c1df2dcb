"""DuckDB SQL for the engine's queries, straight from the relational tables."""

from __future__ import annotations

from .queries import ID, ORG, OVER, SELECTS, SWEEP, UNKNOWN

LINES = "SELECT l_orderkey, l_linestatus, l_linenumber, l_partkey, l_suppkey, l_returnflag AS name, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS bp FROM lineitem"
ORDERS = "SELECT o_orderkey AS id, o_custkey AS customer_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS status FROM orders"
HEAD = "SELECT table_path, column_name, type, n_values < visits AS nullable, CAST(visits AS BIGINT) AS visits, CAST(n_values AS BIGINT) AS n_values, CAST(nulls AS BIGINT) AS nulls, CAST(visits - n_values - nulls AS BIGINT) AS absent, false AS widened, false AS big FROM ("
NAMES = ") AS t(table_path, column_name, type, visits, n_values, nulls)"


def report(rows: list[tuple[str, str, str, str, str, str]], counts: str) -> str:
    values = ", ".join(f"('{p}', '{c}', '{t}', {v}, {n}, {z})" for p, c, t, v, n, z in rows)
    return f"WITH c AS (SELECT {counts}) {HEAD} SELECT u.* FROM c, LATERAL (VALUES {values}) u {NAMES}"


CUSTOMERS = report([
    (".", "id", "int", "c.cu", "c.cu", "0"), (".", "name", "str", "c.cu", "c.cu", "0"), (".", "orders", "coll", "c.cu", "c.cuo", "0"), (".", "segment", "str", "c.cu", "c.cu", "0"),
    (".orders[]", "cents", "int", "c.o", "c.o", "0"), (".orders[]", "id", "int", "c.o", "c.o", "0"), (".orders[]", "shipments", "coll", "c.o", "c.os", "0"), (".orders[]", "status", "str", "c.o", "c.o", "0"),
    (".orders[].shipments[]", "items", "coll", "c.s", "c.s", "0"), (".orders[].shipments[]", "status", "str", "c.s", "c.s", "0"),
    *((".orders[].shipments[].items[]", n, t, "c.l", "c.l", "0") for n, t in (("bp", "int"), ("cents", "int"), ("line", "int"), ("name", "str")))],
    "(SELECT count(*) FROM customer) AS cu, (SELECT count(DISTINCT o_custkey) FROM orders) AS cuo, (SELECT count(*) FROM orders) AS o, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS os, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem)) AS s, (SELECT count(*) FROM lineitem) AS l")
EVENTS = report([
    *((".", n, t, "c.e", "c.e", "0") for n, t in (("cents", "int"), ("id", "int"))), (".", "note", "str", "c.e", "c.e2", "c.e0"), (".", "props", "coll", "c.e", "c.e", "0"), (".", "type", "str", "c.e", "c.e", "0"), (".", "user", "int", "c.e", "c.e", "0"),
    (".props{}", "value", "int", "c.e", "c.e", "0")],
    "count(*) AS e, count(*) FILTER (event_id % 3 = 0) AS e0, count(*) FILTER (event_id % 3 = 2) AS e2 FROM events")
LABELLED = report([
    (".", "id", "int", "c.d", "c.d", "0"), (".", "label", "ref", "c.d", "c.l", "0"), (".", "lang", "str", "c.d", "c.d", "0"), (".", "text", "str", "c.d", "c.t", "0"), (".label", "quality", "int", "c.l", "c.l", "0"), (".label", "toxic", "int", "c.l", "c.l", "0")],
    "(SELECT count(*) FROM documents) AS d, (SELECT count(text) FROM documents) AS t, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS l")
LONE = report([
    (".", "id", "int", "c.o", "c.o", "0"), (".", "items", "coll", "c.o", "c.o", "0"), (".items[]", "cents", "int", "c.l", "c.l", "0"), (".items[]", "line", "int", "c.l", "c.l", "0")],
    "(SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem) AS l")
ALIKE = report([(".", n, t, "c.n", "c.n", "0") for n, t in (("NAME", "bool"), ("Name", "int"), ("id", "int"), ("name", "str"))], "count(*) AS n FROM nation")
MARKS = report([(".", n, t, "c.n", "c.n", "0") for n, t in (("id", "int"), ("key", "uuid"), ("n", "float"), ("some", "str"))], "count(*) AS n FROM customer").replace("false AS widened, false AS big", "column_name = 'n' AS widened, column_name = 'n' AS big")
REFUSED = """SELECT c_custkey AS doc_ord, CASE c_custkey % 7 WHEN 3 THEN 'duplicateMember' WHEN 5 THEN 'duplicateMember' WHEN 4 THEN 'arrayElementNotObject' ELSE 'invalidJson' END AS code,
  CASE c_custkey % 7 WHEN 3 THEN '.at' WHEN 5 THEN '.xs[].k' END AS path, CASE c_custkey % 7 WHEN 3 THEN 'n' WHEN 5 THEN 'id' END AS name FROM customer WHERE c_custkey % 7 > 0"""
VECTORS = report([
    (".", "embedding", "coll", "c.v", "c.v", "0"), (".", "id", "int", "c.v", "c.v", "0"), (".", "label", "int", "c.v", "c.v", "0"), (".embedding[]", "value", "float", "c.x", "c.x", "0")],
    "count(*) AS v, sum(len(embedding)) AS x FROM embeddings")

DOCUMENT = f"""SELECT count(DISTINCT o_orderkey) AS n1, count(DISTINCT (l_orderkey, l_linestatus)) FILTER (l_orderkey IS NOT NULL) AS n2, count(l_orderkey) AS n3, CAST(coalesce(sum(cents), 0) AS BIGINT) AS total
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN ({LINES}) ON l_orderkey = o_orderkey WHERE c_custkey = {{id}} GROUP BY c_custkey"""
SCAN = f"SELECT count(*) AS n FROM ({LINES}) WHERE cents > {OVER}"
COMPUTED = f"SELECT coalesce(CAST(sum(cents * bp) AS DOUBLE), 0.0) AS total FROM ({LINES}) WHERE cents > {OVER}"
BY_NAME = f"SELECT name, max(cents) AS largest FROM ({LINES}) GROUP BY name HAVING max(cents) > 0"
THREE_HOP = f"SELECT CAST(coalesce(sum(cents), 0) AS BIGINT) AS total FROM ({LINES}) WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = '{ORG}'))"


def oracle_sql() -> dict[str, str]:
    out = {f"{name}_{store}": sql for store in ("raw", "nested", "flat") for name, sql in (("scan", SCAN), ("computed", COMPUTED), ("by_name", BY_NAME), ("document", DOCUMENT.format(id=ID)), ("three_hop", THREE_HOP))}
    views = f"WITH orders AS ({ORDERS}), customer AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM main.customer) "
    out |= {f"select_where_{n}": views.replace("FROM orders)", "FROM main.orders)") + sql for n, sql in SELECTS.items()}
    return out | {
        "infer_columns_customers": CUSTOMERS, "infer_columns_events": EVENTS, "infer_incremental": EVENTS, "infer_columns_labelled": LABELLED, "infer_columns_lone": LONE, "infer_columns_vectors": VECTORS, "infer_columns_alike": ALIKE, "infer_columns_marks": MARKS, "refused_by_code": REFUSED,
        "shred_orders": ORDERS,
        "shred_items": f"SELECT l_orderkey AS orders_id, l_linestatus AS line_status, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx, CAST(l_linenumber AS BIGINT) AS line, name, cents, bp FROM ({LINES})",
        "shred_turns": "SELECT conv_id AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, text FROM conversations",
        "shred_props_map": "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events",
        "shred_label_reference": "SELECT doc_id AS id, lang, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id)",
        "shred_items_collapsed": f"SELECT l_orderkey AS purchase_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx, CAST(l_linenumber AS BIGINT) AS line, cents FROM ({LINES})",
        "shred_values": "SELECT vec_id AS vector_id, CAST(i - 1 AS BIGINT) AS idx, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)",
        "reassemble_totals": f"SELECT c_custkey AS id, count(DISTINCT o_orderkey) AS n1, count(DISTINCT (l_orderkey, l_linestatus)) FILTER (l_orderkey IS NOT NULL) AS n2, count(l_orderkey) AS n3, CAST(coalesce(sum(cents), 0) AS BIGINT) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN ({LINES}) ON l_orderkey = o_orderkey GROUP BY c_custkey",
        "fk_orphans": "SELECT * FROM (VALUES ('orders', 'customer_id', CAST(0 AS BIGINT)), ('shipments', 'orders_id', 0), ('items', 'shipments_id', 0)) t(table_name, column_name, orphans)",
        "fk_orphans_found": "SELECT * FROM (SELECT 'orders' AS table_name, 'customer_id' AS column_name, CAST(0 AS BIGINT) AS orphans UNION ALL SELECT 'shipments', 'orders_id', count(*) FROM (SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem WHERE l_orderkey % 10 = 0) UNION ALL SELECT 'items', 'shipments_id', 0)",
        "handle_get": f"SELECT id, customer_id, status, cents FROM ({ORDERS}) WHERE id = {ID}", "handle_of_parent": f"SELECT id, idx, cents FROM ({ORDERS}) WHERE customer_id = {ID}",
        "shred_names_alike": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS other, true AS third FROM nation",
        "middle_order": "SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET (SELECT count(*) // 2 FROM orders)",
        "childless_parents": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
        "nullability_identity": "SELECT CAST(7 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS violations",
        "by_name_nonpositive": "SELECT c_name AS name, max(CAST(round(c_acctbal * 100) AS BIGINT)) AS largest FROM customer GROUP BY c_name HAVING largest > 0",
        "document_semi": DOCUMENT.format(id=ID), "three_hop_semi": THREE_HOP, "document_unknown": DOCUMENT.format(id=UNKNOWN),
        "sweep": f"SELECT CAST(t.over AS BIGINT) AS over, count(*) FILTER (cents > t.over) AS kept, 100.0::DOUBLE * count(*) FILTER (cents > t.over) / count(*) AS percent FROM (VALUES {', '.join(f'({t})' for t in SWEEP)}) t(over), ({LINES}) GROUP BY t.over",
        "reconcile": f"SELECT (SELECT count(*) FROM customer) AS n0, (SELECT count(*) FROM orders) AS n1, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem)) AS n2, count(*) AS n3, CAST(sum(cents) AS BIGINT) AS measure, count(name) AS named, CAST(sum(cents * bp) AS DOUBLE) AS weighted FROM ({LINES})",
        "reconcile_nested": f"SELECT (SELECT count(*) FROM customer) AS n0, (SELECT count(*) FROM orders) AS n1, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem)) AS n2, count(*) AS n3, CAST(sum(cents) AS BIGINT) AS measure, count(name) AS named, CAST(sum(cents * bp) AS DOUBLE) AS weighted FROM ({LINES})",
    }
