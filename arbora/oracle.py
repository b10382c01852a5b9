"""DuckDB SQL for the queries of :mod:`arbora.queries`."""

from .plans.sql import BOTH, TWO

_ORPHANS = "(SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1000000 END AS o_custkey FROM orders)"
_COORD = "(SELECT c_custkey, c_custkey * 7919 % 18000 / 100.0::DOUBLE - 90 AS lat, c_custkey * 104729 % 36000 / 100.0::DOUBLE - 180 AS lon FROM customer)"
_TERMS = "string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"


_FEW = "SELECT nullif(s_nationkey, 3) FROM supplier WHERE s_nationkey < 7"


def _flat(how: str) -> str:
    return f"SELECT c_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM customer {how} JOIN {_ORPHANS} o ON c_custkey = o_custkey"


OWN = {
    "fn_div_mod_zero": "SELECT l_orderkey, l_linenumber, l_orderkey / nullif(l_linenumber - 1, 0) AS a, l_orderkey // nullif(l_linenumber - 1, 0) AS b, l_orderkey % nullif(l_linenumber - 1, 0) AS c FROM lineitem",
    "fn_bit": "SELECT o_orderkey, o_orderkey & o_custkey AS a, o_orderkey | o_custkey AS o, xor(o_orderkey, o_custkey) AS x, CASE WHEN o_custkey % 9 < 2 THEN 0 ELSE o_orderkey * (2 ** (o_custkey % 9 - 2))::BIGINT END AS l, bit_count(o_orderkey)::INT AS n FROM orders",
    "fn_round_truncate": "SELECT o_orderkey, round(trunc((o_totalprice - 100000) * 10) / 10, 1) AS t, ceil(o_totalprice - 100000)::BIGINT AS c, floor(o_totalprice - 100000)::BIGINT AS f, sign(o_totalprice - 100000)::INT AS s FROM orders",
    "fn_log_pow": "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS r, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS l, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS g, round(pow(c_acctbal / 1000, 2), 6) AS p FROM customer",
    "fn_trig": "SELECT c_custkey, round(sin(c_acctbal / 1000), 6) AS s, round(atan2(c_acctbal / 1000, 2.0), 6) AS a, round(pi() / 2 - atan(c_acctbal / 1000), 6) AS ac, round(degrees(c_acctbal / 1000), 6) AS dg FROM customer",
    "fn_substring_edge": "SELECT p_partkey, '' AS z, substring(p_name, 2, 3) AS m, right(p_name, 3) AS e, string_split(p_name, ' ')[1] AS i FROM part",
    "fn_pad_trim": "SELECT p_partkey, lpad(p_brand, 12, '*') AS l, rpad(p_brand, 12, '-') AS r, left(p_brand, 3) AS s, '' AS n, p_brand AS t FROM part",
    "fn_elt_field": "SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS e, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS f, CASE WHEN c_mktsegment < 'BUILDING' THEN -1 WHEN c_mktsegment > 'BUILDING' THEN 1 ELSE 0 END AS s FROM customer",
    "fn_export_set": "SELECT n_nationkey, list_aggregate(list_transform(range(5), lambda i: CASE WHEN (n_nationkey >> i::INT) & 1 = 1 THEN 'Y' ELSE 'N' END), 'string_agg', ',') AS e FROM nation",
    "fn_inet_aton": "SELECT n_nationkey, ((10 * 256 + n_nationkey::BIGINT) * 256 + 3) * 256 + 4 AS i, n_nationkey::BIGINT AS n FROM nation",
    "fn_day_names": "SELECT o_orderkey, dayname(o_orderdate) AS d, monthname(o_orderdate) AS m FROM orders",
    "fn_week_modes": "SELECT o_orderkey, strftime(o_orderdate, '%U')::INT AS w0, CASE WHEN strftime(date_trunc('year', o_orderdate), '%w')::INT IN (2, 3, 4) THEN strftime(o_orderdate, '%W')::INT + 1 ELSE strftime(o_orderdate, '%W')::INT END AS w1, CASE WHEN month(o_orderdate) = 12 AND weekofyear(o_orderdate) = 1 THEN 53 ELSE weekofyear(o_orderdate) END::INT AS w3 FROM orders",
    "fn_date_format": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate, '%A, %-d %B %y %j') AS b, strftime(o_orderdate, '%w %b 100%%') AS c FROM orders",
    "fn_to_days": "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719528 AS n FROM orders",
    "fn_period": "SELECT o_orderkey, ((year(o_orderdate) * 12 + month(o_orderdate) - 1 + 14) // 12) * 100 + (month(o_orderdate) - 1 + 14) % 12 + 1 AS a, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS d FROM orders",
    "fn_cast_lenient": "SELECT c_custkey, round(c_acctbal)::BIGINT AS p, 0::BIGINT AS z, 2147483647::BIGINT AS c, floor(c_acctbal + 0.5)::BIGINT AS d FROM customer",
    "fn_min_max_strict": "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN least(c_nationkey, 7) END AS l, CASE WHEN c_custkey % 3 > 0 THEN greatest(c_nationkey, 7) END AS g FROM customer",
    "flatten_inner": _flat(""), "flatten_left": _flat("LEFT"), "flatten_right": _flat("RIGHT"), "flatten_full": _flat("FULL"),
    "flatten_keep_parent": _flat("") + " UNION ALL SELECT c_custkey, NULL, NULL FROM customer",
    "branch_product": "SELECT n_name, count(*) AS n, count(DISTINCT c_custkey) AS c, count(DISTINCT s_suppkey) AS s FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name",
    "ancestor_lookup": "SELECT o_orderpriority, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
    "branch_lookup": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "nested_json": """SELECT c_custkey, coalesce('[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']', '[]') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
    "select_star_star": """WITH o AS (SELECT o_orderkey, any_value(o_custkey) AS o_custkey, coalesce('[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']', '[]') AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
        SELECT c_custkey, any_value(c_name) AS c_name, coalesce('[' || string_agg('{"o_orderkey":' || o_orderkey || ',"lines":' || lines || '}', ',' ORDER BY o_orderkey) || ']', '[]') AS orders FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey""",
    "insert_returning": "SELECT * FROM (VALUES (100, 'atlantis', 2), (101, 'lemuria', 3)) AS v(n_nationkey, n, r)",
    "insert_default": "SELECT row_number() OVER (ORDER BY n_nationkey)::INT AS id, n_name, n_regionkey::INT AS region, 'x' AS mark FROM nation UNION ALL SELECT * FROM (VALUES (26, 'a', 7, 'x'), (27, 'b', NULL, 'x'), (28, 'c', 7, 'x'))",
    "nextval_rows": "SELECT n_name, 5 + 5 * row_number() OVER (ORDER BY n_name DESC) AS a FROM nation WHERE n_regionkey < 3",
    "nextval_insert": "SELECT 2 + row_number() OVER (ORDER BY n_nationkey) AS k, n_name AS v FROM nation UNION ALL SELECT 1, 'x' UNION ALL SELECT 2, 'y'",
    "update_join": "SELECT s_suppkey, coalesce(n_name, s_name) AS s_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey",
    "ctas": "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_orderstatus",
    "view": "WITH v AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS m FROM v GROUP BY n",
    "routine_sql": "SELECT n_name, (n_nationkey * 2)::INT AS t FROM nation WHERE n_regionkey = 2",
    "select_star_star_sql": """SELECT c_custkey AS cid, any_value(c_mktsegment) AS seg, coalesce('[' || string_agg('{"oid":' || o_orderkey || ',"cid":' || o_custkey || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']', '[]') AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_custkey < 40 GROUP BY c_custkey""",
    "flatten_same_key": "SELECT c_custkey AS cid, c_mktsegment, o_orderkey, o_custkey AS child_cid FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "nest_same_key": """SELECT c_custkey AS cid, coalesce('[' || string_agg('{"o_orderkey":' || o_orderkey || ',"cid":' || o_custkey || '}', ',' ORDER BY o_orderkey) || ']', '[]') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
    "branch_same_key": "SELECT o_orderkey, o_custkey AS cid FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "product_same_key": "SELECT c_custkey AS cid, a.o_orderkey, b.o_orderkey AS other, a.o_custkey AS first_cid, b.o_custkey AS second_cid FROM customer JOIN orders a ON a.o_custkey = c_custkey AND a.o_orderkey < 2000 JOIN orders b ON b.o_custkey = c_custkey AND b.o_orderkey < 2000",
    "group_select_tree": "WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9000), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)) SELECT 'customer' AS t, c_custkey AS k FROM c UNION ALL SELECT 'orders', o_orderkey FROM o UNION ALL SELECT 'lines', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_orderkey IN (FROM o)",
    "delete_rest": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey >= 12",
    "fn_crc32": "SELECT p_partkey, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(p_name) + 1), lambda i: ascii(substring(p_name, i::INT, 1))::BIGINT), lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS c FROM part",
    "update_returning": "SELECT s_suppkey, s_nationkey + 100 AS s_nationkey FROM supplier WHERE s_nationkey = 3",
    "delete_returning": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey < 12",
    "info_schema_columns": "SELECT * FROM (VALUES ('region', 'r_regionkey', 1), ('region', 'r_name', 2), ('nation', 'n_nationkey', 1), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3)) AS v(table_name, column_name, ordinal_position)",
    "fulltext_must_should_not": f"WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents) SELECT doc_id, 1 + list_contains(w, 'and')::INT + list_contains(w, 'idiot')::INT AS hits FROM t WHERE list_contains(w, 'the') AND NOT list_contains(w, 'stupid')",
    "spatial_box": f"SELECT c_custkey FROM {_COORD} WHERE lat BETWEEN -40 AND 40 AND (lon >= 150 OR lon <= -150)",
    "spatial_nearest": f"SELECT c_custkey, round(sqrt(power(CASE WHEN abs(lon - 175) > 180 THEN 360 - abs(lon - 175) ELSE abs(lon - 175) END, 2) + power(lat - 10, 2)), 6) AS far FROM {_COORD} ORDER BY far, c_custkey LIMIT 10",
    "flatten_keep_child": _flat("LEFT") + f" UNION ALL SELECT NULL, o_orderkey, round(o_totalprice, 2) FROM {_ORPHANS} o",
    "any_all_frame": f"SELECT c_custkey, c_nationkey = ANY ({_FEW}) AS a, c_nationkey <> ALL ({_FEW}) AS b, c_nationkey <= ANY ({_FEW}) AS c, c_nationkey = ALL ({_FEW}) AS d FROM customer",
    "if_empty": "SELECT -1::BIGINT AS o_orderkey, 'none' AS o_orderstatus",
    "sequence_values": "SELECT c_custkey, 90 + 10 * row_number() OVER (ORDER BY c_custkey) AS n FROM customer",
    "branch_dump": """WITH l AS (SELECT l_orderkey, string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) AS t FROM lineitem GROUP BY l_orderkey),
        o AS (SELECT o_custkey, string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"' || coalesce(',"lines":[' || t || ']', '') || '}', ',' ORDER BY o_orderkey) AS t FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_custkey)
        SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"' || coalesce(',"orders":[' || t || ']', '') || '}' AS json FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
    "branch_dump_depth": """WITH o AS (SELECT o_custkey, string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) AS t FROM orders GROUP BY o_custkey)
        SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"' || coalesce(',"orders":[' || t || ']', '') || '}' AS json FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
    "group_select": "SELECT c_custkey AS k, 'customer' AS t FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT o_orderkey, 'orders' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000",
    "hkey_union": "SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000 OR o_orderpriority = '1-URGENT'",
    "foreign_key_orphans": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)",
    "fulltext_query": f"WITH t AS (SELECT doc_id, ' ' || array_to_string({_TERMS}, ' ') || ' ' AS w, lang FROM documents) SELECT doc_id, 1 + contains(w, ' of the ')::INT + coalesce(contains(' ' || array_to_string({_TERMS.replace('text', 'lang')}, ' ') || ' ', ' en '), FALSE)::INT AS hits FROM t WHERE contains(w, ' the ') AND NOT contains(w, ' stupid ')",
    "spatial_contains": f"SELECT c_custkey, lat > -10 AND lat < 40 AND lon > -20 AND lon < 30 AS inside FROM {_COORD}",
    "spatial_clustered": f"SELECT c_custkey, list_sum(list_transform(range(29), lambda i: (((least(floor((lon + 180) / 360 * 536870912)::BIGINT, 536870911) >> i) & 1) << (2 * i)) + CASE WHEN i < 28 THEN ((least(floor((lat + 90) / 180 * 268435456)::BIGINT, 268435455) >> i) & 1) << (2 * i + 1) ELSE 0 END))::BIGINT AS z FROM {_COORD}",
    "fn_time_of_day": "WITH t AS (SELECT o_orderkey, o_orderkey * 37 % 200000 - 100000 AS n FROM orders) SELECT o_orderkey, CASE WHEN n < 0 THEN '-' ELSE '' END || lpad((abs(n) // 3600)::VARCHAR, 2, '0') || ':' || lpad((abs(n) // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((abs(n) % 60)::VARCHAR, 2, '0') AS t, n, '00:01:00' AS d FROM t",
    "fn_conv_quote": """SELECT p_partkey, bin(p_partkey) AS b, hex(p_partkey) AS h, '0' AS w, CASE WHEN regexp_full_match(p_name, '[a-z_][a-z0-9_$]*') THEN p_name ELSE '"' || replace(p_name, '"', '""') || '"' END AS q FROM part""",
    "fn_aes": "SELECT n_nationkey, n_name AS n, '69C4E0D86A7B0430D8CDB78070B4C55A' AS known, '69C4E0D86A7B0430D8CDB78070B4C55A' AS wrapped FROM nation",
    "csv_roundtrip": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a "q", ' || s_name END AS s, s_acctbal FROM supplier""",
    "json_output": """SELECT '{"n_nationkey":' || n_nationkey || ',"r":' || coalesce(nullif(n_regionkey, 1)::VARCHAR, 'null') || '}' AS json FROM nation""",
    "procedure_result": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2",
    "ext_stream_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
    "udf_scalar": "SELECT n_nationkey, n_nationkey::BIGINT * 2 AS twice FROM nation",
}


def oracle_sql() -> dict[str, str]:
    return {**BOTH, **{name: text for name, (_, text) in TWO.items()}, **OWN}
