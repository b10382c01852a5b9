"""Queries as SQL. ``BOTH`` holds texts that Spark and the oracle read alike, ``TWO`` pairs of texts."""

BOTH = {
    "flagship_coi": """SELECT c_mktsegment, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS avg_qty
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '1995-01-01' GROUP BY c_mktsegment ORDER BY revenue DESC LIMIT 10""",
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 2) AS net FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R'",
    "values_source": "SELECT a AS a, b AS b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)",
    "between_in": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 150000",
    "row_in": "SELECT o_orderkey FROM orders WHERE (o_orderstatus, CAST(o_custkey % 5 AS INT)) IN (('O', 1), ('F', 2))",
    "like_ilike": "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'B%' OR c_name ILIKE '%#00000001_'",
    "is_null_true": "SELECT c_custkey, (nullif(c_nationkey, 3) IS NULL) AS a, ((nullif(c_nationkey, 3) > 5) IS TRUE) AS b, ((nullif(c_nationkey, 3) > 5) IS NOT FALSE) AS c FROM customer",
    "case_simple_searched": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS a, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 1000 THEN 'mid' END AS b FROM orders",
    "join_inner": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey < 5",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_using": "SELECT k, count(*) AS n FROM (SELECT n_nationkey AS k FROM nation) a JOIN (SELECT c_nationkey AS k FROM customer) b USING (k) GROUP BY k",
    "join_natural": "SELECT k, n_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k FROM region) b",
    "join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "join_semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "join_anti_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_anti_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "join_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_three_way_group": "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name",
    "scalar_subquery_corr": "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer",
    "derived_table": "SELECT s, count(*) AS n FROM (SELECT o_custkey, o_orderstatus AS s FROM orders WHERE o_totalprice > 50000) d GROUP BY s",
    "having_subquery": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 500 FROM nation) ",
    "agg_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS p, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag",
    "agg_global_empty": "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0",
    "agg_var_stddev": "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss FROM lineitem GROUP BY l_returnflag",
    "agg_bit": "SELECT o_orderstatus, bit_and(o_custkey) AS a, bit_or(o_custkey) AS o, bit_xor(o_custkey) AS x FROM orders GROUP BY o_orderstatus",
    "having": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 60",
    "count_star": "SELECT count(*) AS n FROM lineitem",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "order_mixed": "SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey DESC NULLS LAST, c_custkey ASC NULLS FIRST LIMIT 50",
    "order_ordinal": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 15",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "setop_precedence": "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_nationkey > 20",
    "any_gt": "SELECT p_partkey FROM part WHERE p_size > ANY (SELECT p_size FROM part WHERE p_brand = 'Brand#11')",
    "all_ge": "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part WHERE p_brand = 'Brand#11')",
    "ne_all": "SELECT n_name FROM nation WHERE n_nationkey <> ALL (SELECT s_nationkey FROM supplier)",
    "any_all_projected": "SELECT c_custkey, c_nationkey < ANY (SELECT nullif(s_nationkey, 3) FROM supplier) AS a, c_nationkey > ALL (SELECT nullif(s_nationkey, 3) FROM supplier WHERE s_nationkey < 5) AS b, c_nationkey <> ANY (SELECT s_nationkey FROM supplier) AS c, c_nationkey < ALL (SELECT s_nationkey FROM supplier WHERE s_nationkey < 0) AS d FROM customer",
    "all_correlated": "SELECT o_orderkey FROM orders WHERE o_totalprice / 3 > ALL (SELECT l_extendedprice FROM lineitem WHERE l_orderkey = o_orderkey)",
    "fn_arith": "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS a, l_linenumber - 10 AS b, round(l_quantity * l_tax, 6) AS c, abs(l_linenumber - 4) AS d, -l_linenumber AS e FROM lineitem",
    "fn_string_core": "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, concat(p_brand, '/', p_type) AS c, CAST(char_length(p_name) AS INT) AS n, reverse(p_brand) AS r, repeat('ab', 2) AS x, left(p_name, 3) AS f, right(p_name, 2) AS g, ascii(p_name) AS a FROM part",
    "fn_concat_ws": "SELECT c_custkey, concat_ws('-', c_mktsegment, nullif(c_name, ''), 'z') AS c FROM customer",
    "fn_date_parts": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(dayofyear(o_orderdate) AS INT) AS n, last_day(o_orderdate) AS l FROM orders",
    "fn_cond_null": "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS a, nullif(c_mktsegment, 'BUILDING') AS b FROM customer",
    "ext_window_rank": "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST) AS INT) AS r FROM customer",
    "ext_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
}

TWO = {
    "divide_by_zero": (
        "SELECT l_orderkey, l_linenumber, l_quantity / (l_linenumber - 1) AS a, MOD(l_orderkey, l_linenumber - 1) AS m, DIV(l_orderkey, l_linenumber - 1) AS d FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_linenumber - 1, 0) AS a, l_orderkey % nullif(l_linenumber - 1, 0) AS m, l_orderkey // nullif(l_linenumber - 1, 0) AS d FROM lineitem",
    ),
    "fn_sql_intervals": (
        "SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 3 DAY) AS a, SUBDATE(CAST(o_orderdate AS DATE), 3) AS b, ADDDATE(CAST(o_orderdate AS DATE), INTERVAL 1 MONTH) AS c, ADDTIME(o_orderdate, 61) AS d, TIMEDIFF(o_orderdate, SUBTIME(o_orderdate, 3661)) AS e, TIMEDIFF('10:00:00', '11:30:00') AS f, CONV(o_orderkey, 10, 16) AS g FROM orders",
        "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, o_orderdate::DATE - 3 AS b, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS c, o_orderdate + INTERVAL 61 SECOND AS d, '01:01:01' AS e, '-01:30:00' AS f, hex(o_orderkey) AS g FROM orders",
    ),
    "spatial_sql": (
        "SELECT n_nationkey, GEO_TYPE_STRING(GEO_LAT_LON(n_nationkey, 0)) AS t, GEO_WITHIN_DISTANCE(GEO_LAT_LON(n_nationkey, 0), GEO_WKT('point(10 0)'), 3) AS w, GEO_COVERS(GEO_EXPANDED_ENVELOPE(GEO_WKT('POINT (5 0)'), 4), GEO_LAT_LON(n_nationkey, 0)) AS c FROM nation",
        "SELECT n_nationkey, 'Point' AS t, abs(n_nationkey - 10) <= 3 AS w, n_nationkey BETWEEN 1 AND 9 AS c FROM nation",
    ),
    "xor": ("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 XOR c_mktsegment = 'BUILDING'", "SELECT c_custkey FROM customer WHERE (c_acctbal > 5000) <> (c_mktsegment = 'BUILDING')"),
    "group_concat_separator": (
        "SELECT n_regionkey, GROUP_CONCAT(n_name, '/', n_nationkey ORDER BY n_nationkey DESC SEPARATOR '; ') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name || '/' || n_nationkey, '; ' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey",
    ),
    "quoted_names": ('SELECT "c_custkey" AS "a b" FROM "customer" WHERE "c_name" = \'Customer#000000001\'', 'SELECT c_custkey AS "a b" FROM customer WHERE c_name = \'Customer#000000001\''),
    "fn_sql_text": (
        "SELECT p_partkey, STRCMP(p_name, 'm') AS c, SUBSTR(p_name, 0, 3) AS z, SUBSTRING(p_name, -3) AS e, LPAD(p_brand, 3, '') AS l, LOCATE('a', p_name, 3) AS a, FIELD(p_brand, 'Brand#11', NULL, 'Brand#12') AS f, ELT(p_size % 4, 'x', 'y') AS t, EXPORT_SET(p_size, '1', '0', '', 6) AS b, INET_ATON(concat('10.', p_size, '.0.1')) AS i FROM part",
        "SELECT p_partkey, CASE WHEN p_name < 'm' THEN -1 WHEN p_name > 'm' THEN 1 ELSE 0 END AS c, '' AS z, right(p_name, 3) AS e, left(p_brand, 3) AS l, CASE WHEN instr(substring(p_name, 3), 'a') = 0 THEN 0 ELSE instr(substring(p_name, 3), 'a') + 2 END::INT AS a, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 3 ELSE 0 END AS f, CASE p_size % 4 WHEN 1 THEN 'x' WHEN 2 THEN 'y' END AS t, reverse(right('000000' || bin(p_size), 6)) AS b, 10 * 16777216::BIGINT + p_size * 65536 + 1 AS i FROM part",
    ),
    "fn_sql_dates": (
        "SELECT o_orderkey, WEEK(o_orderdate) AS w0, WEEK(o_orderdate, 2) AS w2, WEEK(o_orderdate, 5) AS w5, WEEKOFYEAR(o_orderdate) AS w3, YEARWEEK(o_orderdate, 7) AS y7, DATE_FORMAT(o_orderdate, '%Y/%c/%e %W %T') AS f, DAYNAME(o_orderdate) AS d, TO_SECONDS(o_orderdate) AS s, FROM_DAYS(TO_DAYS(o_orderdate)) AS b, PERIOD_ADD(9911, CAST(month(o_orderdate) AS INT)) AS p FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%U')::INT AS w0, CASE WHEN strftime(o_orderdate, '%U') = '00' THEN strftime(make_date(year(o_orderdate) - 1, 12, 31), '%U') ELSE strftime(o_orderdate, '%U') END::INT AS w2, strftime(o_orderdate, '%W')::INT AS w5, CASE WHEN month(o_orderdate) = 12 AND weekofyear(o_orderdate) = 1 THEN 53 ELSE weekofyear(o_orderdate) END::INT AS w3,"
        " CASE WHEN strftime(o_orderdate, '%W') = '00' THEN strftime(make_date(year(o_orderdate) - 1, 12, 31), '%Y%W') ELSE strftime(o_orderdate, '%Y%W') END::INT AS y7, strftime(o_orderdate, '%Y/%-m/%-d %A %H:%M:%S') AS f, dayname(o_orderdate) AS d, epoch(o_orderdate)::BIGINT + 719528 * 86400::BIGINT AS s, o_orderdate::DATE AS b, 200000::BIGINT + CASE WHEN month(o_orderdate) = 1 THEN -88 ELSE month(o_orderdate) - 1 END AS p FROM orders",
    ),
    "join_broadcast": ("SELECT /*+ BROADCAST(n) */ n_name, count(*) AS n FROM customer JOIN nation n ON c_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "group_concat": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "group_concat_distinct": (
        "SELECT o_orderstatus, listagg(DISTINCT o_orderpriority, ';') WITHIN GROUP (ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_orderstatus",
    ),
    "fn_locate_replace": ("SELECT p_partkey, locate('a', p_name) AS l, replace(p_name, 'a', '__') AS r FROM part", "SELECT p_partkey, CAST(instr(p_name, 'a') AS INT) AS l, replace(p_name, 'a', '__') AS r FROM part"),
    "fn_hex_base64": ("SELECT p_partkey, hex(p_brand) AS h, base64(CAST(p_brand AS BINARY)) AS b FROM part", "SELECT p_partkey, hex(p_brand) AS h, base64(encode(p_brand)) AS b FROM part"),
    "fn_md5": ("SELECT p_partkey, md5(p_name) AS m FROM part", "SELECT p_partkey, md5(p_name) AS m FROM part"),
    "fn_date_add_sub": (
        "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS a, CAST(o_orderdate - INTERVAL 10 DAYS AS DATE) AS b FROM orders",
        "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS a, CAST(o_orderdate - INTERVAL 10 DAY AS DATE) AS b FROM orders",
    ),
    "fn_date_diff": ("SELECT o_orderkey, datediff(o_orderdate, DATE '1994-02-28') AS d FROM orders", "SELECT o_orderkey, CAST(date_diff('day', DATE '1994-02-28', CAST(o_orderdate AS DATE)) AS INT) AS d FROM orders"),
    "fn_timestampdiff": ("SELECT event_id, timestampdiff(HOUR, TIMESTAMP '2020-01-01 00:00:00', ts) AS h FROM events", "SELECT event_id, datesub('hour', TIMESTAMP '2020-01-01 00:00:00', ts) AS h FROM events"),
    "fn_unixtime": ("SELECT event_id, unix_timestamp(ts) AS u FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS u FROM events"),
    "eq_any": ("SELECT n_name FROM nation WHERE n_nationkey = ANY (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)", "SELECT n_name FROM nation WHERE n_nationkey = ANY (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"),
    "agg_first": (
        "SELECT o_orderpriority, FIRST(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS f, FIRST(CASE WHEN o_orderkey < 0 THEN 1 END) AS n FROM orders GROUP BY o_orderpriority",
        "SELECT o_orderpriority, max(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS f, max(CASE WHEN o_orderkey < 0 THEN 1 END) AS n FROM orders GROUP BY o_orderpriority",
    ),
    "regex_match": (
        "SELECT c_custkey, REGEX(c_name, '^Customer#0+1[0-9]+$') AS a, IREGEX(c_mktsegment, 'build') AS b, REGEX(c_mktsegment, 'MACH', 'i') AS c, c_name REGEX '9$' AS d, NOT (c_mktsegment BLIKE 'build%') AS e FROM customer WHERE c_name IREGEX 'CUSTOMER' AND c_custkey MOD 3 = 1",
        "SELECT c_custkey, regexp_matches(c_name, '^Customer#0+1[0-9]+$') AS a, regexp_matches(c_mktsegment, 'build', 'i') AS b, regexp_matches(c_mktsegment, 'MACH', 'i') AS c, regexp_matches(c_name, '9$') AS d, c_mktsegment NOT LIKE 'build%' AS e FROM customer WHERE c_custkey % 3 = 1",
    ),
    "cast_sql": (
        "SELECT c_custkey, CAST(concat(c_custkey, 'abc') AS INT) AS a, CAST(c_name AS INT) AS b, CAST(c_acctbal AS INT) AS c, CAST(concat(c_acctbal, 'e') AS BIGINT) AS d, CONVERT(concat(c_custkey, '.5x'), SIGNED) AS e, CAST(c_acctbal * 1e9 AS INT) AS f, CAST(c_acctbal AS INT UNSIGNED) AS g, CAST(concat(c_nationkey, '.25?') AS DOUBLE) AS h, CAST(c_mktsegment AS CHAR(4)) AS i FROM customer",
        "SELECT c_custkey, c_custkey::INT AS a, 0 AS b, floor(c_acctbal + 0.5)::INT AS c, round(c_acctbal::DECIMAL(18,2))::BIGINT AS d, c_custkey + 1 AS e, least(greatest(floor(c_acctbal * 1e9 + 0.5), -2147483648), 2147483647)::INT AS f, greatest(floor(c_acctbal + 0.5), 0)::BIGINT AS g, c_nationkey + 0.25::DOUBLE AS h, left(c_mktsegment, 4) AS i FROM customer",
    ),
    "fulltext_sql": (
        "SELECT doc_id FROM documents WHERE FULL_TEXT_SEARCH(text, '+the -(stupid idiot) (\"of the\" and)')",
        "WITH t AS (SELECT doc_id, ' ' || array_to_string(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), ' ') || ' ' AS w FROM documents) SELECT doc_id FROM t WHERE contains(w, ' the ') AND NOT (contains(w, ' stupid ') OR contains(w, ' idiot '))",
    ),
    "fn_sql_forms": (
        "SELECT p_partkey, SUBSTRING(p_name FROM 2 FOR 3) AS a, p_partkey MOD 7 AS b, TIME('2001-01-01 10:11:12') AS c, CAST(SIGN(p_size - 20) AS INT) AS d FROM part",
        "SELECT p_partkey, substring(p_name, 2, 3) AS a, p_partkey % 7 AS b, '10:11:12' AS c, sign(p_size - 20)::INT AS d FROM part",
    ),
}
