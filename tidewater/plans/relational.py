"""Relational queries: joins, aggregates, windows, sets and expressions. Text is run by the SQL facade; the second text, if any, is its DuckDB form."""

from __future__ import annotations

#: name: (query, DuckDB form or None where both are the same text)
SQL: dict[str, tuple[str, str | None]] = {
    "projection_alias": ("SELECT o_orderkey AS k, o_totalprice * 2 AS doubled, o_orderstatus FROM orders", None),
    "filter_logic": ("SELECT o_orderkey FROM orders WHERE (o_totalprice > 200000 AND o_orderstatus <> 'F') OR o_orderpriority IS NULL OR NOT (o_totalprice >= 1000)", None),
    "like_ilike": ("SELECT event_type, count(*) AS n FROM events WHERE event_type LIKE '%c%' AND event_type NOT LIKE 'e%' OR event_type ILIKE 'PUR%' GROUP BY event_type", None),
    "regex_match": ("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority RLIKE '^[1-3]-' GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE regexp_matches(o_orderpriority, '^[1-3]-') GROUP BY o_orderpriority"),
    "regexp_replace": ("SELECT DISTINCT o_orderpriority, regexp_replace(o_orderpriority, '[0-9]-', '') AS name FROM orders", None),
    "between_in_case": ("SELECT CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'low' WHEN l_quantity IN (11, 12, 13) THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM lineitem GROUP BY 1", None),
    "null_functions": ("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s, nullif(o_custkey, 10) IS NULL AS gone FROM orders", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)", None),
    "correlated_scalar_subquery": ("SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "exists_subquery": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", None),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)", None),
    "quantified_all": ("SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT s_acctbal FROM supplier)", None),
    "try_cast": ("SELECT DISTINCT try_cast(substr(o_orderpriority, 1, 2) AS INT) AS bad, try_cast(substr(o_orderpriority, 1, 1) AS INT) AS good FROM orders", None),
    "integer_division": ("SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r FROM orders"),
    "bit_operations": ("SELECT o_orderkey, (o_orderkey & 12) | 3 AS a, o_orderkey ^ 5 AS b, shiftleft(o_orderkey, 2) AS c FROM orders", "SELECT o_orderkey, (o_orderkey & 12) | 3 AS a, xor(o_orderkey, 5) AS b, o_orderkey << 2 AS c FROM orders"),
    "integer_overflow_wraps": ("SELECT o_orderkey, CAST(CAST(o_orderkey % 128 AS TINYINT) + CAST(100 AS TINYINT) AS BIGINT) AS t FROM orders", "SELECT o_orderkey, (o_orderkey % 128 + 228) % 256 - 128 AS t FROM orders"),
    "inner_join": ("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", None),
    "left_join": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey", None),
    "right_join": ("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'", None),
    "full_join": ("SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey + 50", None),
    "cross_join": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "using_join": ("SELECT l_orderkey, n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) a JOIN (SELECT DISTINCT o_orderkey AS l_orderkey FROM orders) b USING (l_orderkey)", None),
    "natural_join": ("SELECT * FROM (SELECT n_nationkey, n_name FROM nation) NATURAL JOIN (SELECT n_nationkey, n_regionkey FROM nation)", None),
    "self_join": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "inequality_join": ("SELECT a.r_regionkey AS a, b.n_nationkey AS b FROM region a JOIN nation b ON a.r_regionkey < b.n_regionkey", None),
    "complex_join_condition": ("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON abs(a.n_regionkey - b.r_regionkey) <= 1 OR b.r_name = upper(a.n_name)", None),
    "semi_join": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "anti_join": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "multi_way_join": ("SELECT r_name, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", None),
    "null_safe_join": ("SELECT a.k AS ak, b.k AS bk FROM (SELECT nullif(n_regionkey, 1) AS k, n_nationkey FROM nation) a JOIN (SELECT nullif(r_regionkey, 1) AS k FROM region) b ON a.k <=> b.k", "SELECT a.k AS ak, b.k AS bk FROM (SELECT nullif(n_regionkey, 1) AS k, n_nationkey FROM nation) a JOIN (SELECT nullif(r_regionkey, 1) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k"),
    "lateral_join": ("SELECT r_name, t.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) t", None),
    "count_sum_avg": ("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "min_max_text_time": ("SELECT min(o_orderpriority) AS a, max(o_orderpriority) AS b, min(o_orderdate) AS c, max(o_orderdate) AS d FROM orders", None),
    "distinct_rows": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "stddev_variance": ("SELECT event_type, round(stddev_pop(value), 6) AS sp, round(stddev_samp(value), 6) AS ss, round(var_pop(value), 5) AS vp, round(var_samp(value), 5) AS vs FROM events GROUP BY event_type", None),
    "covariance_correlation": ("SELECT round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs, round(corr(l_extendedprice, l_quantity), 8) AS r FROM lineitem", None),
    "regression": ("SELECT round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS icept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 1) AS sxx FROM lineitem", None),
    "median": ("SELECT event_type, round(median(value), 6) AS m FROM events GROUP BY event_type", None),
    "percentile_cont": ("SELECT event_type, round(percentile(value, 0.9), 6) AS p FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p FROM events GROUP BY event_type"),
    "bool_aggregates": ("SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 499000) AS b FROM orders GROUP BY o_orderstatus", None),
    "bit_aggregates": ("SELECT o_orderstatus, bit_and(o_custkey) AS a, bit_or(o_custkey) AS b, bit_xor(o_custkey) AS c FROM orders GROUP BY o_orderstatus", None),
    "string_agg": ("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", None),
    "array_agg_ordered": ("SELECT n_regionkey, array_to_string(array_agg(n_nationkey ORDER BY n_nationkey DESC), ',') AS ids FROM nation GROUP BY n_regionkey", None),
    "first_last_value": ("SELECT event_type, first_value(value ORDER BY ts, event_id) AS first, last_value(value ORDER BY ts, event_id) AS last FROM events GROUP BY event_type", "SELECT event_type, first(value ORDER BY ts, event_id) AS first, last(value ORDER BY ts, event_id) AS last FROM events GROUP BY event_type"),
    "having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15", None),
    "group_by_alias": ("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY y", None),
    "grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "decimal_aggregates": ("SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DOUBLE) AS total FROM lineitem GROUP BY l_returnflag", None),
    "rank_functions": ("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr FROM customer", None),
    "percent_rank_cume_dist": ("SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), 9) AS p, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), 9) AS c FROM supplier", None),
    "ntile": ("SELECT s_suppkey, ntile(3) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS t FROM supplier", None),
    "lead_lag": ("SELECT event_id, lag(value, 1, 0.0) OVER w AS before, lead(value, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "value_functions": ("SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "window_aggregates": ("SELECT event_id, round(sum(value) OVER w, 4) AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", None),
    "window_frames": ("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS a, count(*) OVER (PARTITION BY user_id ORDER BY value RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM events", None),
    "latest_per_series": ("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1", None),
    "distinct_on": ("SELECT DISTINCT ON (user_id) user_id, event_id FROM events ORDER BY user_id, ts DESC, event_id DESC", None),
    "nulls_order_topk": ("SELECT k, c_custkey FROM (SELECT nullif(c_nationkey, 3) AS k, c_custkey FROM customer) ORDER BY k ASC NULLS LAST, c_custkey LIMIT 50", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None),
    "union_all": ("SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region", None),
    "union_distinct": ("SELECT l_returnflag AS x FROM lineitem UNION SELECT o_orderstatus FROM orders", None),
    "intersect": ("SELECT l_returnflag AS x FROM lineitem INTERSECT SELECT o_orderstatus FROM orders", None),
    "except": ("SELECT o_orderstatus AS x FROM orders EXCEPT SELECT l_returnflag FROM lineitem", None),
    "cte": ("WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT max(t) AS m FROM a) SELECT o_custkey FROM a JOIN b ON a.t = b.m", None),
    "recursive_cte": ("WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t", None),
    "unnest": ("SELECT n_regionkey, unnest(array(n_nationkey, n_nationkey * 10)) AS x FROM nation", "SELECT n_regionkey, unnest([n_nationkey, n_nationkey * 10]) AS x FROM nation"),
    "date_functions": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS t, extract(dow FROM o_orderdate) - 1 AS d FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t, extract(dow FROM o_orderdate) AS d FROM orders"),
    "string_functions": ("SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, length(n_name) AS n, reverse(n_name) AS r, left(n_name, 2) AS a, right(n_name, 2) AS b, lpad(n_name, 12, '*') AS p, replace(n_name, 'A', '_') AS q, substr(n_name, 2, 3) AS s, instr(n_name, 'A') AS i, split_part(n_name, 'A', 1) AS sp FROM nation", None),
    "math_functions": ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(-l_quantity) AS a, ceil(l_tax) AS c, floor(l_quantity / 3) AS f, round(sqrt(l_quantity), 9) AS s, round(ln(l_quantity), 9) AS n, round(power(l_quantity, 2), 4) AS p FROM lineitem", None),
    "pricing_summary": ("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", None),
    # set comparison, operators and ordered aggregates of the dialect
    "quantified_any": ("SELECT n_nationkey FROM nation WHERE n_regionkey > ANY (SELECT r_regionkey FROM region WHERE r_regionkey > 1)", None),
    "quantified_equal_any": ("SELECT n_nationkey FROM nation WHERE n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_regionkey < 2)", None),
    "quantified_differs_all": ("SELECT n_nationkey FROM nation WHERE n_regionkey <> ALL (SELECT r_regionkey FROM region WHERE r_regionkey < 2)", None),
    "quantified_all_empty": ("SELECT n_nationkey FROM nation WHERE n_regionkey < ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 99)", None),
    "regex_operators": ("SELECT o_orderkey FROM orders WHERE o_orderpriority ~ '^[1-3]-' AND o_orderpriority !~* 'urgent'", "SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '^[1-3]-') AND NOT regexp_matches(o_orderpriority, 'urgent', 'i')"),
    "term_operator": ("SELECT doc_id FROM documents WHERE text @@ 'the'", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)')"),
    "ordered_aggregate_mixed": ("SELECT c_nationkey, first_value(c_custkey ORDER BY c_mktsegment DESC, c_custkey ASC) AS f FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, first(c_custkey ORDER BY c_mktsegment DESC, c_custkey ASC) AS f FROM customer GROUP BY c_nationkey"),
    "array_agg_distinct": ("SELECT n_regionkey, array_to_string(sort_array(array_agg(DISTINCT n_nationkey % 3)), ',') AS ids FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_nationkey % 3)), ',') AS ids FROM nation GROUP BY n_regionkey"),
    "bare_count": ("SELECT o_orderstatus, count() AS n FROM orders GROUP BY o_orderstatus", None),
    "cast_operator": ("SELECT o_orderkey::STRING AS k, o_totalprice::BIGINT AS p FROM orders", "SELECT o_orderkey::VARCHAR AS k, trunc(o_totalprice)::BIGINT AS p FROM orders"),
    "aggregate_aliases": ("SELECT event_type, round(std(value), 5) AS a, round(variance(value), 4) AS b, round(var_population(value), 4) AS c FROM events GROUP BY event_type", "SELECT event_type, round(stddev_pop(value), 5) AS a, round(var_samp(value), 4) AS b, round(var_pop(value), 4) AS c FROM events GROUP BY event_type"),
    "approx_aggregates": ("SELECT event_type, abs(approx_median(value) - percentile(value, 0.5)) < 1 AS m, abs(approx_percentile_cont(value, 0.9) - percentile(value, 0.9)) < 2 AS p, abs(approx_distinct(event_id) / count(DISTINCT event_id) - 1) < 0.15 AS d FROM events GROUP BY event_type", "SELECT event_type, true AS m, true AS p, true AS d FROM events GROUP BY event_type"),
    "weighted_percentile": ("SELECT event_type, round(approx_percentile_cont_with_weight(value, 2, 0.5), 6) AS m FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(v, 0.5), 6) AS m FROM (SELECT event_type, unnest([value, value]) AS v FROM events) GROUP BY event_type"),
    "hll_bound": ("SELECT abs(hll_count(hll(event_id)) / count(DISTINCT event_id) - 1) < 0.05 AS near FROM events", "SELECT true AS near"),
    "join_with_window": ("SELECT n_name, t.rn FROM nation JOIN (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) t ON n_nationkey = t.c_nationkey WHERE t.rn <= 2", None),
    "order_by_ordinal": ("SELECT n_regionkey AS r, n_name AS n FROM nation ORDER BY 1 DESC, n LIMIT 7", None),
    "window_nulls": ("SELECT c_custkey, sum(nullif(c_nationkey, 3)) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS s, count(nullif(c_nationkey, 3)) OVER (PARTITION BY c_mktsegment) AS n FROM customer", None),
    "values_relation": ("SELECT a, b FROM (VALUES (1, 'x'), (2, NULL)) AS t(a, b)", None),
    "numbers_table": ("SELECT number FROM numbers WHERE number % 7 = 3", "SELECT CAST(i AS INTEGER) AS number FROM range(100) r(i) WHERE i % 7 = 3"),
    "unicode_text": ("SELECT n_nationkey, concat(n_name, 'é日本') AS t, length(concat(n_name, 'é日本')) AS n, octet_length('é日本') AS o FROM nation", "SELECT n_nationkey, concat(n_name, 'é日本') AS t, length(concat(n_name, 'é日本')) AS n, strlen('é日本')::INTEGER AS o FROM nation"),
    # functions
    "vector_products": ("SELECT vec_id, round(vec_dot_product(embedding, embedding), 4) AS d, round(vec_elem_sum(vec_scalar_mul(2, embedding)), 3) AS m, round(vec_elem_sum(vec_scalar_add(1, embedding)), 3) AS a FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 4) AS d, round(list_sum(list_transform(embedding, lambda x: (x * 2)::DOUBLE)), 3) AS m, round(list_sum(list_transform(embedding, lambda x: (x + 1)::FLOAT::DOUBLE)), 3) AS a FROM embeddings"),
    "vector_pairs": ("SELECT vec_id, round(vec_elem_sum(vec_add(embedding, embedding)), 3) AS a, vec_elem_sum(vec_sub(embedding, embedding)) AS s, round(vec_elem_sum(vec_mul(embedding, embedding)), 3) AS m, vec_elem_sum(vec_div(embedding, embedding)) AS d FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x + x)::DOUBLE)), 3) AS a, 0.0::DOUBLE AS s, round(list_sum(list_transform(embedding, lambda x: (x * x)::DOUBLE)), 3) AS m, len(list_filter(embedding, lambda x: x <> 0))::DOUBLE AS d FROM embeddings"),
    "vector_parts": ("SELECT vec_id, vec_kth_elem(embedding, 1) AS k, vec_dim(vec_subvector(embedding, 1, 4)) AS n, vec_kth_elem(vec_subvector(embedding, 1, 4), 0) AS f, round(vec_elem_avg(embedding), 5) AS a, vec_dim(parse_vec(vec_to_string(embedding))) AS t FROM embeddings", "SELECT vec_id, embedding[2] AS k, 3::BIGINT AS n, embedding[2] AS f, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS a, len(embedding)::BIGINT AS t FROM embeddings"),
    "vector_norm": ("SELECT vec_id, round(vec_dot_product(vec_norm(embedding), vec_norm(embedding)), 3) AS one FROM embeddings", "SELECT vec_id, 1.0::DOUBLE AS one FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0 UNION ALL SELECT vec_id, NULL FROM embeddings WHERE NOT coalesce(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 0) > 0"),
    "address_functions": ("SELECT o_orderkey, ipv4_num_to_string(o_orderkey) AS t, ipv4_string_to_num(ipv4_num_to_string(o_orderkey)) AS n, ipv4_in_range(ipv4_num_to_string(o_orderkey), '0.0.16.0/20') AS r, ipv4_to_cidr(ipv4_num_to_string(o_orderkey), 24) AS c FROM orders", "SELECT o_orderkey, concat_ws('.', 0, (o_orderkey >> 16) & 255, (o_orderkey >> 8) & 255, o_orderkey & 255) AS t, o_orderkey AS n, (o_orderkey >> 12) = 1 AS r, concat_ws('.', 0, (o_orderkey >> 16) & 255, (o_orderkey >> 8) & 255, 0) || '/24' AS c FROM orders"),
    "json_functions": ("SELECT n_nationkey, json_get_int(json_object('k', n_nationkey, 's', n_name, 'k', n_nationkey + 1), 'k') AS k, json_get_string(json_object('s', n_name), '$.s') AS s, json_path_match(json_object('k', n_nationkey), '$.k > 3 && $.k <= 9') AS m, json_path_exists(json_object('k', n_nationkey), '$.z') AS z FROM nation", "SELECT n_nationkey, n_nationkey + 1 AS k, n_name AS s, n_nationkey > 3 AND n_nationkey <= 9 AS m, false AS z FROM nation"),
    "json_kinds": ("SELECT n_nationkey, json_is_int(concat('', n_nationkey)) AS i, json_is_string(concat('\"', n_name, '\"')) AS s, json_is_array(concat('[', n_nationkey, ']')) AS a, json_is_object(json_object('k', 1)) AS o, json_is_null('null') AS n, json_is_bool('true') AS b, json_is_float('1.5') AS f, json_to_string(parse_json(concat('[', n_nationkey, ']'))) AS t FROM nation", "SELECT n_nationkey, true AS i, true AS s, true AS a, true AS o, true AS n, true AS b, true AS f, '[' || n_nationkey || ']' AS t FROM nation"),
    "number_functions": ("SELECT o_orderkey, gcd(o_orderkey, 36) AS g, clamp(o_custkey, 10, 50) AS c, clamp_min(o_custkey, 20) AS a, clamp_max(o_custkey, 20) AS b FROM orders", "SELECT o_orderkey, gcd(o_orderkey, 36) AS g, greatest(10, least(50, o_custkey)) AS c, greatest(20, o_custkey) AS a, least(20, o_custkey) AS b FROM orders"),
    "time_functions": ("SELECT event_id, to_unixtime(ts) AS u, date_bin(INTERVAL '15 minutes', ts) AS b, date_bin(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01 00:30:00') AS o, date_format(ts, '%Y/%m/%d %H:%M') AS f, to_timestamp_millis(event_id * 1000) AS m FROM events", "SELECT event_id, epoch_us(ts) // 1000000 AS u, time_bucket(INTERVAL '15 minutes', ts) AS b, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01 00:30:00') AS o, strftime(ts, '%Y/%m/%d %H:%M') AS f, make_timestamp(event_id * 1000000) AS m FROM events"),
    "text_functions": ("SELECT n_nationkey, field(n_name, 'NATION_2', 'NATION_3') AS f, regexp_extract(n_name, '[0-9]+') AS d, array_to_string(string_to_array(n_name, '_'), '|') AS p, ucase(n_name) AS u, mid(n_name, 2, 3) AS m, strpos(n_name, '_') AS s, space(2) AS w, locate('T', n_name) AS l FROM nation", "SELECT n_nationkey, CASE n_name WHEN 'NATION_2' THEN 1 WHEN 'NATION_3' THEN 2 ELSE 0 END::BIGINT AS f, regexp_extract(n_name, '[0-9]+') AS d, array_to_string(string_split(n_name, '_'), '|') AS p, upper(n_name) AS u, substr(n_name, 2, 3) AS m, strpos(n_name, '_') AS s, '  ' AS w, strpos(n_name, 'T') AS l FROM nation"),
    "matches_query": ("SELECT doc_id FROM documents WHERE matches(text, '(the AND ing) OR -er')", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') AND contains(lower(text), 'ing')) OR NOT contains(lower(text), 'er')"),
    "place_functions": ("SELECT event_id, round(st_distance(wkt_point_from_latlng(3, 0), wkt_point_from_latlng(value, 4)), 6) AS d, round(st_distance_sphere_m('POINT(0 0)', 'POINT(0 1)'), 2) AS m FROM events", "SELECT event_id, round(sqrt(16 + (value - 3) * (value - 3)), 6) AS d, 111195.08 AS m FROM events"),
    "geohash_text": ("SELECT n_nationkey, geohash(n_nationkey * 0.0 + 57.64911, n_nationkey * 0.0 + 10.40744, 11) AS g, s2_cell_to_token(s2_cell_parent(1152921504606846977, 10)) AS p FROM nation", "SELECT n_nationkey, 'u4pruydqqvj' AS g, '100001' AS p FROM nation"),
    "geo_paths": ("SELECT user_id, json_encode_path(1, event_id, ts) LIKE '[[%' AS j, size(geo_path(1, event_id, ts)) AS n FROM events GROUP BY user_id", "SELECT user_id, true AS j, count(*)::INTEGER AS n FROM events GROUP BY user_id"),
    "type_names": ("SELECT arrow_typeof(o_orderkey) AS t, count(*) AS n FROM orders GROUP BY 1", "SELECT lower(typeof(o_orderkey)) AS t, count(*) AS n FROM orders GROUP BY 1"),
}
