"""Relational queries: each is Spark SQL with the same query for DuckDB.

Where both dialects agree there is one text. Sums of doubles go through decimals, so
that they don't depend on the order of addition, and null orders are spelled out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

#: name -> (Spark SQL, DuckDB SQL or None where it is the same)
SQL: dict[str, tuple[str, str | None]] = {
    "scan_filter_project": ("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, upper(l_returnflag) AS flag FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.02 AND 0.05 AND l_returnflag IN ('A', 'R') AND NOT l_linestatus = 'X'", None),
    "typed_nulls_casts": ("SELECT o_orderkey, CAST(NULL AS BIGINT) AS none, CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR(20)) AS txt, (o_totalprice > 1000) IS TRUE AS big FROM orders", "SELECT o_orderkey, CAST(NULL AS BIGINT) AS none, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS txt, (o_totalprice > 1000) IS TRUE AS big FROM orders"),
    "zero_row_describe": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE false", None),
    "inner_join": ("SELECT o_orderkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 20000", None),
    "left_join": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'", None),
    "right_join": ("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 100000", None),
    "full_join": ("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey", None),
    "semi_join": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", None),
    "anti_join": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "cross_join": ("SELECT a.n_name AS n1, r_name FROM nation a CROSS JOIN region", None),
    "join_using": ("SELECT l_orderkey, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') o USING (l_orderkey) GROUP BY l_orderkey", None),
    "scalar_subquery": ("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT max(p_retailprice) * 0.9 FROM part)", None),
    "exists_subquery": ("SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000)", None),
    "cte": ("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE n > 12) SELECT c_name, n FROM customer JOIN big ON c_custkey = big.o_custkey JOIN top ON top.o_custkey = big.o_custkey", None),
    "pivot": ("SELECT * FROM (SELECT l_returnflag AS flag, l_linestatus AS status FROM lineitem) PIVOT (count(*) FOR status IN ('O' AS open_n, 'F' AS final_n))", "SELECT l_returnflag AS flag, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS open_n, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS final_n FROM lineitem GROUP BY l_returnflag"),
    "unpivot": ("SELECT p_partkey, what, val FROM (SELECT p_partkey, p_brand AS brand, p_type AS kind FROM part) UNPIVOT (val FOR what IN (brand, kind))", "SELECT p_partkey, 'brand' AS what, p_brand AS val FROM part WHERE p_brand IS NOT NULL UNION ALL SELECT p_partkey, 'kind', p_type FROM part WHERE p_type IS NOT NULL"),
    "pricing_summary": ("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_filter": ("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, CAST(sum(o_orderkey) FILTER (WHERE o_totalprice > 1000) AS BIGINT) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders", None),
    "agg_distinct": ("SELECT o_orderpriority, count(DISTINCT o_custkey) AS custs, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_orderpriority", None),
    "wide_sum": ("SELECT CAST(sum(CAST(o_orderkey AS DECIMAL(38,0)) * 1000000000000) AS DECIMAL(38,0)) AS s FROM orders", None),
    "grouping_sets": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "rollup": ("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)", None),
    "string_agg_ordered": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "json_array_agg": ("SELECT n_regionkey, to_json(array_sort(collect_list(named_struct('k', n_nationkey, 'n', n_name)))) AS js FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(struct_pack(k := n_nationkey, n := n_name) ORDER BY n_nationkey)) AS VARCHAR) AS js FROM nation GROUP BY n_regionkey"),
    "schema_fingerprint": ("SELECT sha2(to_json(array_sort(collect_list(named_struct('k', r_regionkey, 'n', r_name)))), 256) AS fp FROM region", "SELECT sha256(CAST(to_json(list(struct_pack(k := r_regionkey, n := r_name) ORDER BY r_regionkey)) AS VARCHAR)) AS fp FROM region"),
    "row_number": ("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders", None),
    "rank_dense_ntile": ("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS BIGINT) AS q FROM part", None),
    "lag_lead": ("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after2 FROM events", None),
    "running_sum_rows": ("SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS run FROM lineitem", None),
    "range_frame": ("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part", None),
    "count_over_all": ("SELECT n_nationkey, count(*) OVER () AS total FROM nation", None),
    "topk_per_group": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 2", None),
    "qualify_rewrite": ("SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) x WHERE rn = 1", "SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1"),
    "first_last": ("SELECT DISTINCT o_custkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", None),
    "order_nulls_last": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 30000 ORDER BY o_orderkey ASC NULLS LAST, c_custkey", None),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25", None),
    "limit_offset": ("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20", None),
    "distinct": ("SELECT DISTINCT p_brand, p_size FROM part", None),
    "distinct_on": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) x WHERE rn = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey"),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier", None),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "string_funcs": ("SELECT p_partkey, length(p_name) AS n, lower(p_name) AS lo, lpad(p_brand, 12, '*') AS lp, repeat('ab', p_size % 3) AS rp, replace(p_name, 'a', 'A') AS re, substr(p_name, 2, 3) AS su, trim(p_type) AS tr, p_name || '-' || p_brand AS cc, greatest(p_size, 10) AS gr FROM part", None),
    "prefix_suffix": ("SELECT p_partkey, startswith(p_name, 'p') AS s, endswith(p_type, 'L') AS e FROM part", "SELECT p_partkey, starts_with(p_name, 'p') AS s, ends_with(p_type, 'L') AS e FROM part"),
    "regex_funcs": ("SELECT p_partkey, regexp_extract(p_name, '([0-9]+)', 1) AS x, regexp_replace(p_name, '[aeiou]', '_') AS r, p_brand RLIKE '^Brand#[0-9]+$' AS m FROM part", "SELECT p_partkey, regexp_extract(p_name, '([0-9]+)', 1) AS x, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, regexp_full_match(p_brand, 'Brand#[0-9]+') AS m FROM part"),
    "hex_octet": ("SELECT n_nationkey, hex(n_name) AS h, CAST(octet_length(n_name) AS BIGINT) AS o, decode(unhex(hex(n_name)), 'UTF-8') AS b FROM nation", "SELECT n_nationkey, hex(n_name) AS h, CAST(octet_length(encode(n_name)) AS BIGINT) AS o, decode(from_hex(hex(n_name))) AS b FROM nation"),
    "date_funcs": ("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, DATE '2020-02-29' AS lit FROM orders", None),
    "math_funcs": ("SELECT p_partkey, p_size / 7 AS q, p_size % 7 AS m, -p_size % 3 AS nm, abs(p_size - 25) AS a, floor(p_retailprice) AS f, sqrt(p_size) AS s FROM part", "SELECT p_partkey, p_size / 7 AS q, p_size % 7 AS m, -p_size % 3 AS nm, abs(p_size - 25) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, sqrt(p_size) AS s FROM part"),
    "array_funcs": ("SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, element_at(embedding, 1) AS first, element_at(embedding, -1) AS last FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding[1] AS first, embedding[-1] AS last FROM embeddings"),
    "unnest": ("SELECT vec_id, pos, v FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, v", "SELECT vec_id, CAST(i - 1 AS INT) AS pos, embedding[i] AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"),
    "json_funcs": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "case_coalesce_trycast": ("SELECT o_orderkey, CASE WHEN o_totalprice > 10000 THEN 'hi' WHEN o_totalprice > 1000 THEN 'mid' ELSE 'lo' END AS c, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s, try_cast(o_orderpriority AS INT) AS t FROM orders", None),
    "range_generator": ("SELECT id AS i, id * id AS sq FROM range(1000)", "SELECT range AS i, range * range AS sq FROM range(1000)"),
    "values_list": ("SELECT a, b FROM VALUES (1, 'x'), (2, 'y'), (3, NULL) AS t(a, b)", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)"),
    "tumbling_window": ("SELECT window.start AS w, event_type, count(*) AS n FROM (SELECT CAST(ts AS TIMESTAMP_NTZ) AS ts, event_type FROM events) GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL '1 hour', ts) AS w, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "session_window": ("SELECT user_id, session_window.start AS s, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')", "SELECT user_id, min(ts) AS s, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g"),
}


def views(spark: SparkSession, sf_dir: str) -> None:
    """Name the tables of a directory in the session."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return spark.sql(text)

    return run


QUERIES = {name: query(text) for name, (text, _) in SQL.items()}
ORACLES = {name: other or text for name, (text, other) in SQL.items()}
