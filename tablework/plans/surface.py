"""The SQL surface as runnable statements over the tables.

Each entry is (Spark SQL, DuckDB SQL or None when the text is the same).
These are plain ``spark.sql`` statements: Catalyst plans them (pushdown,
partial aggregation, broadcast of the small join sides by its own size
estimate, sort-merge otherwise).  Where Spark's spelling of a function
differs from the plain name the reference advertises, the Spark column uses
the ``tablework.functions.compat`` form and the DuckDB text the native one.

Money columns are summed as DECIMAL(18,2) so both engines produce the exact
same value; float-valued function results are rounded to 6 places.
"""

from __future__ import annotations

SURFACE: dict[str, tuple[str, str | None]] = {}


def _add(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    SURFACE[name] = (spark_sql.strip(), duck_sql.strip() if duck_sql else None)


# ---------------------------------------------------------------- Q1 - Q9
_add("select_distinct", """
SELECT DISTINCT c_nationkey, c_mktsegment FROM customer
""")
_add("select_alias_all", """
SELECT ALL o_orderkey AS order_key, o_custkey AS customer_key, o_totalprice AS price
FROM orders WHERE o_orderstatus = 'F'
""")
_add("where_and_or_not", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders
WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND NOT (o_totalprice < 150000)
""")
_add("in_list", """
SELECT p_partkey, p_brand, p_type, p_size FROM part
WHERE p_size IN (1, 5, 10, 20) AND p_type NOT IN ('SMALL', 'LARGE')
""")
_add("not_in_subquery", """
SELECT c_custkey, c_nationkey FROM customer
WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)
""")
_add("in_subquery", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  AND o_orderpriority = '1-URGENT'
""")
_add("like_ilike", """
SELECT p_partkey, p_name, p_brand FROM part
WHERE (p_name LIKE '%bolt' OR p_name NOT LIKE 'red%') AND p_brand ILIKE 'BRAND#1%'
""")
_add("between_is_null", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice BETWEEN 100000 AND 200000
  AND CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
  AND o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL
""")
_add("exists", """
SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
              AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F')
""")
_add("not_exists", """
SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                  AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F')
""")
_add("rlike", """
SELECT p_partkey, p_name FROM part WHERE p_name RLIKE '^(red|blue) (bolt|gear)'
""", """
SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) (bolt|gear)')
""")
_add("case_if_nullif", """
SELECT o_orderkey,
       CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid'
            ELSE 'low' END AS band,
       IF(o_orderstatus = 'F', 1, 0) AS is_final,
       IFNULL(NULLIF(o_orderpriority, '5-LOW'), 'low') AS priority
FROM orders
""")

# ---------------------------------------------------------------- joins
_add("join_inner_on", """
SELECT o.o_orderkey, o.o_orderdate, c.c_name, c.c_mktsegment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_mktsegment = 'BUILDING'
""")
_add("join_using", """
SELECT l_orderkey, l_linenumber, l_partkey, o_custkey
FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey, o_custkey FROM orders
                    WHERE o_orderpriority = '1-URGENT') o USING (l_orderkey)
""")
_add("join_left", """
SELECT c.c_custkey, CAST(o.o_orderkey AS STRING) AS o_orderkey
FROM customer c LEFT JOIN orders o
  ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F'
""")
_add("join_right", """
SELECT CAST(o.o_orderkey AS STRING) AS o_orderkey, c.c_custkey
FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') o
RIGHT JOIN customer c ON c.c_custkey = o.o_custkey
""")
_add("join_full", """
SELECT CAST(o.o_orderkey AS STRING) AS o_orderkey, CAST(o.o_custkey AS STRING) AS o_custkey,
       CAST(c.c_custkey AS STRING) AS c_custkey
FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') o
FULL OUTER JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c
  ON c.c_custkey = o.o_custkey
""")
_add("join_natural", """
SELECT * FROM (SELECT o_custkey AS custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O') a
NATURAL JOIN (SELECT c_custkey AS custkey, c_name FROM customer) b
""")
_add("join_semi", """
SELECT c_custkey, c_nationkey FROM customer LEFT SEMI JOIN
  (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o.o_custkey
""", """
SELECT c_custkey, c_nationkey FROM customer SEMI JOIN
  (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o.o_custkey
""")
_add("join_anti", """
SELECT c_custkey, c_nationkey FROM customer LEFT ANTI JOIN
  (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o.o_custkey
""", """
SELECT c_custkey, c_nationkey FROM customer ANTI JOIN
  (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o.o_custkey
""")
_add("join_theta", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS order_date
FROM lineitem l JOIN orders o
  ON l.l_orderkey = o.o_orderkey AND l.l_shipdate < o.o_orderdate
""")
_add("join_star", """
SELECT r.r_name, n.n_name, count(*) AS n_lines,
       CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, n.n_name
""")

# ---------------------------------------------------------------- aggregation
_add("group_having", """
SELECT l_returnflag, l_linestatus, count(*) AS count_order,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
            AS DOUBLE) AS sum_disc_price,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS avg_qty,
       min(l_discount) AS min_disc, max(l_discount) AS max_disc
FROM lineitem
WHERE CAST(l_shipdate AS DATE) <= DATE '2000-12-01'
GROUP BY l_returnflag, l_linestatus
HAVING count(*) > 100
""")
_add("agg_basic", """
SELECT o_orderpriority,
       count(*) AS n, count(o_custkey) AS n_cust,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS mean,
       min(o_totalprice) AS lo, max(o_totalprice) AS hi,
       round(stddev(o_totalprice), 4) AS sd, round(variance(o_totalprice), 2) AS var
FROM orders GROUP BY o_orderpriority
""")
_add("rollup", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       CAST(grouping(o_orderstatus) AS INT) AS g_status,
       CAST(grouping(o_orderpriority) AS INT) AS g_priority
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""")
_add("cube", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n,
       CAST(grouping(o_orderstatus) AS INT) AS g_status,
       CAST(grouping(o_orderpriority) AS INT) AS g_priority
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
_add("grouping_sets", """
SELECT l_returnflag, l_linestatus, count(*) AS n,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())
""")
_add("count_distinct_filter", """
SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_totalprice > 200000)
            AS DOUBLE) AS big_total
FROM orders GROUP BY o_orderstatus
""")
_add("string_agg_ordered", """
SELECT l_orderkey,
       string_agg(CAST(l_linenumber AS STRING), ',') WITHIN GROUP (ORDER BY l_linenumber, l_partkey)
         AS line_numbers,
       listagg(CAST(l_partkey AS STRING), ';') WITHIN GROUP (ORDER BY l_partkey, l_linenumber) AS parts
FROM lineitem GROUP BY l_orderkey
""", """
SELECT l_orderkey,
       string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS line_numbers,
       group_concat(CAST(l_partkey AS VARCHAR), ';' ORDER BY l_partkey, l_linenumber) AS parts
FROM lineitem GROUP BY l_orderkey
""")
_add("array_agg_nulls", """
SELECT l_orderkey,
       CAST(size(transform(array_agg(struct(NULLIF(l_linestatus, 'O') AS s)), x -> x.s)) AS BIGINT) AS n_with_nulls,
       CAST(size(array_agg(NULLIF(l_linestatus, 'O'))) AS BIGINT) AS n_without_nulls,
       array_join(array_sort(collect_list(l_linenumber)), ',') AS lines
FROM lineitem GROUP BY l_orderkey
""", """
SELECT l_orderkey,
       len(array_agg(NULLIF(l_linestatus, 'O'))) AS n_with_nulls,
       count(NULLIF(l_linestatus, 'O')) AS n_without_nulls,
       array_to_string(list_sort(array_agg(l_linenumber)), ',') AS lines
FROM lineitem GROUP BY l_orderkey
""")
_add("json_agg", """
SELECT n_regionkey, to_json(array_sort(collect_list(n_name))) AS names,
       to_json(array_sort(collect_list(n_nationkey))) AS keys
FROM nation GROUP BY n_regionkey
""", """
SELECT n_regionkey, to_json(list_sort(list(n_name)))::VARCHAR AS names,
       to_json(list_sort(list(n_nationkey)))::VARCHAR AS keys
FROM nation GROUP BY n_regionkey
""")

# ---------------------------------------------------------------- ordering
_add("topk", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25
""")
_add("limit_offset", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 250
""")

# ---------------------------------------------------------------- set operations
_add("union_distinct", """
SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier
""")
_add("union_all", """
SELECT c_custkey AS k, 'customer' AS kind FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_acctbal > 9000
""")
_add("intersect_distinct", """
SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'
INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000
""")
_add("intersect_all", """
SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'
INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
""")
_add("except_distinct", """
SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'
EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
""")
_add("except_all", """
SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'
EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
""")
_add("minus", """
SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'
MINUS SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000
""", """
SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'
EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000
""")

# ---------------------------------------------------------------- CTE / subqueries
_add("cte", """
WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY o_custkey),
     seg AS (SELECT c_custkey, c_mktsegment FROM customer)
SELECT seg.c_mktsegment, count(*) AS customers, CAST(sum(big.n) AS BIGINT) AS big_orders
FROM big JOIN seg ON big.o_custkey = seg.c_custkey GROUP BY seg.c_mktsegment
""")
_add("recursive_cte", """
WITH RECURSIVE months(m, hi) AS (
  SELECT min(year(o_orderdate) * 12 + month(o_orderdate) - 1),
         max(year(o_orderdate) * 12 + month(o_orderdate) - 1) FROM orders
  UNION ALL
  SELECT m + 1, hi FROM months WHERE m < hi
)
SELECT CAST(m AS BIGINT) AS month_index, count(o.o_orderkey) AS n_orders
FROM months LEFT JOIN orders o ON year(o.o_orderdate) * 12 + month(o.o_orderdate) - 1 = m
GROUP BY m
""")
_add("lateral_unnest", """
SELECT e.vec_id, count(*) AS n, CAST(max(t.pos) AS BIGINT) AS max_pos, CAST(min(t.v) AS DOUBLE) AS min_v,
       CAST(max(t.v) AS DOUBLE) AS max_v
FROM embeddings e, LATERAL posexplode(e.embedding) AS t(pos, v)
GROUP BY e.vec_id
""", """
SELECT vec_id, count(*) AS n, max(pos) AS max_pos, CAST(min(v) AS DOUBLE) AS min_v, CAST(max(v) AS DOUBLE) AS max_v
FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)
GROUP BY vec_id
""")
_add("scalar_subquery", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)
""")
_add("correlated_subquery", """
SELECT c.c_custkey,
       (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders,
       (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS max_price
FROM customer c
""")
_add("values_inline", """
SELECT v.label, count(*) AS n
FROM orders JOIN (VALUES ('F', 'final'), ('O', 'open'), ('P', 'pending')) AS v(k, label)
  ON o_orderstatus = v.k
GROUP BY v.label
""")

# ---------------------------------------------------------------- windows
_add("window_ranking", """
SELECT o_orderkey, o_custkey,
       CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rnk,
       CAST(dense_rank() OVER w AS BIGINT) AS drnk, percent_rank() OVER w AS prnk,
       cume_dist() OVER w AS cdist, CAST(ntile(3) OVER w AS BIGINT) AS tile
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
_add("window_offsets", """
SELECT o_orderkey, o_custkey,
       lag(o_orderkey, 1, -1) OVER w AS prev_key, CAST(lead(o_orderkey, 2) OVER w AS STRING) AS next2_key,
       first_value(o_orderkey) OVER wf AS first_key, last_value(o_orderkey) OVER wf AS last_key,
       CAST(nth_value(o_orderkey, 2) OVER wf AS STRING) AS second_key
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
       wf AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
_add("window_frames", """
SELECT o_orderkey, o_custkey,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
            ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS sum_last3,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running,
       count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
            RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n_near,
       max(o_totalprice) OVER (PARTITION BY o_custkey) AS cust_max
FROM orders
""")
