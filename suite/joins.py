from pyspark.sql import functions as F

from suite.registry import query, table
from textlake.functions.scalars import pad_key, strip_prefix, weighted_score
from textlake.operators import aggregates as A, relational as R


@query("""
SELECT p_partkey, (
    SELECT string_agg(s.s_name, ',' ORDER BY d.pos)
    FROM (SELECT unnest([p_size * 3, CAST(floor(p_retailprice - 900) * 2 AS BIGINT), p_size]) AS sid, unnest([1, 2, 3]) AS pos) d
    JOIN supplier s ON s.s_suppkey = d.sid AND part.p_type <> 'SMALL') AS names
FROM part
""")
def resolve_id_list(spark, sf):
    ids = F.concat_ws(",", F.col("p_size") * 3, F.floor(F.col("p_retailprice") - 900) * 2, "p_size")
    part = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type") != "SMALL", ids).alias("ids"))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("sid"), "s_name")
    return R.resolve_id_list(part, "ids", names, "sid", "s_name")


@query("""
SELECT l_orderkey, (SELECT string_agg(s_name, ',' ORDER BY pos) FROM (SELECT unnest([l_suppkey, l_partkey]) AS sid, unnest([1, 2]) AS pos) d
                    JOIN supplier ON s_suppkey = d.sid) AS names
FROM lineitem
""")
def resolve_repeated_keys(spark, sf):
    """Lists of the lines of an order: the key repeats, and each line keeps its own list."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.concat_ws(",", "l_suppkey", "l_partkey").alias("ids"))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("sid"), "s_name")
    return R.resolve_id_list(lines, "ids", names, "sid", "s_name")


@query("""
SELECT p_partkey, round(p_retailprice * log10(p_size), 6) AS score FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50)
ORDER BY p_retailprice * log10(p_size) DESC, p_partkey LIMIT 100
""")
def candidates_topn(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity = 50")
    open_parts = R.not_covered(table(spark, sf, "part"), done, "p_partkey", "l_partkey")
    top = A.weighted_top(open_parts, "p_retailprice", "p_size", 100, "p_partkey")
    return top.select("p_partkey", F.round(weighted_score("p_retailprice", "p_size"), 6).alias("score"))


@query("""
SELECT substr('tt' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0'), 3) AS order_id, o_orderstatus FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def not_in_candidates(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    rest = R.not_covered(table(spark, sf, "orders"), returned, "o_orderkey", "l_orderkey")
    return rest.select(strip_prefix(pad_key("o_orderkey")).alias("order_id"), "o_orderstatus")


@query("""
SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
""")
def not_covered_texts(spark, sf):
    """Texts without a good label: those that are surely none of the labelled ones are not shuffled."""
    good = table(spark, sf, "labels").where("quality = 1")
    rest = R.not_covered(table(spark, sf, "documents").select("doc_id", "text"), good, "doc_id", prefilter=True)
    return rest.select("doc_id", F.md5("text").alias("digest"))


@query("""
SELECT conv_id, turn, least(greatest(coalesce(CASE WHEN turn % 3 > 0 THEN turn * 60 - 100 END, 20), 1), 200)::INTEGER AS top_k FROM conversations
""")
def resolved_k(spark, sf):
    """Numbers of results asked for: missing, too small, too large and allowed ones."""
    asked = F.when(F.col("turn") % 3 > 0, F.col("turn") * 60 - 100).cast("int")
    return table(spark, sf, "conversations").select("conv_id", "turn", A.resolve_k(asked).alias("top_k"))


@query("""
SELECT c_custkey, s_suppkey FROM customer JOIN supplier
  ON ('tt' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') = 'tt' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0'))
  OR (c_nationkey = s_nationkey AND right(c_name, 2) = right(s_name, 2))
""")
def disjunctive_join(spark, sf):
    return R.either_join(
        table(spark, sf, "customer"),
        table(spark, sf, "supplier"),
        (pad_key("c_custkey"), pad_key("s_suppkey")),
        [(F.col("c_nationkey"), F.col("s_nationkey")), (F.right("c_name", F.lit(2)), F.right("s_name", F.lit(2)))],
        ["c_custkey"],
        ["s_suppkey"],
    )


@query("""
WITH a AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'),
b AS (SELECT * FROM orders WHERE o_orderpriority = '2-HIGH' AND o_custkey NOT IN (SELECT o_custkey FROM a)),
c AS (SELECT * FROM orders WHERE o_orderpriority = '5-LOW'
      AND o_custkey NOT IN (SELECT o_custkey FROM a) AND o_custkey NOT IN (SELECT o_custkey FROM b))
SELECT o_custkey, o_orderkey, o_orderpriority FROM a UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority FROM b
UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority FROM c
""")
def priority_sources(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    ranked = ["1-URGENT", "2-HIGH", "5-LOW"]
    return R.coalesce_sources([orders.where(F.col("o_orderpriority") == p) for p in ranked], "o_custkey")


@query("""
SELECT count(*) AS total,
       count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)) AS from_first,
       count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)) AS from_other
FROM orders
""")
def origin_counts(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 5000")
    return A.origin_counts(table(spark, sf, "orders"), "o_custkey", rich, "c_custkey")


_EDGES = A.POPULARITY_EDGES
_CELLS = ", ".join(
    f"count(CASE WHEN {lo} {'<=' if i == 0 else '<'} value * 1000 AND value * 1000 <= {hi} THEN 1 END) AS in_range_{lo}_{hi}"
    for i, (lo, hi) in enumerate(zip(_EDGES[:-1], _EDGES[1:]))
)


@query(f"SELECT {_CELLS} FROM events")
def range_histogram(spark, sf):
    events = table(spark, sf, "events").select((F.col("value") * 1000).alias("v"))
    return A.range_histogram(events, "v")


@query("""
WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey),
b(lo, hi) AS (VALUES (0, 5), (5, 10), (10, 15), (15, 20), (20, 40))
SELECT lo, hi, (SELECT count(*) FROM c WHERE c.n > b.lo AND c.n <= b.hi) AS n FROM b
""")
def range_histogram_long(spark, sf):
    per_customer = table(spark, sf, "orders").groupBy("o_custkey").count()
    return A.range_histogram(per_customer, "count", (0, 5, 10, 15, 20, 40), wide=False)


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS grp, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 5
""")
def recent_group_counts(spark, sf):
    return A.top_groups(table(spark, sf, "orders"), F.year("o_orderdate"))


@query("""
SELECT 'r' || r_regionkey AS root, 'c' || c_custkey AS page
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
UNION
SELECT 'r' || r_regionkey, 's' || s_suppkey
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
""")
def category_expand(spark, sf):
    from textlake.operators.extract import expand_category

    def edges(name, parent, p, child, c, kind):
        return table(spark, sf, name).select(
            F.concat(F.lit(p), F.col(parent).cast("string")).alias("parent"),
            F.concat(F.lit(c), F.col(child).cast("string")).alias("child"),
            F.lit(kind).alias("kind"),
        )

    graph = (
        edges("nation", "n_regionkey", "r", "n_nationkey", "n", "category")
        .unionByName(edges("nation", "n_nationkey", "n", "n_regionkey", "r", "category"))
        .unionByName(edges("customer", "c_nationkey", "n", "c_custkey", "c", "page"))
        .unionByName(edges("supplier", "s_nationkey", "n", "s_suppkey", "s", "page"))
    )
    roots = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return expand_category(graph, roots, max_depth=1).select("root", "page")


@query("""
WITH RECURSIVE e AS (
  SELECT c_custkey // 2 AS parent, c_custkey AS child FROM customer WHERE c_custkey > 1
  UNION ALL SELECT c_custkey, c_custkey // 8 FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT c_custkey, c_custkey FROM customer WHERE c_custkey % 5 = 0),
r AS (SELECT c_custkey AS root, c_custkey AS node, 0 AS depth FROM customer WHERE c_custkey IN (1, 3, 14)
      UNION SELECT root, child, depth + 1 FROM r JOIN e ON parent = node WHERE depth < 24),
n AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node),
p AS (SELECT root, o_orderkey AS page, min(depth) AS depth FROM n JOIN orders ON o_custkey = node GROUP BY root, o_orderkey),
w AS (SELECT page, row_number() OVER (ORDER BY page) AS place FROM (SELECT DISTINCT page FROM p))
SELECT 'c' || root AS root, place, page, depth FROM p JOIN w USING (page)
""")
def category_depths(spark, sf):
    """A tree of customers about ten levels deep, with edges back to ancestors and to themselves; orders are the pages, in sorted order."""
    from textlake.operators.extract import expand_category, work_list

    key = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    customers = table(spark, sf, "customer").select("c_custkey")
    half, eighth = F.floor(key / 2).cast("long"), F.floor(key / 8).cast("long")
    graph = customers.where("c_custkey > 1").select(name(half).alias("parent"), name(key).alias("child"))
    graph = graph.unionByName(customers.where("c_custkey % 7 = 0").select(name(key).alias("parent"), name(eighth).alias("child")))
    graph = graph.unionByName(customers.where("c_custkey % 5 = 0").select(name(key).alias("parent"), name(key).alias("child")))
    pages = table(spark, sf, "orders").select(name(F.col("o_custkey")).alias("parent"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("child"), F.lit("page").alias("kind"))
    roots = customers.where("c_custkey IN (1, 3, 14)").select(name(key).alias("root"))
    found = expand_category(graph.withColumn("kind", F.lit("category")).unionByName(pages), roots, max_depth=None)
    placed = found.join(work_list(found), "page")
    return placed.select("root", "place", F.col("page").cast("long").alias("page"), "depth")
