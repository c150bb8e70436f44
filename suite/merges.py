from pyspark.sql import functions as F

from suite.registry import query, table
from textlake.operators import merge as M, quality as Q
from textlake.session import scratch_path

_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]

# target: finished and open orders; incoming: open and pending ones with new prices, urgent ones twice
_CTE = """
WITH target AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O')),
base AS (SELECT * FROM orders WHERE o_orderstatus IN ('O', 'P')),
incoming AS (
  SELECT o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice,
         nullif(o_orderpriority, '5-LOW') AS o_orderpriority, 1 AS seq FROM base
  UNION ALL
  SELECT o_orderkey, o_custkey, 'R', o_totalprice + 1000, o_orderpriority, 2 FROM base WHERE o_orderpriority = '1-URGENT'),
firsts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq) AS rn FROM incoming) WHERE rn = 1),
lasts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS rn FROM incoming) WHERE rn = 1)
"""


def _tables(spark, sf):
    orders = table(spark, sf, "orders")
    target = orders.where(F.col("o_orderstatus").isin("F", "O")).select(*_COLS)
    base = orders.where(F.col("o_orderstatus").isin("O", "P"))
    once = base.select(
        "o_orderkey", "o_custkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"), F.lit(1).alias("seq"),
    )
    again = base.where("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", "o_custkey", F.lit("R").alias("o_orderstatus"), (F.col("o_totalprice") + 1000).alias("o_totalprice"),
        "o_orderpriority", F.lit(2).alias("seq"),
    )
    return target, once.unionByName(again)


@query(_CTE + """
SELECT * FROM target UNION ALL
SELECT * EXCLUDE (seq) FROM firsts WHERE o_orderkey NOT IN (SELECT o_orderkey FROM target)
""")
def merge_ignore(spark, sf):
    return M.merge_ignore(*_tables(spark, sf), "o_orderkey", "seq")[0]


@query(_CTE + """
SELECT coalesce(t.o_orderkey, f.o_orderkey) AS o_orderkey, coalesce(t.o_custkey, f.o_custkey) AS o_custkey,
       CASE WHEN t.o_orderkey IS NULL THEN f.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
       CASE WHEN f.o_orderkey IS NULL THEN t.o_totalprice ELSE f.o_totalprice END AS o_totalprice,
       CASE WHEN f.o_orderkey IS NULL THEN t.o_orderpriority ELSE f.o_orderpriority END AS o_orderpriority
FROM target t FULL JOIN firsts f ON t.o_orderkey = f.o_orderkey
""")
def merge_partial(spark, sf):
    return M.merge_partial(*_tables(spark, sf), "o_orderkey", ["o_totalprice", "o_orderpriority"], "seq")[0]


@query(_CTE + """
SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM firsts) UNION ALL SELECT * EXCLUDE (seq) FROM firsts
""")
def merge_full(spark, sf):
    return M.merge_full(*_tables(spark, sf), "o_orderkey", "seq")[0]


@query(_CTE + """
SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM lasts) UNION ALL SELECT * EXCLUDE (seq) FROM lasts
""")
def merge_replace(spark, sf):
    return M.merge_replace(*_tables(spark, sf), "o_orderkey", "seq")[0]


@query(_CTE + """
SELECT 'merged' AS what, o_orderkey, o_orderstatus, o_totalprice FROM
  (SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM firsts) UNION ALL SELECT * EXCLUDE (seq) FROM firsts)
UNION ALL SELECT 'rejected', count(*), NULL, NULL FROM firsts WHERE o_orderkey % 5 = 0
""")
def merge_twice(spark, sf):
    """A batch with rows that lack the key, merged twice: the second time changes nothing, and rejects the same rows."""
    target, incoming = _tables(spark, sf)
    keyless = M.dedup(incoming, "o_orderkey", "seq").where("o_orderkey % 5 = 0").withColumn("o_orderkey", F.lit(None).cast("long"))
    batch = incoming.unionByName(keyless)
    once, _ = M.merge_full(target, batch, "o_orderkey", "seq")
    merged, counts = M.merge_full(once, batch, "o_orderkey", "seq")
    rows = merged.select(F.lit("merged").alias("what"), "o_orderkey", "o_orderstatus", "o_totalprice")
    left_out = counts.select(F.lit("rejected").alias("what"), F.col("rejected").alias("o_orderkey"), F.lit(None).alias("o_orderstatus"), F.lit(None).alias("o_totalprice"))
    return rows.unionByName(left_out)


_AUDIT_COLS = ["o_orderstatus", "o_totalprice"]


def _audited(spark, sf):
    target, incoming = _tables(spark, sf)
    stamp = F.lit("2023-01-01 00:00:00").cast("timestamp")
    target = target.select(
        (F.col("o_orderkey") + 1).alias("id"), "o_orderkey", *_AUDIT_COLS, stamp.alias("created_at"), stamp.alias("updated_at")
    )
    return M.merge_audited(target, incoming, "o_orderkey", _AUDIT_COLS, "2024-06-01 00:00:00", order_by="seq")


@query(_CTE + """,
added AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM firsts WHERE o_orderkey NOT IN (SELECT o_orderkey FROM target))
SELECT t.o_orderkey + 1 AS id, t.o_orderkey,
       CASE WHEN f.o_orderkey IS NULL THEN t.o_orderstatus ELSE f.o_orderstatus END AS o_orderstatus,
       CASE WHEN f.o_orderkey IS NULL THEN t.o_totalprice ELSE f.o_totalprice END AS o_totalprice,
       2023 AS created, CASE WHEN f.o_orderkey IS NULL THEN 2023 ELSE 2024 END AS updated
FROM target t LEFT JOIN firsts f ON t.o_orderkey = f.o_orderkey
UNION ALL
SELECT (SELECT max(o_orderkey) + 1 FROM target) + n, o_orderkey, o_orderstatus, o_totalprice, 2024, 2024 FROM added
""")
def merge_audit(spark, sf):
    merged = _audited(spark, sf)[0]
    return merged.select("id", "o_orderkey", *_AUDIT_COLS, F.year("created_at").alias("created"), F.year("updated_at").alias("updated"))


@query(_CTE + """,
added AS (SELECT o_orderkey, o_orderkey % 2 AS writer FROM firsts WHERE o_orderkey NOT IN (SELECT o_orderkey FROM target)),
top AS (SELECT max(o_orderkey) + 1 AS last FROM target)
SELECT writer, o_orderkey, last + row_number() OVER (ORDER BY writer, o_orderkey) AS id FROM added, top
UNION ALL SELECT 2, o_orderkey, last + row_number() OVER (ORDER BY o_orderkey) FROM added, top WHERE writer = 0
""")
def merge_two_writers(spark, sf):
    """Two change sets merged into the same state of a target, and the first one again: ids come from reserved ranges."""
    target, incoming = _tables(spark, sf)
    stamp = F.lit("2023-01-01 00:00:00").cast("timestamp")
    target = target.select((F.col("o_orderkey") + 1).alias("id"), "o_orderkey", *_AUDIT_COLS, stamp.alias("created_at"), stamp.alias("updated_at"))
    ledger, out = scratch_path(spark, "ledger"), []
    for writer, part in ((0, 0), (1, 1), (2, 0)):
        mine = incoming.where(F.col("o_orderkey") % 2 == part)
        merged, _ = M.merge_audited(target, mine, "o_orderkey", _AUDIT_COLS, "2024-06-01 00:00:00", order_by="seq", ledger=ledger, owner=f"set {part}")
        new = merged.where(F.year("created_at") == 2024)
        out.append(new.select(F.lit(writer).alias("writer"), "o_orderkey", "id"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(_CTE + """
SELECT m AS merge, (SELECT count(*) FROM firsts WHERE o_orderkey NOT IN (SELECT o_orderkey FROM target)) AS inserted,
       (SELECT count(*) FROM firsts WHERE o_orderkey IN (SELECT o_orderkey FROM target)) AS matched
FROM (VALUES ('ignore'), ('partial'), ('full'), ('replace'), ('audited')) v(m)
""")
def merge_counts(spark, sf):
    target, incoming = _tables(spark, sf)
    counts = {
        "ignore": M.merge_ignore(target, incoming, "o_orderkey", "seq")[1],
        "partial": M.merge_partial(target, incoming, "o_orderkey", ["o_totalprice"], "seq")[1],
        "full": M.merge_full(target, incoming, "o_orderkey", "seq")[1],
        "replace": M.merge_replace(target, incoming, "o_orderkey", "seq")[1],
        "audited": _audited(spark, sf)[1],
    }
    out = [df.select(F.lit(name).alias("merge"), "inserted", "matched") for name, df in counts.items()]
    merged = out[0]
    for one in out[1:]:
        merged = merged.unionByName(one)
    return merged


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn
  FROM lineitem) WHERE rn = 1
""")
def stage_distinct(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    staged = M.stage_distinct(lines.unionByName(lines))
    return M.dedup(staged, "l_orderkey", "l_linenumber")


@query("""
WITH d AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'unique' AS check_name, 'l_orderkey' AS col, count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'not_null', 'quality', count(*) FROM d WHERE quality IS NULL
UNION ALL SELECT 'not_null', 'toxic', count(*) FROM d WHERE toxic IS NULL
UNION ALL SELECT 'bound', 'long_enough', count(*) FROM d WHERE NOT length(text) >= 200
UNION ALL SELECT 'bound', 'good', count(*) FROM d WHERE quality IS NULL OR quality <> 1
""")
def quality_violations(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    unique = Q.unique_violations(table(spark, sf, "lineitem"), "l_orderkey").agg(F.count("*").alias("n"))
    nulls = Q.null_violations(docs, ["doc_id", "quality", "toxic"])
    rules = {"long_enough": F.length("text") >= 200, "good": F.col("quality") == 1}
    bounds = Q.bound_violations(docs.select("text", "quality"), rules).groupBy("rule").agg(F.count("*").alias("n"))
    return (
        unique.select(F.lit("unique").alias("check_name"), F.lit("l_orderkey").alias("col"), "n")
        .unionByName(nulls.select(F.lit("not_null").alias("check_name"), F.col("column").alias("col"), "n"))
        .unionByName(bounds.select(F.lit("bound").alias("check_name"), F.col("rule").alias("col"), "n"))
    )


@query("""
WITH d AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'rows' AS "check", NULL AS "column", count(*) AS n FROM d
UNION ALL SELECT 'null', 'doc_id', 0 UNION ALL SELECT 'null', 'quality', count(*) FROM d WHERE quality IS NULL
UNION ALL SELECT 'rule', 'long_enough', count(*) FROM d WHERE NOT length(text) >= 200
UNION ALL SELECT 'rule', 'good', count(*) FROM d WHERE quality IS NULL OR quality <> 1
UNION ALL SELECT 'unique', 'source', count(*) FROM (SELECT source FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'written', NULL, sum(n_chars)::BIGINT FROM d
UNION ALL SELECT 'empty result', NULL, 1
""")
def checked_write(spark, sf):
    """A table checked in the pass that writes it; a result without rows is refused."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rules = {"long_enough": F.length("text") >= 200, "good": F.col("quality") == 1}
    written, report = Q.write_checked(docs, scratch_path(spark, "checked"), ["doc_id", "quality"], rules, "source")
    try:
        Q.write_checked(docs.where(F.length("text") < 0), scratch_path(spark, "none"), message="no documents")
        refused = 0
    except Q.QualityError:
        refused = 1
    none = F.lit(None).cast("string").alias("column")
    more = written.agg(F.sum("n_chars").alias("n")).select(F.lit("written").alias("check"), none, "n")
    return report.unionByName(more).unionByName(spark.range(1).select(F.lit("empty result").alias("check"), none, F.lit(refused).cast("long").alias("n")))
