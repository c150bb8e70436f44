"""The jobs that write tables: export with its import log, upserts, fetched plots, documents to vectors, wikitext to plots."""

from pyspark.sql import functions as F

from suite.corpus import _MOVIES, movies
from suite.registry import query, table
from suite.searching import _LETTERS, _letters, count_letters
from textlake import schemas
from textlake.functions.scalars import NO_LINKS, NO_PLOT
from textlake.operators import vectors as V
from textlake.plans import jobs
from textlake.session import scratch_path


@query(f"""
WITH {_MOVIES},
fits AS (SELECT *, row_number() OVER (ORDER BY IMDb_rating * log10(ratingCount) DESC, imdb_title_id) AS place FROM movies WHERE IMDb_rating >= 5 AND ratingCount >= 10000),
one AS (SELECT imdb_title_id, row_number() OVER (ORDER BY imdb_title_id) AS id FROM fits WHERE place <= 100),
two AS (SELECT imdb_title_id FROM fits WHERE place <= 250),
new AS (SELECT imdb_title_id, (SELECT count(*) FROM one) + row_number() OVER (ORDER BY imdb_title_id) AS id FROM two WHERE imdb_title_id NOT IN (SELECT imdb_title_id FROM one))
SELECT imdb_title_id AS what, id, 2024 AS created, CASE WHEN imdb_title_id IN (SELECT imdb_title_id FROM two) THEN 2025 ELSE 2024 END AS updated FROM one
UNION ALL SELECT imdb_title_id, id, 2025, 2025 FROM new
UNION ALL SELECT 'log', 2024, (SELECT count(*) FROM one), 0 WHERE EXISTS (FROM fits)
UNION ALL SELECT 'log', 2025, (SELECT count(*) FROM new), (SELECT count(*) FROM one WHERE imdb_title_id IN (SELECT imdb_title_id FROM two)) WHERE EXISTS (FROM fits)
""")
def export_log(spark, sf):
    """Two exports, the second of more rows: ids, times of making and change, and the log of both runs.

    An export that no movie qualifies for writes nothing: the table stays as it is and the log has no row.
    """
    base = scratch_path(spark, "export")
    rows, target = movies(spark, sf), spark.createDataFrame([], schemas.EXPORT)
    log = spark.createDataFrame([], schemas.IMPORT_LOG)
    for year, limit in ((2024, 100), (2025, 250)):
        if jobs.export_ranked(rows, target, f"{year}-01-01", f"{base}/{year}", f"{base}/log", limit, 5.0, 10_000) is not None:
            target, log = spark.read.parquet(f"{base}/{year}"), spark.read.parquet(f"{base}/log")
    table_ = target.select(F.col("imdb_title_id").alias("what"), "id", F.year("created_at").alias("created"), F.year("updated_at").alias("updated"))
    log = log.select(
        F.lit("log").alias("what"), F.year("started_at").cast("long").alias("id"), F.col("rows_inserted").alias("created"), F.col("rows_updated").alias("updated")
    )
    return table_.unionByName(log)


@query(f"""
WITH d AS (SELECT doc_id, {_letters("text")} AS v, {_letters("lang || source")} AS w FROM documents)
SELECT doc_id::VARCHAR AS title_id, CASE WHEN doc_id % 3 = 0 THEN array_to_string(list_transform(w, lambda x: x::BIGINT::VARCHAR), ' ')
  ELSE array_to_string(list_transform(v, lambda x: x::BIGINT::VARCHAR), ' ') END AS numbers FROM d
""")
def vectors_upsert(spark, sf):
    """A vector table and an upsert of it: every third row changes (the later of two changes counts), every third is new."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("title_id"), "text", F.concat("lang", "source").alias("other"), "doc_id")
    shape = lambda rows, text, at: V.embed_column(rows.select("title_id", F.col(text).alias("plot"), F.lit(at).alias("at")), "plot", count_letters)
    first = docs.where("doc_id % 3 <> 1")
    old = V.build_vectors(shape(first, "text", 0), len(_LETTERS), scratch_path(spark, "vectors"))
    third = docs.where("doc_id % 3 = 0")
    new = docs.where("doc_id % 3 = 1")
    changes = shape(third, "text", 1).unionByName(shape(third, "other", 2)).unionByName(shape(new, "text", 1))
    merged = V.build_vectors(changes, len(_LETTERS), scratch_path(spark, "vectors"), old, key="title_id", order_by="at")
    return merged.select("title_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), " ").alias("numbers"))


@query("""
WITH t AS (SELECT p_partkey::VARCHAR AS id, p_name AS summary, p_brand AS plot FROM part WHERE p_size <= 25),
r AS (SELECT p_partkey::VARCHAR AS id, 'told ' || p_type AS text FROM part WHERE p_size >= 20 AND p_type <> 'SMALL')
SELECT coalesce(r.id, t.id) AS what, coalesce(text, summary) AS summary, coalesce(text, plot) AS plot FROM t FULL JOIN r ON t.id = r.id
UNION ALL SELECT 'counts', (SELECT count(*) FROM r WHERE id NOT IN (SELECT id FROM t))::VARCHAR, (SELECT count(*) FROM r WHERE id IN (SELECT id FROM t))::VARCHAR
UNION ALL SELECT 'status', (SELECT count(*) FROM r)::VARCHAR, (SELECT count(*) FROM part WHERE p_size >= 20 AND p_type = 'SMALL')::VARCHAR
""")
def enrichment_merge(spark, sf):
    """Fetched plots merged into the plots table, with the counts of the merge and of the replies."""
    part = table(spark, sf, "part").withColumn("id", F.col("p_partkey").cast("string"))
    plots = part.where("p_size <= 25").select(F.col("id").alias("imdb_title_id"), F.col("p_name").alias("summary"), F.col("p_brand").alias("plot"))
    told = F.to_json(F.struct(F.lit("True").alias("Response"), F.concat(F.lit("told "), "p_type").alias("Plot")))
    replies = part.where("p_size >= 20").select("id", F.when(F.col("p_type") != "SMALL", told).otherwise('{"Response":"False"}').alias("body"))
    merged, counts, status = jobs.merge_enrichment(plots, replies, "id", "body")
    note = lambda df, name, a, b: df.select(F.lit(name).alias("what"), F.col(a).cast("string").alias("summary"), F.col(b).cast("string").alias("plot"))
    return (
        merged.select(F.col("imdb_title_id").alias("what"), "summary", "plot")
        .unionByName(note(counts, "counts", "inserted", "matched"))
        .unionByName(note(status, "status", "fetched", "skipped"))
    )


_LINE = "'plot: ' || p_name || chr(10) || 'note: ' || repeat('y', 30)"


@query(f"""
WITH c AS (SELECT p_partkey, 0 AS chunk_no, 'plot: ' || p_name AS chunk FROM part UNION ALL SELECT p_partkey, 1, 'note:' FROM part
           UNION ALL SELECT p_partkey, 2, repeat('y', 29) FROM part UNION ALL SELECT p_partkey, 3, 'y' FROM part)
SELECT p_partkey::VARCHAR || '-' || chunk_no AS chunk_id, array_to_string(list_transform({_letters("chunk")}, lambda x: x::BIGINT::VARCHAR), ' ') AS numbers FROM c
UNION ALL SELECT 'tokens', sum(len(regexp_extract_all({_LINE}, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]')))::BIGINT::VARCHAR FROM part
""")
def document_vectors(spark, sf):
    """Rows to pages of text, their token price, chunks and vectors."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("plot"), F.expr("repeat('y', 30)").alias("note"))
    vectors, cost = jobs.embed_documents(part, "p_partkey", ["plot", "note"], scratch_path(spark, "chunks"), len(_LETTERS), count_letters, size=30)
    rows = vectors.select("chunk_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), " ").alias("numbers"))
    return rows.unionByName(cost.select(F.lit("tokens").alias("chunk_id"), F.col("tokens").cast("string").alias("numbers")))


@query(f"""
SELECT 'p' || p_partkey AS title, 'lead of ' || p_name AS summary, CASE WHEN p_size % 2 = 0 THEN 'told ' || p_type ELSE '{NO_PLOT}' END AS plot,
       CASE WHEN p_size % 3 = 0 THEN '* see ' || p_brand ELSE '{NO_LINKS}' END AS external_links
FROM part WHERE p_size <= 40
UNION ALL SELECT 'p' || p_partkey, 'kept', 'kept', 'kept' FROM part WHERE p_size > 45
""")
def wiki_plots(spark, sf):
    """Pages of two categories, their wikitext cut into sections, and the plots table merged with them."""
    part = table(spark, sf, "part").withColumn("page", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    size = F.col("p_size")
    edges = part.where("p_size <= 40").select(F.when(size <= 20, "old films").otherwise("new films").alias("parent"), F.col("page").alias("child"), F.lit("page").alias("kind"))
    roots = spark.createDataFrame([("old films",), ("new films",)], "root string")
    text = F.concat(
        F.lit("lead of "), "p_name",
        F.when(size % 2 == 0, F.concat(F.lit("\n== Plot ==\ntold "), "p_type")).otherwise(""),
        F.when(size % 3 == 0, F.concat(F.lit("\n== External links ==\n* see "), "p_brand")).otherwise(""),
    )
    docs = part.where("p_size <= 45").select(F.col("page").alias("title"), text.alias("text"))
    stored = part.where("p_size > 45 OR p_size = 10").select(F.col("page").alias("title"), *[F.lit("kept").alias(c) for c in ("summary", "plot", "external_links")])
    merged, _ = jobs.load_wiki_plots(stored, edges, roots, docs)
    return merged
