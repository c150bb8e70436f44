import functools

from pyspark.sql import functions as F

from suite.registry import query, table
from textlake import schemas
from textlake.functions.predicates import not_sentinel
from textlake.operators.aggregates import catalog_counts
from textlake.session import scratch_path
from textlake.sinks import export_catalog, export_csv, import_csv, new_version
from textlake.sources.files import load_catalog, parse_enrichment, scan_csv, scan_mapped, scan_tsv


@query("""
SELECT p_partkey, '"' || p_name AS p_name, nullif(p_brand, 'Brand#1') AS p_brand, p_size, p_retailprice FROM part
""")
def tsv_roundtrip(spark, sf):
    path = scratch_path(spark, "tsv")
    part = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string"),
        F.concat(F.lit('"'), "p_name").alias("p_name"),
        F.nullif("p_brand", F.lit("Brand#1")).alias("p_brand"),
        F.col("p_size").cast("string"),
        F.col("p_retailprice").cast("string"),
    )
    writer = part.write.option("sep", "\t").option("header", True).option("nullValue", r"\N").option("quote", "")
    writer.option("escapeQuotes", False).option("compression", "gzip").csv(path)
    return scan_tsv(spark, path, part.schema).select(
        F.col("p_partkey").cast("bigint"), "p_name", "p_brand", F.col("p_size").cast("int"), F.col("p_retailprice").cast("double")
    )


def _part_csv(spark, sf):
    path = scratch_path(spark, "csv")
    part = table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("label"), F.split("p_name", " ").alias("words"), "p_retailprice"
    )
    export_csv(part, path)
    return path, part.schema


@query("""
SELECT p_partkey, p_name || ', "' || p_type || '"' AS label, replace(p_name, ' ', '|') AS words,
       len(string_split(p_name, ' ')) AS n_words, p_retailprice
FROM part
""")
def csv_roundtrip(spark, sf):
    path, schema = _part_csv(spark, sf)
    return import_csv(spark, path, schema).select(
        "p_partkey", "label", F.array_join("words", "|").alias("words"), F.size("words").cast("bigint").alias("n_words"), "p_retailprice"
    )


@query("""
SELECT p_partkey, p_name || ', "' || p_type || '"' AS label,
       '["' || replace(p_name, ' ', '","') || '"]' AS words, p_retailprice
FROM part
""")
def csv_inferred(spark, sf):
    path, _ = _part_csv(spark, sf)
    return scan_csv(spark, path).select(F.col("p_partkey").cast("bigint"), "label", "words", "p_retailprice")


#: per table: its columns as text that both engines write alike (money in cents, times in microseconds)
_CELLS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "cents c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "cents s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "cents p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "cents o_totalprice", "time o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cents l_quantity", "cents l_extendedprice", "cents l_discount", "cents l_tax",
        "l_returnflag", "l_linestatus", "time l_shipdate",
    ],
    "events": ["event_id", "time ts", "user_id", "event_type", "cents value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "list embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
_DUCK = {
    "cents": "CAST(CAST(round({} * 100) AS BIGINT) AS VARCHAR)",
    "time": "CAST(epoch_us({}) AS VARCHAR)",
    "list": "array_to_string(list_transform({}, lambda x: CAST(CAST(round(x::DOUBLE * 1000000) AS BIGINT) AS VARCHAR)), ' ')",
    "": "CAST({} AS VARCHAR)",
}
_SPARK = {
    "cents": "CAST(CAST(round({} * 100) AS BIGINT) AS STRING)",
    "time": "CAST(unix_micros(CAST({} AS TIMESTAMP)) AS STRING)",
    "list": "array_join(transform({}, x -> CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS STRING)), ' ')",
    "": "CAST({} AS STRING)",
}


def _row_text(cells, forms):
    parts = [forms[kind].format(name) for kind, _, name in (c.rpartition(" ") for c in cells)]
    return "md5(" + " || '|' || ".join(f"coalesce({p}, '-')" for p in parts) + ")"


@query(" UNION ALL ".join(f"SELECT '{name}' AS tbl, {_row_text(cells, _DUCK)} AS row_md5 FROM {name}" for name, cells in _CELLS.items()))
def catalog_export_load(spark, sf):
    """All tables exported and loaded again: every row of every table."""
    folder = scratch_path(spark, "catalog")
    export_catalog(load_catalog(spark, sf, _CELLS), folder)
    loaded = load_catalog(spark, folder, _CELLS)
    rows = [loaded[name].select(F.lit(name).alias("tbl"), F.expr(_row_text(cells, _SPARK)).alias("row_md5")) for name, cells in _CELLS.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), rows)


@query(" UNION ALL ".join(f"SELECT '{name}' AS tbl, count(*) AS n FROM {name}" for name in _CELLS))
def catalog_sizes(spark, sf):
    return catalog_counts(load_catalog(spark, sf, _CELLS)).withColumnRenamed("table", "tbl")


@query("""
SELECT s_nationkey, s_suppkey, s_name FROM supplier
""")
def versioned_rebuild(spark, sf):
    path = new_version(table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name"), "supplier")
    return spark.read.parquet(path)


@query("""
SELECT doc_id AS title_id, source AS title, CAST(NULL AS INTEGER) AS year, lang AS genres,
       CAST(n_chars AS DOUBLE) AS rating, md5(text) AS plot
FROM documents
WHERE text IS NOT NULL AND length(trim(text)) > 20 AND text NOT IN ('No plot available', ' ', '')
""")
def mapped_usable_text(spark, sf):
    docs = table(spark, sf, "documents").where(not_sentinel("text"))
    rows = scan_mapped(docs, "doc_id", "text", title_col="source", genre_col="lang", rating_col="n_chars")
    return rows.withColumns({"genres": F.array_join("genres", "|"), "plot": F.md5("plot")})


@query("""
SELECT event_id,
       CASE WHEN event_type IN ('click', 'purchase') THEN 'plot ' || props END AS plot,
       CASE WHEN event_type IN ('click', 'purchase') THEN 'plot ' || props END AS summary,
       CASE WHEN event_type IN ('click', 'purchase') THEN 'fetched' ELSE 'skipped' END AS status
FROM events
""")
def enrichment_parse(spark, sf):
    text = F.concat(F.lit("plot "), "props")
    body = (
        F.when(F.col("event_type") == "error", F.lit("<html>busy</html>"))
        .when(F.col("event_type") == "signup", F.lit('{"Response":"False","Error":"not found"}'))
        .when(F.col("event_type") == "view", F.lit('{"Response":"True","Plot":""}'))
        .otherwise(F.to_json(F.struct(F.lit("True").alias("Response"), text.alias("Plot"))))
    )
    return parse_enrichment(table(spark, sf, "events").select("event_id", body.alias("body")), "event_id", "body")


# ---- metadata files standing in for the published title files ----------------------------------

def title_files(spark, sf):
    """part, supplier and orders in the shape of the four metadata files."""
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    size = F.col("p_size")
    basics = part.select(
        F.col("p_partkey").cast("string").alias("tconst"),
        F.when(F.col("p_type") == "SMALL", "short").otherwise("movie").alias("titleType"),
        F.col("p_name").alias("primaryTitle"),
        F.col("p_name").alias("originalTitle"),
        F.when(F.col("p_brand") == "Brand#2", "1").otherwise("0").alias("isAdult"),
        F.when(F.col("p_brand") != "Brand#3", (size + 1950).cast("string")).alias("startYear"),
        F.lit(None).cast("string").alias("endYear"),
        size.cast("string").alias("runtimeMinutes"),
        F.replace("p_name", F.lit(" "), F.lit(",")).alias("genres"),
    )
    ratings = part.select(
        F.col("p_partkey").cast("string").alias("tconst"),
        ((F.col("p_retailprice") - 900) / 10).cast("float").alias("averageRating"),
        (size * size * 2).cast("int").alias("numVotes"),
    )
    crew = part.where(F.col("p_type") != "ECONOMY").select(
        F.col("p_partkey").cast("string").alias("tconst"),
        F.concat_ws(",", size * 3, size, size * 7).alias("directors"),
        F.lit(None).cast("string").alias("writers"),
    )
    names = supplier.select(
        F.col("s_suppkey").cast("string").alias("nconst"),
        F.col("s_name").alias("primaryName"),
        *[F.lit(None).cast("string").alias(c) for c in ("birthYear", "deathYear", "primaryProfession", "knownForTitles")],
    )
    for df, schema in ((basics, schemas.TITLE_BASICS), (ratings, schemas.TITLE_RATINGS), (crew, schemas.TITLE_CREW), (names, schemas.NAME_BASICS)):
        assert df.columns == schema.names
    return basics, ratings, crew, names


TITLE_ROWS = """
rows AS (
  SELECT CAST(p_partkey AS VARCHAR) AS imdb_title_id, p_name AS title, p_size + 1950 AS year,
         replace(p_name, ' ', ',') AS genre, CAST(p_size AS VARCHAR) AS runtime,
         CAST(CAST((p_retailprice - 900) / 10 AS FLOAT) AS DECIMAL(18,3)) AS IMDb_rating,
         p_size * p_size * 2 AS ratingCount,
         CASE WHEN p_type <> 'ECONOMY' THEN
           (SELECT string_agg(s.s_name, ',' ORDER BY d.pos)
            FROM (SELECT unnest([p_size * 3, p_size, p_size * 7]) AS sid, unnest([1, 2, 3]) AS pos) d
            JOIN supplier s ON s.s_suppkey = d.sid) END AS directors
  FROM part
  WHERE p_type <> 'SMALL' AND p_brand <> 'Brand#2' AND p_brand <> 'Brand#3'
    AND p_size + 1950 BETWEEN 1960 AND 1995 AND p_size * p_size * 2 >= 100
)
"""
