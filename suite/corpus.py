from pyspark.sql import functions as F

from suite.columns import cleaned_sql
from suite.files import TITLE_ROWS, title_files
from suite.registry import query, table
from textlake import schemas
from textlake.functions.scalars import pad_key
from textlake.plans import jobs


def movies(spark, sf):
    """part in the shape of the movies table."""
    values = {
        "imdb_title_id": pad_key("p_partkey"),
        "title": F.initcap("p_name"),
        "year": F.col("p_size") + 1950,
        "genre": F.when(F.col("p_type") != "SMALL", F.replace("p_name", F.lit(" "), F.lit(","))),
        "runtime": F.concat(F.col("p_size").cast("string"), F.lit(" min")),
        "IMDb_rating": (F.col("p_retailprice") - 900) / 10,
        "ratingCount": F.col("p_size") * F.col("p_size") * 100,
        "directors": F.col("p_brand"),
    }
    return table(spark, sf, "part").select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.MOVIES]
    )


_MOVIES = """
movies AS (
  SELECT 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS imdb_title_id,
         array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
         p_size + 1950 AS year, CASE WHEN p_type <> 'SMALL' THEN replace(p_name, ' ', ',') END AS genre,
         p_size || ' min' AS runtime, CAST((p_retailprice - 900) / 10 AS DECIMAL(18,3)) AS IMDb_rating,
         p_size * p_size * 100 AS ratingCount, p_brand AS directors
  FROM part)
"""


@query(f"""
WITH {TITLE_ROWS},
target AS (SELECT CAST(p_partkey AS VARCHAR) AS imdb_title_id, p_name AS title, 1900 AS year, 'old' AS genre, 'old' AS runtime,
                  CAST(1 AS DECIMAL(18,3)) AS IMDb_rating, 1 AS ratingCount, 'old' AS directors
           FROM part WHERE p_size <= 30)
SELECT coalesce(t.imdb_title_id, r.imdb_title_id) AS imdb_title_id, coalesce(t.title, r.title) AS title,
       coalesce(t.year, r.year) AS year, coalesce(t.genre, r.genre) AS genre, coalesce(t.runtime, r.runtime) AS runtime,
       CAST(CASE WHEN r.imdb_title_id IS NULL THEN t.IMDb_rating ELSE r.IMDb_rating END AS DOUBLE) AS rating,
       CASE WHEN r.imdb_title_id IS NULL THEN t.ratingCount ELSE r.ratingCount END AS ratingCount,
       CASE WHEN r.imdb_title_id IS NULL THEN t.directors ELSE r.directors END AS directors
FROM target t FULL JOIN rows r ON t.imdb_title_id = r.imdb_title_id
""")
def import_metadata(spark, sf):
    old = {
        "imdb_title_id": F.col("p_partkey"), "title": F.col("p_name"), "year": F.lit(1900), "genre": F.lit("old"),
        "runtime": F.lit("old"), "IMDb_rating": F.lit(1), "ratingCount": F.lit(1), "directors": F.lit("old"),
    }
    target = table(spark, sf, "part").where("p_size <= 30").select(
        *[old.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.MOVIES]
    )
    merged, _ = jobs.import_metadata(target, *title_files(spark, sf), 1960, 1995)
    return merged.select(
        "imdb_title_id", "title", "year", "genre", "runtime", F.col("IMDb_rating").cast("double").alias("rating"), "ratingCount", "directors"
    )


def _sources(spark, sf):
    """English and German documents as source a, all others and the pages as source b."""
    docs = table(spark, sf, "documents")
    num = F.col("doc_id").cast("string")
    plots_a = docs.where("lang in ('en', 'de')").select(
        pad_key(num).alias("imdb_title_id"), num.alias("num"), F.when(F.col("lang") == "en", F.col("source")).alias("summary"), F.col("text").alias("plot")
    )
    by_id = docs.where("lang in ('fr', 'es')").select(
        F.concat(F.lit("Doc (2001 film) "), num).alias("title"),
        F.concat(F.lit("'''"), "source", F.lit("''' {{a}}")).alias("summary"),
        F.concat(F.lit("[["), "lang", F.lit("|x]] "), "text").alias("plot"),
        F.concat(F.lit("{{IMDb title|id="), num, F.lit("}}")).alias("external_links"),
    )
    # pages match on title and year; several share a title once it is cleaned
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    pages = table(spark, sf, "pages").join(part, F.col("page_id") == F.col("p_partkey"))
    by_title = pages.select(
        F.concat(F.initcap("p_name"), F.lit(" (2001 p"), "page_id", F.lit(") (film)")).alias("title"), F.col("url").alias("summary"), F.col("html").alias("plot"),
        F.concat(F.lit("[[Category:"), (F.col("p_size") + 1950).cast("string"), F.lit(" films]]")).alias("external_links"),
    )
    return plots_a, by_id.unionByName(by_title)


_SOURCES = r"""
docs_a AS (SELECT 'tt' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS imdb_title_id, CASE WHEN lang = 'en' THEN source END AS summary, text AS plot
           FROM documents WHERE lang IN ('en', 'de')),
raw_b AS (
  SELECT 'Doc  ' || doc_id AS title, CAST(doc_id AS VARCHAR) AS num, CAST(NULL AS INTEGER) AS year,
         '''''''' || source || ''''''' {{a}}' AS summary, '[[' || lang || '|x]] ' || text AS plot
  FROM documents WHERE lang IN ('fr', 'es')
  UNION ALL
  SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, NULL, p_size + 1950, url, html
  FROM pages JOIN part ON page_id = p_partkey)
"""


def _b(summary, plot):
    return f"clean_b AS (SELECT title, num, year, {cleaned_sql('summary', summary)} AS summary, {cleaned_sql('plot', plot)} AS plot FROM raw_b)"


_OUT = """
SELECT m.imdb_title_id AS source, lower(m.title) AS title, m.year AS year,
       coalesce(replace(lower(m.genre), ',', '|'), 'NA') AS genre,
       CAST(trim(replace(m.runtime, 'min', '')) AS INTEGER) AS runtime, m.ratingCount AS ratingCount, md5(p.plot) AS plot,
       md5(p.summary) AS summary, round(CAST(CAST(m.IMDb_rating AS FLOAT) AS DOUBLE), 4) AS imdb_rating,
       lower(m.directors) AS directors, 'NA' AS stars
"""


def _show(corpus):
    return corpus.withColumns(
        {
            **{c: F.array_join(c, "|") for c in ("genre", "directors", "stars")},
            **{c: F.md5(c) for c in ("plot", "summary")},
            "imdb_rating": F.round(F.col("imdb_rating").cast("double"), 4),
        }
    )


@query(f"""
WITH {_MOVIES}, {_SOURCES}, {_b('standard', 'standard')},
a AS ({_OUT} FROM movies m JOIN docs_a p ON p.imdb_title_id = m.imdb_title_id
      WHERE p.plot IS NOT NULL AND length(trim(p.plot)) > 20 AND m.ratingCount > 1000),
b AS ({_OUT} FROM movies m JOIN clean_b p ON ('tt' || lpad(p.num, 7, '0') = m.imdb_title_id) OR (lower(p.title) = lower(m.title) AND p.year = m.year)
      WHERE m.ratingCount > 1000 AND p.plot IS NOT NULL AND length(trim(p.plot)) > 20 AND m.imdb_title_id NOT IN (SELECT source FROM a))
SELECT * FROM a UNION ALL SELECT * FROM b
""")
def build_corpus(spark, sf):
    plots_a, plots_b = _sources(spark, sf)
    return _show(jobs.build_corpus(movies(spark, sf), plots_a.drop("num"), plots_b, stage=True))


@query(f"""
WITH {_MOVIES}, {_SOURCES}, {_b('dbt_summary', 'dbt_plot')},
b AS ({_OUT} FROM movies m JOIN clean_b p ON ('tt' || lpad(p.num, 7, '0') = m.imdb_title_id) OR (p.title = m.title AND p.year = m.year)
      WHERE m.ratingCount > 1000),
a AS ({_OUT} FROM movies m JOIN docs_a p ON p.imdb_title_id = m.imdb_title_id
      WHERE p.summary IS NOT NULL AND m.ratingCount > 1000 AND m.imdb_title_id NOT IN (SELECT source FROM b))
SELECT * FROM b UNION ALL SELECT * FROM a
""")
def build_corpus_dbt(spark, sf):
    plots_a, plots_b = _sources(spark, sf)
    plots_a = plots_a.select(F.col("num").alias("imdb_title_id"), "summary", "plot")
    return _show(jobs.build_corpus(movies(spark, sf), plots_a, plots_b, variant="dbt"))


@query(f"""
WITH {_MOVIES}
SELECT imdb_title_id, title, year, genre, CAST(replace(runtime, ' min', '') AS INTEGER) AS runtime_min,
       round(CAST(CAST(IMDb_rating AS FLOAT) AS DOUBLE), 4) AS imdb_rating, ratingCount AS rating_count, directors,
       'https://www.imdb.com/title/' || imdb_title_id || '/' AS imdb_url
FROM movies WHERE IMDb_rating >= 5 AND ratingCount >= 10000
ORDER BY IMDb_rating * log10(ratingCount) DESC, imdb_title_id LIMIT 300
""")
def ranked_export(spark, sf):
    rows = jobs.ranked_rows(movies(spark, sf), 300, 5.0, 10_000)
    return rows.withColumn("imdb_rating", F.round(F.col("imdb_rating").cast("double"), 4))
