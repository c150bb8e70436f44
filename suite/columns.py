from pyspark.sql import functions as F

from suite.registry import query, table
from textlake.functions import predicates as P, scalars as S


@query("""
SELECT o_orderkey, year, votes FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'short' ELSE 'movie' END AS type,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE year(o_orderdate) END AS year,
         CASE WHEN o_orderpriority = '5-LOW' THEN '1' ELSE '0' END AS adult,
         CAST(floor(o_totalprice / 1000) AS BIGINT) AS votes
  FROM orders)
WHERE type = 'movie' AND year IS NOT NULL AND adult = '0' AND year BETWEEN 1996 AND 1999 AND votes >= 100
""")
def feature_filter(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "short").otherwise("movie").alias("type"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.year("o_orderdate").cast("string")).alias("start"),
        F.when(F.col("o_orderpriority") == "5-LOW", "1").otherwise("0").alias("adult"),
        F.floor(F.col("o_totalprice") / 1000).alias("votes"),
    )
    rows = orders.where(P.feature_filter("type", "start", "adult", "votes", 1996, 1999))
    return rows.select("o_orderkey", F.col("start").cast("bigint").alias("year"), "votes")


@query("""
SELECT p_partkey, p_name FROM part
WHERE p_size >= 10 AND p_size <= 40 AND p_retailprice >= 905
  AND list_has_any(list_transform(string_split(p_name, ' '), lambda g: lower(g)), ['red', 'gear'])
""")
def optional_filter(spark, sf):
    part = table(spark, sf, "part").withColumn("genres", F.split("p_name", " "))
    bounds = P.Bounds(year_from=10, year_to=40, genres=("Red", "GEAR"), min_rating=905.0)
    return P.where_bounds(part, bounds, year_col="p_size", rating_col="p_retailprice").select("p_partkey", "p_name")


@query("""
SELECT p_partkey,
       CASE WHEN p_type = 'ECONOMY' THEN 'NA' ELSE replace(upper(p_name), ' ', '|') END AS stars,
       CASE WHEN p_type = 'ECONOMY' THEN 'NA' ELSE replace(lower(p_name), ' ', '|') END AS lowered,
       coalesce(nullif(p_brand, 'Brand#1'), 'NA') AS certificate,
       CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS score
FROM part
""")
def display_defaults(spark, sf):
    names = F.when(F.col("p_type") != "ECONOMY", F.upper(F.replace("p_name", F.lit(" "), F.lit(","))))
    part = table(spark, sf, "part").select(
        "p_partkey",
        names.alias("stars"),
        S.split_lower(names).alias("lowered"),
        F.nullif("p_brand", F.lit("Brand#1")).alias("certificate"),
        F.when(F.col("p_size") > 25, F.col("p_size")).alias("score"),
    )
    shown = P.display_defaults(part, lists=["stars"], texts=["certificate"], zeros=["score"])
    return shown.withColumns({c: F.array_join(c, "|") for c in ("stars", "lowered")})


# ---- fixed values: patterns and replacements of the cleaning profiles, ids and years, as DuckDB writes them ----
_STEPS = {
    "comment": ("<!--.*?-->", ""),
    "link": (r"\[\[(.+?)\]\]", r"\1"),
    "ref pair": ("<ref>.*?</ref>", ""),
    "ref": ("<ref .*?/>", ""),
    "tag": ("<[^>]*>", ""),
    "brace": (r"\{.*?\}", ""),
    "double brace": (r"\{\{.*?\}\}", ""),
    "pipe to space": (r"\|", " "),
    "pipe to comma": (r"\|", ","),
    "space": (r"\s+", " "),
    "quotes": ("''", "'"),
}
_PROFILES = {
    "standard": ["comment", "link", "ref pair", "ref", "tag", "brace", "pipe to space", "space"],
    "dbt_plot": ["comment", "link", "ref pair", "ref", "tag", "double brace", "pipe to space", "space", "quotes"],
    "dbt_summary": ["comment", "link", "ref pair", "ref", "tag", "pipe to comma", "quotes", "quotes", "quotes"],
}
_TEMPLATE, _TEMPLATE_TWO = r"\{\{[Ii][Mm][Dd][Bb] title(.*)\}\}", r"\{\{[Ii][Mm][Dd][Bb] title(.*)(\|.*)?\}\}"
_TITLE_URL = r"https://www\.imdb\.com/title/tt(\d+)"
_YEAR, _YEAR_CLOSED, _YEAR_BARE = r"\[\[Category:(\d{4})", r"\[\[Category:(\d{4}).*\]\]", r"Category:(\d{4})"
_YEAR_SUFFIX, _FILM_SUFFIX = r"\(\d{4}\s\w+\)", r"\(film\)"
_NO_LINKS = "No external links available"
# ---------------------------------------------------------------------------------------------------------------


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _replaced(sql, steps):
    """SQL that applies (pattern, replacement) pairs in order, to every match."""
    for pattern, new in steps:
        sql = f"regexp_replace({sql}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    return sql


def cleaned_sql(c, profile):
    return _replaced(c, [_STEPS[step] for step in _PROFILES[profile]])


def _found(sql, pattern, group=1):
    return f"regexp_extract({sql}, {_quoted(pattern)}, {group})"


_MARKED = r"""('[[' || source || '|x]] <ref name="a" />''''q'''' {{t|{{u}}}} ' || text || '<ref>r</ref><!-- c -->' || chr(10) || lang)"""


def _marked():
    return F.concat(
        F.lit("[["), "source", F.lit("|x]] <ref name=\"a\" />''q'' {{t|{{u}}}} "), "text",
        F.lit("<ref>r</ref><!-- c -->\n"), "lang",
    )


def _clean_sql(profile):
    docs, pages = cleaned_sql(_MARKED, profile), cleaned_sql("html", profile)
    return (
        f"SELECT 'documents' AS src, doc_id AS id, md5({docs}) AS cleaned FROM documents "
        f"UNION ALL SELECT 'pages', page_id, md5({pages}) FROM pages"
    )


def _clean(spark, sf, profile):
    docs = table(spark, sf, "documents").select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.md5(S.clean_markup(_marked(), profile)).alias("cleaned")
    )
    pages = table(spark, sf, "pages").select(
        F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.md5(S.clean_markup("html", profile)).alias("cleaned")
    )
    return docs.unionByName(pages)


@query(_clean_sql("standard"))
def clean_markup_standard(spark, sf):
    return _clean(spark, sf, "standard")


@query(_clean_sql("dbt_plot"))
def clean_markup_dbt_plot(spark, sf):
    return _clean(spark, sf, "dbt_plot")


@query(_clean_sql("dbt_summary"))
def clean_markup_dbt_summary(spark, sf):
    return _clean(spark, sf, "dbt_summary")


@query(f"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(t, '{_YEAR_SUFFIX}', ''), '{_FILM_SUFFIX}', '')) AS cleaned
FROM (SELECT p_partkey, p_name || CASE p_type
        WHEN 'ECONOMY' THEN ' (' || (1950 + p_size) || ' film)'
        WHEN 'SMALL' THEN ' (film) (film)'
        WHEN 'LARGE' THEN ' (2010 American film)'
        ELSE ' (2010 film) (2011 film)' END AS t FROM part)
""")
def clean_title(spark, sf):
    kind = F.col("p_type")
    title = F.concat(
        "p_name",
        F.when(kind == "ECONOMY", F.concat(F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(" film)")))
        .when(kind == "SMALL", " (film) (film)")
        .when(kind == "LARGE", " (2010 American film)")
        .otherwise(" (2010 film) (2011 film)"),
    )
    return table(spark, sf, "part").select("p_partkey", S.clean_title(title).alias("cleaned"))


_LINKS = r"""(CASE p_type
  WHEN 'ECONOMY' THEN '* {{imdb title|id=' || p_partkey || '|title=' || p_name || '}} {{x}}'
  WHEN 'SMALL' THEN '{{IMDb name|1}} https://www.imdb.com/title/tt' || p_partkey || '/ [[Category:' || (1950 + p_size) || ' films]]'
  WHEN 'LARGE' THEN 'No external links available'
  ELSE '{{Mojo}} [[Category:' || (1950 + p_size) || ' films' END)"""


def _links():
    kind, key = F.col("p_type"), F.col("p_partkey").cast("string")
    year = (F.col("p_size") + 1950).cast("string")
    return (
        F.when(kind == "ECONOMY", F.concat(F.lit("* {{imdb title|id="), key, F.lit("|title="), "p_name", F.lit("}} {{x}}")))
        .when(
            kind == "SMALL",
            F.concat(F.lit("{{IMDb name|1}} https://www.imdb.com/title/tt"), key, F.lit("/ [[Category:"), year, F.lit(" films]]")),
        )
        .when(kind == "LARGE", S.NO_LINKS)
        .otherwise(F.concat(F.lit("{{Mojo}} [[Category:"), year, F.lit(" films")))
    )


@query(f"""
WITH l AS (SELECT p_partkey, {_LINKS} AS c FROM part),
x AS (SELECT p_partkey, c, nullif({_found(_found('c', _TEMPLATE), '[0-9]+', 0)}, '') AS one,
             nullif({_found(_found('c', _TEMPLATE_TWO), '[0-9]+', 0)}, '') AS two, nullif({_found('c', _TITLE_URL)}, '') AS url FROM l)
SELECT p_partkey, coalesce(one, url) AS num, coalesce(two, url, CASE WHEN c = '{_NO_LINKS}' THEN '-1' END) AS num_or_sentinel FROM x
""")
def extract_id(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        S.extract_id(_links()).alias("num"),
        S.extract_id(_links(), sentinel=S.NO_LINKS, two_part=True).alias("num_or_sentinel"),
    )


@query(f"""
WITH l AS (SELECT p_partkey, {_LINKS} AS c FROM part)
SELECT p_partkey, TRY_CAST({_found('c', _YEAR)} AS INTEGER) AS year, nullif({_found('c', _YEAR_CLOSED)}, '') AS year_text,
       TRY_CAST({_found("replace(c, '[[', '')", _YEAR_BARE)} AS INTEGER) AS year_lenient
FROM l
""")
def extract_year(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        S.extract_year(_links()).alias("year"),
        S.extract_year(_links(), as_text=True).alias("year_text"),
        S.extract_year(F.replace(_links(), F.lit("[["), F.lit("")), lenient=True).alias("year_lenient"),
    )


@query(r"""
SELECT p_partkey,
       array_to_string(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x, chr(9) || chr(10) || ' ')), lambda x: x <> ''), '|') AS items,
       TRY_CAST(trim(replace(runtime, 'min', '')) AS INTEGER) AS runtime,
       'https://example.org/title/' || p_partkey || '/' AS url,
       trim(regexp_replace(spaced, '\s+', ' ', 'g')) AS squeezed,
       'tt' || lpad(CAST(p_partkey * 100003 AS VARCHAR), 7, '0') AS padded,
       'tt' || CASE WHEN length(CAST(p_partkey * 100003 AS VARCHAR)) > 7 THEN CAST(p_partkey * 100003 AS VARCHAR)
                    ELSE lpad(CAST(p_partkey * 100003 AS VARCHAR), 7, '0') END AS padded_whole,
       substr('tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0'), 3) AS stripped
FROM (SELECT p_partkey, chr(9) || replace(p_name, ' ', ' , ') || ',,' || chr(10) AS raw,
             CASE p_type WHEN 'ECONOMY' THEN p_size || ' min' WHEN 'SMALL' THEN p_size || '.5' WHEN 'LARGE' THEN '' ELSE p_brand END AS runtime,
             chr(10) || p_name || chr(9) || '  ' || p_brand AS spaced FROM part)
""")
def list_normalize(spark, sf):
    kind, size, key = F.col("p_type"), F.col("p_size").cast("string"), F.col("p_partkey")
    raw = F.concat(F.lit("\t"), F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(",,\n"))
    runtime = (
        F.when(kind == "ECONOMY", F.concat(size, F.lit(" min")))
        .when(kind == "SMALL", F.concat(size, F.lit(".5")))
        .when(kind == "LARGE", "")
        .otherwise(F.col("p_brand"))
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(S.normalize_list(raw), "|").alias("items"),
        S.runtime_minutes(runtime).alias("runtime"),
        S.build_url("p_partkey", "https://example.org/title/").alias("url"),
        S.squeeze(F.concat(F.lit("\n"), "p_name", F.lit("\t  "), "p_brand")).alias("squeezed"),
        S.pad_key(key * 100003).alias("padded"),
        S.pad_key(key * 100003, truncate=False).alias("padded_whole"),
        S.strip_prefix(S.pad_key(key)).alias("stripped"),
    )
