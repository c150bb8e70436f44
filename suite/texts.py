from pyspark.sql import functions as F

from suite.registry import query, table
from textlake import schemas
from textlake.operators import aggregates as A, chunking as C, extract as X, html as H
from textlake.plans import jobs
from textlake.functions.scalars import NO_LINKS, NO_PLOT, NO_SUMMARY


@query(f"""
SELECT conv_id,
       md5(coalesce(nullif(arg_max(text, turn) FILTER (WHERE role = 'system'), ''), '{NO_SUMMARY}')) AS summary,
       md5(coalesce(nullif(arg_max(text, turn) FILTER (WHERE role = 'user'), ''), '{NO_PLOT}')) AS plot,
       md5(coalesce(nullif(arg_max(text, turn) FILTER (WHERE role = 'assistant'), ''), '{NO_LINKS}')) AS external_links
FROM conversations GROUP BY conv_id
""")
def section_pivot(spark, sf):
    turns = table(spark, sf, "conversations")
    columns = {
        "summary": ("system", NO_SUMMARY), "plot": ("user", NO_PLOT), "external_links": ("assistant", NO_LINKS),
    }
    wide = X.pivot_sections(turns, "conv_id", "role", "text", "turn", columns)
    return wide.select("conv_id", *[F.md5(c).alias(c) for c in columns])


_SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS title, 0 AS pos, CAST(doc_id AS VARCHAR) AS path,
       md5({_SQUEEZED.format("text || ' x y'")}) AS text FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, doc_id || '/== Plot ==', md5({_SQUEEZED.format("source || ' ' || text")}) FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 3, doc_id || '/== Plot ==/=== Plot ===', md5('inner') FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 5, doc_id || '/==External links==', md5('* link ' || doc_id) FROM documents
""")
def wiki_sections(spark, sf):
    page = F.concat(
        "text", F.lit(" [[x]] <ref>r</ref>y\n== Plot ==\n"), "source", F.lit(" "), "text",
        F.lit("\n=== Act ===\ngone\n=== Plot ===\ninner\n== References ==\nr\n==External links==\n* link "), F.col("doc_id").cast("string"),
    )
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("title"), page.alias("page"))
    rows = X.extract_wiki_sections(docs, "title", "page")
    return rows.select("title", "pos", F.array_join("path", "/").alias("path"), F.md5("text").alias("text"))


_TITLE = "replace(regexp_extract(html, '<{0}>([^<]*)</{0}>', 1), '&amp;', '&')"


@query(f"""
SELECT page_id, {_TITLE.format('title')} AS title, {_TITLE.format('h1')} AS h1,
       len(regexp_extract_all(html, '<a href=')) AS n_links, regexp_extract(html, '<a href="([^"]*)"', 1) AS first_link
FROM pages
""")
def html_fields(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return X.page_facts(pages, "html").drop("html")


@query("""
SELECT page_id, unnest(titles) AS title FROM (SELECT page_id, [regexp_extract(html, '<title>([^<]*)</title>', 1)] AS titles FROM pages)
""")
def html_select(spark, sf):
    """The text of an element, entities as they stand in the page."""
    pages = table(spark, sf, "pages").select("page_id", "html", F.when(F.col("html").isNotNull(), "").alias("none"))
    found = H.extract_texts(pages, {"title": ("title",)}, as_written=True)
    return found.select("page_id", F.coalesce("title", "none").alias("title"))


@query("""
SELECT 'tt' || p_partkey AS imdb_title_id, p_name AS title, CAST(1950 + p_size AS VARCHAR) AS year,
       CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_brand END AS certificate, p_type AS genre,
       p_size || ' min' AS runtime, 'about ' || p_name || ' & more' AS description,
       p_retailprice AS IMDb_rating, CAST(p_partkey AS VARCHAR) AS ratingCount,
       CASE WHEN p_size % 3 = 0 THEN 'Ann' WHEN p_size % 3 = 1 THEN 'Ann,Bob' END AS directors,
       'Cy,Di' AS stars
FROM part WHERE p_type <> 'LARGE' AND p_brand <> 'Brand#1'
""")
def listing_pages(spark, sf):
    """One listing block per part, with every credit layout; LARGE lacks votes, Brand#1 a year."""
    return H.extract_listing(_pages(spark, sf)).drop("MetaScore")


@query("""
SELECT coalesce(t.id, r.id) AS imdb_title_id, coalesce(t.title, r.title) AS title, coalesce(r.rating, t.rating) AS rating, coalesce(r.votes, t.votes) AS votes
FROM (SELECT 'tt' || p_partkey AS id, 'old' AS title, 1.0::DOUBLE AS rating, 1 AS votes FROM part WHERE p_size <= 20) t
FULL JOIN (SELECT 'tt' || p_partkey AS id, p_name AS title, p_retailprice AS rating, p_partkey::INTEGER AS votes FROM part WHERE p_type <> 'LARGE' AND p_brand <> 'Brand#1') r
ON t.id = r.id
""")
def listing_load(spark, sf):
    """Listing pages of many blocks, some of them on two pages, merged into the movies table: known titles get new figures only."""
    one = _pages(spark, sf)
    many = one.groupBy(F.col("p_partkey") % 50).agg(F.array_join(F.collect_list("html"), "").alias("html")).select("html")
    old = {"imdb_title_id": F.concat(F.lit("tt"), F.col("p_partkey").cast("string")), "title": F.lit("old"), "IMDb_rating": F.lit(1), "ratingCount": F.lit(1)}
    target = table(spark, sf, "part").where("p_size <= 20").select(*[old.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.MOVIES])
    merged, _ = jobs.load_listing(target, many.unionByName(one.where("p_partkey % 5 = 0").select("html")), tasks=_tasks(spark, table(spark, sf, "part")))
    return merged.select("imdb_title_id", "title", F.col("IMDb_rating").cast("double").alias("rating"), F.col("ratingCount").alias("votes"))


@query("""
SELECT p_partkey, 0 AS block, CASE WHEN p_type = 'LARGE' THEN 'no votes' ELSE 'no year' END AS reason
FROM part WHERE p_type = 'LARGE' OR p_brand = 'Brand#1'
""")
def listing_rejects(spark, sf):
    return H.listing_rejects(_pages(spark, sf))


_PAGES_A_TASK = 20_000


def _tasks(spark, rows):
    return max(spark.sparkContext.defaultParallelism, -(-rows.count() // _PAGES_A_TASK))


def _pages(spark, sf):
    size, text = F.col("p_size"), F.lit
    year = F.when(F.col("p_brand") == "Brand#1", "(I)").otherwise(
        F.concat(text("(I) ("), (size + 1950).cast("string"), text(")"))
    )
    credits = (
        F.when(size % 3 == 0, 'Director:<a>Ann</a><span class="ghost">|</span>Stars:<a>Cy</a>, <a>Di</a>')
        .when(size % 3 == 1, 'Directors:<a>Ann</a>, <a>Bob</a><span class="ghost">|</span>Stars:<a>Cy</a>, <a>Di</a>')
        .otherwise("Stars:<a>Cy</a>, <a>Di</a>")
    )
    block = F.concat(
        text('<div class="lister-item mode-advanced"><h3><a href="/title/tt'), F.col("p_partkey").cast("string"), text('/">'),
        "p_name", text('</a> <span class="lister-item-year text-muted">'), year, text("</span></h3><p class='text-muted'>"),
        F.when(F.col("p_type") == "SMALL", "").otherwise(F.concat(text('<span class="certificate">'), "p_brand", text("</span>"))),
        text('<span class="runtime">'), size.cast("string"), text(' min</span><span class="genre">\n '), "p_type", text(" </span></p><strong>"),
        F.col("p_retailprice").cast("string"), text('</strong><p class="text-muted">about <b>'), "p_name",
        text("</b> &amp; more</p><p class=\"\">"), credits, text("</p>"),
        F.when(F.col("p_type") == "LARGE", "").otherwise(
            F.concat(text('<p class="votes"><span name="nv" data-value="'), F.col("p_partkey").cast("string"), text('">v</span></p>'))
        ),
        text("</div>"),
    )
    # a small file of many parts is one split; narrow rows are spread before they become pages
    part = table(spark, sf, "part")
    return part.repartition(_tasks(spark, part), "p_partkey").select("p_partkey", F.concat(text("<html><body>"), block, text("</body></html>")).alias("html"))


@query(f"""
SELECT doc_id, md5({_SQUEEZED.format("text")}) AS summary, CASE WHEN lang = 'en' THEN md5('from ' || source) ELSE md5('') END AS plot
FROM documents
""")
def detail_pages(spark, sf):
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(
        F.lit('<div data-testid="sub-section-summaries"><span data-reactroot="">drop</span><p>'), escaped, F.lit("</p></div>"),
        F.when(
            F.col("lang") == "en",
            F.concat(F.lit('<div data-testid="sub-section-synopsis"><i>from</i>\n<b>'), "source", F.lit("</b></div>")),
        ).otherwise(""),
    )
    pages = table(spark, sf, "documents").select("doc_id", html.alias("html"))
    return H.extract_sections_html(pages).select("doc_id", F.md5("summary").alias("summary"), F.md5("plot").alias("plot"))


@query(r"""
WITH c AS (SELECT doc_id, 'summary: ' || source || chr(10) || 'plot: ' || text AS body FROM documents)
SELECT doc_id, length(regexp_replace(body, '\s', '', 'g')) AS solid_chars, true AS fits, true AS numbered FROM c
""")
def chunk_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("summary"), F.col("text").alias("plot"))
    docs = docs.select("doc_id", C.page_content(["summary", "plot"]).alias("body"))
    chunks = C.chunk_documents(docs, "doc_id", "body")
    return chunks.groupBy("doc_id").agg(
        F.sum(F.length(F.regexp_replace("chunk", r"\s", "")).cast("bigint")).alias("solid_chars"),
        (F.max(F.length("chunk")) <= 1000).alias("fits"),
        (F.max("chunk_no") + 1 == F.count("*")).alias("numbered"),
    )


_CUT = "repeat('z', 21 + o_orderkey % 40)"


@query(f"""
WITH o AS (SELECT o_orderkey, o_orderpriority AS a, ' ' || {_CUT} AS z FROM orders),
c AS (
  SELECT o_orderkey, 0 AS chunk_no, 'a: ' || a AS chunk FROM o
  UNION ALL SELECT o_orderkey, 1, 'z:' FROM o
  UNION ALL SELECT o_orderkey, 2 + i, trim(substr(z, 1 + 20 * i, 20)) FROM o, range(4) t(i) WHERE 20 * i < length(z))
SELECT o_orderkey, chunk_no::INTEGER AS chunk_no, chunk FROM c
""")
def chunk_cuts(spark, sf):
    """Chunks whose cuts can be told: two fields, the second of one long word, cut every 20 characters from the space before it."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("a"), F.expr(_CUT).alias("z"))
    rows = rows.select("o_orderkey", C.page_content(["a", "z"]).alias("body"))
    return C.chunk_documents(rows, "o_orderkey", "body", 20)


@query(r"""
SELECT tokens, tokens * 0.0001::DOUBLE / 1000 AS est_price
FROM (SELECT CAST(sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'))) AS BIGINT) AS tokens FROM documents)
""")
def token_cost(spark, sf):
    return A.token_cost(table(spark, sf, "documents"), "text")
