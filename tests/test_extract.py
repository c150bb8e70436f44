from pyspark.sql import functions as F

from textlake.operators import extract as X, html as H


def test_wiki_sections(spark):
    docs = [
        ("A", "lead [[x]]<ref>r</ref>\n== Plot ==\nthe plot == Plot == cut\n=== Act I ===\nact\n=== Plot ===\nsub\n==== Plot ====\ndeep\n==Refs==\nx\n==External links==\n* e\n"),
        ("B", "no headings"),
        ("C", "== Plot ==\none\n== Plot ==\ntwo"),
        ("D", "==External links==\nl\n=Top=\n=== Plot ===\nlost\n==Other==\n=== Plot ===\nlost"),
        ("E", "a\n== Plot ==\n==== Plot ====\nskipped level\n=== Plot ===\nkept"),
        ("F", None),
    ]
    df = spark.createDataFrame(docs, "t string, x string")
    rows = X.extract_wiki_sections(df, "t", "x")
    got = {(r.t, r.pos): ("/".join(r.path[1:]), r.text) for r in rows.collect()}
    assert got == {
        ("A", 0): ("", "lead x"),
        ("A", 1): ("== Plot ==", "the plot"),
        ("A", 3): ("== Plot ==/=== Plot ===", "sub"),
        ("A", 4): ("== Plot ==/=== Plot ===/==== Plot ====", "deep"),
        ("A", 6): ("==External links==", "* e"),
        ("B", 0): ("", "no headings"),
        ("C", 0): ("", ""),
        ("C", 1): ("== Plot ==", "one"),
        ("C", 2): ("== Plot ==", "two"),
        ("D", 0): ("", ""),
        ("D", 1): ("==External links==", "l"),
        ("E", 0): ("", "a"),
        ("E", 1): ("== Plot ==", ""),
        ("E", 3): ("== Plot ==/=== Plot ===", "kept"),
    }
    wide = X.pivot_sections(rows.withColumn("s", X.section_name("path")), "t", "s", "text", "pos")
    table = {r.t: (r.summary, r.plot, r.external_links) for r in wide.collect()}
    assert table["A"] == ("lead x", "deep", "* e")
    assert table["B"] == ("no headings", "No plot available", "No external links available")
    assert table["C"] == ("No summary available", "two", "No external links available")


def test_expand_category(spark):
    edges = [
        ("r", "p0", "page"), ("r", "c1", "category"), ("c1", "p1", "page"), ("c1", "p0", "page"), ("c1", "c2", "category"),
        ("c2", "p2", "page"), ("c2", "r", "category"), ("c2", "c3", "category"), ("c3", "p3", "page"), ("q", "p9", "page"),
    ]
    graph = spark.createDataFrame(edges, "parent string, child string, kind string")
    roots = spark.createDataFrame([("r",)], "root string")
    for depth, want in [(0, "p0"), (1, "p0 p1"), (2, "p0 p1 p2"), (5, "p0 p1 p2 p3")]:
        assert sorted(r.page for r in X.expand_category(graph, roots, depth).collect()) == want.split()


def listing(body="", year="(I) (2010)", rating="<strong>7.5</strong>", votes='<span name="nv" data-value="12">12</span>', credits=""):
    return (
        '<div class="lister-item mode-advanced"><h3 class="h"><a href="/title/tt01/?r">T &amp; U</a>'
        f'<span class="lister-item-year text-muted">{year}</span></h3>{rating}{body}<p class="">{credits}</p>{votes}</div>'
    )


def test_listing(spark):
    stars = "<a>S1</a>, <a>S2</a>"
    pages = [
        listing(credits=f'Director:<a>D</a><span>|</span>{stars}', body='<span class="genre">\n Drama </span><p class="text-muted">x</p><p class="text-muted">a <b>b</b></p>')
        + listing(credits=f'\n Directors:\n<a>D1</a>, <a>D2</a><span>|</span>Stars:{stars}', year="(1999)"),
        listing(credits=f"Stars:{stars}") + listing(rating="") + listing(votes="") + listing(year="(I)") + "<p>tail",
        listing(credits="none") + listing(credits="Directors:<a>D1</a>"),
        None,
    ]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    rows = [
        (r.imdb_title_id, r.title, r.year, r.genre, r.description, r.IMDb_rating, r.ratingCount, r.directors, r.stars)
        for r in H.extract_listing(df).collect()
    ]
    base = ("tt01", "T & U")
    assert sorted(rows, key=str) == sorted(
        [
            (*base, "2010", "Drama", "a b", 7.5, "12", "D", "S1,S2"),
            (*base, "1999", None, None, 7.5, "12", "D1,D2", "S1,S2"),
            (*base, "2010", None, None, 7.5, "12", None, "S1,S2"),
            (*base, "2010", None, None, 7.5, "12", None, None),
            (*base, "2010", None, None, 7.5, "12", None, None),
        ],
        key=str,
    )


def test_detail_sections(spark):
    html = '<div data-testid="sub-section-summaries">one<span data-reactroot="">drop</span> <p>two\n three</div>'
    df = spark.createDataFrame([(1, html), (2, "<p>none")], "id int, html string")
    got = {r.id: (r.summary, r.plot) for r in H.extract_sections_html(df).collect()}
    assert got == {1: ("one two three", ""), 2: ("", "")}


def test_fields(spark):
    html = "<h1 class='a b'>H &eacute;&#8217;&#x1F600;&nope;&amp;lt;</h1><!-- <h2>x</h2> --><p data-x=\"1\">y <b>z</b></p>"
    fields = {"h": ("h1", "class", "b", True), "whole": ("h1", "class", "b"), "p": ("p", "data-x", "1"), "none": ("h2",)}
    row = H.extract_texts(spark.createDataFrame([(7, html)], "id int, html string"), fields).first()
    assert (row.id, row.h, row.whole, row.p, row.none) == (7, "H é’😀&nope;&lt;", None, "y z", None)


def test_listing_rejects_and_ends_of_blocks(spark):
    """A block ends with its own closing tag, so what follows it on the page fills none of its gaps."""
    good = listing(body="<div><div>deep</div></div>")
    page = "<strong>1</strong>" + listing(rating="") + good + "<strong>9</strong>" + listing(rating="<strong>n/a</strong>") + listing(votes="") + listing(year="(I)")
    page += good.replace("/title/tt01/?r", "tt01") + '<div class="other"><strong>3</strong></div>'
    df = spark.createDataFrame([(5, page), (6, None), (7, "")], "page int, html string")
    assert [(r.page, r.block, r.reason) for r in H.listing_rejects(df).orderBy("block").collect()] == [
        (5, 0, "no rating"), (5, 2, "rating is no number"), (5, 3, "no votes"), (5, 4, "no year"), (5, 5, "link has no id"),
    ]
    assert [(r.imdb_title_id, r.IMDb_rating) for r in H.extract_listing(df).collect()] == [("tt01", 7.5)]
    plan = H.listing_blocks(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_depth_and_work_list(spark):
    """A chain of eight levels with a way back: every page with its least depth, in sorted order."""
    edges = [(f"c{i}", f"c{i + 1}", "category") for i in range(8)] + [("c8", "c0", "category"), ("c3", "c3", "category")]
    edges += [(f"c{i}", f"p{9 - i}", "page") for i in range(9)] + [("c7", "p9", "page"), ("c5", None, "page")]
    graph = spark.createDataFrame(edges, "parent string, child string, kind string")
    roots = spark.createDataFrame([("c0",), ("c6",)], "root string")
    found = X.expand_category(graph, roots, None)
    rows = {(r.root, r.page): r.depth for r in found.where("page IS NOT NULL").collect()}
    assert {p: d for (root, p), d in rows.items() if root == "c0"} == {f"p{9 - i}": i for i in range(9)}
    assert rows[("c6", "p9")] == 1 and rows[("c6", "p4")] == 8 and len(rows) == 18
    assert [(r.place, r.page) for r in X.work_list(found).orderBy("place").collect()] == [(i, f"p{i}") for i in range(1, 10)]


def test_texts_as_written_keep_references_cut_short(spark):
    titles = ["a &amp;&am", "b &amp; c &", "&lt;i&gt; &#x41; &nosuch;", "d <b>e</b> &quot;"]
    df = spark.createDataFrame([(i, f"<title>{t}</title>") for i, t in enumerate(titles)] + [(9, "<p>none</p>")], "id int, html string")
    got = {r.id: r.title for r in H.extract_texts(df, {"title": ("title",)}, as_written=True).collect()}
    assert got == {0: titles[0], 1: titles[1], 2: titles[2], 3: "d e &quot;", 9: None}
    assert H.extract_texts(df, {"title": ("title",)}).where("id = 2").first().title == "<i> A &nosuch;"


def test_html_select_equals_its_sql_on_cut_references(spark, tmp_path):
    import duckdb
    import suite.texts as texts
    from tests import oracle
    from suite.registry import SQL

    rows = [(1, "u", "<title>x &amp;&am</title>"), (2, "u", "<title>&lt; &</title>"), (3, "u", "<p>no title</p>"), (4, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert oracle.compare(texts.html_select(spark, str(tmp_path)), con, SQL["html_select"]) is None


def test_blocks_of_one_page_are_read_by_many_tasks(spark):
    """The pages of a small file, and the blocks of one page, do not meet in one task."""
    import suite.texts as texts

    block = '<div class="lister-item mode-advanced"><h3><a href="/title/tt{0}/">T{0}</a><span class="lister-item-year">(2010)</span></h3><strong>7</strong><span name="nv" data-value="5">5</span></div>'
    df = spark.createDataFrame([("".join(block.format(i) for i in range(200)),)], "html string").coalesce(1)
    rows = H.extract_listing(df, tasks=8).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.imdb_title_id for r in rows) == sorted(f"tt{i}" for i in range(200)) and len({r.task for r in rows}) == 8
    pages = texts._pages(spark, "/root/testdata/sf0.001")
    assert pages.select(F.spark_partition_id().alias("p")).distinct().count() >= 8


def test_pages_are_joined_once_however_deep_the_graph(spark):
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}", "category") for i in range(5)] + [(f"c{i}", f"p{i}", "page") for i in range(6)] + [("c5", "p0", "page")], "parent string, child string, kind string")
    found = X.expand_category(edges, spark.createDataFrame([("c0",)], "root string"), None)
    assert sorted((r.page, r.depth) for r in found.collect()) == [(f"p{i}", i) for i in range(6)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
