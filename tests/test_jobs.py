import gzip
from decimal import Decimal

from pyspark.sql import functions as F

from textlake import schemas, sinks
from textlake.operators.aggregates import catalog_counts
from textlake.plans import jobs
from textlake.sources import files as S


def movies(spark, *rows):
    names = schemas.MOVIES.names
    full = []
    for row in rows:
        row = {"title": "T", "year": 2000, "ratingCount": 5000, "IMDb_rating": Decimal("7.5"), "runtime": "90 min", **row}
        full.append(tuple(row.get(n) for n in names))
    return spark.createDataFrame(full, schemas.MOVIES)


LONG = "a plot that is long enough"


def test_build_corpus(spark):
    m = movies(
        spark,
        {"imdb_title_id": "tt0000001", "title": "One", "genre": "Drama, War,"},
        {"imdb_title_id": "tt0000002", "title": "Two", "directors": "Ann,Bob"},
        {"imdb_title_id": "tt0000003", "title": "Three", "year": 1999, "runtime": "long"},
        {"imdb_title_id": "tt0000004", "ratingCount": 1000},
        {"imdb_title_id": "tt0000005", "title": "Five"},
    )
    a = spark.createDataFrame(
        [("tt0000001", "s1", LONG), ("tt0000002", "s2", "x" * 20 + "  "), ("tt0000004", "s", LONG), ("tt0000005", None, None)], schemas.PLOTS_A
    )
    b = spark.createDataFrame(
        [
            ("One (film)", "s", f"{LONG} b1", "{{IMDb title|1}}"),
            ("Two (2000 film)", "[[s|t]]", f"{LONG} [[b2|c]]", "{{IMDb title|2}} [[Category:2000 films]]"),
            ("two", "s", f"{LONG} b2b", "https://www.imdb.com/title/tt0000009/ [[Category:2000 films]]"),
            ("THREE", "s", f"{LONG} b3", "[[Category:1999 films]]"),
            ("Three (film)", "s", "No plot available", "[[Category:1999 films]]"),
            ("Five", "s", "{short plot text of more than twenty}", "[[Category:2000 films]]"),
        ],
        schemas.PLOTS_B,
    )
    for stage in (False, True):
        corpus = jobs.build_corpus(m, a, b, stage=stage)
        assert corpus.schema.simpleString() == schemas.CORPUS.simpleString()
        got = sorted((r.source[-1], r.title, r.plot, r.runtime) for r in corpus.collect())
        assert got == [
            ("1", "one", LONG, 90),
            ("2", "two", f"{LONG} b2 c", 90),
            ("2", "two", f"{LONG} b2b", 90),
            ("3", "three", f"{LONG} b3", None),
        ]
    one = {r.source[-1]: r for r in jobs.build_corpus(m, a, b, one_per_key=True).collect()}
    assert one["1"].genre == ["drama", " war", ""] and one["1"].stars == ["NA"] and one["1"].imdb_rating == 7.5
    assert one["2"].directors == ["ann", "bob"] and one["2"].plot == f"{LONG} b2 c"
    reverse = jobs.build_corpus(m, a, b, priority=("b", "a"))
    assert {r.source[-1]: r.plot for r in reverse.collect()}["1"] == f"{LONG} b1"


def test_build_corpus_dbt(spark):
    m = movies(spark, {"imdb_title_id": "tt0000001", "title": "One"}, {"imdb_title_id": "tt0000002", "title": "Two", "stars": "X,Y", "runtime": None})
    a = spark.createDataFrame([("1", "s1", None), ("2", "s2", None)], schemas.PLOTS_A)
    b = spark.createDataFrame(
        [("one", "s", "p", "[[Category:2000 films]]"), ("One", "a''b|c", "{{x}}p", "[[Category:2000 films]]"), ("Two", "s", "p", "[[Category:2000 films")],
        schemas.PLOTS_B,
    )
    got = {(r.source[-1], r.summary, r.plot, r.runtime, tuple(r.stars)) for r in jobs.build_corpus(m, a, b, variant="dbt").collect()}
    assert got == {("1", "a'b,c", "p", 90, ("NA",)), ("2", "s2", None, -1, ("x", "y"))}


def below(plan, operator):
    """The lines of a plan under each node whose line holds ``operator``."""
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if operator in line:
            yield next((lines[i + 1 : j] for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), lines[i + 1 :])


def test_covered_movies_are_left_out_before_texts_join(spark):
    """No anti-join, and so no shuffle for it, carries a cleaned text once per movie that it matches."""
    m = movies(spark, {"imdb_title_id": "tt0000001", "title": "One"}, {"imdb_title_id": "tt0000002", "title": "One"})
    a = spark.createDataFrame([("tt0000001", "s1", LONG)], schemas.PLOTS_A)
    b = spark.createDataFrame([("One", "s", f"{LONG} b", "[[Category:2000 films]]")], schemas.PLOTS_B)
    for variant, left in (("standard", [("1", LONG), ("2", f"{LONG} b")]), ("dbt", [("1", f"{LONG} b"), ("2", f"{LONG} b")])):
        corpus = jobs.build_corpus(m, a, b, variant)
        assert sorted((r.source[-1], r.plot) for r in corpus.collect()) == left
        anti = list(below(corpus._jdf.queryExecution().optimizedPlan().toString(), "LeftAnti"))
        assert anti and not any("Generate" in line for lines in anti for line in lines)  # the cleaning is a generator


def gz(path, header, *rows):
    with gzip.open(path, "wt") as f:
        f.write("\n".join("\t".join(r) for r in [header, *rows]) + "\n")
    return str(path)


def test_import_metadata(spark, tmp_path):
    def title(key, kind="movie", name="N", adult="0", year="2000"):
        return (key, kind, name, name, adult, year, r"\N", r"\N", "Drama")

    basics = gz(
        tmp_path / "b.tsv.gz", schemas.TITLE_BASICS.names, title("t1", name='"Unmatched'), title("t2", kind="short"), title("t3", adult="1"),
        title("t4", year=r"\N"), title("t5", year="1989"), title("t6", year="1990"), title("t7"), title("t8"), title("t9", year="x"),
    )
    ratings = gz(tmp_path / "r.tsv.gz", schemas.TITLE_RATINGS.names, *[(f"t{n}", "7.9", "99" if n == 7 else "100") for n in range(1, 10) if n != 8])
    crew = gz(tmp_path / "c.tsv.gz", schemas.TITLE_CREW.names, ("t1", "n3,n9,n1", r"\N"), ("t6", r"\N", r"\N"))
    names = gz(tmp_path / "n.tsv.gz", schemas.NAME_BASICS.names, *[(f"n{n}", f"Name{n}", *[r"\N"] * 4) for n in (1, 2, 3)])
    scans = [
        S.scan_tsv(spark, basics, schemas.TITLE_BASICS, partitions=2), S.scan_tsv(spark, ratings, schemas.TITLE_RATINGS, null_value=None),
        S.scan_tsv(spark, crew, schemas.TITLE_CREW), S.scan_tsv(spark, names, schemas.NAME_BASICS),
    ]
    target = movies(spark, {"imdb_title_id": "t1", "title": "Kept", "directors": "old"}, {"imdb_title_id": "zz"})
    merged, counts = jobs.import_metadata(target, *scans, 1990, 2005)
    got = {r.imdb_title_id: (r.title, r.year, float(r.IMDb_rating), r.ratingCount, r.directors, r.runtime) for r in merged.collect()}
    assert got == {
        "t1": ("Kept", 2000, 7.9, 100, "Name3,Name1", "90 min"),
        "t6": ("N", 1990, 7.9, 100, None, None),
        "zz": ("T", 2000, 7.5, 5000, None, "90 min"),
    }
    assert tuple(counts.first())[:2] == (1, 1)
    rows = jobs.movie_rows(*scans, 1990, 2005)
    assert {r.title for r in rows.collect()} == {'"Unmatched', "N"}


def test_enrichment(spark):
    plots = spark.createDataFrame([("a", "old", "old"), ("k", "s", "p")], schemas.PLOTS_A)
    m = movies(spark, *[{"imdb_title_id": i, "ratingCount": v} for i, v in [("a", 10**6), ("b", 20000), ("c", 30000), ("d", 9999)]])
    assert [r[0] for r in jobs.enrichment_candidates(m, plots, limit=1).collect()] == ["c"]
    replies = [
        ("a", '{"Response":"True","Plot":"new"}'), ("b", '{"Response":"True","Plot":""}'), ("c", '{"Response":"False"}'), ("d", "oops"), ("e", '{"Response":"True","Plot":"e"}'),
    ]
    merged, counts, status = jobs.merge_enrichment(plots, spark.createDataFrame(replies, "id string, body string"), "id", "body")
    assert {r.imdb_title_id: (r.summary, r.plot) for r in merged.collect()} == {"a": ("new", "new"), "k": ("s", "p"), "e": ("e", "e")}
    assert tuple(counts.first())[:2] == (1, 1) and tuple(status.first()) == (2, 3)


def test_export_ranked(spark, tmp_path):
    m = movies(
        spark, {"imdb_title_id": "a", "ratingCount": 10000, "runtime": None}, {"imdb_title_id": "b", "ratingCount": 90000},
        {"imdb_title_id": "c", "ratingCount": 9999}, {"imdb_title_id": "d", "ratingCount": 10**6, "IMDb_rating": Decimal("6.9")},
    )
    empty = spark.createDataFrame([], schemas.EXPORT)
    log = str(tmp_path / "log")
    assert jobs.export_ranked(m, empty, "2024-01-01", str(tmp_path / "x"), log, min_rating=9.9) is None and not (tmp_path / "x").exists()
    audit = jobs.export_ranked(m, empty, "2024-01-01", str(tmp_path / "v1"), log).first()
    assert (audit.rows_inserted, audit.rows_updated, audit.status) == (2, 0, "success")
    v1 = spark.read.parquet(str(tmp_path / "v1"))
    assert {r.imdb_title_id: (r.id, r.runtime_min) for r in v1.collect()} == {"a": (1, None), "b": (2, 90)}
    audit = jobs.export_ranked(m, v1, "2024-02-01", str(tmp_path / "v2"), log, limit=1).first()
    assert (audit.rows_inserted, audit.rows_updated) == (0, 1)
    v2 = {r.imdb_title_id: (r.created_at.month, r.updated_at.month, r.imdb_url) for r in spark.read.parquet(str(tmp_path / "v2")).collect()}
    assert v2["b"] == (1, 2, "https://www.imdb.com/title/b/") and v2["a"][:2] == (1, 1)
    assert spark.read.parquet(log).count() == 2


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok\nnext', ["a,b", 'c"d'], 2.5), (2, None, None, None)], "i int, t string, l array<string>, d double")
    path = str(tmp_path / "csv")
    sinks.export_csv(df, path)
    assert sorted(map(tuple, sinks.import_csv(spark, path, df.schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert [f.dataType.simpleString() for f in S.scan_csv(spark, path).schema] == ["int", "string", "string", "double"]
    sinks.export_catalog({"x": df, "y": df.limit(1)}, str(tmp_path / "cat"))
    tables = S.load_catalog(spark, str(tmp_path / "cat"), ["x", "y"], register=True)
    assert {r.table: r.n for r in catalog_counts(tables).collect()} == {"x": 2, "y": 1}
    assert spark.sql("select count(*) from x").first()[0] == 2
    again = sinks.materialize(df, str(tmp_path / "m"))
    assert sinks.materialize(df.limit(1), str(tmp_path / "m")).count() == 1 and again is not None
    mapped = S.scan_mapped(df.selectExpr("i", "repeat(t, 3) t", "l"), "i", "t", genre_col="l").first()
    assert (mapped.title_id, mapped.genres, mapped.year) == (1, ["a,b", 'c"d'], None)


def test_export_log_with_and_without_rows(spark, tmp_path, monkeypatch):
    """The registered query, when no movie and when every movie passes the thresholds."""
    from suite import runs

    plain = runs.movies
    sf = "/root/testdata/sf0.001"
    none = lambda spark, sf: plain(spark, sf).withColumn("ratingCount", F.lit(9_999))
    monkeypatch.setattr(runs, "movies", none)
    assert runs.export_log(spark, sf).collect() == []
    all_ = lambda spark, sf: plain(spark, sf).withColumn("ratingCount", F.lit(20_000)).withColumn("IMDb_rating", F.lit(8.0))
    monkeypatch.setattr(runs, "movies", all_)
    rows = runs.export_log(spark, sf).collect()
    n = plain(spark, sf).count()
    log = {r.id: (r.created, r.updated) for r in rows if r.what == "log"}
    assert log == {2024: (min(n, 100), 0), 2025: (min(n, 250) - min(n, 100), min(n, 100))}
    assert len({r.id for r in rows if r.what != "log"}) == min(n, 250)
