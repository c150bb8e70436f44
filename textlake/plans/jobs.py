"""The batch jobs: metadata import, corpus build, vector build, search and ranked export."""

from __future__ import annotations

import functools
import logging

from pyspark.sql import DataFrame, functions as F

from textlake import schemas
from textlake.functions.predicates import PLOT_SENTINELS, feature_filter, min_popularity, not_sentinel, usable_text
from textlake.functions.scalars import (
    NO_LINKS, build_url, clean_markup, clean_title, extract_id, extract_year, pad_key, runtime_minutes, split_lower,
)
from textlake.operators import vectors as V
from textlake.operators.aggregates import token_cost, weighted_top
from textlake.operators.chunking import chunk_documents, page_content
from textlake.operators.extract import expand_category, extract_wiki_sections, pivot_sections, section_name
from textlake.operators.html import extract_listing
from textlake.operators.merge import dedup, merge_audited, merge_full, merge_partial, stage_distinct
from textlake.operators.relational import coalesce_sources, either_join, either_matched, not_covered, resolve_id_list
from textlake.operators.search import extract_filters, parse_replies, prepare_queries, search_report
from textlake.sinks import materialize
from textlake.sources.files import parse_enrichment, scan_mapped

log = logging.getLogger("textlake")

# fixed values: thresholds and the columns a metadata refresh changes
MIN_RATING_COUNT = 1000
REFRESHED = ["IMDb_rating", "ratingCount", "directors"]
LISTED = ["IMDb_rating", "MetaScore", "ratingCount"]
TITLE_URL = "https://www.imdb.com/title/"
EXPORT_LIMIT, EXPORT_MIN_RATING, EXPORT_MIN_VOTES = 10_000, 7.0, 10_000


def movie_rows(
    basics: DataFrame, ratings: DataFrame, crew: DataFrame, names: DataFrame, y0: int, y1: int, min_votes: int = 100
) -> DataFrame:
    """Feature films of the years ``y0..y1`` in the shape of the movies table."""
    rated = basics.join(ratings, "tconst").where(
        feature_filter("titleType", "startYear", "isAdult", "numVotes", y0, y1, min_votes)
    )
    with_crew = rated.join(crew.select("tconst", F.col("directors").alias("_ids")), "tconst", "left")
    named = resolve_id_list(with_crew, "_ids", names, "nconst", "primaryName", "directors")
    values = {
        "imdb_title_id": F.col("tconst"),
        "title": F.col("primaryTitle"),
        "year": F.col("startYear").try_cast("int"),
        "genre": F.col("genres"),
        "runtime": F.col("runtimeMinutes"),
        "IMDb_rating": F.col("averageRating").cast("float"),
        "ratingCount": F.col("numVotes"),
        "directors": F.col("directors"),
    }
    return named.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.MOVIES]
    )


def import_metadata(target: DataFrame, basics, ratings, crew, names, y0: int, y1: int, min_votes: int = 100):
    """Merge the metadata files into the movies table: ``(merged, counts)``."""
    rows = movie_rows(basics, ratings, crew, names, y0, y1, min_votes)
    return merge_partial(target, rows, "imdb_title_id", REFRESHED)


def load_listing(target: DataFrame, pages: DataFrame, html_col: str = "html", tasks: int | None = None):
    """Merge the title blocks of listing pages into the movies table: ``(merged, counts)``.

    Blocks that repeat collapse first. A known title gets the rating, the score and the vote count of its block; a new one all columns.
    ``tasks`` is the number of tasks that read the blocks.
    """
    rows = extract_listing(pages, html_col, tasks)
    shaped = rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in target.schema])
    return merge_partial(target, stage_distinct(shaped), "imdb_title_id", LISTED)


def plot_keys_b(plots_b: DataFrame, variant: str = "standard") -> DataFrame:
    """What the second plot source is matched by, next to its own key; reads no plot text."""
    links = F.col("external_links")
    if variant == "standard":
        num, year = extract_id(links), extract_year(links)
    else:
        num = extract_id(links, sentinel=NO_LINKS, two_part=True)
        year = extract_year(links, as_text=True)
    return plots_b.select(
        F.col("title").alias("raw_title"), clean_title("title").alias("title"), num.alias("imdb_num"), year.alias("year")
    )


def raw_texts_b(plots_b: DataFrame, variant: str = "standard") -> DataFrame:
    """Text of the second source as stored, without its stand-in plots."""
    sentinels = PLOT_SENTINELS if variant == "standard" else ("No plot available", " ")
    return plots_b.where(not_sentinel("plot", sentinels)).select(F.col("title").alias("raw_title"), "summary", "plot")


def with_clean_text(rows: DataFrame, variant: str = "standard") -> DataFrame:
    """Replace summary and plot by their cleaned form.

    The generator keeps the two chains of replacements in one place: a later filter on the plot
    would otherwise carry a second and third copy of them below the join.
    """
    profiles = ("standard", "standard") if variant == "standard" else ("dbt_summary", "dbt_plot")
    cleaned = F.struct(
        clean_markup("summary", profiles[0]).alias("summary"), clean_markup("plot", profiles[1]).alias("plot")
    )
    kept = [c for c in rows.columns if c not in ("summary", "plot")]
    return rows.select(*kept, F.inline(F.array(cleaned)))


def clean_plots_b(plots_b: DataFrame, variant: str = "standard") -> DataFrame:
    """The second plot source as one cleaned table: title, id number, year, summary and plot."""
    texts = with_clean_text(raw_texts_b(plots_b, variant), variant)
    return plot_keys_b(plots_b, variant).join(texts, "raw_title").drop("raw_title")


def _corpus_rows(joined: DataFrame, variant: str) -> DataFrame:
    standard = variant == "standard"
    values = {
        "source": F.col("imdb_title_id"),
        "title": F.lower("title"),
        "year": F.col("year"),
        "genre": split_lower("genre"),
        "runtime": runtime_minutes("runtime", None if standard else -1),
        "ratingCount": F.col("ratingCount"),
        "plot": F.col("plot"),
        "summary": F.col("summary"),
        "imdb_rating": F.col("IMDb_rating").cast("float"),
        "directors": split_lower("directors"),
        "stars": F.array(F.lit("NA")) if standard else split_lower("stars"),
    }
    return joined.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in schemas.CORPUS])


def build_corpus(
    movies: DataFrame,
    plots_a: DataFrame,
    plots_b: DataFrame,
    variant: str = "standard",
    priority: tuple[str, ...] | None = None,
    one_per_key: bool = False,
    stage: bool = False,
) -> DataFrame:
    """One normalised table from movie metadata and two plot sources, the second keyed by its title.

    ``standard`` prefers source a, matches source b by padded id or by lower-cased title and year, and
    asks for usable text. ``dbt`` prefers b, matches titles as written, pads the ids of a, and asks a
    for a summary only. A source that matches a movie more than once keeps all matches unless
    ``one_per_key``. ``stage`` writes the preferred source before the next one is computed.
    """
    standard = variant == "standard"
    popular = movies.where(min_popularity("ratingCount", MIN_RATING_COUNT, strict=True))
    movie_cols = [c for c in popular.columns if c not in ("summary", "plot")]

    if standard:
        texts_a = plots_a.where(usable_text("plot"))
    else:
        texts_a = plots_a.where(F.col("summary").isNotNull()).withColumn("imdb_title_id", pad_key("imdb_title_id"))

    # match on keys alone: what an earlier source covers, and texts that match nothing, is left out before texts join;
    # each text is cleaned once, and no shuffle carries a text once per movie
    keys_b = plot_keys_b(plots_b, variant).withColumnsRenamed({"title": "_title", "year": "_year"})
    fold = F.lower if standard else (lambda c: c)
    year = F.col("_year") if standard else F.col("_year").try_cast("int")
    by_id = (F.col("imdb_title_id"), pad_key("imdb_num"))
    by_title = [(fold(F.col("title")), fold(F.col("_title"))), (F.col("year"), year)]
    turned = lambda on: (on[1], on[0])
    texts_b = raw_texts_b(plots_b, variant)

    def uncovered(earlier):
        return functools.reduce(lambda movies, keys: not_covered(movies, keys, "imdb_title_id", "source"), earlier, popular)

    def rows_a(earlier):
        return _corpus_rows(texts_a.join(uncovered(earlier), "imdb_title_id"), variant)

    def rows_b(earlier):
        movies = uncovered(earlier)
        pairs = either_join(movies, keys_b, by_id, by_title, movie_cols, ["raw_title"])
        wanted = either_matched(keys_b, movies, turned(by_id), [turned(on) for on in by_title]).select("raw_title").distinct()
        clean = with_clean_text(texts_b.join(wanted, "raw_title", "left_semi"), variant)
        return _corpus_rows(pairs.join(clean.where(usable_text("plot")) if standard else clean, "raw_title"), variant)

    order = priority or (("a", "b") if standard else ("b", "a"))
    keys = {"a": popular.join(texts_a.select("imdb_title_id"), "imdb_title_id", "left_semi"), "b": None}
    if not standard:  # every matched text makes a row, so the keys need no cleaning
        keys["b"] = either_matched(popular, keys_b.join(texts_b.select("raw_title"), "raw_title", "left_semi"), by_id, by_title)
    keys = {s: k if k is None else k.select(F.col("imdb_title_id").alias("source")) for s, k in keys.items()}
    corpus = coalesce_sources([{"a": rows_a, "b": rows_b}[s] for s in order], "source", stage, [keys[s] for s in order])
    return dedup(corpus, "source", "plot") if one_per_key else corpus


def enrichment_candidates(movies: DataFrame, plots: DataFrame, limit: int = 1000, min_votes: int = 10_000) -> DataFrame:
    """Ids still without a plot, the best known first."""
    open_ids = not_covered(movies.where(min_popularity("ratingCount", min_votes)), plots, "imdb_title_id")
    return weighted_top(open_ids, "IMDb_rating", "ratingCount", limit, "imdb_title_id").select("imdb_title_id")


def merge_enrichment(plots: DataFrame, responses: DataFrame, id_col: str, body_col: str):
    """Merge fetched plots: ``(merged, counts, status)``, the last with fetched and skipped replies."""
    parsed = parse_enrichment(responses, id_col, body_col)
    fetched = parsed.where(F.col("status") == "fetched").drop("status")
    merged, counts = merge_full(plots, fetched.withColumnRenamed(id_col, "imdb_title_id"), "imdb_title_id")
    status = parsed.agg(
        F.count_if(F.col("status") == "fetched").alias("fetched"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )
    return merged, counts, status


def build_corpus_vectors(corpus: DataFrame, path: str, dim: int, embedder=None, batch: int = 64, target=None) -> DataFrame:
    """Embed the corpus plots and write the vector table, as a rebuild or into ``target``."""
    rows = scan_mapped(corpus, "source", "plot", "title", "year", "genre", "imdb_rating")
    rows = V.embed_column(rows, "plot", embedder or V.HashEmbedder(dim), batch)
    return V.build_vectors(rows, dim, path, target, order_by="plot")


def embed_documents(
    rows: DataFrame, id_col: str, cols: list[str], path: str, dim: int, embedder=None, size: int = 1000, overlap: int = 0, batch: int = 64
) -> tuple[DataFrame, DataFrame]:
    """Rows as pages of ``name: value`` lines, cut into chunks and embedded: ``(chunk vectors, token price)``.

    Chunks are named by the row's id and their number in it; the price is that of the pages.
    """
    pages = rows.select(F.col(id_col), page_content(cols).alias("content"))
    chunks = chunk_documents(pages, id_col, "content", size, overlap)
    named = chunks.select(F.concat_ws("-", F.col(id_col).cast("string"), "chunk_no").alias("chunk_id"), id_col, "chunk_no", "chunk")
    vectors = V.embed_column(named, "chunk", embedder or V.HashEmbedder(dim), batch)
    return V.build_vectors(vectors, dim, path, key="chunk_id"), token_cost(pages, "content")


def load_wiki_plots(plots: DataFrame, edges: DataFrame, roots: DataFrame, docs: DataFrame, max_depth: int = 1):
    """Merge the sections of the wikitext pages below some categories into the plots table: ``(merged, counts)``.

    ``docs(title, text)`` holds the pages fetched so far; a page without a document, or whose text is NULL, is left
    out of this run and keeps what is stored. Every page is taken once, however many categories list it.
    """
    wanted = expand_category(edges, roots, max_depth).select(F.col("page").alias("title")).distinct()
    pages = docs.join(wanted, "title", "left_semi").where(F.col("text").isNotNull())
    sections = extract_wiki_sections(pages, "title", "text").withColumn("section", section_name("path"))
    wide = pivot_sections(sections, "title", "section", "text", "pos")
    return merge_full(plots, stage_distinct(wide), "title")


def batch_search(
    requests: DataFrame,
    vectors: DataFrame | V.CellIndex,
    dim: int,
    genre_vocab=(),
    replies: DataFrame | None = None,
    embedder=None,
    query_id: str = "query_id",
    nprobe: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answer a table of requests ``(query_id, query, top_k)``: ``(reports, rejected)``.

    Filters come from model ``replies(query_id, reply)`` when given, else from the stated rules. ``vectors`` is the
    vector table, searched exactly, or an index of it, of which ``nprobe`` cells are read first, by default as
    many as ``ann_search`` finds needed.
    """
    valid, rejected = prepare_queries(requests)
    if replies is not None:
        valid = valid.join(replies.select(query_id, "reply"), query_id, "left")
        valid = parse_replies(valid, "query", "reply").drop("reply")
    else:
        valid = extract_filters(valid, "query", genre_vocab)
    asked = valid.select(query_id, "top_k", "parsed.*")
    asked = V.embed_column(asked, "semantic_query", embedder or V.HashEmbedder(dim))
    asked = V.prepare_knn_queries(asked, query_id, "embedding", "top_k")
    if isinstance(vectors, V.CellIndex):
        found = V.ann_search(vectors, asked, nprobe)
    else:
        found = V.knn_join(asked, vectors, dim, "title_id", "embedding", "year", "rating", "genres")
    return search_report(valid, found, query_id), rejected


def ranked_rows(movies: DataFrame, limit: int, min_rating: float, min_votes: int) -> DataFrame:
    """The highest scored movies in the shape of the export table."""
    rows = movies.where((F.col("IMDb_rating") >= min_rating) & min_popularity("ratingCount", min_votes))
    return weighted_top(rows, "IMDb_rating", "ratingCount", limit, "imdb_title_id").select(
        "imdb_title_id",
        "title",
        "year",
        "genre",
        runtime_minutes("runtime").alias("runtime_min"),
        F.col("IMDb_rating").cast("float").alias("imdb_rating"),
        F.col("ratingCount").cast("int").alias("rating_count"),
        "directors",
        build_url("imdb_title_id", TITLE_URL).alias("imdb_url"),
    )


def export_ranked(
    movies: DataFrame,
    target: DataFrame,
    now,
    path: str,
    log_path: str,
    limit: int = EXPORT_LIMIT,
    min_rating: float = EXPORT_MIN_RATING,
    min_votes: int = EXPORT_MIN_VOTES,
    importer: str = "export_ranked",
    source_file: str = "movies",
    source: str = "textlake",
) -> DataFrame | None:
    """Upsert the top movies into ``path`` and append one audit row to ``log_path``.

    Returns the audit row; None, with nothing written, when no movie passes the thresholds.
    """
    spark = movies.sparkSession
    rows = ranked_rows(movies, limit, min_rating, min_votes).persist()
    try:
        if rows.isEmpty():
            log.warning("no rows passed the thresholds, nothing exported")
            return None
        log.info("top: %s", rows.limit(5).collect())
        cols = [c for c in rows.columns if c != "imdb_title_id"]
        merged, counts = merge_audited(target, rows, "imdb_title_id", cols, now)
        materialize(merged, path)
        stamp = F.lit(now).cast("timestamp")
        entry = counts.select(
            F.lit(importer).alias("importer"),
            F.lit(source_file).alias("source_file"),
            F.lit(source).alias("source"),
            F.lit("success").alias("status"),
            stamp.alias("started_at"),
            stamp.alias("finished_at"),
            F.col("inserted").alias("rows_inserted"),
            F.col("matched").alias("rows_updated"),
        )
        audit = spark.createDataFrame(entry.collect(), schemas.IMPORT_LOG)  # one row
        audit.write.mode("append").parquet(log_path)
        return audit
    finally:
        rows.unpersist()
