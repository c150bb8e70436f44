"""Category expansion, wikitext sections and their pivot into rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from textlake.functions.scalars import NO_LINKS, NO_PLOT, NO_SUMMARY, clean_section
from textlake.operators.merge import number_rows
from textlake.session import checkpointed

# ---- fixed values: sections that are kept, and the texts that stand in for missing ones --------
SECTIONS_TO_INCLUDE = ("Plot", "External links")
SECTION_COLUMNS = {
    "summary": (None, NO_SUMMARY),
    "plot": ("Plot", NO_PLOT),
    "external_links": ("External links", NO_LINKS),
}
# ----------------------------------------------------------------------------------------------
# before a line that is a heading
_AT_HEADING = r"\n(?=={1,6}[^\n]+?={1,6}[ \t]*(?:\n|\z))"


def expand_category(edges: DataFrame, roots: DataFrame, max_depth: int | None = 1) -> DataFrame:
    """Pages below the root categories, entering sub-categories while depth remains: ``(root, page, depth)``.

    ``edges(parent, child, kind)`` with kind ``page`` or ``category``; ``roots(root)``. A page's ``depth`` is the least
    number of sub-categories between it and the root; ``max_depth`` None goes on to the end. Each level is one join and
    one anti-join with the categories entered so far, so cycles end and every category is entered once for a root;
    levels are written, so the plan stays small however deep the graph is. Pages are joined once, to all categories entered.
    """
    inner = edges.where(F.col("kind") == "category").select("parent", "child")
    level = roots.select("root", F.col("root").alias("_at")).distinct()
    seen, entered, depth = level, [], 0
    while True:
        entered.append(level.withColumn("depth", F.lit(depth)))
        if depth == max_depth:
            break
        level = level.join(inner, F.col("_at") == F.col("parent")).select("root", F.col("child").alias("_at")).distinct()
        level = level.join(seen, ["root", "_at"], "left_anti")
        if max_depth is None or max_depth > 2:
            level = checkpointed(level)
            if level.isEmpty():
                break
        seen = seen.unionByName(level)
        depth += 1
    pages = edges.where(F.col("kind") == "page").select("parent", F.col("child").alias("page"))
    listed = functools.reduce(DataFrame.unionByName, entered).join(pages, F.col("_at") == F.col("parent"))
    return listed.groupBy("root", "page").agg(F.min("depth").alias("depth"))


def work_list(pages: DataFrame, page: str = "page") -> DataFrame:
    """The distinct pages in sorted order: ``(place, page)``, places from 1. Sorted by range, not in one task."""
    return number_rows(pages.select(page).where(F.col(page).isNotNull()).distinct(), page, name="place").select("place", page)


def extract_wiki_sections(
    docs: DataFrame, title_col: str, text_col: str, include=SECTIONS_TO_INCLUDE, clean: bool = True
) -> DataFrame:
    """Sections of wikitext: ``(title, pos, path, text)``.

    Position 0 is the text before the first heading. A level-2 section is kept when its heading is in
    ``include``, with the text up to its first sub-heading; a sub-section only if it directly
    continues a kept section and its own heading is in ``include``. ``path`` is the title followed
    by the headings as written.

    One pass cuts the text at its headings. A fold over the heading lines alone carries the open path; texts are taken
    from the pieces of kept sections only, and rows stay where they are.
    """
    text, title = F.col(text_col), F.col(title_col)
    wanted = F.array(*[F.lit(x) for x in include])
    pieces = F.split(F.concat(F.lit("\n"), text), _AT_HEADING)
    line = lambda piece: F.rtrim(F.call_function("substring_index", piece, F.lit("\n"), F.lit(1)), F.lit(" \t"))
    cut = docs.where(text.isNotNull()).select(title.cast("string").alias(title_col), pieces.alias("_pieces"))
    cut = cut.withColumn("_heads", F.transform(F.slice("_pieces", 2, F.greatest(F.size("_pieces") - 1, F.lit(0))), line))

    def step(state, i):
        heading = F.get(F.col("_heads"), i)
        level = F.least(F.length(heading) - F.length(F.ltrim(heading, F.lit("="))), F.length(heading) - F.length(F.rtrim(heading, F.lit("="))))
        open_path = F.slice(state["path"], 1, F.least(F.size(state["path"]), F.greatest(level - 1, F.lit(1))))
        keep = (level >= 2) & (F.size(open_path) == level - 1) & F.array_contains(wanted, F.trim(heading, F.lit("= ")))
        path = F.when(keep, F.concat(open_path, F.array(heading))).otherwise(open_path)
        row = F.struct((i + 1).cast("int").alias("pos"), path.alias("path"))
        return F.struct(path.alias("path"), F.when(keep, F.concat(state["rows"], F.array(row))).otherwise(state["rows"]).alias("rows"))

    start = F.array(title.cast("string"))
    first = F.array(F.struct(F.lit(0).alias("pos"), start.alias("path"))).cast("array<struct<pos:int,path:array<string>>>")
    indexes = F.when(F.size("_heads") > 0, F.sequence(F.lit(0), F.size("_heads") - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.aggregate(indexes, F.struct(start.alias("path"), first.alias("rows")), step, lambda s: s["rows"])
    out = cut.select(title_col, "_pieces", "_heads", F.inline(kept))
    # a piece ends with the line end that the next heading begins after; its text ends where its heading's (the lead's:
    # the first heading's) own characters appear again
    piece = F.get("_pieces", F.col("pos"))
    head = F.get("_heads", F.greatest(F.col("pos") - 1, F.lit(0)))
    whole = F.concat(piece, F.when((F.col("pos") + 1 < F.size("_pieces")) & (F.length(piece) > 0), "\n").otherwise(""))
    after = F.length(F.call_function("substring_index", piece, F.lit("\n"), F.lit(1)))
    body = F.when(F.col("pos") == 0, F.substring(whole, 2, 2147483647)).otherwise(F.substring(whole, after + 1, F.lit(2147483647)))
    body = F.when(head.isNull(), body).otherwise(F.call_function("substring_index", body, head, F.lit(1)))
    out = out.select(title_col, "pos", "path", body.alias("text"))
    return out.withColumn("text", clean_section("text")) if clean else out


def section_name(path) -> Column:
    """Heading of a section without its marks; NULL for the lead."""
    path = F.col(path) if isinstance(path, str) else path
    return F.trim(F.replace(F.get(path, F.lit(1)), F.lit("="), F.lit("")))


def pivot_sections(sections: DataFrame, title: str, section: str, text: str, pos: str, columns=SECTION_COLUMNS):
    """One row per title. ``columns`` maps an output column to (section name or NULL, default).

    Of repeated sections the last one counts; missing or empty ones take the default.
    """

    def pick(name, default):
        hit = F.col(section).isNull() if name is None else F.col(section) == name
        last = F.max_by(F.col(text), F.when(hit, F.col(pos)))
        return F.coalesce(F.nullif(last, F.lit("")), F.lit(default))

    cells = [pick(name, default).alias(out) for out, (name, default) in columns.items()]
    return sections.groupBy(title).agg(*cells)


def page_facts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Title, first heading, number of links and first link of pages, with built-in expressions.

    A missing tag or link gives ``""``; ``&amp;`` is read as ``&``.
    """
    html = F.col(html_col)

    def tag(name):
        return F.replace(F.regexp_extract(html, f"<{name}>([^<]*)</{name}>", 1), F.lit("&amp;"), F.lit("&"))

    return pages.withColumns(
        {
            "title": tag("title"),
            "h1": tag("h1"),
            "n_links": F.regexp_count(html, F.lit("<a href=")).cast("bigint"),
            "first_link": F.regexp_extract(html, '<a href="([^"]*)"', 1),
        }
    )
