"""Field extraction from web pages with built-in expressions.

Pages are cut at the opening tags of what is looked for; a cut that has to end at its own closing tag is followed by
counting tags of its kind. Fields are then patterns over short pieces. No page is parsed as a whole and no Python runs.

An element counts with its closing tag; attributes are quoted; an attribute's value holds no ``>``. Comments are no
part of a page. Character references are read by number, and by the names of the HTML 4 set.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values: the listing and detail layouts ---------------------------------------------
LISTING_BLOCK = ("div", "class", "lister-item mode-advanced")
YEAR_CLASS, CERTIFICATE_CLASS, GENRE_CLASS, RUNTIME_CLASS = "lister-item-year", "certificate", "genre", "runtime"
DESCRIPTION_CLASS, SCORE_CLASS = "text-muted", "metascore"
VOTES = ("span", "name", "nv")
VOTES_VALUE = "data-value"
DETAIL_SECTIONS = {
    "summary": ("div", "data-testid", "sub-section-summaries"),
    "plot": ("div", "data-testid", "sub-section-synopsis"),
}
DETAIL_DROPPED = {"summary": ("span", "data-reactroot", "")}
ONE_DIRECTOR, MANY_DIRECTORS = "Director:", "Directors:"
UNNUMBERED_YEAR = "I"
# ----------------------------------------------------------------------------------------------
_NUMERIC = r"\s*[+-]?(\d+\.?\d*|\.\d+)\s*"
_TAG = r"<[^>]*>"


# ---- pieces of pages ----------------------------------------------------------------------------


def opening(tag: str, attr: str | None = None, value: str | None = None, word: bool = False) -> str:
    """A pattern for an opening tag; with ``word`` the value is one of the attribute's words."""
    if attr is None:
        return rf"(?is:<{tag}\b[^>]*>)"
    around = (r"(?:[^\"']*\s)?", r"(?:\s[^\"']*)?") if word else ("", "")
    return rf"(?is:<{tag}\b(?=[^>]*\s{attr}\s*=\s*[\"']{around[0]}{value}{around[1]}[\"'])[^>]*>)"


def element(tag: str, attr: str | None = None, value: str | None = None, word: bool = False) -> str:
    """A pattern for an element that holds none of its kind; group 1 is its content."""
    return opening(tag, attr, value, word) + rf"(?is:(.*?)</{tag}\s*>)"


def every(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def first(html: Column, pattern: str, group: int = 1) -> Column:
    """NULL where nothing matches."""
    return F.get(every(html, pattern, group), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    return first(tag, rf"(?i)\s{name}\s*=\s*[\"']([^\"']*)[\"']")


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def unescaped(text: Column) -> Column:
    """Character references as characters; unknown ones stay."""
    names = F.from_json(F.lit("{" + ",".join(f'"{n}":{c}' for n, c in name2codepoint.items()) + '}'), "map<string,int>")  # a constant

    def read(token: Column) -> Column:
        body = F.substring(token, 2, F.length(token) - 2)
        number = (
            F.when(body.rlike(r"^#\d{1,7}$"), F.substring(body, 2, 7).cast("int"))
            .when(body.rlike(r"^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(body, 3, 6), 16, 10).cast("int"))
            .otherwise(F.element_at(names, body))
        )
        known = token.endswith(";") & token.startswith("&") & number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(token)

    parts = F.transform(F.regexp_extract_all(text, F.lit(r"&#?\w{1,10};|&|[^&]+"), F.lit(0)), read)
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def plain(html: Column) -> Column:
    """The text of a piece: its tags taken away."""
    return unescaped(F.regexp_replace(html, _TAG, ""))


def spaced(html: Column) -> Column:
    """The text of a piece, its strings trimmed and joined by spaces."""
    strings = F.transform(F.split(html, _TAG), lambda s: F.regexp_replace(unescaped(s), r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(strings, lambda s: s != ""), " ")


def balanced(after: Column, tag: str) -> Column:
    """What lies between an opening tag and its own closing tag; ``after`` is the page after the opening tag.

    The text is cut at closing tags. An element is over at the first of them by which as many have closed as have
    opened, itself included; without one it lasts to the end.
    """
    pieces = F.split(after, rf"(?i)</{tag}\s*>")
    opened = F.transform(pieces, lambda p: F.regexp_count(p, F.lit(rf"(?i)<{tag}\b")))
    start = F.struct(F.lit(1).alias("open"), F.lit(0).alias("n"))
    step = lambda s, k: F.when(s["open"] == 0, s).otherwise(F.struct((s["open"] + k - 1).alias("open"), (s["n"] + 1).alias("n")))
    last = F.aggregate(opened, start, step, lambda s: s["n"])
    return F.when(after.isNotNull(), F.array_join(F.slice(pieces, 1, last), f"</{tag}>"))


def blocks(pages: DataFrame, html_col: str, tag: str, attr: str, value: str, tasks: int | None = None) -> DataFrame:
    """One row per element of a page that is not inside another of its kind: the page's other columns, block (from 0), piece.

    ``tasks`` spreads the pieces, once cut, over so many tasks: for pages of very many blocks, or few tasks.
    """
    pieces = F.split(without_comments(F.col(html_col)), opening(tag, attr, value))
    kept = [c for c in pages.columns if c != html_col]
    rows = pages.select(*kept, F.posexplode(F.slice(pieces, 2, F.size(pieces))).alias("block", "_after"))
    rows = rows.repartition(tasks, "block", F.xxhash64("_after")) if tasks else rows
    return rows.select(*kept, "block", balanced(F.col("_after"), tag).alias("piece"))


# ---- listing pages ------------------------------------------------------------------------------


def _credits(found: DataFrame) -> DataFrame:
    """Add directors and stars of ``piece``, told apart by the label before the first link.

    Each step uses the one before more than once, so the steps are columns of their own: a pattern is matched once a block.
    """
    paragraph = r"(?is:<p\b(?![^>]*\sclass\s*=\s*[\"'][^\"'])[^>]*>)(?is:(.*?)</p\s*>)"
    steps = [
        {"_block": first(F.col("piece"), paragraph)},
        {"_before": first(F.col("_block"), r"(?is)^(.*?)<a\b"), "_links": first(F.col("_block"), r"(?is)(<a\b.*)$")},
        {"_tail": F.regexp_extract("_before", r"([^<>]*)$", 1), "_of_many": first(F.col("_links"), r"(?is)^(.*?)<span\b"), "_people": every(F.col("_links"), element("a"))},
        {"_said": F.when(F.col("_tail") != "", F.col("_tail")).otherwise(F.regexp_extract("_before", r">([^<>]*)</\w+\s*>$", 1))},
        {"_label": F.when(F.col("_before") != "", F.regexp_replace("_said", r"(?U)^\s+|\s+$", "")), "_people": F.transform("_people", plain)},
    ]
    for step in steps:
        found = found.withColumns(step)
    label, people, many = F.col("_label"), F.col("_people"), F.col("_of_many")
    names = lambda html: F.array_join(F.transform(every(html, element("a")), plain), ",")
    rest = first(F.col("_links"), r"(?is)^.*?<span\b(.*)$")
    directors = F.when(label == ONE_DIRECTOR, F.get(people, F.lit(0))).when(label == MANY_DIRECTORS, F.when(many.isNotNull(), names(many)))
    stars = (
        F.when(label == ONE_DIRECTOR, F.array_join(F.slice(people, 2, F.greatest(F.size(people) - 1, F.lit(0))), ","))
        .when(label == MANY_DIRECTORS, F.when(many.isNotNull(), names(rest)))
        .when(label.isNotNull(), F.array_join(people, ","))
    )
    return found.withColumns({"directors": directors, "stars": stars}).drop(*{name for step in steps for name in step})


def listing_blocks(pages: DataFrame, html_col: str = "html", tasks: int | None = None) -> DataFrame:
    """Every title block of listing pages in one pass: the page's other columns, ``block``, the record's columns, ``reason``.

    ``reason`` says why a block is no record: it lacks a numeric rating, a vote count, a year or a title link, or its
    only year text is the disambiguation mark.
    """
    piece = F.col("piece")
    by_class = lambda tag, name: first(piece, element(tag, "class", name, word=True))
    found = blocks(pages, html_col, *LISTING_BLOCK, tasks=tasks)
    kept = [c for c in found.columns if c != "piece"]
    head = first(piece, element("h3"))
    link = attribute(first(piece, opening("a"), 0), "href")
    votes = attribute(first(piece, opening(*VOTES), 0), VOTES_VALUE)
    rating = first(piece, element("strong"))
    found = found.select(*kept, "piece", head.alias("_head"), link.alias("_link"), votes.alias("ratingCount"), rating.alias("_rating"))
    found = _credits(found.withColumn("_rating", plain(F.col("_rating"))))
    found = found.withColumn("_said", first(F.col("_head"), element("span", "class", YEAR_CLASS, word=True)))
    found = found.withColumn("_said", F.translate(plain(F.col("_said")), "()", ""))
    said = F.col("_said")
    year = F.when(F.contains(said, F.lit(" ")), F.get(F.split(said, " "), F.lit(1))).otherwise(said)
    found = found.withColumn("year", year)
    reason = (
        F.when(F.col("_rating").isNull(), "no rating")
        .when(F.col("ratingCount").isNull(), "no votes")
        .when(F.col("year").isNull(), "no year")
        .when(F.col("_link").isNull(), "no link")
        .when(~F.col("_rating").rlike(f"^{_NUMERIC}$"), "rating is no number")
        .when(F.regexp_count("_link", F.lit("/")) < 2, "link has no id")
        .when(F.col("year") == UNNUMBERED_YEAR, "no year")
    )
    # what is read more than once is cut out first
    found = found.withColumn("reason", reason).withColumns({
        "_title": first(F.col("_head"), element("a")),
        **{name: by_class("span", of) for name, of in (("_certificate", CERTIFICATE_CLASS), ("_genre", GENRE_CLASS), ("_runtime", RUNTIME_CLASS), ("_score", SCORE_CLASS))},
        "_description": F.get(every(piece, element("p", "class", DESCRIPTION_CLASS, word=True)), F.lit(1)),
    })
    return found.select(
        *kept,
        F.get(F.split("_link", "/"), F.lit(2)).alias("imdb_title_id"),
        plain(F.col("_title")).alias("title"),
        "year",
        plain(F.col("_certificate")).alias("certificate"),
        F.regexp_replace(plain(F.col("_genre")), r"(?U)^\s+|\s+$", "").alias("genre"),
        plain(F.col("_runtime")).alias("runtime"),
        spaced(F.col("_description")).alias("description"),
        F.trim("_rating").try_cast("double").alias("IMDb_rating"),
        plain(F.col("_score")).alias("MetaScore"),
        "ratingCount",
        "directors",
        "stars",
        "reason",
    )


LISTING_COLUMNS = "imdb_title_id title year certificate genre runtime description IMDb_rating MetaScore ratingCount directors stars".split()


def extract_listing(pages: DataFrame, html_col: str = "html", tasks: int | None = None) -> DataFrame:
    """One row per title block of a listing page; ``listing_rejects`` returns the blocks that are left out."""
    return listing_blocks(pages.select(html_col), html_col, tasks).where("reason IS NULL").select(*LISTING_COLUMNS)


def listing_rejects(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row per title block that is no record: the page's other columns, ``block`` (its number) and ``reason``."""
    kept = [c for c in pages.columns if c != html_col]
    return listing_blocks(pages, html_col).where("reason IS NOT NULL").select(*kept, "block", "reason")


# ---- detail pages -------------------------------------------------------------------------------


def extract_sections_html(pages: DataFrame, html_col: str = "html", sections: dict = DETAIL_SECTIONS, dropped: dict = DETAIL_DROPPED) -> DataFrame:
    """Text of marked page sections, whitespace collapsed; a missing section gives ``""``. Other columns stay."""
    kept = [c for c in pages.columns if c != html_col]
    html = without_comments(F.col(html_col))
    out = []
    for name, (tag, attr, value) in sections.items():
        after = F.get(F.split(html, opening(tag, attr, value), 2), F.lit(1))
        inside = balanced(after, tag)
        if name in dropped:
            inside = F.regexp_replace(inside, element(*dropped[name]), "<>")
        text = F.regexp_replace(F.regexp_replace(spaced(inside), r"(?U)\s+", " "), "^ | $", "")
        out.append(F.coalesce(text, F.lit("")).alias(name))
    return pages.select(*kept, *out)


def extract_texts(pages: DataFrame, fields: dict[str, tuple], html_col: str = "html", as_written: bool = False) -> DataFrame:
    """The text of the first element for each field, a tuple for ``element``; NULL if there is none. Other columns stay.

    ``as_written`` leaves character references as they stand, whole or cut short.
    """
    read = (lambda piece: F.regexp_replace(piece, _TAG, "")) if as_written else plain
    kept = [c for c in pages.columns if c != html_col]
    html = without_comments(F.col(html_col))
    return pages.select(*kept, *[read(first(html, element(*where))).alias(name) for name, where in fields.items()])
