"""Column functions for text cleaning, id and year extraction, lists and keys.

Everything here is a built-in expression: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values: patterns and texts that define the cleaning profiles ----------------------
# Written for Java: (?d) makes "." stop at \n only, and the whitespace class leaves out \x0B.
_COMMENT = (r"(?d)<!--.*?-->", "")
_LINK = (r"(?d)\[\[(.+?)\]\]", "$1")
_REF_PAIR = (r"(?d)<ref>.*?</ref>", "")
_REF_SINGLE = (r"(?d)<ref .*?/>", "")
_ANY_TAG = (r"<[^>]*>", "")
_BRACE = (r"(?d)\{.*?\}", "")
_DOUBLE_BRACE = (r"(?d)\{\{.*?\}\}", "")
_PIPE_SPACE = ("|", " ")
_PIPE_COMMA = ("|", ",")
_SPACES = (r"[\t\n\f\r ]+", " ")
_QUOTE_PAIR = ("''", "'")

MARKUP_PROFILES = {
    "standard": [_COMMENT, _LINK, _REF_PAIR, _REF_SINGLE, _ANY_TAG, _BRACE, _PIPE_SPACE, _SPACES],
    "dbt_plot": [
        _COMMENT, _LINK, _REF_PAIR, _REF_SINGLE, _ANY_TAG, _DOUBLE_BRACE, _PIPE_SPACE, _SPACES, _QUOTE_PAIR,
    ],
    "dbt_summary": [
        _COMMENT, _LINK, _REF_PAIR, _REF_SINGLE, _ANY_TAG, _PIPE_COMMA, _QUOTE_PAIR, _QUOTE_PAIR, _QUOTE_PAIR,
    ],
}
_PLAIN_TEXT = {_PIPE_SPACE, _PIPE_COMMA, _QUOTE_PAIR}  # steps without a pattern
TITLE_YEAR_SUFFIX = r"\(\d{4}[\t\n\f\r ]\w+\)"
TITLE_FILM_SUFFIX = r"\(film\)"
ID_TEMPLATE = r"(?d)\{\{[Ii][Mm][Dd][Bb] title(.*)\}\}"
ID_TEMPLATE_TWO_PART = r"(?d)\{\{[Ii][Mm][Dd][Bb] title(.*)(\|.*)?\}\}"
ID_URL = r"https://www\.imdb\.com/title/tt(\d+)"
CATEGORY_YEAR = r"\[\[Category:(\d{4})"
CATEGORY_YEAR_CLOSED = r"(?d)\[\[Category:(\d{4}).*\]\]"
CATEGORY_YEAR_LENIENT = r"Category:(\d{4})"
NO_SUMMARY = "No summary available"
NO_PLOT = "No plot available"
NO_LINKS = "No external links available"
# ----------------------------------------------------------------------------------------------

# Python's idea of whitespace (str.split, str.strip, re "\s"), spelled for Java.
_PY_SPACE = r"[\s\x1c-\x1f]"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_markup(c, profile: str = "standard") -> Column:
    """Run one markup-cleaning profile; the steps apply in order, to every match."""
    out = _col(c)
    for step in MARKUP_PROFILES[profile]:
        change = F.replace if step in _PLAIN_TEXT else F.regexp_replace
        out = change(out, F.lit(step[0]), F.lit(step[1]))
    return out


def _drop_first(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, F.lit(rf"(?s)\A(.*?){pattern}"), F.lit("$1"))


def clean_title(c) -> Column:
    """Drop the first ``(dddd word)`` and the first ``(film)``, then trim spaces."""
    return F.trim(_drop_first(_drop_first(_col(c), TITLE_YEAR_SUFFIX), TITLE_FILM_SUFFIX))


def extract_id(c, sentinel: str | None = None, two_part: bool = False) -> Column:
    """Digits of the id template, else of the title URL, else ``-1`` for ``sentinel``, else NULL."""
    c = _col(c)
    template = ID_TEMPLATE_TWO_PART if two_part else ID_TEMPLATE
    from_template = F.regexp_extract(F.regexp_extract(c, template, 1), r"\d+", 0)
    from_url = F.regexp_extract(c, ID_URL, 1)
    out = F.when(from_template != "", from_template).when(from_url != "", from_url)
    if sentinel is not None:
        out = out.when(c == sentinel, F.lit("-1"))
    return out


def extract_year(c, lenient: bool = False, as_text: bool = False) -> Column:
    """Four digits after ``[[Category:``.

    ``as_text`` keeps a string and asks for the closing brackets. ``lenient`` makes the brackets
    optional, for text whose brackets were removed before it was stored.
    """
    pattern = CATEGORY_YEAR_LENIENT if lenient else CATEGORY_YEAR_CLOSED if as_text else CATEGORY_YEAR
    digits = F.nullif(F.regexp_extract(_col(c), pattern, 1), F.lit(""))
    return digits if as_text else digits.try_cast("int")


def runtime_minutes(c, default: int | None = None) -> Column:
    """``'142 min'`` to 142; decimals and exponents round half up, anything else is NULL or ``default``."""
    text = F.trim(F.replace(_col(c), F.lit("min"), F.lit("")))
    number = F.when(text.rlike(_NUMBER), F.round(text.try_cast("double"))).try_cast("int")
    return number if default is None else F.coalesce(number, F.lit(default))


def split_lower(c, default: str = "NA") -> Column:
    """Comma text to a lower-cased array, elements untrimmed; NULL becomes ``[default]``."""
    return F.coalesce(F.split(F.lower(_col(c)), ","), F.array(F.lit(default)))


def strip(c) -> Column:
    """Remove leading and trailing whitespace of every kind."""
    return F.regexp_replace(_col(c), rf"(?U)\A{_PY_SPACE}+|{_PY_SPACE}+\z", "")


def squeeze(c) -> Column:
    """Collapse each whitespace run to one space and strip the ends."""
    return F.trim(F.regexp_replace(_col(c), rf"(?U){_PY_SPACE}+", " "))


def normalize_list(c, is_array: bool = False) -> Column:
    """Array or comma text to stripped, non-empty elements; NULL to an empty array."""
    items = _col(c) if is_array else F.split(_col(c), ",")
    cleaned = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def pad_key(c, prefix: str = "tt", width: int = 7, truncate: bool = True) -> Column:
    """``prefix`` plus the zero-padded number; ``truncate=False`` keeps longer numbers whole."""
    c = _col(c).cast("string")
    padded = F.lpad(c, width, "0")
    if not truncate:
        padded = F.when(F.length(c) > width, c).otherwise(padded)
    return F.concat(F.lit(prefix), padded)


def strip_prefix(c, n: int = 2) -> Column:
    """Text without its first ``n`` characters."""
    return F.substr(_col(c), F.lit(n + 1))


def build_url(c, prefix: str, suffix: str = "/") -> Column:
    return F.concat(F.lit(prefix), _col(c).cast("string"), F.lit(suffix))


def weighted_score(rating, votes) -> Column:
    """``rating * log10(votes)``; zero votes give NULL."""
    return _col(rating) * F.log10(_col(votes))


def clean_section(c) -> Column:
    """Section text without reference blocks and link brackets, whitespace collapsed."""
    out = F.regexp_replace(_col(c), r"(?d)<ref.*?</ref>", "")
    out = F.replace(F.replace(out, F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))
    return squeeze(out)
