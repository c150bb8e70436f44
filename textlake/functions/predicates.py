"""Row predicates and filter composition."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from textlake.functions.scalars import NO_PLOT, _col

PLOT_SENTINELS = (NO_PLOT, " ", "")  # fixed values


@dataclass(frozen=True)
class Bounds:
    """Optional search bounds; absent ones add no clause."""

    year_from: int | None = None
    year_to: int | None = None
    genres: tuple[str, ...] = field(default_factory=tuple)
    min_rating: float | None = None


def usable_text(c, min_len: int = 20) -> Column:
    """Not NULL and longer than ``min_len`` after trimming spaces."""
    c = _col(c)
    return c.isNotNull() & (F.length(F.trim(c)) > min_len)


def not_sentinel(c, values=PLOT_SENTINELS) -> Column:
    c = _col(c)
    return c.isNotNull() & ~c.isin(*values)


def feature_filter(type_c, year_c, adult_c, votes_c, y0: int, y1: int, min_votes: int = 100) -> Column:
    """Feature films that are not adult, inside the year range, with enough votes."""
    year = _col(year_c).try_cast("int")
    return (
        (_col(type_c) == "movie")
        & year.isNotNull()
        & (_col(adult_c) == "0")
        & year.between(y0, y1)
        & (_col(votes_c) >= min_votes)
    )


def min_popularity(c, n: int, strict: bool = False) -> Column:
    return _col(c) > n if strict else _col(c) >= n


def overlaps_ci(c, values) -> Column:
    """True when the array shares an element with ``values``, ignoring case; never NULL."""
    wanted = F.array(*[F.lit(v.lower()) for v in values]).cast("array<string>")
    return F.coalesce(F.arrays_overlap(F.transform(_col(c), F.lower), wanted), F.lit(False))


def build_filter(
    bounds: Bounds, year_col: str = "year", genre_col: str = "genres", rating_col: str = "rating"
) -> Column | None:
    """AND of the supplied bounds, or None when there are none."""
    clauses = []
    if bounds.year_from is not None:
        clauses.append(F.col(year_col) >= bounds.year_from)
    if bounds.year_to is not None:
        clauses.append(F.col(year_col) <= bounds.year_to)
    if bounds.min_rating is not None:
        clauses.append(F.col(rating_col) >= bounds.min_rating)
    if bounds.genres:
        clauses.append(overlaps_ci(genre_col, bounds.genres))
    return functools.reduce(operator.and_, clauses) if clauses else None


def where_bounds(df: DataFrame, bounds: Bounds | None, **cols) -> DataFrame:
    clause = build_filter(bounds, **cols) if bounds else None
    return df if clause is None else df.where(clause)


def has_filter(parsed) -> Column:
    """True when any bound of a parsed-query struct is present."""
    p = _col(parsed)
    return (
        p["year_from"].isNotNull()
        | p["year_to"].isNotNull()
        | p["min_rating"].isNotNull()
        | (F.coalesce(F.size(p["genres"]), F.lit(0)) > 0)
    )


def display_defaults(df: DataFrame, lists=(), texts=(), zeros=(), missing: str = "NA") -> DataFrame:
    """Fill missing values for display: comma text to arrays, ``'NA'`` for text, 0 for numbers."""
    filled = {c: F.coalesce(F.split(F.col(c), ","), F.array(F.lit(missing))) for c in lists}
    filled |= {c: F.coalesce(F.col(c), F.lit(missing)) for c in texts}
    filled |= {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in zeros}
    return df.withColumns(filled)
