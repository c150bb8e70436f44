import pytest
from pyspark.sql import functions as F

from textlake.functions import predicates as P, scalars as S


@pytest.mark.parametrize(
    "profile, text, want",
    [
        ("standard", "a<!-- x -->b [[l|m]] <ref>r</ref><ref n=1 />c", "ab l m c"),
        ("standard", "a{{x}}b", "a}b"),
        ("standard", "t <b>bold</b>\r\n\fx\x0by ", "t bold x\x0by "),
        ("standard", "keep <!-- over\nlines -->", "keep "),
        ("dbt_plot", "a{{x}}b {{y|{{z}}}} ''q''", "ab }} 'q'"),
        ("dbt_summary", "[[a|b]]''''c''''<i>", "a,b'c'"),
    ],
)
def test_clean_markup(one, profile, text, want):
    assert one(S.clean_markup("t", profile), t=text) == want


@pytest.mark.parametrize(
    "title, want",
    [
        ("Foo (film)", "Foo"),
        ("Foo (2010 film)", "Foo"),
        ("Foo (2010 American film)", "Foo (2010 American film)"),
        ("Foo (2010 film) (2011 film)", "Foo  (2011 film)"),
        ("(film)\n(film) x", "(film) x"),
    ],
)
def test_clean_title(one, title, want):
    assert one(S.clean_title("t"), t=title).replace("\n", "") == want


def test_extract_id_and_year(one):
    both = "{{imdb title|id=77|x=1}} https://www.imdb.com/title/tt0099/"
    assert one(S.extract_id("t"), t=both) == "77"
    assert one(S.extract_id("t"), t="https://www.imdb.com/title/tt0099/") == "0099"
    assert one(S.extract_id("t"), t="{{IMDB title}}") is None
    assert one(S.extract_id("t", sentinel=S.NO_LINKS), t=S.NO_LINKS) == "-1"
    assert one(S.extract_year("t"), t="[[Category:1999 films") == 1999
    assert one(S.extract_year("t", as_text=True), t="[[Category:1999 films") is None
    assert one(S.extract_year("t", as_text=True), t="[[Category:1999 films]]") == "1999"
    assert one(S.extract_year("t"), t="Category:1999 films") is None
    assert one(S.extract_year("t", lenient=True), t="Category:1999 films") == 1999


@pytest.mark.parametrize(
    "text, want",
    [("142 min", 142), ("142", 142), ("90.5", 91), ("1e2", 100), ("", None), ("x", None), (None, None), ("99999999999", None)],
)
def test_runtime(one, text, want):
    assert one(S.runtime_minutes("t"), t=text) == want
    assert one(S.runtime_minutes("t", -1), t=text) == (-1 if want is None else want)


def test_lists(one):
    assert one(S.split_lower("t"), t="Action, Drama,") == ["action", " drama", ""]
    assert one(S.split_lower("t"), t=None) == ["NA"]
    assert one(S.split_lower("t"), t="") == [""]
    assert one(S.normalize_list("t"), t=" a ,, b\t") == ["a", "b"]
    assert one(S.normalize_list("t"), t=None) == []
    assert one(S.normalize_list(F.array(F.col("t"), F.lit(" x "), F.lit(None)), True), t=" ") == ["x"]


def test_keys_and_space(one):
    assert one(S.pad_key("t"), t="12") == "tt0000012"
    assert one(S.pad_key("t"), t="12345678") == "tt1234567"
    assert one(S.pad_key("t", truncate=False), t="12345678") == "tt12345678"
    assert one(S.strip_prefix("t"), t="tt007") == "007"
    assert one(S.build_url("t", "u/"), t=None) is None
    assert one(S.squeeze("t"), t="  a \x1f\n b\x85") == "a b"
    assert one(S.clean_section("t"), t=" [[a]]<ref n>x</ref> b ") == "a b"


def test_filters(spark):
    rows = [
        (1, 1999, ["Drama", None], 7.0),
        (2, 2000, ["noir"], 6.0),
        (3, None, None, None),
        (4, 2001, [], 9.0),
    ]
    df = spark.createDataFrame(rows, "id int, year int, genres array<string>, rating double")

    def ids(**kw):
        return [r.id for r in P.where_bounds(df, P.Bounds(**kw)).orderBy("id").collect()]

    assert P.build_filter(P.Bounds()) is None
    assert ids() == [1, 2, 3, 4]
    assert ids(year_from=2000) == [2, 4]
    assert ids(year_to=1999) == [1]
    assert ids(min_rating=7.0) == [1, 4]
    assert ids(genres=("DRAMA", "x")) == [1]
    assert ids(year_from=1999, genres=("Noir",)) == [2]
    flags = [r.x for r in df.orderBy("id").select(P.overlaps_ci("genres", ["zzz"]).alias("x")).collect()]
    assert flags == [False] * 4


def test_text_predicates(one):
    assert one(P.usable_text("t"), t="  " + "x" * 20 + " ") is False
    assert one(P.usable_text("t"), t="x" * 21) is True
    assert one(P.usable_text("t"), t=None) is False
    for bad in (None, "", " ", S.NO_PLOT):
        assert not one(P.not_sentinel("t"), t=bad)
    assert one(P.not_sentinel("t"), t="x") is True
