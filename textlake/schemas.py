"""Declared schemas of the raw, corpus, vector and export tables."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "decimal(18,3)": T.DecimalType(18, 3),
    "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()),
}


def ddl(text: str) -> T.StructType:
    """``name type`` pairs separated by a comma and a space; needs no session."""
    pairs = [item.split(" ") for item in text.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


MOVIES = ddl(
    "imdb_title_id string, title string, year int, certificate string, genre string, runtime string, "
    "description string, IMDb_rating decimal(18,3), MetaScore decimal(18,3), ratingCount int, "
    "directors string, stars string"
)
PLOTS_A = ddl("imdb_title_id string, summary string, plot string")
PLOTS_B = ddl("title string, summary string, plot string, external_links string")
CORPUS = ddl(
    "source string, title string, year int, genre array<string>, runtime int, ratingCount int, plot string, "
    "summary string, imdb_rating float, directors array<string>, stars array<string>"
)
VECTORS = ddl(
    "title_id string, title string, year int, genres array<string>, rating double, plot string, "
    "embedding array<float>"
)
EXPORT = ddl(
    "id bigint, imdb_title_id string, title string, year int, genre string, runtime_min int, imdb_rating float, "
    "rating_count int, directors string, imdb_url string, created_at timestamp, updated_at timestamp"
)
IMPORT_LOG = ddl(
    "importer string, source_file string, source string, status string, started_at timestamp, "
    "finished_at timestamp, rows_inserted bigint, rows_updated bigint"
)

TITLE_BASICS = ddl(
    "tconst string, titleType string, primaryTitle string, originalTitle string, isAdult string, "
    "startYear string, endYear string, runtimeMinutes string, genres string"
)
TITLE_RATINGS = ddl("tconst string, averageRating float, numVotes int")
TITLE_CREW = ddl("tconst string, directors string, writers string")
NAME_BASICS = ddl(
    "nconst string, primaryName string, birthYear string, deathYear string, primaryProfession string, "
    "knownForTitles string"
)
