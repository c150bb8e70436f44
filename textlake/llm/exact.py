"""Exact duplicates through content-defined chunk recipes, with DataFrame functions only.

A text is normalised (ASCII white space deleted) and cut where its content says so: after at least ``least``
characters at the next ``CUT`` match, or after ``most``. Its recipe is the ordered list of its chunks' hashes. Texts
of equal length, chunk count and recipe hash are candidates. Only candidates' chunks are
compared, and a chunk leaves a task once: chunks that differ under one hash get different numbers, so an identifier
(hash, number) stands for one chunk text. Two texts are equal exactly if their ordered identifier lists
are; the lists, not the texts, are grouped. The group's digest then attaches the outcome to its rows.

Defined results: a NULL text counts as empty, and empty texts equal each other and texts of white space only; of
equal texts the one with the most code points stays, then the smallest id (a NULL id last); of rows that tie in all of
this, one stays; ``keep_id`` is the id of the row that stays; other columns of the input, whatever their names, are
kept by ``drop_duplicates``; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlake.llm.common import BLANK, join_small, written

LEAST, MOST = 256, 2048
CUT = r"[.!?,;:0-9\x{3001}\x{3002}]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", "")


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a normalised text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?{CUT}|.{{1,{most}}}"), F.lit(0))


def hashed(chunk: Column, bits: int = 64) -> Column:
    """The chunk hash; fewer ``bits`` make collisions, for tests."""
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


KEY = ["size", "n_chunks", "recipe_hash"]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The narrow table of all rows, and one row for each group of two or more: recipe_hash, text_sha256, group_size, keep.

    The first scan writes identifier lists and no texts. Its shared keys go back to the texts as a semi-join on the
    key, which is computed from the text again, so texts of unique documents stay in their scan. Copies shrink to one
    row per task before every shuffle by content.
    """
    cut = _cut(docs, id_col, text_col, bits)
    light = written(cut.drop("text").withColumn("row", F.monotonically_increasing_id()), "recipes")
    shared = written(light.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY), "shared")
    marks = numbers(join_small(cut, shared, KEY, "left_semi", 1_000_000), bits)
    lists = light.select(*KEY, "recipe", "text_sha256", "doc_id", "row", "n_chars")
    if marks is None:
        lists = lists.withColumn("marks", F.lit(None).cast("array<struct<pos:int,number:int>>"))
    else:
        lists = lists.join(marks, "text_sha256", "left")
    same = lists.groupBy(*KEY, "recipe", "marks").agg(
        F.count("*").alias("group_size"),
        F.min_by(F.struct("doc_id", "row", "n_chars"), F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("keep"),
        F.min("text_sha256").alias("text_sha256"),
    )
    return light, same.where("group_size > 1").select("recipe_hash", "text_sha256", "group_size", "keep")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    light, same = groups(docs, id_col, text_col, bits)
    out = light.drop("recipe", "size", "n_chunks").join(same, ["recipe_hash", "text_sha256"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns it came with.

    Rows outside every group are passed on from their scan. A group's rows that carry the id and length of the one
    that stays shrink to one by aggregation, so repeated rows leave one row each.
    """
    _, same = groups(docs, id_col, text_col)
    same = written(same.select("text_sha256", F.struct("keep.doc_id", "keep.n_chars").alias("keep")), "groups")
    whole = docs.select(
        F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"),
        F.struct(F.col(id_col).alias("id"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars")).alias("own"),
        F.struct("*").alias("whole"),
    )
    met = join_small(whole, same, ["text_sha256"], "left", 1_000_000)
    alone = met.where(F.col("keep").isNull()).select("whole")
    stays = F.col("own.id").eqNullSafe(F.col("keep.doc_id")) & (F.col("own.n_chars") == F.col("keep.n_chars"))
    first = met.where(stays).groupBy("text_sha256").agg(F.min_by("whole", F.col("whole")[text_col]).alias("whole")).select("whole")
    return alone.unionByName(first).select("whole.*")


def _cut(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    text = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"),
        normalised(F.col(text_col)).alias("text"),
    )
    return text.withColumn("recipe", F.transform(chunks(F.col("text")), lambda c: hashed(c, bits))).withColumns(
        {
            "size": F.char_length("text"),
            "n_chunks": F.size("recipe"),
            "recipe_hash": F.xxhash64("recipe"),
            "text_sha256": F.sha2("text", 256),
        }
    )


def numbers(candidates: DataFrame, bits: int = 64) -> DataFrame | None:
    """For texts with chunks whose hash stands for several chunk texts: (pos, number) of those chunks; None without any.

    Every distinct chunk of the candidates is compared in full with the others of its hash. A hash without a mark
    stands for one chunk text (number 0), so equal lists mean equal texts.
    """
    pieces = candidates.select("text_sha256", F.posexplode(chunks(F.col("text"))).alias("pos", "chunk")).withColumn("hash", hashed(F.col("chunk"), bits))
    different = pieces.groupBy("hash", "chunk").agg(F.count("*").alias("n"))
    clash = written(different.groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash"), "clash")
    if clash.isEmpty():
        return None
    odd = pieces.join(clash, "hash")
    number = odd.groupBy("hash", "chunk").agg(F.count("*").alias("n")).select(
        "hash", "chunk", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")).alias("number")
    )
    found = odd.join(number, ["hash", "chunk"]).select("text_sha256", F.struct("pos", "number").alias("mark"))
    return found.groupBy("text_sha256").agg(F.sort_array(F.collect_set("mark")).alias("marks"))

