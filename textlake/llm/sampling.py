"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

The terms of a text are shingles of five words (lower-cased runs without ASCII white space; a text of one to four words
is one shingle), weighted by how often they occur. For register k and term t, a hash gives r and c of a Gamma(2, 1)
distribution and a uniform b. A term of weight S has q = floor(ln S / r + b) and ln a = ln c - r (q - b + 1); the register
keeps a hash of (term, q) of the least ln a. Two texts agree in a register with a probability equal to their
generalised Jaccard similarity, sum of min / sum of max of the weights.

A register's least a is exponential with the total weight W as its rate, so samples with a > 20 / W do not matter. Most
of them are ruled out before any logarithm: with u = e^-c and v = e^-r, products of uniforms, c >= 2 (1 - u) / (1 + u), and
a >= c v / S, for S = 1 even a >= c v / (v + (1 - b) (1 - v)). A register whose samples are all beyond (probability
e^-20) is left empty.

A text and its edited form are sampled together, as most of their terms are shared. Texts are shuffled once, by id
and hash; terms are counted and sampled where the text lies.

Defined results: a NULL text is empty; a text without words has the fingerprint '' and likeness 1.0 to another such text, 0.0
to others; documents are in descending order of id (NULL last), then of text hash; rows that repeat id and text follow
one another, so all but the last have a copy as their next document; a single row is its own next one; ids are integers;
other columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from textlake.llm.common import BLANK, written
from textlake.operators.merge import number_rows

SHINGLE = 5
REGISTERS = 64
FAR = 20.0  # samples beyond FAR / weight are not drawn out
PER_TASK = 8 << 20  # code points of text in a task: its terms are counted in about 30 times as many bytes, and spill beyond the memory it has
HOT_KEYS, LEAST_HOT = 10_000, 1000  # keys of a ten-thousandth of all rows, and of this many at least, shrink before they move
_HEX = 4  # digits of a register


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for a text without any."""
    plain = F.trim(F.regexp_replace(F.lower(text), BLANK + "+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _uniform(bits: Column, shift: int) -> Column:
    """Twenty-five of 64 bits as a number in (0, 1)."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND((1 << 25) - 1).cast("double") + 0.5) / float(1 << 25)


def counted(pairs: DataFrame, keys: list[str], size: int = SHINGLE) -> DataFrame:
    """``pairs`` (keys, left, right: word arrays) to one row per key and term: keys, n_left, n_right (numbers of words),
    term, s_left, s_right (how often the term occurs)."""
    both = pairs.select(*keys, F.size("left").alias("n_left"), F.size("right").alias("n_right"), F.concat("left", "right").alias("w"))
    each = both.select(*keys, "n_left", "n_right", "w", F.posexplode("w").alias("at", "word"))
    is_left = F.col("at") < F.col("n_left")
    end = F.when(is_left, F.col("n_left")).otherwise(F.col("n_left") + F.col("n_right"))
    first = (F.col("at") == 0) | (F.col("at") == F.col("n_left"))
    each = each.where((F.col("at") + size <= end) | first)
    later = [F.when(F.col("at") + k < end, F.get("w", F.col("at") + k)) for k in range(1, size)]
    terms = each.select(*keys, "n_left", "n_right", F.xxhash64("word", *later).alias("term"), is_left.cast("int").alias("is_left"))
    return terms.groupBy(*keys, "n_left", "n_right", "term").agg(F.sum("is_left").alias("s_left"), F.sum(1 - F.col("is_left")).alias("s_right"))


def sampled(terms: DataFrame, keys: list[str], registers: int = REGISTERS, size: int = SHINGLE) -> DataFrame:
    """The table of ``counted`` to keys, left, right: fingerprints as hexadecimal text.

    A sample is packed into a long: ln a in units of 2^-24 above, a hash of term and q below, so the least long is the
    least sample, and equal ones are told apart the same way everywhere.
    """
    total = lambda n: F.greatest(F.lit(1), F.col(n) - (size - 1)).cast("double")
    known = terms.select(*keys, "term", *[
        c
        for s, n in (("s_left", "n_left"), ("s_right", "n_right"))
        for c in ((FAR * F.col(s) / total(n)).alias("most" + s), F.log(F.col(s).cast("double")).alias("ln" + s), F.log(FAR / total(n)).alias("far" + s))
    ])
    known = known.withColumn("most", F.greatest("mosts_left", "mosts_right")).drop("mosts_left", "mosts_right")
    known = known.withColumn("once", F.when(F.greatest("lns_left", "lns_right") == 0, 1.0).otherwise(0.0))
    # each step refers to the one before more than once, so the steps stay apart and their code small
    drawn = known.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(registers)])))
    drawn = drawn.withColumn("h1", F.xxhash64("term", "k")).withColumn("h2", F.xxhash64("term", F.col("k") + registers))
    r1, r2, c1, c2 = _uniform(F.col("h1"), 0), _uniform(F.col("h1"), 32), _uniform(F.col("h2"), 0), _uniform(F.col("h2"), 32)
    beta = (F.shiftrightunsigned("h1", 25).bitwiseAND(127) * 128 + F.shiftrightunsigned("h1", 57) + 0.5) / 16384.0
    ec, er = c1 * c2, r1 * r2
    drawn = drawn.where(2.0 * (1.0 - ec) * er <= F.col("most") * (1.0 + ec) * (er + (1.0 - F.col("once") * beta) * (1.0 - er)))
    drawn = drawn.withColumn("beta", beta).withColumn("r", -F.log(r1 * r2)).withColumn("lc", F.log(-F.log(c1 * c2)))
    for s in ("s_left", "s_right"):  # a weight of 0 has no logarithm, and NULL goes on from there
        drawn = drawn.withColumn("q" + s, F.floor(F.col("ln" + s) / F.col("r") + F.col("beta")))
    for s in ("s_left", "s_right"):
        drawn = drawn.withColumn("la" + s, F.col("lc") - F.col("r") * (F.col("q" + s) - F.col("beta") + 1.0))

    def packed(s: str) -> Column:
        scaled = ((F.col("la" + s) + 80.0) * float(1 << 24)).cast("long")
        hashed = F.xxhash64("h2", "q" + s).bitwiseAND((1 << 32) - 1)
        return F.when(F.col("la" + s) <= F.col("far" + s), F.shiftleft(scaled, 32).bitwiseOR(hashed))

    least = drawn.select(*keys, "k", packed("s_left").alias("x"), packed("s_right").alias("y"))
    least = least.groupBy(*keys, "k").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    rows = least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("all"))

    def text(side: str) -> Column:
        """Registers in order; those without a sample are dashes."""
        cell = lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND((1 << 4 * _HEX) - 1))), _HEX, "0")
        found = F.filter("all", lambda v: v[side].isNotNull())
        by_place = F.map_from_entries(F.transform(found, lambda v: F.struct(v["k"], cell(v[side]))))
        placed = F.transform(F.sequence(F.lit(0), F.lit(registers - 1)), lambda k: F.coalesce(F.element_at(by_place, k), F.lit("-" * _HEX)))
        every = F.when(F.size(found) == registers, F.transform("all", lambda v: cell(v[side]))).otherwise(placed)
        return F.when(F.size(found) > 0, F.array_join(every, "")).otherwise(F.lit(""))

    return rows.select(*keys, text("x").alias("left"), text("y").alias("right"))


def likeness(a: Column, b: Column, registers: int = REGISTERS) -> Column:
    """The share of registers in which two fingerprints agree."""
    cells = lambda c: F.regexp_extract_all(c, F.lit("." * _HEX), F.lit(0))
    same = F.size(F.filter(F.zip_with(cells(a), cells(b), lambda x, y: x == y), lambda v: v)) / float(registers)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same)


def _distinct(rows: DataFrame, light: DataFrame, n_rows: int, most_copies: int) -> DataFrame:
    """One row for each id and text hash.

    Rows that repeat a key very often are aggregated before they move. Keys that hold a ten-thousandth of all rows
    are at most ten thousand, so their table can be broadcast.
    """
    bar = max(LEAST_HOT, math.ceil(n_rows / HOT_KEYS))
    if most_copies >= bar:
        hot = light.where(F.col("copies") >= bar).select("id", "h", F.lit(True).alias("hot"))
        rows = rows.join(F.broadcast(hot), ["id", "h"], "left")
        once = rows.where("hot").groupBy("id", "h").agg(F.first("text").alias("text"))
        rows = rows.where("hot IS NULL").drop("hot").unionByName(once)
    return rows


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", registers: int = REGISTERS, size: int = SHINGLE, per_task: int = PER_TASK) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next document.
    """
    key = ["id", "h"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    no_id = F.col(id_col).isNull()
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("id"), F.xxhash64(text, no_id).alias("h"), no_id.alias("no_id"), text.alias("text"))
    light = rows.groupBy(*key).agg(F.count("*").alias("copies"), F.first(F.char_length("text").cast("long")).alias("n"), F.first("no_id").alias("no_id"))
    light = written(light.withColumn("sort", F.struct("no_id", (-F.col("id")).alias("down"), "h")), "keys")
    total = light.agg(F.count("*").alias("keys"), F.sum("copies").alias("rows"), F.max("copies").alias("most"), F.sum(F.col("n") * F.col("copies")).alias("chars")).first()
    n_keys, most = total["keys"], total["most"] or 0
    n_parts = max(1, math.ceil((total["chars"] or 0) / per_task))
    # the order of all keys, by range sort; each key learns how much of its text the one before takes
    known = written(number_rows(light, "sort", 0, "place").select((F.col("place") - 1).alias("place"), *key, "copies", "n", "no_id"), "order")
    before = known.select(((F.col("place") + 1) % max(1, n_keys)).alias("place"), F.floor(F.col("n") / 3).cast("int").alias("want"), F.col("id").alias("for_id"), F.col("h").alias("for_h"))
    info = known.drop("no_id").join(before, "place").repartition(n_parts, *key)
    # texts move once, to where their key lies; beginnings move on to the key before
    own = _distinct(rows.drop("no_id"), light, total["rows"] or 0, most).repartition(n_parts, *key)
    if most > 1:
        own = own.groupBy(*key).agg(F.first("text").alias("text"))
    own = own.join(info, key)
    heads = own.select(F.col("for_id").alias("id"), F.col("for_h").alias("h"), F.substring("text", F.lit(1), F.col("want")).alias("head")).repartition(n_parts, *key)
    third = F.floor(F.col("n") / 3).cast("int")
    kept, begin = F.substring("text", F.lit(1), F.col("n").cast("int") - third), F.substring("text", F.lit(1), third)
    full = own.join(heads, key)
    # rows that repeat id and text: the last one goes on to the next document, the others to a copy
    form = F.when(F.col("copies") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    full = full.withColumn("form", F.explode(form)).withColumn("edited", F.concat(kept, F.when(F.col("form") == 0, F.col("head")).otherwise(begin)))
    keys = [*key, "form"]
    prints = sampled(counted(full.select(*keys, words(F.col("text")).alias("left"), words(F.col("edited")).alias("right")), keys, size), keys, registers, size)
    facts = full.select(*keys, "place", "copies", "n", F.sha2("edited", 256).alias("edited_sha256"))
    found = facts.join(prints, keys, "left").select(
        "place", "form", "copies", "n", "edited_sha256", F.coalesce("left", F.lit("")).alias("fingerprint"), F.coalesce("right", F.lit("")).alias("edited_fingerprint")
    )
    found = written(found, "fingerprints")
    after = found.where("form = 0").select(((F.col("place") - 1 + n_keys) % max(1, n_keys)).alias("place"), F.col("fingerprint").alias("next"))
    out = found.join(after, "place").join(known.select("place", F.when(~F.col("no_id"), F.col("id")).alias("doc_id")), "place")
    following = F.when(F.col("form") == 0, F.col("next")).otherwise(F.col("fingerprint"))
    times = F.when(F.col("form") == 0, F.lit(1)).otherwise(F.col("copies") - 1).cast("int")
    return out.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), registers).alias("near_edited"),
        likeness(F.col("fingerprint"), following, registers).alias("near_next"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")
