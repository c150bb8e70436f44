"""Every registered query of the subpackage against its SQL; the pipeline stage by stage."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests import oracle
from textlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf), oracle.duck(sf), queries.SQL[name]) is None


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert len({n.split("_")[0] for n in queries.QUERIES}) == 13


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns[: len(columns)] == columns
        assert len(rows) <= before or name in ("mixing", "bpe")
        before = len(rows)
    assert corpus_pipeline.run(spark, sf).count() == before
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["text"] == text[r["doc_id"]] and r["n_tokens"] == len(r["token_ids"]) for r in rows)


def test_the_log_of_op8_has_every_kind_of_event(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    log = queries.event_log(turns)
    kinds = {r["event"]: r["n"] for r in log.groupBy("event").count().withColumnRenamed("count", "n").collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) > 5
    # drafts that a regeneration took away are in the log and not in the result
    assert log.where("message < 0").count() > 5
    assert queries.chat.fold(log).count() == turns.count()


def test_pipeline_edge_rows(spark, sf, tmp_path):
    """NULLs, empty texts, repeated rows and columns with the stages' own names; and no rows at all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    good = docs.orderBy(queries.F.desc("n_chars")).first()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(None, good["text"] + " one more", "en", None, None), (9001, None, None, None, None), (9002, "", "en", "x", 0), (9003, " \n", "en", "x", 2)]
    rows += [(good["doc_id"], good["text"], good["lang"], good["source"], good["n_chars"])] * 3
    extra = {"row": 1, "seq": "s", "keep": None, "size": 2, "copies": "c", "n_tokens": -1, "whole": "w"}
    more = lambda df: df.withColumns({k: queries.F.lit(v).cast("string" if isinstance(v, str) or v is None else "int") for k, v in extra.items()})
    table = more(docs.select(*names).unionByName(spark.createDataFrame(rows, docs.select(*names).schema)))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(table.columns) | {"token_ids", "n_tokens"} == set(out.columns)
    got = out.collect()
    assert got and all(r["row"] == 1 and r["copies"] == "c" and r["n_tokens"] == len(r["token_ids"]) for r in got)
    # of the copies of the longest text, the near one included, at most one document is left, taken up to twice
    assert len({(r["doc_id"], r["text"]) for r in got if (r["text"] or "").startswith(good["text"])}) <= 1
    assert max(sum(r["doc_id"] == i for r in got) for i in {r["doc_id"] for r in got}) <= 2
    none = tmp_path / "none"
    table.limit(0).write.parquet(str(none / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(none / "labels.parquet"))
    empty = corpus_pipeline.run(spark, str(none))
    assert empty.collect() == [] and set(empty.columns) == set(out.columns)
