"""The pipeline and the queries over the smallest tables, stage by stage."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from compare import difference
from labelscape.llm import catalog, packing, secrets, signature_tree
from labelscape.llm.common import table, written
from tests.llm.test_secrets import base
from tests.llm.test_signature_tree import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    assert difference(catalog.QUERIES[name](spark, FOLDER).toPandas(), db.execute(catalog.ORACLES[name]).df()) is None


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES) == list(range(1, 14))


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    kept = written(corpus_pipeline.without_toxic(spark, docs, FOLDER))
    toxic = {r["doc_id"] for r in table(spark, FOLDER, "labels").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in table(spark, FOLDER, "labels").where("toxic = 0").collect()}
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and len(clean & left) >= 0.9 * len(clean)
    assert len(toxic & left) <= 0.5 * len(toxic)  # some seventy labels to learn from

    single = written(corpus_pipeline.without_near_copies(spark, kept, FOLDER))
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c[2] for c in brute(texts, 80, 5)})

    hidden = written(corpus_pipeline.without_secrets(spark, single, FOLDER))
    assert hidden.columns == docs.columns and hidden.count() == single.count()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in hidden.collect():
        assert not [s for s in base(r["text"]) if s] and r["n_chars"] == len(r["text"])
        if not base(before[r["doc_id"]]) and r["text"] != before[r["doc_id"]]:
            assert secrets.secret_spans(single.where(f"doc_id = {r['doc_id']}")).head()["spans"]

    packed = corpus_pipeline.packed(spark, hidden, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in hidden.collect()}
    assert packing.END == 1 and signature_tree.BLOCK > 1


def test_clashing_columns_pass_all_stages(spark, tmp_path):
    """Columns with the names that stages use inside, and names that need quoting, come through every stage but the last."""
    from pyspark.sql import functions as F
    for name in ("documents", "labels"):
        found = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        if name == "documents":
            inner = F.struct(F.lit(1).alias("a b"), F.lit("x").alias("c.d"))
            found = found.limit(120).withColumns({c: F.lit(c) for c in ("toxicity", "gaps", "f_gaps", "found", "f_row_key", "row_hash", "component_id", "x y")}).withColumn(
                "odd", inner).unionByName(found.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")), allowMissingColumns=True)
        found.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, str(tmp_path)))
        assert out.schema.names == docs.schema.names and out.count() > 60
        docs = out
    assert docs.where("odd is not null").select(F.col("odd.`a b`")).distinct().collect() == [(1,)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
