"""Every stage of the pipeline on all that its predecessor kept, against DuckDB and plain patterns."""

import random

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from notewell.llm import oracles, secrets
from tests.llm.test_queries import secret_model

DATA = "/root/testdata/sf0.001"
KEPT = {
    "quality_rules": f"SELECT doc_id FROM ({oracles.OP2_REPETITION}) WHERE kept",
    "near_duplicates": f"SELECT doc_id FROM ({oracles.OP3_JACCARD}) WHERE doc_id = component_id",
    "decontamination": f"SELECT doc_id FROM ({oracles.OP7_DECONTAMINATE}) WHERE NOT contaminated",
    "secret_scan": "SELECT doc_id FROM documents",
    "target_mix": f"SELECT doc_id FROM ({oracles.OP4_MIXING})",
}


def test_each_stage_on_what_is_left(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    # the smallest table holds no secrets
    planted = F.concat("text", F.lit(" password = hunter"), F.col("doc_id").cast("string"), F.lit("tail and more"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("text", F.when(F.col("doc_id") % 7 == 0, planted).otherwise(F.col("text")))
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == list(KEPT)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toArrow()
        duck.register("documents", before)
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in duck.execute(KEPT[name]).fetchall()), name
        assert name == "target_mix" or docs.columns == columns
        if name == "secret_scan":
            held = dict(zip(before["doc_id"].to_pylist(), before["text"].to_pylist(), strict=True))
            assert any(secrets.PLACEHOLDER in (r.text or "") for r in rows)
            for r in rows:
                assert not secret_model(r.text or "") and (secrets.PLACEHOLDER in (r.text or "") or r.text == held[r.doc_id])


def test_stages_on_awkward_and_empty_tables(spark, awkward, nothing, tmp_path):
    prose = [" ".join(f"w{k}x{j}" for j in range(80)) for k in range(3)]
    more = spark.createDataFrame([(50, prose[0], None, None, 1, "a"), (50, prose[0], None, None, 1, "a"), (51, prose[1], "en", None, None, None), (None, prose[2], "en", "s", 1, "b")], awkward.schema)
    for kind, docs in (("awkward", awkward.unionByName(more)), ("nothing", nothing)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{kind}/{name}")
            before, docs = docs, spark.read.parquet(f"{tmp_path}/{kind}/{name}")
            assert docs.count() <= before.count() and (name == "target_mix" or docs.columns == awkward.columns)
            if kind == "awkward" and name == "near_duplicates":
                assert sorted((r.doc_id or 0) for r in docs.collect() if r.text in prose) == [0, 50, 51]
        assert docs.count() == (0 if kind == "nothing" else docs.count())


def test_secret_scan_learns_from_every_value(spark):
    rng = random.Random(36)
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    # 22 symbols come up among values of one share only
    values = [code(20) for _ in range(300)] + [v for v in (code(22) for _ in range(200)) if secrets.is_held(v.encode())][:8]
    words = "ordinary words stand around everything written here."
    rows = [(k, f"{words} token={v}") for k, v in enumerate(values)] + [(1_000, f"{words} {code(22)} more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, docs, DATA).collect()}
    assert got[1_000] == f"{words} [SECRET] more" and len(got) == len(rows)
