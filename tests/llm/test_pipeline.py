"""The pipeline's stages against plain Python, and its queries' SQL."""

from pathlib import Path

import duckdb

import corpus_pipeline
from brookline.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def test_names():
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_exact_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.queries()["op5_exact_dedup"](spark, SF)
    want = con.execute(queries.oracle_sql()["op5_exact_dedup"]).fetchall()
    assert sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == sorted(want)


def test_workers_hold_nothing_of_earlier_stages(spark, monkeypatch):
    """What a network or a tokenizer left in a worker goes before near copies are searched there, and no stage of that search has two functions in Python."""
    from brookline.llm import common, near_copies

    functions, plans = [], []
    frame = type(spark.range(0))
    of = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a: functions.append(f) or plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or of(self, f, *a))
    kept = near_copies.one_of_each(spark.read.parquet(f"{SF}/documents.parquet"))
    assert kept.count() and len(functions) >= 4
    assert not [p for p in plans if "MapInArrow" in p.split("Aggregate")[0].split("Repartition")[0]]
    for f in functions:
        common.kept_in_worker("of another stage", list)
        list(f(iter([])))
        assert not common._kept
    assert common.kept_in_worker("a", list) is common.kept_in_worker("a", list)
    common.nothing_kept()


def test_stages(spark):
    from tests.llm.test_operators import jaccard_representatives

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == columns
    some = kept.limit(150).cache()
    one = corpus_pipeline.drop_near_duplicates(spark, some, SF)
    rows = sorted((r["doc_id"], r["text"]) for r in some.collect())
    assert one.columns == columns
    assert {r["doc_id"] for r in one.collect()} == {rows[k][0] for k in jaccard_representatives([t for _, t in rows])}
    twice = some.unionByName(some)
    assert corpus_pipeline.drop_near_duplicates(spark, twice, SF).count() == one.count()
    clean = corpus_pipeline.drop_benchmark_leaks(spark, some, SF)
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} <= {i for i, _ in rows}
    mixed = corpus_pipeline.mix_sources(spark, some, SF)
    assert mixed.columns == columns
    tokens = corpus_pipeline.write_tokens(spark, mixed, SF)
    assert tokens.count() == mixed.count()
    assert toxicity.WINDOW > toxicity.STEP
    assert Path(SF).exists()
