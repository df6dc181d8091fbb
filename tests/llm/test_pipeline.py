from pyspark.sql import functions as F

import corpus_pipeline
from sensorspark.llm import mixing, near_dedup, token_files

from . import brute
from .test_token_files import brute as token_rows


def test_stages_take_effect(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    kept, stages = docs, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontamination", "mixing", "token_files"]
    good = stages["quality"](spark, docs, tiny).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    kept = stages["near_dedup"](spark, good, tiny).cache()
    want = brute.near_duplicates([(r.doc_id, r.text) for r in good.collect()], percent=80)  # no contract binds a stage: the general 0.8 holds
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, _, k) in want.items() if k}
    clean = stages["decontamination"](spark, kept, tiny).cache()
    want = brute.contamination([(r.doc_id, r.text) for r in kept.collect()], items)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _, hit, _ in want if not hit)
    mixed = stages["mixing"](spark, clean, tiny).cache()
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in mixing.mix(clean).collect() if r.kept)
    last = [tuple(r) for r in stages["token_files"](spark, mixed, tiny).orderBy("start").collect()]
    assert last == token_rows([(r.doc_id, r.text) for r in mixed.collect()])
    assert [tuple(r) for r in corpus_pipeline.run(spark, tiny).orderBy("start").collect()] == last


def test_repeated_rows_leave_one(spark):
    t = "a b c d e f g"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (3, None), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in near_dedup.drop_near_duplicates(df).collect()) == [0, 1, 3]


def test_the_mixing_stage_has_the_raked_shares(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "").cache()
    given = docs.withColumns({"topic": mixing.topic(F.col("text")), "n": mixing.tokens(F.col("text"))}).cache()
    made = out.withColumns({"topic": mixing.topic(F.col("text")), "n": mixing.tokens(F.col("text"))})
    for m in mixing.MARGINS:
        want = {r[0]: r.n**mixing.TEMPER for r in given.groupBy(m).agg(F.sum("n").alias("n")).collect()}
        rows = made.groupBy(m).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("w")).collect()
        all_w, all_n, all_t = sum(r.w for r in rows), sum(r.n for r in rows), sum(want.values())
        for r in rows:
            print(m, r[0], f"target {want[r[0]] / all_t:.4f} weighted {r.w / all_w:.4f} unweighted {r.n / all_n:.4f}")
            assert abs(r.w / all_w - want[r[0]] / all_t) < 0.01
    path = f"file://{tmp_path}/x.orc"
    some = out.orderBy("doc_id").limit(50).cache()
    token_files.write(some, path)
    assert sorted((r.doc_id, r.weight) for r in token_files.read(spark, path, weighted=True).collect()) == sorted((r.doc_id, r.weight) for r in some.collect())


def test_null_empty_and_repeated_documents_go_through_all_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    odd = [(9_000_001, None, None, None), (9_000_002, "", "en", "web"), (9_000_003, " \n ", "en", None), (None, "a text without an id and with some words in it", "en", "web"), (9_000_004, "word " * 60_000, "en", "web")]
    extra = spark.createDataFrame([(*o, None) for o in odd + odd[:2]], "doc_id long, text string, lang string, source string, n_chars long").selectExpr(*[f"cast({c} AS {t}) AS {c}" for c, t in kinds.items()])
    rows = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = stage(spark, rows, tiny)
        if name != "token_files":
            assert rows.columns[: len(docs.columns)] == docs.columns
            kept = {r.doc_id for r in rows.select("doc_id").collect()}
            assert kept <= {r.doc_id for r in before.select("doc_id").collect()}
    last = rows.collect()
    assert sorted(str(r.doc_id) for r in last) == sorted(str(r.doc_id) for r in before.select("doc_id").collect())
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        empty = stage(spark, empty, tiny)
        assert empty.count() == 0


def test_no_stage_leaves_texts_to_batches_of_the_sessions_size(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, tiny)
        assert "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString(), name
