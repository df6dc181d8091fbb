from pyspark.sql import functions as F

from sensorspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, topic string, weight int, kept string"


def test_marginals_hold_after_raking(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(docs).withColumn("t", F.col("n_tokens") * F.col("probability") * F.col("weight"))
    total = out.agg(F.sum("n_tokens")).first()[0]
    for m in mixing.MARGINS:
        rows = out.groupBy(m).agg(F.sum("t").alias("t"), F.sum("n_tokens").alias("n")).collect()
        scale = sum(r.n**mixing.TEMPER for r in rows)
        assert all(abs(r.t / total - r.n**mixing.TEMPER / scale) < 1e-3 for r in rows)
    kept = out.where("kept").agg(F.sum(F.col("n_tokens") * F.col("weight"))).first()[0]
    assert abs(kept / total - 1) < 0.15
    assert mixing.weighted(docs).count() == out.where("kept").count()


def test_given_targets_and_edge_cases(spark):
    rows = [(1, "a b", "x", "en", "t", 1, ""), (2, None, "x", None, "t", 1, ""), (3, "", None, "de", "t", 1, ""), (4, "c d e", "y", "en", "t", 1, ""), (4, "c d e", "y", "en", "t", 1, ""), (None, "f", "y", "de", "t", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs).collect()
    assert len(out) == 6 and all(0 <= r.probability <= 1 for r in out)
    source = spark.createDataFrame([("x", 1.0)], "value string, share double")
    got = {r.doc_id: (r.probability, r.kept) for r in mixing.mix(docs, {"source": source}).collect()}
    assert got[4] == (0.0, False) and got[1] == (1.0, True)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [c for c in mixing.weighted(docs).columns if c != "weight"] == [c for c in docs.columns if c != "weight"]


def plain_raking(cells, targets, sweeps):
    fitted = [float(n) for *_, n in cells]
    total = sum(fitted)
    for _ in range(sweeps):
        for k, want in enumerate(targets):
            have = {}
            for cell, f in zip(cells, fitted):
                have[cell[k]] = have.get(cell[k], 0) + f
            fitted = [f * want[cell[k]] * total / have[cell[k]] for cell, f in zip(cells, fitted)]
    return fitted


def test_slow_raking_runs_to_its_end(spark, monkeypatch):
    cells = [("a", "x", "t", 1000), ("a", "y", "t", 1), ("b", "x", "t", 2), ("b", "y", "t", 1500)]
    shares = [{"a": 0.3, "b": 0.7}, {"x": 0.45, "y": 0.55}, {"t": 1.0}]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {m: spark.createDataFrame(list(s.items()), "value string, share double") for m, s in zip(mixing.MARGINS, shares)}
    got = {(r.source, r.lang): r.fitted for r in mixing.rake(df, targets).collect()}
    short, want = plain_raking(cells, shares, 14), plain_raking(cells, shares, 1000)
    assert any(abs(s - w) > 1e-3 * w for s, w in zip(short, want))  # 14 sweeps aren't enough
    assert all(abs(got[c[:2]] - w) < 1e-7 * w for c, w in zip(cells, want))
    monkeypatch.setattr(mixing, "FEW", 0)
    monkeypatch.setattr(mixing, "CLOSE", 0.01)
    assert all(abs(r.fitted / got[r.source, r.lang] - 1) < 0.1 for r in mixing.rake(df, targets).collect())


def test_contradicting_targets_are_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(mixing, "SWEEPS", 5)
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    table = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    targets = {"source": table({"a": 0.9, "b": 0.1}), "lang": table({"x": 0.5, "y": 0.5})}
    with pytest.raises(ValueError, match="hold together"):
        mixing.rake(cells, targets)
    with pytest.warns(UserWarning, match="hold together"):
        mixing.rake(cells, targets, strict=False)


def test_own_topics_and_tokens_are_used(spark):
    rows = [(1, "a b", "x", "en", "news", 30), (2, "c", "x", "en", "law", 10), (3, "d", "x", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string, tokens long")
    assert {r.doc_id: (r.topic, r.n_tokens) for r in mixing.mix(docs).collect()} == {1: ("news", 30), 2: ("law", 10), 3: ("?", 0)}


def test_no_column_clashes(spark):
    names = ["_r", "_p", "_n", "_id", "_w", "_topic", "_source", "_lang", "_row", "_kept", "weight"]
    df = spark.createDataFrame([(i, "some words here", "en", f"s{i % 3}", *range(7, 7 + len(names))) for i in range(60)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.weighted(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert [r[n] for n in names[:-1]] == list(range(7, 6 + len(names))) and r.weight >= 1
    assert sorted(map(tuple, mixing.mix(df).collect())) == sorted(map(tuple, mixing.mix(df.select("doc_id", "text", "lang", "source")).collect()))


def test_tokens_that_are_no_numbers_and_long_texts(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", "12"), (2, "a", "en", "s", "many"), (3, "a", "en", "s", None)], "doc_id long, text string, lang string, source string, tokens string")
    assert sorted((r.doc_id, r.n_tokens) for r in mixing.mix(df).collect()) == [(1, 12), (2, 0), (3, 0)]
    long = spark.createDataFrame([(1, "w " * 300_000, "en", "s"), (2, "w", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.n_tokens for r in mixing.mix(long).collect()} == {1: 300_000, 2: 1}
