import hashlib
import random

import numpy as np
import pyarrow as pa

from sensorspark.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, block int, halo string"


def brute(docs):
    """From (id, text), ids distinct or texts equal: the contract's columns but for likeness."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    out = []
    for i, (a, t) in enumerate(docs):
        t, after = t or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((a, len(t), hashlib.sha256(edited.encode()).hexdigest(), edited))
    return out


def check(spark, docs):
    df = spark.createDataFrame([(*d, 1, "h") for d in docs], SCHEMA)
    got = sorted(((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in fp.edited_neighbours(df).collect()))
    assert got == sorted((a or -1, n, h) for a, n, h, _ in brute(docs))


def test_whole_table(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    docs = {r.doc_id: r.text for r in df.collect()}
    rows = fp.edited_neighbours(df).collect()
    want = {a: (n, h, e) for a, n, h, e in brute(docs.items())}
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == {a: w[:2] for a, w in want.items()}
    assert len({r.fingerprint for r in rows}) == len(set(docs.values()))
    assert all((r.fingerprint == r.edited_fingerprint) == (docs[r.doc_id] == want[r.doc_id][2]) for r in rows)
    plain = {r.doc_id: r.fingerprint for r in fp.fingerprints(df).collect()}
    assert plain == {r.doc_id: r.fingerprint for r in rows}
    long = [r for r in rows if r.n_chars > 600]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.98 and all(0 <= r.near_next <= 1 for r in rows)


def test_edge_cases(spark):
    check(spark, [(1, None), (2, ""), (3, "a\n"), (4, "\n"), (5, "\n\nb\n"), (6, "é" * 30_001), (9, "x y"), (100, "z\n" * 500), (None, "no id")])
    check(spark, [(7, "alone é")])
    check(spark, [(7, "same"), (7, "same"), (7, "same"), (3, "other\n")])
    empty = spark.createDataFrame([], SCHEMA)
    assert fp.edited_neighbours(empty).count() == 0 and fp.fingerprints(empty).count() == 0


def test_order_insertion_and_deletion():
    one = lambda t: fp.to_text(*fp.vectors(pa.array([t])))[0]
    a, b, c = "first line here", "second line is longer than it", "é"
    assert one(f"{a}\n{b}\n{c}") == one(f"{c}\n{a}\n{b}") != one(f"{a}\n{b}")
    assert fp.insert(one(f"{a}\n{b}"), c) == one(f"{a}\n{c}\n{b}")
    assert fp.delete(one(f"{a}\n{b}"), a) == one(b)
    assert one(f"{a}\n{a}") != one(a) and one("x\n") != one("x") and one("\n") != one("")


def test_results_dont_depend_on_the_run_of_rows(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("ab \né") for _ in range(r.randrange(60))) for _ in range(200)]
    whole = fp.to_text(*fp.vectors(pa.array(texts)))
    assert whole == [fp.to_text(*fp.vectors(pa.array([t])))[0] for t in texts]


def test_likeness_estimates_shared_words():
    r = random.Random(2)
    w = [f"w{r.randrange(10**6)}" for _ in range(4000)]
    v = fp.vectors(pa.array([" ".join(w), " ".join(w[:3000] + w[:1000][::-1]), " ".join(w[::-1])]))
    pair = lambda i: fp.likeness((v[0][:1], v[1][:1]), (v[0][i : i + 1], v[1][i : i + 1]))[0]
    assert pair(0) == 1 and 0.6 < pair(1) < 0.9 and pair(2) < 0.3


def test_the_empty_paragraph_is_a_member():
    one = lambda t: fp.to_text(*fp.vectors(pa.array([t])))[0]
    assert fp.insert(one("a b c"), "") == one("a b c\n") == one("\na b c")
    assert fp.delete(one("a b c\n\n"), "") == one("a b c\n")
    assert fp.delete(fp.insert(one("x"), ""), "") == one("x")


def test_ranges_are_found_by_halving(spark):
    from pyspark.sql import functions as F

    for bounds in ([], [5], [1, 2, 3], list(range(0, 9_000, 3))):
        df = spark.range(-3, 9_010, 7).withColumn("n", fp._search(bounds, F.col("id")))
        assert all(r.n == sum(b <= r.id for b in bounds) for r in df.where("id < 200 OR id > 8900").collect())
