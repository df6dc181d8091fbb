import random

import numpy as np

from sensorspark.llm import suffix_dedup

from . import brute

SCHEMA = "doc_id long, text string, part int, h1 long"


def rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def check(spark, docs):
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], SCHEMA)
    got, want = rows(suffix_dedup.remove_repeats(df)), brute.repeats(docs)
    assert {i for i in want if got[i] != want[i]} == set()


def test_whole_table_matches_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert rows(suffix_dedup.remove_repeats(docs)) == brute.repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_nested_and_shifted_repeats(spark):
    r = random.Random(3)
    letters = "abcdefghij é"
    stuff = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [stuff(r.choice([99, 100, 101, 130, 300])) for _ in range(12)]
    docs = []
    for i in range(80):
        text = ""
        for _ in range(r.randrange(5)):
            p = r.choice(passages)
            a, b = sorted((r.randrange(len(p) // 3 + 1), len(p) - r.randrange(len(p) // 3 + 1)))
            text += stuff(r.randrange(60)) + p[a:b]
        docs.append((i, text + stuff(r.randrange(40))))
    check(spark, docs)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "x" * 5000), (4, "x" * 150), (5, "x" * 99), (6, "ab" * 400), (7, "y" * 99 + "é"), (8, "é" + "y" * 99), (9, "x" * 150), (10, "é" * 50), (11, "é" * 50)]
    docs += [(20 + i, "q" * i + "common passage " * 9 + str(i) * 30) for i in range(40)]
    check(spark, docs)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    t = "".join(f"word{i} " for i in range(40))
    df = spark.createDataFrame([(5, t, 0, 0), (5, t, 0, 0), (None, t, 0, 0), (3, "z" + t, 0, 0)], SCHEMA)
    got = sorted((r.doc_id or -1, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(-1, len(t), 1), (3, 0, 0), (5, len(t), 1), (5, len(t), 1)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_interval_tree_lists_every_group_of_suffixes():
    r = np.random.default_rng(1)
    for _ in range(50):
        words = sorted("".join(r.choice(list("ab"), 6)) for _ in range(9))
        common = [next((k for k in range(7) if a[:k] != b[:k]), 7) - 1 for a, b in zip(words, words[1:])]
        got = {(i, j, n) for i, j, n, _ in suffix_dedup.intervals(common) if n}
        want = set()
        for n in range(1, 7):
            for w in {x[:n] for x in words}:
                at = [k for k, x in enumerate(words) if x.startswith(w)]
                if len(at) > 1 and min(common[at[0] : at[-1]]) == n:
                    want.add((at[0], at[-1], n))
        assert got == want
