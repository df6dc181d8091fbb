import random

import pytest

from sensorspark.llm import near_dedup

from . import brute

SCHEMA = "doc_id long, text string, label long, key string, rep int"


def rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table_matches_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert rows(near_dedup.near_duplicates(docs)) == brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block, size", [("BLOCK", 8), ("BLOCK_SHINGLES", 1500)])
def test_large_groups_are_dealt_out_in_blocks(spark, monkeypatch, block, size):
    monkeypatch.setattr(near_dedup, "KEY_BLOCK", 8)
    monkeypatch.setattr(near_dedup, block, size)
    r = random.Random(5)
    base = [f"w{r.randrange(999)}" for _ in range(150)]
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame([(*d, 1, "k", 2) for d in docs], SCHEMA)
    assert rows(near_dedup.near_duplicates(df)) == brute.near_duplicates(docs)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one"), (9, "a b c d e"), (7, "A b c\nd e"), (8, "É b c d e"), (10, "é b c d e"), (11, "x" * 100_000)]
    df = spark.createDataFrame([(*d, 1, "k", 2) for d in docs], SCHEMA)
    got = rows(near_dedup.near_duplicates(df))
    assert got == brute.near_duplicates(docs)
    assert got[5][1] == 4 and got[9][1] == 7 and got[10][1] == 10


def test_repeated_rows_null_ids_and_empty_tables(spark):
    same = "a b c d e f g h"
    df = spark.createDataFrame([(3, same, 0, "", 0), (3, same, 0, "", 0), (2, same, 0, "", 0), (3, "q r s t u", 0, "", 0), (5, "q r s t u", 0, "", 0), (None, same, 0, "", 0)], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (2, 2, True), (3, 2, False), (3, 2, False), (3, 2, False), (5, 2, False)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def shared(r, n, m, start):
    """Texts of n + m shingles each, the first n of them in both."""
    words = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    base = words(n + 4)
    return [(start + i, " ".join(base + words(m))) for i in range(2)]


def test_the_index_follows_the_percentage(spark):
    r = random.Random(8)
    for percent, n, m in ((80, 81, 9), (50, 60, 28)):  # likenesses of 0.82 and 0.52
        docs = [d for i in range(150) for d in shared(r, n, m, 2 * i)]
        df = spark.createDataFrame([(*d, 1, "k", 2) for d in docs], SCHEMA)
        got = rows(near_dedup.near_duplicates(df, percent=percent))
        assert got == brute.near_duplicates(docs, percent) and sum(not k for _, _, k in got.values()) == 150
    assert near_dedup.layout(85) == (9, 4, 17)
    for percent in (0, 30, 101):
        with pytest.raises(ValueError):
            near_dedup.near_duplicates(df, percent=percent)


def test_near_copies_from_80_per_cent_leave_one(spark):
    docs = [d for i in range(20) for d in shared(random.Random(i), 81, 9, 2 * i)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(df, percent=80).collect()) == list(range(0, 40, 2))


def test_every_pair_under_the_threshold_is_found(spark):
    import numpy as np

    n, size, errors = near_dedup.layout(85)
    r = np.random.default_rng(3)
    sigs, pairs = [], set()
    for i in range(300):
        a = r.integers(0, 1 << 16, n * size).astype(np.uint16)
        b = a.copy()
        # as many errors as allowed, two to a chunk for as long as they last: the worst place for the index; then one more
        bad = [c * size + k for k in r.permutation(size)[:2] for c in r.permutation(n)][: errors + (i % 3 == 0)]
        b[bad] += 1
        sigs += [(2 * i, a.tobytes()), (2 * i + 1, b.tobytes())]
        if i % 3:
            pairs.add((2 * i, 2 * i + 1))
    x = np.array([np.frombuffer(s, np.uint16) for _, s in sigs])
    every = {(i, j) for i in range(len(x)) for j in np.flatnonzero((x != x[i]).sum(axis=1) <= errors) if i < j}
    assert every == pairs
    df = spark.createDataFrame([(i, bytearray(s)) for i, s in sigs], "doc_id long, sig binary")
    assert {tuple(sorted(e)) for e in near_dedup.candidates(df, n, size, errors).collect()} == pairs


def test_a_large_group_of_near_copies_is_not_squared(spark):
    import numpy as np

    n, size, errors = near_dedup.layout(85)
    r = np.random.default_rng(4)
    base, many = r.integers(0, 1 << 16, n * size).astype(np.uint16), 50_000
    x = np.tile(base, (many, 1))
    x[np.arange(many)[:, None], r.integers(0, n * size, (many, 3))] = r.integers(0, 1 << 16, (many, 3))
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(x)], "doc_id long, sig binary")
    edges = near_dedup.candidates(df, n, size, errors)
    root = list(range(many))

    def find(a):
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    for a, b in edges.collect():
        root[find(a)] = find(b)
    assert len({find(i) for i in range(many)}) == 1


def test_pages_of_a_template_send_few_sets(spark, monkeypatch):
    """1,500 texts that share 104 of 145 words: one cluster by 36 values, hardly a set to compare by 256; planted near copies among them are found."""
    import random

    r = random.Random(3)
    head = " ".join(f"house{i}" for i in range(104))
    docs = [(i, head + " " + " ".join(f"w{r.randrange(10**7)}" for _ in range(41))) for i in range(1_500)]
    docs += [(2_000 + i, docs[i][1] + " end") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sent, plain = [], near_dedup._linked
    monkeypatch.setattr(near_dedup, "_in_blocks", lambda d, b, f=near_dedup._in_blocks: sent.append(d) or f(d, b))
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df).collect()}
    assert got == {i: i - 2_000 if i >= 2_000 else i for i, _ in docs} and plain is near_dedup._linked
    (sets,) = [d for d in sent if "shingles" in d.columns]
    assert sets.count() <= 15 + 2 * 5


def test_parted_clusters_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(docs)


def test_rows_of_unordered_types_are_kept_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f", {"k": 1}), (1, "a b c d e f", {"k": 2}), (2, "other words here now", None)], "doc_id long, text string, m map<string,int>")
    assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(df).collect()) == [1, 2]
