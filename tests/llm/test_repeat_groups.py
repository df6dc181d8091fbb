import random

import numpy as np
import pytest

from sensorspark.llm import repeat_groups, suffix_dedup

SCHEMA = "doc_id long, text string, group_id int, start string"


def brute(docs, length=100):
    """Groups as sets of (n_bytes, frozenset of (doc, start)): classes of equal strings, chained while the next one's places are moved by one."""
    classes = {}
    for i, text in sorted(set(docs)):
        b = (text or "").encode()
        for j in range(len(b) - length + 1):
            classes.setdefault(b[j : j + length], []).append((i, j))
    places = {c[0]: c for c in classes.values() if len(c) > 1}
    moved = lambda c, k: [(i, j + k) for i, j in c]
    out = set()
    for (i, j), c in places.items():
        before = places.get((i, j - 1))
        if before and moved(before, 1) == c:
            continue
        n = 1
        while places.get((i, j + n)) == moved(c, n):
            n += 1
        out.add((length + n - 1, frozenset(c)))
    return out


def found(df):
    groups = {}
    for r in df.collect():
        groups.setdefault((r.group_id, r.n_occurrences, r.n_bytes), []).append((r.doc_id, r.start, r.first))
    for (_, n, _), at in groups.items():
        assert len(at) == n == len(set(at)) and [x[:2] for x in at if x[2]] == [min(x[:2] for x in at)]
    return [(size, frozenset(x[:2] for x in at)) for (_, _, size), at in groups.items()]


def check(spark, docs):
    got = found(repeat_groups.repeat_groups(spark.createDataFrame([(*d, 1, "s") for d in docs], SCHEMA)))
    want = brute(docs)
    assert len(got) == len(set(got)) and set(got) == want and want
    return want


def passages(seed, n):
    r = random.Random(seed)
    stuff = lambda k: "".join(r.choice("abcdefghij é") for _ in range(k))
    known = [stuff(r.choice([100, 130, 200, 300, 450])) for _ in range(10)]
    docs = []
    for i in range(n):
        text = ""
        for _ in range(r.randrange(5)):
            p = r.choice(known)
            a, b = sorted((r.randrange(len(p) // 3 + 1), len(p) - r.randrange(len(p) // 3 + 1)))
            text += stuff(r.randrange(60)) + p[a:b]
        docs.append((i, text + stuff(r.randrange(40))))
    return docs


@pytest.mark.parametrize("seed", [3, 4])
def test_groups_match_brute_force(spark, seed):
    check(spark, passages(seed, 60))


def test_copies_periods_and_short_texts(spark):
    docs = [(1, None), (2, ""), (3, "x" * 700), (4, "x" * 150), (5, "x" * 99), (6, "ab" * 150), (7, "y" * 99 + "é"), (8, "é" + "y" * 99), (9, "x" * 150), (10, "é" * 50), (11, "é" * 50)]
    text = "".join(f"word {i} " for i in range(60))
    docs += [(20 + i, text) for i in range(30)] + [(60 + i, "q" * i + "common passage " * 9 + str(i) * 30) for i in range(20)] + [(90, text), (90, text)]
    assert (len(text), frozenset((i, 0) for i in [*range(20, 50), 90])) in check(spark, docs)


def test_groups_tell_what_is_removed(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    gone = {}
    for r in repeat_groups.repeat_groups(docs).where("NOT first").collect():
        gone.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_bytes))
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).where("n_removed > 0").collect()}
    assert removed and {i: len(x) for i, x in gone.items()} == removed


def test_null_ids_and_empty_tables(spark):
    t = "".join(f"word{i} " for i in range(40))
    df = spark.createDataFrame([(5, t), (None, "z" + t), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.start, r.first, r.n_occurrences, r.n_bytes) for r in repeat_groups.repeat_groups(df).collect())
    assert got == [(0, 1, False, 2, len(t)), (5, 0, True, 2, len(t))]
    assert repeat_groups.repeat_groups(df.limit(0)).count() == 0


def test_chosen_keeps_the_strings_that_choose_the_anchor():
    r = np.random.default_rng(5)
    d = r.integers(97, 101, 900, dtype=np.uint8)
    at, _ = suffix_dedup.anchors(d)
    seen = []
    for p in at:
        index = p + np.arange(-suffix_dedup.LEFT, suffix_dedup.LENGTH)
        around = np.where((index >= 0) & (index < len(d)), d[np.clip(index, 0, len(d) - 1)], suffix_dedup.PAD)
        kept = np.flatnonzero(repeat_groups.chosen(around[None].astype(np.uint8))[0] != suffix_dedup.PAD) + p - suffix_dedup.LEFT
        seen += range(kept.min(), kept.max() - suffix_dedup.LENGTH + 2)
    assert sorted(seen) == list(range(900 - suffix_dedup.LENGTH + 1))


def test_parts_grow_with_the_text(spark, monkeypatch):
    docs = passages(6, 40)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert suffix_dedup.parts_for(df) == -(-sum(len(t.encode()) for _, t in docs) // 400) > 16
    assert set(found(repeat_groups.repeat_groups(df))) == brute(docs)
