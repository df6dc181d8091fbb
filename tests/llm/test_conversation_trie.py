import hashlib
import random
import re
import zlib

import pytest

from sensorspark.llm import conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string, ids string, path int"


def turn_key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), turn_key(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    seqs = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = {}
    for c, t in seqs.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = {}
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaf = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k))))
        saved = sum((len(members[x]) - 1) * len([w for w in re.split(r"[\x20\x09-\x0D]+", x[-1][1]) if w]) for x in below if x)
        children = sum(len(x) == len(k) + 1 for x in below)
        row = (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest())
        out[k] = row
    return sorted(map(str, out.values()))


def check(spark, rows, limit):
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA)
    got = conversation_trie.nodes(conversation_trie.rebuilt(df), limit).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def conversations(r, n, shared):
    rows = []
    for c in range(n):
        length = r.randrange(1, 9)
        start = [("user", f"t {i}") for i in range(shared)] if r.random() < 0.6 else []
        for i, (role, text) in enumerate((start + [(r.choice(["user", "bot"]), r.choice(["a b", "c", "d  e\n"])) for _ in range(length)])[: max(1, length)] if r.random() < 0.8 else start + [("user", "same")]):
            rows.append((c * r.choice([1, 1, -1]) if c % 7 else c, i, role, text))
    return rows


@pytest.mark.parametrize("limit", [1, 3, 20, 10_000])
def test_random_conversations_match_brute_force(spark, limit):
    r = random.Random(limit)
    rows = conversations(r, 90, 12)
    r.shuffle(rows)
    check(spark, rows, limit)


def test_copies_in_crowds_and_deep_chains(spark):
    """A third of all conversations are equal, and one shared path is deep: both are burst, and digests go through pieces."""
    rows = [(c, i, "user", f"x{i}") for c in range(0, 300, 20) for i in range(40)] + [(c, i, "user", f"x{i}") for c in range(1, 60) for i in range(c % 41)]
    check(spark, rows, 4)


def test_pieces_are_joined(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    check(spark, [(c, i, "user", "x") for c in range(0, 800, 20) for i in range(2)], 2)


def test_edge_cases(spark):
    rows = [(0, None, None, None), (0, 1, "user", ""), (0, 1, "", "user"), (0, 1, "user", ""), (None, 1, "user", "gone"), (25, 0, "user", "base is absent"), (3, 0, "a", "b"), (-7, None, None, "w " * 40_000), (21, 5, None, "x"), (21, 5, None, "x")]
    check(spark, rows, 256)
    check(spark, rows, 1)
    check(spark, [], 256)
