import random
import re

from sensorspark.llm import license_scan as scan

SCHEMA = "doc_id long, text string, places int, score string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def base(text):
    """n_words, n_base, first, last, labels by plain search."""
    w, at = words(text), []
    for phrase, label in scan.PHRASES.items():
        p = phrase.split()
        at += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def labelled(spark, docs):
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], SCHEMA)
    got = scan.license_labels(df).collect()
    assert len(got) == len(docs)
    want = sorted(map(str, ((i, *base(t)) for i, t in docs)))
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    return {r.doc_id: r for r in got}


def test_random_words_match_plain_search(spark):
    r = random.Random(11)
    some = ["GNU", "general", "public", "License", "apache", "cc", "by", "mit", "the", "-", "x", "é"]
    docs = [(i, r.choice([" ", "-", "\n", ", "]).join(r.choice(some) for _ in range(r.randrange(60)))) for i in range(400)]
    labelled(spark, docs)


def test_the_automaton_knows_every_run():
    r = random.Random(1)
    sequences = [[bytes([r.randrange(97, 100)]) for _ in range(r.randrange(1, 25))] for _ in range(12)]
    sam = scan.Automaton(sequences)
    runs = {tuple(s[i:j]): set() for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for k, s in enumerate(sequences):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                runs[tuple(s[i:j])].add((k, j - 1))
    text = [bytes([r.randrange(97, 101)]) for _ in range(3_000)]
    for i, (state, length) in enumerate(sam.statistics(text)):
        want = next((n for n in range(min(i + 1, 25), 0, -1) if tuple(text[i + 1 - n : i + 1]) in runs), 0)
        assert length == want
        if length:
            assert set(sam.ends[state]) == runs[tuple(text[i + 1 - length : i + 1])] and len(sam.ends[state]) == len(set(sam.ends[state]))


def test_notices_are_found_whole_edited_and_wrapped(spark):
    wrap = lambda t: "\n# ".join(t.split())
    docs, names = [], list(scan.TEMPLATES)
    for i, name in enumerate(names):
        t = scan.TEMPLATES[name]
        w = t.split()
        cut = w[: len(w) // 2] + ["inserted", "words", "here"] + w[len(w) // 2 + 1 :]
        docs += [(3 * i, "int main() {\n" + t + "}"), (3 * i + 1, wrap(t)), (3 * i + 2, " ".join(cut))]
    got = labelled(spark, docs)
    for i, name in enumerate(names):
        for k in (0, 1, 2):
            r = got[3 * i + k]
            assert set(r.labels.split(",")) - set(r.base_labels.split(",")) | {name} <= {name}, (name, r)
            assert name in r.labels.split(",") and r.score > 0.6, (name, r)


def test_spans_name_their_places(spark):
    two = "intro words " + scan.TEMPLATES["isc"] + " middle " * 40 + scan.TEMPLATES["bsd"] + " and " + scan.TEMPLATES["bsd"]
    (r,) = scan.scan(spark.createDataFrame([(1, two)], "doc_id long, text string")).collect()
    n, m = len(words(scan.TEMPLATES["isc"])), len(words(scan.TEMPLATES["bsd"]))
    assert [(s.label, s.first, s.after, s.covered) for s in sorted(r.spans, key=lambda s: s.first)] == [("isc", 2, 2 + n, n), ("bsd", 42 + n, 42 + n + m, m), ("bsd", 43 + n + m, 43 + n + 2 * m, m)]


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " -- "), (4, "MIT"), (5, "MIT-License"), (5, "mit license"), (None, "cc BY"), (7, "w " * 60_000 + "Apache License apache license"), (8, "mit license " * 5_000), (9, "mitlicense mit licenses émit license"), (10, "See\x00the apache\x0blicense")]
    labelled(spark, docs)
    assert scan.license_labels(spark.createDataFrame([], SCHEMA)).collect() == []
    short = scan.scan(spark.createDataFrame([("a", "Use of Foo is free"), ("b", None)], "name string, body string"), "name", "body", {"foo is": "f"}, {"x": "use of foo is free"}).collect()
    assert [(r.doc_id, r.score, len(r.spans)) for r in sorted(short)] == [("a", 1.0, 1), ("b", 0.0, 0)]
