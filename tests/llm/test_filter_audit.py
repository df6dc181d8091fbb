import itertools
import random
import re

import numpy as np

from sensorspark.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, lang string, mask int, n string", "doc_id long, quality int, toxic int, n int"


def fails(text, doc_id, docs):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    out = ["A"] if len(w) < 100 else []
    out += ["B"] if 100 * len(set(w)) < 80 * len(w) else []
    out += ["C"] if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else []
    out += ["D"] if re.search("[#$%&*|]", text) else []
    return set(out + (["E"] if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs) else []))


def brute(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out, shapley = {}, {}
    bad = [fails(t or "", i, docs) for i, t, _ in docs]
    for part in {p or "" for *_, p in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, f) for (i, _, p), f in zip(docs, bad) if (p or "") == part]
            for step, f in enumerate(order, 1):
                gone = [i for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                every = [x for (_, _, p), x in zip(docs, bad) if (p or "") == part and f in x]
                out[part, order, step] = [len(left), len(gone), len(every) - len(gone), sum(x == {f} for x in every), sum(i in good for i in gone), sum(i in toxic for i in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check(spark, docs, labels):
    got = filter_audit.document_audit(spark.createDataFrame([(*d, 7, "x") for d in docs], DOCS), spark.createDataFrame([(*x, 1) for x in labels], LABELS)).collect()
    assert len(got) == 600 * len({p or "" for *_, p in docs})
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute(docs, labels)


def test_random_documents_match_brute_force(spark):
    r = random.Random(13)
    texts = [" ".join(r.choice(["w%d" % r.randrange(300), "AB%d" % r.randrange(9), "x"][: r.randrange(1, 4)]) for _ in range(r.randrange(60, 160))) + r.choice(["", "#", " "]) for _ in range(25)]
    docs = [(r.choice([i, i, i // 3]), r.choice(texts), r.choice(["en", "de"])) for i in range(120)]
    check(spark, docs, [(i, r.randrange(2), r.randrange(2)) for i in range(0, 120, 2)])


def test_edge_cases(spark):
    long = "word " * 50_000
    docs = [(None, None, None), (2, None, ""), (1, "", "en"), (None, long, "en"), (5, long, "fr"), (4, long, "en"), (4, long, "en"), (4, "\x0b\t\x0c", "en"), (-3, "ÀÉ AB é", None)]
    check(spark, docs, [(4, 1, None), (4, 0, 1), (None, 1, 1), (5, None, None)])
    check(spark, docs, [])
    check(spark, [], [(1, 1, 1)])


def test_min_plus_product_is_the_first_failing_step():
    orders, position = filter_audit.positions(4)
    masks = np.array(list(itertools.product([False, True], repeat=4)))
    steps = filter_audit.removal_steps(masks, position)
    for m, row in zip(masks, steps):
        assert row.tolist() == [next((s for s, f in enumerate(o) if m[f]), 4) for o in orders]
    assert filter_audit.scatter(steps, np.arange(16), 4).sum(axis=1).tolist() == [sum(range(1, 16))] * 24
