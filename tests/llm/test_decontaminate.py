import hashlib
import random

from sensorspark.llm import decontaminate
from sensorspark.llm.common import cut

from . import brute

SCHEMA = "doc_id long, text string, w int, item string"


def check(spark, docs, items):
    df = spark.createDataFrame([(*d, 1, "i") for d in docs], SCHEMA)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(df, it).collect()))
    want = sorted((d or -1, n, h, len(w), hashlib.sha256(",".join(w).encode()).hexdigest(), h > 0) for d, n, h, w in brute.contamination(docs, items))
    assert got == want


def test_random_overlaps_match_brute_force(spark):
    r = random.Random(4)
    items = [(i, " ".join(f"w{r.randrange(8)}" for _ in range(r.choice([1, 3, 9, 10, 11, 14, 30])))) for i in range(20)]
    docs = []
    for i in range(150):
        w = [f"w{r.randrange(8)}" for _ in range(r.randrange(40))]
        if i % 2:
            t = r.choice(items)[1].split()
            a = r.randrange(len(t))
            w[len(w) // 2 : len(w) // 2] = t[a : a + r.randrange(1, 20)]
        docs.append((i, " ".join(w).upper() if i % 3 else ", ".join(w)))
    check(spark, docs, items)
    check(spark, docs, [(i, t) for i, t in items if len(t.split()) >= 10])


def test_edge_cases(spark):
    ten = "a b c d e f g h i j"
    docs = [(1, None), (2, ""), (3, "--!"), (4, "A-B c\nd e f g h i j"), (5, ten + " " + ten), (6, "É é"), (7, "x " * 30_000 + ten), (None, ten), (8, ten), (8, ten), (8, "other words")]
    check(spark, docs, [(10, ten), (9, ten + " k"), (None, "é é"), (3, None), (4, ""), (5, "é")])
    check(spark, docs, [])
    check(spark, [], [(1, ten)])


def test_without_broadcast_and_dropping(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    ten = "a b c d e f g h i j"
    docs = [(1, ten), (2, "clean text"), (None, ten), (None, None)]
    check(spark, docs, [(1, ten)])
    df = spark.createDataFrame([(*d, 1, "i") for d in docs], SCHEMA)
    kept = decontaminate.decontaminate(df, spark.createDataFrame([(1, ten)], "item_id long, text string"))
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


def test_repetitive_texts_are_thinned_and_matched(spark):
    """Where runs repeat, their hashes tie: documents keep one in each stretch, items all."""
    texts = ["x " * 1_000, "x y z " * 300, "a b c d e " * 200, " ".join(f"w{i % 7}" for i in range(900))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    places = decontaminate._hashed(df, "text").withColumn("r", decontaminate._runs()).selectExpr("text", "size(w) AS n", "r", "posexplode(r) AS (p, run)")
    for r in places.where(decontaminate._kept(ties=False)).groupBy("text", "n").count().collect():
        assert r["n"] / 5 - 2 <= r["count"] <= r["n"] / 2.5
    docs = [(i, "start " + t + " end") for i, t in enumerate(texts)]
    check(spark, docs, [(1, "x " * 12), (2, "y z x y z x y z x y z"), (3, "c d e a b c d e a b"), (4, "c d e a b c d e a c"), (5, " ".join(f"w{i % 7}" for i in range(3, 30))), (6, "x " * 10 + "end"), (7, "e end")])


def test_long_texts_shuffle_in_proportion(spark, monkeypatch):
    """Beyond the broadcast bound, a run takes the words around it along, not its text."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(16_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(text.split()[500:512])), (2, "w1 w2")], "item_id long, text string")
    plans = []
    monkeypatch.setattr(decontaminate, "cut", lambda d: plans.append(d) or cut(d))
    assert decontaminate.contamination(df, items).first().n_hit == 12
    (rows,) = [d for d in plans if "n_words" in d.columns]  # windows found in documents
    plan = rows._jdf.queryExecution().executedPlan()
    plan.execute().count()
    sent = [m.value() for m in shuffle_bytes(plan)]
    assert 0 < sum(sent) < 5e6


def shuffle_bytes(plan):
    """The metrics of bytes written of an executed plan's shuffles."""
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if name == "ShuffleExchangeExec":
            found.append(p.metrics().apply("shuffleBytesWritten"))
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def test_all_short_lengths_in_one_pass(spark):
    r = random.Random(9)
    items = [(n, " ".join(f"w{r.randrange(5)}" for _ in range(n))) for n in range(1, 10)] + [(20, " ".join(f"w{r.randrange(5)}" for _ in range(12)))]
    docs = [(i, " ".join(f"w{r.randrange(5)}" for _ in range(r.randrange(30)))) for i in range(60)]
    check(spark, docs, items)
