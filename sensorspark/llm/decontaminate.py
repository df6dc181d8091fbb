"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every run of K words is hashed; in each stretch of W = WINDOW - K + 1 runs the one with the smallest hash is kept (of equals, documents keep one and
items all). Two texts that share WINDOW words share such a stretch, so what the document keeps there the item keeps too, at the same place: no
shared window is missed. Kept runs of documents and of items' distinct windows are joined by hash, and each hit is extended to the WINDOW-word window
around it, which is compared word by word; windows that are found meet their items then. An item of fewer words than WINDOW is one window of its own
length, whose hash is looked up among all runs of that length.

Document runs are never shuffled while the items' side has at most BROADCAST_ROWS rows (counted); beyond that Spark joins by shuffle, and a run then
carries the few words around it. Runs that stand in very many documents are split by Spark's skew join, for the items' side of a run is small.

Defined results: words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z only. Null and empty texts have no words and no
hits; items without words have no windows; an item whose id is null marks words but is neither counted nor listed. Rows that repeat a
doc_id and a text get equal results, one row each; the same doc_id with another text is a document of its own. Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same class without a negation, after lower-casing: Java's matcher is eight times faster on it.
FAST_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
WINDOW, K = 10, 6
W = WINDOW - K + 1  # runs in a stretch
PLACE = 3  # bits that hold a place modulo W
BROADCAST_ROWS = 2_000_000


def word_array(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # lower() touches A-Z only where a text has no other letters; it is several times faster
    plain = F.length(text) == F.octet_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(lower, F.lit(FAST_WORD), F.lit(0))


def _runs() -> Column:
    """The hashes of all runs of K words, one for each place, with the place modulo W in their last bits: of equal hashes in a stretch the smaller is then
    a matter of place. An array, so that each is computed once: as columns of exploded places, compared with their neighbours, they make a method that
    Java doesn't compile."""
    r = F.transform("h", lambda x, i: F.xxhash64(x, *[F.get(F.col("h"), i + j) for j in range(1, K)]).bitwiseAND(F.lit(-8)).bitwiseOR((i % W).cast("long")))
    return F.slice(r, 1, F.greatest(F.size("h") - (K - 1), F.lit(0)))


def _kept(ties: bool) -> Column:
    """Whether the run at p has the smallest hash in some stretch of W runs that lies within the text; of equals all, or in each stretch the one at
    the place with the smallest remainder, which thins repetitive text as well."""
    hashed = (lambda c: F.shiftright(c, PLACE)) if ties else (lambda c: c)
    at = lambda j: F.get(F.col("r"), F.expr(f"p + {j}"))

    def side(step: int) -> Column:
        """How many runs on one side, at most W - 1, exist and don't come first."""
        stop = lambda j: F.coalesce(hashed(at(step * j)) < hashed(F.col("run")), F.lit(True))
        out = F.when(stop(1), 0)
        for j in range(2, W):
            out = out.when(stop(j), j - 1)
        return out.otherwise(W - 1)

    return side(-1) + side(1) >= W - 1


def _hashed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("w", word_array(F.col(text))).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def _item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, n (words of the window), run (hash), before (words of the window left of the run), window."""
    items = _hashed(items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")), "text").drop("text").where("size(w) > 0")
    long = items.where(F.size("w") >= WINDOW).withColumn("r", _runs()).select("item", "w", "r", F.posexplode("r").alias("p", "run")).where(_kept(ties=True))
    # each window that holds the kept run
    long = long.withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - (WINDOW - K)), F.least(F.col("p"), F.size("w") - WINDOW))))
    long = long.select("item", F.lit(WINDOW).alias("n"), F.shiftright("run", PLACE).alias("run"), (F.col("p") - F.col("s")).alias("before"), F.slice("w", F.col("s") + 1, WINDOW).alias("window"))
    short = items.where(F.size("w") < WINDOW).select("item", F.size("w").alias("n"), F.xxhash64("h").alias("run"), F.lit(0).alias("before"), F.col("w").alias("window"))
    return long.unionAll(short).distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _results(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), _item_windows(items, item_id, item_text)).drop("key")


def _results(docs: DataFrame, items: DataFrame) -> DataFrame:
    items = cut(items)
    # documents meet distinct windows; only windows that stand in one meet their items
    windows = items.select("n", "run", "before", "window").distinct()
    lengths = {r.n: r.rows for r in windows.groupBy("n").agg(F.count("*").alias("rows")).collect()}  # at most WINDOW rows
    mark = F.broadcast if sum(lengths.values()) <= BROADCAST_ROWS else (lambda df: df)
    docs = _hashed(docs.withColumn("key", F.xxhash64("text", F.length("text"))), "text").drop("text")
    # what a run carries is the words around it, not its text: as many as a window may take
    reach = WINDOW - K
    first = F.greatest(F.col("p") - reach, F.lit(0))
    # the first element stands for the document itself: texts are read and split once, hits or none
    places = docs.withColumn("r", _runs()).select("doc_id", "key", "w", "r", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "r")).alias("_p", "run")).withColumn("p", F.col("_p") - 1)
    kept = places.where((F.col("p") < 0) | _kept(ties=False)).select("doc_id", "key", "p", F.when(F.col("p") >= 0, F.shiftright("run", PLACE)).alias("run"), F.when(F.col("p") < 0, F.size("w")).alias("n_words"), F.when(F.col("p") >= 0, F.slice("w", first + 1, reach + WINDOW)).alias("around"))
    # a window is compared word by word within the join
    same = (F.least(F.col("p"), F.lit(reach)) >= F.col("before")) & (F.slice("around", F.least(F.col("p"), F.lit(reach)) - F.col("before") + 1, WINDOW) == F.col("window"))
    met = kept.alias("d").join(mark(windows.where(f"n = {WINDOW}").select("run", "before", "window")).alias("i"), (F.col("d.run") == F.col("i.run")) & same, "left").where("p < 0 OR window IS NOT NULL")
    rows = met.select("doc_id", "key", "n_words", (F.col("p") - F.col("before")).alias("s"), F.lit(WINDOW).alias("n"), "window")
    short = sorted(k for k in lengths if k < WINDOW)
    if short:  # all lengths in one pass; an array's hash is that of its elements in turn
        ends = lambda i: F.array(*[F.struct(F.lit(n).alias("n"), i.alias("p"), F.when(i + n <= F.size("h"), F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(n)])).alias("run")) for n in short])
        each = F.filter(F.flatten(F.transform("h", lambda x, i: ends(i))), lambda x: x["run"].isNotNull())
        at = docs.select("doc_id", "key", "w", F.explode(each).alias("x")).select("doc_id", "key", "x.*", F.slice("w", F.col("x.p") + 1, F.col("x.n")).alias("around")).alias("d")
        found = at.join(mark(windows.where(f"n < {WINDOW}").select("n", "run", "window")).alias("i"), (F.col("d.n") == F.col("i.n")) & (F.col("d.run") == F.col("i.run")) & (F.col("around") == F.col("window")))
        rows = rows.unionAll(found.select("doc_id", "key", F.lit(None).cast("int").alias("n_words"), F.col("p").alias("s"), F.col("d.n").alias("n"), "window"))
    rows = cut(rows)
    per = rows.groupBy("doc_id", "key").agg(F.count(F.col("n_words")).alias("copies"), F.max("n_words").cast("long").alias("n_words"), F.sort_array(F.collect_set(F.when(F.col("window").isNotNull(), F.struct("s", F.expr("s + n").alias("e"))))).alias("spans"))
    # first per window, so that a passage that stands in many places of a document stays small
    named = rows.where("window IS NOT NULL").select("doc_id", "key", "n", "window").distinct().join(mark(items.select("n", "window", "item").distinct()), ["n", "window"])
    named = named.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "items")
    per = per.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_key")), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    # the words in the union of the windows, by their sorted ends
    hit = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")), lambda a, x: F.struct(F.greatest(a.end, x.e).alias("end"), (a["sum"] + F.greatest(F.lit(0), x.e - F.greatest(a.end, x.s))).alias("sum")), lambda a: a["sum"])
    out = per.select("doc_id", "key", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "copies")
    return out.withColumn("contaminated", F.col("n_hit") > 0).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_c", "copies")


def decontaminate(docs: DataFrame, items: DataFrame, max_share: float = 0.0) -> DataFrame:
    """docs without the rows of whose words more than max_share are hit; all columns of docs."""
    marks = _results(docs.select("doc_id", "text"), _item_windows(items, "item_id", "text")).where(F.col("n_hit") > max_share * F.col("n_words"))
    marks = marks.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    marks = small(cut(marks), BROADCAST_ROWS)
    key = F.xxhash64("text", F.length("text"))
    return docs.join(marks, docs["doc_id"].eqNullSafe(marks["_id"]) & (key == marks["_key"]), "left_anti")


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) n, unnest([array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') FOR s IN range(1, greatest(len(w) - {WINDOW}, 0) + 2)]) win FROM i WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) s, w FROM w, n WHERE len(w) >= n),
hits AS (SELECT doc_id, s, dw.n, item FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') win FROM dw) dw JOIN iw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
