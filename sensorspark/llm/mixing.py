"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed to cells (source, language, topic); the cells' weights are scaled to each marginal's targets in turn until all hold (raking).
Targets that contradict each other, or that no document can meet, never hold: after SWEEPS sweeps raking raises an error, or warns where the targets are the default ones.
A document of a cell whose factor r (fitted over observed tokens) is below 1 is sampled with probability r; others stay, and
weight = r / probability says how often a kept document's tokens count, so kept tokens times weight meet the targets in expectation.

The cells stay a table: sums per marginal value are combined before each shuffle, and only a convergence figure reaches the driver. The
draw is a hash of doc_id, so a recomputed task draws the same.

Defined results: a null source, language or topic is a value of its own ('?'). A value without a target gets 0: its documents have probability 0.
Null and empty texts have 0 tokens and their cell's probability; a cell without tokens has factor 1. Repeated rows are drawn alike. Where docs has columns
topic or tokens, they are used (tokens that are no number count 0); other extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SWEEPS, CLOSE = 300, 1e-11
FEW, TOGETHER = 100_000, 5  # so many cells are raked in one task, several sweeps in a job
TEMPER = 0.7  # default targets: shares to this power, scaled to 1
MARGINS = ("source", "lang", "topic")
TOKEN = r"[^\x20\x09-\x0D]+"  # in SQL; Java's \S+ is the same class
SEED = "mix-1"

#: Topics by form, the first that fits: (name, what the text contains).
FORMS = [("symbols", ["***", "###", "$$$"]), ("shouting", ["!! "]), ("table", [" | "])]


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def topic(text: Column) -> Column:
    """A topic by form: for tables that carry no topic of their own."""
    out, text = None, F.coalesce(text, F.lit(""))
    for name, marks in FORMS:
        hit = None
        for m in marks:
            hit = text.contains(m) if hit is None else hit | text.contains(m)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(F.length(text) < 300, "short").when(F.length(text) > 5000, "long").otherwise("prose")


def tempered(cells: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    """value, share: the observed shares, flattened."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").cast("double").alias("t"))
    scaled = sums.select("value", F.pow("t", F.lit(power)).alias("p"))
    total = scaled.agg(F.sum("p")).first()[0]  # one number
    return scaled.select("value", F.try_divide("p", F.lit(total)).alias("share"))


def _scaled(cells: DataFrame, m: str, here: bool) -> DataFrame:
    """cells with fitted scaled to one margin's targets, and by how much (_m)."""
    if here:  # all cells are in one task: no shuffle
        have = F.sum("fitted").over(Window.partitionBy(m))
        factor = F.coalesce(F.try_divide(F.coalesce(F.col(f"want_{m}"), F.lit(0.0)), have), F.lit(1.0))
        return cells.withColumn("_f", factor).withColumns({"fitted": F.col("fitted") * F.col("_f"), f"_{m}": F.abs(F.col("_f") - 1)}).drop("_f")
    have = cells.groupBy(m).agg(F.sum("fitted").alias("have"), F.max(f"want_{m}").alias("want"))
    factor = have.select(m, F.coalesce(F.try_divide(F.coalesce("want", F.lit(0.0)), "have"), F.lit(1.0)).alias("_f"))
    return cells.join(factor, m).withColumns({"fitted": F.col("fitted") * F.col("_f"), f"_{m}": F.abs(F.col("_f") - 1)}).drop("_f")


def rake(cells: DataFrame, targets: dict[str, DataFrame], strict: bool = True) -> DataFrame:
    """cells with a column fitted whose sums per value of each margin are the targets' shares of all tokens; if they never are, an error or (not strict) a warning."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cells = cells.select(*MARGINS, "tokens", F.col("tokens").cast("double").alias("fitted"))
    for m, t in targets.items():
        cells = cells.join(t.select(F.col("value").alias(m), (F.col("share") * total).alias(f"want_{m}")), m, "left")
    cells = cut(cells)
    columns, here, off = cells.columns, cells.count() <= FEW, 0.0
    for _ in range(SWEEPS // TOGETHER if here else SWEEPS):
        if here:
            cells = cells.coalesce(1)
        for _ in range(TOGETHER if here else 1):
            for m in targets:
                cells = _scaled(cells, m, here)
        done = cut(cells.select(*columns, F.array_max(F.array(*[f"_{m}" for m in targets])).alias("off")))
        cells = done.select(*columns)
        off = done.where("fitted > 0").agg(F.max("off")).first()[0] or 0
        if off < CLOSE:
            break
    else:
        message = f"targets don't hold together: after {SWEEPS} sweeps a margin is still off by {off:.2e} of its target"
        if strict:
            raise ValueError(message)
        warnings.warn(message, stacklevel=2)
    return cells.select(*MARGINS, "tokens", "fitted")


def _celled(docs: DataFrame, id_col: str, keep_rows: bool) -> DataFrame:
    """_id, a column for each margin and _n (tokens), given or found; with keep_rows also _row, which holds all columns of docs, so that no name clashes."""
    given = {c.lower() for c in docs.columns}
    own = F.coalesce(F.col("topic").cast("string"), F.lit("?")) if "topic" in given else topic(F.col("text"))
    n = F.coalesce(F.col("tokens").try_cast("long"), F.lit(0)) if "tokens" in given else tokens(F.col("text"))
    values = [F.coalesce(F.col(m).cast("string"), F.lit("?")).alias(f"_{m}") for m in MARGINS[:2]]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep_rows else []
    return docs.select(*row, F.col(id_col).alias("_id"), *values, own.alias("_topic"), n.alias("_n"))


def _drawn(docs: DataFrame, targets: dict[str, DataFrame] | None) -> DataFrame:
    """docs (with _id, _n and a column for each margin) with _p, _w and _kept, unrounded."""
    cell = [f"_{m}" for m in MARGINS]
    cells = cut(docs.groupBy(*[F.col(f"_{m}").alias(m) for m in MARGINS]).agg(F.sum("_n").alias("tokens")))
    fitted = rake(cells, targets or {m: tempered(cells, m) for m in MARGINS}, strict=targets is not None)
    factors = fitted.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], F.coalesce(F.try_divide("fitted", "tokens"), F.lit(1.0)).alias("_r"))
    drawn = docs.join(factors, cell, "left").withColumn("_p", F.least(F.lit(1.0), F.col("_r")))
    u = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit("|" + SEED))), 1, 13), 16, 10).cast("double") / float(16**13)
    return drawn.withColumns({"_w": F.coalesce(F.try_divide("_r", "_p"), F.lit(0.0)), "_kept": u < F.col("_p")})


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, source, lang, topic, n_tokens, probability, weight, kept. docs needs source, lang, and text or topic and tokens."""
    drawn = _drawn(cut(_celled(docs, id_col, keep_rows=False)), targets)  # texts are read once
    return drawn.select(F.col("_id").alias("doc_id"), *[F.col(f"_{m}").alias(m) for m in MARGINS], F.col("_n").alias("n_tokens"), F.round("_p", 6).alias("probability"), F.round("_w", 6).alias("weight"), F.col("_kept").alias("kept"))


def weighted(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of docs that the mixture keeps; all their columns, and weight (in place of one that docs has): how often a row's tokens count, so that the targets hold."""
    drawn = _drawn(_celled(docs, "doc_id", keep_rows=True), targets)
    return drawn.where("_kept").select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "weight"], F.col("_w").alias("weight"))


def sql() -> str:
    form = " ".join("WHEN {} THEN '{}'".format(" OR ".join(f"contains(t, '{m}')" for m in marks), name) for name, marks in FORMS)
    ctes = [
        "d0 AS (SELECT doc_id, coalesce(source, '?') source, coalesce(lang, '?') lang, coalesce(text, '') t FROM documents)",
        f"d AS (SELECT doc_id, source, lang, CASE {form} WHEN length(t) < 300 THEN 'short' WHEN length(t) > 5000 THEN 'long' ELSE 'prose' END topic, CAST(len(regexp_extract_all(t, '{TOKEN}')) AS BIGINT) n_tokens FROM d0)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE tokens FROM d GROUP BY ALL)",
        *[f"t_{m} AS MATERIALIZED (SELECT {m}, p / sum(p) OVER () * (SELECT sum(tokens) FROM c) want FROM (SELECT {m}, pow(sum(tokens), {TEMPER}) p FROM c GROUP BY {m}))" for m in MARGINS],
        "w AS MATERIALIZED (SELECT c.*, " + ", ".join(f"t_{m}.want want_{m}" for m in MARGINS) + " FROM c " + " ".join(f"JOIN t_{m} USING ({m})" for m in MARGINS) + ")",
        # one margin a step, as many sweeps as raking may take
        f"f AS (SELECT 0 k, *, tokens fitted FROM w UNION ALL SELECT k + 1, source, lang, topic, tokens, {', '.join(f'want_{m}' for m in MARGINS)}, coalesce(fitted * CASE k % 3 "
        + " ".join(f"WHEN {i} THEN want_{m} / nullif(sum(fitted) OVER (PARTITION BY {m}), 0)" for i, m in enumerate(MARGINS))
        + f" END, fitted) FROM f WHERE k < {SWEEPS * len(MARGINS)})",
    ]
    return (
        "WITH RECURSIVE "
        + ",\n".join(ctes)
        + f""",
r AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN fitted / tokens ELSE 1 END r FROM f WHERE k = {SWEEPS * len(MARGINS)}),
p AS (SELECT d.*, r, least(1.0, r) pr, CAST('0x' || substr(md5(doc_id::VARCHAR || '|{SEED}'), 1, 13) AS BIGINT)::DOUBLE / {16**13}.0 u FROM d JOIN r USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(pr, 6) probability, round(CASE WHEN pr > 0 THEN r / pr ELSE 0 END, 6) weight, u < pr kept FROM p"""
    )
