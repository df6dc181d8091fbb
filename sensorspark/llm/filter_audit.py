"""How filters interact: what each removes, repeats and loses in every order of application.

Each text is judged by all filters once; its failures are the bits of a mask. Rows are summed to (part, mask) before anything else, so what follows
doesn't grow with the documents. A part's mask matrix (0 where a filter fails, else out of reach) is then combined with the matrix of inverse
permutations (filter -> position) by a min-plus product: the smallest position of a failing filter is the step that removes the texts of that mask.
Steps drive weighted scatter counts; a filter's redundancies are its failures less what it removed.

Copies are told by hashes: rows are summed to (hash, part, labels) with their smallest id before the copies of a hash meet, so a text that makes up a
third of the table is a few rows then.

Defined results: a null text is empty (no words; fails A, not B), a null part is the empty string. A null doc_id is neither smaller than another
nor larger: it fails no copy test, and makes none fail. Rows that repeat doc_id and text don't fail each other and count each. A document is good or
toxic if any of its label rows says so. Without documents there are no parts and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

SPACE = r"[ \t-\r]+"
LABEL_ROWS = 500_000


def positions(k: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of k filters (orders x steps) and their inverses (filters x orders): where each filter stands."""
    orders = np.array(list(itertools.permutations(range(k))), dtype=np.int64).reshape(-1, k)
    return orders, np.argsort(orders, axis=1).T


def removal_steps(fails: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Min-plus product: for each row of fails (masks x filters) and each order the first step whose filter fails, or the number of filters."""
    k = len(position)
    far = np.where(fails, 0, k)
    out = np.full((len(fails), position.shape[1]), k, dtype=np.int64)
    for f in range(k):
        np.minimum(out, far[:, f, None] + position[f][None, :], out=out)
    return out


def scatter(steps: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The weight that each order removes at each step (orders x steps)."""
    out = np.zeros((steps.shape[1], k + 1), dtype=np.int64)
    np.add.at(out, (np.broadcast_to(np.arange(steps.shape[1]), steps.shape), steps), np.broadcast_to(weight[:, None], steps.shape))
    return out[:, :k]


def audit(masks: DataFrame, filters: str, losses: Mapping[str, str]) -> DataFrame:
    """One row for each part, order and step, from rows (part, mask, n, and a count for each of losses).

    Bit i of mask is set where filter filters[i] fails; rows may repeat a mask. losses: result column -> counted column, summed over what the step
    removes. At most 2**len(filters) rows of a part meet in one task.
    """
    names, k = list(filters), len(filters)
    rows = masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in losses.values()])
    columns = ["kept", "removed", "redundant", "unique_fails", *losses, "shapley"]

    def judged(pdf: pd.DataFrame) -> pd.DataFrame:
        orders, position = positions(k)
        mask, n = pdf["mask"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        fails = (mask[:, None] >> np.arange(k)) & 1 == 1
        steps = removal_steps(fails, position)
        removed = scatter(steps, n, k)
        all_fails = n @ fails
        alone = np.array([n[mask == 1 << f].sum() for f in range(k)])
        shapley = np.array([np.take_along_axis(removed, position[f][:, None], axis=1).sum() for f in range(k)])
        out = {"kept": n.sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": all_fails[orders] - removed, "unique_fails": alone[orders], "shapley": shapley[orders]}
        out |= {name: scatter(steps, pdf[c].to_numpy(np.int64), k) for name, c in losses.items()}
        head = {"part": pdf["part"].iloc[0], "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], k), "step": np.tile(np.arange(1, k + 1), len(orders))}
        return pd.DataFrame(head | {c: out[c].ravel() for c in columns})

    return rows.groupBy("part").applyInPandas(judged, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))


def conditions(words: Column, text: Column) -> list[Column]:
    """Failures A to D of a text and its words."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic), with bits A to E; rows may repeat a part and mask."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    d = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text)
    d = d.withColumn("w", F.filter(F.split("text", SPACE), lambda x: x != ""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("w"), F.col("text")))), F.lit(0))
    d = d.select("doc_id", "part", bits.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_hash"))
    d = d.groupBy("doc_id", "part", "mask", "text_hash").agg(F.count("*").alias("n"))
    said = labels.groupBy(F.col("doc_id").alias("_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(name) for name, c in (("good", "quality"), ("toxic", "toxic"))])
    d = d.join(small(cut(said), LABEL_ROWS), d["doc_id"] == F.col("_id"), "left").select("doc_id", "part", "mask", "text_hash", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    d = d.groupBy("text_hash", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), first.alias("first"))
    # a few rows a text: one for each part and label
    least = F.expr("min(first.doc_id) OVER (PARTITION BY text_hash)")
    d = d.withColumn("passing", F.col("unnamed") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    d = d.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("passing").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("x"))
    return d.select("part", "x.mask", "x.n", (F.col("good") * F.col("x.n")).alias("good"), (F.col("toxic") * F.col("x.n")).alias("toxic"))


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five document filters, for each language."""
    return audit(document_masks(docs, labels), "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})


SQL = r"""
WITH l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, step, substr(o, step, 1) f, left(o, step - 1) earlier FROM o, (SELECT unnest(range(1, 6)) step)),
lab AS (SELECT doc_id, max(coalesce(quality = 1, false)) good, max(coalesce(toxic = 1, false)) toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') w FROM documents),
m AS (SELECT part, coalesce(good, false) good, coalesce(toxic, false) toxic,
  CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END fails FROM t LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, fails, count(*) n, count(*) FILTER (good) good, count(*) FILTER (toxic) toxic FROM m GROUP BY part, fails),
j AS (SELECT part, o, step, f, n, good, toxic, fails, contains(fails, f) failing, len(earlier) > 0 AND translate(earlier, fails, '') <> earlier gone FROM c, s),
r AS (SELECT part, o, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0) removed, coalesce(sum(n) FILTER (failing AND gone), 0) redundant,
  coalesce(sum(n) FILTER (fails = f), 0) unique_fails, coalesce(sum(good) FILTER (failing AND NOT gone), 0) good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) toxic_lost FROM j GROUP BY ALL)
SELECT part, o filter_order, CAST(step AS INTEGER) step, CAST(kept AS BIGINT) kept, CAST(removed AS BIGINT) removed, CAST(redundant AS BIGINT) redundant, CAST(unique_fails AS BIGINT) unique_fails,
  CAST(good_lost AS BIGINT) good_lost, CAST(toxic_lost AS BIGINT) toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) shapley FROM r
"""
