"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

A rule is a glob over the lower-cased host and the path: `*` stands for any run of characters and the rest is literal. Its index tokens are the runs of
letters and digits that stand whole in every url it fits (no `*` beside them). Tokens are counted over the urls and each rule is stored under
its rarest one; a url's own tokens fetch its candidate rules, and only those run their regular expressions. Rules without such a
token are tried on every distinct host and path, as literal expressions. The longest fitting rule decides: an explicit host/path rule before any pattern.

Rules are few beside urls: they are a driver-side list and are broadcast up to BROADCAST_RULES of them; beyond that Spark joins by shuffle.

Verdicts return to the rows by their site. A site with more than one in HOT_SHARE rows (at most HOT_SHARE sites can have so many, whatever the table's size) gets its verdict by
broadcast; its rows, and urls without a site where they are many, go through the shuffle under their ids' hashes, so no task gets them all.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed. Repeated rows get
a row each. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BROADCAST_RULES = 100_000
HOT_SHARE = 10_000

#: host/path rules: (rule, verdict); a rule fits its host, all subdomains, and paths that start with its path
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: pattern rules: (glob, verdict)
PATTERNS = [
    ("*cheap-pills.*", "block"),
    ("*spam-farm.*", "block"),
    ("*casino*", "block"),
    ("*.torrent", "block"),
    ("*/porn/*", "block"),
    ("ads.*", "block"),
    ("*.doubleclick.*", "block"),
    ("*/wp-login.php", "block"),
    ("*/cart/checkout*", "block"),
    ("*/login/*", "block"),
]


def _host_rule(rule: str) -> tuple[str, list[str]]:
    host, _, path = rule.partition("/")
    return rf"^([^/]*\.)?{re.escape(host)}/{re.escape(path)}", re.findall(r"[a-z0-9]+", host)


def _pattern_rule(glob: str) -> tuple[str, list[str]]:
    tokens = [m[0] for m in re.finditer(r"[a-z0-9]+", glob) if "*" not in (glob[m.start() - 1 : m.start()], glob[m.end() : m.end() + 1])]
    return "^" + ".*".join(re.escape(x) for x in glob.split("*")) + "$", tokens


def compile_rules(host_rules=HOST_RULES, patterns=PATTERNS) -> list[tuple]:
    """(rule, verdict, rank, regex, tokens); the largest rank wins."""
    out = [(r, v, (1, len(r), r), *_host_rule(r)) for r, v in host_rules] + [(g, v, (0, len(g), g), *_pattern_rule(g)) for g, v in patterns]
    out.sort(key=lambda x: x[2])
    return [(rule, verdict, i, kind[0], regex, tokens) for i, (rule, verdict, kind, regex, tokens) in enumerate(out)]


def parse(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds host and path."""
    rest = F.when(F.instr(F.col(url_col), "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return urls.withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", path)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """One row for each row of pages: its id, host, path, rule (a host/path rule, or null), pattern (or null), verdict."""
    spark = pages.sparkSession
    rules = compile_rules(host_rules, patterns)
    mark = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    urls = parse(pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url")), "url").withColumn("site", F.concat("host", "path"))
    tokens = F.array_distinct(F.split(F.lower("site"), r"[^a-z0-9]+"))
    table = spark.createDataFrame(rules, "rule string, verdict string, rank int, explicit int, regex string, tokens array<string>")
    wanted = table.select("rank", F.explode("tokens").alias("token"))
    # the rarest token of each rule over the urls; one that no url has comes first, for its rule then fits none
    seen = urls.select(F.explode(tokens).alias("token")).join(mark(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    rarest = wanted.join(seen, "token", "left").groupBy("rank").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("t")).select("rank", "t.token")
    indexed = mark(table.join(rarest, "rank").drop("tokens"))
    # Which rules fit depends on host and path alone, so each distinct site is judged once
    counted = cut(urls.groupBy("site", "host", "path").agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    sites = counted.select("site", "host", "path")
    candidates = sites.select("site", F.explode(tokens).alias("token")).join(indexed, "token").drop("token")
    fits = candidates.where(F.expr("site RLIKE regex")).select("site", "rank", "explicit", "rule", "verdict")
    if free := [r for r in rules if not r[5]]:
        tried = [F.when(F.col("site").rlike(x), F.struct(*[F.lit(v).alias(c) for v, c in ((k, "rank"), (e, "explicit"), (r, "rule"), (v, "verdict"))])) for r, v, k, e, x, _ in free]
        fits = fits.unionByName(sites.select("site", F.explode(F.array_compact(F.array(*tried))).alias("r")).select("site", "r.*"))
    fits = cut(fits.groupBy("site").agg(F.max(F.struct("rank", "explicit", "rule", "verdict")).alias("r")))
    hot = counted.where(F.col("n") * HOT_SHARE > total).groupBy("site").agg(F.lit(True).alias("hot"))  # fewer than HOT_SHARE rows
    out = urls.join(F.broadcast(hot.join(fits, "site", "left").withColumnRenamed("r", "h")), "site", "left")
    key = F.when(F.col("hot").isNull(), F.col("site"))
    out = out.withColumn("key", key).withColumn("salt", F.when(key.isNull(), F.xxhash64(id_col)).otherwise(F.lit(0)))
    out = out.join(fits.select(F.col("site").alias("key"), F.lit(0).cast("long").alias("salt"), "r"), ["key", "salt"], "left").withColumn("r", F.coalesce("h", "r"))
    return out.select(id_col, "host", "path", F.when(F.col("r.explicit") == 1, F.col("r.rule")).alias("rule"), F.when(F.col("r.explicit") == 0, F.col("r.rule")).alias("pattern"), F.coalesce("r.verdict", F.lit("allow")).alias("verdict"))


def sql() -> str:
    """The same verdicts, each rule tried on each url."""
    values = ", ".join("({}, '{}', {}, {}, '{}')".format(f"'{r}'", v, k, e, x.replace("'", "''")) for r, v, k, e, x, _ in compile_rules())
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM u),
r(rule, verdict, rank, explicit, regex) AS (VALUES {values}),
best AS (SELECT page_id, max({{'rank': rank, 'explicit': explicit, 'rule': rule, 'verdict': verdict}}) b FROM p, r WHERE regexp_matches(host || path, regex) GROUP BY page_id)
SELECT page_id, host, path, CASE WHEN b.explicit = 1 THEN b.rule END "rule", CASE WHEN b.explicit = 0 THEN b.rule END pattern, coalesce(b.verdict, 'allow') verdict FROM p LEFT JOIN best USING (page_id)
"""
