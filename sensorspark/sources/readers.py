"""Readers and sinks of raw sensor files. Paths may be any that Spark's readers open."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timefns as t
from .shared import written

c = F.col


def station(spark: SparkSession, path: str, stamp: str = "Date Time") -> DataFrame:
    """Tab-separated station file with a row of units under the header: long (ts, name, value), UTC, sentinels null."""
    raw = spark.read.csv(path, sep="\t", header=True)
    names = [n for n in raw.columns if n != stamp]
    ts = t.fixed_to_utc(t.parse_mixed(c(stamp)))
    wide = raw.select(ts.alias("ts"), *[c(f"`{n}`").try_cast("double").alias(n) for n in names]).where("ts IS NOT NULL")  # the units row has no time
    return t.replace_sentinels(wide).unpivot("ts", names, "name", "value")


def trees(spark: SparkSession, path: str) -> DataFrame:
    """Per-tree sap flux files in one scan: ts, tree, species, value (the mean of the two depths)."""
    raw = spark.read.csv(path, header=True)
    outer, inner = c("Js_outer_cor").try_cast("double"), c("Js_inner_cor").try_cast("double")
    mean = F.try_divide(F.coalesce(outer, F.lit(0.0)) + F.coalesce(inner, F.lit(0.0)), outer.isNotNull().cast("int") + inner.isNotNull().cast("int"))
    return raw.select(t.parse_mixed(c("Ts")).alias("ts"), F.lower("TreeID").alias("tree"), c("Species").alias("species"), mean.alias("value")).where("ts IS NOT NULL")


def dendrometers(spark: SparkSession, path: str) -> DataFrame:
    """Long sensor file; of several rows of a (ts, id) the first that has a value, in file order."""
    raw = spark.read.csv(path, header=True).select(t.parse_mixed(c("TS")).alias("ts"), F.lower("ID").alias("sensor"), c("twd").try_cast("double").alias("value"), F.monotonically_increasing_id().alias("_i"))
    return raw.where("ts IS NOT NULL AND value IS NOT NULL").groupBy("ts", "sensor").agg(F.min_by("value", "_i").alias("value"))


def water_potential(spark: SparkSession, path: str) -> DataFrame:
    """Wide file whose columns are found by prefix: ts, sensor (swp_mpa_<id>), value."""
    raw = spark.read.csv(path, header=True, nullValue="NA")
    stamp = [n for n in raw.columns if n.startswith("TS")]
    sensors = [n for n in raw.columns if n.startswith("H")]
    if not stamp or not sensors:
        raise ValueError(f"no TS or H columns in {raw.columns}")
    wide = raw.select(t.fixed_to_utc(t.parse_mixed(c(f"`{stamp[0]}`"))).alias("ts"), *[c(f"`{n}`").try_cast("double").alias(f"swp_mpa_{n.lower()}") for n in sensors])
    return wide.where("ts IS NOT NULL").unpivot("ts", [f"swp_mpa_{n.lower()}" for n in sensors], "sensor", "value")


def receivers(spark: SparkSession, path: str, min_theta: float = 30.0, only: tuple[str, ...] = ("GPS1", "GPS3", "GPS5"), pattern: str = r"Hartheim_(GPS\d+)_GPS1") -> DataFrame:
    """Receiver files: ts (UTC from standard local time), receiver (lower case, from the file's name), and what there is of nvod, vod, theta, azimuth, pool; low elevations are left out.

    The receivers are asked for by the file's name, so files of others are never opened. A file without a receiver in its name, or no file of those asked
    for, is an error; both are told from the listing alone.
    """
    receiver = lambda name: F.regexp_extract(name, pattern, 1)
    found = [r[0] for r in spark.read.format("binaryFile").load(path).select(receiver(F.element_at(F.split("path", "/"), -1)).alias("r")).distinct().collect()]  # a name a receiver
    if "" in found:
        raise ValueError(f"files in {path} have no receiver in their names")
    if not set(found) & set(only):
        raise ValueError(f"no files of {sorted(only)} in {path}, only of {sorted(found)}")
    raw = spark.read.csv(path, header=True)
    names = [n for n in ("nvod", "vod", "theta", "azimuth") if n in raw.columns]
    raw = raw.where(receiver("_metadata.file_name").isin(*only)).select("*", F.lower(receiver("_metadata.file_name")).alias("receiver"))
    df = raw.select(t.fixed_to_utc(c("datetime").cast("timestamp_ntz")).alias("ts"), "receiver", *[c(n).try_cast("double").alias(n) for n in names], *[n for n in ("pool",) if n in raw.columns])
    return df.where(c("theta") >= min_theta)


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Prediction files {frames: [{timestamp, predicted_mean_leaf_angle}]}: corrupt files, missing and unparsable times are skipped, equal times averaged."""
    schema = "frames array<struct<timestamp: string, predicted_mean_leaf_angle: double>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"), F.col("_metadata.file_name").alias("file"))
    f = raw.select("file", F.explode("j.frames").alias("f")).where("f.timestamp IS NOT NULL AND f.timestamp <> 'missing'")
    return f.select("file", F.try_to_timestamp("f.timestamp").alias("ts"), c("f.predicted_mean_leaf_angle").alias("v")).where("ts IS NOT NULL").groupBy("file", "ts").agg(F.avg("v").alias("value"))


def laser_shots(spark: SparkSession, path: str) -> DataFrame:
    """Shot files: rows of eight numbers; lines that start with # are header and footer. file, then the eight columns."""
    names = ["sample_count", "scan_encoder", "rotary_encoder", "range_first", "intensity_first", "range_last", "intensity_last", "sample_interval_ms"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(~c("value").startswith("#"))
    parts = F.split("value", ",")
    rows = lines.where(F.size(parts) == 8).select("file", *[F.trim(parts[i]).try_cast("double").alias(n) for i, n in enumerate(names)])
    return rows.where(" AND ".join(f"{n} IS NOT NULL" for n in names))


def laser_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, header: the key-values of the # lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(c("value").startswith("#"))
    kv = lines.select("file", F.trim(F.regexp_extract("value", r"^#\s*([^:=]+)[:=]", 1)).alias("k"), F.trim(F.regexp_extract("value", r"[:=](.*)$", 1)).alias("v")).where("k <> ''")
    kv = kv.groupBy("file", "k").agg(F.max("v").alias("v"))
    return kv.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("header"))


def scan_batch(spark: SparkSession, path: str, gap_range: float = 0.0, max_bad: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """A batch of shot files: (results, errors). One row of results for each good file, one of errors (file, reason, lines) for each bad one.

    A file with a broken line or without shots is bad as a whole, and takes no other with it. The lines of all files are summed in one pass, so no file is held
    in a task; a broken line is one that is neither a # line nor eight numbers. More bad files than the share max_bad are an error: then it is the
    batch that is wrong. A shot is a gap if its first range is at most gap_range.
    Spark's readers pass over files of no bytes at all, so these are in neither.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file")).where("value <> ''")
    fields = F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("double"))
    shot = ~c("value").startswith("#")
    good = shot & (F.size(fields) == 8) & ~F.exists(fields, lambda x: x.isNull())
    at = lambda i: F.when(good, F.get(fields, F.lit(i)))
    g = lines.groupBy("file").agg(
        F.count_if(good).alias("shots"), F.count_if(shot & ~good).alias("broken"), F.count_if(at(3) <= gap_range).alias("gaps"), F.avg(at(1)).alias("mean_angle"), F.max(at(3)).alias("top"),
    )
    # files of blank lines have no group
    files = spark.read.format("binaryFile").load(path).select(c("path").alias("file"))
    g = written(files.join(g, "file", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("shots", "broken", "gaps")}))
    bad = (c("broken") > 0) | (c("shots") == 0)
    n, wrong = g.agg(F.count("*"), F.count_if(bad)).first()
    if n and wrong > max_bad * n:
        raise ValueError(f"{wrong} of {n} files in {path} are bad")
    reason = F.when(c("broken") > 0, "broken lines").otherwise("no shots")
    return g.where(~bad).select("file", "shots", "gaps", "mean_angle", "top"), g.where(bad).select("file", reason.alias("reason"), c("broken").alias("lines"))


def precipitation(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    return raw.select(F.try_to_timestamp(F.regexp_replace("From", "Z$", "+00:00")).alias("ts"), c("Precipitation_Sum_mm").try_cast("double").alias("mm")).where("ts IS NOT NULL")


def first_scenes(pixels: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Of scenes that several files hold, the rows of the first file."""
    rest = [n for n in pixels.columns if n not in keys]
    return pixels.groupBy(*keys).agg(F.min_by(F.struct(*rest), source).alias("_r")).select(*keys, "_r.*")


def save(df: DataFrame, path: str, by: list[str], dynamic: bool = True) -> None:
    """Idempotent sink: only partitions that df has are replaced."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(*by).parquet(path)


def file_states(spark: SparkSession, source: str) -> DataFrame:
    """file, length, n_rows, error of every Parquet file below source. A file is decoded whole before it counts as good, for one that breaks off later would give a part of its rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(source)

    def tried(parts):
        for pdf in parts:
            rows = []
            for path, length, content in zip(pdf["path"], pdf["length"], pdf["content"]):
                try:
                    rows.append((path, length, pq.read_table(pa.BufferReader(content)).num_rows, None))
                except Exception as e:  # whatever is wrong with a file, the others go on
                    rows.append((path, length, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["file", "length", "n_rows", "error"]).astype({"n_rows": "Int64"})

    return files.select("path", "length", "content").mapInPandas(tried, "file string, length long, n_rows long, error string")


def compact(spark: SparkSession, source: str, path: str, group: str, order: str, target_bytes: int = 128 << 20, max_bad: float = 0.1, least_files: int = 1) -> DataFrame:
    """Many small files of source into few sorted ones below path/group/bin; returns a row for each file: file, group, bin, length, n_rows, error.

    group is a pattern with one part, matched against a file's path. A group's good files, by name, fill bins up to target_bytes one after the other; a bin becomes
    one file, sorted by order. Where files are nearly as large as the target, or larger, bins grow with them, to hold at least least_files each (but for a group's last one). Bad files are left out and listed; more than the share max_bad of them is an error. Only the small files' sizes are
    ordered by group; rows meet their bin by the file's path.
    """
    named = F.regexp_extract("file", group, 1)
    files = written(file_states(spark, source).withColumn("group", named))
    n, wrong = files.agg(F.count("*"), F.count("error")).first()
    if wrong > max_bad * n:
        raise ValueError(f"{wrong} of {n} files in {source} can't be read")
    before = F.sum("length").over(Window.partitionBy("group").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    target = F.greatest(F.lit(target_bytes), least_files * F.max("length").over(Window.partitionBy("group"))) if least_files > 1 else F.lit(target_bytes)
    packed = files.where("error IS NULL").withColumn("bin", F.floor(F.coalesce(before, F.lit(0)) / target).cast("long"))
    report = written(packed.unionByName(files.where("error IS NOT NULL").withColumn("bin", F.lit(None).cast("long"))))
    sound = report.where("error IS NULL").agg(F.max_by("file", "n_rows")).first()[0]
    if sound is None:
        return report
    # the schema is a good file's: an undamaged footer may be hard to find
    rows = spark.read.schema(spark.read.parquet(sound).schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(source).withColumn("_file", F.col("_metadata.file_path"))
    good = report.where("error IS NULL").select(c("file").alias("_file"), c("group").alias("_group"), c("bin").alias("_bin"))
    rows = rows.join(good, "_file").drop("_file")
    rows.repartition("_group", "_bin").sortWithinPartitions("_group", "_bin", order).withColumnsRenamed({"_group": "group", "_bin": "bin"}).write.mode("overwrite").partitionBy("group", "bin").parquet(path)
    return report


def rename(spark: SparkSession, folder: str, name) -> None:
    """Gives each file below folder the name name(path); for few files, of which the driver asks the file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], fs.listFiles(path(folder), True)
    while files.hasNext():
        found.append(files.next().getPath())
    for f in found:
        if not f.getName().startswith(("_", ".")):
            fs.rename(f, path(f"{folder}/{name(f.toString())}"))


def put(spark: SparkSession, path: str, content: str) -> None:
    """A small file of text."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.writeBytes(content)
    out.close()


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
