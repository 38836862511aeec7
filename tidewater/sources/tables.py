"""Readers and writers: files of several formats, batch tables, feature tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.fixed import RECORD_TYPES
from ..operators.features import tier_filter
from ..operators.ranges import written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _array_files(spark: SparkSession, path: str) -> list[str]:
    """Files that hold one JSON array over several lines: they begin with "[", and their first line is no array by itself."""
    text = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    first = text.where("line <> ''").groupBy("file").agg(F.min_by("line", F.struct("at", "row")).alias("line"))
    return [r["file"] for r in first.where(F.col("line").startswith("[") & F.try_parse_json("line").isNull()).select("file").collect()]  # names of files


def json_records(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON arrays and lines, and what is none (record_id: its file, reason, record): nothing is dropped silently.

    A file that begins with "[" is read as one array, however it is laid out (a file of that kind is one row, so under 2
    GB); other files by line, of which each is an object or an array of objects. Broken lines, lines or elements that are
    JSON but no objects, and objects with a field that is not of its type go to quarantine as a whole, so that they can be
    mended and read again; so does an array that is not well-formed, as one record. The reason shows a record's head.
    """
    arrays = _array_files(spark, path)
    text = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file")).where("line <> ''")
    text = text.where(~F.col("file").isin(arrays)) if arrays else text
    if arrays:
        whole = spark.read.text(arrays, wholetext=True).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"))
        text = text.unionByName(whole)
    listed = F.col("line").startswith("[")
    each = F.when(listed, F.from_json("line", "array<string>")).otherwise(F.array("line"))
    parsed = text.select("file", "line", F.try_parse_json("line").isNull().alias("broken"), each.alias("each"))
    rows = parsed.where("not broken").select("file", F.explode("each").alias("item")).withColumn("item", F.trim("item"))
    ok = F.coalesce(F.col("item").startswith("{"), F.lit(False))
    strict = StructType([*schema.fields, StructField("_misfit", StringType())])
    read = rows.where(ok).select("file", "item", F.from_json("item", strict, {"columnNameOfCorruptRecord": "_misfit"}).alias("r"))
    fits = F.col("r._misfit").isNull()
    good = read.where(fits).select(*(F.col(f"r.`{f.name}`") for f in schema.fields))

    def said(df: DataFrame, why: str, c: str) -> DataFrame:
        return df.select(F.col("file").alias("record_id"), F.concat(F.lit(f"{why}: "), F.coalesce(F.substring(c, 1, 200), F.lit("null"))).alias("reason"), F.col(c).alias("record"))

    return good, by_name([said(parsed.where("broken"), "malformed json", "line"), said(rows.where(~ok), "no object", "item"), said(read.where(~fits), "field of another type", "item")])


def csv_records(spark: SparkSession, path: str, casts: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header; all columns are text but those cast, whose bad values become null."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in (casts or {}).items() if c in df.columns})


def by_name(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def record_type() -> Column:
    """Record type of a row from the name of the file that it comes from; null for unknown files."""
    stem = F.lower(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in RECORD_TYPES.items() for x in kv)), stem)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """path, sha256 and ok of every file: whether its checksum is that of `expected` (name, sha256); an unexpected file is not ok."""
    found = checksums(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    wanted = expected.select("name", F.lower("sha256").alias("wanted"))
    return found.join(wanted, "name", "left").select("path", "sha256", F.coalesce(F.col("sha256") == F.col("wanted"), F.lit(False)).alias("ok"))


def raw_store(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A raw store's records of one type: its `*.json` rows, then those of its Parquet files; not of folders below."""
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = []
    for kind in ("json", "parquet"):
        if len(fs.globStatus(where(f"{folder}/*.{kind}"))):  # names alone, no contents
            parts.append(spark.read.format(kind).schema(schema).option("pathGlobFilter", f"*.{kind}").load(folder))
    return by_name(parts) if parts else spark.createDataFrame([], schema)


def checkpoints(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All finished records of a checkpoint folder (one JSON file each); those that are not well-formed are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder)


def row_counts(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """name and n of Parquet tables; a count reads no column, only the files' footers and row groups' sizes."""
    return by_name([table(spark, folder, k).agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k in names])


def config_digest(config: dict) -> str:
    """Twelve hex digits that tell configurations apart, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def batch_id(run_id: str, config: dict) -> str:
    """Name of a batch: the head of its run and its configuration's digest."""
    return f"{run_id[:8]}-{config_digest(config)}"


def manifests(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The manifests of all batches below a root, the last run first."""
    return spark.read.schema(schema).json(f"{root}/*/manifest.json").orderBy(F.col("run_id").desc())


def write_rows(df: DataFrame, path: str) -> bool:
    """Overwrite a Parquet table; without rows nothing is written and the old table stays. Says whether it wrote."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_report(df: DataFrame, path: str) -> None:
    """A manifest, state, coverage or report as JSON, by partitions of nothing but its rows."""
    df.write.mode("overwrite").json(path)


def upsert_json(df: DataFrame, path: str, key: str, order: str, buckets: int = 64) -> None:
    """One JSON record for each key, the last by order: a key that is written again is replaced, others stay.

    Records lie in folders by a hash of their key, `buckets` of them, however many keys there are. Only the folders of new
    keys are read and written again; the merged ones are written aside first, and Spark puts each in its place as a whole.
    """
    spark, columns = df.sparkSession, df.columns
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    last = df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")
    fresh = last.select(bucket.alias("bucket"), F.col(key).cast("string").alias("_key"), F.to_json(F.struct(*columns)).alias("value"))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        old = spark.read.schema("value string, bucket int").text(path)
        old = old.join(F.broadcast(fresh.select("bucket").distinct()), "bucket", "left_semi").withColumn("_key", F.get_json_object("value", f"$['{key}']"))  # `buckets` rows at most
        fresh = fresh.unionByName(old.join(fresh.select("_key"), "_key", "left_anti"))
    ready = written(fresh.select("bucket", "value"), "records")
    ready.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").text(path)


def merge_table(new: DataFrame, path: str, keys: list[str], score: Column, order: Column) -> None:
    """Existing and new rows of a plain Parquet folder, the best of each key; `versions.merge` does this for committed tables.

    The result is written beside the old table and moved in its place by two renames, so that a write that fails leaves the
    old rows; if a job ends between the renames, the next call puts the old table back first.
    """
    from ..operators.dedup import upsert

    spark = new.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    before, after = where(f"{path.rstrip('/')}.before"), f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    if fs.exists(before) and not fs.exists(where(path)):
        fs.rename(before, where(path))
    upsert(spark.read.parquet(path), new, keys, score, order).write.parquet(after)
    fs.delete(before, True)
    if not (fs.rename(where(path), before) and fs.rename(where(after), where(path))):
        raise OSError(f"{path} could not be replaced; its rows are in it or in {path}.before")
    fs.delete(before, True)


def write_batch(df: DataFrame, root: str, batch_id: str, kind: str) -> None:
    """A table of a frozen batch; an existing one is not overwritten."""
    df.write.mode("errorifexists").parquet(f"{root}/batch_id={batch_id}/record_type={kind}")


def features(spark: SparkSession, root: str, batch_id: str, name: str, tiers: list[str]) -> DataFrame:
    """A feature table with rows of the accepted tiers only."""
    return tier_filter(spark.read.parquet(f"{root}/{batch_id}/{name}.parquet"), tiers)


def date_slices(first: str, last: str, n: int) -> list[tuple[str, str]]:
    """[from, to) split in n slices of days, the last with what is left over."""
    from datetime import date, timedelta

    a, b = date.fromisoformat(first), date.fromisoformat(last)
    step = max(1, (b - a).days // n)
    cuts = [a + timedelta(days=step * i) for i in range(n)]
    return [(x.isoformat(), y.isoformat()) for x, y in zip(cuts, [*cuts[1:], b], strict=True) if x < y]


def read_slices(spark: SparkSession, url: str, dbtable: str, column: str, first: str, last: str, n: int, properties: dict[str, str]) -> DataFrame:
    """A JDBC table by date slices, one partition each."""
    where = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in date_slices(first, last, n)]
    return spark.read.jdbc(url, dbtable, predicates=where, properties=properties)
