"""Benchmark results: resumable sinks, CSV scans that read their configuration from the file name, and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import nf_and_technique, rates

SINGLE = "it int, bps bigint, pps bigint"
MULTI = "it int, nb_cores int, bps bigint, pps bigint"
_SINGLE_NAME = r"^(.+)-single-core-(fw|nop|telemetry)(?:_batch_([a-z]+))?(?:-lbatch([0-9]+))?\.csv$"
_MULTI_NAME = r"^(.+)-multi-core-(\w+)-lbatch([0-9]+)\.csv$"


def append_missing(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table at path lacks, so that a run that was cut off can be resumed."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    rows.write.mode("append").parquet(path)


def file_fields(df: DataFrame, file: str = "file") -> DataFrame:
    """trace, nf, technique, lbatch from single-core file names; others are left out."""
    part = lambda i: F.regexp_extract(file, _SINGLE_NAME, i)
    technique = F.when(part(3) == "", "baseline").otherwise(part(3))
    return df.where(F.col(file).rlike(_SINGLE_NAME)).select(part(1).alias("trace"), part(2).alias("nf"), technique.alias("technique"), F.expr(f"try_cast(nullif(regexp_extract({file}, '{_SINGLE_NAME.replace(chr(92), chr(92) * 2)}', 4), '') AS int)").alias("lbatch"), *df.columns)


def multi_file_fields(df: DataFrame, file: str = "file") -> DataFrame:
    part = lambda i: F.regexp_extract(file, _MULTI_NAME, i)
    df = df.where(F.col(file).rlike(_MULTI_NAME))
    return df.select(part(1).alias("trace"), *nf_and_technique(part(2)), part(3).cast("int").alias("lbatch"), *df.columns)


def read_single(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SINGLE).option("comment", "#").csv(path).withColumn("file", F.col("_metadata.file_name"))
    return file_fields(rows)


def read_multi(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(MULTI).option("comment", "#").csv(path).withColumn("file", F.col("_metadata.file_name"))
    return multi_file_fields(rows)


def latest_histogram(lines: DataFrame) -> DataFrame:
    """run_id, stride_size, n in: of repeated sizes the last run counts, missing sizes up to the largest get 0."""
    last = lines.groupBy("stride_size").agg(F.max_by("n", "run_id").alias("n"))
    sizes = last.agg(F.max("stride_size").alias("m")).select(F.explode(F.sequence(F.lit(1), "m")).alias("stride_size"))
    return sizes.join(last, "stride_size", "left").select("stride_size", F.coalesce("n", F.lit(0)).alias("n"))


def read_stride_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, stride_size, n of histogram files to which runs may have been appended: the last line of a size counts, missing
    sizes up to the largest get 0."""
    lines = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("run_id", "line"))
    lines = lines.where(F.col("line").rlike("^[0-9]+,[0-9]+")).select("file", "run_id", F.split_part("line", F.lit(","), F.lit(1)).cast("int").alias("stride_size"), F.trim(F.split_part("line", F.lit(","), F.lit(2))).cast("long").alias("n"))
    last = lines.groupBy("file", "stride_size").agg(F.max_by("n", "run_id").alias("n"))
    sizes = last.groupBy("file").agg(F.max("stride_size").alias("m")).select("file", F.explode(F.sequence(F.lit(1), "m")).alias("stride_size"))
    return sizes.join(last, ["file", "stride_size"], "left").select("file", "stride_size", F.coalesce("n", F.lit(0)).alias("n"))


def parse_bench_report(df: DataFrame, text: str = "report") -> DataFrame:
    """Totals and rates of a benchmark report."""
    get = lambda p, kind: F.regexp_extract(text, p, 1).cast(kind)
    df = df.select(
        *[c for c in df.columns if c != text],
        get(r"\sTX\s+(\d+)\s+pkts", "long").alias("tx_pkts"),
        get(r"\sTX\s+\d+\s+pkts\s+(\d+) bytes", "long").alias("tx_bytes"),
        get(r"\sRX\s+(\d+)\s+pkts", "long").alias("rx_pkts"),
        get(r"\sRX\s+\d+\s+pkts\s+(\d+) bytes", "long").alias("rx_bytes"),
        get(r"\sElapsed\s+([\d.]+) seconds", "double").alias("elapsed"),
    )
    return df.select("*", *rates(F.col("tx_pkts"), F.col("rx_pkts"), F.col("rx_bytes"), F.col("elapsed")))


def parse_stats_report(df: DataFrame, text: str = "report") -> DataFrame:
    get = lambda p: F.regexp_extract(text, p, 1).cast("long")
    return df.select(*[c for c in df.columns if c != text], get(r"TX:\s+(\d+) pkts").alias("tx_pkts"), get(r"TX:\s+\d+ pkts (\d+) bytes").alias("tx_bytes"), get(r"RX:\s+(\d+) pkts").alias("rx_pkts"), get(r"RX:\s+\d+ pkts (\d+) bytes").alias("rx_bytes"))


def parse_stride_report(df: DataFrame, text: str = "report") -> DataFrame:
    """stride_size, n_strides for every size from 1 to the largest one in the report."""
    pattern = r"Stride size (\d+): (\d+) packets"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("s"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("n"))
    seen = F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["s"].cast("int"), x["n"].cast("long"))))
    df = df.withColumn("__m", seen).where(F.size("__m") > 0)
    df = df.withColumn("stride_size", F.explode(F.sequence(F.lit(1), F.array_max(F.map_keys("__m")))))
    return df.withColumn("n_strides", F.coalesce(F.try_element_at("__m", F.col("stride_size")), F.lit(0))).drop("__m", text)
