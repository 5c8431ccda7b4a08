"""Reading and writing trace records, feature tables and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("item_id", "dataset", "problem", "prompt", "ground_truth", "answer_type", "answer_extraction", "full_response", "reasoning_trace", "answer_text", "extracted_answer", "comparison_method", "model_name", "model_short_name", "backend", "timestamp", "error")]
    + [T.StructField(n, T.LongType()) for n in ("trace_token_count", "trace_length", "total_generated_tokens", "prompt_tokens", "reasoning_tokens")]
    + [T.StructField(n, T.DoubleType()) for n in ("generation_time_seconds", "mean_log_prob", "temperature")]
    + [T.StructField("is_correct", T.BooleanType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
CORRUPT = "_corrupt_record"
#: Names of files that are no input, and endings that are no part of a group's name.
SKIPPED, SUFFIXES = r"^(?:pilot_|_)|_sc(?:\.|_|$)", ("_traces", "_parsed", "_features", "_ngrams", "_graph", "_timing", "_ph")


def file_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)


def group_of(name: Column) -> Column:
    """A file's group: its name without ending and known suffixes."""
    return F.regexp_replace(F.regexp_replace(name, r"(?:\.[A-Za-z0-9]+)+$", ""), f"(?:{'|'.join(SUFFIXES)})+$", "")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = TRACE, *, strict: bool = False) -> DataFrame:
    """One row per line of JSON, with its group from the file's name; blank lines are skipped.

    Lines that are no JSON have all columns null and stand in _corrupt_record; ``strict`` fails on them.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(wide).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.select("*", file_name().alias("_file")).where(~F.col("_file").rlike(SKIPPED)).withColumn("group", group_of(F.col("_file"))).drop("_file")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Feature rows of one or many files, with the group of each file; numbers that are missing or not finite are 0."""
    rows = spark.read.schema(schema).option("header", True).csv(path).select("*", group_of(file_name()).alias("group"))
    return finite(rows, [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)])


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Enriched records as lines of JSON, in as many files as tasks; nulls are left out and read back as nulls."""
    rows.write.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A feature family as CSV, a folder for each group."""
    rows.write.option("header", True).partitionBy("group").csv(path)


def read_csv_family(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``write_csv`` wrote, with the group of each row; numbers that are missing or not finite are 0."""
    wide = T.StructType([*schema.fields, T.StructField("group", T.StringType())])
    return finite(spark.read.schema(wide).option("header", True).csv(path), [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)])


RESULTS = "dataset string, results map<string,map<string,map<string,double>>>"


def write_results(metrics: DataFrame, path: str) -> None:
    """(dataset, baseline, classifier, metric, value) as one line of JSON per data set: baseline, classifier, metric."""
    one = metrics.groupBy("dataset", "baseline", "classifier").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    two = one.groupBy("dataset", "baseline").agg(F.map_from_entries(F.collect_list(F.struct("classifier", "m"))).alias("m"))
    two.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("baseline", "m"))).alias("results")).write.json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_results``, of one or many files."""
    rows = spark.read.schema(RESULTS).json(path).select("dataset", F.explode("results").alias("baseline", "m"))
    return rows.select("dataset", "baseline", F.explode("m").alias("classifier", "m")).select("dataset", "baseline", "classifier", F.explode("m").alias("metric", "value"))


def best_classifiers(results: DataFrame, metric: str = "auroc_mean") -> DataFrame:
    """(dataset, baseline, classifier, value): of each baseline the classifier with the highest metric, the first by name of equal ones."""
    rows = results.where(F.col("metric") == metric)
    return rows.groupBy("dataset", "baseline").agg(F.min_by("classifier", F.struct(-F.col("value"), F.col("classifier"))).alias("classifier"), F.max("value").alias("value"))


def finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, NaN and infinities of the columns as 0."""
    return rows.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)) for c in columns})


def read_table(spark: SparkSession, path: str, *, provenance: DataFrame | None = None, policy: str = "warn") -> DataFrame:
    """A Parquet table; ``provenance`` (source, leaky) tells of columns learned on held-out rows: allow, warn or fail."""
    if provenance is not None and policy != "allow":
        leaky = [r["source"] for r in provenance.where("leaky").select("source").limit(100).collect()]
        if leaky and policy == "fail":
            raise ValueError(f"leaky sources: {', '.join(leaky)}")
        if leaky:
            import warnings

            warnings.warn(f"leaky sources: {', '.join(leaky)}", stacklevel=2)
    return spark.read.parquet(path)


def usable_traces(rows: DataFrame) -> DataFrame:
    """Rows with a text: the trace, or else the full response."""
    text = F.coalesce(F.nullif("reasoning_trace", F.lit("")), F.col("full_response"))
    return rows.withColumn("text", text).where(F.trim(F.coalesce("text", F.lit(""))) != "")


def limited(rows: DataFrame, key: str, n: int | None) -> DataFrame:
    """The first rows by key, the same at each run."""
    return rows if n is None else rows.orderBy(key).limit(n)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Write the rows whose keys are not at ``path`` yet, and give those rows: a run that stopped resumes where it was."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    new = rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if there else rows
    new.write.mode("append").parquet(path)
    return new


def write_family(rows: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """A feature family, one folder per group; groups that are there already stay unless ``overwrite``, and no others are touched."""
    spark = rows.sparkSession
    if not overwrite:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            rows = rows.join(spark.read.parquet(path).select("group").distinct(), "group", "left_anti")
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("group").parquet(path)


def repaired(rows: DataFrame) -> DataFrame:
    """Rows whose trace is ten characters at most get it from the full response, with its lengths; written elsewhere, never in place."""
    from tracelore.functions.answers import repaired_trace, think_block

    rows = rows.withColumn("_short", F.char_length(F.coalesce("reasoning_trace", F.lit(""))) <= 10)
    short = F.col("_short")
    rows = rows.withColumn("answer_text", F.when(short, think_block(F.col("full_response")).getField("answer")).otherwise(F.col("answer_text")))
    rows = rows.withColumn("reasoning_trace", repaired_trace(F.col("reasoning_trace"), F.col("full_response")))
    words = F.size(F.filter(F.split(F.coalesce("reasoning_trace", F.lit("")), r"\s+"), lambda x: x != ""))
    return rows.withColumns({"trace_length": F.when(short, F.char_length("reasoning_trace")).otherwise(F.col("trace_length")), "trace_token_count": F.when(short, words).otherwise(F.col("trace_token_count"))}).drop("_short")
