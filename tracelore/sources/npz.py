"""NumPy archives as rows: predictions, step embeddings, hidden states."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelore.sources.records import group_of

PREDICTIONS = "group string, item_id string, y_true int, oof_prob double, oof_fold int"
STEPS = "group string, item_id string, is_correct int, step int, step_type int, embedding array<float>"


def _archives(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select(group_of(name).alias("file_group"), "content")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Held-out predictions of every archive under a path; the four keys item_ids, groups, y_true and oof_prob must be there, oof_fold may."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                z = np.load(io.BytesIO(content), allow_pickle=False)
                missing = {"item_ids", "groups", "y_true", "oof_prob"} - set(z.files)
                if missing:
                    raise ValueError(f"keys missing: {sorted(missing)}")
                n = len(z["item_ids"])
                fold = pd.array(z["oof_fold"].astype(int), "Int32") if "oof_fold" in z.files else pd.array([None] * n, "Int32")
                yield pd.DataFrame({"group": z["groups"].astype(str), "item_id": z["item_ids"].astype(str), "y_true": z["y_true"].astype(int), "oof_prob": z["oof_prob"].astype(float), "oof_fold": fold})

    return _archives(spark, path).mapInPandas(run, PREDICTIONS)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Step embeddings of every archive: item_ids, is_correct, offsets (one more than items) and embeddings, step_types if there are any."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for group, content in zip(part["file_group"], part["content"], strict=True):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                size = np.diff(z["offsets"])
                item = np.repeat(np.arange(len(size)), size)
                step = np.arange(len(item)) - np.repeat(z["offsets"][:-1], size)
                kind = z["step_types"] if "step_types" in z.files else np.zeros(len(item), int)
                yield pd.DataFrame({"group": group, "item_id": z["item_ids"].astype(str)[item], "is_correct": z["is_correct"].astype(int)[item], "step": step, "step_type": kind, "embedding": list(z["embeddings"].astype(np.float32))})

    return _archives(spark, path).mapInPandas(run, STEPS)


def _write(packed: DataFrame, path: str) -> None:
    """Rows (group, content), one archive each, to files named for the group: they pass through the driver one by one."""
    spark = packed.sparkSession
    jvm = spark.sparkContext._jvm
    for r in packed.toLocalIterator():
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{r['group']}.npz")
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
        out.write(bytearray(r["content"]))
        out.close()


def write_predictions(rows: DataFrame, path: str) -> None:
    """(group, item_id, y_true, oof_prob, oof_fold) as one archive per group."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item_id")
        out = io.BytesIO()
        np.savez(out, item_ids=part["item_id"].to_numpy(str), groups=part["group"].to_numpy(str), y_true=part["y_true"].to_numpy(int), oof_prob=part["oof_prob"].to_numpy(float), oof_fold=part["oof_fold"].to_numpy(int))
        return pd.DataFrame({"group": [part["group"].iloc[0]], "content": [out.getvalue()]})

    _write(rows.select("group", "item_id", "y_true", "oof_prob", "oof_fold").groupBy("group").applyInPandas(pack, "group string, content binary"), path)


def write_steps(rows: DataFrame, path: str) -> None:
    """(group, item_id, is_correct, step, step_type, embedding) as one archive per group, items in order with the place of each one's first step."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["item_id", "step"])
        items = part.groupby("item_id", sort=True)
        out = io.BytesIO()
        np.savez(out, item_ids=np.array(list(items.groups), str), is_correct=items["is_correct"].first().to_numpy(int), offsets=np.append(0, np.cumsum(items.size().to_numpy())), embeddings=np.array(part["embedding"].tolist(), np.float32), step_types=part["step_type"].to_numpy(int))
        return pd.DataFrame({"group": [part["group"].iloc[0]], "content": [out.getvalue()]})

    _write(rows.select("group", "item_id", "is_correct", "step", "step_type", "embedding").groupBy("group").applyInPandas(pack, "group string, content binary"), path)


def by_dimension(steps: DataFrame) -> DataFrame:
    """Traces and vectors of each group and embedding size."""
    return steps.groupBy("group", F.size("embedding").alias("dimension")).agg(F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_steps"))
