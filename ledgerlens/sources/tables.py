"""Readers and writers: Parquet (files or folders), CSV with a schema, JSON label maps, artifacts, models."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USERS = "id long, current_age int, retirement_age string, birth_year int, birth_month int, gender string, address string, latitude double, longitude double, per_capita_income string, yearly_income string, total_debt string, num_credit_cards int"
CARDS = "id long, client_id long, card_brand string, card_type string, card_number string, expires string, cvv string, has_chip string, credit_limit string, acct_open_date string, year_pin_last_changed int, card_on_dark_web string"


def read_parquet(spark: SparkSession, *paths: str, merge: bool | None = None) -> DataFrame:
    """One or more Parquet files or folders as one table; columns are matched by name.

    ``merge`` looks into every file's footer for columns; by default only where there are several paths. A path that
    isn't there, or a folder without Parquet files, is a FileNotFoundError.
    """
    for path in paths:
        fs, p = _at(spark, path)
        found = fs.globStatus(p)
        if not found:
            raise FileNotFoundError(path)
        for status in found:
            if status.isDirectory() and not any(not x.getPath().getName().startswith(("_", ".")) for x in fs.listStatus(status.getPath())):
                raise FileNotFoundError(f"no files in {path}")
    return spark.read.option("mergeSchema", len(paths) > 1 if merge is None else merge).parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_labels(spark: SparkSession, path: str, as_is: bool = False) -> DataFrame:
    """``{"target": {id: "Yes" | "No"}}`` as (id, fraud): "Yes" is 1, anything else 0; of a repeated id the largest counts.

    ``as_is`` gives a row for each entry instead, with null for a null answer and for an empty id.
    A file holds a document on each line (read line by line), or any documents over any lines (read as one text); what
    is no such document is an error. One JSON document is read by one task: convert it to Parquet once, then read that.
    """
    parsed = lambda text, mode: F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<struct<target:map<string,string>>>", {"mode": mode})
    file, lines = F.col("_metadata.file_path"), spark.read.text(path).where(F.trim(F.col("value"), F.lit(" \t\r")) != "")
    broken = [r[0] for r in lines.where(F.size(parsed(F.col("value"), "PERMISSIVE")).isNull()).select(file).distinct().collect()]
    documents = lines.where(~file.isin(broken)).select(parsed(F.col("value"), "FAILFAST").alias("documents"))
    if broken:
        # In a string, too, "} {" may become "},{": neither is an id, or "Yes".
        joined = F.regexp_replace("value", r"\}\s*\{", "},{")
        documents = documents.union(spark.read.text(path, wholetext=True).where(file.isin(broken)).select(parsed(joined, "FAILFAST")))
    pairs = documents.select(F.explode("documents").alias("document")).select(F.explode("document.target").alias("id", "answer"))
    if as_is:
        return pairs.select(F.nullif(F.trim("id"), F.lit("")).cast("long").alias("id"), (F.col("answer") == "Yes").cast("int").alias("fraud"))
    return pairs.groupBy(F.trim("id").cast("long").alias("id")).agg(F.max((F.coalesce(F.col("answer"), F.lit("")) == "Yes").cast("int")).alias("fraud"))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """For small results such as metrics: one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_scores(df: DataFrame, path: str, id_col: str = "id") -> None:
    df.select(id_col, "score").write.mode("overwrite").parquet(path)


def _at(spark: SparkSession, path: str):
    """A path with the Hadoop file system that it belongs to, so that any store Spark knows will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save_artifacts(values: Mapping, path: str) -> None:
    """A few fitted values as one JSON object."""
    fs, p = _at(SparkSession.active(), path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(values, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


def load_artifacts(path: str) -> dict:
    spark = SparkSession.active()
    _, p = _at(spark, path)
    return json.loads(spark.read.text(p.toString(), wholetext=True).first()[0])


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``); in local mode without one, in the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
