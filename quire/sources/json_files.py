"""JSON and text sources that bear missing and broken files, and the sinks beside them."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markup
from pyspark.sql.types import StringType, StructType


def tolerant_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Whole-file JSON with `schema`; a broken file gives nulls and `_broken`, a missing path no rows."""
    wide = StructType([*schema.fields]).add("_broken", StringType())
    try:
        return spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], wide)


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of `first` that aren't broken, or those of `second` if there are none."""
    good = first.filter("_broken is null").drop("_broken")
    return good if good.take(1) else second.filter("_broken is null").drop("_broken")


def formula_files(spark: SparkSession, path: str) -> DataFrame:
    """(page, display, inline) of files page-N.mmd: their formulas."""
    files = spark.read.text(path, wholetext=True).select(markup.formula_candidates(F.col("value")).alias("f"), F.regexp_extract(F.input_file_name(), r"page-(\d+)\.mmd$", 1).cast("int").alias("page"))
    return files.filter("page is not null").select("page", "f.display", "f.inline")


def assets(files: DataFrame) -> DataFrame:
    """(sha, kind, content) of binary `content`: each asset once, named by its hash, its kind from its first bytes."""
    start = F.hex(F.substring("content", 1, 8))
    kind = F.when(start.startswith("89504E47"), "png").when(start.startswith("FFD8FF"), "jpeg").when(start.startswith("47494638"), "gif").when(start.startswith("25504446"), "pdf").otherwise("other")
    return files.select(F.sha2("content", 256).alias("sha"), kind.alias("kind"), "content").dropDuplicates(["sha"])


def replace_version(df: DataFrame, folder: str) -> str:
    """Writes a new version beside the older ones and returns its path; readers switch when they are given it."""
    path = f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.json(path)
    return path
