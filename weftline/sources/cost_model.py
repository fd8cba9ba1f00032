"""Cost models as JSON: three coefficients, r_squared and the inlier threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("coeff_attr", "coeff_meta", "coeff_other", "r_squared", "inlier_threshold")


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """One row with the fields. A file that is no JSON or lacks a field raises ValueError."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", ", ".join(f"{f} double" for f in FIELDS)).alias("m")).select("m.*")
    if row.filter(" OR ".join(f"{f} IS NULL" for f in FIELDS)).limit(1).count() or row.isEmpty():
        raise ValueError(f"{path} is no cost model")
    return row


def write_model(model: DataFrame, path: str) -> None:
    """The fields of the model's row as JSON in the folder path."""
    model.select(*FIELDS).coalesce(1).write.mode("overwrite").json(path)


def of_fit(spark: SparkSession, fit: dict | None) -> DataFrame:
    """The row of a fit with three predictors; none if there is no fit."""
    rows = [(*fit["coefficients"], fit["r_squared"], fit["inlier_threshold"])] if fit else []
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FIELDS))
