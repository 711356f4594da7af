"""Costly expressions on distinct values only."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def on_distinct(df: DataFrame, keys: Sequence[str], expressions: dict[str, Column]) -> DataFrame:
    """Evaluate ``expressions`` once per distinct key combination and join them back."""
    distinct = df.select(*keys).distinct().withColumns(expressions)
    renamed = distinct.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(renamed, condition, "left").drop(*[f"_k_{k}" for k in keys])


@F.pandas_udf(T.StringType())
def _compatibility_form(names: pd.Series) -> pd.Series:
    return names.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def folded_names(df: DataFrame, column: str, output: str) -> DataFrame:
    """``df`` with the compatibility form (NFKC) of a name column.

    Spark has no such function.  Only distinct names with other than ASCII letters reach Python, once each; all other
    names are their own form and stay in the JVM.
    """
    odd = df.select(F.col(column).alias("_raw")).where(F.col("_raw").rlike(r"[^\x00-\x7F]")).distinct()
    forms = odd.withColumn("_nfkc", _compatibility_form("_raw"))
    joined = df.join(forms, F.col(column) == F.col("_raw"), "left")
    return joined.withColumn(output, F.coalesce("_nfkc", F.col(column))).drop("_raw", "_nfkc")
