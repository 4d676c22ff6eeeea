"""Row policy: views that show the rows of one organization, named by a session variable of SQL.

A secured view holds the predicate; nobody who reads it can leave it out. Without the variable's being set, or set to the empty
string, it shows nothing. The variable's value is a constant of the plan, so the predicate reaches the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLE = "tallywright_organization"


def declare(spark: SparkSession) -> None:
    """The variable, not set."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {VARIABLE} STRING DEFAULT NULL")


def act_for(spark: SparkSession, organization: str | None) -> None:
    """Who the session acts for from now on; plans made before keep theirs."""
    spark.sql(f"SET VAR {VARIABLE} = :organization", args={"organization": organization})


def secure(spark: SparkSession, path: str, view: str, column: str = "organization_id") -> None:
    """The view of a parquet table under the policy."""
    if not all(re.fullmatch(r"[a-z_][a-z0-9_]*", x) for x in (view, column)):
        raise ValueError("a view and its column need plain names")
    quoted = path.replace("`", "``")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view} AS SELECT * FROM parquet.`{quoted}` WHERE {column} = nullif({VARIABLE}, '')")


def admitted(spark: SparkSession, rows: DataFrame, column: str = "organization_id") -> DataFrame:
    """rows to be written: one of another organization, or of none, fails the write, and so does a session that acts for none."""
    own = F.expr(f"nullif({VARIABLE}, '')")
    refused = F.raise_error(F.lit("a row of another organization"))
    return rows.withColumn(column, F.when(F.col(column) == own, F.col(column)).otherwise(refused))
