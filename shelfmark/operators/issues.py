"""Issue rows: building them, adding severities, and the promotion gate.

The code of an issue is the stable value that severities hang on.  Its message
is a rule identifier of this library, ``area.fact``: the fact that should hold
and does not.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

COLUMNS = ["code", "subject", "message"]


def rule(condition: Column, code: str | Column, message: str | Column) -> Column:
    """One rule: STRUCT<code,message> when the condition holds, else null."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(
        F.coalesce(condition, F.lit(False)),
        F.struct(as_col(code).alias("code"), as_col(message).alias("message")),
    )


def apply_rules(df: DataFrame, rules: Iterable[Column], *keep: str | Column) -> DataFrame:
    """One output row per broken rule and input row, with the ``keep`` columns.

    The rules are exploded before the unbroken ones are dropped: that stays in
    generated code, while a filter over the array would evaluate all rules in
    interpreted mode.
    """
    each = df.select(*keep, F.explode(F.array(*rules)).alias("_rule")).filter(F.col("_rule").isNotNull())
    return each.select("*", "_rule.code", "_rule.message").drop("_rule")


def issue_rows(df: DataFrame, code: str, message: str, subject: str | Column) -> DataFrame:
    """The rows of ``df`` as issues of one code."""
    subject = F.col(subject) if isinstance(subject, str) else subject
    return df.select(F.lit(code).alias("code"), subject.cast("string").alias("subject"), F.lit(message).alias("message"))


def all_issues(*streams: DataFrame) -> DataFrame:
    """Union of issue streams, each distinct problem of a subject once."""
    return reduce(DataFrame.unionByName, (s.select(*COLUMNS) for s in streams)).distinct()


def issue_codes(spark) -> DataFrame:
    """Dimension of the stable codes: code, area, severity."""
    rows = [(code, area, severity) for code, (area, severity) in fixed.ISSUE_CODES.items()]
    return spark.createDataFrame(rows, "code string, area string, severity string")


def with_severity(issues: DataFrame) -> DataFrame:
    """Area and severity added; codes outside the table are errors of their own."""
    codes = issue_codes(issues.sparkSession)  # a fixed table of some 60 rows
    return (
        issues.join(F.broadcast(codes), "code", "left")
        .withColumn("area", F.coalesce("area", F.lit("validation")))
        .withColumn("severity", F.coalesce("severity", F.lit("BLOCKER")))
    )


def gate(issues: DataFrame, run: str, resolved: str | None = None) -> DataFrame:
    """Per run: counts of unresolved BLOCKER and REVIEW issues, and whether promotion may go on."""
    open_issue = ~F.coalesce(F.col(resolved), F.lit(False)) if resolved else F.lit(True)
    blocker = F.col("severity").contains("BLOCKER") & open_issue
    review = F.col("severity").contains("REVIEW") & ~F.col("severity").contains("BLOCKER") & open_issue
    return (
        with_severity(issues)
        .groupBy(run)
        .agg(F.count_if(blocker).alias("blockers"), F.count_if(review).alias("reviews"))
        .withColumn("allowed", (F.col("blockers") == 0) & (F.col("reviews") == 0))
    )
