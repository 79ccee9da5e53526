"""HTML audit and repair over a table of pages, and code-fence removal."""

from pyspark.sql import DataFrame, functions as F

from ..functions.kinds import quoted
from ..functions.markup import (
    CHART_LIBRARIES,
    EMPTY_PAGE,
    REPAIRS,
    has,
    head_content,
    is_unloaded,
    position,
    starts_with_doctype,
    without_fence,
)


def audit_html(df: DataFrame, column: str) -> DataFrame:
    """Add one boolean per required part, and which chart libraries are used but not loaded."""
    text = quoted(column)
    head = head_content(text)
    unloaded = [F.when(is_unloaded(text, name, script), F.lit(name)) for name, script, _ in CHART_LIBRARIES]
    return df.select(
        "*",
        starts_with_doctype(text).alias("has_doctype"),
        has(text, "<html").alias("has_html"),
        (position(text, "<head>") > 0).alias("has_head"),
        has(head, "<meta charset").alias("has_charset"),
        has(text, "<body").alias("has_body"),
        has(head, '<meta name="viewport"').alias("has_viewport"),
        F.contains(head, F.lit('<meta http-equiv="Content-Security-Policy"')).alias("has_csp"),
        F.concat_ws(",", *unloaded).alias("unloaded_libraries"),
    )


def repair_html(df: DataFrame, column: str) -> DataFrame:
    """Add what is missing: doctype, html, head, charset, body, viewport, scripts of chart libraries in use. Repairing twice
    changes nothing."""
    out = df.withColumn(column, F.when(F.coalesce(F.length(quoted(column)), F.lit(0)) == 0, EMPTY_PAGE).otherwise(quoted(column)))
    for repair in REPAIRS:
        out = out.withColumn(column, repair(quoted(column)))
    return out


def strip_code_fence(df: DataFrame, column: str, language: str = "html") -> DataFrame:
    return df.withColumn(column, without_fence(quoted(column), language))
