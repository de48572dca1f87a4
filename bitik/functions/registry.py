"""The column functions as SQL functions of a session.

Each is a SQL function whose body is the text of the column's own expression, so a query that calls it is optimised
and compiled as if the expression stood in it; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from bitik.functions import text as tx, translit as tr
from bitik.functions.alphabet import JS_SPACE

PREFIX = "bitik_"
FUNCTIONS = {
    "skeleton_key": tx.skeleton_key, "detect_script": lambda w: tx.detect_script(F.lower(w)), "case_pattern": tx.case_pattern, "letter_count": tx.letter_count, "is_marked": tx.is_marked, "is_packable": tx.is_packable,
    "bare": tx.bare, "ascii_form": tx.ascii_form, "fold_confusables": tx.fold_confusables, "strip_apostrophes": tx.strip_apostrophes, "russian_layout": tx.russian_layout, "html_escape": tx.html_escape,
    "old_to_new": tr.old_to_new, "new_to_old": tr.new_to_old, "literal": tr.literal, "cyrillic_to_new": tr.cyrillic_to_new, "cyrillic_rule": tr.cyrillic_rule, "new_to_cyrillic": tr.new_to_cyrillic,
}


def _text(spark: SparkSession, column: Column) -> tuple[str, str]:
    """The SQL text and the type of an expression over the string column w."""
    rows = spark.createDataFrame([], "w string").select(column.alias("x"))
    return rows._jdf.queryExecution().analyzed().expressions().head().child().sql(), dict(rows.dtypes)["x"]


def register(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Create every function and the table function `tokens` (pos, token) of a text; their names."""
    for name, function in FUNCTIONS.items():
        body, kind = _text(spark, function(F.col("w")))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(w STRING) RETURNS {kind} RETURN {body}")
    plain = F.regexp_replace(tx.fold_confusables(F.col("w")), f"[^{JS_SPACE}]*(?:{tx.ANCHOR})[^{JS_SPACE}]*", " ")
    body, _ = _text(spark, tx.tokens_of(plain))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}tokens(w STRING) RETURNS TABLE (pos INT, token STRING) RETURN SELECT pos, nullif(col, '{tx.GLUED}') FROM (SELECT posexplode({body}))")
    return [f"{prefix}{n}" for n in (*FUNCTIONS, "tokens")]
