"""Strict JSON: a value type, or one error with its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphworks.functions.kernels import json_check

#: What the error codes mean.
MESSAGES = {
    "trailing_comma": "A comma stands before a closing bracket.", "unexpected_end": "The text ends inside a value.", "comment_not_allowed": "JSON has no comments.",
    "single_quoted_string": "Strings and names need double quotes.", "expected_value": "A value is missing.", "expected_property_name": "A quoted property name is missing.",
    "expected_colon": "A colon is missing after a property name.", "expected_comma_or_end": "A comma or a closing bracket is missing.", "extra_data": "Something follows the value.",
    "unterminated_string": "A string has no end.", "invalid_unicode_escape": "A Unicode escape is malformed.", "invalid_escape": "An escape is unknown.",
    "unescaped_control_character": "A control character stands unescaped in a string.", "unexpected_bom": "A byte order mark is out of place.",
    "non_standard_number": "NaN and infinities are no JSON numbers.", "nesting_too_deep": "Values are nested too deeply.", "invalid_syntax": "This is no JSON.",
}


def validate(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    r = df.where(F.col(text).isNotNull()).select(key, json_check(F.col(text)).alias("r")).select(key, "r.*")
    return r.withColumn("status", F.when(F.col("valid"), "valid_json").otherwise("invalid_json")).withColumn("message", F.element_at(message, F.col("error_code")))
