"""Request envelopes: strict JSON bodies with a text or Base64 bytes, checked into rows or error codes."""

from __future__ import annotations

import base64
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphworks.functions.kernels import _kernel, invalid_byte

ENVELOPE_LIMIT, INPUT_LIMIT = 262_144, 32_768
PROFILES = ("general", "identifier")
#: Error codes and their HTTP statuses.
STATUSES = {
    "invalid_request": 400, "unsupported_profile": 400, "invalid_base64": 400, "invalid_envelope_utf8": 400, "input_too_large": 413, "unsupported_media_type": 415,
    "unsupported_content_encoding": 415, "rate_limited": 429, "internal_error": 500, "service_unavailable": 503,
}
#: What the error codes mean.
MESSAGES = {
    "invalid_request": "The body is not of the form that is asked for.", "unsupported_profile": "There is no such profile.", "invalid_base64": "The bytes are not in canonical Base64.",
    "invalid_envelope_utf8": "The body is not UTF-8.", "input_too_large": "The body or its input is over the limit.", "unsupported_media_type": "The body has to be application/json.",
    "unsupported_content_encoding": "The body must not be compressed or otherwise encoded.", "rate_limited": "Too many requests of this caller.", "internal_error": "The request failed here.",
    "service_unavailable": "The quota cannot be checked now.", "invalid_utf8": "The bytes are not UTF-8.",
}
_BASE64 = re.compile(r"[A-Za-z0-9+/]*={0,2}")


class _Rejected(Exception):
    pass


def _constant(_: str):
    raise ValueError


def _keys(value, required: set[str], optional: set[str] = frozenset()) -> bool:
    return isinstance(value, dict) and required <= value.keys() <= required | optional


def canonical_base64(value) -> bytes | None:
    """The bytes, if the string is just what an encoder would write."""
    if not isinstance(value, str) or len(value) % 4 or not _BASE64.fullmatch(value):
        return None
    try:
        data = base64.b64decode(value, validate=True)
    except ValueError:
        return None
    return data if base64.b64encode(data).decode() == value else None


def _input(value, profile_allowed: bool) -> dict:
    if not _keys(value, {"input"}, {"profile"} if profile_allowed else frozenset()):
        raise _Rejected("invalid_request")
    profile = value.get("profile", "general")
    if profile not in PROFILES if isinstance(profile, str) else True:
        raise _Rejected("unsupported_profile")
    body = value["input"]
    kind = body.get("kind") if isinstance(body, dict) else None
    if kind == "text":
        text = body.get("value")
        if not _keys(body, {"kind", "value"}) or not isinstance(text, str) or any("\ud800" <= c <= "\udfff" for c in text):
            raise _Rejected("invalid_request")
        data = text.encode()
    elif kind == "bytes":
        if not _keys(body, {"kind", "base64", "declared_charset"}) or body["declared_charset"] != "utf-8":
            raise _Rejected("invalid_request")
        data = canonical_base64(body["base64"])
        if data is None:
            raise _Rejected("invalid_base64")
    else:
        raise _Rejected("invalid_request")
    if len(data) > INPUT_LIMIT:
        raise _Rejected("input_too_large")
    return {"kind": kind, "profile": profile, "data": data}


def read_body(body: bytes, profile_allowed: bool = True) -> dict:
    """kind, profile and data of an envelope, or an error code.  A body nested too deeply for the parser is an invalid request."""
    try:
        if len(body) > ENVELOPE_LIMIT:
            raise _Rejected("input_too_large")
        try:
            source = body.decode("utf-8-sig")
        except UnicodeDecodeError:
            raise _Rejected("invalid_envelope_utf8") from None
        try:
            value = json.loads(source, parse_constant=_constant)
        except (ValueError, RecursionError):
            raise _Rejected("invalid_request") from None
        return _input(value, profile_allowed)
    except _Rejected as e:
        return {"error": e.args[0]}


_TYPE = pa.struct([("error", pa.string()), ("kind", pa.string()), ("profile", pa.string()), ("data", pa.binary())])
_SCHEMA = "struct<error:string,kind:string,profile:string,data:binary>"
_any = _kernel(lambda b: read_body(b, True), _SCHEMA, _TYPE, {"error": "invalid_request"})
_tool = _kernel(lambda b: read_body(b, False), _SCHEMA, _TYPE, {"error": "invalid_request"})


def is_canonical_base64(c: Column) -> Column:
    """Without Python: form, length, and equality with what Spark encodes."""
    shaped = (F.length(c) % 4 == 0) & c.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z")
    again = F.regexp_replace(F.base64(F.try_to_binary(c, F.lit("base64"))), "[\r\n]", "")
    return F.coalesce(shaped & (again == c), F.lit(False))


def envelopes(df: DataFrame, key: str = "id", body: str = "body", profile_allowed: bool = True) -> DataFrame:
    """key, error, kind, profile, data, valid_utf8, first_invalid_byte and text, which is null where there is none."""
    b = F.col(body).cast("binary")
    parsed = df.select(key, (_any if profile_allowed else _tool)(b).alias("e")).select(key, "e.*")
    bad = invalid_byte(F.col("data"))
    out = parsed.withColumn("first_invalid_byte", bad).withColumn("valid_utf8", F.col("data").isNotNull() & F.col("first_invalid_byte").isNull())
    return out.withColumn("text", F.when(F.col("valid_utf8"), F.decode("data", "UTF-8")))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to analyze, and the quarantine: those with an error or invalid bytes, with their code, status and message."""
    of = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    rejected = checked.where(F.col("error").isNotNull() | ~F.col("valid_utf8")).withColumn("code", F.coalesce("error", F.lit("invalid_utf8")))
    rejected = rejected.withColumn("status", F.coalesce(F.element_at(of(STATUSES), F.col("code")), F.lit(200))).withColumn("message", F.element_at(of(MESSAGES), F.col("code")))
    return checked.where(F.col("error").isNull() & F.col("valid_utf8")), rejected


def check_headers(content_type: Column, content_encoding: Column, content_length: Column) -> Column:
    """Error code of the declared headers, or null."""
    json_type = content_type.rlike(r"(?i)\Aapplication/json(\s*;\s*charset\s*=\s*(\"utf-8\"|utf-8))?\s*\z")
    number = content_length.rlike(r"\A(0|[1-9][0-9]*)\z")
    large = (F.length(content_length) > 16) | (content_length.try_cast("decimal(38,0)") > ENVELOPE_LIMIT)
    return (
        F.when(content_encoding.isNotNull(), "unsupported_content_encoding").when(~F.coalesce(json_type, F.lit(False)), "unsupported_media_type")
        .when(content_length.isNotNull() & ~number, "invalid_request").when(content_length.isNotNull() & large, "input_too_large")
    )


def read_texts(spark: SparkSession, path: str, kind: str = "parquet", key: str = "id", text: str = "text") -> DataFrame:
    """(key, text) from files: parquet or json with these columns, text with a line for each row, binary with a file for each row."""
    if kind == "text":
        return spark.read.text(path).select(F.xxhash64("value").alias(key), F.col("value").alias(text))
    if kind == "binary":
        files = spark.read.format("binaryFile").load(path)
        return files.where(F.is_valid_utf8(F.col("content").cast("string"))).select(F.col("path").alias(key), F.decode("content", "UTF-8").alias(text))
    reader = spark.read.schema(f"`{key}` long, `{text}` string") if kind == "json" else spark.read
    return reader.format(kind).load(path).select(key, text)


def write_results(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Results as parquet, or as one compact JSON object a line."""
    if kind == "json":
        df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)
    else:
        df.write.mode(mode).format(kind).save(path)
