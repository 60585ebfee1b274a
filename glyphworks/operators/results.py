"""One result row for each request, with the blocks that all checks share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphworks import __version__
from glyphworks.functions import text as T
from glyphworks.functions.kernels import json_check
from glyphworks.functions.unicode_data import UNICODE_VERSION
from glyphworks.operators import hidden, inspector, mojibake, normalization, scripts
from glyphworks.sources.envelope import MESSAGES, STATUSES

HIDDEN = "hidden-characters"
CHECKS = (HIDDEN, "mojibake", "normalization", "mixed-script-confusables", "text-counts", "json-validation", "code-points")
_METRICS = ("bytes", "utf16_code_units", "unicode_scalars", "lines")


def _status(rows: DataFrame, check: str) -> DataFrame:
    """request, status, total (null where a check lists no findings) and the metrics of each text."""
    if check in (HIDDEN, "mojibake", "normalization", "mixed-script-confusables"):
        found = {HIDDEN: hidden, "mojibake": mojibake, "normalization": normalization, "mixed-script-confusables": scripts}[check].summary(rows, "request", "text")
        return found.select("request", "status", F.col("total").cast("long").alias("total"), *_METRICS)
    c = F.col("text")
    status = {
        "text-counts": F.lit("complete"),
        "json-validation": F.when(json_check(c)["valid"], "valid_json").otherwise("invalid_json"),
        "code-points": F.when(F.char_length(c) > inspector.LIMIT, "input_too_large").otherwise("complete"),
    }[check]
    return rows.select("request", status.alias("status"), F.lit(None).cast("long").alias("total"), T.metrics(c).alias("m")).select("request", "status", "total", "m.*")


def results(checked: DataFrame, check: str, key: str = "id") -> DataFrame:
    """key, status, error, versions, profile, input, encoding, summary and skipped, one row for each row of sources.envelope.envelopes().

    A rejected envelope has status error and an error block; bytes that are not UTF-8 have
    status invalid_utf8, where the first bad byte is, and the check among the skipped ones; others
    have the status of their check.  Findings come from the operators themselves.
    """
    if check not in CHECKS:
        raise ValueError(f"check: one of {', '.join(CHECKS)}")
    request = F.struct(F.col(key).alias("key"), "error", "kind", "profile", "valid_utf8", "first_invalid_byte", F.octet_length("data").cast("long").alias("submitted"))
    found = _status(checked.select(request.alias("request"), F.coalesce("text", F.lit("")).alias("text")), check)
    r = F.col("request")
    too_long = F.col("status") == "input_too_large"
    code = F.coalesce(r["error"], F.when(r["valid_utf8"] & too_long, F.lit("input_too_large")))
    bad = r["error"].isNull() & ~r["valid_utf8"]
    fine = code.isNull() & ~bad
    by_bytes = r["kind"] == "bytes"
    of = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    null = lambda kind: F.lit(None).cast(kind)
    when = lambda on, c: F.when(on, c)

    def shown(name: str) -> Column:
        return when(fine, F.col(name)).alias(name)

    total = F.when(bad & F.lit(check == HIDDEN), F.lit(0).cast("long")).otherwise(when(fine, F.col("total")))
    limit = F.lit(T.DETAIL_LIMIT).cast("long")
    own_basis, text_basis = F.lit("submitted-bytes"), F.lit("utf8-encoding-of-input-string")
    return found.select(
        r["key"].alias(key),
        F.when(code.isNotNull(), "error").when(bad, "invalid_utf8").otherwise(F.col("status")).alias("status"),
        when(code.isNotNull(), F.struct(code.alias("code"), F.coalesce(F.element_at(of(MESSAGES), code), F.lit(MESSAGES["internal_error"])).alias("message"), F.coalesce(F.element_at(of(STATUSES), code), F.lit(500)).alias("http_status"))).alias("error"),
        F.lit(__version__).alias("engine_version"), (F.lit(hidden.RULESET) if check == HIDDEN else null("string")).alias("ruleset_version"), F.lit(UNICODE_VERSION).alias("unicode_version"),
        (when(fine, r["profile"]) if check == HIDDEN else null("string")).alias("profile"),
        when(code.isNull(), F.struct(r["kind"].alias("kind"), F.when(bad, r["submitted"]).otherwise(F.col("bytes")).alias("bytes"), *[shown(m) for m in _METRICS[1:]], F.when(bad | by_bytes, own_basis).otherwise(text_basis).alias("offset_basis"))).alias("input"),
        when(code.isNull(), F.struct(r["valid_utf8"].alias("valid_utf8"), F.when(bad | by_bytes, own_basis).otherwise(F.lit("strict-request-envelope-and-reencoded-text")).alias("basis"), r["first_invalid_byte"].alias("first_invalid_byte"))).alias("encoding"),
        when(total.isNotNull(), F.struct(total.alias("total"), F.least(total, limit).alias("returned"), (total > limit).alias("truncated"))).alias("summary"),
        when(bad, F.array(F.struct(F.lit(check).alias("check"), F.lit("invalid_utf8").alias("reason")))).alias("skipped"),
    )
