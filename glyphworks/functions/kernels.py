"""Arrow functions of one column for what built-in expressions cannot say: clusters, JSON and byte checks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphworks.functions import scan

JSON_DEPTH = 512


def _kernel(fn, schema: str, kind: pa.DataType, empty):
    """An Arrow function of one text column; nulls give the empty value.  It is made at its first use, when there is a session."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([empty if not t.is_valid else fn(t.as_py()) for t in texts], kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    made: list = []

    def call(column: Column) -> Column:
        if not made:
            made.append(F.arrow_udf(run, schema))
        return made[0](column)

    return call


# --- grapheme clusters


def _clusters(column: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classes = scan.Lazy(scan._packed_class)
        for b in batches:
            known = b.is_valid()
            rows = pa.RecordBatch.from_arrays([known, b.fill_null("")], names=["known", "text"])
            counts = [pa.array(scan.clusters(t, classes), pa.int64()) for _, t in scan.slices(rows)]
            yield pc.if_else(known, pa.concat_arrays([pa.array([], pa.int64()), *counts]), None)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "bigint")(column)


def grapheme_clusters(text: Column) -> Column:
    """Only texts with a character from U+0300 on reach Python; elsewhere each character but the second of a CRLF is a cluster."""
    plain = ~text.rlike(r"[^\x{0}-\x{2FF}]")
    crlf = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\r\n"), F.lit("\r")))
    return F.when(plain, (F.char_length(text) - crlf).cast("long")).otherwise(_clusters(F.when(plain, F.lit(None)).otherwise(text)))


# --- JSON


class _NotANumber(ValueError):
    pass


def _refuse(token: str):
    raise _NotANumber(token)


def _outside_strings(text: str):
    """(index, character) of all that stands outside string literals."""
    quoted = skip = False
    for i, c in enumerate(text):
        if quoted:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            else:
                quoted = c != '"'
        elif c == '"':
            quoted = True
        else:
            yield i, c


def _too_deep(text: str) -> int | None:
    depth = 0
    for i, c in _outside_strings(text):
        if c in "[{":
            depth += 1
            if depth > JSON_DEPTH:
                return i
        elif c in "]}":
            depth = max(0, depth - 1)
    return None


#: Starts of the decoder's messages, and the codes that stand for them.
_JSON_CODES = [
    ("Expecting value", "expected_value"), ("Expecting property name", "expected_property_name"), ("Expecting ':'", "expected_colon"), ("Expecting ','", "expected_comma_or_end"),
    ("Extra data", "extra_data"), ("Unterminated string", "unterminated_string"), ("Invalid \\u", "invalid_unicode_escape"), ("Invalid \\escape", "invalid_escape"),
    ("Invalid control character", "unescaped_control_character"), ("Unexpected UTF-8 BOM", "unexpected_bom"),
]


def _json_fault(text: str, error: json.JSONDecodeError) -> tuple[str, int]:
    at = error.pos
    before = len(text[:at].rstrip(" \t\r\n")) - 1
    comma_before = before >= 0 and text[before] == ","
    if error.msg.startswith("Illegal trailing comma") or (text[at : at + 1] in ("]", "}") and text[at : at + 1] and comma_before):
        return "trailing_comma", at if text[at : at + 1] == "," or not comma_before else before
    if at >= len(text):
        return "unexpected_end", at
    if text[at : at + 2] in ("//", "/*"):
        return "comment_not_allowed", at
    if text[at] == "'" and error.msg.startswith(("Expecting value", "Expecting property name")):
        return "single_quoted_string", at
    return next((code for start, code in _JSON_CODES if error.msg.startswith(start)), "invalid_syntax"), at


def check_json(text: str) -> dict:
    """valid with value_type, or an error code and its place."""
    deep = _too_deep(text)
    code, at = ("nesting_too_deep", deep) if deep is not None else (None, 0)
    if code is None:
        try:
            value = json.loads(text, parse_constant=_refuse, parse_int=lambda _: 0, parse_float=lambda _: 0)
            kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", type(None): "null"}
            return {"valid": True, "value_type": kinds[type(value)]}
        except _NotANumber as e:
            token = e.args[0]
            code, at = "non_standard_number", next((i for i, _ in _outside_strings(text) if text.startswith(token, i)), 0)
        except json.JSONDecodeError as e:
            code, at = _json_fault(text, e)
        except RecursionError:
            code = "nesting_too_deep"
    head = text[:at]
    lines = head.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    # a place between the two characters of a line end is on the next line already
    return {"valid": False, "error_code": code, "line": len(lines), "column": len(lines[-1]) + 1, "character_offset": at, "byte_offset": len(head.encode("utf-8", "surrogatepass"))}


json_check = _kernel(
    check_json, "struct<valid:boolean,value_type:string,error_code:string,line:bigint,column:bigint,character_offset:bigint,byte_offset:bigint>",
    pa.struct([("valid", pa.bool_()), ("value_type", pa.string()), ("error_code", pa.string()), *((n, pa.int64()) for n in ("line", "column", "character_offset", "byte_offset"))]), None,
)


# --- bytes


def first_invalid_byte(data: bytes) -> int | None:
    """Index of the first bad byte: of the lead byte where a sequence breaks off at the end, of the wrong byte otherwise."""
    try:
        data.decode("utf-8")
        return None
    except UnicodeDecodeError as e:
        lead = e.start
    b = data[lead]
    if not 0xC2 <= b <= 0xF4:
        return lead
    need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
    for i in range(lead + 1, min(len(data), lead + 1 + need)):
        if not low <= data[i] <= high:
            return i
        low, high = 0x80, 0xBF
    return lead


invalid_byte = _kernel(first_invalid_byte, "bigint", pa.int64(), None)
