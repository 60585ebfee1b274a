"""Texts of up to 500 code points, one row for each."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphworks.functions import scan
from glyphworks.functions.unicode_data import display_name
from glyphworks.operators.hidden import escaped

LIMIT = 500
_COLUMNS = (
    "index long, code_point string, decimal long, name string, category string, utf8_bytes array<int>, utf8_hex string, byte_start long, byte_end long, code_point_start long, code_point_end long, "
    "javascript_unit_start long, javascript_unit_end long, line long, column long, visible string"
)


def visible_form(char: str) -> str:
    """The character itself where it can be seen; an escape for controls, spaces and selectors; marks on a dotted circle."""
    category, cp = unicodedata.category(char), ord(char)
    if category[0] in "CZ" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return escaped(cp)
    return "◌" + char if category[0] == "M" else char


def inspect(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Code point, name, category, bytes, place and a visible form of each character; longer texts are left to too_long()."""

    def make():
        def kernel(t: scan.Texts):
            at = np.arange(len(t.cp))
            place = t.locations(t.owner, at, at + 1)
            distinct, index = np.unique(t.cp, return_inverse=True)
            chars, index = [chr(c) for c in distinct.tolist()], pa.array(index.astype(np.int64))
            of = lambda fact, kind: pa.array([fact(c) for c in chars], kind).take(index)
            return t.owner, {
                "index": place["scalar_start"], "code_point": of(lambda c: f"U+{ord(c):04X}", pa.string()), "decimal": t.cp.astype(np.int64), "name": of(display_name, pa.string()),
                "category": of(unicodedata.category, pa.string()), "utf8_bytes": of(lambda c: list(c.encode()), pa.list_(pa.int32())), "utf8_hex": of(lambda c: c.encode().hex(" ").upper(), pa.string()),
                "byte_start": place["byte_start"], "byte_end": place["byte_end"], "code_point_start": place["scalar_start"], "code_point_end": place["scalar_end"],
                "javascript_unit_start": place["utf16_start"], "javascript_unit_end": place["utf16_end"], "line": place["line"], "column": place["column"], "visible": of(visible_form, pa.string()),
            }

        return kernel

    return scan.scanned(df.where(F.char_length(text) <= LIMIT), key, text, make, _COLUMNS)


def too_long(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return df.where(F.char_length(text) > LIMIT).select(key, F.lit(413).alias("status"), F.lit("input_too_large").alias("code"))
