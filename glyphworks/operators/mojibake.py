"""UTF-8 that was read in a legacy encoding, and replacement characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from glyphworks.functions import scan
from glyphworks.functions import text as T

# cp1252 characters above U+00FF and their bytes.
CP1252 = {
    0x20AC: 0x80, 0x201A: 0x82, 0x0192: 0x83, 0x201E: 0x84, 0x2026: 0x85, 0x2020: 0x86, 0x2021: 0x87, 0x02C6: 0x88, 0x2030: 0x89, 0x0160: 0x8A, 0x2039: 0x8B, 0x0152: 0x8C,
    0x017D: 0x8E, 0x2018: 0x91, 0x2019: 0x92, 0x201C: 0x93, 0x201D: 0x94, 0x2022: 0x95, 0x2013: 0x96, 0x2014: 0x97, 0x02DC: 0x98, 0x2122: 0x99, 0x0161: 0x9A, 0x203A: 0x9B,
    0x0153: 0x9C, 0x017E: 0x9E, 0x0178: 0x9F,
}
# end of fixed values


REPLACEMENT = 0xFFFD
_COLUMNS = (
    "finding string, n int, rule string, category string, severity string, title string, explanation string, " + ", ".join(f"{c} long" for c in scan.LOCATION)
    + f", characters array<{scan.DETAIL_AT_SCHEMA}>, interpreted_bytes_hex string, possible_intended_character string, intended_detail {scan.DETAIL_SCHEMA}"
)
#: rule, title and explanation of the two kinds of findings.
KINDS = [
    ("mojibake.replacement_character", "Replacement character", "A decoder puts U+FFFD where it could not read the bytes, so these may be lost."),
    ("mojibake.utf8_bytes_as_legacy_text", "UTF-8 bytes shown as legacy text", "Read as Latin-1 or Windows-1252 bytes, these characters are one character in UTF-8."),
]


def _hex(packed: int, size: int) -> str:
    return packed.to_bytes(size, "big").hex(" ").upper()


def findings(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row for each suspicious sequence, the first 500 of a text, with its characters and the one that was probably meant."""

    def make():
        table = scan.legacy_table(CP1252)

        def kernel(t: scan.Texts):
            at, size, packed, meant = scan.legacy_sequences(t, table)
            n = scan.ranks(t.owner[at])
            keep = n <= scan.LIMIT
            at, size, packed, meant, n = at[keep], size[keep], packed[keep], meant[keep], n[keep]
            owner, legacy = t.owner[at], t.cp[at] != REPLACEMENT
            kind = pa.array(legacy.astype(np.int64))
            said = lambda k: pa.array([x[k] for x in KINDS]).take(kind)
            pairs, index = np.unique(np.where(legacy, packed * 8 + size, 0), return_inverse=True)
            digits = pa.array([_hex(p >> 3, p & 7) if p else None for p in pairs.tolist()], pa.string()).take(pa.array(index))
            chars, index = np.unique(np.where(legacy, meant, 0), return_inverse=True)
            shown = pa.array([chr(c) for c in chars.tolist()], pa.string()).take(pa.array(index))
            every = ["mojibake"] * len(at), ["warning"] * len(at)
            return owner, {
                "finding": pa.array([f"mojibake_{k}" for k in n.tolist()], pa.string()), "n": n.astype(np.int32), "rule": said(0), "category": pa.array(every[0], pa.string()), "severity": pa.array(every[1], pa.string()),
                "title": said(1), "explanation": said(2), **t.locations(owner, at, at + size), "characters": t.listed(owner, at, at + size), "interpreted_bytes_hex": digits,
                "possible_intended_character": pc.if_else(pa.array(legacy), shown, None), "intended_detail": scan.bare_details(meant, legacy),
            }

        return kernel

    return scan.scanned(df, key, text, make, _COLUMNS)


def summary(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per text: status, total, returned, truncated and the metrics."""

    def make():
        table = scan.legacy_table(CP1252)

        def kernel(t: scan.Texts):
            return np.arange(t.n), {"total": np.bincount(t.owner[scan.legacy_sequences(t, table)[0]], minlength=t.n), **t.metrics()}

        return kernel

    return T.with_status(scan.scanned(df, key, text, make, T.TOTAL_COLUMNS), key)
