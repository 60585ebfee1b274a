"""The four normal forms of a text, and where it differs from each."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphworks.functions import scan

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
EXPLANATION = "This form spells the text in other code points from here on; an exact comparison with normalized text fails."
_METRICS = "bytes long, utf16_code_units long, unicode_scalars long, lines long"
_BOUNDED = pa.struct([("characters", pa.list_(scan.DETAIL_AT)), ("total", pa.int64()), ("returned", pa.int64()), ("truncated", pa.bool_())])
_BOUNDED_SCHEMA = f"struct<characters:array<{scan.DETAIL_AT_SCHEMA}>,total:bigint,returned:bigint,truncated:boolean>"


class _Changes:
    """Where the texts are not in one of the forms: text, form, the normalized texts, and the changed range on both sides."""

    def __init__(self, t: scan.Texts):
        self.text, self.form, ranges, new = [], [], [], []
        for i, s in enumerate(t.strings()):
            if s.isascii():
                continue
            for f, form in enumerate(FORMS):
                if not unicodedata.is_normalized(form, s):
                    changed = unicodedata.normalize(form, s)
                    self.text.append(i)
                    self.form.append(f)
                    new.append(changed)
                    ranges.append(scan.changed_range(s, changed))
        self.text, self.form = np.array(self.text, np.int64), np.array(self.form, np.int64)
        self.new = scan.Texts.of(new)
        self.first, self.end, self.new_end = np.array(ranges, np.int64).reshape(-1, 3).T

    def __len__(self) -> int:
        return len(self.text)


def _bounded(t: scan.Texts, text: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.StructArray:
    """At most 500 character details of each range, and how many there are."""
    total = end - first
    returned = np.minimum(total, scan.LIMIT)
    head = t.start[text]
    return pa.StructArray.from_arrays([t.listed(text, head + first, head + end), pa.array(total), pa.array(returned), pa.array(returned < total)], names=[f.name for f in _BOUNDED])


def forms(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per text and form: is_normalized, the metrics of the form, and the place of the changed range."""

    def make():
        def kernel(t: scan.Texts):
            c, k = _Changes(t), len(FORMS)
            at = c.text * k + c.form
            metrics = {m: np.repeat(v, k) for m, v in t.metrics().items()}
            for m, v in c.new.metrics().items():
                metrics[m][at] = v
            normal = np.ones(t.n * k, bool)
            normal[at] = False
            where = {}
            head = t.start[c.text]
            for name, v in t.locations(c.text, head + c.first, head + c.end).items():
                full = np.zeros(t.n * k, np.int64)
                full[at] = v
                where[name] = pa.array(full, mask=normal)
            return np.repeat(np.arange(t.n), k), {"form": pa.array(list(FORMS) * t.n, pa.string()), "is_normalized": normal, **metrics, **where}

        return kernel

    return scan.scanned(df, key, text, make, f"form string, is_normalized boolean, {_METRICS}, " + ", ".join(f"{c} long" for c in scan.LOCATION))


def findings(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """The forms that a text is not in, in the order NFC, NFD, NFKC, NFKD, with the characters of the changed range on both sides."""

    def make():
        def kernel(t: scan.Texts):
            c = _Changes(t)
            n, head = scan.ranks(c.text), t.start[c.text]
            form = pa.array(c.form)
            every = lambda s: pa.array([s] * len(c), pa.string())
            return c.text, {
                "finding": pa.array([f"normalization_{i}" for i in n.tolist()], pa.string()), "n": n.astype(np.int32), "form": pa.array(FORMS).take(form),
                "rule": pa.array([f"normalization.not_{f.lower()}" for f in FORMS]).take(form), "category": every("normalization"), "severity": every("information"),
                "title": pa.array([f"Not in {f}" for f in FORMS]).take(form), "explanation": every(EXPLANATION), **t.locations(c.text, head + c.first, head + c.end),
                "observed": _bounded(t, c.text, c.first, c.end), "normalized": _bounded(c.new, np.arange(len(c)), c.first, c.new_end),
            }

        return kernel

    columns = "finding string, n int, form string, rule string, category string, severity string, title string, explanation string, " + ", ".join(f"{c} long" for c in scan.LOCATION)
    return scan.scanned(df, key, text, make, f"{columns}, observed {_BOUNDED_SCHEMA}, normalized {_BOUNDED_SCHEMA}")


def summary(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per text: status normalized or changes_found, the number of forms that differ, whether it is in each form, and the metrics."""

    def make():
        def kernel(t: scan.Texts):
            c = _Changes(t)
            other = np.zeros((t.n, len(FORMS)), bool)
            other[c.text, c.form] = True
            return np.arange(t.n), {"total": other.sum(1), **{f"is_{f.lower()}": ~other[:, i] for i, f in enumerate(FORMS)}, **t.metrics()}

        return kernel

    found = scan.scanned(df, key, text, make, "total long, " + ", ".join(f"is_{f.lower()} boolean" for f in FORMS) + f", {_METRICS}")
    return found.select(F.col(key), F.when(F.col("total") > 0, "changes_found").otherwise("normalized").alias("status"), *found.columns[1:])
