"""Writing systems of a text, letters from another system, and lookalikes of ASCII letters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphworks.functions import scan
from glyphworks.functions import text as T
from glyphworks.functions.unicode_data import CONFUSABLES, EXPECTED_COMBINATIONS

CONFUSABLE_VERSION = "ascii-lookalikes-1"
#: Titles and explanations of the two categories.
KINDS = {
    "mixed_script": ("Letter of another script", "The text is mostly in another script; in a name or an address that deserves a second look."),
    "confusable": ("Lookalike of an ASCII letter", "This letter looks like one of the ASCII alphabet, and the text has Latin letters too."),
}


def _reviewer() -> scan.Scripts:
    return scan.Scripts(EXPECTED_COMBINATIONS, CONFUSABLES)


def census(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per text and script: letters, and the first of them."""

    def make():
        reviewer = _reviewer()

        def kernel(t: scan.Texts):
            r = reviewer.review(t)
            owner, script = np.nonzero(r["present"])
            return owner, {"script": reviewer.named(script), "count": r["count"][owner, script], "first_scalar": r["first"][owner, script] - t.start[owner]}

        return kernel

    return scan.scanned(df, key, text, make, "script string, count long, first_scalar long")


def summary(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per text: status, the dominant script, whether scripts are mixed, and how many letters need a second look."""

    def make():
        reviewer = _reviewer()

        def kernel(t: scan.Texts):
            r = reviewer.review(t)
            return np.arange(t.n), {"dominant_script": reviewer.named(r["dominant"]), "is_mixed_script": r["many"] > 1, "expected_combination": r["usual"], "n_scripts": r["many"], "total": r["total"], **t.metrics()}

        return kernel

    columns = "dominant_script string, is_mixed_script boolean, expected_combination boolean, n_scripts long, "
    found = T.with_status(scan.scanned(df, key, text, make, columns + T.TOTAL_COLUMNS), key)
    return found.withColumn("review_recommended", F.col("total") > 0)


def findings(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row for each letter to look at again, the first 500 of a text, with its details and those of the letter it looks like."""

    def make():
        reviewer = _reviewer()

        def kernel(t: scan.Texts):
            r = reviewer.review(t)
            at, alike = r["hits"], r["alike"]
            n = scan.ranks(t.owner[at])
            at, alike, n = at[n <= scan.LIMIT], alike[n <= scan.LIMIT], n[n <= scan.LIMIT]
            owner, target = t.owner[at], reviewer.alike[t.cp[at]]
            # the rule is the reason, the category what is known of the letter
            rule = pa.array(["mixed_script.character", "confusable.curated_ascii_lookalike"]).take(pa.array(alike.astype(np.int64)))
            known = target > 0
            kind = pa.array(known.astype(np.int64))
            said = lambda k: pa.array([v[k] for v in KINDS.values()]).take(kind)
            every = ["warning"] * len(at)
            letters = pa.array([chr(c) if c else None for c in target.tolist()], pa.string())
            return owner, {
                "finding": pa.array([f"script_{i}" for i in n.tolist()], pa.string()), "n": n.astype(np.int32), "rule": rule, "category": pa.array(list(KINDS)).take(kind), "severity": pa.array(every, pa.string()),
                "title": said(0), "explanation": said(1), **t.locations(owner, at, at + 1), "code_point": scan.facts_of(t.cp[at])[1], "script": reviewer.named(r["script"][at]), "looks_like": letters,
                "confusable_data_version": pa.array([CONFUSABLE_VERSION if k else None for k in known.tolist()], pa.string()), "observed": t.details(owner, at), "looks_like_detail": scan.bare_details(target, known),
            }

        return kernel

    columns = "finding string, n int, rule string, category string, severity string, title string, explanation string, " + ", ".join(f"{c} long" for c in scan.LOCATION)
    return scan.scanned(df, key, text, make, f"{columns}, code_point string, script string, looks_like string, confusable_data_version string, observed {scan.DETAIL_AT_SCHEMA}, looks_like_detail {scan.DETAIL_SCHEMA}")
