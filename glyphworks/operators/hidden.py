"""Hidden, bidirectional and control characters: a table over code points finds and explains them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from glyphworks.functions import scan
from glyphworks.functions import text as T

RULESET = "hidden-characters-1"

# First and last code point, rule, category, severity in general and in identifiers (None: the same), title.
RANGES = [
    (0x00A0, 0x00A0, "whitespace.no_break_space", "whitespace", "information", "warning", "No-break space"),
    (0x00AD, 0x00AD, "hidden.soft_hyphen", "formatting", "information", "warning", "Soft hyphen"),
    (0x034F, 0x034F, "hidden.combining_grapheme_joiner", "formatting", "information", "warning", "Combining grapheme joiner"),
    (0x061C, 0x061C, "bidi.arabic_letter_mark", "bidirectional", "information", "warning", "Arabic letter mark"),
    (0x200B, 0x200B, "hidden.zero_width_space", "hidden_text", "warning", None, "Zero width space"),
    (0x200C, 0x200C, "hidden.zero_width_non_joiner", "hidden_text", "information", "warning", "Zero width non-joiner"),
    (0x200D, 0x200D, "hidden.zero_width_joiner", "hidden_text", "information", "warning", "Zero width joiner"),
    (0x200E, 0x200E, "bidi.left_to_right_mark", "bidirectional", "information", "warning", "Left-to-right mark"),
    (0x200F, 0x200F, "bidi.right_to_left_mark", "bidirectional", "information", "warning", "Right-to-left mark"),
    (0x2060, 0x2060, "hidden.word_joiner", "hidden_text", "warning", None, "Word joiner"),
    (0x2061, 0x2061, "hidden.function_application", "formatting", "information", "warning", "Function application"),
    (0x2062, 0x2062, "hidden.invisible_times", "formatting", "information", "warning", "Invisible times"),
    (0x2063, 0x2063, "hidden.invisible_separator", "formatting", "information", "warning", "Invisible separator"),
    (0x2064, 0x2064, "hidden.invisible_plus", "formatting", "information", "warning", "Invisible plus"),
    (0xFEFF, 0xFEFF, "hidden.byte_order_mark", "hidden_text", "warning", None, "Byte order mark"),
    (0x115F, 0x1160, "hidden.filler", "hidden_text", "warning", None, "Blank filler letter"),
    (0x3164, 0x3164, "hidden.filler", "hidden_text", "warning", None, "Blank filler letter"),
    (0xFFA0, 0xFFA0, "hidden.filler", "hidden_text", "warning", None, "Blank filler letter"),
    (0xFE00, 0xFE0F, "format.variation_selector", "formatting", "information", "warning", "Variation selector"),
    (0xE0100, 0xE01EF, "format.supplementary_variation_selector", "formatting", "information", "warning", "Supplementary variation selector"),
    (0xE0000, 0xE007F, "hidden.tag_character", "hidden_text", "warning", "error", "Tag character"),
    (0x202A, 0x202A, "bidi.left_to_right_embedding", "bidirectional", "warning", "warning", "Left-to-right embedding"),
    (0x202B, 0x202B, "bidi.right_to_left_embedding", "bidirectional", "warning", "warning", "Right-to-left embedding"),
    (0x202C, 0x202C, "bidi.pop_directional_formatting", "bidirectional", "warning", "warning", "End of directional formatting"),
    (0x202D, 0x202D, "bidi.left_to_right_override", "bidirectional", "error", "error", "Left-to-right override"),
    (0x202E, 0x202E, "bidi.right_to_left_override", "bidirectional", "error", "error", "Right-to-left override"),
    (0x2066, 0x2066, "bidi.left_to_right_isolate", "bidirectional", "information", "warning", "Left-to-right isolate"),
    (0x2067, 0x2067, "bidi.right_to_left_isolate", "bidirectional", "information", "warning", "Right-to-left isolate"),
    (0x2068, 0x2068, "bidi.first_strong_isolate", "bidirectional", "information", "warning", "First strong isolate"),
    (0x2069, 0x2069, "bidi.pop_directional_isolate", "bidirectional", "information", "warning", "End of directional isolate"),
    (0x206A, 0x206F, "bidi.deprecated_formatting_control", "bidirectional", "warning", "error", "Deprecated formatting control"),
]
CONTROLS = [(0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x7F), (0x80, 0x9F)]
TERMINAL_CONTROLS = [0x00, 0x08, 0x1B, 0x7F, 0x9B]
# end of fixed values

#: What each category means to a reader.
EXPLANATIONS = {
    "whitespace": "It looks like a plain space but is another character.",
    "formatting": "It changes how neighbours are shown and has no shape of its own.",
    "hidden_text": "It takes part in the text without being seen.",
    "bidirectional": "It changes the order in which text is shown.",
    "control": "It is an instruction to a device, not a character of a text.",
}


def rule_rows() -> list[tuple]:
    """(code_point, rule, category, severity, identifier_severity, title, explanation, label)."""
    rows = [(cp, rule, cat, sev, ident or sev, title, EXPLANATIONS[cat], title.lower()) for a, b, rule, cat, sev, ident, title in RANGES for cp in range(a, b + 1)]
    for a, b in CONTROLS:
        for cp in range(a, b + 1):
            severity = "error" if cp in TERMINAL_CONTROLS else "warning"
            rows.append((cp, f"control.{cp:04X}", "control", severity, severity, "Null character" if cp == 0 else "Control character", EXPLANATIONS["control"], "control character"))
    return rows


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), "code_point int, rule string, category string, severity string, identifier_severity string, title string, explanation string, label string")


def hidden_label(code_point: int) -> str | None:
    """What a hidden character is called in running text; None for others."""
    return next((r[7] for r in rule_rows() if r[0] == code_point), None)


def escaped(cp: int) -> str:
    """Backslash spelling with braces above U+FFFF, and letters for tab, line feed and carriage return."""
    return {9: r"\t", 10: r"\n", 13: r"\r"}.get(cp) or (f"\\u{cp:04X}" if cp <= 0xFFFF else f"\\u{{{cp:X}}}")


_COLUMNS = "finding string, n int, rule string, category string, severity string, title string, explanation string, label string, " + ", ".join(f"{c} long" for c in scan.LOCATION[:8]) + ", escaped string, code_point string, utf8_hex string"


def _table(rows: list[tuple]) -> np.ndarray:
    """By code point the number of its row, 0 for none."""
    table = np.zeros(0x110000, np.int16)
    table[[r[0] for r in rows]] = np.arange(1, len(rows) + 1)
    return table


def findings(df: DataFrame, key: str = "id", text: str = "text", profile: str = "general") -> DataFrame:
    """One row for each hidden character, the first 500 of a text: key, finding (its id), n from 1, the rule, the place, what was observed."""
    if profile not in ("general", "identifier"):
        raise ValueError("profile: general or identifier")
    rows = rule_rows()
    severity = 4 if profile == "identifier" else 3

    def make():
        table = _table(rows)
        facts = {"rule": [r[1] for r in rows], "category": [r[2] for r in rows], "severity": [r[severity] for r in rows], "title": [r[5] for r in rows], "explanation": [r[6] for r in rows], "label": [r[7] for r in rows]}
        spelled = {"escaped": [escaped(r[0]) for r in rows], "code_point": [f"U+{r[0]:04X}" for r in rows], "utf8_hex": [chr(r[0]).encode().hex(" ").upper() for r in rows]}

        def kernel(t: scan.Texts):
            at = np.flatnonzero(table[t.cp])
            n = scan.ranks(t.owner[at])
            at, n = at[n <= scan.LIMIT], n[n <= scan.LIMIT]
            owner, which = t.owner[at], pa.array(table[t.cp[at]].astype(np.int64) - 1)
            of = lambda d: {k: pa.array(v).take(which) for k, v in d.items()}
            place = t.locations(owner, at, at + 1)
            return owner, {"finding": pa.array([f"f_{k}" for k in n.tolist()], pa.string()), "n": n.astype(np.int32), **of(facts), **{c: place[c] for c in scan.LOCATION[:8]}, **of(spelled)}

        return kernel

    return scan.scanned(df, key, text, make, _COLUMNS)


def summary(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per text: status, total, returned, truncated and the metrics."""
    rows = rule_rows()

    def make():
        table = _table(rows)

        def kernel(t: scan.Texts):
            return np.arange(t.n), {"total": np.bincount(t.owner[table[t.cp] > 0], minlength=t.n), **t.metrics()}

        return kernel

    return T.with_status(scan.scanned(df, key, text, make, T.TOTAL_COLUMNS), key)
