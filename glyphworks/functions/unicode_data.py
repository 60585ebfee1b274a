"""Facts about code points, from the running Python's Unicode data."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

UNICODE_VERSION = unicodedata.unidata_version

# Marker words of character names in order of precedence, and their scripts
# where these are not the marker in title case.
SCRIPT_MARKERS = [
    "CANADIAN SYLLABICS", "CJK UNIFIED IDEOGRAPH", "CJK COMPATIBILITY IDEOGRAPH", "IDEOGRAPHIC", "HIRAGANA", "KATAKANA", "BOPOMOFO", "HANGUL", "LATIN", "GREEK",
    "CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "SYRIAC", "THAANA", "NKO", "SAMARITAN", "MANDAIC", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "ODIA",
    "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "THAI", "LAO", "TIBETAN", "MYANMAR", "GEORGIAN", "ETHIOPIC", "CHEROKEE", "OGHAM", "RUNIC", "TAGALOG",
    "HANUNOO", "BUHID", "TAGBANWA", "KHMER", "MONGOLIAN", "YI SYLLABLE", "YI RADICAL", "VAI", "BAMUM", "TIFINAGH", "LISU", "JAVANESE", "BALINESE", "SUNDANESE",
    "LEPCHA", "OL CHIKI", "MEETEI MAYEK", "ADLAM", "OSMANYA", "DESERET",
]
SCRIPT_NAMES = {
    "CANADIAN SYLLABICS": "Canadian_Aboriginal", "CJK UNIFIED IDEOGRAPH": "Han", "CJK COMPATIBILITY IDEOGRAPH": "Han", "IDEOGRAPHIC": "Han", "ODIA": "Oriya",
    "YI SYLLABLE": "Yi", "YI RADICAL": "Yi", "OL CHIKI": "Ol_Chiki", "MEETEI MAYEK": "Meetei_Mayek",
}
# Names that the inspector gives to controls.
CONTROL_NAMES = {
    0x00: "NULL", 0x07: "ALERT", 0x08: "BACKSPACE", 0x09: "CHARACTER TABULATION", 0x0A: "LINE FEED", 0x0B: "LINE TABULATION", 0x0C: "FORM FEED",
    0x0D: "CARRIAGE RETURN", 0x1B: "ESCAPE", 0x7F: "DELETE", 0x85: "NEXT LINE",
}
# Greek and Cyrillic letters that look like ASCII letters, code point to letter.
CONFUSABLES = {
    0x0391: "A", 0x0392: "B", 0x0395: "E", 0x0396: "Z", 0x0397: "H", 0x0399: "I", 0x039A: "K", 0x039C: "M", 0x039D: "N", 0x039F: "O", 0x03A1: "P", 0x03A4: "T", 0x03A5: "Y",
    0x03A7: "X", 0x03B1: "a", 0x03B5: "e", 0x03B9: "i", 0x03BA: "k", 0x03BD: "v", 0x03BF: "o", 0x03C1: "p", 0x03C4: "t", 0x03C5: "u", 0x03C7: "x", 0x0405: "S", 0x0406: "I",
    0x0408: "J", 0x0410: "A", 0x0412: "B", 0x0415: "E", 0x041A: "K", 0x041C: "M", 0x041D: "H", 0x041E: "O", 0x0420: "P", 0x0421: "C", 0x0422: "T", 0x0425: "X", 0x0430: "a",
    0x0435: "e", 0x043E: "o", 0x0440: "p", 0x0441: "c", 0x0443: "y", 0x0445: "x", 0x0455: "s", 0x0456: "i", 0x0458: "j", 0x04AE: "Y", 0x04CF: "l",
}
# Sets of scripts that are usual together.
EXPECTED_COMBINATIONS = [{"Han", "Hiragana", "Katakana"}, {"Han", "Bopomofo"}, {"Han", "Hangul"}]
# Ranges of code points for grapheme clusters.
PREPEND = [
    (0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x0D4E, 0x0D4E), (0x110BD, 0x110BD), (0x110CD, 0x110CD),
    (0x111C2, 0x111C3), (0x113D1, 0x113D1), (0x1193F, 0x1193F), (0x11941, 0x11941), (0x11A84, 0x11A89), (0x11D46, 0x11D46), (0x11F02, 0x11F02),
]
EXTRA_SPACING_MARKS = [0x0E33, 0x0EB3, 0x11B61, 0x11B65, 0x11B67]
EXTRA_EXTEND = [(0x200C, 0x200C), (0x1F3FB, 0x1F3FF), (0xE0020, 0xE007F), (0xFF9E, 0xFF9F)]
INDIC = [
    (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0A80, 0x0AFF), (0x0B00, 0x0B7F), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F), (0x0C80, 0x0CFF), (0x0D00, 0x0D7F),
    (0x0D80, 0x0DFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1A20, 0x1AAF), (0xA8E0, 0xA8FF), (0xA980, 0xA9DF), (0xAA60, 0xAA7F), (0xABC0, 0xABFF), (0x11000, 0x11FFF),
]
PICTOGRAPHIC = [
    (0x00A9, 0x00A9), (0x00AE, 0x00AE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x21FF), (0x2300, 0x23FF), (0x25A0, 0x27FF),
    (0x2B00, 0x2BFF), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F000, 0x1FAFF), (0x1FC00, 0x1FFFD),
]
HANGUL = {"L": [(0x1100, 0x115F), (0xA960, 0xA97C)], "V": [(0x1160, 0x11A7), (0xD7B0, 0xD7C6)], "T": [(0x11A8, 0x11FF), (0xD7CB, 0xD7FB)]}
REGIONAL = (0x1F1E6, 0x1F1FF)
# end of fixed values

def _within(cp: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= cp <= b for a, b in ranges)


@lru_cache(maxsize=1 << 16)
def script_of(char: str) -> str:
    """The script as the character's name tells it."""
    category = unicodedata.category(char)
    if category[0] in "CPSZ":
        return "Common"
    name = unicodedata.name(char, "")
    for marker in SCRIPT_MARKERS:
        if marker in name:
            return SCRIPT_NAMES.get(marker, marker.title())
    if category in ("Mn", "Me") or name.startswith("COMBINING "):
        return "Inherited"
    return "Common" if category[0] == "N" else "Unknown"


def is_significant_letter(char: str) -> bool:
    return unicodedata.category(char)[0] == "L" and script_of(char) not in ("Common", "Inherited", "Unknown")


def display_name(char: str) -> str:
    """The name for the inspector, where every code point has one."""
    name = unicodedata.name(char, "")
    if name:
        return name
    kind = {"Cc": "CONTROL", "Co": "PRIVATE USE", "Cs": "SURROGATE"}
    return CONTROL_NAMES.get(ord(char)) or kind.get(unicodedata.category(char), "UNASSIGNED")


@lru_cache(maxsize=1 << 16)
def cluster_class(char: str) -> tuple[str, int, bool, bool, bool]:
    """(class, Indic block or -1, is a consonant, is a linker, is pictographic) for grapheme clusters."""
    cp, category = ord(char), unicodedata.category(char)
    block = next((i for i, (a, b) in enumerate(INDIC) if a <= cp <= b), -1)
    consonant = block >= 0 and category == "Lo"
    name = unicodedata.name(char, "") if block >= 0 else ""
    linker = "VIRAMA" in name or "HALANT" in name
    picture = _within(cp, PICTOGRAPHIC) and not REGIONAL[0] <= cp <= REGIONAL[1]
    hangul = next((k for k, r in HANGUL.items() if _within(cp, r)), None)
    if cp in (13, 10):
        kind = "CR" if cp == 13 else "LF"
    elif hangul:
        kind = hangul
    elif 0xAC00 <= cp <= 0xD7A3:
        kind = "LVT" if (cp - 0xAC00) % 28 else "LV"
    elif REGIONAL[0] <= cp <= REGIONAL[1]:
        kind = "RI"
    elif _within(cp, PREPEND):
        kind = "Prepend"
    elif cp == 0x200D:
        kind = "ZWJ"
    elif category in ("Mn", "Me") or _within(cp, EXTRA_EXTEND):
        kind = "Extend"
    elif category == "Mc" or cp in EXTRA_SPACING_MARKS:
        kind = "SpacingMark"
    else:
        kind = "Control" if category in ("Cc", "Cf", "Cs", "Zl", "Zp") else "Other"
    return kind, block, consonant, linker, picture
