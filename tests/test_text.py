"""Texts of our own: counts, coordinates, findings, forms, scripts, JSON, bytes and envelopes."""

import base64
import json
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphworks.functions import scan
from glyphworks.functions import text as T
from glyphworks.functions.kernels import check_json, first_invalid_byte
from glyphworks.functions.unicode_data import cluster_class
from glyphworks.operators import counts, hidden, inspector, mojibake, normalization, results, scripts
from glyphworks.sources import envelope
from glyphworks.streaming import quota

JOINER, SHY, ZWSP, BOM = "‍", "­", "​", "﻿"


def one(spark, text):
    return spark.createDataFrame([(1, text)], "id long, text string")


def many(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def places(text, at):
    """Bytes, UTF-16 units, line and column before a place, by the plain definition."""
    head = text[:at]
    lines = head.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return len(head.encode()), len(head.encode("utf-16-le")) // 2, len(lines), len(lines[-1]) + 1


ODD = ["", "plain", "\r", "\n", "\r\n", "a\r\nb\n\rc\r\r\nd", "zwölf\r\n\U0001f680\U0001f680\nend", "\n" * 5, "\U0001f9ed", "é́\r", "x" * 700, "\r" * 3 + "ж" * 600 + "\n"]


def test_places():
    t = scan.Texts.of(ODD)
    assert t.strings() == ODD
    for name, value in (("bytes", lambda s: len(s.encode())), ("utf16_code_units", lambda s: len(s.encode("utf-16-le")) // 2), ("unicode_scalars", len), ("lines", lambda s: s.replace("\r\n", "\n").replace("\r", "\n").count("\n") + 1)):
        assert t.metrics()[name].tolist() == [value(s) for s in ODD]
    text, first, end = (np.array(x) for x in zip(*[(i, int(t.start[i]) + a, int(t.start[i]) + b) for i, s in enumerate(ODD) for a in range(len(s) + 1) for b in (a, len(s))], strict=True))
    got = t.locations(text, first, end)
    for k in range(len(text)):
        s, a, b = ODD[text[k]], int(first[k] - t.start[text[k]]), int(end[k] - t.start[text[k]])
        # a place between the two characters of a line end is on the next line, before its first column
        expected = [x for x, y in zip(places(s, a), places(s, b), strict=True) for x in (x, y)]
        assert [int(got[n][k]) for n in ("byte_start", "byte_end", "utf16_start", "utf16_end", "line", "line_end", "column", "column_end")] == expected and (got["scalar_start"][k], got["scalar_end"][k]) == (a, b)


def test_bad_bytes_count_as_replacement():
    assert scan.Texts(pa.array([b"ab", b"c\xff", b""], pa.binary())).strings() == ["ab", "c�", ""]


def test_slices():
    texts = ["é" * 300_000, "", "b", None, "c" * 600_000, "d" * 600_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([x for x in texts if x is not None])], names=["k", "t"])
    parts = [(k.to_pylist(), t.strings()) for k, t in scan.slices(batch)]
    assert sum((k for k, _ in parts), []) == list(range(5)) and sum((t for _, t in parts), []) == [x for x in texts if x is not None] and len(parts) == 3


# --- counts


def clusters_by_hand(text):
    """The rules of clusters as one left-to-right machine."""
    count, prev, odd, picture, indic, linked = 0, "", False, 0, -1, False
    pairs = {"L": ("L", "V", "LV", "LVT"), "LV": ("V", "T"), "V": ("V", "T"), "LVT": ("T",), "T": ("T",)}
    for c in text:
        kind, block, consonant, linker, pictographic = cluster_class(c)
        if not prev:
            join = False
        elif prev in ("CR", "LF", "Control") or kind in ("CR", "LF", "Control"):
            join = prev == "CR" and kind == "LF"
        else:
            join = (
                kind in pairs.get(prev, ()) or kind in ("Extend", "ZWJ", "SpacingMark") or prev == "Prepend" or (consonant and indic == block and linked) or (pictographic and picture == 2)
                or (kind == "RI" and prev == "RI" and odd)
            )
        count += not join
        odd = kind == "RI" and not (prev == "RI" and odd)
        picture = 1 if pictographic else 2 if kind == "ZWJ" and picture == 1 else 1 if kind == "Extend" and picture == 1 else 0
        if consonant and kind not in ("Extend", "ZWJ"):
            indic, linked = block, False
        elif kind in ("Extend", "ZWJ") and indic >= 0 and block in (-1, indic):
            linked = linked or linker
        else:
            indic = -1
        prev = kind
    return count


CLUSTERS = [
    ("ö", 1), ("\U0001f468\U0001f3fe" + JOINER + "\U0001f680", 1), ("x\r\ny", 3), ("한", 1), ("한ᆫ", 1), ("\U0001f44b\U0001f3fc!", 2), ("۝7", 1), ("நி", 1), ("นำ", 1),
    ("\U0001f3f3️" + JOINER + "\U0001f308", 1), ("स्त", 1), ("सत", 2), ("\U0001f1eb\U0001f1f7\U0001f1ef\U0001f1f5", 2), ("q" + JOINER + "q", 2), ("\U0001f1eb\U0001f1f7\U0001f1ef", 2), ("", 0), ("́a", 2),
]


def test_clusters():
    classes = scan.Lazy(scan._packed_class)
    assert scan.clusters(scan.Texts.of([t for t, _ in CLUSTERS]), classes).tolist() == [n for _, n in CLUSTERS]
    rng = random.Random(4)
    pool = "".join(t for t, _ in CLUSTERS) + "ab\n\rकক্̀" + JOINER * 3 + "्" * 3
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 40))) for _ in range(4000)]
    assert scan.clusters(scan.Texts.of(texts), classes).tolist() == [clusters_by_hand(t) for t in texts]


def test_counts(spark):
    texts = ["Öl \U0001f9d1\U0001f3fd" + JOINER + "\U0001f680\r\nend", "", "p\rq\nr\r\ns", "don't d’accord Übermaß 東京 7_8 \U0001f680", "w" * 40_000, "w'" * 20_000, None]
    rows = {r.id: r for r in counts.counts(many(spark, texts)).collect()}
    names = ["utf8_bytes", "unicode_code_points", "unicode_scalars", "grapheme_clusters", "words", "lines", "javascript_string_units"]
    assert [rows[0][n] for n in names] == [len(texts[0].encode()), 12, 12, 8, 2, 2, 15]
    assert [rows[1][n] for n in names] == [0, 0, 0, 0, 0, 1, 0]
    assert rows[2].lines == 4 and rows[3].words == 5 and rows[4].words == rows[5].words == 1 and rows[4].grapheme_clusters == 40_000
    assert all(rows[6][n] is None for n in names)
    odd = {r.id: r for r in counts.counts(many(spark, ODD)).collect()}
    assert [odd[i].lines for i in range(len(ODD))] == [s.replace("\r\n", "\n").replace("\r", "\n").count("\n") + 1 for s in ODD]
    assert [odd[i].grapheme_clusters for i in range(len(ODD))] == [clusters_by_hand(s) for s in ODD]


def test_spellings(spark):
    chars = ["Z", "ß", "☂", "\U0001f9ed", "\t", "\n", "\u0007"]
    c = F.col("text")
    rows = many(spark, chars).orderBy("id").select(T.format_code_point(c).alias("u"), T.escape_code_point(c).alias("e"), T.review_escape(c).alias("r"), T.utf8_hex(c).alias("h")).collect()
    assert [r.u for r in rows] == [f"U+{ord(x):04X}" for x in chars] and [r.h for r in rows] == [x.encode().hex(" ").upper() for x in chars]
    assert [r.e for r in rows] == [hidden.escaped(ord(x)) for x in chars] == ["\\u005A", "\\u00DF", "\\u2602", "\\u{1F9ED}", "\\t", "\\n", "\\u0007"]
    assert [r.r for r in rows] == [scan.review_escape(x) for x in chars] == ["\\u005A", "\\u00DF", "\\u2602", "\\U0001F9ED", "\\u0009", "\\u000A", "\\u0007"]
    data = spark.createDataFrame([(b"a\xed\xa0\x81",), ("퟿í".encode(),), (b"\xed\xbf\xbf",), (b"",)], "b binary")
    assert [r.s for r in data.select(T.has_surrogate(F.col("b")).alias("s")).collect()] == [True, False, True, False]


# --- hidden characters, mojibake


def test_hidden(spark):
    text = "Ω\U0001f9ed\r\n\nxy" + ZWSP + "z"
    (r,) = hidden.findings(one(spark, text)).collect()
    at = text.index(ZWSP)
    assert (r.byte_start, r.utf16_start, r.line, r.column) == places(text, at) and (r.byte_end, r.utf16_end, r.scalar_start, r.scalar_end) == (r.byte_start + 3, r.utf16_start + 1, at, at + 1)
    assert (r.finding, r.n, r.utf8_hex, r.escaped, r.code_point, r.label) == ("f_1", 1, "E2 80 8B", "\\u200B", "U+200B", "zero width space")
    table = {row[0]: row for row in hidden.rule_rows()}
    assert len(table) == len(hidden.rule_rows()) == 480 and hidden.hidden_label(0x202E) == "right-to-left override" and hidden.hidden_label(0x41) is None
    every = one(spark, "q".join(map(chr, list(table)[:480])))
    for profile, column in (("general", 3), ("identifier", 4)):
        got = hidden.findings(every, profile=profile).orderBy("n").collect()
        assert [(x.rule, x.category, x.severity) for x in got] == [(row[1], row[2], row[column]) for row in table.values()]
    with pytest.raises(ValueError, match="profile"):
        hidden.findings(every, profile="other")
    lots = one(spark, SHY * 777)
    s = hidden.summary(lots).first()
    assert (s.total, s.returned, s.truncated, s.status, s.bytes) == (777, 500, True, "issues_found", 1554) and hidden.findings(lots).count() == 500
    assert hidden.findings(many(spark, [None, "", "fine\ttext\r\n"])).count() == 0 and {r.status for r in hidden.summary(many(spark, ["", "ok"])).collect()} == {"clean"}


def test_long_and_clashing_rows(spark):
    """A text of some megabytes; columns whose names the operators use themselves; no rows at all."""
    df = spark.createDataFrame([("k", "ab " * 900_000 + ZWSP, 1, 2), ("k", "ж" * 600_000 + "a", 3, 4)], "key string, text string, n int, rule int")
    r = hidden.findings(df, "key").first()
    assert (r.key, r.scalar_start, r.byte_start) == ("k", 2_700_000, 2_700_000)
    assert {x.total for x in scripts.summary(df, "key").collect()} == {0, 1} and hidden.summary(df, "key").count() == mojibake.summary(df, "key").count() == normalization.summary(df, "key").count() == 2
    empty = df.limit(0)
    for rows in (hidden.findings(empty, "key"), hidden.summary(empty, "key"), mojibake.findings(empty, "key"), normalization.forms(empty, "key"), scripts.census(empty, "key"), counts.counts(empty, "key"), inspector.inspect(empty, "key")):
        assert rows.count() == 0


def test_mojibake(spark):
    meant = ["ü", "ñ", "…", "☂", "\U0001f9ed", "ſ", "߿", "퟿", "\U0010fffd", "ࠀ", "\U00010000"]
    for shown in ("cp1252", "latin-1"):
        for m in meant:
            try:
                text = "so " + m.encode().decode(shown) + "!"
            except UnicodeDecodeError:
                continue
            (r,) = mojibake.findings(one(spark, text)).collect()
            assert (r.scalar_start, r.scalar_end, r.interpreted_bytes_hex, r.possible_intended_character) == (3, len(text) - 1, m.encode().hex(" ").upper(), m)
            assert [c.code_point for c in r.characters] == [f"U+{ord(c):04X}" for c in text[3:-1]] and r.intended_detail.name == unicodedata.name(m, "UNNAMED") and r.finding == "mojibake_1"
            assert [c.location.scalar_start for c in r.characters] == list(range(3, len(text) - 1))
    r = mojibake.findings(one(spark, "lost �\U0001f9ed")).first()
    assert (r.rule, r.characters[0].name, r.interpreted_bytes_hex, r.possible_intended_character, r.intended_detail) == ("mojibake.replacement_character", "REPLACEMENT CHARACTER", None, None, None)
    # a lead byte alone, a wrong continuation, an overlong form, a surrogate, too large, cut off by the end of the text
    assert mojibake.findings(many(spark, ["naïve Ãx", "Ã€x"[:1], "À\x80", "à\x80\x80", "í\xa0\x80", "ô\x90\x80\x80", "ð\x9f\x92", "Ã", "\xa9", None])).count() == 0
    assert [r.id for r in mojibake.findings(many(spark, ["Ã", "\xa9x Ã©Ã©"])).orderBy("n").collect()] == [1, 1]
    s = mojibake.summary(one(spark, "Ã¤" * 640)).first()
    assert (s.total, s.returned, s.truncated) == (640, 500, True)


# --- normal forms


def range_by_hand(a, b):
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < min(len(a), len(b)) - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return start, len(a) - tail, len(b) - tail


def test_changed_range():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choices("xy\U0001f9ed", k=rng.randrange(6))) for _ in range(2))
        assert scan.changed_range(a, b) == range_by_hand(a, b)


def test_normal_forms(spark):
    texts = ["ä", "ä", "½", "plain", "ﬁn Å", "한글", "\U0001f9ed\r\nọ̈q", "x" * 10 + "é" * 600 + "y", ""]
    forms = {(r.id, r.form): r for r in normalization.forms(many(spark, texts)).collect()}
    found = {(r.id, r.form): r for r in normalization.findings(many(spark, texts)).collect()}
    for i, text in enumerate(texts):
        differ = [f for f in normalization.FORMS if unicodedata.normalize(f, text) != text]
        assert [f for f in normalization.FORMS if (i, f) in found] == differ
        for f in normalization.FORMS:
            new, r = unicodedata.normalize(f, text), forms[i, f]
            assert (r.is_normalized, r.bytes, r.unicode_scalars, r.utf16_code_units) == (f not in differ, len(new.encode()), len(new), len(new.encode("utf-16-le")) // 2)
            if f not in differ:
                assert r.byte_start is None
                continue
            a, b, c = range_by_hand(text, new)
            x = found[i, f]
            assert (r.scalar_start, r.scalar_end) == (x.scalar_start, x.scalar_end) == (a, b) and (x.byte_start, x.utf16_start, x.line, x.column) == places(text, a) and (x.byte_end, x.utf16_end, x.line_end, x.column_end) == places(text, b)
            assert (x.n, x.finding, x.rule) == (differ.index(f) + 1, f"normalization_{differ.index(f) + 1}", f"normalization.not_{f.lower()}")
            for side, s, first, end in ((x.observed, text, a, b), (x.normalized, new, a, c)):
                assert (side.total, side.returned, side.truncated, len(side.characters)) == (end - first, min(500, end - first), end - first > 500, min(500, end - first))
                assert [d.code_point for d in side.characters] == [f"U+{ord(ch):04X}" for ch in s[first:end][:500]]
                assert [(d.location.byte_start, d.location.utf16_start, d.location.line, d.location.column) for d in side.characters[:3]] == [places(s, k) for k in range(first, min(end, first + 3))]
    status = {r.id: r for r in normalization.summary(many(spark, texts)).collect()}
    assert [status[i].status for i in range(len(texts))] == ["changes_found" if any((i, f) in found for f in normalization.FORMS) else "normalized" for i in range(len(texts))] and status[2].is_nfd and not status[2].is_nfkc


# --- scripts


def review(spark, texts):
    s = {r.id: r for r in scripts.summary(many(spark, texts)).collect()}
    f = {}
    for r in scripts.findings(many(spark, texts)).orderBy("id", "n").collect():
        f.setdefault(r.id, []).append(r)
    return [(s[i], f.get(i, [])) for i in range(len(texts))]


def test_scripts(spark):
    census = scripts.census(one(spark, "one Ω two 12")).orderBy("first_scalar").collect()
    assert [(r.script, r["count"], r.first_scalar) for r in census] == [("Latin", 6, 0), ("Greek", 1, 4)]
    texts = ["Привет мир", "Καλημέρα", "東京へようこそ", "서울 特別市", "台灣ㄅㄆ", "123 !", "", "hello"]
    assert all(s.total == 0 and not f and s.status == "clean" for s, f in review(spark, texts))
    (cjk, _), (latin, swapped), (_, flooded), (_, foreign), (tied, _), (_, known) = review(spark, ["漢字とカナ", "sесret", "q" + "ο" * 700, "хх аа q", "яq", "вωω"])
    assert (cjk.is_mixed_script, cjk.expected_combination, cjk.n_scripts, cjk.dominant_script) == (True, True, 3, "Han")
    assert [(f.rule, f.byte_start, f.byte_end, f.looks_like, f.script, f.finding, f.looks_like_detail.name) for f in swapped] == [
        ("confusable.curated_ascii_lookalike", 1, 3, "e", "Cyrillic", "script_1", "LATIN SMALL LETTER E"), ("confusable.curated_ascii_lookalike", 3, 5, "c", "Cyrillic", "script_2", "LATIN SMALL LETTER C"),
    ]
    assert latin.review_recommended and latin.status == "issues_found" and latin.dominant_script == "Latin"
    # lookalikes are reported where they are most of the text, and so are letters of the lesser script
    assert len(flooded) == 500 and {f.rule for f in flooded} == {"confusable.curated_ascii_lookalike", "mixed_script.character"} and flooded[0].script == "Latin"
    assert [(f.rule, f.category) for f in foreign[:1]] == [("confusable.curated_ascii_lookalike", "confusable")] and foreign[-1].rule == "mixed_script.character" and foreign[-1].looks_like_detail is None
    assert tied.dominant_script == "Cyrillic"  # of scripts with as many letters, the first
    # without Latin letters the rule is the script, but the letter is a known lookalike all the same
    assert [(f.rule, f.category, f.observed.escaped) for f in known] == [("mixed_script.character", "mixed_script", "\\u0432")] and [f.category for f in review(spark, ["ωωх"])[0][1]] == ["confusable"]


# --- JSON


@pytest.mark.parametrize(
    ("text", "code", "offset"),
    [
        ('{"n": 7,}', "trailing_comma", 7), ('["ö",\r\n ]', "trailing_comma", 4), ("[7,\n]", "trailing_comma", 2), ("  ", "unexpected_end", 2), ('{"n":', "unexpected_end", 5), ("{'n': 7}", "single_quoted_string", 1),
        ('{"n" 7}', "expected_colon", 5), ('{"n": 7 "m": 8}', "expected_comma_or_end", 8), ('["\\w"]', "invalid_escape", 2), ("[7 /* x */]", "comment_not_allowed", 3), ('{"n": }', "expected_value", 6),
        ('{"n":7,,}', "expected_property_name", 7), ("{n:7}", "expected_property_name", 1), ("[,7]", "expected_value", 1), ("fals", "expected_value", 0), ("+7", "expected_value", 0), ("{} {}", "extra_data", 3), ("07", "extra_data", 1),
        ("7.", "extra_data", 1), ('"open', "unterminated_string", 0), ('"tab\there"', "unescaped_control_character", 4), ('"\\u00g0"', "invalid_unicode_escape", 2), (BOM + "7", "unexpected_bom", 0), ("[" * 700, "nesting_too_deep", 512),
        ('{"a":"Infinity",\n"b":Infinity}', "non_standard_number", 21), ('"NaN" NaN', "extra_data", 6),
    ],
)
def test_json_faults(text, code, offset):
    r = check_json(text)
    assert (r["valid"], r["error_code"], r["character_offset"]) == (False, code, offset)
    assert r["byte_offset"] == len(text[:offset].encode()) and (r["line"], r["column"]) == places(text, offset)[2:]


def test_json_values():
    kinds = {"[]": "array", '{"k":{"k":1},"k":2}': "object", "[" * 511 + "{}" + "]" * 511: "array", '"\\udead"': "string", "1" * 5000: "number", "true": "boolean", "\tnull\n": "null"}
    assert {t: check_json(t).get("value_type") for t in kinds} == kinds


# --- code points, bytes


def test_inspector(spark):
    text = "Kö\U0001f9ed\r\ṇ" + SHY + "️"
    rows = inspector.inspect(one(spark, text)).orderBy("index").collect()
    assert [r.visible for r in rows] == ["K", "ö", "\U0001f9ed", "\\r", "\\n", "◌̣", "\\u00AD", "\\uFE0F"]
    assert [(r.byte_start, r.javascript_unit_start, r.line, r.column) for r in rows] == [places(text, i) for i in range(len(text))]
    assert [r.utf8_bytes for r in rows] == [list(c.encode()) for c in text] and [r.decimal for r in rows] == list(map(ord, text))
    assert (rows[3].name, rows[4].name, rows[5].category, rows[2].name) == ("CARRIAGE RETURN", "LINE FEED", "Mn", "COMPASS")
    assert inspector.too_long(one(spark, "n" * 501)).first().code == "input_too_large" and inspector.inspect(one(spark, "n" * 501)).count() == 0 and inspector.inspect(one(spark, "n" * 500)).count() == 500


@pytest.mark.parametrize(
    ("digits", "index"),
    [("4142E298", 2), ("C0AF", 0), ("61FE", 1), ("E29841", 2), ("E09F80", 1), ("EDB080", 1), ("F48FBFBF", None), ("F4A08080", 1), ("F5808080", 0), ("BF", 0), ("F09F", 0), ("F09FA741", 3), ("C2", 0), ("C341", 1), ("C3B6", None), ("", None)],
)
def test_first_invalid_byte(digits, index):
    assert first_invalid_byte(bytes.fromhex(digits)) == index


# --- envelopes


def body(value="text here", **more):
    return {"input": {"kind": "text", "value": value}, **more}


def packed(data: bytes, **more):
    return {"input": {"kind": "bytes", "base64": base64.b64encode(data).decode(), "declared_charset": "utf-8"}, **more}


def test_envelopes(spark):
    cases = [
        (json.dumps(body()).encode(), None), (b"\xef\xbb\xbf" + json.dumps(packed("ö".encode())).encode(), None), (b'{"input":"\xc3"}', "invalid_envelope_utf8"), (b"{", "invalid_request"), (b"[]", "invalid_request"),
        (json.dumps(body(profile="loose")).encode(), "unsupported_profile"), (json.dumps(body("t" * 32_769)).encode(), "input_too_large"), (json.dumps(body("\udc00")).encode(), "invalid_request"),
        (json.dumps(packed("ö".encode())).replace('"w7Y="', '"w7Y"').encode(), "invalid_base64"), (b"\n" * 262_145, "input_too_large"), (b'{"a":' * 90_000, "input_too_large"), (b"[" * 200_000, "invalid_request"),
        (b'{"input":{"kind":"text","value":-Infinity}}', "invalid_request"), (None, "invalid_request"), (json.dumps(packed(b"\xff\xfe")).encode(), None), (json.dumps(body("t" * 32_768, profile="identifier")).encode(), None),
    ]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "id long, body binary")
    checked = envelope.envelopes(df)
    assert [r.error for r in checked.orderBy("id").collect()] == [e for _, e in cases]
    good, bad = envelope.split_valid(checked)
    assert [r.text for r in good.orderBy("id").collect()][:2] == ["text here", "ö"] and {(r.code, r.status) for r in bad.collect()} == {(e or "invalid_utf8", envelope.STATUSES.get(e, 200)) for e in [None, *(e for _, e in cases if e)]}
    assert all(r.message for r in bad.collect())
    assert envelope.envelopes(df, profile_allowed=False).where("id = 5").first().error == "invalid_request"
    given = ["b25l", "b25", "b25l=", "b2 5l", "b25l\n", "_-8=", "QR==", "====", "", base64.b64encode(bytes(range(200))).decode()]
    b = spark.createDataFrame(list(enumerate(given)), "id long, s string").orderBy("id").select(envelope.is_canonical_base64(F.col("s")).alias("ok"))
    assert [r.ok for r in b.collect()] == [envelope.canonical_base64(x) is not None for x in given] == [True, *[False] * 7, True, True]


def test_results(spark):
    bodies = [body("pl" + ZWSP + "ain", profile="identifier"), packed(b"ab\xc3("), body("x" * 501), {"input": 1}]
    checked = envelope.envelopes(spark.createDataFrame([(i, json.dumps(b).encode()) for i, b in enumerate(bodies)], "id long, body binary"))
    r = {x.id: x for x in results.results(checked, "hidden-characters").collect()}
    assert [r[i].status for i in range(4)] == ["issues_found", "invalid_utf8", "clean", "error"] and (r[0].profile, r[0].ruleset_version, r[0].input.bytes, r[0].summary.total) == ("identifier", hidden.RULESET, 8, 1)
    assert (r[1].encoding.first_invalid_byte, r[1].encoding.valid_utf8, r[1].input.bytes, r[1].input.utf16_code_units, r[1].summary.total, r[1].skipped[0].reason) == (3, False, 4, None, 0, "invalid_utf8")
    assert (r[3].error.code, r[3].error.http_status, r[3].input) == ("invalid_request", 400, None) and r[0].skipped is None
    points = {x.id: x for x in results.results(checked, "code-points").collect()}
    assert points[2].error.code == "input_too_large" and points[1].summary is None and points[1].skipped[0].check == "code-points"
    with pytest.raises(ValueError, match="check"):
        results.results(checked, "none")


def test_headers(spark):
    rows = [("application/json", None, "7", None), ('Application/JSON ; charset="utf-8"', None, None, None), ("text/json", None, None, "unsupported_media_type"), ("application/json", "deflate", None, "unsupported_content_encoding"), ("application/json", None, "-1", "invalid_request"), ("application/json", None, "300000", "input_too_large")]
    df = spark.createDataFrame(rows, "t string, e string, n string, expected string").withColumn("got", envelope.check_headers(F.col("t"), F.col("e"), F.col("n")))
    assert all(r.got == r.expected for r in df.collect())


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "ö" + ZWSP), (2, "c")], "id long, text string")
    for kind in ("parquet", "json"):
        envelope.write_results(df, f"file://{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, envelope.read_texts(spark, f"file://{tmp_path}/{kind}", kind).collect())) == [(1, "ö" + ZWSP), (2, "c")]


# --- quota


def test_quota(spark):
    import datetime as dt

    base = dt.datetime(2023, 5, 6)
    events = [("u", i, base + dt.timedelta(seconds=0.25 * i)) for i in range(75)] + [("u", 200, base + dt.timedelta(seconds=100)), ("v", 1, base), ("v", 2, None), (None, 3, base)]
    r = {(x.actor, x.event_id): x.admitted for x in quota.admissions(spark.createDataFrame(events, "actor string, event_id long, ts timestamp")).collect()}
    assert [r["u", i] for i in range(75)] == [True] * 60 + [False] * 15 and r["u", 200] and r["v", 1] and not r["v", 2] and r[None, 3]


def test_actors(spark):
    rows = spark.createDataFrame([(1, "192.0.2.9, 10.1.1.1", "10.2.2.2"), (2, " 192.0.2.9", "10.3.3.3"), (3, "", "10.2.2.2"), (4, None, "10.2.2.2"), (5, None, None)], "id long, forwarded_for string, peer string")
    actor = {r.id: r.actor for r in quota.with_actor(rows, b"secret").collect()}
    assert actor[1] == actor[2] == quota.actor_key("192.0.2.9", b"secret") and actor[3] == actor[4] != actor[5] and actor[1] != quota.actor_key("192.0.2.9", b"other")


def test_quota_stream(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2023, 5, 6)
    spark.createDataFrame([("u", i, base + dt.timedelta(seconds=i)) for i in range(6)], "actor string, event_id long, ts timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("actor string, event_id long, ts timestamp").parquet(f"file://{tmp_path}/in")
    q = quota.stream_admissions(stream, limit=4).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.awaitTermination(120)
    assert sorted((r.event_id, r.admitted) for r in spark.table("admitted").collect()) == [(i, i < 4) for i in range(6)]


def test_findings_of_a_stream(spark, tmp_path):
    """Reviews are projections: a stream of texts gives a stream of findings."""
    many(spark, ["a" + ZWSP, "plain", "Ã¤" + SHY]).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long, text string").parquet(f"file://{tmp_path}/in")
    for name, rows, expected in (("hidden_stream", hidden.findings(stream), {(0, "hidden.zero_width_space"), (2, "hidden.soft_hyphen")}), ("mojibake_stream", mojibake.findings(stream), {(2, "mojibake.utf8_bytes_as_legacy_text")})):
        q = rows.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        q.awaitTermination(120)
        assert {(r.id, r.rule) for r in spark.table(name).collect()} == expected
