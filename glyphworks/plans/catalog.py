"""Queries over the supplied tables, and DuckDB SQL with the same rows.

The supplied texts are clean, so most queries first inject known defects by the
remainder of a key; the SQL injects the same ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphworks import __version__
from glyphworks.functions import text as T
from glyphworks.functions.kernels import invalid_byte
from glyphworks.functions.scan import LOCATION
from glyphworks.functions.unicode_data import CONFUSABLES
from glyphworks.operators import counts, hidden, inspector, json_check, mojibake, normalization, results, scripts
from glyphworks.sources import envelope
from glyphworks.streaming import quota

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- injected defects: remainder of the key -> (what is replaced, by what)

HIDDEN = {0: 0x200B, 1: 0x202E, 2: 0x00A0, 3: 0xFEFF, 4: 0x001B, 5: 0x0085, 6: 0xE0041}
HIDDEN_EDITS = {k: (". ", f".{chr(cp)} ") for k, cp in HIDDEN.items()}
MOJIBAKE_EDITS = {0: ("é", "Ã©"), 1: (". ", ".â€™ "), 2: (". ", ".� "), 3: ("e ", "ðŸ˜€ ")}
SCRIPT_EDITS = {0: ("a", "а"), 1: (". ", ". Ωμ "), 2: (". ", ". 漢字かな ")}


def _edited(key: str, n: int, edits: dict[int, tuple[str, str]], text: str = "text") -> Column:
    c = F.col(text)
    for k, (a, b) in edits.items():
        c = F.when(F.col(key) % n == k, F.replace(F.col(text), F.lit(a), F.lit(b))).otherwise(c)
    return c


def _sql_string(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


def _sql_edited(key: str, n: int, edits: dict[int, tuple[str, str]], text: str = "text") -> str:
    return f"case {key} % {n} " + " ".join(f"when {k} then replace({text}, {_sql_string(a)}, {_sql_string(b)})" for k, (a, b) in edits.items()) + f" else {text} end"


_SQL_WORD = r"[\p{L}\p{N}\p{Pc}](?:[\p{L}\p{N}\p{Pc}\p{M}]|[''’][\p{L}\p{N}\p{Pc}])*"
_SQL_LINES = r"1 + len(regexp_extract_all({t}, '\r\n|\r|\n'))"
_SQL_UTF16 = r"length({t}) + len(regexp_extract_all({t}, '[\x{{10000}}-\x{{10FFFF}}]'))"


def _sql_counts(t: str) -> str:
    return f"strlen({t}) as utf8_bytes, length({t}) as unicode_code_points, length({t}) as unicode_scalars, cast(len(regexp_extract_all({t}, '{_SQL_WORD}')) as bigint) as words, cast({_SQL_LINES.format(t=t)} as bigint) as lines, cast({_SQL_UTF16.format(t=t)} as bigint) as javascript_string_units"


def _sql_class(*ranges: tuple[int, int]) -> str:
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def _sql_legacy(low: int, high: int) -> str:
    """Characters whose legacy byte is in the range: themselves, or their cp1252 stand-ins."""
    return _sql_class((low, high), *((c, c) for c, b in mojibake.CP1252.items() if low <= b <= high))


_ANY = _sql_legacy(0x80, 0xBF)
_SQL_MOJIBAKE = "|".join(
    [
        r"\x{FFFD}", _sql_class((0xC2, 0xDF)) + _ANY, r"\x{E0}" + _sql_legacy(0xA0, 0xBF) + _ANY, _sql_class((0xE1, 0xEC), (0xEE, 0xEF)) + _ANY * 2, r"\x{ED}" + _sql_legacy(0x80, 0x9F) + _ANY,
        r"\x{F0}" + _sql_legacy(0x90, 0xBF) + _ANY * 2, _sql_class((0xF1, 0xF3)) + _ANY * 3, r"\x{F4}" + _sql_legacy(0x80, 0x8F) + _ANY * 2,
    ]
)
_SQL_HIDDEN_CLASS = _sql_class(*((r[0], r[1]) for r in hidden.RANGES), *hidden.CONTROLS)


def _sql_located(edited: str, pattern: str) -> str:
    """Hits with the text before each, from documents."""
    return f"""
with t as (select doc_id, {edited} as t from documents where text is not null
), p as (select doc_id, t, regexp_extract_all(t, '{pattern}') as h, string_split_regex(t, '{pattern}') as g from t
), k as (select *, unnest(range(1, least(len(h), 500) + 1)) as n from p
), o as (select doc_id, n, t, h[n] as o, cast(list_sum(list_transform(g[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:n - 1], lambda x: length(x))), 0) as bigint) as s from k
), l as (select doc_id, cast(n as integer) as n, o, s, substring(t, 1, s) as pre from o
), located as (select doc_id, n, o, s as scalar_start, cast(strlen(pre) as bigint) as byte_start, cast({_SQL_UTF16.format(t='pre')} as bigint) as utf16_start, cast({_SQL_LINES.format(t='pre')} as bigint) as line, cast(1 + length(string_split(pre, chr(10))[-1]) as bigint) as "column" from l)
"""


# --- counts


@_query(f"select lang, count(*) as texts, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in ('utf8_bytes', 'unicode_code_points', 'unicode_scalars', 'words', 'lines', 'javascript_string_units'))} from (select lang, {_sql_counts('text')} from documents) group by lang")
def text_counts_by_lang(spark, sf_dir):
    return counts.rollup(_table(spark, sf_dir, "documents"), ["lang"])


@_query(f"select lang, source, count(*) as texts, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in ('utf8_bytes', 'unicode_code_points', 'unicode_scalars', 'words', 'lines', 'javascript_string_units'))} from (select lang, source, {_sql_counts('text')} from documents) group by lang, source")
def corpus_rollup(spark, sf_dir):
    return counts.rollup(_table(spark, sf_dir, "documents"), ["lang", "source"])


_CRLF = {1: ("\n", "\r\n"), 2: ("\n", "\r")}


@_query(f"select conv_id, turn, {_sql_counts('t')} from (select conv_id, turn, {_sql_edited('conv_id', 3, _CRLF)} as t from conversations)")
def text_counts_rows(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumn("t", _edited("conv_id", 3, _CRLF))
    return rows.select("conv_id", "turn", *counts.native_counts("t"))


@_query("select doc_id, cast(length(text) + case when doc_id % 3 = 1 then 1 else 0 end as bigint) as grapheme_clusters from documents")
def grapheme_counts(spark, sf_dir):
    family = "\U0001f469\U0001f3fd‍\U0001f4bb"
    d = _table(spark, sf_dir, "documents").withColumn("t", F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(family))).otherwise(F.replace("text", F.lit("é"), F.lit("é"))))
    return counts.counts(d, "doc_id", "t").select("doc_id", "grapheme_clusters")


@_query("select doc_id, strlen(text) as bytes from documents where strlen(text) > 32768")
def oversized_inputs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(F.octet_length("text") > envelope.INPUT_LIMIT).select("doc_id", T.utf8_bytes(F.col("text")).alias("bytes"))


# --- hidden characters

_SQL_RULES = "(values " + ", ".join(f"({cp}, '{rule}', '{cat}', '{sev}', '{ident}', '{label}')" for cp, rule, cat, sev, ident, _, _, label in hidden.rule_rows()) + ") as r(cp, rule, category, severity, identifier_severity, label)"
_SQL_HIDDEN = _sql_located(_sql_edited("doc_id", 8, HIDDEN_EDITS), _SQL_HIDDEN_CLASS)


def _hidden_sql(severity: str) -> str:
    return _SQL_HIDDEN + f"""select doc_id, n, rule, category, {severity} as severity, byte_start, byte_start + strlen(o) as byte_end, utf16_start, utf16_start + {_SQL_UTF16.format(t='o')} as utf16_end, scalar_start, scalar_start + 1 as scalar_end,
  line, "column", 'U+' || case when unicode(o) < 65536 then lpad(upper(to_hex(unicode(o))), 4, '0') else upper(to_hex(unicode(o))) end as code_point from located join {_SQL_RULES} on r.cp = unicode(o)"""


def _hidden(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").withColumn("t", _edited("doc_id", 8, HIDDEN_EDITS))


_HIDDEN_COLUMNS = ["doc_id", "n", "rule", "category", "severity", *LOCATION[:8], "code_point"]


@_query(_hidden_sql("severity"))
def hidden_findings(spark, sf_dir):
    return hidden.findings(_hidden(spark, sf_dir), "doc_id", "t").select(*_HIDDEN_COLUMNS)


@_query(_hidden_sql("identifier_severity"))
def hidden_identifier_profile(spark, sf_dir):
    return hidden.findings(_hidden(spark, sf_dir), "doc_id", "t", profile="identifier").select(*_HIDDEN_COLUMNS)


def _summary_sql(edited: str, pattern: str) -> str:
    return f"""with t as (select doc_id, {edited} as t from documents), s as (select doc_id, t, cast(len(regexp_extract_all(t, '{pattern}')) as bigint) as total from t)
select doc_id, case when total > 0 then 'issues_found' else 'clean' end as status, total, least(total, 500) as returned, total > 500 as truncated, strlen(t) as bytes, {_SQL_UTF16.format(t='t')} as utf16_code_units, length(t) as unicode_scalars, {_SQL_LINES.format(t='t')} as lines from s"""


@_query(_summary_sql(_sql_edited("doc_id", 8, HIDDEN_EDITS), _SQL_HIDDEN_CLASS))
def hidden_summary(spark, sf_dir):
    return hidden.summary(_hidden(spark, sf_dir), "doc_id", "t")


# --- mojibake

_SQL_INTENDED = "(values ('Ã©', 'C3 A9', 'é'), ('â€™', 'E2 80 99', '’'), ('ðŸ˜€', 'F0 9F 98 80', '\U0001f600')) as i(shown, hex, intended)"


@_query(_sql_located(_sql_edited("doc_id", 5, MOJIBAKE_EDITS), _SQL_MOJIBAKE) + f"""select doc_id, n, case when o = chr(65533) then 'mojibake.replacement_character' else 'mojibake.utf8_bytes_as_legacy_text' end as rule,
  byte_start, byte_start + strlen(o) as byte_end, scalar_start, scalar_start + length(o) as scalar_end, utf16_start, line, "column", line as line_end, "column" + length(o) as column_end, hex as interpreted_bytes_hex, intended as possible_intended_character from located left join {_SQL_INTENDED} on shown = o""")
def mojibake_findings(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").withColumn("t", _edited("doc_id", 5, MOJIBAKE_EDITS))
    return mojibake.findings(d, "doc_id", "t").select("doc_id", "n", "rule", "byte_start", "byte_end", "scalar_start", "scalar_end", "utf16_start", "line", "column", "line_end", "column_end", "interpreted_bytes_hex", "possible_intended_character")


@_query(_summary_sql(_sql_edited("doc_id", 5, MOJIBAKE_EDITS), _SQL_MOJIBAKE))
def mojibake_summary(spark, sf_dir):
    return mojibake.summary(_table(spark, sf_dir, "documents").withColumn("t", _edited("doc_id", 5, MOJIBAKE_EDITS)), "doc_id", "t")


# --- normal forms

_SQL_NFD = "text"
for _c in map(chr, range(0xC0, 0x100)):
    if len(_d := unicodedata.normalize("NFD", _c)) == 2:
        _SQL_NFD = f"replace({_SQL_NFD}, '{_c}', '{_d[0]}' || chr({ord(_d[1])}))"


@_query(f"""with d as (select doc_id, text, {_SQL_NFD} as nfd from documents), f as (select doc_id, text, unnest(['NFC', 'NFD', 'NFKC', 'NFKD']) as form, nfd from d), g as (select doc_id, form, text, case when form in ('NFC', 'NFKC') then nfc_normalize(text) else nfd end as t from f)
select doc_id, form, t = text as is_normalized, strlen(t) as bytes, length(t) as unicode_scalars, length(t) as utf16_code_units, {_SQL_LINES.format(t='t')} as lines from g""")
def normalization_forms(spark, sf_dir):
    return normalization.forms(_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "form", "is_normalized", "bytes", "unicode_scalars", "utf16_code_units", "lines")


@_query(f"""with d as (select doc_id, text, {_SQL_NFD} as nfd from documents), c as (select *, length(text) - length(regexp_replace(text, '[{''.join(c for c in map(chr, range(0xC0, 0x100)) if len(unicodedata.normalize('NFD', c)) == 2)}][\\s\\S]*', '')) as tail from d where nfd <> text)
select doc_id, cast(n as integer) as n, rule, length(text) - tail as scalar_start from c, (values (1, 'normalization.not_nfd'), (2, 'normalization.not_nfkd')) as r(n, rule)""")
def normalization_findings(spark, sf_dir):
    return normalization.findings(_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "n", "rule", "scalar_start")


# --- scripts

_SQL_LETTERS = f"""with t as (select doc_id, {_sql_edited('doc_id', 5, SCRIPT_EDITS)} as t from documents), c as (select doc_id, unnest(string_split(t, '')) as c, unnest(range(0, length(t))) as i from t), s as (
  select doc_id, c, i, case when regexp_matches(c, '[A-Za-zÀ-ÖØ-öø-ÿ]') then 'Latin' when unicode(c) between 880 and 1023 then 'Greek' when unicode(c) between 1024 and 1279 then 'Cyrillic' when unicode(c) between 19968 and 40959 then 'Han' when unicode(c) between 12353 and 12438 then 'Hiragana' end as script from c
), l as (select * from s where script is not null), n as (select doc_id, script, count(*) as count, min(i) as first_scalar from l group by 1, 2
), d as (select doc_id, count(*) as n_scripts, arg_min(script, struct_pack(a := -count, b := first_scalar)) as dominant_script, bool_or(script = 'Latin') as latin from n group by 1)
"""


def _scripts(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").withColumn("t", _edited("doc_id", 5, SCRIPT_EDITS))


@_query(_SQL_LETTERS + "select doc_id, script, count, first_scalar from n")
def script_census(spark, sf_dir):
    return scripts.census(_scripts(spark, sf_dir), "doc_id", "t")


@_query(_SQL_LETTERS + """, f as (select l.doc_id, l.c, l.i, l.script, case when c = chr(1072) and latin then 'confusable.curated_ascii_lookalike' when n_scripts > 1 and script <> dominant_script then 'mixed_script.character' end as rule from l join d using (doc_id)
), g as (select *, row_number() over (partition by doc_id order by i) as n from f where rule is not null)
select doc_id, cast(n as integer) as n, rule, case when c = chr(1072) then 'confusable' else 'mixed_script' end as category, script, case when c = chr(1072) then 'a' end as looks_like, i as scalar_start from g where n <= 500""")
def mixed_script_findings(spark, sf_dir):
    return scripts.findings(_scripts(spark, sf_dir), "doc_id", "t").select("doc_id", "n", "rule", "category", "script", "looks_like", "scalar_start")


@_query(_SQL_LETTERS + """, f as (select l.doc_id, count(*) as total from l join d using (doc_id) where (c = chr(1072) and latin) or (n_scripts > 1 and script <> dominant_script) group by 1)
select t.doc_id, case when coalesce(total, 0) > 0 then 'issues_found' else 'clean' end as status, coalesce(total, 0) > 0 as review_recommended, dominant_script, coalesce(n_scripts, 0) > 1 as is_mixed_script, coalesce(n_scripts, 0) as n_scripts, coalesce(total, 0) as total from t left join d using (doc_id) left join f using (doc_id)""")
def script_summary(spark, sf_dir):
    return scripts.summary(_scripts(spark, sf_dir), "doc_id", "t").select("doc_id", "status", "review_recommended", "dominant_script", "is_mixed_script", "n_scripts", "total")


# --- JSON, code points, bytes

_BROKEN = {1: "substring(props, 1, length(props) - 1)", 2: "replace(props, '}', ',}')", 3: "replace(props, '\"', '''')", 4: "concat(props, ' x')", 5: "replace(props, ': ', ': NaN, \"z\": ')"}


@_query("""with e as (select event_id, event_id % 6 as k, length(props) as n from events)
select event_id, k = 0 as valid, case when k = 0 then 'object' end as value_type, case k when 1 then 'unexpected_end' when 2 then 'trailing_comma' when 3 then 'single_quoted_string' when 4 then 'extra_data' when 5 then 'non_standard_number' end as error_code,
  cast(case k when 1 then n - 1 when 2 then n - 1 when 3 then 1 when 4 then n + 1 when 5 then 6 end as bigint) as character_offset, cast(case when k > 0 then 1 end as bigint) as line from e""")
def json_validation(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    broken = F.col("props")
    for k, edit in _BROKEN.items():
        broken = F.when(F.col("event_id") % 6 == k, F.expr(edit.replace("''''", '"\'"'))).otherwise(broken)
    return json_check.validate(e.withColumn("t", broken), "event_id", "t").select("event_id", "valid", "value_type", "error_code", "character_offset", "line")


@_query("""with c as (select p_partkey, unnest(string_split(p_name, '')) as c, unnest(range(0, length(p_name))) as i from part where length(p_name) between 1 and 500)
select p_partkey, i as "index", 'U+' || lpad(upper(to_hex(unicode(c))), 4, '0') as code_point, cast(unicode(c) as bigint) as "decimal", case when c = ' ' then '\\u0020' else c end as visible, i as byte_start, i + 1 as javascript_unit_end, cast(1 as bigint) as line, i + 1 as "column" from c""")
def code_point_inspection(spark, sf_dir):
    return inspector.inspect(_table(spark, sf_dir, "part"), "p_partkey", "p_name").select("p_partkey", "index", "code_point", "decimal", "visible", "byte_start", "javascript_unit_end", "line", "column")


_BAD_BYTES = {0: ("E282", 0), 1: ("E228A1", 1), 2: ("FF", 0), 3: ("EDA080", 1), 4: ("F09F98", 0), 5: ("F09F2880", 2)}


@_query(f"select doc_id, doc_id % 7 = 6 as valid_utf8, cast(case doc_id % 7 {' '.join(f'when {k} then strlen(text) + {n}' for k, (_, n) in _BAD_BYTES.items())} end as bigint) as first_invalid_byte, doc_id % 7 = 3 as has_surrogate from documents")
def utf8_validation(spark, sf_dir):
    data = F.col("text").cast("binary")
    for k, (digits, _) in _BAD_BYTES.items():
        data = F.when(F.col("doc_id") % 7 == k, F.concat(F.col("text").cast("binary"), F.unhex(F.lit(digits)))).otherwise(data)
    d = _table(spark, sf_dir, "documents").select("doc_id", data.alias("b"))
    return d.select("doc_id", F.is_valid_utf8(F.col("b").cast("string")).alias("valid_utf8"), invalid_byte(F.col("b")).alias("first_invalid_byte"), T.has_surrogate(F.col("b")).alias("has_surrogate"))


@_query("""select doc_id, doc_id % 4 = 0 as canonical from documents""")
def base64_canonical(spark, sf_dir):
    good = F.base64(F.col("doc_id").cast("string").cast("binary"))
    k = F.col("doc_id") % 4
    given = F.when(k == 0, good).when(k == 1, F.concat(good, F.lit("="))).when(k == 2, F.lit("AB==")).otherwise(F.concat(F.lit("Y Q=="), good))
    return _table(spark, sf_dir, "documents").select("doc_id", envelope.is_canonical_base64(given).alias("canonical"))


_BODIES = [
    '{"input":{"kind":"text","value":"ID"}}', '{"input":{"kind":"bytes","base64":"SUQ=","declared_charset":"utf-8"},"profile":"identifier"}', '{"input":{"kind":"text","value":"ID"},"more":1}',
    '{"input":{"kind":"file","value":"ID"}}', '{"input":{"kind":"text","value":"ID"},"profile":"strict"}', '{"input":', '{"input":{"kind":"bytes","base64":"SUQ","declared_charset":"utf-8"}}',
]


@_query("""with d as (select doc_id, doc_id % 7 as k from documents)
select doc_id, case when k in (2, 3, 5) then 'invalid_request' when k = 4 then 'unsupported_profile' when k = 6 then 'invalid_base64' end as error, case k when 0 then 'text' when 1 then 'bytes' end as kind, case k when 0 then 'general' when 1 then 'identifier' end as profile,
  case when k = 0 then cast(doc_id as varchar) when k = 1 then 'ID' end as text from d""")
def envelope_validation(spark, sf_dir):
    body = F.element_at(F.array(*[F.lit(b) for b in _BODIES]), (F.col("doc_id") % len(_BODIES)).cast("int") + 1)
    d = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % len(_BODIES) == 1, body).otherwise(F.replace(body, F.lit("ID"), F.col("doc_id").cast("string"))).alias("body"))
    return envelope.envelopes(d, "doc_id").select("doc_id", "error", "kind", "profile", "text")


@_query("""with d as (select doc_id, doc_id % 7 as k from documents)
select doc_id, case when k in (2, 3, 5) then 'invalid_request' when k = 4 then 'unsupported_profile' else 'invalid_base64' end as code, cast(400 as integer) as status from d where k >= 2""")
def quarantine(spark, sf_dir):
    body = F.element_at(F.array(*[F.lit(b) for b in _BODIES]), (F.col("doc_id") % len(_BODIES)).cast("int") + 1)
    checked = envelope.envelopes(_table(spark, sf_dir, "documents").select("doc_id", body.alias("body")), "doc_id")
    return envelope.split_valid(checked)[1].select("doc_id", "code", "status")


# The log of a user is the list of admissions that may still count; at each event those of the last day do.
@_query("""with recursive e as (
  select cast(user_id as varchar) as actor, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as n, epoch_us(ts) as t from events where ts is not null
), run as (
  select actor, n, event_id, true as admitted, [t] as log from e where n = 1
  union all
  select e.actor, e.n, e.event_id, len(list_filter(run.log, lambda x: x >= e.t - 86400000000)) < 2,
    case when len(list_filter(run.log, lambda x: x >= e.t - 86400000000)) < 2 then list_append(list_filter(run.log, lambda x: x >= e.t - 86400000000), e.t) else list_filter(run.log, lambda x: x >= e.t - 86400000000) end
  from run join e on e.actor = run.actor and e.n = run.n + 1
)
select event_id, actor, admitted from run union all select event_id, cast(user_id as varchar), false from events where ts is null""")
def quota_admission(spark, sf_dir):
    """Two admissions a day for each user."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("actor"), "event_id", "ts")
    return quota.admissions(e, limit=2, window=86_400.0).select("event_id", "actor", "admitted")


# --- everything that the tables list: rules, lookalikes, JSON faults, headers, limits


@_query(f"""with d as (select doc_id, doc_id % {len(hidden.rule_rows())} as k from documents), r as (select *, row_number() over () - 1 as k from {_SQL_RULES})
select doc_id, rule, category, severity, identifier_severity, label, 'U+' || case when cp < 65536 then lpad(upper(to_hex(cp)), 4, '0') else upper(to_hex(cp)) end as code_point, cast(1 as bigint) as scalar_start,
  1 + strlen(chr(cp)) as byte_end, cast(case when cp > 65535 then 3 else 2 end as bigint) as utf16_end from d join r using (k)""")
def hidden_every_rule(spark, sf_dir):
    """Each hidden code point in turn, with its severities in both profiles."""
    points = [r[0] for r in hidden.rule_rows()]
    char = F.element_at(F.array(*[F.lit(chr(cp)) for cp in points]), (F.col("doc_id") % len(points)).cast("int") + 1)
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a"), char, F.lit("b")).alias("t"))
    strict = hidden.findings(d, "doc_id", "t", "identifier").select("doc_id", F.col("severity").alias("identifier_severity"))
    return hidden.findings(d, "doc_id", "t").join(strict, "doc_id").select("doc_id", "rule", "category", "severity", "identifier_severity", "label", "code_point", "scalar_start", "byte_end", "utf16_end")


_ALIKE = sorted(CONFUSABLES.items())


@_query(f"""with d as (select doc_id, doc_id % {len(_ALIKE)} as k from documents), r as (select *, row_number() over () - 1 as k from (values {', '.join(f"({cp}, '{c}')" for cp, c in _ALIKE)}) as v(cp, letter))
select doc_id, 'confusable.curated_ascii_lookalike' as rule, 'confusable' as category, letter as looks_like, 'U+' || lpad(upper(to_hex(cp)), 4, '0') as code_point, '\\u' || lpad(upper(to_hex(cp)), 4, '0') as escaped,
  case when cp < 1024 then 'Greek' else 'Cyrillic' end as script, 'U+' || lpad(upper(to_hex(unicode(letter))), 4, '0') as looks_like_point, cast(3 as bigint) as byte_start from d join r using (k)""")
def lookalikes(spark, sf_dir):
    """Each lookalike in turn, among Latin letters."""
    char = F.element_at(F.array(*[F.lit(chr(cp)) for cp, _ in _ALIKE]), (F.col("doc_id") % len(_ALIKE)).cast("int") + 1)
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("zz "), char, F.lit("zz")).alias("t"))
    found = scripts.findings(d, "doc_id", "t")
    return found.select("doc_id", "rule", "category", "looks_like", "code_point", F.col("observed.escaped").alias("escaped"), "script", F.col("looks_like_detail.code_point").alias("looks_like_point"), "byte_start")


#: Sources with every kind of fault, the code, the place of the fault and its line; last some without fault, and their types.
JSON_CASES = [
    ('{"a":[2,]}', "trailing_comma", 7, 1), ('{"a":\n', "unexpected_end", 6, 2), ("[2, /* two */ 3]", "comment_not_allowed", 4, 1), ('[\n\'x\']', "single_quoted_string", 2, 2), ('{"a": ,"b":3}', "expected_value", 6, 1),
    ("{a:2}", "expected_property_name", 1, 1), ('{"a"; 2}', "expected_colon", 4, 1), ('["a" "b"]', "expected_comma_or_end", 5, 1), ("2 3", "extra_data", 2, 1), ('["ab', "unterminated_string", 1, 1),
    ('["\\u12g4"]', "invalid_unicode_escape", 3, 1), ('["\\z"]', "invalid_escape", 2, 1), ('["a\tb"]', "unescaped_control_character", 3, 1), ("\ufeff2", "unexpected_bom", 0, 1), ("[2,\r\n-Infinity]", "non_standard_number", 5, 2),
    ("[" * 600, "nesting_too_deep", 512, 1), ("[2", "unexpected_end", 2, 1), ("[]", None, "array", None), ('"é"', None, "string", None), ("-0.5e3", None, "number", None), ("true", None, "boolean", None), (" null ", None, "null", None), ("{}", None, "object", None),
]


def _sql_literal(s: str | None) -> str:
    return "null" if s is None else " || ".join(f"'{c}'" if c.isascii() and c.isalnum() else f"chr({ord(c)})" for c in s) if len(s) < 100 else f"repeat('{s[0]}', {len(s)})"


@_query(f"""with d as (select doc_id, doc_id % {len(JSON_CASES)} as k from documents), r as (select * from (values {', '.join(f"({i}, {_sql_literal(t)}, {'null' if c is None else repr(c)}, {'null' if c is None else p}, {'null' if c is not None else repr(p)}, {'null' if n is None else n})" for i, (t, c, p, n) in enumerate(JSON_CASES))}) as v(k, t, code, place, kind, line))
select doc_id, code is null as valid, kind as value_type, code as error_code, cast(place as bigint) as character_offset, cast(strlen(substring(t, 1, place)) as bigint) as byte_offset, cast(line as bigint) as line from d join r using (k)""")
def json_every_code(spark, sf_dir):
    """Each fault that has a code of its own, and each type of value."""
    source = F.element_at(F.array(*[F.lit(t) for t, *_ in JSON_CASES]), (F.col("doc_id") % len(JSON_CASES)).cast("int") + 1)
    d = _table(spark, sf_dir, "documents").select("doc_id", source.alias("t"))
    return json_check.validate(d, "doc_id", "t").select("doc_id", "valid", "value_type", "error_code", "character_offset", "byte_offset", "line")


#: Content type, encoding and length, and the code.
_HEADERS = [
    ("application/json", None, "12", None), ('APPLICATION/JSON; Charset="UTF-8"', None, "0", None), ("application/json;charset=latin-1", None, None, "unsupported_media_type"), (None, None, "5", "unsupported_media_type"),
    ("application/json", "br", "5", "unsupported_content_encoding"), ("application/json", None, "+5", "invalid_request"), ("application/json", None, "007", "invalid_request"), ("application/json", None, "262144", None),
    ("application/json", None, "262145", "input_too_large"), ("application/json", None, "9" * 40, "input_too_large"), ("application/jsonx", None, "1", "unsupported_media_type"),
]


def _sql_quoted(s: str | None) -> str:
    return "cast(null as varchar)" if s is None else "'" + s.replace("'", "''") + "'"


@_query(f"with d as (select doc_id, doc_id % {len(_HEADERS)} as k from documents), r as (select * from (values {', '.join(f'({i}, {_sql_quoted(c)})' for i, (*_, c) in enumerate(_HEADERS))}) as v(k, code)) select doc_id, code from d join r using (k)")
def header_validation(spark, sf_dir):
    """Declared media type, encoding and size."""
    pick = lambda i: F.element_at(F.array(*[F.lit(h[i]).cast("string") for h in _HEADERS]), (F.col("doc_id") % len(_HEADERS)).cast("int") + 1)
    return _table(spark, sf_dir, "documents").select("doc_id", envelope.check_headers(pick(0), pick(1), pick(2)).alias("code"))


@_query("select doc_id, cast(413 as integer) as status, 'input_too_large' as code from documents where length(text) > 500")
def inspection_limit(spark, sf_dir):
    return inspector.too_long(_table(spark, sf_dir, "documents"), "doc_id")


_NAMED = [(0x00, "NULL", "Cc"), (0x0A, "LINE FEED", "Cc"), (0x1B, "ESCAPE", "Cc"), (0x85, "NEXT LINE", "Cc"), (0x90, "CONTROL", "Cc"), (0xE000, "PRIVATE USE", "Co"), (0x0378, "UNASSIGNED", "Cn"), (0xE9, "LATIN SMALL LETTER E WITH ACUTE", "Ll"), (0x301, "COMBINING ACUTE ACCENT", "Mn"), (0x1F600, "GRINNING FACE", "So")]
_VISIBLE = {0x00: r"\u0000", 0x0A: r"\n", 0x1B: r"\u001B", 0x85: r"\u0085", 0x90: r"\u0090", 0xE000: r"\uE000", 0x0378: r"\u0378", 0x301: "◌\u0301"}


@_query(f"""with d as (select doc_id, doc_id % {len(_NAMED)} as k from documents), r as (select * from (values {', '.join(f"({i}, '{n}', '{c}', {_sql_quoted(_VISIBLE.get(cp, chr(cp)))}, [{', '.join(str(b) for b in chr(cp).encode())}])" for i, (cp, n, c) in enumerate(_NAMED))}) as v(k, name, category, visible, utf8_bytes))
select doc_id, name, category, visible, array_to_string(utf8_bytes, ' ') as utf8_bytes, cast(len(utf8_bytes) as bigint) as byte_end from d join r using (k)""")
def character_names(spark, sf_dir):
    """Names, categories, bytes and visible forms of all kinds of characters."""
    char = F.element_at(F.array(*[F.lit(chr(cp)) for cp, *_ in _NAMED]), (F.col("doc_id") % len(_NAMED)).cast("int") + 1)
    d = _table(spark, sf_dir, "documents").select("doc_id", char.alias("t"))
    return inspector.inspect(d, "doc_id", "t").select("doc_id", "name", "category", "visible", F.array_join(F.col("utf8_bytes").cast("array<string>"), " ").alias("utf8_bytes"), "byte_end")


# --- character details and results


@_query("""with d as (select doc_id, doc_id % 3 as k from documents)
select doc_id, cast(k * 300 as bigint) as total, cast(least(k * 300, 500) as bigint) as returned, k * 300 > 500 as truncated, cast(least(k * 300, 500) as bigint) as listed, 'LATIN SMALL LETTER E WITH ACUTE' as first_name, '\\u00E9' as first_escape,
  cast(2 as bigint) as first_byte, cast(2 * k * 300 as bigint) as normalized_total, '\\u0065' as normalized_escape, 'Latin' as script from d where k > 0""")
def normalization_details(spark, sf_dir):
    """The changed range has at most 500 character details on both sides."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("ab"), F.repeat(F.lit("é"), (F.col("doc_id") % 3 * 300).cast("int"))).alias("t"))
    o, n = F.col("observed"), F.col("normalized")
    first = o["characters"][0]
    f = normalization.findings(d, "doc_id", "t").where("form = 'NFD'")
    return f.select(
        "doc_id", o["total"].alias("total"), o["returned"].alias("returned"), o["truncated"].alias("truncated"), F.size(o["characters"]).cast("long").alias("listed"), first["name"].alias("first_name"), first["escaped"].alias("first_escape"),
        first["location"]["byte_start"].alias("first_byte"), n["total"].alias("normalized_total"), n["characters"][0]["escaped"].alias("normalized_escape"), first["script"].alias("script"),
    )


@_query(f"with d as (select doc_id, text, {_SQL_NFD} as nfd from documents) select doc_id, case when nfd = text then 'normalized' else 'changes_found' end as status, cast(case when nfd = text then 0 else 2 end as bigint) as total, true as is_nfc, nfd = text as is_nfd, true as is_nfkc, nfd = text as is_nfkd, strlen(text) as bytes from d")
def normalization_summary(spark, sf_dir):
    return normalization.summary(_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "status", "total", "is_nfc", "is_nfd", "is_nfkc", "is_nfkd", "bytes")


@_query("""with d as (select doc_id, doc_id % 3 as k from documents)
select doc_id, case k when 0 then 'mojibake.replacement_character' else 'mojibake.utf8_bytes_as_legacy_text' end as rule, 'mojibake_1' as finding, 'warning' as severity, cast(case k when 0 then 1 when 1 then 2 else 4 end as bigint) as n_characters,
  case k when 0 then 'REPLACEMENT CHARACTER' when 1 then 'LATIN CAPITAL LETTER A WITH TILDE' else 'LATIN SMALL LETTER ETH' end as first_name, case k when 1 then 'U+00E9' when 2 then 'U+1F600' end as intended_point,
  case k when 1 then 'é' when 2 then chr(128512) end as intended, case k when 2 then '\\U0001F600' when 1 then '\\u00E9' end as intended_escape from d""")
def mojibake_details(spark, sf_dir):
    """Characters as shown, and the one meant, with their details."""
    shown = F.element_at(F.array(F.lit("\ufffd"), F.lit("Ã©"), F.lit("ðŸ˜€")), (F.col("doc_id") % 3).cast("int") + 1)
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("so "), shown).alias("t"))
    meant = F.col("intended_detail")
    return mojibake.findings(d, "doc_id", "t").select(
        "doc_id", "rule", "finding", "severity", F.size("characters").cast("long").alias("n_characters"), F.col("characters")[0]["name"].alias("first_name"), meant["code_point"].alias("intended_point"),
        F.col("possible_intended_character").alias("intended"), meant["escaped"].alias("intended_escape"),
    )


#: Bodies, and by check the status, error code, total and bytes that the result has.
_REQUESTS = [
    '{"input":{"kind":"text","value":"A\u200bé"}}', '{"input":{"kind":"bytes","base64":"WzEyXQ==","declared_charset":"utf-8"}}', '{"input":{"kind":"bytes","base64":"4iih","declared_charset":"utf-8"}}',
    '{"input":{"kind":"text","value":"x"},"profile":"identifier"}', "[]", '{"input":{"kind":"text","value":"' + "x" * 600 + '"}}',
]
_STATUS = {
    "hidden-characters": [("issues_found", None, 1), ("clean", None, 0), ("invalid_utf8", None, 0), ("clean", None, 0), ("error", "invalid_request", None), ("clean", None, 0)],
    "mojibake": [("clean", None, 0), ("clean", None, 0), ("invalid_utf8", None, None), ("error", "invalid_request", None), ("error", "invalid_request", None), ("clean", None, 0)],
    "normalization": [("changes_found", None, 2), ("normalized", None, 0), ("invalid_utf8", None, None), ("error", "invalid_request", None), ("error", "invalid_request", None), ("normalized", None, 0)],
    "mixed-script-confusables": [("clean", None, 0), ("clean", None, 0), ("invalid_utf8", None, None), ("error", "invalid_request", None), ("error", "invalid_request", None), ("clean", None, 0)],
    "text-counts": [("complete", None, None), ("complete", None, None), ("invalid_utf8", None, None), ("error", "invalid_request", None), ("error", "invalid_request", None), ("complete", None, None)],
    "json-validation": [("invalid_json", None, None), ("valid_json", None, None), ("invalid_utf8", None, None), ("error", "invalid_request", None), ("error", "invalid_request", None), ("invalid_json", None, None)],
    "code-points": [("complete", None, None), ("complete", None, None), ("invalid_utf8", None, None), ("error", "invalid_request", None), ("error", "invalid_request", None), ("error", "input_too_large", None)],
}
_SIZES = [(6, 3, "utf8-encoding-of-input-string"), (4, 4, "submitted-bytes"), (3, None, "submitted-bytes"), (1, 1, "utf8-encoding-of-input-string"), (None, None, None), (600, 600, "utf8-encoding-of-input-string")]


def _sql_results() -> str:
    null = lambda x: "null" if x is None else repr(x)
    rows = []
    for check, cases in _STATUS.items():
        for k, (status, code, total) in enumerate(cases):
            size, units, basis = _SIZES[k] if status != "error" else (None, None, None)
            http = {None: None, "invalid_request": 400, "input_too_large": 413}[code]
            rows.append(f"('{check}', {k}, '{status}', {null(code)}, {null(http)}, {null(total)}, {null(size)}, {null(units)}, {null(basis)}, {1 if status == 'invalid_utf8' else 'null'}, {null(check if status == 'invalid_utf8' else None)})")
    return f"""with d as (select doc_id, doc_id % {len(_REQUESTS)} as k from documents), r as (select * from (values {', '.join(rows)}) as v("check", k, status, code, http_status, total, bytes, utf16_code_units, offset_basis, first_invalid_byte, skipped))
select doc_id, "check", status, code, cast(http_status as integer) as http_status, cast(total as bigint) as total, cast(bytes as bigint) as bytes, cast(utf16_code_units as bigint) as utf16_code_units, offset_basis, cast(first_invalid_byte as bigint) as first_invalid_byte, skipped from d join r using (k)"""


@_query(_sql_results())
def request_results(spark, sf_dir):
    """All seven checks on texts, bytes, bad bytes, a profile where it is not allowed, a wrong body and a long text."""
    body = F.element_at(F.array(*[F.lit(b) for b in _REQUESTS]), (F.col("doc_id") % len(_REQUESTS)).cast("int") + 1)
    d = _table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    out = None
    for check in results.CHECKS:
        r = results.results(envelope.envelopes(d, "doc_id", profile_allowed=check == results.HIDDEN), check, "doc_id")
        r = r.select(
            "doc_id", F.lit(check).alias("check"), "status", F.col("error.code").alias("code"), F.col("error.http_status").alias("http_status"), F.col("summary.total").alias("total"), F.col("input.bytes").alias("bytes"),
            F.col("input.utf16_code_units").alias("utf16_code_units"), F.col("input.offset_basis").alias("offset_basis"), F.col("encoding.first_invalid_byte").alias("first_invalid_byte"), F.col("skipped")[0]["check"].alias("skipped"),
        )
        out = r if out is None else out.unionByName(r)
    return out


@_query(f"select 'ok' as status, '{__version__}' as engine_version, '{hidden.RULESET}' as ruleset_version, '{scripts.CONFUSABLE_VERSION}' as confusable_data_version")
def engine_info(spark, sf_dir):
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(__version__).alias("engine_version"), F.lit(hidden.RULESET).alias("ruleset_version"), F.lit(scripts.CONFUSABLE_VERSION).alias("confusable_data_version"))
