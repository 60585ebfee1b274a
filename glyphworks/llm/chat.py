"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is its turns one after the other, each
``### role: text</turn>`` and a line feed.  The text is written as it is where a
deterministic parser reads the same turn back from it; otherwise the turn is
written as ``###! role: text</turn>`` with control characters escaped.  Levels
are tried until what the parser reads is identical to the source: all turns
plain, then the conflicting turns escaped, then all of them.

Escapes: backslash ``\\b``, less-than ``\\l``, number sign ``\\h``, and in roles
colon ``\\c`` and line feed ``\\n``.  Every backslash of an escaped text starts a
two-character code, so codes are undone one by one, the backslash last.

Nulls: null texts and roles are empty, rows with a null conv_id form one
conversation, a null turn comes first.  Turns of the same number are ordered by
role and text, and repeated rows are turns of their own.  A conversation is one value, so it must fit into a row,
however long its texts are.  An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, HEAD = "</turn>\n", "###"
LOSS_ROLE = "assistant"


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _swap(c, ("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


def unescape(c: Column) -> Column:
    return _swap(c, ("\\l", "<"), ("\\h", "#"), ("\\b", "\\"))


def _escape_role(c: Column) -> Column:
    return _swap(escape(c), (":", "\\c"), ("\n", "\\n"))


def _unescape_role(c: Column) -> Column:
    return _swap(c, ("\\c", ":"), ("\\n", "\n"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\"))


def render_turn(role: Column, text: Column, escaped: Column) -> Column:
    plain = F.concat(F.lit(f"{HEAD} "), role, F.lit(": "), text, F.lit(END))
    return F.when(escaped, F.concat(F.lit(f"{HEAD}! "), _escape_role(role), F.lit(": "), escape(text), F.lit(END))).otherwise(plain)


def parse_blocks(formatted: Column) -> Column:
    """The turns as written, without their ends; what stands after the last end is a block too, unless empty."""
    blocks = F.split(formatted, END, -1)
    return F.when(F.element_at(blocks, -1) == "", F.slice(blocks, 1, F.size(blocks) - 1)).otherwise(blocks)


def parse_turn(block: Column) -> Column:
    """struct(role, text, skip, escaped): skip is where the text starts in the block.  Null if the grammar has no such turn."""
    escaped = F.startswith(block, F.lit(f"{HEAD}! "))
    start = F.when(escaped, F.lit(6)).when(F.startswith(block, F.lit(f"{HEAD} ")), F.lit(5))
    colon = F.instr(F.substr(block, start), F.lit(": "))
    role = F.substr(block, start, colon - 1)
    text = F.substr(block, start + colon + 1)
    # neither the head nor the end of a turn may stand inside one
    proper = (colon > 0) & ~F.contains(F.concat(role, F.lit(": "), text), F.lit(HEAD)) & ~F.contains(text, F.lit("</turn>"))
    return F.when(
        proper,
        F.struct(
            F.when(escaped, _unescape_role(role)).otherwise(role).alias("role"),
            F.when(escaped, unescape(text)).otherwise(text).alias("text"),
            (start + colon).cast("int").alias("skip"),
            escaped.alias("escaped"),
        ),
    )


def _pairs(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(conversations: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted, loss_mask, level: one row per conversation.

    loss_mask holds a struct(skip, take) for each turn in order: characters without
    loss, then characters with loss; whatever a turn has after that has none.
    level: 0 all turns plain, 1 conflicting turns escaped, 2 all escaped.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.struct("turn", empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    c = rows.groupBy("conv_id").agg(_pairs(F.sort_array(F.collect_list("t"))).alias("turns"))
    never, always = F.lit(False), F.lit(True)

    def rendered(escaped) -> Column:
        return F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"], escaped(t))), "")

    def conflicts(t: Column) -> Column:
        block = render_turn(t["role"], t["text"], never)
        back = F.transform(parse_blocks(block), parse_turn)
        return ~F.coalesce((F.size(back) == 1) & (back[0]["role"] == t["role"]) & (back[0]["text"] == t["text"]), F.lit(False))

    def same(formatted: Column) -> Column:
        return F.coalesce(_pairs(F.transform(parse_blocks(formatted), parse_turn)) == F.col("turns"), F.lit(False))

    c = c.withColumn("f0", rendered(lambda t: never)).withColumn("ok0", same(F.col("f0")))
    c = c.withColumn("f1", F.when(F.col("ok0"), F.col("f0")).otherwise(rendered(conflicts))).withColumn("ok1", F.col("ok0") | same(F.col("f1")))
    # the last level is parsed too: what cannot be read back is an error, not a result
    c = c.withColumn("f2", F.when(~F.col("ok1"), rendered(lambda t: always)))
    lost = F.raise_error(F.lit("a conversation cannot be read back from its text")).cast("string")
    c = c.withColumn("formatted", F.when(F.col("ok1"), F.col("f1")).when(same(F.col("f2")), F.col("f2")).otherwise(lost))
    c = c.withColumn("level", F.when(F.col("ok0"), 0).when(F.col("ok1"), 1).otherwise(2))
    c = c.withColumn("blocks", parse_blocks(F.col("formatted")))
    mask = F.transform("blocks", lambda b: _mask_of(b, parse_turn(b), loss_role))
    return c.select("conv_id", "formatted", mask.alias("loss_mask"), "level")


def _mask_of(block: Column, turn: Column, loss_role: str) -> Column:
    on = turn["role"] == loss_role
    whole = F.length(block) + len(END)
    return F.struct(F.when(on, turn["skip"]).otherwise(whole).cast("int").alias("skip"), F.when(on, F.length(block) - turn["skip"]).otherwise(0).cast("int").alias("take"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text as the grammar and the mask give them, from format_conversations()."""
    f = formatted.withColumn("blocks", parse_blocks(F.col("formatted")))
    f = f.withColumn("turns", F.transform("blocks", parse_turn))
    masked = F.transform(
        F.arrays_zip("blocks", "loss_mask", "turns"),
        lambda z: F.when(z["loss_mask"]["take"] > 0, _undo(F.substr(z["blocks"], z["loss_mask"]["skip"] + 1, z["loss_mask"]["take"]), z["turns"]["escaped"])).otherwise(F.lit("")),
    )
    return f.withColumn("loss_text", F.array_join(masked, ""))


def _undo(text: Column, escaped: Column) -> Column:
    return F.when(escaped, unescape(text)).otherwise(text)


def digests(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, contains(text, '###') or contains(text, '</turn>') or contains(role, '###') or contains(role, '</turn>') or contains(role, ': ')
    or contains(role || ': ' || text, '###') as odd from r
), f as (
  select *, case when odd
    then length('###! ' || replace(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c'), chr(10), '\n') || ': ' || replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') || '</turn>' || chr(10))
    else length('### ' || role || ': ' || text || '</turn>' || chr(10)) end as n from e
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(n) as bigint) as formatted_chars
from f group by conv_id
"""
