r"""Chat formatting with Spark expressions only.

Method. The turns of a conversation are collected as structs and sorted,
adjacent turns of one role are merged by array functions, and the blocks are
concatenated:

    <turn ROLE>\n TEXT [<turn/> TEXT ...] </turn>\n     (without the blanks)

`<turn/>` stands between the merged texts of a block, so every turn can be
read back. Inside texts and roles a backslash becomes `\s` and the `<` of a
control string (`<turn` or `</turn`) becomes `\l`; in roles `>` and a newline
become `\g` and `\n`. No control string is left in an escaped text, and the
escapes are undone in the opposite order.

The loss mask is a list of (start, length) spans in code points of the
formatted text: one span for each text of a trained role, without markers.

Cases: null text or role is an empty string; a null order value comes first;
ties are ordered by role, then text; repeated rows are turns of their own; a
null conversation id is a conversation of its own; an empty table gives an
empty result; other columns are ignored. A conversation is one output row, so
its whole text must fit into one row (2 GB).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE = "</turn>\n"
NEXT = "<turn/>"
#: Pieces that are summed or cut at once; a conversation of n turns costs about n times this at most.
BLOCK = 256


def escape_text(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\s")), "<(/?turn)", r"\\l$1")


def unescape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape_text(c), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape_text(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often `use` names it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _merge(turns: Column) -> Column:
    """array<struct<role, texts>>: one element for each run of turns with one role.

    A run begins where the role differs from the one before; its texts are the
    slice up to the next beginning, so each turn is copied once.
    """

    def cut(t: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(t) + 1))
        runs = F.zip_with(starts, ends, lambda a, b: F.slice(t, a, b - a))
        return F.transform(runs, lambda run: F.struct(run[0]["role"].alias("role"), F.transform(run, lambda x: x["text"]).alias("texts")))

    def begins(t: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.element_at(t, i)["role"] != F.element_at(t, F.greatest(i - 1, F.lit(1)))["role"]))

    return _let(turns, lambda t: _let(begins(t), lambda starts: cut(t, starts)))


def _blocks(items: Column) -> Column:
    """The items in arrays of BLOCK: work that is quadratic in an array stays small."""
    last = lambda x: F.greatest(F.floor((F.size(x) - 1) / BLOCK).cast("int"), F.lit(0))
    return _let(items, lambda x: F.filter(F.transform(F.sequence(F.lit(0), last(x)), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK))), lambda g: F.size(g) > 0))


def _running(sizes: Column, first: Column) -> Column:
    """The sum before each of a few sizes, from `first` on."""
    start = F.struct(first.alias("pos"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(sizes, start, lambda acc, n: F.struct((acc["pos"] + n).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")), lambda acc: acc["out"])


def _segments(blocks: Column, loss_roles: tuple[str, ...]) -> Column:
    """array<struct<s, loss>>: the pieces of the formatted text in order."""

    def piece(s: Column, loss: Column) -> Column:
        return F.struct(s.alias("s"), loss.alias("loss"))

    def block(b: Column) -> Column:
        trained = b["role"].isin(*loss_roles)
        head = piece(F.concat(F.lit("<turn "), escape_role(b["role"]), F.lit(">\n")), F.lit(False))
        texts = F.flatten(F.transform(b["texts"], lambda t, i: F.when(i == 0, F.array(piece(escape_text(t), trained))).otherwise(F.array(piece(F.lit(NEXT), F.lit(False)), piece(escape_text(t), trained)))))
        return F.concat(F.array(head), texts, F.array(piece(F.lit(CLOSE), F.lit(False))))

    return F.flatten(F.transform(blocks, block))


def _spans(segments: Column) -> Column:
    """array<struct<start, length>> of the pieces under the loss mask: running sums inside blocks of pieces, and over the blocks."""

    def starts(sizes: Column) -> Column:
        totals = F.transform(sizes, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, n: a + n))
        return F.flatten(F.zip_with(sizes, _running(totals, F.lit(0).cast("long")), _running))

    def placed(x: Column) -> Column:
        sizes = _blocks(F.transform(x, lambda y: F.char_length(y["s"]).cast("long")))
        return F.zip_with(x, _let(sizes, starts), lambda y, at: F.struct(y["loss"].alias("loss"), at.alias("start"), F.char_length(y["s"]).cast("long").alias("length")))

    return F.transform(F.filter(_let(segments, placed), lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_col, formatted, loss_spans) for each conversation."""
    turn = F.struct(F.col(order_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = sorted_turns.select("conv", _merge(F.col("turns")).alias("blocks")).select("conv", _segments(F.col("blocks"), loss_roles).alias("pieces"))
    return pieces.select(F.col("conv").alias(conv_col), F.array_join(F.transform("pieces", lambda x: x["s"]), "").alias("formatted"), _spans(F.col("pieces")).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> parsed back from a formatted text, one element for each original turn."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescape_role(F.regexp_extract(b, "(?s)^<turn ([^>]*)>\n(.*)$", 1))
        body = F.regexp_extract(b, "(?s)^<turn ([^>]*)>\n(.*)$", 2)
        return F.transform(F.split(body, NEXT), lambda t: F.struct(role.alias("role"), unescape_text(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order: the stretch of a block of spans is cut out first, then its spans."""

    def stretch(f: Column, g: Column) -> Column:
        end = F.element_at(g, -1)["start"] + F.element_at(g, -1)["length"]
        return F.struct(g.alias("g"), g[0]["start"].alias("base"), F.substring(f, g[0]["start"].cast("int") + 1, (end - g[0]["start"]).cast("int")).alias("s"))

    def texts(x: Column) -> Column:
        return F.array_join(F.transform(x["g"], lambda y: unescape_text(F.substring(x["s"], (y["start"] - x["base"]).cast("int") + 1, y["length"].cast("int")))), "")

    return F.array_join(F.transform(_let(formatted, lambda f: F.transform(_blocks(spans), lambda g: stretch(f, g))), texts), "")


def digest(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from format_conversations()' output."""
    back = chats.select(conv_col, "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


DIGEST_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) is not distinct from role as merged,
    regexp_replace(replace(text, '\', '\s'), '<(/?turn)', '\\l\1', 'g') as kept,
    replace(replace(regexp_replace(replace(role, '\', '\s'), '<(/?turn)', '\\l\1', 'g'), '>', '\g'), chr(10), '\n') as name
  from turns
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(kept) + case when merged and k > 1 then 7 else length(name) + 8 + 8 end)::bigint as formatted_chars
from placed group by conv_id
"""
