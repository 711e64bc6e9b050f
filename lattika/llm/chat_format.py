r"""Chat formatting with a grammar round trip (DataFrame functions only).

    conversation = turn*
    turn         = "<|im_start|>" role "\n" text "<|im_end|>\n"

Neither role nor text of the grammar holds a mark, and a role holds no line break. The
parser is strict: anything else than the grammar, such as a mark inside a text, a turn
without its end mark or a role without a line break, gives null for the conversation.

The round trip decides what is escaped. Turns are rendered as they are and parsed
again, each on its own; where the recovered role or text differs from the source (or
nothing is recovered), the side that conflicts is escaped once more and parsed again,
for as many rounds as it takes to be identical, at most ROUNDS. Unescaping takes away
one level everywhere, so the parser needs no notes on what was escaped:
"<|im_start|>" becomes "<\|im_start|>", and an escaped form, with any number of
backslashes, gets one more. In roles a line break is written as "<\n|>", with the
same rule. Then the rendered conversation is parsed as a whole and compared with the
source; the query fails where it is not identical.

`loss_mask` has the (start, length) of each assistant text in the formatted string, in
code points.

Defined results: null role or text is empty; a null conv_id is a conversation of
its own; turns are ordered by turn (null first), then role, then text, so repeated
rows and ties are kept in a fixed order; an empty table gives no rows; other
columns are ignored. One conversation is one output string, so it must fit a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattika.llm.common import let, running

START, END = "<|im_start|>", "<|im_end|>"
ESCAPABLE = r"<(\\*)\|(im_start|im_end)\|>"
ESCAPED = r"<\\(\\*)\|(im_start|im_end)\|>"
ROLE_BREAK, ROLE_ESCAPED = r"<\n|>", r"<\\(\\+)n\|>"
ROUNDS = 3


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"<\\$1|$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"<$1|$2|>")


def escape_role(role: Column) -> Column:
    longer = F.regexp_replace(escape(role), r"<(\\+)n\|>", r"<\\$1n|>")
    return F.replace(longer, F.lit("\n"), F.lit(ROLE_BREAK))


def unescape_role(role: Column) -> Column:
    broken = F.regexp_replace(role, r"<\\n\|>", "\n")
    return unescape(F.regexp_replace(broken, ROLE_ESCAPED, r"<$1n|>"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


TURN = "struct<role:string,text:string>"


def parse_turn(p: Column) -> Column:
    """struct(role, text), unescaped, of what stands between two start marks; null if the grammar does not allow it."""
    tail = END + "\n"
    cut_at = F.instr(p, "\n")
    role = F.substring(p, F.lit(1), cut_at - 1)
    text = F.substring(p, cut_at + 1, F.length(p) - len(tail) - cut_at)
    # The first end mark is the one at the end, after the role's line break.
    fits = p.endswith(tail) & (F.instr(p, END) == F.length(p) - len(tail) + 1) & (cut_at > 0) & (cut_at <= F.length(p) - len(tail))
    return F.when(fits, F.struct(unescape_role(role).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """Array of struct(role, text) of a rendered conversation; null if any of it is not of the grammar."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)

    def read(ps: Column) -> Column:
        turns = F.transform(F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0))), parse_turn)
        return let(turns, lambda ts: F.when((F.element_at(ps, 1) == "") & ~F.exists(ts, lambda t: t.isNull()), ts))

    return let(pieces, read)


def recovered(role: Column, text: Column) -> Column:
    """The turn that the parser finds in a rendered one; null if it finds none or several."""
    return let(parse(render_turn(role, text)), lambda turns: F.when(F.size(turns) == 1, F.get(turns, F.lit(0))))


def _side(source: Column, read: Callable[[Column], Column], more: Callable[[Column], Column]) -> Column:
    """struct(shown, ok, rounds): source, escaped once more for each round in which read(shown) is not the source."""
    start = F.struct(source.alias("shown"), F.lit(False).alias("ok"), F.lit(0).alias("rounds"))

    def step(acc: Column, _: Column) -> Column:
        same = F.coalesce(read(acc["shown"]) == source, F.lit(False))
        tried = let(same, lambda ok: F.struct(F.when(ok, acc["shown"]).otherwise(more(acc["shown"])).alias("shown"), ok.alias("ok"), (acc["rounds"] + F.when(ok, 0).otherwise(1)).alias("rounds")))
        return F.when(acc["ok"], acc).otherwise(tried)

    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), start, step)


def escaped(rows: DataFrame) -> DataFrame:
    """rows with shown_role and shown_text, which the parser reads back as role and text, and the number of rounds it took."""
    # Each side is tried with a harmless other side, to see which of them conflicts.
    role = _side(F.col("role"), lambda r: recovered(r, F.lit(""))["role"], escape_role)
    text = _side(F.col("text"), lambda t: recovered(F.lit("x"), t)["text"], escape)
    d = rows.select("*", F.array(F.struct(role.alias("role"), text.alias("text"))).alias("_s")).select("*", F.explode("_s").alias("_t")).drop("_s")
    return d.select(*rows.columns, F.col("_t.role.shown").alias("shown_role"), F.col("_t.text.shown").alias("shown_text"), F.greatest("_t.role.rounds", "_t.text.rounds").alias("rounds"))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (parsed back), round_trip, loss_mask, n_escaped: one row a conversation."""
    src = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    shown = render_turn(F.col("shown_role"), F.col("shown_text"))
    where = F.length(F.lit(START)) + F.length("shown_role") + 1  # of the text, in the rendered turn
    turn = F.struct("turn", "role", "text", shown.alias("shown"), where.cast("int").alias("at"), F.length("shown_text").alias("long"), (F.col("rounds") > 0).cast("int").alias("escaped"))
    convs = escaped(src).select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    convs = convs.select("conv_id", "ts", F.array_join(F.transform("ts", lambda t: t["shown"]), "").alias("formatted"))
    convs = convs.withColumn("turns", parse(F.col("formatted"))).withColumn("_begin", running(F.transform("ts", lambda t: F.length(t["shown"]))))
    same = F.coalesce(F.col("turns") == F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))
    spans = F.filter(F.zip_with("ts", "_begin", lambda t, b: F.struct((b + t["at"]).alias("start"), t["long"].alias("length"), t["role"].alias("role"))), lambda x: x["role"] == "assistant")
    mask = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return convs.select("conv_id", "formatted", "turns", same.alias("round_trip"), mask.alias("loss_mask"), F.aggregate("ts", F.lit(0), lambda a, t: a + t["escaped"]).alias("n_escaped"))


def chat_digest(rows: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the formatted string and its loss mask; fails where the round trip is not identical."""
    d = format_chats(rows)
    sure = F.when(F.col("round_trip"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation was not recovered from its formatted string")).cast(f"array<{TURN}>"))
    said = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring("formatted", m["start"] + 1, m["length"]))), "")
    d = d.select("conv_id", "formatted", "round_trip", "n_escaped", sure.alias("turns"), said.alias("loss"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
        F.col("n_escaped").cast("long").alias("n_escaped"),
    )
