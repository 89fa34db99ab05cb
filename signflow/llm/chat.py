"""Chat formatting from a declarative template, with DataFrame functions only.

A finite-state machine over the roles checks the order of turns.  The output is
a list of segments with a loss flag each, and their concatenation.  Control
strings inside texts are escaped by one more backslash after their first
character, which is undone by taking one away.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import table

START, BROKEN = "<start>", "<broken>"


@dataclass(frozen=True)
class ChatTemplate:
    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    #: Strings that must not appear in a text as they are; each is one character and a rest.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "<s>", "</s>")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> next state; what is missing breaks the order
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            (START, "system"): "system",
            (START, "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accept: tuple[str, ...] = ("assistant",)

    def pattern(self) -> str:
        firsts = "".join(sorted({re.escape(c[0]) for c in self.control}))
        rests = "|".join(_quoted(c[1:]) for c in sorted(set(self.control), key=lambda c: (-len(c), c)))
        if any(c[0] in d[1:] for c in self.control for d in self.control):
            raise ValueError("the first character of a control string must not be inside another")
        return rf"([{firsts}])(\\*)({rests})"

    def states(self) -> list[str]:
        return [START, *sorted({s for k, v in self.moves.items() for s in (k[0], v)} - {START})]


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def escape(text: Column, t: ChatTemplate) -> Column:
    return F.regexp_replace(text, t.pattern(), r"$1\\$2$3")


def unescape(text: Column, t: ChatTemplate) -> Column:
    return F.regexp_replace(text, t.pattern().replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def escape_role(role: Column, t: ChatTemplate) -> Column:
    # every backslash of the result is followed by b or n, so taking the two apart again has one reading
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")), t)


def unescape_role(role: Column, t: ChatTemplate) -> Column:
    return F.replace(F.replace(unescape(role, t), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_chats(rows: DataFrame, template: ChatTemplate | None = None, block_turns: int = 256) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, segments, valid, broken_at.

    ``segments`` is an array of (text, loss) whose texts make up ``formatted``.
    ``broken_at`` is the number, from 0, of the first turn out of order, null if
    none is; ``valid`` also asks for an accepting last state.  Invalid
    conversations are formatted as well.

    Turns are ordered by turn, then role, then text, so ties and repeated rows
    have a fixed order; null texts and roles are empty, a null turn comes first,
    a null conv_id is a conversation, an empty table gives an empty table, other
    columns are not read, so they may have any names.  A conversation is first put together in
    blocks of turns, so a very long one is spread over tasks until its blocks,
    each with the machine's moves from every state, are joined up.
    """
    t = template or ChatTemplate()
    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    r = r.withColumn("block", F.floor(F.col("turn") / block_turns))
    blocks = r.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text"))).alias("turns"))
    moves = F.create_map(*[x for (s, role), to in t.moves.items() for x in (F.lit(f"{s}\n{role}"), F.lit(to))])

    def step(acc: Column, turn: Column) -> Column:
        to = F.when(acc.state == BROKEN, F.lit(BROKEN)).otherwise(F.coalesce(moves[F.concat(acc.state, F.lit("\n"), turn.role)], F.lit(BROKEN)))
        return F.struct(to.alias("state"), (acc.n + 1).alias("n"), F.when(acc.at.isNull() & (to == BROKEN), acc.n).otherwise(acc.at).alias("at"))

    def walk(state: str) -> Column:
        first = F.struct(F.lit(state).alias("state"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("at"))
        return F.aggregate("turns", first, step)

    def segments(turn: Column) -> Column:
        off = F.lit(False)
        return F.array(
            F.struct(F.concat(F.lit(t.begin), escape_role(turn.role, t), F.lit(t.after_role)).alias("text"), off.alias("loss")),
            F.struct(escape(turn.text, t).alias("text"), turn.role.isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.end).alias("text"), off.alias("loss")),
        )

    walked = blocks.select(
        "conv_id",
        "block",
        F.size("turns").cast("long").alias("n"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.create_map(*[x for s in t.states() for x in (F.lit(s), walk(s))]).alias("walks"),
    )
    whole = walked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "n", "segments", F.map_entries("walks").alias("walks")))).alias("blocks"))

    def join_up(acc: Column, b: Column) -> Column:
        way = F.filter(b.walks, lambda e: e.key == acc.state)[0].value
        broken = acc.state == BROKEN
        return F.struct(F.when(broken, F.lit(BROKEN)).otherwise(way.state).alias("state"), (acc.n + b.n).alias("n"), F.when(broken, acc.at).otherwise(acc.n + way.at).alias("at"))

    begun = F.struct(F.lit(START).alias("state"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("at"))
    out = whole.select("conv_id", F.flatten(F.transform("blocks", lambda b: b.segments)).alias("segments"), F.aggregate("blocks", begun, join_up).alias("end"))
    return out.select(
        "conv_id",
        F.col("end.n").alias("n_turns"),
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        "segments",
        F.col("end.state").isin(*t.accept).alias("valid"),
        F.col("end.at").alias("broken_at"),
    )


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns, an array of (role, text), that a formatted conversation holds."""
    t = template or ChatTemplate()
    parts = F.filter(F.split(formatted, _quoted(t.begin)), lambda x, i: i > 0)

    def turn(x: Column) -> Column:
        cut = F.instr(x, t.after_role)
        text = F.substring(x, cut + len(t.after_role), F.length(x) - cut + 1 - len(t.after_role) - len(t.end))
        return F.struct(unescape_role(F.substring(x, F.lit(1), cut - 1), t).alias("role"), unescape(text, t).alias("text"))

    return F.transform(parts, turn)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string"))
    t = ChatTemplate()
    out = format_chats(rows, t).withColumn("turns", read_back(F.col("formatted"), t))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text, t)), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "broken_at")
    return out.select("conv_id", "n_turns", F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "valid", "broken_at")
