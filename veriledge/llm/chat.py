"""Chat formatting: a state machine over roles, and text segments with loss flags from a template.

All of it is Column expressions. A conversation is cut into parts of 64 turn numbers; each part
becomes segments on its own, together with what it does to every state of the machine, and parts
are composed per conversation. So a conversation with very many turns meets as a few short rows.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledge.llm.common import stored

# Control strings of the output. Texts never hold "<|" after escaping, so none can occur inside.
BEGIN, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
# Turn numbers that one part spans.
PART = 64


@dataclass(frozen=True)
class Template:
    """Pieces of a turn, each with its loss flag, and the legal order of roles.

    ``turns`` maps a role to its pieces; ``{role}`` and ``{text}`` stand for the escaped values.
    ``other`` serves roles without an entry. ``moves`` maps (state, role) to the next state; any
    other turn is illegal. The first state of ``states`` is the start.
    """

    turns: dict = field(default_factory=lambda: {
        "assistant": ((BEGIN + "{role}\n", False), ("{text}", True), (END + "\n", False))})
    other: tuple = ((BEGIN + "{role}\n", False), ("{text}", False), (END + "\n", False))
    states: tuple = ("start", "system", "user", "assistant", "tool")
    moves: dict = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant"})


CHAT = Template()


def escape(text: Column) -> Column:
    """One more backslash inside every ``<|``, ``<\\|``, ``<\\\\|`` ...; nothing else changes."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _filled(piece: str, role: Column, text: Column) -> Column:
    """A piece of the template as a Column."""
    values = {"{role}": F.replace(escape(role), F.lit("\n"), F.lit(LINE)), "{text}": escape(text)}
    out, rest = [], piece
    while rest:
        at = min((rest.find(v) for v in values if v in rest), default=len(rest))
        if at:
            out.append(F.lit(rest[:at]))
            rest = rest[at:]
        else:
            name = next(v for v in values if rest.startswith(v))
            out.append(values[name])
            rest = rest[len(name):]
    return F.concat(*out) if len(out) > 1 else out[0]


def _segments(turn: Column, template: Template) -> Column:
    """array<struct<text, loss>> of one turn."""
    def of(pieces):
        return F.array(*[F.struct(_filled(p, turn["role"], turn["text"]).alias("text"),
                                  F.lit(loss).alias("loss")) for p, loss in pieces])

    chosen = of(template.other)
    for role, pieces in template.turns.items():
        chosen = F.when(turn["role"] == role, of(pieces)).otherwise(chosen)
    return chosen


def _moves(role: Column, template: Template) -> Column:
    """Next state by number for every state; the number of states stands for an illegal turn."""
    states, illegal = template.states, len(template.states)

    def row(name):
        return F.array(*[F.lit(states.index(template.moves[s, name])
                               if (s, name) in template.moves else illegal) for s in states])

    chosen = F.array(*[F.lit(illegal)] * illegal)
    for name in sorted({r for _, r in template.moves}):
        chosen = F.when(role == name, row(name)).otherwise(chosen)
    return chosen


def _walked(turns: Column, template: Template) -> Column:
    """Per start state: the state after ``turns`` and the place of the first illegal turn."""
    illegal = len(template.states)
    state = "struct<state: int, bad: int>"
    start = F.array(*[F.struct(F.lit(i).alias("state"), F.lit(None).cast("int").alias("bad"))
                      .cast(state) for i in range(illegal)])
    steps = F.transform(turns, lambda t, i: F.struct(
        _moves(t["role"], template).alias("to"), i.alias("i")))

    def one(s: Column, step: Column) -> Column:
        to = F.element_at(step["to"], s["state"] + 1)
        return F.when(s["bad"].isNotNull(), s).otherwise(F.struct(
            F.when(to == illegal, s["state"]).otherwise(to).alias("state"),
            F.when(to == illegal, step["i"]).alias("bad")).cast(state))

    return F.aggregate(steps, start, lambda acc, step: F.transform(acc, lambda s: one(s, step)))


def formatted(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """Segments of every conversation: conv_id, part, segments, walked.

    Turns go by number, null numbers first, equal ones by role and text; repeated rows are turns
    of their own. Null roles and texts are empty; a null conv_id is a conversation. An empty table
    gives no rows; other columns are ignored.
    """
    empty = F.lit("")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), empty).alias("role"),
            F.coalesce(F.col("text").cast("string"), empty).alias("text")).alias("t"))
    part = F.coalesce(F.floor(F.col("t.turn") / PART), F.lit(-(1 << 62)))
    grouped = turns.groupBy("conv_id", part.alias("part")).agg(
        F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.select(
        "conv_id", "part",
        F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
        _walked(F.col("turns"), template).alias("walked"))


def _read_turn(raw: Column) -> Column:
    """role, line feed, text, line feed of one turn without its opening control string."""
    head = F.substring_index(raw, "\n", 1)
    body = F.substring_index(F.substr(raw, F.length(head) + 2), END, 1)
    role = unescape(F.replace(head, F.lit(LINE), F.lit("\n")))
    return F.concat(role, F.lit("\n"), unescape(body), F.lit("\n"))


def read_back(output: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation of a formatted output, parsed from its segments.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; then whether all
    turns come in legal order, the place of the first that does not, and the last state before it.
    """
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    raw = F.slice(F.split(F.col("whole"), r"<\|im_start\|>"), 2, 1 << 30)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                    lambda s: unescape(s["text"])), "")
    parts = (output.select("conv_id", "part", "walked", text.alias("whole"), loss.alias("loss"))
             .select("conv_id", "part", "walked", "loss", F.length("whole").alias("chars"),
                     F.transform(raw, _read_turn).alias("turns"))
             .groupBy("conv_id").agg(
                 F.sum(F.size("turns")).alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                 F.sum(F.length("loss")).alias("loss_chars"),
                 F.sort_array(F.collect_list(F.struct(
                     "part", F.array_join("turns", "").alias("turns"), "loss", "walked",
                     F.size("turns").alias("n")))).alias("p")))
    state = "struct<state: int, bad: long, seen: long>"
    start = F.struct(F.lit(0).alias("state"), F.lit(None).cast("long").alias("bad"),
                     F.lit(0).cast("long").alias("seen")).cast(state)

    def after(acc: Column, one: Column) -> Column:
        step = F.element_at(one["walked"], acc["state"] + 1)
        return F.when(acc["bad"].isNotNull(), acc).otherwise(F.struct(
            step["state"].alias("state"), (acc["seen"] + step["bad"]).alias("bad"),
            (acc["seen"] + one["n"]).alias("seen")).cast(state))

    names = F.array(*[F.lit(s) for s in template.states])
    whole = parts.withColumn("end", F.aggregate("p", start, after))
    digest = {name: F.sha2(F.array_join(F.col(f"p.{name}"), "").cast("binary"), 256)
              for name in ("turns", "loss")}
    return whole.select(
        "conv_id", "n_turns", digest["turns"].alias("turns_sha256"), "loss_chars",
        digest["loss"].alias("loss_sha256"), "formatted_chars",
        F.col("end.bad").isNull().alias("legal"), F.col("end.bad").alias("first_illegal"),
        F.element_at(names, F.col("end.state") + 1).alias("last_state"))


def with_control_texts(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose two texts are control strings."""
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(END + BEGIN + "assistant ok").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def format_and_read(spark: SparkSession, conversations: DataFrame, template: Template = CHAT
                    ) -> DataFrame:
    """Write the segments as Parquet and return what is read back from them."""
    return read_back(stored(formatted(conversations, template), "chat"), template)
