"""Chat formatting from event logs.

A log row is an event of a conversation's message: `start` opens it (its text is the role), `delta` appends streamed text,
`edit` replaces the message's text, `regenerate` clears it so that later deltas rewrite it. Logs are partitioned by
conversation in one shuffle, sorted by message and sequence and folded to final messages; these are rendered with a
template whose control strings can't occur in escaped text, and read_back() undoes it. Only DataFrame functions run here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>[INST]", "</s>\n"
#: Every control string starts with one of the escaped characters, so none can occur in escaped text.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&nl;"))


def escape(c: Column, table: tuple = ESCAPES) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), table, c)


def unescape(c: Column, table: tuple = ESCAPES) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[1]), F.lit(p[0])), reversed(table), c)


def turns_as_events(turns: DataFrame, masked: str = "assistant", draft: str = "...") -> DataFrame:
    """The event log of a table of finished turns (conv_id, turn, role, text; nulls are empty), as a chat service would
    have written it: each message starts with a draft, which a regeneration clears if its role is the masked one and an
    edit replaces otherwise, and the rest of its text is streamed."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"), F.monotonically_increasing_id().alias("message"), role.alias("role"), text.alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    a, b = F.substr("text", F.lit(1), half), F.substr("text", half + 1)

    def event(seq: int, kind: str, text: Column) -> Column:
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("event"), text.alias("text"))

    begin = [event(0, "start", F.col("role")), event(1, "delta", F.lit(draft))]
    again = F.array(*begin, event(2, "regenerate", F.lit("")), event(3, "delta", a), event(4, "delta", b))
    edited = F.array(*begin, event(2, "edit", a), event(3, "delta", b))
    return t.select("conv_id", "at", "message", F.explode(F.when(F.col("role") == masked, again).otherwise(edited)).alias("x")).select("conv_id", "at", "message", "x.*")


def fold_messages(events: DataFrame) -> DataFrame:
    """(conv_id, messages): each conversation's final messages (at, role, text) in order. events: conv_id, at, message, seq,
    event, text.

    Messages stand in order of `at`, equal ones in order of role, then text; `message` tells those of one place apart.
    Events before the last edit or regeneration are overridden; what follows is joined in sequence. Equal sequence
    numbers go by event, then text. Null texts are empty, a message without a start has an empty role. Unknown events
    have no effect. Work follows the number of events.
    """
    log = F.array_sort(F.collect_list(F.struct("at", "message", "seq", "event", F.coalesce("text", F.lit("")).alias("text"))))
    c = events.groupBy("conv_id").agg(log.alias("log")).withColumn("n", F.size("log"))

    def first(i: Column) -> Column:
        x, before = F.get("log", i), F.get("log", i - 1)
        return (i == 0) | ~(x["at"].eqNullSafe(before["at"]) & x["message"].eqNullSafe(before["message"]))

    c = c.withColumn("starts", F.filter(F.sequence(F.lit(0), F.col("n") - 1), first))
    c = c.select("conv_id", F.transform("starts", lambda s, k: F.slice("log", s + 1, F.coalesce(F.get("starts", k + 1), F.col("n")) - s)).alias("logs"))

    def reset(m: Column) -> Column:
        """Number of the last event that overrides what was before."""
        return F.coalesce(F.array_max(F.transform(m, lambda e, i: F.when(e["event"].isin("edit", "regenerate"), i))), F.lit(-1))

    def message(x: Column) -> Column:
        m, last = x["m"], x["last"]
        live = F.filter(m, lambda e, i: (i >= last) & ((e["event"] == "delta") | ((e["event"] == "edit") & (i == last))))
        role = F.coalesce(F.get(F.filter(m, lambda e: e["event"] == "start"), F.lit(0))["text"], F.lit(""))
        return F.struct(F.get(m, F.lit(0))["at"].alias("at"), role.alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))

    c = c.select("conv_id", F.transform("logs", lambda m: F.struct(m.alias("m"), reset(m).alias("last"))).alias("logs"))
    return c.select("conv_id", F.array_sort(F.transform("logs", message)).alias("messages"))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted): each message is OPEN, escaped role, a newline, escaped text, CLOSE, in message order."""
    turn = lambda m: F.concat(F.lit(OPEN), escape(m["role"], ROLE_ESCAPES), F.lit("\n"), escape(m["text"]), F.lit(CLOSE))
    return conversations.select("conv_id", F.array_join(F.transform("messages", turn), "").alias("formatted"))


def read_back(formatted: DataFrame, masked: str = "assistant") -> DataFrame:
    """Adds turns (role, text), parsed from formatted alone, and loss_text: the text under the loss mask, unescaped."""
    parts = F.split(F.col("formatted"), F.lit(r"</s>\n"))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(p: Column) -> Column:
        body = F.substr(p, F.lit(len(OPEN) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substr(body, F.char_length(role) + 2)).alias("text"))

    parsed = formatted.withColumn("turns", F.transform(parts, one))
    return parsed.withColumn("loss_text", F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == masked), lambda t: t["text"]), ""))


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, formatted, turns and loss_text of every conversation of an event log; an empty log: no rows."""
    return read_back(render(fold_messages(events)))
