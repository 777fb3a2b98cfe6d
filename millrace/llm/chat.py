"""Chat formatting from event logs.

A conversation is the fold of its events. They are partitioned by conversation and message and sorted
by sequence: ``open`` starts a message, ``delta`` adds a streamed piece, ``edit`` replaces what there
is, ``regenerate`` drops it to start anew, ``delete`` takes the message away. A message's text is what
was added from its last edit or regeneration on. Messages, each once, are then gathered by
conversation in order and rendered. Folding by message first means that the deltas of a very long
conversation are spread over tasks; its rendered text is one value and meets in one place.

The template of a turn is ``<s>role[INST]text[/INST]</s>``. A control string inside a role or text
gets a backslash behind its first character, another one if it has some already; reading takes one
away, so every text comes back as it was. ``loss`` says for each turn whether its text is learned
from: those of the assistant.

Null texts and roles count as empty. Sequence numbers may be null (they come first) or repeated: ties
of messages are ordered by role and text, of events by kind and text. A null conversation is one of its own, as are
repeated rows events of their own. An unopened message has an empty role. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: control strings of the template -------------------------------------------
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
LEARNED = "assistant"
_CONTROL = r"(?=/?s>)"
_MARK = r"(?=/?INST\])"
ESCAPED = ((r"(<)(\\*)" + _CONTROL, r"(<)\\(\\*)" + _CONTROL), (r"(\[)(\\*)" + _MARK, r"(\[)\\(\\*)" + _MARK))


def escape(text: Column) -> Column:
    for found, _ in ESCAPED:
        text = F.regexp_replace(text, found, r"$1\\$2")
    return text


def unescape(text: Column) -> Column:
    for _, found in ESCAPED:
        text = F.regexp_replace(text, found, "$1$2")
    return text


def fold(events: DataFrame) -> DataFrame:
    """conv_id, seq, message_id, role, text: the final messages of (conv_id, seq, message_id, kind,
    role, text) events."""
    sorted_events = F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")))
    grouped = events.groupBy("conv_id", "message_id").agg(sorted_events.alias("e"))
    resets = F.transform("e", lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i + 1).otherwise(0))
    since = grouped.withColumns({"from": F.greatest(F.array_max(resets), F.lit(1)), "deleted": F.exists("e", lambda x: x["kind"] == "delete")})
    kept = F.filter(F.slice("e", F.col("from"), F.size("e")), lambda x: x["kind"].isin("delta", "edit"))
    opened = F.filter("e", lambda x: x["kind"] == "open")
    return since.filter("NOT deleted").select(
        "conv_id", F.get("e", F.lit(0))["seq"].alias("seq"), "message_id",
        F.coalesce(F.get(opened, F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss of messages (conv_id, seq, message_id, role, text)."""
    turn = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(OPEN), escape(F.col("text")), F.lit(CLOSE + END))
    pieces = messages.select("conv_id", F.struct("seq", "role", "text", "message_id", turn.alias("turn"), (F.col("role") == LEARNED).alias("loss")).alias("m"))
    gathered = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    return gathered.select("conv_id", F.array_join("m.turn", "").alias("formatted"), F.col("m.loss").alias("loss"))


def format_conversations(events: DataFrame) -> DataFrame:
    return render(fold(events))


def read_back(formatted: Column, loss: Column) -> Column:
    """The turns of a formatted conversation as structs of role, text and loss."""
    turns = F.split(formatted, END)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    return F.transform(turns, lambda turn, i: F.struct(
        unescape(F.substring(F.substring_index(turn, OPEN, 1), F.lit(len(BEGIN) + 1), F.length(turn))).alias("role"),
        unescape(F.substring_index(F.substring(turn, F.length(F.substring_index(turn, OPEN, 1)) + len(OPEN) + 1, F.length(turn)), CLOSE, 1)).alias("text"),
        F.get(loss, i).alias("loss"),
    ))


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log that would have led to them: each message streamed
    in two deltas, after a draft that was regenerated (assistant) or edited (others). Equal rows
    become messages of their own."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    named = counted.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    learned = F.col("role") == LEARNED

    def event(step, kind, text, role=F.lit(None).cast("string")):
        return F.struct(F.struct("turn", F.lit(step).alias("step")).alias("seq"), kind.alias("kind"), text.alias("text"), role.alias("role"))

    log = F.array(
        event(0, F.lit("open"), F.lit(""), F.col("role")), event(1, F.lit("delta"), F.lit("draft")),
        event(2, F.when(learned, "regenerate").otherwise("edit"), F.lit("")),
        event(3, F.lit("delta"), first), event(4, F.lit("delta"), second),
    )
    message = F.struct("turn", "role", F.sha2("text", 256).alias("digest"), "copy")
    return named.select("conv_id", message.alias("message_id"), F.inline(log))
