"""Chat logs folded into final messages and rendered for training.

A log is a table of events (conv_id, seq, turn, kind, role, text):

- ``message`` sets the turn's text, ``delta`` appends to it,
- ``edit`` replaces it, ``delete`` removes the turn,
- ``regenerate`` discards the turn and all later ones, which are then streamed anew.

The fold needs no state machine: an event counts if no later ``regenerate`` of
its own or an earlier turn follows it, and no later ``message``, ``edit`` or
``delete`` of its turn. Running minima over the log in reverse order tell that;
what is left of a turn is concatenated in sequence order.

Template: ``<turn:role>`` newline, text, ``</turn>`` newline. In roles and texts
a backslash is written as ``\\b``, ``<`` as ``\\l``, and in roles also ``>`` as
``\\g``, so that no text can contain a control string, and back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OPEN, CLOSE = "<turn:", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text.

    Events are ordered by (seq, kind, role, text), so ties and repeated rows
    have one outcome. A null conv_id is a conversation of its own; a null turn
    sorts first; null roles and texts are empty; unknown or null kinds count
    as ``message``. The role is that of the turn's last counting event that
    has one. Other columns are ignored. No events give no messages.
    """
    kinds = ["delta", "edit", "regenerate", "delete"]
    e = events.select("conv_id", "seq", "turn", F.when(F.col("kind").isin(kinds), F.col("kind")).otherwise("message").alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("_o", F.struct("seq", "kind", "role", "text"))
    after = W.partitionBy("conv_id").orderBy(F.desc("_o")).rowsBetween(W.unboundedPreceding, -1)
    turn_after = W.partitionBy("conv_id", "turn").orderBy(F.desc("_o")).rowsBetween(W.unboundedPreceding, -1)
    again = F.min(F.when(F.col("kind") == "regenerate", F.coalesce("turn", F.lit(-(2**63))))).over(after)
    reset = F.max(F.col("kind").isin("message", "edit", "delete").cast("int")).over(turn_after)
    e = e.withColumn("_again", again).withColumn("_reset", reset)
    e = e.where((F.col("_again").isNull() | (F.coalesce("turn", F.lit(-(2**63))) < F.col("_again"))) & (F.coalesce("_reset", F.lit(0)) == 0))
    turns = e.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("_o")).alias("_es"))
    said = F.filter("_es", lambda x: x["kind"].isin("message", "delta", "edit"))
    turns = turns.withColumn("_said", said).where(F.size("_said") > 0)
    named = F.filter("_said", lambda x: x["role"].isNotNull())
    return turns.select("conv_id", "turn", F.coalesce(F.get(named, F.size(named) - 1)["role"], F.lit("")).alias("role"), F.array_join(F.transform("_said", lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, *, trained_role: str = "assistant") -> DataFrame:
    """One formatted row a conversation: conv_id, formatted, loss_spans.

    loss_spans are the (start, length) in code points, within ``formatted``, of
    the texts that are trained on. A conversation becomes one string, so its
    size is bounded by Spark's limit for a value (2 GB).
    """
    turn = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">\n"), escape(F.col("text")), F.lit(CLOSE))
    m = messages.select("conv_id", F.struct("turn", turn.alias("out"), (F.col("role") == trained_role).alias("on"), F.length(escape(F.col("text"))).cast("long").alias("n"), F.length(turn).cast("long").alias("whole")).alias("m"))
    m = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))
    spans = F.aggregate(
        "ms",
        start,
        lambda a, x: F.struct((a["at"] + x["whole"]).alias("at"), F.when(x["on"], F.array_append(a["spans"], F.struct((a["at"] + x["whole"] - x["n"] - len(CLOSE)).alias("start"), x["n"].alias("length")))).otherwise(a["spans"]).alias("spans")),
    )["spans"]
    return m.select("conv_id", F.array_join(F.transform("ms", lambda x: x["out"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted conversation."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    head = len(OPEN)
    end = lambda p: F.instr(p, ">\n")
    return F.transform(pieces, lambda p: F.struct(unescape_role(F.substring(p, F.lit(head + 1), end(p) - head - 1)).alias("role"), unescape(F.substring(p, end(p) + 2, F.length(p))).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


#: A conversation whose texts hold the control strings of several templates.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def event_log(messages: DataFrame) -> DataFrame:
    """The log that a chat service would keep of ``messages`` (conv_id, turn, role, text): conv_id, seq, turn, kind, role, text.

    An assistant's turn is streamed, discarded half-way, regenerated and streamed
    again in two deltas; any other turn is sent as a draft and then edited.
    Turns must be unique within a conversation.
    """
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))

    def told(*events: tuple[str, Column]) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"), said.alias("text")) for i, (kind, said) in enumerate(events)))

    streamed = told(("delta", F.reverse(first)), ("regenerate", F.lit(None).cast("string")), ("delta", first), ("delta", second))
    edited = told(("message", F.concat(F.lit("draft: "), second)), ("edit", text))
    rows = messages.select("conv_id", "turn", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e"))
    return rows.select("conv_id", (F.col("turn") * 4 + F.col("e.step")).alias("seq"), "turn", F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def chat_report(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them.

    The table holds final messages only, so they are told as an event log
    first, and the log is folded. Null conv_ids are one conversation, null
    turns sort first, null roles and texts are empty; repeated rows are
    messages of their own. A long text is kept whole. Columns other than these
    four are not read. An empty table gives the probe alone.
    """
    spark = conversations.sparkSession
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    # rows that share a turn are messages of their own, in order of role and text
    numbered = rows.withColumn("seq", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    out = render(fold_events(event_log(numbered.select("conv_id", F.col("seq").alias("turn"), "role", "text"))))
    out = out.withColumn("_turns", parse(F.col("formatted"))).withColumn("_loss", masked(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same in SQL, apart from reading back.
CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id,
       count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(16 + length(role) + length(text)
           + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<', ''))))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
