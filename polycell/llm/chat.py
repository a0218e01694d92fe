"""Chat formatting from event logs, with DataFrame functions only.

An event log has a row per event: conv_id, seq, turn, kind, role, text. Kinds:

* ``message``: the turn starts (again) with role and text;
* ``delta``: text is appended to the turn, as streamed;
* ``edit``: text takes the place of the turn's text;
* ``regenerate``: the turn starts again with text; what later turns had so far is
  dropped.

Events are dealt out by conversation, put in order of seq and folded to final
messages, which are rendered. A conversation is one row of the result, so its
own text is the least that a task must hold.

Template: ``<turn role="ROLE">TEXT</turn>`` and a line end for each turn. In roles
and texts, a backslash becomes ``\\b`` and the ``<`` of ``<turn`` or ``</turn``
becomes ``\\l``; in roles ``"`` becomes ``\\q``. Every backslash of the output
starts one of these codes, which is why the mapping can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

OPEN, MID, CLOSE = '<turn role="', '">', "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<turn"), F.lit("\\lturn")), F.lit("</turn"), F.lit("\\l/turn"))


def unescape(text: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\q", '"'), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit('"'), F.lit("\\q"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of event logs.

    Events with equal seq are taken in the order message, regenerate, edit, delta,
    then by role and text. An unknown or null kind counts as a delta; a null text
    is empty; the role is the last one that isn't null, else empty. A null conv_id
    is a conversation like any other. Null seq or turn come first.
    """
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    e = events.select("conv_id", "seq", "turn", rank.alias("rank"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    again = e.filter("rank = 1").groupBy(F.col("conv_id").alias("c")).agg(F.collect_list(F.struct("turn", "seq")).alias("again"))
    e = e.join(again, F.col("conv_id").eqNullSafe(F.col("c")), "left").filter("again is null or not exists(again, r -> r.turn < turn and r.seq > seq)")
    log = e.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("seq", "rank", "role", "text"))).alias("log"))
    start = F.expr("greatest(coalesce(array_max(transform(log, (x, i) -> if(x.rank < 3, i, 0))), 0), 0)")
    return log.withColumn("start", start).select(
        "conv_id",
        "turn",
        F.expr("coalesce(try_element_at(filter(transform(log, x -> x.role), r -> r is not null), -1), '')").alias("role"),
        F.expr("array_join(transform(slice(log, start + 1, size(log)), x -> x.text), '')").alias("text"),
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) of messages (conv_id, turn, role, text), in order of turn.

    loss_spans: array of (start, chars) in code points of ``formatted``, the
    texts of the trained role.
    """
    m = messages.select("conv_id", "turn", "role", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(MID)).alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("chars", (F.length("head") + F.length("body") + F.lit(len(CLOSE))).cast("long"))
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    m = m.withColumn("end", F.sum("chars").over(w))
    m = m.select("conv_id", F.struct("turn", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.when(F.col("role") == trained_role, F.struct((F.col("end") - F.col("chars") + F.length("head")).alias("start"), F.length("body").cast("long").alias("chars"))).alias("span")).alias("t"))
    m = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return m.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.expr("array_join(transform(ts, t -> t.piece), '')").alias("formatted"),
        F.expr("filter(transform(ts, t -> t.span), s -> s is not null)").alias("loss_spans"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, an array of (role, text), and ``loss_text``, both read from the formatted text and its mask."""
    pieces = F.split("formatted", CLOSE)
    out = formatted.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, MID, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(p, F.length(head) + len(MID) + 1)).alias("text"))

    loss = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int")))
    return out.withColumn("turns", F.transform("pieces", turn)).withColumn("loss_text", unescape(F.array_join(loss, ""))).drop("pieces")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and -7 as event logs, folded, rendered and read back.

    Of three turns one is streamed, one is a draft that an edit takes the place
    of, and one is a draft that is generated again, in two parts.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    own = F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in own]))
    rows = rows.union(spark.range(1).select(own.alias("r")).select("r.*"))
    # Rows with the same turn are turns of their own, in the order of role and text.
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("n", place)
    text = F.coalesce("text", F.lit(""))
    half = F.expr("cast(length(coalesce(text, '')) div 2 as int)")
    step = lambda k, kind, value: F.struct((F.col("n") * 8 + k).alias("seq"), F.lit(kind).alias("kind"), value.alias("text"))
    streamed = F.array(step(0, "message", F.lit("")), step(1, "delta", text))
    edited = F.array(step(0, "message", F.lit("a dra")), step(1, "delta", F.lit("ft")), step(2, "edit", text))
    again = F.array(step(0, "message", F.lit("a draft")), step(1, "regenerate", F.lit("")), step(2, "delta", F.substr(text, F.lit(1), half)), step(3, "delta", F.substr(text, half + 1)))
    steps = F.when(F.col("n") % 3 == 0, streamed).when(F.col("n") % 3 == 1, edited).otherwise(again)
    events = rows.select("conv_id", F.col("n").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.explode(steps).alias("e")).select("conv_id", "turn", "role", "e.seq", "e.kind", "e.text")
    read = parse(render(fold_events(events)))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = "replace(replace(replace({}, '\\', '\\b'), '<turn', '\\lturn'), '</turn', '\\l/turn')"
SQL = {
    "op4_chat_formatting": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + MID + CLOSE)} + length(replace({_ESC.format("role")}, '"', '\\q')) + length({_ESC.format("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
}
QUERIES = {"op4_chat_formatting": op4_chat_formatting}
