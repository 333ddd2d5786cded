"""Chat formatting by a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation:

    conversation := turn*
    turn         := "### " Role ": " content "</turn>" newline

A backslash in a role or content escapes the character after it. Content is first rendered as it is; the
rendering is parsed again and compared with the source, and content that doesn't come back unchanged is
escaped and parsed once more. The parser always unescapes, so no flag has to be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import read

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
ROLES = ("system", "user", "assistant")


def render(role: Column, content: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), content, F.lit(CLOSE))


def escaped(text: Column) -> Column:
    """No control string is left whole in the result: "#", "</turn>" and ": " get a backslash before or inside."""
    x = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(x, F.lit("#"), F.lit("\\#"))
    return F.replace(F.replace(x, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit(MIDDLE), F.lit(":\\ "))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def parse(formatted: Column) -> Column:
    """Array of (role, content, text) of a formatted text; content is still escaped, text isn't.

    The text is cut at each CLOSE; in a cut, the role ends at the first MIDDLE. A cut that doesn't start with
    OPEN or holds a bare control string comes back with a null role, so that the comparison with the source fails.
    """
    cuts = F.filter(F.split(formatted, CLOSE, -1), lambda c: c != "")

    def turn(c: Column) -> Column:
        at = F.instr(c, MIDDLE)
        content = F.substring(c, at + len(MIDDLE), F.length(c))
        good = c.startswith(OPEN) & (at > 0) & ~F.contains(content, F.lit("###")) & ~F.contains(content, F.lit("</turn>"))
        role = F.substring(c, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(F.when(good, unescaped(role)).alias("role"), content.alias("content"), unescaped(content).alias("text"))

    return F.transform(cuts, turn)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) plus rendered (the turn in the output) and content (the escaped text in it).

    Nulls in role or text count as empty. Each turn is parsed back by itself; it is escaped only if needed.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    role, text = F.col("role"), F.col("text")

    def same(rendered: Column) -> Column:
        p = parse(rendered)
        return (F.size(p) == 1) & (p[0]["role"] == role) & (p[0]["text"] == text)

    plain = t.withColumn("rendered", render(role, text)).withColumn("content", text)
    # A turn that holds neither an escape nor a control character can't be misread; the parse is for the rest.
    clean = ~F.coalesce(same(F.col("rendered")), F.lit(False))
    suspect = F.concat(role, text).rlike(r"[\\#<]|: ")
    out = plain.withColumn("escape", F.when(suspect, clean).otherwise(F.lit(False)))
    out = out.withColumn("content", F.when(F.col("escape"), escaped(text)).otherwise(text))
    return out.withColumn("rendered", F.when(F.col("escape"), render(escaped(role), F.col("content"))).otherwise(F.col("rendered"))).drop("escape")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: formatted, and turns (array of role, content, text) read back from it.

    Turns stand in the order of turn (null first), then role, then text; repeated rows are turns of their own;
    a null conv_id is a conversation. An empty table gives no rows. Other columns are left out. A
    conversation is one text, so its turns meet in one row; all work on a turn is done before that.
    """
    t = format_turns(turns.select("conv_id", "turn", "role", "text"))
    one = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered")))
    c = t.groupBy("conv_id").agg(one.alias("rows"))
    c = c.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"], r["text"])).alias("source"), F.array_join(F.transform("rows", lambda r: r["rendered"]), "").alias("formatted"))
    c = c.withColumn("turns", parse(F.col("formatted")))
    back = F.transform("turns", lambda r: F.struct(r["role"], r["text"]))
    return c.withColumn("round_trip", F.to_json(back) == F.to_json("source")).drop("source")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back; sha256 digests, lengths in code points."""
    text = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    c = format_conversations(rows)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # The mask covers the content of assistant turns.
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: unescaped(t["content"])), "")
    return c.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


ORACLE = r"""
WITH a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), b AS (
  SELECT *, regexp_matches(role, '(?s)\\.') OR regexp_matches(text, '(?s)\\.') OR contains(text, '###') OR contains(text, '</turn>') OR contains(role, ': ') AS e FROM a
), c AS (
  SELECT *, CASE WHEN e THEN replace(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ': ', ':\ ') ELSE text END AS content FROM b
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(role) + length(content) + 14) AS BIGINT) AS formatted_chars,
  true AS round_trip
FROM c GROUP BY conv_id
"""
