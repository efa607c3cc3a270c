r"""Chat formatting by prefix-target expansion (operator 7), in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context, and only
its reply is trainable. Template of a turn: ``[role]text</s>``. Inside roles and texts the four
characters of control strings are escaped reversibly: ``\`` as ``\e``, ``<`` as ``\l``, ``[`` as
``\o``, ``]`` as ``\c``, so no control string can come from data. A conversation whose last turn
is not an assistant's (or that has none) also gets one example without target, with nothing under
the loss mask, so that no turn is lost.

Nulls: a null text or role counts as empty; rows without conv_id or turn form a conversation or
come first like any other value. Ties of (conv_id, turn) are ordered by role, then text; repeated
rows stay. An empty table gives no example (the query still has conversation -1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Character, its escape.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\o"), ("]", "\\c"))
END = "</s>"


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def expand(turns: DataFrame) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text).

    Columns: conv_id, example (0-based), n_context (turns before the target), text (formatted),
    loss_start, loss_end (0-based code points of the trainable reply in text; both null without
    one), last (it shows the whole conversation).
    """
    seg = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = seg.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    convs = convs.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(F.lit("["), escape(t["role"]), F.lit("]"), escape(t["text"]), F.lit(END))).alias("segs"),
        F.transform("ts", lambda t: F.length(escape(t["text"]))).alias("lens"),
        F.transform("ts", lambda t: t["role"] == "assistant").alias("own"),
    )
    n = F.size("segs")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("own", i))
    # a trailing example without target is written as its negative length
    targets = F.when(F.element_at("own", -1), targets).otherwise(F.concat(targets, F.array(-n)))
    ex = convs.select("conv_id", "segs", "lens", F.posexplode(targets).alias("example", "target"))
    upto = F.abs("target")
    ex = ex.select("conv_id", "example", "target", F.array_join(F.slice("segs", F.lit(1), upto), "").alias("text"), F.element_at("lens", upto).alias("reply"), (upto == F.size("segs")).alias("last"))
    ends = F.when(F.col("target") > 0, F.length("text") - len(END))
    return ex.select("conv_id", "example", (F.abs("target") - (F.col("target") > 0).cast("int")).alias("n_context"), "text", (ends - F.col("reply")).alias("loss_start"), ends.alias("loss_end"), "last")


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the formatted text of its examples alone."""
    reply = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    # split leaves an empty string after the last end mark
    parts = F.split(F.col("text"), F.lit(END), F.lit(-1))
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: F.concat(unescape(F.substr(s, F.lit(2), F.instr(s, "]") - 2)), F.lit("\n"), unescape(F.substr(s, F.instr(s, "]") + 1)), F.lit("\n")))
    one = examples.select(
        "conv_id",
        F.length("text").cast("long").alias("chars"),
        F.struct("example", F.coalesce(reply, F.lit("")).alias("reply")).alias("r"),
        F.when(F.col("last"), F.struct((F.size(parts) - 1).cast("long").alias("n"), F.sha2(F.array_join(turns, ""), 256).alias("sha"))).alias("all"),
    )
    g = one.groupBy("conv_id").agg(F.max("all").alias("all"), F.sum("chars").alias("formatted_chars"), F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["reply"]), "").alias("loss"))
    return g.select(
        "conv_id",
        F.col("all.n").alias("n_turns"),
        F.col("all.sha").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t"),
    ).select("conv_id", "t.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(expand(turns))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(text) + 6
      + (length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '[', ''), ']', '')))
      + (length(text) - length(replace(replace(replace(replace(text, '\', ''), '<', ''), '[', ''), ']', ''))) AS len,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
