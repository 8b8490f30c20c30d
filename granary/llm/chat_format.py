"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its text is trainable. Turns that follow the last assistant
turn (or a conversation without one) give one more example without a
trainable span, so that no turn is lost.

A turn is rendered as ``### role: text</turn>`` and a line feed. Control
strings inside roles and texts are escaped: ``\\`` as ``\\b``, ``</turn>`` as
``\\e``, ``###`` as ``\\h`` and, in roles, ``:`` as ``\\c``; reading back
reverses this exactly.

Defined results: a null text or role counts as empty; rows of a conversation
go by turn (null first), then role, then text, so ties and repeated rows have
one order and all stay; rows without a conv_id form a conversation of their
own; an empty table gives no rows; other columns play no part. A conversation
must fit in one row; the examples of one are made one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, safe in (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in (("###", "\\h"), ("</turn>", "\\e"), ("\\", "\\b")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, segments: an array with each turn's role and its rendered string, in order."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("row"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return ordered.select(
        "conv_id",
        F.transform(
            "rows",
            lambda r: F.struct(
                r["role"].alias("role"),
                F.concat(F.lit(OPEN), escape_role(r["role"]), F.lit(": "), escape(r["text"]), F.lit(CLOSE)).alias("shown"),
                F.char_length(escape(r["text"])).alias("loss"),
            ),
        ).alias("segments"),
    )


def prefix_examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_end: one row per trainable turn.

    ``example`` counts the turns shown; loss_start and loss_end bound the
    trainable code points of ``formatted`` (equal where nothing is trainable).
    """
    shown = render(turns)
    n = F.size("segments")
    ends = F.filter(
        F.sequence(F.lit(1), n),
        lambda k: (F.get("segments", k - 1)["role"] == target_role) | (k == n),
    )
    ends = shown.select("conv_id", "segments", F.explode(ends).alias("example"))
    last = F.get("segments", F.col("example") - 1)
    ends = ends.select(
        "conv_id",
        "example",
        F.array_join(F.transform(F.slice("segments", 1, F.col("example")), lambda s: s["shown"]), "").alias("formatted"),
        F.when(last["role"] == target_role, last["loss"]).otherwise(0).alias("loss"),
    )
    stop = F.char_length("formatted") - len(CLOSE)
    return ends.select("conv_id", "example", "formatted", (stop - F.col("loss")).alias("loss_start"), stop.alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs that a formatted string holds."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), ": ", 1)).alias("role"),
            unescape(F.substr(p, F.position(F.lit(": "), p) + 2)).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """What each conversation's examples hold, read back from their strings and spans."""
    read = examples.select(
        "conv_id",
        "example",
        "formatted",
        F.char_length("formatted").cast("long").alias("chars"),
        unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda r: r["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    turns = read_turns(F.col("whole"))
    return whole.select("conv_id", turns.alias("turns"), "loss", "formatted_chars", "n_examples").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


#: The conversation that op1 adds: control strings inside both texts.
PROBE = "\\### Assistant: </turn> ok"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return digest(prefix_examples(turns.unionByName(probe)))


ORACLE_SQL = {
    "op1_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length('### ' || replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c') || ': '
      || replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h') || '</turn>' || chr(10)) AS shown
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR k = n)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant' OR k = n)::BIGINT AS n_examples
FROM p GROUP BY conv_id
""",
}
QUERIES = {"op1_chat_format": op1_chat_format}
