"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and
that one reply as the only text under the loss. A conversation that does not end with an
assistant turn ends with one more example without loss, so that no turn is lost.

A turn is written as

    <|turn|>role
    text<|end|>

Control strings inside roles and texts lose their first character to an entity (`&lt;`,
`&lb;`, and `&nl;` for a role's line ends); an ampersand that would read as one of the
entities becomes `&amp;`. Reading back replaces the entities, `&amp;` last.

Everything is built from Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlake.llm.common import column
from feedlake.staging import stage

TURN = "<|turn|>"
END = "<|end|>\n"
ASSISTANT = "assistant"
# A conversation of more examples is dealt to several tasks, so many to each.
PART_EXAMPLES = 256

ENTITY = r"&(?=(?:amp|lt|lb|nl);)"
ANGLE = r"<(?=/?s>|\|turn\|>|\|end\|>)"
BRACKET = r"\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, ENTITY, "&amp;")
    return F.regexp_replace(F.regexp_replace(text, ANGLE, "&lt;"), BRACKET, "&lb;")


def unescaped(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&lb;", "["), ("&nl;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def examples(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per example: conversation, example, formatted, loss_start, loss_end, complete.

    example numbers the turns of a conversation from 1 and names the turn the example ends
    with; formatted[loss_start:loss_end] (code points) is the escaped reply, both null
    without one. complete marks the example that holds the whole conversation. Turns come
    by their number, nulls first, ties by role and text, so repeated rows stay beside each
    other; null roles and texts count as empty; rows with a null conversation form one.
    An empty table gives an empty result; extra columns are not read.

    Every example is a prefix of its conversation, so a conversation is written once, with
    the places where its examples end, and each example is cut out of it. One of more than
    PART_EXAMPLES examples is dealt to several tasks for that. A conversation must fit in
    a row; what its examples hold in all grows with the square of its turns.
    """
    rows = turns.select(
        column(turns, conv_col).alias("conv"),
        column(turns, turn_col).alias("turn"),
        F.coalesce(column(turns, role_col), F.lit("")).alias("role"),
        F.coalesce(column(turns, text_col), F.lit("")).alias("text"),
    )
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&nl;"))
    head = F.concat(F.lit(TURN), role, F.lit("\n"))
    rows = rows.withColumn("body", escaped(F.col("text"))).withColumn(
        "piece", F.concat(head, F.col("body"), F.lit(END))
    )
    ordered = W.partitionBy("conv").orderBy("turn", "role", "text")
    placed = rows.select(
        "conv",
        "piece",
        F.row_number().over(ordered).alias("example"),
        F.sum(F.length("piece").cast("long")).over(ordered.rowsBetween(W.unboundedPreceding, 0)).alias("end"),
        F.when(F.col("role") == ASSISTANT, F.length("body")).alias("reply"),
        F.lead(F.lit(1)).over(ordered).isNull().alias("complete"),
    )
    stop = F.struct("example", "end", "reply", "complete")
    whole = placed.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("example", "piece"))).alias("pieces"),
        F.array_sort(
            F.collect_list(F.when(F.col("reply").isNotNull() | F.col("complete"), stop))
        ).alias("stops"),
    )
    whole = stage(
        whole.select("conv", F.array_join("pieces.piece", "").alias("whole"), "stops"), "conversations"
    )
    parts = F.ceil(F.size("stops") / PART_EXAMPLES).cast("int")
    part = F.slice("stops", F.col("part") * PART_EXAMPLES + 1, PART_EXAMPLES)
    # With their number given, adaptive execution leaves the tasks apart: they make far more than they read.
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        whole.where(parts > 1)
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("conv", "whole", part.alias("stops"), "part")
        .repartition(tasks, "conv", "part")
        .drop("part")
    )
    cut = whole.where(parts == 1).unionByName(dealt).select("conv", "whole", F.inline("stops"))
    end = F.col("end") - len(END)
    return cut.select(
        F.col("conv").alias(conv_col),
        "example",
        F.substr("whole", F.lit(1), F.col("end").cast("int")).alias("formatted"),
        (end - F.col("reply")).cast("int").alias("loss_start"),
        F.when(F.col("reply").isNotNull(), end).cast("int").alias("loss_end"),
        "complete",
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped."""
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    bodies = F.transform(
        F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substr(p, F.lit(len(TURN) + 1))
    )

    def turn(b):
        role = F.substring_index(b, "\n", 1)
        text = F.substr(b, F.length(role) + 2)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(bodies, turn)


def digests(made: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What a conversation's examples say when read back: its turns, its replies, its size."""
    loss = F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    back = made.groupBy(column(made, conv_col).alias("conv")).agg(
        F.max(F.when(F.col("complete"), F.col("formatted"))).alias("whole"),
        F.array_sort(
            F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("loss"))))
        ).alias("replies"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    turns = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    replies = F.array_join(F.transform("replies", lambda r: unescaped(r["loss"])), "")
    return (
        back.withColumn("turns", read_turns(F.col("whole")))
        .withColumn("said", replies)
        .select(
            F.col("conv").alias(conv_col),
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(turns, 256).alias("turns_sha256"),
            F.length("said").cast("long").alias("loss_chars"),
            F.sha2("said", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


TEST_ID = -7
TEST_TEXT = "</s>[INST] ok [/INST]"


def with_test_conversation(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """turns and a conversation of two turns that are made of control strings."""
    test = spark.range(2).select(
        F.lit(TEST_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"),
        F.lit(TEST_TEXT).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(test)


_SIZE = (
    "len({0}) + 3 * len(regexp_extract_all({0}, '</?s>|<\\|(turn|end)\\|>'))"
    " + 3 * len(regexp_extract_all({0}, '\\[/?INST\\]')) + 4 * len(regexp_extract_all({0}, '&(amp|lt|lb|nl);'))"
)
ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {TEST_ID}, 0, 'user', '{TEST_TEXT}'
  UNION ALL SELECT {TEST_ID}, 1, 'assistant', '{TEST_TEXT}'),
p AS (
  SELECT *, sum({_SIZE.format('role')} + {_SIZE.format('text')} + 17) OVER so_far AS size,
    lead(1) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS complete
  FROM c WINDOW so_far AS (PARTITION BY conv_id ORDER BY turn, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(size) FILTER (role = 'assistant' OR complete))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
