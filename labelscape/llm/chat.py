"""Chat formatting with rotating perspective (operator 1).

A dialogue of several speakers becomes one training text for each of them: that speaker is the assistant, all others are named users,
system turns stay system turns, and the mask marks what the assistant says. Long dialogues come in segments of whole turns,
so that neither a task nor a row holds a dialogue of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscape.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Speakers that are nobody's counterpart: their turns stay what they are, and no text is made for them.
SYSTEM = ("system",)
SEGMENT = 16_384


def escaped(text: Column) -> Column:
    """Marks inside a turn lose their meaning."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def turns_in_order(df: DataFrame, conversation: str, turn: str, speaker: str, text: str, system: tuple[str, ...]) -> DataFrame:
    """Distinct turns, dealt by ranges of their order; ``part`` is the range, so that a long dialogue has many."""
    rows = df.select(
        F.struct(F.col(conversation).alias("id")).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.regexp_replace(F.col(speaker).cast("string"), r"[\x00-\x20]+", "_"), F.lit("unknown")).alias("speaker"),
        F.coalesce(escaped(F.col(text).cast("string")), F.lit("")).alias("text")).distinct()
    order = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text")]
    return written(rows.repartitionByRange(*order).withColumn("is_system", F.col("speaker").isin(*system)).withColumn(
        "part", F.spark_partition_id()))


def perspectives(df: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
                 system: tuple[str, ...] = SYSTEM, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation, participant and segment: conversation, participant, segment, n_turns, text, mask.

    ``mask`` lists the stretches of ``text`` to learn from as "start:end" in code points, comma-joined: what the participant says and the mark that
    ends it. A segment has the turns that begin within ``segment`` code points of the whole rendering; a turn is never cut.

    Turns go by number, then speaker and text; those without number come last. Equal rows are one turn. A null text is empty, a null
    speaker is "unknown", blanks in names are "_", and marks of the format inside a text are broken up. A null conversation is one of its own.
    A conversation without participants has no rows.
    """
    turns = turns_in_order(df, conversation, turn, speaker, text, system)
    # ``conv`` is a struct, so that a null conversation is a key like any other
    people = turns.where("not is_system").select("conv", F.col("speaker").alias("participant")).distinct()
    own = F.col("speaker") == F.col("participant")
    head = F.concat(F.lit(OPEN), F.when(F.col("is_system"), "system").when(own, "assistant").otherwise(
        F.concat(F.lit("user name="), F.col("speaker"))), F.lit("\n"))
    said = turns.join(people, "conv").select(
        "conv", "participant", "part", "turn", "speaker", "text", own.alias("own"), head.alias("head")).withColumn(
        "size", F.char_length("head") + F.char_length("text") + len(CLOSE) + 1)
    # where each turn begins: running sums inside a range of turns, and the ranges before it
    order = [F.col("turn").asc_nulls_last(), "speaker", "text"]
    group = [F.col("conv"), F.col("participant")]
    inside = F.sum("size").over(Window.partitionBy(*group, "part").orderBy(*order)) - F.col("size")
    totals = said.groupBy("conv", "participant", "part").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("conv", "participant", "part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = said.withColumn("inside", inside).join(bases, ["conv", "participant", "part"]).withColumn(
        "at", F.col("base") + F.col("inside"))
    rendered = F.concat("head", "text", F.lit(CLOSE + "\n"))
    spoken = F.col("at") + F.char_length("head")
    grouped = placed.withColumn("segment", F.floor(F.col("at") / segment)).groupBy("conv", "participant", "segment").agg(
        F.array_sort(F.collect_list(F.struct(
            "at", rendered.alias("text"), "own", spoken.alias("from"),
            (spoken + F.char_length("text") + len(CLOSE)).alias("to")))).alias("said"))
    first = F.col("said")[0]["at"]
    return grouped.select(
        F.col("conv")["id"].alias(conversation), "participant", "segment", F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda t: t["text"]), "").alias("text"),
        F.array_join(F.transform(F.filter("said", lambda t: t["own"]), lambda t: F.concat_ws(
            ":", t["from"] - first, t["to"] - first)), ",").alias("mask"))


#: The same in DuckDB, over ``conversations``.
SQL = f"""
    WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(regexp_replace(role, '[\\x00-\\x20]+', '_', 'g'), 'unknown') AS speaker,
            coalesce(replace(text, '<|im_', '<| im_'), '') AS text FROM conversations),
    people AS (SELECT DISTINCT conv_id AS c, speaker AS participant FROM turns WHERE speaker <> 'system'),
    said AS (SELECT conv_id, participant, turn, speaker, text, speaker = participant AS own,
            '{OPEN}' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant'
                ELSE 'user name=' || speaker END || chr(10) AS head
        FROM turns JOIN people ON conv_id IS NOT DISTINCT FROM c),
    sized AS (SELECT *, length(head) + length(text) + {len(CLOSE) + 1} AS size FROM said),
    placed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS LAST, speaker, text
            ROWS UNBOUNDED PRECEDING) - size AS pos FROM sized),
    dealt AS (SELECT *, CAST(floor(pos / {SEGMENT}) AS BIGINT) AS segment FROM placed),
    based AS (SELECT *, min(pos) OVER (PARTITION BY conv_id, participant, segment) AS first FROM dealt)
    SELECT conv_id, participant, segment, count(*) AS n_turns,
        string_agg(head || text || '{CLOSE}' || chr(10), '' ORDER BY pos) AS text,
        coalesce(string_agg(CAST(CAST(pos + length(head) - first AS BIGINT) AS VARCHAR) || ':'
            || CAST(CAST(pos + length(head) + length(text) + {len(CLOSE)} - first AS BIGINT) AS VARCHAR), ',' ORDER BY pos)
            FILTER (WHERE own), '') AS mask
    FROM based GROUP BY conv_id, participant, segment"""
