"""Chat formatting: one rendering of a dialogue for each participant's point of view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
UNKNOWN = "unknown"


def _plain(text: Column) -> Column:
    """A text in which the markers of the format can't be spelled."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<|im⁠_"))


def rotate_perspectives(turns: DataFrame, speaker: str = "role") -> DataFrame:
    """One row per dialogue and participant: ``conv_id, participant, n_turns, text, mask, n_chars, n_trained``.

    ``turns`` holds conv_id, turn, text and the speaker's name. In a participant's rendering
    its own turns are the assistant's, system turns stay system turns, and every other
    speaker is a named user. ``mask`` lists (length, trained) runs that together cover the
    text: the content and end marker of the participant's own turns are trained, all else
    is not. Lengths count code points.

    Turns are ordered by number, then speaker, then text; repeated rows are repeated turns.
    A null speaker is "unknown", a null text is empty, a null turn comes first. Markers of
    the format inside a name or text are broken up. A dialogue of system turns alone has no
    participant and gives no row, nor does a turn without conv_id, which belongs to no
    dialogue. A row of the result is one whole dialogue, so one dialogue bounds its size.
    """
    name = F.coalesce(F.col(speaker).cast("string"), F.lit(UNKNOWN))
    said = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct(F.col("turn").alias("turn"), name.alias("speaker"), _plain(F.col("text")).alias("text")).alias("said")
    )
    dialogues = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    people = F.array_sort(F.array_distinct(F.filter(F.col("said.speaker"), lambda s: s != SYSTEM)))
    views = dialogues.select("conv_id", "said", F.explode(people).alias("participant"))

    def head(s: Column) -> Column:
        role = (
            F.when(s["speaker"] == F.col("participant"), F.lit("assistant"))
            .when(s["speaker"] == SYSTEM, F.lit(SYSTEM))
            .otherwise(F.concat(F.lit("user name="), _plain(s["speaker"])))
        )
        return F.concat(F.lit(OPEN), role, F.lit("\n"))

    parts = F.transform("said", lambda s: F.struct(head(s).alias("head"), F.concat(s["text"], F.lit(CLOSE)).alias("rest"), (s["speaker"] == F.col("participant")).alias("own")))
    views = views.select("conv_id", "participant", parts.alias("parts"))
    runs = F.flatten(
        F.transform(
            "parts",
            lambda p: F.array(
                F.struct(F.length(p["head"]).alias("length"), F.lit(False).alias("trained")),
                F.struct(F.length(p["rest"]).alias("length"), p["own"].alias("trained")),
            ),
        )
    )
    total = lambda keep: F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + F.when(keep(m), m["length"]).otherwise(F.lit(0)))
    return views.select(
        "conv_id",
        "participant",
        F.size("parts").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["rest"])), "").alias("text"),
        runs.alias("mask"),
    ).select("*", total(lambda m: F.lit(True)).alias("n_chars"), total(lambda m: m["trained"]).alias("n_trained"))
