"""Agent traces: who acts next, when a dialogue ends, what state and milestones remain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the dialogue loop.
STOP, TURN_LIMIT = "finish conversation", 40


def cut_dialogues(trace: DataFrame, limit: int = TURN_LIMIT) -> DataFrame:
    """Steps (case, step, sender, recipient, message) up to the first stop after step 1, ``limit`` at most."""
    stop = F.min(F.when((F.col("step") > 1) & F.contains("message", F.lit(STOP)), F.col("step"))).over(Window.partitionBy("case"))
    return trace.withColumn("stop", stop).filter((F.col("step") < limit) & (F.col("stop").isNull() | (F.col("step") <= F.col("stop")))).drop("stop")


def milestones(trace: DataFrame, recipient: str = "execution") -> DataFrame:
    """(case, milestones): messages sent to the executor, in order."""
    sent = F.array_sort(F.collect_list(F.when(F.col("recipient") == recipient, F.struct("step", "message"))))
    return trace.groupBy("case").agg(F.transform(sent, lambda m: m["message"]).alias("milestones"))


def final_states(states: DataFrame, saved: dict[str, list[str]]) -> DataFrame:
    """(case, class, attributes): the last state of each class, limited to its saved attributes."""
    last = states.groupBy("case", "class").agg(F.max_by("attributes", "step").alias("attributes"))
    keep = F.create_map(*[x for c, names in saved.items() for x in (F.lit(c), F.array(*map(F.lit, names)))])
    return last.withColumn("attributes", F.map_filter("attributes", lambda k, _: F.coalesce(F.array_contains(keep[F.col("class")], k), F.lit(False))))


def next_actor(trace: DataFrame) -> DataFrame:
    """(case, actor): the last step's recipient."""
    return trace.groupBy("case").agg(F.max_by("recipient", "step").alias("actor"))
