"""Preference pairs: one prompt, two completions, and which characters are trained on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subloom.operators.skew import checked_broadcast
from subloom.session import materialize


def conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, opening, turns): each conversation's (role, text) in order of turn, then
    role and text. Turns without a conv_id belong to none; null roles and texts are empty. Repeated
    turns are all kept."""
    clean = turns.filter("conv_id IS NOT NULL").select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    listed = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    said = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return listed.select("conv_id", said.alias("turns")).withColumn("opening", F.get("turns", F.lit(0)))


def paired_by_opening(convs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Rows (chosen_id, rejected_id): conversations with the same first turn, two by two in order
    of conv_id. The one with more assistant characters is chosen, on ties the smaller id. A
    conversation left over has no rejected_id. Each is in one row.

    A common opening is ranked in ranges of conv_id (``blocks`` in all, or Spark's number of
    partitions), to which the number of its conversations in earlier ranges is added."""
    spoken = F.aggregate(
        "turns",
        F.lit(0),
        lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0),
    )
    listed = convs.select(
        "conv_id", F.xxhash64("opening.role", "opening.text").alias("o"), "opening.text", spoken.alias("said")
    ).select("conv_id", "o", F.length("text").alias("size"), "said")
    by = ("o", "size", "conv_id")
    ranges = listed.repartitionByRange(blocks, *by) if blocks else listed.repartitionByRange(*by)
    # Range bounds are sampled: kept, so that counts and ranks see the same blocks.
    dealt = materialize(ranges.withColumn("block", F.spark_partition_id()))
    counts = dealt.groupBy("o", "size", "block").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("o", "size").orderBy("block"))
    # At most one opening a block goes on from an earlier one.
    earlier = counts.withColumn("earlier", so_far - F.col("n")).filter("earlier > 0").drop("n")
    rank = F.row_number().over(Window.partitionBy("o", "size", "block").orderBy("conv_id"))
    ranked = dealt.withColumn("rank", rank).join(
        checked_broadcast(materialize(earlier)), ["o", "size", "block"], "left"
    )
    at = F.col("rank") - 1 + F.coalesce("earlier", F.lit(0))
    two = ranked.withColumn("pair", F.floor(at / 2)).groupBy("o", "size", "pair")
    best = F.array_sort(F.collect_list(F.struct((-F.col("said")).alias("s"), "conv_id")))
    return two.agg(best.alias("b")).select(
        F.col("b")[0]["conv_id"].alias("chosen_id"), F.get("b.conv_id", F.lit(1)).alias("rejected_id")
    )


def render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def trained_spans(turns: Column) -> Column:
    """Character spans (start, stop) of what assistants say, end mark included, in the rendering
    of ``turns``."""
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc: Column, turn: Column) -> Column:
        stop = acc["at"] + F.length(render(turn))
        start = acc["at"] + F.length(turn["role"]) + 5
        mine = F.array(F.struct(start.alias("start"), (stop - 1).alias("stop")))
        spans = F.when(turn["role"] == "assistant", F.concat(acc["spans"], mine))
        return F.struct(stop.alias("at"), spans.otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are equal in role and text."""
    shorter = F.least(F.size(a), F.size(b))
    places = F.sequence(F.lit(0), shorter)
    same = F.filter(places, lambda i: (i == shorter) | ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.array_min(same)


def preference_format(convs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (chosen_id, rejected_id, n_prompt, prompt, chosen, chosen_spans, rejected,
    rejected_spans), one per row of ``pairs`` whose chosen conversation exists.

    The prompt is the longest common prefix of turns, rendered once; each completion is the rest
    of its conversation. Spans are the trained characters of a completion: assistant turns;
    everything else is masked. Without a rejected conversation (null or unknown id) the prompt is
    all before the last assistant turn and the completion starts there; without an assistant turn
    all is prompt. Equal conversations have empty completions. No pairs give no rows.
    """
    one = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    two = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    # Rows without a partner would meet in one task, that of the null key.
    paired = pairs.filter("rejected_id IS NOT NULL").join(two, "rejected_id", "left")
    single = pairs.filter("rejected_id IS NULL").withColumn("b", F.lit(None).cast(two.schema["b"].dataType))
    both = paired.unionByName(single).join(one, "chosen_id")
    spots = F.filter(
        F.sequence(F.lit(0), F.size("a") - 1), lambda i: F.get("a", i)["role"] == "assistant"
    )
    alone = F.coalesce(F.array_max(spots), F.size("a"))
    n = F.when(F.col("b").isNull(), alone).otherwise(common_prefix(F.col("a"), F.col("b")))
    cut = both.withColumn("n_prompt", n)
    after = F.col("n_prompt") + 1
    rest_a = F.slice("a", after, F.size("a") - F.col("n_prompt"))
    rest_b = F.slice("b", after, F.size("b") - F.col("n_prompt"))
    split = cut.select(
        "chosen_id",
        "rejected_id",
        "n_prompt",
        F.slice("a", F.lit(1), F.col("n_prompt")).alias("p"),
        rest_a.alias("a"),
        F.when(F.col("b").isNotNull(), rest_b).alias("b"),
    )
    return split.select(
        "chosen_id",
        "rejected_id",
        "n_prompt",
        rendered(F.col("p")).alias("prompt"),
        rendered(F.col("a")).alias("chosen"),
        trained_spans(F.col("a")).alias("chosen_spans"),
        rendered(F.col("b")).alias("rejected"),
        trained_spans(F.col("b")).alias("rejected_spans"),
    )
