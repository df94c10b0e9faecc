"""Truncation, masking, padding and packing as table jobs."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket, hash32, unit_draw
from ..functions.scan import int_levels, ordered_scan
from ..session import stage
from .cohort import first_where
from .sequence import VISIT_END, VISIT_START
from .tokens import CLS_ID, MASK_ID, PAD_ID

TRUNCATION_MODES = ("tail", "random", "random_right", "random_complete")
IGNORED_LABEL = -100


def truncate(
    seq: DataFrame, max_len: int, mode: str = "tail", seed: int = 42, packing: bool = False, by: str = "person_id"
) -> DataFrame:
    """At most ``max_len`` tokens per sequence, one place being left for the leading token unless ``packing``.

    ``tail`` keeps the last tokens from the first visit start among them; ``random`` any slice; ``random_right`` a slice
    from a random visit start; ``random_complete`` also ends before the last visit end in the slice. Sequences that
    fit are unchanged. Limits are found by one aggregation per sequence, not by ordering its tokens.
    """
    if mode not in TRUNCATION_MODES:
        raise ValueError(f"unknown truncation mode {mode!r}; one of {TRUNCATION_MODES}")
    m = max_len if packing else max_len - 1
    sizes = seq.groupBy(by).agg(F.max("pos").alias("n"))
    pos, n = F.col("pos"), F.col("n")
    is_start = F.col("token") == VISIT_START
    tail_start = first_where(is_start & (pos > n - m), pos)
    if mode == "random":
        limits = sizes.filter(n > m).withColumn("from_pos", hash32(seed, F.col(by)) % (n - m + 1) + 1)
    else:
        draws = F.min(F.when(is_start & (pos <= n - m), F.struct(hash32(seed, F.col(by), pos).alias("h"), pos)))
        marks = (
            seq.filter(is_start)
            .join(sizes, by)
            .filter(n > m)
            .groupBy(by)
            .agg(tail_start.alias("tail"), draws.alias("draw"))
        )
        limits = sizes.filter(n > m).join(marks, by, "left")
        start = F.coalesce("tail", n - m + 1)
        if mode != "tail":
            start = F.coalesce("draw.pos", start)
        limits = limits.withColumn("from_pos", start).drop("tail", "draw")
    limits = limits.withColumn("to_pos", F.least(F.col("from_pos") + m - 1, n)).drop("n")
    if mode == "random_complete":
        ends = (
            seq.filter(F.col("token") == VISIT_END)
            .join(limits, by)
            .filter((pos > F.col("from_pos")) & (pos <= F.col("to_pos")))
            .groupBy(by)
            .agg((F.max("pos") - 1).alias("__cut"))
        )
        limits = limits.join(ends, by, "left").withColumn("to_pos", F.coalesce("__cut", "to_pos")).drop("__cut")
    out = seq.join(limits, by, "left").filter(
        F.col("from_pos").isNull() | pos.between(F.col("from_pos"), F.col("to_pos"))
    )
    return out.withColumn("pos", pos - F.coalesce(F.col("from_pos") - 1, F.lit(0))).drop("from_pos", "to_pos")


def mask_tokens(
    seq: DataFrame, vocab_size: int, p: float = 0.15, seed: int = 42, by: Sequence[str] = ("person_id",)
) -> DataFrame:
    """``masked_id`` and ``label_id``: a share ``p`` of positions is hidden, 80 % by the mask id, 10 % by a random id.

    Padding and the leading token are never chosen. Draws are seeded hashes of the position's key.
    """
    key = [*[F.col(c) for c in by], F.col("pos")]
    chosen = (unit_draw(f"{seed}:choose", *key) < p) & ~F.col("token_id").isin(PAD_ID, CLS_ID)
    kind = unit_draw(f"{seed}:kind", *key)
    word = bucket(f"{seed}:word", *key, size=vocab_size).cast("int")
    hidden = F.when(kind < 0.8, F.lit(MASK_ID)).when(kind < 0.9, word).otherwise(F.col("token_id"))
    return seq.withColumns(
        {
            "masked_id": F.when(chosen, hidden).otherwise(F.col("token_id")),
            "label_id": F.when(chosen, F.col("token_id")).otherwise(F.lit(IGNORED_LABEL)),
        }
    )


# What the leading token and padding carry in each side column; None means taken from the first token.
_LEAD = {"input_ids": CLS_ID, "ages": None, "dates": None, "concept_values": -1.0, "concept_value_masks": 0,
         "visit_segments": 0}
_PAD = {"input_ids": PAD_ID, "ages": 0, "dates": 0, "concept_values": 0.0, "concept_value_masks": 0, "visit_segments": 0}


def pad_rows(arrays: DataFrame, max_len: int) -> DataFrame:
    """Fixed-length rows: the leading token, then the sequence, then padding; with an ``attention_mask``.

    Array columns: ``input_ids, ages, dates, visit_concept_orders, concept_values, concept_value_masks, visit_segments``,
    each already truncated to ``max_len`` - 1.
    """
    n = F.size("input_ids")
    pad = F.lit(max_len - 1) - n
    out = {"attention_mask": F.concat(F.array_repeat(F.lit(1), n + 1), F.array_repeat(F.lit(0), pad))}
    for c, lead in _LEAD.items():
        first = F.coalesce(F.get(c, F.lit(0)), F.lit(0)) if lead is None else F.lit(lead)
        out[c] = F.concat(F.array(first), F.col(c), F.array_repeat(F.lit(_PAD[c]), pad))
    orders = F.col("visit_concept_orders")
    first = F.greatest(F.coalesce(F.get(orders, F.lit(0)), F.lit(0)) - 1, F.lit(0))
    out["visit_concept_orders"] = F.concat(F.array(first), orders, F.array_repeat(F.lit(max_len - 1).cast("long"), pad))
    return arrays.withColumns(out)


def default_shards(n_rows: int, per_shard: int = 100_000) -> int:
    return max(1, math.ceil(n_rows / per_shard))


def pack(
    lengths: DataFrame,
    max_tokens: int,
    max_pos: int,
    shards: int | None = None,
    seed: int = 42,
    drop_last: bool = False,
    key: str = "person_id",
    per_shard: int = 100_000,
    replicas: int = 1,
) -> DataFrame:
    """``key, length, shard, pack, slot``: samples laid into packs of at most ``max_tokens`` by next-fit.

    Next-fit depends on order, so it is sequential within a shard. Samples are dealt to shards, and ordered there, by
    a seeded hash of their key; the number of shards grows with the table, which keeps each one small. A replica reads every
    ``replicas``-th shard; ``drop_last`` drops the last pack of each replica, however many shards there are.
    """
    if not shards:
        lengths = stage(lengths.select(key, "length"), "pack-lengths")
        shards = default_shards(lengths.count(), per_shard)
    shards = -(-shards // replicas) * replicas
    h = hash32(seed, F.col(key))
    dealt = lengths.select(key, "length", h.alias("h"), (h % shards).cast("int").alias("shard"))

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", key], ignore_index=True)
        # next-fit by running totals: a pack begins where the one before it cannot take the next sample; a step for each pack
        upto = np.concatenate(([0], np.cumsum(pdf["length"].clip(upper=max_pos).to_numpy() + 2)))
        starts, at = [], 0
        while at < len(pdf):
            starts.append(at)
            at = max(int(np.searchsorted(upto, upto[at] + max_tokens, side="right")) - 1, at + 1)
        sizes = np.diff([*starts, len(pdf)])
        pdf["pack"] = np.repeat(np.arange(len(starts)), sizes)
        pdf["slot"] = np.arange(len(pdf)) - np.repeat(np.array(starts, np.int64), sizes)
        current = len(starts) - 1
        if drop_last and len(pdf) and pdf["shard"].iloc[0] >= shards - replicas:  # a replica's last shard
            pdf = pdf[pdf["pack"] < current]
        return pdf[[key, "length", "shard", "pack", "slot"]]

    key_type = lengths.schema[key].dataType.simpleString()
    return dealt.groupBy("shard").applyInPandas(
        lay, f"{key} {key_type}, length long, shard int, pack long, slot int"
    )


def estimate_packs(lengths: DataFrame, max_tokens: int, max_pos: int, replicas: int = 1, drop_last: bool = False):
    """One row: the expected number of packs from the average truncated length.

    Samples of length 0 all fit one pack; where the average is above the budget each sample is a pack of its own.
    """
    need = F.least(F.col("length"), F.lit(max_pos))
    out = lengths.agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum(need) / F.count(F.lit(1))).alias("avg_len"))
    per_pack = F.greatest(F.floor(F.try_divide(F.lit(max_tokens), F.col("avg_len"))), F.lit(1))
    packs = F.when(F.col("avg_len") > 0, F.floor(F.col("n") / per_pack)).otherwise(F.least(F.col("n"), F.lit(1)))
    packs = packs if drop_last else F.greatest(packs, F.lit(1))
    return out.withColumn("packs", F.coalesce(packs * replicas, F.lit(0)).cast("long"))


def packed_rows(seq: DataFrame, packs: DataFrame, key: str = "person_id") -> DataFrame:
    """Long rows of packs: per member a leading token, its tokens, and a padding token.

    ``seq`` has ``key, pos, token_id, age, week, visit_order, value, value_mask, segment`` and is already truncated.
    Returns ``shard, pack, pack_pos`` with the side columns; a pack is bounded by its token budget.
    """
    need = packs.select(key, "shard", "pack", "slot")
    n = seq.groupBy(key).agg(
        F.max("pos").alias("n"),
        F.min_by("age", "pos").alias("first_age"),
        F.min_by("week", "pos").alias("first_week"),
        F.min_by("visit_order", "pos").alias("first_order"),
        F.max_by("visit_order", "pos").alias("last_order"),
    )
    members = need.join(n, key)
    members = ordered_scan(
        members, ["shard", "pack"], int_levels(F.col("slot")), [F.col("slot")], sums={"__upto": F.col("n") + 2}
    ).withColumn("__at", F.col("__upto") - F.col("n") - 2)
    where = members.select(key, "shard", "pack", "__at")
    body = seq.join(where, key).select(
        "shard", "pack", key, (F.col("__at") + 1 + F.col("pos")).alias("pack_pos"), "token_id",
        F.lit(1).alias("attention"), "age", "week", "visit_order", "value", "value_mask", "segment",
    )

    def edge(pos, token_id, attention, age, week, order):
        return F.struct(
            pos.cast("long").alias("pack_pos"), F.lit(token_id).alias("token_id"), F.lit(attention).alias("attention"),
            age.alias("age"), week.alias("week"), order.cast("long").alias("visit_order"),
        )

    zero = F.lit(0)
    lead = edge(F.col("__at") + 1, CLS_ID, 1, F.col("first_age"), F.col("first_week"),
                F.greatest(F.col("first_order") - 1, zero))
    tail = edge(F.col("__upto"), PAD_ID, 0, zero, zero, F.col("last_order"))
    edges = members.select("shard", "pack", key, F.inline(F.array(lead, tail))).withColumns(
        {"value": F.lit(-1.0), "value_mask": zero, "segment": zero}
    )
    return body.unionByName(edges)


def segment_ids(packed: DataFrame) -> DataFrame:
    """``sample``: 1, 2, … over the members of each pack on attended positions, 0 on separators."""
    out = ordered_scan(
        packed,
        ["shard", "pack"],
        int_levels(F.col("pack_pos")),
        [F.col("pack_pos")],
        sums={"__seps": (F.col("attention") == 0).cast("long")},
    )
    return out.withColumn("sample", F.when(F.col("attention") == 1, F.col("__seps") + 1).otherwise(0)).drop("__seps")


def sample_ranges(packed: DataFrame, key: str = "person_id") -> DataFrame:
    """``shard, pack, sample, key, from_pos, to_pos``: the attended positions of each member of a pack, first and last."""
    marked = segment_ids(packed).filter("sample > 0")
    return marked.groupBy("shard", "pack", "sample", key).agg(F.min("pack_pos").alias("from_pos"), F.max("pack_pos").alias("to_pos"))


def is_packed(packed: DataFrame) -> DataFrame:
    """``packed`` per pack: an attended position follows a separator, so there is more than one member."""
    first_sep = F.min(F.when(F.col("attention") == 0, F.col("pack_pos")))
    last_on = F.max(F.when(F.col("attention") == 1, F.col("pack_pos")))
    return packed.groupBy("shard", "pack").agg(F.coalesce(last_on > first_sep, F.lit(False)).alias("packed"))
