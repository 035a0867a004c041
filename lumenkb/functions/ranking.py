"""Ranking arithmetic: fusion, decay, reinforcement. Constants are the engine's published defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
#: Score factors (fixed values): weaker query tier, inactive note, graph boost, expansion outwards and inwards, global scope.
ANY_TOKENS, INACTIVE, BOOST, OUTWARD, INWARD, GLOBAL = 0.55, 0.2, 0.25, 0.50, 0.35, 0.7
DAY = 86_400
#: Half life in days and floor of the decay by level (fixed values).
DECAY = {"L0Ephemeral": (60.0, 0.50), "L2Log": (180.0, 0.70)}
STALE, REINFORCE, REINFORCE_DAYS = 0.45, 0.15, 30.0
PLAUSIBLE_SINCE = 946_684_800


def decay(level: Column, stamp: Column, now: Column, stale: Column) -> Column:
    """1 for lasting levels, else falling with age to a floor; implausible stamps don't age; stale notes are cut."""
    age = F.greatest((now - stamp) / DAY, F.lit(0.0))
    plausible = (stamp >= PLAUSIBLE_SINCE) & (stamp <= now + DAY)
    factor = F.lit(1.0)
    for name, (half, floor) in DECAY.items():
        factor = F.when(level == name, floor + (1 - floor) * F.pow(F.lit(2.0), -age / half)).otherwise(factor)
    return F.when(plausible, factor).otherwise(1.0) * F.when(stale, STALE).otherwise(1.0)


def reinforcement(count: Column, last: Column, now: Column) -> Column:
    age = F.greatest((now - last) / DAY, F.lit(0.0))
    gain = F.least(F.lit(1.0), F.log2(1.0 + count) / 4) * F.pow(F.lit(2.0), -age / REINFORCE_DAYS)
    return F.least(F.lit(1.0 + REINFORCE), F.greatest(F.lit(1.0), 1.0 + REINFORCE * gain))


def rrf(bm25_rank: Column, vector_rank: Column, bm25_weight: Column, vector_weight: Column, tier: Column) -> Column:
    one = lambda w, r: F.coalesce(w / (RRF_K + r), F.lit(0.0))
    return one(bm25_weight * tier, bm25_rank) + one(vector_weight, vector_rank)
