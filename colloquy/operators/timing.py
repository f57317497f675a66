"""Reply durations of dialog turns: rows of (dialog_id, turn_idx, role, duration, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import metric, non_negative, side


def turn_duration(seconds: list[Column], milliseconds: Column | None = None, nested: Column | None = None) -> Column:
    """First non-negative of the second fields, the millisecond field and the nested response's."""
    found = [non_negative(metric(c)) for c in seconds]
    if milliseconds is not None:
        found.append(non_negative(metric(milliseconds)) / 1000.0)
    if nested is not None:
        found.append(nested)
    return F.coalesce(*found)


def infer_durations(turns: DataFrame, dialog: str = "dialog_id", order: str = "turn_idx") -> DataFrame:
    """Missing durations become the time since the previous turn if it isn't negative, rounded to 4 places.

    Times are compared in whole microseconds, and ties go to the even side, so results don't depend
    on how far from zero the clock stands.
    """
    micros = _micros(F.col("ts"))
    gap = micros - F.lag(micros).over(Window.partitionBy(dialog).orderBy(order))
    return turns.withColumn("duration", F.coalesce("duration", F.when(gap >= 0, F.bround(gap, -2) / 1_000_000)))


def _micros(seconds: Column) -> Column:
    return F.round(seconds * 1_000_000).cast("long")


def _known(dialog) -> Column:
    """Sum of the known durations, in whole microseconds, so that their order doesn't matter."""
    return F.coalesce(F.sum(_micros(F.col("duration"))).over(dialog), F.lit(0).cast("long"))


def _share(micros: Column, among: Column) -> Column:
    """An even share in seconds, rounded to 4 places; in whole numbers, ties to the even side."""
    unit = 100 * F.nullif(among, F.lit(0))
    whole, rest = F.floor(micros / unit), 2 * (micros % unit)
    up = (rest > unit) | ((rest == unit) & (whole % 2 == 1))
    return (whole + up.cast("long")) / 10_000


def share_wall(turns: DataFrame, dialog: str = "dialog_id", wall: str = "wall") -> DataFrame:
    """Turns without a duration share what the known ones leave of the dialog's wall time; nothing if none is left."""
    w = Window.partitionBy(dialog)
    missing = F.count_if(F.col("duration").isNull()).over(w)
    budget = _micros(F.col(wall)) - _known(w)
    return turns.withColumn("duration", F.coalesce("duration", F.when(budget > 0, _share(budget, missing))))


def backfill(turns: DataFrame, total: str, dialog: str = "dialog_id") -> DataFrame:
    """As ``share_wall`` for user and assistant turns only, which get 0 if nothing is left."""
    w = Window.partitionBy(dialog)
    spoken = side(F.lower("role")).isNotNull()
    missing = F.count_if(F.col("duration").isNull() & spoken).over(w)
    budget = F.greatest(F.lit(0), _micros(F.col(total)) - _known(w))
    return turns.withColumn("duration", F.coalesce("duration", F.when(spoken & F.col(total).isNotNull(), _share(budget, missing))))


def dialog_times(turns: DataFrame, dialog: str = "dialog_id") -> DataFrame:
    """Per dialog: mean reply time of the assistant's and the user's side, and the known total."""
    s = side(F.lower(F.trim("role")))
    return turns.groupBy(dialog).agg(F.avg(F.when(s == "assistant", F.col("duration"))).alias("avg_assistant"), F.avg(F.when(s == "user", F.col("duration"))).alias("avg_user"), F.sum("duration").alias("known_total"))


def mean_times(dialogs: DataFrame) -> DataFrame:
    """Means over dialogs of their means."""
    return dialogs.agg(F.avg("avg_assistant").alias("mean_assistant"), F.avg("avg_user").alias("mean_user"), F.avg("known_total").alias("mean_duration"))


def enrich(turns: DataFrame, wall: str = "wall") -> DataFrame:
    """Durations from time stamps, then from the wall time; running it again changes nothing."""
    return share_wall(infer_durations(turns), wall=wall)
