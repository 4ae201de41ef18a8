"""Systematic causes: what many differences of a field have in common, found from the values and not from a list of suspects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import FieldRule


def cells(joined: DataFrame, rules: list[FieldRule]) -> DataFrame:
    """(field, expected, actual): every compared field of the rows that match one to one, as normalised text, equal ones too."""
    one = joined.where("sn = 1 and tn = 1")
    return one.select(F.inline(F.array(*[F.struct(F.lit(r.column).alias("field"), F.col(f"s.f{i}").cast("string").alias("expected"), F.col(f"t.f{i}").cast("string").alias("actual")) for i, r in enumerate(rules)])))


def _ratio(e: Column, a: Column) -> Column:
    """How many times the actual value is the expected one, to six digits; null where that says nothing."""
    x, y = e.try_cast("double"), a.try_cast("double")
    digits = F.lit(5) - F.floor(F.log10(F.abs(y / x))).cast("int")
    scaled = F.round(y / x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    return F.when((x != 0) & (y != 0) & (F.abs(x) != F.abs(y)), F.regexp_replace(scaled.cast("decimal(38,6)").cast("string"), r"\.?0+$", ""))


def _shift(e: Column, a: Column) -> Column:
    """Seconds by which the actual time is later; null where one of them is no time of day."""
    clock = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"
    both = e.rlike(clock) & a.rlike(clock)
    return F.when(both, F.unix_timestamp(a.try_cast("timestamp")) - F.unix_timestamp(e.try_cast("timestamp")))


def systematic_causes(compared: DataFrame, min_support: int = 10, min_share: float = 0.5, min_confidence: float = 0.9) -> DataFrame:
    """(field, cause, detail, support, share, confidence) of ``compared(field, expected, actual)``.

    Every differing cell votes for what it can be evidence of, and one aggregation counts the votes:

    * ``value_map``: this value became that one. confidence: of all cells with the expected value, equal ones included, the part
      that has this actual value. Values are reported one by one.
    * ``unit_scale``: the actual value is the expected one times ``detail``.
    * ``time_zone``: the actual time is later by a whole number of quarter hours up to 14 hours, ``detail`` as in +08:00;
      ``time_shift``: by any other constant number of seconds.

    share: the part of the field's differences; for scales and times confidence is the same. Of these a cause needs ``min_share``,
    of a value map ``min_confidence``; ``min_support`` cells at least stand behind each.
    """
    e, a = F.col("expected"), F.col("actual")
    shift = _shift(e, a)
    zone = (shift % 900 == 0) & (F.abs(shift) <= 14 * 3600)
    clock = F.concat(F.when(shift < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(shift) / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(F.abs(shift) / 60) % 60).cast("string"), 2, "0"))
    vote = lambda cause, detail: F.struct(F.lit(cause).alias("cause"), detail.cast("string").alias("detail"))
    votes = F.array(vote("value_map", F.concat(e, F.lit("=>"), a)), vote("unit_scale", _ratio(e, a)), vote("time_zone", F.when(zone, clock)), vote("time_shift", F.when(~zone, shift)))
    counts = compared.groupBy("field", "expected", "actual").agg(F.count("*").alias("n"))
    differing = counts.where(~e.eqNullSafe(a))
    totals = differing.groupBy("field").agg(F.sum("n").alias("_all"))
    cast = differing.select("field", F.when(e.isNotNull(), e).alias("expected"), "n", F.explode(F.filter(votes, lambda v: v["detail"].isNotNull())).alias("v")).select("field", "v.cause", "v.detail", "expected", "n")
    tallied = cast.groupBy("field", "cause", "detail", F.when(F.col("cause") == "value_map", F.col("expected")).alias("_e")).agg(F.sum("n").alias("support")).where(F.col("support") >= min_support)
    held = counts.groupBy("field", F.col("expected").alias("_e")).agg(F.sum("n").alias("_held"))
    rated = tallied.join(F.broadcast(totals), "field").join(held, ["field", "_e"], "left")
    share = F.col("support") / F.col("_all")
    rated = rated.withColumn("share", F.round(share, 4)).withColumn("confidence", F.round(F.when(F.col("cause") == "value_map", F.col("support") / F.col("_held")).otherwise(share), 4))
    fit = F.when(F.col("cause") == "value_map", F.col("confidence") >= min_confidence).otherwise(F.col("share") >= min_share)
    return rated.where(fit).select("field", "cause", "detail", "support", "share", "confidence")
