"""Scalar cleaning rules, each a ``Column -> Column`` over native functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    AMOUNT_THRESHOLDS,
    EPSILON_BIN,
    INDUSTRY_RANGES,
    POSITIVE_LABELS,
    SECONDS_PER_YEAR,
)


def amount_feature(x: Column) -> Column:
    """``"$1,234.50"`` -> 1234.5; text that is no number raises."""
    return F.regexp_replace(x, "[$,]", "").cast("double")


def amount_number(x: Column, strip: str = "$,") -> Column:
    """Amount for tokens. ``strip`` names the characters to drop; unparsable -> null."""
    return F.translate(x.cast("string"), strip, "").try_cast("double")


def amount_bucket(x: Column, thresholds=AMOUNT_THRESHOLDS) -> Column:
    """Number of thresholds at or below ``x``; null and negative amounts give 0."""
    hits = [F.when(x >= F.lit(float(t)), 1).otherwise(0) for t in thresholds]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total.cast("int")


def merchant(x: Column) -> Column:
    return F.regexp_replace(F.upper(x.cast("string")), r"[^A-Z0-9\s\-]", "")


def merchant_cjk(x: Column) -> Column:
    return F.regexp_replace(F.upper(x.cast("string")), r"[^A-Z0-9一-鿿\s\-/]", "")


def institution(x: Column) -> Column:
    return F.trim(F.upper(x.cast("string")))


def hash_bucket(x: Column, buckets: int, hash: str = "xxhash64") -> Column:
    """Non-negative bucket of a value; null goes to bucket 0.

    ``xxhash64`` stays in generated code and is the default. ``md5`` gives
    buckets that other engines can reproduce.
    """
    if hash == "md5":
        h = F.conv(F.substring(F.md5(x.cast("string")), 1, 8), 16, 10).cast("bigint")
    elif hash == "xxhash64":
        h = F.xxhash64(x)
    else:
        raise ValueError(f"unknown hash {hash!r}")
    return F.when(x.isNull(), 0).otherwise(F.pmod(h, F.lit(buckets))).cast("int")


def mcc_int(x: Column) -> Column:
    return F.coalesce(x.cast("int"), F.lit(-1))


def date_from_parts(y: Column, m: Column, d: Column) -> Column:
    """Calendar date, null when the parts name no day."""
    return F.try_make_timestamp_ntz(
        y.cast("int"), m.cast("int"), d.cast("int"), F.lit(0), F.lit(0), F.lit(0)
    ).cast("date")


def timestamp_from_parts(y: Column, m: Column, d: Column, hhmm: Column) -> Column:
    """Time of a card row. Month and day are clipped, a missing time is midnight;
    an impossible date or a time not in ``H:M`` form gives null."""
    t = F.coalesce(hhmm, F.lit("00:00"))
    part = lambda i: F.substring_index(t, ":", i).try_cast("int")
    yr = F.coalesce(y.cast("int"), F.lit(0))
    stamp = F.try_make_timestamp_ntz(
        yr,
        clip(F.coalesce(m.cast("int"), F.lit(1)), 1, 12),
        clip(F.coalesce(d.cast("int"), F.lit(1)), 1, 31),
        part(1),
        part(-1),
        F.lit(0),
    )
    return F.when(t.rlike(r"^\d{1,2}:\d{1,2}$") & (part(1) < 24) & (part(-1) < 60) & yr.between(1000, 9999), stamp)


def hour_of(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(0))


def weekday_of(ts: Column) -> Column:
    """Monday is 0; null gives 0."""
    return F.coalesce(F.weekday(ts), F.lit(0))


def month_of(ts: Column) -> Column:
    return F.coalesce(F.month(ts), F.lit(1))


def weekday_from_parts(y: Column, m: Column, d: Column) -> Column:
    return F.coalesce(F.weekday(date_from_parts(y, m, d)), F.lit(0))


def day_quarter(h: Column, mi: Column, s: Column) -> Column:
    secs = (
        F.least(h.cast("int"), F.lit(24)) * 3600
        + F.least(mi.cast("int"), F.lit(60)) * 60
        + F.least(s.cast("int"), F.lit(60))
    )
    return (
        F.when(secs < 6 * 3600, 0).when(secs < 12 * 3600, 1).when(secs < 18 * 3600, 2).otherwise(3)
    )


def zip3(x: Column) -> Column:
    """First three characters of the code, taken before zero filling."""
    z = F.replace(F.coalesce(x.cast("string"), F.lit("00000")), F.lit(".0"), F.lit(""))
    return F.lpad(F.substring(z, 1, 3), 3, "0").try_cast("int")


def state(x: Column) -> Column:
    s = F.trim(F.upper(x.cast("string")))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("XX"))


def clip(x: Column, lo: int, hi: int) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def format_token(prefix: str, value: Column, width: int = 0) -> Column:
    """``PREFIX_007``; wide numbers are never cut (``lpad`` alone would cut them)."""
    text = value.cast("string")
    if width:
        text = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return F.concat(F.lit(prefix + "_"), text)


def digitize(x: Column, edges: list[float], bins: int | None = None) -> Column:
    """Ordinal bin of ``x``: edges after the first that are <= x, kept below ``bins``."""
    bins = bins or len(edges) - 1
    inner = [float(e) for e in edges[1:]]
    v = x.cast("double") + F.lit(EPSILON_BIN)
    if len(inner) <= 64:
        idx = F.lit(0)
        for e in inner:
            idx = idx + F.when(v >= F.lit(e), 1).otherwise(0)
    else:
        idx = F.size(F.filter(F.lit(inner), lambda e: e <= v))
    return F.when(x.isNull() | F.isnan(x.cast("double")), 0).otherwise(F.least(idx, F.lit(bins - 1))).cast("int")


def log_time_bucket(seconds: Column, bins: int = 32, max_years: float = 10.0) -> Column:
    """Equal steps of ``ln(seconds + 1)``; zero seconds is bucket 1, bucket 0 stays empty."""
    horizon = int(max_years * SECONDS_PER_YEAR)
    top = math.log(float(horizon) + 1.0)
    s = F.greatest(F.least(seconds.cast("double"), F.lit(float(horizon))), F.lit(0.0))
    b = F.width_bucket(F.log(s + 1.0), F.lit(0.0), F.lit(top), F.lit(bins))
    return F.coalesce(F.least(b, F.lit(bins - 1)), F.lit(bins - 1)).cast("int")


def range_label(v: Column, default: Column | None = None, display: bool = False) -> Column:
    """Industry of a merchant code; where ranges overlap the later one wins."""
    expr = F.lit("GENERAL") if default is None else default
    for lo, hi, label, shown in INDUSTRY_RANGES:
        expr = F.when(v.between(lo, hi), F.lit(shown if display else label)).otherwise(expr)
    return expr


def mcc_display(v: Column) -> Column:
    code = v.cast("int")
    label = range_label(code, F.lit(None).cast("string"), display=True)
    return F.coalesce(F.concat(label, F.lit(" ("), code.cast("string"), F.lit(")")), code.cast("string"))


def target(x: Column) -> Column:
    return F.coalesce(x.isin(*POSITIVE_LABELS), F.lit(False)).cast("int")


def yes_flag(x: Column) -> Column:
    """The looser label of the split report: any spelling of yes, nothing else."""
    return F.coalesce(F.lower(x.cast("string")) == "yes", F.lit(False)).cast("int")
