"""Column-to-column functions. Everything here stays inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .noise import let

MAX_DOUBLE = 1.7976931348623157e308
NONE_SENTINEL = "__none__"


# transaction projections ------------------------------------------------------------

def series_key(account, name) -> Column:
    """account + '_' + recipient; null when either is null."""
    return F.concat(F.col(account).cast("string"), F.lit("_"), F.col(name).cast("string"))


def year_month(date) -> Column:
    return F.date_format(date, "yyyy-MM")


def day_of_week(date) -> Column:
    """Monday = 0."""
    return F.weekday(date)


def is_card_mobile(method, channel) -> Column:
    return F.when((F.col(method) == "CARD") & (F.col(channel) == "MOBILE_APP"), 1).otherwise(0)


def anomaly_label(description) -> Column:
    return F.col(description).isNotNull().cast("int")


def anomaly_type(description) -> Column:
    return F.substring_index(F.col(description), ":", 1)


def clip_range(value: Column, low: float, high: float) -> Column:
    """Clamp; null and NaN pass through."""
    return F.when(F.isnan(value), value).otherwise(
        F.when(value < low, F.lit(float(low))).when(value > high, F.lit(float(high))).otherwise(value)
    )


def nan_to_num(value: Column) -> Column:
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(0.0))
        .when(value == float("inf"), F.lit(MAX_DOUBLE))
        .when(value == float("-inf"), F.lit(-MAX_DOUBLE))
        .otherwise(value)
    )


def business_day_roll(date: Column) -> Column:
    """Saturday and Sunday move to the Monday after."""
    return F.when(F.weekday(date) >= 5, F.date_add(date, F.lit(7) - F.weekday(date))).otherwise(date)


NOTE_PATTERN = r"INV-(\d{4})-(\d{2})-(\d+) \(Term (\d+)d\)"


def invoice_note_parse(note) -> dict[str, Column]:
    """year, month, counter and term of an invoice note; null where the note has none."""
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(note, NOTE_PATTERN, i), F.lit("")).cast("int")

    return {"inv_year": part(1), "inv_month": part(2), "inv_counter": part(3), "inv_term": part(4)}


def dataset_display_name(name) -> Column:
    c = F.col(name)
    words = F.regexp_replace(F.replace(c, F.lit(".npz"), F.lit("")), "_", " ")
    # title case: a capital after every non-letter
    runs = F.regexp_extract_all(words, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    plain = F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")
    return (
        F.when(F.lower(c).contains("campaign"), "Campaign Dataset")
        .when(F.lower(c).contains("business"), "Business Dataset")
        .otherwise(plain)
    )


def unpack_none(col) -> Column:
    return F.nullif(F.col(col), F.lit(NONE_SENTINEL))


def pack_none(col) -> Column:
    return F.coalesce(F.col(col), F.lit(NONE_SENTINEL))


# time grids and schedules -----------------------------------------------------------

def time_grid(n_t, start=0.0) -> Column:
    """array: n_t equally spaced levels from start to 1."""
    n = n_t if isinstance(n_t, Column) else F.lit(n_t)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.lit(start) + F.lit(1.0 - start) * i.cast("double") / (n - 1).cast("double"),
    )


def grid_levels(n_t: int, start: float) -> list[float]:
    """The same grid as Python numbers, for plans that are unrolled by level."""
    return [start + (1.0 - start) * i / (n_t - 1) for i in range(n_t)]


def time_embedding(t: Column, dim: int, max_period: float = 10000.0) -> Column:
    """sin and cos of t at dim/2 geometric frequencies."""
    half = dim // 2

    def angles(fn):
        return F.transform(
            F.sequence(F.lit(0), F.lit(half - 1)),
            lambda i: fn(t * F.exp(F.lit(-math.log(max_period)) * i.cast("double") / F.lit(float(half)))),
        )

    return F.concat(angles(F.sin), angles(F.cos))


def vp_log_mean(t: Column, b0: float = 0.1, b1: float = 8.0) -> Column:
    return F.lit(-0.25) * t * t * F.lit(b1 - b0) - F.lit(0.5) * t * F.lit(b0)


def vp_mean(t: Column, b0: float = 0.1, b1: float = 8.0) -> Column:
    return F.exp(vp_log_mean(t, b0, b1))


def vp_std(t: Column, b0: float = 0.1, b1: float = 8.0) -> Column:
    return F.sqrt(F.lit(1.0) - F.exp(F.lit(2.0) * vp_log_mean(t, b0, b1)))


def vp_beta(t: Column, b0: float = 0.1, b1: float = 8.0) -> Column:
    return F.lit(b0) + t * F.lit(b1 - b0)


def vp_drift(x: Column, t: Column, b0: float = 0.1, b1: float = 8.0) -> Column:
    return F.lit(-0.5) * vp_beta(t, b0, b1) * x


def vp_diffusion(t: Column, b0: float = 0.1, b1: float = 8.0) -> Column:
    return F.sqrt(vp_beta(t, b0, b1))


def vp_coefficients(t: float, b0: float, b1: float) -> tuple[float, float]:
    """Mean coefficient and standard deviation at a level known when planning."""
    log_mean = -0.25 * t * t * (b1 - b0) - 0.5 * t * b0
    return math.exp(log_mean), math.sqrt(1.0 - math.exp(2.0 * log_mean))


# paths between noise and data -------------------------------------------------------

def flow_interpolate(x1: Column, x0: Column, t: Column) -> Column:
    return F.zip_with(x1, x0, lambda a, b: t * a + (F.lit(1.0) - t) * b)


def flow_target(x1: Column, x0: Column) -> Column:
    return F.zip_with(x1, x0, lambda a, b: a - b)


def vp_perturb(x1: Column, x0: Column, t: Column, b0: float = 0.1, b1: float = 8.0) -> Column:
    return F.zip_with(x1, x0, lambda a, b: vp_mean(t, b0, b1) * a + vp_std(t, b0, b1) * b)


def contraction_path(x: Column, t: Column) -> Column:
    return F.transform(x, lambda a: (F.lit(1.0) - t) * a)


# classification ---------------------------------------------------------------------

def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def binary_label(probability: Column) -> Column:
    """Half-even rounding: 0.5 is class 0."""
    return F.rint(probability).cast("long")


def softmax(values: Column) -> Column:
    powers = let(values, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return let(powers, lambda e: let(
        F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda all_: F.transform(e, lambda x: x / all_)))


def argmax(values: Column) -> Column:
    """First position of the largest value, from 0."""
    return let(values, lambda v: F.array_position(v, F.array_max(v)) - 1)
