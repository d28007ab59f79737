"""Scoring primitives as Spark column expressions. Missing is NULL everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import config as cfg

def null_double() -> Column:
    return F.lit(None).cast("double")


def null_string() -> Column:
    return F.lit(None).cast("string")


def finite(x: Column) -> Column:
    """NaN and the infinities become NULL."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def positive(x: Column) -> Column:
    """max(x, 0) that keeps NULL (Spark's greatest would skip it)."""
    return F.when(x > 0, x).when(x.isNotNull(), F.lit(0.0))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)


def gamma_log(power: Column) -> Column:
    """ln(1 + power in squared microvolts)."""
    return F.log1p(positive(power * F.lit(cfg.GAMMA_SCALE)))


def ratio_log(ratio: Column) -> Column:
    return F.log1p(positive(ratio))


def bounded_gate(x: Column) -> Column:
    return positive(x) / (F.lit(1.0) + positive(x))


def robust_tanh(x: Column, center: float, width: float) -> Column:
    if width <= 0:
        return null_double()
    return F.tanh((x - F.lit(center)) / F.lit(width))


def signed_power(x: Column, power: float | Column) -> Column:
    return F.signum(x) * F.pow(F.abs(x), power if isinstance(power, Column) else F.lit(power))


def asymmetry(left: Column, right: Column, epsilon: float = cfg.EPSILON) -> Column:
    return (left - right) / (left + right + F.lit(epsilon))


def signed_root(a: Column, b: Column) -> Column:
    """Geometric mean of two terms carrying the sign of their sum."""
    return F.signum(a + b) * F.sqrt(F.abs(a * b) + F.lit(1e-9))


def total(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, columns)


def null_sum(columns: list[Column]) -> Column:
    """Sum over the non-missing terms; NULL when every term is missing."""
    some = reduce(lambda x, y: x | y, [c.isNotNull() for c in columns])
    return F.when(some, total([F.coalesce(c, F.lit(0.0)) for c in columns]))


def by_key(key: Column, table: dict, default: Column | None = None) -> Column:
    """Small fixed lookup table as a CASE expression: no join, no shuffle."""
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    if expr is None:
        return null_double() if default is None else default
    return expr if default is None else expr.otherwise(default)


# --- provenance -------------------------------------------------------------------------------

def gated(name: str, mode: str, allow_proxy: bool = False) -> tuple[Column, Column, Column]:
    """Value, provenance and source of a feature as far as the mode admits it."""
    prov = F.col(f"prov_{name}")
    admitted = prov == "direct"
    if allow_proxy and mode == "proxy":
        admitted = prov.isin("direct", "proxy")
    usable = admitted & F.col(name).isNotNull()
    return F.when(usable, F.col(name)), F.when(usable, prov), F.when(usable, F.col(f"source_{name}"))


def merge_provenance(parts: list[Column]) -> Column:
    """NULL or 'unavailable' parts are ignored; one proxy makes the whole a proxy."""
    parts = [F.coalesce(p, F.lit("unavailable")) for p in parts]
    has = lambda word: reduce(lambda x, y: x | y, [p == word for p in parts])
    return F.when(has("proxy"), "proxy").when(has("direct"), "direct").otherwise("unavailable")


def merge_sources(parts: list[Column]) -> Column:
    """Distinct non-empty names in first-seen order, comma separated."""
    cleaned = F.array(*[F.nullif(p, F.lit("")) for p in parts])
    return F.concat_ws(", ", F.array_distinct(F.array_compact(cleaned)))


def merge_sources_text(merged: Column, extra: list[str]) -> Column:
    """Appends fixed names to an already merged source text."""
    return F.concat_ws(", ", F.nullif(merged, F.lit("")), *[F.lit(x) for x in extra])


def accepted(value: Column, prov: Column, mode: str) -> Column:
    allowed = ["direct", "proxy"] if mode == "proxy" else ["direct"]
    return F.when(prov.isin(*allowed), value)


# --- self report ------------------------------------------------------------------------------

def self_report_norm(dataset: Column, value: Column) -> Column:
    """Self-report on 0..1 by the dataset's scale; raw value clipped for unknown datasets."""
    key = F.lower(dataset)
    low = by_key(key, {k: v[0] for k, v in cfg.REPORT_RANGES.items()})
    high = by_key(key, {k: v[1] for k, v in cfg.REPORT_RANGES.items()})
    return clip(F.when(low.isNotNull(), (value - low) / (high - low)).otherwise(value))


def motivation_level(dataset: Column, label: Column, valence: Column, stress: Column) -> tuple[Column, Column]:
    norm = self_report_norm(dataset, valence)
    mapped = by_key(F.lower(label), cfg.MOTIVATION_BY_LABEL)
    level = F.coalesce(norm, mapped, clip(F.lit(1.0) - stress))
    source = (
        F.when(norm.isNotNull(), "valence").when(mapped.isNotNull(), "label").when(stress.isNotNull(), "stress_label")
    )
    return level, source


def stress_level(dataset: Column, label: Column, arousal: Column, stress: Column) -> tuple[Column, Column]:
    norm = self_report_norm(dataset, arousal)
    mapped = by_key(F.lower(label), cfg.STRESS_BY_LABEL)
    level = F.coalesce(clip(stress), norm, mapped)
    source = F.when(stress.isNotNull(), "stress_label").when(norm.isNotNull(), "arousal").when(mapped.isNotNull(), "label")
    return level, source


def level_in_range(level: Column, bounds: tuple[float, float]) -> Column:
    low, high = bounds
    return F.lit(low) + F.lit(high - low) * level


def state_label(dataset: Column, valence: Column, arousal: Column) -> Column:
    """Stress / baseline / disbalance from the valence-arousal corners of the dataset's scale."""
    key = F.lower(dataset)
    low = by_key(key, {k: v[0] for k, v in cfg.STATE_THRESHOLDS.items()})
    high = by_key(key, {k: v[1] for k, v in cfg.STATE_THRESHOLDS.items()})
    return (
        F.when((arousal >= high) & (valence <= low), "stress")
        .when((arousal <= low) & (valence >= high), "baseline")
        .otherwise("disbalance")
    )


def stress_encoding(dataset: Column, label: Column, valence: Column, arousal: Column) -> tuple[Column, Column, Column]:
    """Numeric load of a label, its provenance and its source name."""
    known = by_key(F.lower(F.trim(label)), cfg.LABEL_LOAD)
    derived = by_key(state_label(dataset, valence, arousal), cfg.LABEL_LOAD)
    is_wesad = F.lower(dataset) == "wesad"
    prov = F.when(known.isNotNull() & is_wesad, "direct").otherwise("proxy")
    source = F.when(is_wesad, "dataset_label").otherwise("self_report_label_logic")
    return F.coalesce(known, derived), prov, source


# --- softmax and the structural scalar --------------------------------------------------------

def softmax_terms(logits: list[Column], temperature: Column) -> list[Column]:
    """Unnormalised softmax weights; the temperature multiplies the centred logits.

    The centred logits are never above zero, so only the lower clip bound can bind.
    """
    top = F.greatest(*logits)
    return [F.exp(F.greatest((x - top) * temperature, F.lit(-50.0))) for x in logits]


def softmax_array(logits: Column, temperature: float) -> Column:
    """Softmax of an array column; uniform weights when nothing is defined."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(clip((x - top) * F.lit(float(max(temperature, 1e-6))), -50.0, 50.0)))
    mass = array_sum(weights)
    uniform = F.transform(logits, lambda x: F.lit(1.0) / F.size(logits))
    return F.when(mass > 0, F.transform(weights, lambda w: w / mass)).otherwise(uniform)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    return F.try_divide(array_sum(values), F.size(values))


def fence(df):
    """Evaluates the columns of each row once, as a one-row generator.

    Filters and join conditions on a deep column would otherwise be rewritten in terms of its inputs
    at every level of the projection chain, which grows exponentially; they stop at a generator.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
