"""Structural scalar: attention-weighted level of a few terms plus spread and energy boosts.

``staged`` unrolls a fixed list of terms into plain projections, so that scoring a big table stays
in generated code; ``trace`` keeps every intermediate as a column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import total


@dataclass(frozen=True)
class Spec:
    """One scalar to compute: output name and its input columns (double, may be NULL)."""

    out: str
    terms: tuple[str, ...]


def staged(
    df: DataFrame, specs: list[Spec], params: dict[str, Column], *, keep_single: bool = True, null_as_gap: bool = True,
    trace: bool = False,
) -> DataFrame:
    """Adds one column per spec; all specs advance together so the plan stays six projections deep.

    keep_single: a lone finite term is returned unchanged (off for the frame form, where the
    energy boost still applies). null_as_gap=False promises that no term is NULL.
    """
    t = params["temperature"]
    scratch: list[str] = []

    def add(current: DataFrame, columns: dict[str, Column]) -> DataFrame:
        scratch.extend(columns)
        return current.withColumns(columns)

    def present(name: str) -> Column:
        return F.col(name).isNotNull() if null_as_gap else F.lit(True)

    def each(spec: Spec, f) -> list[Column]:
        out = []
        for i, name in enumerate(spec.terms):
            value = f(i, F.col(name))
            out.append(F.when(present(name), value).otherwise(F.lit(0.0)) if null_as_gap else value)
        return out

    step = {}
    for s in specs:
        count = total([present(n).cast("double") for n in s.terms]) if null_as_gap else F.lit(float(len(s.terms)))
        count = F.when(count > 0, count)
        step[f"{s.out}__n"] = count
        step[f"{s.out}__m"] = total(each(s, lambda i, x: x)) / count
    df = add(df, step)

    step = {}
    for s in specs:
        m, n = F.col(f"{s.out}__m"), F.col(f"{s.out}__n")
        step[f"{s.out}__s"] = F.sqrt(total(each(s, lambda i, x: (x - m) * (x - m))) / n)
    df = add(df, step)

    step = {}
    for s in specs:
        m, sd = F.col(f"{s.out}__m"), F.col(f"{s.out}__s")
        for i, name in enumerate(s.terms):
            z = (F.col(name) - m) / (sd + F.lit(1e-6))
            step[f"{s.out}__d{i}"] = F.lit(0.60) * z + F.lit(0.40) * F.abs(z)
    df = add(df, step)

    step = {}
    for s in specs:
        drives = [F.col(f"{s.out}__d{i}") for i in range(len(s.terms))]
        top = F.greatest(*drives) if len(drives) > 1 else drives[0]
        for i, d in enumerate(drives):
            # the centred drive is never above zero, so only the lower clip bound can bind
            weight = F.exp(F.greatest((d - top) * t, F.lit(-50.0)))
            step[f"{s.out}__w{i}"] = F.when(present(s.terms[i]), weight).otherwise(F.lit(0.0)) if null_as_gap else weight
    df = add(df, step)

    step = {}
    for s in specs:
        weights = [F.col(f"{s.out}__w{i}") for i in range(len(s.terms))]
        mass = total(weights)
        mass = F.when(mass > 0, mass)
        step[f"{s.out}__mass"] = mass
        step[f"{s.out}__am"] = total(each(s, lambda i, x: weights[i] * x)) / mass
    df = add(df, step)

    step = {}
    for s in specs:
        am, mass = F.col(f"{s.out}__am"), F.col(f"{s.out}__mass")
        weights = [F.col(f"{s.out}__w{i}") for i in range(len(s.terms))]
        spread = F.sqrt(total(each(s, lambda i, x: weights[i] * (x - am) * (x - am))) / mass)
        energy = F.log1p(total(each(s, lambda i, x: weights[i] * x * x)) / mass)
        # sign of the level, then of the plain sum (mean), then +1
        sign = F.coalesce(F.nullif(F.signum(am), F.lit(0.0)), F.nullif(F.signum(F.col(f"{s.out}__m")), F.lit(0.0)), F.lit(1.0))
        boost = sign * (
            params["structure_weight"] * (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + spread))
            + params["energy_weight"] * (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + energy))
        )
        if trace:
            step |= {
                f"{s.out}_n": F.coalesce(F.col(f"{s.out}__n"), F.lit(0.0)), f"{s.out}_mean": F.col(f"{s.out}__m"), f"{s.out}_std": F.col(f"{s.out}__s"),
                f"{s.out}_level": am, f"{s.out}_spread": spread, f"{s.out}_energy": energy,
                f"{s.out}_sign": F.when(am.isNotNull(), sign), f"{s.out}_boost": boost,
            }
        value = F.when(am.isNotNull(), params["level_weight"] * am + boost)
        if keep_single and null_as_gap:
            value = F.when(F.col(f"{s.out}__n") == 1, F.coalesce(*[F.col(n) for n in s.terms])).otherwise(value)
        step[s.out] = value
    return df.withColumns(step).drop(*scratch)
