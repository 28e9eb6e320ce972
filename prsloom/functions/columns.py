"""Scalar functions as Column expressions: they stay inside generated code."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def or_to_beta(odds: Column) -> Column:
    return F.when(odds > 0, F.ln(odds))


#: Rational approximation of the normal quantile (P. J. Acklam), relative error below 1.2e-9.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425


def _horner(x, coefficients):
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_quantile(p: Column) -> Column:
    """Null outside (0, 1)."""
    tail = F.sqrt(-2 * F.ln(F.when(p < 0.5, p).otherwise(1 - p)))
    outer = _horner(tail, _C) / (_horner(tail, _D) * tail + 1.0)
    q = p - 0.5
    inner = _horner(q * q, _A) * q / (_horner(q * q, _B) * (q * q) + 1.0)
    return F.when((p > 0) & (p < 1), F.when(p < _LOW, outer).when(p > 1 - _LOW, -outer).otherwise(inner))


def normal_quantile_sql(p: str) -> str:
    """The same as SQL text, for engines that have no such function."""

    def horner(x: str, coefficients) -> str:
        total = f"({coefficients[0]!r})"
        for c in coefficients[1:]:
            total = f"({total} * {x} + ({c!r}))"
        return total

    tail = f"sqrt(-2 * ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    outer = f"({horner(tail, _C)} / ({horner(tail, _D)} * {tail} + 1.0))"
    q = f"({p} - 0.5)"
    inner = f"({horner(f'({q} * {q})', _A)} * {q} / ({horner(f'({q} * {q})', _B)} * ({q} * {q}) + 1.0))"
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN {p} < {_LOW} THEN {outer} WHEN {p} > {1 - _LOW!r} THEN -{outer} ELSE {inner} END END"


def se_from_p(beta: Column, p: Column) -> Column:
    """From half the p value, so that tiny ones keep their digits."""
    return F.when((p > 0) & (p < 1) & (beta != 0), F.abs(beta) / -normal_quantile(p / 2))


def standardized_scale(beta: Column, se: Column, n: Column) -> Column:
    return F.sqrt(n * se * se + beta * beta)


def standardize_beta(beta: Column, se: Column, n: Column) -> Column:
    scale = standardized_scale(beta, se, n)
    return F.when(scale > 0, beta / scale).otherwise(0.0)


_CHROMS = {"23": "X", "24": "Y", "25": "XY", "26": "MT", "M": "MT"}


def norm_chrom(chrom: Column) -> Column:
    whole = F.upper(F.trim(chrom))
    bare = F.when(whole.startswith("CHR"), F.substring(whole, 4, 1 << 30)).otherwise(whole)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in _CHROMS.items() for x in pair)), bare), bare)


def complement(allele: Column) -> Column:
    """Reverse complement; null for anything but A, C, G, T."""
    return F.when(allele.rlike("^[ACGT]*$"), F.reverse(F.translate(allele, "ACGT", "TGCA")))


def palindromic(a: Column, b: Column) -> Column:
    return (F.length(a) == 1) & (F.length(b) == 1) & F.concat(a, b).isin("AT", "TA", "CG", "GC")


def n_eff_case_control(cases: Column, controls: Column) -> Column:
    return F.when((cases > 0) & (controls > 0), 4.0 / (1.0 / cases + 1.0 / controls))


def liability_factor(prevalence: float, prop_cases: float | None = None) -> float:
    """What observed-scale heritability is multiplied by."""
    if not 0 < prevalence < 1 or not 0 < (prop_cases if prop_cases is not None else 0.5) < 1:
        raise ValueError("prevalence and prop_cases lie in (0, 1)")
    share = prevalence if prop_cases is None else prop_cases
    height = NormalDist().pdf(NormalDist().inv_cdf(1 - prevalence))
    return (prevalence * (1 - prevalence)) ** 2 / (height**2 * share * (1 - share))


def slab_weight(af: Column, alpha: float) -> Column:
    """Null where the variant does not vary; divide by the mean over the others, and take 1 there."""
    return F.when((af > 0) & (af < 1), F.pow(2 * af * (1 - af), F.lit(1.0 + alpha)))


def frozen_mean(af: Column, flipped: Column) -> Column:
    return 2 * F.when(flipped, 1 - af).otherwise(af)


def recoded(dosage: Column, flip: Column) -> Column:
    """Counts of the other allele; a missing call stays missing."""
    return F.when(flip, F.transform(dosage, lambda g: 2 - g)).otherwise(dosage)
