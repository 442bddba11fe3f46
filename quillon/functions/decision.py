"""Evidence and decisions as column expressions: every signal may be missing and then doesn't count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import vocab
from quillon.functions.vocab import EngineConfig


def mrp_evidence(a: Column, b: Column) -> Column:
    return rounded_evidence(F.round(a), F.round(b))


def rounded_evidence(x: Column, y: Column) -> Column:
    """``mrp_evidence`` of list prices in whole units."""
    gap = F.try_divide(F.abs(x - y), F.greatest(x, y))
    return F.when(x == y, 1.0).when(gap <= 0.02, 0.9).when(gap <= 0.1, 0.55).when(gap <= 0.25, 0.25).when(gap.isNotNull(), 0.0)


def blend(signals: dict[str, Column], scales: dict[str, Column] | None = None) -> Column:
    """(score, coverage): the weighted mean of the signals that are present."""
    weight = {n: F.lit(w) * (scales or {}).get(n, F.lit(1.0)) for n, w in vocab.SIGNAL_WEIGHTS.items() if n in signals}
    total = sum((F.coalesce(signals[n] * w, F.lit(0.0)) for n, w in weight.items()), F.lit(0.0))
    cover = sum((F.when(signals[n].isNotNull(), w).otherwise(0.0) for n, w in weight.items()), F.lit(0.0))
    return F.struct(F.round(F.when(cover > 0, F.try_divide(total, cover)), 4).alias("score"), F.round(cover, 3).alias("coverage"))


def attribute_scale(compared: Column) -> Column:
    """Agreement over fewer than five fields counts for less."""
    return F.least(F.lit(1.0), F.coalesce(compared, F.lit(0)) / 5)


def tier(score: Column, config: EngineConfig = EngineConfig()) -> Column:
    named = F.coalesce(*[F.when(score >= least, F.lit(n)) for n, least in vocab.TIERS], F.lit("PARTIAL MATCH"))
    return F.when(score.isNull() | (score < config.min_score), "NO MATCH").otherwise(named)


def price_verdict(value: Column, least: Column, most: Column) -> Column:
    return F.when(value.isNull(), "na").when((value == least) & (least != most), "best").when((value == most) & (least != most), "low").otherwise("moderate")


def count_verdict(value: Column, least: Column, most: Column, n: Column) -> Column:
    return F.when(value.isNull() | (n < 2), "na").when(least == most, "moderate").when(value == most, "best").when(value == least, "low").otherwise("moderate")


def score_verdict(v: Column) -> Column:
    return F.when(v.isNull(), "na").when(v >= 0.85, "best").when(v >= 0.6, "moderate").otherwise("low")


def attribute_verdict(value: Column, verdict: Column, is_source: Column) -> Column:
    """Of an attribute's cell: how the comparison of its field went; the source itself and what has no value aren't judged."""
    judged = F.when(verdict == "match", "best").when(verdict == "partial", "moderate").when(verdict == "differ", "low").when(verdict == "na", "na").otherwise("moderate")
    return F.when(is_source | value.isNull(), "na").otherwise(judged)


def posture(gap: Column) -> Column:
    return F.when(gap.isNull(), "No competitor data").when(gap > 0, "Undercut").when(gap < 0, "Cheapest").otherwise("Parity")


def rejection(colour_multi: Column, delta_e: Column, image_rejected: Column, colour_agree: Column, colour_conflict: Column, model_conflict: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Why a finalist is out; the first reason counts, and a conflict of colours hides later ones."""
    f = lambda c: F.coalesce(c, F.lit(False))
    unproven = f(colour_conflict) & (F.lit(config.strict) | ~f(delta_e <= config.conflict_proof))
    return (
        F.when(f(colour_multi) & ~f(delta_e <= config.colour_confirm), "color_unproven")
        .when(f(image_rejected) & ~f(colour_agree), "color")
        .when(unproven, "color_family")
        .when(f(colour_conflict), F.lit(None))
        .when(F.lit(config.strict) & f(model_conflict), "model_mismatch")
    )


def strict_rejection(score: Column, mrp_a: Column, mrp_b: Column, proven: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Why the best candidate isn't shown; null if it is."""
    gap = F.try_divide(F.abs(mrp_a - mrp_b), F.greatest(mrp_a, mrp_b))
    most = F.when(F.coalesce(proven, F.lit(False)), config.mrp_tolerance_proven).otherwise(config.mrp_tolerance)
    out = F.when(score.isNull() | (score < config.min_score), "low_confidence")
    return out.when(gap > most, "mrp_mismatch").when(score < config.strict_score, "below_strict_tier") if config.strict else out


def all_or_nothing(brand: Column, gender_ok: Column, garment_ok: Column, mrp_ok: Column, fit_ok: Column, fit_same: Column, pattern_ok: Column,
    pattern_same: Column, title: Column, colour_same: Column) -> Column:
    """(score, ditto) of the older scorer: a candidate is the same product only if every check holds; others keep 0.4 of the score.

    ``garment_ok`` needs both sides known; ``*_same`` and ``colour_same`` are null where a side is unknown."""
    f = lambda c: F.coalesce(c, F.lit(False))
    ditto = (brand >= 0.8) & f(gender_ok) & f(garment_ok) & f(mrp_ok) & f(fit_ok) & f(pattern_ok)
    half = lambda same: F.when(f(same), 1.0).otherwise(0.5)
    hue = F.when(colour_same, 1.0).when(~colour_same, 0.3).otherwise(0.6)
    raw = 0.30 * brand + 0.24 * f(mrp_ok).cast("int") + 0.14 * f(garment_ok).cast("int") + 0.10 * half(fit_same) + 0.08 * half(pattern_same) + 0.08 * title + 0.06 * hue
    return F.struct(F.round(F.when(ditto, raw).otherwise(raw * 0.4), 4).alias("score"), ditto.alias("ditto"))


def cheapest(prices: dict[str, Column]) -> Column:
    """The platform with the least price; ties go to the first, missing prices never win."""
    least = F.least(*prices.values()) if len(prices) > 1 else next(iter(prices.values()))
    return F.coalesce(*[F.when(p == least, F.lit(n)) for n, p in prices.items()])
