"""Rubric scoring: rules as data, hits, dimension scores, caps and the overall.

Rules are a tuple of (rule, dimension, polarity, weight, pattern). A text's hits
are one array built in one projection, so a table is read once, whatever the
number of rules; nothing is exploded. Long rule lists are put together from
arrays of thirty, which keeps generated methods within the JVM's limits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import banded
from tessera.operators.rubric_rules import APPLIES, CAPS, DIMENSION_WEIGHTS, MOST_POSITIVE, RULES

#: What a rule needs besides its own match, as (rule, another, whether that must be there).
PROVISOS = (("STR-N09", "STR-P09", False), ("SQL-N04", "SQL-P03", False))
MULTILINE = "(?md)"


def _matches(code: Column, plain: Column, pattern: str) -> Column:
    return code.rlike(MULTILINE + pattern) | plain.rlike(MULTILINE + pattern)


def rule_hits(code: Column, rules: Iterable[tuple] = RULES, cache_writes: str = r"wp_cache_set\s*\(", suppressed: dict[str, Column] | None = None) -> Column:
    """The rules that a text meets, as it is or with all quotes single, after the provisos. suppressed: rule to a condition under which it does not count."""
    plain = F.replace(code, F.lit('"'), F.lit("'"))
    hits = [F.when(_matches(code, plain, pattern) & ~(suppressed or {}).get(rule, F.lit(False)), rule) for rule, _, _, _, pattern in rules]
    raw = F.flatten(F.array(*(F.array_compact(F.array(*hits[k : k + 30])) for k in range(0, len(hits), 30)))) if hits else F.array().cast("array<string>")
    out = raw
    for rule, other, needed in PROVISOS:
        drop = F.array_contains(raw, other) != F.lit(needed)
        out = F.when(drop, F.array_remove(out, rule)).otherwise(out)
    return F.when(code.rlike(cache_writes), out).otherwise(F.array_remove(out, "PERF-P01"))


def evidence(code: Column, pattern: str, most: int = 5, length: int = 100) -> Column:
    """The first matches of a rule."""
    return F.transform(F.slice(F.regexp_extract_all(code, F.lit(MULTILINE + f"(?:{pattern})"), F.lit(0)), 1, most), lambda m: F.substring(m, 1, length))


def tool_hits(found: DataFrame, units: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """Key, rule and hit from a tool's findings (key, code) by mapping (code, rule, when_absent): a finding is a hit, or, for rules that hold where nothing is found, the want of one is."""
    seen = found.join(mapping, "code").select(key, "rule").distinct().withColumn("found", F.lit(True))
    every = units.select(key).crossJoin(F.broadcast(mapping.select("rule", "when_absent").distinct()))
    return every.join(seen, [key, "rule"], "left").select(key, "rule", F.when(F.col("when_absent"), F.col("found").isNull()).otherwise(F.col("found").isNotNull()).alias("hit"))


def merged_hits(*by_precedence: Column) -> Column:
    """Maps of rule to hit, the earlier prevailing: later tools add rules and override none."""
    out = by_precedence[0]
    for m in by_precedence[1:]:
        out = F.map_concat(out, _without_keys(m, F.map_keys(out)))
    return out


def _without_keys(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.array_contains(keys, k))


def inapplicable(code: Column, applies: dict[str, str] = APPLIES) -> Column:
    """Dimensions that the text gives nothing to judge by."""
    return F.array_compact(F.array(*(F.when(~code.rlike(f"(?i){MULTILINE}{p}"), d) for d, p in applies.items())))


def dimension_scores(hits: Column, na: Column, rules: Iterable[tuple] = RULES, most_positive: dict[str, int] = MOST_POSITIVE, caps: tuple = CAPS) -> dict[str, Column]:
    """From 10, less 3 times a negative hit's share of the evaluated negative weights, not under the positives' floor, within 0 and 10, capped; null where inapplicable."""
    rules, out = list(rules), {}
    for dim, full in most_positive.items():
        own = [(r, p, w) for r, d, p, w, _ in rules if d == dim]
        negative = [(r, w) for r, p, w in own if p == "negative"]
        total = sum(w for _, w in negative)
        score, gained = F.lit(10.0), F.lit(0.0)
        for r, w in negative:
            score = score - F.when(F.array_contains(hits, r), 3.0 * w / max(total, w)).otherwise(0.0)
        for r, p, w in own:
            if p == "positive":
                gained = gained + F.when(F.array_contains(hits, r), float(w)).otherwise(0.0)
        score = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.greatest(score, gained / full * 8.0)))
        for d, cap, triggers in caps:
            if d == dim:
                score = F.when(F.arrays_overlap(hits, F.array(*map(F.lit, triggers))), F.least(score, F.lit(cap))).otherwise(score)
        out[dim] = F.when(~F.array_contains(na, dim), score)
    return out


def overall(scores: dict[str, Column], weights: dict[str, float] = DIMENSION_WEIGHTS) -> Column:
    """The mean by weights over what applies, times ten, to one digit; 0 where nothing does."""
    weight = sum((F.when(s.isNotNull(), weights[d]).otherwise(0.0) for d, s in scores.items()), F.lit(0.0))
    total = sum((F.coalesce(s, F.lit(0.0)) * weights[d] for d, s in scores.items()), F.lit(0.0))
    return F.when(weight == 0, 0.0).otherwise(F.round(total / weight * 10, 1))


def scored(df: DataFrame, key: str, code: str, rules: Iterable[tuple] = RULES) -> DataFrame:
    """Key, hits, na, a column for each dimension, overall and grade."""
    rules = list(rules)
    rows = df.select(key, rule_hits(F.col(code), rules).alias("hits"), inapplicable(F.col(code)).alias("na"))
    dims = dimension_scores(F.col("hits"), F.col("na"), rules)
    rows = rows.select("*", *(c.alias(d) for d, c in dims.items()))
    rows = rows.withColumn("overall", overall({d: F.col(d) for d in dims}))
    return rows.withColumn("grade", banded(F.col("overall")))


def features(hits: Column, rules: Iterable[tuple] = RULES) -> list[Column]:
    """A 0/1 column for each rule."""
    return [F.array_contains(hits, r[0]).cast("int").alias(r[0]) for r in rules]


def folded_scores(text: Column, rules: list[tuple], dims: dict[str, float], least: float = 1.0, most: float | None = 10.0) -> dict[str, Column]:
    """C14: heuristic judges as data. rules: (dimension, pattern, absent pattern or "", delta, set_to or None), in order; dims: start values.

    A rule holds where its pattern is found and its absent pattern is not; set_to
    overrides the score so far, later rules go on from there, and the clamp is last.
    """
    out = {}
    for d, start in dims.items():
        score = F.lit(float(start))
        for dim, pattern, absent, delta, set_to in rules:
            if dim == d:
                hit = text.rlike(pattern) & (~text.rlike(absent) if absent else F.lit(True))
                score = F.when(hit, F.lit(float(set_to)) if set_to is not None else score + delta).otherwise(score)
        score = F.greatest(F.lit(least), score)
        out[d] = F.least(F.lit(most), score) if most is not None else score
    return out


def judged(scores: dict[str, Column], failures: Column, critical: Column, na_score: float = 7.0, na_exempt: tuple[str, ...] = (), policy: str = "any", least: float = 8.0, bypass: Column | None = None) -> Column:
    """C14: the verdict under a policy: any failure forces FAIL, only critical ones do, or none does. na_exempt: dimensions that may stand at na_score."""
    low = F.lit(False)
    for d, s in scores.items():
        bad = s < least
        low = low | (bad & (s != na_score) if d in na_exempt else bad)
    forced = {"any": F.size(failures) > 0, "critical": critical, "none": F.lit(False)}[policy]
    out = F.when(low | forced, "FAIL").otherwise("PASS")
    return out if bypass is None else F.when(bypass, "PASS").otherwise(out)
