"""Mutations that put a known defect into code, and their fan-out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns whose first match goes, in order of trial.
NONCE = (r"if\s*\(\s*!\s*wp_verify_nonce\s*\(.*?\)\s*\)\s*\{[^}]*\}\s*", r"if\s*\(\s*!\s*isset\s*\(\s*\$_POST\[.+?\]\s*\)\s*\|\|\s*!\s*wp_verify_nonce.*?\{[^}]*\}\s*", r"check_ajax_referer\s*\([^)]+\)\s*;\s*", r"wp_verify_nonce\s*\([^)]+\)\s*;\s*")
CAPABILITY = (r"if\s*\(\s*!\s*current_user_can\s*\(.*?\)\s*\)\s*\{[^}]*\}\s*",)
ESCAPING = ("esc_html", "esc_attr", "esc_url", "esc_textarea", "wp_kses_post", "wp_kses")
SANITIZING = ("sanitize_text_field", "sanitize_email", "sanitize_title", "sanitize_file_name", "sanitize_key", "absint", "intval", "wp_kses", "wp_kses_post")
TRANSLATION = ((r"esc_html__\(\s*'([^']+)'\s*,\s*'[^']+'\s*\)", "'$1'"), (r"esc_html_e\(\s*'([^']+)'\s*,\s*'[^']+'\s*\)", "echo '$1'"), (r"esc_attr__\(\s*'([^']+)'\s*,\s*'[^']+'\s*\)", "'$1'"), (r"__\(\s*'([^']+)'\s*,\s*'[^']+'\s*\)", "'$1'"), (r"_e\(\s*'([^']+)'\s*,\s*'[^']+'\s*\)", "echo '$1'"))
SELECT_LIST = r"(SELECT\s+)(\w+(?:\.\w+)?(?:\s*,\s*\w+(?:\.\w+)?)+)(\s+FROM)"
PREPARED = re.compile(r"\$wpdb->prepare\(\s*([\"'])(.*?)\1\s*,\s*(.*?)\)", re.DOTALL)


def replace_first(c: Column, pattern: str, replacement: str) -> Column:
    """regexp_replace of the first match only: what is left of it is matched with it."""
    groups = re.compile(pattern.replace("(?U)", "")).groups
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", replacement)
    return F.regexp_replace(c, rf"(?s)\A(.*?){_scoped(pattern)}(.*)\z", f"$1{shifted}${groups + 2}")


def _scoped(pattern: str) -> str:
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    return f"(?{flags[1]}:{pattern[flags.end() :]})" if flags else f"(?:{pattern})"


def _drop_first(c: Column, patterns: tuple[str, ...]) -> Column:
    out = None
    for p in patterns:
        hit = c.rlike(f"(?s){p}")
        out = F.when(hit, replace_first(c, p, "")) if out is None else out.when(hit, replace_first(c, p, ""))
    return out


def _unwrap(c: Column, names: tuple[str, ...]) -> Column:
    out = c
    for n in names:
        out = F.regexp_replace(out, rf"{n}\s*\(\s*([^)]+)\s*\)", "$1")
    return F.when(c.rlike("|".join(rf"{n}\s*\(\s*[^)]+\s*\)" for n in names)), out)


def _translated(c: Column) -> Column:
    out = c
    for p, r in TRANSLATION:
        out = F.regexp_replace(out, p, r)
    return F.when(out != c, out)


def _inlined(c: Column) -> Column:
    """Each placeholder takes the next variable in turn, which one regular expression cannot count."""

    def one(c: str | None) -> str | None:
        if c is None or not (m := PREPARED.search(c)):
            return None
        names = iter([v.strip() for v in m[3].split(",")])
        query = re.sub(r"%[sdf]", lambda p: f"' . {v} . '" if (v := next(names, None)) is not None else p[0], m[2])
        return f'{c[: m.start()]}"{query}"{c[m.end() :]}'

    def many(code: pd.Series) -> pd.Series:
        return code.map(one)

    return F.pandas_udf(many, "string")(c)


#: Name, what it does to a column (null where it does not apply), and what is said of it.
MUTATIONS = (
    ("sql_injection", _inlined, "values concatenated into SQL instead of prepared"),
    ("csrf", lambda c: _drop_first(c, NONCE), "nonce verification removed"),
    ("xss", lambda c: _unwrap(c, ESCAPING), "output escaping removed"),
    ("authorization", lambda c: _drop_first(c, CAPABILITY), "capability check removed"),
    ("input_validation", lambda c: _unwrap(c, SANITIZING), "input sanitization removed"),
    ("i18n", _translated, "translation calls removed"),
    ("performance", lambda c: F.when(c.rlike(f"(?i){SELECT_LIST}"), replace_first(c, f"(?i){SELECT_LIST}", "$1*$3")), "all columns selected instead of some"),
)


def fan_out(df: DataFrame, code: str, mutations: tuple = MUTATIONS) -> DataFrame:
    """A row for each mutation that applies and changes the code, with mutation_type, description, bad_code."""
    made = F.array(*(F.struct(F.lit(n).alias("mutation_type"), F.lit(d).alias("description"), f(F.col(code)).alias("bad_code")) for n, f, d in mutations))
    out = df.withColumn("_m", F.explode(made)).where(F.col("_m.bad_code").isNotNull() & (F.col("_m.bad_code") != F.col(code)))
    return out.select(*df.columns, "_m.*")


def perturbed(code: Column, key: Column, axis: str, seed: int = 42) -> Column:
    """The same code, longer or more praised: inert lines, a tail of comments, or a note of quality, chosen by the hash of the row."""
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")
    if axis == "padding":
        return F.concat(code, F.lit("\n"), F.repeat(F.lit("$unused_pad = null;\n"), (pick % 8 + 3).cast("int")))
    if axis == "boilerplate":
        return F.concat(code, F.lit("\n/* "), F.repeat(F.lit("Reviewed for standards. "), (pick % 5 + 2).cast("int")), F.lit("*/"))
    return F.concat(F.element_at(F.array(F.lit("/* Exemplary implementation. */\n"), F.lit("/* Follows every best practice. */\n"), F.lit("/* Secure by design. */\n")), (pick % 3 + 1).cast("int")), code)


def pairs_by_axis(df: DataFrame, key: str, code: str, axes: tuple[str, ...] = ("padding", "boilerplate", "self_preference"), seed: int = 42) -> DataFrame:
    """Clean and perturbed rows of each axis, with pair_id, axis and variant."""
    kinds = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(v).alias("variant"), (F.col(code) if v == "clean" else perturbed(F.col(code), F.col(key), a, seed)).alias("code")) for a in axes for v in ("clean", "perturbed")))
    return df.select(F.col(key), F.explode(kinds).alias("x")).select(F.concat_ws(":", "x.axis", F.col(key).cast("string")).alias("pair_id"), "x.*")
