"""Training examples: builders, normalisers and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scores of severities.
SEVERITY = {"critical": 2, "high": 4, "medium": 6, "low": 8, "none": 10}


def short_description(docblock: Column) -> Column:
    """The first line of a doc comment that says something."""
    lines = F.filter(F.transform(F.split(docblock, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*/?\*+/?", ""))), lambda x: (x != "") & ~x.startswith("@"))
    return F.coalesce(F.get(lines, 0), F.lit(""))


def reasoning_text(dims: Column, order: list[str], verdict: Column, overall: Column) -> Column:
    """One line for each dimension in order, then the verdict as JSON. dims: map of name to struct(score, analysis)."""
    line = lambda d: F.when(F.try_element_at(dims, d).isNotNull(), F.concat(d, F.lit(": score "), F.coalesce(F.try_element_at(dims, d)["score"].cast("string"), F.lit("None")), F.lit("/10\n"), F.coalesce(F.try_element_at(dims, d)["analysis"], F.lit(""))))
    parts = F.array_compact(F.transform(F.array(*map(F.lit, order)), line))
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\n\n"), F.to_json(F.struct(verdict.alias("verdict"), overall.alias("overall_score"))))


def severity_scores(dims: Column) -> Column:
    """Map of name to score from a map of name to struct(severity, ...)."""
    scores = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return F.transform_values(dims, lambda _, d: F.coalesce(F.try_element_at(scores, F.trim(F.lower(d["severity"]))), F.lit(5)))


def severity_verdict(dims: Column, least: int = 6) -> Column:
    """FAIL if any score is under least."""
    return F.when(F.exists(F.map_values(severity_scores(dims)), lambda s: s < least), "FAIL").otherwise("PASS")


def as_messages(prompt: Column, answer: Column, reasoning: Column | None = None, marker: str = "[/REASONING]") -> Column:
    """A user and an assistant message, with the reasoning before the answer where there is some."""
    said = answer if reasoning is None else F.when(F.coalesce(reasoning, F.lit("")) != "", F.concat(reasoning, F.lit(f"\n{marker}\n"), answer)).otherwise(answer)
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("user", prompt), turn("assistant", said))


def listed(**notes: tuple[Column, str]) -> Column:
    """The notes whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), text) for c, text in notes.values())))


# Features of code by pattern.
FEATURES = {
    "has_nonce": r"wp_verify_nonce|check_ajax_referer|check_admin_referer",
    "has_capability": r"current_user_can",
    "has_escaping": r"esc_html|esc_attr|esc_url|wp_kses",
    "has_sanitizing": r"sanitize_\w+|absint|intval",
    "has_prepare": r"->prepare\s*\(",
    "has_sql": r"\$wpdb",
    "has_cache": r"wp_cache_|_transient\s*\(",
    "has_i18n": r"\b(?:__|_e|_n|_x|esc_html__|esc_attr__)\s*\(",
    "has_docblock": r"/\*\*",
    "has_hooks": r"add_action|add_filter|do_action|apply_filters",
    "has_rest": r"register_rest_route",
    "has_ajax": r"wp_ajax_|wp_send_json",
    "has_error_object": r"WP_Error|is_wp_error",
    "has_try": r"\btry\s*\{",
    "has_types": r"\)\s*:\s*\??\w+|function\s+\w+\s*\(\s*\??(?:int|string|array|bool|float)\b",
    "has_class": r"\bclass\s+\w+",
    "has_html": r"<(?:div|span|form|input|a|img)\b",
    "has_aria": r"aria-|role=",
    "has_loop_query": r"(?s)(?:foreach|while|for)\s*\(.*?(?:get_posts|WP_Query|\$wpdb)",
    "has_superglobal": r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES)",
}


def features(code: Column, patterns: dict[str, str] = FEATURES) -> list[Column]:
    """A boolean column for each feature."""
    return [code.rlike(p).alias(n) for n, p in patterns.items()]


def feature_score(has: dict[str, Column], weights: dict[str, float], start: float = 60.0) -> Column:
    """Start and the weights of the features that hold, within 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum((F.when(has[n], w).otherwise(0.0) for n, w in weights.items()), F.lit(start))))


def seed_columns(df: DataFrame, kind: str, by_kind: dict[str, dict[str, str]]) -> DataFrame:
    """P20: each output column from the column that the row's kind keeps it in. by_kind: kind to {output: input}."""
    names = sorted({n for m in by_kind.values() for n in m})
    pick = lambda n: F.coalesce(*(F.when(F.col(kind) == k, F.col(m[n])) for k, m in by_kind.items() if n in m))
    return df.select(kind, *(pick(n).alias(n) for n in names))


def alignment(dims: Column, before: Column, after: Column) -> Column:
    """the share of criticised dimensions of whose fix a word is new in the corrected text; 1 without criticism. dims: map of name to struct(severity, fix)."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z_]\w{3,}"), F.lit(0)))
    bad = F.filter(F.map_values(dims), lambda d: ~F.lower(d["severity"]).isin("none", "low"))
    new = F.array_except(words(after), words(before))
    met = F.filter(bad, lambda d: F.arrays_overlap(words(d["fix"]), new))
    return F.when(F.size(bad) == 0, 1.0).otherwise(F.size(met) / F.size(bad))


def expectation_ok(expected: Column, score: Column) -> Column:
    """F16: rows said to be good under 50 and rows said to be poor over 95 are not believed."""
    return ~((expected == "high") & (score < 50) | (expected == "low") & (score > 95))


def wired(code: Column, least: int = 60, most: int = 6000, pattern: str = r"add_action|add_filter|register_rest_route|add_shortcode") -> Column:
    """code that registers itself, of a length within bounds."""
    return code.rlike(pattern) & F.length(code).between(least, most)


def mechanical_reason(text: Column, least_lines: int = 3, longest: int = 500) -> Column:
    """Too short, or minified by the 95th percentile of its lines' lengths."""
    lengths = F.array_sort(F.transform(F.split(text, "\n"), F.length))
    n = F.size(lengths)
    at = F.get(lengths, F.floor(0.95 * (n - 1)).cast("int"))
    return F.when(n < least_lines, "too_short").when(at > longest, "minified")


def overlap_disposition(kind: Column, jaccard: Column, held_out: Column) -> Column:
    """What becomes of an overlap: exact and held-out ones go, near ones are looked at, the others stay."""
    return F.when(held_out & ((kind == "exact") | (jaccard >= 0.8)), "drop").when(kind == "exact", "merge").when(jaccard >= 0.9, "merge").when(jaccard >= 0.8, "review").otherwise("keep")


def context_lines(text: Column, start: Column, count: Column, around: int = 20) -> tuple[Column, Column]:
    """Up to `around` lines before and after the lines from start (from 1)."""
    lines = F.split(text, "\n")
    first = F.greatest(F.lit(1), start - around)
    before = F.slice(lines, first, F.greatest(F.lit(0), start - first))
    return F.array_join(before, "\n"), F.array_join(F.slice(lines, start + count, F.lit(around)), "\n")


def unit_id(*parts: Column) -> Column:
    """D04, C43."""
    return F.sha1(F.concat_ws("\x1f", *parts))


def grouped_rollouts(df: DataFrame, group: str, ok: Column, seq: str) -> DataFrame:
    """Each group's rows that pass, as an array in order, and how many did not; groups without any stay out."""
    marked = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    row = F.struct(seq, *(c for c in df.columns if c not in (group, seq)))
    out = marked.groupBy(group).agg(F.array_sort(F.collect_list(F.when(F.col("_ok"), row))).alias("rows"), F.count_if(~F.col("_ok")).alias("dropped"))
    return out.where(F.size("rows") > 0)


def sentinel_check(expected: DataFrame, answers: DataFrame, key: str = "index") -> DataFrame:
    """Rows that should fail: how many answers are missing, cannot be read, pass as said, pass by policy (overall under 70 fails), or fail rightly."""
    both = expected.join(answers, key, "left")
    read = F.col("verdict").isNotNull() | F.col("overall").isNotNull()
    passed = F.col("verdict") == "PASS"
    by_policy = passed & F.coalesce(F.col("overall") >= 70, F.lit(False))
    return both.agg(F.count("*").alias("rows"), F.count_if(~read).alias("unparsed"), F.count_if(read & passed).alias("said_pass"), F.count_if(read & by_policy).alias("policy_pass"), F.count_if(read & ~by_policy).alias("right"))


def seed_scores(df: DataFrame, key: str, field: str, score: str, seq: str) -> DataFrame:
    """The first score of each field, times ten, and their mean."""
    first = df.where(F.col(score).isNotNull()).groupBy(key, field).agg((F.min_by(score, seq) * 10).alias("s"))
    return first.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, "s")))).alias("scores"), F.avg("s").alias("overall"))


def substantive(failures: Column, words: list[str], skipped: dict[str, str]) -> Column:
    """Null where a failure has one of words, else the category of the first pattern of skipped that any failure meets, else "other"."""
    text = F.lower(F.array_join(failures, " | "))
    out = F.when(text.rlike("|".join(words)), None).when(F.size(failures) == 0, "none")
    for name, pattern in skipped.items():
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("other")


def common(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first frame whose key is in all of them, with every frame's other columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key)
    return out


def normalised_ratio(c: Column) -> Column:
    """A run's key without its prefix."""
    return F.regexp_replace(c, "^ratio_", "")


def skew(df: DataFrame, by: list[str], kept: str, boundary: str) -> DataFrame:
    """The shares of boundary rows among kept and among dropped rows."""
    share = lambda k: F.avg(F.when(F.col(kept) == k, F.col(boundary).cast("double")))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), share(True).alias("kept_share"), share(False).alias("dropped_share"))


def coverage_missing(df: DataFrame, values: str, required: list[str]) -> DataFrame:
    """Distinct values that occur and the required ones that do not."""
    seen = F.array_sort(F.collect_set(values))
    return df.agg(seen.alias("seen"), F.array_sort(F.array_except(F.array(*map(F.lit, required)), seen)).alias("missing"))


def claim_rates(df: DataFrame, claims: str) -> DataFrame:
    """Over rows of maps claim to boolean: mean share of true claims among rows with claims, and how many have none."""
    n = F.size(F.map_keys(claims))
    true = F.size(F.filter(F.map_values(claims), lambda v: v))
    return df.agg(F.avg(F.when(n > 0, true / n)).alias("mean_share"), F.count_if(n == 0).alias("without"))


def provenance(**columns: Column) -> tuple[Column, Column]:
    """The first value that is there, and the name of the column that gave it."""
    value, source = F.coalesce(*columns.values()), None
    for name, c in columns.items():
        source = F.when(c.isNotNull(), name) if source is None else source.when(c.isNotNull(), name)
    return value, source


