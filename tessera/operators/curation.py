"""Catalogue selection, tagging and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import lenient_double, lenient_long, unclosed_braces


def catalog_ok(installs: Column, rating: Column, unpatched: Column, url: Column, least_installs: int = 10_000, least_rating: float = 80.0, most_unpatched: int = 0, prefix: str = "https://github.com/") -> Column:
    """F01. All inputs as text."""
    return (lenient_long(installs) >= least_installs) & (lenient_double(rating) >= least_rating) & (lenient_long(unpatched) <= most_unpatched) & F.coalesce(F.trim(url).startswith(prefix), F.lit(False))


def tier(total_vulns: Column, unpatched: Column, rating: Column) -> Column:
    """P02."""
    return F.when((lenient_long(unpatched) == 0) & (lenient_long(total_vulns) == 0) & (lenient_double(rating) >= 90), "trusted").otherwise("assessed")


def _any_contains(listed: Column, part: str) -> Column:
    return F.exists(listed, lambda x: x.contains(part))


def first_match(tags: Column, rules: dict[str, list[str]], default: list[str]) -> Column:
    """The values of the first keyword that some tag of a comma-separated list contains."""
    listed = F.transform(F.split(F.lower(F.coalesce(tags, F.lit(""))), ","), F.trim)
    values = lambda v: F.array(*map(F.lit, v))
    out = None
    for word, paths in rules.items():
        hit = _any_contains(listed, word)
        out = F.when(hit, values(paths)) if out is None else out.when(hit, values(paths))
    return values(default) if out is None else out.otherwise(values(default))


def catalog_entry(df: DataFrame, rules: dict[str, list[str]], default: list[str], skip: list[str]) -> DataFrame:
    """Name, url, quality_tier, paths, skip_paths, description of catalogue rows."""
    name = F.coalesce(F.nullif(F.trim("slug"), F.lit("")), F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("-")))
    url = F.trim("github_url")
    text = F.concat(F.coalesce("name", name), F.lit(" — "), F.format_number(lenient_long(F.col("active_installs")), 0), F.lit(" installs, "), F.bround(lenient_double(F.col("rating_pct"))).cast("int").cast("string"), F.lit("% rating"))
    return df.select(
        name.alias("name"),
        F.when((url == "") | url.endswith(".git"), url).otherwise(F.concat(url, F.lit(".git"))).alias("url"),
        tier(F.col("total_known_vulns"), F.col("unpatched_vulns"), F.col("rating_pct")).alias("quality_tier"),
        first_match(F.col("tags"), rules, default).alias("paths"),
        F.array(*map(F.lit, skip)).alias("skip_paths"),
        text.alias("description"),
    )


# Tag, where it is looked for (body: lower-cased text; sql, hooks: lists) and what must be there.
TAG_RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("sql:prepared_statements", "sql", ("prepared_query",)),
    ("sql:joins_across_meta", "sql", ("join",)),
    ("sql:dbdelta_migrations", "sql", ("dbdelta",)),
    ("sql:targeted_select", "sql", ("get_var", "get_col", "get_row")),
    ("hooks:action_registration", "hooks", ("add_action",)),
    ("hooks:filter_registration", "hooks", ("add_filter",)),
    ("security:nonce_verification", "body", ("wp_verify_nonce(", "check_ajax_referer(")),
    ("security:capability_checks", "body", ("current_user_can(",)),
    ("security:output_escaping", "body", ("esc_html(", "esc_attr(", "esc_url(", "wp_kses(")),
    ("security:input_sanitization", "body", ("sanitize_text_field(", "sanitize_email(", "absint(")),
    ("data:custom_post_types", "body", ("register_post_type(",)),
    ("data:custom_taxonomies", "body", ("register_taxonomy(",)),
    ("rest:route_registration", "body", ("register_rest_route(",)),
    ("data:transients", "body", ("set_transient(", "get_transient(")),
    ("data:object_cache", "body", ("wp_cache_set(", "wp_cache_get(")),
    ("perf:query_caching", "body", ("set_transient(", "wp_cache_set(")),
    ("cron:scheduled_events", "body", ("wp_schedule_event(",)),
    ("theme:enqueue_scripts", "body", ("wp_enqueue_script(", "wp_enqueue_style(")),
    ("theme:block_patterns", "body", ("register_block_pattern(",)),
    ("arch:activation_hooks", "body", ("register_activation_hook(",)),
    ("arch:deactivation_hooks", "body", ("register_deactivation_hook(",)),
    ("multisite:site_switching", "body", ("switch_to_blog(",)),
    ("i18n:translation_functions", "body", ("__(", "_e(", "esc_html__(", "esc_html_e(", "esc_attr__(")),
    ("i18n:pluralization", "body", ("_n(",)),
    ("a11y:aria_attributes", "body", ("aria-label", "aria-describedby", 'role="', "screen-reader-text")),
)


def tags(body: Column, sql: Column, hooks: Column, rules: tuple = TAG_RULES, labels: bool = True) -> Column:
    """The sorted tags of a unit by rules of contained strings."""
    low = F.lower(F.coalesce(body, F.lit("")))

    def hit(where: str, marks: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for m in marks:
            if where == "body":
                found = found | low.contains(m)
            elif where == "sql":
                found = found | F.coalesce(F.array_contains(sql, m), F.lit(False))
            else:
                found = found | F.coalesce(_any_contains(hooks, m), F.lit(False))
        return found

    picked = [F.when(hit(where, marks), tag) for tag, where, marks in rules]
    if labels:
        picked.append(F.when(low.contains("<label") & low.contains('for="'), "a11y:form_labels"))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*picked))))


def error_density_ok(errors: Column, code: Column, most: float = 5.0) -> Column:
    """errors for every hundred lines."""
    lines = F.greatest(F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))), F.lit(1))
    return errors / lines * 100 <= most


def verdict(scores: list[Column], failures: Column, least: float = 8.0) -> Column:
    """F06."""
    return F.when((F.least(*scores) >= least) & (F.size(F.coalesce(failures, F.array().cast("array<string>"))) == 0), "PASS").otherwise("FAIL")


def security_override(verdict_: Column, security: Column, failures: Column, note: str = "security_auto_fail") -> tuple[Column, Column]:
    """verdict and failures, with FAIL and the note (once) where security is under 5."""
    low = F.coalesce(security < 5, F.lit(False))
    return F.when(low, "FAIL").otherwise(verdict_), F.when(low, F.array_union(failures, F.array(F.lit(note)))).otherwise(failures)


# Excluded paths, foreign code and pasted fixes.
EXCLUDED_PATH = r"(?i)(?:^|/)(tests?/|test/|phpunit/|vendor/|node_modules/|third[-_]?party/|[^/]*-test\.php$|[^/]*[._-]tests?\.php$)"
FOREIGN_CODE = r"(?i)Generated from protobuf field|GPBUtil|PlugnmeetProto|Mynaparrot|\bLivekit\b"
PASTED_FIX = r"Defensive:\s*Added input sanitization per WPCS review|Input validation added per code quality review|if\s*\(\s*empty\(\s*\$args\s*\)\s*&&\s*func_num_args\(|\$sanitized_input\s*=\s*array_map\(\s*['\"]sanitize_text_field['\"]"


def reject_reason(code: Column, most_open: int = 2) -> Column:
    """why a text is no use, or null."""
    c = F.coalesce(code, F.lit(""))
    return F.when(c.rlike(FOREIGN_CODE), "vendor").when(unclosed_braces(c) > most_open, "truncated").when(c.rlike(PASTED_FIX), "boilerplate")


def first_failure(*gates: tuple[str, Column]) -> Column:
    """the name of the first gate whose condition does not hold, or null."""
    out = None
    for name, ok in gates:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def violations(df: DataFrame, key: str, **rules: Column) -> DataFrame:
    """key and rule of each rule that a row breaks; rules say what is wrong."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def report(df: DataFrame, reason: str) -> DataFrame:
    """Each reason (accepted where null), its rows and their share."""
    total = df.agg(F.count("*").alias("_n"))
    out = df.groupBy(F.coalesce(F.col(reason), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("rows"))
    return out.crossJoin(F.broadcast(total)).select("reason", "rows", (F.col("rows") / F.greatest(F.col("_n"), F.lit(1))).alias("share"))


def gaps(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Tag, have, need, deficit and fill_pct of tags below target. counts: tag, have; targets: tag, need."""
    both = targets.join(counts, "tag", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    out = both.withColumn("deficit", F.greatest(F.lit(0), F.col("need") - F.col("have")))
    return out.where("deficit > 0").select("tag", "have", "need", "deficit", F.round(F.col("have") / F.col("need") * 100, 1).alias("fill_pct"))


def cited_ok(text: Column, source: Column, names: Column, negative: list[str], reach: int = 60) -> Column:
    """the share of names that the text has, the source has and no negative word is near; 1 without names."""
    low = F.lower(text)

    def good(n: Column) -> Column:
        at = F.locate(n, text)
        around = F.substring(low, F.greatest(at - reach, F.lit(1)), F.length(n) + 2 * reach)
        bad = F.lit(False)
        for w in negative:
            bad = bad | around.contains(w)
        return (at > 0) & source.contains(n) & ~bad

    return F.when(F.size(names) == 0, 1.0).otherwise(F.size(F.filter(names, good)) / F.size(names))


def needs_reasoning(tags_: Column, complex_tags: list[str], sql: Column, line_count: Column) -> Column:
    """P15."""
    return F.arrays_overlap(tags_, F.array(*map(F.lit, complex_tags))) | (F.size(sql) >= 2) | (line_count > 40)


# Words of a critical failure, which score they cap, and at what.
FAILURE_CAPS = (
    (("nonce", "capability", "unescaped", "sql inject", "xss", "security"), ("security",), 45),
    (("label", "alt text", "keyboard", "aria", "accessibility"), ("accessibility",), 45),
    (("sql", "prepare", "injection"), ("security",), 30),
    (("naming", "phpdoc", "standard", "dead code", "debug"), ("wpcs", "documentation"), 50),
    (("loop", "unbounded", "n+1", "performance"), ("performance",), 40),
)


def rescaled(scores: dict[str, Column], verdict_: Column, failures: Column, weights: dict[str, float]) -> dict[str, Column]:
    """Scores from 1-10 as 0-100 with caps for critical failures, and overall by weights, capped for FAIL (65) and low security (40).

    scores: wpcs, security, sql, performance, i18n, accessibility, documentation.
    """
    raw = {k: v for k, v in scores.items() if k != "sql"}
    raw["security"] = (scores["security"] + scores["sql"]) / 2
    out = {k: F.bround(v / 10 * 100).cast("int") for k, v in raw.items()}
    text = F.lower(F.array_join(failures, " "))
    fail, critical = verdict_ == "FAIL", F.size(failures) > 0
    for words, dims, cap in FAILURE_CAPS:
        hit = fail & critical & text.rlike("|".join(w.replace("+", r"\+") for w in words))
        for d in dims:
            out[d] = F.when(hit, F.least(out[d], F.lit(cap))).otherwise(out[d])
    lowest = F.least(raw["security"], raw["wpcs"], raw["documentation"])
    taken = F.lit(False)
    for d in ("security", "wpcs", "documentation"):
        hit = fail & ~critical & (raw[d] == lowest) & (lowest < 9) & ~taken
        taken = taken | (raw[d] == lowest)
        out[d] = F.when(hit, F.least(out[d], F.lit(55))).otherwise(out[d])
    overall = F.bround(sum((out[d] * w for d, w in weights.items()), F.lit(0.0))).cast("int")
    overall = F.when(scores["security"] < 5, F.least(overall, F.lit(40))).otherwise(overall)
    return out | {"overall": F.when(fail, F.least(overall, F.lit(65))).otherwise(overall)}
