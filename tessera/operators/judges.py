"""Heuristic judges of code units as data (C14, P06): predicates, ordered steps, verdict and tags.

A judge is a set of named predicates over a unit's text and a list of steps. All
predicates become columns of one projection, so each pattern runs once a unit,
and steps are conditions over them. A later step that sets a score undoes the
deductions before it; that is written as one flat sum for each dimension, which
stays of linear size and within generated code, rather than as nested cases.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import rubric


class Found(NamedTuple):
    """A predicate: whether pattern is found, at least `least` times, in a text from which what `without` matches is taken out first, or anywhere after the first match of `after`."""

    pattern: str
    flags: str = ""
    without: str = ""
    least: int = 1
    text: str = "body"
    after: str = ""


class Step(NamedTuple):
    """Where `when` holds, the score changes by delta or becomes set_to, and the failure is noted."""

    dimension: str
    when: str
    delta: int = 0
    set_to: int | None = None
    failure: str | None = None


@dataclass(frozen=True)
class Judge:
    starts: dict[str, int]
    predicates: dict[str, Found]
    steps: tuple[Step, ...]
    tags: dict[str, str]
    policy: str = "any"
    passing: float = 8.0
    auto_fail: tuple[str, float, str] | None = None


# Patterns (of the lower-case text where case does not matter), deductions and names of the judge of single functions.
AGENT_STARTS = {
    "wpcs_compliance": 9, "sql_safety": 10, "security": 9, "performance": 9, "wp_api_usage": 9,
    "code_quality": 9, "dependency_integrity": 9, "i18n": 8, "accessibility": 8,
}
AGENT_PREDICATES = {
    "described": Found(r"@param|@return", text="docblock"),
    "debugging": Found(r"\bvar_dump\b|\bprint_r\b|\bdie\(|\bexit\("),
    "inline_style": Found(r"style="),
    "outputs_somehow": Found(r"echo|\?>"),
    "queries": Found(r"\$wpdb\s*->\s*(query|get_results|get_row|get_col|get_var)"),
    "speaks_sql": Found(r"select |insert into|update |delete from", text="low"),
    "prepares": Found(r"\$wpdb\s*->\s*prepare\s*\("),
    "interpolates": Found(r"""\$wpdb\s*->\s*(query|get_results|get_row|get_col|get_var)\s*\(\s*["'].*?\$""", "s"),
    "concatenates": Found(r"""\$wpdb\s*->\s*(query|get_results|get_row|get_col|get_var)\s*\(\s*["'][^"']*\s*\.\s*\$"""),
    "loose_variable": Found(r"\$\w+", without=r"\$wpdb\b", text="after_query"),
    "fixed_prefix": Found(r"""['"]\s*wp_\w+\s*['"]"""),
    "own_prefix": Found(r"\$wpdb->prefix"),
    "posted": Found(r"\$_POST|\$_REQUEST"),
    "nonce": Found(r"wp_verify_nonce|check_ajax_referer|check_admin_referer"),
    "prints": Found(r"\becho\b|\bprint\b|<\?="),
    "escapes": Found(r"esc_html|esc_attr|esc_url|wp_kses|esc_js|wp_kses_post"),
    "prints_request": Found(r"echo.*\$_(GET|POST|REQUEST|COOKIE|SERVER)"),
    "prints_variable": Found(r"echo.*\$\w+", without=r"\$(this->|self::)"),
    "extracts_request": Found(r"\bextract\s*\(\s*\$_(GET|POST|REQUEST|COOKIE|FILES)"),
    "evaluates": Found(r"\beval\s*\("),
    "opens_files": Found(r"\bfopen\s*\(|\bfile_put_contents\s*\(|\bfile_get_contents\s*\("),
    "filesystem_api": Found(r"WP_Filesystem|wp_filesystem"),
    "request_in_query": Found(r"\$wpdb.*query.*\$_(GET|POST|REQUEST)", "s"),
    "db_in_loop": Found(r"(foreach|for|while)\s*\([^)]+\)\s*\{[^}]*\$wpdb"),
    "posts_in_loop": Found(r"new\s+WP_Query|get_posts\s*\(|wp_get_post_terms|get_post_meta", after="foreach|for|while"),
    "whole_meta": Found(r"select\s+\*\s+from\s+\w*(meta|options)", text="low"),
    "limited": Found(r"limit\s+\d+", text="low"),
    "endless": Found(r"while\s*\(\s*true\s*\)"),
    "selects_posts": Found(r"select.*from.*wp_posts", text="low"),
    "posts_api": Found(r"WP_Query|get_posts"),
    "adds_route": Found(r"register_rest_route\s*\("),
    "permission": Found(r"permission_callback"),
    "adds_post_type": Found(r"register_post_type\s*\("),
    "labels_given": Found(r"labels"),
    "reminders": Found(r"//.*(?:todo|fixme|hack|xxx|temp)", text="low", least=4),
    "returns_twice": Found(r"return\s*;.*return\s*;", "s"),
    "swallows": Found(r"catch\s*\([^)]+\)\s*\{\s*\}"),
    "globals": Found(r"\bglobal\s+\$\w+", least=4),
    "requires": Found(r"""\brequire_once?\s*\(\s*['"]""", without=r"""\brequire_once?\s*\(\s*['"].*vendor/autoload"""),
    "requires_vendor": Found(r"""\brequire_once?\s*\(\s*['"][^'"]*vendor/[^'"]+['"]"""),
    "guarded": Found(r"static\s+\$|\$depth|\$level"),
    "speaks": Found(r"""\becho\b|\bprint\b|return\s+['"]"""),
    "has_tag": Found(r"<[a-zA-Z][^>]*>|<\?="),
    "translates": Found(r"\b__\s*\(|\b_e\s*\(|\besc_html__\s*\(|\besc_html_e\s*\(|\besc_attr__\s*\(|\b_n\s*\(|\b_x\s*\("),
    "hardcodes": Found(r"""(?:echo|print)\s+["'][A-Za-z][A-Za-z\s]{3,}["']"""),
    "markup": Found(r"<[a-zA-Z][^>]*>|echo\s+.*<\w"),
    "input_field": Found(r"<input[^>]+>", text="low"),
    "label_for": Found(r"<label[^>]*for=|<label[^>]*htmlfor=", text="low"),
    "aria_label": Found(r"aria-label=|aria-labelledby=", text="low"),
    "hidden_input": Found(r"""<input[^>]+type=["']hidden["']""", text="low"),
    "image": Found(r"<img[^>]+>", text="low"),
    "alternative": Found(r"alt=", text="low"),
    "aria": Found(r"aria-|role=", text="low"),
    "screen_reader": Found(r"screen-reader-text|sr-only"),
}
AGENT_STEPS = (
    Step("wpcs_compliance", "camel_case", -1),
    Step("wpcs_compliance", "n_lines >= 5 AND docblock = ''", -2, failure="missing_phpdoc"),
    Step("wpcs_compliance", "n_lines >= 10 AND docblock <> '' AND NOT described", -1),
    Step("wpcs_compliance", "debugging", -3, failure="debug_statements"),
    Step("wpcs_compliance", "inline_style AND outputs_somehow", -1),
    Step("sql_safety", "(queries OR speaks_sql) AND (interpolates OR concatenates) AND NOT prepares", set_to=1, failure="unprepared_query_with_concat"),
    Step("sql_safety", "(queries OR speaks_sql) AND NOT (interpolates OR concatenates OR prepares) AND loose_variable", set_to=3, failure="possible_unprepared_query"),
    Step("sql_safety", "(queries OR speaks_sql) AND NOT (interpolates OR concatenates OR prepares OR loose_variable)", -1),
    Step("sql_safety", "(queries OR speaks_sql) AND fixed_prefix AND NOT own_prefix", -1),
    Step("security", "posted AND NOT nonce", -4, failure="missing_nonce_on_state_change"),
    Step("security", "prints AND NOT escapes AND prints_request", set_to=1, failure="unescaped_user_controlled_output"),
    Step("security", "prints AND NOT escapes AND NOT prints_request AND prints_variable", -2, failure="possible_unescaped_output"),
    Step("security", "extracts_request", set_to=1, failure="extract_on_user_data"),
    Step("security", "evaluates", set_to=1, failure="eval_usage"),
    Step("security", "opens_files AND NOT filesystem_api", -2, failure="direct_file_operations"),
    Step("security", "request_in_query", set_to=1, failure="sql_injection_vector"),
    Step("performance", "db_in_loop", -3, failure="query_in_loop"),
    Step("performance", "posts_in_loop", -2, failure="wp_query_in_loop"),
    Step("performance", "whole_meta AND NOT limited", -2, failure="select_star_meta_no_limit"),
    Step("performance", "endless", -1),
    Step("wp_api_usage", "selects_posts AND NOT posts_api", -2, failure="raw_sql_instead_of_wp_query"),
    Step("wp_api_usage", "adds_route AND NOT permission", -3, failure="rest_route_missing_permission_callback"),
    Step("wp_api_usage", "adds_post_type AND NOT labels_given", -1),
    Step("code_quality", "n_lines > 200", -2, failure="function_too_long"),
    Step("code_quality", "n_lines > 100 AND n_lines <= 200", -1),
    Step("code_quality", "reminders", -1),
    Step("code_quality", "returns_twice", -1),
    Step("code_quality", "swallows", -2, failure="empty_catch_block"),
    Step("code_quality", "open_braces > 0", -1),
    Step("code_quality", "globals", -1),
    Step("dependency_integrity", "requires", -1),
    Step("dependency_integrity", "requires_vendor", -2, failure="direct_vendor_require"),
    Step("dependency_integrity", "calls_itself AND NOT guarded", -1),
    Step("i18n", "translates", set_to=9),
    Step("i18n", "hardcodes", set_to=7),
    Step("i18n", "(speaks OR has_tag) AND hardcodes AND NOT translates", set_to=4, failure="hardcoded_user_facing_strings"),
    Step("i18n", "NOT (speaks OR has_tag)", set_to=7),
    Step("accessibility", "markup AND input_field AND NOT (label_for OR aria_label OR hidden_input)", -2, failure="form_input_without_label"),
    Step("accessibility", "markup AND image AND NOT alternative", -2, failure="image_without_alt_text"),
    Step("accessibility", "aria", 1),
    Step("accessibility", "screen_reader", 1),
    Step("accessibility", "NOT markup", set_to=7),
)
# Training tags, by what a unit's lower-case text, hooks or kinds of query must hold.
AGENT_TAGS = {
    "sql:prepared_statements": "contains(queries_used, ' prepared_query ')",
    "sql:joins_across_meta": "contains(queries_used, ' join ')",
    "sql:dbdelta_migrations": "contains(queries_used, ' dbdelta ')",
    "sql:targeted_select": "contains(queries_used, ' get_var ') OR contains(queries_used, ' get_col ') OR contains(queries_used, ' get_row ')",
    "hooks:action_registration": "contains(hooks, 'add_action')",
    "hooks:filter_registration": "contains(hooks, 'add_filter')",
    "security:nonce_verification": "contains(low, 'wp_verify_nonce(') OR contains(low, 'check_ajax_referer(')",
    "security:capability_checks": "contains(low, 'current_user_can(')",
    "security:output_escaping": "contains(low, 'esc_html(') OR contains(low, 'esc_attr(') OR contains(low, 'esc_url(') OR contains(low, 'wp_kses(')",
    "security:input_sanitization": "contains(low, 'sanitize_text_field(') OR contains(low, 'sanitize_email(') OR contains(low, 'absint(')",
    "data:custom_post_types": "contains(low, 'register_post_type(')",
    "data:custom_taxonomies": "contains(low, 'register_taxonomy(')",
    "rest:route_registration": "contains(low, 'register_rest_route(')",
    "data:transients": "contains(low, 'set_transient(') OR contains(low, 'get_transient(')",
    "data:object_cache": "contains(low, 'wp_cache_set(') OR contains(low, 'wp_cache_get(')",
    "perf:query_caching": "contains(low, 'set_transient(') OR contains(low, 'wp_cache_set(')",
    "cron:scheduled_events": "contains(low, 'wp_schedule_event(')",
    "theme:enqueue_scripts": "contains(low, 'wp_enqueue_script(') OR contains(low, 'wp_enqueue_style(')",
    "theme:block_patterns": "contains(low, 'register_block_pattern(')",
    "arch:activation_hooks": "contains(low, 'register_activation_hook(')",
    "arch:deactivation_hooks": "contains(low, 'register_deactivation_hook(')",
    "multisite:site_switching": "contains(low, 'switch_to_blog(')",
    "i18n:translation_functions": "contains(low, '__(') OR contains(low, '_e(')",
    "i18n:pluralization": "contains(low, '_n(')",
    "a11y:aria_attributes": "contains(low, 'aria-label') OR contains(low, 'aria-describedby') OR contains(low, 'role=\"') OR contains(low, 'screen-reader-text')",
    "a11y:form_labels": "contains(low, '<label') AND contains(low, 'for=\"')",
    "data:wp_query": "contains(low, 'wp_query')",
    "rest:api_response": "contains(low, 'wp_rest') OR contains(low, 'rest_api')",
    "ajax:handler": "contains(hooks, 'wp_ajax_') OR contains(low, 'admin-ajax')",
}
AGENT = Judge(AGENT_STARTS, AGENT_PREDICATES, AGENT_STEPS, AGENT_TAGS, auto_fail=("security", 5, "security_auto_fail"))
JUDGES = {"agent": AGENT}


def _holds(p: Found) -> Column:
    text = F.col(p.text)
    flags = f"(?dU{p.flags})"
    if p.after:  # one search from the first place on, as each further place would read the rest again
        return text.rlike(rf"(?dUs)\A(?>.*?(?:{p.after})).*?(?:{p.pattern})")
    text = F.regexp_replace(text, flags + p.without, " ") if p.without else text
    return text.rlike(flags + p.pattern) if p.least == 1 else F.regexp_count(text, F.lit(flags + p.pattern)) >= p.least


def _score(start: int, steps: list[Step]) -> Column:
    """The ordered steps as one sum: the last set that holds gives the base, and a delta counts if no later set holds."""
    base = F.coalesce(*(F.when(F.expr(s.when), s.set_to) for s in reversed(steps) if s.set_to is not None), F.lit(start))
    for k, s in enumerate(steps):
        if s.set_to is None:
            undone = "".join(f" AND NOT ({t.when})" for t in steps[k + 1 :] if t.set_to is not None)
            base = base + F.when(F.expr(f"({s.when}){undone}"), s.delta).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(10), base))


def judged(units: DataFrame, key: str, body: str = "body", docblock: str | None = None, name: str | None = None, hooks: str | None = None, queries_used: str | None = None, judge: Judge = AGENT) -> DataFrame:
    """Key, a score of 1 to 10 for each dimension, failures in order of the steps, verdict, and tags in order of their table.

    hooks and queries_used are arrays of strings. Null and absent columns count
    as empty; repeated keys are judged each for itself. Nothing is shuffled.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c else F.lit("")
    listed = lambda c: F.concat(F.lit(" "), F.coalesce(F.array_join(c, " "), F.lit("")), F.lit(" ")) if c else F.lit("")
    rows = units.select(F.col(key).alias("_key"), text(body).alias("body"), text(docblock).alias("docblock"), text(name).alias("name"), listed(hooks).alias("hooks"), listed(queries_used).alias("queries_used"))
    count = lambda c: F.length("body") - F.length(F.replace("body", F.lit(c), F.lit("")))
    bare = F.element_at(F.split("name", "::"), -1)
    rows = rows.withColumns({"after_query": F.split_part("body", F.lit("->query"), F.lit(2)), "low": F.lower("body")})
    rows = rows.select(
        "*", *(_holds(p).alias(n) for n, p in judge.predicates.items()), (count("\n") + 1).alias("n_lines"), (count("{") - count("}")).alias("open_braces"),
        (F.col("name").rlike("[A-Z]") & ~F.col("name").contains("_") & ~F.col("name").contains("::")).alias("camel_case"),
        ((bare != "") & F.expr(r"body rlike concat(r'(?dU)\b\Q', element_at(split(name, '::'), -1), r'\E\s*\(')")).alias("calls_itself"),
    )
    dims = {d: _score(start, [s for s in judge.steps if s.dimension == d]) for d, start in judge.starts.items()}
    failures = F.array_compact(F.array(*(F.when(F.expr(s.when), s.failure) for s in judge.steps if s.failure)))
    tags = F.array_compact(F.array(*(F.when(F.expr(when), tag) for tag, when in judge.tags.items())))
    out = rows.select(F.col("_key").alias(key), *(c.cast("int").alias(d) for d, c in dims.items()), failures.alias("failures"), tags.alias("tags"))
    if judge.auto_fail:
        dim, least, failure = judge.auto_fail
        out = out.withColumn("failures", F.when(F.col(dim) < least, F.array_append("failures", failure)).otherwise(F.col("failures")))
    scores = {d: F.col(d) for d in dims}
    return out.withColumn("verdict", rubric.judged(scores, F.col("failures"), F.lit(False), policy=judge.policy, least=judge.passing))
