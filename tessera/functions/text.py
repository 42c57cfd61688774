"""Text normalisers, parsers and predicates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_long(c: Column) -> Column:
    """A whole number with "+" signs left out; anything else is 0."""
    return F.coalesce(F.trim(F.replace(c, F.lit("+"), F.lit(""))).try_cast("bigint"), F.lit(0))


def lenient_double(c: Column) -> Column:
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def stripped(c: Column) -> Column:
    """No white space at the ends, line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def without_comments(c: Column) -> Column:
    """Block and line comments gone, white space squeezed."""
    return squeezed(F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), r"(?md)//.*?$", ""))


def code_hash(c: Column) -> Column:
    """The first 16 hex digits of sha256 of the squeezed text; null where nothing is left."""
    s = squeezed(c)
    return F.when(s != "", F.substring(F.sha2(s, 256), 1, 16))


def open_tag(c: Column) -> Column:
    """T15: "<?php" before a text whose first 200 characters do not have it."""
    return F.when(F.substring(c, 1, 200).rlike(r"<\?(php|=)"), c).otherwise(F.concat(F.lit("<?php\n"), c))


def reformatted(c: Column) -> Column:
    """P25: tabs as four spaces, no blanks at line ends, at most one empty line in a row."""
    spaced = F.regexp_replace(F.replace(c, F.lit("\t"), F.lit("    ")), r"(?md)[ \r]+$", "")
    return F.regexp_replace(spaced, r"\n{3,}", "\n\n")


def class_wrapped(c: Column, name: str = "Wrapper") -> Column:
    """A text that begins with a method's modifiers, inside a class."""
    method = c.rlike(r"(?s)^\s*(?:/\*.*?\*/\s*)?(?:(?:public|protected|private|static|final|abstract)\s+)+function\b")
    return F.when(method, F.concat(F.lit(f"class {name} {{\n"), c, F.lit("\n}"))).otherwise(c)


def neutral_directives(c: Column) -> Column:
    """Double braces and percent braces of templates with a space between, so no template engine reads them."""
    return F.regexp_replace(F.regexp_replace(c, r"\{([{%#])", "{ $1"), r"([}%#])\}", "$1 }")


def unclosed_braces(c: Column) -> Column:
    """by how much opening and closing braces differ."""
    count = lambda b: F.length(c) - F.length(F.replace(c, F.lit(b), F.lit("")))
    return F.abs(count("{") - count("}"))


# Descriptions that say nothing.
EMPTY_DESCRIPTIONS = ("constructor", "destructor", "init", "initialize", "setup", "register", "{@inheritdoc}", "render", "display")


def docblock_summary(c: Column) -> Column:
    """P10: the description of a doc comment up to its first tag, or "" if it is too short, one word or says nothing."""
    lines = F.transform(F.split(F.trim(c), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*/?[*]+\s?/?", "")))
    lines = F.filter(lines, lambda x: x != "")
    stop = F.array_position(F.transform(lines, lambda x: x.startswith("@") | (x == "/")), True)
    text = squeezed(F.array_join(F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines), " "))
    bad = (F.length(text) < 10) | F.regexp_replace(F.lower(text), r"^\.+|\.+$", "").isin(*EMPTY_DESCRIPTIONS) | ~text.contains(" ")
    return F.coalesce(F.when(~bad, text), F.lit(""))


def spoken_name(c: Column) -> Column:
    """Part of P11: a function's name as words, without its class."""
    return F.lower(F.trim(F.replace(F.regexp_replace(F.substring_index(c, "::", -1), "([A-Z])", " $1"), F.lit("_"), F.lit(" "))))


def instruction(name: Column, docblock: Column, hooks: Column, sql: Column, deps: Column, class_context: Column) -> Column:
    """What to ask for, so that the function is the answer: its description, else what its metadata tell, else its name."""
    any_of = lambda a, test: F.coalesce(F.exists(a, test), F.lit(False))
    kinds = F.array_compact(F.array(F.when(any_of(sql, lambda s: s.contains("prepared")), "prepared SQL queries"), F.when(any_of(sql, lambda s: F.lower(s).contains("join")), "JOIN queries"), F.when(any_of(sql, lambda s: F.lower(s).contains("insert")), "database insertions")))
    # Calls that are named as security measures
    secure = F.filter(deps, lambda d: d.isin("wp_verify_nonce", "check_ajax_referer", "current_user_can", "sanitize_text_field", "esc_html", "esc_attr", "esc_url"))
    parts = F.array_compact(
        F.array(
            F.when(F.size(kinds) > 0, F.concat(F.lit("using "), F.array_join(kinds, ", "))),
            F.when(any_of(hooks, lambda h: h.contains("add_action")), "registering WordPress action hooks").when(any_of(hooks, lambda h: h.contains("add_filter")), "applying WordPress filters"),
            F.when(F.size(secure) > 0, F.concat(F.lit("with "), F.array_join(F.slice(secure, 1, 2), ", "), F.lit(" for security"))),
            F.when(F.coalesce(class_context, F.lit("")) != "", F.concat(F.lit("in the "), class_context, F.lit(" class"))),
        )
    )
    words, ask = spoken_name(name), F.lit("Write a WordPress function that ")
    made = F.when(F.size(parts) > 0, F.concat(ask, words, F.lit(", "), F.array_join(parts, ", "))).when(F.length(words) > 5, F.concat(ask, words)).otherwise(F.concat(F.lit("Write a WordPress function: "), name))
    summary = docblock_summary(docblock)
    return F.when(summary != "", summary).otherwise(made)


def unit_key(repo: Column, file: Column, function: Column) -> Column:
    """P26."""
    return F.concat_ws("::", repo, file, function)


def bare_name(function: Column) -> Column:
    """Without the class before it."""
    return F.substring_index(function, "::", -1)


def first_function(c: Column) -> Column:
    """G04."""
    return F.nullif(F.regexp_extract(c, r"\bfunction\s+&?\s*([A-Za-z_]\w*)\s*\(", 1), F.lit(""))


def json_in(c: Column) -> Column:
    """The JSON in a reply, as variant: all of it, a fenced block marked json, any fenced block, or from the first to the last brace."""
    return F.coalesce(
        F.try_parse_json(F.trim(c)),
        F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)```json\s*(.+?)\s*```", 1), F.lit(""))),
        F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)```\s*(.+?)\s*```", 1), F.lit(""))),
        F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))),
    )


def without_thinking(c: Column) -> Column:
    """C05."""
    return stripped(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def before_marker(c: Column, marker: str = "[/REASONING]") -> Column:
    """What stands before the marker."""
    return F.substring_index(c, marker, 1)


def judged_json(c: Column, tag: str = "judge_output") -> Column:
    """The tagged block's JSON first, as braces in prose would mislead the other ways."""
    text = without_thinking(c)
    return F.coalesce(F.try_parse_json(F.nullif(F.trim(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))), json_in(text))


def json_number(v: Column, path: str) -> Column:
    """A number at path, not a boolean and not text."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(v, path, "double"))


def prose_scores(c: Column) -> Column:
    """Dimension to score times ten, from lines "Name: score 7/10"; "None" gives null."""
    line = r"(?md)^[*\-# ]*([A-Za-z][A-Za-z0-9 _/&-]*?)\**: *score *(\d+|None)/10"
    names = F.regexp_extract_all(c, F.lit(line), F.lit(1))
    values = F.transform(F.regexp_extract_all(c, F.lit(line), F.lit(2)), lambda x: x.try_cast("double") * 10)
    pairs = F.zip_with(names, values, lambda n, v: F.struct(F.lower(F.replace(n, F.lit(" "), F.lit("_"))).alias("k"), v.alias("v")))
    first = F.filter(pairs, lambda p, i: i == F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) - 1)
    return F.map_from_entries(first)


def code_block(c: Column, language: str = "php") -> Column:
    """The first fenced block, or the text itself."""
    found = F.regexp_extract(c, rf"(?s)```(?:{language})?\s*\n?(.*?)```", 1)
    return F.when(found != "", stripped(found)).otherwise(stripped(c))


# Grades and the least score of each.
GRADES = ((90.0, "Excellent"), (75.0, "Good"), (60.0, "Acceptable"), (40.0, "Poor"), (20.0, "Bad"), (0.0, "Failing"))


def banded(score: Column, bands: tuple[tuple[float, str], ...] = GRADES) -> Column:
    """The first band, from the top, whose least score is reached; the last one below all."""
    out = F.when(score.isNull(), None)
    for least, name in bands[:-1]:
        out = out.when(score >= least, name)
    return out.otherwise(bands[-1][1])


def retention(original: Column, revised: Column, pattern: str = r"[A-Za-z_]\w*") -> Column:
    """The share of the original's distinct tokens that the revision still has; 1 where it has none."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    n = F.size(tokens(original))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(tokens(original), tokens(revised))) / n)


# What looks like a call and is none.
NO_CALLS = ("if", "for", "foreach", "while", "switch", "catch", "function", "array", "list", "isset", "empty", "echo", "return", "print", "unset", "die", "exit", "include", "require", "elseif", "and", "or")


def calls(c: Column) -> Column:
    """Distinct names that are called."""
    names = F.regexp_extract_all(c, F.lit(r"(?<![>:$\w])([A-Za-z_]\w*)\s*\("), F.lit(1))
    return F.array_distinct(F.filter(names, lambda n: ~F.lower(n).isin(*NO_CALLS)))


def hooks(c: Column) -> Column:
    """Distinct hooks with their names, as add_action('init'."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"((?:add_action|add_filter|do_action|apply_filters)\s*\(\s*['\"][^'\"]+['\"])"), F.lit(1)))


def sql_patterns(c: Column) -> Column:
    """Which ways of reaching the database a text uses."""
    low = F.lower(c)
    marks = {"prepared_query": r"->prepare\s*\(", "get_var": r"->get_var\s*\(", "get_col": r"->get_col\s*\(", "get_row": r"->get_row\s*\(", "get_results": r"->get_results\s*\(", "insert": r"->insert\s*\(", "update": r"->update\s*\(", "delete": r"->delete\s*\(", "dbdelta": r"\bdbdelta\s*\(", "join": r"\bjoin\s+"}
    return F.array_compact(F.array(*(F.when(low.rlike(p), n) for n, p in marks.items())))


def cache_key(a: Column, b: Column) -> Column:
    """sha256 of the JSON text of both texts' first 512 characters, with a space after the comma."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(F.substring(c, 1, 512))), r"(?s)^\[(.*)\]$", 1)
    return F.sha2(F.concat(F.lit("["), quoted(a), F.lit(", "), quoted(b), F.lit("]")), 256)
