"""The heuristic judges over whole pages: their markup is the unit's body, its first comment the doc comment, the address's last word the name."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import judges
from tessera.plans._registry import query, tables

LINK, KIND = 'href="([^"]*)"', r"\b(join|dbdelta|prepared_query|get_var|get_col|get_row)\b"
COMMENT, LAST_WORD = "<!--[^>]*-->", "([A-Za-z]+)[^A-Za-z]*$"


def _units(spark, sf_dir):
    (pages,) = tables(spark, sf_dir, "pages")
    every = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(1))
    return pages.select("page_id", "html", F.regexp_extract("html", COMMENT, 0).alias("doc"), F.regexp_extract("url", LAST_WORD, 1).alias("name"), every(LINK).alias("links"), every(KIND).alias("kinds"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql(judge: judges.Judge, last: str) -> str:
    """Step by step: each is a table in which one score has changed."""

    def holds(p: judges.Found) -> str:
        if p.after:
            return f"regexp_matches({p.text}, {_text(f'(?:{p.after}).*?(?:{p.pattern})')}, 's')"
        flags, text = _text(p.flags), f"regexp_replace({p.text}, {_text(p.without)}, ' ', 'g')" if p.without else p.text
        return f"regexp_matches({text}, {_text(p.pattern)}, {flags})" if p.least == 1 else f"len(regexp_extract_all({text}, {_text(p.pattern)}, 0, {flags})) >= {p.least}"

    count = lambda c: f"(length(body) - length(replace(body, {c}, '')))"
    out = f"""WITH u AS (SELECT page_id, coalesce(html, '') AS body, coalesce(regexp_extract(html, {_text(COMMENT)}), '') AS docblock, coalesce(regexp_extract(url, {_text(LAST_WORD)}, 1), '') AS name,
    ' ' || coalesce(array_to_string(regexp_extract_all(html, {_text(LINK)}, 1), ' '), '') || ' ' AS hooks, ' ' || coalesce(array_to_string(regexp_extract_all(html, {_text(KIND)}, 1), ' '), '') || ' ' AS queries_used FROM pages),
    v AS (SELECT *, lower(body) AS low, split_part(body, '->query', 2) AS after_query FROM u),
    s0 AS (SELECT *, {", ".join(f"{holds(p)} AS {n}" for n, p in judge.predicates.items())}, {count("chr(10)")} + 1 AS n_lines, {count("'{'")} - {count("'}'")} AS open_braces,
    regexp_matches(name, '[A-Z]') AND NOT contains(name, '_') AND NOT contains(name, '::') AS camel_case, name <> '' AND regexp_matches(body, '\\b' || regexp_escape(name) || '\\s*\\(') AS calls_itself,
    {", ".join(f"{start} AS {d}" for d, start in judge.starts.items())}, []::VARCHAR[] AS failures FROM v)"""
    for k, s in enumerate(judge.steps):
        to = s.set_to if s.set_to is not None else f"{s.dimension} + {s.delta}"
        noted = f", CASE WHEN {s.when} THEN list_append(failures, '{s.failure}') ELSE failures END AS failures" if s.failure else ""
        out += f",\n    s{k + 1} AS (SELECT * REPLACE (CASE WHEN {s.when} THEN {to} ELSE {s.dimension} END AS {s.dimension}{noted}) FROM s{k})"
    dim, least, failure = judge.auto_fail
    tags = ", ".join(f"CASE WHEN {when} THEN '{tag}' END" for tag, when in judge.tags.items())
    out += f""",
    c AS (SELECT * REPLACE ({", ".join(f"greatest(1, least(10, {d}))::INTEGER AS {d}" for d in judge.starts)}) FROM s{len(judge.steps)}),
    f AS (SELECT * REPLACE (CASE WHEN {dim} < {least} THEN list_append(failures, '{failure}') ELSE failures END AS failures), list_filter([{tags}], lambda x: x IS NOT NULL) AS tags FROM c),
    j AS (SELECT *, CASE WHEN len(failures) > 0 OR least({", ".join(judge.starts)}) < {judge.passing} THEN 'FAIL' ELSE 'PASS' END AS verdict FROM f)
    """
    return out + last


@query(_sql(judges.AGENT, f"SELECT page_id, {', '.join(judges.AGENT.starts)}, verdict, array_to_string(failures, ' ') AS failures, array_to_string(tags, ' ') AS tags FROM j"))
def judged_pages(spark, sf_dir):
    """Scores, verdict, failures and tags of every page by the judge of single functions."""
    out = judges.judged(_units(spark, sf_dir), "page_id", "html", "doc", "name", "links", "kinds")
    return out.withColumns({c: F.array_join(c, " ") for c in ("failures", "tags")})
