"""Fitting calibrations: splits of a tree, a grid over folds, predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import boosting
from tessera.plans._registry import query, tables


def _candidates(rows: str, node: int, features: tuple[str, ...] = ("quantity", "discount", "tax", "line")) -> str:
    """The best split of the rows of one node: every value of a feature is a threshold, and nulls go to either side."""
    long = " UNION ALL ".join(f"SELECT {k} AS k, '{f}' AS feature, {f} AS v, g, h FROM {rows}" for k, f in enumerate(features))
    return f"""SELECT {node} AS node, * FROM (
  SELECT *, round(power(gl, 2) / (hl + 1) + power(ga - gl, 2) / (ha - hl + 1) - power(ga, 2) / (ha + 1), 9) AS gain FROM (
    SELECT k, feature, v AS threshold, null_left, gs + CASE WHEN null_left THEN gn ELSE 0 END AS gl, hs + CASE WHEN null_left THEN hn ELSE 0 END AS hl, ga, ha FROM (
      SELECT k, feature, v, sum(sum(g)) OVER f AS gs, sum(sum(h)) OVER f AS hs FROM ({long}) WHERE v IS NOT NULL GROUP BY k, feature, v WINDOW f AS (PARTITION BY k ORDER BY v)
    ) JOIN (SELECT k, coalesce(sum(g) FILTER (v IS NULL), 0) AS gn, coalesce(sum(h) FILTER (v IS NULL), 0) AS hn, sum(g) AS ga, sum(h) AS ha FROM ({long}) GROUP BY k) USING (k), (VALUES (true), (false)) AS s(null_left)
    WHERE null_left OR hn > 0
  ) WHERE hl >= 5 AND ha - hl >= 5
) WHERE gain > 0 QUALIFY row_number() OVER (ORDER BY gain DESC, k, threshold, null_left DESC) = 1"""


_SIDE = "(SELECT r.* FROM (SELECT *, CASE feature WHEN 'quantity' THEN quantity WHEN 'discount' THEN discount WHEN 'tax' THEN tax ELSE line END AS own FROM g, n0) r WHERE {} coalesce(own <= threshold, null_left))"


@query(f"""
WITH r AS (SELECT (l_returnflag = 'R')::INT AS y, l_quantity::DOUBLE AS quantity, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax, CASE WHEN l_linenumber <= 4 THEN l_linenumber END::DOUBLE AS line FROM lineitem),
p AS (SELECT avg(y) AS p FROM r), g AS (SELECT r.*, p - y AS g, p * (1 - p) AS h FROM r, p),
n0 AS ({_candidates("g", 0)}), n1 AS ({_candidates(_SIDE.format(""), 1)}), n2 AS ({_candidates(_SIDE.format("NOT"), 2)})
SELECT node, feature, threshold, null_left, round(gain, 6) AS gain FROM n0 UNION ALL SELECT node, feature, threshold, null_left, round(gain, 6) FROM n1 UNION ALL SELECT node, feature, threshold, null_left, round(gain, 6) FROM n2
""")
def calibration_tree(spark, sf_dir):
    """The splits of a first tree of two levels, from all line items."""
    (li,) = tables(spark, sf_dir, "lineitem")
    rows = li.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("key"), (F.col("l_returnflag") == "R").cast("int").alias("y"), *(F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "discount", "tax")), F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber")).cast("double").alias("line")
    )
    booster, _ = boosting.fit(rows, "key", F.col("y"), ["quantity", "discount", "tax", "line"], [boosting.Setting(depth=2, trees=1, child_weight=5)], positive=1.0)
    return booster.splits(spark).select("node", "feature", "threshold", "null_left", F.round("gain", 6).alias("gain"))


FEATURES = ["chars", "words", "distinct_share", "lines", "digits", "capitals", "marks", "mean_word", "longest_word", "repeated_lines", "urls", "mails"]


def text_features(docs):
    """Measures of whole texts; those of a text without words are null, which trees treat as a value of its own."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    share = lambda pattern: F.try_divide(F.size(F.split("text", pattern)) - 1, F.col("chars"))
    rows = docs.withColumns({"chars": F.length("text"), "_w": words, "_l": lines})
    return rows.withColumns({
        "words": F.size("_w"), "distinct_share": F.try_divide(F.size(F.array_distinct("_w")), F.size("_w")), "lines": F.size("_l"), "digits": share("[0-9]"), "capitals": share("[A-Z]"), "marks": share("[^\\w\\s]"),
        "mean_word": F.try_divide(F.aggregate("_w", F.lit(0), lambda a, w: a + F.length(w)), F.size("_w")), "longest_word": F.array_max(F.transform("_w", F.length)), "repeated_lines": F.size("_l") - F.size(F.array_distinct("_l")), "urls": F.size(F.split("text", "https?://")) - 1, "mails": F.size(F.split("text", "@")) - 1,
    }).drop("_w", "_l")


def _labelled(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return text_features(docs.join(labels, "doc_id").select("doc_id", "text", "quality")).select("doc_id", "quality", *FEATURES)


@query()
def calibration_grid(spark, sf_dir):
    """36 settings over five folds, trained together; numbers of trees are a fiftieth of the calibration's, as each tree waits for the one before."""
    return boosting.cross_validated(_labelled(spark, sf_dir), "doc_id", "quality", FEATURES, boosting.grid(trees=(2, 4, 8)))


@query()
def calibration_importances(spark, sf_dir):
    """What a model of all labelled documents splits on."""
    booster, _ = boosting.fit(_labelled(spark, sf_dir), "doc_id", F.col("quality"), FEATURES, [boosting.Setting(trees=10, child_weight=1)])
    return booster.importances(spark)
