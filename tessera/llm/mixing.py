"""Temperature mixing of sources to target weights (operator 1).

A source's weight is its token share to the power of an exponent from 1 (shares
as they are) down to 0 (all alike), over the sum of those powers. Bisection
finds the largest exponent whose weights still have the target entropy (a
fraction of the logarithm of the number of sources) and the smallest whose most
repeated source is seen at most ``repeats`` times; the larger one is taken, so
the limit on repetition prevails. The weights divide a budget of tokens: a
multiple of all tokens, or with ``cover`` the least at which every source is
seen whole at least once.

Each source's budget is realised by permutations of its blocks: documents are
dealt to blocks of about ``block_tokens`` by a hash, whole epochs come first, each
with its own order of blocks, and a last epoch takes blocks in order until the
budget is used up; in the block that no longer fits, documents are taken in
hash order.

Bisection runs over the table of sources on the executors, five bisection steps
a job (31 exponents at once), whatever their number; a handful of numbers
reaches the driver. Documents move as narrow rows, summed before each shuffle;
a source with a third of all rows is spread over its blocks. The plan of blocks
is broadcast only when it was counted to hold at most ``broadcast_rows`` rows.

Null sources are a source of their own; null text has no tokens. A source
without tokens is seen once and has no weight. Repeated rows count each and stay
together. Ties of hashes are taken or left together. An empty table gives an
empty result. Other columns are not read; in ``mixed`` a row travels as one struct, so
their names may be any.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import cut

STEPS, AT_ONCE = 40, 5


@dataclass(frozen=True)
class Target:
    """budget: tokens as a multiple of all tokens, or None to cover every source."""

    entropy: float = 0.97
    repeats: float = 4.0
    budget: float | None = 1.0
    block_tokens: int = 1 << 18
    seed: int = 11
    broadcast_rows: int = 20_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Joinable where source is null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _digest(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def narrow(docs: DataFrame, target: Target, source: str) -> DataFrame:
    return docs.select("doc_id", source_key(F.col(source)).alias("key"), token_count(F.col("text")).alias("tokens"), _digest(target.seed, F.col("doc_id")).alias("doc_hash"))


def exponent(sources: DataFrame, target: Target) -> float:
    """sources: key, of_source. The exponent by bisection."""
    live = sources.where("of_source > 0")
    total, n, least, most = live.agg(F.sum("of_source"), F.count("*"), F.min("of_source"), F.max("of_source")).first()
    if not n or n == 1:
        return 1.0
    share = F.col("of_source") / F.lit(float(total))

    def fits(points: list[float]) -> list[tuple[bool, bool]]:
        """Of each exponent: entropy at least the target; repetition within its limit."""
        import math

        at = F.explode(F.array(*map(F.lit, points))).alias("x")
        sums = live.select(share.alias("p"), at).groupBy("x").agg(F.sum(F.pow("p", F.col("x"))).alias("z"), F.sum(F.pow("p", F.col("x")) * F.log("p")).alias("l"))
        got = {r.x: (r.z, r.l) for r in sums.collect()}  # one row for each exponent
        out = []
        for x in points:
            z, l = got[x]
            top = (most / least) ** (1 - x) if target.budget is None else target.budget * (least / total) ** (x - 1) / z
            out.append((math.log(z) - x * l / z >= target.entropy * math.log(n), top <= target.repeats))
        return out

    def bisect(which: int, rising: bool) -> float:
        """Where the goal begins (rising) or ceases to hold, from 0 to 1."""
        low, high = 0.0, 1.0
        for _ in range(STEPS // AT_ONCE):
            width = (high - low) / (1 << AT_ONCE)
            points = [low + width * k for k in range(1, 1 << AT_ONCE)]
            held = [f[which] == rising for f in fits(points)]
            k = next((k for k, h in enumerate(held) if h), len(points))
            low, high = low + width * k, low + width * (k + 1)
        return high if rising else low

    ends = fits([0.0, 1.0])
    by_entropy = 1.0 if ends[1][0] else bisect(0, False)
    by_limit = 0.0 if ends[0][1] else 1.0 if not ends[1][1] else bisect(1, True)
    return max(by_entropy, by_limit)


def budgets(sources: DataFrame, target: Target, x: float) -> DataFrame:
    """key, of_source, weight, budget, blocks, epochs (whole ones) and rest (tokens of the last one)."""
    live = sources.where("of_source > 0")
    total, most = live.agg(F.coalesce(F.sum("of_source").cast("double"), F.lit(1.0)), F.coalesce(F.max("of_source").cast("double"), F.lit(1.0))).first()
    power = F.pow(F.col("of_source") / F.lit(total), F.lit(x))
    z = live.agg(F.coalesce(F.sum(power), F.lit(1.0))).first()[0]
    all_tokens = total * target.budget if target.budget is not None else z * total * (most / total) ** (1 - x)
    own = F.floor(F.col("weight") * all_tokens)
    if target.budget is None:
        own = F.greatest(own, F.col("of_source"))
    joined = sources.withColumn("weight", F.when(F.col("of_source") > 0, power / F.lit(z)).otherwise(0.0))
    joined = joined.withColumn("budget", F.when(F.col("of_source") > 0, own).otherwise(0).cast("long"))
    one = F.greatest(F.col("of_source"), F.lit(1))
    return joined.select("key", "of_source", "weight", "budget", F.greatest(F.lit(1), F.ceil(F.col("of_source") / target.block_tokens)).cast("long").alias("blocks"), F.when(F.col("of_source") > 0, F.floor(F.col("budget") / one)).otherwise(1).cast("int").alias("epochs"), F.when(F.col("of_source") > 0, F.col("budget") % one).otherwise(0).alias("rest"))


def _block(doc_hash: Column, blocks: Column) -> Column:
    return F.conv(F.substring(doc_hash, 1, 15), 16, 10).cast("long") % blocks


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _with_source(rows: DataFrame, sources: DataFrame, target: Target, salts: int = 32) -> DataFrame:
    """rows with columns of their source. Beyond what may be broadcast, each source is dealt under every salt, so that a hot one is split."""
    if sources.count() <= target.broadcast_rows:
        return rows.join(F.broadcast(sources), "key")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_hash"), F.lit(salts)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def plan(rows: DataFrame, sources: DataFrame, target: Target) -> DataFrame:
    """key, block, epoch, block_start, upto: which blocks each epoch takes, in which order, and up to which document hash (null: all)."""
    placed = _with_source(rows, sources.select("key", "blocks", "epochs", "rest"), target).withColumn("block", _block(F.col("doc_hash"), F.col("blocks")))
    sizes = placed.groupBy("key", "block").agg(F.sum("tokens").alias("of_block"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
    each = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs")))).where((F.col("epoch") < F.col("epochs")) | (F.col("rest") > 0))
    each = each.withColumn("block_hash", _digest(target.seed, F.col("epoch"), F.col("key"), F.col("block")))
    before = Window.partitionBy("key", "epoch").orderBy("block_hash", "block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("block_start", F.coalesce(F.sum("of_block").over(before), F.lit(0)))
    each = cut(each.withColumn("left", F.when(F.col("epoch") == F.col("epochs"), F.col("rest") - F.col("block_start"))))
    whole = each.where(F.col("left").isNull() | (F.col("left") >= F.col("of_block")))
    split = each.where((F.col("left") > 0) & (F.col("left") < F.col("of_block"))).select("key", "block", "epoch", "block_start", "left")
    # at most one block of each source is split; the frame takes rows with equal hashes together
    upto = Window.partitionBy("key", "block").orderBy("doc_hash").rangeBetween(Window.unboundedPreceding, 0)
    taken = placed.join(split, ["key", "block"]).withColumn("sum", F.sum("tokens").over(upto)).where(F.col("sum") <= F.col("left"))
    ends = taken.groupBy("key", "block", "epoch", "block_start").agg(F.max("doc_hash").alias("upto"))
    return cut(whole.select("key", "block", "epoch", "block_start", F.lit(None).cast("string").alias("upto")).unionByName(ends))


def _planned(docs: DataFrame, target: Target, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = cut(narrow(docs, target, source))
    totals = cut(rows.groupBy("key").agg(F.sum("tokens").alias("of_source")))
    sources = cut(budgets(totals, target, exponent(totals, target)))
    return rows, sources, plan(rows, sources, target)


def _realised(rows: DataFrame, sources: DataFrame, steps: DataFrame, target: Target) -> DataFrame:
    """rows (with key, doc_hash) once for each time they are taken, with epoch, block, block_start."""
    placed = _with_source(rows, sources.select("key", "blocks"), target).withColumn("block", _block(F.col("doc_hash"), F.col("blocks")))
    out = placed.join(_small(steps, target.broadcast_rows), ["key", "block"])
    return out.where(F.col("upto").isNull() | (F.col("doc_hash") <= F.col("upto")))


def mix(docs: DataFrame, target: Target = Target(), source: str = "source") -> DataFrame:
    """doc_id, source, tokens, epoch, block, block_start (tokens of the source before the block in that epoch)."""
    rows, sources, steps = _planned(docs, target, source)
    name = F.when(F.col("key") != "-", F.expr("substring(key, 2)"))
    return _realised(rows, sources, steps, target).select("doc_id", name.alias("source"), "tokens", F.col("epoch").cast("long").alias("epoch"), F.col("block").cast("long").alias("block"), F.col("block_start").cast("long").alias("block_start"))


def mixed(docs: DataFrame, target: Target, source: str = "source") -> DataFrame:
    """Rows of docs, columns as before whatever their names, each as often as the mixture takes it."""
    _, sources, steps = _planned(docs, target, source)
    rows = docs.select(F.struct("*").alias("row"), source_key(F.col(source)).alias("key"), _digest(target.seed, F.col("doc_id")).alias("doc_hash"))
    return _realised(rows, sources, steps, target).select("row.*")


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || source, '-') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
         md5(concat_ws(':', '{seed}', doc_id::VARCHAR)) AS doc_hash
  FROM documents
), totals AS (SELECT key, sum(tokens)::BIGINT AS t FROM docs GROUP BY key
), live AS (SELECT key, t::DOUBLE AS t, t::DOUBLE / sum(t::DOUBLE) OVER () AS p FROM totals WHERE t > 0
), facts AS (SELECT count(*) AS n, sum(t) AS total, min(p) AS least, max(p) AS most FROM live
), steps AS (
  SELECT 0 AS k, 0.0::DOUBLE AS e0, 1.0::DOUBLE AS e1, 0.0::DOUBLE AS r0, 1.0::DOUBLE AS r1
  UNION ALL
  SELECT k + 1,
    CASE WHEN ok_e THEN (e0 + e1) / 2 ELSE e0 END, CASE WHEN ok_e THEN e1 ELSE (e0 + e1) / 2 END,
    CASE WHEN ok_r THEN r0 ELSE (r0 + r1) / 2 END, CASE WHEN ok_r THEN (r0 + r1) / 2 ELSE r1 END
  FROM (
    SELECT s.*,
      (SELECT ln(sum(pow(p, (s.e0 + s.e1) / 2))) - (s.e0 + s.e1) / 2 * sum(pow(p, (s.e0 + s.e1) / 2) * ln(p)) / sum(pow(p, (s.e0 + s.e1) / 2)) FROM live) >= {entropy} * ln(f.n) AS ok_e,
      {budget} * pow(f.least, (s.r0 + s.r1) / 2 - 1) / (SELECT sum(pow(p, (s.r0 + s.r1) / 2)) FROM live) <= {repeats} AS ok_r
    FROM steps s, facts f WHERE s.k < 40)
), ends AS (
  SELECT (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) FROM live) >= {entropy} * ln(n) AS natural_ok,
         {budget} * pow(least, -1) / n <= {repeats} AS uniform_ok, {budget} <= {repeats} AS share_ok, n FROM facts
), found AS (
  SELECT CASE WHEN n = 1 THEN 1.0 ELSE greatest(CASE WHEN natural_ok THEN 1.0 ELSE e0 END, CASE WHEN uniform_ok THEN 0.0 WHEN NOT share_ok THEN 1.0 ELSE r1 END) END AS x
  FROM steps, ends WHERE k = 40
), weighed AS (
  SELECT t.key, t.t, pow(l.p, x) / (SELECT sum(pow(p, x)) FROM live) AS w, (SELECT total FROM facts) AS total
  FROM totals t LEFT JOIN live l USING (key), found
), sources AS (
  SELECT key, t, greatest(1, ceil(t / {block_tokens}.0))::BIGINT AS blocks, coalesce(floor(w * (total * {budget}))::BIGINT, 0) AS b FROM weighed
), budgets AS (
  SELECT key, blocks, CASE WHEN t > 0 THEN b // greatest(t, 1) ELSE 1 END AS epochs, CASE WHEN t > 0 THEN b % greatest(t, 1) ELSE 0 END AS rest FROM sources
), placed AS (
  SELECT d.*, ('0x' || substr(doc_hash, 1, 15))::BIGINT % blocks AS block, epochs, rest FROM docs d JOIN budgets USING (key)
), sizes AS (SELECT key, block, sum(tokens)::BIGINT AS of_block, first(epochs) AS epochs, first(rest) AS rest FROM placed GROUP BY 1, 2
), each AS (
  SELECT *, md5(concat_ws(':', '{seed}', epoch::VARCHAR, key, block::VARCHAR)) AS h
  FROM (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM sizes) WHERE epoch < epochs OR rest > 0
), begun AS (
  SELECT *, coalesce(sum(of_block) OVER (PARTITION BY key, epoch ORDER BY h, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_start FROM each
), rows AS (
  SELECT p.doc_id, p.key, p.tokens, p.block, e.epoch, e.block_start, e.of_block,
         CASE WHEN e.epoch = e.epochs THEN e.rest - e.block_start END AS room,
         sum(p.tokens) OVER (PARTITION BY p.key, p.block, e.epoch ORDER BY p.doc_hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM placed p JOIN begun e USING (key, block)
)
SELECT doc_id, CASE WHEN key <> '-' THEN substr(key, 2) END AS source, tokens, epoch::BIGINT AS epoch, block::BIGINT AS block, block_start
FROM rows WHERE room IS NULL OR room >= of_block OR (room > 0 AND upto <= room)
"""
