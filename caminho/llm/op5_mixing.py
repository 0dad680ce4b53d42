"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The mix keeps the documents' rates r as near as possible to 1 in relative entropy, the sum of
r log r - r + 1 over documents, while each source's tokens meet its target and no rate exceeds
MOST. A document's share in its source's constraint is its size, so the convex dual has one
multiplier per source and the rates are min(MOST, exp(multiplier * size)): longer documents
are tilted more. The dual's gradient and curvature are sums over all documents, which depend
on sizes only, so each Newton step is one distributed aggregation over the table of sizes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, table

#: Sources up to which their table is sent to all tasks.
SOURCES = 10_000
#: Weights of the sources in order, repeating; tokens of the mix as a share of all tokens; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.0, 3
#: Most Newton steps, and the relative distance from the targets that ends them.
STEPS, CLOSE = 60, 1e-10
#: Steps between two looks at the distance.
AT_ONCE = 5
#: Decimals of a multiplier (per token of the longest document) and of a rate, so that engines that sum in another order agree.
DECIMALS = 9

_WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from a table of (source, source_size).

    Targets are in proportion to the weights but stop at ``most`` times the source's size;
    the excess is shared anew by weight until none is above. In order of size over weight
    the sources that stop come first, so running sums give the level of the others. The
    windows run over one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    known = sizes.withColumn("weight", F.array(*map(F.lit, weights))[(place - 1) % len(weights)]).withColumn("place", place)
    order = every.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumns(
        {
            "stopped": F.coalesce(F.sum(F.col("source_size") * most).over(order), F.lit(0).cast("long")),
            "spent": F.coalesce(F.sum("weight").over(order), F.lit(0).cast("long")),
            "total": F.sum("source_size").over(every) * F.lit(share),
            "shares": F.sum("weight").over(every),
        }
    )
    known = known.withColumn("level", (F.col("total") - F.col("stopped")).cast("double") / (F.col("shares") - F.col("spent")))
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * most
    known = known.withColumn("first", F.min(F.when(fits, F.struct("spent", "place", "level"))).over(every))
    below = F.col("first").isNotNull() & (F.struct("spent", "place") >= F.struct(F.col("first.spent"), F.col("first.place")))
    target = F.when(below, F.col("first.level") * F.col("weight")).otherwise((F.col("source_size") * most).cast("double"))
    return known.select("source", "source_size", target.alias("target"))


def _rate(multiplier: Column, size: Column, most: int) -> Column:
    """exp(multiplier * size), at most ``most``; without a multiplier ``most`` itself."""
    return F.coalesce(F.least(F.exp(F.least(multiplier * size, F.lit(5.0))), F.lit(float(most))), F.lit(float(most)))


def multipliers(cells: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """(source, multiplier, scale) that solve the dual for ``cells`` (source, size, n) and ``wanted`` (source, target).

    The gap, sum of n * size * rate - target, grows with the multiplier, and its slope is the
    sum of n * size^2 * rate over the documents below ``most``. A Newton step that leaves the
    interval known to hold the root is replaced by its middle. A source whose target is
    ``most`` times its size has no multiplier (null); one without tokens has 0. Sizes are
    taken per token of the longest document of the source (scale).
    """
    scale = cells.groupBy(F.col("source").alias("_s")).agg(F.max("size").cast("double").alias("scale"), F.sum(F.col("size") * F.col("n")).alias("all"))
    start = wanted.join(scale, F.expr("source <=> _s")).select(
        "source",
        "target",
        "scale",
        F.when(F.col("target") >= F.col("all") * most * (1 - 1e-12), F.lit(None)).otherwise(F.lit(0.0)).alias("m"),
        F.lit(-60.0).alias("low"),
        # At this multiplier the rate of a single token is ``most``.
        (F.col("scale") * math.log(most) + 1e-9).alias("high"),
    )
    now = materialize(start.where("m is not null and scale > 0"), "op5-dual")
    slim = cells.where("size > 0").select(F.col("source").alias("_s"), "size", "n")
    few = now.count() <= SOURCES

    def step(now: DataFrame) -> DataFrame:
        x = F.col("size") / F.col("scale")
        rate = _rate(F.col("m"), x, most)
        each = slim.join(F.broadcast(now) if few else now, F.expr("_s <=> source"))
        tokens = F.col("n") * F.col("size")
        sums = each.groupBy("source", "target", "scale", "m", "low", "high").agg(
            (F.sum(tokens * rate) - F.first("target")).alias("gap"), F.sum(F.when(rate < most, tokens * x * rate).otherwise(0.0)).alias("slope")
        )
        sums = sums.withColumns({"low": F.when(F.col("gap") < 0, F.col("m")).otherwise(F.col("low")), "high": F.when(F.col("gap") > 0, F.col("m")).otherwise(F.col("high"))})
        ahead = F.col("m") - F.try_divide(F.col("gap"), F.col("slope"))
        inside = (ahead > F.col("low")) & (ahead < F.col("high"))
        near = F.abs("gap") <= CLOSE * F.greatest("target", F.lit(1.0))
        after = F.when(near, F.col("m")).when(inside, ahead).otherwise((F.col("low") + F.col("high")) / 2)
        return sums.select("source", "target", "scale", after.alias("m"), "low", "high", near.alias("near"))

    for _ in range(0, STEPS, AT_ONCE):
        for _ in range(AT_ONCE):
            now = step(now)
        now = materialize(now, "op5-dual")
        if now.where("not near").isEmpty():
            break
    solved = now.select(F.col("source").alias("_t"), F.round("m", DECIMALS).alias("solved"))
    found = start.join(solved, F.expr("source <=> _t"), "left")
    return found.select("source", F.when(F.col("m").isNotNull(), F.coalesce("solved", F.lit(0.0))).alias("multiplier"), F.greatest("scale", F.lit(1.0)).alias("scale"))


def copies(units: DataFrame, dual: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """``units`` (source, doc_id, size, rows) with floor (copies of every row) and more (rows that have one more).

    Every row has floor(rate) copies. The rest of its rate is its chance of one more: rows
    come in the order of a hash of doc_id and size less that chance, and the first of them, up
    to the tokens that are missing, have one more. So a source misses its target by half a
    document at most, also where many rows share an id, since a unit may be taken in part. The
    running sum over a source is taken over 256 ranges of the order, then over 256 ranges in
    each, then inside these, so no task holds a source.
    """
    of = dual.select(F.col("source").alias("_s"), "multiplier", "scale").join(wanted.select(F.col("source").alias("_w"), "source_size", "target"), F.expr("_s <=> _w")).drop("_w")
    rated = units.join(of, F.expr("source <=> _s")).drop("_s")
    rate = F.round(_rate(F.col("multiplier"), F.col("size") / F.col("scale"), most), DECIMALS)
    rated = rated.withColumn("rate", rate).withColumn("floor", F.when(F.col("size") > 0, F.floor("rate")).otherwise(F.lit(0)).cast("long"))
    text = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    uniform = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    chance = F.floor((F.col("rate") - F.col("floor")) * (1 << 32)).cast("long")
    open_ = (F.col("size") > 0) & (F.col("floor") < most)
    dealt = rated.withColumn("mark", F.when(open_, uniform - chance + (1 << 32)))  # 33 bits
    dealt = dealt.withColumns({"high": F.shiftright("mark", 25), "low": F.shiftright("mark", 17).bitwiseAND(255), "tokens": F.col("size") * F.col("rows")})
    taken = dealt.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("tokens") * F.col("floor")).alias("taken"))
    lows = dealt.where("mark is not null").groupBy("source", "high", "low").agg(F.sum("tokens").alias("t"))
    highs = lows.groupBy("source", "high").agg(F.sum("t").alias("t"))
    ahead = lambda keys, by: F.coalesce(F.sum("t").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    highs = highs.select(F.col("source").alias("_s"), F.col("high").alias("_h"), ahead(["source"], "high").alias("from_high"))
    lows = lows.withColumn("from_low", ahead(["source", "high"], "low")).join(highs, F.expr("source <=> _s and high = _h"))
    lows = lows.select(F.col("source").alias("_a"), F.col("high").alias("_h"), F.col("low").alias("_l"), (F.col("from_high") + F.col("from_low")).alias("start"))
    within = Window.partitionBy("source", "high", "low").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.where("mark is not null").withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0).cast("long")))
    placed = placed.join(lows, F.expr("source <=> _a and high = _h and low = _l")).join(taken, F.expr("source <=> _s"))
    # The rows of the unit whose middle lies before the end of the missing tokens.
    fits = F.floor((F.col("target") - F.col("taken") - F.col("start") - F.col("inside")) / F.col("size") + 0.5)
    placed = placed.withColumn("more", F.greatest(F.lit(0), F.least(F.col("rows"), fits)).cast("long"))
    columns = ["source", "doc_id", "size", "rows", "floor", "more", "source_size", "target"]
    return placed.select(*columns).union(dealt.where("mark is null").withColumn("more", F.lit(0).cast("long")).select(*columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The decisions on the rows of ``docs``: (source, doc_id, size, rows, floor, more, source_size, target).

    Rows equal in source, doc_id and size are one unit; ``more`` of its ``rows`` have
    floor + 1 copies, the others floor. A null source is a source of its own, last in order;
    null texts have size 0 and, like all documents of size 0, are not taken. Other columns
    are ignored; an empty table gives no rows.
    """
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD)).cast("long")
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    units = materialize(sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "op5-units")
    cells = materialize(units.groupBy("source", "size").agg(F.sum("rows").alias("n")), "op5-cells")
    per_source = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = materialize(targets(per_source, weights, share, most), "op5-targets")
    return copies(units, multipliers(cells, wanted, most), wanted, most)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns. Of a unit
    that is taken in part (one a source) the rows are counted in the order of a text hash."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD)).cast("long")
    tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_i"), F.col("source").cast("string").alias("_s"), size.alias("_n"), tie.alias("_tie"))
    decided = mix(docs, weights, share, most).where("floor > 0 or more > 0").select("source", "doc_id", "size", "rows", "floor", "more")
    taken = rows.join(decided, F.expr("_i <=> doc_id and _s <=> source and _n = size"))
    whole = taken.where("more = 0 or more = rows").select("_row", F.when(F.col("more") > 0, F.col("floor") + 1).otherwise(F.col("floor")).alias("_c"))
    place = F.row_number().over(Window.partitionBy("source", "doc_id", "size").orderBy("_tie"))
    part = taken.where("more > 0 and more < rows").select("_row", (F.col("floor") + (place <= F.col("more")).cast("long")).alias("_c"))
    return whole.union(part).where("_c > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))).alias("_copy")).select("_row.*")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    decided = mix(table(spark, sf_dir, "documents"))
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_k")
    each = decided.select("doc_id", "source", "size", "source_size", "target", "floor", "more", row)
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("floor") + (F.col("_k") <= F.col("more")).cast("long"))).alias("taken"))


#: Steps of the SQL form, which has no way to stop early.
SQL_STEPS = 40


def _steps_sql() -> str:
    """The Newton steps as one table expression each."""
    found = []
    for k in range(SQL_STEPS):
        rate = f"least(exp(least(m * (size / scale), 5.0)), {MOST}.0)"
        found.append(f"""d{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (gap, slope) REPLACE (CASE WHEN NOT free OR abs(gap) <= {CLOSE} * greatest(target, 1.0) THEN m
  WHEN m - gap / nullif(slope, 0) > CASE WHEN gap < 0 THEN m ELSE low END AND m - gap / nullif(slope, 0) < CASE WHEN gap > 0 THEN m ELSE high END THEN m - gap / slope
  ELSE (CASE WHEN gap < 0 THEN m ELSE low END + CASE WHEN gap > 0 THEN m ELSE high END) / 2 END AS m, CASE WHEN gap < 0 THEN m ELSE low END AS low, CASE WHEN gap > 0 THEN m ELSE high END AS high)
  FROM (SELECT d.*, coalesce(g.total, 0) - target AS gap, g.slope FROM d{k} d LEFT JOIN (SELECT c.source, sum(n * size * {rate}) AS total,
  sum(CASE WHEN {rate} < {MOST} THEN n * size * (size / scale) * {rate} ELSE 0.0 END) AS slope FROM cells c JOIN d{k} e ON c.source IS NOT DISTINCT FROM e.source WHERE size > 0 GROUP BY c.source) g ON d.source IS NOT DISTINCT FROM g.source))""")
    return ",\n".join(found)


ORACLE_SQL = f"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
c AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM c),
w AS (SELECT *, CAST([5, 2, 1][(place - 1) % 3 + 1] AS BIGINT) AS weight FROM k),
f AS (SELECT *, coalesce(sum({MOST} * source_size) OVER o, 0) AS stopped, coalesce(sum(weight) OVER o, 0) AS spent,
  sum(source_size) OVER () AS total, sum(weight) OVER () AS shares,
  row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, place) AS turn
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - stopped AS DOUBLE) / CAST(shares - spent AS DOUBLE) AS level FROM f),
q AS (SELECT *, (SELECT min(turn) FROM l WHERE level * weight <= {MOST} * source_size) AS first FROM l),
t AS (SELECT source, source_size, CASE WHEN turn >= first THEN (SELECT level FROM q AS z WHERE z.turn = z.first) * weight ELSE CAST({MOST} * source_size AS DOUBLE) END AS target FROM q),
cells AS MATERIALIZED (SELECT source, size, count(*) AS n FROM s GROUP BY ALL),
d0 AS MATERIALIZED (SELECT t.source, t.source_size, t.target, greatest(c.scale, 1.0) AS scale, c.scale > 0 AND target < {MOST} * source_size * (1 - 1e-12) AS free,
  0.0::DOUBLE AS m, -60.0::DOUBLE AS low, c.scale * ln({MOST}) + 1e-9 AS high
  FROM t JOIN (SELECT source, CAST(max(size) AS DOUBLE) AS scale FROM cells GROUP BY source) c ON t.source IS NOT DISTINCT FROM c.source),
{_steps_sql()},
u AS (SELECT s.source, doc_id, s.size, count(*) AS n FROM s GROUP BY ALL),
r AS (SELECT u.*, source_size, target, CASE WHEN free THEN least(exp(least(round(m, {DECIMALS}) * (size / scale), 5.0)), {MOST}.0) WHEN scale > 0 AND source_size > 0 THEN {MOST}.0 ELSE 1.0 END AS raw
  FROM u JOIN d{SQL_STEPS} d ON u.source IS NOT DISTINCT FROM d.source),
f2 AS (SELECT *, round(raw, {DECIMALS}) AS rate, CASE WHEN size > 0 THEN CAST(floor(round(raw, {DECIMALS})) AS BIGINT) ELSE 0 END AS flr FROM r),
g AS (SELECT *, CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', CAST(size AS VARCHAR))), 1, 8)) AS BIGINT) - CAST(floor((rate - flr) * 4294967296) AS BIGINT) AS mark,
  sum(size * n * flr) OVER (PARTITION BY source) AS taken, size > 0 AND flr < {MOST} AS open FROM f2),
h AS (SELECT *, coalesce(sum(CASE WHEN open THEN size * n ELSE 0 END) OVER (PARTITION BY source, open ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM g),
k2 AS (SELECT *, CASE WHEN open THEN greatest(0, least(n, CAST(floor((target - taken - ahead) / size + 0.5) AS BIGINT))) ELSE 0 END AS more FROM h)
SELECT doc_id, source, size, source_size, target, CAST(size * (flr + CASE WHEN i <= more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (SELECT *, unnest(range(CAST(1 AS BIGINT), n + 1)) AS i FROM k2)"""
