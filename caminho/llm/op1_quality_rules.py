"""Quality rules with risk-controlled cutoffs, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, table, words

#: Share of good documents that all rules together may reject in a stratum, and the chance that this is exceeded anywhere.
ALPHA, DELTA = 0.1, 0.05
#: Among the cutoffs that pass, a rejected good document costs as much as this many rejected bad ones bring.
PRICE = 10
#: Words of a window whose repeats count.
WINDOW = 8
#: rule: (numerator, denominator, candidate cutoffs from loosest to strictest); a document is rejected above the cutoff, per mille.
RULES = {
    "symbols": ("n_symbols", "word_chars", [600, 500, 400, 300, 200, 150, 100, 70, 50, 30, 20, 10]),
    "dup_lines": ("n_dup_lines", "n_text_lines", [900, 800, 700, 600, 500, 400, 300, 200, 150, 100]),
    "repeats": ("n_repeat_words", "n_words", [300, 250, 200, 150, 100, 80, 60, 40, 20]),
    "stutter": ("n_stutter", "n_words", [600, 500, 400, 300, 200, 150, 100, 70, 50]),
    "upper": ("n_upper", "word_chars", [900, 800, 700, 600, 500, 400, 300, 200, 150, 100]),
    "word_length": ("word_chars", "n_words", [50000, 30000, 20000, 15000, 12000, 10000, 9000, 8000]),
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines", "n_upper", "n_stutter"]


def _covered(hits: Column) -> Column:
    """Words under windows that begin at the sorted positions ``hits``."""
    gaps = F.transform(hits, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(hits, k + 1), x + WINDOW) - x).cast("long"))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with one more column ``_stats``, a struct of the text statistics of each row.

    Steps are separate projections, so each array is computed once. Only documents that
    have a repeated window at all sort their windows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = docs.withColumns({"_words": F.transform(words(text), lambda w: F.xxhash64(w)), "_lines": lines})
    eight = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])
    many = F.size("_words") >= WINDOW
    grams = F.when(many, F.transform(F.sequence(F.lit(0), F.greatest(F.size("_words") - WINDOW, F.lit(0))), eight))
    step = step.withColumns({"_grams": grams, "_n_lines": F.size("_lines").cast("long"), "_n_other": F.size(F.array_distinct("_lines")).cast("long")}).drop("_lines")
    again = F.size(F.array_distinct("_grams")) < F.size("_grams")
    pairs = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    stutter = F.size(F.filter("_words", lambda w, i: F.coalesce(F.get("_words", i - 1) == w, F.lit(False)))).cast("long")
    step = step.withColumns({"_n_words": F.size("_words").cast("long"), "_n_stutter": stutter}).drop("_words").withColumn("_pairs", F.when(again, pairs)).drop("_grams")
    same = lambda x, k: F.coalesce(F.get("_pairs", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_pairs", k + 1)["h"] == x["h"], F.lit(False))
    hits = F.sort_array(F.transform(F.filter("_pairs", same), lambda x: x["i"]))
    step = step.withColumn("_hits", hits).drop("_pairs")
    step = step.withColumns(
        {
            "_word_chars": (F.length(text) - F.regexp_count(text, F.lit("[\\x20\\x09-\\x0D]"))).cast("long"),
            "_n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "_n_dup_lines": F.col("_n_lines") - F.col("_n_other"),
            "_n_repeat_words": F.coalesce(_covered(F.col("_hits")), F.lit(0).cast("long")),
            "_n_text_lines": F.col("_n_lines"),
            "_n_upper": F.regexp_count(text, F.lit("\\p{Lu}")).cast("long"),
        }
    ).drop("_n_lines", "_n_other", "_hits")
    return step.withColumn("_stats", F.struct(*[F.col(f"_{s}").alias(s) for s in STATS])).drop(*[f"_{s}" for s in STATS])


def _per_mille(rule: str) -> Column:
    above, below, _ = RULES[rule]
    return F.coalesce(F.expr(f"(1000 * _stats.{above}) div nullif(_stats.{below}, 0)"), F.lit(0))


def _log_gamma(x: Column) -> Column:
    """Stirling's series ten steps up, for x >= 1; exact to about 1e-13."""
    z = x + 10
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - reduce(lambda a, k: a + F.log(x + k), range(10), F.lit(0.0))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from k down; 1 where k is not below the mean.

    Below the mean the terms fall faster than geometrically; those left out after
    20 standard deviations are under 1e-80 of the first.
    """
    first = F.exp(_log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    depth = F.least(k, (F.sqrt(n * p) * 20 + 400).cast("long"))
    steps = F.when(depth > 0, F.sequence(F.lit(0).cast("long"), depth - 1)).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(acc: Column, i: Column) -> Column:
        term = acc["term"] * ((k - i) / (n - k + i + 1)) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(steps, start, down, lambda acc: acc["sum"])
    return F.when(n == 0, F.lit(1.0)).when(k >= n * p, F.lit(1.0)).otherwise(first * total)


def cutoffs(rated: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: stratum and a nullable cutoff per rule.

    ``rated`` has doc_id, stratum and _stats. The holdout is every labelled document (of
    repeated labels the best counts; quality 1 is good). A candidate cutoff passes if an exact
    binomial test rejects "the rule loses more than alpha / rules of the stratum's good
    documents" at level delta / (strata * rules), Bonferroni over strata and rules. Within a
    rule the candidates are tested in fixed order, loosest first, and the first failure ends
    it, which needs no further correction. All that pass hold at once, so any may be taken:
    the one that gains most, bad documents less PRICE times the good ones, the loosest of
    equals. Without a passing candidate that gains, the rule is off in that stratum.
    """
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q")).where("_q is not null")
    held = rated.join(good, rated.doc_id == good._id)
    is_good = F.col("_q") == 1
    counts = [
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.count(F.when(is_good & (_per_mille(r) > c), 1)).alias("lost"), F.count(F.when(~is_good & (_per_mille(r) > c), 1)).alias("caught"))
        for r, (_, _, grid) in RULES.items()
        for c in grid
    ]
    counted = held.groupBy("stratum").agg(F.count(F.when(is_good, 1)).alias("n"), F.array(*counts).alias("tests"))
    n_strata = F.count("*").over(Window.partitionBy(F.lit(0)))
    tests = counted.withColumn("n_strata", n_strata).select("stratum", "n", "n_strata", F.explode("tests").alias("t")).select("stratum", "n", "n_strata", "t.*")
    ok = binomial_cdf(F.col("lost"), F.col("n"), alpha / len(RULES)) <= F.lit(delta) / (F.col("n_strata") * len(RULES))
    order = Window.partitionBy("stratum", "rule").orderBy(F.col("cutoff").desc()).rowsBetween(Window.unboundedPreceding, 0)
    passed = tests.withColumn("ok", F.min(ok.cast("int")).over(order)).withColumn("gain", F.expr(f"caught - {PRICE} * lost")).where("ok = 1 and gain > 0")
    return passed.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.struct("gain", "cutoff")))["cutoff"].alias(f"cut_{r}") for r in RULES])


def _judged(rated: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rated`` with _base_failed and _kept."""
    both = rated.alias("r").join(cuts.withColumnRenamed("stratum", "_of"), F.expr("r.stratum <=> _of"), "left")
    lost = [F.coalesce(_per_mille(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    base = F.expr("_stats.n_words < 20 or 100 * _stats.n_repeat_words > 30 * _stats.n_words")
    return both.withColumn("_base_failed", base).withColumn("_kept", ~(F.col("_base_failed") | reduce(lambda a, b: a | b, lost)))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every row of ``docs``.

    Strata are the languages, null being one of its own. Null and empty texts have no words
    and fail the base rule. Rows that repeat a doc_id are judged each by its own text. Other
    columns are ignored; empty tables give no rows, and without labels only the base rule
    rejects. Null labels are ignored.
    """
    slim = docs.select("doc_id", F.col("lang").cast("string").alias("stratum"), F.col("text").cast("string").alias("text"))
    rated = materialize(with_stats(slim).drop("text"), "op1-stats")
    found = _judged(rated, cutoffs(rated, labels, alpha, delta))
    return found.select("doc_id", *[F.col(f"_stats.{s}").alias(s) for s in STATS], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns. Cutoffs come from the
    labelled rows alone; each row is then judged where it is, without a shuffle of texts.
    The row number holds the filter above the statistics, which it would else repeat."""
    held = docs.select("doc_id", F.col("lang").cast("string").alias("stratum"), F.col("text").cast("string").alias("text"))
    named = labels.select(F.col("doc_id").alias("_id")).distinct()
    held = held.join(named, held.doc_id == named._id, "left_semi")
    cuts = materialize(cutoffs(with_stats(held).drop("text"), labels, alpha, delta), "op1-cutoffs")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"), F.col("lang").cast("string").alias("stratum"))
    rated = with_stats(packed).withColumn("_at", F.monotonically_increasing_id())
    return _judged(rated, cuts).where("_kept and _at >= 0").select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    tests = " UNION ALL ".join(
        f"SELECT stratum, count(*) FILTER (good) AS n, '{r}' AS rule, {c} AS cutoff, count(*) FILTER (good AND coalesce((1000 * {a}) // nullif({b}, 0), 0) > {c}) AS lost, count(*) FILTER (NOT good AND coalesce((1000 * {a}) // nullif({b}, 0), 0) > {c}) AS caught FROM held GROUP BY stratum"
        for r, (a, b, grid) in RULES.items()
        for c in grid
    )
    cuts = ", ".join(f"min(CASE WHEN rule = '{r}' THEN cutoff END) AS cut_{r}" for r in RULES)
    lost = " OR ".join(f"coalesce(coalesce((1000 * {a}) // nullif({b}, 0), 0) > cut_{r}, false)" for r, (a, b, _) in RULES.items())
    p = ALPHA / len(RULES)
    space = "[\\x20\\x09-\\x0D]"
    return f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_id, doc_id, stratum, text, list_filter(string_split_regex(text, '{space}+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT row_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT row_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
d AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS c FROM g),
e AS (SELECT row_id, i, lead(i) OVER (PARTITION BY row_id ORDER BY i) AS nxt FROM d WHERE c > 1),
r AS (SELECT row_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat_words FROM e GROUP BY row_id),
s AS (SELECT w.row_id, doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '{space}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ls) AS BIGINT) AS n_text_lines, CAST(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper,
  CAST(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS BIGINT) AS n_stutter
  FROM w LEFT JOIN r ON w.row_id = r.row_id),
held AS (SELECT s.*, q = 1 AS good FROM s JOIN (SELECT doc_id AS id, max(quality) AS q FROM labels GROUP BY doc_id) ON doc_id = id WHERE q IS NOT NULL),
tests AS ({tests}),
p AS (SELECT tests.*, CASE WHEN n = 0 OR lost >= n * {p!r} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln({1 - p!r})))
  FROM (SELECT unnest(range(CAST(0 AS BIGINT), CAST(lost + 1 AS BIGINT))) AS j)) END AS tail FROM tests),
o AS (SELECT *, min(CASE WHEN tail <= {DELTA!r} / ({len(RULES)} * (SELECT count(DISTINCT coalesce(stratum, '')) FROM held)) THEN 1 ELSE 0 END)
  OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS ok FROM p),
best AS (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - {PRICE} * lost DESC, cutoff DESC) AS place FROM o WHERE ok = 1 AND caught > {PRICE} * lost),
cuts AS (SELECT stratum, {cuts} FROM best WHERE place = 1 GROUP BY stratum),
b AS (SELECT s.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_text_lines, n_upper, n_stutter, base_failed, NOT (base_failed OR {lost}) AS kept
FROM b LEFT JOIN cuts ON b.stratum IS NOT DISTINCT FROM cuts.stratum"""


ORACLE_SQL = _sql()
