"""Personal data by candidate generators, boosted trees and calibrated thresholds, in DataFrame operations only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, table

KINDS = ("email", "ip", "card", "phone")

# The patterns of the four kinds, with the guards and possessive forms that
# find the same leftmost matches in linear time. A card is a maximal run of 12 to 19 digits.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\\.{_HOST}++)+",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){11,18}+(?![\\x20-]?[0-9])",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: What else may be personal data: spelled-out or spaced addresses, and numbers written like phones.
MORE = {
    "email": f"(?<!{_LOCAL}){_LOCAL}++\\x20?(?:\\(at\\)|\\[at\\]|@)\\x20?{_HOST}++(?:\\x20?(?:\\.|\\(dot\\)|\\[dot\\])\\x20?{_HOST}++)+",
    "phone": "(?<![0-9A-Za-z+.])(?<![0-9][\\x20().-])(?:\\([0-9]{1,4}\\)|00[0-9]|[0-9])(?:[\\x20().-]{0,2}[0-9]){7,14}(?![\\x20().-]?[0-9A-Za-z])",
}
#: What a text must contain for a pattern to be tried: for the base phone only what its pattern implies, since any number of
#: separators may lie between its digits.
NEEDS_BASE = {"phone": "\\+[0-9][\\x20().0-9-]"}
NEEDS = {"email": "@|\\(at\\)|\\[at\\]", "ip": "[0-9]\\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){11}", "phone": "[0-9](?:[\\x20().-]{0,2}[0-9]){7}"}
#: Words whose presence shortly before a span speaks for personal data.
HINTS = "(?i)mail|contact|write|phone|call|tel|mobil|fax|card|visa|account|konto|carte|tarjeta|compte|host|address|server"
FEATURES = ("kind", "digits", "others", "plus", "bracket", "left", "right", "hint", "groups", "lead")
#: Boosting rounds, step, and precision on held-out documents that a threshold must keep, with the fewest candidates to judge it by.
ROUNDS, RATE, PRECISION, FEWEST = 24, 0.4, 0.95, 30


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    value = lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    doubled = F.transform(F.transform(F.split(F.reverse(digits), ""), lambda d: F.ascii(d) - 48), value)
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    """Whether a match of the base pattern holds."""
    if kind == "ip":
        return F.forall(F.split(span, "\\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return _luhn(_digits(span))
    if kind == "phone":
        return F.length(_digits(span)).between(9, 15)
    return F.lit(True)


def _matches(text: Column, needs: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, span), by the lengths of what lies between them."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    step = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("span"))
    item = lambda start, span: F.struct(start.alias("start"), (start + F.length(span)).alias("end"), span.alias("span"))
    empty = F.array().cast("array<struct<start:int,end:int,span:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["span"])).alias("at"), F.concat(acc["out"], F.array(item(start, x["span"]))).alias("out"))

    all_ = F.aggregate(step, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(needs), all_).otherwise(empty)


def _side(char: Column) -> Column:
    """0: nothing or white space, 1: a letter or digit, 2: anything else."""
    return F.when(char.rlike("^\\s?$"), 0).when(char.rlike("[\\p{L}0-9_]"), 1).otherwise(2)


def _candidate(text: Column, kind: str, x: Column, base: Column) -> Column:
    """One candidate with its format and context features, all small integers."""
    span, digits = x["span"], _digits(x["span"])
    before = F.when(x["start"] > 0, F.substring(text, F.greatest(x["start"] - 31, F.lit(1)), F.least(x["start"], F.lit(32)))).otherwise("")
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        x["start"].alias("start"),
        x["end"].alias("end"),
        base.alias("base"),
        F.least(F.length(digits), F.lit(20)).alias("digits"),
        F.least(F.length(span) - F.length(digits), F.lit(12)).alias("others"),
        span.startswith("+").cast("int").alias("plus"),
        span.contains("(").cast("int").alias("bracket"),
        _side(F.right(before, F.lit(1))).alias("left"),
        _side(F.substring(text, x["end"] + 1, F.lit(1))).alias("right"),
        before.rlike(HINTS).cast("int").alias("hint"),
        F.least(F.size(F.split(span, "[^0-9A-Za-z]+")), F.lit(8)).alias("groups"),
        F.when(digits == "", -1).otherwise(F.ascii(digits) - 48).alias("lead"),
    )


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``_found``: all candidate spans of the whole text.

    Base spans are those of the four patterns that hold; every other match of a generator is
    a candidate too. Candidates may overlap.
    """
    step = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.col("_t")
    names = {}
    for kind in KINDS:
        names[f"_b_{kind}"] = _matches(text, NEEDS_BASE.get(kind, NEEDS[kind]), BASE[kind])
        if kind in MORE:
            names[f"_m_{kind}"] = _matches(text, NEEDS[kind], MORE[kind])
    step = step.withColumns(names)

    def rated(kind: str) -> list[Column]:
        base, more = F.col(f"_b_{kind}"), F.col(f"_m_{kind}")
        parts = [F.transform(base, lambda x: _candidate(text, kind, x, _valid(kind, x["span"])))]
        if kind in MORE:
            new = F.filter(more, lambda x: ~F.exists(base, lambda b: (b["start"] == x["start"]) & (b["end"] == x["end"])))
            parts.append(F.transform(new, lambda x: _candidate(text, kind, x, F.lit(False))))
        return parts

    parts = [x for kind in KINDS for x in rated(kind)]
    return step.withColumn("_found", F.concat(*parts)).drop("_t", *names)


# The trees are fitted to counts per combination of features, a table whose size is bounded
# by the features' ranges, not by the documents.


def _tree(cells: list[tuple], grad: list[float], hess: list[float], depth: int):
    """A regression tree on the cells: (feature, limit, lower, upper) or a leaf value."""
    g, h = sum(grad), sum(hess)
    best = (1e-6, None)
    for f in range(len(FEATURES)) if depth else ():
        sums: dict[int, list[float]] = {}
        for c, a, b in zip(cells, grad, hess):
            s = sums.setdefault(c[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
        lg = lh = 0.0
        for value in sorted(sums)[:-1]:
            lg, lh = lg + sums[value][0], lh + sums[value][1]
            gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, (f, value))
    if best[1] is None:
        return RATE * g / (h + 1)
    f, value = best[1]
    sides = []
    for low in (True, False):
        of = [k for k, c in enumerate(cells) if (c[f] <= value) is low]
        sides.append(_tree([cells[k] for k in of], [grad[k] for k in of], [hess[k] for k in of], depth - 1))
    return f, value, *sides


def _value(tree, cell: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if cell[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(cells: list[tuple], good: list[int], bad: list[int], rounds: int = ROUNDS, depth: int = 3) -> list:
    """Gradient-boosted trees for the log odds of ``good`` against ``bad`` counts of each cell."""
    score, trees = [0.0] * len(cells), []
    for _ in range(rounds if cells else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [a - (a + b) * q for a, b, q in zip(good, bad, p)]
        hess = [(a + b) * q * (1 - q) for a, b, q in zip(good, bad, p)]
        trees.append(_tree(cells, grad, hess, depth))
        score = [s + _value(trees[-1], c) for s, c in zip(score, cells)]
    return trees


def thresholds(trees: list, cells: list[tuple], good: list[int], bad: list[int]) -> list[float]:
    """Per kind the least score from which on held-out candidates are personal data at PRECISION or better."""
    found = [math.inf] * len(KINDS)
    for kind in range(len(KINDS)):
        rows = sorted(((sum(_value(t, c) for t in trees), a, b) for c, a, b in zip(cells, good, bad) if c[0] == kind), reverse=True)
        right = wrong = 0
        for k, (score, a, b) in enumerate(rows):
            right, wrong = right + a, wrong + b
            whole = k + 1 == len(rows) or rows[k + 1][0] < score
            if whole and right + wrong >= FEWEST and right >= PRECISION * (right + wrong):
                found[kind] = score
    return found


def _as_column(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, value, low, high = tree
    return F.when(x[FEATURES[f]] <= value, _as_column(low, x)).otherwise(_as_column(high, x))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans of each row of ``docs``: structs (start, kind, end, base, score), sorted.

    Positions are code points, end exclusive. Base spans always stay. Boosted trees learn
    from three quarters of the documents which formats and contexts base spans have, without
    seeing whether a match held; another candidate joins if its score reaches the threshold
    of its kind, calibrated on the last quarter, and it overlaps no base span and no better
    candidate. Null and empty texts have no spans; rows that repeat a doc_id are searched
    each; a null doc_id is allowed; other columns are ignored; no rows give no rows.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = materialize(with_candidates(slim).drop("text"), "op9-candidates")
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 3).alias("held")
    each = found.select(fold, F.explode("_found").alias("c")).groupBy("held", *[F.col(f"c.{f}").alias(f) for f in FEATURES])
    counted = each.agg(F.count(F.when(F.col("c.base"), 1)).alias("good"), F.count(F.when(~F.col("c.base"), 1)).alias("bad")).orderBy("held", *FEATURES).collect()
    of = lambda held: zip(*[(tuple(r[f] for f in FEATURES), r.good, r.bad) for r in counted if r.held is held])
    fitting, judging = (tuple(map(list, of(h))) or ([], [], []) for h in (False, True))
    trees = boost(*fitting)
    limits = thresholds(trees, *judging)
    score = lambda x: reduce(lambda a, t: a + _as_column(t, x), trees, F.lit(0.0))
    limit = lambda x: reduce(lambda a, k: F.when(x["kind"] == k, F.lit(limits[k])).otherwise(a), range(len(KINDS)), F.lit(math.inf))
    rated = F.transform("_found", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"), score(x).alias("score"), limit(x).alias("limit")))
    step = found.select("doc_id", rated.alias("_rated"))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    step = step.select("doc_id", F.filter("_rated", lambda x: x["base"]).alias("_base"), F.filter("_rated", lambda x: ~x["base"] & (x["score"] >= x["limit"])).alias("_more"))
    better = lambda x, y: (y["score"] > x["score"]) | ((y["score"] == x["score"]) & (F.struct(y["start"], y["kind"], -y["end"]) < F.struct(x["start"], x["kind"], -x["end"])))
    more = F.filter("_more", lambda x: ~F.exists("_base", lambda b: meets(x, b)) & ~F.exists("_more", lambda y: meets(x, y) & better(x, y)))
    all_ = F.sort_array(F.transform(F.concat("_base", more), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"), x["score"].alias("score"))))
    return step.select("doc_id", all_.alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span (sorted structs as of find_pii) as its kind in brackets; of overlapping spans the first is named."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)

    def add(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), name(x["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    found = find_pii(table(spark, sf_dir, "documents"))
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
