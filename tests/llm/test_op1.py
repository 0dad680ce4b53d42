"""Quality rules against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from caminho.llm.op1_quality_rules import RULES, STATS, binomial_cdf, cutoffs, judge, keep_good, with_stats

SCHEMA = "doc_id long, text string, lang string, source string, _words string, stratum string"


def row(i, text, lang="en"):
    return (i, text, lang, "s", "mine", "mine too")


def repeats(words):
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {k for i in at for k in range(i, i + 8)}
    return len(hit)


def plain(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeats(words),
        "n_text_lines": len(lines),
        "n_stutter": sum(a == b for a, b in zip(words, words[1:])),
    }


def test_statistics(spark):
    rnd = random.Random(2)
    texts = [None, "", " \t\n\x0b ", "a b  c", "For " * 50, "x y " * 5, "a\n\na\n \na\nb", "wörter # $ |\r\n" * 12]
    texts += ["".join(rnd.choice(["ab", "é", " ", "  ", "\n", "#", "ZZ "]) for _ in range(rnd.randint(0, 300))) for _ in range(40)]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 200))) for _ in range(20)]
    found = with_stats(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).collect()
    for r in found:
        want = plain(texts[r.doc_id])
        assert {k: r._stats[k] for k in want} == want, texts[r.doc_id]


@pytest.mark.parametrize("n,p", [(40, 0.05), (900, 0.02), (60_000, 0.02)])
def test_binomial_bound(spark, n, p):
    ks = sorted({0, 1, 2, int(n * p * 0.5), int(n * p * 0.9), int(n * p) + 1})
    got = spark.createDataFrame([(k, n) for k in ks], "k long, n long").select("k", binomial_cdf(F.col("k"), F.col("n"), p).alias("c")).collect()
    for r in got:
        terms = [math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(r.k + 1)]
        assert r.c == pytest.approx(sum(terms) if r.k < n * p else 1.0, rel=1e-8)


def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    good = [row(i, " ".join(word() for _ in range(40)), None if i % 4 == 0 else "en") for i in range(2400)]
    bad = [row(5000 + i, " ".join(word() + "%%%" for _ in range(40)), None if i % 4 == 0 else "en") for i in range(100)]
    labels = [(r[0], int(r[0] < 5000), 0) for r in good + bad if r[0] % 5] + [(None, 1, 0), (7, None, 0), (10**9, 1, 1)]
    return good + bad + [row(9000, None), row(9001, ""), row(None, "short", "xx")], labels


def test_rules_reject_junk_and_keep_good(spark):
    docs, labels = corpus()
    docs, labels = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in judge(docs, labels).collect()}
    assert len(found) == 2503
    assert all(found[i].kept for i in range(2400))
    assert not any(found[5000 + i].kept or found[5000 + i].base_failed for i in range(100))
    assert found[9000].base_failed and found[9001].base_failed and found[None].base_failed
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 2400


def test_no_labels_and_no_rows(spark):
    docs, _ = corpus()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = judge(spark.createDataFrame(docs, SCHEMA), none)
    assert found.where("kept").count() == 2500 and found.columns == ["doc_id", *STATS, "base_failed", "kept"]
    assert judge(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_bound_stops_a_cutoff(spark):
    """60 of 400 good documents are lost at every cutoff of the rule: it stays off."""
    rows = [(i, "en", 500 if i < 60 or i >= 400 else 0) for i in range(440)]
    rated = spark.createDataFrame(rows, "doc_id long, stratum string, v long").select(
        "doc_id", "stratum", F.struct(*[(F.col("v") if s == "n_symbols" else F.lit(1000 if s in ("word_chars", "n_words") else 0).cast("long")).alias(s) for s in STATS]).alias("_stats")
    )
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(440)], "doc_id long, quality int, toxic int")
    assert [r.cut_symbols for r in cutoffs(rated, labels).collect()] in ([], [None])
    assert set(RULES) >= {"symbols", "repeats"}
