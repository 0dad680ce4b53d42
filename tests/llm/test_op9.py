"""Personal data: base spans against Python's re, and the added ones."""

import random
import re

from pyspark.sql import functions as F

from caminho.llm.op9_pii import KINDS, boost, find_pii, redact, thresholds

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base(text):
    found = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


def corpus():
    rnd = random.Random(6)
    pieces = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f.g", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0255.01.1.00", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112",
              "+1 (811) 555-3281", "+49 30 1234567", "+1234", "(030) 123 45 67 89", "7", "12", " ", " ", "  ", "-", "--", "+", ".", "é", "ñ😀", "word", "token=9a8b", "\n", "e-mail me", "0000000000000000"]
    return [None, "", "x" * 3000 + "@", "1" * 2000, "a@b.co " * 300] + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25))) for _ in range(400)]


def test_base_spans(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "z@z.zz", "s"), (7, texts[7], "s")], "doc_id long, text string, spans string")
    found = find_pii(docs).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        text = "z@z.zz" if r.doc_id is None else texts[r.doc_id]
        assert [(x.start, x.kind, x.end) for x in r.spans if x.base] == base(text), text
        spans = sorted((x.start, x.end) for x in r.spans if not x.base)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert find_pii(docs.limit(0)).count() == 0


def test_candidates_like_base_spans_join(spark):
    """Numbers with a wrong check digit, written like cards that are nearly all right, are found too."""
    rnd = random.Random(8)
    rows = []
    for i in range(600):
        digits = "4" + "".join(str(rnd.randint(0, 9)) for _ in range(14))
        digits += next(str(d) for d in range(10) if luhn(digits + str(d)))
        if i % 60 == 0:
            digits = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        rows.append((i, f"my card is {' '.join(digits[k:k + 4] for k in (0, 4, 8, 12))} thanks"))
    rows += [(1000 + i, f"id{rnd.randint(10**12, 10**13)}x and nothing else") for i in range(300)]
    found = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(found[i]) == 1 for i in range(600))
    assert not any(x for i in range(300) for x in found[1000 + i] if not x.base)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é mail a@b.co or +1 234 567 8901."), (2, "")], "doc_id long, text string")
    out = docs.join(find_pii(docs), "doc_id").select("doc_id", redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r.doc_id: r.t for r in out} == {1: "é mail [email] or [phone].", 2: ""}


def test_boosting_separates():
    cells = [(0, d, *(0,) * 8) for d in range(10)]
    good, bad = [100 if d > 5 else 1 for d in range(10)], [1 if d > 5 else 100 for d in range(10)]
    trees = boost(cells, good, bad)
    assert thresholds(trees, cells, good, bad)[0] > 0
