"""SimHash near-dedup against all pairs."""

import random

import numpy as np
import xxhash

from caminho.llm.hamming import block_masks, forest, hamming_links
from caminho.llm.op8_simhash import LIMIT, near_duplicates, representatives

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdEÉ") for _ in range(rnd.randint(1, 6)))
    rows = []
    for i in range(150):
        if rows and rnd.random() < 0.5:
            words = (rnd.choice(rows)[1] or "x").split(" ")
            if rnd.random() < 0.7:
                words[rnd.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = rnd.choice([" ", "\n", "\t "]).join(word() for _ in range(rnd.choice([1, 3, 4, 5, 200, 400])))
        rows.append((7 * i, text, "", ""))
    return rows + [(2000, None, "", ""), (2001, "", "", ""), (2002, " \n\t", "", ""), (7, rows[1][1], "", ""), (7, "other", "", ""), (3000, "w " * 30_000, "", "")]


def test_all_pairs(spark):
    rows = corpus()
    prints = [plain(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= LIMIT:
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, r in enumerate(rows):
        least[top(k)] = min(least.get(top(k), r[0]), r[0])
    want = sorted((r[0], prints[k], least[top(k)]) for k, r in enumerate(rows))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in near_duplicates(docs).collect())
    assert found == want
    kept = representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """A document goes for its text only, never for its id; rows without id are deduplicated as well."""
    rnd = random.Random(8)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(50))
    a, b, c, d = (text() for _ in range(4))
    docs = spark.createDataFrame([(1, a, "x", ""), (1, b, "y", ""), (2, c, "z", ""), (2, a, "", ""), (None, d, "", ""), (None, d, "", ""), (None, c, "", "")], SCHEMA)
    for n in (1, 3):
        kept = representatives(docs.repartition(n)).collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, a), (1, b), (2, c), (0, d)])


def test_large_buckets_lose_no_link(spark):
    """Thousands of fingerprints around one: all connected, by far fewer links than pairs."""
    rnd = random.Random(1)
    center = rnd.getrandbits(64)
    fps = {center} | {center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))) for _ in range(1500)}
    far = {rnd.getrandbits(64) for _ in range(500)}
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in fps | far]
    links = hamming_links(spark.createDataFrame(rows, "fp long"), 4, 2).collect()
    seen, todo, near = set(), [center], {}
    for a, b in ((r.a % (1 << 64), r.b % (1 << 64)) for r in links):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
        assert (a ^ b).bit_count() <= 4
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += near.get(x, [])
    assert fps <= seen and len(links) < 40 * len(fps)


def test_blocks_and_forest():
    masks = [m % (1 << 64) for m in block_masks(4, 2)]
    rnd = random.Random(2)
    for _ in range(200):
        diff = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(diff & m == 0 for m in masks)
    i, j = forest(np.array([0, 1, 3, 1 << 40, 0xFFFFFFFF], np.uint64), 1)
    assert {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())} == {(0, 1), (1, 2), (0, 3)}
