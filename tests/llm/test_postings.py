"""The positional index against plain search."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from augury.llm import postings

low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))


def by_hand(docs, items, size):
    grams = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - size + 1)) if w else ():
            grams.setdefault(tuple(w[a:a + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if of := grams.get(tuple(w[a:a + n])):
                    hit.update(range(a, a + n))
                    found |= of
        out.append((d, len(w), len(hit), sorted(found, key=str.encode), bool(hit)))
    return sorted(out, key=repr)


def some(seed=4):
    r = random.Random(seed)
    vocabulary = "the of to a In is été 7 x9 don't Ünion ﬀ".split()
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", ", ", "\n", "_"]) for _ in range(n))
    items = [(i, text(r.randint(1, 14))) for i in range(30)] + [(3, text(5)), (None, text(4)), (40, None), (41, " .. "), (42, ""), (43, "the"), (44, "word that nobody has")]
    docs = [(i, text(r.randint(0, 60))) for i in range(50)] + [(i, f"{text(8)} {items[i % 9][1]} {text(r.randint(0, 5))}") for i in range(50, 120)]
    docs += [(200, None), (201, ""), (202, "?!"), (None, items[2][1]), (5, items[1][1]), (5, items[1][1]), (203, " ".join(text(9) + items[i % 30][1] for i in range(300)))]
    return docs, items


def tables(spark, docs, items):
    d = spark.createDataFrame([(*x, "e", 1, 2) for x in docs], "doc_id long, text string, term string, row int, segment int").repartition(3, "doc_id")
    return d, spark.createDataFrame([(*x, "e", 1) for x in items], "item_id long, text string, phrase string, terms int")


@pytest.mark.parametrize("size,segment_words,most", [(10, 1_000_000, 1_000_000), (4, 50, 0), (3, 7, 1_000_000)])
def test_decontaminate(spark, size, segment_words, most):
    docs, items = some()
    got = postings.decontaminate(*tables(spark, docs, items), size=size, segment_words=segment_words, most_broadcast=most).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(docs, items, size)


def test_decontaminate_empty_tables(spark):
    docs, items = some()
    d, i = tables(spark, docs, items)
    assert postings.decontaminate(d.limit(0), i).collect() == []
    for none in (i.limit(0), i.where("item_id IN (40, 41, 42, 44)")):
        got = postings.decontaminate(d, none).collect()
        assert len(got) == len(docs) and {(r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got} == {(0, (), False)}
        assert sorted(r["n_words"] for r in got) == sorted(len(words(t)) for _, t in docs)


@pytest.mark.parametrize("slop,segment_words", [(0, 1_000_000), (0, 40), (2, 1_000_000), (2, 30)])
def test_matches(spark, slop, segment_words):
    docs, items = some(7)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    d, i = tables(spark, docs, items[:25])
    index = postings.build_index(d, segment_words=segment_words, longest=5, slop=slop)
    grams = postings.windows(i, size=5)
    terms = {r["phrase"]: r["terms"] for r in grams.collect()}
    ids = {r["row"]: r["id"] for r in index.where("term IS NULL").collect()}
    got = sorted((ids[r["row"]], r["phrase"], r["start"]) for r in postings.matches(index, grams, slop).collect())
    code = {w: postings._Terms()[w.encode()] for _, t in docs for w in words(t)}
    texts = {i: [code[w] for w in words(t)] for i, t in docs}
    if slop == 0:
        want = sorted((d, p, a) for d, w in texts.items() for p, t in terms.items() for a in range(len(w) - len(t) + 1) if w[a:a + len(t)] == t)
        assert got == want
        return
    for d, p, a in got:  # the rarest term depends on the segment: every answer must be one by one of the terms
        t, w = terms[p], texts[d]
        assert any(0 <= a + k < len(w) and w[a + k] == t[k] and all(t[j] in w[max(0, a + j - slop):max(0, a + j + slop + 1)] for j in range(len(t))) for k in range(len(t)))
    exact = {(d, p, a) for d, w in texts.items() for p, t in terms.items() for a in range(len(w) - len(t) + 1) if w[a:a + len(t)] == t}
    assert exact <= set(got) and len(set(got)) > len(exact)
    if segment_words == 1_000_000:  # one segment a partition: the rarest term is known
        parts = {}
        for r in index.where("term IS NULL").collect():
            parts.setdefault(r["segment"], set()).add(r["id"])
        want = set()
        for of in parts.values():
            n = {}
            for d in of:
                for x in texts[d]:
                    n[x] = n.get(x, 0) + 1
            for p, t in terms.items():
                k = min(range(len(t)), key=lambda i: (n.get(t[i], 0), i))
                for d in of:
                    w = texts[d]
                    want |= {(d, p, x - k) for x in range(len(w)) if w[x] == t[k] and all(t[j] in w[max(0, x - k + j - slop):max(0, x - k + j + slop + 1)] for j in range(len(t)))}
        assert set(got) == want


def test_registered_query_carries_the_digest(spark):
    from augury.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = {d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, n, h, i, c in by_hand(docs, items, 10)}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_decontaminate"](spark, d).collect()}
    assert got == want and any(r[4] for r in got.values())
