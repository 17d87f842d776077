"""The Merkle manifest against a plain tree."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from augury.llm import merkle
from augury.llm.positions import in_order

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_by_hand(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_by_hand(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def siblings(levels, i, fan):
    out = []
    for level in levels[:-1]:
        run = level[i // fan * fan:i // fan * fan + fan]
        out.append((run[:i % fan], run[i % fan + 1:]))
        i //= fan
    return out


def by_hand(rows, fan, changed):
    """(id, leaf, subroot, root, proof, folded) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf_by_hand(r)))
        trees.append(levels_by_hand([leaf_by_hand(r) for r in groups[g]], fan))
    top = levels_by_hand([t[-1][0] for t in trees], fan)
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            proof = siblings(trees[k], i, fan) + siblings(top, k, fan)
            h = leaf_by_hand((*r[:4], changed(r)))
            for a, b in proof:
                h = sha("".join(a) + h + "".join(b))
            out.append((r[0], leaf_by_hand(r), trees[k][-1][0], top[-1][0], [(list(a), list(b)) for a, b in proof], h))
    return out


def shown(rows):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [([x.hex() for x in p["before"]], [x.hex() for x in p["after"]]) for p in r["proof"]], r["folded"]) for r in rows), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, at int, leaf string, root string, t int")


def some_rows(n, langs, seed=1):
    r = random.Random(seed)
    return [(i * 3 % 101 if i % 7 else None, r.choice(["s", None, ""]), r.choice(langs), r.choice([None, 5]), r.choice([None, "", "A b", "ü" * 9, "Long " * 2000, "-"])) for i in range(n)]


@pytest.mark.parametrize("n,langs,fan,most", [(300, ["en", "de", None, "", "é", "Z"], 8, 4096), (90, ["en"], 2, 0), (120, [f"l{i}" for i in range(70)], 3, 10), (9, ["x"], 8, 4096), (1, [None], 8, 4096), (2, ["a", "b"], 2, 0)])
def test_manifest(spark, n, langs, fan, most):
    rows = some_rows(n, langs)
    rows += rows[: n // 4]  # repeated rows are leaves of their own
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.manifest(table(spark, rows), altered={"text": F.lower("text")}, where=where, fan=fan, most_broadcast=most).collect()
    import zlib
    changed = lambda r: r[4].lower() if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]
    assert shown(got) == sorted(by_hand(rows, fan, changed), key=repr)


def test_tampering_shows_only_where_a_text_changed(spark):
    from augury.llm.queries import QUERIES
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    import zlib
    for r in QUERIES["op12_merkle"](spark, "/root/testdata/sf0.001").collect():
        text = docs[r["doc_id"]]
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0 or text is None or not any("A" <= c <= "Z" for c in text))


def test_manifest_of_nothing(spark):
    assert merkle.manifest(table(spark, [])).collect() == []


def test_in_order(spark):
    df = spark.createDataFrame([(i % 3, "x") for i in range(500)] + [(None, "y")], "k int, place string").repartition(7)
    rows = in_order(df, [F.col("k").asc_nulls_first()], "n").collect()
    assert sorted(r["n"] for r in rows) == list(range(501))
    assert [r["k"] for r in sorted(rows, key=lambda r: r["n"])] == [None] + [0] * 167 + [1] * 167 + [2] * 166
