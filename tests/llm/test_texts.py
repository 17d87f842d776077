"""Exact copies, common lines, mixing, near copies and packing against plain versions on small and odd tables."""
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from augury.llm import exact_dedup, line_dedup, mixing, packing, simhash
from augury.llm.components import components
from augury.llm.perfect_hash import PerfectHash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, k1 string, fp string, kept boolean"
ODD = [None, "", " ", "\n", "a", "A", "a b", " a\tb ", "ab", "A B\nab", "x" * 50_000, "w " * 30_000, "ü ß", "ﬀ \x1cz", "a\n\na", "\n\n"]


def table(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, None, s, None, 7, "x", "y", None) for i, t, s in zip(ids, texts, sources)], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def some_texts(n=120, seed=3):
    r = random.Random(seed)
    base = [" ".join(r.choice("the of and a to in is you that it".split()) for _ in range(r.randint(1, 30))) + r.choice(["", "\nsame line", "\n Same LINE \nother", "\n"]) for _ in range(n)]
    return base + base[:20] + [t.upper() for t in base[20:30]] + [t.replace(" ", "  ") for t in base[30:40]] + ODD


def test_exact_copies(spark):
    texts = some_texts()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    ids[5] = None
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_copies(table(spark, texts, ids)).collect()}
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    assert len(got) == len(texts)
    for key, members in groups.items():
        keep = min(members)[2]
        h = hashlib.sha256(key.encode()).hexdigest()
        for _, _, i in members:
            r = got[i, h]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(members), i == keep)


@pytest.mark.parametrize("share", [1.0, 1e-9])
def test_exact_copies_hot_and_cold_agree(spark, share):
    texts = ["hot"] * 60 + ["h ot "] * 2 + ["cold", "cold", "single"]
    rows = exact_dedup.exact_copies(table(spark, texts), share=share).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows) == sorted(
        [(i, 60, 62) for i in range(62)] + [(62, 62, 2), (63, 62, 2), (64, 64, 1)])
    assert sum(r["kept"] for r in rows) == 3


def test_exact_copies_repeated_rows_and_empty(spark):
    rows = exact_dedup.exact_copies(table(spark, ["a", "a", "a"], [1, 1, 2])).collect()
    assert sum(r["kept"] for r in rows) == 1 and {r["keep_id"] for r in rows} == {1}
    assert exact_dedup.exact_copies(table(spark, [])).collect() == []


def lines_by_hand(texts, least_docs, least_chars=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    gone = {k for k, n in seen.items() if n >= least_docs and len(k) >= least_chars}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in gone]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("least_docs,shard_keys,shard_probes", [(10, 500_000, 2_000_000), (2, 7, 5)])
def test_common_lines(spark, least_docs, shard_keys, shard_probes):
    texts = some_texts()
    got = line_dedup.drop_common_lines(table(spark, texts), least_docs=least_docs, shard_keys=shard_keys, shard_probes=shard_probes)
    assert got.columns[:9] == table(spark, []).columns
    rows = {r["doc_id"]: (r["__n_lines"], r["__n_dropped"], r["__kept_text"]) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == lines_by_hand(texts, least_docs)


def test_common_lines_null_ids_repeats_and_empty(spark):
    texts = ["x\ny"] * 9 + ["X \nz"]
    rows = line_dedup.drop_common_lines(table(spark, texts, [None, None] + [1] * 7 + [2])).collect()
    assert sorted(r["__kept_text"] for r in rows) == ["y"] * 9 + ["z"]
    assert line_dedup.drop_common_lines(table(spark, [])).collect() == []


def test_perfect_hash_is_minimal_and_turns_others_away():
    r = np.random.default_rng(0)
    a, b = (r.integers(0, 2**63, 20_000).astype(np.uint64) for _ in range(2))
    n = r.integers(1, 70_000, 20_000)
    h = PerfectHash.loads(PerfectHash.build(a, b, n).dumps())
    assert sorted(h.slots(a, b)) == list(range(20_000))
    assert (h.count(a, b) == n).all()
    assert (h.count(b, a) == 0).all()
    assert len(PerfectHash.build(a[:0], b[:0], n[:0]).count(a[:5], b[:5]).nonzero()[0]) == 0


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def test_mixing(spark):
    r = random.Random(5)
    texts = some_texts(300, 8)
    sources = [r.choice(["big"] * 9 + ["ä", "b", "B", "one", None]) for _ in texts]
    sources[-1] = "nothing"
    texts[-1] = None
    d = table(spark, texts, None, sources)
    rows = mixing.mix(d).collect()
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    sizes = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want, taken = targets_by_hand(sizes), {}
    for x in rows:
        assert x["size"] == 7 and x["__size"] == len(words(texts[x["doc_id"]]))
        assert x["__source_size"] == sizes[x["source"]] and x["__target"] == pytest.approx(want[x["source"]])
        assert 0 <= x["__taken"] <= 2 * x["__size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["__taken"]
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    out = mixing.take(mixing.mix(d)).collect()
    got = {}
    for x in out:
        got[x["source"]] = got.get(x["source"], 0) + len(words(x["text"]))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}
    whole = {x["doc_id"]: x["text"] for x in d.collect()}
    assert all(whole[x["doc_id"]].startswith(x["text"]) for x in out)


def test_mixing_repeated_ids_and_empty(spark):
    rows = mixing.mix(table(spark, ["a b c"] * 4 + ["d"], [1, 1, None, None, 2], ["x"] * 4 + ["y"])).collect()
    assert all(r["__taken"] <= 2 * r["__size"] for r in rows)
    assert mixing.mix(table(spark, [])).collect() == []
    assert mixing.take(mixing.mix(table(spark, [None, ""]))).collect() == []


def simhash_by_hand(text, width=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    texts = some_texts()
    got = {r["doc_id"]: r["fingerprint"] % 2**64 for r in simhash.near_copies(table(spark, texts)).collect()}
    assert got == {i: simhash_by_hand(t) for i, t in enumerate(texts)}


def reach(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [3, 512])
def test_links_reach_what_all_pairs_reach(spark, block):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1, 2**63]
    fps = set(base)
    for f in base:  # clouds and chains around each
        for _ in range(25):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
        for _ in range(6):
            f ^= sum(1 << b for b in r.sample(range(64), 3))
            fps.add(f)
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    want = reach(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {f: f for f in fps} | {x["node"]: x["root"] for x in components(simhash.links(df, 3, block)).collect()}
    assert got == want


def test_near_copies_groups(spark):
    long = " ".join(f"w{i % 97} v{i % 31}" for i in range(900))
    texts = [long, long + " end", None, "", "one", "ONE", "two words"]
    rows = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(table(spark, texts)).collect()}
    assert rows == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6}
    assert sorted(r["doc_id"] for r in simhash.first_of_groups(table(spark, texts)).collect()) == [0, 2, 4, 6]
    assert simhash.near_copies(table(spark, [])).collect() == []
    assert {r["component_id"] for r in simhash.near_copies(table(spark, ["a", "a"], [None, 5])).collect()} == {5}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_bucket_bounds_are_optimal():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 9)
        lengths = sorted(r.sample(range(40), n))
        counts = [r.randint(1, 20) for _ in lengths]
        k = r.randint(1, 5)
        got = packing.bucket_bounds(np.array(lengths), np.array(counts), k)
        best = min(padding(lengths, counts, (*c, lengths[-1])) for m in range(min(k, n)) for c in itertools.combinations(lengths[:-1], m))
        assert len(got) <= k and got[-1] == lengths[-1] and got == sorted(got)
        assert padding(lengths, counts, got) == best


def test_packing(spark):
    texts = some_texts() + ["x"] * 30
    rows = packing.pack(table(spark, texts), buckets=4, most_tokens=50, budget=200).collect()
    by_doc, slots = {}, set()
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
        assert r["n_tokens"] + r["padding"] == r["bucket_tokens"] and 0 <= r["padding"]
        assert r["slot"] < max(1, 200 // max(1, r["bucket_tokens"]))
        slots.add((r["bucket_tokens"], r["batch"], r["slot"]))
    assert len(slots) == len(rows) and len({r["bucket_tokens"] for r in rows}) <= 4
    for i, t in enumerate(texts):
        at = 0
        for first, n in sorted(by_doc[i]):
            assert first == at
            at += n
        assert at == len(words(t))
    for b in {r["bucket_tokens"] for r in rows}:
        places = sorted(r["batch"] * max(1, 200 // max(1, b)) + r["slot"] for r in rows if r["bucket_tokens"] == b)
        assert places == list(range(len(places)))  # only a bucket's last batch is short
    assert packing.pack(table(spark, [])).collect() == []


def test_row_numbers_over_many_ranges(spark):
    from augury.llm.prefix import row_numbers
    rows = [(g, random.Random(i).getrandbits(64) - 2**63) for i, g in enumerate(["a"] * 500 + [None] * 40 + ["b"])]
    got = row_numbers(spark.createDataFrame(rows, "g string, key long"), ["g"], "key", "at", per_range=20).collect()
    for g in ("a", "b", None):
        own = sorted((r["key"], r["at"]) for r in got if r["g"] == g)
        assert [at for _, at in own] == list(range(len(own)))


def shingles_by_hand(text, width=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(" ".join(x) for x in zip(*[w[i:] for i in range(width)])) or frozenset({" ".join(w)} if w else ())


def groups_at_four_fifths(texts):
    sets = {i: shingles_by_hand(t) for i, t in texts.items()}
    alike = lambda a, b: sets[a] == sets[b] or min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    return reach(sorted(sets), alike)


def crowd(n, seed):
    """Texts of one template around, and mostly below, the similarity that counts; each is its own or close to one other."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(240)]
    out = []
    while len(out) < n:
        own = [f"x{r.random()}" if r.random() < 0.022 else w for w in base]
        out.append(" ".join(own))
        if r.random() < 0.3:
            out.append(" ".join(f"y{r.random()}" if r.random() < 0.015 else w for w in own))
    return out[:n]


def test_crowds_below_the_similarity_are_not_paired(spark, monkeypatch):
    """Pairs grow with the rows, not with their square, and nearly all links that join groups are found."""
    from augury.llm import jaccard
    compared, whole = [], jaccard._linked

    def counted(pairs, *a):
        compared[-1] += pairs.count()
        return whole(pairs, *a)
    monkeypatch.setattr(jaccard, "_linked", counted)
    for n in (200, 400):
        texts = crowd(n, n)
        roots = groups_at_four_fifths(dict(enumerate(texts)))
        compared.append(0)
        kept = jaccard.first_of_groups(table(spark, texts)).count()
        want = sum(i == r for i, r in roots.items())
        assert want < 0.9 * n and want <= kept and n - kept >= 0.9 * (n - want)
    assert compared[1] <= 2.6 * compared[0]


def test_near_copies_at_four_fifths(spark):
    """Every link at a Jaccard similarity of 0.8 or more counts, and no other, against all pairs."""
    from augury.llm import jaccard
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 400))]
        texts.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.05, 0.2):
            texts.append(" ".join(r.choice(vocabulary) if r.random() < share else w for w in base))
        texts.append(" ".join(base[len(base) // 8:]))
    texts += ["  ".join(t.split()).upper() for t in texts[:5]] + ODD
    shingles = [shingles_by_hand(t) for t in texts]
    linked = [len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b])) for a, b in itertools.combinations(range(175), 2)]
    assert sum(0.8 <= x < 0.95 for x in linked) > 30 and sum(0.5 <= x < 0.8 for x in linked) > 10
    roots = groups_at_four_fifths(dict(enumerate(texts)))
    df = table(spark, texts)
    got = jaccard.first_of_groups(df)
    assert got.columns == df.columns
    assert {x["doc_id"] for x in got.collect()} == {i for i, root in roots.items() if i == root}
    assert jaccard.first_of_groups(df.limit(0)).collect() == []


def test_near_copies_null_and_repeated_ids(spark):
    from augury.llm import jaccard
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (3, a), (3, a), (7, b), (3, b), (None, c), (None, c)]
    got = jaccard.first_of_groups(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted((x["text"], x["doc_id"] or 0) for x in got) == [(a, 3), (b, 3), (c, 0)]


def test_columns_with_the_operators_own_names(spark):
    """Callers' columns keep their values whatever they are called; new columns get names that are free."""
    from augury.llm import jaccard
    own = ["__key", "__size", "__source_size", "__target", "__taken", "__epochs", "__cut_key", "__source", "__pass", "__whole", "__part", "__k1", "__k2", "k1", "__drops", "__cut",
           "__kept_text", "__n_lines", "__n_dropped", "__row", "row", "c0", "c1", "root", "best", "key", "source_size"]
    texts = ["a b c\nsame"] * 3 + ["d e f g\nsame", None]
    df = spark.createDataFrame([(i, t, "s", *[f"{c}{i}" for c in own]) for i, t in enumerate(texts)], f"doc_id long, text string, source string, {', '.join(f'{c} string' for c in own)}")
    whole = {r["doc_id"]: tuple(r) for r in df.collect()}
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "__size_", "__source_size_", "__target_", "__taken_"]
    assert {r[0]: tuple(r)[:-4] for r in mixed.collect()} == whole
    assert [(r["__size_"], r["__source_size_"]) for r in mixed.orderBy("doc_id").collect()] == [(4, 17)] * 3 + [(5, 17), (0, 17)]
    assert all(tuple(r)[2:-4] == whole[r[0]][2:] for r in mixing.take(mixed).collect())
    lines = line_dedup.drop_common_lines(df, least_docs=4)
    assert lines.columns == [*df.columns, "__kept_text_", "__n_lines_", "__n_dropped_"]
    assert {r[0]: tuple(r)[:-3] for r in lines.collect()} == whole
    assert {r[0]: r["__kept_text_"] for r in lines.collect()} == {0: "a b c", 1: "a b c", 2: "a b c", 3: "d e f g", 4: ""}
    first = jaccard.first_of_groups(df)
    assert first.columns == df.columns and {r[0]: tuple(r) for r in first.collect()} == {i: whole[i] for i in (0, 3, 4)}


def test_near_copies_by_fingerprint_join_groups(spark):
    """With ``bits`` fingerprints link too, also where sets of shingles are less alike, and both kinds of links join one group."""
    from augury.llm import jaccard
    long = [f"w{i}" for i in range(3000)]
    a = " ".join(long)
    b = " ".join([*long, *(w for i in range(0, 600) for w in ("q", f"x{i}"))])  # as long as needed to be less than 0.8 alike
    texts = [a, b, b + " end", "one two three", None, ""]
    got = jaccard.first_of_groups(table(spark, texts), bits=3)
    prints = [simhash.simhash((t or "").encode()) for t in texts]
    near = lambda x, y: ((prints[x] ^ prints[y]) & (2**64 - 1)).bit_count() <= 3
    sets = [shingles_by_hand(t) for t in texts]
    both = lambda x, y: len(sets[x] & sets[y]) / max(1, len(sets[x] | sets[y])) >= 0.8 or sets[x] == sets[y]
    root = reach(range(len(texts)), lambda x, y: near(x, y) or both(x, y))
    assert {x["doc_id"] for x in got.collect()} == {i for i, r in root.items() if i == r}


def test_pipeline_stage_links_by_fingerprint(spark, monkeypatch):
    import corpus_pipeline
    from augury.llm import jaccard
    seen, real = [], jaccard.near_copies
    monkeypatch.setattr(jaccard, "near_copies", lambda *a, **kw: seen.append(kw["bits"]) or real(*a, **kw))
    docs = table(spark, ["one two three four five six", "One  two three four five six", "other words are here"])
    assert sorted(x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2] and seen == [3]


def test_rounds_of_components_leave_few_files(spark):
    """A round over few edges writes few files, however many shuffle partitions the session has."""
    import glob
    from augury.session import checkpoint_folder
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (101, 102)], "a long, b long")
    parts = lambda: set(glob.glob(f"{checkpoint_folder(spark).removeprefix('file:')}/rdd-*/part-*"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        before = parts()
        got = {r["node"]: r["root"] for r in components(edges).collect()}
        made = len(parts() - before)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert 40 <= made < 80  # the distinct edges, then a file a round
