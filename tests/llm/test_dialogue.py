"""Conversation repair against a plain search that keeps the best (cost, audit) of every state."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from augury.llm import dialogue
from augury.llm.dialogue import END, chunk_again, chunk_back, chunk_trace

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
BLANK = " \t\n\x0b\x0c\r"


def by_hand(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest, lines) of one conversation's rows (turn, role, text)."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    turns = {t for t, _, _ in rows if t is not None}
    faults, seen, counts = [], set(), [0, 0, 0]
    for _, role, text in rows:
        if not text.strip(BLANK):
            f = 0
        elif (role, text) in seen:
            f = 1
        else:
            f = 2 if text.rstrip(BLANK)[-1] not in ".!?" else None
            seen.add((role, text))
        faults.append(f)
        if f is not None:
            counts[f] += 1
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(2):
            for s, (c, a, out) in list(best.items()):
                w = "a" if s == 2 else "u"
                new = (c + 3, a + "I", (*out, {"u": "user:", "a": "assistant:"}[w]))
                best[NEXT[s][w]] = min(best.get(NEXT[s][w], new), new)
        return best

    for (_, role, text), f in zip(rows, faults):
        after = {}
        for s, (c, a, out) in inserted(best).items():
            w = "a" if s == 2 else "u"
            ways = [(s, (c + 4, a + "D", out))]
            if f not in (0, 1):
                x = 3 if f == 2 else 0
                if role[:1] in NEXT[s]:
                    ways.append((NEXT[s][role[:1]], (c + x, a + "K", (*out, f"{role}:{text}"))))
                ways.append((NEXT[s][w], (c + 3 + x, a + "R", (*out, {"u": "user", "a": "assistant"}[w] + f":{text}"))))
            for t, way in ways:
                after[t] = min(after.get(t, way), way)
        best = after
    cost, audit, lines = min(v for s, v in inserted(best).items() if s in (0, 3))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)


def some(seed=0, n=40, longest=30):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "u2"]
    texts = ["Hello.", "Yes!", "no end", "", None, "  ", "Why? \n", "word " * 3000 + ".", ".", "ü", "Again.", "Once more."]
    out = []
    for c in [None, *range(n)]:
        kind = r.randrange(4)
        for t in range(r.randint(1, longest)):
            turn = None if r.random() < 0.03 else t + (t > 5) * r.randint(0, 1)
            role = "user" if kind == 0 else ("user", "assistant")[t % 2] if kind == 1 else r.choice(roles)
            out.append((c, turn, role, r.choice(texts) if kind != 1 or r.random() < 0.2 else f"Line {t}."))
        if r.random() < 0.3:
            out.append(out[-1])
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", True) for r in rows], "conv_id long, turn long, role string, text string, at int, conv string, last boolean")


@pytest.mark.parametrize("chunk_rows,passes", [(4096, 6), (4, 6), (1, 1), (7, 0)])
def test_repair(spark, chunk_rows, passes):
    rows = some()
    want = {}
    for c, *x in rows:
        want.setdefault(c, []).append(x)
    ids = table(spark, rows + [(900, 0, "user", "gone")])
    got = {r["conv_id"]: tuple(r)[1:] for r in dialogue.repair(table(spark, rows), ids, chunk_rows=chunk_rows, passes=passes).collect()}
    assert got.pop(900) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: by_hand(x)[:-1] for c, x in want.items()}


@pytest.mark.parametrize("chunk_rows,passes", [(100, 2), (5000, 6)])
def test_one_long_conversation_that_never_converges(spark, chunk_rows, passes):
    rows = [(1, t, "user", f"Text {t}.") for t in range(1501)] + [(1, 2000 + t, "user", " ") for t in range(300)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    got = {r["conv_id"]: tuple(r)[1:] for r in dialogue.repair(table(spark, rows), chunk_rows=chunk_rows, passes=passes).collect()}
    assert got == {c: by_hand([r[1:] for r in rows if r[0] == c])[:-1] for c in (1, 2)}


def test_repaired_rows(spark):
    rows = some(5, 12)
    lines = {}
    for r in dialogue.repaired_rows(table(spark, rows), chunk_rows=5).orderBy("place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    want = {}
    for c, *x in rows:
        want.setdefault(None if c is None else str(c), []).append(x)
    assert lines == {c: list(out) for c, x in want.items() if (out := by_hand(x)[-1])}


def test_fix_up_pass_ends_where_vectors_meet():
    r = random.Random(2)
    for _ in range(200):
        codes = bytes(r.choice([0, 1, 2, 3, 4, 8, 9, 10, 5]) for _ in range(r.randint(0, 40)))
        old, new = (chunk_back(bytes(r.choice([0, 1, 2, 9, 10, 4]) for _ in range(3)), END)[0] for _ in range(2))
        front, total = chunk_back(codes, old)
        assert chunk_again(codes, new, old, front, total) == chunk_back(codes, new)
    assert chunk_trace(b"", END, 2, True) == ("I", 3)


def test_empty_table_and_damage(spark):
    from augury.llm.queries import damaged
    assert dialogue.repair(table(spark, [])).collect() == []
    assert dialogue.repaired_rows(table(spark, [])).collect() == []
    import zlib
    rows = some(8, 30)
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
            want += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    got = damaged(table(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert damaged(table(spark, rows)).where(F.col("role").isNull() | F.col("text").isNull()).count() == 0
