"""Repair of conversation structure: the cheapest edits of every conversation by a Viterbi search in parallel chunks.

Rows lie in one global order and are cut into chunks of it; a chunk is a string of one byte a row. Costs to go run backward
through all chunks at once from guessed vectors, fix-up passes mend them, and the edits are traced forward along the costs.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from augury.llm.common import BLANKS
from augury.llm.positions import in_order
from augury.session import cut_lineage

# States of (s?(ua)+)?: nothing yet, after the system's turn, after a user, after an assistant. What may follow, and to what state.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WRITES = ("u", "u", "a", "u")  # the only role that an edit can write from a state
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3  # costs; CUT_OFF is added for a truncated row that stays
FAR = 1 << 40
LETTERS = "sua?"


def _inserted(after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before any insertions, from those after them: each may write the role that its state allows."""
    b = list(after)
    for _ in range(2):  # u and a lead back to where they began
        for s in range(4):
            b[s] = min(b[s], INSERT + b[NEXT[s][WRITES[s]]])
    return tuple(b)


def _edits(code: int, s: int) -> list[tuple[str, int, int]]:
    """Edits of a row by their letters, in ASCII order: letter, cost, next state."""
    letter, must_go, extra = LETTERS[code & 3], code & 4, CUT_OFF if code & 8 else 0
    out = [("D", DELETE, s)]
    if not must_go:
        if letter in NEXT[s]:
            out.append(("K", KEEP + extra, NEXT[s][letter]))
        out.append(("R", REROLE + extra, NEXT[s][WRITES[s]]))
    return out


def _normal(b: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(b)
    return tuple(min(x - low, FAR) for x in b), low


END = _normal(_inserted((0, FAR, FAR, 0)))[0]  # costs to go after the last row: insertions may still finish a pair


@lru_cache(65536)
def _back(code: int, b: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """One row back: a normal cost vector and the constant that normalising took off."""
    return _normal(_inserted(tuple(min(c + b[t] for _, c, t in _edits(code, s)) for s in range(4))))


def chunk_back(codes: bytes, b: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """From the cost vector after a chunk of rows to the one before it, and the constant between them."""
    total = 0
    for code in reversed(codes):
        b, c = _back(code, b)
        total += c
    return b, total


def chunk_again(codes: bytes, new: tuple[int, ...], old: tuple[int, ...], front: tuple[int, ...], total: int) -> tuple[tuple[int, ...], int]:
    """A fix-up pass over a chunk that has been run from ``old`` to ``front``, ``total``: it runs from ``new`` and ends at
    the first row where both vectors differ only by a constant, as all rows before it keep what they have."""
    more = 0
    for code in reversed(codes):
        if new == old:
            return front, total + more
        (new, c), (old, d) = _back(code, new), _back(code, old)
        more += c - d
    return (front, total + more) if new == old else (new, total + more)


def _vectors(codes: bytes, b: tuple[int, ...]) -> list[tuple[tuple[int, ...], int]]:
    """After each row, and before the first, the cost vector with the constant to the place behind it."""
    out = [(b, 0)]
    for code in reversed(codes):
        out.append(_back(code, out[-1][0]))
    return out[::-1]


def chunk_trace(codes: bytes, b: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least cheapest edits of a chunk entered in ``state``, and the state it is left in. Costs to go decide at
    every step: the least letter whose cost and rest add up to what is to pay."""
    at, out = _vectors(codes, b), []
    for i, code in enumerate(codes):
        here, step = at[i]
        behind = at[i + 1][0]
        for _ in range(4):
            need = here[state] + step
            edits = {letter: t for letter, c, t in _edits(code, state) if c + behind[t] == need}
            if "D" in edits:
                out.append("D")
                break
            written = NEXT[state][WRITES[state]]
            if INSERT + here[written] == here[state]:
                out.append("I")
                state = written
                continue
            letter = "K" if "K" in edits else "R"
            out.append(letter)
            state = edits[letter]
            break
    while last and state not in (START, ASSISTANT):
        out.append("I")
        state = NEXT[state][WRITES[state]]
    return "".join(out), state


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs chunks, or runs them again where what lies behind them has become known (``next``)."""
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        behind, front, total, changed = [], [], [], []
        for codes, old, first, done, now in zip(cols["codes"], cols["behind"], cols["front"], cols["total"], cols["next"]):
            start = tuple(now) if now is not None else tuple(old) if old is not None else END
            if first is None:
                f, t = chunk_back(codes, start)
            else:
                f, t = chunk_again(codes, start, tuple(old), tuple(first), done)
            behind.append(start), front.append(f), total.append(t), changed.append(first is None or f != tuple(first))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), batch.column("codes"), batch.column("last"), pa.array(behind, pa.list_(pa.int64())),
                                          pa.array(front, pa.list_(pa.int64())), pa.array(total, pa.int64()), pa.array(changed, pa.bool_())],
                                         ["conv", "chunk", "codes", "last", "behind", "front", "total", "changed"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk run from every state alone: 16 costs, row by row of the state before it."""
    for batch in batches:
        out = []
        for codes in batch.column("codes").to_pylist():
            runs = [chunk_back(codes, tuple(0 if s == t else FAR for s in range(4))) for t in range(4)]
            out.append([min(f[s] + t, FAR) for s in range(4) for f, t in runs])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(out, pa.list_(pa.int64()))], ["conv", "chunk", "m"])


def _product(a: Column, b: Column) -> Column:
    """Shortest ways through two runs of chunks."""
    cell = lambda i: F.least(F.lit(FAR), *[F.element_at(a, i // 4 * 4 + k + 1) + F.element_at(b, 4 * k + i % 4 + 1) for k in range(4)])
    return F.array(*[cell(i) for i in range(16)])


def _composed(rows: DataFrame, value: str, compose, rounds: int, forward: bool) -> DataFrame:
    """``conv``, ``chunk`` and ``value`` composed over all chunks of the conversation from a chunk on (``forward``), or up
    to it, by doubling: in each round a chunk takes over what the one ``2**k`` further has."""
    held = cut_lineage(rows.select("conv", "chunk", F.col(value).alias("v")))
    for k in range(rounds):
        other = held.select(F.col("conv").alias("oc"), (F.col("chunk") + (-(1 << k) if forward else 1 << k)).alias("ok"), F.col("v").alias("o"))
        met = held.join(other, (F.col("conv") == F.col("oc")) & (F.col("chunk") == F.col("ok")), "left")
        first, second = ("v", "o") if forward else ("o", "v")
        held = cut_lineage(met.select("conv", "chunk", F.when(F.col("o").isNull(), F.col("v")).otherwise(compose(F.col(first), F.col(second))).alias("v")))
    return held.withColumnRenamed("v", value)


RUN = "conv string, chunk long, codes binary, last boolean, behind array<long>, front array<long>, total long, changed boolean"


def backward(chunks: DataFrame, passes: int = 6) -> DataFrame:
    """``chunks`` (``conv``, ``chunk``, ``codes``, ``last``) with ``behind`` and ``front``, the true cost vectors after and
    before each, less a constant, and ``total``, what the chunk adds to it.

    All chunks start at once from the vector that ends a conversation, a guess for all but the last. Then each gets the
    vector its right neighbour arrived at, and reruns if that differs by more than a constant from what it started from;
    a rerun ends where it meets the earlier run. Passes go on until no vector changes. Rows of alternating roles agree
    after a few steps; a conversation that still changes after ``passes`` passes (say, users only) gets the exact
    transitions of its chunks, composed by doubling, so that the number of rounds grows with the logarithm of its length.
    """
    empty = [F.lit(None).cast("array<long>").alias(c) for c in ("behind", "front", "next")]
    held = cut_lineage(chunks.select("*", *empty, F.lit(None).cast("long").alias("total")).mapInArrow(_run, RUN))
    many = held.where(~F.col("last")).select("conv").distinct()
    open_ = cut_lineage(held.join(many, "conv", "left_semi"))
    done = held.join(many, "conv", "left_anti")
    for _ in range(passes):
        if not open_.take(1):
            return done.drop("changed")
        right = open_.select(F.col("conv").alias("oc"), (F.col("chunk") - 1).alias("ok"), F.col("front").alias("next"))
        met = open_.join(right, (F.col("conv") == F.col("oc")) & (F.col("chunk") == F.col("ok")), "left")
        met = met.withColumn("next", F.coalesce("next", "behind"))
        open_ = cut_lineage(met.select("conv", "chunk", "codes", "last", "behind", "front", "total", "next").mapInArrow(_run, RUN))
        moving = open_.where("changed").select("conv").distinct()
        done = done.unionByName(open_.join(moving, "conv", "left_anti"))
        open_ = cut_lineage(open_.join(moving, "conv", "left_semi"))
    if not open_.take(1):
        return done.drop("changed")
    longest = open_.groupBy("conv").agg((F.max("chunk") - F.min("chunk") + 1).alias("n")).agg(F.max("n")).first()[0]
    ways = open_.select("conv", "chunk", "codes").mapInArrow(_matrices, "conv string, chunk long, m array<long>")
    ways = _composed(ways, "m", _product, (longest - 1).bit_length(), True)
    reach = lambda s: F.least(*[F.element_at("m", 4 * s + k + 1) + F.lit(int(END[k])) for k in range(4)])
    costs = F.array(*[reach(s) for s in range(4)])
    known = ways.select("conv", (F.col("chunk") - 1).alias("chunk"), F.transform(costs, lambda x: F.least(x - F.array_min(costs), F.lit(FAR))).alias("next"))
    met = open_.join(known, ["conv", "chunk"], "left").withColumn("next", F.coalesce("next", F.array(*[F.lit(int(x)).cast("long") for x in END])))
    exact = met.select("conv", "chunk", "codes", "last", "behind", "front", "total", "next").mapInArrow(_run, RUN)
    return cut_lineage(done.unionByName(exact)).drop("changed")


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of a chunk from each state that it may be entered in (from the start alone where it is the first)."""
    for batch in batches:
        edits, exits = [], []
        for codes, behind, last, first in zip(*(batch.column(c).to_pylist() for c in ("codes", "behind", "last", "first"))):
            found = [chunk_trace(codes, tuple(behind), s, last) for s in range(1 if first else 4)]
            found += [found[0]] * (4 - len(found))
            edits.append([e for e, _ in found]), exits.append([x for _, x in found])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(edits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int64()))], ["conv", "chunk", "edits", "exits"])


def traced(chunks: DataFrame) -> DataFrame:
    """``conv``, ``chunk``, ``state`` (in which the chunk is entered) and ``edits``, the letters of its rows and insertions."""
    firsts = chunks.groupBy("conv").agg(F.min("chunk").alias("c0"), F.max("chunk").alias("c1"))
    base = chunks.join(firsts, "conv").withColumn("first", F.col("chunk") == F.col("c0"))
    found = cut_lineage(base.select("conv", "chunk", "codes", "behind", "last", "first").mapInArrow(_traces, "conv string, chunk long, edits array<string>, exits array<long>"))
    many = firsts.where("c1 > c0")
    longest = many.agg(F.max(F.col("c1") - F.col("c0") + 1)).first()[0]
    if longest is None:
        return found.select("conv", "chunk", F.lit(START).alias("state"), F.element_at("edits", 1).alias("edits"))
    part = found.join(many.select("conv", "c0"), "conv")
    after = lambda f, g: F.transform(f, lambda s: F.element_at(g, (s + 1).cast("int")))
    upto = _composed(part, "exits", after, (longest - 1).bit_length(), False)
    entered = upto.select("conv", (F.col("chunk") + 1).alias("chunk"), F.element_at("exits", 1).alias("state"))
    out = found.select("conv", "chunk", "edits").join(entered, ["conv", "chunk"], "left").withColumn("state", F.coalesce("state", F.lit(START)).cast("int"))
    return out.select("conv", "chunk", "state", F.element_at("edits", F.col("state") + 1).alias("edits"))


def _classed(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows in order with ``at`` and ``chunk``, and their slim classes: which fault comes first, and the code of the search."""
    missing = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    key = F.when(conv.isNull(), "").otherwise(F.concat(F.lit(":"), conv.cast("string")))
    base = rows.select(key.alias("conv"), turn.alias("turn"), missing(role).alias("role"), missing(text).alias("text"))
    tie = F.sha2("text", 256)  # of bounded length, as range bounds are sampled on the driver
    placed = in_order(base.withColumn("digest", tie), [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "at")
    placed = placed.withColumn("chunk", F.expr(f"at div {chunk_rows}"))
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    slim = placed.select("conv", "turn", "chunk", "at", "role", "digest", F.left("role", F.lit(1)).alias("initial"), (F.length(F.rtrim(F.col("text"), F.lit(BLANKS))) == 0).alias("blank"),
                         (~end.isin(".", "!", "?")).alias("open"))
    slim = cut_lineage(slim)
    said = slim.where(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = slim.join(said, ["conv", "role", "digest"], "left").withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
    met = met.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
    letter = F.coalesce(*[F.when(F.col("initial") == x, i) for i, x in enumerate(LETTERS[:3])], F.lit(3))
    code = letter + F.when(F.col("blank") | F.col("duplicate"), 4).otherwise(0) + F.when(F.col("truncated"), 8).otherwise(0)
    return placed, met.select("conv", "turn", "chunk", "at", "blank", "duplicate", "truncated", code.alias("code"))


def _chunked(classes: DataFrame) -> DataFrame:
    """One row per (``conv``, ``chunk``): the rows' ``codes``, pairs of initials that may not follow each other, both ends."""
    codes = F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"])
    chunks = classes.groupBy("conv", "chunk").agg(codes.alias("list"))
    letter = lambda x: x.bitwiseAND(3)
    legal = lambda a, b: F.concat(a, F.lit("|"), b).isin("0|1", "1|2", "2|1")
    bad = lambda a, b: F.when(legal(a.cast("string"), b.cast("string")), 0).otherwise(1).cast("long")
    inside = F.aggregate(F.slice("list", 2, F.size("list")), F.struct(letter(F.element_at("list", 1)).alias("before"), F.lit(0).cast("long").alias("n")),
                         lambda s, x: F.struct(letter(x).alias("before"), (s["n"] + bad(s["before"], letter(x))).alias("n")))["n"]
    codes = F.unhex(F.array_join(F.transform("list", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    chunks = chunks.select("conv", "chunk", codes.alias("codes"), inside.alias("illegal"), letter(F.element_at("list", 1)).alias("head"), letter(F.element_at("list", -1)).alias("tail"))
    chunks = cut_lineage(chunks)
    right = chunks.select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("head").alias("following"))
    met = chunks.join(right, ["conv", "chunk"], "left")
    between = F.when(F.col("following").isNotNull(), bad(F.col("tail"), F.col("following"))).otherwise(0)
    return met.select("conv", "chunk", "codes", F.col("following").isNull().alias("last"), (F.col("illegal") + between).alias("illegal"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of repaired conversations from rows in order, each chunk led by its edits; nothing but a batch is held."""
    conv, letters, state, place = None, iter(()), START, 0

    def insertions(out: list) -> str:
        """Writes what is inserted next; the letter of the row that follows, or none at the end of a chunk."""
        nonlocal state, place
        for letter in letters:
            if letter != "I":
                return letter
            out.append((conv, place, ROLES[WRITES[state]].encode(), b""))
            state, place = NEXT[state][WRITES[state]], place + 1
        return ""

    for batch in batches:
        out: list = []
        cols = [batch.column(c).to_pylist() for c in ("conv", "edits", "state")]
        texts = [batch.column(c).cast(pa.large_binary()).to_pylist() for c in ("role", "text")]
        for c, edits, entered, role, text in zip(*cols, *texts):
            if edits is not None:
                insertions(out)
                if c != conv:
                    conv, place = c, 0
                letters, state = iter(edits), entered
                continue
            letter = insertions(out)
            if letter == "D":
                continue
            if letter == "R":
                role = ROLES[WRITES[state]].encode()
            out.append((conv, place, role, text))
            state, place = NEXT[state][role[:1].decode()], place + 1
        yield _lines(out)
    out = []
    insertions(out)
    yield _lines(out)


LINES = "conv string, place long, role binary, text binary"


def _lines(out: list) -> pa.RecordBatch:
    cols = list(zip(*out)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["conv", "place", "role", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, h = None, None
    shown = lambda found: pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["conv", "repaired_sha256"])
    for batch in _apply(batches):
        found = []
        for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "place", "role", "text"))):
            if c != conv:
                if h is not None:
                    found.append((conv, h.hexdigest()))
                conv, h = c, hashlib.sha256()
            h.update((b"\n" if place else b"") + role + b":" + text)
        yield shown(found)
    yield shown([(conv, h.hexdigest())] if h is not None else [])


def _in_turn(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """Chunks' edits, each followed by the chunk's rows: the input of ``_apply``."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    lead = edits.select("conv", "chunk", F.lit(-1).cast("long").alias("at"), "edits", "state", none("string", "role"), none("string", "text"))
    rows = placed.select("conv", "chunk", "at", none("string", "edits"), none("int", "state"), "role", "text")
    both = lead.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "chunk", "at")
    return both.select("conv", "edits", "state", "role", "text")


def _solved(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, chunk_rows: int, passes: int):
    placed, classes = _classed(rows, F.col(conv_col), F.col(turn_col), F.col(role_col), F.col(text_col), chunk_rows)
    classes = cut_lineage(classes)
    chunks = cut_lineage(_chunked(classes))
    solved = backward(chunks.select("conv", "chunk", "codes", "last"), passes)
    return placed, classes, chunks, solved, cut_lineage(traced(solved))


def repaired_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  chunk_rows: int = 4096, passes: int = 6) -> DataFrame:
    """The repaired conversations: ``conv_col`` (as text), ``place``, ``role`` and ``text``."""
    placed, *_, edits = _solved(rows, conv_col, turn_col, role_col, text_col, chunk_rows, passes)
    lines = _in_turn(placed, edits).mapInArrow(_apply, LINES)
    return lines.select(F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).alias(conv_col), "place", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def repair(rows: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           chunk_rows: int = 4096, passes: int = 6) -> DataFrame:
    """One row per conversation of ``ids`` (by default of ``rows``): its faults, the cheapest repair and what it gives.

    Rows of a conversation come by turn (null first), rows of one turn by role and SHA-256 of the text; null roles and
    texts are one space; null is a conversation of its own. A row's first fault counts: ``blank``, ``duplicate`` (role and
    text of an earlier row), ``truncated`` (its last character ends no sentence). ``gaps`` are missing turns, ``illegal``
    adjacent rows whose roles' initials are not su, ua or au. Edits keep a row, give it the role user or assistant (3),
    delete it (4; blank and duplicate rows must go) or insert an empty row (3); a truncated row that stays costs 3 more.
    ``audit`` holds the initials of the cheapest edits after which the initials read (s?(ua)+)?, ties to the ASCII-least;
    ``repaired_sha256`` is the digest of the ``role:text`` lines. Conversations without rows have zeros, an empty audit
    and the digest of nothing. An empty table gives no rows; other columns, whatever their names, are not read.

    A conversation may hold any share of the rows: order comes from one range exchange, the search holds a chunk of
    ``chunk_rows`` rows at most, and the digest, which is sequential by nature, streams through sorted rows.
    """
    placed, classes, chunks, solved, edits = _solved(rows, conv_col, turn_col, role_col, text_col, chunk_rows, passes)
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    faults = classes.groupBy("conv").agg(count("blank"), count("duplicate"), count("truncated"))
    turns = classes.select("conv", "turn").distinct().groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    entry = F.min_by(F.element_at("front", START + 1), "chunk")
    costs = solved.groupBy("conv").agg((F.sum("total") + entry).alias("cost"))
    pairs = chunks.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    audit = edits.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "edits"))), lambda x: x["edits"]), "").alias("audit"))
    digests = _in_turn(placed, edits).mapInArrow(_digests, "conv string, repaired_sha256 string")
    key = lambda c: F.when(c.isNull(), "").otherwise(F.concat(F.lit(":"), c.cast("string")))
    out = (rows if ids is None else ids).select(conv_col).distinct().withColumn("__conv", key(F.col(conv_col)))
    found = faults
    for other in (turns, costs, pairs, audit):
        found = found.join(other, "conv")
    found = found.join(digests, "conv", "left")
    out = out.join(found, F.col("__conv") == F.col("conv"), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(conv_col, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
