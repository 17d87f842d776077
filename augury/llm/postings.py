"""A distributed positional inverted index of whole texts, with exact phrase and proximity search."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from augury.session import cut_lineage

# Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased: digits, letters and all that is not ASCII.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


class _Terms(dict):
    """Hashes of words; forgets them when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 11) - 2**63
        return got


def _pieces(found: list[bytes], size: int, reach: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """A text cut into pieces that own ``size`` words each and hold ``reach`` more on both sides: where a piece and its own words begin."""
    if len(found) <= size:
        yield 0, 0, found
        return
    for own in range(0, len(found), size):
        lo = max(0, own - reach)
        yield lo, own, found[lo:own + size + reach]


def _index(size: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of about ``size`` words: a row per term with its places, and a row per piece of a text. Texts lie behind
        each other in the places of a segment, ``reach`` apart, so that no phrase crosses two."""
        terms, part, number, at, texts = _Terms(), TaskContext.get().partitionId(), 0, 0, 0
        hashes: list[np.ndarray] = []
        places: list[np.ndarray] = []
        held: list[tuple] = []

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal at, number
            h, p = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (hashes, places))
            order = np.argsort(h, kind="stable")
            h, p = h[order], p[order].astype(np.int32)
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
            ends = np.r_[starts[1:], len(h)]
            n, m = len(starts), len(held)
            cols = list(zip(*held))
            out = [pa.array([(part << 33) + number] * (n + m), pa.int64()), pa.array([*h[starts].tolist(), *[None] * m], pa.int64()),
                   pa.array([*(ends[:n] - starts).tolist(), *[None] * m], pa.int64()), pa.array([*(p[a:b].tobytes() for a, b in zip(starts, ends)), *[None] * m], pa.binary()),
                   *[pa.array([*[None] * n, *c], k) for c, k in zip(cols, [pa.int64(), kind, *[pa.int64()] * 5])]]
            hashes.clear(), places.clear(), held.clear()
            at, number = 0, number + 1
            return pa.RecordBatch.from_arrays(out, COLUMNS)

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
                found = words(text)
                for lo, own, piece in _pieces(found, size, reach):
                    if held and (at + len(piece) > size or len(held) >= 65536):
                        yield flush(kind)
                    held.append(((part << 33) + texts, id_, lo, own, min(own + size, len(found)), len(found), at))
                    if piece:
                        hashes.append(np.fromiter(map(terms.__getitem__, piece), np.int64, len(piece)))
                        places.append(np.arange(at, at + len(piece)))
                        at += len(piece) + reach
                texts += 1
        if held:
            yield flush(kind)
    return run


COLUMNS = ["segment", "term", "n", "postings", "row", "id", "lo", "own", "end", "n_words", "place"]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = 1_000_000, longest: int = 64, slop: int = 8) -> DataFrame:
    """The index of ``docs`` in the shared checkpoint folder, for phrases of up to ``longest`` words found with ``slop`` at most.

    Rows with a ``term`` hold its ``n`` ascending places (int32) in one ``segment``. Rows without one tell which text lies
    where: its ``row`` (a number of this index), ``id`` and ``n_words``; the piece begins at word ``lo`` of the text and at
    ``place`` of the segment, and owns the words from ``own`` to ``end``. A segment holds about ``segment_words`` places, so
    a term of any frequency has as many short rows as segments. Longer texts are cut into pieces that overlap but own
    different words. Terms are 64-bit hashes. Null and empty texts have no words; repeated rows are texts of their own.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = {"postings": "binary", "id": src.schema["id"].dataType.simpleString()}
    return cut_lineage(src.mapInArrow(_index(segment_words, longest + slop), ", ".join(f"{c} {kinds.get(c, 'long')}" for c in COLUMNS)))


def _phrase_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of ``size`` consecutive words of each item; an item of fewer words, but not none, is one window."""
        terms = _Terms()
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
                h = [terms[w] for w in words(text)]
                found = {tuple(h[i:i + size]) for i in range(max(1, len(h) - size + 1))} if h else ()
                keys = [xxhash.xxh64_intdigest(np.array(f, np.int64).tobytes(), len(f)) - 2**63 for f in found]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array([list(f) for f in found], pa.list_(pa.int64()))], ["item", "phrase", "terms"])
    return run


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """``item`` (the id as text, null as the empty one), ``phrase`` (hash) and ``terms`` of the windows of ``size`` words of every item."""
    item = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return items.select(item.alias("item"), F.col(text_col).alias("text")).mapInArrow(_phrase_rows(size), "item string, phrase long, terms array<long>")


def _near(places: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which of the ``wanted`` places lie within ``slop`` of one of the ascending ``places``."""
    return np.searchsorted(places, wanted + slop, "right") > np.searchsorted(places, wanted - slop, "left")


def occurrences(lists: dict[int, np.ndarray], terms: list[int], slop: int = 0) -> tuple[np.ndarray, int]:
    """Places of the phrase's rarest term where the whole phrase occurs, and that term's place in the phrase. Lists are
    intersected from the rarest on, each shifted by its term's place in the phrase."""
    order = sorted(range(len(terms)), key=lambda i: (len(lists.get(terms[i], ())), i))
    first = order[0]
    at = lists.get(terms[first], np.empty(0, np.int32)).astype(np.int64)
    for i in order[1:]:
        if not len(at):
            break
        at = at[_near(lists[terms[i]], at + (i - first), slop)]
    return at, first


def _found(left: pa.Table, right: pa.Table, slop: int):
    """The texts of a segment (arrays), and per phrase: its hash and length, and where it occurs (places, number of the text)."""
    is_text = left.column("term").is_null()
    lists = {t: np.frombuffer(p, np.int32) for t, p in zip(left.column("term").to_pylist(), left.column("postings").to_pylist()) if t is not None}
    texts = left.filter(is_text)
    texts = {c: texts.column(c).to_numpy() for c in ("row", "lo", "own", "end", "place")}
    order = np.argsort(texts["place"], kind="stable")
    order = order[texts["end"][order] > texts["own"][order]]  # texts without words have no place of their own
    texts = {c: x[order] for c, x in texts.items()}

    def hits():
        for phrase, terms in zip(right.column("phrase").to_pylist(), right.column("terms").to_pylist()):
            at, first = occurrences(lists, terms, slop)
            if len(at):
                yield phrase, len(terms), at - first, np.searchsorted(texts["place"], at, "right") - 1
    return texts, hits()


def _each(slop: int):
    names = ["row", "phrase", "start"]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            t, hits = _found(left, right, slop)
            for phrase, _, at, text in hits:
                start = at - t["place"][text] + t["lo"][text]
                mine = (np.maximum(start, 0) >= t["own"][text]) & (np.maximum(start, 0) < t["end"][text])
                out.append((t["row"][text][mine], np.full(int(mine.sum()), phrase, np.int64), start[mine]))
        return pa.table({n: pa.array(np.concatenate(c).astype(np.int64)) for n, c in zip(names, zip(*out))})
    return run


def _covered(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Per piece with hits: how many of its own words lie in an occurrence, and the phrases found."""
    rows, n_hit, phrases = [], [], []
    if left.num_rows and right.num_rows:
        t, hits = _found(left, right, 0)
        mask = np.zeros(int((t["place"] + t["end"] - t["lo"]).max(initial=0)) + 2**10, bool)
        found: dict[int, list[int]] = {}
        for phrase, length, at, text in hits:
            for i in range(length):
                mask[at + i] = True
            for x in np.unique(text).tolist():
                found.setdefault(x, []).append(phrase)
        for x, of in found.items():
            place, lo, own, end = (int(t[c][x]) for c in ("place", "lo", "own", "end"))
            rows.append(int(t["row"][x])), n_hit.append(int(mask[place + own - lo:place + end - lo].sum())), phrases.append(of)
    return pa.table({"row": pa.array(rows, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "phrases": pa.array(phrases, pa.list_(pa.int64()))})


def _met(index: DataFrame, phrases: DataFrame, most_broadcast: int):
    """Segments with the lists that phrases use, and the phrases that may occur in each.

    The distinct terms of phrases are broadcast while they are ``most_broadcast`` or fewer, else joined by shuffle. A
    phrase with a word that no text has goes at once; the others go to the segments in which their two rarest terms occur.
    """
    phrases = cut_lineage(phrases.groupBy("phrase").agg(F.first("terms").alias("terms")))
    used = cut_lineage(phrases.select(F.explode("terms").alias("used")).distinct())
    terms = index.where("term IS NOT NULL").join(F.broadcast(used) if used.count() <= most_broadcast else used, F.col("term") == F.col("used"), "left_semi")
    heads = cut_lineage(terms.select("segment", "term", "n"))
    frequency = heads.groupBy("term").agg(F.sum("n").alias("n"))
    each = phrases.select("phrase", F.explode(F.array_distinct("terms")).alias("term")).join(frequency, "term", "left")
    ranked = each.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("ranked"))
    known = ranked.where("ranked[0].n > 0").select("phrase", F.expr("ranked[0].term").alias("rarest"), F.expr("ranked[least(1, size(ranked) - 1)].term").alias("second"))
    known = cut_lineage(known.join(phrases, "phrase"))
    pairs = known.select("rarest", "second").distinct()
    held = heads.select("segment", "term")
    both = pairs.join(held.withColumnRenamed("term", "rarest"), "rarest").join(held.withColumnRenamed("term", "second"), ["segment", "second"])
    wanted = cut_lineage(both.join(known, ["rarest", "second"]).select(F.col("segment").alias("within"), "phrase", "terms"))
    texts = index.where("term IS NULL")
    cols = ["segment", "term", "postings", "row", "lo", "own", "end", "place"]
    left = terms.select(*cols).unionByName(texts.select(*cols)).join(wanted.select("within").distinct(), F.col("segment") == F.col("within"), "left_semi")
    return left.groupBy("segment").cogroup(wanted.groupBy("within"))


def matches(index: DataFrame, phrases: DataFrame, slop: int = 0, most_broadcast: int = 1_000_000) -> DataFrame:
    """Every occurrence of the ``phrases`` (``phrase``, ``terms``): ``row`` of the text, ``phrase`` and ``start``, its word.

    ``slop`` 0 finds exact phrases. With more, each term may lie that many words off its place beside the rarest term, in
    either direction; ``start`` is where the phrase would begin by the rarest term (below 0 at the start of a text).
    A segment is a task of bounded size that meets a phrase's lists in the order of their length.
    """
    return _met(index, phrases, most_broadcast).applyInArrow(_each(slop), "row long, phrase long, start long")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  size: int = 10, segment_words: int = 1_000_000, most_broadcast: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``n_hit``, ``items`` (sorted ids as text) and ``contaminated``.

    A window is ``size`` consecutive words of an item, or all words of a shorter one; every word of a text inside an
    occurrence of a window is hit, and ``items`` are those with a window in the text. Words are ASCII letters (lower-cased),
    digits and all other characters beyond ASCII. Null and empty texts have no words, items without words no window;
    repeated rows are texts of their own, items that share an id are one, a null id shows as an empty one. An empty table of
    texts gives no rows; without items nothing is hit; other columns, whatever their names, are not read.

    Texts with the same windows share one list of items, so a passage that many texts hold is looked up once.
    """
    index = build_index(docs, id_col, text_col, segment_words, size, 0)
    grams = cut_lineage(windows(items, item_col, item_text_col, size))
    found = _met(index, grams.select("phrase", "terms"), most_broadcast).applyInArrow(_covered, "row long, n_hit long, phrases array<long>")
    by_row = found.groupBy("row").agg(F.sum("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("phrases")))).alias("phrases"))
    by_row = cut_lineage(by_row.withColumn("set", F.md5(F.array_join(F.transform("phrases", lambda x: x.cast("string")), ","))))
    sets = by_row.groupBy("set").agg(F.first("phrases").alias("phrases"))
    of = grams.select("phrase", "item").distinct()
    named = sets.select("set", F.explode("phrases").alias("phrase")).join(of, "phrase").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = by_row.select("row", "n_hit", "set").join(named, "set").select("row", "n_hit", "items")
    out = index.where("term IS NULL AND own = 0").select("row", "id", "n_words").join(hit, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))
