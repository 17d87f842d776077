"""One registered query per operator, over whole tables, with a SQL twin where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from augury.llm import ann, dialogue, exact_dedup, html_text, line_dedup, merkle, mixing, packing, postings, secrets, simhash, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@_query
def op1_ann(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest(_table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op2_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_copies(_table(spark, d, "documents"))


ORACLES["op2_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
h AS (SELECT doc_id, length(body) AS n, sha256(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM h
"""


@_query
def op3_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    m = line_dedup.drop_common_lines(_table(spark, d, "documents"))
    return m.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept_text", 256).alias("kept_sha256"))


ORACLES["op3_line_dedup"] = r"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM r),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
c AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.k = c.k GROUP BY rid
"""


@_query
def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    m = mixing.mix(_table(spark, d, "documents"))
    return m.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


ORACLES["op4_mixing"] = r"""
WITH t AS (SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][(rk % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
u AS (SELECT *, coalesce(sum(cap) OVER b, 0.0) AS capped, coalesce(sum(weight) OVER b, 0.0) AS used,
             1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS goal, sum(weight) OVER () AS heft
      FROM w WINDOW b AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (goal - capped) / (heft - used) AS lev FROM u),
g AS (SELECT *, lev * weight <= cap AS free FROM l),
p AS (SELECT source, source_size, CASE WHEN free THEN weight * max(CASE WHEN free THEN lev END) OVER () ELSE cap END AS target FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM p),
k AS (SELECT source, k, sum(size)::BIGINT AS words FROM t GROUP BY source, k),
c AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY k))::BIGINT - words AS before FROM k)
SELECT t.doc_id, t.size, e.source_size, e.target,
       (epochs * t.size + CASE WHEN before >= floor(target)::BIGINT - epochs * source_size THEN 0
            WHEN before + words <= floor(target)::BIGINT - epochs * source_size THEN t.size
            ELSE (floor(target)::BIGINT - epochs * source_size - before) * t.size // greatest(words, 1) END)::BIGINT AS taken
FROM t JOIN e ON t.source IS NOT DISTINCT FROM e.source JOIN c ON t.source IS NOT DISTINCT FROM c.source AND t.k = c.k
"""


@_query
def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    m = simhash.near_copies(_table(spark, d, "documents"))
    return m.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op5_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"))


@_query
def op6_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Independent evidence stands in for findings labelled by hand (``secrets.evidence``): findings without any are scored
    and not taught. Labels are read for four documents of five."""
    docs = _table(spark, d, "documents")
    return secrets.scan(docs, secrets.evidence(), ~toxicity.held_out(F.col("id")))


def _day(*parts: str):
    return F.conv(F.substring(F.md5(F.concat(*[F.lit(x) if x.endswith(":") else F.col(x) for x in parts])), 1, 7), 16, 10).cast("int")


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts of ``pages``: hosts are listed, delisted and listed again, their parent domains
    are listed, and some paths are allowed. Dates follow from hashes of the hosts."""
    host = pages.select(url_filter.url_parts(F.col("url"))[0].alias("host")).where("host <> ''").distinct()
    h = host.select("host", (_day("a:", "host") % 400).alias("a"), (_day("b:", "host") % 200 + 30).alias("b"), (_day("c:", "host") % 100 + 20).alias("c"), (_day("e:", "host") % 600).alias("e"))
    at = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    row = lambda pattern, listed, action, n: F.struct(pattern.alias("pattern"), F.lit(listed).alias("list"), F.lit(action).alias("action"), at(n).alias("day"))
    a, ab, abc = F.col("a"), F.col("a") + F.col("b"), F.col("a") + F.col("b") + F.col("c")
    rows = [row(F.col("host"), "hosts", "block", a), row(F.col("host"), "hosts", "remove", ab), row(F.col("host"), "hosts", "block", abc),
            row(F.concat("host", F.lit("/en/")), "paths", "allow", F.col("e")), row(F.regexp_replace("host", r"^[^.]+\.", ""), "domains", "block", F.col("e") + F.col("c"))]
    return h.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@_query
def op7_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), _day("f:", "page_id") % 730))
    out = url_filter.filter_urls(captures, list_entries(pages))
    return out.select("page_id", "url", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), F.col("__verdict").alias("verdict"), F.col("__pattern").alias("pattern"), F.col("__list").alias("list"))


ORACLES["op7_url_filter"] = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + (('0x' || substr(md5('f:' || page_id::VARCHAR), 1, 7))::INT % 730) AS day,
                  rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host, ('0x' || substr(md5('a:' || host), 1, 7))::INT % 400 AS a, ('0x' || substr(md5('b:' || host), 1, 7))::INT % 200 + 30 AS b,
             ('0x' || substr(md5('c:' || host), 1, 7))::INT % 100 + 20 AS c, ('0x' || substr(md5('e:' || host), 1, 7))::INT % 600 AS e FROM p WHERE host <> ''),
r AS (SELECT host AS pattern, 'hosts' AS list, 'block' AS action, a AS n FROM h UNION ALL SELECT host, 'hosts', 'remove', a + b FROM h
      UNION ALL SELECT host, 'hosts', 'block', a + b + c FROM h UNION ALL SELECT host || '/en/', 'paths', 'allow', e FROM h
      UNION ALL SELECT regexp_replace(host, '^[^.]+\.', ''), 'domains', 'block', e + c FROM h),
v AS (SELECT pattern, list, n, max(action) AS verdict FROM r GROUP BY ALL),
w AS (SELECT pattern, list, verdict, DATE '2024-01-01' + n::INT AS s, DATE '2024-01-01' + (lead(n) OVER (PARTITION BY pattern, list ORDER BY n))::INT AS e FROM v),
x AS (SELECT *, string_split(host, '.') AS hs, string_split(CASE WHEN path = '' THEN '/' ELSE path END, '/') AS ps FROM p),
q AS (SELECT DISTINCT page_id, day, array_to_string(hs[i:], '.') || CASE WHEN j = 0 THEN '' ELSE array_to_string(ps[:j], '/') || '/' END AS pattern
      FROM x, unnest(range(1, len(hs) + 1)) AS a(i), unnest(range(0, len(ps))) AS b(j) WHERE host <> ''),
m AS (SELECT q.page_id, w.verdict, w.pattern, w.list, row_number() OVER (PARTITION BY q.page_id ORDER BY length(w.pattern) DESC, w.pattern, w.verdict, w.list) AS n
      FROM q JOIN w ON q.pattern = w.pattern AND w.s <= q.day AND (w.e IS NULL OR q.day < w.e) WHERE w.verdict <> 'remove')
SELECT p.page_id, p.url, strftime(p.day, '%Y-%m-%d') AS fetched, m.verdict, m.pattern, m.list FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1
"""


@_query
def op9_html(spark: SparkSession, d: str) -> DataFrame:
    m = html_text.extract(_table(spark, d, "pages"))
    return m.select("page_id", "url", F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))


@_query
def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    m = toxicity.toxicity(_table(spark, d, "documents"), _table(spark, d, "labels"))
    return m.select("doc_id", F.col("__held_out").alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def altered_rows(id_: Column, one_in: int = 3) -> Column:
    """The rows of the tampering test: unsigned crc32 of the decimal id divisible by ``one_in``; null ids are left alone."""
    return F.crc32(id_.cast("string").cast("binary")) % one_in == 0


@_query
def op12_merkle(spark: SparkSession, d: str) -> DataFrame:
    """Every document's proof, checked against a copy of the table in which a third of the texts are lower-cased."""
    docs = _table(spark, d, "documents")
    m = merkle.manifest(docs, altered={"text": F.translate("text", ascii_uppercase, ascii_lowercase)}, where=altered_rows(F.col("doc_id")))
    return m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                    F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


# CRC-32 of a string of ASCII characters, from its table of bytes.
_CRC = """table_crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i))"""
_crc = lambda s: f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({s}, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)))"

ORACLES["op12_merkle"] = rf"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, lang, source, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
             coalesce({_crc('doc_id::VARCHAR')} % 3 = 0, false) AS tampered FROM documents, table_crc),
f AS (SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                       coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM d),
h AS (SELECT doc_id, lang, tampered, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS forged FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h),
t AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT lang FROM l)),
leaves AS (SELECT l.*, t.t FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang),
up AS (SELECT t, 0 AS lv, i, n, leaf AS h FROM leaves UNION ALL
       SELECT t, lv + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY t, lv, i // 8),
sub AS (SELECT t, h AS subroot FROM up WHERE n = 1),
top AS (SELECT 100 AS lv, t AS i, (SELECT count(*) FROM sub) AS n, subroot AS h FROM sub UNION ALL
        SELECT lv + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lv, i // 8),
anc AS (SELECT doc_id, leaf, tampered, forged, t, 0 AS lv, i, n FROM leaves UNION ALL
        SELECT doc_id, leaf, tampered, forged, t, CASE WHEN lv < 100 AND n = 1 THEN 100 ELSE lv + 1 END,
               CASE WHEN lv < 100 AND n = 1 THEN t ELSE i // 8 END, CASE WHEN lv < 100 AND n = 1 THEN (SELECT count(*) FROM sub) ELSE (n + 7) // 8 END
        FROM anc WHERE lv < 100 OR n > 1),
every AS (SELECT t, lv, i, h FROM up UNION ALL SELECT -1, lv, i, h FROM top),
seg AS (SELECT a.doc_id, a.leaf, a.lv, string_agg(e.h, '' ORDER BY e.i) FILTER (WHERE e.i < a.i) AS b, string_agg(e.h, '' ORDER BY e.i) FILTER (WHERE e.i > a.i) AS c
        FROM anc a JOIN every e ON e.t = CASE WHEN a.lv < 100 THEN a.t ELSE -1 END AND e.lv = a.lv AND e.i // 8 = a.i // 8
        WHERE a.n > 1 GROUP BY a.doc_id, a.leaf, a.lv),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY lv) AS k FROM (SELECT doc_id, leaf, lv, coalesce(b, '') AS b, coalesce(c, '') AS c FROM seg)),
fold AS (SELECT doc_id, leaf, 0::BIGINT AS k, CASE WHEN tampered THEN forged ELSE leaf END AS h, '' AS p FROM leaves UNION ALL
         SELECT f.doc_id, f.leaf, s.k, sha256(s.b || f.h || s.c), f.p || s.b || s.c FROM fold f JOIN s ON f.doc_id = s.doc_id AND f.leaf = s.leaf AND s.k = f.k + 1),
done AS (SELECT doc_id, leaf, arg_max(h, k) AS folded_root, sha256(arg_max(p, k)) AS proof_sha256 FROM fold GROUP BY doc_id, leaf)
SELECT l.doc_id, l.leaf, sub.subroot, r.h AS root, done.proof_sha256, done.folded_root, done.folded_root = r.h AS verified
FROM leaves l JOIN sub ON l.t = sub.t JOIN done ON done.doc_id = l.doc_id AND done.leaf = l.leaf, (SELECT h FROM top WHERE n = 1) r
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by a hash of conversation and turn: rows dropped, emptied, cut off, repeated, or of the wrong role."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(k == 4, "user").otherwise(shown("role"))
    copies = F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(k != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@_query
def op13_dialogue(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "conversations")
    return dialogue.repair(damaged(rows), rows)


ORACLES["op13_dialogue"] = rf"""
WITH RECURSIVE {_CRC},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, table_crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM o, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) WHERE k <> 0),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS c, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM d),
f AS (SELECT *, t = '' AS blank, t <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before,
             count(*) OVER (PARTITION BY conv_id) AS n FROM i),
r AS (SELECT *, NOT blank AND NOT dup AND right(t, 1) NOT IN ('.', '!', '?') AS cut FROM f),
conv AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
                count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
ins(s, x, y) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
kept(s, c, y) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
-- best (cost, audit, lines) per state: a row with even step inserts up to two rows, one with odd step edits the next row
dp AS (SELECT conv_id, 0 AS step, 0 AS s, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS b, any_value(n) AS n FROM r GROUP BY conv_id UNION ALL
       SELECT conv_id, step + 1, s, min(b), any_value(n) FROM (
         SELECT dp.conv_id, step, dp.s, dp.b, n FROM dp WHERE step % 2 = 0 AND step <= 2 * n
         UNION ALL SELECT dp.conv_id, step, ins.y, {{'cost': b.cost + 3, 'audit': b.audit || 'I', 'lines': list_append(b.lines, ins.x || ':')}}, n FROM dp JOIN ins ON ins.s = dp.s WHERE step % 2 = 0 AND step <= 2 * n
         UNION ALL SELECT dp.conv_id, step, CASE ins.y WHEN 2 THEN 3 ELSE 2 END, {{'cost': b.cost + 6, 'audit': b.audit || 'II', 'lines': list_concat(b.lines, [ins.x || ':', CASE ins.y WHEN 2 THEN 'assistant:' ELSE 'user:' END])}}, n
           FROM dp JOIN ins ON ins.s = dp.s WHERE step % 2 = 0 AND step <= 2 * n
         UNION ALL SELECT dp.conv_id, step, dp.s, {{'cost': b.cost + 4, 'audit': b.audit || 'D', 'lines': b.lines}}, dp.n FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = step // 2 + 1 WHERE step % 2 = 1
         UNION ALL SELECT dp.conv_id, step, kept.y, {{'cost': b.cost + CASE WHEN cut THEN 3 ELSE 0 END, 'audit': b.audit || 'K', 'lines': list_append(b.lines, r.role || ':' || r.text)}}, dp.n
           FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = step // 2 + 1 JOIN kept ON kept.s = dp.s AND kept.c = r.c WHERE step % 2 = 1 AND NOT blank AND NOT dup
         UNION ALL SELECT dp.conv_id, step, ins.y, {{'cost': b.cost + 3 + CASE WHEN cut THEN 3 ELSE 0 END, 'audit': b.audit || 'R', 'lines': list_append(b.lines, ins.x || ':' || r.text)}}, dp.n
           FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = step // 2 + 1 JOIN ins ON ins.s = dp.s WHERE step % 2 = 1 AND NOT blank AND NOT dup
       ) GROUP BY conv_id, step, s),
best AS (SELECT conv_id, min(b) AS b FROM dp WHERE step = 2 * n + 1 AND s IN (0, 3) GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN conv ON a.conv_id IS NOT DISTINCT FROM conv.conv_id LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id
"""


@_query
def op11_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    m = postings.decontaminate(_table(spark, d, "documents"), _table(spark, d, "benchmark"))
    return m.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op11_decontaminate"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS gram FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(i) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM g),
p AS (SELECT rid, k, i, hash(list_aggregate(w[i:i + k - 1], 'string_agg', ' ')) AS h FROM d, k, unnest(range(1, len(w) - k + 2)) AS r(i) WHERE len(w) >= k),
hits AS (SELECT p.rid, p.i, p.k, g.item_id FROM p JOIN g ON p.k = g.k AND p.h = hash(g.gram)),
covered AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, k)) AS r(j) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, coalesce(item_id::VARCHAR, '') AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.rid = covered.rid LEFT JOIN named ON d.rid = named.rid
"""
