"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame functions and MLlib only."""
from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from augury.session import cut_lineage

# Characters of keys and tokens, and words that name one.
CANDIDATE = r"[A-Za-z0-9+/_=\-]{16,}"
NAMING = r"(?i)(token|secret|passw|pwd|api_?key|apikey|access|auth|credential|bearer|private|signature)"
# Forms that issuers give their keys, words that end in an assigned name, and words that announce a digest.
ISSUED = (r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[opsur]_[A-Za-z0-9]{36,}$|^github_pat_[A-Za-z0-9_]{22,}$|^glpat-[A-Za-z0-9_\-]{20,}$|^(sk|pk|rk)_(live|test)_[A-Za-z0-9]{16,}$"
          r"|^sk-[A-Za-z0-9_\-]{20,}$|^xox[abeoprs]-[A-Za-z0-9\-]{10,}$|^AIza[A-Za-z0-9_\-]{35}$|^eyJ[A-Za-z0-9_\-]{13,}$|^npm_[A-Za-z0-9]{36}$")
NAME_ENDS = r"(?i)(token|secret|passw(?:or)?d|passphrase|pwd|api_?key|access_?key|private_?key|auth|credentials?|bearer|signature)[a-z0-9_]*[\"'`]?\s*(?::=|=>|[=:])\s*[\"'`]?(?:bearer )?$"
DIGEST = r"(?i)\b(commit|sha-?(1|256|512)?|md5|checksum|digest|revision|etag|integrity|uuid)[\"'`]?\s*[=:]?\s*[\"'`]?$"
KINDS = ("lower", "upper", "digit", "other")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: ``id``, ``path``, ``place`` (index of its word), ``nth`` in that word, ``finding``, the three
    words before and the one after. Words are split at white space, over the whole text."""
    words = F.split(F.col(text_col), r"[\x20\x09-\x0D]+")
    # The words are bound to a name, so the text is split once, not once per word.
    spot = lambda ws: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (F.length(ws[i]) >= 16) & ws[i].rlike(CANDIDATE)),
        lambda i: F.struct(i.alias("place"), ws[i].alias("word"), *[F.coalesce(F.get(ws, i + d), F.lit("")).alias(n) for d, n in ((-3, "b3"), (-2, "b2"), (-1, "b1"), (1, "a1"))]))
    found = F.transform(F.array(words), spot)[0]
    d = docs.where(F.col(text_col).rlike(CANDIDATE)).select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.explode(found).alias("c"))
    d = d.select("id", "path", "c.*").select("*", F.posexplode(F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"), F.lit(1))).alias("nth", "finding"))
    return d


def dictionary(docs: DataFrame, text_col: str = "text", least_docs: int = 20) -> DataFrame:
    """Words of three letters or more, in lower case, that stand in ``least_docs`` documents of the corpus or more."""
    w = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(\p{L}{3,15})"), F.lit(1)))).alias("run"))
    return w.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs).select("run")


def _kind(c: Column) -> Column:
    return F.when(c.rlike("[a-z]"), "lower").when(c.rlike("[A-Z]"), "upper").when(c.rlike("[0-9]"), "digit").otherwise("other")


def features(found: DataFrame, known: DataFrame) -> tuple[DataFrame, list[str]]:
    """``found`` with one numeric column per feature: length; shares of character kinds and of the changes between them;
    distinct characters; share of letters in dictionary words; path; and the words around."""
    text = F.col("finding")
    n = F.length(text)
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    # Replaces each run of a kind by one letter: the length left counts the changes.
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "1"), "[^aB1]+", "-")
    pairs = {"lower_digit": "a1", "digit_lower": "1a", "upper_digit": "B1", "digit_upper": "1B", "lower_upper": "aB", "upper_lower": "Ba"}
    cols = {"length": n, "lower": kept("[^a-z]") / n, "upper": kept("[^A-Z]") / n, "digit": kept("[^0-9]") / n, "other": kept("[A-Za-z0-9]") / n, "hexadecimal": (kept("[0-9a-fA-F]") == 0),
            "changes": F.length(runs) / n, "distinct": F.size(F.array_distinct(F.split(text, ""))) / n}
    cols |= {k: (F.length(runs) - F.length(F.replace(runs, F.lit(v), F.lit("")))) / 2 / n for k, v in pairs.items()}
    before = F.concat_ws(" ", "b3", "b2", "b1")
    cols |= {"named": F.concat_ws(" ", before, "word").rlike(NAMING), "assigned": before.rlike(r"[=:]\s*$") | F.col("word").rlike(r"[=:]"), "quoted": F.col("word").rlike("[\"'`]"),
             "part": F.col("word").rlike("[./@]"), "first_before": F.pmod(F.xxhash64(F.lower("b1")), F.lit(64)), "second_before": F.pmod(F.xxhash64(F.lower("b2")), F.lit(64)),
             "after": F.pmod(F.xxhash64(F.lower("a1")), F.lit(64)), "path": F.pmod(F.xxhash64(F.coalesce(F.col("path").cast("string"), F.lit(""))), F.lit(64)),
             "path_code": F.coalesce(F.col("path").cast("string"), F.lit("")).rlike(r"(?i)\.(py|js|ts|java|go|rb|env|ya?ml|json|toml|ini|cfg|conf|sh|tf)$")}
    d = found.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{k}") for k, c in cols.items()])
    # Dictionary coverage is looked up once per distinct finding.
    each = found.select("finding").distinct().select("finding", F.explode(F.regexp_extract_all(F.lower("finding"), F.lit(r"([a-z]{3,})"), F.lit(1))).alias("run"))
    cover = each.join(known, "run").groupBy("finding").agg(F.sum(F.length("run")).alias("covered"))
    d = d.join(cover, "finding", "left").withColumn("f_dictionary", F.coalesce(F.col("covered"), F.lit(0)) / F.length("finding")).drop("covered")
    return d, [c for c in d.columns if c.startswith("f_")]


def evidence() -> Column:
    """A label over the columns of ``candidates``: true, false or, without evidence of either, null.

    True: the form of a known issuer, or any alphabet with letters and digits (or both cases) assigned to a naming word,
    with or without spaces and quotes. False: plain numbers, runs of letters in one case or of capitalised words, one repeated character, pieces of
    paths or addresses, and digests that a word such as commit or checksum announces. What an issuer's form says comes first, then
    the assignment to a naming word.
    """
    text = F.col("finding")
    # The pattern for candidates may take the name and the sign with the value: name=value is one finding.
    value = F.when(text.rlike(r"^[A-Za-z_\-]+=[^=]"), F.regexp_replace(text, r"^[A-Za-z_\-]+=", "")).otherwise(text)
    own = F.split_part(F.col("word"), value, F.lit(1))  # what stands before the value in its word
    before = F.concat_ws(" ", "b3", "b2", "b1", own)
    mixed = (value.rlike("[0-9]") & value.rlike("[A-Za-z]")) | (value.rlike("[a-z]") & value.rlike("[A-Z]") & ~value.rlike("^([A-Z]?[a-z]+[_-]?)+$"))
    plain = value.rlike(r"^[0-9_\-]+$") | value.rlike(r"^([A-Z]?[a-z]+[_/=-]*)+$|^[A-Z_/=-]+$") | value.rlike(r"^(.)\1*$")
    path = F.col("word").rlike(r"://|^[\"'`(]?(\.{0,2}|~)/[\w.-]+/") | value.rlike(r"^([A-Za-z_-]{2,}/){2,}")
    return (F.when(value.rlike(ISSUED), True).when(mixed & before.rlike(NAME_ENDS), True)
            .when(plain | path | before.rlike(DIGEST), False))


def scan(docs: DataFrame, label: Column, learn: Column, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", most_labelled: int = 50_000, trees: int = 30, depth: int = 6, least: float = 0.5) -> DataFrame:
    """Every candidate with its ``probability`` of being a secret and the verdict ``secret`` (``least`` or more).

    ``label`` (true, false or null) is the finding label over the columns of ``candidates``, such as a joined review
    column; it is read only where ``learn`` holds. The forest learns from labelled findings, drawn by hash to
    ``most_labelled`` expected rows of each class; every candidate is scored. With labels of one class only, or none,
    the probability is the share of true labels, or 0.5. Null and empty texts have no candidates; equal findings at
    different places are rows of their own; rows that repeat are scanned each; an empty table gives no rows.
    """
    found = cut_lineage(candidates(docs, id_col, text_col, path_col))
    d, names = features(found, dictionary(docs, text_col))
    d = cut_lineage(VectorAssembler(inputCols=names, outputCol="features").transform(d).drop(*names))
    taught = d.where(learn).select("features", label.cast("double").alias("label"), F.xxhash64("id", "place", "nth", "finding").alias("h")).where("label IS NOT NULL")
    seen = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    place = [F.col("id").alias(id_col), "place", "nth", "finding"]
    if len(seen) < 2:
        share = 0.5 if not seen else max(seen)
        return d.select(*place, F.lit(float(share)).alias("probability"), F.lit(share >= least).alias("secret"))
    bound = F.element_at(F.create_map(*[F.lit(x) for k, n in seen.items() for x in (k, -2**63 + int(2**64 * min(1.0, most_labelled / n)) - 1)]), F.col("label"))
    sample = cut_lineage(taught.where(F.col("h") <= bound).select("features", "label"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(sample)
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(d).select(*place, p.alias("probability"), (p >= least).alias("secret"))
