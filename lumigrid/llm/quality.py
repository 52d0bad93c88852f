"""Quality rules: counts of bad signs, and a hashed n-gram likelihood ratio.

The ratio is taken between two multinomials over hashed features of the words
(the word, the pair with its successor, its last three characters): one of
trusted documents, one of the raw corpus. A document's score is the mean log
ratio of its features, so it does not depend on length, and a document is kept
when its score reaches a fixed threshold. Everything is DataFrame expressions.

Defined cases: a null or empty text has no words, scores 0 and fails; repeated
rows are judged one by one, and rows that share a doc_id are all trusted if it
is; rows without a doc_id are not; an empty corpus gives no rows; without trusted
documents the target is uniform and the ratio still is defined; input columns of
the result's names are replaced, all others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class QualityRules:
    buckets: int = 1 << 13
    min_score: float = -0.2
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: trusted ids are broadcast up to this many rows, and joined by shuffle beyond
    broadcast_rows: int = 1_000_000


def word_array(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def _part(array: str, start: int, less: int) -> Column:
    """``array`` from position ``start`` (from 1), as long as the words less ``less``."""
    return F.slice(array, F.lit(start), F.greatest(F.col("n_words") - less, F.lit(0)).cast("int"))


def _hashed(docs: DataFrame) -> DataFrame:
    """Adds n_words, and arrays of hashes: ``one`` of words, ``two`` of pairs."""
    out = docs.withColumn("words", word_array(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    out = out.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    return out.withColumn("two", F.zip_with(_part("one", 1, 1), _part("one", 2, 1), lambda a, b: F.xxhash64(a, b)))


def _ending(word: Column) -> Column:
    return F.xxhash64(F.lit("end"), F.substring(word, -3, 3))


def feature_counts(docs: DataFrame, trusted: DataFrame, rules: QualityRules) -> DataFrame:
    """Per bucket: how often it occurs in all documents (raw) and in the trusted ones (target)."""
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    if trusted.limit(rules.broadcast_rows + 1).count() <= rules.broadcast_rows:
        ids = F.broadcast(ids)
    docs = docs.select("doc_id", "text")
    marked = docs.join(ids, docs.doc_id == ids.trusted_id, "left").select("text", F.col("trusted_id").isNotNull().cast("long").alias("t"))
    # words are exploded with their successors before they are hashed: rows are hashed in compiled code, array elements are not
    words = marked.select("t", word_array(F.col("text")).alias("words"))
    words = words.select("t", "words", F.slice("words", F.lit(2), F.size("words")).alias("next"))
    words = words.select("t", F.explode(F.arrays_zip("words", "next")).alias("z")).select("t", "z.words", "z.next")
    one = F.xxhash64("words")
    features = F.array(one, F.when(F.col("next").isNotNull(), F.xxhash64(one, F.xxhash64("next"))), _ending(F.col("words")))
    each = words.select("t", F.explode(features).alias("f")).where("f is not null").select("t", F.pmod("f", F.lit(rules.buckets)).cast("int").alias("bucket"))
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))


def log_ratios(counts: DataFrame, rules: QualityRules) -> list[float]:
    """log of target over raw probability (each count plus one) of every bucket; one row per bucket is gathered."""
    import math

    raw, target = [1] * rules.buckets, [1] * rules.buckets
    for r in counts.collect():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    r_all, t_all = math.log(sum(raw)), math.log(sum(target))
    return [round(math.log(t) - t_all - math.log(r) + r_all, 9) for t, r in zip(target, raw, strict=True)]


def _with_base(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """Adds the base columns to hashed documents."""
    k = rules.window
    has_word = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("lines", F.filter(F.split(text, "\n"), has_word))
    out = (
        out.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    )
    # a window of five is a pair, a pair and a word; wider ones take in more words
    rest = lambda i: [F.get("two", i + d) for d in range(2, k - 1, 2)] + [F.get("one", i + k - 1)] * (k % 2)
    out = out.withColumn("runs", F.transform(_part("two" if k > 1 else "one", 1, k - 1), lambda a, i: F.xxhash64(a, *rest(i))))
    # only texts with a repeated run sort their runs
    repeats = F.size(F.array_distinct("runs")) < F.size("runs")
    numbered = F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("sorted", F.when(repeats, F.sort_array(numbered)))
    same = lambda s, x, i: (F.get(s, i)["h"] == x["h"])
    twice = F.filter("sorted", lambda x, i: F.coalesce(same(F.col("sorted"), x, i - 1), F.lit(False)) | F.coalesce(same(F.col("sorted"), x, i + 1), F.lit(False)))
    out = out.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.zip_with("starts", F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(k)), F.lit(k)))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long")))


def judge(docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Every column of ``docs`` (those named as an added one are replaced) with
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score (mean log ratio) and kept."""
    weights = log_ratios(feature_counts(docs, trusted, rules), rules)
    table = F.array(*map(F.lit, weights))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("row")
    out = _with_base(_hashed(docs.select(others, "text")), rules)
    weight = lambda f: F.get(table, F.pmod(f, F.lit(rules.buckets)).cast("int"))
    total = F.aggregate("words", F.lit(0.0), lambda s, x: s + weight(_ending(x)))
    for array in ("one", "two"):
        total = F.aggregate(array, total, lambda s, x: s + weight(x))
    size = 2 * F.size("words") + F.size("two")
    out = out.withColumn("score", F.when(size > 0, total / size).otherwise(0.0))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    # A filter on ``kept`` would be pushed below the projections above, and compute every
    # array anew at each of its references. A term that is always true but that the
    # optimizer may not move keeps the filter here.
    here = F.monotonically_increasing_id() >= 0
    return out.select("row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score", (~failed & (F.col("score") >= rules.min_score) & here).alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text")
