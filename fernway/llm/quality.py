"""Quality rules in DataFrame functions alone: repetition and length rules, then a hashed n-gram likelihood ratio.

Words are ``[^\\x20\\x09-\\x0D]+``. Each document's words and marks, and pairs of neighbours, are hashed into ``BUCKETS`` buckets.
Two multinomials over the buckets are counted, with half a count added to each bucket: one of trusted documents (a bounded
sample of those labelled good) and one of all documents. A document's score is the mean log ratio of its n-grams; those below
``THRESHOLD`` are rejected, every one of them and no other, without drawing lots.

Defined results: a null or empty text has no words and fails the base rules; with no trusted document every ratio is one, so
the base rules decide; repeated rows are judged alike and each counted; an empty table gives no rows; columns with the names
of results are replaced, and names that begin with ``__fernway`` are reserved.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernway.llm.common import fenced

BUCKETS = 1 << 14
THRESHOLD = -0.3
#: Labelled documents of which the trusted multinomial is made, at most.
TRUSTED = 20_000

_SPACE = r"[\x20\x09-\x0D]+"
_RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_rules(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Every row with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, _SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.drop(*_RESULTS).withColumns({"__fernway_w": fenced(words), "__fernway_l": fenced(lines)})
    df = df.withColumns(
        {
            "n_words": F.size("__fernway_w").cast("long"),
            "word_chars": F.length(F.array_join("__fernway_w", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__fernway_l") - F.size(F.array_distinct("__fernway_l"))).cast("long"),
            "__fernway_h": fenced(F.transform(F.expr("slice(__fernway_w, 1, greatest(size(__fernway_w) - 2, 0))"), lambda w, i: F.xxhash64(w, F.get("__fernway_w", i + 1), F.get("__fernway_w", i + 2)))),
        }
    ).drop("__fernway_l")
    # Hashes that stand twice or more, with their places: sort them, look at the neighbours.
    placed = F.array_sort(F.transform("__fernway_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<h: BIGINT, p: INT>>)")
    df = df.withColumn("__fernway_s", fenced(F.when(F.size(F.array_distinct("__fernway_h")) < F.size("__fernway_h"), placed).otherwise(none)))
    again = F.filter("__fernway_s", lambda x, i: F.coalesce(x["h"] == F.get("__fernway_s", i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("__fernway_s", i - 1)["h"], F.lit(False)))
    df = df.withColumn("__fernway_p", fenced(F.sort_array(F.transform(again, lambda x: x["p"]))))
    gaps = F.transform("__fernway_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__fernway_p", i + 1), p + 3) - p))
    df = df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__fernway_w", "__fernway_h", "__fernway_s", "__fernway_p")


def tokens(text: Column) -> Column:
    """Runs of letters and digits, and runs of other characters but white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0))


def with_buckets(docs: DataFrame, text: str, buckets: int, name: str = "__fernway_b") -> DataFrame:
    """Every row with the buckets of its tokens and of the pairs of neighbours."""
    df = docs.withColumn("__fernway_t", fenced(tokens(F.col(text))))
    one = F.transform("__fernway_t", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(F.expr("slice(__fernway_t, 1, greatest(size(__fernway_t) - 1, 0))"), lambda w, i: F.pmod(F.xxhash64(w, F.get("__fernway_t", i + 1)), F.lit(buckets)).cast("int"))
    return df.withColumn(name, fenced(F.concat(one, two))).drop("__fernway_t")


def _counts(docs: DataFrame, text: str, buckets: int) -> list[int]:
    """Of every bucket the number of n-grams; the result is as long as there are buckets."""
    found = with_buckets(docs.select(text), text, buckets).select(F.explode("__fernway_b").alias("b")).groupBy("b").count().collect()
    counts = [0] * buckets
    for row in found:
        counts[row["b"]] = row["count"]
    return counts


def log_ratios(docs: DataFrame, trusted: DataFrame, *, text: str = "text", buckets: int = BUCKETS) -> list[float]:
    """Of every bucket the log of its share in ``trusted`` over its share in ``docs``; zeros if ``trusted`` has no n-grams."""
    good = _counts(trusted, text, buckets)
    if not sum(good):
        return [0.0] * buckets
    raw = _counts(docs, text, buckets)
    n, m = sum(good) + 0.5 * buckets, sum(raw) + 0.5 * buckets
    return [round(math.log((g + 0.5) / n) - math.log((r + 0.5) / m), 6) for g, r in zip(good, raw, strict=True)]


def trusted_sample(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", most: int = TRUSTED) -> DataFrame:
    """The documents of at most ``most`` ids labelled good, chosen by hash; so few ids that they are broadcast."""
    ids = labels.where("quality = 1").select(F.col(doc_id).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.join(F.broadcast(ids), docs[doc_id] == ids["_id"], "left_semi")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Every row with the base counts, base_failed, llr (mean log ratio, 0 for no n-grams) and kept."""
    ratios = log_ratios(docs, trusted_sample(docs, labels, doc_id=doc_id), text=text, buckets=buckets)
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    df = with_buckets(base_rules(docs, text=text).drop("llr", "kept"), text, buckets)
    total = F.aggregate("__fernway_b", F.lit(0.0), lambda a, b: a + F.get(table, b))
    df = df.withColumn("llr", F.when(F.size("__fernway_b") > 0, total / F.size("__fernway_b")).otherwise(F.lit(0.0))).drop("__fernway_b")
    return df.withColumn("kept", fenced(~F.col("base_failed") & (F.col("llr") >= F.lit(threshold))))
