"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text's fingerprints are the least hashes of its k-word grams in every window of w grams; two
texts that share w + k - 1 words in a row share one of them.  The fingerprints of documents are
joined with those of the benchmark, and only texts with a hit are looked at again: every gram
of theirs that is a benchmark fingerprint fixes an alignment of text and item, and along it the
words themselves are compared, so a hash decides nothing.

Equal texts are one text: hits are found and extended per digest of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import lower_ascii, stored

#: Words of a gram; with windows of 10 words a window of the winnowing holds 10 - GRAM + 1 grams.
GRAM = 5


def words(text: Column) -> Column:
    """Words of lower-cased A-Z, digits and anything beyond ASCII; null and empty texts have none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def _grams(hashes: Column, k: int) -> Column:
    """Hashes of all k-word grams of an array of word hashes."""
    n = F.size(hashes)
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k))))
    return F.when(n >= k, grams).otherwise(F.array().cast("array<bigint>"))


def _word_grams(words: str, k: int) -> Column:
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _grams(h, k))


def _fingerprints(grams: Column, w: int) -> Column:
    """The least gram hash of every w grams in a row; one for fewer grams, if any."""
    n = F.size(grams)
    least = F.transform(F.sequence(F.lit(0), n - w), lambda i: F.least(*(F.get(grams, i + j) for j in range(w)))) if w > 1 else grams
    return F.array_distinct(F.when(n >= w, least).otherwise(F.filter(F.array(F.array_min(grams)), lambda v: v.isNotNull())))


def _marks(n: int, k: int) -> Column:
    """Fingerprints of an array of word hashes for windows of ``n`` words, told apart by ``n``."""
    return F.transform(_let(_grams(F.col("_h"), k), lambda g: _fingerprints(g, n - k + 1)), lambda f: F.xxhash64(f, F.lit(n)))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Which words of ``docs`` (doc_id, text) lie in a window of an item of ``benchmark`` (item_id, text).

    A window is ``window`` words of an item in a row; an item with fewer, but some, is one window.
    Returns doc_id, _text (a digest of the text), n_words, n_hit (words in any occurrence of a
    window), n_items (items with an occurring window), items_sha256 (of their ids as text, sorted,
    comma-joined) and contaminated (n_hit > 0) for every row.  Null and empty texts and items have
    no words; items of one id with several texts count once; a null item_id is left out; repeated
    rows get equal results; an empty benchmark hits nothing, no documents give no rows; other
    columns are left out.
    """
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("_words")).where(F.size("_words") > 0).distinct()
    items = stored(items.withColumn("_len", F.least(F.lit(window), F.size("_words"))), "winnow-items")
    lengths = sorted(r["_len"] for r in items.select("_len").distinct().collect())  # at most ``window`` values

    base = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_text"), words(F.col("text")).alias("_words"))
    # a window of n words: grams of k words, winnowed over n - k + 1
    plans = [(n, min(GRAM, n)) for n in lengths]
    marks = [_marks(n, k) for n, k in plans]
    marks = F.concat(*marks) if marks else F.array().cast("array<bigint>")
    hashed = base.select("doc_id", "_text", F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))
    scanned = stored(hashed.select("doc_id", "_text", F.size("_h").cast("long").alias("n_words"), marks.alias("_marks")), "winnow-marks")

    parts = []
    for n, k in plans:
        own = items.where(F.col("_len") == n).withColumn("_g", _word_grams("_words", k)).withColumn("_f", _fingerprints(F.col("_g"), n - k + 1))
        placed = own.select("item_id", "_words", "_f", F.posexplode("_g").alias("_q", "_gram")).where(F.array_contains("_f", F.col("_gram")))
        parts.append(placed.select(F.lit(n).alias("_n"), F.lit(k).alias("_k"), "item_id", "_words", "_q", "_gram"))
    if not parts:
        return _result(scanned, None)
    marked = parts[0]
    for p in parts[1:]:
        marked = marked.unionByName(p)
    marked = stored(marked.withColumn("_mark", F.xxhash64("_gram", "_n")), "winnow-benchmark")

    # Spark sends the marks to every task while their table is small, and exchanges both sides beyond
    hits = scanned.select("_text", F.explode("_marks").alias("_mark")).join(marked.select("_mark").distinct(), "_mark").select("_text").distinct()
    hits = stored(hits, "winnow-hits")
    texts = docs.select(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_text"), "text").join(hits, "_text", "left_semi")
    texts = texts.groupBy("_text").agg(F.first("text").alias("text")).select("_text", words(F.col("text")).alias("_doc"))
    texts = stored(texts, "winnow-texts")

    found = None
    for k in sorted({k for _, k in plans}):
        grams = texts.select("_text", F.posexplode(_word_grams("_doc", k)).alias("_p", "_gram"))
        own = marked.where(F.col("_k") == k).select("_n", "_gram", "item_id", "_words", "_q")
        lines = grams.join(own, "_gram").select("_text", "_n", "item_id", F.col("_words").alias("_item"), (F.col("_p") - F.col("_q")).alias("_shift")).distinct()
        found = lines if found is None else found.unionByName(lines)
    lines = found.join(texts, "_text")
    # along an alignment: which words agree, and where a whole window does
    size = F.size("_item")
    same = F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.coalesce((F.col("_shift") + j >= 0) & (F.get(F.col("_doc"), F.greatest(F.lit(0), F.col("_shift") + j)) == F.get(F.col("_item"), j)), F.lit(False)))
    windows = F.filter(F.sequence(F.lit(0), size - F.col("_n")), lambda j: ~F.array_contains(F.slice(F.col("_same"), j + 1, F.col("_n")), False))
    ends = lines.withColumn("_same", same).select("_text", "_n", "item_id", "_shift", F.explode(windows).alias("_j"))
    ends = ends.select("_text", "item_id", "_n", (F.col("_shift") + F.col("_j")).alias("_start"))
    ends = stored(ends, "winnow-windows")
    n_hit = ends.select("_text", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_n") - 1)).alias("_p")).distinct()
    n_hit = n_hit.groupBy("_text").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = ends.select("_text", F.col("item_id").cast("string").alias("i")).distinct().groupBy("_text").agg(F.array_sort(F.collect_list("i")).alias("_items"))
    return _result(scanned, n_hit.join(ids, "_text"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    bad = stored(contamination(docs, benchmark, window).where("contaminated").select("_text").distinct(), "winnow-bad")
    digest = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    return docs.join(bad, digest == bad["_text"], "left_anti")


def _result(scanned: DataFrame, hits: DataFrame | None) -> DataFrame:
    rows = scanned.select("doc_id", "_text", "n_words")
    if hits is None:
        rows = rows.withColumn("n_hit", F.lit(None).cast("long")).withColumn("_items", F.lit(None).cast("array<string>"))
    else:
        rows = rows.join(hits, "_text", "left")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "_text", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
