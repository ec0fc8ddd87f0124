"""Benchmark decontamination: which words of a corpus lie in a window that also occurs in a benchmark.

Built from DataFrame functions only. The distinct normalised benchmark windows are the hash set. Each is filed under
its longest word (its anchor); while the training words are scanned, only positions of anchors form candidate windows,
whose 64-bit hash must be in the set and whose words are then compared one by one (verified).

The set is broadcast if it has at most ``max_windows`` windows; a larger one is joined by shuffle, which sends positions
of words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import ascii_lower, drop, read, scratch, small, table

#: A word: a run of ASCII letters or digits, or of anything beyond ASCII.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
#: Windows (some 200 bytes each) that may be broadcast.
MAX_WINDOWS = 500_000


def words(text: Column) -> Column:
    """The words of a text in order; null and texts without words give an empty array."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BREAK, -1), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, gram, n, anchor, at): the distinct windows of each item, with its anchor word and the anchor's place."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    g = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("gram")).distinct()
    anchor = F.array_max(F.transform("gram", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return g.withColumn("a", anchor).select("item_id", "gram", F.size("gram").alias("n"), F.xxhash64("gram").alias("h"), F.col("a.x").alias("anchor"), (-F.col("a.i")).alias("at"))


def find(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_windows: int = MAX_WINDOWS, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, counts): hits has a row (doc_id, start, n, item_id) for each occurrence of a window, start from 0;
    counts has (doc_id, n_words). Both come from one scan of the documents, kept as a table.

    Null or empty texts have 0 words and no hit. Items without words have no window. Repeated rows of a doc_id give
    equal hits once. Other columns of either input are ignored.
    """
    spark = documents.sparkSession
    at = at or scratch(spark)
    b = table(windows(benchmark, size), at, "windows")
    d = documents.select("doc_id", words(F.col("text")).alias("w"))
    few = b.count() <= max_windows
    if few:  # one pass; each candidate sees the words beside it
        by_anchor = F.broadcast(table(b.groupBy("anchor").agg(F.collect_set(F.struct("at", "n", "h")).alias("spots")), at, "anchors"))
        p = d.select("doc_id", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "anchor"))
        p = p.join(by_anchor, "anchor", "left").where(F.col("spots").isNotNull() | (F.coalesce(F.col("pos"), F.lit(0)) == 0))
        c = p.select("doc_id", "n_words", "w", "pos", F.explode_outer("spots").alias("s"))
        c = c.select("doc_id", "n_words", (F.col("pos") - F.col("s.at")).alias("start"), F.col("s.n").alias("n"), F.col("s.h").alias("h"), "w", "pos")
    else:  # the shuffle sends positions only; words come back to documents with a candidate
        spots = b.select("anchor", "at", "n", "h").distinct()
        p = d.select("doc_id", F.posexplode("w").alias("pos", "anchor")).join(spots, "anchor")
        p = p.groupBy("doc_id", (F.col("pos") - F.col("at")).alias("start"), "n", "h").agg(F.min("pos").alias("pos")).where("start >= 0")
        c = d.join(p, "doc_id").select("doc_id", F.size("w").alias("n_words"), "start", "n", "h", "w", F.greatest("pos", F.lit(1)).alias("pos"))
        c = c.unionByName(d.select("doc_id", F.size("w").alias("n_words"), *[F.lit(None).cast(t).alias(x) for x, t in (("start", "int"), ("n", "int"), ("h", "bigint"))], "w", F.lit(0).alias("pos")))
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))
    c = c.withColumn("gram", F.when(fits, F.slice("w", F.col("start") + 1, F.col("n"))))
    c = c.withColumn("ok", F.coalesce(F.xxhash64("gram") == F.col("h"), F.lit(False)) & F.col("gram").isNotNull())
    c = c.where(F.col("ok") | (F.coalesce(F.col("pos"), F.lit(0)) == 0))
    c = table(c.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.when(F.col("ok"), F.col("start")).alias("start"), F.when(F.col("ok"), F.col("gram")).alias("gram")).distinct(), at, "found")
    whole = b.select("gram", "n", "item_id")
    hits = c.where("gram is not null").join(F.broadcast(whole) if few else whole, "gram").select("doc_id", "start", "n", "item_id").distinct()
    return hits, c.groupBy("doc_id").agg(F.max("n_words").alias("n_words"))


def hit_counts(hits: DataFrame) -> DataFrame:
    """(doc_id, n_hit, items): words inside the union of a document's hits, and its sorted item ids as strings."""
    spans = hits.groupBy("doc_id", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = W.partitionBy("doc_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    n = spans.select("doc_id", new.alias("new")).groupBy("doc_id").agg(F.sum("new").cast("long").alias("n_hit"))
    items = hits.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return n.join(items, "doc_id")


def report(documents: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row for each doc_id."""
    hits, counts = find(documents, benchmark, **kw)
    out = counts.join(hit_counts(hits), "doc_id", "left")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def remove_documents(documents: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that hold no benchmark window, and those without a doc_id, all columns kept."""
    spark, at = documents.sparkSession, scratch(documents.sparkSession)
    hits, _ = find(documents, benchmark, at=f"{at}/work", **kw)
    ids = small(table(hits.select("doc_id").distinct(), at, "drop"))
    drop(spark, f"{at}/work")
    return documents.join(ids, "doc_id", "left_anti").select(documents.columns)


def op3_decontamination(spark, sf_dir):
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_W = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents), b AS (SELECT item_id, {_W} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[i:i + 9] END AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(gram) AS n FROM g),
p AS (SELECT doc_id, n, i, w[i:i + n - 1] AS gram FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes)),
h AS (SELECT DISTINCT doc_id, p.i, p.n, item_id FROM p JOIN g USING (gram)),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES = {"op3_decontamination": SQL}
