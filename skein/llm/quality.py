"""Quality classifier by importance resampling of hashed n-gram generative models.

Two multinomial models over hashed features (byte trigrams; word bigrams, in which a repeated word is one feature) are
estimated: of the target text (labelled documents of good quality that aren't toxic) and of the raw text (the whole
corpus). A document's log weight is the sum of its features' log ratios, target over raw. Documents are resampled
without replacement by Gumbel top-k: the k largest of log weight + Gumbel noise stay.

A few rude words hardly move the sum over a long text, so toxicity is decided by itself: words that labelled toxic
documents hold more often than others, in either half of the labels, mark a document (by its strongest word, see
``markers``) as toxic above the threshold that separates the labels best. The target has no such document: none is kept.

k is the number of other documents whose log weight is above the threshold that separates the labelled ones best, so
about as many documents stay as resemble the target. The target model is fitted on at most ``max_labels`` labelled
documents (those with the smallest hashes of doc_id); all else covers the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import SCHEMA, collect, gather, lean, pieces, ranges, send, word_hashes, word_spans
from ._common import drop, read, scratch, small, table

TRIGRAMS, BIGRAMS = 1 << 16, 1 << 14
SIZE = TRIGRAMS + BIGRAMS
#: Labelled documents that the target model and the threshold are fitted on.
MAX_LABELS = 20_000
#: Added to each feature's count, per feature, in the target model: weight of the raw model as its prior.
PRIOR = 2.0
#: Standard errors taken off a word's log odds of toxicity.
DOUBT = 1.5
#: Bytes as they count in whole words: A-Z lower-cased, ASCII that is neither letter nor digit a space.
PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) pairs of a batch of texts, piece by piece."""
    for rows, starts, own, b, _ in pieces(texts):
        x = b.astype(np.uint32)
        tri = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
        yield np.repeat(rows, own), tri[ranges(starts, own)].astype(np.int64)
        first, end = word_spans(b)
        if len(first) > 1:
            h = word_hashes(b, first, end)
            of = np.searchsorted(starts, first, "right") - 1
            mine = (of[1:] == of[:-1]) & (first[:-1] < (starts + own)[of[:-1]])
            f = np.where(h[1:] == h[:-1], np.uint64(0), ((h[:-1] * np.uint64(31) + h[1:]) >> np.uint64(20)) % np.uint64(BIGRAMS - 1) + np.uint64(1))
            yield rows[of[:-1][mine]], f[mine].astype(np.int64) + TRIGRAMS


def plain_words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the whole words of a batch of texts, piece by piece."""
    for rows, starts, own, b, _ in pieces(texts):
        b = PLAIN[b]
        first, end = word_spans(b)
        of = np.searchsorted(starts, first, "right") - 1
        mine = first < (starts + own)[of]
        yield rows[of[mine]], word_hashes(b, first[mine], end[mine])


def markers(docs: DataFrame, lab: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that mark toxic documents, and their weights.

    A word's weight is its log odds of toxicity by labelled documents that hold it, less ``DOUBT`` standard errors; the smaller of those of the two halves of the labels counts."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.column(1).to_numpy(zero_copy_only=False)
            found = list(plain_words(b.column(0).to_pylist()))
            if not found:
                continue
            row, h = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((row, h))
            row, h = row[order], h[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
            at, inv = np.unique(h[new], return_inverse=True)
            n = np.bincount(inv * 4 + kind[row[new]], minlength=4 * len(at)).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), *[pa.array(n[:, k]) for k in range(4)]], ["h", "n0", "n1", "n2", "n3"])

    kind = F.col("toxic") + 2 * F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    size = {r.kind: r.n for r in docs.select("doc_id").join(lab, "doc_id").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}
    if any(k not in size for k in range(4)):
        return np.zeros(0, np.uint64), np.zeros(0)
    sent = docs.join(lab, "doc_id").select("text", kind.cast("int").alias("kind")).mapInArrow(lean(held), "h bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
    sums = sent.groupBy("h").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])

    def weight(u: int) -> Column:
        t, f = F.col(f"n{u + 1}") + 0.5, F.col(f"n{u}") + 0.5
        return F.log(t / (size[u + 1] + 1)) - F.log(f / (size[u] + 1)) - DOUBT * F.sqrt(1 / t + 1 / f)

    found = sums.where("n1 > 0 and n3 > 0").select("h", F.least(weight(0), weight(2)).alias("w")).where("w > 0").collect()
    h, w = np.array([r.h for r in found], np.int64).view(np.uint64), np.array([r.w for r in found], float)
    order = np.argsort(h)
    return h[order], w[order]


def labelled(labels: DataFrame, max_labels: int, at: str) -> DataFrame:
    """(doc_id, good, toxic): a bounded sample, small enough to broadcast. Good is what is of quality and not toxic; what
    is toxic needs no known quality."""
    toxic = F.coalesce(F.col("toxic") > 0, F.lit(False))
    s = labels.where((F.col("quality").isNotNull() | toxic) & F.col("doc_id").isNotNull())
    s = s.groupBy("doc_id").agg(F.min(F.when((F.col("quality") > 0) & ~toxic, 1).otherwise(0)).alias("good"), F.max(toxic.cast("int")).alias("toxic"))
    return F.broadcast(table(s.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels), at, "labels"))


def kth(keys: DataFrame, k: int, most: int = 10_000) -> float:
    """The k-th largest ``key``: histograms over ever smaller ranges until ``most`` keys or one value are left."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    while lo < hi:
        n = keys.where(F.col("key").between(lo, hi)).count()
        if n <= most:
            return sorted((r.key for r in keys.where(F.col("key").between(lo, hi)).select("key").collect()), reverse=True)[k - 1]
        step = (hi - lo) / 1024
        b = F.least(F.floor((F.col("key") - lo) / step), F.lit(1023))
        for r in sorted(keys.where(F.col("key").between(lo, hi)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(), key=lambda r: -r.b):
            if k <= r.n:
                lo, hi = r.lo, r.hi
                break
            k -= r.n
    return lo


def resampled(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, seed: int = 10, at: str | None = None) -> DataFrame:
    """doc_id, n_features, log_weight, kept: a row for each row of ``documents``.

    Null and empty texts have no features and log weight 0. Without labels, or if none is good or none bad, every
    document stays that isn't found toxic. Rows that tie at the k-th key, such as repeated rows of a doc_id with equal
    texts, stay or go together, so more than k may stay. doc_id may have any type; other columns are ignored.
    """
    at = at or scratch(documents.sparkSession)
    lab = labelled(labels, max_labels, at)
    docs = documents.select("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((2, SIZE), np.int64)
        for b in batches:
            good = b.column(1).to_numpy(zero_copy_only=False) == 1
            for row, f in features(b.column(0).to_pylist()):
                c[0] += np.bincount(f, minlength=SIZE)
                if good.any():
                    c[1] += np.bincount(f[good[row]], minlength=SIZE)
        yield from send(c.reshape(-1))

    sent = docs.join(lab, "doc_id", "left").select("text", "good").mapInArrow(lean(count), SCHEMA)
    raw, target = collect(gather(sent), 2 * SIZE).reshape(2, SIZE).astype(float)
    ratio = np.zeros(SIZE, np.float32)
    if target.sum():
        for part in (slice(0, TRIGRAMS), slice(TRIGRAMS, SIZE)):
            p = (raw[part] + 1) / (raw[part] + 1).sum()
            prior = PRIOR * len(p) * p
            ratio[part] = np.log((target[part] + prior) / (target[part].sum() + prior.sum()) / p)

    words, marks = markers(docs, lab)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, n, m = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            texts = b.column(1).to_pylist()
            for row, f in features(texts):
                w += np.bincount(row, weights=ratio.take(f), minlength=len(w))
                n += np.bincount(row, minlength=len(w))
            for row, h in plain_words(texts) if len(words) else ():
                i = np.minimum(np.searchsorted(words, h), len(words) - 1)
                hit = words[i] == h
                np.maximum.at(m, row[hit], marks[i[hit]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(w), pa.array(m)], ["doc_id", "n_features", "log_weight", "mark"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    scored = docs.mapInArrow(lean(weigh), f"doc_id {kind}, n_features bigint, log_weight double, mark double").withColumn("key", F.col("log_weight") - F.log(-F.log(u)))
    scored = table(scored, at, "scored")
    seen = scored.join(lab, "doc_id").select("log_weight", "n_features", "good", "mark", "toxic").collect()
    limit = threshold([(r.mark, 0, r.toxic) for r in seen])
    clean = F.lit(True) if limit is None else F.col("mark") <= limit
    cut = threshold([(r.log_weight, r.n_features, r.good) for r in seen if limit is None or r.mark <= limit])
    if cut is None:
        return scored.select("doc_id", "n_features", "log_weight", clean.alias("kept"))
    rest = scored.where(clean)
    k = rest.where(F.col("log_weight") > cut).count()
    if k == 0:
        return scored.select("doc_id", "n_features", "log_weight", F.lit(False).alias("kept"))
    return scored.select("doc_id", "n_features", "log_weight", (clean & (F.col("key") >= kth(rest, k))).alias("kept"))


def threshold(rows: list[tuple[float, int, int]]) -> float | None:
    """The log weight that separates good from bad best, errors on either counting by share; None without both.

    Halfway in the gap where several do equally well.
    """
    rows = sorted(rows)
    w, good = np.array([r[0] for r in rows]), np.array([r[2] for r in rows]) == 1
    if not good.any() or good.all():
        return None
    loss = np.concatenate([[0], np.cumsum(good)]) / good.sum() + 1 - np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    k = int(np.argmin(loss))
    return float(w[0] - 1 if k == 0 else w[-1] if k == len(w) else (w[k - 1] + w[k]) / 2)


def keep(documents: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The documents that resampling keeps, and those without a doc_id, all columns."""
    spark, at = documents.sparkSession, scratch(documents.sparkSession)
    gone = small(table(resampled(documents, labels, at=f"{at}/work", **kw).where(~F.col("kept")).select("doc_id"), at, "drop"))
    drop(spark, f"{at}/work")
    return documents.join(gone, "doc_id", "left_anti").select(documents.columns)


def op10_quality(spark, sf_dir):
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op10_quality": op10_quality}
ORACLES = {}
