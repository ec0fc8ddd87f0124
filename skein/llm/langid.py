"""Language identification by mixture inference.

Each language has a model of hashed byte trigrams. A document is a mixture of languages: expectation-maximisation over
its words (each with its likelihood under every language) estimates their proportions. Languages are dropped one by one,
the least first, while the log-likelihood less half a log word count for each free proportion doesn't fall.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import SCHEMA, collect, gather, lean, pieces, ranges, send, word_spans
from ._common import read

SIZE = 1 << 16
LETTER = re.compile(r"[^\W\d_]")
FIRST_ROUNDS, ROUNDS = 10, 6


def trigrams(b: np.ndarray) -> np.ndarray:
    x = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint32)
    x[b < 32] = 32
    return ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64)


def word_trigrams(piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, trigrams, their number) of each word of a piece: those that hold one of its bytes in the middle."""
    _, starts, own, b, _ = piece
    first, end = word_spans(b)
    part = np.searchsorted(starts, first, "right") - 1
    mine = first < (starts + own)[part]
    part, first, end = part[mine], first[mine], end[mine]
    return part, trigrams(b)[ranges(first - 1, end - first)], end - first


def em(e: np.ndarray, doc: np.ndarray, cuts: np.ndarray, n: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds, and the log-likelihood (without what is common to all languages) before the last."""
    ll = np.zeros(len(pi))
    for _ in range(rounds):
        r = e * pi[doc]
        s = r.sum(1)
        ll = np.add.reduceat(np.log(np.maximum(s, 1e-300)), cuts)
        pi = np.add.reduceat(r / np.maximum(s, 1e-300)[:, None], cuts) / n[:, None]
    return pi, ll


def mixture(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Proportions for each document; ``words``: log-likelihoods by word and language; ``doc``: 0, 0, 1, ... ascending."""
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(doc) > 0]))
    n = np.diff(np.append(cuts, len(doc))).astype(float)
    e = np.exp(np.maximum(words - words.max(1, keepdims=True), -60))
    k = words.shape[1]
    pi, ll = em(e, doc, cuts, n, np.full((len(n), k), 1 / k), FIRST_ROUNDS)
    open_ = np.ones(len(n), bool)
    for _ in range(k - 1):
        least = np.where(pi > 0, pi, np.inf).argmin(1)
        fewer = pi.copy()
        fewer[np.arange(len(n)), least] = 0
        alive = fewer.sum(1) > 0
        fewer = np.where(alive[:, None], fewer / np.maximum(fewer.sum(1, keepdims=True), 1e-12), pi)
        p2, l2 = em(e, doc, cuts, n, fewer, ROUNDS)
        take = open_ & alive & (l2 + 0.5 * np.log(n + 1) >= ll)
        pi[take], ll[take] = p2[take], l2[take]
        open_ &= take
    return pi


def identify(documents: DataFrame, train: Column, languages: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, languages (the chosen set with proportions): a row for each row.

    ``train``: a condition; rows that meet it and have text and lang are learned from. ``languages``: those to choose
    from, else the learned values, whose number is taken to be small. A null text or one without a letter, or any text if
    nothing is learned, gives ``und`` and 0. Each document's words are all taken into one inference, whatever its length;
    equal texts have equal results; repeated rows give a row each. doc_id may have any type; other columns are ignored.
    """
    docs = documents.select("doc_id", "text", F.when(train, F.col("lang")).alias("lang"))
    langs = languages or sorted(r.lang for r in docs.where("lang is not null and text is not null").select("lang").distinct().collect())
    index, k = {x: i for i, x in enumerate(langs)}, len(langs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(k * SIZE, np.int64)
        for b in batches:
            of = np.array([index.get(x, -1) for x in b.column(1).to_pylist()])
            for piece in pieces(b.column(0).to_pylist()):
                part, tri, n = word_trigrams(piece)
                lang = np.repeat(of[piece[0][part]], n)
                c += np.bincount((lang * SIZE + tri)[lang >= 0], minlength=len(c))
        yield from send(c)

    if k:
        c = collect(gather(docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(lean(count), SCHEMA)), k * SIZE).reshape(k, SIZE)
        logp = np.ascontiguousarray(np.log((c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * SIZE)).T.astype(np.float32))

    def likelihoods(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of the words, log-likelihoods by language), whole texts at a time."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for piece in pieces(texts):
            part, tri, n = word_trigrams(piece)
            rows = piece[0]
            if len(part):
                held.append((rows[part], np.add.reduceat(logp[tri], np.cumsum(n) - n).astype(float)))
            if piece[4] and rows[0] == rows[-1]:
                continue
            got = [np.concatenate(x) for x in zip(*held)] if held else None
            held = []
            if got is None:
                continue
            if piece[4]:  # the last text goes on
                open_ = got[0] == rows[-1]
                held = [(got[0][open_], got[1][open_])]
                got = [x[~open_] for x in got]
            if len(got[0]):
                yield got[0], got[1]
        if held:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            total = np.zeros((b.num_rows, max(k, 1)))
            for rows, words in likelihoods(texts) if k else ():
                ids, compact = np.unique(rows, return_inverse=True)
                total[ids] = mixture(words, compact)
            pred, score, sets = [], [], []
            for t, p in zip(texts, total):
                if k and t and LETTER.search(t) and p.sum() > 0:
                    pred.append(langs[int(p.argmax())])
                    score.append(float(min(1.0, p.max())))
                    sets.append(",".join(f"{langs[i]}:{p[i]:.3f}" for i in np.argsort(-p, kind="stable") if p[i] > 0))
                else:
                    pred.append("und")
                    score.append(0.0)
                    sets.append("")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], ["doc_id", "lang_pred", "score", "languages"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(predict), f"doc_id {kind}, lang_pred string, score double, languages string")


def op8_language(spark, sf_dir):
    held = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(3)) == 1
    p = identify(read(spark, sf_dir, "documents"), ~held("doc_id"))
    return p.select("doc_id", held("doc_id").alias("held_out"), "lang_pred", "score", "languages")


QUERIES = {"op8_language": op8_language}
ORACLES = {}
