"""Exact top-k search: BM25 over an inverted index, block-max pruning, run per shard, merged with global statistics.

Document frequencies, the number of documents and their mean length are counted over the whole corpus. A shard (a chunk
of the corpus, see ``_chunks``) builds its inverted index with BM25 weights from these global statistics; postings are
cut into blocks of 64 consecutive documents with their largest weight. For a query, the blocks' bounds (sums of its
terms' block maxima) are visited from the highest; blocks whose bound is below the k-th score so far are skipped. Shards
return their k best, of which the k best overall are exact. Where a query has more than ``DENSE`` terms, nearly every
block's bound is above the k-th score, so all its postings are summed at once: those of common terms, for many queries,
as a product of matrices in single precision. What that leaves, within its largest error, below the k-th score is
dropped, and the rest is scored again in double precision; the results are the same.

Queries are documents: all distinct words of the whole text of each, or its ``terms`` most distinctive (count times
idf). They are read block by block, so a shard holds those of about ``QUERY_TERMS`` terms at once.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._arrays import lean, ranges
from ._chunks import by_chunk, chunked, read_folder
from ._common import read, scratch, table

#: A-Z lower-cased, other ASCII characters than letters and digits as spaces.
SPACED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
K1, B, BLOCK = 1.2, 0.75, 64
#: Terms of queries that a shard holds in memory at once.
QUERY_TERMS = 1_000_000
#: Terms of a query above which all of its postings are summed.
DENSE = 16
#: Share of a shard's documents above which a term is common, and numbers in a matrix of common terms by documents.
COMMON, MATRIX = 0.04, 16_000_000


def words(text: str | None) -> list[str]:
    return [w for w in text.encode().translate(SPACED).decode().split(" ") if w] if text else []


#: In the table of frequencies: numbers of documents and of words; no word has such characters.
DOCS, WORDS = "\x00docs", "\x00words"


def frequencies(chunks: DataFrame, total: int, most: int = 400_000) -> DataFrame:
    """(term, df) over all documents, and rows for DOCS and WORDS: counted per task, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["term", "n"])

        for b in batches:
            size = 0
            for t in b.column(0).to_pylist():
                w = words(t)
                size += len(w)
                c.update(set(w))
            c[DOCS] += b.num_rows
            c[WORDS] += size
            if len(c) > most:
                yield out()
                c.clear()
        if c:
            yield out()

    return chunks.select("text").mapInArrow(lean(count), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def idf(n: int, df: Column) -> Column:
    return F.log1p((F.lit(float(n)) - df + 0.5) / (df + 0.5))


def queries_of(queries: DataFrame, df: DataFrame, n: int, terms: int | None) -> DataFrame:
    """(qid, terms, weights): all terms or the most distinctive, ties by the term, each weighted by its idf."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = Counter(words(t))
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(c), pa.int64()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["qid", "term", "tf"])

    t = queries.select("doc_id", "text").mapInArrow(lean(split), "qid bigint, term string, tf bigint")
    t = t.groupBy("qid", "term").agg(F.sum("tf").alias("tf")).join(df, "term").withColumn("idf", idf(n, F.col("df")))
    if terms is not None:
        t = t.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.round(-F.col("tf") * F.col("idf"), 9), "term"))).where(F.col("r") <= terms)
    return t.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("s")).select("qid", F.col("s.term").alias("terms"), F.col("s.idf").alias("weights"))


class Index:
    """The inverted index of a shard; rows are added in any order of doc_id."""

    def __init__(self, mean: float, wanted: set[str] | None = None):
        self.mean, self.ids, self.lengths, self.parts, self.sizes = mean, [], [], [], []
        self.vocab: defaultdict[str, int] = defaultdict()
        if wanted is None:
            self.vocab.default_factory = self.vocab.__len__
        else:
            self.vocab.update(zip(wanted, range(len(wanted))))
        self.known = None if wanted is None else repeat(-1)
        self.built: dict[int, tuple] = {}

    def add(self, doc: int, tokens: list[str]) -> None:
        self.ids.append(doc)
        self.lengths.append(len(tokens))
        c = Counter(tokens)
        self.sizes.append(len(c))
        ids = map(self.vocab.__getitem__, c) if self.known is None else map(self.vocab.get, c, self.known)
        self.parts.append((np.fromiter(ids, np.int32, len(c)), np.fromiter(c.values(), np.int32, len(c))))

    def close(self) -> Index:
        self.ids = np.array(self.ids, np.int64)
        norm = K1 * (1 - B + B * np.array(self.lengths, float) / max(self.mean, 1e-9))
        term, tf = (np.concatenate([np.zeros(0, np.int32), *x]) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int32),) * 2
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        if self.known is not None:
            keep = term >= 0
            term, tf, doc = term[keep], tf[keep], doc[keep]
        self.parts.clear()
        weight = tf * (K1 + 1) / (tf + norm[doc])
        #: By document: its terms and their weights without idf. By term: its documents and the same weights.
        self.term, self.weight, self.begin = term, weight, np.searchsorted(doc, np.arange(len(self.ids) + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.by_term = doc[order], weight[order]
        self.df = np.bincount(term, minlength=len(self.vocab))
        self.start = np.cumsum(self.df) - self.df
        self.words = pa.array(self.vocab.keys(), pa.string())
        self.place = np.full(len(self.vocab), -1)
        n = len(self.ids)
        heavy = np.flatnonzero(self.df > COMMON * n)
        heavy = heavy[np.argsort(-self.df[heavy], kind="stable")[: MATRIX // max(1, n)]]
        self.column = np.full(len(self.vocab), -1)
        self.column[heavy] = np.arange(len(heavy))
        self.matrix = np.zeros((len(heavy), n), np.float32)
        at = np.flatnonzero(self.column[term] >= 0)
        self.matrix[self.column[term[at]], doc[at]] = weight[at]
        return self

    def postings(self, term: int):
        """(documents, weights without idf, block numbers, block maxima, where blocks begin and end)."""
        if term not in self.built:
            s = slice(self.start[term], self.start[term] + self.df[term])
            at, w = self.doc[s], self.by_term[s]
            blocks, starts = np.unique(at // BLOCK, return_index=True)
            self.built[term] = at, w, blocks, np.maximum.reduceat(w, starts), np.append(starts, len(at))
        return self.built[term]

    def answers(self, asked: pa.Table, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(qid, doc_ids, scores) of the k best of each query (qid, terms, weights), by score, then doc_id."""
        asked = asked.combine_chunks()
        terms, weights = asked.column("terms").combine_chunks(), asked.column("weights").combine_chunks()
        ids = pc.fill_null(pc.index_in(terms.flatten(), value_set=self.words), -1).to_numpy()
        ids = np.where((ids >= 0) & (np.append(self.df, 0)[ids] > 0), ids, -1)
        xs, qids = weights.flatten().to_numpy(), asked.column("qid").to_numpy()
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())])
        known = np.concatenate([[0], np.cumsum(ids >= 0)])[cuts]
        size = np.diff(known)
        for q in np.flatnonzero((size > 0) & (size <= DENSE)):
            s = slice(cuts[q], cuts[q + 1])
            yield qids[q], *self.top(ids[s], xs[s], k)
        many = np.flatnonzero(size > DENSE)
        step = max(1, MATRIX // 4 // max(1, len(self.ids)))
        for x in range(0, len(many), step):
            some = many[x : x + step]
            approx, error = self.sums([(ids[cuts[q] : cuts[q + 1]], xs[cuts[q] : cuts[q + 1]]) for q in some])
            groups = approx.shape[1] // BLOCK
            floor = np.zeros(len(some), np.float32)
            if groups > k:  # the k-th highest of the groups' maxima is no more than the k-th score
                tops = approx[:, : groups * BLOCK].reshape(len(some), groups, BLOCK).max(2)
                floor = np.partition(tops, groups - k, axis=1)[:, groups - k]
            for q, row, low in zip(some, approx, floor):
                at = np.flatnonzero(row >= low * (1 - error)) if low > 0 else np.flatnonzero(row > 0)
                if len(at) > k:
                    at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k] * (1 - error)]
                s = slice(cuts[q], cuts[q + 1])
                score = self.exact(at, ids[s], xs[s])
                best = np.lexsort((self.ids[at], -score))[:k]
                yield qids[q], self.ids[at[best]], score[best]

    def sums(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
        """Scores of all documents, a row for each query (term numbers, weights), and twice their largest relative error:
        common terms as a product of matrices in single precision, the others' postings summed."""
        common = np.zeros((len(queries), len(self.matrix)), np.float32)
        rest = []
        for row, (ids, xs) in zip(common, queries):
            ids, xs = ids[ids >= 0], xs[ids >= 0]
            column = self.column[ids]
            row[column[column >= 0]] = xs[column >= 0]
            rest.append((ids[column < 0], xs[column < 0]))
        out = common @ self.matrix
        for row, (ids, xs) in zip(out, rest):
            n = self.df[ids]
            at = ranges(self.start[ids], n)
            row += np.bincount(self.doc[at], weights=self.by_term[at] * np.repeat(xs, n), minlength=len(row))
        return out, 2.0 * (len(self.matrix) + 8) * 2.0**-24

    def exact(self, docs: np.ndarray, ids: np.ndarray, xs: np.ndarray) -> np.ndarray:
        """Scores of some documents for a query, summed in the order of its terms, so equal texts have equal scores."""
        here = np.flatnonzero(ids >= 0)
        self.place[ids[here]] = here
        out = []
        for x in range(0, len(docs), 256):
            d = docs[x : x + 256]
            n = self.begin[d + 1] - self.begin[d]
            at = ranges(self.begin[d], n)
            place = self.place[self.term[at]]
            found = place >= 0
            m = np.zeros((len(d), len(ids)))
            m[np.repeat(np.arange(len(d)), n)[found], place[found]] = self.weight[at[found]]
            m *= xs
            out.append(m.sum(1))
        self.place[ids[here]] = -1
        return np.concatenate([np.zeros(0), *out])

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of the k best with a term in common, block by block."""
        ps = [(self.postings(t), x) for t, x in zip(terms.tolist(), weights.tolist()) if t >= 0]
        blocks = np.unique(np.concatenate([p[2] for p, _ in ps]))
        bound = np.zeros(len(blocks))
        for p, x in ps:
            bound[np.searchsorted(blocks, p[2])] += p[3] * x
        order = np.argsort(-bound, kind="stable")
        docs, scores, floor, k0 = np.zeros(0, np.int64), np.zeros(0), -np.inf, 0
        step, open_ = 8, np.zeros(blocks[-1] + 1, bool)
        while k0 < len(order) and bound[order[k0]] * (1 + 1e-9) >= floor:
            take = blocks[order[k0 : k0 + step]]
            k0, step = k0 + step, step * 2
            at, score = [], []
            open_[take] = True
            for p, x in ps:
                i = np.flatnonzero(open_[p[2]])
                j = ranges(p[4][i], p[4][i + 1] - p[4][i])
                at.append(p[0][j])
                score.append(p[1][j] * x)
            open_[take] = False
            d, inv = np.unique(np.concatenate(at), return_inverse=True)
            s = np.bincount(inv, weights=np.concatenate(score))
            docs, scores = np.concatenate([docs, self.ids[d]]), np.concatenate([scores, s])
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(docs) == k:
                floor = scores[-1]
        return docs, scores


def search(documents: DataFrame, queries: DataFrame, k: int = 10, terms: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: for each query (doc_id, text) its k best documents; itself, if it is one, too.

    ``terms``: how many words of a query count, None for all. Rows that repeat a query's id are one query of all their
    words; repeated rows of a document are documents of their own.
    Documents that share no term with a query aren't results of it; null and empty texts match nothing and ask for
    nothing. Ties go to the smaller doc_id. Other columns are ignored.
    """
    at = scratch(documents.sparkSession)
    chunks, total = chunked(documents, ["doc_id", "text"], at)

    counted = table(frequencies(chunks, total), at, "frequencies")
    sizes = {r.term: r.df for r in counted.where(F.col("term").isin(DOCS, WORDS)).collect()}
    n = sizes.get(DOCS, 0)
    mean = sizes.get(WORDS, 0) / max(1, n)
    df = counted.where(~F.col("term").isin(DOCS, WORDS))
    q = table(queries_of(queries, df, n, terms), at, "asked")
    size = q.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_TERMS))
    q.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(f"{at}/queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not size:
            return
        wanted = None
        if blocks <= 4:
            parts = [t for k0 in range(blocks) if (t := read_folder(f"{at}/queries/block={k0}")) is not None]
            wanted = {w for t in parts for w in pc.unique(t.column("terms").combine_chunks().flatten()).to_pylist()}
            del parts

        def answer(ix: Index) -> Iterator[pa.RecordBatch]:
            ix.close()
            for k0 in range(blocks):
                part = read_folder(f"{at}/queries/block={k0}")
                if part is None:
                    continue
                qs, ds, ss = [], [], []
                for qid, d, s in ix.answers(part, k):
                    qs.append(np.full(len(d), qid))
                    ds.append(d)
                    ss.append(s)
                if qs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (qs, ds, ss)], ["query_id", "doc_id", "score"])

        now, ix = None, None
        for chunk, b in by_chunk(batches):
            if chunk != now:
                if ix:
                    yield from answer(ix)
                now, ix = chunk, Index(mean, wanted)
            for doc, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ix.add(doc, words(t))
        if ix:
            yield from answer(ix)

    hits = chunks.mapInArrow(lean(run), "query_id bigint, doc_id bigint, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def op4_search(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 100 = 0"), terms=None)


QUERIES = {"op4_search": op4_search}
ORACLES = {}
