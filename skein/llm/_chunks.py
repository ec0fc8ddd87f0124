"""Distinct words of chunks of a corpus, looked up once per word and joined back without shuffling the texts.

A chunk is a fixed run of rows of one input file (file, row number div rows), so two scans see the same chunks however
the files are split into tasks. The first scan sends each chunk's distinct words, packed into one row per hash bucket
of words; each bucket works out a value for each distinct word once; the values go back to the chunks as a table
partitioned by chunk, of which the second scan reads its own part.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import PIECE, lean, word_hashes
from ._common import table

CHUNK_BYTES = 32 << 20
#: Bytes of text whose words are held as Python strings at once.
LOOK_UP = 1 << 20


def open_uri(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder that Spark names, e.g. file:///..., hdfs://..., s3a://..."""
    if "://" not in uri:
        return pa.fs.LocalFileSystem(), uri.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def read_folder(uri: str) -> pa.Table | None:
    fs, path = open_uri(uri)
    if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
        return None
    files = [f.path for f in fs.get_file_info(pa.fs.FileSelector(path)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(f, filesystem=fs, partitioning=None) for f in sorted(files)]) if files else None


def chunked(documents: DataFrame, columns: list[str], at: str, size: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """The columns with ``chunk`` (bigint) before them, and the bytes of text in all."""
    try:
        d = documents.select(*columns, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
        d.schema  # noqa: B018
    except AnalysisException:
        documents = table(documents.select(*columns), at, "input")
        d = documents.select(*columns, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    n, total = documents.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rows = max(1, int(size * n / max(1, total)))
    return d.select(F.xxhash64("_f", F.floor(F.col("_i") / rows)).alias("chunk"), *columns), total


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one chunk."""
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                yield int(c[x]), b.slice(x, y - x)


def looked_up(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``LOOK_UP`` bytes."""
    step = max(1, b.num_rows * LOOK_UP // max(1, b.nbytes))
    for k in range(0, b.num_rows, step):
        yield b.slice(k, step)


def shares(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word, by a hash of its bytes."""
    out = []
    for k in range(0, len(words), PIECE // 16):
        w = words.slice(k, PIECE // 16)
        ends = np.cumsum(pc.binary_length(w).to_numpy().astype(np.int64))
        b = np.frombuffer(b"".join(w.cast(pa.binary()).to_pylist()), np.uint8)
        h = word_hashes(b, np.concatenate([[0], ends[:-1]]), ends) if len(b) else np.zeros(len(w), np.uint64)
        out.append(((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32))
    return np.concatenate([np.zeros(0, np.int32), *out])


def lookup(chunks: DataFrame, total: int, split: Callable[[pa.RecordBatch], set[str]], value: Callable[[list[str]], pa.Array], kind: str, at: str, name: str, most: int = 600_000) -> str:
    """Folder of a table (chunk, words, values) partitioned by chunk.

    ``split`` gives the distinct words of some rows of a chunk; ``value`` gets distinct words and returns a value (of SQL
    type ``kind``) for each, null for none. Rows are sent when a chunk ends or has ``most`` distinct words, and words are
    held as Arrow arrays but for those of ``LOOK_UP`` bytes of text, so memory is bounded.
    """
    buckets = max(8, 4 * total // CHUNK_BYTES + 1)

    def rows(chunk: int, words: pa.Array) -> pa.RecordBatch:
        which = shares(words, buckets)
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts[full], cuts[-1]).astype(np.int32)), words.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([chunk] * len(full), pa.int64()), lists], ["bucket", "chunk", "words"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held, last = None, [], 0, 0
        for chunk, b in by_chunk(batches):
            if parts and (chunk != now or last > most):
                yield rows(now, pa.concat_arrays(parts).unique())
                parts, held, last = [], 0, 0
            now = chunk
            for piece in looked_up(b):
                parts.append(pa.array(list(split(piece)), pa.string()))
                held += len(parts[-1])
            if held > 2 * last + most // 4:
                parts = [pa.concat_arrays(parts).unique()]
                held = last = len(parts[0])
        if parts:
            yield rows(now, pa.concat_arrays(parts).unique())

    def work(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        lists = t.column("words").chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        code = lists.flatten().dictionary_encode()
        values = value(code.dictionary.to_pylist()).take(code.indices)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.table({"chunk": t.column("chunk").combine_chunks(), "words": lists, "values": pa.ListArray.from_arrays(offsets, values)})

    sent = chunks.mapInArrow(lean(send), "bucket int, chunk bigint, words array<string>")
    out = sent.groupBy("bucket").applyInArrow(work, f"chunk bigint, words array<string>, values array<{kind}>")
    out.repartition("chunk").write.partitionBy("chunk").option("compression", "zstd").parquet(f"{at}/{name}")
    return f"{at}/{name}"


def values_of(folder: str, chunk: int, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    """The words of a chunk and their values, of Arrow type ``kind``."""
    t = read_folder(f"{folder}/chunk={chunk}")
    if t is None:
        return pa.array([], pa.string()), pa.array([], kind)
    t = t.combine_chunks()
    return t.column("words").combine_chunks().flatten(), t.column("values").combine_chunks().flatten()


def quiet() -> None:
    """One thread per worker: Spark runs a worker per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
