"""BPE encoding and decoding through a distinct-word table.

Texts are split into the words that byte-level BPE never merges across. Each distinct word is encoded once, and decoded
by looking its ids up in the id-to-piece table (its 50,257 entries are fixed by the tokenizer). Ids and decoded words
are joined back by position, chunk by chunk (``_chunks``); texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._arrays import lean
from ._chunks import by_chunk, chunked, looked_up, lookup, quiet, values_of
from ._common import read, scratch

#: Characters below U+0250 by the classes of the splitting pattern; texts with others are split by the library itself.
LETTER, NUMBER, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
PLAIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
BEYOND = re.compile("[^\\x00-\\u024f]")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    quiet()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def special(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    ids = {x.content: i for i, x in tokenizer(path).get_added_tokens_decoder().items()}
    return (re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None), ids


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table: the bytes of each id."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    t, own = tokenizer(path), {i: s for s, i in special(path)[1].items()}
    out = [b""] * (max(t.get_vocab().values()) + 1)
    for s, i in t.get_vocab().items():
        out[i] = own[i].encode() if i in own else bytes(byte[c] for c in s)
    return out


def width(path: str) -> str:
    return "<u2" if len(pieces(path)) <= 1 << 16 else "<u4"


def split(text: str, path: str) -> list[str]:
    """The words of a text, special tokens as words of their own; joined they are the text."""
    rx, ids = special(path)
    parts = rx.split(text) if rx and any(s in text for s in ids) else [text]
    out: list[str] = []
    for i, p in enumerate(parts):
        if i % 2:
            out.append(p)
        elif p:
            out += PLAIN.findall(p) if p.isascii() or not BEYOND.search(p) else [p[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(p)]
    return out


def encode_words(words: list[str], path: str) -> pa.Array:
    """For each word {ids: its ids as little-endian integers (``width``), odd: its decoded text where that isn't the word}."""
    t, table, kind = tokenizer(path), pieces(path), width(path)
    ids, odd = [], []
    for k in range(0, len(words), 2_000):
        for w, e in zip(words[k : k + 2_000], t.encode_batch(words[k : k + 2_000], add_special_tokens=False)):
            ids.append(np.array(e.ids, kind).tobytes())
            back = b"".join([table[i] for i in e.ids]).decode("utf-8", "replace")
            odd.append(None if back == w else back)
    return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(odd, pa.string())], ["ids", "odd"])


VALUE = pa.struct([("ids", pa.binary()), ("odd", pa.string())])


@lru_cache(maxsize=2)
def decimals(path: str) -> pa.Array:
    return pa.array([str(i) for i in range(len(pieces(path)))])


def joined(parts: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
    """Runs of strings, of the given sizes, each joined."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, parts), by)


def listed(ids: pa.Array, path: str) -> pa.Array:
    """Decimal ids, comma-joined, of words from their ids as integers."""
    data, n = np.frombuffer(b"".join(ids.to_pylist()), width(path)), pc.binary_length(ids).to_numpy() // np.dtype(width(path)).itemsize
    return joined(decimals(path).take(pa.array(data)), n, ",")


def _encoded(documents: DataFrame, path: str, finish: Callable[[pa.Array, pa.Array], list[pa.Array]], schema: str) -> DataFrame:
    """doc_id, n_tokens and what ``finish`` makes of ids (decimal, comma-joined) and decoded texts, with its ``schema``.

    A chunk's words and ids are held as Arrow arrays; words are looked up in them about a megabyte of text at a time."""
    at = scratch(documents.sparkSession)
    chunks, total = chunked(documents, ["doc_id", "text"], at)

    def distinct(b: pa.RecordBatch) -> set[str]:
        words: set[str] = set()
        for t in b.column(2).to_pylist():
            if t:
                words.update(split(t, path))
        return words

    folder = lookup(chunks, total, distinct, lambda words: encode_words(words, path), "struct<ids: binary, odd: string>", at, "words")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, ids, odd = None, None, None, None
        for chunk, b in by_chunk(batches):
            if chunk != now:
                words = ids = odd = None
                words, v = values_of(folder, chunk, VALUE)
                ids, odd, now = listed(v.field("ids"), path), v.field("odd"), chunk
                del v
            for part in looked_up(b):
                parts = [split(t, path) if t else [] for t in part.column(2).to_pylist()]
                sizes = np.array([len(p) for p in parts])
                flat = pa.array(list(chain.from_iterable(parts)), pa.string())
                del parts
                place = pc.index_in(flat, value_set=words)
                if place.null_count:
                    raise KeyError("a word is missing from its chunk's table")
                lists = joined(ids.take(place), sizes, ",")
                n = pc.if_else(pc.equal(lists, ""), 0, pc.add(pc.count_substring(lists, ","), 1)).cast(pa.int64())
                out = finish(lists, joined(pc.coalesce(odd.take(place), flat), sizes, ""))
                yield pa.RecordBatch.from_arrays([part.column(1), n, *out], ["doc_id", "n_tokens", *names])

    kind, names = documents.schema["doc_id"].dataType.simpleString(), [c.split()[0] for c in schema.split(", ")]
    return chunks.mapInArrow(lean(join), f"doc_id {kind}, n_tokens bigint, {schema}")


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, comma-joined), decoded: a row for each row. A null text counts as empty. doc_id may
    have any type; other columns are ignored."""
    return _encoded(documents, path, lambda ids, decoded: [ids, decoded], "ids string, decoded string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def sha(c: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(x.encode()).hexdigest() for x in c.to_pylist()], pa.string())

    return _encoded(documents, path, lambda ids, decoded: [sha(ids), sha(decoded)], "ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark, sf_dir):
    return digests(read(spark, sf_dir, "documents"), default_path())


QUERIES = {"op9_bpe": op9_bpe}
ORACLES = {}
