"""The queries of the corpus operators and their oracle SQL."""

from . import bpe, chat, decontam, langid, lm, neardup, quality, search, secrets, warc

MODULES = [warc, lm, decontam, search, neardup, secrets, chat, langid, bpe, quality]


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles():
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
