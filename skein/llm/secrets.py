"""Secret scanning with a trigram index; built from DataFrame functions only.

Each rule's regular expression is compiled on the driver into a Boolean trigram query (an OR of ANDs). One scan of the
corpus, lower-cased, makes the postings of the trigrams that any rule needs; posting lists are intersected by counting,
which gives each rule its candidates. Only candidates are then scanned with the expression (verified). Rules without
mandatory trigrams scan every text.
"""

from __future__ import annotations

import itertools
import re._constants as sc
import re._parser as sp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop, read, scratch, small, table


@dataclass(frozen=True)
class Rule:
    """``pattern`` works alike in Java and Python. A match counts if ``group`` has at least ``least`` characters.

    ``probe`` matches somewhere in every text with a match that counts (and may be the quicker to rule texts out).
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    probe: str | None = None


#: In the order in which spans that begin together are listed. The first three are the base rules.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
#: Candidates (an id with up to a kind for each rule, some 150 bytes) that may be broadcast.
MAX_BROADCAST = 200_000


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams, one of which holds for every match; [] if none is mandatory.

    The expression becomes a list of alternatives, each a list of runs of literal text with gaps between them. Sets of
    alternatives over ``most`` and classes over 8 characters become gaps, which only weakens the query.
    """

    def cross(a, b):
        if len(a) * len(b) > most:
            b = [("", "")]  # a gap
        return list(dict.fromkeys((*x[:-1], x[-1] + y[0], *y[1:]) for x, y in itertools.product(a, b)))

    def walk(items):
        alts = [("",)]
        for op, arg in items:
            if op is sc.LITERAL:
                part = [(chr(arg).lower(),)]
            elif op is sc.IN and all(k is sc.LITERAL for k, _ in arg) and len(arg) <= 8:
                part = [(x,) for x in sorted({chr(v).lower() for _, v in arg})]
            elif op is sc.SUBPATTERN:
                part = walk(arg[3])
            elif op is sc.BRANCH:
                part = [y for x in arg[1] for y in walk(x)]
            elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT) and arg[1] == 1:
                part = [("",), *walk(arg[2])]
            elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT) and arg[0] >= 1:
                part = [(*x, "", *x) if arg[1] > arg[0] or arg[0] > 1 else x for x in walk(arg[2])]
            elif op is sc.AT:
                continue
            else:
                part = [("", "")]
            alts = cross(alts, part)
        return alts

    ands = {frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)) for runs in walk(sp.parse(pattern))}
    if not ands or frozenset() in ands:
        return []
    return sorted((a for a in ands if not any(b < a for b in ands)), key=sorted)


def postings(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): in which documents each of the trigrams occurs, letters in either case."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    has = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return documents.select("doc_id", low.alias("low")).select("doc_id", F.explode(has).alias("trigram")).select("trigram", "doc_id")


def candidates(documents: DataFrame, rules: tuple[Rule, ...], at: str) -> tuple[DataFrame | None, dict[str, bool]]:
    """(kind, doc_id) of the documents that fulfil the rules' trigram queries; for each rule, whether it has one."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    ands = [(kind, k, t, len(a)) for kind, q in queries.items() for k, a in enumerate(q) for t in sorted(a)]
    has = {k: bool(q) for k, q in queries.items()}
    if not ands:
        return None, has
    spark = documents.sparkSession
    wanted = F.broadcast(spark.createDataFrame(ands, "kind string, part int, trigram string, need int"))
    post = postings(documents, sorted({a[2] for a in ands}))
    both = post.distinct().join(wanted, "trigram").groupBy("doc_id", "kind", "part", "need").agg(F.count("*").alias("got"))
    return table(both.where("got = need").select("kind", "doc_id").distinct(), at, "candidates"), has


def spans(text: Column, rule: Rule) -> tuple[Column, Column]:
    """Arrays for two projections: the matches (m) and the texts between them (g); then the spans from ``m`` and ``g``."""
    return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)


def scan(documents: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, kind, start, end): leftmost non-overlapping matches that are long enough; in code points, end exclusive."""
    t = F.coalesce(F.col("text"), F.lit(""))
    m, g = spans(F.col("t"), rule)
    d = documents.select("doc_id", t.alias("t")).where(F.col("t").rlike(rule.probe or rule.pattern)).select("doc_id", "t", m.alias("m"), g.alias("g"))
    if rule.group:
        d = d.withColumn("v", F.regexp_extract_all("t", F.lit(rule.pattern), F.lit(rule.group)))
    else:
        d = d.withColumn("v", F.col("m"))
    place = "aggregate(zip_with(transform(m, x -> length(x)), transform(slice(g, 1, size(m)), x -> length(x)), (a, b) -> named_struct('m', a, 'g', b)), named_struct('at', 0, 'out', cast(array() as array<int>)), (s, x) -> named_struct('at', s.at + x.g + x.m, 'out', concat(s.out, array(s.at + x.g))), s -> s.out)"
    d = d.select("doc_id", F.explode(F.arrays_zip(F.expr(place).alias("start"), F.col("m"), F.col("v"))).alias("s"))
    d = d.where(F.length("s.v") >= rule.least)
    return d.select("doc_id", F.lit(rule.kind).alias("kind"), F.col("s.start").cast("long").alias("start"), (F.col("s.start") + F.length("s.m")).cast("long").alias("end"))


def find(documents: DataFrame, rules: tuple[Rule, ...] = RULES, at: str | None = None) -> DataFrame:
    """(doc_id, kind, start, end) of every secret. Null and empty texts have none; other columns are ignored."""
    at = at or scratch(documents.sparkSession)
    documents = documents.select("doc_id", "text")
    cand, has = candidates(documents, rules, at)
    found = [scan(documents, r) for r in rules if not has[r.kind]]
    if cand is not None:
        some = [r for r in rules if has[r.kind]]
        kinds = cand.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
        texts = table(documents.join(small(table(kinds, at, "kinds"), MAX_BROADCAST), "doc_id"), at, "texts")
        found += [scan(texts.where(F.array_contains("kinds", r.kind)), r) for r in some]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return table(out.distinct(), at, "spans")


def report(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each doc_id; see ``find``."""
    order = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))]), F.col("kind"))
    text = F.concat_ws(":", "kind", "start", "end")
    s = find(documents, rules).select("doc_id", "kind", F.struct("start", order.alias("o"), text.alias("x")).alias("s"))
    base = F.col("kind").isin(*BASE)
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda v: v.x), ",")
    g = s.groupBy("doc_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE], listed(F.collect_list(F.when(base, F.col("s")))).alias("base"), listed(F.collect_list("s")).alias("spans"))
    out = documents.select("doc_id").distinct().join(g, "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def remove_documents(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents without a secret, and those without a doc_id, all columns kept."""
    spark, at = documents.sparkSession, scratch(documents.sparkSession)
    ids = small(table(find(documents, rules, f"{at}/work").select("doc_id").distinct(), at, "drop"))
    drop(spark, f"{at}/work")
    return documents.join(ids, "doc_id", "left_anti").select(documents.columns)


def op6_secrets(spark, sf_dir):
    return report(read(spark, sf_dir, "documents"))


def _sql():
    def one(i, r):
        p = r.pattern.replace("'", "''")
        v = f"regexp_extract_all(t, '{p}', {r.group})"
        return f"SELECT doc_id, {i} AS o, '{r.kind}' AS kind, start, start + len(m) AS stop FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS k, ms[k] AS m, vs[k] AS v, len(array_to_string(gs[1:k], '')) + len(array_to_string(ms[1:k - 1], '')) AS start FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, {v} AS vs, string_split_regex(t, '{p}') AS gs FROM d)) WHERE len(v) >= {r.least}"

    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(one(i, r) for i, r in enumerate(RULES))}),
x AS (SELECT *, kind || ':' || start || ':' || stop AS s FROM s),
g AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, string_agg(s, ',' ORDER BY start, o) FILTER (o < 3) AS base, string_agg(s, ',' ORDER BY start, o) AS spans FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


QUERIES = {"op6_secrets": op6_secrets}
ORACLES = {"op6_secrets": _sql()}
