"""MinHash near-duplicate detection with odd sketches; built from DataFrame functions only.

1. A document's set is its distinct 3-word shingles as 64-bit hashes. Documents with equal sets form a class (grouped by
   a 128-bit key of the set), so copies never form pairs; everything after works on one representative of each class.
2. Sets of up to ``SMALL`` shingles are filed under the members of their prefix: shingles are ordered by how often small
   sets hold them (counts in 65,536 hash buckets, so of fixed size), rare ones first; linked sets share a member of
   their prefixes for certain, and a passage that many documents share is in few of these.
3. Larger sets: 64 MinHash samples (the least hashes of 16 parts of the hash range, under 4 hash functions) form 16 bands
   of 4. A link of similarity 0.85 is missed by all bands with probability 8e-6.
   256 MinHash samples (64 parts each) are folded into an odd sketch: a 1,024-bit parity bitmap whose XOR population count
   estimates the similarity, so that band partners that are no near match are given up before their sets are fetched.
   Prefix partners are never judged by the sketch.
4. Band buckets are worked off in rounds. In a round, some members of each bucket are centres: first the one with the
   most band partners, then random ones, four times as many each round. Members that don't yet share a component with a
   centre are compared with it. A bucket is done when all its members are in one component or all have been centres, so
   nothing is lost and a hot bucket costs a pass, not all its pairs; only open buckets go on to the next round.
5. Pairs are first compared by their shingles' lowest 16 bits, which gives an upper bound of the intersection (exact
   rejection with a quarter of the bytes); what passes is confirmed on the full sets.
6. Components come from label propagation with pointer jumping over confirmed links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, drop, read, scratch, small, table

SPACE = "[ \\t-\\r]+"
ROWS, BITS, WORDS = 4, 1024, 16
#: Standard deviations above the expected flips of a link at which the sketch gives up a pair: 3e-7 of links at exactly
#: the threshold, fewer above it.
SURE = 5.0
SALTS = 16
#: Up to so many shingles, candidates come from prefixes. The prefix of n hashes has n - ceil(0.85 n) + 1 of them.
SMALL = 64
#: Hash buckets in which the shingles of small sets are counted.
COUNTED = 1 << 16


def shingles(text: Column) -> tuple[Column, ...]:
    """(words, shingles of words): for use in two projections, words first."""
    words = F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SPACE, -1), "")
    w = F.col("w")
    three = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return words, F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < 3, F.array(F.xxhash64(F.size(w), w))).otherwise(F.array_distinct(three))


def sets(documents: DataFrame) -> DataFrame:
    """(doc_id, hs): the set of each document, sorted."""
    words, hs = shingles(F.col("text"))
    return documents.select("doc_id", words.alias("w")).select("doc_id", F.sort_array(hs).alias("hs"))


def arc_minima(h: str) -> str:
    """SQL for 16 MinHash samples of the sorted array ``h``: the least value of each sixteenth of the hash range, or,
    where that is empty, the next value on the circle."""
    first = f"filter({h}, (x, i) -> i = 0 or shiftright(x, 60) <> shiftright({h}[i - 1], 60))"
    fill = "flatten(transform(f, (x, i) -> array_repeat(x, cast(shiftright(x, 60) - if(i = 0, -9L, shiftright(f[greatest(i - 1, 0)], 60)) as int))))"
    tail = "array_repeat(f[0], cast(7L - shiftright(element_at(f, -1), 60) as int))"
    return f"transform(array({first}), f -> concat({fill}, {tail}))[0]"


def flips_allowed(samples: Column, num: int, den: int) -> Column:
    """XOR population counts up to which two sketches of so many samples may belong to a link."""
    part = (den - num) / den
    mean = (BITS / 2) * (1 - F.exp(-samples * (4 * part / BITS)))
    return mean + SURE * (2 * F.sqrt(samples * (part * (1 - part)))) + 2


def signatures(documents: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, n, k1, k2, few, bands, m, s0..s15): set size, set key; for small sets the set itself; for large ones
    their band keys, number of samples and odd sketch; those about the boundary have both. Equal rows become one."""
    large = F.col("n") > SMALL * num // den
    d = sets(documents).withColumn("n", F.size("hs").cast("long"))
    hashed = [F.col("hs"), *[F.expr(f"sort_array(transform(hs, x -> xxhash64(x, {r})))") for r in range(1, ROWS)]]
    d = d.select("doc_id", "n", "hs", *[F.when(large, h).alias(f"h{r}") for r, h in enumerate(hashed)])
    least = [F.expr(f"filter(h{r}, (x, i) -> i = 0 or shiftright(x, 58) <> shiftright(h{r}[i - 1], 58))").alias(f"l{r}") for r in range(ROWS)]
    few = F.when(F.col("n") <= few_most(num, den), F.col("hs"))
    d = d.select("doc_id", "n", F.xxhash64("hs").alias("k1"), F.xxhash64(F.lit(7), F.col("hs")).alias("k2"), few.alias("few"), *least)
    # a word of the sketch holds the samples of one hash function and a quarter of its parts
    word = lambda r, q: F.expr(f"aggregate(filter(l{r}, x -> shiftright(x, 62) = {q - 2}L), 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63L as int)))")
    m = reduce(lambda a, b: a + b, [F.size(f"l{r}") for r in range(ROWS)])
    own = ["doc_id", "n", "k1", "k2", "few"]
    d = d.select(*own, m.alias("m"), *[word(r, q).alias(f"s{4 * r + q}") for r in range(ROWS) for q in range(4)], *[F.when(large, F.expr(arc_minima(f"l{r}"))).alias(f"m{r}") for r in range(ROWS)])
    bands = F.expr("transform(m0, (x, i) -> xxhash64(i, x, m1[i], m2[i], m3[i]))")
    return d.select(*own, bands.alias("bands"), "m", *[f"s{q}" for q in range(WORDS)]).dropDuplicates(["doc_id", "k1", "k2"])


def few_most(num: int, den: int) -> int:
    """Size up to which sets have prefix keys: sets linked with one of up to ``SMALL`` have no more."""
    return SMALL * den // num + 1


def prefixes(reps: DataFrame, num: int, den: int) -> Column:
    """Keys of small sets: their rarest members. The counts have a fixed number of buckets, and any order would do."""
    slot = F.pmod(F.col("h"), F.lit(COUNTED)).cast("int")
    got = {r.b: r.n for r in reps.where("few is not null").select(F.explode("few").alias("h")).groupBy(slot.alias("b")).agg(F.count("*").alias("n")).collect()}
    often = F.split(F.lit(",".join(str(got.get(b, 0)) for b in range(COUNTED))), ",").cast("array<bigint>")
    ranked = F.array_sort(F.transform("few", lambda x: F.struct(F.get(often, F.pmod(x, F.lit(COUNTED)).cast("int")).alias("c"), x.alias("x"))))
    first = F.slice(ranked, 1, F.expr(f"cast(n - ceil(n * {num} / {den}) + 1 as int)"))
    return F.transform(first, lambda x: F.xxhash64(F.lit("prefix"), x.x))


def components(edges: DataFrame, labels: DataFrame | None, at: str, name: str) -> DataFrame:
    """(v, label): the least id reachable over ``edges`` (a, b); ``labels`` are those of earlier edges, if any."""
    both = table(edges.select(F.col("a").alias("v"), F.col("b").alias("o")).union(edges.select("b", "a")).distinct(), at, f"{name}-both")
    lab = both.select("v").distinct().withColumn("label", F.col("v"))
    if labels is not None:
        lab = lab.union(labels.select("v", "label")).groupBy("v").agg(F.min("label").alias("label"))
        both = both.union(labels.select("v", "label").where("v <> label")).union(labels.select("label", "v").where("v <> label"))
    lab, k = table(lab, at, f"{name}-0"), 0
    while True:
        k += 1
        near = both.join(lab.withColumnsRenamed({"v": "o", "label": "l"}), "o").groupBy("v").agg(F.min("l").alias("l"))
        new = lab.join(near, "v", "left").select("v", "label", F.least("label", F.coalesce("l", "label")).alias("low"))
        jump = new.select(F.col("v").alias("low"), F.col("low").alias("lower"))
        new = new.join(jump, "low", "left").select("v", F.least("low", F.coalesce("lower", "low")).alias("label"), (F.least("low", F.coalesce("lower", "low")) != F.col("label")).alias("moved"))
        lab = table(new, at, f"{name}-{k}")
        if lab.where("moved").isEmpty():
            return lab.drop("moved")


def confirmed(full: DataFrame, pairs: DataFrame, num: int, den: int, at: str, name: str) -> DataFrame:
    """Those pairs (a, b) whose sets, of the table ``full`` (v, hs), have den * intersection >= num * union."""

    def beside(p: DataFrame, sets: DataFrame) -> DataFrame:
        for side in ("b", "a"):
            p = p.join(sets.select(F.col("v").alias(side), F.col("hs").alias(f"h{side}"), F.col("n").alias(f"n{side}")), side)
        return p

    fold = full.select("v", F.size("hs").cast("long").alias("n"), F.array_distinct(F.transform("hs", lambda x: (x.bitwiseAND(F.lit(65535)) - 32768).cast("smallint"))).alias("hs"))
    lost = F.least(*[F.col(f"n{s}") - F.size(f"h{s}") for s in "ab"])
    most = F.size(F.array_intersect("ha", "hb")) + lost
    total = F.col("na") + F.col("nb")
    near = table(beside(pairs, fold).where(most * den >= (total - most) * num).select("a", "b"), at, f"{name}-near")
    ids = small(near.select(F.col("a").alias("v")).union(near.select("b")).distinct())
    i = F.size(F.array_intersect("ha", "hb"))
    exact = beside(near, full.join(ids, "v", "left_semi").withColumn("n", F.size("hs").cast("long")))
    return table(exact.where(i * den >= (total - i) * num).select("a", "b"), at, f"{name}-links")


def classes(documents: DataFrame, num: int = 85, den: int = 100, at: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; doc_ids are expected to be unique. Bands and sketch are
    laid out for thresholds num / den of 0.85 or more.

    Null texts and texts without words have an empty set, are linked with nothing and kept. Rows that repeat a doc_id
    with an equal set give one row. Rows with a null doc_id are kept, without a component. Other columns are ignored.
    """
    spark, at = documents.sparkSession, at or scratch(documents.sparkSession)
    documents = documents.select("doc_id", "text")
    sketch = ["m", *[f"s{q}" for q in range(WORDS)]]
    sig = table(signatures(documents, num, den), at, "signatures")
    known = sig.where("n > 0 and doc_id is not null")
    groups = table(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), at, "groups")
    copies = groups.where("c > 1").select("k1", "k2", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    member = sig.withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int")).join(copies, ["k1", "k2", "salt"], "left")
    member = table(member.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), at, "members")
    reps = known.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    none = F.array().cast("array<bigint>")
    small_keys = F.when(F.col("few").isNotNull(), prefixes(reps, num, den)).otherwise(none)
    keyed = reps.select(F.col("doc_id").alias("v"), F.explode(F.concat(small_keys, F.coalesce("bands", none))).alias("key"))
    sizes = table(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), at, "sizes")
    u = F.pmod(F.xxhash64("key", "v"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    inb = table(keyed.join(sizes, "key").select("key", "v", "size", u.alias("u")), at, "filed")
    degree = table(inb.groupBy("v").agg(F.sum("size").alias("degree")), at, "degree")
    full = table(sets(documents.join(small(degree.select(F.col("v").alias("doc_id"))), "doc_id", "left_semi")).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "v"), at, "sets")
    by_v = degree.join(reps.select(F.col("doc_id").alias("v"), "n", *sketch), "v")
    cur = table(inb.join(by_v, "v").withColumn("label", F.col("v")), at, "open-0")
    drop(spark, *[f"{at}/{x}" for x in ("signatures", "groups", "sizes", "filed", "degree")])
    labels, used, k = None, 0.0, 0
    wide = ["v", "n", *sketch, "label"]
    while True:
        if k:
            open_ = cur.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("size").alias("z")).where(f"lo <> hi and z > {used}").select("key")
            cur = table(cur.join(small(table(open_, at, f"keys-{k}")), "key", "left_semi"), at, f"open-{k}")
            drop(spark, f"{at}/open-{k - 1}", f"{at}/keys-{k}", f"{at}/pairs-{k - 1}", f"{at}/round-{k - 1}-near", f"{at}/round-{k - 1}-links")
            if cur.isEmpty():
                break
            now = float(4**k)
            centre = cur.where((F.col("u") * F.col("size") < now) & (F.col("u") * F.col("size") >= used)).select("key", F.struct(*wide).alias("c"))
            used = now
        else:
            centre = cur.groupBy("key").agg(F.max(F.struct("degree", (-F.col("v")).alias("o"), *wide)).alias("c"))
        pairs = cur.join(centre, "key").where(F.col("label") != F.col("c.label"))
        flips = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"s{q}").bitwiseXOR(F.col(f"c.s{q}"))) for q in range(WORDS)])
        alike = flips <= flips_allowed(F.greatest("m", "c.m"), num, den)
        near = (F.least("n", "c.n") * den >= F.greatest("n", "c.n") * num) & ((F.least("n", "c.n") <= few_most(num, den)) | F.coalesce(alike, F.lit(True)))
        pairs = table(pairs.where(near).select(F.least("v", "c.v").alias("a"), F.greatest("v", "c.v").alias("b")).distinct(), at, f"pairs-{k}")
        if not pairs.isEmpty():
            links = confirmed(full, pairs, num, den, at, f"round-{k}")
            if not links.isEmpty():
                labels = table(components(links, labels, f"{at}/labels-{k}", "c"), at, f"component-{k}")
                drop(spark, f"{at}/labels-{k}")
                near_now = small(labels.withColumnRenamed("label", "new"))
                cur = cur.join(near_now, "v", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
        k += 1
    out = member if labels is None else member.join(labels.withColumnRenamed("v", "rep"), "rep", "left")
    comp = F.col("rep") if labels is None else F.coalesce("label", "rep")
    drop(spark, f"{at}/sets", f"{at}/open-{k}")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """The documents with the smallest doc_id of their near-duplicate component, all columns kept, and those without a
    doc_id."""
    spark, at = documents.sparkSession, scratch(documents.sparkSession)
    gone = small(table(classes(documents, num, den, f"{at}/work").where(~F.col("kept")).select("doc_id"), at, "drop"))
    drop(spark, f"{at}/work")
    return documents.join(gone, "doc_id", "left_anti").select(documents.columns)


def op5_near_duplicates(spark, sf_dir):
    return classes(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS o FROM documents UNION SELECT r.v, e2.b FROM r JOIN e2 ON e2.a = r.o)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(o) AS c FROM r GROUP BY v) c USING (doc_id)
"""
QUERIES = {"op5_near_duplicates": op5_near_duplicates}
ORACLES = {"op5_near_duplicates": SQL}
