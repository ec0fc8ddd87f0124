"""Quotation linking of conversations; built from DataFrame functions only.

Lines are parsed into nested quote levels; runs of quoted lines are passages. A passage, normalised and hashed, is
joined to the earliest message of its conversation whose own text, paragraph or line has the same hash, or whose own
lines hold each paragraph of the passage as a run of consecutive lines (``parts``); that message is what the quoting one
replies to. Threads (the first message that a chain of replies leads to) come from pointer jumping.
Sorted by (conv_id, thread, turn), messages stand in reply order, each after what it replies to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import read, scratch, table

#: Quote marks at the start of a line; possessive, without a repeated group, so that no line overflows the stack.
MARK = "^[ \\t]*+>[> \\t]*+"


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))


def lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, i, level, line) of all lines."""
    d = messages.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\r?\\n", -1)).alias("i", "raw"))
    mark = F.regexp_extract("raw", MARK, 0)
    return d.select("conv_id", "turn", "i", F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.regexp_replace("raw", MARK, "").alias("line"))


def runs(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, at, passage): runs of lines of one level; blank lines end the runs of level 0.

    The windows go over the lines of one message."""
    w = W.partitionBy("conv_id", "turn").orderBy("i")
    blank = (F.col("level") == 0) & (F.trim("line") == "")
    p = parsed.withColumn("blank", blank).withColumn("new", F.coalesce((F.lag("level").over(w) != F.col("level")) | F.lag("blank").over(w), F.lit(True)).cast("int"))
    p = p.withColumn("run", F.sum("new").over(w)).where(~F.col("blank"))
    g = p.groupBy("conv_id", "turn", "run", "level").agg(F.min("i").alias("at"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("ls"))
    return g.select("conv_id", "turn", "level", "at", F.array_join(F.transform("ls", lambda x: x.line), "\n").alias("passage"))


RUN = ["conv_id", "turn", "level", "at"]


def parts(quoted: DataFrame, own: DataFrame, units: DataFrame) -> DataFrame:
    """(conv_id, turn, level, at, part): the earliest earlier message that holds every paragraph of a quoted run, each as
    one of its ``units`` or as consecutive lines, blank ones left out. Runs of one line are left to the units.

    Lines are looked up by the line of the paragraph that the conversation has least often, the others then compared."""
    hashes = lambda c, sep: F.transform(F.filter(F.transform(F.split(c, sep), normal), lambda x: x != ""), lambda x: F.xxhash64(x))
    p = quoted.withColumn("ps", F.filter(F.split("passage", "\\n\\s*\\n"), lambda x: normal(x) != ""))
    p = p.select(*RUN, F.size("ps").alias("n"), F.posexplode("ps").alias("p", "para"))
    p = p.select(*RUN, "n", "p", F.xxhash64(normal(F.col("para"))).alias("h"), hashes(F.col("para"), "\\n").alias("hs")).where((F.col("n") > 1) | (F.size("hs") > 1))
    whole = own.select("conv_id", F.col("turn").alias("origin"), hashes(F.col("body"), "\\r?\\n").alias("all"))
    places = whole.select("conv_id", "origin", F.posexplode("all").alias("k", "h"))
    often = places.groupBy("conv_id", "h").agg(F.count("*").alias("often"))
    line = p.select(*RUN, "n", "p", "hs", F.posexplode("hs").alias("j", "h")).join(often, ["conv_id", "h"], "left")
    line = line.groupBy(*RUN, "n", "p").agg(F.first("hs").alias("hs"), F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "j", "h")).alias("a"))
    start = F.col("k") - F.col("a.j")
    by_line = line.withColumn("h", F.col("a.h")).join(places, ["conv_id", "h"]).where(F.col("origin") < F.col("turn")).withColumn("start", start).where("start >= 0")
    by_line = by_line.join(whole, ["conv_id", "origin"]).where(F.slice("all", F.greatest("start", F.lit(0)) + 1, F.size("hs")) == F.col("hs"))
    by_unit = p.join(units.withColumnRenamed("turn", "origin"), ["conv_id", "h"]).where(F.col("origin") < F.col("turn"))
    found = by_line.select(*RUN, "n", "p", "origin").union(by_unit.select(*RUN, "n", "p", "origin")).distinct()
    return found.groupBy(*RUN, "n", "origin").agg(F.count("*").alias("got")).where("got = n").groupBy(*RUN).agg(F.min("origin").alias("part"))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, quote_depth, n_quotes, n_linked, reply_to, thread: a row for each message.

    ``body`` is the message without quotes. Null or empty texts have an empty body and no quotes. Fully equal rows give
    one row. Of different messages with one (conv_id, turn), the first by role and text (nulls first) takes part; the
    others, and rows with a null conv_id or turn, are returned with their body but linked with nothing.
    Quotes that no earlier message of the conversation has, paragraph by paragraph, stay unlinked; so do quotes of a part
    of a line and of a part of a paragraph in other line breaks. Other columns are ignored.
    """
    at = scratch(messages.sparkSession)
    all_ = messages.select("conv_id", "turn", "role", "text").distinct()
    first = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    all_ = table(all_.withColumn("alone", (first > 1) | F.col("conv_id").isNull() | F.col("turn").isNull()), at, "all")
    alone, m = all_.where("alone"), all_.where("not alone").drop("alone")
    quoting = F.coalesce(F.col("text").rlike("(?m)" + MARK), F.lit(False))
    m = table(m.withColumn("quoting", quoting), at, "messages")
    parsed = lines(m.where("quoting"))
    r = table(runs(parsed), at, "runs")
    quoted = r.where("level > 0")
    quotes = quoted.select(*RUN, F.xxhash64(normal(F.col("passage"))).alias("h"))
    body = r.where("level = 0").groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "passage"))), lambda x: x.passage), "\n\n").alias("own"))
    whole = m.join(body, ["conv_id", "turn"], "left").withColumn("body", F.when(F.col("quoting"), F.coalesce("own", F.lit(""))).otherwise(F.coalesce("text", F.lit(""))))
    whole = table(whole.select("conv_id", "turn", "role", "body", "quoting"), at, "bodies")
    convs = m.where("quoting").select("conv_id").distinct()
    own = whole.join(convs, "conv_id", "left_semi")
    units = own.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array("body"), F.split("body", "\\n\\s*\\n"), F.split("body", "\\r?\\n")))).alias("u"))
    units = units.withColumn("u", normal(F.col("u"))).where("u <> ''").select("conv_id", "turn", F.xxhash64("u").alias("h"))
    first = units.groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    q = quotes.join(first, ["conv_id", "h"], "left").join(parts(quoted, own, units), RUN, "left")
    q = q.withColumn("origin", F.least(F.when(F.col("origin") < F.col("turn"), F.col("origin")), "part"))
    q = q.groupBy("conv_id", "turn").agg(F.max("level").alias("quote_depth"), F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"), F.min(F.when(F.col("origin").isNotNull(), F.struct("level", "at", "origin"))).alias("best"))
    q = table(q.withColumn("reply_to", F.col("best.origin")).drop("best"), at, "quotes")
    up = q.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("top"))
    k = 0
    while True:
        # from every message halfway up its chain of replies: the number of rounds is the log of the longest chain
        nxt = up.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("higher"))
        j = table(up.join(nxt, ["conv_id", "top"], "left").select("conv_id", "turn", F.coalesce("higher", "top").alias("top"), F.col("higher").isNotNull().alias("moved")), at, f"up-{k}")
        up, k = j.drop("moved"), k + 1
        if j.where("moved").isEmpty():
            break
    out = whole.join(q, ["conv_id", "turn"], "left").join(up, ["conv_id", "turn"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("conv_id", "turn", "role", "body", zero("quote_depth"), zero("n_quotes"), zero("n_linked"), "reply_to", F.coalesce("top", "turn").alias("thread"))
    own = F.filter(F.split(F.coalesce("text", F.lit("")), "\\r?\\n", -1), lambda x: ~x.rlike(MARK))
    none = [F.lit(0).cast("long").alias(c) for c in ("quote_depth", "n_quotes", "n_linked")]
    alone = alone.select("conv_id", "turn", "role", F.array_join(own, "\n").alias("body"), *none, F.lit(None).cast(out.schema["reply_to"].dataType).alias("reply_to"), F.col("turn").alias("thread"))
    return out.unionByName(alone)


def op7_chat(spark, sf_dir):
    return linked(read(spark, sf_dir, "conversations"))


QUERIES = {"op7_chat": op7_chat}
ORACLES = {}
