"""Mixing sources to target weights: a low-discrepancy source schedule.

Each source's documents are shuffled (by a hash) and laid end to end, and that line of words is cut
into blocks of equal length. Slot i of the schedule takes the point frac(i / golden ratio), which a
table of cumulative weights maps to a source; the slot's rank among its source's slots gives pass
and block: rank r takes block r mod n in pass r div n. So every prefix of the schedule is close to
the weights, and a source is read through before any of it is read again.

Sizes are counts of words (runs of characters other than space, tab, line feed, vertical tab, form
feed and carriage return). Sources in order of code points, null last, weigh 1, 2, 3, 1, 2, 3 and
so on, and share all words by weight; a target stops at `MOST` times its source's size, and the
excess is shared by weight among the others until none is above.

Scale: texts are read once, to count words; later steps use thin rows. A source of any size is
split: prefix sums run over (source, bucket of the shuffle hash), so no task holds a source, and
ranks run over (chunk of slots, source). There may be any number of sources: their order, targets and
cumulative weights come of range exchanges and sums, and points meet weights cell by cell. The
driver gets sums over all sources alone.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source;
repeated rows are documents of their own; a table without rows gives none; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanscope.llm.common import fresh, parallelism, text_or_empty, written
from fanscope.llm.merkle import placed
from fanscope.operators.joins import spread_join

#: Words of a block in large sources, and the blocks that a source has at least (if it has as many words).
BLOCK_WORDS, MIN_BLOCKS = 4096, 256
#: How often a source may be passed through.
MOST = 3
#: Slots whose ranks one task finds together, and documents to a bucket of the shuffle.
CHUNK, BUCKET_ROWS = 1 << 16, 20_000
#: Units of weight in a slot, and slots in a cell, in which points look for their source.
UNITS, CELL = 1 << 20, 64
#: Sources whose rows are broadcast (about 1 MB); with more, each source's documents are spread over slices.
FEW, SLICES = 10_000, 16
GOLDEN = (math.sqrt(5) - 1) / 2
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """Thin rows doc_id, missing (no source), source, size, h (the place in the shuffle), written once."""
    text, source = text_or_empty(), F.col("source").cast("string")
    return written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(4), F.col("doc_id").cast("long"), text).alias("h")), "mix-sizes")


def level(shares: DataFrame) -> float:
    """The words that a source of weight 1 gets where no bound is reached: those of `shares` (size,
    weight) that reach theirs, `MOST` times their size, leave the rest to the others."""
    bound = MOST * F.col("size")
    total, weight = shares.agg(F.sum("size"), F.sum("weight")).first()
    if not total:
        return 0.0
    found, before = total / weight, -1.0
    while found != before:  # it only rises, and with it the sources that reach their bound
        over = bound < F.lit(found) * F.col("weight")
        taken, free = shares.agg(F.sum(F.when(over, bound).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        before, found = found, (total - taken) / free
    return found


def source_table(sizes: DataFrame) -> DataFrame:
    """For each source: k (its place in the order), missing, source, source_size, target, block (its
    length in words), blocks, low and units (its stretch of the cumulative weights); written once."""
    per = sizes.groupBy("missing", "source").agg(F.sum("size").alias("size")).withColumn("all", F.lit(0))
    per = placed(per, "all", ["missing", "source"]).withColumnRenamed("pos", "k").withColumn("weight", F.col("k") % 3 + 1)
    per = written(per.select("k", "missing", "source", "size", "weight"), "mix-weights")
    target = F.least(MOST * F.col("size").cast("double"), F.lit(level(per)) * F.col("weight"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.expr(f"size div {MIN_BLOCKS}")))
    per = per.withColumn("target", target).withColumn("block", block.cast("long"))
    per = per.withColumn("blocks", F.expr("(size + block - 1) div block"))
    return weighted(per.withColumnRenamed("size", "source_size"))


def weighted(sources: DataFrame) -> DataFrame:
    """`sources` (k, source_size, target, blocks and others) with low and units; written once. A source
    has as many slots as its target has blocks."""
    slots = F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0))
    per = sources.withColumn("units", F.round(slots * UNITS).cast("long")).withColumn("part", F.expr(f"k div {FEW}"))
    sums = per.groupBy("part").agg(F.sum("units").alias("units"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for 10,000 sources
    sums = sums.select("part", F.coalesce(F.sum("units").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return written(per.join(sums, "part")
                   .withColumn("low", F.col("before") + F.coalesce(F.sum("units").over(own), F.lit(0)))
                   .drop("part", "before", "weight"), "mix-sources")


def schedule(sources: DataFrame) -> DataFrame:
    """The mix in order: slot, k (source), pass, block. `sources` as `weighted` gives them."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("units")).first()[0] or 0
    n, cell = -(-total // UNITS), CELL * UNITS
    parts = max(1, min(parallelism(spark), -(-n // CHUNK)))
    turn = (F.col("id") + 0.5) * GOLDEN
    points = spark.range(0, n, 1, parts).select(
        F.col("id").alias("slot"), F.expr(f"id div {CHUNK}").alias("chunk"),
        F.least(F.floor((turn - F.floor(turn)) * total).cast("long"), F.lit(total - 1)).alias("at"))
    # A source's stretch is in each cell that it touches; a point looks in its own cell.
    first, last = F.expr(f"low div {cell}"), F.expr(f"(low + units - 1) div {cell}")
    stretches = sources.filter("units > 0").select("k", "blocks", "low", "units", F.explode(F.sequence(first, last)).alias("cell"))
    slot = (points.withColumn("cell", F.expr(f"at div {cell}")).join(stretches, "cell")
            .filter("at >= low AND at < low + units").select("slot", "chunk", "k", "blocks"))
    before = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = slot.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select("k", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    rank = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1 + F.col("n_before")
    return (slot.join(counts, ["k", "chunk"]).withColumn("rank", rank).filter(F.col("rank") < MOST * F.col("blocks"))
            .select("slot", "k", F.expr("rank div blocks").alias("pass"), (F.col("rank") % F.col("blocks")).alias("block")))


def with_source(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of `sized` with their source's k, length (of a block), source_size and target."""
    of = sources.select("missing", "source", "k", F.col("block").alias("length"), "source_size", "target")
    if sources.count() <= FEW:
        return sizes.join(F.broadcast(of), ["missing", "source"])
    key = F.struct("missing", "source")
    return spread_join(sizes.withColumn("key", key), of.withColumn("key", key).drop("missing", "source"), "key", "h", SLICES).drop("key")


def pieces(docs: DataFrame) -> DataFrame:
    """What the blocks hold, of documents that have words (`with_source`): their columns, start (in the
    line of their source), block, words (of the document in this block)."""
    bits = max(4, min(24, math.ceil(math.log2(max(1, docs.count() / BUCKET_ROWS)))))
    docs = docs.withColumn("bucket", F.shiftright("h", 64 - bits))
    ahead = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("k", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("k", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_before"))
    own = Window.partitionBy("k", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    docs = (docs.join(sums, ["k", "bucket"])
            .withColumn("start", F.col("n_before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
            .withColumn("end", F.col("start") + F.col("size")))
    docs = docs.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.expr("start div length"), F.expr("(end - 1) div length"))))
    low, high = F.col("block") * F.col("length"), (F.col("block") + 1) * F.col("length")
    return (docs.withColumn("words", F.least("end", high) - F.greatest("start", low))
            .drop("bucket", "n_before", "end", "length", "missing", "source"))


def taken_words(sizes: DataFrame) -> DataFrame:
    """For each row of `sizes`: k, doc_id, h, size, source_size, target, taken (words that the mix
    takes, repeats counted)."""
    sources = source_table(sizes)
    docs = written(with_source(sizes, sources), "mix-documents")
    visits = schedule(sources).groupBy("k", "block").agg(F.count("*").alias("visits"))
    # A document with words is known by its source and start there.
    kept = ["k", "doc_id", "h", "size", "source_size", "target"]
    taken = (pieces(docs).join(visits, ["k", "block"], "left").groupBy(*kept, "start")
             .agg(F.sum(F.col("words") * F.coalesce("visits", F.lit(0))).alias("taken")).drop("start"))
    return taken.unionByName(docs.filter("size = 0").select(*kept, F.lit(0).cast("long").alias("taken")))


def mix_report(docs: DataFrame) -> DataFrame:
    """For each row of `docs` (doc_id, text, source): doc_id, size, source_size, target (its
    source's), taken (words that the mix takes of it, repeats counted)."""
    return taken_words(sized(docs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """`docs` as the mix takes them, with the same columns: a document is there as often as its
    taken words fill its size, rounded (so 0 to `MOST` times). Rows that agree in doc_id and text
    share what the mix takes of them evenly, rounded."""
    key, times = fresh(docs, "_key"), fresh(docs, "_times")
    # h is a hash of doc_id and text.
    taken = (taken_words(sized(docs)).groupBy(F.col("h").alias(key))
             .agg(F.expr("cast(round(try_divide(sum(taken), sum(size))) as int)").alias(times)).filter(F.col(times) > 0))
    marked = docs.withColumn(key, F.xxhash64(F.lit(4), F.col("doc_id").cast("long"), text_or_empty()))
    return (marked.join(taken, key).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
            .select(*docs.columns))
