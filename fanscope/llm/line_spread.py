"""Line dedup: distinct-site spread.

For each distinct line a HyperLogLog sketch of its sites (`source`) is built where the line is read
and merged by aggregation. Lines whose estimate is clearly below the threshold stay, those clearly
above are boilerplate, and those near it get an exact distinct count. Boilerplate lines go from
every text; all else stays as it was.

A line is what stands between line feeds, without white space at its ends; lines of white space
only are neither counted nor removed. Lines are equal if two 64-bit hashes agree.

Scale: sketches are merged map-side, so a line that stands in a third of all rows is one small row
for each task; exact counts run over distinct (line, site) pairs of the few lines near the
threshold. Boilerplate lines are broadcast only if counted at `BROADCAST_LINES` or fewer, and
joined by hash otherwise. Texts are joined with their removed line numbers by a hash of the text,
so equal texts are decided once.

Defined cases: a null text counts as empty and comes out empty; a null source is a site; a line
that repeats in a text goes everywhere in it; repeated rows stay repeated; a table without rows
gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanscope.llm.common import text_or_empty, written

#: A line on so many sites or more is boilerplate.
MIN_SITES = 5
#: Sketches have 2**LG_K slots, for a relative error of 1.04 / 2**(LG_K / 2); lines within
#: SIGMAS such errors of the threshold, and one site at least, are counted exactly.
LG_K, SIGMAS = 12, 5
BROADCAST_LINES = 200_000
BLANKS = " \t\x0b\x0c\r"


def _hashes(c: Column) -> tuple[Column, Column]:
    return F.xxhash64(c).alias("k1"), F.xxhash64(F.lit(9), c).alias("k2")


def _lines(docs: DataFrame) -> DataFrame:
    """t1, t2 (hashes of the text), site, pos, k1, k2 of every line that isn't blank."""
    text = text_or_empty()
    rows = docs.select(*[h.alias(f"t{k}") for k, h in enumerate(_hashes(text), 1)],
                       F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("site"),
                       F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    line = F.expr(f"trim(BOTH '{BLANKS}' FROM line)")
    return rows.withColumn("line", line).filter("line <> ''").select("t1", "t2", "site", "pos", *_hashes(F.col("line")))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """k1, k2 of the lines on `min_sites` sites or more, written."""
    lines = _lines(docs)
    band = max(1.0, SIGMAS * 1.04 / 2 ** (LG_K / 2) * min_sites)
    spread = (lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
              .select("k1", "k2", F.hll_sketch_estimate("sketch").alias("sites"))
              .filter(F.col("sites") >= min_sites - band))
    spread = written(spread, "line-spread")
    near = spread.filter(F.col("sites") <= min_sites + band).select("k1", "k2")
    exact = (lines.select("k1", "k2", "site").join(near, ["k1", "k2"], "left_semi")
             .distinct().groupBy("k1", "k2").agg(F.count("*").alias("sites")))
    sure = spread.filter(F.col("sites") > min_sites + band)
    return written(sure.unionByName(exact).filter(F.col("sites") >= min_sites).select("k1", "k2"), "line-boilerplate")


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """For each row of `docs` (doc_id, text, source): doc_id, source, n_lines (that aren't blank),
    n_removed, clean_text (the lines that stay, blank ones too, joined by line feeds)."""
    found = boilerplate_lines(docs, min_sites)
    if found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        found = F.broadcast(found)  # 3.2 MB at most
    removed = (_lines(docs).join(found, ["k1", "k2"], "left_semi")
               .groupBy("t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    text = text_or_empty()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), text.alias("text"),
                       *[h.alias(f"t{k}") for k, h in enumerate(_hashes(text), 1)])
    lines = F.col("lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    count = F.size(F.filter(lines, lambda x: F.call_function("btrim", x, F.lit(BLANKS)) != ""))
    return (rows.join(removed, ["t1", "t2"], "left").withColumn("lines", F.split("text", "\n"))
            .select("doc_id", "source", count.cast("long").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), clean.alias("clean_text")))


def oracle(min_sites: int = MIN_SITES) -> str:
    blanks = "chr(32) || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
a AS (SELECT r, source, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT r, coalesce('=' || source, '') AS site, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM a),
t AS (SELECT *, trim(line, {blanks}) AS key FROM l),
b AS (SELECT key FROM t WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= {min_sites}),
f AS (SELECT t.*, b.key IS NOT NULL AS gone FROM t LEFT JOIN b ON t.key = b.key),
s AS (SELECT r, count(*) FILTER (WHERE key <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
      string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS clean_text FROM f GROUP BY r)
SELECT d.doc_id, d.source, s.n_lines, s.n_removed, coalesce(s.clean_text, '') AS clean_text
FROM d JOIN s ON d.r = s.r"""
