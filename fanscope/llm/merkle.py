"""Merkle dataset manifest: trees of fan-out 3 built with lag and lead windows.

Each row is a leaf, H of its fields (H: lowercase hex SHA-256 of the inputs joined, digests as hex
text). Per source the leaves ascend by doc_id; while a level has more than one node, every `FAN`
consecutive nodes (the last run may be shorter, even one node) become the H of their digests. What
remains is the source's subroot, and the subroots, in order of source (null first, UTF-8 bytewise),
are joined likewise into the root.

Per level L the node of a run stands on the row of its first leaf, so its siblings stand FAN^L and
2*FAN^L rows before or behind: fixed offsets of lag and lead. The slot (place in the run) and the
run's length say which of them count. First-child rows hash the parents; rows behind them take their
ancestors' siblings with a running last().

Scale: texts are hashed in the scan and dropped there. Rows get their place in the source from a
range exchange and a sum over (partition, source) counts, so no task holds a source. The windows
run over blocks of FAN^LEVELS leaves, whose subtrees close by themselves; the blocks' roots, a
729th of the rows, are the next phase's leaves, until one is left. Paths come back by joins of
(source, block). The driver gets one number for each phase. Each phase is a written table.

Defined cases: a null field is `-`; a null doc_id comes first; rows that agree in doc_id are ordered
by leaf, and wholly repeated rows are leaves of their own; a lone leaf is its own subroot and root,
with an empty path; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanscope.llm.common import parallelism, written

#: Children of a node, and the levels that one phase of windows builds (blocks of 3^6 = 729 leaves).
FAN, LEVELS = 3, 6
FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}


def field(value: Column) -> Column:
    """A value as it goes into a leaf: `-` if null, else its UTF-8 byte count, `:`, itself."""
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(**changed: Column) -> Column:
    """H of a row's fields; `changed` gives other values for some."""
    return F.sha2(F.concat(*(field(changed.get(k, F.col(k)).cast(kind).cast("string")) for k, kind in FIELDS.items())), 256)


def group_key(source: Column) -> Column:
    """`source` as text that is never null and keeps the order null first, UTF-8 bytewise."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`df` with `pos`, the place in its group by `order` (from 0), and `n`, the group's rows.

    A range exchange sorts the rows over all partitions, whatever the groups' sizes (rows that agree
    in everything may part anywhere, as their last key is their place in the input); a row's place
    in its partition less that of its group's first row, plus the group's rows in the partitions
    before, is its place."""
    by = [group, *order]
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parallelism(df.sparkSession), *by, "_tie").sortWithinPartitions(*by, "_tie")
    rows = written(rows.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy(group, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group).orderBy("_part")
    counts = counts.select(
        group, "_part", "_first", F.sum("_rows").over(Window.partitionBy(group)).alias("n"),
        (F.sum("_rows").over(whole) - F.col("_rows")).alias("_before"))
    return (rows.join(counts, [group, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_part", "_first", "_before"))


def phase(nodes: DataFrame, group: str, levels: int) -> DataFrame:
    """The subtrees over blocks of FAN^levels nodes (columns `group`, pos, n, d and others): adds
    `block`; `path`, a list of (l, r): the digests of the siblings left and right of the node and of
    its ancestors in the block, level by level; and `top`, the block's root, on its first row."""
    size = FAN ** levels
    out = nodes.withColumn("block", F.expr(f"pos div {size}"))
    in_block = Window.partitionBy(group, "block").orderBy("pos")
    pos, none = F.col("pos"), F.lit("")
    kept = list(out.columns)
    out = out.withColumn("d0", F.col("d"))
    for level in range(levels):
        step = FAN ** level
        d = f"d{level}"
        out = out.withColumns({
            "g1": F.lag(d, step).over(in_block), "g2": F.lag(d, 2 * step).over(in_block),
            "e1": F.lead(d, step).over(in_block), "e2": F.lead(d, 2 * step).over(in_block)})
        level_n = F.expr(f"(n + {step - 1}) div {step}")
        slot = F.expr(f"(pos div {step}) % {FAN}")
        run = level_n - F.expr(f"pos div {step}") + slot  # nodes from the run's first on, to the level's end
        left = F.when(slot == 0, none).when(slot == 1, F.col("g1")).otherwise(F.concat("g2", "g1"))
        behind = F.concat(F.when(run > 1, F.col("e1")).otherwise(none), F.when(run > 2, F.col("e2")).otherwise(none))
        right = F.when(slot == 0, behind).when((slot == 1) & (run > 2), F.col("e1")).otherwise(none)
        parent = F.when(level_n > 1, F.sha2(F.concat(F.col(d), behind), 256)).otherwise(F.col(d))
        out = out.select(
            *kept, F.when((pos % step == 0) & (level_n > 1), F.struct(left.alias("l"), right.alias("r"))).alias(f"s{level}"),
            F.when(pos % (step * FAN) == 0, parent).alias(f"d{level + 1}"))
        kept.append(f"s{level}")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumns({f"s{k}": F.last(f"s{k}", ignorenulls=True).over(so_far) for k in range(1, levels)})
    siblings = [f"s{k}" for k in range(levels)]
    return (out.withColumn("path", F.filter(F.array(*siblings), lambda s: s.isNotNull()))
            .withColumnRenamed(f"d{levels}", "top").drop(*siblings))


def tree(nodes: DataFrame, group: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Trees over the nodes (`group`, pos, n, d and others) of each group, of up to `most` nodes.
    Returns the nodes with `path` (to their group's root), and for each group its root `d`."""
    built = []
    while True:
        levels = next((k for k in range(1, LEVELS) if FAN ** k >= most), LEVELS)
        built.append(written(phase(nodes, group, levels), "merkle-phase"))
        size = FAN ** levels
        nodes = built[-1].filter(F.col("pos") % size == 0).select(
            group, F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("d"))
        most = -(-most // size)
        if most <= 1:
            break
    above = None
    for level in reversed(built):
        level = level.drop("n", "top")
        if above is not None:
            up = above.select(group, F.col("pos").alias("block"), F.col("path").alias("_up"))
            level = level.join(up, [group, "block"]).withColumn("path", F.concat("path", "_up")).drop("_up")
        above = level.drop("block")
    return above.drop("pos", "d"), nodes.select(group, "d")


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """For each row of `docs` (`FIELDS`): doc_id, source, leaf, subroot, root and path, a list of
    (l, r): the digests left and right of the row's node, level by level up to the root. `carry`
    names further columns to work out of each row while its text is at hand."""
    carry = carry or {}
    leaves = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), group_key(F.col("source")).alias("key"), leaf_digest().alias("d"),
        *(c.alias(k) for k, c in carry.items())), "merkle-leaves")
    nodes = placed(leaves, "key", ["doc_id", "d"])
    most = nodes.agg(F.max("n")).first()[0] or 1
    rows, subroots = tree(nodes.withColumn("leaf", F.col("d")), "key", most)
    tops = placed(subroots.withColumn("subroot", F.col("d")).withColumn("all", F.lit(0)), "all", ["key"])
    sources, root = tree(tops, "all", tops.count())
    root = root.withColumnRenamed("d", "root")
    sources = sources.join(F.broadcast(root), "all").select("key", "subroot", "root", F.col("path").alias("_up"))
    return rows.join(sources, "key").select(
        "doc_id", F.expr("if(key = '', null, substring(key, 2))").alias("source"), "leaf", "subroot", "root",
        F.concat("path", "_up").alias("path"), *carry)


def proof(path: Column) -> Column:
    """H of the siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["l"], s["r"]))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda x, s: F.sha2(F.concat(s["l"], x, s["r"]), 256))


def merkle_report(docs: DataFrame) -> DataFrame:
    """For each row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified,
    where rows whose crc32(doc_id) is even are tampered with: their text loses its line feeds."""
    is_hit = (F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    tampered = F.when(is_hit, leaf_digest(text=F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))))
    rows = manifest(docs, {"tampered": tampered})
    return (rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
            .select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


@functools.cache
def oracle() -> str:
    """DuckDB SQL for merkle_report: a recursive query groups the runs of each level, and each leaf
    climbs level by level. crc32 is folded over the id's digits (reflected polynomial 0xEDB88320)."""
    fields = " || ".join(f"CASE WHEN {k} IS NULL THEN '-' ELSE strlen(CAST({k} AS VARCHAR)) || ':' || {k} END" for k in FIELDS)
    digits = "list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(CAST(doc_id AS VARCHAR), '')])"
    shift = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b), [i::BIGINT for i in range(8)]), lambda c, i: {shift})"
    return f"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS id, *, xor(list_reduce({digits}, lambda a, b: {byte}), 4294967295) AS crc FROM documents),
l AS (SELECT id, doc_id, source, sha256({fields}) AS leaf,
        sha256({fields.replace('text', 't')}) AS bent
      FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM f)),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos FROM l),
s AS (SELECT 0 AS lev, source, pos, leaf AS d, count(*) OVER (PARTITION BY source) AS n FROM p
      UNION ALL
      SELECT lev + 1, source, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3
      FROM s WHERE n > 1 GROUP BY lev, source, pos // 3, n),
u AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS pos,
        count(*) OVER () AS n FROM s WHERE n = 1),
v AS (SELECT 0 AS lev, pos, subroot AS d, n FROM u
      UNION ALL
      SELECT lev + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3
      FROM v WHERE n > 1 GROUP BY lev, pos // 3, n),
sr AS (SELECT lev, source, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM s WHERE n > 1 GROUP BY ALL),
vr AS (SELECT lev, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM v WHERE n > 1 GROUP BY ALL),
a AS (SELECT id, 0 AS lev, source, pos, bent AS x, '' AS sib FROM p
      UNION ALL
      SELECT a.id, a.lev + 1, a.source, a.pos // 3,
        sha256(array_to_string(sr.ds[:a.pos % 3], '') || a.x || array_to_string(sr.ds[a.pos % 3 + 2:], '')),
        a.sib || array_to_string(sr.ds[:a.pos % 3], '') || array_to_string(sr.ds[a.pos % 3 + 2:], '')
      FROM a JOIN sr ON a.lev = sr.lev AND a.source IS NOT DISTINCT FROM sr.source AND a.pos // 3 = sr.run),
am AS (SELECT id, arg_max(x, lev) AS x, arg_max(sib, lev) AS sib FROM a GROUP BY id),
b AS (SELECT am.id, 0 AS lev, u.pos, am.x, am.sib FROM am JOIN p ON am.id = p.id JOIN u ON p.source IS NOT DISTINCT FROM u.source
      UNION ALL
      SELECT b.id, b.lev + 1, b.pos // 3,
        sha256(array_to_string(vr.ds[:b.pos % 3], '') || b.x || array_to_string(vr.ds[b.pos % 3 + 2:], '')),
        b.sib || array_to_string(vr.ds[:b.pos % 3], '') || array_to_string(vr.ds[b.pos % 3 + 2:], '')
      FROM b JOIN vr ON b.lev = vr.lev AND b.pos // 3 = vr.run),
bm AS (SELECT id, arg_max(x, lev) AS x, arg_max(sib, lev) AS sib FROM b GROUP BY id)
SELECT p.doc_id, p.leaf, u.subroot, r.d AS root, sha256(bm.sib) AS proof_sha256, bm.x AS folded_root, bm.x = r.d AS verified
FROM p JOIN bm ON p.id = bm.id JOIN u ON p.source IS NOT DISTINCT FROM u.source, (SELECT d FROM v WHERE n = 1) r"""
