"""Declared schemas of the logical input tables.

The original job reads tab-separated text with positional fields; here every
table has named, typed columns. Raw TSV positions are listed next to each field
so the TSV reader and the docs share one definition.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TsvLayout:
    """Where a table's fields sit in a raw tab-separated line.

    `min_fields_exclusive` is the ragged-row guard: lines with this many fields
    or fewer are skipped (trailing empty fields don't count). `width` is the
    number of fields that are declared; what stands behind them is not read.
    """
    min_fields_exclusive: int
    positions: dict[str, int]
    width: int


# name -> (raw position). Only the fields the analysis reads are listed.
FACT_LIKE_TSV = TsvLayout(2, {"fact_id": 0, "person_id": 1, "like_id": 2}, width=8)
DIM_LIKE_TSV = TsvLayout(3, {"like_id": 0, "name": 1, "type": 2, "external_id": 3}, width=8)
FACT_LOCATION_TSV = TsvLayout(2, {"person_id": 1, "location_id": 2}, width=8)
DIM_LOCATION_TSV = TsvLayout(6, {"location_id": 0, "country": 6, "state": 7}, width=16)
PERSON_INFO_TSV = TsvLayout(8, {"person_id": 0, "birthday_raw": 5,
                                "relationship_raw": 8, "gender_raw": 10,
                                "locale_raw": 15}, width=32)

# Column sets of the logical tables (types: ids are strings when read from
# TSV and whatever the source has otherwise; attributes are strings).
FACT_LIKE_COLS = ("fact_id", "person_id", "like_id")
DIM_LIKE_COLS = ("like_id", "name", "type")
FACT_LOCATION_COLS = ("person_id", "location_id")
DIM_LOCATION_COLS = ("location_id", "country", "state")
PERSON_INFO_COLS = ("person_id", "birthday_raw", "relationship_raw",
                    "gender_raw", "locale_raw")
TOPIC_COLS = ("like_id", "name", "type")
CENSUS_COLS = ("age", "population")


@dataclass
class AffinityTables:
    """The inputs of one analysis.

    fact_like      (fact_id, person_id, like_id)   person likes entity
    dim_like       (like_id, name, type)           entity attributes
    fact_location  (person_id, location_id)        person lives at location
    dim_location   (location_id, country, state)   location attributes
    person_info    (person_id, birthday_raw, relationship_raw, gender_raw, locale_raw)
    topic          (like_id, name, type)           curated topic entities
    census         (age, population)               ages 0..100
    categories     {group: [type, ...]}            category vocabularies
    names          [name, ...]                     name slice vocabulary
    roots          [path, ...]                     folders or files that the frames are read from
    folders        [RunFolder, ...]                run folders that hold them, released with the analysis
    """
    fact_like: DataFrame
    dim_like: DataFrame
    fact_location: DataFrame
    dim_location: DataFrame
    person_info: DataFrame
    topic: DataFrame | None
    census: DataFrame
    categories: dict[str, list[str]]
    names: list[str]
    roots: list[str] = field(default_factory=list)
    folders: list = field(default_factory=list)

    def plan_hashes(self) -> list[str]:
        """Semantic hash of each input's canonical plan: covers column
        derivations and in-memory rows, which a file listing cannot."""
        frames = (self.fact_like, self.dim_like, self.fact_location, self.dim_location,
                  self.person_info, self.topic, self.census)
        return [str(df.semanticHash()) if df is not None else "-" for df in frames]

    def fingerprint_parts(self) -> list[str]:
        vocab = [f"{g}:{'|'.join(ts)}" for g, ts in sorted(self.categories.items())]
        return self.input_state() + self.plan_hashes() + vocab + ["names:" + "|".join(self.names)]

    def input_state(self) -> list[str]:
        """One value for the path, length and modification time of all input
        files: any changed, added or removed file changes it. The files under
        `roots` are listed and hashed by a small distributed job over their
        metadata (contents are not read), and a single row comes back. Frames
        made without `roots` are looked up by the files that they name."""
        roots = list(self.roots)
        if not roots:
            frames = (self.fact_like, self.dim_like, self.fact_location, self.dim_location,
                      self.person_info, self.topic)
            roots = sorted({f for df in frames if df is not None for f in df.inputFiles()})
        if not roots:
            return []
        meta = (self.fact_like.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true")
                .load(roots).select(F.xxhash64("path", "length", "modificationTime").alias("h")))
        n, total = meta.agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        return [f"{n} files {total}"]
