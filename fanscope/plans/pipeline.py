"""The analysis as one graph of DataFrames.

Each property is one intermediate of the analysis. Reading a property may run
small jobs: the sets that get joined to like facts (the country's locations,
topic entities, big entities, topic-or-big entities, the region's people, top
predictors) are counted, in rows and bytes, when they are first used. A set
within `broadcast_max_rows` and `broadcast_max_bytes` is broadcast to the tasks
holding like facts (such sets are orders of magnitude smaller than the facts,
and a broadcast keeps the facts from being shuffled by that key, so a hot entity
or person cannot overload one task). A larger one is joined by a shuffle that
spreads each key over slices; entities that a sketch of the facts finds heavy
are joined map-side. The topic count also fixes how many topic entities are
"basic" and "common".

The ranking and the tiers rank the same facts. If the tiers are computed first
(`tier_like_stats`, as in a batch run), the ranking sums them up; else it has
its own pass, which needs no tiers.

The frames that several results reuse (region like facts, the entity sets, the
per-person summary and metrics, entity statistics and implications, edge
non-fans, avidity and tiers) are kept according to `store`:
  "memory"      region like facts are persisted (MEMORY_AND_DISK; lost blocks
                are recomputed); all other kept frames are small tables,
                written to a folder of this pipeline under the shared
                `spark.checkpoint.dir` (see `fanscope.sinks.runs`). (Frames persisted on top of each other
                would nest their plans, whose size then grows as a power.)
                `unpersist()` releases both.
  "checkpoint"  all are written as parquet there, in folders keyed by a fingerprint of
                the parameters, the inputs and the frame's own plan, and read
                them back:
                lineage is cut, a rerun on unchanged inputs reuses them, and
                any change of input or parameter misses.
  "none"        keep nothing (every result recomputes its inputs).
"""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from fanscope.operators import affinity, avidity, census, edge, factors, profiles, region, slices, topic
from fanscope.operators.joins import Spread, bounded_broadcast, heavy_keys
from fanscope.params import AffinityParams
from fanscope.sinks import input_fingerprint, materialize, write_ranked_report
from fanscope.sinks.buckets import ByPerson, kept_by_person, split_by_weight
from fanscope.sinks.runs import RunFolder
from fanscope.sources.schemas import AffinityTables


# Attribute -> the property that holds (person_id, attribute).
FACTOR_ATTRIBUTES = {
    "age": "people_ages",
    "ageband": "people_agebands",
    "gender": "people_genders",
    "relationship": "people_relationships",
    "locale": "people_locales",
    "state": "region_people_states",
}


class Sized(NamedTuple):
    """A counted set: broadcast if it fits."""
    df: DataFrame
    rows: int
    bytes: int
    fits: bool


class AffinityPipeline:
    def __init__(self, tables: AffinityTables, params: AffinityParams, store: str = "memory"):
        if store not in ("memory", "checkpoint", "none"):
            raise ValueError(f"unknown store {store!r}")
        self.t = tables
        self.p = params
        self.store = store
        self._persisted: list[DataFrame] = []

    @property
    def spark(self) -> SparkSession:
        return self.t.fact_like.sparkSession

    @cached_property
    def fingerprint(self) -> str:
        """Of the inputs and parameters."""
        return input_fingerprint(self.t.fingerprint_parts(), self.p.fingerprint())

    @cached_property
    def _folder(self) -> RunFolder:
        """Where frames are kept: with store="checkpoint" a folder that runs on the same inputs reuse
        (until nobody has for the length of its lease), else this run's own."""
        if self.store == "checkpoint":
            return RunFolder(self.spark, "checkpoint", self.fingerprint)
        return RunFolder(self.spark, "run")

    @property
    def checkpoint_prefix(self) -> str:
        return self._folder.path

    def ranked_report(self) -> DataFrame:
        """The best `report_top` predictors, written as the ranked report and read back."""
        path = self._folder.table("ranked_report")
        write_ranked_report(self.entity_implications, path, self.p.report_top)
        return self.spark.read.schema(self.entity_implications.schema).json(path)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        if self.store == "checkpoint":
            # The folder is keyed by the inputs and parameters (prefix) and by
            # the frame's canonical plan, so a change in how it is computed
            # misses too.
            plan = f"{df.semanticHash() & 0xFFFFFFFF:08x}"
            return materialize(df, self._folder.table(f"{name}-{plan}"))
        if self.store == "memory" and name == "region_facts":
            self._persisted.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        elif self.store == "memory":
            return self._folder.keep(df, name)
        return df

    def unpersist(self, blocking: bool = False) -> None:
        """Release what this pipeline keeps; its results can't be read after that."""
        for df in self._persisted:
            df.unpersist(blocking)
        self._persisted.clear()
        for folder in (*self.t.folders, *([self._folder] if "_folder" in self.__dict__ else [])):
            folder.release()

    def _fits(self, rows: int, size: int) -> bool:
        return rows <= self.p.broadcast_max_rows and size <= self.p.broadcast_max_bytes

    def _sized(self, df: DataFrame, name: str) -> Sized:
        """Keep a set, count its rows and the bytes of its values, and hint a
        broadcast when both are within bounds."""
        kept = self._keep(df, name)
        width = F.lit(16)
        for f in kept.schema.fields:
            text = isinstance(f.dataType, (StringType, BinaryType))
            width = width + (F.coalesce(F.octet_length(f.name), F.lit(0)) if text else F.lit(8))
        rows, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()
        fits = self._fits(rows, size)
        return Sized(bounded_broadcast(kept, fits), rows, size, fits)

    @cached_property
    def heavy_entities(self) -> DataFrame | None:
        """(like_id) of entities with more than 1/heavy_keys_max of the region's facts (so many that
        `broadcast_max_rows` can't be exceeded; None where that allows none)."""
        return self._heavy(self.region_facts, "like_id")

    def _heavy(self, facts: DataFrame, key: str) -> DataFrame | None:
        most = min(self.p.heavy_keys_max, self.p.broadcast_max_rows)
        return heavy_keys(facts, key, most) if most else None

    def _spread(self, keys: Sized) -> Spread | None:
        """How facts are joined with a set of entities: none for a broadcast."""
        return None if keys.fits else Spread(self.heavy_entities, self.p.skew_slices)

    def _derived(self, df: DataFrame, *of: Sized) -> DataFrame:
        """Broadcast hint for a frame derived from counted sets, which has at
        most their rows, each with their values and a number or two. (Spark
        carries a hint up through projections and aggregations but not
        through a union, so derived frames state their own bound.)"""
        rows = sum(x.rows for x in of)
        return bounded_broadcast(df, self._fits(rows, sum(x.bytes for x in of) + 16 * rows))

    # --- entities and topic -------------------------------------------------
    @cached_property
    def entities(self) -> DataFrame:
        return topic.entities(self.t.dim_like)

    @cached_property
    def discovered_entities(self) -> DataFrame:
        return topic.discover_entities(self.t.dim_like, self.p.token_a, self.p.token_b)

    @cached_property
    def topic_entities(self) -> DataFrame:
        if self.t.topic is None:
            return self.discovered_entities
        return self.t.topic.select("like_id", "name", "type").distinct()

    @cached_property
    def _topic_ids_sized(self) -> Sized:
        source = self.t.topic if self.t.topic is not None else self.discovered_entities
        return self._sized(topic.topic_ids(source), "topic_ids")

    @property
    def topic_ids(self) -> DataFrame:
        return self._topic_ids_sized.df

    @property
    def n_topic(self) -> int:
        """Distinct topic ids."""
        return self._topic_ids_sized.rows

    # --- region -----------------------------------------------------------------
    @cached_property
    def like_facts(self) -> DataFrame:
        return region.like_facts(self.t.fact_like)

    @cached_property
    def _country_locations(self) -> Sized:
        return self._sized(region.country_locations(self.t.dim_location, self.p.region_value), "country_locations")

    @cached_property
    def _state_locations(self) -> Sized:
        return self._sized(region.state_locations(self.t.dim_location, self.p.region_value), "state_locations")

    def _slices(self, keys: Sized) -> int | None:
        """Slices of a shuffle by keys that may be hot; none for a broadcast."""
        return None if keys.fits else self.p.skew_slices

    @cached_property
    def _region_people_sized(self) -> Sized:
        places = self._country_locations
        return self._sized(region.region_people(self.t.fact_location, places.df, self._slices(places)),
                           "region_people")

    @property
    def region_people(self) -> DataFrame:
        return self._region_people_sized.df

    @cached_property
    def region_people_states(self) -> DataFrame:
        places = self._state_locations
        return region.region_people_states(self.t.fact_location, places.df, self._slices(places))

    @property
    def _is_bucketed(self) -> bool:
        return self.p.person_buckets > 0 and self.store == "memory"

    @cached_property
    def region_facts(self) -> DataFrame:
        if self._is_bucketed:
            return self._facts_by_person.whole()
        return self._keep(self._region_facts, "region_facts")

    @property
    def _region_facts(self) -> DataFrame:
        people = self._region_people_sized
        return region.region_like_facts(self.t.fact_like, people.df, self._slices(people))

    # With `person_buckets`, facts and what is aggregated of them by person are kept as tables
    # bucketed by person; joins and aggregations by person then need no exchange.
    def _keep_by_person(self, parts: ByPerson, name: str) -> ByPerson:
        return kept_by_person(parts, self._folder, name, self.p.person_buckets)

    @cached_property
    def _facts_by_person(self) -> ByPerson:
        facts = self._region_facts
        return self._keep_by_person(split_by_weight(facts, self._heavy(facts, "person_id")), "region_facts")

    @cached_property
    def _summary_by_person(self) -> ByPerson:
        flags = self._sized(affinity.entity_flags(self._entity_rows_sized.df, self.topic_ids), "entity_flags")
        spread = self._spread(flags)
        return self._keep_by_person(self._facts_by_person.then(
            lambda facts: affinity.person_summary_by_pairs(facts, flags.df, spread)), "person_summary")

    @cached_property
    def _big_by_person(self) -> ByPerson:
        big, spread = self.big_likes, self._spread(self._big_likes_sized)
        return self._facts_by_person.then(lambda facts: affinity.big_like_facts(facts, big, spread))

    @cached_property
    def _avidity_by_person(self) -> ByPerson:
        weights = self._weights
        spread = self._spread(weights)
        return self._keep_by_person(self._facts_by_person.then(
            lambda facts: avidity.person_avidity(facts, weights.df, self.p, spread)), "person_avidity")

    @cached_property
    def _big_likes_sized(self) -> Sized:
        return self._sized(topic.big_likes(self.region_facts, self.p.big_min_exclusive), "big_likes")

    @property
    def big_likes(self) -> DataFrame:
        return self._big_likes_sized.df.select("like_id")

    @cached_property
    def _topic_and_big_sized(self) -> Sized:
        ids = self._derived(topic.topic_or_big_ids(self.topic_ids, self.big_likes),
                            self._topic_ids_sized, self._big_likes_sized)
        return self._sized(topic.topic_and_big_likes(ids, self.t.dim_like), "topic_and_big_likes")

    @property
    def topic_and_big_likes(self) -> DataFrame:
        return self._topic_and_big_sized.df

    # --- share and implications ----------------------------------------------
    @cached_property
    def person_summary(self) -> DataFrame:
        """(person_id, n_likes, n_relevant, n_topic): every person-level count
        in one aggregation; kept, since most results start from it."""
        if self._is_bucketed:
            return self._summary_by_person.whole()
        rows_of = self._entity_rows_sized
        return self._keep(affinity.person_summary(self.region_facts, rows_of.df, self.topic_like_facts,
                                                  self._spread(rows_of)), "person_summary")

    @cached_property
    def _entity_rows_sized(self) -> Sized:
        # Counted by its own two columns: names and types don't travel to the facts.
        return self._sized(affinity.entity_rows(self.topic_and_big_likes), "entity_rows")

    @cached_property
    def hot_people(self) -> DataFrame | None:
        """(person_id) of people with more region likes than `hot_person_share`
        of a mean shuffle partition; None when there are none. Fewer than
        partitions / share people can exceed that, and the bound is raised so
        that no more than `broadcast_max_rows` can, so they always fit."""
        total = self.person_summary.agg(F.sum("n_likes")).first()[0] or 0
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        most = min(parts / self.p.hot_person_share, self.p.broadcast_max_rows)
        if not most:
            return None
        hot = self.person_summary.filter(F.col("n_likes") > F.lit(total / most)).select("person_id")
        return None if hot.isEmpty() else hot

    @cached_property
    def person_total_counts(self) -> DataFrame:
        if self._is_bucketed:
            return self._facts_by_person.then(affinity.person_total_counts).whole()
        return affinity.person_total_counts(self.region_facts)

    @cached_property
    def person_relevant_counts(self) -> DataFrame:
        return affinity.person_relevant_counts(self.person_summary)

    @cached_property
    def topic_like_facts(self) -> DataFrame:
        return affinity.topic_like_facts(self.region_facts, self.topic_ids, self._spread(self._topic_ids_sized))

    @cached_property
    def person_topic_counts(self) -> DataFrame:
        return affinity.person_topic_counts(self.person_summary)

    @cached_property
    def person_topic_share(self) -> DataFrame:
        return affinity.person_topic_share(self.person_summary)

    @cached_property
    def big_like_facts(self) -> DataFrame:
        return affinity.big_like_facts(self.region_facts, self.big_likes, self._spread(self._big_likes_sized))

    @cached_property
    def like_topic_fractions(self) -> DataFrame:
        if self._is_bucketed:
            share = self._summary_by_person.then(affinity.person_topic_share)
            return self._big_by_person.join(share).whole().select("like_id", "person_id", "share")
        return affinity.like_topic_fractions(self.big_like_facts, self.person_topic_share, self.hot_people)

    @cached_property
    def like_topic_stats(self) -> DataFrame:
        if "tier_like_stats" in self.__dict__:
            return self._keep(avidity.over_all_tiers(self.tier_like_stats), "like_topic_stats")
        return self._keep(affinity.like_topic_stats(self.like_topic_fractions), "like_topic_stats")

    @cached_property
    def entity_implications(self) -> DataFrame:
        return self._keep(affinity.entity_implications(self.like_topic_stats,
                                                       self.topic_and_big_likes, self.p.exponent),
                          "entity_implications")

    @cached_property
    def offtopic_implications(self) -> DataFrame:
        return affinity.offtopic_implications(self.entity_implications, self.topic_ids)

    def top_implications(self, k: int | None = None) -> DataFrame:
        return affinity.top_implications(self.entity_implications, self.p.report_top if k is None else k)

    def top_offtopic(self, k: int | None = None) -> DataFrame:
        return affinity.top_implications(self.offtopic_implications, self.p.report_top if k is None else k)

    # --- edge ----------------------------------------------------------------------
    @cached_property
    def edge_likers(self) -> DataFrame:
        ids = self._sized(edge.top_offtopic_ids(self.offtopic_implications, self.p.top_offtopic), "top_offtopic_ids")
        return edge.edge_likers(self.region_facts, ids.df, self._spread(ids))

    @cached_property
    def edge_nonfans(self) -> DataFrame:
        return self._keep(edge.edge_nonfans(self.person_summary, self.edge_likers), "edge_nonfans")

    # --- profiles ------------------------------------------------------------------
    @cached_property
    def region_profiles(self) -> DataFrame:
        return profiles.region_profiles(self.t.person_info, self.region_people)

    @cached_property
    def people_birthdays(self) -> DataFrame:
        return profiles.people_birthdays(self.region_profiles)

    @cached_property
    def people_ages(self) -> DataFrame:
        return profiles.people_ages(self.people_birthdays, self.p.as_of)

    @cached_property
    def people_agebands(self) -> DataFrame:
        return profiles.people_agebands(self.people_ages)

    @cached_property
    def people_genders(self) -> DataFrame:
        return profiles.people_genders(self.region_profiles)

    @cached_property
    def people_relationships(self) -> DataFrame:
        return profiles.people_relationships(self.region_profiles)

    @cached_property
    def people_locales(self) -> DataFrame:
        return profiles.people_locales(self.region_profiles)

    # --- factor reports ----------------------------------------------------------
    @cached_property
    def _metrics_with_edge(self) -> DataFrame:
        return self._keep(factors.person_metrics(self.person_summary, self.edge_nonfans), "person_metrics")

    def person_metrics(self, with_edge: bool = True) -> DataFrame:
        return self._metrics_with_edge if with_edge else factors.person_metrics(self.person_summary, None)

    def factor_report(self, factor: DataFrame, level_col: str, with_edge: bool = True) -> DataFrame:
        """Full report (with the helper column n_with_share). Without the edge
        metrics the report does not depend on the implication ranking."""
        return factors.factor_report(self.person_metrics(with_edge), factor, level_col)

    @cached_property
    def _factors(self) -> dict[str, DataFrame]:
        return {name: getattr(self, prop) for name, prop in FACTOR_ATTRIBUTES.items()}

    @cached_property
    def factor_reports(self) -> DataFrame:
        """(attribute, level, metrics) of all attributes, from one join with the people's metrics."""
        return self._keep(factors.factor_reports(self.person_metrics(), self._factors), "factor_reports")

    def factor_report_of(self, attribute: str) -> DataFrame:
        """One attribute's report out of `factor_reports`."""
        return factors.one_report(self.factor_reports, attribute, self._factors[attribute].schema[attribute].dataType)

    # --- slices --------------------------------------------------------------------
    def category_slice(self, group: str) -> DataFrame:
        return slices.category_slice(self.entity_implications, self.t.categories[group])

    def name_slice(self) -> DataFrame:
        return slices.name_slice(self.entity_implications, self.t.names)

    # --- avidity -------------------------------------------------------------------
    @cached_property
    def topic_popularity(self) -> DataFrame:
        big_topic = self._big_likes_sized.df.join(self.topic_ids, "like_id", "left_semi")
        absent, facts = big_topic.select("like_id").join(self._entity_rows_sized.df, "like_id", "left_anti"), None
        if not absent.isEmpty():
            ids = self._sized(absent, "absent_topic_ids")
            facts = affinity.big_like_facts(self.region_facts, ids.df, self._spread(ids))
        return self._keep(avidity.topic_popularity(big_topic, self._entity_rows_sized.df, facts,
                                                   self.person_topic_share), "topic_popularity")

    def _most_liked(self, frac: float, name: str) -> DataFrame:
        k = avidity.top_fraction_count(self.n_topic, frac)
        return self._sized(avidity.most_liked(self.topic_popularity, k, self.p.direct_top_max), name).df

    @cached_property
    def entity_avidity(self) -> DataFrame:
        basic = self._most_liked(self.p.basic_frac, "basic_ids")
        common = self._most_liked(self.p.common_frac, "common_ids")
        return self._keep(avidity.entity_avidity(self.topic_and_big_likes, self.topic_ids, basic, common),
                          "entity_avidity")

    @cached_property
    def _weights(self) -> Sized:
        return self._sized(avidity.avidity_weights(self.entity_avidity), "avidity_weights")

    @cached_property
    def person_avidity(self) -> DataFrame:
        if self._is_bucketed:
            return self._avidity_by_person.whole()
        weights = self._weights
        return self._keep(avidity.person_avidity(self.region_facts, weights.df, self.p, self._spread(weights)),
                          "person_avidity")

    @cached_property
    def tier_like_stats(self) -> DataFrame:
        if self._is_bucketed:
            share = self._summary_by_person.then(affinity.person_topic_share)
            graded = share.join(self._avidity_by_person.then(lambda df: df.select("person_id", "tier")))
            facts = self._big_by_person.join(graded).whole()
            return self._keep(affinity.like_topic_stats(facts, "tier"), "tier_like_stats")
        return self._keep(avidity.tier_like_stats(self.big_like_facts, self.person_avidity, self.person_topic_share,
                                                  self.hot_people), "tier_like_stats")

    def top_tier_implications(self, k: int | None = None) -> DataFrame:
        return avidity.top_per_tier(self.tier_implications, self.p.report_top if k is None else k)

    @cached_property
    def tier_implications(self) -> DataFrame:
        return self._keep(avidity.tier_implications(self.tier_like_stats, self.topic_and_big_likes, self.p.exponent),
                          "tier_implications")

    # --- census ---------------------------------------------------------------------
    @cached_property
    def estimated_fans_by_age(self) -> DataFrame:
        return census.estimated_fans_by_age(self.factor_report(self.people_ages, "age", with_edge=False),
                                            self.t.census)
