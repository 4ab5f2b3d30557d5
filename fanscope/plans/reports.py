"""Batch report run: every output of the analysis written under one folder.

  topic_entities/            topic entity list, one entity JSON per line
  top_implications/          best `report_top` predictors (JSON lines, ordered)
  top_offtopic/              best `report_top` off-topic predictors, for review
  like_topic_implications/   all implications (parquet)
  implications_<group>/      category slices, implications_names/ name slice
  edge_nonfans/              near-fans (parquet)
  factor_<attr>/             factor report per person attribute (parquet)
  person_avidity/, tier_implications/, top_tier_implications/,
  estimated_fans_by_age/

Reviewing `top_offtopic`, moving on-topic entities into the topic file and
rerunning is the curation loop; with store="checkpoint" a rerun recomputes
exactly what the edited topic file changes (the fingerprint covers it).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from fanscope import sinks
from fanscope.operators import factors
from fanscope.plans.pipeline import FACTOR_ATTRIBUTES, AffinityPipeline

def _parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def run_reports(pipe: AffinityPipeline, out_dir: str) -> list[str]:
    """Write every report; returns the folders written."""
    p = pipe.p
    written = []

    def out(name: str) -> str:
        path = os.path.join(out_dir, name)
        written.append(path)
        return path

    pipe.tier_like_stats  # first: the ranking then sums up the tiers, and facts meet people once
    sinks.write_topic_file(pipe.topic_entities, out("topic_entities"))
    sinks.write_ranked_report(pipe.entity_implications, out("top_implications"), p.report_top)
    sinks.write_ranked_report(pipe.offtopic_implications, out("top_offtopic"), p.report_top)
    # The one large report: a rerun on the same inputs and parameters leaves it as it is.
    sinks.write_unless_current(pipe.entity_implications, out("like_topic_implications"), pipe.fingerprint)
    for group in pipe.t.categories:
        _parquet(pipe.category_slice(group), out(f"implications_{group}"))
    if pipe.t.names:
        _parquet(pipe.name_slice(), out("implications_names"))
    _parquet(pipe.edge_nonfans, out("edge_nonfans"))
    for attr in FACTOR_ATTRIBUTES:
        _parquet(factors.report_columns(pipe.factor_report_of(attr), attr), out(f"factor_{attr}"))
    _parquet(pipe.person_avidity, out("person_avidity"))
    _parquet(pipe.tier_implications, out("tier_implications"))
    _parquet(pipe.top_tier_implications(), out("top_tier_implications"))
    _parquet(pipe.estimated_fans_by_age, out("estimated_fans_by_age"))
    return written
