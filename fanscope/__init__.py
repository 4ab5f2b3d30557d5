"""fanscope: audience-affinity analytics on Spark DataFrames.

Given a topic (a set of liked entities) and a region, fanscope finds which other
popular entities predict interest in the topic, scores each person's topic share,
finds near-fans, grades fans by avidity, breaks results down by any person
attribute and scales sample fan rates to population figures.

Everything is expressed with the DataFrame API so Catalyst and AQE choose the
physical plan; there are no Python UDFs.
"""

from fanscope.params import AffinityParams
from fanscope.plans.pipeline import AffinityPipeline

__all__ = ["AffinityParams", "AffinityPipeline"]
