"""All stages on rows with odd values and further columns whose names operators might use."""

from __future__ import annotations

import os

import pytest
from helpers import ODD, docs

import corpus_pipeline
from fanscope.llm.common import scratch, written

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_further_columns_are_carried_through_the_stages(spark):
    with scratch(spark):
        frame = docs(spark, ODD + [(20 + k, f"Sentence number {k} is about something else than the others, as {k * 7} shows. " * 3) for k in range(8)])
        names, before = frame.columns, frame.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = written(stage(spark, frame, SF), "test-stage")
            assert frame.columns == names, name
            assert all(r.root == "y" and r._searched == "x" and r.pos == 7 for r in frame.collect())
            if name != "mix":
                assert frame.count() <= before
            before = frame.count()
        assert before and corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == before
