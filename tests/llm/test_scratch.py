"""What operators keep is deleted when its owner ends."""

from __future__ import annotations

import os

import pytest
from helpers import ODD, docs

from fanscope.llm import common, merkle, mixing, token_files
from fanscope.sinks import runs


def kept(spark):
    root = runs.runs_root(spark).replace("file:", "")
    return {n for n in os.listdir(root) if n.startswith("llm-")} if os.path.isdir(root) else set()


@pytest.mark.parametrize("run", [mixing.mix_report, merkle.merkle_report,
                                 lambda d: token_files.written_and_read(d, __import__("public_tokenizers").path("word_bpe_49k.json"))])
def test_a_block_deletes_what_operators_kept_in_it(spark, run):
    before = kept(spark)
    with common.scratch(spark):
        assert len(run(docs(spark, ODD)).collect()) == len(ODD)
        assert len(kept(spark)) == len(before) + 1
    assert kept(spark) == before


def test_release_deletes_what_was_kept_outside_of_blocks(spark):
    common.release()
    before = kept(spark)
    assert common.written(spark.range(3), "t").count() == 3
    assert common.written(spark.range(4), "t").count() == 4 and len(kept(spark)) == len(before) + 1
    common.release()
    assert kept(spark) == before
    assert common.written(spark.range(5), "t").count() == 5  # and on it goes
