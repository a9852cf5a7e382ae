"""Queries whose rows cost far more than reading them aren't one task for a table of one file."""

from pathlib import Path

import pytest

from __spark_entry__ import queries

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["reference_dois", "document_kinds", "gapped_phrases", "cleaned_articles"])
@pytest.mark.skipif(not Path(TABLES).exists(), reason="the given tables are not there")
def test_one_file_is_dealt_out(spark, name):
    assert queries()[name](spark, TABLES).rdd.getNumPartitions() >= 8
