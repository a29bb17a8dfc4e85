"""Every query of the subpackage is registered, so the guard in the entry can't hide a broken import."""

from __future__ import annotations

import re

import __spark_entry__ as entry


def test_all_operators_and_the_pipeline_are_registered():
    found = {int(m[1]) for q in entry.queries() if (m := re.match(r"op(\d+)_", q))}
    assert found == set(range(1, 14)) and "pipeline" in entry.queries()
    assert {"op6_licenses", "op7_substring_dedup", "op10_embeddings", "op11_topk", "op12_resampling", "op13_conversations"} <= set(entry.oracle_sql())
