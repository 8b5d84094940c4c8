"""What the exports write while they run."""

import pytest

import __spark_entry__ as entry
from catalog import audits
from clipspark.operators import ranking


@pytest.mark.parametrize("name, texts", [("e17_review_export", 0), ("e22_run_report", 1)])
def test_texts_are_written_once_at_most(spark, sf_dir, monkeypatch, name, texts):
    written = []
    for module in (audits, ranking):
        real = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, real=real: written.append(df.columns) or real(df))
    assert entry.queries()[name](spark, sf_dir).count() > 0
    assert sum("text" in columns for columns in written) == texts and not any("segment_ids" in columns for columns in written)
