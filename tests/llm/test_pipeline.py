"""The pipeline's stages, one after another, each against plain Python on its own input."""

from collections import Counter

import corpus_pipeline
from clipspark.llm.tables import written
from clipspark.llm.toxicity import THRESHOLD, toxicity_table

from . import brute
from .conftest import edge_rows


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def marked(text):
    """A text with its base spans replaced by a mark; touching ones by one."""
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in brute.base_spans(text))
    out, at = [], 0
    for a, b in spans:
        if b > at:
            out.append(text[at:a] + "<secret>" if a > at or at == 0 else "")
            at = b
    return "".join(out) + (text or "")[at:]


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns

    kept = written(stages["toxicity"](spark, docs, sf_dir))
    scores = toxicity_table(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert Counter(d for d, _ in pairs(kept)) == Counter(r.doc_id for r in scores.filter(scores.score < THRESHOLD).collect())

    one = written(stages["near_duplicates"](spark, kept, sf_dir))
    want = {d for d, n, c in brute.classes(pairs(kept)) if not n or c == d}
    assert sorted(d for d, _ in pairs(one)) == sorted(want)

    clean = written(stages["decontamination"](spark, one, sf_dir))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(d for d, _ in pairs(clean)) == sorted(x[0] for x in brute.leaks(pairs(one), items) if not x[-1])

    safe = written(stages["secrets"](spark, clean, sf_dir))
    assert dict(pairs(safe)) == {d: marked(t) for d, t in pairs(clean)}
    assert all(r.n_chars == len(r.text) for r in safe.collect())
    for df in (kept, one, clean, safe):
        assert df.columns == columns

    pieces = stages["packing"](spark, safe, sf_dir).collect()
    assert {p.doc_id for p in pieces} == {d for d, _ in pairs(safe)}
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_stages_on_awkward_rows(spark, edge, nothing, sf_dir):
    for docs in (edge, nothing):
        rows = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = written(stage(spark, rows, sf_dir))
            assert rows.columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).count()
        if docs is edge:
            assert 0 < rows.count() < len(edge_rows())
        else:
            assert rows.count() == 0
