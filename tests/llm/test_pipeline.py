"""The pipeline against its stages' brute-force meaning, and the registered queries against their SQL twins."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

import corpus_pipeline  # noqa: E402
from compare import connect, difference  # noqa: E402
from weir.llm import QUERIES, SQL  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    assert difference(rows, connect(FOLDER), SQL[name]) is None if name in SQL else rows.count() > 0


def test_pipeline(spark):
    from test_operators import components_of, contaminated, features, lines_removed  # noqa: PLC0415
    from weir.llm.quality import quality  # noqa: PLC0415

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    good = {r.doc_id for r in quality(docs).collect() if r.kept}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    assert not any(features(t)[-1] for t in texts.values())
    gone = {i: {int(p) for p in x[2].split(",") if p} for i, x in lines_removed(list(texts.items())).items()}
    left = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in texts.items()}
    left = {i: t for i, t in left.items() if t.strip() or not gone[i]}
    classes = components_of(left.items())
    left = {i: t for i, t in left.items() if classes[i][1] == i}
    clean = {r[0] for r in contaminated(left.items(), items) if not r[2]}
    got = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == clean
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "bpe"]
