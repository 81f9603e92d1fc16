"""The pipeline against brute force: each stage on what its predecessor kept."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import sentencepiece

from pairscope.llm import common, lang_crf
from tests.llm.conftest import ITEMS
from tests.llm.test_operators import contained, deduplicated, linked


def test_stages_have_effect_and_keep_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, odd).checkpoint()
        sizes.append(docs.count())
        if n + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) >= 5


def test_run_matches_brute_force(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = lang_crf.stage(spark, docs, odd).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()
    rows = {r.doc_id: r.text for r in kept}
    lines = deduplicated(rows.items())
    rows = {i: t for i, (t, n) in lines.items() if n == 0 or t.replace("\n", " ").strip(" ")}
    rows = {i: rows[i] for i, n, low in linked(sorted(rows.items()), 5, 80) if not n or i == low}
    bad = {d for d, *_ in contained(rows.items(), ITEMS)}
    rows = {i: t for i, t in rows.items() if i not in bad}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.text, list(r.ids)) for r in corpus_pipeline.run(spark, odd).collect() if r.doc_id is not None}
    assert got == {i: (t, library.encode(t)) for i, t in rows.items()}
    assert np.mean([len(x) for _, x in got.values()]) > 10


def test_empty_table(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_executors_give_memory_back_before_each_stage(spark, empty):
    """Old garbage is gone after a release, and every stage begins with one."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def collections():
        return sum(bean.getCollectionCount() for bean in beans if "Old" in bean.getName() or "MarkSweep" in bean.getName())

    common.release(spark)
    for _, stage in corpus_pipeline.STAGES:
        before = collections()
        docs = stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty)
        assert collections() > before and docs.count() == 0
