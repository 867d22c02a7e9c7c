"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import corpus_pipeline as P
from tests.llm.test_text_operators import corpus, near_groups, words_of
from starloom.llm.exact_dedup import exact_duplicates


def test_stages(spark, tmp_path):
    rows = [(i, t, "en" if i is not None and i % 2 else None, s, len(t or "")) for i, t, s, *_ in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        before = [tuple(r) for r in kept.collect()]
        out = stage(spark, kept, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        after = [tuple(r) for r in kept.collect()]
        if name == "language":
            assert not [r for r in after if not (r[1] or "").strip()]
            assert len(after) >= 0.8 * len(before)
        elif name == "exact_dedup":
            verdict = {r.doc_id for r in exact_duplicates(spark.createDataFrame(before, docs.schema)).where("kept").collect()}
            assert Counter(after) == Counter(r for r in before if r[0] in verdict)
        elif name == "near_dedup":
            assert Counter(after) == Counter(r for r, (i, _, c) in zip(before, near_groups(before, 80)) if i == c)
        elif name == "mixing":
            times = Counter(after)
            assert set(times) <= set(before) and max(times.values()) <= 3 * max(Counter(before).values())
            total, largest = sum(len(words_of(r[1])) for r in before), {}
            for r in before:
                largest[r[3]] = max(largest.get(r[3], 0), len(words_of(r[1])))
            # Whole documents only: each source ends within half a document of its target.
            assert abs(sum(len(words_of(r[1])) for r in after) - total) <= sum(largest.values()) / 2
        else:
            assert {r[0] for r in after} == {r[0] for r in before}
