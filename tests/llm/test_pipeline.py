"""Each stage of the pipeline against brute force on its own input, and run() against the stages."""

import corpus_pipeline
import llm_data
import pandas as pd
from test_exact_dedup import brute as brute_exact
from test_simhash import slow_components, slow_fingerprint
from test_substring import brute as brute_substring
from test_substring import shared_passages

from lexisift.llm import quality
from lexisift.llm.common import documents


def made():
    parts = [llm_data.rows(), shared_passages(3)]
    parts[1]["doc_id"] += len(parts[0])
    out = pd.concat(parts, ignore_index=True)
    near = out[out.text.map(lambda t: len((t or "").split()) > 150)].head(4).copy()
    near["text"] = near.text.map(lambda t: t + " end")
    near["doc_id"] = range(1000, 1000 + len(near))
    return pd.concat([out, near], ignore_index=True)


def table(df):
    return df.toPandas().sort_values("doc_id", ignore_index=True)


def test_stages(spark, tmp_path):
    llm_data.frame(spark, made()).write.parquet(f"{tmp_path}/documents.parquet")
    docs = documents(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = table(docs)
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.toPandas()
        if name == "packing":
            assert set(after.doc_id) == set(before.doc_id)
            break
        assert list(after.columns) == list(before.columns)
        after = after.sort_values("doc_id", ignore_index=True)
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.judged(documents(spark, str(tmp_path))).filter("kept").collect()}
            assert 0 < len(kept) < len(before)
        elif name == "exact_dedup":
            kept = {d for d, _, _, keep, _ in brute_exact(before) if keep}
        elif name == "near_dedup":
            found = slow_components({d: slow_fingerprint(t) for d, t in zip(before.doc_id, before.text)})
            kept = {d for d, c in found.items() if d == c}
            assert len(kept) < len(before)
        else:
            expected = brute_substring(before)
            whole = dict(zip(before.doc_id, before.text))
            assert sum(x[1] > 0 for x in expected.values()) > 10
            assert {d: t for d, t in zip(after.doc_id, after.text)} == {d: x[3] if x[1] else whole[d] for d, x in expected.items()}
            kept = set(expected)
        assert set(after.doc_id) == kept and len(after) == len(kept)
    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert set(map(tuple, whole[columns].values)) == set(map(tuple, after[columns].values))
    assert whole.groupby("sequence_id").length.sum().max() <= 4096
