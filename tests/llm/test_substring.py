import hashlib
import random
import re

import llm_data
import pandas as pd
import pytest

from lexisift.llm import substring


def brute(pdf, window=50):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in zip(pdf.doc_id, pdf.text)}
    first, out = {}, {}
    for d in sorted(words):
        own, gone = words[d], set()
        keys = [tuple(own[i : i + window]) for i in range(len(own) - window + 1)]
        for i, k in enumerate(keys):
            if first.get(k, d) < d:
                gone.update(range(i, i + window))
        for k in keys:
            first.setdefault(k, d)
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out[d] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def shared_passages(seed, n_docs=80, few_words=False):
    rng = random.Random(seed)
    vocabulary = ["a", "b"] if few_words else [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([40, 49, 50, 51, 60, 130]))] for _ in range(6)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(n_docs):
        own = []
        for _ in range(rng.randint(0, 6)):
            own += [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
            own += rng.choice([*passages, common, rng.choice(passages)[5:], rng.choice(passages)[:-3]])
        texts.append(rng.choice([" ", "\n", "  "]).join(own))
    texts += texts[:10] + ["x " * 400, "x " * 90, "y x " * 60]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return pd.DataFrame({"doc_id": ids, "text": texts, "lang": "en", "source": "s", "n_chars": [len(t) for t in texts]})


@pytest.mark.parametrize("case", ["mixed", "few", "rows"])
@pytest.mark.parametrize("shard_rows", [512, 2])
def test_against_brute_force(spark, case, shard_rows):
    pdf = llm_data.rows() if case == "rows" else shared_passages(3, few_words=case == "few")
    expected = brute(pdf)
    got = substring.removal_digests(llm_data.frame(spark, pdf), shard_rows=shard_rows).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {d: x[:3] for d, x in expected.items()}
    assert len(got) == len(pdf)
    assert case == "rows" or sum(r.n_removed > 0 for r in got) > 20


def test_removal_keeps_columns(spark):
    pdf = shared_passages(8)
    docs = llm_data.frame(spark, pdf).withColumnRenamed("lang", "spans")
    out = substring.remove_repeats(docs, size_col="n_chars")
    assert out.columns == docs.columns
    expected, whole = brute(pdf), dict(zip(pdf.doc_id, pdf.text))
    rows = out.collect()
    assert len(rows) == len(pdf)
    for r in rows:
        assert r.text == (expected[r.doc_id][3] if expected[r.doc_id][1] else whole[r.doc_id])
        assert r.n_chars == len(r.text)


def test_automaton_statistics():
    rng = random.Random(0)
    for _ in range(50):
        known = [[rng.randint(0, 2) for _ in range(rng.randint(0, 30))] for _ in range(4)]
        a = substring.Automaton()
        for k in known:
            a.add(k)
        asked = [rng.randint(0, 3) for _ in range(40)]
        every = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        expected = [max([n for n in range(1, e + 2) if tuple(asked[e + 1 - n : e + 1]) in every], default=0) for e in range(40)]
        assert a.statistics(asked) == expected


def test_rows_that_share_an_id_are_cut_by_their_own_text(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    shared, alone, more = ([rng.choice(words) for _ in range(80)] for _ in range(3))
    rows = [(1, shared), (2, shared[:70]), (2, alone), (2, more[:10] + shared + more), (2, more[:3]), (3, alone), (3, None)]
    frame = [(d, " ".join(t) if t else None) for d, t in rows]
    for shard_rows in (512, 1):
        docs = spark.createDataFrame(frame, "doc_id long, text string").withColumn("row", substring.F.lit(0)).withColumn("rk", substring.F.lit("x"))
        got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.removal_digests(docs, shard_rows=shard_rows).collect())
        assert got == sorted([(1, 80, 0), (2, 70, 70), (2, 80, 0), (2, 170, 80), (2, 3, 0), (3, 80, 80), (3, 0, 0)])
        out = substring.remove_repeats(docs, shard_rows=shard_rows)
        assert out.columns == docs.columns and len(out.collect()) == len(rows)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, spans int")
    assert substring.removal_digests(none).count() == substring.remove_repeats(none).count() == 0
    long = " ".join(map(str, range(60)))
    odd = spark.createDataFrame([(None, long), (5, long), (5, long), (7, long), (8, None)], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), r.n_removed) for r in substring.removal_digests(odd).collect()) == [(-1, 0), (5, 0), (5, 0), (7, 60), (8, 0)]
