import random

import llm_data
import numpy as np

from lexisift.llm import similar, simhash
from lexisift.llm.components import components


def slow_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_components(texts):
    sets = {i: slow_set(t) for i, t in texts.items()}
    near = {i: [j for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in sets}
    best = {i: i for i in sets}
    while (new := {i: min(best[j] for j in near[i]) for i in sets}) != best:
        best = new
    return best


def varied(seed, n=150):
    """Texts of 20 to 250 words with near copies of them and copies of copies, and a phrase that very many have."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            text = list(rng.choice(out))
            for _ in range(rng.randint(0, max(1, len(text) // 30))):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = rng.choices(words, k=rng.randint(20, 250))
            text[3:3] = "a phrase that very many of them have".split()
        out.append(text)
    return {i + 5: " ".join(x) for i, x in enumerate(out)}


def test_stage_drops_what_all_pairs_find(spark):
    texts = varied(2)
    expected = {i for i, c in slow_components(texts).items() if i == c}
    assert 20 < len(expected) < len(texts) - 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8).collect()} == expected
    keyed = docs.withColumn("doc_id", similar.F.unhex(similar.F.lpad(similar.F.hex("doc_id"), 16, "0")))
    for part_shingles, key_rows in ((10**6, 4096), (300, 4)):
        found = {int.from_bytes(r.node): int.from_bytes(r.component) for r in components(similar.links(keyed, part_shingles=part_shingles, key_rows=key_rows)).collect()}
        assert {i for i in texts if found.get(i, i) == i} == expected


def test_fingerprints_of_close_sets_are_within_the_allowed_distance():
    rng = np.random.default_rng(0)
    most = similar.allowed_distance(0.8)
    far = 0
    for _ in range(2000):
        n = int(rng.integers(9, 400))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a.copy()
        b[: n // 9] = rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)  # a Jaccard index of 0.8
        c = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        fps = [similar.fingerprint(x) for x in (a, b, c)]
        assert np.bitwise_count(fps[0] ^ fps[1]).sum() <= most
        far += np.bitwise_count(fps[0] ^ fps[2]).sum() > most
    assert far > 1800


def test_near_stage_of_the_pipeline_goes_beyond_three_bits(spark):
    import corpus_pipeline
    from lexisift.llm.simhash import fingerprint

    rng = random.Random(0)
    text = [f"w{rng.randrange(5000)}" for _ in range(150)]
    other = list(text)
    for i in (40, 80, 120):
        other[i] = "changed"
    a, b = " ".join(text), " ".join(other)
    assert (fingerprint(a) ^ fingerprint(b)).bit_count() > 3
    docs = spark.createDataFrame([(1, a), (2, b), (3, " ".join(reversed(text)))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == {1, 3}


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.drop_near_duplicates(none, shingle=5, similarity=0.8).count() == 0
    pdf = llm_data.rows()
    expected = slow_components(dict(zip(pdf.doc_id, pdf.text)))
    assert {r.doc_id for r in simhash.drop_near_duplicates(llm_data.frame(spark, pdf), shingle=5, similarity=0.8).collect()} == {i for i, c in expected.items() if i == c}
    assert all(len(similar.shingles(t or "")) == len(slow_set(t)) for t in pdf.text)
    assert np.array_equal(similar.shingles(""), similar.shingles(" \n"))


def test_small_tables_have_few_files(spark, monkeypatch):
    """Links and other tables of ids are written by a few tasks a core, however many partitions a shuffle has; none is lost."""
    from pathlib import Path

    from lexisift.llm import components
    from lexisift.plans import storage

    most, files = storage.FILES_A_CORE * spark.sparkContext.defaultParallelism, []

    def stash(df, tag, **named):
        out = storage.stash(df, tag, **named)
        files.append(len(list(Path(out.stash_path.removeprefix("file://")).glob("part-*"))))
        return out

    monkeypatch.setattr(components, "stash", stash)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(4 * most))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.range(3000).selectExpr("id + id div 10 AS a", "id + id div 10 + 1 AS b")  # 300 chains of 11 nodes
        got = components.components(links).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [(n, n - n % 11) for n in range(3300)]
    assert len(files) > 4 and max(files) <= most
