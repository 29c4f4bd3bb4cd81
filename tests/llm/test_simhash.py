import random

import llm_data
import numpy as np
import xxhash

from lexisift.llm import simhash
from lexisift.llm.common import row_key
from lexisift.llm.components import components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """{id: fp} to {id: least id reachable}."""
    best = {i: i for i in fps}
    while True:
        new = {i: min(best[j] for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 3) for i in fps}
        if new == best:
            return best
        best = new


def test_query_shape(spark):
    pdf = llm_data.rows()
    fps = {d: slow_fingerprint(t) for d, t in zip(pdf.doc_id, pdf.text)}
    expected = slow_components(fps)
    got = simhash.near_duplicates(llm_data.frame(spark, pdf)).collect()
    assert {tuple(r) for r in got} == {(d, f"{fps[d]:016x}", expected[d]) for d in fps}


def close_fingerprints(rng, n):
    seeds = [rng.getrandbits(64) for _ in range(8)]
    out = []
    for _ in range(n):
        x = rng.choice(seeds + out[-20:])
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5])):
            x ^= 1 << b
        out.append(x)
    return out


def test_links_reach_what_all_pairs_reach(spark):
    rng = random.Random(5)
    fps = {i + 10: x for i, x in enumerate(dict.fromkeys(close_fingerprints(rng, 400)))}
    frame = spark.createDataFrame([(simhash.signed(x), i) for i, x in fps.items()], "fp long, rep long")
    expected = slow_components(fps)
    for key_rows in (4096, 7):
        found = {r.node: r.component for r in components(simhash.links(frame, key_rows=key_rows)).collect()}
        assert {i: found.get(i, i) for i in fps} == expected


def test_forest_of_a_dense_group():
    rng = random.Random(1)
    fps = np.array(close_fingerprints(rng, 300), np.uint64)
    i, j = simhash.close_pairs(fps, np.array([0, 300]), 3)
    assert len(i) < 300
    root = list(range(300))
    for a, b in zip(i, j):
        root = [root[a] if r == root[b] else r for r in root]
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    assert all(root[a] == root[b] for a, b in zip(*np.nonzero(near)))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_edges_and_dropping(spark):
    none = spark.createDataFrame([], "doc_id long, text string, fp long")
    assert simhash.near_duplicates(none).count() == simhash.drop_near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (4, "A b c"), (2, "a b\tc"), (9, None), (8, ""), (None, "x y z w"), (2, "a b c")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), (r.component_id or -1)) for r in simhash.near_duplicates(odd).collect())
    assert got == [(-1, -1), (-1, 2), (2, 2), (2, 2), (4, 2), (8, 8), (9, 8)]
    for how in ({}, {"shingle": 5, "similarity": 0.8}):
        left = sorted((r.doc_id or -1) for r in simhash.drop_near_duplicates(odd, **how).collect())
        assert left == ([-1, 2, 8] if not how else [-1, 2, 8]), how


def test_string_ids_and_shared_ids(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(120)) for _ in range(3))
    docs = spark.createDataFrame([("x1", a, 0), ("x2", a.replace(" ", "\n"), 1), ("x2", b, 2), ("x3", b, 3), ("x3", c, 4), (None, c, 5), ("x3", c, 4)], "doc_id string, text string, key int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 7 and {r.component_id for r in got} == {"x1", "x2", "x3"}
    for how in ({}, {"shingle": 5, "similarity": 0.8}):
        out = simhash.drop_near_duplicates(docs, **how)
        assert out.columns == docs.columns and sorted(r.key for r in out.collect()) == [0, 2, 4], how


def test_keys_ascend_as_ids_do(spark):
    ids = [-(1 << 63), -5, -1, 0, 1, 7, 1 << 40, (1 << 63) - 1, None]
    docs = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    assert [r.doc_id for r in docs.orderBy(row_key(docs, "doc_id", "text")).collect()] == ids
    docs = spark.createDataFrame([(i, "t") for i in ("", "a", "ab", "b", None)], "doc_id string, text string")
    assert [r.doc_id for r in docs.orderBy(row_key(docs, "doc_id", "text")).collect()] == ["", "a", "ab", "b", None]
