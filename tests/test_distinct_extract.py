import random

from lexisift.operators import distinct, extract, report
from lexisift.sources import generators


def test_distinct_substrings(spark):
    golden = {"aaaa": [1, 1, 1, 1], "abab": [2, 2, 2, 1], "abcd": [4, 3, 2, 1], "banana": [3, 3, 3, 3, 2, 1], "mississippi": [4, 7, 7, 7, 7, 6, 5, 4, 3, 2, 1]}
    rng = random.Random(2)
    values = [*golden, "", None, "é日é", *generators.adversarial_texts(20).values(), *("".join(rng.choices("abc", k=rng.randint(1, 60))) for _ in range(30))]
    frame = spark.createDataFrame(list(enumerate(values)), "text_id long, text string")
    expected = {(i, n): len({t[k : k + n] for k in range(len(t) - n + 1)}) for i, t in enumerate(v or "" for v in values) for n in range(1, len(t) + 1)}
    assert {(r.text_id, r.len): r.cnt for r in distinct.distinct_by_length(frame).collect()} == expected
    totals = {r.text_id: r.n_distinct for r in distinct.distinct_total(frame).collect()}
    assert totals == {i: sum(c for (j, _), c in expected.items() if j == i) for i in range(len(values))}
    for i, text in enumerate(golden):
        assert [expected[i, n + 1] for n in range(len(text))] == golden[text]


def slow_extract(corpus, outputs, size, least):
    def count(t):
        return sum(o.startswith(t, k) for o in outputs for k in range(len(o)))

    out = set()
    for doc_id, text in enumerate(corpus):
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        hit = [count(p) > 0 for p in parts]
        runs, i = [], 0
        while i < len(parts):
            j = i
            while j < len(parts) and hit[j]:
                j += 1
            if j > i:
                runs += [(i, j)] if count("".join(parts[i:j])) else [(k, k + 1) for k in range(i, j)]
            i = max(j, i + 1)
        for a, b in runs:
            core, left, right = "".join(parts[a:b]), parts[a - 1] if a else "", parts[b] if b < len(parts) else ""
            x = max(k for k in range(len(left) + 1) if count(left[len(left) - k :] + core))
            y = max(k for k in range(len(right) + 1) if count(core + right[:k]))
            ls, rs = left[len(left) - x :], right[:y]
            both, side = ls + core + rs, ls + core if x >= y else core + rs
            row = (doc_id, a, both, count(both), len(both), len(both)) if count(both) else (doc_id, a, side, count(side), len(side), len(both) - 1)
            if row[-1] >= least:
                out.add(row)
    return out


def test_extraction(spark):
    rng = random.Random(9)
    corpus = ["".join(rng.choices("abcd", k=rng.randint(0, 60))) for _ in range(12)]
    outputs = []
    for _ in range(15):
        text = rng.choice(corpus)
        a = rng.randint(0, len(text))
        outputs.append("".join(rng.choices("abcd", k=5)) + text[a : a + rng.randint(0, 40)] + "".join(rng.choices("abcd", k=5)))
    c = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    o = spark.createDataFrame(list(enumerate(outputs)), "text_id long, text string")
    got = extract.extract(c, o, size=6, least=8).collect()
    expected = slow_extract(corpus, outputs, 6, 8)
    assert {tuple(r) for r in got} == expected and expected
    long = extract.long_runs(c, o, size=8, hits=2).collect()
    expected = set()
    for doc_id, text in enumerate(corpus):
        parts = [text[i : i + 8] for i in range(0, len(text), 8)]
        hit = [any(p in o for o in outputs) for p in parts] + [False]
        begin = 0
        for k, h in enumerate(hit):
            if not h:
                whole = "".join(parts[begin:k])
                cnt = sum(o.startswith(whole, i) for o in outputs for i in range(len(o)))
                if k - begin >= 2 and cnt:
                    expected.add((doc_id, begin, k - begin, cnt))
                begin = k + 1
    assert {tuple(r) for r in long} == expected and expected


def test_stitching_over_documents(spark):
    rows = spark.createDataFrame([(1, 0, "aa", 1), (1, 1, "b", 2), (2, 0, "cc", 1), (2, 1, "dd", 0)], "doc_id long, chunk_no int, chunk string, cnt long")
    alone = {(r.doc_id, r.core, r.left, r.right) for r in extract.stitch(rows).collect()}
    assert alone == {(1, "aab", "", ""), (2, "cc", "", "dd")}
    over = {(r.doc_id, r.core, r.left, r.right) for r in extract.stitch(rows, cross_doc=True).collect()}
    assert over == {(1, "aabcc", "", "dd")}


def test_reports(spark):
    results = spark.createDataFrame([(0, "abc", 2, 3, 3), (1, "abc", 5, 3, 3), (1, "xy", 1, 2, 9), (1, " - ", 4, 3, 3)], "iter int, t string, cnt long, maxlen_lo int, maxlen_hi int")
    assert report.summary(results, 100).first()[:] == (2, 8, 8.0)
    assert sorted(map(tuple, report.percentages(results, 100).collect())) == [(0, 6, 6, 6.0, 6.0, 6.0, 6.0), (1, 2, 9, 2.0, 9.0, 8.0, 15.0)]
    assert sorted(map(tuple, report.cumulative_curve(results).collect())) == [(0, 1, 1), (1, 2, 3)]
    lengths = spark.createDataFrame([(x,) for x in (0, 1, 49, 50, 100)], "n int")
    assert {tuple(r) for r in report.histogram(lengths, "n", 2).collect()} == {(1, 3), (2, 2)}
