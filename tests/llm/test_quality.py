import random
import re
from collections import Counter

import llm_data
import numpy as np
import pandas as pd
import pytest

from lexisift.llm import quality, queries


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def prose(rng, junk=False):
    words = ["".join(rng.choices("aeiounrstlmd", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 200))]
    if junk:
        return " ".join(w + rng.choice(["###", "&&&", "***"]) for w in words)
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, len(words), 12))


def test_counts(spark):
    pdf = llm_data.rows()
    got = {r.doc_id: r for r in quality.judged(llm_data.frame(spark, pdf)).collect()}
    assert len(got) == len(pdf)
    for d, t in zip(pdf.doc_id, pdf.text):
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(4)
    junk = [i % 10 == 0 for i in range(900)]
    pdf = pd.DataFrame({"doc_id": range(900), "text": [prose(rng, j) for j in junk], "lang": ["en" if i % 3 else None for i in range(900)], "source": ["s" if i % 47 else f"t{i}" for i in range(900)], "n_chars": 0})
    got = {r.doc_id: r for r in quality.judged(llm_data.frame(spark, pdf)).collect()}
    assert all(got[i].kept != j for i, j in enumerate(junk))
    docs = llm_data.frame(spark, pdf).withColumnRenamed("n_chars", "kept")
    out = quality.drop_rejected(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, j in enumerate(junk) if not j}


def numpy_estimate(x, tries=60):
    """A plain minimum covariance determinant: random starts, the closest half by sorting, steps until nothing changes, then
    what lies within the 0.975 quantile."""
    rng, (n, p) = np.random.default_rng(1), x.shape
    h, best = min((n + p + 1) // 2, n), (np.inf, None)

    def moments(y, factor):
        return y.mean(axis=0), factor * np.cov(y.T, bias=True) + quality.FLOOR**2 * np.eye(p)

    def distance(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    for _ in range(tries):
        mean, cov = moments(x[rng.choice(n, min(n, p + 1), replace=False)], 1.0)
        was = np.inf
        while (now := np.linalg.slogdet(cov)[1]) < was - 1e-9 or was == np.inf:
            was = now
            mean, cov = moments(x[np.argsort(distance(mean, cov), kind="stable")[:h]], quality.HALF_FACTOR)
        if now < best[0]:
            best = (now, (mean, cov))
    return moments(x[distance(*best[1]) <= quality.WITHIN], quality.WITHIN_FACTOR)


def numpy_verdicts(x, langs, sources):
    """Squared distance of every row by the same rules of shrinking."""
    def mixed(own, pool, n):
        w = n / (n + quality.SHRINK)
        gap = own[0] - pool[0]
        return w * own[0] + (1 - w) * pool[0], w * w * own[1] + (1 - w * w) * pool[1] + w * w * (1 - w) * np.outer(gap, gap)

    whole, out = numpy_estimate(x), np.zeros(len(x))
    for lang in set(langs):
        mine = np.array([v == lang for v in langs])
        pool = mixed(numpy_estimate(x[mine]), whole, mine.sum())
        for source in {s for s, m in zip(sources, mine) if m}:
            own = mine & np.array([s == source for s in sources])
            mean, cov = mixed(numpy_estimate(x[own]), pool, own.sum())
            out[own] = np.einsum("ij,jk,ik->i", x[own] - mean, np.linalg.inv(cov), x[own] - mean)
    return out


@pytest.mark.parametrize("share", [0.05, 0.25, 0.4])
def test_estimate_holds_up_to_40_percent_of_outliers(spark, share):
    rng = np.random.default_rng(0)
    x = rng.multivariate_normal([1, 2, 0, -1, 0.5], np.diag([0.04, 0.09, 0.01, 0.25, 0.04]), 2000)
    n = int(share * len(x))
    x[:n] += rng.choice([2, 3], (n, 1))
    ints = np.round(x * quality.UNIT).astype(int)
    rows = spark.createDataFrame([([7], *map(int, r)) for r in ints], "gids array<long>, " + ", ".join(f"{s} long" for s in quality.STATS)).repartition(3)
    got = quality.estimate(rows).first()
    assert got.n == len(x)
    mean, cov = numpy_estimate(ints / quality.UNIT)
    assert np.allclose([got[f"m{i}"] for i in range(5)], mean, atol=0.01)
    assert np.allclose([[got[f"c{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)], cov, atol=0.01)
    assert np.allclose(mean, x[n:].mean(axis=0), atol=0.05)


def test_wider_cells_of_a_group_with_very_many(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.multivariate_normal([1, 2, 0, -1, 0.5], np.diag([0.04, 0.09, 0.01, 0.25, 0.04]), 1500)
    rows = spark.createDataFrame([([i % 2], *map(int, r * quality.UNIT)) for i, r in enumerate(x)], "gids array<long>, " + ", ".join(f"{s} long" for s in quality.STATS))
    monkeypatch.setattr(quality, "MAX_CELLS", 300)
    for r in quality.estimate(rows).collect():
        assert r.n == 750 and np.allclose([r[f"m{i}"] for i in range(5)], [1, 2, 0, -1, 0.5], atol=0.1)


def test_shortest_interval():
    rng = np.random.default_rng(2)
    for _ in range(50):
        values = np.unique(rng.integers(0, 60, 20))
        number = rng.integers(1, 5, len(values))
        every = np.repeat(values, number)
        need = int(np.ceil(0.5 * len(every)))
        assert quality.shortest(values, number, 0.5)[1] == min(every[i + need - 1] - every[i] for i in range(len(every) - need + 1))


@pytest.mark.parametrize("junk_share", [0.1, 0.4])
def test_query_against_brute_force(spark, tmp_path, junk_share):
    """op5_quality itself, whole texts, against counts by regular expressions and a plain estimate in numpy."""
    rng = random.Random(11)
    n = 700
    junk = [rng.random() < junk_share for _ in range(n)]
    langs = [rng.choice(["en", "de", None]) for _ in range(n)]
    sources = [rng.choice(["a", "a", "a", "b"]) if i else "alone" for i in range(n)]
    texts = [prose(rng, j) if rng.random() < 0.95 else rng.choice([None, "", "w " * 30]) for j in junk]
    texts[5] = prose(rng) * 60
    pdf = pd.DataFrame({"doc_id": range(n), "text": texts, "lang": langs, "source": sources, "n_chars": 0})
    llm_data.frame(spark, pdf).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_quality(spark, str(tmp_path)).collect()}
    assert len(got) == n
    for d, t in enumerate(texts):
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
    judged = [d for d in range(n) if not got[d].base_failed]
    x = np.array([quality.measures(texts[d])[5:] for d in judged]) / quality.UNIT
    distance = numpy_verdicts(x, [langs[d] for d in judged], [sources[d] for d in judged])
    assert all(got[d].kept == (y <= quality.CUTOFF) for d, y in zip(judged, distance) if abs(y / quality.CUTOFF - 1) > 0.1)
    assert np.mean(np.abs(np.array([got[d].distance for d in judged]) - distance) <= 0.1 * distance + 0.1) > 0.97
    assert np.mean([got[d].kept != junk[d] for d in judged]) > 0.95


def test_rows_that_share_an_id_or_have_none_are_judged_alone(spark):
    rng = random.Random(3)
    good = [prose(rng) for _ in range(60)]
    rows = [(i, t, "en", "s") for i, t in enumerate(good)] + [(0, "short", "en", "s"), (None, "short", "en", "s"), (None, prose(rng), "en", "s"), (1, good[1], "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("row", quality.F.lit(1)).withColumn("kept", quality.F.lit("x")).withColumn("n", quality.F.lit(2))
    out = quality.drop_rejected(docs)
    assert out.columns == docs.columns and out.schema["kept"].dataType == docs.schema["kept"].dataType
    left = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in out.collect())
    assert left == sorted((-1 if d is None else d, t) for d, t, _, _ in rows if t != "short")


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, kept int")
    assert quality.judged(none).count() == quality.drop_rejected(none).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, "w " * 30, "en", "s"), (1, "w " * 30, "en", "s"), (2, " ".join(map(str, range(30))), None, "s")], "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id or -1, r.n_words, r.kept) for r in quality.judged(odd).collect()) == [(-1, 0, False), (1, 30, False), (1, 30, False), (2, 30, True)]
    assert [r.doc_id for r in quality.drop_rejected(odd).collect()] == [2]
    assert [r.doc_id for r in quality.drop_rejected(odd.withColumn("text", quality.F.col("text").cast("binary"))).collect()] == [2]


def test_small_tables_and_groups_are_judged(spark):
    rng = random.Random(6)
    n = 80
    junk = [i % 8 == 0 for i in range(n)]
    pdf = pd.DataFrame({"doc_id": range(n), "text": [prose(rng, j) for j in junk], "lang": [["en", None][i % 3 == 0] for i in range(n)], "source": [f"s{rng.randrange(5)}" for _ in range(n)], "n_chars": 0})
    got = {r.doc_id: r for r in quality.judged(llm_data.frame(spark, pdf)).collect()}
    assert all(r.distance is not None for r in got.values())
    assert [i for i, j in enumerate(junk) if got[i].kept == j] == []
