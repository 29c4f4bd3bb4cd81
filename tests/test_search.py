"""Search operators: hand-made values, equality of the three forms, and brute force."""

import random

import pytest

from lexisift.functions import text as T
from lexisift.operators import search
from lexisift.plans import forms
from lexisift.sources import generators

GOLDEN = {
    "aaaa": {"a": (4, 1), "aa": (3, 1), "aaa": (2, 1), "aaaa": (1, 1), "aaaaa": (0, -1), "b": (0, -1)},
    "abab": {"ab": (2, 1), "ba": (1, 2), "aba": (1, 1), "abab": (1, 1), "bb": (0, -1)},
    "banana": {"ana": (2, 2), "an": (2, 2), "nan": (1, 3), "banana": (1, 1), "x": (0, -1)},
    "é日é": {"é": (2, 1), "日é": (1, 2)},
}


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "text_id long, text string")


def patterns(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pattern_id long, pattern string")


def brute(values, words):
    return {(i, j, sum(t.startswith(p, k) for k in range(len(t))) if p else 0, (t.find(p) + 1 or -1) if p else -1) for i, t in enumerate(v or "" for v in values) for j, p in enumerate(w or "" for w in words)}


@pytest.mark.parametrize("form", ["automaton", "native", "windows"])
@pytest.mark.parametrize("text", GOLDEN)
def test_golden(spark, form, text):
    words = list(GOLDEN[text])
    got = search.match_counts(texts(spark, [text]), patterns(spark, words), form=form).collect()
    assert {words[r.pattern_id]: (r.cnt, r.first_pos) for r in got} == GOLDEN[text]


@pytest.mark.parametrize("form", ["automaton", "native", "windows"])
def test_forms_agree_with_brute_force(spark, form):
    rng = random.Random(7)
    values = ["".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(12)] + [None, "", "aé日\nb"] + list(generators.adversarial_texts(16).values())
    words = ["".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(25)] + ["", None, "ab", "ab", "é日", "x" * 100]
    got = search.match_counts(texts(spark, values), patterns(spark, words), form=form).collect()
    assert {tuple(r) for r in got} == brute(values, words) and len(got) == len(values) * len(words)


def test_totals_and_duplicates(spark):
    got = search.totals(texts(spark, ["abab", "ab"]), patterns(spark, ["ab", "ab", "zz", ""])).collect()
    assert sorted(map(tuple, got)) == [(0, 3), (1, 3), (2, 0), (3, 0)]


def test_positions_prefixes_and_chunks(spark):
    values, words = ["abcabca", "xbcab"], ["abca", "bc", "bc", "q"]
    got = {tuple(r) for r in search.match_positions(texts(spark, values), patterns(spark, words)).collect()}
    assert got == {(0, 0, 4), (0, 0, 7), (0, 1, 3), (0, 1, 6), (0, 2, 3), (0, 2, 6), (1, 1, 3), (1, 2, 3)}
    assert {tuple(r) for r in search.matches_by_end(texts(spark, values), patterns(spark, words)).collect()} == {(0, 4, 1), (0, 7, 1), (0, 3, 2), (0, 6, 2), (1, 3, 2)}
    assert {tuple(r) for r in search.longest_prefix(texts(spark, values), patterns(spark, words)).collect()} == {(0, 0, 4), (0, 1, 2), (0, 2, 2), (0, 3, 0), (1, 0, 2), (1, 1, 2), (1, 2, 2), (1, 3, 0)}
    rng = random.Random(3)
    values, words = ["".join(rng.choices("ab", k=80)) for _ in range(6)], ["".join(rng.choices("ab", k=rng.randint(1, 11))) for _ in range(30)]
    got = {tuple(r) for r in search.two_chunk_count(texts(spark, values), patterns(spark, words)).collect()}
    assert got == {(i, j, c) for i, j, c, _ in brute(values, words) if c}
    some = {r.pattern_id for r in search.prefix_candidates(texts(spark, values), patterns(spark, words)).collect()}
    assert some >= {j for _, j, c, _ in brute(values, words) if c}


def test_aggressive_mode_never_misses(spark):
    rng = random.Random(11)
    values = ["".join(rng.choices("ab", k=30)) for _ in range(40)] + ["abcdefxbcdefg"]
    words = ["".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(40)] + ["abcdefg"]
    pairs = {m: {tuple(r) for r in search.exists(texts(spark, values), patterns(spark, words), m).collect()} for m in ("exact", "aggressive", "pairwise")}
    assert pairs["exact"] == {(i, j) for i, j, c, _ in brute(values, words) if c}
    assert pairs["exact"] <= pairs["aggressive"] <= pairs["pairwise"]
    assert (40, 40) in pairs["aggressive"] - pairs["exact"]


def test_empty_tables(spark):
    no_texts, no_patterns = texts(spark, []), patterns(spark, [])
    for form in ("automaton", "native", "windows"):
        assert search.match_counts(no_texts, patterns(spark, ["a"]), form=form).count() == 0
        assert search.match_counts(texts(spark, ["a"]), no_patterns, form=form).count() == 0


def test_large_dictionaries_take_the_shuffled_form(spark, monkeypatch):
    rng = random.Random(5)
    values = ["".join(rng.choices("abé", k=rng.randint(0, 90))) for _ in range(15)] + list(generators.adversarial_texts(30).values())
    words = ["".join(rng.choices("abé", k=rng.randint(1, 11))) for _ in range(40)]
    t, p = texts(spark, values), patterns(spark, words)
    asks = (search.match_positions, search.two_chunk_count, search.longest_prefix, search.prefiltered_counts, search.gated_positions)
    small = [sorted(map(tuple, ask(t, p).collect())) for ask in asks]
    assert small[1] == small[3] == sorted((i, j, c) for i, j, c, _ in brute(values, words) if c)
    heads = {w[: 1 << len(w).bit_length() - 1] for w in words}
    gated = {i: sum(v[k : k + len(h)] == h for h in heads for k in range(len(v))) for i, v in enumerate(values)}
    assert small[4] == [(i, n) for i, n in gated.items() if n]
    monkeypatch.setattr(forms, "BROADCAST_CHARS", 60)
    monkeypatch.setattr(forms, "check", lambda patterns: None)  # slices of a hash are not of equal size
    assert [sorted(map(tuple, ask(t, p).collect())) for ask in asks] == small
    monkeypatch.undo()
    monkeypatch.setattr(forms, "BROADCAST_CHARS", 60)
    with pytest.raises(ValueError):
        search.match_counts(t, p, form="automaton")


def test_choice_of_form(spark, monkeypatch):
    assert forms.choose(patterns(spark, ["a" * 100])) == "automaton"
    monkeypatch.setattr(forms, "BROADCAST_CHARS", 50)
    assert forms.choose(patterns(spark, ["a" * 100])) == "windows"


def test_functions(spark):
    row = spark.createDataFrame([("Ab é-C. ", 11, "8a4bc")], "t string, n int, r string")
    from pyspark.sql import functions as F

    t, n = F.col("t"), F.col("n")
    got = row.select(T.normalize(t), T.ascii_lower(t), T.filler_share(t), T.bit_floor(n), T.popcount(n), T.chain(n), T.rle_decode(T.rle_runs(F.col("r"))), T.rle_encode(F.lit("aaab")), T.chunks(t, 3), T.token_chunks(t, 2), T.strip_line(t)).first()
    assert got[0] == "abéc" and got[1] == "ab é-c. " and got[2] == 4 and got[3] == 8 and got[4] == 3
    assert [(c.off, c.len) for c in got[5]] == [(0, 8), (8, 2), (10, 1)]
    assert got[6] == "aaaaaaaabbbbc" and got[7] == "3a1b" and got[8] == ["Ab ", "é-C", ". "] and got[9] == ["Ab é-C."] and got[10] == "Ab é-C."
    assert row.select(T.chunks(F.lit(""), 3), T.token_chunks(F.lit(" ")), T.bit_floor(F.lit(0))).first()[:] == ([], [], 0)


def test_native_form_looks_up_blocks(spark):
    """Texts meet the patterns by hashes of blocks, not each text each pattern; places in text, lengths and repeats of every kind."""
    rng = random.Random(2)
    values = ["".join(rng.choices("abé😀", k=rng.randint(0, 300))) for _ in range(30)] + ["a" * 200, "x" + "ab" * 150, None, "", "a"]
    words = ["".join(rng.choices("abé😀", k=rng.randint(1, 7))) for _ in range(30)] + [None, "", "a", "a", "aa", "a" * 31, "ab" * 40, "a" * 63, "a" * 64]
    words += [v[k : k + n] for v in values[:30] for n in (1, 2, 3, 15, 16, 30, 31, 33, 63, 64, 100) if len(v) > n for k in (0, rng.randrange(len(v) - n), len(v) - n)]
    t, p = texts(spark, values), patterns(spark, words)
    found = search.match_counts(t, p, zeros=False, form="native")
    assert sorted(map(tuple, found.collect())) == sorted(x for x in brute(values, words) if x[2])
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    twice = search.match_counts(t.union(t), p.union(p), zeros=False, form="native")
    assert sorted(map(tuple, twice.collect())) == sorted([x for x in brute(values, words) if x[2]] * 4)
