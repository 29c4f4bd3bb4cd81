import random
from itertools import combinations

import llm_data
import pytest

from lexisift.llm import license_scan as ls


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def brute_rising(pairs):
    for n in range(len(pairs), 0, -1):
        if any(all(x[1] < y[1] for x, y in zip(c, c[1:])) for c in combinations(pairs, n)):
            return n
    return 0


def test_rising():
    rng = random.Random(0)
    for _ in range(100):
        seconds = rng.sample(range(20), rng.randint(0, 9))
        pairs = list(enumerate(seconds))
        got = ls.rising(pairs)
        assert len(got) == brute_rising(pairs) and all(x < y for (_, x), (_, y) in zip(got, got[1:]))


def test_alignment_is_common_and_near_the_longest():
    rng = random.Random(1)
    for _ in range(200):
        template = [b"%d" % i for i in rng.choices(range(60), k=30)]
        text = [w for w in template if rng.random() < 0.9]
        for _ in range(3):
            text.insert(rng.randint(0, len(text)), b"new")
        pairs = ls.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert 0.8 * longest_common(text, template) <= len(pairs) <= longest_common(text, template)


@pytest.mark.parametrize("name,text", ls.TEMPLATES)
def test_planted_notices_are_found(name, text):
    rng = random.Random(name)
    scanner = ls.Scanner(ls.TEMPLATES, ls.COVERAGE)
    prose = ["la", "the", "of", "license", "under", "x", "version", "2"]
    for copies in (1, 3):
        own = []
        for _ in range(copies):
            own += rng.choices(prose, k=300) + text.split()
        found = scanner.findings(ls.words_of(" ".join(own + rng.choices(prose, k=300))))
        by_name = {f[0]: f for f in found}
        assert by_name[name][2] == 1.0
        assert by_name[name][4] - by_name[name][3] >= len(ls.words_of(text))


def test_scan(spark):
    apache = dict(ls.TEMPLATES)["Apache-2.0"]
    texts = [None, "", " \n", "no license here", f"a b\n{apache}\nc d", apache.upper(), apache.replace("2.0", "1.1"), "x " * 30_000 + apache]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(4, texts[4], 0.5), (None, apache, 0.5)], "doc_id long, text string, coverage double")
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), r.license, r.coverage) for r in ls.scan_licenses(docs).collect())
    name = "Apache-2.0"
    assert rows == [(-1, name, 1.0), (0, None, 0.0), (1, None, 0.0), (2, None, 0.0), (3, None, 0.0), (4, name, 1.0), (4, name, 1.0), (5, name, 1.0), (6, name, 6 / 7), (7, name, 1.0)]
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert ls.scan_licenses(llm_data.frame(spark, llm_data.rows())).filter("license IS NOT NULL").count() == 0


@pytest.mark.parametrize("name,text", ls.TEMPLATES)
def test_notices_that_repeat_close_by_are_found(name, text):
    rng = random.Random(name)
    scanner = ls.Scanner(ls.TEMPLATES, ls.COVERAGE)
    prose = ["la", "the", "of", "license", "under", "x", "version", "2"]
    n = len(ls.words_of(text))
    for copies in (2, 3, 7):
        for between in ("", "license:", "module a.py\n", "la la under x"):
            body = f" {between} ".join([text] * copies)
            words = ls.words_of(" ".join(rng.choices(prose, k=300) + [between, body] + rng.choices(prose, k=300)))
            by_name = {f[0]: f for f in scanner.findings(words)}
            assert by_name[name][1:3] == (n, 1.0)


def test_close_copies_with_a_changed_word_are_found():
    scanner = ls.Scanner(ls.TEMPLATES, ls.COVERAGE)
    text = "Released under the new MIT License. " * 3 + "Released under MIT License. " * 3
    for body in (text, " ".join(reversed(text.split(". ")))):
        found = {f[0]: f for f in scanner.findings(ls.words_of("la " * 300 + body + " x" * 300))}
        assert found["MIT"][2] >= 0.8
    assert not scanner.findings(ls.words_of("la " * 300 + "license mit the under released " * 5 + " x" * 300))
