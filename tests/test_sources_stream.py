import os

from lexisift.sources import generators, readers
from lexisift.streaming.matcher import Matcher, running_totals


def test_text_files(spark, tmp_path):
    (tmp_path / "case").write_text("banana\n3\nan na\nq\n")
    texts, patterns = readers.read_case(spark, str(tmp_path / "case"))
    assert [tuple(r) for r in texts.collect()] == [(0, "banana")]
    assert [tuple(r) for r in patterns.orderBy("pattern_id").collect()] == [(0, "an"), (1, "na"), (2, "q")]
    (tmp_path / "targets").write_text("2\nan\na b\n2\nx a b y\nban\n")
    texts, patterns = readers.read_targets(spark, str(tmp_path / "targets"))
    assert [r.text for r in texts.orderBy("text_id").collect()] == ["x a b y", "ban"] and [r.pattern for r in patterns.orderBy("pattern_id").collect()] == ["an", "a b"]
    os.mkdir(tmp_path / "out")
    for i in range(3):
        (tmp_path / "out" / f"batch_{i}.txt").write_text(f"line\n{i}")
    assert sorted(map(tuple, readers.read_outputs(spark, str(tmp_path / "out")).collect())) == [(0, "line\n0"), (1, "line\n1"), (2, "line\n2")]


def test_reports_and_counts(spark, tmp_path):
    results = spark.createDataFrame([("a\nb", 2, 3, 4), ("--", 1, 3, 3), ("x\n---\ny", 1, 7, 9)], "t string, cnt int, maxlen_lo int, maxlen_hi int")
    readers.write_report(results.coalesce(1), str(tmp_path / "iter_7"))
    back = readers.read_report(spark, str(tmp_path / "iter_7"))
    assert {tuple(r) for r in back.collect()} == {(7, *r) for r in results.collect()}
    readers.write_strings(results, str(tmp_path / "strings"), "t")
    assert {r.text for r in readers.read_strings(spark, str(tmp_path / "strings")).collect()} == {"a\nb", "--", "x\n---\ny"}
    readers.write_counts(spark.createDataFrame([(1, 5), (0, 9)], "pattern_id long, cnt long"), str(tmp_path / "counts"))
    assert [r.value for r in spark.read.text(str(tmp_path / "counts")).collect()] == ["9", "5"]


def test_small_readers(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a\0b"), (1, "é"), (2, "x"), (3, None)], "text_id long, text string")
    assert [r.text_id for r in readers.rows_with_nul(docs).collect()] == [0]
    docs.write.parquet(str(tmp_path / "p"))
    assert {r.text for r in readers.read_strings(spark, str(tmp_path / "p")).collect()} == {"a\0b", "é"}
    assert readers.joined_outputs(docs).first().text == "a\0b\né\nx\n"
    ranges = spark.createDataFrame([(0, 5, 2, 3), (0, 6, 3, 2)], "text_id long, pattern_id long, l int, r int")
    assert {(r.pattern_id, r.pattern) for r in readers.by_ranges(docs, ranges).collect()} == {(5, "\0b"), (6, "")}
    lines = spark.createDataFrame([(1, 'alert x (content:"|4D 5A|"; depth:2; offset:0; content:"|00|";)'), (2, "none")], "rule_no int, value string")
    assert {(r.rule_no, bytes(r.content), r.depth, r.offset) for r in readers.parse_rules(lines).collect()} == {(1, b"MZ", 2, 0), (1, b"\0", 2, 0)}


def test_generators(spark):
    assert generators.random_text(50) == generators.random_text(50) and len(generators.periodic_text(1000)) == 1000
    assert generators.fibonacci_text(20)[:5] == "ababa" and generators.adversarial_texts(8)["thue"] == "abbabaab"
    text = spark.createDataFrame([(0, "abcab")], "text_id long, text string")
    assert {(r.pos, r.phrase) for r in generators.sliding_phrases(text, [2, 9], 2).collect()} == {(1, "ab"), (3, "ca")}
    assert {r.pattern for r in generators.budgeted_queries(text, 9).collect()} == {"a", "b", "c", "abc", "bca"}
    assert generators.shuffled(text).count() == 1


def test_matcher(spark):
    matcher = Matcher(spark)
    matcher.add_patterns(spark.createDataFrame([(1, "Ab", True, False), (2, "aB", True, False), (3, "Ab", False, False), (4, "zz", False, True), (5, "", False, False)], "pattern_id long, pattern string, no_case boolean, negated boolean"))
    matcher.add_patterns(spark.createDataFrame([(9, "b")], "pattern_id long, pattern string"))
    assert matcher.pattern_count() == 4
    payloads = spark.createDataFrame([(0, "abAB"), (1, "zz"), (2, None)], "payload_id long, payload string")
    assert {tuple(r) for r in matcher.search(payloads).collect()} == {(0, 1, 2), (0, 4, 0), (0, 9, 1), (2, 4, 0)}


def test_binary_payloads_places_and_totals(spark):
    matcher = Matcher(spark).add_patterns(spark.createDataFrame([(1, "Ab", True, False), (2, "b", False, False), (3, "é", False, False), (4, "ab", True, True), (5, "zz", False, True)], "pattern_id long, pattern string, no_case boolean, negated boolean"))
    rows = [(0, b"xaBab\xff"), (1, "éb".encode()), (2, None), (3, b"\x00\xc3")]
    payloads = spark.createDataFrame(rows, "payload_id long, payload binary")
    assert [tuple(r) for r in matcher.matches(payloads).collect()] == [(0, 1, 3), (0, 1, 5), (0, 2, 5), (1, 3, 2), (1, 2, 3)]
    assert {tuple(r) for r in matcher.first_match(payloads).collect()} == {(0, 1, 3), (1, 3, 2)}
    assert {tuple(r) for r in matcher.first_match(payloads, [2]).collect()} == {(0, 2, 5), (1, 2, 3)}
    assert {tuple(r) for r in matcher.totals(payloads).collect()} == {(0, 3), (1, 2), (2, 0), (3, 0)}
    assert {tuple(r) for r in matcher.search(payloads).collect()} == {(0, 1, 2), (0, 2, 1), (0, 5, 0), (1, 2, 1), (1, 3, 1), (1, 4, 0), (1, 5, 0), (2, 4, 0), (2, 5, 0), (3, 4, 0), (3, 5, 0)}
    strings = spark.createDataFrame([(1, "éb")], "payload_id long, payload string")
    assert {tuple(r) for r in matcher.matches(strings).collect()} == {(1, 3, 1), (1, 2, 2)}


def test_stream(spark, tmp_path):
    matcher = Matcher(spark).add_patterns(spark.createDataFrame([(1, "ab")], "pattern_id long, pattern string")).prepare()
    spark.createDataFrame([(0, "abab"), (1, "x"), (2, "ab")], "payload_id long, payload string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("payload_id long, payload string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_totals(matcher.search(stream), str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "sink")).groupBy("pattern_id").sum("cnt").first()[1] == 3
