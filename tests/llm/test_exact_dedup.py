import hashlib
import re
from collections import defaultdict

import llm_data
import pandas as pd

from lexisift.llm import exact_dedup


def brute(pdf):
    groups = defaultdict(list)
    for doc_id, text in zip(pdf.doc_id, pdf.text):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
    return {(d, min(own)[1], len(own), d == min(own)[1], hashlib.sha256(n.encode()).hexdigest()) for n, own in groups.items() for _, d in own}


def test_marks(spark):
    pdf = llm_data.rows()
    assert {tuple(r) for r in exact_dedup.mark_duplicates(llm_data.frame(spark, pdf)).collect()} == brute(pdf)


def test_drop_keeps_all_columns(spark):
    pdf = llm_data.rows()
    docs = llm_data.frame(spark, pdf).withColumnRenamed("n_chars", "group_size")
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, _, keep, _ in brute(pdf) if keep}


def test_full_and_shuffled_filters_change_nothing(spark, monkeypatch):
    pdf = llm_data.rows(1, 4000)
    docs, expected = llm_data.frame(spark, pdf), brute(pdf)
    stay = {d for d, _, _, keep, _ in expected if keep}
    for settings in ({"SLOTS_A_ROW": 0}, {"BROADCAST_BYTES": 0}, {"BROADCAST_BYTES": 0, "BLOCK_ROWS": 2}):
        with monkeypatch.context() as m:
            for k, v in settings.items():
                m.setattr(exact_dedup, k, v)
            assert {tuple(r) for r in exact_dedup.mark_duplicates(docs).collect()} == expected
            assert {r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()} == stay


def test_only_possibly_repeated_rows_are_shuffled(spark):
    rows = [(i, f"text {i}") for i in range(20_000)] + [(20_000 + i, f"text {i % 500}") for i in range(1000)]
    hashed = exact_dedup._hashed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").cache()
    bitmaps, blocks = exact_dedup.repeated_slots(hashed, len(rows))
    tested = exact_dedup.with_maybe(hashed, bitmaps, blocks)
    assert tested.count() == len(rows)
    shuffled = tested.filter("maybe")
    again = shuffled.filter("id < 500 OR id >= 20000").count()
    assert again == 1500  # every repeated row
    assert shuffled.count() - again < 0.1 * len(rows)  # and few others
    assert "Exchange hash" not in tested._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_no_python_on_the_main_path(spark):
    docs = llm_data.frame(spark, llm_data.rows())
    for out in (exact_dedup.mark_duplicates(docs), exact_dedup.drop_duplicates(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, kept boolean")
    assert exact_dedup.mark_duplicates(none).count() == exact_dedup.drop_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (2, "b"), (None, None), (None, "")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), (r.keep_id or -1), r.group_size, r.kept) for r in exact_dedup.mark_duplicates(odd).collect())
    assert got == [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 3, 3, False), (2, 2, 1, True), (3, 3, 3, True), (3, 3, 3, True)]
    assert sorted(((r.doc_id or -1), r.text or "") for r in exact_dedup.drop_duplicates(odd).collect()) == [(-1, ""), (2, "b"), (3, "a")]


def test_one_row_of_each_group_stays(spark):
    same = spark.createDataFrame([(3, "a"), (3, "a"), (3, "a "), (4, "b"), (4, "c"), (5, "long " * 20_000), (6, "long" * 20_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:5]) for r in exact_dedup.drop_duplicates(same).collect()) == [(3, "a "), (4, "b"), (4, "c"), (5, "long ")]


def test_columns_may_bear_any_name(spark):
    names = ["row", "id", "sha", "size", "maybe", "keep", "number", "block", "slot", "bitmap", "sha2", "rows"]
    docs = spark.createDataFrame([(1, "a", *range(len(names))), (2, "a", *range(len(names))), (3, "b", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a", *range(len(names))), (3, "b", *range(len(names)))]
    assert exact_dedup.mark_duplicates(docs).count() == 3
