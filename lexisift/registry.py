"""Queries of the search and overlap operators, with the SQL that gives the same rows.

Roles of the tables: documents are texts, benchmark is the dictionary (whole, and in slices of 30 characters), conversations
are outputs, pages are payloads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.operators import distinct, extract, report, search
from lexisift.plans.storage import stash
from lexisift.sources import generators, readers
from lexisift.streaming.matcher import Matcher

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SLICE = 30


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts; dealt out, since the automaton is CPU-bound and a small table is one file."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return docs.repartition(spark.sparkContext.defaultParallelism) if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else docs


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of SLICE characters that cover every item; the last ends where the item ends."""
    n = F.ceil(F.length("text") / SLICE).cast("int")
    every = table(spark, sf_dir, "benchmark").filter(n > 0).select("item_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    begin = F.least(F.col("k") * SLICE + 1, F.greatest(F.length("text") - SLICE + 1, F.lit(1)))
    return every.select((F.col("item_id") * 1000 + F.col("k")).alias("pattern_id"), F.substring(F.col("text"), begin, F.lit(SLICE)).alias("pattern"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


SLICES_SQL = f"slices AS (SELECT item_id * 1000 + k AS pattern_id, substr(text, least(1 + {SLICE} * k, greatest(length(text) - {SLICE - 1}, 1)), {SLICE}) AS pattern FROM benchmark, unnest(range(0, (length(text) + {SLICE - 1}) // {SLICE})) AS u(k))"
COUNT_SQL = "len(list_filter(range(1, length({t}) - length({p}) + 2), lambda i: substr({t}, i, length({p})) = {p}))"


# counts ------------------------------------------------------------------------------------------------------------


@query(f"SELECT d.doc_id AS text_id, b.item_id AS pattern_id, CASE WHEN contains(d.text, b.text) THEN {COUNT_SQL.format(t='d.text', p='b.text')} ELSE 0 END AS cnt FROM documents d, benchmark b")
def mass_count(spark, sf_dir):
    """Every item in every document, absent ones with 0."""
    return search.mass_count(texts(spark, sf_dir), items(spark, sf_dir))


@query(f"WITH {SLICES_SQL} SELECT s.pattern_id, coalesce(sum({COUNT_SQL.format(t='d.text', p='s.pattern')}), 0)::BIGINT AS cnt FROM slices s LEFT JOIN documents d ON contains(d.text, s.pattern) GROUP BY s.pattern_id")
def mass_count_total(spark, sf_dir):
    return search.totals(texts(spark, sf_dir), slices(spark, sf_dir))


@query(f"SELECT d.doc_id AS text_id, b.item_id AS pattern_id, CASE WHEN contains(d.text, b.text) THEN {COUNT_SQL.format(t='d.text', p='b.text')} ELSE 0 END AS cnt, (CASE WHEN contains(d.text, b.text) THEN strpos(d.text, b.text) ELSE -1 END)::INT AS first_pos FROM documents d, benchmark b")
def first_position(spark, sf_dir):
    return search.match_counts(texts(spark, sf_dir), items(spark, sf_dir))


@query(f"WITH {SLICES_SQL} SELECT d.doc_id AS text_id, s.pattern_id, {COUNT_SQL.format(t='d.text', p='s.pattern')} AS cnt, strpos(d.text, s.pattern)::INT AS first_pos FROM slices s JOIN documents d ON contains(d.text, s.pattern)")
def native_count(spark, sf_dir):
    """The form without Python: blocks of the texts meet the patterns' stretches in a broadcast join."""
    return search.match_counts(texts(spark, sf_dir), slices(spark, sf_dir), zeros=False, form="native")


@query(f"WITH {SLICES_SQL} SELECT d.doc_id AS text_id, s.pattern_id, {COUNT_SQL.format(t='d.text', p='s.pattern')} AS cnt, strpos(d.text, s.pattern)::INT AS first_pos FROM slices s JOIN documents d ON contains(d.text, s.pattern)")
def window_join_count(spark, sf_dir):
    """The form for dictionaries too large to broadcast: gated and grouped windows meet the patterns' chunks in a shuffled join."""
    return search.match_counts(texts(spark, sf_dir), slices(spark, sf_dir), zeros=False, form="windows")


@query(f"WITH {SLICES_SQL}, chunks AS (SELECT DISTINCT substr(pattern, 1, 16) AS p FROM slices), places AS (SELECT doc_id, substr(text, i, 16) AS w FROM documents, unnest(range(1, length(text) - 14)) AS u(i)) SELECT doc_id AS text_id, count(*) AS n_windows FROM places JOIN chunks ON w = p GROUP BY doc_id")
def gated_positions(spark, sf_dir):
    """Places where some pattern may begin, by its first power-of-two chunk (16 of 30 characters)."""
    return search.gated_positions(texts(spark, sf_dir), slices(spark, sf_dir))


@query(f"WITH {SLICES_SQL} SELECT d.doc_id AS text_id, s.pattern_id, {COUNT_SQL.format(t='d.text', p='s.pattern')} AS cnt FROM slices s JOIN documents d ON contains(d.text, s.pattern)")
def prefiltered_count(spark, sf_dir):
    """First the search for first chunks alone, then for the patterns that are left."""
    return search.prefiltered_counts(texts(spark, sf_dir), slices(spark, sf_dir))


@query(f"WITH {SLICES_SQL} SELECT d.doc_id AS text_id, s.pattern_id, {COUNT_SQL.format(t='d.text', p='s.pattern')} AS cnt FROM slices s JOIN documents d ON contains(d.text, s.pattern)")
def two_chunk_count(spark, sf_dir):
    return search.two_chunk_count(texts(spark, sf_dir), slices(spark, sf_dir))


@query(f"WITH {SLICES_SQL} SELECT d.doc_id AS text_id, sum({COUNT_SQL.format(t='d.text', p='s.pattern')})::BIGINT AS cnt FROM slices s JOIN documents d ON contains(d.text, s.pattern) GROUP BY d.doc_id")
def total_matches(spark, sf_dir):
    return search.match_counts(texts(spark, sf_dir), slices(spark, sf_dir), zeros=False).groupBy("text_id").agg(F.sum("cnt").alias("cnt"))


POSITIONS_SQL = f"positions AS (SELECT d.doc_id AS text_id, s.pattern_id, unnest(list_filter(range(1, length(d.text) - {SLICE} + 2), lambda i: substr(d.text, i, {SLICE}) = s.pattern)) + {SLICE} - 1 AS pos_end FROM slices s JOIN documents d ON contains(d.text, s.pattern))"


@query(f"WITH {SLICES_SQL}, {POSITIONS_SQL} SELECT text_id, pattern_id, pos_end::INT AS pos_end FROM positions")
def match_positions(spark, sf_dir):
    return search.match_positions(texts(spark, sf_dir), slices(spark, sf_dir))


@query(f"WITH {SLICES_SQL}, {POSITIONS_SQL} SELECT text_id, pos_end::INT AS pos_end, count(*) AS cnt FROM positions GROUP BY text_id, pos_end")
def matches_by_end_pos(spark, sf_dir):
    return search.matches_by_end(texts(spark, sf_dir), slices(spark, sf_dir))


# existence ----------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id AS text_id, b.item_id AS pattern_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def exists_exact(spark, sf_dir):
    return search.exists(texts(spark, sf_dir), items(spark, sf_dir))


def _links_sql(source: str, shifted: bool) -> str:
    parts = f"SELECT pattern_id, pattern AS t FROM {source}" + (f" UNION ALL SELECT pattern_id, substr(pattern, 2) FROM {source}" if shifted else "")
    return f"""chains AS (SELECT pattern_id, t, list_transform(list_filter(range(30, -1, -1), lambda b: (length(t) >> b) & 1 = 1), lambda b: {{'o': (length(t) >> (b + 1)) << (b + 1), 'n': 1::BIGINT << b}}) AS c FROM ({parts})),
    links AS (SELECT DISTINCT pattern_id, link FROM (SELECT pattern_id, unnest(list_transform(range(1, greatest(len(c) - 1, 1) + 1), lambda i: substr(t, c[i].o + 1, c[i].n + coalesce(c[i + 1].n, 0)))) AS link FROM chains))"""


ITEMS_SQL = "items AS (SELECT item_id AS pattern_id, text AS pattern FROM benchmark)"
FOUND_SQL = "SELECT d.doc_id AS text_id, l.pattern_id FROM links l JOIN documents d ON contains(d.text, l.link) JOIN (SELECT pattern_id, count(*) AS need FROM links GROUP BY pattern_id) n ON n.pattern_id = l.pattern_id GROUP BY d.doc_id, l.pattern_id HAVING count(*) = max(need)"


@query(f"WITH {SLICES_SQL}, {_links_sql('slices', True)} {FOUND_SQL}")
def exists_aggressive(spark, sf_dir):
    return search.exists(texts(spark, sf_dir), slices(spark, sf_dir), "aggressive")


@query(f"WITH {SLICES_SQL}, {_links_sql('slices', False)} {FOUND_SQL}")
def exists_pairwise(spark, sf_dir):
    return search.exists(texts(spark, sf_dir), slices(spark, sf_dir), "pairwise")


@query(f"WITH {ITEMS_SQL}, {_links_sql('items', True)} SELECT pattern_id, link, (SELECT count(*) FROM documents d WHERE contains(d.text, link)) AS n_texts FROM links")
def link_search(spark, sf_dir):
    """Each distinct link of the dictionary is answered once, for all patterns that have it."""
    wanted = search.links(items(spark, sf_dir), True)
    numbered = wanted.select("link").distinct().select(F.monotonically_increasing_id().alias("pattern_id"), F.col("link").alias("pattern"))
    numbered = stash(numbered, "links")
    found = search.match_counts(texts(spark, sf_dir), numbered, zeros=False).groupBy("pattern_id").agg(F.count("*").alias("n"))
    answers = numbered.join(found, "pattern_id", "left").select(F.col("pattern").alias("link"), F.coalesce("n", F.lit(0)).alias("n_texts"))
    return wanted.join(answers, "link").select("pattern_id", "link", "n_texts")


@query("SELECT DISTINCT b.item_id AS pattern_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, (1::BIGINT << (length(bin(length(b.text))) - 1))::BIGINT))")
def prefix_prefilter(spark, sf_dir):
    return search.prefix_candidates(texts(spark, sf_dir), items(spark, sf_dir))


@query("SELECT c.conv_id * 1000 + c.turn AS text_id, b.item_id AS pattern_id, coalesce(list_max(list_filter(range(1, length(b.text) + 1), lambda k: contains(c.text, substr(b.text, 1, k)))), 0)::INT AS prefix_len FROM conversations c, benchmark b")
def longest_prefix(spark, sf_dir):
    out = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text")
    return search.longest_prefix(out, items(spark, sf_dir))


# payloads -----------------------------------------------------------------------------------------------------------

FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


SHOWN_SQL = f"{SLICES_SQL}, folded AS (SELECT min(pattern_id) AS pattern_id, encode({FOLD.format('pattern')}) AS p FROM slices GROUP BY 2), shown AS (SELECT page_id, encode({FOLD.format('html')}) AS h FROM pages), places AS (SELECT page_id, pattern_id, octet_length(p) AS n, unnest(list_filter(range(1, octet_length(h) - octet_length(p) + 2), lambda i: h[i:i + octet_length(p) - 1] = p)) AS i FROM shown JOIN folded ON contains(hex(h), hex(p)))"


def payload_matcher(spark, sf_dir, binary: bool = False) -> tuple[Matcher, DataFrame]:
    patterns = slices(spark, sf_dir).withColumn("no_case", F.lit(True))
    html = F.col("html").cast("binary") if binary else F.col("html")
    shown = table(spark, sf_dir, "pages").select(F.col("page_id").alias("payload_id"), html.alias("payload"))
    return Matcher(spark).add_patterns(patterns), shown


@query(f"WITH {SHOWN_SQL} SELECT page_id AS payload_id, pattern_id, (i + n - 1)::INT AS pos_end FROM places")
def payload_matches(spark, sf_dir):
    """Every occurrence in payloads of bytes, with the byte where it ends."""
    matcher, shown = payload_matcher(spark, sf_dir, True)
    return matcher.matches(shown)


@query(f"WITH {SHOWN_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i, pattern_id) AS r FROM places) SELECT page_id AS payload_id, pattern_id, (i + n - 1)::INT AS pos_end FROM ranked WHERE r = 1")
def payload_first_match(spark, sf_dir):
    """The search that ends with its first match: by where it begins, then by pattern."""
    matcher, shown = payload_matcher(spark, sf_dir, True)
    return matcher.first_match(shown)


@query(f"WITH {SHOWN_SQL} SELECT s.page_id AS payload_id, count(i) AS total FROM shown s LEFT JOIN places p ON p.page_id = s.page_id GROUP BY s.page_id")
def payload_totals(spark, sf_dir):
    """Occurrences over all distinct patterns of each payload of bytes."""
    matcher, shown = payload_matcher(spark, sf_dir, True)
    return matcher.totals(shown)


@query(f"WITH {SLICES_SQL}, folded AS (SELECT min(pattern_id) AS pattern_id, {FOLD.format('pattern')} AS p FROM slices GROUP BY 2), shown AS (SELECT page_id, {FOLD.format('html')} AS h FROM pages) SELECT page_id AS payload_id, pattern_id, {COUNT_SQL.format(t='h', p='p')} AS cnt FROM shown JOIN folded ON contains(h, p)")
def payload_search(spark, sf_dir):
    """All patterns in all payloads, without regard to case."""
    matcher, shown = payload_matcher(spark, sf_dir)
    return matcher.search(shown)


@query(f"WITH {SLICES_SQL}, folded AS (SELECT DISTINCT {FOLD.format('pattern')} AS p FROM slices), shown AS (SELECT page_id, {FOLD.format('html')} AS h FROM pages) SELECT page_id AS payload_id, count(p) AS n_patterns FROM shown LEFT JOIN folded ON contains(h, p) GROUP BY page_id")
def payload_pattern_count(spark, sf_dir):
    matcher, shown = payload_matcher(spark, sf_dir)
    found = matcher.search(shown).groupBy("payload_id").agg(F.count("*").alias("n"))
    return shown.select("payload_id").join(found, "payload_id", "left").select("payload_id", F.coalesce("n", F.lit(0)).alias("n_patterns"))


@query(f"WITH {SLICES_SQL}, folded AS (SELECT pattern_id, {FOLD.format('pattern')} AS pattern FROM slices), shown AS (SELECT page_id AS doc_id, {FOLD.format('html')} AS text FROM pages), {_links_sql('folded', True)} {FOUND_SQL.replace('documents d', 'shown d')}")
def payload_aggressive(spark, sf_dir):
    folded = slices(spark, sf_dir).withColumn("pattern", T.ascii_lower(F.col("pattern")))
    shown = table(spark, sf_dir, "pages").select(F.col("page_id").alias("text_id"), T.ascii_lower(F.col("html")).alias("text"))
    return search.exists(shown, folded, "aggressive")


# distinct substrings ------------------------------------------------------------------------------------------------

EVERY_SQL = "every AS (SELECT item_id, l, substr(text, i, l) AS s FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS l FROM benchmark), unnest(range(1, length(text) - l + 2)) AS u(i))"


@query(f"WITH {EVERY_SQL} SELECT item_id AS text_id, count(DISTINCT s) AS n_distinct FROM every GROUP BY item_id")
def distinct_total(spark, sf_dir):
    return distinct.distinct_total(items(spark, sf_dir).toDF("text_id", "text"))


@query(f"WITH {EVERY_SQL} SELECT item_id AS text_id, l::INT AS len, count(DISTINCT s) AS cnt FROM every GROUP BY item_id, l")
def distinct_by_length(spark, sf_dir):
    return distinct.distinct_by_length(items(spark, sf_dir).toDF("text_id", "text"))


@query()
def distinct_by_length_documents(spark, sf_dir):
    """The same over whole documents, too many for SQL; tests hold it against brute force."""
    return distinct.distinct_by_length(texts(spark, sf_dir))


@query()
def distinct_total_documents(spark, sf_dir):
    """The same over whole documents, which SQL is too slow for; tests hold it against brute force."""
    return distinct.distinct_total(texts(spark, sf_dir))


# extraction ---------------------------------------------------------------------------------------------------------

CHUNKS_SQL = "chunks AS (SELECT item_id AS doc_id, k AS chunk_no, substr(text, 1 + 100 * k, 100) AS chunk FROM benchmark, unnest(range(0, (length(text) + 99) // 100)) AS u(k))"
HITS_SQL = f"{CHUNKS_SQL}, hits AS (SELECT *, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, chunk)) AS hit, coalesce(lag(chunk) OVER w, '') AS l, coalesce(lead(chunk) OVER w, '') AS r FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no))"
RUNS_SQL = f"{HITS_SQL}, marked AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS miss FROM hits), runs AS (SELECT doc_id, min(chunk_no) AS first_chunk, count(*) AS n_chunks, string_agg(chunk, '' ORDER BY chunk_no) AS core, arg_min(l, chunk_no) AS l, arg_max(r, chunk_no) AS r FROM marked WHERE hit GROUP BY doc_id, miss)"
SPLIT_SQL = f"{RUNS_SQL}, whole AS (SELECT *, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, core)) AS found FROM runs), split AS (SELECT doc_id, first_chunk, core, l, r FROM whole WHERE found UNION ALL SELECT h.doc_id, h.chunk_no, h.chunk, h.l, h.r FROM whole w JOIN hits h ON h.doc_id = w.doc_id AND h.chunk_no >= w.first_chunk AND h.chunk_no < w.first_chunk + w.n_chunks WHERE NOT found)"


@query("SELECT doc_id, k::INT AS chunk_no, substr(text, 1 + 100 * k, 100) AS chunk FROM documents, unnest(range(0, (length(text) + 99) // 100)) AS u(k)")
def chunk100(spark, sf_dir):
    return extract.chunk_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _runs(spark, sf_dir):
    out = texts(spark, sf_dir)
    return stash(extract.stitch(extract.occurrences(extract.chunk_corpus(corpus(spark, sf_dir)), out, "chunk")), "runs"), out


@query(f'WITH {RUNS_SQL} SELECT doc_id, first_chunk::INT AS first_chunk, n_chunks::INT AS n_chunks, core, l AS "left", r AS "right" FROM runs')
def stitch_runs(spark, sf_dir):
    return _runs(spark, sf_dir)[0].drop("p")


GROWN_SQL = f"""{SPLIT_SQL}, grown AS (
    SELECT doc_id, first_chunk::INT AS first_chunk, core, l, r,
           coalesce((SELECT max(k) FROM unnest(range(1, length(l) + 1)) AS u(k) WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, right(l, k) || core))), 0)::INT AS left_len,
           coalesce((SELECT max(k) FROM unnest(range(1, length(r) + 1)) AS u(k) WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, core || left(r, k)))), 0)::INT AS right_len
    FROM split)"""


@query(f"WITH {GROWN_SQL} SELECT doc_id, first_chunk, core, left_len, right_len FROM grown")
def extend_max(spark, sf_dir):
    runs, out = _runs(spark, sf_dir)
    return extract.extend(stash(extract.split_failed(extract.occurrences(runs, out, "core")), "runs-split"), out).select("doc_id", "first_chunk", "core", "left_len", "right_len")


def _total_sql(t: str) -> str:
    return f"coalesce((SELECT sum({COUNT_SQL.format(t='d.text', p=t)}) FROM documents d WHERE contains(d.text, {t})), 0)::BIGINT"


@query(f"""WITH {GROWN_SQL}, sides AS (SELECT doc_id, first_chunk, right(l, left_len) || core || left(r, right_len) AS b, CASE WHEN left_len >= right_len THEN right(l, left_len) || core ELSE core || left(r, right_len) END AS s FROM grown),
    counted AS (SELECT *, {_total_sql('b')} AS bc, {_total_sql('s')} AS sc FROM sides),
    found AS (SELECT doc_id, first_chunk, CASE WHEN bc > 0 THEN b ELSE s END AS t, CASE WHEN bc > 0 THEN bc ELSE sc END AS cnt, length(b) - CASE WHEN bc > 0 THEN 0 ELSE 1 END AS hi FROM counted)
    SELECT doc_id, first_chunk, t, cnt, length(t)::INT AS maxlen_lo, hi::INT AS maxlen_hi FROM found WHERE hi >= 200""")
def extraction(spark, sf_dir):
    """The whole pipeline: chunks, runs, extension to both sides, bounds."""
    return extract.extract(corpus(spark, sf_dir), texts(spark, sf_dir))


@query(f"""WITH {RUNS_SQL.replace('100 * k, 100', '20 * k, 20').replace('+ 99) // 100', '+ 19) // 20')}
    SELECT doc_id, first_chunk::INT AS first_chunk, n_chunks::INT AS n_chunks, (SELECT sum({COUNT_SQL.format(t='d.text', p='core')}) FROM documents d WHERE contains(d.text, core))::BIGINT AS cnt
    FROM runs WHERE n_chunks >= 5 AND EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, core))""")
def long_extractions(spark, sf_dir):
    """Runs of five or more chunks that occur as a whole."""
    return extract.long_runs(corpus(spark, sf_dir), texts(spark, sf_dir), size=20)


# reports ------------------------------------------------------------------------------------------------------------


@query("SELECT length(substr(text, 1 + 100 * k, 100)) AS len, count(*) AS cnt FROM documents, unnest(range(0, (length(text) + 99) // 100)) AS u(k) GROUP BY 1")
def chunk_len_hist(spark, sf_dir):
    return report.length_frequencies(chunk100(spark, sf_dir), "chunk").withColumn("len", F.col("len").cast("long"))


@query("WITH e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT (CASE WHEN hi > lo THEN least(floor((n_chars - lo) * 25 / (hi - lo)) + 1, 25) ELSE 1 END)::INT AS bin, count(*) AS cnt FROM documents, e GROUP BY 1")
def length_histogram(spark, sf_dir):
    return report.histogram(table(spark, sf_dir, "documents"), "n_chars")


def _results(spark, sf_dir):
    """Conversations as results of iterations: the turn is the iteration."""
    return table(spark, sf_dir, "conversations").select(F.col("turn").alias("iter"), F.col("text").alias("t"), F.lit(1).alias("cnt"), F.length("text").alias("maxlen_lo"), F.length("text").alias("maxlen_hi"))


@query("SELECT text AS t, min(turn) AS iter FROM conversations GROUP BY text")
def first_seen(spark, sf_dir):
    return report.first_seen(_results(spark, sf_dir)).select("t", "iter")


@query("WITH f AS (SELECT min(turn) AS iter FROM conversations GROUP BY text), n AS (SELECT iter, count(*) AS new_texts FROM f GROUP BY iter) SELECT iter, new_texts, (sum(new_texts) OVER (ORDER BY iter))::BIGINT AS all_texts FROM n")
def cumulative_curve(spark, sf_dir):
    return report.cumulative_curve(_results(spark, sf_dir))


@query("WITH t AS (SELECT sum(n_chars) AS n FROM documents), f AS (SELECT min(turn) AS iter, text FROM conversations WHERE length(text) - length(translate(text, ' -.', '')) < length(text) GROUP BY text), s AS (SELECT iter, sum(length(text)) AS c FROM f GROUP BY iter) SELECT iter, c::BIGINT AS lo, (2 * c)::BIGINT AS hi, c * 100.0::DOUBLE / n AS percent_lo, 2 * c * 100.0::DOUBLE / n AS percent_hi, sum(c) OVER (ORDER BY iter) * 100.0::DOUBLE / n AS all_percent_lo, sum(2 * c) OVER (ORDER BY iter) * 100.0::DOUBLE / n AS all_percent_hi FROM s, t")
def extraction_percentages(spark, sf_dir):
    """Shares of the corpus by iteration and up to it; the upper bound of a length is here twice the lower one."""
    total = table(spark, sf_dir, "documents").agg(F.sum("n_chars")).first()[0] or 1
    return report.percentages(_results(spark, sf_dir).withColumn("maxlen_hi", 2 * F.col("maxlen_lo")), total)


@query("WITH t AS (SELECT sum(n_chars) AS n FROM documents), f AS (SELECT DISTINCT text FROM conversations WHERE length(text) - length(translate(text, ' -.', '')) < length(text)) SELECT count(*) AS n_texts, coalesce(sum(length(text)), 0)::BIGINT AS extracted, coalesce(sum(length(text)), 0)::BIGINT * 100.0::DOUBLE / max(n) AS percent FROM f, t")
def extraction_summary(spark, sf_dir):
    total = table(spark, sf_dir, "documents").agg(F.sum("n_chars")).first()[0] or 1
    return report.summary(_results(spark, sf_dir), total)


# functions and sources ----------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, regexp_replace(lower(text), '[^\p{L}]', '', 'g') AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query(rf"SELECT doc_id, {FOLD.format('text')} AS lowered, regexp_replace(text, '[^\x{{0}}-\x{{FF}}]', 'ÿ', 'g') AS latin, trim(text, e' \t\n\r\x0b\x0c') AS stripped, length(text) - length(translate(text, ' -.', '')) AS filler FROM documents")
def char_filters(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.ascii_lower(t).alias("lowered"), T.to_latin(t).alias("latin"), T.strip_line(t).alias("stripped"), T.filler_share(t).cast("long").alias("filler"))


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, k::INT AS chunk_no, array_to_string(w[10 * k + 1 : 10 * k + 10], ' ') AS chunk FROM w, unnest(range(0, (len(w) + 9) // 10)) AS u(k)")
def token_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.token_chunks(F.col("text"))).alias("chunk_no", "chunk"))


@query("SELECT doc_id, n_chars AS n, (1::BIGINT << (length(bin(n_chars)) - 1))::BIGINT AS floor2, bit_count(n_chars)::INT AS links, b::INT AS bit, ((n_chars >> (b + 1)) << (b + 1))::INT AS off, (1::BIGINT << b)::INT AS len FROM documents, unnest(range(0, 31)) AS u(b) WHERE (n_chars >> b) & 1 = 1")
def chain_decompose(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"), T.bit_floor(F.col("n_chars")).cast("long").alias("floor2"), T.popcount(F.col("n_chars")).cast("int").alias("links"), F.explode(T.chain(F.col("n_chars"))).alias("c"))
    return rows.select("doc_id", "n", "floor2", "links", (F.length(F.bin(F.col("c.len").cast("long"))) - 1).alias("bit"), "c.off", "c.len")


@query("SELECT item_id, substr(translate(text, '0123456789', ''), 5, 40) AS part, true AS equal FROM benchmark")
def rle_cut(spark, sf_dir):
    """Substrings of run-length strings without expanding them anywhere but here."""
    plain = F.translate("text", "0123456789", "")
    rows = table(spark, sf_dir, "benchmark").select("item_id", plain.alias("plain"), T.rle_decode(T.rle_runs(T.rle_encode(plain))).alias("back"))
    return rows.select("item_id", F.substring("back", 5, 40).alias("part"), (F.col("back") == F.col("plain")).alias("equal"))


@query("SELECT doc_id, lpad(doc_id::VARCHAR, 5, '0') AS padded FROM documents WHERE doc_id < 100000 UNION ALL SELECT doc_id, doc_id::VARCHAR FROM documents WHERE doc_id >= 100000")
def padded_names(spark, sf_dir):
    name = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", F.lpad(name, F.greatest(F.length(name), F.lit(5)), F.lit("0")).alias("padded"))


@query("SELECT doc_id AS text_id, doc_id AS pattern_id, substr(text, 1 + doc_id % 7, 30) AS pattern FROM documents")
def range_patterns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    left = 1 + F.col("text_id") % 7
    return readers.by_ranges(docs, docs.select("text_id", F.col("text_id").alias("pattern_id"), left.cast("int").alias("l"), (left + 29).cast("int").alias("r")))


@query("SELECT doc_id FROM documents WHERE contains(replace(text, e'\\n', chr(0)), chr(0))")
def rows_with_nul(spark, sf_dir):
    """Documents have no such character, so each line feed becomes one first."""
    return readers.rows_with_nul(table(spark, sf_dir, "documents").withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit("\0")))).select("doc_id")


@query("SELECT text FROM documents WHERE strlen(text) > 1")
def parquet_strings(spark, sf_dir):
    return readers.read_strings(spark, f"{sf_dir}/documents.parquet")


@query(r"SELECT conv_id, string_agg(regexp_replace(text, '[^\x{0}-\x{FF}]', 'ÿ', 'g'), e'\n' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def concat_outputs(spark, sf_dir):
    return readers.joined_outputs(table(spark, sf_dir, "conversations").withColumn("text_id", F.col("turn")), "conv_id")


@query("SELECT item_id AS text_id, k::INT AS k, pos::INT AS pos, substr(text, pos, k) AS phrase FROM benchmark, unnest([32, 64, 128, 256]) AS u(k), unnest(range(1, length(text) - k + 2, 4)) AS v(pos) WHERE length(text) >= k")
def sliding_phrases(spark, sf_dir):
    return generators.sliding_phrases(items(spark, sf_dir).toDF("text_id", "text"), [32, 64, 128, 256], 4)


@query(
    """WITH every AS (SELECT item_id, l AS k, i AS pos, substr(text, i, l) AS pattern FROM (SELECT item_id, text, unnest(range(1, length(text) + 1, 2)) AS l FROM benchmark), unnest(range(1, length(text) - l + 2)) AS u(i)),
    first AS (SELECT item_id, k, pattern, min(pos) AS pos FROM every GROUP BY item_id, k, pattern),
    used AS (SELECT *, sum(k) OVER (PARTITION BY item_id ORDER BY k, pos) AS used FROM first)
    SELECT item_id AS text_id, k::INT AS k, pattern FROM used WHERE used <= 3000"""
)
def budgeted_queries(spark, sf_dir):
    return generators.budgeted_queries(items(spark, sf_dir).toDF("text_id", "text"), 3000)
