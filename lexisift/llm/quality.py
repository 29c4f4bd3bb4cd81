"""Quality rules: fixed rules first, then robust multivariate outliers for each language and source.

Every document that passes the fixed rules gives a vector of five transformed statistics. For each language and source, each
language and all documents the minimum-covariance-determinant estimate is found by concentration steps: from several
robust starts (medians with quartiles, the shortest half and the shortest quarter of every statistic) the mean and covariance
of the closest half are taken again and again until the determinant falls no more; the start with the least determinant
counts, and what lies within its 0.975 quantile gives the final mean and covariance. Up to almost half of a group may be
outliers. An estimate is mixed with that of its pool, the language's and then all documents', the more the smaller the group
is, so groups of every size are judged alike. A document whose squared Mahalanobis distance exceeds CUTOFF goes.

Every document counts, with exact integer sums: documents whose statistics fall into one small cell are summed up, before
and after the shuffle, and the steps run over cells. Of a cell at the end of the half a fraction counts. A group's cells come
together in one task; a group with more than MAX_CELLS of them has cells of twice the width, so that task is bounded however
many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexisift.llm.common import discard, map_texts, stash, text_of, whole_groups
from lexisift.llm.substring import Rolling

#: Fixed rules.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
#: Quantile 0.975 of chi-square with five degrees of freedom; what makes covariances of the closest half, and of what lies within
#: that quantile, those of the whole under normality.
WITHIN, HALF_FACTOR, WITHIN_FACTOR = 12.832, 1.912, 1.0553
#: Smallest standard deviation of a statistic; squared distance beyond which a document goes (the 1 - 1.5e-7 quantile of
#: chi-square with five degrees of freedom); members at which half of a group's mean is its own, the rest that of its pool.
FLOOR, CUTOFF, SHRINK = 0.04, 40.0, 50
#: Integer steps of a statistic's unit; width of a cell in these; cells of a group at most; fall of the logarithm of a
#: determinant below which a start has converged; estimates that are broadcast at most.
UNIT, CELL, MAX_CELLS, FALL, BROADCAST_GROUPS = 4096, 128, 200_000, 1e-6, 100_000
SYMBOLS, N_STATS = b"#*$%&|<>", 5
STATS = [f"q{i}" for i in range(N_STATS)]
PAIRS = [(i, j) for i in range(N_STATS) for j in range(i, N_STATS)]
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS)
SPACE = b"\t\n\x0b\x0c\r "


def measures(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the five statistics in integer steps."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(text) - int(count[list(SPACE)].sum())
    symbols = int(count[list(SYMBOLS)].sum())
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    repeated = 0
    if n > REPEAT_WINDOW:
        begin = np.arange(n - REPEAT_WINDOW + 1)
        windows = Rolling(hashes).of(0, begin, begin + REPEAT_WINDOW)
        order = np.argsort(windows)
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.concatenate([order[1:][same], order[:-1][same]])
        if len(twice):
            edge = np.zeros(n + 1, np.int64)
            twice = np.unique(twice)
            edge[twice] += 1
            edge[twice + REPEAT_WINDOW] -= 1
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())

    def share(k: float, of: int) -> float:
        return float(np.arcsin(np.sqrt(min(1.0, k / max(of, 1)))))

    stats = (
        np.log(chars / max(n, 1) + 0.1),
        share(symbols, chars),
        share(count[65:91].sum(), chars),
        share(count[list(PUNCTUATION)].sum(), chars),
        share((hashes[1:] == hashes[:-1]).sum(), n),
    )
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, *(int(np.clip(round(float(s) * UNIT), -65_536, 65_536)) for s in stats)


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, whole: bool) -> DataFrame:
    """Every row as a struct (if whole is asked for), doc_id, own_group, the contract's counts, base_failed and the statistics."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *STATS]
    key = F.to_json(F.struct(F.col(lang_col).cast("string").alias("l"), F.col(source_col).cast("string").alias("s")))
    # all that a row keeps travels in one column, and its text only there
    inside = whole and dict(docs.dtypes).get(text_col) == "string"
    k = F.struct((F.struct("*") if whole else F.lit(0)).alias("row"), F.col(id_col).alias("doc_id"), key.alias("own_group")).alias("k")
    plain = docs.select(k) if inside else docs.select(k, text_of(text_col).alias("text"))
    at = docs.columns.index(text_col) if inside else 0

    def step(keys: pa.Array, texts: list[str]) -> dict:
        return {"k": keys} | dict(zip(names, np.array([measures(x) for x in texts], np.int64).T, strict=True))

    schema = StructType([plain.schema["k"], *(StructField(n, LongType()) for n in names)])
    out = map_texts(plain, step, schema, ["k", *names], text=(lambda keys: pc.fill_null(keys.field("row").field(at), "")) if inside else None)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select("k.row", "k.doc_id", "k.own_group", *names).withColumn("base_failed", failed)


def _distance() -> Column:
    """The squared Mahalanobis distance from the estimate's columns m0.. and v00.. ."""
    gap = [F.col(q) / UNIT - F.col(f"m{i}") for i, q in enumerate(STATS)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1 if i == j else 2) * F.col(f"v{i}{j}") * gap[i] * gap[j]
    return F.greatest(total, F.lit(0.0))


#: gid tells an estimate, n counts its documents; means, covariances, and the covariances' inverse.
ESTIMATE = ", ".join(["gid bigint", "n bigint", *(f"m{i} double" for i in range(N_STATS)), *(f"{x}{i}{j} double" for x in "cv" for i, j in PAIRS)])
ESTIMATE_NAMES = [x.split()[0] for x in ESTIMATE.split(", ")]
#: Of a cell: documents, sums of statistics and of their products.
SUM_NAMES, PLACES = ["k", *(f"s{i}" for i in range(N_STATS)), *(f"s{i}{j}" for i, j in PAIRS)], [f"p{i}" for i in range(N_STATS)]


def _batch(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    flat = [[gid, n, *mean.tolist(), *(float(x[i, j]) for x in (cov, np.linalg.inv(cov)) for i, j in PAIRS)] for gid, n, mean, cov in rows]
    kinds = [pa.int64() if k.endswith("bigint") else pa.float64() for k in ESTIMATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*flat, strict=True), kinds, strict=True)], names=ESTIMATE_NAMES)


def shortest(values: np.ndarray, number: np.ndarray, share: float) -> tuple[float, float]:
    """Middle and width of the shortest interval that holds this share; values ascend."""
    upto = np.cumsum(number)
    need = np.ceil(share * upto[-1])
    last = np.searchsorted(upto, upto - number + need)
    first = np.flatnonzero(last < len(values))
    k = first[np.argmin(values[last[first]] - values[first])]
    return (values[last[k]] + values[k]) / 2, values[last[k]] - values[k]


def starts(x: np.ndarray, number: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Three starts from the statistics one by one, of points x that stand for so many documents each."""
    middle, width = np.zeros((3, N_STATS)), np.zeros((3, N_STATS))
    for k in range(N_STATS):
        order = np.argsort(x[:, k], kind="stable")
        values, own = x[order, k], number[order]
        low, middle[0, k], high = values[np.searchsorted(np.cumsum(own), np.array([0.25, 0.5, 0.75]) * own.sum())]
        width[0, k] = (high - low) / 1.349  # in standard deviations of the normal distribution
        for s, (share, deviations) in enumerate(((0.5, 1.349), (0.25, 0.6373)), 1):
            middle[s, k], w = shortest(values, own, share)
            width[s, k] = w / deviations
    return [(m, np.diag(np.maximum(w, FLOOR) ** 2)) for m, w in zip(middle, width, strict=True)]


def moments(sums: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from a number, sums and sums of products, the covariance no narrower than FLOOR."""
    mean = sums[1 : 1 + N_STATS] / sums[0]
    cov = np.zeros((N_STATS, N_STATS))
    for k, (i, j) in enumerate(PAIRS):
        cov[i, j] = cov[j, i] = sums[1 + N_STATS + k] / sums[0] - mean[i] * mean[j]
    return mean, factor * cov + FLOOR**2 * np.eye(N_STATS)


def determinant_estimate(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a group, given as one row of sums a cell, in units of the statistics."""
    number = sums[:, 0]
    x = sums[:, 1 : 1 + N_STATS] / number[:, None]
    n = int(number.sum())
    half = min((n + N_STATS + 1) // 2, n)

    def distance(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    best = (np.inf, None)
    for now in starts(x, number):
        was = np.inf
        while True:
            order = np.argsort(distance(*now), kind="stable")
            before = np.cumsum(number[order]) - number[order]
            part = np.clip((half - before) / number[order], 0, 1)  # all of the closest cells, of the last a fraction
            now = moments(part @ sums[order], HALF_FACTOR)
            if (det := np.linalg.slogdet(now[1])[1]) >= was - FALL:
                break
            was = det
        if det < best[0]:
            best = (det, now)
    return moments(sums[distance(*best[1]) <= WITHIN].sum(axis=0), WITHIN_FACTOR)


def _combined(cells: DataFrame) -> DataFrame:
    return cells.groupBy("gid", *PLACES).agg(*[F.sum(c).alias(c) for c in SUM_NAMES])


def estimate(rows: DataFrame) -> DataFrame:
    """The estimate of each of a row's gids (an array), from rows of gids and statistics."""
    products = [F.lit(1).cast("long"), *map(F.col, STATS), *(F.col(STATS[i]) * F.col(STATS[j]) for i, j in PAIRS)]
    single = rows.select("gids", *[F.floor(F.col(q) / CELL).alias(p) for q, p in zip(STATS, PLACES, strict=True)], *[c.alias(n) for c, n in zip(products, SUM_NAMES, strict=True)])
    own = single.groupBy("gids", *PLACES).agg(*[F.sum(c).alias(c) for c in SUM_NAMES])
    cells = stash(_combined(own.select(F.explode("gids").alias("gid"), *PLACES, *SUM_NAMES)), "quality-cells", few=True)
    while True:
        wide = cells.groupBy("gid").agg(F.count("*").alias("cells")).filter(F.col("cells") > MAX_CELLS).select("gid")
        if wide.isEmpty():
            break
        wide = stash(wide, "quality-wide", few=True)
        doubled = cells.join(wide, "gid", "left_semi").withColumns({p: F.floor(F.col(p) / 2) for p in PLACES})
        old, cells = cells, stash(cells.join(wide, "gid", "left_anti").unionByName(_combined(doubled)), "quality-cells", few=True)
        discard(old, wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.array([1.0] + [1 / UNIT] * N_STATS + [1 / UNIT**2] * len(PAIRS))
        for table, begins in whole_groups(batches, ["gid"]):
            gid = table["gid"].to_numpy()
            sums = np.stack([table[c].to_numpy() for c in SUM_NAMES], axis=1) * scale
            yield _batch([(int(gid[a]), int(sums[a:b, 0].sum()), *determinant_estimate(sums[a:b])) for a, b in zip(begins[:-1], begins[1:], strict=True)])

    found = stash(cells.repartition("gid").sortWithinPartitions("gid", *PLACES).mapInArrow(run, ESTIMATE), "quality-estimates", few=True)
    discard(cells)
    return found


def _mixed(own: tuple[np.ndarray, np.ndarray], pool: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a group of n shrunk towards its pool. The own covariance, and what the gap between the means adds,
    have the square of the mean's weight, since a few outliers widen those of a small group."""
    w = n / (n + SHRINK)
    gap = own[0] - pool[0]
    return w * own[0] + (1 - w) * pool[0], w * w * own[1] + (1 - w * w) * pool[1] + w * w * (1 - w) * np.outer(gap, gap)


def _shrunk(row: dict) -> tuple[int, int, np.ndarray, np.ndarray]:
    def of(x: dict) -> tuple[np.ndarray, np.ndarray]:
        cov = np.zeros((N_STATS, N_STATS))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = x[f"c{i}{j}"]
        return np.array([x[f"m{i}"] for i in range(N_STATS)]), cov

    pool = _mixed(of(row["language"]), of(row["whole"]), row["language"]["n"])
    return row["own"]["gid"], row["own"]["n"], *_mixed(of(row["own"]), pool, row["own"]["n"])


def _levels() -> list[Column]:
    """The gids of a row: of language and source, of the language, of all."""
    language = F.to_json(F.struct(F.get_json_object("own_group", "$.l").alias("l")))
    return [F.xxhash64(F.lit("own"), F.col("own_group")), F.xxhash64(F.lit("language"), language), F.xxhash64(F.lit("all"))]


def group_estimates(passed: DataFrame) -> DataFrame:
    """The estimate of each own_group of passed (gid is the first of its levels), whatever its size, shrunk towards that of its
    language, and this towards that of all."""
    found = estimate(passed.select(F.array(*_levels()).alias("gids"), *STATS))
    own, language, whole = _levels()
    rows = passed.select("own_group").distinct().select(own.alias("o"), language.alias("l"), whole.alias("w"))
    for key, name in (("o", "own"), ("l", "language"), ("w", "whole")):
        rows = rows.join(found.select(F.col("gid").alias(key), F.struct(*ESTIMATE_NAMES).alias(name)), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if mixed := [_shrunk(r) for r in batch.to_pylist()]:
                yield _batch(mixed)

    out = stash(rows.select("own", "language", "whole").mapInArrow(run, ESTIMATE), "quality-shrunk", few=True)
    discard(found)
    return out


def _verdicts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, whole: bool) -> DataFrame:
    """measured() with distance and kept."""
    rows = stash(measured(docs, id_col, text_col, lang_col, source_col, whole), "quality-measures")
    found = group_estimates(rows.filter("NOT base_failed").select("own_group", *STATS)).select("gid", *[c for c in ESTIMATE_NAMES if c[0] in "mv"])
    if found.count() <= BROADCAST_GROUPS:  # 21 numbers each; many more are joined in a shuffle, whose hot groups AQE splits
        found = F.broadcast(found)
    out = rows.withColumn("gid", _levels()[0]).join(found, "gid", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Null and empty texts have no words and fail. Null languages and sources are values of their own. Repeated rows and
    rows that share an id each count and are judged by their own text. Whole texts are read; other columns are not.
    An empty table gives an empty one. distance is null where base_failed.
    """
    out = _verdicts(docs, id_col, text_col, lang_col, source_col, False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns, which may bear any name. Each row is judged by its own text, so
    rows that share an id or have none can stay or go. Other cases as in judged()."""
    return _verdicts(docs, id_col, text_col, lang_col, source_col, True).filter("kept").select("row.*")
