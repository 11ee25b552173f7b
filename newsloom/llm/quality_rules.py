"""Quality rules: fixed base rules, then robust multivariate outliers by the minimum covariance determinant (MCD).

Native: DataFrame functions only.

Every document becomes a vector of transformed statistics. For every language and source the MCD is approached by
concentration steps from deterministic starts: the share `h` of documents with the smallest Mahalanobis distances gives
the next mean and covariance, until no determinant falls any more; the start with the smallest determinant wins. Its
covariance is made consistent for normal data by the usual factor, documents beyond the 0.975 quantile of chi-square
get weight zero, and those left give the final mean and covariance, made consistent again. Documents whose squared
distance to these is over the `quantile` of chi-square are rejected. The smallest distances are found in steps of a
fixed logarithmic grid, so what crosses the network are counts and sums per group, never its rows; a group can hold any
share of all rows. Estimates are sent to the tasks if there are at most `MOST_GROUPS`, else joined by shuffles.

Edge cases: null texts have no words and fail the base rule; groups with fewer than `min_group` documents that pass the
base rules are judged by an estimate of all documents of their language, and if those are too few, of all documents, so
every document that passes the base rules has a distance; null languages and sources are groups of their own; repeated rows each
count and get the same verdict; `floors` are the least standard deviations, so statistics that are constant in most
documents don't make the estimate singular; an empty table gives an empty result; other columns are ignored.

Building the result runs jobs: the statistics, the groups and each step's estimates are written in the shared folder.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import SPACES, materialized, words

SYMBOLS = "#*$%&|<>"


def let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with the value computed once a row and not once for every element of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(tokens: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text; the first occurrence counts."""
    windows = F.when(
        F.size(tokens) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(tokens) - 3),
            lambda i: F.struct(F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)).alias("h"), i.alias("i")),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    return let(F.sort_array(windows), covered_words)


def covered_words(windows: Column) -> Column:
    """windows: sorted by hash. Starts whose hash stands beside an equal one, then the length of their union."""

    def repeated(x: Column, k: Column) -> Column:
        return (x["h"] == F.get(windows, k - 1)["h"]) | (x["h"] == F.get(windows, k + 1)["h"])

    starts = F.sort_array(F.transform(F.filter(windows, repeated), lambda x: x["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def statistics(docs: DataFrame, text: str = "text", fraction: float = 0.5, min_words: int = 50) -> DataFrame:
    """docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumn("_words", words(F.col(text)))
    return (
        out.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(body, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", let(F.col("_words"), repeated_words))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") > fraction * F.col("n_words")))
        .drop("_words")
    )


#: Transformed statistics, and the least standard deviation that is told apart in each.
VECTOR = {
    "word_length": (lambda: F.log(F.col("word_chars") / F.col("n_words")), 0.05),
    "symbols": (lambda: F.sqrt(F.col("n_symbols") / F.col("n_words")), 0.05),
    "dup_lines": (lambda: F.sqrt(F.col("n_dup_lines") / F.col("n_words")), 0.05),
    "repeats": (lambda: F.sqrt(F.col("n_repeat_words") / F.col("n_words")), 0.10),
}
GRID = 64  # steps per doubling of a squared distance
REWEIGHT = 0.975  # the quantile within which documents have weight one in the final estimate
MOST_GROUPS = 100_000  # estimates of at most so many groups, of under 200 bytes each, are sent to the tasks


def chi2_cdf(x: float, d: int) -> float:
    """The chi-square distribution function of d degrees of freedom, by the series of the incomplete gamma function."""
    a, y = d / 2, x / 2
    if y <= 0:
        return 0.0
    term = total = 1 / a
    for n in range(1, 1000):
        term *= y / (a + n)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(a * math.log(y) - y - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, d) < p else (low, middle)
    return (low + high) / 2


def consistency(h: float, d: int) -> float:
    """What the covariance of the share h nearest to the mean of normal data is to be multiplied by."""
    return 1.0 if h >= 1 else h / chi2_cdf(chi2_quantile(h, d), d + 2)


def _cholesky(cov: dict[tuple[int, int], Column], d: int) -> dict[tuple[int, int], Column]:
    low: dict[tuple[int, int], Column] = {}
    for i in range(d):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - low[i, k] * low[j, k], range(j), cov[i, j])
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / low[j, j]
    return low


def _distance(x: list[Column], mean: list[Column], low: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i in range(len(x)):
        z.append(reduce(lambda a, k: a - low[i, k] * z[k], range(i), x[i] - mean[i]) / low[i, i])
    return reduce(lambda a, b: a + b, [v * v for v in z])


def _estimate(rows: DataFrame, keys: list[str], d: int, floors: list[float]) -> DataFrame:
    """keys, m0.., l00.. (Cholesky factor) and log_det of the rows of each key."""
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(d) for j in range(i + 1)]
    agg = rows.groupBy(*keys).agg(*sums)
    mean = [F.col(f"s{i}") / F.col("n") for i in range(d)]
    cov = {(i, j): F.col(f"s{i}_{j}") / F.col("n") - mean[i] * mean[j] for i in range(d) for j in range(i + 1)}
    for i in range(d):
        cov[i, i] = F.greatest(cov[i, i], F.lit(0.0)) + floors[i] ** 2
    out = agg.select(*keys, *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[c.alias(f"c{i}_{j}") for (i, j), c in cov.items()])
    for i in range(d):  # one column at a time keeps the expressions small
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}"), range(j), F.col(f"c{i}_{j}"))
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}"))
    log_det = reduce(lambda a, b: a + b, [2 * F.log(F.col(f"l{i}_{i}")) for i in range(d)])
    return out.select(*keys, *[f"m{i}" for i in range(d)], *[f"l{i}_{j}" for i in range(d) for j in range(i + 1)], log_det.alias("log_det"))


def _met(rows: DataFrame, est: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """rows with their group's row of est. few: est is small enough to be sent to all tasks, so rows stay where they are."""
    return rows.join(F.broadcast(est) if few else est, keys)


def _with_distance(rows: DataFrame, est: DataFrame, keys: list[str], d: int, few: bool) -> DataFrame:
    low = {(i, j): F.col(f"l{i}_{j}") for i in range(d) for j in range(i + 1)}
    d2 = _distance([F.col(f"x{i}") for i in range(d)], [F.col(f"m{i}") for i in range(d)], low)
    return _met(rows, est, keys, few).withColumn("d2", d2)


def _concentrate(rows: DataFrame, est: DataFrame, keys: list[str], d: int, floors: list[float], h: float, few: bool) -> DataFrame:
    """One concentration step: the estimate from the share h with the smallest distances."""
    near = _with_distance(rows, est, keys, d, few)
    near = near.withColumn("bin", F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-9))) * GRID).cast("int"))
    counts = near.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    # At most 60 * GRID bins for a key, whatever its number of rows.
    bins = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
    found = F.aggregate(
        "bins",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("bin")),
        lambda a, b: F.struct(
            (a["n"] + b["n"]).alias("n"), F.when(a["n"] < F.col("total") * h, b["bin"]).otherwise(a["bin"]).alias("bin")
        ),
        lambda a: a["bin"],
    )
    limits = bins.select(*keys, found.alias("limit"))
    return _estimate(_met(near, limits, keys, few).where(F.col("bin") <= F.col("limit")), keys, d, floors)


def mcd_distances(
    rows: DataFrame, group: list[str], columns: list[str], floors: list[float], h: float = 0.75, steps: int = 12
) -> DataFrame:
    """rows with d2, the squared robust distance within the row's group. Groups must not be null; columns are finite.

    steps: the most concentration steps; fewer are done if no determinant changes any more.
    """
    d = len(columns)
    named = rows.withColumns({f"x{i}": F.col(c) for i, c in enumerate(columns)})
    slim = named.select(*group, *[f"x{i}" for i in range(d)])
    # Starts: all rows; the rows near the mean in units of the floors alone, which far rows don't widen.
    moments = materialized(_estimate(slim, group, d, floors).select(*group, *[f"m{i}" for i in range(d)]))
    few = moments.count() <= MOST_GROUPS
    flat = reduce(lambda a, b: a + b, [((F.col(f"x{i}") - F.col(f"m{i}")) / floors[i]) ** 2 for i in range(d)])
    central = _met(slim, moments, group, few).withColumn("flat", flat)
    bound = central.groupBy(*group).agg(F.avg(F.sqrt("flat")).alias("bound"))
    central = _met(central, bound, group, few).where(F.sqrt("flat") <= F.col("bound"))
    starts = slim.withColumn("start", F.lit(0)).unionByName(central.select(*slim.columns).withColumn("start", F.lit(1)))
    keys = [*group, "start"]
    est = materialized(_estimate(starts, keys, d, floors))
    both = slim.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(steps):
        before, est = est, materialized(_concentrate(both, est, keys, d, floors, h, few))
        fall = _met(est, before.select(*keys, F.col("log_det").alias("was")), keys, few).agg(F.max(F.abs(F.col("was") - F.col("log_det")))).first()[0]
        if fall is None or fall < 1e-9:
            break
    best = est.groupBy(*group).agg(F.min_by(F.struct(*[c for c in est.columns if c not in group]), F.struct("log_det", "start")).alias("e"))
    best = best.select(*group, "e.*").drop("start", "log_det")
    near = _with_distance(slim, best, group, d, few).where(F.col("d2") <= consistency(h, d) * chi2_quantile(REWEIGHT, d))
    final = materialized(_estimate(near.select(*slim.columns), group, d, floors).drop("log_det"))
    out = _with_distance(named, final, group, d, few).withColumn("d2", F.col("d2") / consistency(REWEIGHT, d))
    return out.drop(*[c for c in final.columns if c not in group], *[f"x{i}" for i in range(d)])


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    group: tuple[str, ...] = ("lang", "source"),
    quantile: float = 0.9999,
    min_group: int = 50,
    h: float = 0.75,
    steps: int = 12,
) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance (null: base_failed) and kept.

    quantile: of chi-square, beyond which a squared distance is rejected.
    """
    base = statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"g{i}") for i, g in enumerate(group)]))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    keys = [f"g{i}" for i in range(len(group))]
    base = materialized(base.select("doc_id", *keys, *stats))
    vectors = base.where(~F.col("base_failed")).withColumns({k: f() for k, (f, _) in VECTOR.items()})
    # The level of a group: by how many of its keys the smallest large enough group is made that holds it.
    groups = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{len(keys)}"))
    level = F.lit(0)
    for k in range(1, len(keys) + 1):
        if k < len(keys):
            groups = groups.join(groups.groupBy(*keys[:k]).agg(F.sum(f"n{len(keys)}").alias(f"n{k}")), keys[:k])
        level = F.when(F.col(f"n{k}") >= min_group, F.lit(k)).otherwise(level)
    groups = materialized(groups.select(*keys, level.alias("level")))
    # Each level's estimate is of all documents of a group that judges some, and tells the distances of those alone.
    own = [f"e{i}" for i in range(len(keys))]
    few = groups.count() <= MOST_GROUPS
    levels = sorted(r["level"] for r in groups.select("level").distinct().collect())
    vectors = _met(vectors, groups, keys, few)
    parts = []
    for k in levels:
        wanted = groups.where(F.col("level") == k).select(*keys[:k]).distinct()
        rows = (_met(vectors, wanted, keys[:k], few) if k else vectors).withColumn("at", F.lit(k))
        parts.append(rows.withColumns({own[i]: F.col(keys[i]) if i < k else F.lit("") for i in range(len(keys))}))
    if parts:
        rows = reduce(DataFrame.unionByName, parts)
        scored = mcd_distances(rows, ["at", *own], list(VECTOR), [f for _, f in VECTOR.values()], h, steps).where(F.col("at") == F.col("level"))
    else:
        scored = vectors.withColumn("d2", F.lit(0.0))
    failed = base.where("base_failed").select("doc_id", *stats, F.lit(None).cast("double").alias("distance"))
    out = scored.select("doc_id", *stats, F.col("d2").alias("distance")).unionByName(failed)
    return out.select("doc_id", *stats, "distance", (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi2_quantile(quantile, len(VECTOR)))).alias("kept"))
