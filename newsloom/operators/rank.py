"""Ranking of a feed: freshness, orders, top-k, and the greedy re-rankers of a single request.

Orders that windows can express are windows. The greedy re-rankers and the orders whose comparison isn't transitive look
at one request's list, which is bounded by its limit, in a grouped pandas function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import text

# Freshness bounds in minutes, jump rules and boosts.
BUCKET_MINUTES = [30, 90, 180, 360]
JUMP_BOOST, JUMP_LEAD = 20, 18
SLICE_HOURS = [(3, "fresh"), (6, "fallback"), (72, "backfill")]


def age_minutes(now: Column, published_at: Column) -> Column:
    """Null without a date; a date ahead is age 0."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(published_at.cast("timestamp"))
    return F.greatest(micros / 6e7, F.when(published_at.isNotNull(), F.lit(0.0)))


def freshness_bucket(now: Column, published_at: Column) -> Column:
    """0 to 4 by age, 99 without a date."""
    age, out = age_minutes(now, published_at), F.when(published_at.isNull(), 99)
    for k, bound in enumerate(BUCKET_MINUTES):
        out = out.when(age <= bound, k)
    return out.otherwise(len(BUCKET_MINUTES))


def freshness_slice(now: Column, published_at: Column) -> Column:
    """fresh, fallback or backfill by age; null for older and undated rows."""
    age, out = age_minutes(now, published_at), F
    for hours, name in SLICE_HOURS:
        out = out.when(age <= 60 * hours, name)
    return out.otherwise(F.lit(None).cast("string"))


def within_hours(rows: DataFrame, now: Column, hours: float, column: str = "published_at", missing: bool = False) -> DataFrame:
    """Rows at most so old; rows without a date as `missing` says."""
    return rows.where(F.coalesce(age_minutes(now, F.col(column)) <= hours * 60, F.lit(missing)))


def core_boost(favorites: bool = True) -> Column:
    """Of the columns priority, favorite_match, favorite_context, favorite_context_score, is_local, has_swedish_player, editorial_tier and is_top_league."""
    p = F.coalesce("priority", F.lit(0))
    boost = F.when(p >= 90, 24).when(p >= 80, 18).when(p >= 50, 10).otherwise(0)
    if favorites:
        context = F.greatest(F.coalesce("favorite_context_score", F.lit(6)), F.lit(0))
        boost = boost + F.when(F.col("favorite_match"), 16).when(F.col("favorite_context"), context).otherwise(0)
    tier = F.col("editorial_tier")
    boost = boost + F.when(F.col("is_local"), 14).otherwise(0) + F.when(F.col("has_swedish_player"), 12).otherwise(0)
    return boost + F.when(tier == 1, 12).when(tier == 2, 6).when(tier.isNull() & F.col("is_top_league"), 8).otherwise(0)


def ordered(rows: DataFrame, keys: Sequence[str], *by: Column) -> DataFrame:
    """rows with position, from 1 within each key."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def top_k(rows: DataFrame, keys: Sequence[str], k: int, *by: Column) -> DataFrame:
    """The first k rows of each key. Spark limits each task to k rows before the shuffle."""
    return ordered(rows, keys, *by).where(F.col("position") <= k)


def score_order() -> list[Column]:
    return [F.col("score").desc(), F.coalesce(F.col("published_at").cast("timestamp"), F.lit(0).cast("timestamp")).desc(), F.col("ordinal")]


def score_floor(rows: DataFrame, floors: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose score reaches their sport's floor; hard news has the second one."""
    keep = F.lit(False)
    for sport, (plain, hard) in floors.items():
        keep = keep | ((F.col("sport") == sport) & (F.col("score") >= F.when(F.col("hard_news"), hard).otherwise(plain)))
    return rows.where(keep)


def reranked(rows: DataFrame, request: Sequence[str], arrange: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """rows with a new position: arrange gives a request's rows, sorted by position, in their new order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position", kind="stable").reset_index(drop=True)
        out = group.iloc[arrange(group)].copy()
        out["position"] = range(1, len(out) + 1)
        return out

    return rows.groupBy(*request).applyInPandas(run, rows.schema)


def pick_in_turn(n: int, choose: Callable[[list[int], list[int]], int]) -> list[int]:
    """Takes from a queue of n again and again; choose(queue, taken) is the place to take."""
    queue, taken = list(range(n)), []
    while queue:
        taken.append(queue.pop(choose(queue, taken)))
    return taken


def balance_sources(rows: DataFrame, request: Sequence[str], protect: int = 2, gap: int = 1, lookahead: int = 10, drop: float = 8.0, first: int = 30) -> DataFrame:
    """A source that was just shown waits for another one near behind that scores little less. gap 0 looks at the last five."""

    def arrange(group: pd.DataFrame) -> list[int]:
        source = [str(s or "").strip().lower() for s in group["source"]]
        score = group["score"].tolist()

        def choose(queue: list[int], taken: list[int]) -> int:
            named = [source[t] for t in taken if source[t]]
            recent = set(named[-gap:] if gap else named[-5:])
            if len(taken) < protect or source[queue[0]] not in recent:
                return 0
            for k, x in enumerate(queue[1 : lookahead + 1], 1):
                if source[x] not in recent and score[queue[0]] - score[x] <= drop:
                    return k
            return 0

        n = min(first, len(group))
        return [*pick_in_turn(n, choose), *range(n, len(group))]

    return reranked(rows, request, arrange)


def balance_favorites(rows: DataFrame, request: Sequence[str], streak: int = 2, lookahead: int = 8) -> DataFrame:
    """After a streak of favourites the nearest other row comes next."""

    def arrange(group: pd.DataFrame) -> list[int]:
        favorite = group["favorite_match"].fillna(False).tolist()

        def choose(queue: list[int], taken: list[int]) -> int:
            if favorite[queue[0]] and len(taken) >= streak and all(favorite[t] for t in taken[-streak:]):
                return next((k for k, x in enumerate(queue[1 : lookahead + 1], 1) if not favorite[x]), 0)
            return 0

        return pick_in_turn(len(group), choose)

    return reranked(rows, request, arrange)


def interleave_sources(rows: DataFrame, request: Sequence[str], first: int = 16, lookahead: int = 6, block: int = 2) -> DataFrame:
    """Of the next few rows, the best ranked whose source isn't among the last ones; lists of up to `first` stay."""

    def arrange(group: pd.DataFrame) -> list[int]:
        if len(group) <= first:
            return list(range(len(group)))
        source, rank = [str(s or "").strip().lower() for s in group["source"]], group["score"].fillna(0).tolist()

        def choose(queue: list[int], taken: list[int]) -> int:
            recent = [source[t] for t in taken if source[t]][-block:]
            free = [k for k, x in enumerate(queue[:lookahead]) if source[x] not in recent]
            return max(free, key=lambda k: (rank[queue[k]], -k), default=0)

        return [*pick_in_turn(first, choose), *range(first, len(group))]

    return reranked(rows, request, arrange)


def by_comparison(rows: DataFrame, request: Sequence[str], compare: Callable[[dict, dict], float]) -> DataFrame:
    """Sorted by a comparison that need not be transitive, from the order of position."""

    def arrange(group: pd.DataFrame) -> list[int]:
        records = group.to_dict("records")
        sign = lambda a, b: (lambda d: (d > 0) - (d < 0))(compare(records[a], records[b]))
        return sorted(range(len(group)), key=cmp_to_key(sign))

    return reranked(rows, request, arrange)


def hybrid_order(rows: DataFrame, request: Sequence[str], now: Column, favorites: bool = True) -> DataFrame:
    """By freshness bucket, but a strong older row may pass rows of the next fresher bucket; then by score with boost."""
    ready = rows.withColumns({"bucket": freshness_bucket(now, F.col("published_at")), "boost": core_boost(favorites).cast("double")})
    ready = ready.withColumns({"hybrid": F.coalesce("score", F.lit(0.0)) + F.col("boost"), "ms": F.coalesce(F.unix_millis(F.col("published_at").cast("timestamp")), F.lit(0))})

    def jumps(older: dict, fresher: dict) -> bool:
        return older["boost"] >= JUMP_BOOST and older["hybrid"] - fresher["hybrid"] >= JUMP_LEAD

    def compare(a: dict, b: dict) -> float:
        apart = a["bucket"] - b["bucket"]
        if apart == 1 and jumps(a, b):
            return -1
        if apart == -1 and jumps(b, a):
            return 1
        return apart or b["hybrid"] - a["hybrid"] or b["ms"] - a["ms"] or (b["score"] or 0) - (a["score"] or 0)

    return by_comparison(ready, request, compare).drop("hybrid", "ms")


def feed_order(rows: DataFrame, request: Sequence[str], favorites: bool, region: bool, window: float = 16.0) -> DataFrame:
    """Local, favourite and score order, in which near scores yield to Swedish players, priority and top leagues."""
    ready = rows.withColumn("ms", F.coalesce(F.unix_millis(F.col("published_at").cast("timestamp")), F.lit(0)))
    flags = lambda a, b, c: bool(b[c]) - bool(a[c])

    def near(a: dict, b: dict) -> float:
        return flags(a, b, "has_swedish_player") or (b["priority"] or 0) - (a["priority"] or 0) or flags(a, b, "is_top_league")

    def compare(a: dict, b: dict) -> float:
        personal = (
            favorites
            and (
                flags(a, b, "favorite_match")
                or (b["favorite_mode"] == "entity") - (a["favorite_mode"] == "entity")
                or (b["favorite_score"] or 0) - (a["favorite_score"] or 0)
            )
            or 0
        )
        gap = b["score"] - a["score"]
        return (region and flags(a, b, "is_local")) or personal or (abs(gap) <= window and gap and near(a, b)) or gap or near(a, b) or b["ms"] - a["ms"]

    return by_comparison(ready, request, compare).drop("ms")


def favorites_first(rows: DataFrame, request: Sequence[str]) -> DataFrame:
    """A stable partition: favourites keep their order and come before the others."""
    return ordered(rows.withColumnRenamed("position", "_was"), request, F.coalesce(F.col("favorite_match"), F.lit(False)).desc(), F.col("_was")).drop("_was")


def pushed_first(ranked: DataFrame, pushed: DataFrame, request: Sequence[str], limit: int) -> DataFrame:
    """Unread pushed rows by time, then the ranked ones, each id once, up to the limit."""
    both = pushed.withColumn("_phase", F.lit(0)).withColumn("position", F.lit(0)).unionByName(ranked.withColumn("_phase", F.lit(1)), allowMissingColumns=True)
    once = top_k(both.withColumnRenamed("position", "_was"), [*request, "id"], 1, F.col("_phase")).drop("position")
    return top_k(once, request, limit, F.col("_phase"), F.when(F.col("_phase") == 0, F.col("published_at")).desc_nulls_last(), F.col("_was")).drop("_phase", "_was")


def collapse_stories(rows: DataFrame, request: Sequence[str], margin: float = 0.08) -> DataFrame:
    """One row of each story, at the story's first position. Columns: story, pinned, preference, published_at, position.

    Pinned rows stay before others; a clearly better source wins, a near one if it is newer. With a margin the winner
    depends on the order, so a story's rows are scanned in order.
    """

    def arrange(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position", kind="stable").reset_index(drop=True)
        best = None
        for r in group.itertuples():
            if best is None:
                best = r
            elif bool(r.pinned) != bool(best.pinned):
                best = r if r.pinned else best
            elif r.preference > best.preference + margin or (abs(r.preference - best.preference) <= margin and r.published_at > best.published_at):
                best = r
        return group.iloc[[best.Index]].assign(position=group["position"].iloc[0])

    return rows.groupBy(*request, "story").applyInPandas(arrange, rows.schema)


def cluster_representatives(rows: DataFrame, cluster: str) -> DataFrame:
    """Of each cluster the best by score, time and source, the last two from the end."""
    return top_k(rows, [cluster], 1, F.col("score").desc(), F.col("published_at").desc_nulls_last(), text(F.col("source")).desc()).drop("position")


def top_highlight(rows: DataFrame, keys: Sequence[str], now: Column, fresh_minutes: int = 90, tie_minutes: int = 20) -> DataFrame:
    """The highlight of each key: of rows up to 90 minutes old (of all if there is none), those up to 20 minutes older
    than the newest; then special signal, favourite, score and time."""
    w = Window.partitionBy(*keys)
    pool = rows.where(F.col("published_at").isNotNull()).withColumn("_fresh", (age_minutes(now, F.col("published_at")) <= fresh_minutes).cast("int"))
    pool = pool.withColumn("_any", F.max("_fresh").over(w)).where(F.col("_fresh") == F.col("_any"))
    newest = F.max(F.unix_micros(F.col("published_at").cast("timestamp"))).over(w)
    tied = pool.withColumn("_behind", (newest - F.unix_micros(F.col("published_at").cast("timestamp"))) / 6e7).where(F.col("_behind") <= tie_minutes)
    by = [F.col(c).desc() for c in ("special", "favorite_match", "score", "published_at")]
    return top_k(tied, keys, 1, *by, F.col("id")).drop("_fresh", "_any", "_behind", "position")


def top_score(hours: Column, title: Column, live: list[str], opinion: list[str]) -> Column:
    """120 less 30 an hour, less 25 and 8 for the terms of two lists, plus up to 8 for the title's length."""
    any_of = lambda terms: F.lit(False) if not terms else F.lower(title).rlike(rf"\b({'|'.join(terms)})\b")
    return F.greatest(F.lit(0.0), 120 - 30 * hours) - F.when(any_of(live), 25).otherwise(0) - F.when(any_of(opinion), 8).otherwise(0) + F.least(F.lit(8), F.floor(F.length(title) / 25))
