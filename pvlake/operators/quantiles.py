"""Exact, interpolated quantiles whose memory does not grow with a hot group.

``percentile`` (exact, linear interpolation as pandas) keeps every distinct
value of a group, which fails when one key holds a large share of all rows.
Here groups with at most ``small`` rows use ``percentile`` directly; for the
larger (hot) groups each needed order statistic is found by histogram
refinement: count the values of the current range in ``buckets`` equal-width
buckets per (group, target), with both ends of the range in buckets of their
own, keep the bucket that contains the target rank (its actual min/max become
the new range) and repeat, then read the value by rank once the bucket is small
or holds one distinct value. Each round is a partial aggregate over the hot
groups' rows only; no task ever holds more than ``small`` values of one group.
Both ways give the same numbers.

A round divides the range by ``buckets``, and infinities leave it in the first,
so the span of all doubles (under 2 ** 2100 of the least difference) bounds the
rounds. A target still open after that is an error, never a NULL.

``weight`` names a column of row counts: each value then counts that often.

The result equals Spark's / pandas' linear interpolation:
``(hi - pos) * v[lo] + (pos - lo) * v[hi]`` with ``pos = (n - 1) * p``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvlake.session import cut_lineage


def _interpolate(pos: Column, v_lo: Column, v_hi: Column) -> Column:
    lo, hi = F.floor(pos), F.ceil(pos)
    return F.when((lo == hi) | (v_lo == v_hi), v_lo).otherwise((hi - pos) * v_lo + (pos - lo) * v_hi)


# groups above this many values take the refinement path (tests lower it to force that path)
HOT_GROUP_ROWS = 200_000
COLLECT_LIMIT = 100_000
# tables of groups or targets are broadcast up to this many (counted) rows
BROADCAST_ROWS = 100_000


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _bucket(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """Monotone bucket of ``v``: -1 and ``buckets`` for the ends. Halves keep the width finite."""
    width = hi / 2 - lo / 2
    inside = F.when((width > 0) & (width < float("inf")),
                    F.least(F.floor((v / 2 - lo / 2) / width * buckets), F.lit(buckets - 1))).otherwise(0)
    return F.when(v == lo, -1).when(v == hi, buckets).otherwise(inside)


def exact_quantiles(df: DataFrame, keys: list[str], value: Column | str, probs: dict[str, float],
                    small: int | None = None, buckets: int = 4096, collect_limit: int | None = None,
                    group_bound: int | None = None, weight: str | None = None) -> DataFrame:
    """keys + one column per ``probs`` name (NULLs ignored; groups without values are absent).

    ``group_bound``: a known upper bound on the rows per group (e.g. the row
    count of the table everything derives from); when it is at most ``small``
    the plain aggregate is planned without any check job.
    """
    small = HOT_GROUP_ROWS if small is None else small
    collect_limit = COLLECT_LIMIT if collect_limit is None else collect_limit
    global_ = not keys
    if global_:  # one group: a constant key (the target table it meets has at most 2 rows per quantile)
        df, keys = df.withColumn("_g", F.lit(0)), ["_g"]
    times = F.lit(1) if weight is None else F.col(weight)
    v = df.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v"),
                  times.cast("bigint").alias("_t")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_t") > 0))
    names = list(probs)
    exact = [(F.percentile("_v", F.lit(p)) if weight is None else F.percentile("_v", F.lit(p), F.col("_t"))).alias(n)
             for n, p in probs.items()]
    if group_bound is not None and group_bound <= small:
        return _finish(v.groupBy(*keys).agg(*exact), global_, names)
    sizes = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_t").alias("_n"),
                                 F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    named = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    hot = cut_lineage(sizes.filter((F.col("_rows") > small) & named))  # never more than rows / small
    hot_groups = hot.count()
    if not hot_groups:  # the common case: one plain aggregate
        return _finish(v.groupBy(*keys).agg(*exact), global_, names)
    small_part = v.join(_bounded(hot.select(*keys), hot_groups), keys, "left_anti").groupBy(*keys).agg(*exact)

    # one target per (group, quantile, lower/upper order statistic)
    tgt = hot.select(*keys, "_n", "_min", "_max", F.explode(F.array(*[
        F.struct(F.lit(n).alias("_q_name"), F.lit(p).alias("p")) for n, p in probs.items()])).alias("q"))
    tgt = tgt.select(*keys, "_min", "_max", F.col("q._q_name").alias("_q_name"),
                     ((F.col("_n") - 1) * F.col("q.p")).alias("_q_pos"))
    tgt = tgt.select("*", F.explode(F.array(
        F.struct(F.lit("lo").alias("_q_which"), F.floor("_q_pos").alias("_q_rank")),
        F.struct(F.lit("hi").alias("_q_which"), F.ceil("_q_pos").alias("_q_rank")))).alias("t"))
    state = cut_lineage(tgt.select(*keys, "_q_name", "_q_pos", F.col("t._q_which").alias("_q_which"),
                                   F.col("t._q_rank").alias("_q_rank"), F.col("_min").alias("_q_lo_v"),
                                   F.col("_max").alias("_q_hi_v"), F.lit(0).cast("bigint").alias("_q_below"),
                                   F.lit(None).cast("double").alias("_q_answer")))
    targets = state.count()
    tkeys = [*keys, "_q_name", "_q_which"]
    for _ in range(math.ceil(2100 / math.log2(buckets)) + 4):
        open_ = state.filter(F.col("_q_answer").isNull())
        if open_.isEmpty():
            break
        # targets of one group mostly share their range: a value is counted once for each range
        span = [*keys, "_q_lo_v", "_q_hi_v"]
        rows = v.join(_bounded(open_.select(*span).distinct(), targets), keys).filter(
            F.col("_v").between(F.col("_q_lo_v"), F.col("_q_hi_v")))
        b = _bucket(F.col("_v"), F.col("_q_lo_v"), F.col("_q_hi_v"), buckets)
        hist = rows.groupBy(*span, b.alias("_q_b")).agg(
            F.sum("_t").alias("_q_c"), F.count(F.lit(1)).alias("_q_rows"),
            F.min("_v").alias("_q_bmin"), F.max("_v").alias("_q_bmax"))
        hist = hist.join(_bounded(open_.select(*tkeys, "_q_rank", "_q_lo_v", "_q_hi_v", "_q_below"), targets), span)
        w = Window.partitionBy(*tkeys).orderBy("_q_b").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_q_before", F.coalesce(F.sum("_q_c").over(w), F.lit(0)))
        local = F.col("_q_rank") - F.col("_q_below")
        chosen = hist.filter((local >= F.col("_q_before")) & (local < F.col("_q_before") + F.col("_q_c"))).select(
            *tkeys, F.col("_q_bmin").alias("_q_lo_v"), F.col("_q_bmax").alias("_q_hi_v"),
            (F.col("_q_below") + F.col("_q_before")).alias("_q_below"), F.col("_q_rows"))
        chosen = cut_lineage(chosen)
        single = chosen.filter(F.col("_q_lo_v") == F.col("_q_hi_v")).select(*tkeys, F.col("_q_lo_v").alias("_q_ans"))
        few = chosen.filter((F.col("_q_lo_v") < F.col("_q_hi_v")) & (F.col("_q_rows") <= collect_limit))
        picked = v.join(_bounded(few.join(open_.select(*tkeys, "_q_rank"), tkeys), targets), keys).filter(
            F.col("_v").between(F.col("_q_lo_v"), F.col("_q_hi_v")))
        upto = F.sum("_t").over(Window.partitionBy(*tkeys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
        at = F.col("_q_rank") - F.col("_q_below")
        picked = picked.withColumn("_q_upto", upto).filter(
            (at < F.col("_q_upto")) & (at >= F.col("_q_upto") - F.col("_t"))).select(*tkeys, F.col("_v").alias("_q_ans"))
        answers = single.unionByName(picked)
        narrowed = chosen.filter((F.col("_q_lo_v") < F.col("_q_hi_v")) & (F.col("_q_rows") > collect_limit)).select(
            *tkeys, F.col("_q_lo_v").alias("_q_nlo"), F.col("_q_hi_v").alias("_q_nhi"),
            F.col("_q_below").alias("_q_nbelow"))
        state = cut_lineage(
            state.join(answers, tkeys, "left").join(narrowed, tkeys, "left").select(
                *tkeys, "_q_pos", "_q_rank",
                F.coalesce("_q_nlo", "_q_lo_v").alias("_q_lo_v"), F.coalesce("_q_nhi", "_q_hi_v").alias("_q_hi_v"),
                F.coalesce("_q_nbelow", "_q_below").alias("_q_below"),
                F.coalesce("_q_answer", "_q_ans").alias("_q_answer")))
    if not state.filter(F.col("_q_answer").isNull()).isEmpty():
        raise RuntimeError(f"quantiles of {names} stayed open")
    both = state.groupBy(*keys, "_q_name").agg(
        F.first("_q_pos").alias("_q_pos"),
        F.max(F.when(F.col("_q_which") == "lo", F.col("_q_answer"))).alias("v_lo"),
        F.max(F.when(F.col("_q_which") == "hi", F.col("_q_answer"))).alias("v_hi"))
    hot_part = both.select(*keys, "_q_name", _interpolate(F.col("_q_pos"), F.col("v_lo"), F.col("v_hi")).alias("q"))
    hot_part = hot_part.groupBy(*keys).pivot("_q_name", names).agg(F.first("q"))
    return _finish(small_part.unionByName(hot_part), global_, names)


# rows that propose the ranges of column_quantiles: this many, or a hundredth of all if that is more
GUIDE_ROWS = 50_000


def column_quantiles(df: DataFrame, cols: list[str], p: float, small: int | None = None) -> dict[str, float]:
    """Exact quantile of each of many columns, as one number a column (columns without values are absent).

    A seeded share of the rows only proposes a narrow range for each column. All rows then count what lies below
    and within it, in one pass without a shuffle of values: where the wanted order statistics lie within, a range of one
    value is the answer and the few values of a wider one are counted by value. A column whose range missed,
    and tables of at most ``small`` rows, go through ``exact_quantiles``."""
    small = HOT_GROUP_ROWS if small is None else small
    values = df.select(*[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(cols)])

    def stacked_quantiles(rows: DataFrame, some: list[int], probs: dict[str, float]) -> dict[int, tuple]:
        if not some:
            return {}
        long = rows.select(*[f"c{i}" for i in some]).unpivot([], [f"c{i}" for i in some], "name", "value")
        found = exact_quantiles(long.filter(F.col("value").isNotNull()), ["name"], "value", probs).collect()
        return {int(r["name"][1:]): tuple(r[n] for n in probs) for r in found}

    every = list(range(len(cols)))
    n_rows = df.count() if cols else 0
    if n_rows <= small:
        return {cols[i]: q for i, (q,) in stacked_quantiles(values, every, {"q": p}).items()}
    share = max(0.01, GUIDE_ROWS / n_rows)
    reach = 2.5 / math.sqrt(share * n_rows)  # five standard deviations of a sampled median's place
    ends = stacked_quantiles(values.sample(min(share, 1.0), seed=7), every,
                             {"lo": max(p - reach, 0.0), "hi": min(p + reach, 1.0)})
    counts = [x for i, (lo, hi) in ends.items() for x in (
        F.count(f"c{i}").alias(f"n{i}"), F.count(F.when(F.col(f"c{i}") < lo, 1)).alias(f"b{i}"),
        F.count(F.when(F.col(f"c{i}") <= hi, 1)).alias(f"u{i}"))]
    got = values.agg(*counts).first() if counts else {}
    out, inside, missed = {}, {}, [i for i in every if i not in ends]
    for i, (lo, hi) in ends.items():
        at = (got[f"n{i}"] - 1) * p
        if not got[f"b{i}"] <= math.floor(at) <= math.ceil(at) < got[f"u{i}"]:
            missed.append(i)
        elif lo == hi:
            out[i] = lo
        else:
            inside[i] = at
    if inside:
        places = F.create_map(*[F.lit(x) for i, at in inside.items() for x in (i, at - got[f"b{i}"])])
        cells = F.array_compact(F.array(*[
            F.when(F.col(f"c{i}").between(*ends[i]), F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("v"))) for i in inside]))
        by_value = values.select(F.inline(cells)).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        ranked = by_value.withColumn("upto", upto).withColumn("at", F.element_at(places, F.col("i")))
        holds = lambda rank: (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))
        found = ranked.groupBy("i").agg(F.max(F.when(holds(F.floor("at")), F.col("v"))).alias("lo"),
                                        F.max(F.when(holds(F.ceil("at")), F.col("v"))).alias("hi")).collect()
        for r in found:
            at, lo, hi = inside[r["i"]], r["lo"], r["hi"]
            out[r["i"]] = lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi
    out |= {i: q for i, (q,) in stacked_quantiles(values, missed, {"q": p}).items()}
    return {cols[i]: float(q) for i, q in out.items()}


def _finish(out: DataFrame, global_: bool, names: list[str]) -> DataFrame:
    return out.select(*names) if global_ else out


def exact_quantile_scalar(df: DataFrame, value: Column | str, p: float, **kw) -> Column:
    """Global quantile as a scalar Column (one-row result used as a scalar subquery)."""
    return exact_quantiles(df, [], value, {"q": p}, **kw).select("q").scalar()
