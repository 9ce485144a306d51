"""Implausible readings of measurement series: a hidden Markov model per series, with hard bounds.

A series has one reading per moment (repeats of a moment with the same reading count once). Four kinds of states emit the
readings: normal, spike, stuck (its first reading and those equal to it) and out of range. Emissions take their scale from the
series, the transitions are fitted to it by expectation maximisation. Forward-backward probabilities and the hard bounds propose
readings; an exact rule (distance from the median against the median distance, runs of equal readings) may confirm them.

Series of any length: those above a chunk are numbered by a global sort and cut into overlapping chunks of bounded size, so that a
source with a third of all readings is no single task. The overlap is some hundred readings, after which the chain has forgotten
where it began.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators.percentile import exact_percentile, numbered

CHUNK_READINGS, OVERLAP = 20_000, 512
MAX_LONG = 100_000
BATCH_READINGS = 200_000

STATES = ("normal", "spike", "stuck", "stuck", "out_of_range")
NORMAL, SPIKE, FIRST, STUCK, OUT = range(5)
#: Prior transitions, rows from, columns to. A reading is stuck only after a first one of its run, so a run is flagged whole.
TRANSITION = np.array([[0.96, 0.015, 0.015, 0.0, 0.01], [0.80, 0.10, 0.05, 0.0, 0.05], [0.05, 0.02, 0.01, 0.90, 0.02], [0.25, 0.02, 0.01, 0.70, 0.02], [0.80, 0.05, 0.05, 0.0, 0.10]])
START = np.array([0.94, 0.02, 0.02, 0.0, 0.02])
#: Readings that the prior transitions weigh, the least probability of a transition that is possible, and rounds of the fit.
PRIOR_READINGS, LEAST, FIT_ROUNDS = 50.0, 1e-4, 1


@dataclass(frozen=True)
class Rule:
    """What a reading must not do. ``low``, ``high``: hard bounds; ``zero_is_normal``: an exact 0 is never flagged."""

    factor: float = 12.0
    run: int = 5
    low: float | None = None
    high: float | None = None
    zero_is_normal: bool = False


def _ranks(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and size of each run of equal values in the sorted ``group``."""
    if not len(group):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return start, np.diff(np.r_[start, len(group)])


def _medians(group: np.ndarray, x: np.ndarray, n_groups: int) -> np.ndarray:
    """Exact median of x for each of the groups 0..n_groups-1; NaN where a group has none."""
    order = np.lexsort((x, group))
    g, v = group[order], x[order]
    start, size = _ranks(g)
    out = np.full(n_groups, np.nan)
    if len(start):
        out[g[start]] = (v[start + (size - 1) // 2] + v[start + size // 2]) / 2
    return out


def _emissions(u: np.ndarray, equal: np.ndarray, out: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Likelihood of readings in each state. u: distance from the median in robust standard deviations of the series; equal: the same
    as the reading before; out: beyond a hard bound.

    Normal readings are Gaussian, spikes a Cauchy bell as wide as the far readings of the series. A normal reading equals the one
    before as rarely as single pairs of equal readings in the series say.
    """
    of = np.repeat(np.arange(len(size)), size)
    u = np.minimum(np.nan_to_num(u, nan=0.0, posinf=1e30), 1e30)
    far = (u > 6) & (u < 1e30)
    wide = np.bincount(of, np.where(far, np.log(np.maximum(u, 1.0)), 0.0), len(size))
    wide = np.exp(np.where((n := np.bincount(of, far, len(size))) > 0, wide / np.maximum(n, 1), np.log(30.0)))[of]
    before, after = np.r_[False, equal[:-1]], np.r_[equal[1:], False]
    single = np.bincount(of, equal & ~before & ~after, len(size))
    tie = np.clip(single / size, 1e-4, 5e-3)[of]
    bell = np.maximum(np.exp(-0.5 * np.minimum(u, 37.0) ** 2), 1e-300) / 2.5066
    cauchy = 1 / (np.pi * wide * (1 + (u / wide) ** 2))
    e = np.empty((len(u), 5))
    e[:, NORMAL] = bell * np.where(equal, tie, 1.0)
    e[:, SPIKE] = cauchy * np.where(equal, 1e-3, 1.0)
    e[:, FIRST] = (bell + cauchy) / 2 * np.where(equal, 1e-3, 1.0)
    e[:, STUCK] = np.where(equal, 1.0, 1e-9)
    e[:, OUT] = 0.0
    e[out] = (0.0, 0.0, 0.0, 0.0, 1.0)
    return e


def _forward_backward(e: np.ndarray, start: np.ndarray, size: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each state at each reading, and the expected number of each transition in each series. ``transition`` has a
    matrix for each series. Series of similar length step together through one array."""
    states, moves = np.empty((len(e), 5)), np.zeros((len(size), 5, 5))
    cls = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for c in np.unique(cls):
        of = np.flatnonzero(cls == c)
        n, t = len(of), int(size[of].max())
        step = np.arange(t)
        live = step[:, None] < size[of]
        at = np.where(live, start[of] + step[:, None], 0)
        seen = np.where(live[:, :, None], e[at], 1.0)
        m = transition[of]
        f = np.empty((t, n, 5))
        a = START * seen[0]
        f[0] = a / a.sum(1, keepdims=True)
        for i in range(1, t):
            a = (f[i - 1][:, None, :] @ m)[:, 0] * seen[i]
            f[i] = a / a.sum(1, keepdims=True)
        b = np.ones((n, 5))
        back = m.transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            p = f[i] * b
            p /= p.sum(1, keepdims=True)
            states[at[i][live[i]]] = p[live[i]]
            if i:
                ahead = seen[i] * b
                move = f[i - 1][:, :, None] * m * ahead[:, None, :]
                moves[of] += np.where(live[i][:, None, None], move / move.sum((1, 2), keepdims=True), 0.0)
                b = (ahead[:, None, :] @ back)[:, 0]
                b /= b.sum(1, keepdims=True)
    return states, moves


def _fitted(e: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Probability of each state at each reading, under transitions fitted to each series around the prior ones."""
    transition = np.broadcast_to(TRANSITION, (len(size), 5, 5))
    for _ in range(FIT_ROUNDS):
        counts = _forward_backward(e, start, size, transition)[1] + PRIOR_READINGS * TRANSITION
        transition = counts / counts.sum(2, keepdims=True)
        transition = np.where(TRANSITION > 0, np.maximum(transition, LEAST), 0.0)
        transition /= transition.sum(2, keepdims=True)
    return _forward_backward(e, start, size, transition)[0]


def judge_readings(group: np.ndarray, moment: np.ndarray, x: np.ndarray, rule: Rule, centre: np.ndarray | None = None, spread: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each state for each reading, and whether the exact rule holds for it. Groups are 0..n-1 without gaps, in order.
    centre, spread: known medians and median distances of the groups; where they are NaN or not given they are computed here. Nulls
    must be left out before."""
    if not len(x):
        return np.empty((0, 5)), np.zeros(0, bool)
    same = np.lexsort((np.nan_to_num(x, nan=np.inf), moment, group))
    g, m, v = group[same], moment[same], x[same]
    equal = (v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
    first = np.r_[True, (g[1:] != g[:-1]) | (m[1:] != m[:-1]) | ~equal]
    which = np.cumsum(first) - 1
    g, v = g[first], v[first]

    with np.errstate(invalid="ignore"):
        out = ~np.isfinite(v)
        out |= (v < (-np.inf if rule.low is None else rule.low)) | (v > (np.inf if rule.high is None else rule.high))
    used = ~out & ~((v == 0) & rule.zero_is_normal)
    n = int(group[-1]) + 1
    own = _medians(g[used], v[used], n)
    own_spread = _medians(g[used], np.abs(v[used] - own[g[used]]), n)
    centre = own if centre is None else np.where(np.isnan(centre), own, centre)
    spread = own_spread if spread is None else np.where(np.isnan(spread), own_spread, spread)
    with np.errstate(invalid="ignore", divide="ignore"):
        away = np.abs(v - centre[g])
        scale = 1.4826 * spread[g]
        u = np.where(away > 0, away / scale, 0.0)
    u[~used] = 0.0
    start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
    run = np.repeat(np.diff(np.r_[start, len(v)]), np.diff(np.r_[start, len(v)]))
    zero = (v == 0) & rule.zero_is_normal
    again = np.r_[False, (g[1:] == g[:-1]) & (v[1:] == v[:-1])] & ~zero

    begin, size = _ranks(g)
    states = _fitted(_emissions(u, again, out, begin, size), begin, size)
    with np.errstate(invalid="ignore"):
        exact = (out | (away > rule.factor * scale) & used | (run >= rule.run)) & ~zero
    states[zero] = (1.0, 0.0, 0.0, 0.0, 0.0)
    back = np.empty(len(same), np.int64)
    back[same] = which
    return states[back], exact[back]


def flag_readings(group: np.ndarray, moment: np.ndarray, x: np.ndarray, rule: Rule, centre: np.ndarray | None = None, spread: np.ndarray | None = None) -> np.ndarray:
    """True for each reading that is likelier not normal and for which the exact rule holds."""
    states, exact = judge_readings(group, moment, x, rule, centre, spread)
    return (states[:, NORMAL] < 0.5) & exact


def _long_stats(readings: DataFrame, keys: list[str], fields: dict[str, Rule], long: DataFrame) -> DataFrame:
    """Exact median and median distance of the long series. Nothing is gathered by series."""
    stats = long.select(*keys)
    for f, rule in fields.items():
        x = F.col(f).cast("double")
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        ok = ok & (x >= rule.low if rule.low is not None else F.lit(True)) & (x <= rule.high if rule.high is not None else F.lit(True)) & ((x != 0) if rule.zero_is_normal else F.lit(True))
        v = readings.where(ok).select(*keys, "_moment", x.alias("_x")).distinct()
        mid = exact_percentile(v, keys, "_x", 0.5, f"_centre_{f}", few_keys=True)
        d = v.join(F.broadcast(mid), keys).select(*keys, F.abs(F.col("_x") - F.col(f"_centre_{f}")).alias("_x"))
        spread = exact_percentile(d, keys, "_x", 0.5, f"_spread_{f}", few_keys=True)
        stats = stats.join(mid, keys, "left").join(spread, keys, "left")
    return stats


def _chunked(readings: DataFrame, keys: list[str], names: list[str], chunk: int) -> DataFrame:
    """Readings of long series with _chunk and _own (false for readings of the overlap, which are context only). A global sort numbers
    them, so a chunk is a range of places and no series passes through one task."""
    at = numbered(readings, [*map(F.col, keys), F.col("_moment"), *(F.asc_nulls_first(n) for n in names)], "_nth")
    series = at.groupBy(*keys).agg(F.min("_nth").alias("_first"), F.max("_nth").alias("_final"))
    r = at.join(F.broadcast(series), keys).withColumn("_place", F.col("_nth") - F.col("_first"))
    whole = lambda c: F.floor(c / F.lit(chunk)).cast("int")
    overlap = min(OVERLAP, chunk // 2)
    homes = [whole(F.col("_place")), whole(F.col("_place") + overlap), whole(F.greatest(F.col("_place") - overlap, F.lit(0)))]
    last = whole(F.col("_final") - F.col("_first"))
    r = r.withColumn("_home", homes[0]).withColumn("_chunk", F.explode(F.array_distinct(F.array(*(F.least(h, last) for h in homes)))))
    return r.withColumn("_own", F.col("_chunk") == F.col("_home")).drop("_nth", "_first", "_final", "_place", "_home")


def implausible_readings(df: DataFrame, keys: list[str], moment: str, row_id: str, fields: dict[str, Rule], chunk_readings: int = CHUNK_READINGS, confirmed: bool = True) -> DataFrame:
    """Flagged readings as rows (field, key_id, state, p_normal): key_id is ``row_id`` of the row, state the likeliest of the states that
    are not normal, p_normal the probability of the normal one. One row of output per flagged row and field.

    ``keys`` name a series, ``moment`` (integer or timestamp) orders it; ``fields`` maps each measured column to its rule. Readings are
    flagged that are likelier not normal under the model of their series and, if ``confirmed``, for which the exact rule holds too.
    Null readings are no readings and are passed over; rows with a null key or moment belong to no series and are never
    flagged. Several different readings of one moment stand one after the other by size. Repeated rows are flagged alike. An
    empty input gives an empty result; other columns are ignored.
    """
    names = list(fields)
    numeric = F.unix_micros(moment) if isinstance(df.schema[moment].dataType, T.TimestampType) else F.col(moment).cast("long")
    rows = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), numeric.alias("_moment"), F.col(row_id).cast("long").alias("_id"), *names)
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in [*ks, "_moment"]) + " AND (" + " OR ".join(f"`{n}` IS NOT NULL" for n in names) + ")")
    sizes = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    # a chunk has at least 1/MAX_LONG of all readings, so there are under MAX_LONG longer series: small enough to broadcast
    chunk = max(chunk_readings, (total or 0) // MAX_LONG)
    if not most or most <= chunk:
        return _judged(rows.withColumns({"_chunk": F.lit(0), "_own": F.lit(True)}), ks, fields, confirmed)
    long = sizes.where(F.col("n") > chunk).select(*ks)
    short = rows.join(F.broadcast(long), ks, "left_anti").withColumns({"_chunk": F.lit(0), "_own": F.lit(True)})
    mine = rows.join(F.broadcast(long), ks, "left_semi")
    # a reading delivered very often is judged once, under its least id, and its rows are found by it again
    readings = mine.groupBy(*ks, "_moment", *names).agg(F.min("_id").alias("_id"))
    parts = _chunked(readings, ks, names, chunk).join(F.broadcast(_long_stats(readings, ks, fields, long)), ks)
    bad = _judged(parts, ks, fields, confirmed).withColumnRenamed("key_id", "_id").join(readings, "_id")
    alike = F.expr(" AND ".join([*(f"a.{c} = b.{c}" for c in [*ks, "_moment"]), *(f"a.`{n}` <=> b.`{n}`" for n in names)]))
    again = mine.alias("a").join(bad.alias("b"), alike).select("field", F.col("a._id").alias("key_id"), "state", "p_normal")
    return _judged(short, ks, fields, confirmed).unionByName(again)


def _judged(chunked: DataFrame, ks: list[str], fields: dict[str, Rule], confirmed: bool) -> DataFrame:
    """The flagged readings of chunks, each chunk in one task; those of the overlap are context only."""
    names = list(fields)
    stats = [f"_{s}_{n}" for n in names for s in ("centre", "spread")]
    chunked = chunked.withColumns({c: F.lit(None).cast("double") for c in stats if c not in chunked.columns})
    sort = [*ks, "_chunk", "_moment"]
    ready = chunked.select(*sort, "_id", "_own", *names, *stats).repartition(*ks, "_chunk").sortWithinPartitions(*sort)

    def flags_of(t: pa.Table) -> pa.RecordBatch:
        new = np.zeros(len(t), bool)
        new[0] = True
        for c in [*ks, "_chunk"]:
            a = t[c].combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= a[1:] != a[:-1]
        group = np.cumsum(new) - 1
        moments, own, ids = (t[c].to_numpy() for c in ("_moment", "_own", "_id"))
        found_f, found_i, found_s, found_p = [], [], [], []
        for n in names:
            there = ~t[n].is_null().to_numpy(zero_copy_only=False)
            if not there.any():
                continue
            idx = np.flatnonzero(there)
            _, g = np.unique(group[idx], return_inverse=True)
            x = t[n].cast(pa.float64()).to_numpy(zero_copy_only=False)[idx]
            at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            centre, spread = (t[f"_{c}_{n}"].to_numpy(zero_copy_only=False)[idx][at].astype(float) for c in ("centre", "spread"))
            states, exact = judge_readings(g, moments[idx], x, fields[n], centre, spread)
            bad = (states[:, NORMAL] < 0.5) & own[idx]
            if confirmed:
                bad &= exact
            found_i.append(ids[idx][bad])
            found_f += [n] * int(bad.sum())
            found_s += [STATES[k] for k in states[bad, SPIKE:].argmax(1) + SPIKE]
            found_p.append(states[bad, NORMAL])
        ids_out = np.concatenate(found_i) if found_i else np.empty(0, np.int64)
        p_out = np.concatenate(found_p) if found_p else np.empty(0)
        return pa.RecordBatch.from_arrays([pa.array(found_f, pa.string()), pa.array(ids_out, pa.int64()), pa.array(found_s, pa.string()), pa.array(p_out)], names=["field", "key_id", "state", "p_normal"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups only: the last, perhaps unfinished group of what is held waits for the next batch."""
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < BATCH_READINGS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = [t[c][-1].as_py() for c in [*ks, "_chunk"]]
            tail = np.ones(len(t), bool)
            for c, v in zip([*ks, "_chunk"], last, strict=True):
                a = t[c].combine_chunks().dictionary_encode()
                tail &= a.indices.to_numpy() == a.dictionary.to_pylist().index(v)
            cut = int(np.argmax(tail))
            if cut:
                yield flags_of(t.slice(0, cut).combine_chunks())
                held = t.slice(cut).to_batches()
                n = len(t) - cut
        if n:
            yield flags_of(pa.Table.from_batches(held).combine_chunks())

    return ready.mapInArrow(run, "field string, key_id long, state string, p_normal double")
