"""Rules evaluated on chunks of a pair's samples, whole arrays at a time; :mod:`tidewatch.operators.metrics` plans the chunks.

A pair is a rule and one of its series. A chunk covers ``kind.span`` milliseconds of a pair, all its curves (a metric of a ratio, a bound
of a histogram) together. Three things reach over chunks, and each is one number per chunk and curve or condition that is handed on afterwards:
the growth at the first sample of a chunk, the growth of whole chunks inside a range, and the time since which a condition holds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from tidewatch.plans.memory import passed

#: Stands for a missing time. Samples without a time are a chunk of their own, which nothing reaches into.
NO_TIME = -(2**63)
#: Rows of a chunk that its length aims at, and of a task that packs chunks.
CHUNK_ROWS, TASK_ROWS = 131_072, 500_000
#: Rows of a batch of results.
OUT_ROWS = 65_536

PACKED = """_pair long, _start long, _kind int, curves array<int>, sizes array<int>, times binary, xs binary, known binary, halo array<long>,
  first_ts array<long>, first_x array<double>, last_x array<double>, total array<double>, tail array<int>, tail_step array<double>"""
CARRIED = "_pair long, _start long, own array<double>, late array<double>, middle array<double>"
RUNS = "_pair long, _start long, first long, broke array<boolean>, last array<long>"
OPEN = "_pair long, _start long, open array<long>"


@dataclass(frozen=True)
class Kind:
    """How a pair is cut: chunks of ``span`` ms; ``reach`` is the range of a counter, 0 for plain values, and ``span`` is a multiple or a fraction of it."""

    reach: int
    span: int
    rate: bool


@dataclass(frozen=True)
class Condition:
    op: str | None
    threshold: float | None
    other: bool
    quantile: float | None


def growing(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Growing sums of the segments that begin where ``first`` is true. Only values of one segment are ever added, so nothing cancels."""
    at = np.arange(len(x))
    at -= np.maximum.accumulate(np.where(first, at, 0))
    step, most, x = 1, int(at.max(initial=0)), x.copy()
    while step <= most:
        x[step:] += np.where(at[step:] >= step, x[:-step], 0.0)
        step *= 2
    return x


def _steps(value: np.ndarray, ok: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(growth since the sample before, is it known)``; after a reset the new value itself. Not a number is above every number."""
    was, before = np.r_[np.nan, value[:-1]], np.r_[False, ok[:-1]]
    less = (value < was) | (np.isnan(was) & ~np.isnan(value))
    with np.errstate(invalid="ignore"):
        return np.where(less, value, value - was), ok & before & ~new


def _step(value: float | None, was: float | None) -> float:
    """Growth from one chunk to the next, 0 where it is not known."""
    if value is None or was is None:
        return 0.0
    return value if value < was or (was != was and value == value) else value - was


def _curves_of(code: np.ndarray, ts: np.ndarray, value: np.ndarray, ok: np.ndarray, start: int, kind: Kind) -> dict | None:
    """A chunk in order, with what its curves grow by inside it."""
    curves, rank = np.unique(code, return_inverse=True)
    low = int(ts.min())
    width = int(ts.max()) - low + 2 + kind.reach
    if width * len(curves) >= 2**62:
        raise ValueError("times of one chunk lie too far apart")
    key = rank * width + (ts - low)
    order = np.argsort(key)
    key = key[order]
    if (key[1:] == key[:-1]).any():
        order = np.lexsort((value, rank * width + (ts - low)))
    rank, ts, value, ok = rank[order], ts[order], value[order], ok[order]
    own = ts >= start
    if not own.any():
        return None
    new = np.r_[True, rank[1:] != rank[:-1]]
    heads = np.flatnonzero(new)
    ends = np.r_[heads[1:], len(ts)]
    n = len(curves)
    begin = np.array([a + int(np.searchsorted(ts[a:b], start)) for a, b in zip(heads, ends)])
    out = {"halo": [None] * n, "first_x": [None] * n, "last_x": [None] * n, "total": [0.0] * n, "tail": [0] * n, "tail_step": [0.0] * n}
    out["first_ts"] = [int(ts[i]) if i < b else None for i, b in zip(begin, ends)]
    xs = value
    if kind.reach and start == NO_TIME:
        xs, ok = np.zeros(len(ts)), np.ones(len(ts), bool)
    elif kind.reach:
        step, known = _steps(value, ok, new)
        known[begin[begin < ends]] = False  # comes from the chunk before
        step = np.where(known, step, 0.0)
        block = (ts - start) // kind.reach
        cut = new | np.r_[True, block[1:] != block[:-1]]
        here = growing(step, cut)
        there = growing(step[::-1], np.r_[cut[1:], True][::-1])[::-1]
        same = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
        last = np.repeat(same, np.diff(np.r_[-1, same]))
        left = np.searchsorted(key, key - kind.reach, side="right")
        xs = here[last] + np.where(block[left] == block - 1, there[left], 0.0)
        for i, (a, f, b) in enumerate(zip(heads, begin, ends)):
            if a < f:
                out["halo"][i] = int(ts[a])
            if f < b:
                out["first_x"][i], out["last_x"][i] = (float(value[j]) if ok[j] else None for j in (f, b - 1))
                out["total"][i] = float(step[f:b].sum())
                # The first sample that the next chunk still sees: 1 where it is the first of this one, 2 where its growth is known here.
                j = f if kind.span < kind.reach else max(f, a + int(np.searchsorted(ts[a:b], start + kind.span - kind.reach, side="right")))
                if j < b:
                    out["tail"][i], out["tail_step"][i] = 1 if j == f else 2, float(step[j])
        ok = np.ones(len(ts), bool)
    sizes = ends - begin
    ts, xs, ok = ts[own], xs[own], ok[own]
    times = ts - start if start != NO_TIME else np.zeros(len(ts), np.int64)
    times[1:] -= times[:-1].copy()
    return {**out, "curves": curves.tolist(), "sizes": sizes.tolist(), "times": times.tobytes(), "xs": np.ascontiguousarray(xs).tobytes(), "known": None if ok.all() else ok.tobytes()}


def _tables(parts: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[f.name] for p in parts], f.type) for f in schema], schema=schema)


def pack(kinds: list[Kind], schema: pa.Schema) -> Callable:
    """Rows ``(_pair, _code, _start, ts, value)`` of whole chunks to one row per chunk. The code holds the number of the curve and of its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        del rows
        pair, code, start, ts = (table.column(i).to_numpy() for i in range(4))
        ok = ~np.asarray(table.column(4).is_null())
        value = table.column(4).fill_null(np.nan).to_numpy()
        passed(table.nbytes)
        del table
        with np.errstate(over="ignore"):
            mixed = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ start.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        group, seen = pd.factorize(mixed)
        first = np.zeros(len(seen), np.int64)
        first[group[::-1]] = np.arange(len(group))[::-1]
        if (pair[first][group] != pair).any() or (start[first][group] != start).any():  # two chunks of one hash
            group = np.unique(np.stack([pair, start], axis=1), axis=0, return_inverse=True)[1].ravel()
        del mixed
        order = np.argsort(group.astype(np.uint16) if len(seen) < 2**16 else group, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0, True])
        parts, size = [], 0
        for a, b in zip(edges[:-1], edges[1:]):
            at = order[a:b]
            kind = int(code[at[0]]) & 0xFFFF
            chunk = _curves_of(code[at] >> 16, ts[at], value[at], ok[at], int(start[at[0]]), kinds[kind])
            if chunk is not None:
                parts.append({**chunk, "_pair": int(pair[at[0]]), "_start": int(start[at[0]]), "_kind": kind})
                size += b - a
            if size >= CHUNK_ROWS:
                yield _tables(parts, schema)
                parts, size = [], 0
        if parts:
            yield _tables(parts, schema)

    return run


def carry(kinds: list[Kind], schema: pa.Schema) -> Callable:
    """What reaches from chunk to chunk of a pair, per curve: growth at the first sample of the chunk, at the first earlier sample that it
    still sees, and of whole chunks inside the range."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda row: row["_start"])
        kind = kinds[rows[0]["_kind"]]
        out, was, chunks, starts, totals = [], {}, {}, {}, {}
        for row in rows:
            start, got = row["_start"], {"own": [], "late": [], "middle": []}
            for i, c in enumerate(row["curves"]):
                own = late = middle = 0.0
                if kind.reach and start != NO_TIME:
                    seen = row["first_ts"][i] is not None
                    if seen and c in was:
                        own = _step(row["first_x"][i], was[c])
                    tail, step = chunks.get((c, start - max(kind.span, kind.reach)), (0, 0.0))
                    late = step if tail else 0.0
                    if kind.span < kind.reach:
                        at, sums = starts.setdefault(c, []), totals.setdefault(c, [])
                        middle = float(sum(sums[bisect_left(at, start - kind.reach + kind.span):], 0.0))
                    if seen:
                        was[c] = row["last_x"][i]
                        chunks[c, start] = row["tail"][i], own if row["tail"][i] == 1 else row["tail_step"][i]
                        if kind.span < kind.reach:
                            at.append(start)
                            sums.append(own + row["total"][i])
                for name, x in (("own", own), ("late", late), ("middle", middle)):
                    got[name].append(x)
            out.append({"_pair": row["_pair"], "_start": start, **got})
        return pa.Table.from_pylist(out, schema=schema)

    return run


def open_runs(schema: pa.Schema) -> Callable:
    """Per chunk and condition the time since which the condition holds as the chunk begins, null where it does not."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda row: row["_start"])
        out, now = [], None
        for row in rows:
            if row["_start"] == NO_TIME:
                out.append({**{k: row[k] for k in ("_pair", "_start")}, "open": [None] * len(row["broke"])})
                continue
            now = now or [None] * len(row["broke"])
            out.append({**{k: row[k] for k in ("_pair", "_start")}, "open": list(now)})
            now = [last if broke else row["first"] if since is None else since for broke, last, since in zip(row["broke"], row["last"], now)]
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _largest(x: np.ndarray, ok: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum.reduceat(np.where(ok, x, -np.inf), heads), np.logical_or.reduceat(ok, heads)


def _quantiles(ts: np.ndarray, le: np.ndarray, le_ok: np.ndarray, n: np.ndarray, n_ok: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(times, quantiles, are they known)`` of cumulative bucket counts, as :func:`tidewatch.operators.metrics.bucket_quantile`."""
    order = np.lexsort((n, n_ok, le, le_ok, ts))
    ts, le, le_ok, n, n_ok = (x[order] for x in (ts, le, le_ok, n, n_ok))
    heads = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])
    ends = np.r_[heads[1:], len(ts)] - 1
    total, some = n[ends], n_ok[ends]
    sizes = ends - heads + 1
    rank = total * q
    wanted = np.repeat(rank, sizes)
    far = len(ts)
    hit = np.minimum.reduceat(np.where(n_ok & np.repeat(some, sizes) & ((n >= wanted) | np.isnan(n)), np.arange(far), far), heads)
    found = hit < far
    at = np.where(found, hit, heads)
    before, later = np.maximum(heads, at - 1), at > heads
    low, low_ok = np.where(later, le[before], 0.0), np.where(later, le_ok[before], True)
    seen, seen_ok = np.where(later, n[before], 0.0), np.where(later, n_ok[before], True)
    here, open_end = le[at], le_ok[at] & (np.isnan(le[at]) | (le[at] == np.inf))
    inside = n[at] - seen
    flat = seen_ok & (inside == 0)
    value = np.where(open_end, le[before], np.where(flat, here, low + (here - low) * (rank - seen) / np.where(inside == 0, 1.0, inside)))
    known = np.where(open_end, le_ok[before], np.where(flat, le_ok[at], low_ok & seen_ok & le_ok[at]))
    return ts[heads], value, known & found & some & ((total > 0) | np.isnan(total))


def _points(row: dict, kind: Kind, conditions: list[Condition]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Times of a chunk, and per condition the value at each of them and whether it is known."""
    sizes = np.asarray(row["sizes"])
    curve = np.repeat(np.arange(len(sizes)), sizes)
    xs = np.frombuffer(row["xs"], float)
    ok = np.ones(len(xs), bool) if row["known"] is None else np.frombuffer(row["known"], bool)
    ts = np.cumsum(np.frombuffer(row["times"], np.int64))
    if row["_start"] != NO_TIME:
        ts = ts + row["_start"]
        if kind.reach:
            parts = []
            for i, (a, b) in enumerate(zip(np.r_[0, np.cumsum(sizes)[:-1]], np.cumsum(sizes))):
                t, x = ts[a:b], xs[a:b].copy()
                if a < b:
                    x += np.where(t < row["first_ts"][i] + kind.reach, row["own"][i], 0.0)
                    if row["halo"][i] is not None:
                        x += np.where(t < row["halo"][i] + kind.reach, row["late"][i], 0.0)
                    if kind.span < kind.reach:
                        x += row["middle"][i]
                parts.append(x)
            xs = np.concatenate(parts)
    if kind.rate:
        xs = xs / (kind.reach / 1000.0)
    main, cell = (np.asarray([row[name][c] for c in row["curves"]], bool)[curve] for name in ("mains", "cells"))
    les = [row["les"][c] for c in row["curves"]]
    if len(sizes) > 1:
        order = np.argsort(ts, kind="stable")
    else:
        order = np.arange(len(ts))
    t = ts[order]
    heads = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    times = t[heads]
    out = []
    for c in conditions:
        if c.quantile is not None:
            value, known = np.zeros(len(times)), np.zeros(len(times), bool)
            if cell.any():
                le = np.array([np.nan if x is None else x for x in les])[curve][cell]
                at, got, right = _quantiles(ts[cell], le, np.array([x is not None for x in les])[curve][cell], xs[cell], ok[cell], c.quantile)
                place = np.searchsorted(times, at)
                value[place], known[place] = got, right
        else:
            value, known = _largest(xs[order], (ok & main)[order], heads)
            if c.other:
                below, divided = _largest(xs[order], (ok & ~main)[order], heads)
                whole, above = divided & (below != 0), (value > 0) | np.isnan(value)
                known, value = known & (whole | (divided & (below == 0) & above)), np.where(whole, value / np.where(below == 0, 1.0, below), np.inf)
        out.append((value, known))
    return times, out


def _holds(value: np.ndarray, known: np.ndarray, c: Condition) -> np.ndarray:
    if c.threshold is None:
        return np.zeros(len(value), bool)
    number = np.isnan(value)
    if np.isnan(c.threshold):
        return known & (number if c.op not in (">", "<") else ~number if c.op == "<" else np.zeros(len(value), bool))
    return known & ((value > c.threshold) | number if c.op == ">" else value < c.threshold if c.op == "<" else value == c.threshold)


def judge(kinds: list[Kind], conditions: list[Condition], schema: pa.Schema, summary: bool) -> Callable:
    """Packed chunks with what reaches into them to points, or to one row per chunk that says how its conditions end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed(batch.nbytes)
            ended = []
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                with np.errstate(all="ignore"):
                    times, values = _points(row, kinds[row["_kind"]], [conditions[c] for c in row["conditions"]])
                timed, brokes, lasts = row["_start"] != NO_TIME, [], []
                for k, (c, (value, known)) in enumerate(zip(row["conditions"], values)):
                    holds = _holds(value, known, conditions[c])
                    begins = holds & ~np.r_[False, holds[:-1]]
                    since = times[np.maximum(np.maximum.accumulate(np.where(begins, np.arange(len(times)), -1)), 0)]
                    if summary:
                        brokes.append(not holds.all())
                        lasts.append(int(since[-1]) if holds[-1] else None)
                        continue
                    if row["open"][k] is not None:
                        since = np.where(np.logical_and.accumulate(holds), row["open"][k], since)
                    for a in range(0, len(times), OUT_ROWS):
                        at = slice(a, a + OUT_ROWS)
                        n = len(times[at])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(n, row["_pair"])), pa.array(np.full(n, c, np.int32)), pa.array(times[at]) if timed else pa.nulls(n, pa.int64()),
                            pa.array(value[at], mask=~known[at]), pa.array(holds[at]),
                            pa.array(since[at], mask=~holds[at]) if timed else pa.nulls(n, pa.int64())], schema=schema)
                if summary:
                    ended.append({"_pair": row["_pair"], "_start": row["_start"], "first": int(times[0]), "broke": brokes, "last": lasts})
            if ended:
                yield _tables(ended, schema)

    return run
