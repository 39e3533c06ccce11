"""Kernels over one elevation series: resampling, smoothing, extrema, climbs, spikes.  All numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .geodesy import cumulative_np, direct_np, inverse_np

# The spike penalty's and the stored profile's grid, spans and limits.
SPIKE_STEP, SPIKE_SPAN, SPIKE_WINDOW, SPIKE_FLOOR, SPIKE_CAP = 30.0, 100.0, 250.0, 0.07, 0.15
PROFILE_STEP, PROFILE_WINDOW, PROFILE_ORDER = 20.0, 400.0, 3


def moving_average(x: np.ndarray, size: int) -> np.ndarray:
    """Means of `size` samples, the edge values repeated; an even window reaches one sample further back."""
    if size <= 1 or not len(x):
        return np.asarray(x, dtype=float)
    back = size // 2
    padded = np.concatenate((np.full(back, x[0]), x, np.full(size - 1 - back, x[-1])))
    return np.lib.stride_tricks.sliding_window_view(padded, size).mean(axis=1)


def peaks(x: np.ndarray, prominence: float) -> np.ndarray:
    """Places of local maxima (a plateau counts at its middle, ends never) that stand out by `prominence` from the
    higher of the two lowest points on the way to anything higher."""
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    level = x[first]
    last = np.append(first[1:], len(x)) - 1
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1 if len(level) > 2 else np.zeros(0, dtype=np.int64)
    out = []
    for k in top.tolist():
        height = level[k]
        left, right = level[:k], level[k + 1 :]
        higher = np.flatnonzero(left > height)
        low_left = left[higher[-1] + 1 :].min() if higher.size else left.min()
        higher = np.flatnonzero(right > height)
        low_right = right[: higher[0]].min() if higher.size else right.min()
        if height - max(low_left, low_right) >= prominence:
            out.append((first[k] + last[k]) // 2)
    return np.array(out, dtype=np.int64)


def extrema(x: np.ndarray, prominence: float) -> list[tuple[int, str]]:
    """Alternating troughs and peaks with both ends forced in: an end that isn't higher than its neighbouring extremum
    is a trough; without any extremum the first is a trough unless the last is lower, and the last the opposite."""
    end = len(x) - 1
    if end < 1:
        return []
    found = sorted([(int(i), "peak") for i in peaks(x, prominence)] + [(int(i), "trough") for i in peaks(-x, prominence)])
    if not found:
        rises = x[0] <= x[end]
        return [(0, "trough" if rises else "peak"), (end, "peak" if rises else "trough")]
    kind = lambda own, other: "trough" if x[own] <= x[other] else "peak"
    return [(0, kind(0, found[0][0])), *found, (end, kind(end, found[-1][0]))]


def candidates(cum: np.ndarray, elev: np.ndarray, min_length: float, min_grade: float, min_gain: float, prominence: float) -> list[tuple[int, int, float, float, list[str]]]:
    """(trough, peak, length, gain, which limits it falls short of) of neighbouring extrema that rise."""
    if len(elev) < 3:
        return []
    found, out = extrema(elev, prominence), []
    for (a, kind_a), (b, kind_b) in zip(found, found[1:]):
        length, gain = float(cum[b] - cum[a]), float(elev[b] - elev[a])
        if (kind_a, kind_b) == ("trough", "peak") and length > 0 and gain > 0:
            short = [name for name, low in (("length", length < min_length), ("grade", gain / length < min_grade), ("gain", gain < min_gain)) if low]
            out.append((a, b, length, gain, short))
    return out


def climbs(cum: np.ndarray, elev: np.ndarray, min_length: float, min_grade: float, min_gain: float, prominence: float) -> list[tuple[int, int]]:
    """(trough, peak) places of neighbouring extrema that are long, steep and high enough."""
    return [(a, b) for a, b, _, _, short in candidates(cum, elev, min_length, min_grade, min_gain, prominence) if not short]


def along(lat: np.ndarray, lng: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(lat, lng, metres) of a path whose segments are cut in equal parts of about `step`, nodes kept."""
    if len(lat) < 2:
        return None
    d, az = inverse_np(lat[:-1], lng[:-1], lat[1:], lng[1:])
    use = np.flatnonzero(d > 0)
    if not use.size:
        return None
    d, az = d[use], az[use]
    parts = np.maximum(1, np.floor(d / step)).astype(np.int64)
    seg = np.repeat(np.arange(len(use)), parts)
    k = np.arange(len(seg)) - np.repeat(np.cumsum(parts) - parts, parts) + 1
    part = d[seg] * (k / parts[seg])
    y, x = direct_np(lat[:-1][use][seg], lng[:-1][use][seg], az[seg], part)
    before = np.concatenate(([0.0], np.cumsum(d)))[seg]
    return np.concatenate((lat[:1], y)), np.concatenate((lng[:1], x)), np.concatenate(([0.0], before + part))


def uniform(cum: np.ndarray, elev: np.ndarray, step: float) -> tuple[np.ndarray, float] | None:
    """(elevations on an even grid of about `step`, length); None below two steps."""
    if len(cum) < 2 or cum[-1] < 2 * step:
        return None
    n = max(3, int(cum[-1] / step))
    return np.interp(np.linspace(0.0, cum[-1], n), cum, elev), float(cum[-1])


def spike_penalty(cum: np.ndarray, elev: np.ndarray) -> float:
    """How far grades over some 100 m stray from their 250 m mean, beyond a noise floor and up to a cap, in sum."""
    grid = uniform(cum, elev, SPIKE_STEP)
    if grid is None:
        return 0.0
    x, total = grid
    step = total / (len(x) - 1)
    span = max(1, round(SPIKE_SPAN / step))
    if len(x) <= span:
        return 0.0
    grade = (x[span:] - x[:-span]) / (span * step)
    stray = np.abs(grade - moving_average(grade, max(1, round(SPIKE_WINDOW / step))))
    return float(np.clip(stray - SPIKE_FLOOR, 0.0, SPIKE_CAP).sum())


@lru_cache(maxsize=256)
def polynomials(window: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the least-squares polynomial's coefficients, powers of the places) of an odd window."""
    half = window // 2
    powers = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    return np.linalg.pinv(powers), powers


def savgol(x: np.ndarray, window: int, order: int) -> np.ndarray:
    """Least-squares polynomials over an odd window; the ends take the first and last window's polynomial."""
    half = window // 2
    fit, powers = polynomials(window, order)
    out = np.convolve(x, fit[0][::-1], mode="same")
    out[:half] = (powers @ (fit @ x[:window]))[:half]
    out[-half:] = (powers @ (fit @ x[-window:]))[-half:]
    return out


def profile(cum: np.ndarray, elev: np.ndarray) -> np.ndarray:
    """The stored profile: smoothed on a 20 m grid, the nodes' own elevations if the climb is too short."""
    grid = uniform(cum, elev, PROFILE_STEP)
    if grid is None:
        return np.asarray(elev, dtype=float)
    x, _ = grid
    window = round(PROFILE_WINDOW / PROFILE_STEP)
    window += 1 - window % 2
    window = min(window, len(x) - (1 - len(x) % 2))
    if window <= PROFILE_ORDER:
        return x
    return savgol(x, max(window, PROFILE_ORDER + 2), PROFILE_ORDER)


def passes(lat: np.ndarray, lng: np.ndarray, elev: np.ndarray, nodes: np.ndarray, ways: np.ndarray, bidirectional: bool, p):
    """((turn, lat, lng, metres, smoothed height) of the samples of a chain ridden forward and, if it may be, backward;
    the nodes' metres, nodes and ways), or nothing if the chain is too short.  A cycle begins at its lowest node."""
    if len(nodes) >= 3 and lat[0] == lat[-1] and lng[0] == lng[-1]:
        k = int(np.argmin(elev[:-1]))
        if k:
            lat, lng, elev, nodes, ways = (np.concatenate((x[k:-1], x[:k], x[k : k + 1])) for x in (lat, lng, elev, nodes, ways))
    path = along(lat, lng, p.sample_step)
    if path is None or path[2][-1] < p.min_length:
        return None
    y, x, cum = path
    node_cum = cumulative_np(lat, lng)
    heights = np.interp(cum, node_cum, elev)
    width = max(1, round(p.smooth_window / p.sample_step))
    if 1 < width < len(heights):
        heights = moving_average(heights, width)
    found = [(0, y, x, cum, heights)]
    if bidirectional:
        found.append((1, y[::-1], x[::-1], cum[-1] - cum[::-1], heights[::-1]))
    return found, node_cum, nodes, ways


def limits(p) -> tuple[float, float, float, float]:
    return p.min_length, p.min_grade, p.min_gain, p.prominence


def chain_climbs(lat: np.ndarray, lng: np.ndarray, elev: np.ndarray, nodes: np.ndarray, ways: np.ndarray, bidirectional: bool, p) -> list[dict]:
    """The climbs of one chain, forward and, if it may be ridden both ways, backward."""
    ridden = passes(lat, lng, elev, nodes, ways, bidirectional, p)
    if ridden is None:
        return []
    (found, node_cum, nodes, ways), out = ridden, []
    total = node_cum[-1]
    for turn, y, x, way, heights in found:
        for a, b in climbs(way, heights, *limits(p)):
            low, high = (way[a], way[b]) if not turn else (total - way[b], total - way[a])
            inside, direction = (node_cum >= low) & (node_cum <= high), slice(None, None, -1 if turn else 1)
            out.append({"turn": turn, "at": a, "nodes": nodes[inside][direction].tolist(), "ways": list(dict.fromkeys(ways[inside][direction].tolist())), "start_lat": float(y[a]), "start_lng": float(x[a]), "distance": float(way[b] - way[a])})
    return out


def chain_explained(lat: np.ndarray, lng: np.ndarray, elev: np.ndarray, nodes: np.ndarray, ways: np.ndarray, bidirectional: bool, p) -> list[dict]:
    """Why a chain has the climbs it has: its extrema, and each rise with the limits that it falls short of."""
    ridden, out = passes(lat, lng, elev, nodes, ways, bidirectional, p), []
    if ridden is None:
        return [{"turn": 0, "what": "chain", "a": None, "b": None, "length": None, "gain": None, "grade": None, "verdict": "skipped: shorter than the least length"}]
    for turn, _, _, way, heights in ridden[0]:
        out += [{"turn": turn, "what": kind, "a": i, "b": None, "length": float(way[i]), "gain": float(heights[i]), "grade": None, "verdict": None} for i, kind in extrema(heights, p.prominence)]
        for a, b, length, gain, short in candidates(way, heights, *limits(p)):
            out.append({"turn": turn, "what": "rise", "a": a, "b": b, "length": length, "gain": gain, "grade": gain / length, "verdict": "skipped: too little " + ", ".join(short) if short else "accepted"})
    return out


# --- many chains at once

#: Samples of chains that are worked on at once, unless one chain has more.
SAMPLES_AT_ONCE = 200_000


def running_sums(step: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums along each of many series in one array, 0 at its first place; added in order, as cumsum does."""
    out = np.zeros(len(step))
    order = np.argsort(-size, kind="stable")
    at, left = first[order], size[order]
    for k in range(1, int(size.max(initial=0))):
        at = at[: np.searchsorted(-left, -k)]
        if len(at) < 16:  # a few long ones are left
            for a, n in zip(at.tolist(), left.tolist()):
                out[a + k - 1 : a + n] = np.cumsum(np.concatenate((out[a + k - 1 : a + k], step[a + k : a + n])))
            break
        out[at + k] = out[at + k - 1] + step[at + k]
    return out


def window_means(x: np.ndarray, size: int) -> np.ndarray:
    """Means of all windows of `size` samples, with the sums in the order in which numpy's mean adds up to 128 values."""
    n = len(x) - size + 1
    if not 8 <= size <= 128:
        return np.lib.stride_tricks.sliding_window_view(x, size).mean(axis=1)
    part = lambda k: x[k : k + n]
    r = [part(k) for k in range(8)]
    for k in range(8, size - size % 8):
        r[k % 8] = r[k % 8] + part(k)
    out = ((r[0] + r[1]) + (r[2] + r[3])) + ((r[4] + r[5]) + (r[6] + r[7]))
    for k in range(size - size % 8, size):
        out += part(k)
    out /= size
    return out


def spread_out(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each of many series, one after another."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def stands_out(level: np.ndarray, first: np.ndarray, last: np.ndarray, k: np.ndarray, prominence: float) -> np.ndarray:
    """Which of the tops k among turning points stand out, as in `peaks`; first and last point of each top's series."""
    good = np.ones(len(k), dtype=bool)
    for step, end in ((-1, first), (1, last)):
        on = np.flatnonzero(good)
        at, low = k[on] + step, np.full(len(on), np.inf)
        while on.size:
            now, own = level[at], level[k[on]]
            higher = now > own
            low = np.where(higher, low, np.minimum(low, now))
            fine = own - low >= prominence
            over = higher | (at == end[on])
            good[on[over & ~fine]] = False
            go = ~(over | fine)
            on, at, low = on[go], at[go] + step, low[go]
    return good


def turned_low(lat: np.ndarray, lng: np.ndarray, elev: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    """The places of all series with cycles begun at their lowest node, if there is any such cycle."""
    end = first + size - 1
    cycles, order = np.flatnonzero((size >= 3) & (lat[first] == lat[end]) & (lng[first] == lng[end])), None
    for a, b in zip(first[cycles].tolist(), end[cycles].tolist()):
        if k := int(np.argmin(elev[a:b])):
            order = np.arange(len(lat)) if order is None else order
            order[a : b + 1] = np.concatenate((np.arange(a + k, b), np.arange(a, a + k + 1)))
    return order


def chains_climbs(size: np.ndarray, lat: np.ndarray, lng: np.ndarray, elev: np.ndarray, nodes: np.ndarray, ways: np.ndarray, bidirectional: np.ndarray, p) -> dict[str, np.ndarray]:
    """`chain_climbs` of many chains, whose nodes lie one after another, `size` of each; all values finite.

    A column for each of a climb's facts, with `chain` (which of the chains), and nodes and ways of all climbs one after
    another with `n_nodes` and `n_ways` of each."""
    first = np.cumsum(size) - size
    order = turned_low(lat, lng, elev, first[size > 0], size[size > 0])
    if order is not None:
        lat, lng, elev, nodes, ways = (x[order] for x in (lat, lng, elev, nodes, ways))
    step, turn = np.zeros(len(lat)), np.zeros(len(lat))
    if len(lat) > 1:
        step[1:], turn[1:] = inverse_np(lat[:-1], lng[:-1], lat[1:], lng[1:])
    step[first[size > 0]] = 0.0
    cum = running_sums(step, first, size)
    parts = np.maximum(1, np.floor(step / p.sample_step)).astype(np.int64)
    count = np.where(step > 0, parts, 0)
    count[first[size > 0]] = 1
    total = np.zeros(len(size))
    total[size > 0] = cum[(first + size - 1)[size > 0]]
    used = np.flatnonzero((size >= 2) & (total > 0) & (total >= p.min_length))
    before = np.concatenate(([0], np.cumsum(count)))
    samples = before[first + size] - before[first]
    used = used[samples[used] >= 3]
    found, bounds = [], np.cumsum(samples[used])
    while used.size:
        n = max(1, int(np.searchsorted(bounds, SAMPLES_AT_ONCE, side="right")))
        own = used[:n]
        place = spread_out(first[own], size[own])
        found.append({"chain": own, "place": place} | rises(size[own], *(x[place] for x in (lat, lng, elev, step, turn, cum, parts, count)), bidirectional[own], p))
        used, bounds = used[n:], bounds[n:] - bounds[n - 1]
    out = {c: np.concatenate([x[c] for x in found]) if found else np.zeros(0, kind) for c, kind in RISE.items()}
    low = np.concatenate([x["place"][x["low"]] for x in found]) if found else np.zeros(0, np.int64)
    out["chain"] = np.concatenate([x["chain"][x["chain_"]] for x in found]) if found else np.zeros(0, np.int64)
    n = out["n_nodes"]
    place, climb = spread_out(low, n), np.repeat(np.arange(len(n)), n)
    back = out["turn"][climb] == 1
    mirrored = np.repeat(2 * (np.cumsum(n) - n) + n - 1, n) - np.arange(len(climb))
    place = np.where(back, place[mirrored], place)
    out["nodes"], own = nodes[place], ways[place]
    # A climb's ways, each where it comes first.
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (climb[1:] != climb[:-1]))[: len(own)])
    own, climb = own[new], climb[new]
    order = np.lexsort((own, climb))
    again = order[1:][(own[order[1:]] == own[order[:-1]]) & (climb[order[1:]] == climb[order[:-1]])]
    keep = np.ones(len(own), dtype=bool)
    keep[again] = False
    return out | {"ways": own[keep], "n_ways": np.bincount(climb[keep], minlength=len(n)).astype(np.int64)}


#: The columns of `rises` that are the climbs' own.
RISE = {"turn": np.int64, "at": np.int64, "n_nodes": np.int64, "start_lat": float, "start_lng": float, "distance": float}


def rises(size, lat, lng, elev, step, turn, cum, parts, count, bidirectional, p) -> dict[str, np.ndarray]:
    """Climbs of chains of at least three samples: chain_ (which), low (its first node in riding uphill of the lower
    place in the arrays) and the columns RISE."""
    first = np.cumsum(size) - size
    last = first + size - 1
    is_first = np.zeros(len(cum), dtype=bool)
    is_first[first] = True
    n = np.add.reduceat(count, first)
    s0 = np.cumsum(n) - n  # a chain's first sample
    s1 = s0 + n - 1
    # Of each sample: the node at its segment's end, and how many of the segment's equal parts lie before it.
    seg = np.repeat(np.arange(len(cum)), count)
    k = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count) + 1
    before = np.where(is_first, 0.0, np.append(0.0, cum[:-1]))
    whole = parts[seg] == k
    x = before[seg] + step[seg] * (k / parts[seg])
    # Nodes of one place (no metre on) count as the last of them.
    change = np.append(True, (cum[1:] != cum[:-1]) | is_first[1:])
    same_first = np.maximum.accumulate(np.where(change, np.arange(len(cum)), 0))
    change = np.append(change[1:], True)
    same_last = np.minimum.accumulate(np.where(change, np.arange(len(cum)), len(cum))[::-1])[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.append(0.0, np.diff(elev)) / np.append(0.0, np.diff(cum))
    height = np.where(whole, elev[same_last[seg]], slope[seg] * (x - before[seg]) + elev[seg - 1])
    width = max(1, round(p.smooth_window / p.sample_step))
    if width > 1 and (n > width).any():
        padded = np.clip(spread_out(s0 - width // 2, n + width - 1), np.repeat(s0, n + width - 1), np.repeat(s1, n + width - 1))
        means = window_means(height[padded], width)[spread_out(s0 + np.arange(len(n)) * (width - 1), n)]
        height = means if (n > width).all() else np.where(np.repeat(n > width, n), means, height)
    # Runs of equal samples, and of these both ends and the turning points.
    at_first = np.zeros(len(height), dtype=bool)
    at_first[s0] = True
    begin = np.flatnonzero(np.append(True, height[1:] != height[:-1]) | at_first)
    end = np.append(begin[1:], len(height)) - 1
    level, lead = height[begin], at_first[begin]
    tail = np.append(lead[1:], True)
    up = np.append(False, level[1:] > level[:-1]) & ~lead
    down_next = np.append(level[1:] < level[:-1], False) & ~tail
    inner = ~lead & ~tail
    point = np.flatnonzero(lead | tail | (inner & (up == down_next)))
    top = (inner & up & down_next)[point]
    bottom = inner[point] & ~top
    level, lead, tail, begin, end = level[point], lead[point], tail[point], begin[point], end[point]
    series = np.cumsum(lead) - 1
    lead_at, tail_at = np.flatnonzero(lead), np.flatnonzero(tail)
    keep = lead | tail
    for kind, sign in ((top, 1.0), (bottom, -1.0)):
        which = np.flatnonzero(kind)
        keep[which] = stands_out(sign * level, lead_at[series[which]], tail_at[series[which]], which, p.prominence)
    keep &= ~(lead & tail)
    level, lead, tail, begin, end, top, series = (v[keep] for v in (level, lead, tail, begin, end, top, series))
    if len(level) < 2:
        level, lead, tail, begin, end, top, series = (v[:0] for v in (level, lead, tail, begin, end, top, series))
    # Kinds: an end that isn't higher than its neighbour is a trough; of two ends alone that are level nothing rises.
    low_first = np.append(level[:-1] <= level[1:], True)
    low_last = np.append(True, level[1:] <= level[:-1])
    low = np.where(lead, low_first, np.where(tail, low_last, ~top))
    middle = (begin + end) // 2
    place = np.where(lead, s0[series], np.where(tail, s1[series], middle))
    turned = np.where(lead | tail, place, s1[series] - (s1[series] - end + s1[series] - begin) // 2)
    pair = ~tail[:-1] if len(tail) else tail
    out = []
    for back in (0, 1):
        i = np.flatnonzero(pair & (low[1:] & ~low[:-1] & bidirectional[series[1:]] if back else low[:-1] & ~low[1:]))
        a, b = (turned[i + 1], turned[i]) if back else (place[i], place[i + 1])
        own = series[i]
        end_x = x[s1[own]]
        ridden = lambda v: end_x - x[v] if back else x[v]  # noqa: B023, E731
        from_, to = ridden(a), ridden(b)
        length, gain = to - from_, height[b] - height[a]
        with np.errstate(divide="ignore", invalid="ignore"):
            good = (length > 0) & (gain > 0) & ~((length < p.min_length) | (gain / length < p.min_grade) | (gain < p.min_gain))
        a, b, own, from_, to = (v[good] for v in (a, b, own, from_, to))
        total = cum[last[own]]
        least, most = (total - to, total - from_) if back else (from_, to)
        l, r = (b, a) if back else (a, b)  # noqa: E741
        l, r = same_first[seg[l]], np.where(whole[r], same_last[seg[r]], seg[r] - 1)  # noqa: E741
        l, r = nearest(cum, l, first[own], last[own], least, most, r)  # noqa: E741
        begun = seg[a]
        lat_a, lng_a = lat[begun], lng[begun]
        moved = ~is_first[begun]
        from_node = begun[moved] - 1
        lat_a[moved], lng_a[moved] = direct_np(lat[from_node], lng[from_node], turn[begun[moved]], step[begun[moved]] * (k[a][moved] / parts[begun[moved]]))
        out.append({"chain_": own, "turn": np.full(len(own), back), "at": s1[own] - a if back else a - s0[own], "low": np.minimum(l, len(cum) - 1), "n_nodes": np.maximum(0, r - l + 1), "start_lat": lat_a, "start_lng": lng_a, "distance": to - from_})
    return {c: np.concatenate([v[c] for v in out]) for c in out[0]}


def nearest(cum, low, first, last, least, most, high) -> tuple[np.ndarray, np.ndarray]:
    """The first and last nodes with least <= cum <= most in each series, from places that are right but for rounding."""
    while (less := (low > first) & (cum[np.maximum(low - 1, 0)] >= least)).any():
        low = low - less
    while (more := (low <= last) & (cum[np.minimum(low, last)] < least)).any():
        low = low + more
    while (more := (high < last) & (cum[np.minimum(high + 1, last)] <= most)).any():
        high = high + more
    while (less := (high >= first) & (cum[np.maximum(high, first)] > most)).any():
        high = high - less
    return low, high
