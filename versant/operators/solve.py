"""Order-preserving alignment of one recording's segments with its reference units.

Plain functions over the rows of one recording; ``align`` runs them for each
recording in a grouped Arrow stage.  A recording is the unit of work: its rows
are ordered and depend on one another, and different recordings never meet.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import lru_cache, partial

import numpy as np

from ..functions.costs import BLANK_COST, LOW_SIMILARITY, segment_cost_of, span_cost_of
from ..functions.similarity import as_integer, code_points, common_row, indel_ratio, letter_places, packed_places, phonetic_text
from ..functions.text import BASMALA, ISTIADHA, LETTER_FORMS

_FOLD = str.maketrans(*LETTER_FORMS)
_DROP = re.compile("[ً-ٰٟ]|[^\\w\\s]")

#: Texts are long, so few are remembered, and none beyond a recording (``forget``).
_REMEMBERED = 4096
#: Bytes of runs that are compared with a unit at once, and of the places of their letters.
_BLOCK, _PLACES = 1 << 15, 1 << 24
_SPACE = code_points(" ")


@dataclass(frozen=True)
class Segment:
    text: str
    start: float
    end: float
    kind: str = "ayah"
    id: int = 1
    group: int = 1
    words: tuple = ()


@dataclass(frozen=True)
class Unit:
    number: int
    text: str
    group: int = 1


@dataclass(frozen=True)
class Row:
    """An aligned unit: its time, the text found for it, how alike that is, and the segments [first, last)."""

    unit: Unit
    start: float
    end: float
    text: str
    score: float
    overlap: bool = False
    first: int = -1
    last: int = -1
    words: tuple = ()
    source: str = "dp"

    @property
    def duration(self) -> float:
        return self.end - self.start


@lru_cache(maxsize=_REMEMBERED)
def plain(text: str) -> str:
    return " ".join(_DROP.sub("", text.translate(_FOLD)).split())


@lru_cache(maxsize=_REMEMBERED)
def likeness(a: str, b: str) -> float:
    return indel_ratio(plain(a), plain(b))


def n_words(text: str) -> int:
    """Of a unit or a short text, which is remembered."""
    return len(plain(text).split())


def pair_overlap(a: str, b: str) -> float:
    """Jaccard similarity of the letter pairs of two plain texts; 0 where one has none."""
    x, y = ({t[i : i + 2] for i in range(len(t) - 1)} for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def coverage(text: str, unit: str) -> float:
    return n_words(text) / n_words(unit) if n_words(unit) else 0.0


@lru_cache(maxsize=_REMEMBERED)
def cost(text: str, unit: str) -> float:
    if not text.strip() or not unit.strip():
        return segment_cost_of(0.0, 0.0, True)
    return segment_cost_of(likeness(text, unit), coverage(text, unit), False)


def special_type(segment: Segment) -> str | None:
    if segment.kind in ("istiadha", "basmala", "basmalah"):
        return segment.kind.removesuffix("h") if segment.kind != "istiadha" else "istiadha"
    text = plain(segment.text)
    return "basmala" if re.search(BASMALA, text) else "istiadha" if re.search(ISTIADHA, text) else None


def without_formulas(segments: list[Segment], units: list[Unit]) -> list[Segment]:
    """Opening formulas go, unless they are part of group 1's text or nothing else is left."""
    gone = {"istiadha"} if units and units[0].group == 1 else {"istiadha", "basmala"}
    return [s for s in segments if s.kind not in gone] or segments


def joined(segments: list[Segment], first: int, last: int) -> str:
    return " ".join(s.text for s in segments[first:last])


def cheapest_runs(n: int, m: int, most: int, price: Callable[[int, int, int], float]) -> list[tuple[int, int]]:
    """Cuts items 0..n into a run of 1 to ``most`` for each of m units, from item 0 on, at the least
    total price(first, last, unit); items behind the last run may be left over.  Of equal totals the
    shorter last run and the earlier end win.  With fewer items than units: as many units as can be."""
    layers: list[dict[int, tuple[float, int]]] = [{0: (0.0, 0)}]
    for unit in range(m):
        layer: dict[int, tuple[float, int]] = {}
        for last in range(unit + 1, n + 1):
            options = ((layers[-1][first][0] + price(first, last, unit), last - first, first) for first in range(max(unit, last - most), last) if first in layers[-1])
            if best := min(options, default=None):
                layer[last] = best[0], best[2]
        if not layer:
            break
        layers.append(layer)
    end = min(layers[-1], key=lambda i: (layers[-1][i][0], i)) if len(layers) == m + 1 else max(layers[-1])
    runs = []
    for layer in layers[:0:-1]:
        runs.append((layer[end][1], end))
        end = layer[end][1]
    return runs[::-1]


def forget() -> None:
    """Lets go of the texts of a recording that is done."""
    for f in (plain, likeness, cost):
        f.cache_clear()


def _blocks(bare: list[str], most: int, letters: set[str]) -> Iterable[tuple[int, int, dict[str, int], int, np.ndarray, np.ndarray, int]]:
    """Items cut into blocks: the items [a, b) at which runs begin, and the runs' letters side by side in one
    integer.  Each item begins on a byte, padded with places that no letter has, so a run's first items are its
    first bytes; a byte lies between runs.  Places, all places, for each run the byte where it begins and those
    where its 1 to ``most`` items end, and the bytes in all."""
    limit = max(1, min(_BLOCK, _PLACES // max(len(letters), 1)))
    kinds = [code_points(t) for t in bare]
    a = 0
    while a < len(bare):
        codes, places, starts, ends, used, at, b = [], [], [], [], [], 0, a
        while b < len(bare) and (b == a or at < limit):
            begun, reached = at, []
            for k in range(b, b + most):
                if k < len(bare) and bare[k]:
                    gap = at > begun  # a space before each but the first
                    if gap:
                        codes.append(_SPACE)
                        places.append(np.array([8 * at]))
                    codes.append(kinds[k])
                    places.append(np.arange(8 * at + gap, 8 * at + gap + len(bare[k])))
                    at += (len(bare[k]) + gap + 7) // 8
                reached.append(at)
            starts.append(begun)
            ends.append(reached)
            used.append((8 * begun, 8 * at))
            at += 1
            b += 1
        full = np.zeros(8 * at, dtype=bool)
        for x, y in used:
            full[x:y] = True
        where = packed_places(np.concatenate(codes), np.concatenate(places), at, letters) if codes else {}
        yield a, b, where, as_integer(full), np.array(starts), np.array(ends), at
        a = b


def cheapest_text_runs(texts: list[str], units: list[str], most: int, spared: np.ndarray | None = None) -> list[tuple[int, int]]:
    """``cheapest_runs`` of texts, joined, for units at their ``cost``, less ``spared`` by the run's end.

    Runs of a block are compared with a unit at once, and a run's shorter ones on the way.  What is kept for each
    item and unit is a run's length; all else is a block's."""
    n, m = len(texts), min(len(texts), len(units))
    bare, wanted = [plain.__wrapped__(t) for t in texts], [plain.__wrapped__(u) for u in units[:m]]
    empty = np.array([not t.strip() for t in texts])
    sizes, counts = np.array([len(t) for t in bare]), np.array([len(t.split()) for t in bare])
    back = np.zeros((m, n + 1), dtype=np.uint8 if most < 256 else np.uint32)
    layers, last_layer = np.full((m + 1, most + 1), np.inf), np.full(n + 1, np.inf)
    layers[0, 0] = 0.0
    steps = np.arange(1, most + 1)
    for a, b, where, full, starts, ends, n_bytes in _blocks(bare, most, set().union(*wanted)):
        layers = np.concatenate([layers, np.full((m + 1, b - a), np.inf)], axis=1)  # items a to b + most
        lasts = np.minimum(np.arange(a, b)[:, None] + steps, n)
        firsts = np.arange(a, b)[:, None]
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        filled = upto(sizes > 0)[lasts] - upto(sizes > 0)[firsts]
        length = upto(sizes)[lasts] - upto(sizes)[firsts] + np.maximum(filled - 1, 0)
        words = upto(counts)[lasts] - upto(counts)[firsts]
        blank = upto(~empty)[lasts] == upto(~empty)[firsts]
        beyond = np.arange(a, b)[:, None] + steps > n
        for j in range(m):
            # a run of unit j begins behind j items at least and j runs at most
            if j >= b or j * most < a:
                continue
            row = common_row(full, where, full, wanted[j])
            ones = upto(np.bitwise_count(np.frombuffer(row.to_bytes(n_bytes, "little"), dtype=np.uint8)).astype(np.int64))
            common = 8 * (ends - starts[:, None]) - (ones[ends] - ones[starts][:, None])
            total = length + len(wanted[j])
            s = np.where(total == 0, 1.0, 2 * common / np.maximum(total, 1))
            n_wanted = len(wanted[j].split())
            cover = words / n_wanted if n_wanted else np.zeros(words.shape)
            price = 1.0 - s
            price = price + np.where(cover < 0.7, (0.7 - cover) * 0.5, np.where(cover > 1.3, (cover - 1.3) * 0.3, 0.0))
            price = np.maximum(0.0, price + np.where(s < LOW_SIMILARITY, 0.5 * (LOW_SIMILARITY - s) / LOW_SIMILARITY, 0.0))
            price[blank if units[j].strip() else np.full(blank.shape, True)] = BLANK_COST
            if spared is not None:
                price = price - spared[lasts]
            price[beyond] = np.inf
            sums = layers[j, : b - a][:, None] + price
            for k in range(most, 0, -1):  # of equal totals the shorter run stays
                new, old = sums[:, k - 1], layers[j + 1, k : k + b - a]
                less = (new <= old) & np.isfinite(new)
                old[less] = new[less]
                back[j, a + k : b + k][less[: max(0, n + 1 - a - k)]] = k
        last_layer[a:b] = layers[m, : b - a]
        layers = layers[:, b - a :]
    last_layer[n] = layers[m, 0]
    end, runs = int(np.argmin(last_layer)) if m == len(units) else int(np.flatnonzero(np.isfinite(last_layer))[-1]), []
    for j in range(m - 1, -1, -1):
        runs.append((end - int(back[j, end]), end))
        end = runs[-1][0]
    return runs[::-1]


def row_of(segments: list[Segment], unit: Unit, first: int, last: int, source: str = "dp") -> Row:
    text = joined(segments, first, last)
    return Row(unit, segments[first].start, segments[last - 1].end, text, likeness(text, unit.text), False, first, last, tuple(w for s in segments[first:last] for w in s.words), source)


def align_plain(segments: list[Segment], units: list[Unit], most: int = 14) -> list[Row]:
    """Dynamic programming alone."""
    segments = without_formulas(segments, units)
    if not segments or not units:
        return []
    runs = cheapest_text_runs([s.text for s in segments], [u.text for u in units], most)
    return [row_of(segments, units[j], a, b) for j, (a, b) in enumerate(runs)]


def align_dp(segments: list[Segment], units: list[Unit], silences: Iterable[tuple[float, float]] = (), most: int = 8) -> list[Row]:
    """Dynamic programming, then recovery of runs of low scores; blocks where segments are too few."""
    segments = without_formulas(segments, units)
    if not segments or not units:
        return []
    if len(segments) < len(units):
        return align_blocks(segments, units)
    return recover_cascades(segments, align_plain(segments, units, most), list(silences))


def align_blocks(segments: list[Segment], units: list[Unit], window: int = 4, accept: float = 0.35) -> list[Row]:
    """Blocks of up to ``window`` segments for up to ``window`` units, best first; a segment that starts
    no acceptable block is passed over.  A block's time is dealt to its units by their words."""
    rows: list[Row] = []
    s = u = 0
    while s < len(segments) and u < len(units):
        options = [(likeness(joined(segments, s, s + a), " ".join(x.text for x in units[u : u + b])) - (0.05 if a > 1 and b > 1 else 0.0), -a, -b)
                   for a in range(1, min(window, len(segments) - s) + 1) for b in range(1, min(window, len(units) - u) + 1)]
        score, a, b = max(options)
        if score <= accept:
            s += 1
            continue
        a, b = -a, -b
        block, start, end = units[u : u + b], segments[s].start, segments[s + a - 1].end
        sizes = [len(x.text.split()) for x in block]
        shares = [n / sum(sizes) if sum(sizes) else 1 / b for n in sizes]
        text = joined(segments, s, s + a) if b == 1 else f"[{a} segs -> {b} ayahs]"
        at = start
        for unit, share in zip(block, shares):
            until = at + share * (end - start)
            rows.append(Row(unit, round(at, 2), round(until, 2), text, score, a > 1 or b > 1, s, s + a, tuple(w for x in segments[s : s + a] for w in x.words)))
            at = until
        s, u = s + a, u + b
    return rows


def append_without_overlap(first: str, second: str) -> tuple[str, bool]:
    """The second text's words that the first has not used up, behind the first."""
    left, kept = Counter(plain.__wrapped__(first).split()), []
    for word in second.split():
        if left[plain(word)] > 0:
            left[plain(word)] -= 1
        else:
            kept.append(word)
    return " ".join([first.strip(), *kept]), len(kept) < len(second.split()) or not kept


def buffered(start: float, end: float, silences: list[tuple[float, float]], before: float | None, after: float | None, buffer: float) -> tuple[float, float]:
    """Start and end with their share of the gaps to the neighbours, or else of the silences beside them."""
    new_start, new_end = start, end
    share = lambda gap: min(gap, 0.1) if gap <= 0.3 else 0.2 if gap >= 0.4 else gap / 2
    if before is not None and start > before:
        new_start = start - share(start - before)
    elif quiet := max((s for s in silences if s[1] <= start), key=lambda s: s[1], default=None):
        reach = start - min(buffer, start - quiet[0])
        new_start = reach if before is None or reach >= before else start
    if after is not None and after > end:
        new_end = after - share(after - end)
    elif quiet := min((s for s in silences if s[0] >= end), key=lambda s: s[0], default=None):
        reach = end + min(buffer, quiet[1] - end)
        new_end = reach if after is None or reach <= after else end
    return new_start, new_end


def align_greedy(segments: list[Segment], units: list[Unit], silences: Iterable[tuple[float, float]] = (), similarity: float = 0.6, cover: float = 0.7, buffer: float = 0.3, required: dict[tuple[int, int], list[str]] | None = None, merge_tail: bool = False) -> list[Row]:
    """One pass: a unit takes segments until its last words are reached or the next unit's first words come.

    ``required``: (group, unit index) -> tokens without which a unit takes one more segment.
    ``merge_tail`` lets the last unit take segments as the others do.
    """
    rows, silences, i, ended = [], sorted(silences), 0, None
    ends = lambda a, b, n: indel_ratio(" ".join(a[-n:]), " ".join(b[-n:]))
    begins = lambda a, b, n: indel_ratio(" ".join(a[:n]), " ".join(b[:n]))
    while i < len(segments) and len(rows) < len(units):
        kind = special_type(segments[i])
        if kind == "istiadha" or (kind == "basmala" and segments[i].group != 1) or (kind is None and segments[i].id == 0):
            i += 1
            continue
        unit, following = units[len(rows)], units[len(rows) + 1] if len(rows) + 1 < len(units) else None
        first, text, overlap, words = i, segments[i].text, False, list(segments[i].words)
        wanted = plain(unit.text).split()
        n = min(max(len(wanted), 1), 3)
        needed = (required or {}).get((unit.group, len(rows)), [])
        after = None
        while True:
            ahead = segments[i + 1] if i + 1 < len(segments) else None
            bare = plain.__wrapped__(text)  # it grows, so it isn't kept
            forced = ahead is not None and not all(t in bare for t in needed)
            if not forced:
                taken = bare.split()
                covered = len(taken) / len(wanted) if wanted else 0.0
                ended_here = ends(taken, wanted, n) >= similarity
                if ended_here and covered >= cover:
                    break
                if ahead is None or (following is None and not merge_tail):
                    break
                if following is not None:
                    first_words = plain(following.text).split()
                    k = min(max(len(first_words), 1), 3)
                    if begins(plain(ahead.text).split(), first_words, k) > similarity and (ended_here or covered >= 0.9):
                        after = ahead.start
                        break
            text, found = append_without_overlap(text, ahead.text)
            overlap |= found
            if not forced:
                words += ahead.words
            i += 1
        end = segments[i].end
        start, until = buffered(segments[first].start, end, silences, ended, after, buffer)
        rows.append(Row(unit, start, until, text, likeness(text, unit.text), overlap, first, i + 1, tuple(words), "greedy"))
        ended = end
        i += 1
    return rows


def runs_below(scores: list[float], bar: float, least: int) -> list[tuple[int, int]]:
    found, start = [], None
    for i, low in enumerate([*(s < bar for s in scores), False]):
        if low and start is None:
            start = i
        elif not low and start is not None:
            if i - start >= least:
                found.append((start, i))
            start = None
    return found


def recover_cascades(segments: list[Segment], rows: list[Row], silences: list[tuple[float, float]], bar: float = 0.7, least: int = 2) -> list[Row]:
    """Aligns runs of low scores anew with one row of context, favouring ends at silences; kept only if
    no good row loses and the run gains."""
    rows = list(rows)
    for a, b in reversed(runs_below([r.score for r in rows], bar, least)):
        a, b = max(0, a - 1), min(len(rows), b + 1)
        old = rows[a:b]
        t0, t1 = old[0].start, old[-1].end
        inside = [i for i, s in enumerate(segments) if s.start >= t0 - 0.5 and s.end <= t1 + 0.5]
        if not inside:
            continue
        base = inside[0]
        part, units = segments[base : inside[-1] + 1], [r.unit for r in old]
        if len(part) < len(units):
            continue
        starts = [s for s, _ in silences if t0 <= s <= t1]
        quiet = np.array([0.0, *(0.15 if any(abs(s.end - q) < 0.3 for q in starts) else 0.0 for s in part)])
        runs = cheapest_text_runs([s.text for s in part], [u.text for u in units], min(6, len(part)), quiet)
        if len(runs) < len(units):
            continue
        new = [row_of(part, u, x, y) for u, (x, y) in zip(units, runs)]
        loses = any((o.score >= 0.75 and (o.score - n.score > 0.08 or n.score < 0.7)) or (o.score >= 0.5 and o.score - n.score > 0.12) for o, n in zip(old, new))
        # the mean leaves out one row on either side, also where there is no context
        inner = slice(1, len(old) - 1) if len(old) > 2 else slice(1, len(old))
        size = len(old[inner])
        if loses or not size or sum(n.score for n in new[inner]) / size <= sum(o.score for o in old[inner]) / size + 0.08:
            continue
        rows[a:b] = [replace(n, first=n.first + base, last=n.last + base, source="cascade") for n in new]
    return rows


def silence_parts(segments: list[Segment], start: float, end: float, silences: list[tuple[float, float]], least: float = 0.2) -> list[Segment]:
    """Segments of a window cut at the silences within them; words go with their share of the time."""
    cuts = [((max(s, start) + min(e, end)) / 2) for s, e in sorted(silences) if min(e, end) - max(s, start) >= least]
    out = []
    for s in segments:
        if s.start < start - 0.5 or s.end > end + 0.5:
            continue
        edges = [s.start, *(c for c in cuts if s.start < c < s.end), s.end]
        words = s.text.split()
        places = [round(len(words) * (t - s.start) / (s.end - s.start)) if s.end > s.start else len(words) for t in edges]
        out += [replace(s, text=" ".join(words[i:j]), start=x, end=y) for i, j, x, y in zip(places, places[1:], edges, edges[1:]) if j > i]
    return out


def align_hybrid(segments: list[Segment], units: list[Unit], silences: Iterable[tuple[float, float]] = (), quality: float = 0.85, long_words: int = 30, long_seconds: float = 30.0) -> list[Row]:
    """For each unit the dynamic program's row if it is good, else the best of it, its text put together
    anew from the parts between silences (long units only), and the greedy row; the first wins ties."""
    silences = list(silences)
    dp, greedy = align_dp(segments, units, silences), align_greedy(segments, units, silences)
    if not dp:
        return greedy
    other = {r.unit.number: r for r in greedy}
    out = []
    for row in dp:
        options = [row]
        if row.score < quality:
            if len(row.unit.text.split()) > long_words or row.duration > long_seconds:
                text = " ".join(p.text for p in silence_parts(segments, row.start, row.end, silences))
                if text and likeness(text, row.unit.text) > row.score + 0.05:
                    options.append(replace(row, text=text, score=likeness(text, row.unit.text), source="split"))
            if row.unit.number in other:
                options.append(other[row.unit.number])
        out.append(max(options, key=lambda r: r.score))
    return out


def zone_bars(row: Row, base: float, adaptive: bool) -> float:
    size = n_words(row.unit.text)
    return base if not adaptive else 0.60 if size < 5 else 0.75 if size <= 15 else base


def realign_zones(segments: list[Segment], rows: list[Row], quality: float = 0.85, least: int = 3, adaptive: bool = False, buffers: tuple[float, ...] = (10.0, 30.0)) -> list[Row]:
    """Aligns zones of low scores anew within their time; keeps what is strictly better, unit by unit."""
    rows = sorted(rows, key=lambda r: r.unit.number)
    low = [-1.0 if r.score < zone_bars(r, quality, adaptive) else 1.0 for r in rows]
    for a, b in runs_below(low, 0.0, least):
        part: list[Segment] = []
        for reach in buffers:
            part = [s for s in segments if s.start >= rows[a].start - reach and s.end <= rows[b - 1].end + reach]
            if len(part) >= b - a:
                break
        better = {r.unit.number: r for r in align_plain(part, [r.unit for r in rows[a:b]])}
        rows[a:b] = [replace(n, source="zone") if (n := better.get(r.unit.number)) and n.score > r.score else r for r in rows[a:b]]
    return rows


def realign_iterated(segments: list[Segment], rows: list[Row], quality: float = 0.85) -> list[Row]:
    for less, least in ((0.0, 3), (0.1, 5), (0.2, 6)):
        bar = max(0.5, quality - less)
        if not runs_below([-1.0 if r.score < zone_bars(r, bar, True) else 1.0 for r in rows], 0.0, least):
            break
        rows = realign_zones(segments, rows, bar, least, adaptive=True)
    return rows


def anchor_places(rows: list[Row], bar: float = 0.95, slowest: float = 0.8, fastest: float = 2.0) -> list[int]:
    out = []
    for i, r in enumerate(rows):
        rate = len(r.unit.text.split()) / r.duration if r.duration > 0 else 0.0
        sound = r.score >= bar and slowest <= rate <= fastest
        if sound and len(rows) > 2:
            sound = (i == 0 or (rows[i - 1].score >= 0.5 and rows[i - 1].end <= r.start + 1.0)) and (i + 1 == len(rows) or (rows[i + 1].score >= 0.5 and rows[i + 1].start >= r.end - 1.0))
        if sound:
            out.append(i)
    return out


def realign_between_anchors(segments: list[Segment], rows: list[Row], least: int = 3) -> list[Row]:
    """Aligns the rows between two anchors, and behind the last, within the time between them."""
    rows, found = list(rows), anchor_places(rows)
    if len(found) < 2:
        return rows
    for a, b in zip(found, [*found[1:], len(rows)]):
        if b - a - 1 < least:
            continue
        t0, t1 = rows[a].end - 5.0, (rows[b].start if b < len(rows) else rows[-1].end) + 5.0
        part = [s for s in segments if s.start >= t0 and s.end <= t1]
        if len(part) < b - a - 1:
            continue
        better = {r.unit.number: r for r in align_plain(part, [r.unit for r in rows[a + 1 : b]])}
        rows[a + 1 : b] = [replace(n, source="anchor") if (n := better.get(r.unit.number)) and n.score > r.score + 0.01 else r for r in rows[a + 1 : b]]
    return rows


@dataclass
class Word:
    text: str
    start: float
    end: float
    plain: str = field(init=False)

    def __post_init__(self):
        self.plain = plain(self.text)


def word_stream(segments: list[Segment]) -> list[Word]:
    """Words with their times; where a segment has none, its time is dealt by letters."""
    out = []
    for s in segments:
        if s.words:
            out += [Word(w[0], w[1], w[2]) for w in s.words]
            continue
        parts = s.text.split()
        total, at = sum(map(len, parts)), 0
        for p in parts:
            span = s.end - s.start
            out.append(Word(p, s.start + span * at / total, s.start + span * (at + len(p)) / total))
            at += len(p)
    return [w for w in out if w.plain]


def align_words(words: list[Word], units: list[Unit], silences: Iterable[tuple[float, float]] = (), ratio: float = 3.0, beam: int = 50) -> list[Row]:
    """Runs of words for units by beam search: a unit of r words takes between 0.3 r and ``ratio`` r words
    near the place where its share of the stream would be.  No rows where that leaves a unit without words."""
    if not words or not units:
        return []
    bare = [plain.__wrapped__(u.text) for u in units]
    n_wanted, wanted = [len(t.split()) for t in bare], [set(t.split()) for t in bare]
    sizes = [max(n, 1) for n in n_wanted]
    places = [letter_places(t) for t in bare]
    where, full = [p[0] for p in places], [p[1] for p in places]
    pace = (words[-1].end - words[0].start) / len(words)
    scale, silences = len(words) / sum(sizes), list(silences)
    bonus = [0.0] * (len(words) + 1)
    for i in range(1, len(words)):
        a, b = words[i - 1].end, words[i].start
        bonus[i] = 0.05 if b - a < 0.05 else -0.15 if any(s < b and e > a for s, e in silences) else 0.05

    def fit_around(first: int, last: int, j: int) -> float:
        """How well the words before and after a span go with the units before and after, as far as there are any."""
        sides = []
        if j and first >= 2:
            sides.append((words[max(0, first - sizes[j]) : first], bare[j - 1]))
        if j + 1 < len(units) and last + 2 <= len(words):
            sides.append((words[last : last + sizes[j + 1]], bare[j + 1]))
        fits = [pair_overlap(text, unit) for span, unit in sides if (text := " ".join(w.plain for w in span))]
        return sum(fits) / len(fits) if fits else 0.0

    def prices(first: int, j: int) -> Callable[[int], float]:
        """The price of a span of words from ``first`` on by its end; ends are asked for in rising order, and what a
        span shares with the one before is not counted anew."""
        mine: set[str] = set()
        shared = n_mine = length = 0
        at = compared = first
        row, begun = full[j], False

        def price(last: int) -> float:
            nonlocal shared, n_mine, length, at, compared, row, begun
            for w in words[at:last]:
                if w.plain not in mine:
                    mine.add(w.plain)
                    shared += w.plain in wanted[j]
                if w.plain:
                    length += len(w.plain) + (length > 0)
                    n_mine += len(w.plain.split())
            at = last
            if not shared or shared / (len(mine) + len(wanted[j]) - shared) < 0.15:
                return 1.5
            for w in words[compared:last]:
                if w.plain:
                    row = common_row(row, where[j], full[j], f" {w.plain}" if begun else w.plain)
                    begun = True
            compared = last
            s = 2 * (len(bare[j]) - row.bit_count()) / (length + len(bare[j]))
            phonetic = phonetic_text(" ".join(w.plain for w in words[first:last]), bare[j]) if 0.4 <= s <= 0.85 else 0.0
            found = span_cost_of(s, phonetic, n_mine / n_wanted[j] if n_wanted[j] else 0.0, (last - first) / sizes[j], words[last - 1].end - words[first].start, sizes[j] * pace)
            found += bonus[last]
            # short units repeat, so their surroundings count too
            return max(0.0, found - 0.35 * fit_around(first, last, j)) if sizes[j] <= 8 and found < 1.0 else found

        return price

    states: dict[int, float] = {0: 0.0}
    came: list[dict[int, int]] = []
    before = 0
    for j, size in enumerate(sizes):
        low, high = max(1, int(0.3 * size)), max(int(ratio * size), 3)
        before += size
        middle, slack = int(before * scale), max(int(0.05 * len(words)), 2 * high)
        # one word at least stays for each unit that follows
        first_end, last_end = max(j + 1, middle - slack), min(len(words) - (len(units) - j - 1) + 1, middle + slack, len(words))
        fresh: dict[int, float] = {}
        back: dict[int, int] = {}
        for at, total in states.items():
            price = prices(at, j)
            for last in range(max(at + low, first_end), min(at + high, last_end) + 1):
                if last in fresh and total >= fresh[last]:
                    continue
                new = total + price(last)
                if last not in fresh or new < fresh[last]:
                    fresh[last], back[last] = new, at
        if not fresh:
            return []
        ranked = sorted(fresh.items(), key=lambda x: (x[1], x[0]))
        near = sum(v < ranked[0][1] * 1.2 + 0.1 for _, v in ranked)
        states = dict(ranked[: 3 * beam if near > 0.6 * beam else beam])
        came.append(back)
    at = min(states, key=lambda x: (states[x], x))
    path = []
    for back in reversed(came):
        path.append((back[at], at))
        at = back[at]
    path.reverse()
    out = []
    for unit, (a, b) in zip(units, path):
        text = " ".join(w.text for w in words[a:b])
        out.append(Row(unit, round(words[a].start, 3), round(words[b - 1].end, 3), text, round(likeness(text, unit.text), 4), False, a, b, tuple((w.text, w.start, w.end) for w in words[a:b]), "words"))
    return out


def align_words_in_chunks(words: list[Word], units: list[Unit], silences: Iterable[tuple[float, float]] = (), size: int = 60, shared: int = 10) -> list[Row]:
    """Chunks of units that overlap, each with its share of the words; a unit keeps its better row."""
    counts = [max(n_words(u.text), 1) for u in units]
    total, kept = sum(counts), {}
    for a in range(0, len(units), size - shared):
        b = min(a + size, len(units))
        slack = max(int(0.03 * len(words)), 50)
        first = max(0, int(len(words) * sum(counts[:a]) / total) - slack)
        last = min(len(words), int(len(words) * sum(counts[:b]) / total) + slack)
        for r in align_words(words[first:last], units[a:b], silences):
            r = replace(r, first=r.first + first, last=r.last + first)
            if r.unit.number not in kept or r.score > kept[r.unit.number].score:
                kept[r.unit.number] = r
        if b == len(units):
            break
    rows = [kept[u.number] for u in units if u.number in kept]
    for i in range(1, len(rows)):
        if rows[i].start < rows[i - 1].end:
            middle = round((rows[i].start + rows[i - 1].end) / 2, 3)
            rows[i - 1], rows[i] = replace(rows[i - 1], end=middle), replace(rows[i], start=middle)
    return rows


def align_word_level(segments: list[Segment], units: list[Unit], silences: Iterable[tuple[float, float]] = ()) -> list[Row]:
    segments = without_formulas(segments, units)
    words = word_stream(segments)
    run = align_words_in_chunks if len(words) > 2000 else align_words
    return run(words, units, silences) or align_dp(segments, units, silences)


def realign_drift(segments: list[Segment], rows: list[Row], least: int = 4, ratio: float = 2.5) -> list[Row]:
    """Aligns zones whose pace is off word by word, between the trusted rows on either side."""
    rows = list(rows)
    paces = [r.duration / max(n_words(r.unit.text), 1) for r in rows]
    positive = sorted(p for p in paces if p > 0)
    if not positive:
        return rows
    m = positive[len(positive) // 2]
    off = [-1.0 if p <= 0 or max(p / m, m / p) > ratio else 1.0 for p in paces]
    stream = word_stream(segments)
    for a, b in runs_below(off, 0.0, least):
        trusted = lambda r: r.duration > 0 and r.score >= 0.7
        t0 = next((r.end for r in reversed(rows[:a]) if trusted(r)), segments[0].start if segments else 0.0)
        t1 = next((r.start for r in rows[b:] if trusted(r)), segments[-1].end if segments else 0.0)
        inside = [i for i, w in enumerate(stream) if w.start >= t0 and w.end <= t1]
        if not inside:
            continue
        better = {r.unit.number: r for r in align_words(stream[inside[0] : inside[-1] + 1], [r.unit for r in rows[a:b]], beam=80)}
        for i in range(a, b):
            if new := better.get(rows[i].unit.number):
                size = max(n_words(new.unit.text), 1)
                steadier = abs(new.duration / size - m) < 0.8 * abs(rows[i].duration / size - m)
                if (new.score >= 0.9 * rows[i].score and steadier) or new.score > rows[i].score + 0.02:
                    rows[i] = replace(new, source="drift")
    return rows


def snap_to_silences(rows: list[Row], silences: Iterable[tuple[float, float]], reach: float = 2.0) -> list[Row]:
    """Moves each border to the silence whose middle is nearest, if both sides stay valid."""
    rows, silences = sorted(rows, key=lambda r: r.unit.number), sorted(silences)
    middles = sorted(((s[0] + s[1]) / 2, n) for n, s in enumerate(silences))
    for i in range(len(rows) - 1):
        border = (rows[i].end + rows[i + 1].start) / 2
        at = bisect_left(middles, (border, -1))
        beside = [middles[at]] if at < len(middles) else []
        if at:  # of equal middles before the border, the first
            beside.append(middles[bisect_left(middles, (middles[at - 1][0], -1))])
        best = silences[min((abs(m - border), n) for m, n in beside)[1]] if beside else None
        if best and abs((best[0] + best[1]) / 2 - border) <= reach and best[0] > rows[i].start and best[1] < rows[i + 1].end:
            rows[i], rows[i + 1] = replace(rows[i], end=round(best[0], 2)), replace(rows[i + 1], start=round(best[1], 2))
    return rows


def snap_to_energy(rows: list[Row], envelope: Iterable[tuple[float, float]], reach: float = 1.0) -> list[Row]:
    """Moves each border to the quietest time near it, if both sides stay valid."""
    rows, frames = sorted(rows, key=lambda r: r.unit.number), sorted((e[0], n, e[1]) for n, e in enumerate(envelope))
    for i in range(len(rows) - 1):
        border = (rows[i].end + rows[i + 1].start) / 2
        near = frames[bisect_left(frames, (border - reach - 0.001,)) : bisect_left(frames, (border + reach + 0.001,))]
        lowest = min(((energy, n, t) for t, n, energy in near if abs(t - border) <= reach), default=None)
        best = (lowest[2], lowest[0]) if lowest else None
        if best and rows[i].start + 0.1 < best[0] < rows[i + 1].end - 0.1:
            rows[i], rows[i + 1] = replace(rows[i], end=round(best[0], 3)), replace(rows[i + 1], start=round(best[0], 3))
    return rows


def fix_overlaps(rows: list[Row], min_gap: float = 0.0) -> list[Row]:
    """The list form of ``boundaries.fix_overlaps``."""
    rows = sorted(rows, key=lambda r: r.unit.number)
    for i in range(1, len(rows)):
        a, b = rows[i - 1], rows[i]
        if (lack := min_gap - (b.start - a.end)) > 0:
            start, end = b.start + lack / 2, a.end - lack / 2
            start = b.end - 0.1 if start > b.end else start
            end = a.start + 0.1 if end < a.start else end
            rows[i - 1], rows[i] = replace(a, end=round(end, 2)), replace(b, start=round(start, 2))
    return rows


def claim_breaths(ends: list[float], breaths: list[tuple[float, float]], near: float = 0.8, around: float = 0.5) -> list[int | None]:
    """For each segment end in order the nearest breath not yet taken, by its place in ``breaths``."""
    taken: set[int] = set()
    out: list[int | None] = []
    for end in ends:
        options = [(min(abs(s - end), abs(e - end)), i) for i, (s, e) in enumerate(breaths) if i not in taken and (abs(s - end) <= near or abs(e - end) <= near or s - around <= end <= e + around)]
        best = min(options, default=None)
        out.append(best[1] if best else None)
        if best:
            taken.add(best[1])
    return out


def align_sequences(reference: list[str], heard: list[str], accept: float = 0.6) -> list[int | None]:
    """For each reference word the heard word it is matched with, in order, at the highest total; a pair
    counts its likeness, or -1 under ``accept``.

    best[i][j] is the highest total of i and j words.  Rows are made from the row above, of which a few are kept;
    those between are made again where the way back passes, up to the column it has reached, so memory grows with
    the words and not with their pairs."""
    n, m = len(reference), len(heard)
    known = {w: k for k, w in enumerate(dict.fromkeys(heard))}
    ids = np.array([known[w] for w in heard], dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    places_from = np.searchsorted(ids[order], np.arange(len(known) + 1))
    like = _likeness_to(list(known), accept)

    def below(row: np.ndarray, i: int) -> np.ndarray:
        """Row i from row i - 1; a pair that counts -1 is never better than leaving both words."""
        words, worth = like(reference[i - 1])
        row = row.copy()
        if words.size:
            sizes = places_from[words + 1] - places_from[words]
            at = order[np.repeat(places_from[words] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            worth = np.repeat(worth, sizes)
            here = at + 1 < len(row)
            at, worth = at[here], worth[here]
            row[at + 1] = np.maximum(row[at + 1], row[at] + worth)
        return np.maximum.accumulate(row)

    out: list[int | None] = [None] * n

    def back(first: int, last: int, top: np.ndarray, j: int) -> int:
        """From row ``last`` and column j back to row ``first``, whose totals are ``top``; gives the column there."""
        if (last - first) * (j + 1) > _CELLS and last - first > 1:
            step = -(-(last - first) // 8)
            starts, rows, row = list(range(first, last, step)), [top[: j + 1]], top[: j + 1]
            for i in range(first + 1, starts[-1] + 1):
                row = below(row, i)
                if (i - first) % step == 0:
                    rows.append(row)
            while starts:
                a = starts.pop()
                j = back(a, last, rows.pop(), j)
                last = a
            return j
        rows = [top[: j + 1]]
        for i in range(first + 1, last + 1):
            rows.append(below(rows[-1], i))
        i = last
        while i > first and j:
            here, above = rows[i - first], rows[i - first - 1]
            words, worth = like(reference[i - 1])
            values = dict(zip(words.tolist(), worth.tolist()))
            while j:
                now = values.get(int(ids[j - 1]), -1.0)
                if now > 0 and math.isclose(here[j], above[j - 1] + now):
                    out[i - 1] = j = j - 1
                    break
                if math.isclose(here[j], above[j]):
                    break
                j -= 1
            i -= 1
        return j

    if n and m:
        back(0, n, np.zeros(m + 1), m)
    return out


#: Totals of pairs that are kept at once.
_CELLS = 1 << 21


def _likeness_to(words: list[str], accept: float) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """A function of a word: which of ``words`` are alike, and how much.  It meets all of a block at once, side by side."""
    blocks, a = [], 0
    while a < len(words):
        used, b = 0, a
        while b < len(words) and (b == a or used < _BLOCK):
            used += len(words[b]) // 8 + 1
            b += 1
        sizes = np.array([len(w) for w in words[a:b]])
        ends = np.cumsum(sizes // 8 + 1)
        begins = ends - sizes // 8 - 1
        places = np.repeat(8 * begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        text = "".join(words[a:b])
        full = np.zeros(8 * used, dtype=bool)
        full[places] = True
        blocks.append((a, packed_places(code_points(text), places, used, set(text)), as_integer(full), used, sizes, begins))
        a = b

    @lru_cache(maxsize=256)
    def like(word: str) -> tuple[np.ndarray, np.ndarray]:
        found, worth = [], []
        for a, where, full, n_bytes, sizes, begins in blocks:
            row = common_row(full, where, full, word)
            ones = np.bitwise_count(np.frombuffer(row.to_bytes(n_bytes, "little"), dtype=np.uint8)).astype(np.int64)
            common, total = sizes - np.add.reduceat(ones, begins), sizes + len(word)
            s = np.where(total == 0, 1.0, 2 * common / np.maximum(total, 1))
            alike = np.flatnonzero((s >= accept) & (s > 0))
            found.append(alike + a)
            worth.append(s[alike])
        return np.concatenate(found), np.concatenate(worth)

    return like


def align_full(segments: list[Segment], units: list[Unit], silences: Iterable[tuple[float, float]] = (), envelope: Iterable[tuple[float, float]] = (), strategy: str = "auto", quality: float = 0.85, fix_drift: bool = True, snap_energy: bool = True, snap_silence: bool = True, repair: bool = True, min_gap: float = 0.0, required: dict[tuple[int, int], list[str]] | None = None) -> list[Row]:
    """A strategy and the steps that mend its result, each behind its flag; ``required`` is for greedy."""
    strategies = {"greedy": partial(align_greedy, required=required), "dp": align_dp, "hybrid": align_hybrid, "auto": align_hybrid, "words": align_word_level}
    if strategy not in strategies:
        raise ValueError(f"unknown strategy {strategy!r}: use one of {sorted(strategies)}")
    if not segments or not units:
        return []
    silences, envelope = list(silences), list(envelope)
    rows = strategies[strategy](segments, units, silences)
    if fix_drift:
        rows = realign_drift(segments, realign_between_anchors(segments, realign_iterated(segments, rows, quality)))
    if snap_energy and envelope:
        rows = snap_to_energy(rows, envelope)
    if snap_silence and silences:
        rows = snap_to_silences(rows, silences)
    return fix_overlaps(rows, min_gap) if repair else rows
