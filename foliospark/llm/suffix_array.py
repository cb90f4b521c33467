"""Suffix array and capped common-prefix values of one shard by external induced sorting.

The suffixes at S* positions are sorted first: their substrings by one induction from text order, the string of their names
by recursion (by prefix doubling once it fits the memory bound). Two inductions then place all other suffixes. Each keeps a
priority queue of suffix tuples (position, common prefix with the tuple before it), popped by leading symbol and
pushed in arrival order; the value of a pushed tuple is one more than the least value passed since the last push to
the same symbol. Tuples of one symbol are handled as arrays, in rounds, and the queue writes its largest parts to disk
when it holds more than its bound; the text and its derived arrays are memory-mapped files beyond theirs.
Common prefixes are capped, as only prefixes of a given length matter, and take a byte each.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of tuples that a queue keeps in memory, symbols of a text kept in memory, names solved in memory.
QUEUE_BYTES = 96_000_000
TEXT_BYTES = 64_000_000
BASE_NAMES = 24_000_000


BATCH = 1 << 20


def joined(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return some[0] if len(some) == 1 else (np.concatenate([p for p, _ in some]), np.concatenate([v for _, v in some]))


class SymbolQueue:
    """Priority queue of (position, prefix) tuples by leading symbol; tuples of one symbol come back in arrival order."""

    def __init__(self, most_bytes: int):
        self.most, self.held, self.file = most_bytes, 0, None
        self.parts: dict[int, list] = {}

    def push(self, symbol: int, at: np.ndarray, prefix: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append((at, prefix))
        self.held += at.nbytes + prefix.nbytes
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        in_memory = lambda s: sum(p[0].nbytes + p[1].nbytes for p in self.parts[s] if isinstance(p[0], np.ndarray))
        for symbol in sorted(self.parts, key=in_memory, reverse=True):
            for k, part in enumerate(self.parts[symbol]):
                if isinstance(part[0], np.ndarray):
                    offset = self.file.seek(0, 2)
                    part[0].tofile(self.file)
                    part[1].tofile(self.file)
                    self.file.flush()
                    self.held -= part[0].nbytes + part[1].nbytes
                    self.parts[symbol][k] = (offset, len(part[0]), part[0].dtype, part[1].dtype)
            if self.held <= self.most // 2:
                return

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrivals in order, in batches of at most about BATCH tuples."""
        some: list[tuple[np.ndarray, np.ndarray]] = []
        for part in self._parts(symbol):
            some.append(part)
            if sum(len(p) for p, _ in some) >= BATCH:
                yield joined(some)
                some = []
        if some:
            yield joined(some)

    def _parts(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in self.parts.pop(symbol, []):
            if isinstance(part[0], np.ndarray):
                self.held -= part[0].nbytes + part[1].nbytes
                yield part
            else:
                offset, n, kind, value = part
                self.file.seek(offset)
                yield np.fromfile(self.file, kind, n), np.fromfile(self.file, value, n)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def on_disk(array: np.ndarray) -> np.ndarray:
    """The array as a mapped file if it is larger than the bound; the file goes with the mapping."""
    if array.nbytes <= TEXT_BYTES:
        return array
    with tempfile.TemporaryFile() as f:
        array.tofile(f)
        f.flush()
        return np.memmap(f, array.dtype, "r", shape=array.shape)


class _Text:
    """A text that ends with its only zero, its suffix types and run lengths."""

    def __init__(self, text: np.ndarray, cap: int):
        n = len(text)
        self.cap, self.n = cap, n
        change = np.flatnonzero(text[1:] != text[:-1])
        lengths = np.diff(np.concatenate(([-1], change, [n - 1])))
        rising = np.concatenate((text[change + 1] > text[change], [True]))  # the final zero is an S suffix
        self.s = on_disk(np.repeat(rising, lengths))
        ends = np.repeat(np.concatenate((change, [n - 1])), lengths)
        self.run = on_disk(np.minimum(ends - np.arange(n) + 1, cap).astype(np.uint8))
        self.text = on_disk(text)
        star = np.flatnonzero(self.s[1:] & ~self.s[:-1]) + 1
        self.star = star.astype(np.int32 if n < 1 << 31 else np.int64)


def _scan(t: _Text, batch: Iterator, here: int, falling: bool, carry: np.ndarray, seen: np.ndarray, push: Callable, keep: Callable, last: int | None) -> int | None:
    """Take batches of one symbol in scan order, push their predecessors; same-symbol pushes come back as further batches.

    ``last`` is the position scanned before in this symbol, or None at its start.
    """
    waiting = batch
    while waiting:
        again: list[tuple[np.ndarray, np.ndarray]] = []
        for at, prefix in waiting:
            if not len(at):
                continue
            if last is not None and not len(again) and prefix[0] == 255:  # a seam between kinds, value to be derived
                prefix = prefix.copy()
                prefix[0] = min(t.run[last], t.run[at[0]])
            keep(at, prefix)
            last = int(at[-1])
            made = _push_predecessors(t, at, prefix, falling, carry, seen)
            for symbol, p, v in made:
                if symbol == here:
                    again.append((p, v))
                else:
                    push(symbol, p, v)
        waiting = [joined(again)] if again else []
    return last


def _push_predecessors(t: _Text, at: np.ndarray, prefix: np.ndarray, falling: bool, carry: np.ndarray, seen: np.ndarray) -> list:
    before = at - 1
    ok = at > 0
    ok &= t.s[before] if falling else ~t.s[before]
    which = np.flatnonzero(ok)
    low = int(prefix.min())
    if not len(which):
        np.minimum(carry, low, out=carry)
        return []
    symbols = t.text[before[which]]
    by = np.argsort(symbols, kind="stable")
    symbols, which = symbols[by], which[by]
    first = np.concatenate(([True], symbols[1:] != symbols[:-1]))
    start = np.where(first, 0, np.concatenate(([0], which[:-1] + 1)))
    padded = np.append(prefix, np.uint8(t.cap))
    values = np.minimum.reduceat(padded, np.stack((start, which + 1), 1).ravel())[::2].astype(np.int64)
    heads = np.flatnonzero(first)
    target = symbols[heads].astype(np.int64)
    values[heads] = np.minimum(values[heads], carry[target])
    values = np.minimum(values + 1, t.cap).astype(np.uint8)
    values[heads[~seen[target]]] = 0  # nothing of the symbol before it
    seen[target] = True
    tails = np.concatenate((heads[1:] - 1, [len(which) - 1]))
    np.minimum(carry, low, out=carry)
    after = which[tails] + 1
    carry[target] = np.minimum.reduceat(padded, np.stack((after, np.full(len(after), len(prefix))), 1).ravel())[::2]
    positions = before[which]
    return [(int(s), positions[a:b], values[a:b]) for s, a, b in zip(target, heads, tails + 1, strict=True)]


def _induce(t: _Text, star: np.ndarray, star_prefix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sort all suffixes given the S* suffixes in order; yields them a symbol at a time from the largest down, each with its prefix with the next smaller one."""
    symbols = np.flatnonzero(np.bincount(t.text.astype(np.int64) if t.n < 1 << 26 else t.text))
    top = int(symbols[-1]) + 1
    queue, of_l = SymbolQueue(QUEUE_BYTES), SymbolQueue(QUEUE_BYTES)
    lead = t.text[star]
    cut = np.concatenate(([0], np.flatnonzero(lead[1:] != lead[:-1]) + 1, [len(star)]))
    seeds = {int(lead[a]): (a, b) for a, b in zip(cut, cut[1:], strict=False) if b > a}
    carry, seen = np.full(top, t.cap, np.uint8), np.zeros(top, bool)
    for c in symbols.tolist():
        np.minimum(carry, 0, out=carry)  # another symbol begins
        last = _scan(t, queue.pop(c), c, False, carry, seen, queue.push, lambda p, v, c=c: of_l.push(c, p, v), None)
        if c in seeds:
            a, b = seeds[c]
            prefix = star_prefix[a:b].copy()
            prefix[0] = 255 if last is not None else 0
            _scan(t, iter([(star[a:b], prefix)]), c, False, carry, seen, queue.push, lambda p, v: None, last)
    carry[:], seen[:] = t.cap, False
    for c in symbols[::-1].tolist():
        np.minimum(carry, 0, out=carry)
        chunks: list[tuple[np.ndarray, np.ndarray]] = []
        if c == 0:
            yield np.array([t.n - 1], t.star.dtype), np.array([0], np.uint8)
            continue
        keep = lambda p, v: chunks.append((p, v))  # noqa: E731, B023
        last = _scan(t, queue.pop(c), c, True, carry, seen, queue.push, keep, None)
        rising = list(of_l.pop(c))
        if rising:
            at = np.concatenate([p for p, _ in rising])[::-1]
            v = np.concatenate([v for _, v in rising])[::-1]
            _scan(t, iter([(at, np.concatenate(([np.uint8(255 if last is not None else 0)], v[:-1])).astype(np.uint8))]), c, True, carry, seen, queue.push, keep, last)
        at, v = np.concatenate([p for p, _ in chunks]), np.concatenate([v for _, v in chunks])
        yield at, np.append(v[1:], np.uint8(0))  # each with the next smaller one
    queue.close()
    of_l.close()


def _names(t: _Text, order: np.ndarray) -> np.ndarray:
    """Names of the S* substrings, given S* positions in the order of their substrings; equal substrings share one."""
    following = np.append(t.star[1:], t.n - 1)
    size = following[np.searchsorted(t.star, order)] - order + 1
    equal = np.flatnonzero(size[1:] == size[:-1]) + 1
    different = np.ones(len(order), bool)
    k = 0
    live = equal
    while len(live):
        live = live[t.text[order[live] + k] == t.text[order[live - 1] + k]]
        done = size[live] == k + 1
        different[live[done]] = False
        live = live[~done]
        k += 1
    names = np.empty(len(order), np.int64)
    names[np.searchsorted(t.star, order)] = np.cumsum(different) - 1
    return names


def _double(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by ``depth`` names at least: prefix doubling over groups still tied."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    by_rank = names[order]
    head = np.concatenate(([True], by_rank[1:] != by_rank[:-1], [True]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head[:-1], np.arange(n), 0))
    step = 1
    while step < depth:
        tied = np.flatnonzero(~(head[:-1] & head[1:]))
        if not len(tied):
            break
        at = order[tied]
        group = rank[at]
        after = at + step
        beyond = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = group * (n + 1) + beyond
        by = np.argsort(key)
        at, key, group = at[by], key[by], group[by]
        order[tied] = at
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        head[tied] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        step *= 2
    return order


def _prefixes(t: _Text, order: np.ndarray) -> np.ndarray:
    """Capped common prefix of each S* suffix in order with the one before; several symbols are compared at a time."""
    text, wide = t.text, 8 // t.text.dtype.itemsize
    padded = np.concatenate((text, np.zeros(t.cap + 8, text.dtype)))
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(text) + t.cap, 8), (text.dtype.itemsize, 1))
    value = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    k = 0
    while len(live) and k < t.cap:
        a = words[order[live] + k].view(np.uint64).ravel()
        b = words[order[live - 1] + k].view(np.uint64).ravel()
        same = a == b
        x = (a ^ b)[~same]
        value[live[~same]] = k + (np.log2((x & (~x + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3) // text.dtype.itemsize
        live = live[same]
        k += wide
    value[live] = t.cap
    return np.minimum(value, t.cap).astype(np.uint8)


def star_order(t: _Text, base_names: int) -> np.ndarray:
    """S* positions in suffix order."""
    if len(t.star) < 2:
        return t.star
    is_star = np.zeros(t.n, bool)
    is_star[t.star] = True
    by_symbol = t.star[np.argsort(t.text[t.star], kind="stable")]
    found = [at[is_star[at]] for at, _ in _induce(t, by_symbol, np.zeros(len(t.star), np.uint8))]
    names = _names(t, np.concatenate(found)[::-1])
    if names.max() + 1 == len(names):
        order = np.argsort(names)
    elif len(names) <= base_names:
        order = _double(names, t.cap)
    else:
        upper = _Text(np.append(names + 1, 0), 1)  # the names end with the only S* suffix of the final zero
        inner = star_order(upper, base_names)
        places = [at for at, _ in _induce(upper, inner, np.zeros(len(inner), np.uint8))]
        order = np.concatenate(places)[::-1][1:]  # without the zero that was added
    return t.star[order]


def suffix_array(text: np.ndarray, cap: int, base_names: int = BASE_NAMES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks (positions, common prefix of each with the next smaller suffix, at most ``cap`` < 255), from the largest suffix down.

    Suffixes that agree in their first ``cap`` symbols may come in any order; the common prefixes are the same in each.
    ``text`` holds positive symbols (uint8 or wider) and ends with its only zero.
    """
    if not 0 < cap < 255:
        raise ValueError("the cap takes a byte, less one value")
    t = _Text(text, cap)
    if t.n == 1:
        yield np.array([0]), np.array([0], np.uint8)
        return
    order = star_order(t, base_names)
    yield from _induce(t, order, _prefixes(t, order))
