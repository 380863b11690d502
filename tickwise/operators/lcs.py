"""Similar pairs of two blocks of keys (D7): length bound, characters in common, LCS of parts, banded LCS.

Every step is exact.  A pair needs LCS >= ``need`` = ceil(threshold * (l1 + l2) / 200):

* the longer key has at most l1 * (200 - threshold) / threshold characters;
* the characters in common bound the LCS (counted in ``ROUGH`` classes, then in ``BINS``);
* the classes are dealt to ``PARTS`` parts of the alphabet.  What a common subsequence has of
  a part's characters is a common subsequence of what both keys have of them, so the LCS of
  the parts add up to a bound of the LCS.  Part by part, the LCS takes the place of the
  characters in common, and a pair goes as soon as the sum is below ``need``: texts of one
  language have most characters in common, but in another order;
* the bit-parallel LCS runs over many pairs at a time; that of long keys only over the words
  that an alignment with at most l1 - need and l2 - need skipped characters can touch, and a
  pair goes as soon as what is left of both keys cannot make up for what it has missed.
"""

from __future__ import annotations

import numpy as np

BINS = 128          # the 64 most frequent characters have a class each, the others share the rest
ROUGH = 32          # classes of the first count
PARTS = 4           # parts of the alphabet: short enough for few words, of enough characters to have an order
PAIRS = 4096        # pairs aligned at a time
FEW = 32            # so few pairs are aligned one by one
CELLS = 2_000_000   # bound of a batch's tables, in elements
STEP = 32           # signs between two looks at which pairs are still open
WORDS = 4           # keys of more words are aligned in a band
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


class Signs:
    """Texts as codes of their characters, all below ``signs``."""

    def __init__(self, code: np.ndarray, size: np.ndarray, signs: int):
        self.code, self.size, self.signs = code, size, signs
        self.start = np.concatenate([[0], np.cumsum(size)])


class Keys(Signs):
    """The keys of the blocks, the counts of their characters and what they hold of each part."""

    def __init__(self, texts: list[str]):
        size = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        often = np.bincount(points)
        alphabet = np.flatnonzero(often)
        alphabet = alphabet[np.argsort(-often[alphabet], kind="stable")]
        codes = np.zeros(often.size, dtype=np.int64)
        codes[alphabet] = np.arange(alphabet.size)
        super().__init__(codes[points], size, alphabet.size)
        rank = np.arange(self.signs)
        kind = np.where(rank < BINS // 2, rank, BINS // 2 + rank % (BINS // 2))
        row = np.repeat(np.arange(size.size), size)
        counts = np.bincount(row * BINS + kind[self.code], minlength=size.size * BINS).reshape(-1, BINS)
        # a key's counts add up to its length; the classes of a part stand together
        counts = counts.astype(np.uint16 if size.max(initial=0) < 1 << 16 else np.int64)
        self.rough = np.ascontiguousarray(counts.reshape(size.size, BINS // ROUGH, ROUGH).sum(axis=1, dtype=counts.dtype).T)
        self.counts = np.ascontiguousarray(counts.reshape(size.size, BINS // PARTS, PARTS).swapaxes(1, 2))
        self.parts = []
        for p in range(PARTS):
            held = np.flatnonzero(kind % PARTS == p)
            codes = np.full(self.signs, -1)
            codes[held] = np.arange(held.size)
            code = codes[self.code]
            inside = np.flatnonzero(code >= 0)
            self.parts.append(Signs(code[inside], np.bincount(row[inside], minlength=size.size), held.size))


def similar_keys(left: list[str], right: list[str] | None, threshold: int):
    """(left positions, right positions, LCS) of the similar pairs.

    Both lists are sorted by length, no key of ``right`` is shorter than one of
    ``left``; without ``right``, the pairs are those of ``left`` with itself.
    """
    n = len(left)
    keys = Keys(left + (right or []))
    first = n if right is not None else 0
    found, some, held = [], [], 0
    for x in range(n):
        size = int(keys.size[x])
        a = first if right is not None else x + 1
        b = first + int(np.searchsorted(keys.size[first:], size * (200 - threshold) // threshold, "right"))
        if a >= b:
            continue
        need = -(-threshold * (size + keys.size[a:b]) // 200)
        y = np.flatnonzero(np.minimum(keys.rough[:, a:b], keys.rough[:, x, None]).sum(axis=0, dtype=keys.rough.dtype) >= need)
        common = np.minimum(keys.counts[a + y], keys.counts[x]).sum(axis=2, dtype=np.int64)
        ok = np.flatnonzero(common.sum(axis=1) >= need[y])
        if ok.size:
            some.append((np.full(ok.size, x), a + y[ok], need[y[ok]], common[ok]))
            held += ok.size
        if held >= 16 * PAIRS or (held and len(some) * keys.signs * (size // 64 + 1) >= CELLS):
            found.append(_similar(keys, *map(np.concatenate, zip(*some))))
            some, held = [], 0
    if some:
        found.append(_similar(keys, *map(np.concatenate, zip(*some))))
    parts = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in (zip(*found) if found else ([], [], []))]
    return parts[0], parts[1] - first, parts[2]


def _similar(keys: Keys, x: np.ndarray, y: np.ndarray, need: np.ndarray, bound: np.ndarray):
    """The pairs (x, y) with LCS >= need, and the LCS; ``bound`` has their characters in common by part."""
    for p, part in enumerate(keys.parts):
        # what the part must give if every other part gives its bound
        ok, lcs = _aligned(part, x, y, need - bound.sum(axis=1) + bound[:, p])
        x, y, need, bound = x[ok], y[ok], need[ok], bound[ok]
        bound[:, p] = lcs
    ok, lcs = _aligned(keys, x, y, need)
    return x[ok], y[ok], lcs


def _aligned(keys: Signs, x: np.ndarray, y: np.ndarray, need: np.ndarray):
    """(positions, LCS) of the pairs with LCS >= need."""
    words = np.maximum(1, (keys.size[x] + 63) // 64)
    # a long x shares its table with others of up to twice its words
    words = np.where(words <= WORDS, words, 1 << np.ceil(np.log2(words)).astype(np.int64))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for w in np.unique(words):
        of_w = np.flatnonzero(words == w)
        out += [(of_w[ok], lcs) for ok, lcs in _of_words(keys, int(w), x[of_w], y[of_w], need[of_w])]
    ok, lcs = (np.concatenate(p) for p in zip(*out))
    order = np.argsort(ok)
    return ok[order], lcs[order]


def _of_words(keys: Signs, words: int, x: np.ndarray, y: np.ndarray, need: np.ndarray):
    some, of = np.unique(x, return_inverse=True)
    size = keys.size[some]
    # masks[(k, sign), w]: where the k-th x holds the sign; the last sign is held by none
    masks = np.zeros(some.size * (keys.signs + 1) * words, dtype=np.uint64)
    k = np.repeat(np.arange(some.size), size)
    at = np.arange(k.size) - np.repeat(np.cumsum(size) - size, size)
    cell = (k * (keys.signs + 1) + keys.code[keys.start[some][k] + at]) * words + at // 64
    np.bitwise_or.at(masks, cell, np.uint64(1) << (at % 64).astype(np.uint64))
    order = np.argsort(keys.size[y], kind="stable")
    at = 0
    while at < order.size:
        longest = int(keys.size[y[order[min(at + PAIRS, order.size) - 1]]])
        m = max(1, min(PAIRS, CELLS // max(longest, 1)))
        batch = order[at:at + m]
        align = _single if batch.size <= FEW else _whole if words <= WORDS else _batch
        ok, lcs = align(keys, masks, words, of[batch], x[batch], y[batch], need[batch])
        yield batch[ok], lcs
        at += m


def _single(keys: Signs, masks: np.ndarray, words: int, of: np.ndarray, x: np.ndarray, y: np.ndarray, need: np.ndarray):
    """``_batch`` pair by pair, a key of any length in one integer."""
    table, got = masks.reshape(-1, keys.signs + 1, words), np.empty(x.size, dtype=np.int64)
    last = -1
    for n in np.argsort(of, kind="stable"):
        if of[n] != last:
            last = of[n]
            some = np.flatnonzero(table[last].any(axis=1))
            held = {c: int.from_bytes(m.tobytes(), "little") for c, m in zip(some.tolist(), table[last, some])}
            full = (1 << int(keys.size[x[n]])) - 1
        v = full
        for c in keys.code[keys.start[y[n]]:keys.start[y[n] + 1]].tolist():
            m = v & held.get(c, 0)
            v = ((v + m) | (v - m)) & full
        got[n] = int(keys.size[x[n]]) - v.bit_count()
    ok = np.flatnonzero(got >= need)
    return ok, got[ok]


def _whole(keys: Signs, masks: np.ndarray, words: int, of: np.ndarray, x: np.ndarray, y: np.ndarray, need: np.ndarray):
    """``_batch`` over all words; the pairs are sorted by the length of y, so those that have signs left are the last ones."""
    size = keys.size[y]
    v = np.full((words, y.size), ONES, dtype=np.uint64)
    code, base, start = keys.code * words, of * ((keys.signs + 1) * words), keys.start[y]
    for s, low in enumerate(np.searchsorted(size, np.arange(int(size[-1])), "right")):
        row = code.take(start[low:] + s)
        row += base[low:]
        carry = None
        for w in range(words):
            one = v[w, low:]
            m = masks.take(row + w if w else row)
            m &= one
            total = one + m
            over = total < m
            if carry is not None:
                total += carry
                over |= total < carry
            one -= m
            one |= total
            carry = over
    got = (64 - np.bitwise_count(v).astype(np.int64)).sum(axis=0)
    ok = np.flatnonzero(got >= need)
    return ok, got[ok]


def _batch(keys: Signs, masks: np.ndarray, words: int, of: np.ndarray, x: np.ndarray, y: np.ndarray, need: np.ndarray):
    signs = keys.signs
    l1, l2 = keys.size[x], keys.size[y]
    skip1, skip2, steps = int((l1 - need).max()), int((l2 - need).max()), int(l2.max())
    t = np.arange(steps)[:, None]
    code = keys.code[np.minimum(keys.start[y] + t, len(keys.code) - 1)]
    row = ((of * (signs + 1) + np.where(t < l2, code, signs)) * words)
    v = np.full((words, x.size), ONES, dtype=np.uint64)
    edge = np.arange(1, 4 * words + 1)[:, None] * 16
    alive, high = np.arange(x.size), 0
    for s in range(steps):
        # a word once touched stays in the band: only words of ones may lose a carry
        low, high = max(0, s - skip2) // 64, max(high, min(words - 1, (s + skip1) // 64) + 1)
        if low < high:
            m = masks[row[s] + np.arange(low, high)[:, None]]
            band = v[low:high]
            total = band + (band & m)
            carry = total[:-1] < band[:-1]
            band &= ~m
            while carry.any():   # into the next word; again where that was full
                total[1:] += carry
                more = np.zeros_like(carry)
                more[1:] = carry[:-1] & (total[1:-1] == 0)
                carry = more
            band |= total
        if s % STEP == STEP - 1 and s + 1 < steps:
            # zeros among the first p bits: the LCS of the y read so far with p signs of x
            part = np.ascontiguousarray(v.T).view("<u2").T
            got = np.cumsum(16 - np.bitwise_count(part).astype(np.int64), axis=0)
            rest = np.minimum(l2 - s - 1, np.maximum(l1 - edge + 16, 0))
            best = np.maximum((got + np.maximum(rest, 0)).max(axis=0), 0)
            keep = np.flatnonzero(best >= need)
            if keep.size < 0.8 * need.size:
                alive, v, row = alive[keep], np.ascontiguousarray(v[:, keep]), np.ascontiguousarray(row[:, keep])
                l1, l2, need = l1[keep], l2[keep], need[keep]
                if not keep.size:
                    break
                skip1, skip2 = int((l1 - need).max()), int((l2 - need).max())
    got = (64 - np.bitwise_count(v).astype(np.int64)).sum(axis=0)
    ok = got >= need
    return alive[ok], got[ok]
