"""Edit distances by bit-parallel dynamic programming on Python's long integers and on arrays of words (Myers 1999; bands after Hyyro 2003)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np

#: Pairs of texts that are aligned at once.
PAIRS_AT_ONCE = 4096
#: Letters of the longer texts that are aligned at once.
LETTERS_AT_ONCE = 8_000_000
#: Pairs from which a step on arrays is faster than a step of each pair.
PAIRS_A_STEP = 30


def places(items: Sequence) -> dict:
    """For each item, the positions at which it stands, as bits."""
    where: dict = defaultdict(int)
    for i, x in enumerate(items):
        where[x] |= 1 << i
    return where


def banded_distance(a: Sequence, b: Sequence, most: int) -> int | None:
    """Edit distance of two sequences if it is at most `most`, else None.

    Only the diagonal band of the alignment table that such a distance can
    reach is computed. A column is held as the bits of its vertical +1 and -1
    steps, already moved down by one row for the column after it.
    """
    first, shorter = 0, min(len(a), len(b))
    while first < shorter and a[first] == b[first]:
        first += 1
    last = 0
    while last < shorter - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if len(a) > len(b):
        a, b = b, a
    n, gap = len(a), len(b) - len(a)
    if gap > most:
        return None
    if not n:
        return gap
    down = min((most - gap) // 2, n)
    up = (most - gap) // 2 + gap
    width = up + down + 1
    full = (1 << width) - 1
    where = places(a)
    rises, falls = full & ~((1 << up) - 1), 0  # rows above the table neither rise nor fall
    score = down
    for j, x in enumerate(b):
        low = j - up  # the item of `a` that belongs to the band's first row
        hits = where.get(x, 0)
        hits = (hits >> low if low >= 0 else hits << -low) & full
        same = ((((hits & rises) + rises) ^ rises) | hits | falls) & full  # no more than the cell up and left
        right_up = (falls | ~(same | rises)) & full
        right_down = same & rises
        if j + 1 + down <= n:
            score += not same >> (width - 1) & 1
            if score > most + up:  # distances never fall along a diagonal
                return None
        else:
            row = n - (j + 1) + up
            score += (right_up >> row & 1) - (right_down >> row & 1)
        rises = (right_down | ~((same >> 1) | right_up)) & full
        falls = (same >> 1) & right_up
    return score if score <= most else None


def similar(a: Sequence, b: Sequence, share: float) -> bool:
    """Whether 1 - distance / longer length reaches share; two empty sequences are similar."""
    longer = max(len(a), len(b))
    return banded_distance(a, b, int(longer * (1 - share) + 1e-9)) is not None


def similar_words(firsts: Sequence[str], seconds: Sequence[str], share: float) -> np.ndarray:
    """similar() of the words of many pairs of texts."""
    return np.fromiter((similar(a.split(), b.split(), share) for a, b in zip(firsts, seconds, strict=True)), bool, len(firsts))


def similar_texts(firsts: Sequence[str], seconds: Sequence[str], share: float) -> np.ndarray:
    """similar() of many pairs of strings: side by side in arrays, where few are left one by one."""
    hold = np.zeros(len(firsts), bool)
    sizes = np.array([(len(a), len(b)) for a, b in zip(firsts, seconds, strict=True)], np.int64).reshape(-1, 2)
    least, most_size = sizes.min(axis=1), sizes.max(axis=1)
    most, gap = (most_size * (1 - share) + 1e-9).astype(np.int64), most_size - least
    near = gap <= most
    hold[near & (least == 0)] = True
    todo = np.nonzero(near & (least > 0))[0]
    todo = todo[np.argsort(-most_size[todo], kind="stable")]
    while len(todo):
        part = todo[: max(1, min(PAIRS_AT_ONCE, LETTERS_AT_ONCE // int(most_size[todo[0]])))]
        pairs = [(firsts[i], seconds[i]) if len(firsts[i]) <= len(seconds[i]) else (seconds[i], firsts[i]) for i in part]
        hold[part] = bands_hold(*zip(*pairs, strict=True), most[part])
        todo = todo[len(part) :]
    return hold


def letters(texts: Sequence[str], pad: np.ndarray, width: int, filler: int) -> np.ndarray:
    """A row of letter codes for each text, each begun after `pad` fillers and filled up to `width`; no code is a filler."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(2)
    kind = np.uint8 if codes.max(initial=0) < 1 << 8 else np.uint16 if codes.max(initial=0) < 1 << 16 else np.uint32
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), width), filler, kind)
    row = np.repeat(np.arange(len(texts)), sizes)
    out[row, np.arange(len(codes)) + np.repeat(pad - (np.cumsum(sizes) - sizes), sizes)] = codes.astype(kind)
    return out


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of numbers of several 64-bit words a row, the lowest first."""
    out = a + b
    if a.shape[1] > 1:
        over = out < a
        for k in range(1, a.shape[1]):
            carry = over[:, k - 1].astype(np.uint64)
            out[:, k] += carry
            over[:, k] |= out[:, k] < carry
    return out


def bands_hold(shorter: Sequence[str], longer: Sequence[str], most: np.ndarray) -> np.ndarray:
    """banded_distance() is not None, for pairs with the longest `longer` first and none empty: the same steps on arrays, a row of words a band."""
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (shorter, longer))
    if len(n) < PAIRS_A_STEP:
        return np.array([banded_distance(*pair) is not None for pair in zip(shorter, longer, most.tolist(), strict=True)], bool)
    gap = m - n
    down = np.minimum((most - gap) // 2, n)
    up = (most - gap) // 2 + gap
    width = up + down + 1
    across = int(-(-width.max() // 8) * 8)
    words = -(-across // 64)
    a, b = letters(shorter, up, int(max((n + up).max(), m.max())) + across, 0), letters(longer, np.zeros(len(m), np.int64), int(m.max()), 1)
    one, word = np.uint64(1), np.arange(words) * 64
    low = lambda k: np.where(k[:, None] >= word + 64, np.uint64(2**64 - 1), (one << np.clip(k[:, None] - word, 0, 63).astype(np.uint64)) - one)  # noqa: E731  the k lowest bits
    bit = lambda rows, k: (rows[np.arange(len(rows)), k >> 6] >> (k & 63).astype(np.uint64) & one).view(np.int64)
    top, full = width - 1, low(width)
    rises = full & ~low(up)
    falls, score, at = np.zeros((len(n), words), np.uint64), down.copy(), np.arange(len(n))
    hold = np.zeros(len(n), bool)
    bits = np.zeros((len(n), 8 * words), np.uint8)
    j, live, inner = 0, len(n), int((n - down).min())
    while live:
        bits[:live, : across // 8] = np.packbits(a[:live, j : j + across] == b[:live, j, None], axis=1, bitorder="little")
        hits, f, r, d = bits[:live].view(np.uint64) & full[:live], full[:live], rises[:live], falls[:live]
        same = ((added(hits & r, r) ^ r) | hits | d) & f
        right_up, right_down = (d | ~(same | r)) & f, same & r
        if j < inner:  # no band has come to its text's last row
            score[:live] += 1 - bit(same, top[:live])
        else:
            within = j + 1 + down[:live] <= n[:live]
            row = np.where(within, 0, n[:live] - (j + 1) + up[:live])
            score[:live] += np.where(within, 1 - bit(same, top[:live]), bit(right_up, row) - bit(right_down, row))
        moved = same >> one
        moved[:, :-1] |= same[:, 1:] << np.uint64(63)
        rises[:live] = (right_down | ~(moved | right_up)) & f
        falls[:live] = moved & right_up
        j += 1
        ended = int(np.searchsorted(-m[:live], -j, side="left"))  # texts of j letters and fewer are at their end
        if ended < live:
            hold[at[ended:live]] = score[ended:live] <= most[ended:live]
            live = ended
        if live and j % 16 == 0:
            # distances never fall along a diagonal
            open_ = np.nonzero((score[:live] <= most[:live] + up[:live]) | (j + down[:live] > n[:live]))[0]
            if len(open_) < 0.7 * live:
                n, m, most, up, down, top, full, rises, falls, score, at, a, b = (x[open_] for x in (n, m, most, up, down, top, full, rises, falls, score, at, a, b))
                bits, live = np.zeros((len(open_), 8 * words), np.uint8), len(open_)
            if live and live * m[0] < PAIRS_A_STEP * (m[0] - j):
                for i in range(live):
                    hold[at[i]] = banded_distance(shorter[at[i]], longer[at[i]], int(most[i])) is not None
                live = 0
    return hold


def best_match(pattern: str, where: dict, text: str, most: int) -> tuple[int, int] | None:
    """The least distance of pattern to any stretch of text, if at most `most`, and where the first such stretch ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, m - 1
    rises, falls, score, best = full, 0, m, (min(m, most + 1), 0)
    for j, x in enumerate(text):
        hits = where.get(x, 0)
        same = ((((hits & rises) + rises) ^ rises) | hits | falls) & full
        right_up = (falls | ~(same | rises)) & full
        right_down = same & rises
        score += (right_up >> top & 1) - (right_down >> top & 1)
        if score < best[0]:
            best = (score, j + 1)
        right_up, right_down = right_up << 1, right_down << 1  # a match can begin anywhere: the row above the first stays 0
        rises = (right_down | ~(same | right_up)) & full
        falls = same & right_up & full
    return best if best[0] <= most else None
