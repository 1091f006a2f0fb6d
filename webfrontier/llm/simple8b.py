"""Simple-8b: 64-bit words whose top four bits say how many values of which width the other sixty hold.

Selector k from 2 to 15 stands for LAYOUTS[k - 2], a count and a width in bits. Selector 0 is an escape: the value
is the next word as it is. Every document starts a new word, and what its last word has left over is zero, so
documents can be decoded apart from each other.
"""

from __future__ import annotations

import numpy as np

LAYOUTS = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
FIRST = 2
WIDTHS = [x[1] for x in LAYOUTS]


def _layout_of(values: np.ndarray) -> np.ndarray:
    """The narrowest layout that takes a value, len(LAYOUTS) if none does."""
    narrow = np.zeros(len(values), np.uint8)
    for bits in WIDTHS:
        narrow += values >= np.uint64(1 << bits)
    return narrow


_OF_SMALL = _layout_of(np.arange(1 << 16, dtype=np.uint64))


def pack(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs documents that lie one after another, each by the widest fit at every step.

    Returns the words, the place of each document's first word, and the places of escape words.
    """
    lengths = np.asarray(lengths, np.int64)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(len(lengths), np.uint32), np.zeros(0, np.uint32)
    # zeros behind every document, so that its last word is filled with them
    gap = LAYOUTS[0][0]
    firsts = np.cumsum(lengths + gap) - lengths - gap
    padded = np.zeros(int(lengths.sum()) + gap * len(lengths), np.uint64)
    padded[np.arange(len(values)) + np.repeat(firsts - (np.cumsum(lengths) - lengths), lengths)] = values
    chosen = np.full(len(padded), 255, np.uint8)
    # the layout of the widest value among those from here on that a layout takes
    widest = _OF_SMALL[padded.astype(np.uint16)] if int(values.max()) < len(_OF_SMALL) else _layout_of(padded)
    taken = 1
    for number in range(len(LAYOUTS) - 1, -1, -1):
        count = LAYOUTS[number][0]
        while taken < count:  # the maximum over more values from that over fewer
            more = min(taken, count - taken)
            grown = widest.copy()
            np.maximum(widest[:-more], widest[more:], out=grown[:-more])
            widest, taken = grown, taken + more
        np.copyto(chosen, number, where=widest <= number)
    counts = np.append(np.array([x[0] for x in LAYOUTS]), 1)[np.minimum(chosen, len(LAYOUTS))]
    steps, places = counts.astype(np.uint8).tobytes(), []
    for place, end in zip(firsts.tolist(), (firsts + lengths).tolist()):
        while place < end:
            places.append(place)
            place += steps[place]
    starts = np.array(places)
    kinds = chosen[starts]
    sizes = np.where(kinds == 255, 2, 1)
    spots = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), np.uint64)
    for number in np.unique(kinds).tolist():
        mine = kinds == number
        begin = starts[mine]
        if number == 255:
            words[spots[mine] + 1] = padded[begin]
            continue
        count, bits = LAYOUTS[number]
        word = np.full(len(begin), (number + FIRST) << 60, np.uint64)
        for at in range(count):
            word |= padded[begin + at] << np.uint64(at * bits)
        words[spots[mine]] = word
    offsets = np.append(spots, len(words))[np.searchsorted(starts, firsts)]
    return words, offsets.astype(np.uint32), spots[kinds == 255].astype(np.uint32)


def unpack(words: np.ndarray, escapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a block with the zeros that fill last words, and the place of each word's first value."""
    kinds = (words >> np.uint64(60)).astype(np.int64) - FIRST
    raw = escapes.astype(np.int64) + 1
    kinds[raw] = -1  # a raw word's top bits mean nothing
    counts = np.array([x[0] for x in LAYOUTS])[np.maximum(kinds, 0)]
    counts[escapes.astype(np.int64)] = 0
    counts[raw] = 1
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    out[first[raw]] = words[raw]
    for number, (count, bits) in enumerate(LAYOUTS):
        mine = np.flatnonzero(kinds == number)
        if len(mine):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[first[mine][:, None] + np.arange(count)] = (words[mine][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out, first
