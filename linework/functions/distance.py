"""Edit distances between bounds that are cheap, and by bit-parallel columns where the bounds differ, as Arrow UDFs.

A distance is at least the number of items that one side has and the other lacks, and at most what any alignment costs. Where
a greedy alignment, mended stretch by stretch, costs as much as the items say, that is the distance, in time linear in the
length. Otherwise the alignment's cost bounds the diagonals that a least path can reach, and only those are computed. A column of the
dynamic programme is two integers of as many bits as it has rows there, so a step costs a few operations on whole integers
instead of one on each cell.
"""

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Signs compared at once, of one alignment and of each of three; signs between differences that stand alone.
AHEAD, STEP, ALONE = 96, 24, 2
#: Least signs of a stretch and of the agreement that ends it; columns between moves of the band.
STRETCH, AGREED, COLUMNS = 48, 8, 512


def least_edits(a: str, b: str) -> int:
    """The larger count of signs that one side has and the other lacks: no fewer edits turn a into b."""
    mine, other = ({x: t.count(x) for x in set(t)} if len(t) > 200 else Counter(t) for t in (a, b))
    gone = sum(n - other.get(x, 0) for x, n in mine.items() if n > other.get(x, 0))
    return max(gone, gone + len(b) - len(a))


def aligned(a: str, b: str) -> list[tuple[int, int, int]]:
    """A greedy alignment as stretches: where each ends in a and in b, and its edits.

    A sign that differs alone is replaced. Where more differ, the edit is taken after which most signs agree.
    """
    n, m = len(a), len(b)
    code, kind = ("ascii", "u1") if a.isascii() and b.isascii() else ("utf-32-le", "<u4")
    width = np.dtype(kind).itemsize
    p, q = a.encode(code, "surrogatepass") + b"\xff" * (AHEAD + 2) * width, b.encode(code, "surrogatepass") + b"\xfe" * (AHEAD + 2) * width
    signs, others = np.frombuffer(p, kind), np.frombuffer(q, kind)
    size, bits, number = STEP * width, 8 * width, int.from_bytes

    def agreed(i: int, j: int) -> int:
        i, j = i * width, j * width
        x = number(p[i : i + size], "little") ^ number(q[j : j + size], "little")
        return ((x & -x).bit_length() - 1) // bits if x else STEP

    out: list[tuple[int, int, int]] = []
    i = j = edits = began = 0
    while i < n and j < m:
        left = min(n - i, m - j)
        differ = (signs[i : i + AHEAD] != others[j : j + AHEAD]).nonzero()[0].tolist()
        ahead = AHEAD
        for k, after in zip(differ, [*differ[1:], AHEAD]):
            if k >= left:
                ahead = left
                break
            if after == AHEAD and k > ahead - ALONE and k:
                ahead = k  # what comes after it is seen from there
                break
            edits += 1
            run = after - k - 1
            if run < ALONE:
                fewer = agreed(i + k + 1, j + k)
                more = agreed(i + k, j + k + 1) if fewer < AGREED else 0
                if fewer > run or more > run:
                    ahead, run = k, max(fewer, more)
                    i, j = (i + 1, j) if fewer >= more else (i, j + 1)
            if run >= AGREED and i + k - began >= STRETCH:
                began = i + k + 1 if ahead == AHEAD else i + k
                out.append((began, began - i + j, edits))
                edits = 0
            if ahead < AHEAD:
                break
        i, j = i + ahead, j + ahead
    i, j = min(i, n), min(j, m)
    out.append((n, m, edits + max(n - i, m - j)))
    return out


def banded(a: Sequence, b: Sequence, most: int) -> int:
    """Edits that turn a, the longer one, into b, if they are no more than `most`, else `most` or more: by the diagonals that a path of so many edits can reach.

    Outside of them every step counts as an edit, so that what is found is never too little.
    """
    n, m = len(a), len(b)
    above, below = (most - (n - m)) // 2, (most + (n - m)) // 2
    places: dict[object, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    match = {}
    for x in dict.fromkeys(b):
        marks = bytearray(n // 8 + 1)
        for i in places.get(x, ()):
            marks[i >> 3] |= 1 << (i & 7)
        match[x] = int.from_bytes(marks, "little")
    top = bottom = total = 0  # rows of the band, and the edits at its last one
    more = less = 0  # where a column rises and falls from one row to the next
    for at in range(0, m, COLUMNS):
        columns = b[at : at + COLUMNS]
        drop, bottom_before = max(0, at - above) - top, bottom
        top, bottom = top + drop, min(n, at + COLUMNS + below)
        new = bottom - bottom_before
        size = bottom - top
        every, last = (1 << size) - 1, size - 1
        more = more >> drop | ((1 << new) - 1) << (size - new)
        less >>= drop
        total += new
        near = {x: match[x] >> top & every for x in dict.fromkeys(columns)}
        for x in columns:
            mask = near[x]
            kept = mask | less
            across = ((((mask & more) + more) & every) ^ more) | mask
            up = less | (every ^ ((across | more) & every))
            down = more & across
            total += (up >> last & 1) - (down >> last & 1)
            up = (up << 1 | 1) & every
            down = down << 1 & every
            more = down | (every ^ ((kept | up) & every))
            less = up & kept
    return total


def _signs(a: Sequence, b: Sequence) -> tuple[str, str] | None:
    """Both as texts of a sign for each distinct item; None where there are more of them than signs."""
    if isinstance(a, str):
        return a, b
    kinds = {x: i for i, x in enumerate(dict.fromkeys((*a, *b)))}
    return ("".join([chr(kinds[x]) for x in a]), "".join([chr(kinds[x]) for x in b])) if len(kinds) <= 0x110000 else None


def edits(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and replacements of items that turn a into b."""
    n = min(len(a), len(b))
    start = 0
    while start < n and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < n - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    signs = _signs(a, b)
    if signs is None:
        return banded(a, b, len(a))
    a, b = signs
    least = least_edits(a, b)
    if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == least:
        return least
    stretches = aligned(a, b)
    most = sum(d for _, _, d in stretches)
    if most > least:
        i = j = most = 0
        for to_i, to_j, d in stretches:
            x, y = a[i:to_i], b[j:to_j]
            if d > least_edits(x, y):
                d = banded(x, y, d) if len(x) >= len(y) else banded(y, x, d)
            i, j, most = to_i, to_j, most + d
    return least if most == least else banded(a, b, most)


@F.pandas_udf(IntegerType())
def text_edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(IntegerType())
def word_edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else edits(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")
