"""Position-selecting fingerprints: few places of a text, chosen by its content, that any two equal windows have in common.

Of the ``REACH`` grams in each window of ``SHINGLE_WIDTH`` bytes the one with the least hash is kept. What is kept depends on
the window alone, so texts that share a window keep the same gram of it: to find all shared windows, it is enough to compare the windows
around kept grams that both sides keep. About one byte in seven starts a kept gram.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tracewarden.functions.ranks import as_col
from tracewarden.functions.text import SHINGLE_WIDTH, trim_space

GRAM = 12
REACH = SHINGLE_WIDTH - GRAM + 1
#: windows whose hashes are in memory at once: few enough to stay in a core's cache; bytes of texts that are looked at together
PIECE, HELD = 1 << 14, 1 << 20
_STEP = 0x100000001B3


def kept_positions(texts: list[bytes]) -> list[np.ndarray]:
    """0-based starts of the kept grams of each text; a text shorter than a window keeps its start."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    found = []
    for at in range(0, len(data) - SHINGLE_WIDTH + 1, PIECE):
        part = data[at:at + PIECE + SHINGLE_WIDTH - 1].astype(np.uint64)
        n = len(part) - GRAM + 1
        # sums of 1, 2, 4 and 8 neighbours, each from the one before, make up a gram
        h, width, powers = part + np.uint64(1), 1, {}
        while width <= GRAM:
            powers[width] = h
            h = h[:len(h) - width] * np.uint64(pow(_STEP, width, 1 << 64)) + h[width:]
            width *= 2
        h, done = np.zeros(n, dtype=np.uint64), 0
        for width in sorted(powers, reverse=True):
            if GRAM & width:
                h = h * np.uint64(pow(_STEP, width, 1 << 64)) + powers[width][done:done + n]
                done += width
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        # the place in the window stands in the last bits, so that the leftmost of equal ones is the least
        m = len(part) - SHINGLE_WIDTH + 1
        h &= ~np.uint64(15)
        least = h[:m].copy()
        for k in range(1, REACH):
            np.minimum(least, h[k:k + m] | np.uint64(k), out=least)
        start = at + np.arange(m)
        places = start + (least & np.uint64(15)).astype(np.int64)
        inside = start + SHINGLE_WIDTH <= ends[np.searchsorted(ends, start, side="right")]
        # windows in a row keep grams in rising order
        places = places[inside]
        found.append(places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places)
    kept = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    cut = np.searchsorted(kept, ends)
    out = []
    for i, (n, end) in enumerate(zip(size, ends)):
        if n < SHINGLE_WIDTH:
            out.append(np.zeros(min(n, 1), dtype=np.int32))
        else:
            out.append((kept[cut[i - 1] if i else 0:cut[i]] - (end - n)).astype(np.int32))
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _kept_udf(texts: pd.Series) -> pd.Series:
    out, group, held = [], [], 0
    values = [b"" if t is None else bytes(t) for t in texts]
    for t in values:
        group.append(t)
        held += len(t)
        if held >= HELD:
            out += kept_positions(group)
            group, held = [], 0
    return pd.Series([p + 1 for p in out + kept_positions(group)])


def anchors(view: Column | str) -> Column:
    """array<struct<gram, around>> of a trimmed string: each kept gram and the bytes of all windows that hold it.

    A string shorter than a window is its own gram and its own surroundings.
    """
    def of(bound: Column) -> Column:
        b, n = bound["b"], F.octet_length(bound["b"])

        def one(p: Column) -> Column:
            low = F.greatest(p - (REACH - 1), F.lit(1))
            high = F.least(p + (SHINGLE_WIDTH - 1), n)
            whole = n < SHINGLE_WIDTH
            return F.struct(F.when(whole, b).otherwise(F.substring(b, p, F.lit(GRAM))).alias("gram"),
                            F.when(whole, b).otherwise(F.substring(b, low, high - low + 1)).alias("around"))

        return F.transform(bound["p"], one)

    # binding the bytes to a lambda variable keeps them from being computed once per gram
    b = F.encode(trim_space(as_col(view)), "UTF-8")
    return F.get(F.transform(F.array(F.struct(b.alias("b"), _kept_udf(b).alias("p"))), of), F.lit(0))


def windows_around(around: Column | str) -> Column:
    """Distinct windows of a kept gram's surroundings, as byte strings; short strings give themselves."""
    around = as_col(around)
    n = F.octet_length(around)
    cut = F.transform(F.sequence(F.lit(1), n - SHINGLE_WIDTH + 1), lambda i: F.substring(around, i, F.lit(SHINGLE_WIDTH)).cast("string"))
    return F.when(n <= SHINGLE_WIDTH, F.array(around.cast("string"))).otherwise(F.array_distinct(cut))
