"""Code that runs in the Python workers. It is sent by value: executors need no install."""

import sys
import types
from operator import ne

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def bit_edits(ref, hyp):
    """Exact edit distance of two token sequences; null when one is.

    Where an alignment found in one pass needs no more edits than the token counts demand, that is the
    distance. Otherwise the first try looks at a band of diagonals as wide as the counts demand; while the
    distance is outside the band, the band doubles, up to the whole table.
    """
    from collections import Counter

    if ref is None or hyp is None:
        return None
    ref, hyp = list(ref), list(hyp)
    if ref == hyp:
        return 0
    if not ref or not hyp:
        return len(ref) or len(hyp)
    ref, hyp = _core(ref, hyp)
    if not ref or not hyp:
        return len(ref) or len(hyp)
    mine, other = Counter(ref), Counter(hyp)
    least = max(sum((mine - other).values()), sum((other - mine).values()))
    if _plain_edits(ref, hyp) == least:
        return least
    places = _places(ref)
    band = 64 + least + least // 8
    while 4 * band < len(ref):
        edits = _banded_edits(places, len(ref), hyp, band)
        if edits <= band:
            return edits
        band *= 2
    return _table_edits(places, len(ref), hyp)


def _core(ref, hyp):
    """Both without the tokens that they begin and end with alike: these cost no edits."""
    most = min(len(ref), len(hyp))
    first = next((i for i in range(most) if ref[i] != hyp[i]), most)
    last = next((i for i in range(most - first) if ref[-1 - i] != hyp[-1 - i]), most - first)
    return ref[first : len(ref) - last], hyp[first : len(hyp) - last]


def _plain_edits(ref, hyp):
    """The edits of one alignment, so at least the distance: token by token, or the shorter one's tokens in order within the longer."""
    if len(ref) == len(hyp):
        return sum(map(ne, ref, hyp))
    few, many = sorted((ref, hyp), key=len)
    rest = iter(many)
    return len(many) - len(few) if all(token in rest for token in few) else len(many)


def pair_counts(refs, hyps, pattern=None):
    """Edits and reference length per pair of token lists, or of texts cut by a pattern."""
    import re

    import pandas as pd

    cut = re.compile(pattern).findall if pattern else list
    edits, lengths = [], []
    for ref, hyp in zip(refs, hyps, strict=True):
        tokens = None if ref is None else cut(ref)
        lengths.append(None if tokens is None else len(tokens))
        if tokens is None or hyp is None:
            edits.append(None)
        elif pattern and ref == hyp:
            edits.append(0)
        else:
            edits.append(bit_edits(tokens, cut(hyp)))
    return pd.DataFrame({"edits": pd.array(edits, dtype="Int64"), "ref_tokens": pd.array(lengths, dtype="Int64")})


def _places(ref):
    """Per token, a bit for each place it has, as little-endian bytes."""
    found = {}
    for i, token in enumerate(ref):
        bits = found.get(token)
        if bits is None:
            bits = found[token] = bytearray(len(ref) // 8 + 1)
        bits[i >> 3] |= 1 << (i & 7)
    return found


def _table_edits(places, width, hyp):
    """All rows of a column as the bits of one number (Myers 1999, Hyyro 2003)."""
    where = {token: int.from_bytes(bits, "little") for token, bits in places.items()}
    every, last = (1 << width) - 1, 1 << (width - 1)
    up, down, edits = every, 0, width
    for token in hyp:
        same = where.get(token, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up = down | (every & ~(diagonal | up))
        right_down = up & diagonal
        if right_up & last:
            edits += 1
        elif right_down & last:
            edits -= 1
        right_up = ((right_up << 1) | 1) & every
        up = ((right_down << 1) & every) | (every & ~(diagonal | right_up))
        down = right_up & diagonal
    return edits


def _banded_edits(places, length, hyp, band):
    """As above for the rows within `band` of the diagonal only; a result over `band` is a bound.

    Bit p of column j stands for row j - band + p, so the vectors move down a row per column.
    """
    width = 2 * band + 1
    every, last = (1 << width) - 1, 1 << (2 * band)
    up, down, edits = every ^ ((1 << band) - 1), 0, band
    turn = length - band
    for column, token in enumerate(hyp, 1):
        first = column - band - 1
        bits = places.get(token)
        if bits is None:
            same = 0
        elif first < 0:
            same = (int.from_bytes(bits[: (width + first) // 8 + 1], "little") << -first) & every
        else:
            part = bits[first >> 3 : (first + width >> 3) + 1]
            same = (int.from_bytes(part, "little") >> (first & 7)) & every
        diagonal = ((((same & up) + up) ^ up) | same | down) & every
        right_up = down | (every ^ (diagonal | up))
        right_down = diagonal & up
        if column <= turn:
            edits += not diagonal & last
        else:
            last >>= 1
            if right_up & last:
                edits += 1
            elif right_down & last:
                edits -= 1
        below = diagonal >> 1
        up = right_down | (every ^ (below | right_up))
        down = below & right_up
    return edits


def loaded(name, version, factory):
    """The scorer built by `factory`, once per worker process and version; a new version takes the old one's place."""
    store = sys.modules.setdefault("_quillspark_scorers", types.ModuleType("_quillspark_scorers"))
    if getattr(store, name, (None,))[0] != version:
        setattr(store, name, (version, factory()))
    return getattr(store, name)[1]


def pixel_hash(height, width, channels, data, side):
    """Grey, 4x oversampled box resize, cosine transform, low block against its median, as hex."""
    import numpy as np

    if height is None or height <= 0 or data is None:
        return None
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(float)
    # channel order is blue, green, red
    grey = pixels[..., :3] @ [0.114, 0.587, 0.299] if channels >= 3 else pixels[..., 0]
    size = 4 * side

    def averaging(length):
        edges = np.linspace(0, length, size + 1)
        cells = np.arange(length)
        low = np.maximum(edges[:-1, None], cells)
        high = np.minimum(edges[1:, None], cells + 1)
        weights = np.clip(high - low, 0, None)
        return weights / weights.sum(axis=1, keepdims=True)

    small = averaging(height) @ grey @ averaging(width).T
    steps = np.arange(size)
    cosines = np.cos(np.pi * np.outer(steps, 2 * steps + 1) / (2 * size))
    low = (cosines @ small @ cosines.T)[:side, :side]
    return np.packbits(low > np.median(low)).tobytes().hex()
