"""Hash-seeded integers: the same on every run, partitioning, retry and engine."""

import hashlib

from pyspark.sql import functions as F


def hash32(*parts):
    """First 32 bits of the MD5 of the parts joined with '|', as a bigint."""
    text = F.concat_ws("|", *[p if hasattr(p, "cast") else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts):
    """Double in [0, 1) fixed by the parts."""
    return hash32(*parts) / F.lit(4294967296.0)


def path_set_key(paths):
    """MD5 name of a set of paths: independent of their order."""
    return F.md5(F.array_join(F.array_sort(paths), ""))


def permutation_seeds(count, modulus):
    """`count` pairs (a, b) of a linear hash family modulo a prime, from a fixed rule."""

    def number(tag, i):
        return int(hashlib.md5(f"{tag}|{i}".encode()).hexdigest()[:8], 16)

    return [(1 + number("a", i) % (modulus - 1), number("b", i) % modulus) for i in range(count)]
