"""A keyed permutation of 0 .. size - 1 as columns: any place of a shuffled range without the rest of it.

A number below size is a pair (low, high) on a grid of sides a and b, a = ceil(sqrt(size)). Half-rounds of a Feistel network take turns: a keyed
mixing of one is added to the other, modulo its side, which can always be undone. Fewer than a pairs of the grid lie outside the range; a
number that lands there walks on along its cycle until it is back inside.
"""

from pyspark.sql import functions as F

PRIME = 2147483647
HALF_ROUNDS = 8
MOST_STEPS = 66  # more than the pairs outside for sizes to 4096; beyond, a walk this long has no chance to happen, and is an error


def keys(hasher):
    """Key columns k0, k1, ...: two numbers below PRIME for each half-round. `hasher(tag)` is a 32-bit hash."""
    return {f"k{i}": hasher(f"key{i}") % PRIME for i in range(2 * HALF_ROUNDS)}


def _mixed(value, k, m):
    at = (value + k) % PRIME
    return (at * at + m) % PRIME


def _sides(size):
    a = F.greatest(F.ceil(F.sqrt(size)).cast("bigint"), F.lit(1).cast("bigint"))
    return a, F.greatest(F.call_function("div", size + a - 1, a).cast("bigint"), F.lit(1).cast("bigint"))


def _walked(x, size, a, b):
    """`x`, or the first number inside the range that follows it."""

    def halves(i):
        def two(pair):
            low, high = pair["l"], pair["h"]
            low = (low + _mixed(high, F.col(f"k{4 * i}"), F.col(f"k{4 * i + 1}"))) % a
            return F.struct(low.alias("l"), ((high + _mixed(low, F.col(f"k{4 * i + 2}"), F.col(f"k{4 * i + 3}"))) % b).alias("h"))

        return two

    def once(x):
        pair = F.struct((x % a).alias("l"), F.call_function("div", x, a).cast("bigint").alias("h"))
        for i in range(HALF_ROUNDS // 2):
            pair = F.transform(F.array(pair), halves(i))[0]
        return F.transform(F.array(pair), lambda p: p["h"] * a + p["l"])[0]

    found = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), x, lambda at, _: F.when(at < size, at).otherwise(once(at)))
    endless = F.raise_error(F.lit("a walk outside the range did not end")).cast("bigint")
    return F.transform(F.array(found), lambda y: F.when(y < size, y).otherwise(endless))[0]


def permuted(df, number, size, name):
    """`df` with the place `name` of column `number` (0 .. size - 1) in the order that its key columns set. The key columns go.

    Each half-round is a projection, so it runs in generated code; only numbers that leave the range walk in lambdas. The place is declared
    never null: a join on it would else push a null check down, and write all half-rounds out as one expression.
    """
    kept = [c for c in df.columns if not (c.startswith("k") and c[1:].isdigit())]
    a, b = _sides(F.col(size))
    df = df.withColumns({"__a": a, "__b": b})
    df = df.withColumns({"__l": F.col(number) % F.col("__a"), "__h": F.call_function("div", F.col(number), F.col("__a")).cast("bigint")})
    for j in range(HALF_ROUNDS):
        mine, other, side = ("__l", "__h", "__a") if j % 2 == 0 else ("__h", "__l", "__b")
        df = df.withColumn(mine, (F.col(mine) + _mixed(F.col(other), F.col(f"k{2 * j}"), F.col(f"k{2 * j + 1}"))) % F.col(side))
    df = df.withColumn("__x", F.col("__h") * F.col("__a") + F.col("__l"))
    inside = F.col("__x") < F.col(size)
    at = F.when(inside, F.col("__x")).otherwise(_walked(F.col("__x"), F.col(size), F.col("__a"), F.col("__b")))
    return df.select(*kept, F.coalesce(at, F.lit(-1).cast("bigint")).alias(name))
