"""Array columns of doubles: softmax, top-k, cross-entropy, block fingerprints."""

from pyspark.sql import functions as F

from quillspark.functions.text import bind


def doubles(array):
    return array.cast("array<double>")


def _exp_sum(logits, top):
    return F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))


def softmax(logits):
    """Probabilities; the maximum is taken off first, so no exponential overflows."""

    def scaled(s):
        return bind(
            F.struct(s["x"].alias("x"), s["top"].alias("top"), _exp_sum(s["x"], s["top"]).alias("z")),
            lambda t: F.transform(t["x"], lambda x: F.exp(x - t["top"]) / t["z"]),
        )

    return bind(F.struct(logits.alias("x"), F.array_max(logits).alias("top")), scaled)


def top1(values, names):
    """Name of the largest entry; the first one wins a tie."""
    at = F.array_position(values, F.array_max(values)).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in names]), at)


def target_rank(logits, target):
    """How many entries come before the target's (0 = best); earlier entries win ties."""

    def count(s):
        return F.size(
            F.filter(
                F.transform(s["x"], lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                lambda e: (e["x"] > s["v"]) | ((e["x"] == s["v"]) & (e["i"] < s["t"])),
            )
        )

    at_target = F.element_at(logits, target + 1)
    return bind(F.struct(logits.alias("x"), at_target.alias("v"), target.alias("t")), count)


def cross_entropy(logits, target):
    def loss(s):
        return F.log(_exp_sum(s["x"], s["top"])) + s["top"] - F.element_at(s["x"], s["t"] + 1)

    return bind(F.struct(logits.alias("x"), F.array_max(logits).alias("top"), target.alias("t")), loss)


def median_block_hash(block):
    """Hex text of 64 bits, one per coefficient: set where it is over the block's median.

    A block of another size is an error.
    """
    wrong = F.raise_error(F.concat(F.lit("not a block of 64: "), F.size(block)))
    block = F.when(block.isNull() | (F.size(block) == 64), block).otherwise(wrong.cast("array<double>"))

    def of(s):
        half = F.size(s["x"]) / F.lit(2)
        low, high = F.element_at(s["o"], half.cast("int")), F.element_at(s["o"], half.cast("int") + 1)
        return bind(
            F.struct(s["x"].alias("x"), ((low + high) / 2).alias("m")),
            lambda t: F.array_join(
                F.transform(t["x"], lambda v: F.when(v > t["m"], F.lit("1")).otherwise(F.lit("0"))), ""
            ),
        )

    bits = bind(F.struct(block.alias("x"), F.array_sort(block).alias("o")), of)
    return F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0"))
