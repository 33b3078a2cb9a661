"""Rounding and score helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c, places: int = 0) -> Column:
    """Round ties of the binary value towards plus infinity; Spark's round() goes by the decimal text."""
    k = float(10 ** places)
    scaled = _col(c) * F.lit(k)
    whole = F.floor(scaled)
    return (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / F.lit(k)


def clamp01(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(c)))


def round4(c) -> Column:
    return F.bround(_col(c), 4)


def keyed_hash(seed: int, c) -> Column:
    """Repeatable order key of a row: the same in any engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(c).cast("string")))


def seeded_score(seed: int, c) -> Column:
    """Score of 0.70 to 0.90 in whole hundredths, repeatable per key."""
    share = F.conv(F.substring(keyed_hash(seed, c), 1, 8), 16, 10).cast("double") / F.lit(float(16 ** 8))
    return half_up(F.lit(0.7) + share * F.lit(0.2), 2)


# Binary digits of a limb below the point, and the bound below which numbers are added up in limbs.
_LIMB = 52
_WHOLE = float(2 ** 53)


def exact_limbs(c) -> dict[str, Column]:
    """A number as whole numbers that add up without rounding: its whole part and two times 52 binary places below.

    A sum of limbs is the same in any order and any grouping. They are DECIMAL, whose sums have room for 2^40 numbers:
    a limb is below 2^53, their sum below 2^93, which takes 28 of 38 digits. Places below 2^-104 are cut off in each
    number alone. Infinities, NaN and numbers from 2^53 on, of which the fraction is gone anyway, are left to `huge`, a
    plain double.
    """
    x = _col(c)
    plain = F.abs(x) < F.lit(_WHOLE)
    near = F.when(plain, x)

    def shifted(rest: Column) -> Column:
        return rest * F.lit(float(2 ** _LIMB))

    whole = near.cast("bigint")
    below = shifted(near - whole)
    mid = below.cast("bigint")
    low = shifted(below - mid).cast("bigint")
    limbs = {name: part.cast("decimal(20,0)") for name, part in (("whole", whole), ("mid", mid), ("low", low))}
    return limbs | {"huge": F.when(~plain, x)}


def sum_limbs(limbs: dict[str, Column]) -> dict[str, Column]:
    """Sums of limbs, or of such sums, as aggregates of the same types."""
    return {k: F.sum(c) if k == "huge" else F.sum(c).cast("decimal(38,0)") for k, c in limbs.items()}


def from_limbs(limbs: dict[str, Column]) -> Column:
    """The sum that limbs stand for, rounded once; null if nothing was added."""
    unit = F.lit(float(2 ** _LIMB))
    over = F.pmod(limbs["mid"], F.lit(2 ** _LIMB).cast("decimal(20,0)"))
    whole = limbs["whole"].cast("double") + (limbs["mid"] - over).cast("double") / unit
    total = whole + (over.cast("double") + limbs["low"].cast("double") / unit) / unit
    return F.when(limbs["huge"].isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + limbs["huge"])
