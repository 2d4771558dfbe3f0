"""Sizes as text and back."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkloom.config import KIB, MIB


def human_size(n: Column) -> Column:
    """More than 1 MiB in MiB, more than 1 KiB in KiB, with the bytes in brackets; else bytes. Null stays null."""
    # halves go to the even digit, which format_string alone would round up
    scaled = lambda unit, name: F.format_string(f"%.1f {name} (%d bytes)", F.bround(n.cast("double") / unit, 1), n)
    return F.when(n > MIB, scaled(MIB, "MiB")).when(n > KIB, scaled(KIB, "KiB")).when(n.isNotNull(), F.format_string("%d bytes", n))


def parse_size(text: Column, strict: bool = True) -> Column:
    """Bytes of a whole number with B, KiB, MiB, GiB or nothing; other text is an error, or null if not strict."""
    pattern = "^([0-9]+)(B|KiB|MiB|GiB|)$"
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.when(unit == "KiB", F.lit(KIB)).when(unit == "MiB", F.lit(MIB)).when(unit == "GiB", F.lit(1 << 30)).otherwise(F.lit(1))
    wrong = F.raise_error(F.concat(text, F.lit(" is no size"))).cast("long") if strict else F.lit(None).cast("long")
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).cast("long") * factor.cast("long")).when(text.isNotNull(), wrong)
