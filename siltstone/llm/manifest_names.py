"""How splits, hashes and family names of a manifest are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAIN, EVALUATION = "train", ("calibration", "test")
#: Bits of a set of splits.
SPLIT_BITS = {"train": 1, "calibration": 2, "test": 4}
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def split_name(column: str) -> Column:
    """The split without case and surrounding blanks; null for anything else."""
    name = F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return F.when(name.isin(*SPLIT_BITS), name)


def split_bit(column: str) -> Column:
    name = split_name(column)
    bit = F.lit(0)
    for split, value in SPLIT_BITS.items():
        bit = F.when(name == split, F.lit(value)).otherwise(bit)
    return bit


def usable_hash(column: str) -> Column:
    """64 hex digits without case, blanks around them and the prefix sha256:; null for placeholders."""
    text = F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", "")), r"^sha256:\s*", "")
    return F.when(text.rlike("^[0-9a-f]{64}$") & ~text.rlike(r"^(.)\1{63}$") & (text != EMPTY_SHA256), text)


def family_name(column: Column) -> Column:
    """A name without case, blanks, '-' and '_'; null if nothing is left."""
    name = F.regexp_replace(F.lower(column), r"[\s _-]+", "")
    return F.when(name != "", name)
