"""Order of archive files: a path as a key that sorts in the order in which archives are loaded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name up to its first run of digits and that run; what follows doesn't count.
_HEAD = r"^([^0-9]*)([0-9]*)"


def natural_key(path: Column) -> Column:
    """(depth, numbered, prefix, number) of a path with / or \\ between its parts, to be sorted ascending: deeper files come first; of one depth those without a number, or with 0, before
    others; then by the name before the number, with as many spaces as the number has digits; then by number. A number of more than 38 digits counts as none."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    name = F.element_at(parts, -1)
    digits = F.regexp_extract(name, _HEAD, 2)
    number = F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return F.struct((-F.size(parts)).alias("depth"), (number != 0).alias("numbered"), F.concat(F.regexp_extract(name, _HEAD, 1), F.repeat(F.lit(" "), F.length(digits))).alias("prefix"), number.alias("number"))
