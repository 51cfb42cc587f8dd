"""Checksums as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eleven_test(digits: Column) -> Column:
    """Nine digits, the first not 0, with weights 9 to 2 and -1 adding up to a positive multiple of 11."""
    weights = (9, 8, 7, 6, 5, 4, 3, 2, -1)
    total = sum((F.substring(digits, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    return F.coalesce((F.length(digits) == 9) & (F.substring(digits, 1, 1) != "0") & (total % 11 == 0) & (total != 0), F.lit(False))


def mod_97(iban: Column) -> Column:
    """ISO 13616: the first four characters go to the end, letters become 10 to 35, and the number's remainder by 97 is 1."""
    compact = F.upper(F.regexp_replace(iban, r"(?U)\s", ""))
    turned = F.concat(compact.substr(F.lit(5), F.length(compact)), compact.substr(1, 4))
    value = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("^[A-Z]$"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    return F.coalesce(F.array_join(value, "").try_cast("decimal(38,0)") % 97 == 1, F.lit(False))


def luhn(number: Column) -> Column:
    digits = F.regexp_replace(number, r"(?U)[\s\-]", "")
    return F.coalesce(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), F.lit(False))
