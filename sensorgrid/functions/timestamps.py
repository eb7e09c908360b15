"""Timestamp strings of instruments as epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def millis(ntz: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, cut off, whatever the session's zone is."""
    return F.timestamp_diff("MILLISECOND", F.expr(EPOCH), F.col(ntz) if isinstance(ntz, str) else ntz)


def parse_millis(text: Column, numeric_unit: str = "ms") -> Column:
    """Milliseconds of a timestamp string, null for what no form fits.

    Forms: date and time with T (also quoted) or a blank, with or without a fraction; the same with a zone name and an
    offset, of which the offset counts; a bare number in `numeric_unit` (ms or s). Without an offset the time is UTC.
    """
    plain = F.regexp_replace(F.replace(text, F.lit("'T'"), F.lit("T")), r" [A-Z]+([+-]\d{4})$", " $1")
    offset = r" ([+-])(\d{2})(\d{2})$"
    sign, hours, minutes = (F.regexp_extract(plain, offset, k) for k in (1, 2, 3))
    shift = F.when(sign == "", F.lit(0)).otherwise((hours.try_cast("long") * 60 + minutes.try_cast("long")) * 60000)
    at = F.replace(F.regexp_replace(plain, offset, ""), F.lit("T"), F.lit(" "))
    # A timestamp without zone does not depend on the session's.
    local = F.when(F.rlike(at, F.lit(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$")), at.try_cast("timestamp_ntz"))
    number = F.when(F.rlike(text, F.lit(r"^-?\d+(\.\d+)?$")), F.round(text.try_cast("double") * (1000 if numeric_unit == "s" else 1)).cast("long"))
    return F.coalesce(millis(local) - F.when(sign == "-", -shift).otherwise(shift), number)
