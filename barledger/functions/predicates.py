"""Row predicates on prices and text flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE_COLUMNS = ("open", "high", "low", "close")


def finite_double(col: Column) -> Column:
    """The value as a double, or null when it is not a finite number."""
    x = col.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def is_not_finite(col: Column) -> Column:
    return finite_double(col).isNull()


def envelope_broken(o="open", h="high", low="low", c="close") -> Column:
    """High below, or low above, any of the other prices."""
    return (F.col(h) < F.greatest(o, c, low)) | (F.col(low) > F.least(o, c, h))


def any_nonpositive(cols: Sequence[str] = PRICE_COLUMNS) -> Column:
    return F.least(*cols) <= 0


def truthy(col: Column) -> Column:
    """Text or boolean flags: true, 1 and yes in any case count as true."""
    text = F.lower(F.trim(col.cast("string")))
    return F.coalesce(text.isin("true", "1", "yes"), F.lit(False))


def is_sha256(col: Column) -> Column:
    return F.coalesce(col.rlike("^[0-9a-f]{64}$"), F.lit(False))


def checksum_token(text: Column) -> Column:
    """First token of the first line of a checksum file; '*' marks count as blanks."""
    first_line = F.regexp_extract(F.trim(text), r"^([^\r\n]*)", 1)
    return F.lower(F.regexp_extract(F.translate(first_line, "*", " "), r"(\S+)", 1))


def log_return(net: Column) -> Column:
    """log(1 + net). A missing net return, or one of -100 % or worse, has no logarithm and stops the job.

    A null would be skipped by every sum, so that the worst bar vanished from the results.
    """
    stop = F.raise_error(F.concat(F.lit("no log return of "), F.coalesce(net.cast("string"), F.lit("a missing return")))).cast("double")
    return F.when(net > -1, F.log1p(net)).otherwise(stop)
