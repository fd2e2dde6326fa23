"""Coercion expressions that reproduce lenient pandas-style parsing in Spark.

Spark separates NULL from NaN and accepts a few literals pandas rejects
(``'1.0d'``), so numeric coercion is guarded by a strict pattern first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

# Accepted numeric text (after trim) and infinity spellings.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_WORDS = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")

# Text that a sales file uses for a missing value.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The layout that needs no taking apart: Spark's cast reads it.
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?)?$"

# Date layouts.  A time and a zone may follow each; the wall-clock time counts.
_TIME = r"(?:[T ]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?)? *(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2})?$"
YEAR_FIRST = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + _TIME
COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})" + _TIME
YEAR_LAST = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})" + _TIME
MONTH_NAME = r"^([A-Za-z]{3,9})[.]? +([0-9]{1,2}),? +([0-9]{4})" + _TIME
NAME_BETWEEN = r"^([0-9]{1,2})[ -]+([A-Za-z]{3,9})[.]?,?[ -]+([0-9]{4})" + _TIME
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
PIVOT_YEAR = 69  # two-digit years from here on are 19xx


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_double(c, dtype: DataType | None = None, fill: float = 0.0) -> Column:
    """Numeric coercion: unparsable, NULL and NaN become ``fill``; inf is kept."""
    col = _col(c)
    if isinstance(dtype, NumericType):
        value = col.cast("double")
    else:
        text = F.trim(col.cast("string"))
        valid = text.rlike(NUMBER_PATTERN) | F.lower(text).isin(*INFINITY_WORDS)
        value = F.when(valid, text.try_cast("double"))
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(float(fill)))


def missing_to_null(c) -> Column:
    """NULL for a value that is one of ``MISSING_TOKENS`` as it stands."""
    col = _col(c)
    return F.when(~col.isin(*MISSING_TOKENS), col)


def _month_number(name: Column) -> Column:
    """Month of an English name or its first three letters (also "sept"); NULL for other words."""
    low = F.lower(name)
    known = low.isin(*MONTHS, *FULL_MONTHS, "sept")
    short = F.substring(low, 1, 3)
    return F.when(known, F.array_position(F.array(*[F.lit(m) for m in MONTHS]), short)).cast("int")


def parse_timestamp(c, day_first: bool = False) -> Column:
    """TIMESTAMP_NTZ of the known layouts; NULL for any other text and for impossible dates.

    Year-first dates (any of ``- / .``), ``yyyyMMdd``, numeric dates with the
    year last and dates with an English month name, each with an optional time
    and zone.  ``day_first`` decides how ``05/01/2024`` is read, whatever the
    separator; a date that this order makes impossible is NULL, not guessed.
    The zone is dropped and never applied, so the session's zone has no say.
    """
    col = _col(c)
    text = F.trim(col.cast("string"))
    middle = "$2|$1" if day_first else "$1|$2"
    # Each layout with its groups put in the order year|month|day|hour|minute|second|fraction.
    layouts = (
        (YEAR_FIRST, "$1|$2|$3|$4|$5|$6|$7"),
        (COMPACT, "$1|$2|$3|$4|$5|$6|$7"),
        (YEAR_LAST, f"$3|{middle}|$4|$5|$6|$7"),
        (MONTH_NAME, "$3|$1|$2|$4|$5|$6|$7"),
        (NAME_BETWEEN, "$3|$2|$1|$4|$5|$6|$7"),
    )

    def ordered(t: Column) -> Column:
        """The text in the order of the layout it has; what one layout has put in order no other one matches."""
        for pattern, groups in layouts:
            t = F.regexp_replace(t, pattern, groups)
        return t

    def build(part: Column) -> Column:
        def number(i: int) -> Column:
            return F.coalesce(F.nullif(part[i], F.lit("")).try_cast("int"), F.lit(0))

        short = number(0) + F.when(number(0) >= PIVOT_YEAR, 1900).otherwise(2000)
        second = F.concat(number(5).cast("string"), F.lit("."), F.rpad(part[6], 6, "0"))
        made = F.try_make_timestamp_ntz(
            F.when(F.length(part[0]) == 2, short).otherwise(number(0)),
            F.coalesce(_month_number(part[1]), number(1)),
            number(2),
            number(3),
            number(4),
            second.try_cast("decimal(16,6)"),
        )
        return F.when(F.size(part) == 7, made)

    # Lambdas keep a projection out of generated code but for their own branch, which ISO text never enters; as a
    # lambda's argument the parts are made once.
    apart = F.transform(F.array(text), lambda t: F.when(~t.contains("|"), F.split(ordered(t), "[|]")))
    return F.when(text.rlike(ISO), text.try_cast("timestamp_ntz")).otherwise(F.transform(apart, build)[0])


def parse_date(c, day_first: bool = False) -> Column:
    """``parse_timestamp`` truncated to a DATE (time of day dropped)."""
    return F.to_date(parse_timestamp(c, day_first))


def fill_unknown(c, value: str = "Unknown") -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(value))
