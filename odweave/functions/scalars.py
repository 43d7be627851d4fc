"""Column functions: comparison, cleaning, conversion and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from odweave.operators.translate import clean


def is_close(a: Column, b: Column, relative: float = 1e-4, absolute: float = 0.0) -> Column:
    """Whether two numbers are nearly equal; infinities only equal themselves."""
    return (a == b) | ((F.abs(a) != float("inf")) & (F.abs(b) != float("inf")) & (F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))))


def all_close(values: Column, relative: float = 1e-4, absolute: float = 0.0) -> Column:
    """Whether all elements of an array are nearly equal to the first; true for an empty one."""
    return F.forall(values, lambda x: is_close(x, values[0], relative, absolute))


def clip_small(x: Column, least: float) -> Column:
    """Positive values under least raised to it."""
    return F.when((x > 0) & (x < least), F.lit(least).cast("double")).otherwise(x)


def is_none_like(x: Column) -> Column:
    """Whether a string is null or says none, in any case and with space around it."""
    return x.isNull() | (F.lower(F.trim(x)) == "none")


def all_none_like(xs: Column) -> Column:
    """Whether all elements of an array are none-like."""
    return xs.isNull() | F.forall(xs, is_none_like)


def starts_with(x: Column, pattern: str) -> Column:
    """Whether a string begins with a match of a regular expression."""
    return x.rlike(f"^(?:{pattern})")


#: The characters that a plain name may have.
NAME_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789!#$%£&-.<=>+^_~()"


def normalised_name(name: str) -> str:
    """A column name in lower case, spaces as underscores and dashes without space, of NAME_CHARACTERS only."""
    import re

    kept = re.sub(r"\s+", "_", re.sub(r"\s*-\s*", "-", name.strip().lower()))
    return "".join(c for c in kept if c in NAME_CHARACTERS)


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns' names in their plain form; two that become one raise."""
    names = [normalised_name(c) for c in df.columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns that have the same plain name: {', '.join(twice)}")
    return df.toDF(*names)


def to_numeric(df: DataFrame, column: str, errors: str = "raise", kind: str = "double") -> DataFrame:
    """df with a column as numbers: errors raises at a value that isn't one, coerces it to null, or ignores.

    With ignore a column that holds any such value stays as it is, which one aggregate decides.
    """
    c = F.col(column)
    if errors == "raise":
        return df.withColumn(column, c.cast(kind))
    if errors == "coerce":
        return df.withColumn(column, c.try_cast(kind))
    if errors != "ignore":
        raise ValueError("errors is raise, coerce or ignore")
    bad = df.agg(F.count_if(c.isNotNull() & c.try_cast(kind).isNull())).first()[0]
    return df if bad else df.withColumn(column, c.cast(kind))


def duration(ms: Column) -> Column:
    """Milliseconds as hours, minutes and seconds; negative ones raise."""
    s = F.when(ms < 0, F.raise_error(F.lit("a duration is not negative")).cast("double")).otherwise(ms / 1000)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    text = F.format_string("%.2fs", s % 60)
    return F.when(h > 0, F.format_string("%dhrs %dm %.2fs", h, m, s % 60)).when(m > 0, F.format_string("%dm %.2fs", m, s % 60)).otherwise(text)


def clock(format: str = "yyyy-MM-dd HH:mm:ss", at: Column | None = None) -> Column:
    """A time, by default when the query began, as text."""
    return F.date_format(F.current_timestamp() if at is None else at, format)


def milliseconds(at: Column | None = None) -> Column:
    """A time, by default when the query began, as milliseconds since 1970."""
    return F.unix_millis(F.current_timestamp() if at is None else at)


def rmse(pairs: DataFrame, target: str, achieved: str) -> DataFrame:
    """(rmse) over all rows."""
    return pairs.agg(F.sqrt(F.avg(F.pow(F.col(target).cast("double") - F.col(achieved).cast("double"), 2))).alias("rmse"))


def nan_report(df: DataFrame, keys: Sequence[str], output: str, inputs: Sequence[str]) -> DataFrame:
    """Keys, output and inputs of the rows whose output is null or NaN."""
    return df.filter(clean(output).isNull()).select(*keys, output, *inputs)


def require_numbers(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise ValueError unless all these columns are of numbers."""
    odd = [c for c in columns if not isinstance(df.schema[c].dataType, NumericType)]
    if odd:
        raise ValueError(f"columns that aren't of numbers: {', '.join(odd)}")
