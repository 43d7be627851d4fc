"""CSV input with checks, matrices in long or square form, and files found by name."""

from __future__ import annotations

import time
import warnings
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from odweave.functions.scalars import normalised_name, plain_names
from odweave.operators.correspondence import Correspondence
from odweave.operators.reshape import square_zones, wide_to_long
from odweave.operators.translate import Losses, translate_matrix, translate_vector
from odweave.sources.archives import ARCHIVES, LINE, MEMBER, inferred, read_members, strict_cast
from odweave.sources.storage import write_sorted

#: Suffixes of files that can be read, in the order in which they are tried.
SUFFIXES = (".csv", ".csv.gz", ".csv.bz2", ".gz", ".bz2", ".zip", ".xz", ".zst", ".tar", ".tar.gz", ".tar.xz", ".tar.bz2")
#: First column names that a long matrix's header starts with.
ORIGIN_NAMES = ("o", "origin", "p", "production", "productions")


class MissingColumnsError(ValueError):
    """A file lacks columns that are asked for."""

    def __init__(self, name: str, columns: Sequence[str]):
        *most, last = columns
        super().__init__(f"{name} lacks columns: " + (f"{', '.join(most)} and {last}" if most else last))
        self.columns = list(columns)


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str | int] | None = None,
    types: Mapping[str, str] | None = None,
    name: str | None = None,
    normalise: bool = False,
    similar: bool = False,
) -> DataFrame:
    """A CSV file's columns, by name or place, in given types.

    normalise brings names to their plain form, in which columns and types are given then; two that become one
    raise. A value that isn't of its type raises when it is read, with its column's name; bad_values counts such.
    Archives, and compressed files that Spark has no codec for, are read member by member. similar takes a local file
    of the same stem with another suffix if there is no such file.
    """
    path = str(find_similar(path)) if similar else path
    raw = _strings(spark, path) if path.lower().endswith(ARCHIVES) else spark.read.option("header", True).option("inferSchema", types is None).csv(path)
    if types is None and path.lower().endswith(ARCHIVES):
        raw = inferred(raw)
    if normalise:
        raw = plain_names(raw)
    if normalise and (odd := [c for c in [*(columns or []), *(types or {})] if isinstance(c, str) and c != normalised_name(c)]):
        raise ValueError(f"names that aren't in their plain form: {', '.join(odd)}")
    wanted = [raw.columns[c] if isinstance(c, int) else c for c in columns] if columns is not None else raw.columns
    if lacking := [c for c in [*wanted, *(types or {})] if c not in raw.columns]:
        raise MissingColumnsError(name or path, lacking)
    types = types or {}
    return raw.select(*[strict_cast(c, types[c], name or path) if c in types else F.col(f"`{c}`") for c in wanted])


def _strings(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a CSV file or archive as strings; a line that has another number of cells than the header raises in an archive."""
    if not path.lower().endswith(ARCHIVES):
        return spark.read.option("header", True).csv(path)
    raw = read_members(spark, path)
    said = F.concat(F.lit(f"a line of {path} doesn't fit its header: "), F.col(LINE))
    return raw.filter(F.when(F.col(LINE).isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)).drop(MEMBER, LINE)


def bad_values(spark: SparkSession, path: str, types: Mapping[str, str]) -> DataFrame:
    """(column, n): values of a CSV file that can't be read as their column's type."""
    raw = _strings(spark, path)
    row = raw.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()).alias(c) for c, t in types.items()])
    return row.unpivot([], list(types), "column", "n").filter("n > 0")


def read_matrix(spark: SparkSession, path: str, form: str | None = None, header: bool | None = None, similar: bool = False) -> DataFrame:
    """(origin, destination, value) from a CSV file, long (three columns) or square (more, the first of zones).

    Unless told, a square file has a header, and a long one has if its first line begins as one; members of archives
    always have. Ids become integers
    if all can; zones on one side only warn and get null cells. similar is as in read_csv.
    """
    path = str(find_similar(path)) if similar else path
    archive = path.lower().endswith(ARCHIVES)
    if header is None and not archive:
        first = spark.read.text(path).first()
        header = first is None or len(first[0].split(",")) != 3 or has_header(first[0])
    raw = _strings(spark, path) if archive else spark.read.option("header", header).csv(path)
    form = form or ("long" if len(raw.columns) == 3 else "square" if len(raw.columns) > 3 else None)
    if form not in ("long", "square"):
        raise ValueError("a matrix file has three columns at least")
    long = raw.toDF("origin", "destination", "value") if form == "long" else wide_to_long(raw.withColumnRenamed(raw.columns[0], "origin"), "origin", "destination", "value")
    long = long.withColumn("value", F.col("value").cast("double"))
    ids = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("bigint").isNull()).alias(c) for c in ("origin", "destination")]
    odd = long.agg(*ids).first()
    if not odd.origin and not odd.destination:
        long = long.withColumns({c: F.col(c).cast("bigint") for c in ("origin", "destination")})
    return square_zones(long)


def has_header(first_line: str) -> bool:
    """Whether a long matrix's first line names its columns."""
    return first_line.split(",")[0].strip().strip('"').lower() in ORIGIN_NAMES


def read_correspondence(
    spark: SparkSession, path: str, source: str | int = 0, target: str | int = 1, factor: str | int | None = 2, generic: bool = False, check: bool = False
) -> Correspondence:
    """A correspondence from a CSV file; without a factor column every factor is 1. check warns of factors over 1 or under 0."""
    raw = read_csv(spark, path)
    at = lambda c: raw.columns[c] if isinstance(c, int) else c
    names = [at(source), at(target), *([at(factor)] if factor is not None else [])]
    if lacking := [n for n in names if n not in raw.columns]:
        raise MissingColumnsError(path, lacking)
    value = F.col(f"`{names[2]}`").cast("double") if factor is not None else F.lit(1.0)
    table = raw.select(F.col(f"`{names[0]}`"), F.col(f"`{names[1]}`"), value.alias("factors"))
    if check:
        wrong = table.agg(F.count_if(F.col("factors") > 1).alias("over"), F.count_if(F.col("factors") < 0).alias("under")).first()
        for n, what in ((wrong.over, "over 1"), (wrong.under, "under 0")):
            if n:
                warnings.warn(f"{n} factors of {path} are {what}", stacklevel=2)
    return Correspondence(table.toDF("from", "to", "factors")) if generic else Correspondence(table, names[0], names[1], "factors")


def write_csv(df: DataFrame, path: str, attempts: int = 5, wait: float = 1.0, order: Sequence[str] = ()) -> None:
    """Write a table as CSV with a header; a refused permission is tried again a few times.

    With an order, files hold ranges of it one after another, and their rows are sorted.
    """
    for n in range(attempts):
        try:
            if order:
                write_sorted(df, path, order, form="csv")
            else:
                df.write.mode("overwrite").option("header", True).csv(path)
            return
        except Exception as e:
            # the JVM's refusals come as errors of Spark
            if n + 1 == attempts or "permission denied" not in str(e).lower() and not isinstance(e, PermissionError):
                raise
            warnings.warn(f"{path} can't be written yet", stacklevel=2)
            time.sleep(wait)


def translate_vector_file(spark: SparkSession, vector: str, correspondence: str, out: str, zone: str | int = 0, check: bool = False, **columns) -> None:
    """A CSV vector's numeric columns, translated into another CSV. check warns of losses, as the writing job saw them."""
    raw, lookup = read_csv(spark, vector), read_correspondence(spark, correspondence, **columns)
    zone = raw.columns[zone] if isinstance(zone, int) else zone
    values = [f.name for f in raw.schema if f.name != zone and isinstance(f.dataType, NumericType)]
    if not values:
        warnings.warn("the vector has no columns of numbers", stacklevel=2)
        return
    losses = Losses() if check else None
    write_csv(translate_vector(raw, lookup, zone, values, check=losses or False), out)
    if losses:
        losses.warn(3)


def translate_matrix_file(spark: SparkSession, matrix: str, correspondence: str, out: str, **columns) -> None:
    """A CSV matrix in long or square form, translated into a long CSV in the order of its zones."""
    moved = translate_matrix(read_matrix(spark, matrix), read_correspondence(spark, correspondence, **columns))
    write_csv(moved, out, order=["origin", "destination"])


def require_file(path: str | Path) -> Path:
    """The path of a local file; FileNotFoundError if there is none."""
    if not (path := Path(path)).is_file():
        raise FileNotFoundError(path)
    return path


def without_suffixes(path: str | Path) -> Path:
    """A path without any of its suffixes."""
    path = Path(path)
    return path.with_name(path.name.split(".")[0]) if not path.name.startswith(".") else path


def find_similar(path: str | Path, suffixes: Sequence[str] = SUFFIXES) -> Path:
    """The path, or the first of the same stem with another suffix; FileNotFoundError if there is none."""
    path = Path(path)
    if path.is_file():
        return path
    stem = without_suffixes(path)
    for s in suffixes:
        if (found := stem.with_name(stem.name + s)).is_file():
            return found
    raise FileNotFoundError(f"neither {path} nor a file of the same name with {', '.join(suffixes)}")


def find_named(folder: str | Path, name: str, suffixes: Sequence[str]) -> Path:
    """The file of a name with the first of some suffixes; several, or others, warn."""
    files = [p for p in Path(folder).glob(f"{name}.*") if p.is_file()]
    fit = [p for s in suffixes for p in files if p.name == name + s]
    if not fit:
        raise FileNotFoundError(f"{name} with one of {', '.join(suffixes)} in {folder}")
    if len(files) > 1:
        warnings.warn(f"{len(files)} files are called {name}; {fit[0].name} is taken", stacklevel=2)
    return fit[0]
