"""CSV files inside archives as a data source of Spark: a partition for each run of members, read as streams in its task.

A run is one member, or as many small ones as have PART bytes. Members of a zip or of a plain tar are read from their own
places; a compressed tar is one run, as what stands before a member has to be unpacked first.

All values come as strings; types are given in the plan, where a cell that isn't of its type is null and is named in the
column ``rejected``, and a line with another number of cells than the header is kept as text in ``rejected_line``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of archives and of compressed files that only this source reads, and of those that it reads too.
ARCHIVES = (".zip", ".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz", ".xz", ".zst")
OTHERS = (".gz", ".bz2", ".csv")
#: Bytes that a task reads at once.
BLOCK = 1 << 20
#: Bytes of a run of members at most, unless one has more, and runs that less than that is cut into, about.
PART, PARTS = 64 << 20, 64
#: Bytes that could be read while a member is opened, and while its entry in a zip's directory is read; each task reads that whole.
OPENING, ENTRY = 64 << 10, 8 << 10

FORMAT = "csv_members"
MEMBER, LINE = "member", "rejected_line"


def _source() -> type:
    """The data source. It is made here, with all that it needs, so that workers get it by value."""
    import bz2
    import gzip
    import io
    import lzma
    import tarfile
    import zipfile

    import pyarrow as pa
    from pyarrow import csv, fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    known, block, part, parts, opening, entry = ARCHIVES + OTHERS, BLOCK, PART, PARTS, OPENING, ENTRY

    def opened(path: str):
        if path.startswith("file:"):
            path = "/" + path[len("file:") :].lstrip("/")
        system, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return system, own

    def files(path: str) -> list[str]:
        system, own = opened(path)
        info = system.get_file_info(own)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            return [path]
        inside = system.get_file_info(fs.FileSelector(own, recursive=True))
        return [f"{path.rstrip('/')}/{x.path[len(own) :].lstrip('/')}" for x in sorted(inside, key=lambda x: x.path) if x.is_file and x.base_name.lower().endswith(known)]

    def raw(path: str):
        system, own = opened(path)
        return io.BufferedReader(system.open_input_file(own))

    def is_tar(path: str) -> bool:
        return path.lower().endswith((".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz"))

    def places(path: str) -> list[tuple] | None:
        """(bytes, place) of each member, if it can be read without those before it."""
        if path.lower().endswith(".zip"):
            with raw(path) as f, zipfile.ZipFile(f) as z:
                return [(x.file_size, i) for i, x in enumerate(z.infolist()) if not x.is_dir()]
        if not is_tar(path):
            return None
        try:
            with raw(path) as f, tarfile.open(fileobj=f, mode="r:") as t:
                return [(x.size, (x.name, x.offset_data, x.size, x.sparse)) for x in t if x.isfile()]
        except tarfile.ReadError:  # it is compressed
            return None

    def runs(path: str, found: list[tuple], most: float) -> list[list]:
        """The places of members in runs of most bytes, of more if a zip's directory is long."""
        if path.lower().endswith(".zip"):
            most = max(most, entry * len(found))
        out, size = [], most
        for n, place in found:
            if size + n + opening > most:
                out.append([])
                size = 0
            out[-1].append(place)
            size += n + opening
        return out

    def streams(path: str, run: list | None = None):
        """(member, stream) of the members of a run, or of all, one after another."""
        f, low = raw(path), path.lower()
        if low.endswith(".zip"):
            z = zipfile.ZipFile(f)
            all_ = z.infolist()
            for x in [x for x in all_ if not x.is_dir()] if run is None else [all_[i] for i in run]:
                yield x.filename, z.open(x)
        elif is_tar(path):
            t = tarfile.open(fileobj=f, mode="r:*")
            for name, offset, size, sparse in run or ():
                x = tarfile.TarInfo(name)
                x.offset_data, x.size, x.sparse = offset, size, sparse
                yield name, t.extractfile(x)
            while run is None and (x := t.next()) is not None:
                t.members = []  # it would keep all
                if x.isfile():
                    yield x.name, t.extractfile(x)
        else:
            yield "", plain(f, low)

    def plain(f, low: str):
        if low.endswith(".zst"):
            import zstandard

            return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(f))
        for suffix, kind in ((".gz", gzip), (".bz2", bz2), (".xz", lzma)):
            if low.endswith(suffix):
                return kind.open(f)
        return f

    def merged(batches):
        """Batches of a block at least, but for the last, as a small member's would cost more to send than to read."""
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= block:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def reader(source, columns: Sequence[str] | None, odd: list) -> csv.CSVStreamingReader | None:
        def kept(row) -> str:
            odd.append(row.text or "")
            return "skip"

        some = {} if columns is None else {"include_columns": list(columns), "include_missing_columns": True}
        types = {} if columns is None else dict.fromkeys(columns, pa.string())
        try:
            return csv.open_csv(
                source,
                read_options=csv.ReadOptions(block_size=block, use_threads=False),
                parse_options=csv.ParseOptions(newlines_in_values=True, invalid_row_handler=kept),
                convert_options=csv.ConvertOptions(column_types=types, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""], **some),
            )
        except pa.ArrowInvalid as e:
            if "mpty CSV" in str(e):
                return None
            raise

    class Run(InputPartition):
        def __init__(self, path: str, places: list | None):
            self.path, self.places = path, places

    class Members(DataSourceReader):
        def __init__(self, path: str, schema):
            self.path, self.columns = path, [f.name for f in schema.fields][:-2]

        def partitions(self) -> list[Run]:
            found = [(p, places(p)) for p in files(self.path)]
            most = min(part, sum(n + opening for _, of in found for n, _ in of or ()) / parts)
            return [Run(p, run) for p, of in found for run in ([None] if of is None else runs(p, of, most))]

        def read(self, partition: Run):
            if partition is None:  # a folder without members
                return iter(())
            return merged(self.batches(partition))

        def batches(self, run: Run):
            names, archive = [*self.columns, MEMBER, LINE], run.path.rsplit("/", 1)[-1]
            for member, source in streams(run.path, run.places):
                odd: list[str] = []
                name = f"{archive}/{member}".rstrip("/")

                def batch(columns: list, n: int, lines: list, name: str = name):
                    return pa.RecordBatch.from_arrays([*columns, pa.array([name] * n, pa.string()), pa.array(lines, pa.string())], names=names)

                for b in reader(source, self.columns, odd) or ():
                    yield batch([b.column(c) for c in self.columns], len(b), [None] * len(b))
                if odd:
                    yield batch([pa.nulls(len(odd), pa.string()) for _ in self.columns], len(odd), odd)

    class CsvMembers(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self):
            from pyspark.sql.types import StringType, StructType

            names: list[str] = []
            for path in files(self.options["path"]):
                for _, source in streams(path):
                    if (got := reader(source, None, [])) is not None:
                        names = got.schema.names
                        break
                if names:
                    break
            out = StructType()
            for n in [*names, MEMBER, LINE]:
                out = out.add(n, StringType())
            return out

        def reader(self, schema):
            return Members(self.options["path"], schema)

    return CsvMembers


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a CSV file, an archive of such, or a folder of them, as strings, with ``member`` and ``rejected_line``.

    The first member's header names the columns; a member that lacks one has nulls there, and its others are left out.
    """
    spark.dataSource.register(_source())
    return spark.read.format(FORMAT).load(path)


def _bad(c: str, kind: str) -> Column:
    return F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kind).isNull()


def strict_cast(c: str, kind: str, name: str) -> Column:
    """A column in another type; a value that isn't of it raises, with the names of file and column."""
    said = F.concat(F.lit(f"column '{c}' of {name} has a value that is no {kind}: "), F.col(f"`{c}`").cast("string"))
    return F.when(_bad(c, kind), F.raise_error(said).cast(kind)).otherwise(F.col(f"`{c}`").try_cast(kind)).alias(c)


def typed(raw: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Strings in their types, with ``rejected``: (column, value) of each cell of a row that isn't of its type."""
    cells = [F.when(_bad(c, t), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"))) for c, t in types.items()]
    rejected = F.array_compact(F.array(*cells)) if cells else F.array().cast("array<struct<column: string, value: string>>")
    columns = [F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in raw.columns]
    return raw.select(*columns, rejected.alias("rejected"))


def rejects(table: DataFrame) -> DataFrame:
    """(column, n) of the rejected cells of a table of ``typed``; lines with too many or few cells stand under a null."""
    cells = table.select(F.explode("rejected").alias("c")).groupBy(F.col("c.column").alias("column")).agg(F.count("*").alias("n"))
    if LINE not in table.columns:
        return cells
    lines = table.agg(F.count(LINE).alias("n")).filter("n > 0").select(F.lit(None).cast("string").alias("column"), "n")
    return cells.unionByName(lines)


def require_types(table: DataFrame, name: str) -> DataFrame:
    """A table of ``typed``, unless it has rejected cells or lines: that raises ValueError with each column and its number."""
    if wrong := sorted(((r["column"] or "a line's length", r["n"]) for r in rejects(table).collect())):
        raise ValueError(f"{name} has values that aren't of their type: " + ", ".join(f"{n} in {c}" for c, n in wrong))
    return table


def inferred(raw: DataFrame) -> DataFrame:
    """Columns of strings as integers or doubles where all their values are."""
    kinds = ("bigint", "double")
    if not raw.columns:
        return raw
    row = raw.agg(*[F.count_if(_bad(c, k)).alias(f"{k}_{i}") for i, c in enumerate(raw.columns) for k in kinds], *[F.count(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(raw.columns)]).first()
    fit = [next((k for k in kinds if row[f"n_{i}"] and not row[f"{k}_{i}"]), "string") for i in range(len(raw.columns))]
    return raw.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(raw.columns, fit, strict=True)])


def write_members(df: DataFrame, folder: str, by: str, suffix: str = ".zip", rows: int = 100_000) -> DataFrame:
    """Write the rows of each value of ``by`` as an archive in folder, of CSV members of so many rows; (archive, members), when run."""
    if suffix not in (".zip", ".tar", ".tar.gz", ".tar.bz2", ".tar.xz"):
        raise ValueError(f"{suffix} is no archive")

    def pack(t):
        import io
        import tarfile
        import zipfile

        import pyarrow as pa
        from pyarrow import csv, fs

        path = "/" + folder[len("file:") :].lstrip("/") if folder.startswith("file:") else folder
        system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(base, recursive=True)
        name, parts = f"{t[by][0].as_py()}{suffix}", []
        for at in range(0, len(t), rows):
            sink = io.BytesIO()
            csv.write_csv(t.slice(at, rows), sink)
            parts.append((f"part-{len(parts):04d}.csv", sink.getvalue()))
        with system.open_output_stream(f"{base}/{name}") as out:
            if suffix == ".zip":
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for n, data in parts:
                        z.writestr(n, data)
            else:
                with tarfile.open(fileobj=out, mode="w|" + suffix.removeprefix(".tar").removeprefix(".")) as tar:
                    for n, data in parts:
                        info = tarfile.TarInfo(n)
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
        return pa.table({"archive": [name], "members": [len(parts)]})

    return df.groupBy(by).applyInArrow(pack, "archive string, members long")
