"""Data sources for the two binary files of census geography: DBF tables and shapefiles of polygons.

Both take filters (column = value, column in values) into the scan: a record is left as bytes until its filtered fields have been
looked at. Files are opened where they are read, through the file system that their path names; Spark offers filters to Python
sources only where spark.sql.python.filterPushdown.enabled is on (see enable)."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

Field = tuple[str, int, int]


def enable(spark: SparkSession) -> SparkSession:
    """Register both sources and have filters offered to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (DbfSource, ShapeSource):
        spark.dataSource.register(source)
    return spark


def opened(path: str):
    """A seekable file: a local path, or a URI of any file system that Arrow knows (file, hdfs and viewfs by libhdfs, s3, gs)."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return system.open_input_file(name)


def parse_header(f) -> tuple[int, int, int, list[Field]]:
    """(records, place of the first, record size, fields as (name, offset, width)) of a DBF file."""
    f.seek(0)
    records, first, size = struct.unpack("<IHH", f.read(32)[4:12])
    fields, at = [], 1
    for _ in range((first - 33) // 32):
        x = f.read(32)
        fields.append((x[:11].split(b"\0")[0].decode("ascii"), at, x[16]))
        at += x[16]
    return records, first, size, fields


def text_of(record: bytes, field: Field) -> str:
    return record[field[1] : field[1] + field[2]].decode("latin-1").strip()


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class FilteredReader(DataSourceReader):
    """Takes the filters that compare a column of the table with values; wanted maps such a column to the values that pass."""

    columns: tuple[str, ...] = ()

    def __init__(self) -> None:
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in self.columns:
                yield f  # Spark does it
                continue
            name = f.attribute[0]
            self.wanted[name] = self.wanted.get(name, values) & values


def _ranges(n: int, parts: int) -> list[Range]:
    step = max(1, -(-n // max(1, parts)))
    return [Range(k, min(n, k + step)) for k in range(0, n, step)] or [Range(0, 0)]


class DbfSource(DataSource):
    """spark.read.format("dbf").load(path): every field as text. Option columns (comma-separated) prunes the scan; option
    partitions cuts the records into that many ranges, read apart. Deleted records are left out."""

    @classmethod
    def name(cls) -> str:
        return "dbf"

    def _wanted(self) -> list[Field]:
        with opened(self.options["path"]) as f:
            fields = parse_header(f)[3]
        names = [x.strip() for x in self.options.get("columns", "").split(",") if x.strip()]
        known = {x[0]: x for x in fields}
        if missing := [x for x in names if x not in known]:
            raise ValueError(f"no such DBF fields: {missing}")
        return [known[x] for x in names] if names else fields

    def schema(self) -> StructType:
        return StructType([StructField(x[0], StringType()) for x in self._wanted()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return DbfReader(self.options["path"], self._wanted(), int(self.options.get("partitions", "4")))


class DbfReader(FilteredReader):
    def __init__(self, path: str, fields: list[Field], parts: int):
        super().__init__()
        self.path, self.fields, self.parts = path, fields, parts
        self.columns = tuple(x[0] for x in fields)

    def partitions(self) -> list[Range]:
        with opened(self.path) as f:
            return _ranges(parse_header(f)[0], self.parts)

    def read(self, partition: Range) -> Iterator[tuple]:
        tests = [(x, self.wanted[x[0]]) for x in self.fields if x[0] in self.wanted]
        with opened(self.path) as f:
            _, first, size, _ = parse_header(f)
            f.seek(first + partition.start * size)
            for _ in range(partition.start, partition.end):
                row = f.read(size)
                if len(row) < size:
                    return
                if row[:1] != b"*" and all(text_of(row, x) in values for x, values in tests):
                    yield tuple(text_of(row, x) for x in self.fields)


class ShapeSource(DataSource):
    """spark.read.format("shp").load(path of the .shp): a row a polygon record, its fields of the .dbf beside it as text and rings, an
    array of rings of (x, y). Partitions are ranges of records, found by the offsets of the .shx beside it; a filtered record's shape is not read."""

    @classmethod
    def name(cls) -> str:
        return "shp"

    def _fields(self) -> list[Field]:
        with opened(self.options["path"][:-4] + ".dbf") as f:
            return parse_header(f)[3]

    def schema(self) -> StructType:
        point = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
        return StructType([*[StructField(x[0], StringType()) for x in self._fields()], StructField("rings", ArrayType(ArrayType(point)))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShapeReader(self.options["path"], self._fields(), int(self.options.get("partitions", "8")))


class ShapeReader(FilteredReader):
    def __init__(self, path: str, fields: list[Field], parts: int):
        super().__init__()
        self.stem, self.fields, self.parts = path[:-4], fields, parts
        self.columns = tuple(x[0] for x in fields)

    def partitions(self) -> list[Range]:
        with opened(self.stem + ".shx") as f:
            words = struct.unpack(">I", f.read(28)[24:28])[0]
        return _ranges((2 * words - 100) // 8, self.parts)

    def read(self, partition: Range) -> Iterator[tuple]:
        tests = [(x, self.wanted[x[0]]) for x in self.fields if x[0] in self.wanted]
        with opened(self.stem + ".shx") as index, opened(self.stem + ".dbf") as table, opened(self.stem + ".shp") as shapes:
            _, first, size, _ = parse_header(table)
            index.seek(100 + 8 * partition.start)
            table.seek(first + partition.start * size)
            for _ in range(partition.start, partition.end):
                at, words = struct.unpack(">II", index.read(8))
                row = table.read(size)
                if row[:1] == b"*" or not all(text_of(row, x) in values for x, values in tests):
                    continue
                shapes.seek(2 * at + 8)
                yield (*[text_of(row, x) for x in self.fields], polygon(shapes.read(2 * words)))


def polygon(body: bytes) -> list[list[tuple[float, float]]]:
    """The rings of the content of a polygon record; none for a null shape."""
    kind = struct.unpack("<I", body[:4])[0]
    if kind == 0:
        return []
    if kind != 5:
        raise ValueError("not a polygon")
    parts, points = struct.unpack("<II", body[36:44])
    starts = [*struct.unpack(f"<{parts}I", body[44 : 44 + 4 * parts]), points]
    flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
    return [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
