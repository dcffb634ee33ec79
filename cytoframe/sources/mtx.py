"""Matrix Market coordinate files with name lists: a partitioned data source, a reader that checks, and a writer."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ingest import whole

_SCHEMA = pa.schema([("row", pa.int64()), ("column", pa.int64()), ("value", pa.float64()), ("mirrored", pa.bool_())])
#: Bytes of a partition, and of a block that is parsed at once.
PARTITION, BLOCK = 64 << 20, 4 << 20


@dataclass(frozen=True)
class Header:
    rows: int
    columns: int
    entries: int
    field: str = "integer"
    symmetry: str = "general"


def banner(line: str) -> tuple[str, str]:
    """(field, symmetry) of a banner; a file without one is taken as general integers."""
    words = line.lower().split()
    if not line.startswith("%%"):
        return "integer", "general"
    if words[:3] != ["%%matrixmarket", "matrix", "coordinate"] or len(words) != 5 or words[3] not in ("integer", "real", "pattern") or words[4] not in ("general", "symmetric"):
        raise ValueError(f"no coordinate matrix of whole or real numbers, general or symmetric: {line.strip()[:200]}")
    return words[3], words[4]


def header(lines: Iterator[bytes]) -> tuple[Header, int]:
    """The header from a file's first lines, and the bytes it takes."""
    field, symmetry, at = "integer", "general", 0
    for k, raw in enumerate(lines):
        at += len(raw)
        line = raw.decode(errors="replace").strip()
        if k == 0:
            field, symmetry = banner(line)
        if not line or line.startswith("%"):
            continue
        size = line.split()
        if len(size) != 3 or not all(x.isdigit() for x in size):
            raise ValueError(f"no size line: {line[:200]}")
        found = Header(*map(int, size), field, symmetry)
        if symmetry == "symmetric" and found.rows != found.columns:
            raise ValueError("a symmetric matrix must be square")
        return found, at
    raise ValueError("no size line")


def _lines(stream) -> Iterator[bytes]:
    """Lines of a stream, read block by block."""
    rest = b""
    while block := stream.read(1 << 16):
        *whole_, rest = (rest + block).split(b"\n")
        yield from (x + b"\n" for x in whole_)
    if rest:
        yield rest


@dataclass
class ByteRange(InputPartition):
    """Lines of a file that begin at ``first`` <= byte < ``last`` (None: its end, for files that can't be entered at a byte)."""

    path: str
    first: int
    last: int | None

    def __init__(self, path: str, first: int, last: int | None) -> None:
        super().__init__(path)
        self.path, self.first, self.last = path, first, last


def parse(block: bytes, known: Header) -> pa.RecordBatch:
    """Entries of whole lines, checked against the header; of a symmetric matrix those beside the diagonal twice."""
    width = 2 if known.field == "pattern" else 3
    words = np.array(block.split(), dtype=bytes)
    lines = [x for x in block.split(b"\n") if x.strip()]
    if len(words) != width * len(lines) or any(x.count(b"%") for x in lines):
        bad = next(x for x in lines if len(x.split()) != width or b"%" in x)
        raise ValueError(f"not an entry: {bad[:200].decode(errors='replace')}")
    table = words.reshape(-1, width)
    try:
        row, column = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64)
        value = table[:, 2].astype(np.float64) if width == 3 else np.ones(len(table))
    except ValueError as error:
        raise ValueError(f"not a number: {error}") from None
    out = (row < 1) | (row > known.rows) | (column < 1) | (column > known.columns)
    if out.any():
        k = int(out.argmax())
        raise ValueError(f"entry {row[k]} {column[k]} of a matrix of {known.rows} x {known.columns}")
    mirrored = np.zeros(len(row), bool)
    if known.symmetry == "symmetric":
        beside = row != column
        row, column = np.concatenate([row, column[beside]]), np.concatenate([column, row[beside]])
        value, mirrored = np.concatenate([value, value[beside]]), np.concatenate([mirrored, np.ones(beside.sum(), bool)])
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(column), pa.array(value), pa.array(mirrored)], schema=_SCHEMA)


class MatrixMarketReader(DataSourceReader):
    """Reads a file, or a folder of parts of which one has the header, in ranges of bytes; compressed files as a whole each."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size
        system, at = fs.FileSystem.from_uri(path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"no file {path}")
        parts = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
        self.files = sorted((f.path, f.size) for f in parts if f.type == fs.FileType.File and f.base_name[0] not in "._" and (f.size or f is info))
        self.begins: dict[str, int] = {}
        known = []
        for name, _ in self.files:
            with self._open(name) as stream:
                first = stream.read(2)
            if len(self.files) == 1 or first == b"%%":
                with self._open(name) as stream:
                    found, self.begins[name] = header(_lines(stream))
                known.append(found)
        if len(known) != 1:
            raise ValueError(f"{len(known)} headers in {path}")
        self.header = known[0]

    def _open(self, name: str):
        system, _ = fs.FileSystem.from_uri(self.path)
        stream = system.open_input_file(name) if not name.endswith(".gz") else gzip.open(io.BufferedReader(system.open_input_stream(name, compression=None)))
        return stream

    def partitions(self) -> list[ByteRange]:
        out = []
        for name, size in self.files:
            first = self.begins.get(name, 0)
            if name.endswith(".gz"):
                out.append(ByteRange(name, first, None))
            else:
                out += [ByteRange(name, lo, min(lo + self.size, size)) for lo in range(first, size, self.size)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with self._open(partition.path) as stream:
            entered = partition.first > self.begins.get(partition.path, 0)
            at = partition.first - entered
            stream.seek(at)
            rest, skip = b"", entered  # a line that begins before the range is the range before's
            while partition.last is None or at < partition.last:
                block = stream.read(BLOCK if partition.last is None else min(BLOCK, partition.last - at))
                if not block:
                    break
                at += len(block)
                rest += block
                if skip:
                    head, found, rest = rest.partition(b"\n")
                    if not found:
                        rest = b""
                        continue
                    skip = False
                done, found, tail = rest.rpartition(b"\n")
                if found:
                    rest = tail
                    if done.strip():
                        yield parse(done, self.header)
            # The last line goes on to its end.
            while rest and partition.last is not None and not rest.endswith(b"\n") and (block := stream.read(1 << 12)):
                head, found, _ = block.partition(b"\n")
                rest += head + found
            if rest.strip():
                yield parse(rest, self.header)


class MatrixMarketSource(DataSource):
    """``spark.read.format("mtx").load(path)``: row, column, value and mirrored (an entry that a symmetric file implies). Option ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return "row long, column long, value double, mirrored boolean"

    def reader(self, schema) -> MatrixMarketReader:
        return MatrixMarketReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION)))


def _names(spark: SparkSession, path: str, id_name: str, name: str) -> DataFrame:
    """Line k names row or column k. Lines are numbered within the file's blocks, and blocks by what precedes them."""
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.split("value", "\t")[0].alias(name))
    own = F.row_number().over(Window.partitionBy("block").orderBy("at"))
    sizes = lines.groupBy("block").agg(F.count(F.lit(1)).alias("n"))  # a row per block
    before = sizes.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    return lines.withColumn("own", own).join(before, "block").select((F.col("before") + F.col("own")).cast("long").alias(id_name), name)


def _by_text(spark: SparkSession, path: str) -> tuple[DataFrame, Header]:
    """Entries of one file by Spark's text reader, which reads any store that Spark does, and the header.

    The size line, the first that isn't a comment, has three whole numbers like an entry. It is the first that
    isn't a comment of the file's first block, so it is known by its place there.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = lines.first()
    known, _ = header(r["value"].encode() for r in [*([first] if first else []), *lines.where("trim(value) <> '' and not startswith(trim(value), '%')").take(1)])
    rest = lines.where("trim(value) <> '' and not startswith(trim(value), '%')")
    at = rest.where("block = 0").agg(F.min("at")).first()[0]
    parts = F.split(F.trim("value"), r"\s+")
    row, column = parts[0].cast("long"), parts[1].cast("long")
    bad = (F.size(parts) != (2 if known.field == "pattern" else 3)) | (row < 1) | (row > known.rows) | (column < 1) | (column > known.columns)
    value = F.lit(1.0) if known.field == "pattern" else parts[2].cast("double")
    entries = rest.where(F.col("at") != at).select(F.when(bad, F.raise_error(F.concat(F.lit(f"not an entry of a matrix of {known.rows} x {known.columns}: "), F.col("value")))).otherwise(row).alias("row"), column.alias("column"), value.alias("value"), F.lit(False).alias("mirrored"))
    if known.symmetry == "symmetric":
        entries = entries.union(entries.where("row <> column").select("column", "row", "value", F.lit(True)))
    return entries, known


def read_matrix(spark: SparkSession, path: str, by_text: bool = False, partition_bytes: int = PARTITION) -> DataFrame:
    """Counts of a coordinate matrix of ``gene cell value`` lines, ids from 1.

    It is read by the data source ``mtx``, or with ``by_text`` by Spark's text reader where only Spark reaches
    the file. A line that is no entry, an entry outside the dimensions and a value that is
    negative or not whole fail the query. The number of entries is compared to the header's before this returns, by
    one pass over the file. Repeated entries are summed up and zeros dropped.
    """
    if by_text:
        entries, known = _by_text(spark, path)
    else:
        spark.dataSource.register(MatrixMarketSource)
        known = MatrixMarketReader(path, partition_bytes).header
        entries = spark.read.format("mtx").option("partitionBytes", partition_bytes).load(path)
    found = entries.where("not mirrored").count()
    if found != known.entries:
        raise ValueError(f"{found} entries of {known.entries} in {path}")
    return entries.select(F.col("column").alias("cell_id"), F.col("row").alias("gene_id"), whole(F.col("value")).alias("cnt")).groupBy("cell_id", "gene_id").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def read_mtx(spark: SparkSession, folder: str, matrix: str = "matrix.mtx", genes: str = "genes.tsv", barcodes: str = "barcodes.tsv", by_text: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, cells, genes) of a folder with a matrix (see :func:`read_matrix`) and the names of its columns and rows."""
    return read_matrix(spark, f"{folder}/{matrix}", by_text), _names(spark, f"{folder}/{barcodes}", "cell_id", "cell_name"), _names(spark, f"{folder}/{genes}", "gene_id", "gene_name")


def write_mtx(counts: DataFrame, n_cells: int, n_genes: int, path: str) -> None:
    """Counts (ids from 1) as a folder of parts, one of which is the header; each task writes its own part."""
    spark = counts.sparkSession
    lines = counts.select(F.concat_ws(" ", "gene_id", "cell_id", "cnt").alias("value"))
    lines.write.mode("overwrite").text(path)
    top = [("%%MatrixMarket matrix coordinate integer general",), (f"{n_genes} {n_cells} {counts.count()}",)]
    spark.createDataFrame(top, "value string").coalesce(1).write.mode("append").text(path)
