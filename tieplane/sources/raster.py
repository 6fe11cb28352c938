"""Rasters of one byte a sample, as a data source: a text label, then lines of fixed length.

    spark.dataSource.register(RasterSource)
    lines = spark.read.format("raster").load(path).filter("tile = 3 AND row >= 1000 AND row < 2000")
    lines.write.format("raster").mode("append").save(path)

A line is a row: tile, row, pixels (binary). A file is read in strips of lines, each a task of its own, and filters on tile and row
choose files and lines before anything is read. Each task writes files of its own; a folder's committed files are those that its
indexes name, and an index is written once all tasks are done.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "tile int, row long, pixels binary"
#: Bytes of a strip, about, and of the part of a file in which its label ends.
STRIP, LABEL = 8 << 20, 1 << 16
#: Bytes before the lines of a written file.
HEAD = 1024


@dataclass
class Layout:
    """Where lines lie in a file: the first byte, bytes from line to line, bytes before a line's samples, lines and samples."""

    offset: int
    stride: int
    prefix: int
    lines: int
    samples: int
    tile: int = 0
    first: int = 0

    def at(self, line: int) -> int:
        return self.offset + line * self.stride + self.prefix


def read_label(head: bytes) -> dict[str, str]:
    """``KEY = value`` lines up to END; values lose quotes."""
    out = {}
    for line in head.decode("latin-1").splitlines():
        if line.strip() == "END":
            return out
        if m := re.match(r"\s*(\^?\w+)\s*=\s*\"?([^\"]*)", line):
            out[m[1]] = m[2].strip()
    raise ValueError("a raster's label has no END")


def layout_of(label: dict[str, str]) -> Layout:
    """The layout that a label states: ^IMAGE counts records from 1, or bytes where it says so."""
    number = lambda key, default: int(label.get(key, str(default)).split()[0])  # noqa: E731  units may follow
    if number("SAMPLE_BITS", 8) != 8:
        raise ValueError("only samples of 8 bits are read")
    samples, prefix = int(label["LINE_SAMPLES"].split()[0]), number("LINE_PREFIX_BYTES", 0)
    stride = prefix + samples + number("LINE_SUFFIX_BYTES", 0)
    offset = (number("^IMAGE", 1) - 1) * (1 if "BYTE" in label.get("^IMAGE", "").upper() else number("RECORD_BYTES", stride))
    return Layout(offset, stride, prefix, int(label["LINES"].split()[0]), samples, number("TILE", 0), number("FIRST_LINE", 0))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-zA-Z][\w+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), path


def _write(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Written under another name first, so a reader meets it whole or not at all."""
    with fs.open_output_stream(f"{path}.tmp") as out:
        out.write(data)
    fs.move(f"{path}.tmp", path)


def committed(path: str) -> list[dict]:
    """The files of a folder that an index names: name, tile, first line and lines."""
    fs, where = _open(path)
    names = [f.path for f in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)) if re.search(r"/_index-[0-9a-f]+\.json$", f.path)]
    out = []
    for name in sorted(names):
        with fs.open_input_stream(name) as f:
            out += json.loads(f.read())
    return out


@dataclass
class Strip(InputPartition):
    name: str
    tile: int
    first: int
    begin: int
    end: int


class RasterReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.options = path, options
        self.tiles: set | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what bounds tile or row; all else stays with Spark."""
        for f in filters:
            name = getattr(f, "attribute", (None,))[0]
            if name == "tile" and isinstance(f, EqualTo | In):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tiles = found if self.tiles is None else self.tiles & found
            elif name == "row" and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif name == "row" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == "row" and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def _layout(self, fs: pafs.FileSystem, name: str) -> Layout:
        """Of the label, or of the options offset, stride, prefix, lines and samples for files without one."""
        if "samples" in self.options:
            o = {k: int(v) for k, v in self.options.items() if k in ("offset", "stride", "prefix", "lines", "samples", "tile", "first")}
            return Layout(**({"offset": 0, "prefix": 0, "stride": o["samples"]} | o))
        with fs.open_input_file(name) as f:
            return layout_of(read_label(f.read(LABEL)))

    def partitions(self) -> list[Strip]:
        fs, where = _open(self.path)
        info = fs.get_file_info(where)
        files = [{"name": where}] if info.type == pafs.FileType.File else [f | {"name": f"{where}/{f['name']}"} for f in committed(self.path)]
        out = []
        for f in files:
            if "tile" not in f:  # one file of another origin
                at = self._layout(fs, f["name"])
                f |= {"tile": at.tile, "first": at.first, "lines": at.lines, "samples": at.samples}
            if self.tiles is not None and f["tile"] not in self.tiles:
                continue
            begin, end = max(0, self.low - f["first"]), min(f["lines"], self.high - f["first"])
            step = max(1, STRIP // max(1, f["samples"]))
            out += [Strip(f["name"], f["tile"], f["first"], a, min(end, a + step)) for a in range(begin, end, step)]
        return out

    def read(self, strip: Strip | None) -> Iterator[pa.RecordBatch]:
        if strip is None:  # nothing is left to read
            return
        fs, _ = _open(self.path)
        at = self._layout(fs, strip.name)
        with fs.open_input_file(strip.name) as f:
            f.seek(at.at(strip.begin))
            data = f.read((strip.end - strip.begin - 1) * at.stride + at.samples)
        if len(data) < (strip.end - strip.begin - 1) * at.stride + at.samples:
            raise ValueError(f"{strip.name} ends before line {strip.end}")
        lines = [data[k * at.stride : k * at.stride + at.samples] for k in range(strip.end - strip.begin)]
        rows = range(strip.first + strip.begin, strip.first + strip.end)
        yield pa.RecordBatch.from_arrays([pa.array([strip.tile] * len(lines), pa.int32()), pa.array(rows, pa.int64()), pa.array(lines, pa.binary())], ["tile", "row", "pixels"])


@dataclass
class Written(WriterCommitMessage):
    files: list


class RasterWriter(DataSourceWriter):
    """Writes runs of consecutive lines of a tile, each to a file with a label of its own."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.before = [f["name"] for f in committed(path)] if overwrite else []
        self.indexes = self._indexes() if overwrite else []

    def _indexes(self) -> list[str]:
        fs, where = _open(self.path)
        return [f.path for f in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)) if f.path.endswith(".json")]

    def write(self, rows) -> Written:
        fs, where = _open(self.path)
        fs.create_dir(where, recursive=True)
        out, run, at = [], [], None

        def close() -> None:
            tile, last, samples = at
            first, name = last - len(run) + 1, f"{uuid.uuid4().hex}.img"
            facts = {"RECORD_TYPE": "FIXED_LENGTH", "RECORD_BYTES": samples, "^IMAGE": f"{HEAD + 1} <BYTES>", "TILE": tile, "FIRST_LINE": first, "LINES": len(run), "LINE_SAMPLES": samples, "SAMPLE_BITS": 8, "SAMPLE_TYPE": "MSB_UNSIGNED_INTEGER"}
            head = "".join(f"{k} = {v}\r\n" for k, v in facts.items()) + "END\r\n"
            _write(fs, f"{where}/{name}", head.encode().ljust(HEAD) + b"".join(run))
            out.append({"name": name, "tile": tile, "first": first, "lines": len(run), "samples": samples})

        for r in rows:
            pixels = bytes(r["pixels"])
            if run and (at != (r["tile"], r["row"] - 1, len(pixels)) or len(run) * len(pixels) >= STRIP):
                close()
                run = []
            at = (r["tile"], r["row"], len(pixels))
            run.append(pixels)
        if run:
            close()
        return Written(out)

    def commit(self, messages: list) -> None:
        fs, where = _open(self.path)
        fs.create_dir(where, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        _write(fs, f"{where}/_index-{uuid.uuid4().hex}.json", json.dumps(files).encode())
        for old in [*self.indexes, *(f"{where}/{n}" for n in self.before)]:
            fs.delete_file(old)

    def abort(self, messages: list) -> None:
        fs, where = _open(self.path)
        for f in [f for m in messages if m is not None for f in m.files]:
            fs.delete_file(f"{where}/{f['name']}")


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options["path"], overwrite)


def register(spark) -> None:
    """Makes the format known and lets its reader see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)


def write_lines(lines: DataFrame, path: str, strip: int = 4096) -> None:
    """Writes (tile, row, pixels): strips of lines are dealt out, so a tile of any height is written by many tasks. Nulls in
    a column are an error of the writer; repeated lines are written as often as they come."""
    dealt = lines.select("tile", F.col("row").cast("long").alias("row"), "pixels").repartition("tile", F.floor(F.col("row") / strip)).sortWithinPartitions("tile", "row")
    dealt.write.format("raster").mode("append").save(path)


def to_byte(value: Column, low: Column, high: Column) -> Column:
    """A sample as 0 to 255, cut off, between the least and the greatest; 0 where these are equal."""
    return F.when(high > low, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))) * 255.0)).otherwise(0).cast("int")


def byte_range(samples: DataFrame, value: str, keys: list[str] = (), limit: float = 10_000.0) -> DataFrame:
    """The least and greatest sample of each key, as ``low`` and ``high``, without those of ``limit`` or more, which mark gaps."""
    return samples.filter(F.abs(F.col(value)) < limit).groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def pixels_of(values: Column) -> Column:
    """An array of 0 to 255 as bytes."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def values_of(pixels: Column) -> Column:
    """The bytes of a line as an array of int."""
    text = F.hex(pixels)
    return F.transform(F.sequence(F.lit(0), F.octet_length(pixels) - 1), lambda i: F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))


def repair_stripes(pixels: DataFrame, tile: str = "tile", row: str = "row", col: str = "col", value: str = "v") -> DataFrame:
    """Stretches each tile to 0..255 and replaces striped columns: (tile, row, col, v).

    A column differs from the columns beside it by a mean step each; where the smaller one is a 50th of the tile's range or more, it is
    a stripe and takes the mean of two columns on either side, weighted 1, 2, 2, 1, without its fraction. First and last columns never are; of missing columns
    the weight is left out; a tile of one value becomes 0.
    """
    k, r, c = F.col(tile), F.col(row), F.col(col)
    px = pixels.select(k.alias("tile"), r.alias("row"), c.alias("col"), F.col(value).cast("double").alias("v"))
    edge = px.groupBy("tile").agg(F.min("col").alias("_c0"), F.max("col").alias("_c1"))
    inner = px.join(edge, "tile").filter("col > _c0 AND col < _c1")
    spread = inner.groupBy("tile").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    beside = px.select("tile", "row", F.explode(F.array(F.struct((F.col("col") - 1).alias("col"), F.lit(1).alias("side")), F.struct((F.col("col") + 1).alias("col"), F.lit(-1).alias("side")))).alias("s"), F.col("v").alias("w")).select("tile", "row", "s.*", "w")
    steps = inner.join(beside, ["tile", "row", "col"]).groupBy("tile", "col", "side").agg(F.avg(F.abs(F.col("v") - F.col("w"))).alias("step"))
    stripes = steps.groupBy("tile", "col").agg(F.min("step").alias("step"), F.count(F.lit(1)).alias("n")).join(spread, "tile")
    stripes = stripes.filter((F.col("n") == 2) & (F.col("step") >= (F.col("_hi") - F.col("_lo")) / 50)).select("tile", "col", F.lit(True).alias("_stripe"))
    weights = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in ((-2, 1), (-1, 2), (1, 2), (2, 1))))
    donors = px.select("tile", "row", F.col("col").alias("_from"), "v", F.explode(weights).alias("s")).select("tile", "row", (F.col("_from") + F.col("s.d")).alias("col"), "v", "s.w").join(stripes.select("tile", "col"), ["tile", "col"], "left_semi")
    means = donors.groupBy("tile", "row", "col").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("_mean"))
    full = px.join(stripes, ["tile", "col"], "left").join(means, ["tile", "row", "col"], "left").join(spread, "tile", "left")
    best = F.when(F.col("_stripe"), F.floor(F.col("_mean"))).otherwise(F.col("v"))
    return full.select("tile", "row", "col", F.coalesce(to_byte(best, F.col("_lo"), F.col("_hi")), F.lit(0)).alias("v"))
