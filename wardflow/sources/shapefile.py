"""Polygon layers in the shapefile format, as a PySpark data source: spark.read.format("shp").load(path), df.write.format("shp").save(folder).

A path is a .shp file or a folder of them. A file is read in parts of about `split` bytes (an option): the .shx has each record's place at a place of its own, and the rows of the .dbf have one width, so a
part reads its own bytes of the three files and no others. A file without .shx is one part, read record by record. The columns are those of the
.dbf (text, long, double, boolean; dates as text), then rings (null for no geometry, empty for other types than polygons) and precinct_id, the record's
number, counted on through a folder's files in order of their names. A schema given to the reader names the columns that are wanted: others, and rings, are then not decoded. With the option `box` ("x1,y1,x2,y2") records whose
own box does not meet it are passed over before their points are read.

Writing: each task writes files of up to `roll` bytes, which are renamed to their places when all tasks have ended. Files are opened through pyarrow's file systems."""

from __future__ import annotations

import hashlib
import math
import posixpath
import struct
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from wardflow.functions.geometry import RINGS

POLYGONS = (5, 15, 25)
SPLIT, ROLL, TEXT = 16 << 20, 64 << 20, 80
Box = tuple[float, float, float, float]


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _bytes(disk: fs.FileSystem, path: str) -> bytes | None:
    if disk.get_file_info(path).type != fs.FileType.File:
        return None
    with disk.open_input_stream(path) as f:
        return f.read()


def _signed_area(pts: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:])) / 2


def shape(raw: bytes, box: Box | None = None, points: bool = True) -> tuple[bool, list | None]:
    """Whether a record's contents meet the box, and its rings; clockwise rings are outer ones. None: no geometry (which meets no box); []: another type, or the points are not wanted."""
    kind = struct.unpack_from("<i", raw)[0]
    if kind == 0:
        return box is None, None
    if kind not in POLYGONS:
        return box is None, []
    own = struct.unpack_from("<4d", raw, 4)
    if box is not None and (own[0] > box[2] or own[2] < box[0] or own[1] > box[3] or own[3] < box[1]):
        return False, None
    if not points:
        return True, []
    n, m = struct.unpack_from("<2i", raw, 36)
    starts = [*struct.unpack_from(f"<{n}i", raw, 44), m]
    xy = struct.unpack_from(f"<{2 * m}d", raw, 44 + 4 * n)
    pts = list(zip(xy[::2], xy[1::2]))
    return True, [(_signed_area(r) > 0, r) for r in (pts[a:b] for a, b in zip(starts, starts[1:]))]


def fields(raw: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type, width, decimals) of a .dbf."""
    out, at = [], 32
    while raw[at] != 0x0D:
        out.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        at += 32
    return out


def _cell(raw: bytes, kind: str, decimals: int, encoding: str):
    v = raw.decode(encoding, "replace").strip(" \0")
    if kind in "NF":
        try:
            return None if not v or v.startswith("*") else float(v) if decimals or kind == "F" else int(v)
        except ValueError:
            return None
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(v.upper())
    return v or None


class _Part(InputPartition):
    def __init__(self, path: str, first: int, end: int | None, before: int):
        """Records first to end (None: all, without .shx) of a file; before: the records of the files before it."""
        self.path, self.first, self.end, self.before = path, first, end, before


def _size(disk: fs.FileSystem, path: str) -> int | None:
    info = disk.get_file_info(path)
    return info.size if info.type == fs.FileType.File else None


def _stream(disk: fs.FileSystem, path: str) -> Iterator[bytes]:
    """The records' contents of a .shp, one after the other."""
    with disk.open_input_stream(path) as f:
        head = f.read(100)
        if len(head) < 100 or struct.unpack_from(">i", head)[0] != 9994:
            raise ValueError(f"{path} is no shapefile")
        while len(head := f.read(8)) == 8:
            yield f.read(struct.unpack(">i", head[4:])[0] * 2)


class ShapefileReader(DataSourceReader):
    def __init__(self, uri: str, columns: list[str], box: Box | None = None, split: int = SPLIT):
        self.uri, self.columns, self.box, self.split = uri, columns, box, split
        self.bytes_read = 0

    def partitions(self) -> list[_Part]:
        """Planned by the files' sizes alone."""
        disk, _ = opened(self.uri)
        out, before = [], 0
        for path in files(self.uri):
            index, size = _size(disk, path[:-4] + ".shx"), _size(disk, path) or 0
            if index is None:
                out.append(_Part(path, 0, None, before))
                before += self._rows(disk, path)
                continue
            n = max(0, index - 100) // 8
            step = max(1, math.ceil(n / max(1, math.ceil(size / self.split))))
            out += [_Part(path, k, min(n, k + step), before) for k in range(0, n, step)]
            before += n
        return out

    def _rows(self, disk: fs.FileSystem, path: str) -> int:
        head = self._at(disk, path[:-4] + ".dbf", 0, 32)
        return struct.unpack_from("<I", head, 4)[0] if head else sum(1 for _ in _stream(disk, path))

    def _at(self, disk: fs.FileSystem, path: str, first: int, n: int) -> bytes:
        if _size(disk, path) is None:
            return b""
        with disk.open_input_file(path) as f:
            f.seek(first)
            raw = f.read(n)
        self.bytes_read += len(raw)
        return raw

    def _contents(self, disk: fs.FileSystem, part: _Part) -> Iterator[bytes]:
        """The records' contents; a record's first bytes alone where neither points nor a box are wanted would save nothing, as they lie side by side."""
        if part.end is None:
            yield from _stream(disk, part.path)
            return
        own = struct.unpack(f">{2 * (part.end - part.first)}i", self._at(disk, part.path[:-4] + ".shx", 100 + 8 * part.first, 8 * (part.end - part.first)))
        places = [(2 * a + 8, 2 * n) for a, n in zip(own[::2], own[1::2])]
        low, high = min(a for a, _ in places), max(a + n for a, n in places)
        if high - low <= 2 * sum(n + 8 for _, n in places):  # records that lie together, as they mostly do
            raw = self._at(disk, part.path, low, high - low)
            yield from (raw[a - low : a - low + n] for a, n in places)
        else:
            yield from (self._at(disk, part.path, a, n) for a, n in places)

    def read(self, part: _Part | None) -> Iterator[tuple]:
        if part is None:
            return
        disk, _ = opened(self.uri)
        stem = part.path[:-4]
        code = self._at(disk, stem + ".cpg", 0, 64).decode("latin-1").strip() or "utf-8"
        try:
            "".encode(code)
        except LookupError:
            code = "latin-1"
        head = self._at(disk, stem + ".dbf", 0, 32)
        own, rows, width = {}, b"", 0
        if head:
            n, first, width = struct.unpack_from("<IHH", head, 4)
            at = 1
            for name, kind, w, decimals in fields(self._at(disk, stem + ".dbf", 0, first)):
                own[name] = (at, at + w, kind, decimals)
                at += w
            if set(self.columns) & set(own):
                rows = self._at(disk, stem + ".dbf", first + part.first * width, width * ((n if part.end is None else part.end) - part.first))
        points = "rings" in self.columns
        for k, raw in enumerate(self._contents(disk, part)):
            meets, rings = shape(raw, self.box, points)
            if not meets:
                continue
            line = rows[k * width : (k + 1) * width]
            out = []
            for c in self.columns:
                if c == "rings":
                    out.append(None if rings is None else [{"is_hole": hole, "pts": [{"x": x, "y": y} for x, y in pts]} for hole, pts in rings])
                elif c == "precinct_id":
                    out.append(part.before + part.first + k)
                else:
                    a, b, kind, decimals = own[c]
                    out.append(_cell(line[a:b], kind, decimals, code))
            yield tuple(out)


def files(uri: str) -> list[str]:
    disk, root = opened(uri)
    info = disk.get_file_info(root)
    if info.type == fs.FileType.Directory:
        return sorted(x.path for x in disk.get_file_info(fs.FileSelector(root)) if x.path.lower().endswith(".shp") and not x.base_name.startswith("_"))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    return [root]


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shp"

    def schema(self) -> StructType | str:
        disk, _ = opened(self.options["path"])
        found = {}
        for path in files(self.options["path"]):
            dbf = _bytes(disk, path[:-4] + ".dbf")
            own = [] if dbf is None else [f"`{name}` " + ("long" if kind == "N" and not d else "double" if kind in "NF" else "boolean" if kind == "L" else "string") for name, kind, _, d in fields(dbf)]
            found.setdefault(tuple(own), path)
        if len(found) > 1:
            raise ValueError(f"files of one folder differ in their columns: {', '.join(found.values())}")
        own = next(iter(found), ())
        return ", ".join([*own, f"rings {RINGS}", "precinct_id long"])

    def reader(self, schema) -> ShapefileReader:
        box = self.options.get("box")
        return ShapefileReader(self.options["path"], [f.name for f in schema], tuple(map(float, box.split(","))) if box else None, int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> ShapefileWriter:
        return ShapefileWriter(self.options["path"], schema, overwrite, int(self.options.get("roll", ROLL)), int(self.options.get("text", TEXT)))


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class ShapefileWriter(DataSourceWriter):
    """Columns but `rings` (and precinct_id, which the reader gives) become fields: text of up to `text` bytes, whole numbers, numbers, booleans."""

    def __init__(self, uri: str, schema: StructType, overwrite: bool, roll: int, text: int):
        self.uri, self.overwrite, self.roll = uri, overwrite, roll
        self.at = [f.name for f in schema if f.name not in ("rings", "precinct_id")]
        kinds = [(f.name, f.dataType) for f in schema if f.name in self.at]
        long = [n for n, _ in kinds if len(n.encode()) > 10]
        if long:
            raise ValueError(f"names of over 10 bytes: {', '.join(long)}")
        field = lambda t: ("L", 1, 0) if isinstance(t, T.BooleanType) else ("N", 20, 0) if isinstance(t, T.IntegralType) else ("F", 24, 16) if isinstance(t, (T.DoubleType, T.FloatType)) else ("C", text, 0)
        self.fields = [(n, *field(t)) for n, t in kinds]

    def write(self, iterator) -> _Written:
        from pyspark import TaskContext

        task, names, own = TaskContext.get().partitionId(), [], _Layer(self.fields)

        def put() -> None:
            # Names in order of the tasks and of their files; a repeated attempt writes files of its own.
            names.append(f"part-{task:06d}-{len(names):04d}-{uuid.uuid4().hex}")
            own.save(f"{self.uri}/_{names[-1]}.shp")

        for row in iterator:
            own.add((*(row[c] for c in self.at), row["rings"]))
            if own.size() >= self.roll:
                put()
                own = _Layer(self.fields)
        if own.rows:
            put()
        return _Written(names)

    def commit(self, messages) -> None:
        disk, root = opened(self.uri)
        disk.create_dir(root, recursive=True)
        if self.overwrite:
            for x in disk.get_file_info(fs.FileSelector(root)):
                if x.type == fs.FileType.File and not x.base_name.startswith("_"):
                    disk.delete_file(x.path)
        for name in (n for m in messages if m for n in m.names):
            for ext in (".cpg", ".dbf", ".shx", ".shp"):
                disk.move(f"{root}/_{name}{ext}", f"{root}/{name}{ext}")

    def abort(self, messages) -> None:
        disk, root = opened(self.uri)
        for name in (n for m in messages if m for n in m.names):
            for ext in (".shp", ".shx", ".dbf", ".cpg"):
                if _size(disk, f"{root}/_{name}{ext}") is not None:
                    disk.delete_file(f"{root}/_{name}{ext}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)


def parts(spark: SparkSession, uri: str, split: int = SPLIT // 4) -> DataFrame:
    """(path, first, end, before): the parts of a layer's files, a row each in a partition of its own, for SQL's shapefile_vertices."""
    _, root = opened(uri)
    scheme = uri.removesuffix(root) if uri.endswith(root) else ""
    found = [(scheme + p.path, p.first, p.end, p.before) for p in ShapefileReader(uri, [], split=split).partitions()]
    kind = "path string, first long, end long, before long"
    return spark.createDataFrame(spark.sparkContext.parallelize(found, len(found)), kind) if found else spark.createDataFrame([], kind)


def widths(uri: str) -> dict[str, int]:
    """Declared width of each field, by which lost leading zeros are restored."""
    disk, _ = opened(uri)
    return {name: width for path in files(uri)[:1] for name, _, width, _ in fields(_bytes(disk, path[:-4] + ".dbf") or bytes(32) + b"\r")}


def fingerprint(uri: str) -> dict:
    """SHA-256 and size of a layer's .shp and .dbf; empty if either is missing."""
    disk, root = opened(uri)
    out = {}
    for ext in (".shp", ".dbf"):
        raw = _bytes(disk, root[:-4] + ext)
        if raw is None:
            return {}
        out[ext] = {"sha256": hashlib.sha256(raw).hexdigest(), "size": len(raw)}
    return out


def load(spark: SparkSession, uri: str) -> DataFrame:
    """A layer with a `population` column, whatever its case or usual name; ValueError if there is none."""
    from wardflow.operators.validate import POPULATION, hint

    register(spark)
    df = spark.read.format("shp").load(uri)
    found = hint(df, POPULATION)
    if found is None:
        raise ValueError(f"no population column among {df.columns}")
    return df.withColumnRenamed(found, "population")


def inspect(spark: SparkSession, uri: str) -> dict:
    """What a layer holds: rows, column profile, geometry counts and guessed roles. Errors are reported as `error`, not raised."""
    from wardflow.operators import validate as V

    try:
        register(spark)
        df = V.coerced(spark.read.format("shp").load(uri))
        for c, w in widths(uri).items():
            if c.lower() in V.PRECINCT or "geoid" in c.lower():
                df = V.padded(df, c, w)
        return {
            "error": None,
            "layer": df,
            "columns": {r["column"]: r.asDict() for r in V.profile(df).collect()},
            "geometry": V.geometry_counts(df).first().asDict(),
            "population": V.hint(df, V.POPULATION, numbers=True),
            "precinct": V.hint(df, V.PRECINCT),
            "county": V.hint(df, V.COUNTY),
            "election": V.election_hint(df),
        }
    except Exception as e:  # a file that can't be read is a finding of the inspection
        return {"error": f"{type(e).__name__}: {e}"}


class _Layer:
    """A file's bytes, to which records are added one by one: what is held is what will be written. fields: (name, type, width, decimals)."""

    def __init__(self, fields: list[tuple[str, str, int, int]]):
        self.fields, self.rows = fields, 0
        self.body, self.index, self.lines = bytearray(), bytearray(), bytearray()

    def size(self) -> int:
        return len(self.body) + len(self.index) + len(self.lines)

    def add(self, row: tuple) -> None:
        """values..., rings, rings as the reader gives them."""
        rings = row[-1]
        if rings is None:
            rec = struct.pack("<i", 0)
        else:
            parts = [[(p["x"], p["y"]) for p in r["pts"]] for r in rings]
            parts = [p if (_signed_area(p) > 0) == r["is_hole"] else p[::-1] for p, r in zip(parts, rings)]
            pts = [p for part in parts for p in part]
            starts, n = [], 0
            for part in parts:
                starts.append(n)
                n += len(part)
            box = (min(x for x, _ in pts), min(y for _, y in pts), max(x for x, _ in pts), max(y for _, y in pts)) if pts else (0.0,) * 4
            rec = struct.pack("<i4d2i", 5, *box, len(parts), len(pts)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        cells = [("" if v is None else f"{v:.{d}f}" if t == "N" and d else repr(float(v)) if t == "F" else "FT"[v] if t == "L" else str(v)).encode() for v, (_, t, _, d) in zip(row, self.fields)]
        if any(len(c) > w for c, (_, _, w, _) in zip(cells, self.fields)):
            raise ValueError(f"values longer than their fields: {row[:-1]}")
        self.rows += 1
        self.index += struct.pack(">2i", 50 + len(self.body) // 2, len(rec) // 2)
        self.body += struct.pack(">2i", self.rows, len(rec) // 2) + rec
        self.lines += b" " + b"".join(c.rjust(w) if t in "NF" else c.ljust(w) for c, (_, t, w, _) in zip(cells, self.fields))

    def save(self, uri: str) -> None:
        disk, root = opened(uri)
        disk.create_dir(posixpath.dirname(root), recursive=True)
        head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + n // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
        size = 1 + sum(w for _, _, w, _ in self.fields)
        dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, self.rows, 33 + 32 * len(self.fields), size) + b"".join(struct.pack("<11sc4xBB14x", n.encode(), t.encode(), w, d) for n, t, w, d in self.fields) + b"\r"
        for ext, raw in ((".shp", (head(len(self.body)), self.body)), (".shx", (head(len(self.index)), self.index)), (".dbf", (dbf, self.lines, b"\x1a")), (".cpg", (b"UTF-8",))):
            with disk.open_output_stream(root[:-4] + ext) as f:
                for x in raw:
                    f.write(x)


def write(uri: str, names: list[tuple[str, str, int, int]], rows: list[tuple]) -> None:
    """A small layer from rows (values..., rings), rings as the reader gives them. names: (name, type, width, decimals)."""
    own = _Layer(names)
    for row in rows:
        own.add(row)
    own.save(uri)
