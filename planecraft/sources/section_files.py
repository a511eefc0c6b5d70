"""Image files as a Spark source and sink of sections, both by byte range.

Source `sections`: every file is cut into splits of bytes, and small files are put together into one
split, as Spark does with its own files. A task reads
the header, finds the sections that begin in its split and are wanted by the pushed filters, and reads
only these, some megabytes at a time; so memory follows a plane's size and not a file's. Filters on t,
w and z are exact. Files that state each section's lowest and highest value beside its header (a zone
map) let filters on v_min and v_max skip sections unread; those stated as 0, 0, 0 aren't trusted.

Sink `sections`: tasks write their sections at their places into hidden files, each with its line of
the zone map; only when all tasks are done, and every section of a file has come exactly once, does
the file get its header and its name. A failed or repeated task leaves nothing behind. Files are
written by offset, so the folder must be one that all machines mount. With `gaps`, a file may lack
sections: those that came are marked beside the header, the others read as zeros elsewhere and
aren't given out here.
"""

from __future__ import annotations

import fnmatch
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from planecraft.plans.shipping import ship
from planecraft.plans.storage import checked
from planecraft.sources.image_files import MRC_ORDERS, MRC_TYPES, TIFF_KINDS, TIFF_SIZES

SCHEMA = "file string, t long, w long, z long, ny int, nx int, dtype string, wave double, pz double, py double, px double, v_min double, v_max double, v_mean double, data array<double>"
TYPES = [pa.string(), *[pa.int64()] * 3, *[pa.int32()] * 2, pa.string(), *[pa.float64()] * 7, pa.list_(pa.float64())]
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Bytes of a split, and of the planes read and given out at once.
SPLIT_BYTES, READ_BYTES = 64 << 20, 16 << 20
#: What opening a file counts for when small files are put together, in bytes.
OPEN_BYTES = 256 << 10
# Fixed values of the format: the header's size, the number that says that it has channels and frames, and where a section's floats have its lowest, highest and mean value.
HEADER, KNOWN, ZONE = 1024, -16224, (5, 6, 7)
#: Floats of a section beside the header in files written here; the first tells that it was written, they end with the zone map.
FLOATS = 8
#: The header's label of files that lack sections, and where it stands.
LACKING, LABEL = b"sections may be lacking", 224


@dataclass
class Layout:
    """Where a file's sections lie, and what its header says."""

    kind: str
    ny: int
    nx: int
    shape: tuple[int, int, int]  # nt, nw, nz
    order: str = "ZTW"  # the first letter runs fastest
    start: int = HEADER
    waves: list[float] = field(default_factory=list)
    pixel: tuple[float, float, float] = (1.0, 1.0, 1.0)
    zone: tuple[int, int] | None = None  # bytes of a section beside the header, and where its zone map begins there
    offsets: list[int] | None = None  # of sections that don't lie one after the other
    lacking: bool = False  # only sections with their mark beside the header are there

    @property
    def n(self) -> int:
        return self.shape[0] * self.shape[1] * self.shape[2]

    @property
    def size(self) -> int:
        return self.ny * self.nx * np.dtype(self.kind).itemsize

    def place(self, i: np.ndarray) -> dict[str, np.ndarray]:
        at = {}
        for axis in self.order:
            i, at[axis] = np.divmod(i, self.shape["TWZ".index(axis)])
        return at

    def index(self, t: int, w: int, z: int) -> int:
        at, i = {"T": t, "W": w, "Z": z}, 0
        for axis in reversed(self.order):
            i = i * self.shape["TWZ".index(axis)] + at[axis]
        return i

    def beginning(self, a: int, b: int) -> np.ndarray:
        """The sections whose first byte lies in [a, b)."""
        if self.offsets is not None:
            at = np.array(self.offsets, np.int64)
            return np.flatnonzero((at >= a) & (at < b))
        first, last = (min(max(-(-(x - self.start) // max(self.size, 1)), 0), self.n) for x in (a, b))
        return np.arange(first, last)

    def offset(self, i: int) -> int:
        return self.start + i * self.size if self.offsets is None else self.offsets[i]


def mrc_layout(head: bytes) -> Layout:
    mark = next((e for e in "<>" if struct.unpack(e + "i", head[12:16])[0] in MRC_TYPES and 0 < struct.unpack(e + "i", head[:4])[0] < 1 << 20), None)
    if mark is None:
        raise ValueError("not an MRC file of a known type")
    nx, ny, n, mode = struct.unpack(mark + "4i", head[:16])
    px, py, pz = struct.unpack(mark + "3f", head[40:52])
    extra = struct.unpack(mark + "i", head[92:96])[0]
    ints, floats = struct.unpack(mark + "2h", head[128:132])
    nt, order = struct.unpack(mark + "2h", head[180:184])
    nw, *waves = struct.unpack(mark + "6h", head[196:208])
    known = struct.unpack(mark + "h", head[96:98])[0] == KNOWN
    nt, nw = max(nt, 1), nw if 0 < nw <= (1 << 15 if known else 5) else 1
    if n % (nt * nw):
        nt = nw = 1
    each = 4 * (ints + floats)
    zone = (each, 4 * (ints + ZONE[0])) if floats > ZONE[-1] and extra >= each * n else None
    return Layout(mark + MRC_TYPES[mode], ny, nx, (nt, nw, n // (nt * nw)), MRC_ORDERS.get(order, "ZTW"), HEADER + extra, [float(v) for v in waves[:nw]], (pz, py, px), zone, lacking=zone is not None and head[LABEL : LABEL + len(LACKING)] == LACKING)


def npy_layout(f: pa.NativeFile) -> Layout:
    f.seek(0)
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran or kind.hasobject or not 2 <= len(shape) <= 5:
        raise ValueError("npy files of two to five axes in C order, holding numbers, are read")
    nt, nw, nz, ny, nx = (1,) * (5 - len(shape)) + tuple(shape)
    return Layout(kind.str, ny, nx, (nt, nw, nz), "ZWT", f.tell())


def tiff_layout(f: pa.NativeFile) -> Layout:
    """Of pages in one strip each, uncompressed, with one sample a pixel; only their lists of fields are read."""
    head = f.read_at(8, 0)
    mark = {b"II": "<", b"MM": ">"}.get(head[:2])
    if mark is None or struct.unpack(mark + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen, offsets, pages = struct.unpack(mark + "I", head[4:])[0], set(), [], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(mark + "H", f.read_at(2, at))[0]
        body = f.read_at(12 * n + 4, at + 2)
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack(mark + "HHI", body[12 * i : 12 * i + 8])
            if kind not in (1, 3, 4):
                continue
            size = TIFF_SIZES[kind] * count
            raw = body[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else f.read_at(size, struct.unpack(mark + "I", body[12 * i + 8 : 12 * i + 12])[0])
            fields[tag] = struct.unpack(f"{mark}{count}{'BHI'[(1, 3, 4).index(kind)]}", raw)
        if fields.get(259, (1,))[0] != 1 or fields.get(277, (1,))[0] != 1:
            raise ValueError("compressed or coloured TIFF pages aren't read")
        sizes, places = fields[279], fields[273]
        if any(a + n != b for a, n, b in zip(places, sizes, places[1:])):
            raise ValueError("TIFF pages whose strips don't follow each other aren't read")
        offsets.append(places[0])
        pages.add((fields[257][0], fields[256][0], f"{mark}{TIFF_KINDS[fields.get(339, (1,))[0]]}{fields.get(258, (8,))[0] // 8}"))
        at = struct.unpack(mark + "I", body[12 * n :])[0]
    if len(pages) != 1:
        raise ValueError("TIFF pages of one size and type are read")
    ny, nx, kind = pages.pop()
    return Layout(kind, ny, nx, (1, 1, len(offsets)), offsets=offsets)


def layout_of(name: str, f: pa.NativeFile) -> Layout:
    end = name.rsplit(".", 1)[-1].lower()
    if end in ("mrc", "dv", "st"):
        return mrc_layout(f.read_at(HEADER, 0))
    if end in ("tif", "tiff"):
        return tiff_layout(f)
    if end == "npy":
        return npy_layout(f)
    raise ValueError(f"no reader for .{end}")


ENDS = ("mrc", "dv", "st", "tif", "tiff", "npy")
TESTS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal, In: np.isin}


@dataclass
class Piece:
    path: str
    start: int
    end: int


@dataclass
class Split(InputPartition):
    pieces: list[Piece]


class SectionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.split, self.data = int(options.get("splitbytes", SPLIT_BYTES)), options.get("data", "true") == "true"
        self.cores = int(options.get("cores", 8))
        self.exact: list[tuple[str, type, object]] = []
        self.zones: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if type(f) in TESTS and name in ("t", "w", "z") and value is not None:
                self.exact.append((name, type(f), value))
                continue
            if (type(f), name) in {(k, "v_max") for k in (GreaterThan, GreaterThanOrEqual, EqualTo)} | {(k, "v_min") for k in (LessThan, LessThanOrEqual, EqualTo)}:
                self.zones.append((name, type(f), value))
            yield f

    def partitions(self) -> list[Split]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        kept = [f for f in files if f.is_file and f.base_name.rsplit(".", 1)[-1].lower() in ENDS and fnmatch.fnmatch(f.base_name, self.glob) and "/_" not in f.path[len(root) :]]
        pieces = [Piece(f.path, a, min(a + self.split, f.size)) for f in kept for a in range(0, f.size, self.split)]
        costs = [p.end - p.start + OPEN_BYTES for p in pieces]
        most, held, splits = min(self.split, max(sum(costs) // (2 * self.cores), OPEN_BYTES)), 0, []
        for piece, cost in zip(pieces, costs):
            if not splits or held + cost > most:
                splits.append(Split([]))
                held = 0
            splits[-1].pieces.append(piece)
            held += cost
        return splits

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for piece in split.pieces:
            yield from self.read_piece(store, piece)

    def read_piece(self, store: fs.FileSystem, split: Piece) -> Iterator[pa.RecordBatch]:
        with store.open_input_file(split.path) as f:
            layout = layout_of(split.path, f)
            i = layout.beginning(split.start, split.end)
            at = layout.place(i)
            for name, kind, value in self.exact:
                keep = TESTS[kind](at[name.upper()], value)
                i, at = i[keep], {k: v[keep] for k, v in at.items()}
            there, low, high, mean = self.zone_map(f, layout, i)
            if layout.lacking:
                i, at, low, high, mean = i[there != 0], {k: v[there != 0] for k, v in at.items()}, *(s[there != 0] for s in (low, high, mean))
            stated = ~((low == 0) & (high == 0) & (mean == 0))
            keep = np.ones(len(i), bool)
            for name, kind, value in self.zones:  # stated bounds are rounded outwards
                bound, beyond = (high, kind is not GreaterThan) if name == "v_max" else (low, kind is not LessThan)
                inside = (bound >= value if beyond else bound > value) if name == "v_max" else (bound <= value if beyond else bound < value)
                keep &= inside | ~stated
            i, at = i[keep], {k: v[keep] for k, v in at.items()}
            stats = [np.where(stated, s, np.nan)[keep] for s in (low, high, mean)]
            each = max(READ_BYTES // max(layout.size, 1), 1) if self.data else 1 << 16
            for a in range(0, len(i), each):
                yield self.batch(f, split, layout, i[a : a + each], {k: v[a : a + each] for k, v in at.items()}, [s[a : a + each] for s in stats])

    def zone_map(self, f: pa.NativeFile, layout: Layout, i: np.ndarray) -> np.ndarray:
        if layout.zone is None or not len(i):
            return np.zeros((4, len(i)))
        each, first = layout.zone
        raw = np.frombuffer(f.read_at(int(i[-1] - i[0] + 1) * each, HEADER + int(i[0]) * each), np.uint8).reshape(-1, each)
        floats = raw[i - i[0], first - 4 * ZONE[0] : first + 12].copy().view(layout.kind[0] + "f4").astype(float)
        return floats[:, [0, *ZONE]].T

    def batch(self, f: pa.NativeFile, split: Piece, layout: Layout, i: np.ndarray, at: dict[str, np.ndarray], stats: list[np.ndarray]) -> pa.RecordBatch:
        n, pixels = len(i), layout.ny * layout.nx
        if self.data:
            runs = np.split(i, np.flatnonzero(np.diff(i) != 1) + 1) if layout.offsets is None else [[j] for j in i]
            raw = [f.read_at(len(r) * layout.size, layout.offset(int(r[0]))) for r in runs]
            if sum(map(len, raw)) != n * layout.size:
                raise ValueError(f"{split.path} ends before its last section")
            values = np.frombuffer(b"".join(raw), layout.kind).astype(float).reshape(n, pixels)
            if pixels:
                stats = [values.min(1), values.max(1), values.mean(1)]
            data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * pixels), pa.array(values.ravel()))
        else:
            data = pa.nulls(n, TYPES[-1])
        waves = np.array([layout.waves[w] if w < len(layout.waves) else float(w) for w in range(layout.shape[1])])
        same = lambda v, k: pa.array([v] * n, k)
        kind = str(np.dtype(layout.kind).newbyteorder("="))
        columns = [same(split.path, TYPES[0]), *(pa.array(at[k], pa.int64()) for k in "TWZ"), same(layout.ny, TYPES[4]), same(layout.nx, TYPES[5]), same(kind, TYPES[6])]
        columns += [pa.array(waves[at["W"]]), *(same(float(p), pa.float64()) for p in layout.pixel), *(pa.array(s, pa.float64(), from_pandas=True) for s in stats), data]
        return pa.RecordBatch.from_arrays(columns, NAMES)


#: What the sink takes: a section's place and pixels, and its file's frame.
SINK = "file string, t long, w long, z long, nt long, nw long, nz long, ny int, nx int, dtype string, waves array<double>, pz double, py double, px double, data array<double>"


def mrc_header(layout: Layout, order: str, low: float, high: float, mean: float, floats: int, lacking: bool = False) -> bytes:
    head = bytearray(HEADER)
    nt, nw, _ = layout.shape
    mode = next(m for m, t in MRC_TYPES.items() if "<" + t == layout.kind)
    struct.pack_into("<4i", head, 0, layout.nx, layout.ny, layout.n, mode)
    struct.pack_into("<3i", head, 28, 1, 1, 1)
    struct.pack_into("<3f", head, 40, *reversed(layout.pixel))
    struct.pack_into("<3i", head, 64, 1, 2, 3)
    struct.pack_into("<3f", head, 76, low, high, mean)
    struct.pack_into("<i", head, 92, 4 * floats * layout.n)
    struct.pack_into("<h", head, 96, KNOWN)
    struct.pack_into("<2h", head, 128, 0, floats)
    struct.pack_into("<2h", head, 180, nt, next(k for k, v in MRC_ORDERS.items() if v == order))
    struct.pack_into("<h", head, 196, nw)
    struct.pack_into(f"<{len(layout.waves)}h", head, 198, *[int(round(v)) for v in layout.waves])
    if lacking:
        struct.pack_into("<i", head, LABEL - 4, 1)
        head[LABEL : LABEL + len(LACKING)] = LACKING
    return bytes(head)


def outward(low: float, high: float) -> tuple[np.float32, np.float32]:
    """The nearest 4-byte numbers that enclose a range."""
    a, b = np.float32(low), np.float32(high)
    return (a if float(a) <= low else np.nextafter(a, np.float32(-np.inf))), (b if float(b) >= high else np.nextafter(b, np.float32(np.inf)))


def mark(i: np.ndarray) -> int:
    """A sum that tells sets of section numbers apart."""
    x = (np.asarray(i, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return int((x * np.uint64(0xBF58476D1CE4E5B9)).sum(dtype=np.uint64))


@dataclass
class Written(WriterCommitMessage):
    """Of each file: its frame, and of the sections written their number, mark, lowest, highest and total value."""

    files: dict[str, tuple[Layout, int, int, float, float, float]]


class SectionWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        store, self.root = fs.FileSystem.from_uri(options["path"])
        if not isinstance(store, fs.LocalFileSystem):
            raise ValueError("sections are written by offset, which needs a mounted folder")
        self.order = options.get("order", "ZTW")
        if self.order not in MRC_ORDERS.values():
            raise ValueError(f"the format has no order {self.order}")
        self.gaps = options.get("gaps", "false") == "true"
        self.hidden = os.path.join(self.root, f"_writing-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.hidden, exist_ok=True)
        done: dict[str, tuple[Layout, int, int, float, float, float]] = {}
        with ExitStack() as opened:
            self.write_batches(iterator, done, opened)
        return Written(done)

    def write_batches(self, iterator: Iterator[pa.RecordBatch], done: dict, opened: ExitStack) -> None:
        last = f = None
        for batch in iterator:
            flat, offsets = batch.column("data").values.to_numpy(zero_copy_only=False), batch.column("data").offsets.to_numpy()
            for k, r in enumerate(batch.drop_columns(["data"]).to_pylist()):
                if os.path.basename(r["file"]) != r["file"] or not r["file"].endswith(".mrc"):
                    raise ValueError("a file is named by a plain name that ends in .mrc")
                kind = "<" + np.dtype(r["dtype"]).str[1:]
                layout = Layout(kind, r["ny"], r["nx"], (r["nt"], r["nw"], r["nz"]), self.order, waves=r["waves"] or [], pixel=(r["pz"], r["py"], r["px"]))
                layout.start = HEADER + 4 * FLOATS * layout.n
                values = flat[offsets[k] : offsets[k + 1]]
                if kind[1:] not in MRC_TYPES.values() or len(values) != r["ny"] * r["nx"]:
                    raise ValueError(f"a section of {r['file']} has another size or a type that the format doesn't know")
                plane, i = values.astype(kind), layout.index(r["t"], r["w"], r["z"])
                low, high, mean = float(plane.min()), float(plane.max()), float(plane.mean(dtype=float))
                if r["file"] != last:  # it stays open while its sections follow each other
                    opened.close()
                    f = opened.enter_context(open(os.open(os.path.join(self.hidden, r["file"]), os.O_CREAT | os.O_WRONLY), "wb"))
                    last = r["file"]
                f.seek(HEADER + 4 * FLOATS * i)
                f.write(struct.pack(f"<{FLOATS}f", float(self.gaps), *[0.0] * (ZONE[0] - 1), *outward(low, high), mean))
                f.seek(layout.offset(i))
                f.write(plane.tobytes())
                old = done.get(r["file"], (layout, 0, 0, np.inf, -np.inf, 0.0))
                done[r["file"]] = (layout, old[1] + 1, (old[2] + mark(np.array([i]))) % (1 << 64), min(old[3], low), max(old[4], high), old[5] + mean)

    def commit(self, messages: list[Written | None]) -> None:
        files: dict[str, list] = {}
        for m in messages:
            for name, (layout, n, marks, low, high, total) in (m.files if m else {}).items():
                f = files.setdefault(name, [layout, 0, 0, np.inf, -np.inf, 0.0])
                f[1:] = f[1] + n, (f[2] + marks) % (1 << 64), min(f[3], low), max(f[4], high), f[5] + total
        def finish(name: str) -> None:
            layout, n, marks, low, high, total = files[name]
            with open(os.path.join(self.hidden, name), "r+b") as f:
                lacking = self.gaps and n < layout.n
                there = np.arange(layout.n)
                if lacking:
                    f.seek(HEADER)
                    there = np.flatnonzero(np.frombuffer(f.read(4 * FLOATS * layout.n).ljust(4 * FLOATS * layout.n, b"\0"), "<f4")[::FLOATS])
                    f.truncate(layout.start + layout.n * layout.size)
                    f.seek(0)
                if n != len(there) or marks != mark(there):
                    raise ValueError(f"{name} has {n} sections written where each of {layout.n} is wanted once")
                f.write(mrc_header(layout, self.order, low, high, total / n, FLOATS, lacking))
                f.flush()
                os.fsync(f.fileno())

        try:
            # files are brought to the disk together, as each waits for it
            with ThreadPoolExecutor(32) as pool:
                for _ in pool.map(finish, files):
                    pass
            for name in files:
                os.replace(os.path.join(self.hidden, name), os.path.join(self.root, name))
        finally:
            shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class SectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sections"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> SectionReader:
        return SectionReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> SectionWriter:
        if overwrite:
            raise ValueError("files are added to a folder; a file of the same name is replaced")
        return SectionWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark push filters into it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SectionSource)


def read(spark: SparkSession, path: str, data: bool = True, **options: object) -> DataFrame:
    """The sections of a file or of all files under a folder; without data only what headers and zone maps say."""
    register(spark)
    return spark.read.format("sections").options(path=path, data=str(data).lower(), cores=spark.sparkContext.defaultParallelism, **{k: str(v) for k, v in options.items()}).load()


def write(planes: DataFrame, path: str, order: str = "ZTW", gaps: bool = False) -> None:
    """Write planes (file, t, w, z, ny, nx, dtype, wave, pz, py, px, data) into a folder, a file for each name. t, w and z count from 0, without gaps unless these are allowed."""
    register(planes.sparkSession)
    if path.startswith("file:"):
        os.makedirs(fs.FileSystem.from_uri(path)[1], exist_ok=True)
    waves = F.transform(F.array_sort(F.collect_set(F.struct("w", "wave"))), lambda s: s["wave"])
    sizes = [(F.max(c) + 1).alias("n" + c) for c in "twz"]
    # a row for each file; at most five channels have a wavelength in the format
    frames = planes.groupBy("file").agg(*sizes, F.when(F.max("w") < 5, waves).alias("waves"))
    whole = planes.join(checked(frames, "frames"), "file")
    names = [c.split()[0] for c in SINK.split(", ")]
    whole.select(*names).write.format("sections").mode("append").options(path=path, order=order, gaps=str(gaps).lower()).save()


def convert(spark: SparkSession, path: str, out: str, **options: object) -> None:
    """All image files under a path as files of the sink's format, of the same names but for their endings. Types that the format doesn't know become float32."""
    found = read(spark, path, **options)
    name = F.concat(F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", ""), F.lit(".mrc"))
    known = F.col("dtype").isin(*[str(np.dtype(t)) for t in MRC_TYPES.values()])
    write(found.withColumn("file", name).withColumn("dtype", F.when(known, F.col("dtype")).otherwise("float32")), out)
