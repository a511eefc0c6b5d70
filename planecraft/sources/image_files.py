"""Image files as stacks: MRC (with the fields of wavelengths and frames), baseline TIFF of several pages, and npy.

`read` takes a file in a task, by Spark's reader of binary files, so any store will do; a file must fit into a worker.
Each plane is a row. Numbers are read by their stated type and byte order only; nothing in a file is evaluated.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from planecraft.plans.shipping import ship

PLANES = "file string, t long, w long, z long, ny int, nx int, dtype string, wave double, pz double, py double, px double, data array<double>"
# Fixed values of the formats: MRC's types by mode, the orders of its sections, and TIFF's field sizes.
MRC_TYPES = {0: "u1", 1: "i2", 2: "f4", 6: "u2", 7: "i4"}
MRC_ORDERS = {0: "ZTW", 1: "WZT", 2: "ZWT"}
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 16: 8}
TIFF_KINDS = {1: "u", 2: "i", 3: "f"}


def places(order: str, nt: int, nw: int, nz: int) -> list[tuple[int, int, int]]:
    """(t, w, z) of a file's sections; the first letter of the order runs fastest."""
    sizes = {"T": nt, "W": nw, "Z": nz}
    out = []
    for i in range(nt * nw * nz):
        at = {}
        for axis in order:
            i, at[axis] = divmod(i, sizes[axis])
        out.append((at["T"], at["W"], at["Z"]))
    return out


def mrc_planes(raw: bytes) -> tuple[np.ndarray, list[tuple[int, int, int]], list[float], tuple[float, float, float]]:
    """Sections, their places, wavelengths and pixel sizes (z, y, x)."""
    mark = next((e for e in "<>" if 0 < struct.unpack(e + "i", raw[:4])[0] < 1 << 20 and struct.unpack(e + "i", raw[12:16])[0] in MRC_TYPES), None)
    if mark is None:
        raise ValueError("not an MRC file of a known type")
    nx, ny, n, mode = struct.unpack(mark + "4i", raw[:16])
    px, py, pz = struct.unpack(mark + "3f", raw[40:52])
    extra = struct.unpack(mark + "i", raw[92:96])[0]
    nt, order = struct.unpack(mark + "2h", raw[180:184])
    nw, *waves = struct.unpack(mark + "6h", raw[196:208])
    nt, nw = max(nt, 1), max(nw, 1) if nw <= 5 else 1
    if n % (nt * nw):
        nt = nw = 1
    kind = np.dtype(mark + MRC_TYPES[mode])
    data = np.frombuffer(raw, kind, n * ny * nx, 1024 + extra).reshape(n, ny, nx)
    return data, places(MRC_ORDERS.get(order, "ZTW"), nt, nw, n // (nt * nw)), [float(v) for v in waves[:nw]], (pz, py, px)


def mrc_bytes(planes: np.ndarray, waves: list[float] = (0,), nt: int = 1, pixel: tuple[float, float, float] = (1, 1, 1), order: str = "ZTW") -> bytes:
    """Planes (n, ny, nx), in the file's order, of a type that the format knows."""
    mode = next((m for m, t in MRC_TYPES.items() if np.dtype(t) == planes.dtype.newbyteorder("=")), None)
    if mode is None or len(waves) > 5:
        raise ValueError(f"{planes.dtype} or {len(waves)} channels don't go into this format")
    head = bytearray(1024)
    n, ny, nx = planes.shape
    struct.pack_into("<4i", head, 0, nx, ny, n, mode)
    struct.pack_into("<3i", head, 28, 1, 1, 1)
    struct.pack_into("<3f", head, 40, pixel[2], pixel[1], pixel[0])
    struct.pack_into("<3i", head, 64, 1, 2, 3)
    if planes.size:
        struct.pack_into("<3f", head, 76, float(planes.min()), float(planes.max()), float(planes.mean()))
    struct.pack_into("<h", head, 96, -16224)
    struct.pack_into("<2h", head, 180, nt, next(k for k, v in MRC_ORDERS.items() if v == order))
    struct.pack_into("<h", head, 196, len(waves))
    struct.pack_into(f"<{len(waves)}h", head, 198, *[int(round(v)) for v in waves])
    return bytes(head) + planes.astype(planes.dtype.newbyteorder("<")).tobytes()


def tiff_pages(raw: bytes) -> list[np.ndarray]:
    """Pages of an uncompressed TIFF with one sample a pixel."""
    mark = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if mark is None or struct.unpack(mark + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages, seen = struct.unpack(mark + "I", raw[4:8])[0], [], set()
    while at and at not in seen:
        seen.add(at)
        fields = {}
        for i in range(struct.unpack(mark + "H", raw[at : at + 2])[0]):
            tag, kind, n = struct.unpack(mark + "HHI", raw[at + 2 + 12 * i : at + 10 + 12 * i])
            place = at + 10 + 12 * i
            if TIFF_SIZES.get(kind, 1) * n > 4:
                place = struct.unpack(mark + "I", raw[place : place + 4])[0]
            if kind in (1, 3, 4):
                fields[tag] = struct.unpack(f"{mark}{n}{'BHI'[(1, 3, 4).index(kind)]}", raw[place : place + TIFF_SIZES[kind] * n])
        if fields.get(259, (1,))[0] != 1 or fields.get(277, (1,))[0] != 1:
            raise ValueError("compressed or coloured TIFF pages aren't read")
        nx, ny, bits = fields[256][0], fields[257][0], fields.get(258, (8,))[0]
        kind = np.dtype(f"{mark}{TIFF_KINDS[fields.get(339, (1,))[0]]}{bits // 8}")
        body = b"".join(raw[a : a + n] for a, n in zip(fields[273], fields[279]))
        pages.append(np.frombuffer(body, kind, ny * nx).reshape(ny, nx))
        at = struct.unpack(mark + "I", raw[at + 2 + 12 * struct.unpack(mark + "H", raw[at : at + 2])[0] :][:4])[0]
    return pages


def tiff_bytes(pages: list[np.ndarray]) -> bytes:
    """Uncompressed pages, one strip each."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        raw = page.astype(page.dtype.newbyteorder("<")).tobytes()
        where = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        struct.pack_into("<I", out, link, len(out))
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        fields = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, page.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, where), (277, 3, 1), (278, 4, page.shape[0]), (279, 4, len(raw)), (339, 3, kind)]
        out += struct.pack("<H", len(fields))
        for tag, form, value in fields:
            out += struct.pack("<HHII", tag, form, 1, value)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def npy_array(raw: bytes) -> np.ndarray:
    import io

    return np.load(io.BytesIO(raw), allow_pickle=False)


def npy_bytes(array: np.ndarray) -> bytes:
    import io

    sink = io.BytesIO()
    np.save(sink, array, allow_pickle=False)
    return sink.getvalue()


def planes_of(file: str, raw: bytes) -> Iterator[tuple]:
    """A file's planes as rows, by its name's ending."""
    end = file.rsplit(".", 1)[-1].lower()
    waves, pixel = [], (1.0, 1.0, 1.0)
    if end in ("mrc", "dv", "st"):
        data, where, waves, pixel = mrc_planes(raw)
    elif end in ("tif", "tiff"):
        data = tiff_pages(raw)
        where = [(0, 0, z) for z in range(len(data))]
    elif end == "npy":
        data = npy_array(raw)
        data = data.reshape((1,) * (5 - data.ndim) + data.shape)  # t, w, z, y, x
        where = [tuple(map(int, at)) for at in np.ndindex(data.shape[:3])]
        data = data.reshape(-1, *data.shape[3:])
    else:
        raise ValueError(f"no reader for .{end}")
    for (t, w, z), plane in zip(where, data):
        wave = waves[w] if w < len(waves) else float(w)
        yield file, t, w, z, plane.shape[0], plane.shape[1], str(plane.dtype.newbyteorder("=")), wave, *map(float, pixel), plane.astype(float).ravel()


def read(spark: SparkSession, path: str) -> DataFrame:
    """All planes of the image files under a path or pattern."""
    ship(spark)
    names = [c.split()[0] for c in PLANES.split(", ")]
    types = [pa.string()] + [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.string()] + [pa.float64()] * 4 + [pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for row in planes_of(file, raw):  # a batch for each plane, which bounds memory
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PLANES)


def contents(planes: DataFrame, kind: str = "mrc") -> DataFrame:
    """(file, content): each stack (file, t, w, z, ny, nx, dtype, wave, pz, py, px, data) as one file's bytes. A file is made by one task, as it must be."""
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values(["w", "t", "z"])
        first = pdf.iloc[0]
        data = np.stack([np.asarray(d).reshape(first.ny, first.nx) for d in pdf["data"]]).astype(first["dtype"])
        nt, nw = pdf["t"].nunique(), pdf["w"].nunique()
        if kind == "mrc":
            raw = mrc_bytes(data, pdf.groupby("w")["wave"].first().tolist(), nt, (first.pz, first.py, first.px))
        elif kind == "tif":
            raw = tiff_bytes(list(data))
        else:
            raw = npy_bytes(data.reshape(nw, nt, -1, first.ny, first.nx).swapaxes(0, 1))
        return pd.DataFrame({"file": [first.file], "content": [raw]})

    ship(planes.sparkSession)
    return planes.groupBy("file").applyInPandas(run, "file string, content binary")
