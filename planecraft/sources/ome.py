"""Image metadata as OME-XML: columns to XML and back, and any XML as nested paths."""

from __future__ import annotations

import xml.etree.ElementTree as tree
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planecraft.plans.shipping import ship

# Fixed values of the format: its name for each type of pixel, and its namespace.
PIXEL_TYPES = {
    "int8": "int8", "int16": "int16", "int32": "int32", "uint8": "uint8", "uint16": "uint16", "uint32": "uint32",
    "float32": "float", "float64": "double", "bool": "bit", "complex64": "complex", "complex128": "double complex",
}
NAMESPACE = "http://www.openmicroscopy.org/Schemas/OME/2016-06"

_CHANNEL = "struct<_ID: string, _EmissionWavelength: double, _EmissionWavelengthUnit: string>"
_PIXELS = ", ".join(
    [f"_{n}: string" for n in ("ID", "DimensionOrder", "Type")] + [f"_Size{a}: long" for a in "XYZCT"] + [f"_PhysicalSize{a}: double" for a in "XYZ"] + [f"_PhysicalSize{a}Unit: string" for a in "XYZ"]
)
SCHEMA = f"Image struct<_ID: string, _Name: string, Pixels: struct<{_PIXELS}, Channel: array<{_CHANNEL}>>>"


def order_of(sequence: Column) -> Column:
    """XYZTC for the sequence ZTW: x and y run fastest, and the format calls channels C."""
    return F.concat(F.lit("XY"), F.replace(F.upper(sequence), F.lit("W"), F.lit("C")))


def xml(images: DataFrame) -> DataFrame:
    """(images' columns, ome): images have name, sequence (like ZTW), dtype, nt, nw, nz, ny, nx, pz, py, px in micrometres and waves in nanometres. A type that the format lacks gives a null."""
    kinds = F.create_map(*[F.lit(v) for pair in PIXEL_TYPES.items() for v in pair])
    channel = F.transform("waves", lambda w, i: F.struct(F.concat(F.lit("Channel:0:"), i.cast("string")).alias("_ID"), w.cast("double").alias("_EmissionWavelength"), F.lit("nm").alias("_EmissionWavelengthUnit")))
    sizes = {"X": "nx", "Y": "ny", "Z": "nz", "C": "nw", "T": "nt"}
    pixels = F.struct(
        F.lit("Pixels:0").alias("_ID"),
        order_of(F.col("sequence")).alias("_DimensionOrder"),
        F.try_element_at(kinds, F.col("dtype")).alias("_Type"),
        *[F.col(c).cast("long").alias(f"_Size{a}") for a, c in sizes.items()],
        *[F.col("p" + a.lower()).cast("double").alias(f"_PhysicalSize{a}") for a in "XYZ"],
        *[F.lit("µm").alias(f"_PhysicalSize{a}Unit") for a in "XYZ"],
        channel.alias("Channel"),
    )
    image = F.struct(F.lit("Image:0").alias("_ID"), F.col("name").alias("_Name"), pixels.alias("Pixels"))
    made = F.to_xml(F.struct(F.lit(NAMESPACE).alias("_xmlns"), image.alias("Image")), {"rowTag": "OME", "attributePrefix": "_"})
    return images.select("*", F.when(F.try_element_at(kinds, F.col("dtype")).isNotNull(), made).alias("ome"))


def columns(ome: Column) -> list[Column]:
    """name, sequence, dtype, nt, nw, nz, ny, nx, pz, py, px, waves of an OME text; null where it states none. Lengths are micrometres, also where it states nm or mm."""
    read = F.from_xml(ome, SCHEMA, {"rowTag": "OME", "attributePrefix": "_", "ignoreNamespace": "true"})
    p = read["Image"]["Pixels"]
    back = F.create_map(*[F.lit(v) for k, n in PIXEL_TYPES.items() for v in (n, k)])
    scale = lambda a: F.when(p[f"_PhysicalSize{a}Unit"] == "nm", 0.001).when(p[f"_PhysicalSize{a}Unit"] == "mm", 1000.0).otherwise(1.0)
    sizes = {"nt": "T", "nw": "C", "nz": "Z", "ny": "Y", "nx": "X"}
    return [
        read["Image"]["_Name"].alias("name"),
        F.replace(F.substring(p["_DimensionOrder"], 3, 3), F.lit("C"), F.lit("W")).alias("sequence"),
        F.try_element_at(back, p["_Type"]).alias("dtype"),
        *[p[f"_Size{a}"].alias(c) for c, a in sizes.items()],
        *[(p[f"_PhysicalSize{a}"] * scale(a)).alias("p" + a.lower()) for a in "ZYX"],
        F.transform(p["Channel"], lambda c: c["_EmissionWavelength"]).alias("waves"),
    ]


def _leaves(node: tree.Element, path: str) -> Iterator[tuple[str, str]]:
    """(path, text): attributes by @name, elements of one name counted from 0 where there are several; names without their namespace."""
    for name, value in node.attrib.items():
        yield f"{path}/@{name.rsplit('}', 1)[-1]}", value
    if node.text and node.text.strip():
        yield path, node.text.strip()
    names = [child.tag.rsplit("}", 1)[-1] for child in node]
    seen: dict[str, int] = {}
    for child, name in zip(node, names):
        nth = seen[name] = seen.get(name, -1) + 1
        yield from _leaves(child, f"{path}/{name}" + (f"[{nth}]" if names.count(name) > 1 else ""))


def paths(texts: DataFrame, id: str, text: str) -> DataFrame:
    """(id, path, value, number, flag) of XML texts: a row for each attribute and each element with text of its own. `number` and `flag` are what the value says as a number, or as true or false. A text that is no XML has one row, with null path and the fault as value; null texts have none."""
    ship(texts.sparkSession)
    kind = texts.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if raw is None:
                    continue
                try:
                    root = tree.fromstring(raw)
                    rows += [(key, *leaf) for leaf in _leaves(root, root.tag.rsplit("}", 1)[-1])]
                except tree.ParseError as fault:
                    rows.append((key, None, str(fault)))
            if rows:
                ids, where, values = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(where, pa.string()), pa.array(values, pa.string())], ["id", "path", "value"])

    found = texts.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, path string, value string")
    number = F.when(F.col("value").rlike(r"^\s*[-+]?[0-9.]"), F.col("value").try_cast("double"))
    flag = F.when(F.lower("value") == "true", True).when(F.lower("value") == "false", False)
    return found.select("id", "path", "value", number.alias("number"), flag.alias("flag"))
