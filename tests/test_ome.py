"""OME-XML on small cases."""

import pytest
from pyspark.sql import functions as F

from planecraft.sources import ome

OME = """<?xml version="1.0" encoding="UTF-8"?>
<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06" Creator="x">
  <Image ID="Image:0" Name="cells"><Description>two words</Description>
    <Pixels ID="Pixels:0" DimensionOrder="XYCZT" Type="uint16" SizeX="512" SizeY="256" SizeZ="3" SizeC="2" SizeT="1" PhysicalSizeX="80" PhysicalSizeXUnit="nm" PhysicalSizeY="0.08" PhysicalSizeZ="0.0002" PhysicalSizeZUnit="mm" Interleaved="False">
      <Channel ID="Channel:0:0" EmissionWavelength="520.5"/><Channel ID="Channel:0:1"/>
    </Pixels>
  </Image>
</OME>"""
PLAIN = '<?xml version="1.0" ?><root attr="name"><key>1</key><key>2.5e1</key><other/>text</root>'


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, OME, "p"), (2, PLAIN, "p"), (3, None, "p"), (4, "<broken", "p"), (5, "", "p"), (6, "<OME/>", "p")], "key int, xml string, path string")


def test_columns_of_other_programs(texts):
    rows = {r.key: r for r in texts.where("key IN (1, 2, 3, 6)").select("key", *ome.columns(F.col("xml"))).collect()}
    r = rows[1]
    assert (r.name, r.sequence, r.dtype, r.nt, r.nw, r.nz, r.ny, r.nx, r.waves) == ("cells", "WZT", "uint16", 1, 2, 3, 256, 512, [520.5, None])
    assert (r.pz, r.py, r.px) == pytest.approx((0.2, 0.08, 0.08))
    assert all(v is None for k in (2, 3, 6) for v in rows[k][1:])


def test_paths(texts):
    found = {}
    for r in ome.paths(texts, "key", "xml").collect():
        found.setdefault(r.id, {})[r.path] = (r.value, r.number, r.flag)
    assert found[2] == {"root/@attr": ("name", None, None), "root/key[0]": ("1", 1.0, None), "root/key[1]": ("2.5e1", 25.0, None)}
    assert found[1]["OME/Image/Pixels/@Interleaved"] == ("False", None, False) and found[1]["OME/Image/Description"][0] == "two words"
    assert found[1]["OME/Image/Pixels/Channel[0]/@EmissionWavelength"][1] == 520.5
    assert 3 not in found and set(found[4]) == {None} and set(found[5]) == {None} and 6 not in found


def test_there_and_back(spark):
    rows = [("a<&>\"'é", "ZTW", "float32", 2, 2, 3, 4, 5, 0.2, 0.1, 0.05, [488.0, 561.0]), ("b", "wzt", "uint8", 1, 1, 1, 1, 1, 1.0, 1.0, 1.0, []), (None, "ZWT", "int16", 1, 1, 1, 1, 1, 1.0, 1.0, 1.0, None), ("d", "ZWT", "int64", 1, 1, 1, 1, 1, 1.0, 1.0, 1.0, [1.0])]
    images = spark.createDataFrame(rows, "name string, sequence string, dtype string, nt int, nw int, nz int, ny int, nx int, pz double, py double, px double, waves array<double>")
    got = {r.name: tuple(r) for r in ome.xml(images).where("ome IS NOT NULL").select(*ome.columns(F.col("ome"))).collect()}
    assert got[rows[0][0]] == rows[0] and got["b"][:11] == ("b", "WZT", *rows[1][2:11]) and not got["b"][11] and got[None][1:3] == ("ZWT", "int16")
    assert ome.xml(images).where("ome IS NULL").count() == 1
