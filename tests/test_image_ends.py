"""Queries of stacks whose last image ends early, held against their SQL."""

import duckdb
import pyarrow.parquet as pq
import pytest

from planecraft.plans import catalogue, images, series  # noqa: F401


def differences(spark, sf, folder, name, n):
    rows = pq.read_table(f"{sf}/embeddings.parquet")
    pq.write_table(rows.slice(0, n), f"{folder}/embeddings.parquet")
    got = catalogue.QUERIES[name](spark, str(folder))
    base = duckdb.connect()
    base.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = base.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    return sorted(map(repr, want)), sorted(repr(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("name", ["file_region", "file_shapes", "map_files", "merged_files", "summed_channels"])
def test_last_image_ends_early(spark, sf, tmp_path, name):
    for n in (36, 42):
        want, got = differences(spark, sf, tmp_path, name, n)
        assert got == want and got


def test_sections_that_one_stack_lacks_are_left_out(spark, sf, tmp_path):
    want, got = differences(spark, sf, tmp_path, "stacks_laid_over", 86)
    assert got == want and got
