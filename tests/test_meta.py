from __future__ import annotations

import json
import math

import pytest

from gridloom import grid
from gridloom.meta import FILE, ArrayMeta, MetadataError

BASE = {"chunks": [16, 16, 16], "compressor": {"id": "blosc", "cname": "zstd", "clevel": 5, "shuffle": 1, "blocksize": 0}, "dtype": "<u2", "fill_value": 0, "filters": None, "order": "F", "shape": [40, 24, 18], "zarr_format": 2}


def parse(**changes):
    return ArrayMeta.parse({k: v for k, v in (BASE | changes).items() if v is not ...})


def test_document_round_trip(tmp_path):
    for meta in (parse(), parse(fill_value=7, order="c"), ArrayMeta(shape=(70, 40, 40), chunks=(32, 32, 32), chunk_shape=(16, 16, 16), shard=True, dimension_separator="/", subfolders=(2, 0, 1), cname="gzip", dtype="<f4", fill_value=-0.5)):
        meta.save(str(tmp_path))
        assert ArrayMeta.load(str(tmp_path)) == meta
    assert not [p for p in tmp_path.iterdir() if p.name != FILE]
    assert json.loads((tmp_path / FILE).read_text())["codecs"][0]["name"] == "sharding_indexed"


@pytest.mark.parametrize("changes", [{k: ...} for k in BASE if k != "filters"] + [{"compressor": None}, {"filters": [{"id": "delta"}]}, {"dtype": "<i4"}, {"order": "X"}, {"shape": [1, 2]}, {"compressor": {"id": "bz2", "level": 1}}])
def test_what_is_not_supported_raises(changes):
    with pytest.raises(MetadataError):
        parse(**changes)


def test_fill_values_and_separators():
    assert parse(fill_value=None).fill_value == 0
    assert parse(fill_value=0.5).fill_value == 0
    assert parse(fill_value=0.5, dtype="<f4").fill_value == 0.5
    assert parse(fill_value="NaN").fill_value == 0
    assert math.isnan(parse(fill_value="NaN", dtype="<f8").fill_value)
    assert parse(fill_value="-Infinity", dtype="<f8").fill_value == -math.inf
    assert parse(fill_value=-1).fill == 65535
    with pytest.raises(MetadataError):
        parse(fill_value="Infinity")
    assert parse(dimension_separator="/").dimension_separator == "/"
    assert parse(dimension_separator="x").dimension_separator == "."
    assert parse(unknown=1) == parse()
    assert parse(compressor={"id": "zlib", "level": 3}).cname == "zlib-stream"


def test_missing_document(tmp_path):
    with pytest.raises(FileNotFoundError, match="metadataFileMissing"):
        ArrayMeta.load(str(tmp_path))
    (tmp_path / FILE).write_text("{")
    with pytest.raises(MetadataError):
        ArrayMeta.load(str(tmp_path))


def test_shards_need_chunks_that_divide_them():
    with pytest.raises(MetadataError):
        ArrayMeta(shape=(8, 8, 8), chunks=(8, 8, 8), chunk_shape=(3, 8, 8), shard=True)


def test_grid():
    assert grid.touched((5, 3, 7), (37, 20, 17), (16, 16, 16)) == ((0, 0, 0), (3, 2, 2))
    assert [grid.name(b) for b in grid.blocks((0, 0, 0), (1, 2, 2))] == ["0.0.0", "0.0.1", "0.1.0", "0.1.1"]
    assert grid.parse_name("3/14/5") == (3, 14, 5) == grid.parse_name("3.14.5")
    assert grid.subfolder((5, 3, 7), (2, 0, 1)) == "2_0_7" and grid.subfolder((5, 3, 7), (0, 0, 0)) == ""
    assert grid.shard_of((5, 3, 7), (2, 2, 2)) == (2, 1, 3) and grid.place_in_shard((5, 3, 6), (2, 2, 2)) == 6
    assert grid.bbox_to_region([1, 1, 1, 20, 24, 18]) == ((0, 0, 0), (20, 24, 18))
    assert grid.region((4, 4, 4), None, [0, 0, 0]) == ((0, 0, 0), (4, 4, 4))
    for start, end in (((0, 0, 0), (5, 4, 4)), ((2, 0, 0), (2, 4, 4)), ((-1, 0, 0), (4, 4, 4))):
        with pytest.raises(ValueError):
            grid.region((4, 4, 4), start, end)
    with pytest.raises(ValueError):
        grid.bbox_to_region([0, 1, 1, 2, 2, 2])
