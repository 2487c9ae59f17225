"""JSON lists cut into records by many tasks, against json.loads of the whole file."""

import json
import random

import pytest

from gazetta import schema as S
from gazetta.sources import json_lists, readers


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k, None) for k in names}
    spark.conf.set(names[0], "151")
    spark.conf.set(names[1], "1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _record(rng, i, deep=True):
    tricky = ["a}b", "{", '"', '\\"}', "]", "[{", "ä漢", "\\", "a\\\\", "line\nbreak", '"features": [', ""]
    r = {"id": i, "note": rng.choice(tricky), "x": rng.choice([None, True, 1.5, rng.choice(tricky)])}
    if deep and rng.random() < 0.5:
        r["deep"] = {"list": [{"a": rng.choice(tricky)}, [], [1, {"b": {}}]], "more": {"c": rng.choice(tricky)}}
    return r


def _found(spark, path, keys):
    return [json.loads(r.value) for r in json_lists.records(spark, str(path), keys).orderBy("_row").collect()]


@pytest.mark.parametrize("indent", [None, 2])
def test_records(spark, tmp_path, tiny_splits, indent):
    """Root lists, lists under keys, keys that stand elsewhere too, values that are no records, lists after the list."""
    rng = random.Random(indent)
    some = [_record(rng, i) for i in range(60)]
    mixed = [1, "a}{", None, *some[:5], [], True, *some[5:9], "]"]
    cases = [
        (some, some), ({"n": 3, "meta": {"features": [{"no": 1}], "x": {"y": {}}}, "data": some, "after": {"z": {"q": 1}}, "w": [{"v": 1}]}, some),
        ({"title": '"data": [', "data": [], "results": some[:40]}, some[:40]), (mixed, some[:9]), ([], []), ({"data": []}, []), ([some[0]], some[:1]), ([{}, {}], [{}, {}]),
    ]
    for k, (data, expected) in enumerate(cases):
        path = tmp_path / f"t {k}.json"
        path.write_text(json.dumps(data, indent=indent, ensure_ascii=k % 2 == 0), encoding="utf-8")
        assert _found(spark, path, ("records", "data", "results")) == expected, k


def test_both_ways_read_alike(spark, tmp_path, tiny_splits):
    """Cut into records and parsed whole: the same columns and rows, in order; GeoJSON too."""
    rng = random.Random(2)
    plain = [_record(rng, i) for i in range(60)]
    points = [{"type": "Feature", "properties": {"id": i, "Latitude": None if i % 2 else "7", "n": {"a": "}"}}, "geometry": {"type": "Point", "coordinates": [i + 0.5, -i]}} for i in range(60)]
    for name, data in (("a.json", plain), ("b.json", {"results": plain, "total": 2}), ("c.geojson", {"type": "FeatureCollection", "crs": {"properties": {"name": "x"}}, "features": points})):
        (tmp_path / name).write_text(json.dumps(data))
        one, many = (readers.read_json_records(spark, str(tmp_path / name), split) for split in (False, True))
        assert [c for c in one.columns if c != "_row"] == [c for c in many.columns if c != "_row"]
        names = [c for c in one.columns if c != "_row"]
        assert one.orderBy("_row").select(*names).collect() == many.orderBy("_row").select(*names).collect()
        assert many.select("_row").distinct().count() == 60


def test_large_files_are_split(spark, tmp_path, tiny_splits):
    (tmp_path / "one.json").write_text(json.dumps({"id": 1, "list": {"records": []}}))
    assert [r.id for r in readers.read_json_records(spark, str(tmp_path / "one.json"), True).collect()] == ["1"]
    (tmp_path / "t.json").write_text(json.dumps([{"id": i, "s": "x" * i} for i in range(100)]))
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "t.json")).rdd.getNumPartitions() > 20
    assert [int(r.id) for r in readers.load_records(spark, str(tmp_path / "t.json")).orderBy("_row").collect()] == list(range(100))


@pytest.mark.parametrize("geo", [False, True])
def test_only_small_files_are_parsed_whole(spark, tmp_path, monkeypatch, geo):
    """Beyond WHOLE_BYTES a file is read by lines: parsed whole, the text of every number is fetched from the file anew."""
    rows = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [i % 180, 1.50]}, "properties": {"id": i}} if geo else {"id": i, "x": 1.50, "name": "n" * 20} for i in range(6000)]
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": rows} if geo else rows))
    assert readers.WHOLE_BYTES < path.stat().st_size < 1 << 20
    whole = readers.read_json_records(spark, str(path), split=False).drop(S.ROW)
    asked, own = [], readers.json_lists.read
    monkeypatch.setattr(readers.json_lists, "read", lambda *a: asked.append(a) or own(*a))
    found = readers.read_json_records(spark, str(path)).drop(S.ROW)
    assert asked and sorted(found.columns) == sorted(whole.columns) and found.count() == 6000
    assert sorted(map(tuple, found.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
