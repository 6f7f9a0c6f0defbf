"""JSON pools read by many tasks against the plain reader and the json module."""

import json
import random

import numpy as np
import pytest

from traceaudit.sources import large_pools, pools

NASTY = ['}],{"queries": [', 'a\\', '\\"', '"}', "{", "[[[", "]]}}", ',","', "\\\\", "\n}\n", "é}日本", " }", "", "x" * 300]


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "1500")
    spark.conf.set(names[1], "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def records(seed, count):
    draw = random.Random(seed)
    out = []
    for k in range(count):
        text = "".join(draw.choice(NASTY) for _ in range(draw.randrange(4)))
        extra = {"tags": [text, [k, {"n": [text]}]], "data": [{"queries": text}]}
        out.append({"prompt": text or "p", **({"id": f"r{k}"} if k % 3 else {}), **(extra if k % 2 else {})})
    return out


def found(rows):
    return [(r.position, r.prompt_id, r.prompt_text) for r in rows.select("position", "prompt_id", "prompt_text").orderBy("position").collect()]


@pytest.mark.parametrize(("indent", "tail"), [(None, ""), (1, "\n")])
def test_pools_of_many_splits(spark, tmp_path, small_splits, indent, tail):
    rows = records(5, 90)
    documents = {
        "wrapped": {"meta": {"name": 'q"}', "deep": {"a": [1, {"b": "]"}]}}, "note": NASTY, "queries": rows, "after": [{"id": "no"}]},
        "data_first": {"queries": [{"prompt": "not this"}], "n": 3, "data": rows, "meta": None},
        "plain": rows,
        "texts": [r["prompt"] for r in rows],
        "empty": {"records": [], "meta": {}},
    }
    for name, document in documents.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(document, indent=indent, ensure_ascii=False) + tail, encoding="utf-8")
        got, meta = large_pools.read_large_pool(spark, str(path))
        if name != "empty":
            assert large_pools._pieces(spark, str(path)).select("block").distinct().count() > 3
        want = [] if name == "empty" else rows
        texts = {r.position: json.loads(r.raw) for r in got.selectExpr("position", "to_json(raw) AS raw").collect()}
        assert texts == dict(enumerate(r["prompt"] if name == "texts" else r for r in want))
        assert found(got) == found(pools.read_pool(spark, str(path))[0])
        (one,) = meta.selectExpr("to_json(meta) AS meta").collect()
        value = document.get("meta") if isinstance(document, dict) else None
        assert (None if one.meta is None else json.loads(one.meta)) == value


def test_written_pools_come_back(spark, tmp_path, small_splits):
    rows = records(9, 100)
    frame = spark.createDataFrame([(json.dumps(r),) for r in rows], "record string").repartition(3)
    large_pools.write_large_pool(frame, str(tmp_path / "pools"), '{"name": "x"}')
    got, meta = large_pools.read_large_pool(spark, str(tmp_path / "pools"))
    back = sorted(r.raw for r in got.selectExpr("to_json(raw) AS raw").collect())
    assert sorted(json.dumps(json.loads(r), sort_keys=True) for r in back) == sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert {r.name for r in meta.selectExpr("try_variant_get(meta, '$.name', 'string') AS name").collect()} == {"x"}
    with pytest.raises(Exception, match="duplicate"):
        large_pools.read_large_pool(spark, str(tmp_path / "pools"), unique=True)


def test_structure_of_random_json():
    draw = random.Random(2)
    for _ in range(200):
        text = json.dumps([draw.choice(NASTY) for _ in range(6)] + [{"a": draw.choice(NASTY)}])
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        places, change, open_ = large_pools.structure(data, False)
        assert change.sum() == 0 and not open_ and (np.cumsum(change)[:-1] >= 1).all()
        cut = draw.randrange(len(text))
        while cut and text[cut - 1] == "\\":
            cut -= 1
        first = large_pools.structure(data[:cut], False)
        second = large_pools.structure(data[cut:], first[2])
        assert [*first[0], *(second[0] + cut)] == places.tolist()
