"""GeoJSON read in splits against the json module."""

import json
import random

import pytest

from muniframe.sources import geojson


def document(rng, features):
    odd = ['plain', 'a "quoted" {name}', "back\\\\slash\\", "}],[{", "\u00e9\u6f22", "", "line\nbreak\ttab", '\\"}']
    made = [{"type": "Feature", "properties": {"nome": rng.choice(odd) + str(k), "n": k, "deep": {"x": [{"y": "}"}]}, **({"extra": None} if k % 3 else {})},
             "geometry": {"type": "Polygon", "coordinates": [[[rng.randint(0, 9), k], [1, 2]]] * rng.randint(1, 4)}} for k in range(features)]
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:{x}"}}, "features": made, "after": {"list": [{"type": "other"}]}}


@pytest.mark.parametrize("split,chunk", [(40, 16), (300, 100), (1 << 27, 1 << 22)])
def test_any_split_gives_the_same_features(spark, tmp_path, monkeypatch, split, chunk):
    rng = random.Random(split)
    docs = {"one.json": [document(rng, 7)], "indented.json": [document(rng, 4)], "two.json": [document(rng, 2), document(rng, 3)], "none.json": [document(rng, 0)]}
    want = []
    for name, parts in docs.items():
        (tmp_path / name).write_text("\n".join(json.dumps(d, indent=1 if name == "indented.json" else None, ensure_ascii=rng.random() < 0.5) for d in parts) + ("\n" if name == "two.json" else ""))
        want += [(f["properties"]["nome"], str(f["properties"]["n"]), f["geometry"]) for d in parts for f in d["features"]]
    monkeypatch.setattr(geojson, "CHUNK", chunk)
    real = spark.read.__class__.text

    def in_splits(reader, *args, **options):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        return real(reader, *args, **options)

    keep = geojson.stored

    def then_whole(df):  # the scan is over once its chunks are stored
        try:
            return keep(df)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    monkeypatch.setattr(spark.read.__class__, "text", in_splits)
    monkeypatch.setattr(geojson, "stored", then_whole)
    found = geojson.read_geojson(spark, str(tmp_path), ["nome", "n", "absent"]).collect()
    assert all(r.absent is None for r in found)
    key = lambda x: (x[0], x[1], json.dumps(x[2]))
    assert sorted([(r.nome, r.n, json.loads(r.geometry)) for r in found], key=key) == sorted(want, key=key)


def test_states_compose():
    """Wherever a document is cut, the features and pieces of the parts are those of the whole."""
    rng = random.Random(1)
    text = json.dumps(document(rng, 5))
    whole = geojson.cut_features(text, False, 0)[0]
    assert [json.loads(f) for f in whole if '"Feature"' in f] == json.loads(text)["features"]
    for cut in [k + 1 for k, c in enumerate(text) if c == "}"]:
        turns, outside, _ = geojson.brackets(text[:cut])
        first, _, begun = geojson.cut_features(text[:cut], False, 0)
        second, lead, rest = geojson.cut_features(text[cut:], turns == 1, outside)
        middle = [begun + lead] if begun is not None else []
        assert first + middle + second == whole and rest is None
