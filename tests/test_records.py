"""Files read in splits against Python's csv reader, on generated and malformed files."""

import csv
import json
import random

import pytest

from conftest import scan_in_splits
from muniframe.sources import records
from muniframe.sources.bronze import check_complete, load_bronze
from muniframe.sources.files import read_delimited

ALPHABET = ["a", "b", " ", ";", ",", '"', '""', "\n", "\r", "\r\n", "\u00e9", ';"', ',"', '";', '",', "'"]


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("latin-1"))
    return path


def plain(path):
    """What the standard library reads: delimiter from 8 KiB, then one dictionary a record."""
    with path.open(encoding="latin-1", newline="") as f:
        sample = f.read(8192)
    try:
        delimiter = csv.Sniffer().sniff(sample, ";,").delimiter
    except csv.Error:
        delimiter = "," if path.parent.name == "commas" else ";"
    with path.open(encoding="latin-1", newline="") as f:
        return [json.loads(json.dumps(row)) for row in csv.DictReader(f, delimiter=delimiter)]


def loaded(spark, root):
    registry, found = load_bronze(spark, str(root), comma_sources=["commas"])
    check_complete(registry, found)
    out = {}
    for r in found.orderBy("file_name", "row_number").collect():
        rows = out.setdefault(r.file_name, [])
        assert r.row_number == len(rows) + 1
        rows.append(json.loads(r.payload))
    return out, {r.file_name: r.n_records for r in registry.collect()}


@pytest.fixture(params=[23, 200, 1 << 27])
def split_bytes(spark, request, monkeypatch):
    scan_in_splits(spark, monkeypatch, request.param)
    monkeypatch.setattr(records, "CHUNK", 64)


def test_cells_with_the_other_delimiter(spark, tmp_path, split_bytes):
    put(tmp_path / "x" / "a.csv", 'id;txt\n1;a,"b\n2;c\n3;d,"e\n4;f\n')
    put(tmp_path / "commas" / "b.csv", 'id,txt\n1,a;"b\n2,"c\n;"\n3,d;"e\n4,f')
    put(tmp_path / "x" / "c.csv", 'id;txt\n1;"rua x,""casa"" 5"\n2;rua x,"casa\n3;"a"b;"c\nd"\n')
    got, counts = loaded(spark, tmp_path)
    for path in tmp_path.glob("*/*.csv"):
        assert got[path.name] == plain(path) and counts[path.name] == len(plain(path))
    assert len(got["a.csv"]) == 4


def test_generated_files(spark, tmp_path, split_bytes):
    """Both delimiters in cells, quotes in any place, all line ends, breaks across splits, open ends."""
    rng = random.Random(8)
    for k in range(16):
        d = rng.choice(";,")
        text = f"id{d}text{d}more" + rng.choice(["\n", "\r\n"])
        for row in range(rng.randint(0, 12)):
            if rng.random() < 0.5:
                text += d.join([str(row), '"' + "".join(rng.choices(ALPHABET, k=8)).replace('"', '""') + '"', "x"]) + rng.choice(["\n", "\r\n"])
            else:
                text += "".join(rng.choices(ALPHABET, k=rng.randint(0, 12))) + rng.choice(["\n", "\r\n", ""])
        put(tmp_path / rng.choice(["x", "commas"]) / f"f{k}.csv", text)
    put(tmp_path / "x" / "blank.csv", "\na;b\n1;2\n")
    put(tmp_path / "x" / "wide.csv", "a;" * 200 + '"b\nc"\n' + "1;" * 200 + '"2\n3"\n')
    put(tmp_path / "x" / "long.csv", 'a;b\n1;"' + "line, of; text\n" * 40 + '"\n2;x')
    got, counts = loaded(spark, tmp_path)
    for path in tmp_path.glob("*/*.csv"):
        want = plain(path)
        assert got.get(path.name, []) == want, path.read_bytes()
        assert counts[path.name] == len(want)


def test_effects_compose():
    """The effect of two stretches is the composition of their effects, whatever the cut."""
    rng = random.Random(3)
    for _ in range(300):
        lines = records.lines_of("".join(rng.choices(ALPHABET, k=60)))
        cut = rng.randint(0, len(lines))
        for d in ";,":
            for quoted in (False, True):
                whole, first = records.effect(lines, d, quoted), records.effect(lines[:cut], d, quoted)
                second = records.effect(lines[cut:], d, first[0])
                assert whole[:2] == (second[0], first[1] + second[1])


def test_delimited_over_splits(spark, tmp_path, split_bytes):
    with (tmp_path / "t.csv").open("w", encoding="utf-8", newline="") as f:
        writer = csv.writer(f, delimiter=";")
        writer.writerow(["id", "text;x", "more"])
        rows = [[str(k), f"l\u00edne {k}\nnext; {'x' * (k % 40)}", 'say "x"'] for k in range(60)]
        writer.writerows(rows)
        f.write("short\r\nlong;1;2;3;4\r\n")
    read = read_delimited(spark, str(tmp_path / "t.csv"), ";", "UTF-8")
    want = [*map(tuple, rows), ("short", None, None), ("long", "1", "2")]
    assert read.columns == ["id", "text;x", "more"] and sorted(map(tuple, read.collect()), key=str) == sorted(want, key=str)
    picked = read_delimited(spark, str(tmp_path / "t.csv"), ";", "UTF-8", columns=["more", "id"])
    assert sorted(map(tuple, picked.collect()), key=str) == sorted(((w[2], w[0]) for w in want), key=str)
    with pytest.raises(Exception, match="no column"):
        read_delimited(spark, str(tmp_path / "t.csv"), ";", "UTF-8", columns=["absent"]).collect()


def test_a_batch_is_not_held_as_objects():
    """The chunks of a batch come one after another; its values are not all Python objects at a time."""
    import tracemalloc

    import pyarrow as pa

    n, size = 4000, 10_000
    value = pa.array([bytes(size)] * n, pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(["p"] * n), pa.array([1] * n), pa.array([0] * n), value], names=["path", "size", "block", "value"])
    tracemalloc.start()
    try:
        found = sum(len(data) for *_, data in records.in_chunks(iter([batch]), b"\n", 1 << 20))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == n * (size + 1) and most < n * size / 4
