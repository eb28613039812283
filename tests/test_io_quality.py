import csv
import json

import pytest
from conftest import scan_in_splits
from pyspark.sql import functions as F

from muniframe.operators.quality import (
    CORRECTED_RULES, LITERAL_RULES, check_constraints, duplicate_keys, fk_orphans, overlapping_values, range_rules, require_rows, with_defaults,
)
from muniframe.operators.joins import outer_profile, union_schemas
from muniframe.operators.aggregates import aggregate_units, balance_weights, profile_distinct, value_counts
from muniframe.sources import bronze, commits, records as splits
from muniframe.sources.bronze import check_complete, load_bronze, read_records, read_registry, row_payload, upsert, write_bronze
from muniframe.sources.files import list_files, required_files, superseded_files, write_delimited, write_distinct_values, write_summary, read_delimited
from muniframe.sources.listing import (
    changed, file_candidates, has_new_file, html_table_rows, latest_by, latest_file, listing_html, load_state, save_state, url_file_name,
)
from muniframe.streaming.ingest import ingest_once


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="latin-1")


@pytest.fixture
def landing(tmp_path):
    root = tmp_path / "bronze"
    put(root / "inc" / "a.csv", "a,b,c\n" + "".join(f'{i},"x,{i}",á\n' for i in range(200)) + "1,2\n1,2,3,4,\n1,,\n\n,,9\n")
    put(root / "cen" / "b.csv", "a;b\r\n1;2\r\n")
    put(root / "cen" / "empty.csv", "a;b\n")
    put(root / "inc" / "one.csv", "solo\nv\n")
    return root


@pytest.fixture
def many_splits(spark, monkeypatch):
    scan_in_splits(spark, monkeypatch, 300)


def test_bronze_rows_over_many_splits(spark, landing, many_splits):
    registry, records = load_bronze(spark, str(landing), comma_sources=["inc"])
    assert splits.chunks_of(spark, str(landing / "inc" / "a.csv"), "latin-1", ",").select("block").distinct().count() > 5
    rows = {r["row_number"]: json.loads(r["payload"]) for r in records.where("file_name = 'a.csv'").collect()}
    assert sorted(rows) == list(range(1, 205))
    assert all(rows[i + 1] == {"a": str(i), "b": f"x,{i}", "c": "á"} for i in range(200))
    # Short row, long row, empty cells; the blank line is not a row.
    assert rows[201] == {"a": "1", "b": "2", "c": None}
    assert rows[202]["null"] == ["4", ""] and rows[203] == {"a": "1", "b": "", "c": ""} and rows[204] == {"a": "", "b": "", "c": "9"}
    other = {(r["file_name"], r["row_number"]): json.loads(r["payload"]) for r in records.where("file_name <> 'a.csv'").collect()}
    assert other == {("b.csv", 1): {"a": "1", "b": "2"}, ("one.csv", 1): {"solo": "v"}}
    sizes = {r["file_name"]: r["file_size_bytes"] for r in registry.collect()}
    assert set(sizes) == {"a.csv", "b.csv", "empty.csv", "one.csv"} and sizes["b.csv"] == (landing / "cen" / "b.csv").stat().st_size


@pytest.mark.parametrize("size", [37, 300, 134217728])
def test_bronze_keeps_quoted_line_breaks(spark, tmp_path, monkeypatch, size):
    rows = [["1", "line one\nline two", 'say "x"'], ["2", "a;b\n\n\nc", ""], ["3", 'in"side', "5"], ["4", "\n", "\n;\n"], ["5", "plain", "é"]] * 9
    path = tmp_path / "q" / "inc" / "a.csv"
    path.parent.mkdir(parents=True)
    with path.open("w", encoding="latin-1", newline="") as f:
        writer = csv.writer(f, delimiter=";", lineterminator="\n")
        writer.writerow(["id", 'text;"x"', "more"])
        writer.writerows(rows)
        f.write('6;5" pipe;x\n7;"open ""end""";\n')
    want = list(csv.DictReader(path.open(encoding="latin-1", newline=""), delimiter=";"))
    scan_in_splits(spark, monkeypatch, size)
    registry, records = load_bronze(spark, str(tmp_path / "q"))
    got = [json.loads(r.payload) for r in records.orderBy("row_number").collect()]
    assert got == want and registry.first()["n_records"] == len(want)


def test_bronze_is_whole_when_splits_change(spark, tmp_path):
    path = tmp_path / "big" / "inc" / "a.csv"
    put(path, "a,b\n" + "".join(f"{i},x{i}\n" for i in range(250_000)))
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        registry, records = load_bronze(spark, str(tmp_path / "big"))
        spark.conf.set("spark.sql.files.minPartitionNum", "4")
        numbers = records.agg(F.count("*"), F.min("row_number"), F.max("row_number"), F.count_distinct("row_number")).first()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert tuple(numbers) == (250_000, 1, 250_000, 250_000) and registry.first()["n_records"] == 250_000
    check_complete(registry, records)
    with pytest.raises(ValueError, match="differ"):
        check_complete(registry, records.where("row_number > 1"))


def in_force(spark, out):
    """(file, row, payload) of the version that readers see."""
    found = read_records(spark, str(out))
    return None if found is None else sorted((r.file_name, r.row_number, r.payload) for r in found.collect())


@pytest.mark.parametrize("step", ["records", "check", "manifest"])
def test_bronze_is_whole_wherever_a_load_stops(spark, landing, tmp_path, monkeypatch, step):
    out = tmp_path / "out"
    stop = RuntimeError("stopped")

    def stopping(rows, root):
        rows.write.parquet(f"{root}/{max(commits.versions(spark, root), default=0) + 1:012d}")
        (out / "raw_files" / f"{max(commits.versions(spark, root)):012d}" / "_SUCCESS").unlink()
        raise stop

    def failing_load():
        with monkeypatch.context() as m:
            if step == "check":
                m.setattr(bronze, "check_complete", lambda *_: (_ for _ in ()).throw(stop))
            if step == "manifest":
                m.setattr(bronze, "publish", stopping)
            registry, found = load_bronze(spark, str(landing))
            if step == "records":
                found = found.withColumn("payload", F.when(F.col("row_number") > 0, F.raise_error(F.lit("stopped"))).otherwise(F.col("payload")))
            with pytest.raises(Exception, match="stopped"):
                write_bronze(spark, registry, found, str(out))

    failing_load()
    assert in_force(spark, out) is None and read_registry(spark, str(out)) is None
    write_bronze(spark, *load_bronze(spark, str(landing)), str(out))
    first = in_force(spark, out)
    assert len(first) == 206 and read_registry(spark, str(out)).count() == 4
    put(landing / "inc" / "a.csv", "a,b,c\n7,8,9\n")
    failing_load()
    assert in_force(spark, out) == first
    write_bronze(spark, *load_bronze(spark, str(landing)), str(out))
    assert [r for r in in_force(spark, out) if r[0] == "a.csv"] == [("a.csv", 1, '{"a":"7","b":"8","c":"9"}')]


def test_bronze_reload_replaces_only_its_files(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    write_bronze(spark, *load_bronze(spark, str(landing)), out)
    ids = {r["file_name"]: r["id"] for r in read_registry(spark, out).collect()}
    assert len(in_force(spark, out)) == 206
    put(landing / "inc" / "a.csv", "a,b,c\n7,8,9\n")
    put(landing / "cen" / "b.csv", "a;b\n")
    write_bronze(spark, *load_bronze(spark, str(landing), "inc"), out)
    write_bronze(spark, *load_bronze(spark, str(landing), "cen"), out)
    assert {(f, p) for f, _, p in in_force(spark, out)} == {("a.csv", '{"a":"7","b":"8","c":"9"}'), ("one.csv", '{"solo":"v"}')}
    assert {r["file_name"]: r["id"] for r in read_registry(spark, out).collect()} == ids


def test_state_is_the_last_whole_one(spark, tmp_path):
    path = str(tmp_path / "state")
    row = lambda name: spark.createDataFrame([(name, "u", "t", "s")], "filename string, url string, portal_updated_at string, portal_size string")
    assert load_state(spark, path).count() == 0
    for name in ("one", "two", "three"):
        save_state(row(name), path)
        assert [r.latest_file for r in load_state(spark, path).collect()] == [name]
    (tmp_path / "state" / "000000000003" / "_SUCCESS").unlink()
    assert [r.latest_file for r in load_state(spark, path).collect()] == ["two"]
    save_state(row("four"), path)
    assert commits.versions(spark, path) == {1: True, 2: True, 3: False, 4: True} and load_state(spark, path).first().latest_file == "four"


def test_stream_takes_each_file_once(spark, landing, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest_once(spark, str(landing), out, state).awaitTermination()
    assert len(in_force(spark, out)) == 206
    put(landing / "inc" / "late.csv", "a,b,c\n1,2,3\n")
    query = ingest_once(spark, str(landing), out, state)
    query.awaitTermination()
    assert len(in_force(spark, out)) == 207 and query.lastProgress["numInputRows"] == 1


PORTAL = """<table><tr><th>h</th></tr>
<tr class="r"><td><a href="http://p/x/2024-01_base.csv">one &amp; only</a></td><td>csv</td><td>02/01/2024 09:05</td><td>1 MB</td></tr>
<TR><TD><a title=x href='http://p/x/2024-10_base.csv?k=1#f'>b</a></TD><td>csv</td><td> 1/10/2024 9:00 </td><td>2 MB</td></tr>
<tr><td><a href="http://p/x/2024-10_base.csv">b</a></td><td>csv</td><td> 1/10/2024 9:00 </td><td>2 MB</td></tr>
<tr><td>no link</td><td>csv</td><td>01/12/2024 09:00</td><td>2 MB</td></tr>
<tr><td><a href="http://p/x/other.pdf">b</a></td><td>pdf</td><td>01/12/2024 09:00</td><td>2 MB</td></tr>
<tr><td><a href="http://p/x/z_base.csv">b</a></td><td>3 cells</td><td>01/12/2024 09:00</td></tr></table>"""


def test_portal_listing(spark, tmp_path):
    answers = spark.createDataFrame([(json.dumps({"sucesso": True, "tabela": PORTAL}),)], "body string")
    rows = html_table_rows(listing_html(answers), "html")
    first = rows.orderBy("row").first()["cells"]
    assert [c["text"] for c in first] == ["one & only", "csv", "02/01/2024 09:05", "1 MB"] and rows.count() == 6
    latest = latest_file(file_candidates(rows, "_base.csv"))
    assert tuple(latest.first()) == ("http://p/x/2024-10_base.csv", "2024-10_base.csv", "1/10/2024 9:00", "2 MB")
    state = str(tmp_path / "state")
    assert has_new_file(latest, load_state(spark, state)).count() == 1
    save_state(latest, state)
    assert has_new_file(latest, load_state(spark, state)).count() == 0
    assert has_new_file(latest.withColumn("portal_size", F.lit("3 MB")), load_state(spark, state)).count() == 1
    failed = spark.createDataFrame([(json.dumps({"sucesso": False, "erro": "down"}),)], "body string")
    with pytest.raises(Exception, match="down"):
        listing_html(failed).collect()


def test_url_and_latest(spark):
    urls = spark.createDataFrame([("http://a/b/c.csv?x=1#y",), ("http://a/",)], "u string")
    assert [r[0] for r in urls.select(url_file_name(F.col("u"))).collect()] == ["c.csv", ""]
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", None, "c")], "k string, t int, v string")
    assert {r["k"]: r["v"] for r in latest_by(df.where("t is not null"), F.col("t"), ["k"]).collect()} == {"k": "b"}
    state = spark.createDataFrame([("k", None)], "k string, v string")
    now = spark.createDataFrame([("k", None), ("m", "c")], "k string, v string")
    assert [r["k"] for r in changed(now, state, ["k"], ["v"]).collect()] == ["m"]


def test_files_and_sinks(spark, landing, tmp_path):
    files = list_files(spark, str(landing), "*.csv")
    assert sorted(r["name"] for r in required_files(files, ["a.csv", "zzz.csv"]).collect()) == ["a.csv"]
    assert sorted(r["name"] for r in superseded_files(files, ["a.csv", "b.csv"]).collect()) == ["empty.csv", "one.csv"]
    df = spark.createDataFrame([("á", "1"), (None, "2")], "x string, y string")
    for encoding, sep in (("ISO-8859-1", ";"), ("UTF-8", ","), ("ISO-8859-1", ",")):
        write_delimited(df, str(tmp_path / "csv"), sep, encoding)
        back = read_delimited(spark, str(tmp_path / "csv"), sep, encoding, columns=["x", "y"])
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    write_distinct_values(spark.createDataFrame([("b",), ("a",), ("b",)], "value string"), str(tmp_path / "txt"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "txt")).collect()] == ["a", "b"]
    write_summary(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert sorted(r[0] for r in df.select(row_payload(df)).collect()) == ['{"x":"á","y":"1"}', '{"x":null,"y":"2"}']


def test_constraints(spark):
    df = spark.createDataFrame([(1, 0), (13, 8), (None, 9)], "ocorrencia_mes int, ocorrencia_dia_semana int")
    found = lambda rules: {r["rule"]: r["violations"] for r in check_constraints(df, range_rules(rules["occurrence"])).collect()}
    assert found(LITERAL_RULES) == {"ocorrencia_mes between 1 and 12": 1, "ocorrencia_dia_semana between 1 and 12": 1}
    assert found(CORRECTED_RULES)["ocorrencia_dia_semana between 0 and 7"] == 2
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert list(map(tuple, fk_orphans(child, spark.createDataFrame([(2,)], "p int"), "k", "p").collect())) == [(1, 2)]
    assert [tuple(r) for r in duplicate_keys(child, ["k"]).collect()] == [(1, 2)]
    vocabulary = spark.createDataFrame([("v", "A"), ("v", "B"), ("w", "A")], "value string, cat string")
    assert overlapping_values(vocabulary, "value", "cat").first()["categories"] == ["A", "B"]
    assert [r["k"] for r in with_defaults(child, {"k": 0, "z": True}).orderBy("k").collect()] == [0, 1, 1, 2]
    with pytest.raises(ValueError, match="4 rows"):
        require_rows(child, 5)


def test_aggregates_and_unions(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), (None, 1.0)], "u string, v double")
    assert {r["u"]: r["v"] for r in aggregate_units(df, ["u"], ["v"]).collect()} == {"a": 0.0, "b": 2.0}
    assert {r["u"]: r["v"] for r in aggregate_units(df, ["u"], ["v"], null_zero=False).collect()} == {"a": None, "b": 2.0}
    assert {(r["column"], r["value"]) for r in profile_distinct(df, ["u", "v"]).collect()} == {("u", "a"), ("u", "b"), ("v", "2.0"), ("v", "1.0")}
    assert {r["u"]: r["share"] for r in value_counts(df, "u").collect()} == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3), None: None}
    assert {r["u"]: r["weight"] for r in balance_weights(df, "u").collect()} == {"a": 0.75, "b": 1.5}
    wide = outer_profile([df.dropna().select("u", "v"), spark.createDataFrame([("c", 1)], "u string, w_x int")], ["u"], "_x")
    assert sorted(wide.columns) == ["u", "v_x", "w_x"] and wide.count() == 2
    assert union_schemas(df, spark.createDataFrame([(1,)], "z int")).columns == ["u", "v", "z"]
    old, new = (spark.createDataFrame([(k, v)], "k int, v string") for k, v in ((1, "o"), (1, "n")))
    assert [tuple(r) for r in upsert(old, new, ["k"]).collect()] == [(1, "n")]


def test_delimited_null_words_and_quoted_breaks(spark, tmp_path):
    text = 'a;b.c\n1;NA\nnull;nada\n" x";"line\n""two"""\nNaN;None\n'
    put(tmp_path / "n.csv", text)
    rows = lambda **o: [tuple(r) for r in read_delimited(spark, str(tmp_path / "n.csv"), **o).collect()]
    assert rows() == [("1", None), (None, "nada"), (" x", 'line\n"two"'), (None, None)]
    assert rows(null_words=(), columns=["a", "b.c"]) == [("1", "NA"), ("null", "nada"), (" x", 'line\n"two"'), ("NaN", "None")]
