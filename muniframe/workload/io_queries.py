"""Sources and sinks: tables written to the shared folder in each format, read back, and compared with the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import DAY_MONTH_YEAR_MINUTE, month_start, parse_date
from ..operators.aggregates import profile_distinct, value_counts
from ..plans.models import fit_count_model, load_model, predict_counts, save_model
from ..session import shared_folder
from ..sources.bronze import load_bronze, read_records, read_registry, write_bronze
from ..sources.files import LATIN1, UTF8, list_files, read_delimited, required_files, superseded_files, write_delimited, write_distinct_values, write_summary
from ..sources.geojson import read_geojson
from ..sources.listing import has_new_file, load_state, save_state
from ..streaming.ingest import ingest_once
from .adapters import HISTORY_SQL, features
from .catalog import Tables, query, rounded

FORMATS = {"semicolon_latin1": (";", LATIN1), "semicolon_utf8": (";", UTF8), "comma_latin1": (",", LATIN1)}
TEXTS = ["doc_id", "lang", "source", "text"]


@query(f"SELECT format, doc_id, lang, md5(text) AS text_md5 FROM documents CROSS JOIN (VALUES {', '.join(f'({f!r})' for f in FORMATS)}) AS f(format)")
def delimited_round_trip(t: Tables) -> DataFrame:
    """Every document through each dialect, line breaks and quotes in its text included."""
    out = None
    for name, (sep, encoding) in FORMATS.items():
        folder = shared_folder(t.spark, "csv")
        write_delimited(t.documents.select(TEXTS), folder, sep, encoding)
        read = read_delimited(t.spark, folder, sep, encoding, TEXTS)
        part = read.select(F.lit(name).alias("format"), F.col("doc_id").cast("long").alias("doc_id"), "lang", F.md5("text").alias("text_md5"))
        out = part if out is None else out.unionByName(part)
    return out


def _bronze(t: Tables) -> str:
    """Documents as CSV files of two sources, with either delimiter; returns the root folder."""
    root = shared_folder(t.spark, "landing")
    write_delimited(t.documents.select(TEXTS), f"{root}/semicolons", ";", LATIN1)
    write_delimited(t.documents.select(TEXTS), f"{root}/commas", ",", LATIN1)
    return root


@query("SELECT s AS source, doc_id, lang, md5(text) AS text_md5, TRUE AS in_file FROM documents CROSS JOIN (VALUES ('semicolons'), ('commas')) AS x(s)")
def bronze_records(t: Tables) -> DataFrame:
    """Loaded, written as a version, and read back: the payload of every record, and that its number lies within its file."""
    out = shared_folder(t.spark, "bronze")
    write_bronze(t.spark, *load_bronze(t.spark, _bronze(t), comma_sources=["commas"]), out)
    sizes = read_registry(t.spark, out).select(F.col("id").alias("raw_file_id"), "n_records")
    cell = F.from_json("payload", "doc_id string, lang string, text string")
    rows = read_records(t.spark, out).join(sizes, "raw_file_id").withColumn("cell", cell)
    return rows.select("source", F.col("cell.doc_id").cast("long").alias("doc_id"), "cell.lang", F.md5("cell.text").alias("text_md5"), F.col("row_number").between(1, F.col("n_records")).alias("in_file"))


@query("SELECT s AS source, CAST(count(*) AS BIGINT) AS n_records, CAST(count(*) AS BIGINT) AS numbers, CAST(count(*) AS BIGINT) AS last_numbers FROM documents CROSS JOIN (VALUES ('semicolons'), ('commas')) AS x(s) GROUP BY s")
def bronze_stream(t: Tables) -> DataFrame:
    """The same files taken as a stream: records by the registry, distinct numbers, and the sum of the files' last numbers."""
    out, state = shared_folder(t.spark, "bronze"), shared_folder(t.spark, "state")
    ingest_once(t.spark, _bronze(t), out, state, ["commas"]).awaitTermination()
    files = read_records(t.spark, out).groupBy("source", "file_name").agg(F.count_distinct("row_number").alias("numbers"), F.max("row_number").alias("last"))
    found = files.groupBy("source").agg(F.sum("numbers").alias("numbers"), F.sum("last").alias("last_numbers"))
    return read_registry(t.spark, out).groupBy("source").agg(F.sum("n_records").alias("n_records")).join(found, "source")


WANTED = ["NATION_1", "NATION_7", "NATION_24", "NOWHERE"]


@query(f"SELECT n_name AS name, n_name IN ({', '.join(map(repr, WANTED))}) AS required, n_name NOT IN ({', '.join(map(repr, WANTED))}) AS superseded FROM nation")
def listed_files(t: Tables) -> DataFrame:
    """A folder per nation, listed without reading it, against an allow-list and a keep-list."""
    folder = shared_folder(t.spark, "list")
    t.nation.withColumn("name", F.col("n_name")).write.partitionBy("name").parquet(folder)
    files = list_files(t.spark, folder, "*.parquet").withColumn("name", F.regexp_extract("path", "name=([^/]*)/", 1))
    tag = lambda df, c: df.select("name").distinct().withColumn(c, F.lit(True))
    wanted, old = tag(required_files(files, WANTED), "required"), tag(superseded_files(files, WANTED), "superseded")
    found = files.select("name").distinct().join(wanted, "name", "left").join(old, "name", "left")
    return found.select("name", F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("superseded", F.lit(False)).alias("superseded"))


@query("""SELECT DISTINCT v AS value FROM (SELECT o_orderpriority AS v FROM orders UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT CAST(c_nationkey AS VARCHAR) FROM customer)""")
def distinct_values_file(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "values")
    values = profile_distinct(t.orders, ["o_orderpriority"]).unionByName(profile_distinct(t.customer, ["c_mktsegment", "c_nationkey"]))
    write_distinct_values(values, folder)
    return t.spark.read.text(folder)


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def summary_json(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "summary")
    write_summary(value_counts(t.orders, "o_orderpriority"), folder)
    return t.spark.read.json(folder).select("o_orderpriority", "n", rounded("share").alias("share"))


@query("""WITH p AS (SELECT 'p' || page_id AS filename, url, CAST(length(html) AS VARCHAR) AS size, page_id FROM pages)
SELECT saved.filename AS latest_file, saved.url AS latest_url, saved.size AS portal_size, CAST((SELECT count(*) FROM pages) - 1 AS BIGINT) AS newer
FROM p saved WHERE page_id = (SELECT max(page_id) FROM pages)""")
def ingest_state_log(t: Tables) -> DataFrame:
    """Two states saved one after the other; the later one is in force, and every other page differs from it."""
    path = shared_folder(t.spark, "state")
    pages = t.pages.select(F.concat(F.lit("p"), "page_id").alias("filename"), "url", F.lit("01/02/2024 10:00").alias("portal_updated_at"), F.length("html").cast("string").alias("portal_size"), "page_id")
    for pick in (F.min, F.max):
        save_state(pages.where(F.col("page_id") == pages.agg(pick("page_id")).scalar()).drop("page_id"), path)
    state = load_state(t.spark, path)
    newer = has_new_file(pages.drop("page_id"), state).agg(F.count(F.lit(1)).alias("newer"))
    return state.select("latest_file", "latest_url", "portal_size", newer.scalar().alias("newer"))


@query("SELECT c_custkey, c_name AS nome, c_mktsegment || ' \"{}]' AS note, round(c_acctbal, 2) AS x FROM customer")
def geojson_features(t: Tables) -> DataFrame:
    """Customers as points of collections that each fill one line, braces and quotes inside their texts."""
    folder = shared_folder(t.spark, "map")
    note = F.concat("c_mktsegment", F.lit(' "{}]'))
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round("c_acctbal", 2), F.lit(0.0)).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("nome"), note.alias("note")).alias("properties"), point.alias("geometry")))
    some = t.customer.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 5000)).agg(F.array_join(F.collect_list(feature), ",").alias("features"))
    some.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "features", F.lit("]}"))).write.text(folder)
    read = read_geojson(t.spark, folder, ["id", "nome", "note"])
    return read.select(F.col("id").cast("long").alias("c_custkey"), "nome", "note", F.from_json("geometry", "coordinates array<double>")["coordinates"][0].alias("x"))


@query(f"WITH {HISTORY_SQL} SELECT categoria, count(*) AS n, TRUE AS same FROM hist WHERE lag_12 IS NOT NULL GROUP BY categoria")
def saved_model(t: Tables) -> DataFrame:
    """A fitted model saved, loaded, and asked again: the same forecasts for all rows."""
    frame = features(t).persist()
    folder = shared_folder(t.spark, "model")
    model = fit_count_model(frame, "poisson_regressor", ["log1p_lag_1"], ["categoria"], {"maxIter": 10})
    save_model(model, folder)
    keys = ["unit", "categoria", "data"]
    before, after = predict_counts(model, frame, keys), predict_counts(load_model(folder), frame, keys).withColumnRenamed("y_pred", "again")
    return before.join(after, keys).groupBy("categoria").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("y_pred") == F.col("again")).alias("same"))


@query("SELECT CAST(date_trunc('month', ts) AS DATE) AS month, CAST(hour(ts) AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def month_starts(t: Tables) -> DataFrame:
    """Event times written as day/month/year hour:minute, parsed again, set to the start of their month."""
    at = parse_date(F.date_format("ts", "d/M/yyyy H:m"), DAY_MONTH_YEAR_MINUTE)
    rows = t.events.select(at.alias("at"))
    return rows.groupBy(month_start(F.year("at"), F.month("at")).alias("month"), F.hour("at").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
