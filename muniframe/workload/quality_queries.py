"""Bronze, listings, change detection, constraints and class metrics on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.aggregates import balance_weights, class_report, confusion_metrics
from ..operators.joins import checked_join
from ..operators.quality import check_constraints, duplicate_keys, fk_orphans, not_null_rules, overlapping_values, range_rules, with_defaults
from ..plans.classify import fit_imputer, stratified_split
from ..plans.models import population_scaler
from ..sources.bronze import row_payload, upsert
from ..sources.listing import changed, file_candidates, html_links, html_table_rows, latest_by, listing_html, url_file_name
from .catalog import Tables, query, round_all, rounded


@query("""SELECT CAST(event_id AS BIGINT) AS row_number, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS payload,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def bronze_payload(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type", "props")
    return rows.select(
        F.col("event_id").alias("row_number"), row_payload(rows, exclude=["props"]).alias("payload"),
        F.from_json("props", "k bigint")["k"].alias("k"),
    )


def _day_files(t: Tables) -> DataFrame:
    """Events of one type and day play one file; its size is its row count."""
    return t.events.groupBy(F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("file_name"))


@query("""
WITH old AS (SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS file_name, count(*) AS n, 'old' AS batch FROM events WHERE day(ts) <= 20 GROUP BY 1, 2),
new AS (SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS file_name, 2 * count(*) AS n, 'new' AS batch FROM events WHERE day(ts) >= 11 GROUP BY 1, 2)
SELECT source, file_name, CAST(n AS BIGINT) AS file_size_bytes, batch FROM new UNION ALL
SELECT source, file_name, CAST(n AS BIGINT), batch FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.source = old.source AND new.file_name = old.file_name)""")
def bronze_upsert(t: Tables) -> DataFrame:
    sizes = _day_files(t).agg(F.count(F.lit(1)).alias("file_size_bytes"))
    day = F.substring("file_name", 9, 2)
    old = sizes.where(day <= "20").withColumn("batch", F.lit("old"))
    new = sizes.where(day >= "11").withColumns({"file_size_bytes": F.col("file_size_bytes") * 2, "batch": F.lit("new")})
    return upsert(old, new, ["source", "file_name"])


@query(r"""SELECT CAST(page_id AS BIGINT) AS page_id, CAST(count(*) AS BIGINT) AS n, list_extract(list(h ORDER BY i), 1) AS first_href
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h, unnest(generate_series(1, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS i FROM pages) GROUP BY page_id""", "html_links")
def html_links_query(t: Tables) -> DataFrame:
    found = html_links(t.pages, "html")
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("href", "position").alias("first_href"))


def _pages_as_tables(t: Tables) -> DataFrame:
    """Navigation lists rewritten as one-column tables."""
    html = F.replace(F.replace("html", F.lit("<li>"), F.lit("<tr><td>")), F.lit("</li>"), F.lit("</td></tr>"))
    return t.pages.select("page_id", "url", html.alias("html"))


@query(r"""SELECT CAST(page_id AS BIGINT) AS page_id, CAST(i - 1 AS BIGINT) AS "row", trim(regexp_replace(c, '<[^>]*>', '', 'g')) AS text, regexp_extract(c, 'href="([^"]*)"', 1) AS link
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS c, unnest(generate_series(1, len(regexp_extract_all(html, '<li>(.*?)</li>', 1)))) AS i FROM pages)""", "html_table_rows")
def html_table_rows_query(t: Tables) -> DataFrame:
    rows = html_table_rows(_pages_as_tables(t), "html")
    cell = F.col("cells")[0]
    return rows.select("page_id", F.col("row").cast("bigint"), cell["text"].alias("text"), F.coalesce(F.try_element_at(cell["links"], F.lit(1)), F.lit("")).alias("link"))


@query(r"""SELECT CAST(page_id AS BIGINT) AS page_id, h AS url, regexp_extract(h, '([^/?]*)(\?.*)?$', 1) AS filename, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(page_id AS INTEGER)), '%d/%m/%Y %H:%M') AS portal_updated_at,
  CAST(length(html) AS VARCHAR) AS portal_size
FROM (SELECT page_id, html, regexp_extract(html, '<li><a href="([^"]*)"', 1) AS h FROM pages) WHERE h LIKE '%a'""")
def portal_candidates(t: Tables) -> DataFrame:
    """Portal answers (JSON with an HTML table) built from each page's first navigation link."""
    link = F.regexp_extract("html", '<li>(<a href="[^"]*")', 1)
    stamp = F.date_format(F.timestamp_add("HOUR", F.col("page_id").cast("int"), F.lit("2024-01-01").cast("timestamp")), "dd/MM/yyyy HH:mm")
    row = F.concat(F.lit("<tr class='x'><td>"), link, F.lit(">f</a></td><td>csv</td><td> "), stamp, F.lit("</td><td>"), F.length("html"), F.lit("</td></tr>"))
    answers = t.pages.select("page_id", F.to_json(F.struct(F.lit(True).alias("sucesso"), row.alias("tabela"))).alias("body"))
    return file_candidates(html_table_rows(listing_html(answers), "html"), "a", keep=["page_id"])


@query(r"""SELECT CAST(page_id AS BIGINT) AS page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS file_name FROM pages""")
def url_file_names(t: Tables) -> DataFrame:
    return t.pages.select("page_id", url_file_name(F.col("url")).alias("file_name"))


@query("""SELECT CAST(user_id AS BIGINT) AS user_id, CAST(arg_max(event_id, ts) AS BIGINT) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id""")
def latest_per_group(t: Tables) -> DataFrame:
    stamped = t.events.withColumn("text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    order = F.try_to_timestamp("text", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return latest_by(stamped.select("user_id", "event_id", "event_type", "text"), order, ["user_id"]).select("user_id", "event_id", "event_type")


@query("""
WITH old AS (SELECT user_id, arg_max(event_type, ts) AS e, count(*) AS n FROM events WHERE day(ts) <= 15 GROUP BY user_id),
new AS (SELECT user_id, arg_max(event_type, ts) AS e, count(*) AS n FROM events WHERE day(ts) > 15 GROUP BY user_id)
SELECT CAST(new.user_id AS BIGINT) AS user_id, new.e AS event_type, CAST(new.n AS BIGINT) AS n FROM new LEFT JOIN old ON new.user_id = old.user_id
WHERE old.user_id IS NULL OR new.e IS DISTINCT FROM old.e OR new.n IS DISTINCT FROM old.n""")
def change_detection(t: Tables) -> DataFrame:
    def half(cond: str) -> DataFrame:
        return t.events.where(cond).groupBy("user_id").agg(F.max_by("event_type", "ts").alias("event_type"), F.count(F.lit(1)).alias("n"))

    return changed(half("day(ts) > 15"), half("day(ts) <= 15"), ["user_id"], ["event_type", "n"])


@query("""
SELECT 'l_orderkey not null' AS rule, CAST(sum(CASE WHEN l_orderkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM lineitem UNION ALL
SELECT 'l_discount between 0.01 and 0.09', CAST(sum(CASE WHEN l_discount < 0.01 OR l_discount > 0.09 THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem UNION ALL
SELECT 'l_quantity between 2 and None', CAST(sum(CASE WHEN l_quantity < 2 THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem""")
def constraint_report(t: Tables) -> DataFrame:
    rules = {**not_null_rules(["l_orderkey"]), **range_rules({"l_discount": (0.01, 0.09), "l_quantity": (2, None)})}
    return check_constraints(t.lineitem, rules)


@query("""SELECT CAST(l_orderkey AS BIGINT) AS "key", CAST(count(*) AS BIGINT) AS n FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1""", "fk_orphans")
def fk_orphans_query(t: Tables) -> DataFrame:
    return fk_orphans(t.lineitem, t.orders.where("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey")


@query("""SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_key_report(t: Tables) -> DataFrame:
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"]).withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


@query("""SELECT p_brand, CAST(count(DISTINCT p_type) AS BIGINT) AS n, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS categories FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1""")
def vocabulary_overlap(t: Tables) -> DataFrame:
    return overlapping_values(t.part, "p_brand", "p_type").withColumn("categories", F.array_join("categories", ","))


@query("""SELECT o_orderstatus, c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def many_to_one_join(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = checked_join(t.orders.select("o_custkey", "o_orderstatus"), customers, ["o_custkey"], "left", "m:1")
    return joined.groupBy("o_orderstatus", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN active THEN 1 ELSE 0 END) AS BIGINT) AS active FROM
 (SELECT source, CASE WHEN lang = 'en' THEN false ELSE true END AS active FROM documents) GROUP BY source""")
def default_values(t: Tables) -> DataFrame:
    flagged = t.documents.select("source", F.when(F.col("lang") == "en", False).alias("active"))
    filled = with_defaults(flagged, {"active": True})
    return filled.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("active"))


def _predictions(t: Tables) -> DataFrame:
    """Quality label against a length rule on the document."""
    rule = t.documents.select("doc_id", (F.col("n_chars") > 400).cast("bigint").alias("pred"))
    return t.labels.select("doc_id", F.col("quality").cast("bigint").alias("label")).join(rule, "doc_id")


_PRED_SQL = "p AS (SELECT quality AS y, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS z FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"
_REPORT_SQL = _PRED_SQL + """,
c AS (SELECT k.k AS class, CAST(sum(CASE WHEN y = k.k AND z = k.k THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN y = k.k THEN 1 ELSE 0 END) AS DOUBLE) AS a,
  CAST(sum(CASE WHEN z = k.k THEN 1 ELSE 0 END) AS DOUBLE) AS q FROM p CROSS JOIN (VALUES (0), (1)) k(k) GROUP BY k.k),
r AS (SELECT *, coalesce(tp / nullif(q, 0), 0) AS pr, coalesce(tp / nullif(a, 0), 0) AS re FROM c),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM r)"""


@query(f"WITH {_REPORT_SQL} SELECT round(sum(tp) / sum(a), 6) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * a) / sum(a), 6) AS f1_weighted, CAST(sum(a) AS BIGINT) AS n FROM f", "confusion_metrics")
def confusion_metrics_query(t: Tables) -> DataFrame:
    return round_all(confusion_metrics(_predictions(t), "label", "pred"), ["accuracy", "f1_macro", "f1_weighted"])


@query(f"WITH {_REPORT_SQL} SELECT CAST(class AS BIGINT) AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, CAST(a AS BIGINT) AS support FROM f", "class_report")
def class_report_query(t: Tables) -> DataFrame:
    return round_all(class_report(_predictions(t), "label", "pred").drop("tp"), ["precision", "recall", "f1"])


@query("""SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round((SELECT CAST(count(*) AS DOUBLE) FROM lineitem) / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*)), 6) AS weight
FROM lineitem GROUP BY l_returnflag""")
def class_balance_weights(t: Tables) -> DataFrame:
    return balance_weights(t.lineitem, "l_returnflag").withColumn("weight", rounded("weight"))


@query("""
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT *, floor(n * 0.6 + 0.5) AS a, floor(n * 0.8 + 0.5) AS b FROM c)
SELECT o_orderpriority, CAST(0 AS BIGINT) AS part, CAST(a AS BIGINT) AS n FROM k UNION ALL
SELECT o_orderpriority, 1, CAST(b - a AS BIGINT) FROM k UNION ALL SELECT o_orderpriority, 2, CAST(n - b AS BIGINT) FROM k""")
def stratified_split_counts(t: Tables) -> DataFrame:
    parts = stratified_split(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")
    return parts.groupBy("o_orderpriority", F.col("part").cast("bigint").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem)
SELECT l_returnflag, round(avg((l_quantity - m) / d), 6) AS mean_z, round(max((l_quantity - m) / d), 6) AS max_z FROM lineitem CROSS JOIN s GROUP BY l_returnflag""")
def standard_scaling(t: Tables) -> DataFrame:
    scaled = population_scaler(t.lineitem, ["l_quantity"]).transform(t.lineitem.select("l_returnflag", "l_quantity"))
    return scaled.groupBy("l_returnflag").agg(rounded(F.avg("l_quantity__scaled")).alias("mean_z"), rounded(F.max("l_quantity__scaled")).alias("max_z"))


@query("""WITH g AS (SELECT CASE WHEN l_quantity > 5 THEN l_quantity END AS q, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS f FROM lineitem),
m AS (SELECT median(q) AS q, (SELECT f FROM g WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1) AS f FROM g)
SELECT coalesce(g.f, m.f) AS f, CAST(count(*) AS BIGINT) AS n, round(sum(coalesce(g.q, m.q)), 2) AS q FROM g CROSS JOIN m GROUP BY 1""")
def impute_most_frequent_median(t: Tables) -> DataFrame:
    gaps = t.lineitem.select(F.expr("CASE WHEN l_quantity > 5 THEN l_quantity END AS q"), F.expr("CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS f"))
    filled = fit_imputer(gaps, ["q"], ["f"]).transform(gaps)
    return filled.groupBy("f").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("q"), 2).alias("q"))
