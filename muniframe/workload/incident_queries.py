"""Text, dates, numbers, classification and census roll-ups on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import (
    any_positive, argmax_name, clean_text, map_binary, map_weekday_pt, normalize_name, parse_census_number, parse_ptbr_number,
    pct, period_of_day, positive_ratio, row_mean, row_sum, standardize_category,
)
from ..functions.dates import DAY_MONTH_YEAR, TIMESTAMP_FRACTION
from ..operators.aggregates import aggregate_units, profile_distinct, value_counts
from ..operators.joins import common_keys, key_difference, outer_profile, suffix_columns, union_schemas
from ..plans.incidents import classify_first_match, first_category, invalid_dates, split_date, split_time, unmapped_values
from .adapters import incidents
from .catalog import Tables, iso, query, rounded

CLEAN_SQL = (
    r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^\x00-\x7F]', '', 'g'), "
    r"'[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), '')"
)


@query(f"SELECT doc_id, {CLEAN_SQL.format(c='text')} AS cleaned FROM documents")
def text_clean(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query(r"SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')) AS normalized FROM documents")
def name_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", normalize_name(F.col("text")).alias("normalized"))


@query("""
SELECT CASE WHEN lower(p_type) IN ('promo') THEN NULL
            WHEN (CASE lower(p_type) WHEN 'standard' THEN 'economy' ELSE lower(p_type) END) IN ('economy', 'small', 'medium')
            THEN (CASE lower(p_type) WHEN 'standard' THEN 'economy' ELSE lower(p_type) END) END AS kind,
       CAST(count(*) AS BIGINT) AS n
FROM part GROUP BY 1""")
def text_discard_map_allow(t: Tables) -> DataFrame:
    kind = standardize_category(F.col("p_type"), ["promo"], {"standard": "economy"}, ["economy", "small", "medium"])
    return t.part.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT DISTINCT * FROM (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS "value" FROM orders UNION ALL
  SELECT 'o_orderpriority', trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) FROM orders
) WHERE "value" IS NOT NULL""")
def distinct_values_profile(t: Tables) -> DataFrame:
    raw = profile_distinct(t.orders, ["o_orderstatus"])
    return raw.unionByName(profile_distinct(t.orders, ["o_orderpriority"], clean=True))


@query("""
SELECT raw, CAST(CASE WHEN raw IN (' Sim ', '1.0') THEN 1 ELSE 0 END AS BIGINT) AS flag, CAST(count(*) AS BIGINT) AS n
FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN ' Sim ' WHEN '2-HIGH' THEN '1.0' WHEN '3-MEDIUM' THEN 's'
             WHEN '4-NOT SPECIFIED' THEN '---------' END AS raw FROM orders) GROUP BY raw""")
def binary_flag_map(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    raw = F.when(p == "1-URGENT", " Sim ").when(p == "2-HIGH", "1.0").when(p == "3-MEDIUM", "s").when(p == "4-NOT SPECIFIED", "---------")
    flagged = t.orders.select(raw.alias("raw")).withColumn("flag", map_binary(F.col("raw")).cast("bigint"))
    return flagged.groupBy("raw", "flag").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT CAST(CASE WHEN event_type = 'error' THEN 0 ELSE dayofweek(ts) + 1 END AS BIGINT) AS weekday, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1""")
def weekday_map(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("Domingo", "SEGUNDA", "Terça", "quarta", " Quinta", "sexta", "Sábado")])
    raw = F.when(F.col("event_type") != "error", names[F.dayofweek("ts") - 1]).otherwise("segunda-feira")
    return t.events.groupBy(map_weekday_pt(raw).cast("bigint").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT hour, CAST(sum(CASE WHEN hour BETWEEN 0 AND 5 THEN 1 WHEN hour IS NOT NULL THEN 0 END) AS BIGINT) AS madrugada,
  CAST(sum(CASE WHEN hour BETWEEN 6 AND 11 THEN 1 WHEN hour IS NOT NULL THEN 0 END) AS BIGINT) AS manha,
  CAST(sum(CASE WHEN hour BETWEEN 12 AND 17 THEN 1 WHEN hour IS NOT NULL THEN 0 END) AS BIGINT) AS tarde,
  CAST(sum(CASE WHEN hour BETWEEN 18 AND 23 THEN 1 WHEN hour IS NOT NULL THEN 0 END) AS BIGINT) AS noite,
  CAST(sum(minute) AS BIGINT) AS minutes
FROM (SELECT CASE WHEN event_type <> 'error' THEN CAST(hour(ts) AS BIGINT) END AS hour,
             CASE WHEN event_type <> 'error' THEN minute(ts) END AS minute FROM events) GROUP BY hour""", "period_of_day")
def period_of_day_counts(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "24:00:00").otherwise(F.date_format("ts", "H:mm:ss"))
    timed = split_time(t.events.select(text.alias("time")), "time")
    flags = {k.lower(): c for k, c in period_of_day(F.col("time_HORA")).items()}
    return timed.groupBy(F.col("time_HORA").alias("hour")).agg(
        *[F.sum(c).cast("bigint").alias(k) for k, c in flags.items()], F.sum("time_MINUTO").cast("bigint").alias("minutes")
    )


def _raw_dates(t: Tables) -> DataFrame:
    """Dates as text in both extract layouts; pending orders carry text that is no date."""
    d = F.col("o_orderdate")
    old = F.when(F.col("o_orderstatus") == "P", "----------").otherwise(F.date_format(d, " yyyy-MM-dd HH:mm:ss.SSS"))
    new = F.when(F.col("o_orderstatus") == "P", "31/02/2020").otherwise(F.date_format(d, "d/M/yyyy"))
    return t.orders.select("o_orderkey", old.alias("old"), new.alias("new"))


@query("""
SELECT layout, CAST(year(o_orderdate) AS BIGINT) AS ano, CAST(month(o_orderdate) AS BIGINT) AS mes,
       CAST(count(*) AS BIGINT) AS n, CAST(sum(day(o_orderdate)) AS BIGINT) AS days
FROM orders CROSS JOIN (VALUES ('old'), ('new')) v(layout) WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3""")
def date_parse_split(t: Tables) -> DataFrame:
    names = ("ano", "mes", "dia")
    raw = _raw_dates(t)
    old = split_date(raw.select("old"), "old", TIMESTAMP_FRACTION, names).withColumn("layout", F.lit("old"))
    new = split_date(raw.select("new"), "new", DAY_MONTH_YEAR, names).withColumn("layout", F.lit("new"))
    return old.unionByName(new).groupBy("layout", "ano", "mes").agg(F.count(F.lit(1)).alias("n"), F.sum("dia").alias("days"))


@query("""SELECT CAST(o_orderkey + 2 AS BIGINT) AS line, '31/02/2020' AS "value" FROM orders WHERE o_orderstatus = 'P'""")
def invalid_date_report(t: Tables) -> DataFrame:
    raw = _raw_dates(t).withColumn("row_number", F.col("o_orderkey") + 1)
    return invalid_dates(raw, "new", DAY_MONTH_YEAR, "row_number")


@query("""
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS ptbr_total,
       round(sum(CASE WHEN l_linestatus <> 'O' THEN l_discount END), 4) AS census_total,
       CAST(count(CASE WHEN l_linestatus <> 'O' THEN 1 END) AS BIGINT) AS census_known
FROM lineitem GROUP BY l_returnflag""")
def ptbr_number_parse(t: Tables) -> DataFrame:
    ptbr = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    census = F.when(F.col("l_linestatus") == "O", " X ").otherwise(F.replace(F.col("l_discount").cast("string"), F.lit("."), F.lit(",")))
    parsed = t.lineitem.select("l_returnflag", parse_ptbr_number(ptbr).alias("p"), parse_census_number(census).alias("c"))
    return parsed.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("p"), 2).alias("ptbr_total"), rounded(F.sum("c"), 4).alias("census_total"),
        F.count("c").alias("census_known"),
    )


@query("""
SELECT origin, CAST(count(*) AS BIGINT) AS n, CAST(count(o_orderpriority) AS BIGINT) AS with_priority, CAST(count(o_totalprice) AS BIGINT) AS with_price
FROM (SELECT 'old' AS origin, o_orderpriority, NULL AS o_totalprice FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT 'new', NULL, o_totalprice FROM orders WHERE o_orderstatus <> 'F') GROUP BY origin""")
def union_two_schemas(t: Tables) -> DataFrame:
    old = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority", F.lit("old").alias("origin"))
    new = t.orders.where("o_orderstatus <> 'F'").select("o_orderkey", "o_totalprice", F.lit("new").alias("origin"))
    return union_schemas(old, new).groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_orderpriority").alias("with_priority"), F.count("o_totalprice").alias("with_price")
    )


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders
WHERE year(o_orderdate) = 1998 AND month(o_orderdate) = 11 AND o_orderstatus = 'P'""")
def overlap_codes(t: Tables) -> DataFrame:
    old, new = t.orders.where("o_orderstatus in ('F', 'P')"), t.orders.where("o_orderstatus in ('P', 'O')")
    return common_keys(old, new, "o_orderkey", (F.year("o_orderdate") == 1998) & (F.month("o_orderdate") == 11))


@query("""
(SELECT CAST(doc_id AS BIGINT) AS "key", 'left' AS side FROM documents EXCEPT SELECT CAST(doc_id AS BIGINT), 'left' FROM labels)
UNION ALL
(SELECT CAST(doc_id AS BIGINT), 'right' FROM labels EXCEPT SELECT CAST(doc_id AS BIGINT), 'right' FROM documents)""")
def key_domain_difference(t: Tables) -> DataFrame:
    """Documents without a label, and labels without a document."""
    keys = [df.select(F.col("doc_id").cast("bigint").alias("key")) for df in (t.documents, t.labels)]
    return key_difference(*keys, ["key"])


# Small vocabularies over priority and market segment.
SEGMENT_CATEGORIES = {"FAST": ["1 urgent", "alta"], "HOME": ["household", "furniture"], "WORK": ["machinery"]}
SEGMENT_FIXES = {"2 high": "alta", "automobile": "vaga"}
SEGMENT_DROP = ["vaga"]
SEGMENT_COLUMNS = ["o_orderpriority", "c_mktsegment"]
SEGMENT_SQL = """SELECT o_orderpriority, c_mktsegment,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'FAST' WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'HOME'
       WHEN c_mktsegment = 'MACHINERY' THEN 'WORK' END AS categoria
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'AUTOMOBILE'"""


def _natures(t: Tables) -> DataFrame:
    return incidents(t).select(*SEGMENT_COLUMNS)


@query(f"SELECT categoria, c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM ({SEGMENT_SQL}) GROUP BY categoria, c_mktsegment")
def first_match_category(t: Tables) -> DataFrame:
    tagged = first_category(_natures(t), SEGMENT_COLUMNS, SEGMENT_CATEGORIES, SEGMENT_FIXES, SEGMENT_DROP)
    return tagged.groupBy("categoria", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT DISTINCT trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) AS "value"
FROM (SELECT o_orderpriority AS v FROM ({SEGMENT_SQL}) WHERE categoria IS NULL UNION ALL SELECT c_mktsegment FROM ({SEGMENT_SQL}) WHERE categoria IS NULL)""", "unmapped_values")
def unmapped_natures(t: Tables) -> DataFrame:
    return unmapped_values(_natures(t), SEGMENT_COLUMNS, SEGMENT_CATEGORIES, SEGMENT_FIXES, SEGMENT_DROP)


ALL_SEGMENTS = {**SEGMENT_CATEGORIES, "REST": ["building", "3 medium", "4 not specified", "5 low"]}


@query(f"""
SELECT o_orderpriority, CAST(sum(CASE WHEN categoria = 'FAST' THEN 1 ELSE 0 END) AS BIGINT) AS "FAST",
  CAST(sum(CASE WHEN categoria IS NULL AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR categoria IN ('HOME', 'WORK') THEN 1 ELSE 0 END) AS BIGINT) AS "REST",
  CAST(count(*) AS BIGINT) AS n
FROM ({SEGMENT_SQL}) GROUP BY o_orderpriority""")
def one_hot_exclusive(t: Tables) -> DataFrame:
    flags = classify_first_match(_natures(t), SEGMENT_COLUMNS, ALL_SEGMENTS, SEGMENT_FIXES, SEGMENT_DROP)
    return flags.groupBy("o_orderpriority").agg(
        F.sum("FAST").alias("FAST"), F.sum("REST").alias("REST"), F.sum(F.col("FAST") + F.col("HOME") + F.col("WORK") + F.col("REST")).alias("n")
    )


FLAGS = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}


def _flags(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", *[(F.col("o_orderpriority") == v).cast("int").alias(k) for k, v in FLAGS.items()])


@query("""
SELECT o_orderstatus, CAST(CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 1 ELSE 0 END AS BIGINT) AS "OUTROS", CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 1, 2""")
def others_bucket(t: Tables) -> DataFrame:
    pooled = any_positive(F.col("unspecified"), F.col("low")).cast("bigint")
    return _flags(t).groupBy("o_orderstatus", pooled.alias("OUTROS")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'urgent' END AS label, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 1, 2""")
def argmax_label(t: Tables) -> DataFrame:
    """All flags zero gives the first name."""
    return _flags(t).groupBy("o_orderstatus", argmax_name(["urgent", "high", "medium"]).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT n_name, round(sum(c_acctbal), 2) AS c_acctbal, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS DOUBLE) AS building
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 GROUP BY n_name""")
def sector_to_unit_sum(t: Tables) -> DataFrame:
    dim = t.nation.where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    detail = t.customer.withColumn("building", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    rolled = aggregate_units(detail, ["n_name"], ["c_acctbal", "building"], True, dim, "c_nationkey")
    return rolled.withColumn("c_acctbal", rounded("c_acctbal", 2))


@query("""
SELECT CAST(c_nationkey AS BIGINT) AS unit, c_mktsegment, round(sum(v), 2) AS null_sum, round(coalesce(sum(v), 0), 2) AS zero_sum
FROM (SELECT c_nationkey, c_mktsegment, CASE WHEN c_acctbal > 9000 THEN c_acctbal END AS v FROM customer) GROUP BY 1, 2""")
def sum_min_count(t: Tables) -> DataFrame:
    detail = t.customer.select(F.col("c_nationkey").cast("bigint").alias("unit"), "c_mktsegment", F.expr("CASE WHEN c_acctbal > 9000 THEN c_acctbal END").alias("v"))
    keys = ["unit", "c_mktsegment"]
    nulls = aggregate_units(detail, keys, ["v"], null_zero=False)
    return nulls.select(*keys, rounded("v", 2).alias("null_sum"), rounded(F.coalesce("v", F.lit(0.0)), 2).alias("zero_sum"))


@query("""
SELECT l_returnflag, round(sum(coalesce(d, 0) + coalesce(x, 0) + coalesce(q, 0)), 2) AS row_sums,
       round(avg((coalesce(d, 0) + coalesce(x, 0) + coalesce(q, 0)) / nullif((CASE WHEN d IS NULL THEN 0 ELSE 1 END) + (CASE WHEN x IS NULL THEN 0 ELSE 1 END) + (CASE WHEN q IS NULL THEN 0 ELSE 1 END), 0)), 6) AS row_means
FROM (SELECT l_returnflag, nullif(l_discount, 0) AS d, nullif(l_tax, 0) AS x, CASE WHEN l_quantity > 10 THEN l_quantity END AS q FROM lineitem) GROUP BY l_returnflag""")
def rowwise_sum_mean(t: Tables) -> DataFrame:
    cells = [F.expr("nullif(l_discount, 0)"), F.expr("nullif(l_tax, 0)"), F.expr("CASE WHEN l_quantity > 10 THEN l_quantity END")]
    return t.lineitem.select("l_returnflag", row_sum(*cells).alias("s"), row_mean(*cells).alias("m")).groupBy("l_returnflag").agg(
        rounded(F.sum("s"), 2).alias("row_sums"), rounded(F.avg("m")).alias("row_means")
    )


@query("""
SELECT CAST(c_nationkey AS BIGINT) AS unit, round(100.0 * sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) / count(*), 6) AS pct_building,
  round(CASE WHEN sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) > 0 THEN sum(c_acctbal) / sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) END, 4) AS balance_per_debtor,
  round(avg(c_acctbal) / 510, 6) AS balance_in_wages
FROM customer GROUP BY c_nationkey""")
def indicator_percentages(t: Tables) -> DataFrame:
    units = t.customer.groupBy(F.col("c_nationkey").cast("bigint").alias("unit")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("c_mktsegment") == "BUILDING").cast("int")).alias("building"), F.sum("c_acctbal").alias("balance"),
        F.sum((F.col("c_acctbal") < 0).cast("int")).alias("debtors"), F.avg("c_acctbal").alias("mean_balance"),
    )
    return units.select(
        "unit", rounded(pct(F.col("building"), F.col("n"))).alias("pct_building"),
        rounded(positive_ratio(F.col("balance"), F.col("debtors")), 4).alias("balance_per_debtor"), rounded(F.col("mean_balance") / 510).alias("balance_in_wages"),
    )


@query("""
SELECT CAST(coalesce(c.unit, s.unit, o.unit) AS BIGINT) AS unit, CAST(customers AS BIGINT) AS customers_x, CAST(suppliers AS BIGINT) AS suppliers_x, CAST(urgent AS BIGINT) AS urgent_x
FROM (SELECT c_nationkey AS unit, count(*) AS customers FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) c
FULL JOIN (SELECT s_nationkey AS unit, count(*) AS suppliers FROM supplier WHERE s_acctbal > 2000 GROUP BY 1) s ON s.unit = c.unit
FULL JOIN (SELECT c_nationkey AS unit, count(*) AS urgent FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o.unit = coalesce(c.unit, s.unit)""")
def outer_join_profile(t: Tables) -> DataFrame:
    def counted(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.groupBy(F.col(key).cast("bigint").alias("unit")).agg(F.count(F.lit(1)).alias(name))

    frames = [
        counted(t.customer.where("c_mktsegment = 'BUILDING'"), "c_nationkey", "customers"),
        counted(t.supplier.where("s_acctbal > 2000"), "s_nationkey", "suppliers"),
        counted(incidents(t).where("o_orderpriority = '1-URGENT'"), "unit", "urgent"),
    ]
    return outer_profile(frames, ["unit"], "_x")


@query("""
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM orders), 6) AS share FROM orders GROUP BY o_orderstatus""")
def value_share(t: Tables) -> DataFrame:
    return value_counts(t.orders, "o_orderstatus").withColumn("share", rounded("share"))


@query("""SELECT n_name AS n_name_dim, CAST(n_nationkey AS BIGINT) AS n_nationkey, r_name AS r_name_dim FROM nation JOIN region ON n_regionkey = r_regionkey""")
def suffixed_dimension(t: Tables) -> DataFrame:
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("bigint"), "n_name", "r_name")
    return suffix_columns(joined, "_dim", ["n_nationkey"])


@query("""
SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day,
       CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, round(sum(o_totalprice), 2) AS total FROM orders""")
def global_extremes(t: Tables) -> DataFrame:
    out = t.orders.agg(F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"), F.count_distinct("o_custkey").alias("customers"), rounded(F.sum("o_totalprice"), 2).alias("total"))
    return out.withColumns({"first_day": iso("first_day"), "last_day": iso("last_day")})
