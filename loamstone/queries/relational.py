"""Generic relational surface. What both engines spell alike is one SQL text; Catalyst plans it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamstone.operators import intervals, ordered
from loamstone.sources.tables import broadcast_if_small, load, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _same(name: str, sql: str, *tables: str) -> None:
    """One text for both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables)
        return spark.sql(sql)

    QUERIES[name], SQL[name] = run, sql


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Headline analytics.
_same("pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""", "lineitem")
_same("shipping_priority", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1996-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""", "customer", "orders", "lineitem")
_same("local_supplier_volume", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
GROUP BY n_name""", "customer", "orders", "lineitem", "supplier", "nation", "region")
_same("forecast_revenue", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24""", "lineitem")

# Projection, filters, null handling.
_same("project_filter_case", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band,
       coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, o_orderpriority IS NOT DISTINCT FROM '1-URGENT' AS urgent
FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= DATE '1996-01-01'""", "orders")

# Joins.
_same("join_inner", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0", "customer", "orders")
_same("join_left", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", "customer", "orders")
_same("join_right", "SELECT d.doc_id, q.quality FROM labels q RIGHT JOIN documents d ON d.doc_id = q.doc_id", "documents", "labels")
_same("join_full", "SELECT a.v AS a, b.v AS b FROM (SELECT DISTINCT l_suppkey % 97 AS v FROM lineitem) a FULL JOIN (SELECT DISTINCT s_suppkey % 101 AS v FROM supplier) b ON a.v = b.v", "lineitem", "supplier")
_same("join_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "documents", "labels")
_same("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", "customer", "orders")
_same("join_small_matrix", "SELECT r_name, t.l_returnflag AS flag FROM region CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem) t", "region", "lineitem")


def _hinted(name: str, hint: str) -> None:
    sql = "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders {}JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders, customer, nation = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
        side = broadcast_if_small(customer) if hint == "broadcast" else customer.hint(hint)
        return orders.join(side, orders.o_custkey == customer.c_custkey).join(broadcast_if_small(nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    QUERIES[name], SQL[name] = run, sql.format("")


for _name, _hint in (("join_broadcast", "broadcast"), ("join_smj", "merge"), ("join_shj", "shuffle_hash")):
    _hinted(_name, _hint)


@query("join_range", """
WITH r AS (SELECT event_id AS purchase_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT r.purchase_id, e.event_id FROM r JOIN events e ON e.user_id = r.user_id AND e.ts >= r.ts - INTERVAL 6 HOUR AND e.ts < r.ts""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same user in the six hours before a purchase.

    Time is cut into six-hour bins; a purchase looks into its own and the one
    before, so the join is an equality on (user, bin) and only then a range.
    """
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    width = 6 * 3_600_000_000
    left = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("t").alias("at"), F.explode(F.array(F.floor(F.col("t") / width), F.floor(F.col("t") / width) - 1)).alias("bin"))
    right = e.select("event_id", "user_id", "t", F.floor(F.col("t") / width).alias("bin"))
    return left.join(right, ["user_id", "bin"]).where((F.col("t") >= F.col("at") - width) & (F.col("t") < F.col("at"))).select("purchase_id", "event_id")


_SPANS = """
WITH s AS (SELECT user_id, epoch_us(min(ts)) AS "start", epoch_us(max(ts)) + 1 AS "end" FROM (
  SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (
    SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k),
p AS (SELECT event_id, user_id, epoch_us(ts) AS "start", epoch_us(ts) + CASE WHEN event_id % 50 = 0 THEN 2592000000000 ELSE 60000000 * (event_id % 300) END AS "end" FROM events WHERE event_type = 'purchase')"""


@query("join_overlap", _SPANS + """
SELECT p.event_id, s."start" AS session_start, s."end" AS session_end FROM p JOIN s ON s.user_id = p.user_id AND p."start" < s."end" AND s."start" < p."end" WHERE p."start" < p."end\"""")
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that overlap the time after a purchase in which it counts: minutes to hours, for one in fifty thirty days."""
    e = load(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    # A session ends with its last event here, not when its gap has passed.
    sessions = e.groupBy("user_id", span.alias("w")).agg(F.min(t).alias("start"), (F.max(t) + 1).alias("end")).select("user_id", "start", "end")
    counts = e.where("event_type = 'purchase'").select("event_id", "user_id", t.alias("start"), (t + F.expr("CASE WHEN event_id % 50 = 0 THEN 2592000000000 ELSE 60000000 * (event_id % 300) END")).alias("end"))
    return intervals.overlaps(counts, sessions, ["user_id"]).select(F.col("l.event_id").alias("event_id"), F.col("r.start").alias("session_start"), F.col("r.end").alias("session_end"))


@query("join_asof", """
WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT p.event_id AS purchase_id, v.event_id AS view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest view at or before each purchase, per user.

    Time is cut into days. A running window finds the latest view within the day; for
    purchases before the day's first one, the last view of an earlier day comes from a
    window over one row a user and day. So no task needs all events of a user.
    """
    view, day = F.col("event_type") == "view", F.date_trunc("day", "ts").alias("day")
    e = load(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase")).select("event_id", "user_id", "event_type", "ts", day)
    w = Window.partitionBy("user_id", "day").orderBy("ts", F.when(view, 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = e.withColumn("own", F.last(F.when(view, F.col("event_id")), ignorenulls=True).over(w)).where(~view)
    days = e.groupBy("user_id", "day").agg(F.max(F.when(view, F.struct("ts", "event_id")))["event_id"].alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    held = days.select("user_id", "day", before.alias("before"))
    return seen.join(held, ["user_id", "day"]).select(F.col("event_id").alias("purchase_id"), F.coalesce("own", "before").alias("view_id"))


_same("join_nlj", """
SELECT band, count(*) AS n, round(min(p_retailprice), 2) AS low FROM part
JOIN (VALUES (0.0, 1000.0, 'low'), (900.0, 1400.0, 'middle'), (1300.0, 1.0e9, 'high')) AS b(lo, hi, band) ON p_retailprice >= lo AND p_retailprice < hi GROUP BY band""", "part")


# Aggregates.
_same("agg_group", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY o_orderstatus, o_orderpriority HAVING count(*) > 10", "orders")
@query("agg_distinct", "SELECT lang, count(DISTINCT source) AS n_sources, count(DISTINCT text) AS n_texts, count(*) AS n FROM documents GROUP BY lang")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are told apart by SHA-256, so 32 bytes of each are shuffled."""
    d = load(spark, sf_dir, "documents").select("lang", "source", F.unhex(F.sha2("text", 256)).alias("h"))
    return d.groupBy("lang").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("h").alias("n_texts"), F.count("*").alias("n"))


_same("agg_rollup", "SELECT lang, source, count(*) AS n, CAST(grouping(lang) + 2 * grouping(source) AS BIGINT) AS g FROM documents GROUP BY ROLLUP (lang, source)", "documents")
_same("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
_same("agg_grouping_sets", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())", "events")
_same("agg_filtered", "SELECT lang, count(*) FILTER (WHERE n_chars > 1000) AS n_long, sum(CASE WHEN n_chars <= 1000 THEN 1 ELSE 0 END) + 0.0 AS n_short FROM documents GROUP BY lang", "documents")
SQL["agg_filtered"] = "SELECT lang, count(*) FILTER (WHERE n_chars > 1000) AS n_long, CAST(count(*) FILTER (WHERE n_chars <= 1000) AS DOUBLE) AS n_short FROM documents GROUP BY lang"


@query("agg_stats", """
SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90, round(stddev_samp(value), 6) AS sd, round(corr(value, CAST(user_id AS DOUBLE)), 6) AS r,
       max_by(event_id, value * 1000000 + event_id) AS top_event, round(regr_slope(value, CAST(user_id AS DOUBLE)), 9) AS slope FROM events GROUP BY event_type""")
def agg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles come from counts between sketched cut-offs; the other figures are sums."""
    e = load(spark, sf_dir, "events")
    u = F.col("user_id").cast("double")
    sums = e.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.corr("value", u), 6).alias("r"), F.max_by("event_id", F.col("value") * 1000000 + F.col("event_id")).alias("top_event"), F.round(F.regr_slope("value", u), 9).alias("slope"))
    exact = ordered.percentiles(e, ["event_type"], "value", [0.5, 0.9]).select(F.col("event_type").alias("t"), F.round("p0", 6).alias("med"), F.round("p1", 6).alias("p90"))
    return sums.join(exact, F.col("event_type").eqNullSafe(F.col("t")), "left").drop("t")


@query("agg_mode", "SELECT o_orderstatus, mode() WITHIN GROUP (ORDER BY o_custkey) AS top_customer, count(*) AS n FROM orders GROUP BY o_orderstatus")
def agg_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    top = ordered.mode(o, ["o_orderstatus"], "o_custkey").select(F.col("o_orderstatus").alias("s"), F.col("mode").alias("top_customer"))
    n = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return n.join(top, F.col("o_orderstatus").eqNullSafe(F.col("s")), "left").select("o_orderstatus", "top_customer", "n")


@query("agg_approx")
def agg_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches: mergeable, so they are summed map-side; tests hold them against exact figures."""
    e = load(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", 0.5, 1000).alias("med"), F.hll_sketch_estimate(F.hll_sketch_agg("event_id", 14)).alias("events"), F.theta_sketch_estimate(F.theta_sketch_agg("event_id", 14)).alias("theta"), F.count("*").alias("n"))


# Windows.
@query("win_rank", """
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice, o_orderkey)""")
def win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks from ranges of rows and what lies before them, so no task has a whole group."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    ranked = ordered.ranks(o, ["o_orderpriority", "o_orderstatus"], ["o_totalprice", "o_orderkey"], tiles=4)
    return ranked.select("o_orderkey", *(F.col(c).cast("int").alias(n) for c, n in (("rn", "rn"), ("rk", "rk"), ("dr", "dr"), ("tile", "quarter"))), F.round("pr", 9).alias("pr"), F.round("cd", 9).alias("cd"))


_same("win_analytic", """
SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER w AS second_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""", "events")
_same("win_frame", """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS last_four,
       count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day_count FROM events""", "events")

# Sorts and limits.
_same("sort_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "orders")
_same("sort_limit_offset", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 25", "part")
_same("topk_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3", "customer")

# Sets.
_same("set_union_all", "SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer", "orders", "customer")
_same("set_union", "SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier", "lineitem", "supplier")
_same("set_intersect", "SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'", "events")
_same("set_intersect_all", "SELECT lang, source FROM documents WHERE n_chars > 1000 INTERSECT ALL SELECT lang, source FROM documents WHERE n_chars <= 3000", "documents")
_same("set_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000", "customer", "orders")
_same("set_except_all", "SELECT lang FROM documents WHERE n_chars > 100 EXCEPT ALL SELECT lang FROM documents WHERE n_chars > 5000", "documents")


@query("pivot", "SELECT lang, " + ", ".join(f"count(*) FILTER (WHERE source = 'src{k}') AS src{k}" for k in range(20)) + " FROM documents GROUP BY lang")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column a source: the 20 known ones, and what others the table holds (`null` for none), 1,000 at most."""
    docs = load(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("null")))
    known = [f"src{k}" for k in range(20)]
    more = [r.source for r in docs.where(~F.col("source").isin(known)).select("source").distinct().limit(1_001).collect()]
    if len(more) > 1_000:
        raise ValueError("more than 1,000 sources besides the known ones: too many columns to pivot to")
    names = known + sorted(more)
    counts = docs.groupBy("lang").pivot("source", names).agg(F.count(F.lit(1)))
    return counts.select("lang", *(F.coalesce(F.col(f"`{n.replace('`', '``')}`"), F.lit(0)).alias(n) for n in names))


@query("unpivot", "SELECT doc_id, 'quality' AS kind, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "kind", "v")


# Sampling is the feature here: md5 makes it the same everywhere.
_same("sample_hash", "SELECT o_orderkey FROM orders WHERE substring(md5(CAST(o_orderkey AS VARCHAR(20))), 1, 1) < '4'", "orders")


@query("sample_quota", """
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
WHERE rn <= ceil(n / 10.0)""")
def sample_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each source, exactly (rounded up): the rows of its least hashes, ranked without a task a source."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("doc_id").cast("string")).alias("h"))
    ranked = ordered.ranks(d, ["source"], ["h", "doc_id"])
    n = d.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count("*") / 10).alias("quota"))
    return ranked.join(broadcast_if_small(n), F.col("source").eqNullSafe(F.col("s"))).where(F.col("rn") <= F.col("quota")).select("doc_id", "source")


@query("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", k.alias("k"), k.try_cast("bigint").alias("n"))


_PROPS = "CASE WHEN event_id % 7 = 3 THEN '{\"k\": ' WHEN event_id % 11 = 5 THEN NULL WHEN event_id % 13 = 1 THEN '{\"k\": \"' || event_id || '\", \"more\": {\"list\": [1, ' || event_id || ', null]}}' ELSE props END"


@query("json_variant", f"""
WITH p AS (SELECT event_id, {_PROPS} AS props FROM events), j AS (SELECT event_id, props IS NOT NULL AND NOT json_valid(props) AS malformed, CASE WHEN json_valid(props) THEN props END AS j FROM p)
SELECT event_id, malformed, json_extract_string(j, '$.k') AS k, TRY_CAST(json_extract_string(j, '$.k') AS BIGINT) AS n, TRY_CAST(json_extract_string(j, '$.more.list[1]') AS BIGINT) AS second,
       coalesce(json_type(j, '$.more.list[2]') = 'NULL', false) AS third_is_null FROM j""")
def json_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of several types and depths from variants; malformed and missing texts give nulls, and malformed ones are told apart."""
    p = load(spark, sf_dir, "events").selectExpr("event_id", f"{_PROPS} AS props").withColumn("v", F.try_parse_json("props"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return p.select("event_id", (F.col("props").isNotNull() & F.col("v").isNull()).alias("malformed"), get("$.k", "string").alias("k"), get("$.k", "bigint").alias("n"), get("$.more.list[1]", "bigint").alias("second"), F.is_variant_null(get("$.more.list[2]", "variant")).alias("third_is_null"))


@query("json_schema", f"""
WITH p AS (SELECT {_PROPS} AS props FROM events), j AS (SELECT props AS j FROM p WHERE json_valid(props))
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE json_exists(j, '$.more')) AS BIGINT) AS with_more, 'OBJECT<k: VARIANT, more: OBJECT<list: ARRAY<BIGINT>>>' AS shape FROM j""")
def json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common shape of all variants that parse: a field that is a number here and a text there is a variant."""
    p = load(spark, sf_dir, "events").selectExpr(f"try_parse_json({_PROPS}) AS v").where("v is not null")
    return p.agg(F.count(F.lit(1)).alias("n"), F.count(F.try_variant_get("v", "$.more", "variant")).alias("with_more"), F.schema_of_variant_agg("v").alias("shape"))


@query("scalar_string", """
SELECT c_custkey, split_part(c_name, '#', 2) AS num, translate(c_name, 'aeiou', 'AEIOU') AS t, levenshtein(c_mktsegment, 'BUILDING') AS d, regexp_replace(c_name, '[0-9]+', '#') AS r,
       upper(c_mktsegment) AS u, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS p, reverse(c_name) AS v, strpos(c_name, '#') AS i FROM customer""")
def scalar_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(2)).alias("num"), F.translate("c_name", "aeiou", "AEIOU").alias("t"), F.levenshtein("c_mktsegment", F.lit("BUILDING")).cast("long").alias("d"), F.regexp_replace("c_name", "[0-9]+", "#").alias("r"), F.upper("c_mktsegment").alias("u"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("p"), F.reverse("c_name").alias("v"), F.instr("c_name", "#").cast("long").alias("i"))


SQL["scalar_string"] = SQL["scalar_string"].replace("regexp_replace(c_name, '[0-9]+', '#')", "regexp_replace(c_name, '[0-9]+', '#', 'g')")


@query("scalar_date", """
SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
       CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INTEGER) AS days, last_day(o_orderdate) AS eom, strftime(o_orderdate, '%Y/%m/%d') AS f FROM orders""")
def scalar_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    return o.select("o_orderkey", F.date_trunc("month", d).cast("timestamp_ntz").alias("m"), F.year(d).alias("y"), F.quarter(d).alias("q"), F.dayofyear(d).alias("doy"), F.date_diff(d, F.lit("1995-01-01").cast("date")).alias("days"), F.last_day(d).alias("eom"), F.date_format(d, "yyyy/MM/dd").alias("f"))


SQL["scalar_date"] = SQL["scalar_date"].replace("date_trunc('month', o_orderdate) AS m", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m")


@query("scalar_array_map", """
SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_pos, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS sq,
       CAST(list_max(embedding) AS DOUBLE) AS hi, embedding[1:3] AS head, CAST(list_position(embedding, list_min(embedding)) AS BIGINT) AS low_at FROM embeddings""")
def scalar_array_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).alias("n_pos"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 6).alias("sq"), F.array_max("embedding").cast("double").alias("hi"), F.slice("embedding", 1, 3).alias("head"), F.array_position("embedding", F.array_min("embedding")).alias("low_at"))


_same("recursive_cte", """
WITH RECURSIVE t(level, k) AS (SELECT 0, n_nationkey FROM nation WHERE n_nationkey < 3 UNION ALL SELECT level + 1, k * 2 + 1 FROM t WHERE level < 4)
SELECT level, k, n_name FROM t LEFT JOIN nation ON n_nationkey = k""", "nation")
_same("subquery_scalar", "SELECT s_suppkey, s_acctbal FROM supplier s WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier x WHERE x.s_nationkey = s.s_nationkey)", "supplier")
_same("lateral_topk", """
SELECT n.n_nationkey, t.s_suppkey FROM nation n, LATERAL (SELECT s_suppkey FROM supplier s WHERE s.s_nationkey = n.n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) t""", "nation", "supplier")
