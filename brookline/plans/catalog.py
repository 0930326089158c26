"""The registered queries: a pipeline over the tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline.plans import roundtrips
from brookline.plans.frame import Events, events
from brookline.plans.language import run

#: The order of arrival of each table.
ORDER = {"events": "event_id", "lineitem": None, "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "pages": "page_id", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey"}


def source(spark: SparkSession, sf_dir: str, name: str) -> Events:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "lineitem":
        return events(df.withColumn("_seq", F.struct("l_orderkey", "l_linenumber")), "_seq")
    return events(df, ORDER.get(name))


def shuffled(spark: SparkSession, sf_dir: str) -> Events:
    """The events in another order of arrival, so that some are late."""
    df = source(spark, sf_dir, "events").df
    return events(df.withColumn("_seq", F.struct((F.col("event_id") * 7919 % 10007).alias("p"), F.col("event_id"))), "_seq")


_found: dict[str, tuple[Callable, str | None]] = {}


def pipeline(name: str, text: str, sql: str | None, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    words = {w for w in ORDER if w in text.replace("|", " ").replace(";", " ").split()}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {w: source(spark, sf_dir, w) for w in words}
        if "shuffled" in text.split():
            tables["shuffled"] = shuffled(spark, sf_dir)
        if "spread" in text.split():
            tables["spread"] = spread(spark, sf_dir)
        if "baskets" in text.split():
            tables["baskets"] = baskets(spark, sf_dir)
        out = run(spark, text, tables=tables)
        return finish(out) if finish else out

    _found[name] = (query, sql)


def spread(spark: SparkSession, sf_dir: str) -> Events:
    df = source(spark, sf_dir, "nation").df
    return events(df.select("n_nationkey", F.struct("n_name", F.col("n_regionkey").alias("region")).alias("place"), F.array("n_nationkey", "n_regionkey").alias("codes")), "n_nationkey")


def baskets(spark: SparkSession, sf_dir: str) -> Events:
    """An order and its lines as an array of objects (an order has few lines)."""
    li = source(spark, sf_dir, "lineitem").df
    item = F.struct("l_linenumber", "l_quantity", F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("value"))
    return events(li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items")), "l_orderkey")


def _over_zero(difference: Column) -> Column:
    """What SQL gives for a percentage of zero, where `diff` has none: infinity with the sign of the difference, NaN for no difference."""
    return difference * F.lit(float("inf"))


def _define() -> None:
    e = "event_id, user_id, event_type, value"
    cut = "select '{event_id: event_id, user_id: user_id, event_type: event_type, value: value}'"
    pipeline("match", f"events | match \"event_type == 'purchase' && value > `50`\" | {cut}", f"SELECT {e} FROM events WHERE event_type = 'purchase' AND value > 50")
    pipeline("jmespath", "events | jmespath '[user_id, value][?@ > `100`]' -l big | select '{event_id: event_id, n: length(big)}'", "SELECT event_id, CAST((user_id > 100)::INT + (value > 100)::INT AS BIGINT) AS n FROM events")
    pipeline("has_field", f"events | has_field value | {cut}", f"SELECT {e} FROM events WHERE value IS NOT NULL")
    pipeline("contains", f"events | contains event_type -m urch rro | {cut}", f"SELECT {e} FROM events WHERE contains(event_type, 'urch') OR contains(event_type, 'rro')")
    pipeline("starts_with", f"events | starts_with event_type -m pu si | {cut}", f"SELECT {e} FROM events WHERE starts_with(event_type, 'pu') OR starts_with(event_type, 'si')")
    pipeline("ends_with", f"events | ends_with event_type -m up ew | {cut}", f"SELECT {e} FROM events WHERE suffix(event_type, 'up') OR suffix(event_type, 'ew')")
    pipeline("nummatch", "lineitem | nummatch l_linenumber -v 1 3 -e | select '{k: l_orderkey, n: l_linenumber}'", "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber IN (1, 3)")
    pipeline("numfilter", "lineitem | numfilter l_discount between 0.03 0.05 | numfilter l_quantity outside 10 40 | select '{k: l_orderkey, n: l_linenumber, d: l_discount}'", "SELECT l_orderkey AS k, l_linenumber AS n, l_discount AS d FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.05 AND NOT l_quantity BETWEEN 10 AND 40")
    pipeline("regexmatcher", f"events | regexmatcher event_type -p '^c' 'p$' | {cut}", f"SELECT {e} FROM events WHERE regexp_matches(event_type, '^c|p$')")
    pipeline("uniq", f"events | uniq user_id | {cut}", f"SELECT {e} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
    pipeline("firstn", f"events | firstn user_id -n 3 | {cut}", f"SELECT {e} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3")
    pipeline("aftern", f"events | aftern user_id -n 3 | {cut}", f"SELECT {e} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 3")
    pipeline("head", f"events | head -n 25 | {cut}", f"SELECT {e} FROM events ORDER BY event_id LIMIT 25")
    pipeline("sample", f"events | sample -n 4 -k event_type | {cut}", f"SELECT {e} FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 4")
    pipeline("enumerate", "shuffled | enumerate -l at | select '{event_id: event_id, at: at}'", "SELECT event_id, row_number() OVER (ORDER BY event_id * 7919 % 10007, event_id) - 1 AS at FROM events")
    pipeline("count", "events | match \"event_type == 'click'\" | count -l n | select '{event_id: event_id, n: n}'", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type = 'click'")
    pipeline("select", "nation | select '{name: n_name, region: n_regionkey}'", "SELECT n_name AS name, n_regionkey AS region FROM nation")
    pipeline("select_unwind", "spread | select codes -u", "SELECT n_nationkey AS value FROM nation UNION ALL SELECT n_regionkey FROM nation")
    pipeline("annotate", "region | annotate seen -l note | remove r_regionkey", "SELECT r_name, 'seen' AS note FROM region")
    pipeline("remove", "nation | remove n_regionkey", "SELECT n_nationkey, n_name FROM nation")
    pipeline("denest", "spread | denest place.n_name n_nationkey", "SELECT n_name, n_nationkey FROM nation")
    pipeline("nest", "nation | nest -i all | select '{name: all.n_name, key: all.n_nationkey}'", "SELECT n_name AS name, n_nationkey AS key FROM nation")
    pipeline("substring", "part | substring p_name -d 4 -f -l tail | substring p_type -d 3 -o 2 -l mid | select '{k: p_partkey, tail: tail, mid: mid}'", "SELECT p_partkey AS k, CASE WHEN length(p_name) > 0 THEN right(p_name, 4) END AS tail, nullif(substr(p_type, 3, 3), '') AS mid FROM part")
    pipeline("transform", "part | transform p_name -u -f AEIOU -t 12 --label t | select '{k: p_partkey, t: t}'", "SELECT p_partkey AS k, translate(upper(p_name), 'AEIOU', '12222') AS t FROM part")
    pipeline("upper_lower", "part | upper p_name --label u | lower p_type --label l | select '{k: p_partkey, u: u, l: l}'", "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_type) AS l FROM part")
    pipeline("split_join", "part | split p_name -d ' ' -l w | arrayjoiner w -s / -l j | select '{k: p_partkey, n: length(w), j: j}'", "SELECT p_partkey AS k, len(string_split(p_name, ' ')) AS n, array_to_string(string_split(p_name, ' '), '/') AS j FROM part")
    pipeline("regexextractor", "pages | regexextractor url -p '//([^/]+)/' -c 1 -t host | select '{k: page_id, host: host}'", "SELECT page_id AS k, nullif(regexp_extract(url, '//([^/]+)/', 1), '') AS host FROM pages")
    pipeline("defang", "pages | defang url -l d | select '{k: page_id, d: d}'", r"SELECT page_id AS k, replace(regexp_extract(url, '^(https?)://', 1), 'http', 'hxxp') || '://' || replace(regexp_extract(url, '//([^/]+)', 1), '.', '[.]') || regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS d FROM pages")
    pipeline("jsondecode", "events | jsondecode props | select '{event_id: event_id, k: k}'", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
    pipeline("jsondecode_variant", "events | jsondecode props -l doc --variant | match 'doc.k > `5`' | sum doc.k -k event_type -s total", "SELECT event_type AS key, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS total FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 5 GROUP BY 1")
    pipeline("classify", "events | classify level -f value --rules 'value >= 200 -> high' 'value >= 50 -> mid' --default low | select '{event_id: event_id, level: level}'", "SELECT event_id, CASE WHEN value >= 200 THEN 'high' WHEN value >= 50 THEN 'mid' ELSE 'low' END AS level FROM events")
    pipeline("sum", "events | sum value -k user_id -s total", "SELECT CAST(user_id AS VARCHAR) AS key, round(sum(value), 4) AS total FROM events GROUP BY user_id", lambda d: d.withColumn("total", F.round("total", 4)))
    pipeline("keycounttotal", "lineitem | keycounttotal l_suppkey", "SELECT CAST(l_suppkey AS VARCHAR) AS key, count(*) AS keycount FROM lineitem GROUP BY l_suppkey")
    pipeline("percentile", "events | percentile value -k event_type | select '{key: key, p50: percentiles.p50, p90: percentiles.p90, p99: percentiles.p99, lo: percentiles.min, hi: percentiles.p100}'", "SELECT event_type AS key, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1", lambda d: d.withColumns({c: F.round(c, 6) for c in ("p50", "p90", "p99")}))
    pipeline("histogram", "events | histogram value -k event_type -b 0:100:25", "SELECT event_type AS key, CASE WHEN value < 0 THEN '<0' WHEN value < 25 THEN '[0-25)' WHEN value < 50 THEN '[25-50)' WHEN value < 75 THEN '[50-75)' WHEN value <= 100 THEN '[75-100]' ELSE '>100' END AS bucket, count(*) AS n FROM events GROUP BY ALL", lambda d: d.select("key", F.explode("histogram.buckets").alias("bucket", "n")).filter("n > 0"))
    pipeline("pivot", "events | pivot -k user_id -c event_type -v value -a count --fill 0", "SELECT CAST(user_id AS VARCHAR) AS user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
    pipeline("groupevents", "events | groupevents user_id -m 7 | select '{n: group_length, first: group[0].event_id, last: group[-1].event_id}'", "SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS c FROM events) GROUP BY user_id, c")
    pipeline("burstgroup", "events | burstgroup user_id -t ts -g 7200 -m 100 -o 1 | select '{n: group_length, first: group[0].event_id}'", "WITH t AS (SELECT *, (epoch_us(ts) // 1000) // 1000 AS s FROM events), g AS (SELECT *, CASE WHEN s - max(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 7200 THEN 1 ELSE 0 END AS n FROM t), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM g) SELECT count(*) AS n, min(event_id) AS first FROM b GROUP BY user_id, b")
    pipeline("lastn", "events | lastn user_id -m 3 | select '{n: group_length, newest: group[0].event_id, oldest: group[-1].event_id}'", "SELECT count(*) AS n, max(event_id) AS newest, min(event_id) AS oldest FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3) GROUP BY user_id")
    pipeline("keycorrelate", "lineitem | keycorrelate l_returnflag -k l_suppkey -n 5 | select '{a: pair[0], b: pair[1], n: co_occurrence_count, support: support}'", "WITH d AS (SELECT DISTINCT l_suppkey AS k, l_returnflag AS v FROM lineitem) SELECT a.v AS a, b.v AS b, count(*) AS n, round(count(*) / (SELECT count(DISTINCT k) FROM d), 6) AS support FROM d a JOIN d b ON a.k = b.k AND a.v < b.v GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, a, b LIMIT 5", lambda d: d.withColumn("support", F.round("support", 6)))
    pipeline("anomaly", "events | anomaly value -k event_type --threshold 2.5 | select '{event_id: event_id, odd: is_anomaly, score: anomaly_score}'", "SELECT event_id, abs(value - avg(value) OVER w) / stddev_pop(value) OVER w > 2.5 AS odd, round(abs(value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS score FROM events WINDOW w AS (PARTITION BY event_type)", lambda d: d.withColumn("score", F.round("score", 6)))
    pipeline("anomaly_iqr", "events | anomaly value --method iqr | select '{event_id: event_id, odd: is_anomaly}'", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS odd FROM events, q")
    pipeline("rank", "events | rank value -k event_type -p | select '{event_id: event_id, rank: rank, p: percentile}'", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS rank, round((count(*) OVER (PARTITION BY event_type) - rank() OVER (PARTITION BY event_type ORDER BY value DESC)) / (count(*) OVER (PARTITION BY event_type) - 1) * 100, 2) AS p FROM events")
    pipeline("rank_global", "events | rank value -g -d --asc | select '{event_id: event_id, rank: rank}'", "SELECT event_id, dense_rank() OVER (ORDER BY value) AS rank FROM events")
    pipeline("sort", "customer | sort c_acctbal | enumerate -l at | select '{k: c_custkey, at: at}'", "SELECT c_custkey AS k, row_number() OVER (ORDER BY CAST(c_acctbal AS VARCHAR), c_custkey) - 1 AS at FROM customer")
    pipeline("numsort", "part | numsort p_retailprice -r | enumerate -l at | select '{k: p_partkey, at: at}'", "SELECT p_partkey AS k, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS at FROM part")
    pipeline("top", "lineitem | top l_extendedprice -n 20 | select '{k: l_orderkey, n: l_linenumber, p: l_extendedprice}'", "SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS p FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
    pipeline("keycount", "events | keycount user_id -o n | select '{event_id: event_id, n: n}'", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
    pipeline("timedelta", "events | timedelta user_id -t ts -d ms | select '{event_id: event_id, ms: ms}'", "SELECT * FROM (SELECT event_id, abs((epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY event_id)) AS ms FROM events) WHERE ms IS NOT NULL")
    pipeline("state_delta", "events | state_delta user_id -s event_type -t ts -d ms | select '{event_id: event_id, was: previous_state, is: current_state, ms: ms}'", "SELECT * FROM (SELECT event_id, lag(event_type) OVER w AS was, event_type AS \"is\", abs((epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w) AS ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE was <> \"is\"")
    pipeline("threshold", "events | threshold user_id -t 20 -l n | select '{event_id: event_id, n: n}'", "SELECT event_id, CAST(n AS DOUBLE) AS n FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n >= 20")
    pipeline("threshold_reset", "events | threshold user_id -t 20 -r -l n | select '{event_id: event_id, n: n}'", "SELECT event_id, CAST(20 AS DOUBLE) AS n FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n % 20 = 0")
    pipeline("diff", "events | diff -k user_id -f value --previous | select '{event_id: event_id, d: value_diff, p: value_pct_change}'", "SELECT event_id, round(value - lag(value) OVER w, 6) AS d, round((value - lag(value) OVER w) / lag(value) OVER w * 100, 4) AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", lambda d: d.withColumns({"d": F.round("d", 6), "p": F.round(F.coalesce("p", _over_zero(F.col("d"))), 4)}))
    text = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S+00:00')"
    w = f"{text.format('w')} AS window_start, {text.format('(w + {0})')} AS window_end"
    pipeline("window_tumbling", "events | window ts -w 6h -k event_type -a sum -f value", f"SELECT {w.format(21600000)}, CAST(21600 AS BIGINT) AS duration, event_type AS key, count(*) AS count, round(sum(value), 4) AS sum FROM (SELECT *, (epoch_us(ts) // 1000) // 21600000 * 21600000 AS w FROM events) GROUP BY w, event_type", lambda d: d.withColumn("sum", F.round("sum", 4)))
    pipeline("window_sliding", "events | window ts -w 1d -s 12h", f"SELECT {w.format(86400000)}, CAST(86400 AS BIGINT) AS duration, count(*) AS count FROM (SELECT unnest([(epoch_us(ts) // 1000) // 43200000 * 43200000, (epoch_us(ts) // 1000) // 43200000 * 43200000 - 43200000]) AS w FROM events) GROUP BY w")
    late = "SELECT * FROM (SELECT *, (epoch_us(ts) // 1000) AS t, coalesce(max((epoch_us(ts) // 1000)) OVER (ORDER BY event_id * 7919 % 10007, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM events) WHERE t >= m - 86400000"
    pipeline("window_late", "shuffled | window ts -w 6h --allowed-lateness 1d", f"SELECT {w.format(21600000)}, CAST(21600 AS BIGINT) AS duration, count(*) AS count FROM (SELECT *, t // 21600000 * 21600000 AS w FROM ({late})) GROUP BY w")
    pipeline("window_session", "events | window ts --session-gap 4h -k user_id | select '{key: key, n: count, s: duration}'", "WITH t AS (SELECT *, (epoch_us(ts) // 1000) AS t FROM events), g AS (SELECT *, CASE WHEN t - max(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 14400000 THEN 1 ELSE 0 END AS n FROM t), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM g) SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, (max(t) - arg_min(t, event_id)) // 1000 AS s FROM b GROUP BY user_id, b")
    pipeline("flatten", "baskets | flatten items -k '{order: l_orderkey}' | select '{order: order, n: l_linenumber, q: l_quantity}'", "SELECT l_orderkey AS \"order\", l_linenumber AS n, l_quantity AS q FROM lineitem")
    pipeline("split_array", "baskets | split_array items -k '{label: `x`, order: l_orderkey}' | select '{order: order, n: l_linenumber, label: label}'", "SELECT l_orderkey AS \"order\", l_linenumber AS n, 'x' AS label FROM lineitem")
    pipeline("kvmap", "baskets | kvmap items -o last | select '{k: l_orderkey, a: last.A, n: last.N, r: last.R}'", "SELECT l_orderkey AS k, max(l_linenumber) FILTER (l_returnflag = 'A') AS a, max(l_linenumber) FILTER (l_returnflag = 'N') AS n, max(l_linenumber) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey")
    pipeline("filterarray", "baskets | filterarray items numfilter l_quantity '>' 25 | select '{k: l_orderkey, n: length(items)}'", "SELECT l_orderkey AS k, count(*) FILTER (l_quantity > 25) AS n FROM lineitem GROUP BY l_orderkey")
    pipeline("apply", "spread | apply place lower n_name --label low | select '{k: n_nationkey, low: place.low}'", "SELECT n_nationkey AS k, lower(n_name) AS low FROM nation")
    lines = "baskets | flatten items -k '{order: l_orderkey}' | nummatch l_linenumber -v "
    pipeline("union_order", f"{lines}1 -e | $out ; {lines}2 -e | $out ; $out | enumerate -l at | select '{{order: order, n: l_linenumber, at: at}}'", "SELECT l_orderkey AS \"order\", l_linenumber AS n, row_number() OVER (ORDER BY l_linenumber, l_orderkey) - 1 AS at FROM lineitem WHERE l_linenumber <= 2")
    pipeline("union_head", "shuffled | match \"event_type == 'click'\" | $out ; events | match \"event_type == 'view'\" | $out ; $out | head -n 15 | select '{event_id: event_id}'", "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id * 7919 % 10007, event_id LIMIT 15")
    pipeline("percentile_all", "events | percentile value | select '{key: key, p50: percentiles.p50, p99: percentiles.p99, hi: percentiles.p100}'", "SELECT 'total' AS key, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS hi FROM events", lambda d: d.withColumns({c: F.round(c, 6) for c in ("p50", "p99")}))
    pipeline("histogram_quantile", "events | histogram value -k event_type -b quantile:4", "WITH r AS (SELECT event_type AS k, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL), b AS (SELECT DISTINCT k, v FROM r, range(5) t(i) WHERE rn = least(i * n // 4, n - 1)), m AS (SELECT k, max(v) AS top, count(*) AS c FROM b GROUP BY k), p AS (SELECT r.k, r.v, count(b.v) AS upto FROM r JOIN b ON b.k = r.k AND b.v <= r.v GROUP BY r.k, r.v, r.rn), h AS (SELECT k, CASE WHEN v = top THEN c - 1 ELSE upto END AS place FROM p JOIN m USING (k)), q AS (SELECT event_type AS k, median(value) AS median FROM events GROUP BY 1) SELECT k AS key, count(*) AS n, round(median, 6) AS median FROM h JOIN q USING (k) GROUP BY k, place, median", lambda d: d.select("key", F.explode("histogram.buckets").alias("bucket", "n"), F.round("histogram.median", 6).alias("median")).drop("bucket"))
    pipeline("histogram_cumulative", "events | histogram value -b log:1:1000:10 --cumulative", "SELECT u.bucket, count(*) FILTER (CASE u.bucket WHEN '<1' THEN value < 1 WHEN '[1-10)' THEN value < 10 WHEN '[10-100)' THEN value < 100 WHEN '[100-1000]' THEN value <= 1000 ELSE true END) AS n FROM events, unnest(['<1', '[1-10)', '[10-100)', '[100-1000]', '>1000']) u(bucket) WHERE value IS NOT NULL GROUP BY u.bucket", lambda d: d.select(F.explode("histogram.buckets").alias("bucket", "n")))
    pipeline("histogram_normalized", "events | histogram value -k event_type -b 0:100:50 --normalize", "SELECT key, bucket, round(c / sum(c) OVER (PARTITION BY key), 6) AS n FROM (SELECT event_type AS key, CASE WHEN value < 0 THEN '<0' WHEN value < 50 THEN '[0-50)' WHEN value <= 100 THEN '[50-100]' ELSE '>100' END AS bucket, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL)", lambda d: d.select("key", F.explode("histogram.buckets").alias("bucket", "n")).filter("n > 0").withColumn("n", F.round("n", 6)))
    pipeline("rank_dense", "lineitem | rank l_quantity -k l_returnflag -d | select '{k: l_orderkey, n: l_linenumber, rank: rank}'", "SELECT l_orderkey AS k, l_linenumber AS n, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rank FROM lineitem")
    pipeline("keycorrelate_keys", "lineitem | keycorrelate l_linenumber -k l_suppkey -n 3 | select '{a: pair[0], b: pair[1], n: co_occurrence_count, m: length(keys)}'", "WITH d AS (SELECT DISTINCT l_suppkey AS k, CAST(l_linenumber AS VARCHAR) AS v FROM lineitem) SELECT a.v AS a, b.v AS b, count(*) AS n, count(*) AS m FROM d a JOIN d b ON a.k = b.k AND a.v < b.v GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, a, b LIMIT 3")
    pipeline("keycounttotal_first", "events | keycounttotal user_id -r first | select '{key: key, n: keycount, first: first.event_id}'", "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, min(event_id) AS first FROM events GROUP BY user_id")
    pipeline("lastn_one", f"events | lastn user_id -m 1 | {cut}", f"SELECT {e} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
    pipeline("diff_value", "events | diff -k user_id -f value --value 50 | select '{event_id: event_id, d: value_diff, p: value_pct_change}'", "SELECT event_id, round(value - 50, 6) AS d, round((value - 50) / 50 * 100, 4) AS p FROM events", lambda d: d.withColumns({"d": F.round("d", 6), "p": F.round("p", 4)}))
    pipeline("sample_reservoir", "events | sample --reservoir 50 --seed 3", "SELECT CAST(50 AS BIGINT) AS n, CAST(50 AS BIGINT) AS ids", lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids")))
    pipeline("window_update", "events | window ts -w 1d -k event_type --emit on-update", f"SELECT {w.format(86400000)}, CAST(86400 AS BIGINT) AS duration, event_type AS key, row_number() OVER (PARTITION BY w, event_type ORDER BY event_id) AS count FROM (SELECT *, (epoch_us(ts) // 1000) // 86400000 * 86400000 AS w FROM events)")
    pipeline("fan_out_union", "events | match \"value > `100`\" | $big ; $big | match \"event_type == 'click'\" | $out ; $big | match \"event_type == 'view'\" | $out ; $out | sum value -k event_type -s total", "SELECT event_type AS key, round(sum(value), 4) AS total FROM events WHERE value > 100 AND event_type IN ('click', 'view') GROUP BY 1", lambda d: d.withColumn("total", F.round("total", 4)))


def decode_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode, compare."""
    ev = source(spark, sf_dir, "part")
    ev = ev.add("b64", F.base64(F.col("p_name").cast("binary"))).add("hexed", F.hex(F.col("p_type").cast("binary")))
    ev = ev.apply("decode", "b64 -l name").apply("decode", "hexed -m hex -l kind")
    return ev.apply("select", "{k: p_partkey, name: name, kind: kind}").frame()


def join_query(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from brookline.operators.joins import join_reference

        ref = source(spark, sf_dir, "nation").df.filter("n_regionkey <> 2").select(F.col("n_nationkey").cast("string").alias("__k"), "n_name", "n_regionkey")
        ev = join_reference(source(spark, sf_dir, "customer"), ref, "c_nationkey", how)
        return ev.apply("select", "{k: c_custkey, nation: n_name, region: n_regionkey}").frame()

    return query


def lookup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookline.sources.tables import register_lookup

    register_lookup("suppliers", source(spark, sf_dir, "supplier").df.withColumnRenamed("s_suppkey", "key"))
    ev = source(spark, sf_dir, "lineitem").apply("dynamodbget", "suppliers -j l_suppkey -l s")
    return ev.apply("select", "{k: l_orderkey, n: l_linenumber, name: s.s_name}").frame()


def components_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order's lines as edges from line to line."""
    li = source(spark, sf_dir, "lineitem").df
    edge = F.struct(F.col("l_suppkey").cast("string").alias("parent"), (F.col("l_partkey") + 1_000_000_000).cast("string").alias("child"))
    ev = events(li.groupBy("l_orderkey").agg(F.collect_list(edge).alias("edges")), "l_orderkey").apply("components", "edges")
    return ev.apply("select", "{k: l_orderkey, n: component_count}").frame()


COMPONENTS = """
WITH RECURSIVE pair AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS a, l_partkey + 1000000000 AS b FROM lineitem),
edge AS (SELECT k, a, b FROM pair UNION SELECT k, b, a FROM pair),
reach AS (SELECT k, a, b FROM edge UNION SELECT r.k, r.a, e.b FROM reach r JOIN edge e ON r.k = e.k AND r.b = e.a)
SELECT k, CAST(count(DISTINCT low) AS INTEGER) AS n FROM (SELECT k, a, min(b) AS low FROM reach GROUP BY k, a) GROUP BY k
"""


def generated_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if not _found:
        _define()
        _found["decode"] = (decode_query, "SELECT p_partkey AS k, p_name AS name, p_type AS kind FROM part")
        joined = "SELECT c_custkey AS k, n_name AS nation, n_regionkey AS region FROM customer {0} JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey"
        _found["join_left"] = (join_query("left"), joined.format("LEFT"))
        _found["join_inner"] = (join_query("inner"), joined.format(""))
        _found["dynamodbget"] = (lookup_query, "SELECT l_orderkey AS k, l_linenumber AS n, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
        _found["components"] = (components_query, COMPONENTS)
        _found["gen"] = (generated_query("gen -c 1000 --seed 1"), None)
        _found["keygen"] = (generated_query("keygen -k 200 --mean 4 -m 1000"), None)
        _found.update(roundtrips.found())
    return {k: q for k, (q, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: s for k, (_, s) in _found.items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, "events | match \"event_type == 'purchase'\" | sum value -k user_id | top count", tables={"events": source(spark, sf_dir, "events")})
