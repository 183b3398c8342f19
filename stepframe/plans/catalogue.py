"""The driver's query catalogue: QUERIES and the equivalent ORACLES, each over whole tables.

Program queries go through the session's text language, the others through the table functions.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.frame import from_dataframe
from stepframe.operators import stats
from stepframe.operators import tables as ops
from stepframe.session import Session
from stepframe.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def program(name: str, text: str, tables: dict[str, str], result: str, oracle: str | None, finish: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """A query that submits a program. tables: WORK name -> column list (SQL) of the source table, 'table: exprs'."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = Session(spark)
        for work, source in tables.items():
            table, _, exprs = source.partition(":")
            d = read(spark, sf, table.strip())
            s.add(work, d.selectExpr(*(e.strip() for e in exprs.split(";"))) if exprs.strip() else d)
        s.submit(text)
        return finish(s.dataframe(result))

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def longs(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.withColumns({n: F.col(n).cast("long") for n in names})


def rounded(digits: int, *names: str, whole: tuple[str, ...] = ()) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.withColumns({n: F.round(F.col(n), digits) for n in names} | {n: F.col(n).cast("long") for n in whole})


DAY = "date_diff('day', DATE '1960-01-01', CAST({} AS DATE))"
LINES = "lineitem: l_orderkey; l_linenumber; l_quantity; l_extendedprice; l_discount; l_returnflag; l_linestatus; l_shipdate"
ORDERS = "orders: o_orderkey; o_custkey; o_orderstatus; o_totalprice; o_orderdate; o_orderpriority"

# --- projection, filter, options

program("q01_assign_keep", "data out; set li; revenue = l_extendedprice * (1 - l_discount); keep l_orderkey revenue; run;", {"li": LINES}, "out", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem", rounded(4, "revenue", whole=("l_orderkey",)))
program(
    "q02_if_else", "data out; set li; revenue = l_extendedprice * (1 - l_discount); if l_quantity > 25 then tier = 2; else tier = 1; keep l_orderkey revenue tier; run;", {"li": LINES}, "out",
    "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue, CAST(CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS BIGINT) AS tier FROM lineitem", rounded(4, "revenue", whole=("l_orderkey", "tier")),
)
program("q03_subset_if", "data out; set o; dear = o_totalprice * 2; if dear > 300000 and o_orderstatus = 'O'; keep o_orderkey dear; run;", {"o": ORDERS}, "out", "SELECT o_orderkey, round(o_totalprice * 2, 4) AS dear FROM orders WHERE o_totalprice * 2 > 300000 AND o_orderstatus = 'O'", rounded(4, "dear", whole=("o_orderkey",)))
MISSING = "orders: o_orderkey; CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p"
program("q04_where_missing_low", "data out; set o; where p < 50000; run;", {"o": MISSING}, "out", "SELECT o_orderkey, p FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders) WHERE p < 50000 OR p IS NULL", longs("o_orderkey"))
program("q05_dataset_options", "data out; set o(where=(o_totalprice >= 100000) keep=o_orderkey o_totalprice o_orderstatus rename=(o_totalprice=price)); run;", {"o": ORDERS}, "out", "SELECT o_orderkey, o_orderstatus, o_totalprice AS price FROM orders WHERE o_totalprice >= 100000", longs("o_orderkey"))

# --- sort, limit, sets

program("q06_sort_nodupkey", "proc sort data=o; by o_orderkey; run; proc sort data=o out=out nodupkey; by o_custkey; run;", {"o": "orders: o_orderkey; o_custkey"}, "out", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey", longs("o_orderkey", "o_custkey"))


@query("q07_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def q07(spark: SparkSession, sf: str) -> DataFrame:
    t = from_dataframe(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"))
    return ops.slice_rows(ops.sort(t, [("o_totalprice", True), ("o_orderkey", False)]), None, 100).data().withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


program("q08_set_concat", "data out; set c s; run;", {"c": "customer: c_custkey AS key; c_name AS name; c_acctbal AS bal", "s": "supplier: s_suppkey AS key; s_name AS name; s_nationkey AS nation"}, "out", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS bal, CAST(NULL AS BIGINT) AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, CAST(s_nationkey AS BIGINT) FROM supplier", longs("key", "nation"))
program("q09_append_force", "proc append base=c data=s force; run;", {"c": "customer: c_custkey AS key; c_name AS name", "s": "supplier: s_suppkey AS key; s_acctbal AS name; s_nationkey AS extra"}, "c", "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, '' FROM supplier", longs("key"))
program("q10_firstobs_obs", "proc sort data=o; by o_orderkey; run; data out; set o(firstobs=101 obs=1100); run;", {"o": "orders: o_orderkey; o_totalprice"}, "out", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n BETWEEN 101 AND 1100", longs("o_orderkey"))

# --- merge and joins

CUST = "customer: c_custkey AS k; c_name; c_acctbal"
SOME = "orders: o_custkey AS k; o_totalprice"
program(
    "q11_merge_full", "proc means data=o noprint; class k; var o_totalprice; output out=t n=n sum=total; run; data out; merge c t(keep=k n total); by k; run;", {"c": "customer: c_custkey AS k; c_acctbal", "o": "orders: o_custkey + 700 AS k; o_totalprice"}, "out",
    "WITH t AS (SELECT o_custkey + 700 AS k, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT coalesce(c.c_custkey, t.k) AS k, c.c_acctbal, CAST(t.n AS BIGINT) AS n, round(t.total, 2) AS total FROM customer c FULL JOIN t ON c.c_custkey = t.k", rounded(2, "total", whole=("k", "n")),
)
program(
    "q12_merge_inner", "data out; merge c o(in=b); by k; if b; run;", {"c": CUST, "o": SOME}, "out",
    "SELECT c_custkey AS k, c_name, c_acctbal, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey", longs("k"),
)
program("q13_merge_left_anti", "data out; merge c(in=a) o(in=b); by k; if a and not b; keep k c_acctbal; run;", {"c": CUST, "o": "supplier: s_suppkey AS k; s_acctbal"}, "out", "SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)", longs("k"))


@query(
    "q14_merge_m_to_n_hold",
    """WITH a AS (SELECT o_custkey AS k, o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    b AS (SELECT user_id AS k, event_id AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT k, rn FROM a UNION SELECT k, rn FROM b), na AS (SELECT DISTINCT k, n FROM a), nb AS (SELECT DISTINCT k, n FROM b)
    SELECT s.k, a.x, b.y FROM s LEFT JOIN na ON na.k = s.k LEFT JOIN nb ON nb.k = s.k LEFT JOIN a ON a.k = s.k AND a.rn = least(s.rn, na.n) LEFT JOIN b ON b.k = s.k AND b.rn = least(s.rn, nb.n)""",
)
def q14(spark: SparkSession, sf: str) -> DataFrame:
    a = from_dataframe(read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("x")), F.col("x"))
    b = from_dataframe(read(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("y")), F.col("y"))
    return longs("k", "x", "y")(ops.merge([a, b], ["k"], [None, None]).data())


program(
    "q15_sql_join_multi", "proc sql; create table out as select n.n_name, count(*) as n, sum(o.o_totalprice) as total from o o inner join c c on o.o_custkey = c.c_custkey inner join n n on c.c_nationkey = n.n_nationkey group by n.n_name; quit;",
    {"o": "orders: o_custkey; o_totalprice", "c": "customer: c_custkey; c_nationkey", "n": "nation: n_nationkey; n_name"}, "out",
    "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", rounded(2, "total", whole=("n",)),
)

# --- ordered state

SORTED = "proc sort data=o; by o_custkey o_orderkey; run; "
KEYS = "orders: o_orderkey; o_custkey; o_totalprice"
RANK = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"
program(
    "q16_first_last", SORTED + "data out; set o; by o_custkey; f = first.o_custkey; l = last.o_custkey; keep o_orderkey f l; run;", {"o": KEYS}, "out",
    f"SELECT o_orderkey, CAST({RANK} = 1 AS BIGINT) AS f, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS BIGINT) AS l FROM orders", longs("o_orderkey", "f", "l"),
)
program(
    "q17_running_sum_by", SORTED + "data out; set o; by o_custkey; if first.o_custkey then run = 0; run + o_totalprice; keep o_orderkey run; run;", {"o": KEYS}, "out",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS run FROM orders", rounded(2, "run", whole=("o_orderkey",)),
)
program(
    "q18_retain_carry", "proc sort data=e; by event_id; run; data out; set e; retain seen .; if event_type = 'purchase' then seen = event_id; keep event_id seen; run;", {"e": "events: event_id; event_type"}, "out",
    "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events", longs("event_id", "seen"),
)
program(
    "q19_by_group_totals", SORTED + "data out; set o; by o_custkey; if first.o_custkey then do; total = 0; n = 0; end; total + o_totalprice; n + 1; if last.o_custkey; keep o_custkey total n; run;", {"o": KEYS}, "out",
    "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY o_custkey", rounded(2, "total", whole=("o_custkey", "n")),
)
program("q20_row_number_n", "proc sort data=o; by o_orderkey; run; data out; set o; n = _n_; keep o_orderkey n; run;", {"o": "orders: o_orderkey"}, "out", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders", longs("o_orderkey", "n"))

# --- summaries


@query("q21_means_class", "SELECT l_returnflag, l_linestatus, v AS \"Variable\", count(*) AS \"N\", round(avg(x), 6) AS \"Mean\", round(stddev_samp(x), 6) AS \"StdDev\", min(x) AS \"Min\", max(x) AS \"Max\" FROM (SELECT l_returnflag, l_linestatus, 'l_quantity' AS v, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, l_linestatus, 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY ALL")
def q21(spark: SparkSession, sf: str) -> DataFrame:
    t = from_dataframe(read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"))
    return rounded(6, "Mean", "StdDev", whole=("N",))(stats.means_listing(t, ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus"]).data())


program(
    "q22_means_out", "proc means data=li noprint; class l_returnflag; var l_quantity l_extendedprice; output out=out n=nq np mean=mq mp sum=sq sp; run;", {"li": LINES}, "out",
    "SELECT l_returnflag, CAST(1 AS BIGINT) AS \"_TYPE_\", count(*) AS \"_FREQ_\", count(l_quantity) AS nq, count(l_extendedprice) AS np, round(avg(l_quantity), 6) AS mq, round(avg(l_extendedprice), 4) AS mp, round(sum(l_quantity), 2) AS sq, round(sum(l_extendedprice), 1) AS sp FROM lineitem GROUP BY l_returnflag",
    lambda d: rounded(6, "mq", whole=("_TYPE_", "_FREQ_", "nq", "np"))(rounded(4, "mp")(rounded(2, "sq")(rounded(1, "sp")(d)))),
)
program("q23_freq_oneway", "proc freq data=o noprint; tables o_orderpriority / out=out; run;", {"o": "orders: o_orderpriority"}, "out", "SELECT o_orderpriority, count(*) AS \"COUNT\", round(100.0 * count(*) / sum(count(*)) OVER (), 8) AS \"PERCENT\" FROM orders GROUP BY 1", rounded(8, "PERCENT", whole=("COUNT",)))


@query("q24_freq_nway", "SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS \"Frequency\", round(100.0 * count(*) / sum(count(*)) OVER (), 8) AS \"Percent\", CAST(sum(count(*)) OVER w AS BIGINT) AS \"CumFreq\", round(100.0 * sum(count(*)) OVER w / sum(count(*)) OVER (), 8) AS \"CumPercent\" FROM lineitem GROUP BY 1, 2, 3 WINDOW w AS (ORDER BY l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) ROWS UNBOUNDED PRECEDING)")
def q24(spark: SparkSession, sf: str) -> DataFrame:
    t = from_dataframe(read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))
    return rounded(8, "Percent", "CumPercent", whole=("Frequency", "CumFreq", "l_linenumber"))(stats.freq_list(t, ["l_returnflag", "l_linestatus", "l_linenumber"]).data())


@query("q25_freq_crosstab", "SELECT o_orderstatus, o_orderpriority, count(*) AS \"Frequency\", round(100.0 * count(*) / sum(count(*)) OVER (), 8) AS \"Percent\", round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 8) AS \"RowPercent\", round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 8) AS \"ColPercent\" FROM orders GROUP BY 1, 2")
def q25(spark: SparkSession, sf: str) -> DataFrame:
    t = from_dataframe(read(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))
    return rounded(8, "Percent", "RowPercent", "ColPercent", whole=("Frequency",))(stats.crosstab(t, "o_orderstatus", "o_orderpriority").data())


@query("q26_chisq", "WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT n, sum(n) OVER (PARTITION BY r) AS nr, sum(n) OVER (PARTITION BY k) AS nk, sum(n) OVER () AS t FROM c) SELECT round(max(t) * (sum(n * n / (CAST(nr AS DOUBLE) * nk)) - 1), 4) AS stat, CAST(((SELECT count(DISTINCT r) FROM c) - 1) * ((SELECT count(DISTINCT k) FROM c) - 1) AS BIGINT) AS df FROM m")
def q26(spark: SparkSession, sf: str) -> DataFrame:
    t = from_dataframe(read(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))
    stat, df, _ = stats.chi_square(t, "o_orderstatus", "o_orderpriority")
    return spark.createDataFrame([(round(stat, 4), int(df))], "stat double, df long")


@query("q27_ols_simple", "SELECT 'Intercept' AS \"Parameter\", round(regr_intercept(l_extendedprice, l_quantity), 3) AS \"Estimate\", round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3), round(regr_r2(l_extendedprice, l_quantity), 6) FROM lineitem")
def q27(spark: SparkSession, sf: str) -> DataFrame:
    t, fit = stats.least_squares(from_dataframe(read(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")), "l_extendedprice", ["l_quantity"])
    return t.df.select("Parameter", F.round("Estimate", 3).alias("Estimate"), F.lit(round(fit["rsquare"], 6)).alias("r2"))


@query(
    "q28_ols_multi",
    """WITH d AS (SELECT p_retailprice AS y, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey AS DOUBLE) AS b FROM part), s AS (SELECT var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM d),
    e AS (SELECT (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb, ma, mb, my FROM s)
    SELECT 'Intercept' AS "Parameter", round(my - ba * ma - bb * mb, 3) AS "Estimate" FROM e UNION ALL SELECT 'p_size', round(ba, 4) FROM e UNION ALL SELECT 'p_partkey', round(bb, 4) FROM e""",
)
def q28(spark: SparkSession, sf: str) -> DataFrame:
    t, _ = stats.least_squares(from_dataframe(read(spark, sf, "part").select("p_retailprice", "p_size", "p_partkey")), "p_retailprice", ["p_size", "p_partkey"])
    return t.df.select("Parameter", F.when(F.col("Parameter") == "Intercept", F.round("Estimate", 3)).otherwise(F.round("Estimate", 4)).alias("Estimate"))


@query("q29_glm_class", "WITH m AS (SELECT o_orderstatus AS g, avg(o_totalprice) AS a FROM orders GROUP BY 1), r AS (SELECT max(g) AS g FROM m) SELECT 'Intercept' AS \"Parameter\", round(a, 3) AS \"Estimate\" FROM m WHERE g = (SELECT g FROM r) UNION ALL SELECT 'o_orderstatus ' || g, round(a - (SELECT a FROM m WHERE g = (SELECT g FROM r)), 3) FROM m")
def q29(spark: SparkSession, sf: str) -> DataFrame:
    t, _ = stats.least_squares(from_dataframe(read(spark, sf, "orders").select("o_orderstatus", "o_totalprice")), "o_totalprice", ["o_orderstatus"], ["o_orderstatus"])
    return t.df.select("Parameter", F.round("Estimate", 3).alias("Estimate"))


# --- formats, functions

program(
    "q30_value_format_group", "proc format; value band low-<50000='small' 50000-<150000='middle' 150000-high='large'; run; data b; set o; format o_totalprice band.; run; proc freq data=b noprint; tables o_totalprice / out=out; run;", {"o": "orders: o_totalprice"}, "out",
    "SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'middle' ELSE 'large' END AS o_totalprice, count(*) AS \"COUNT\", round(100.0 * count(*) / sum(count(*)) OVER (), 8) AS \"PERCENT\" FROM orders GROUP BY 1", rounded(8, "PERCENT", whole=("COUNT",)),
)
program(
    "q31_put_input", "data out; set o; c = put(int(o_totalprice), comma12.); n = input(c, comma12.); d = put(datepart(o_orderdate), date9.); e = input(d, date9.); keep o_orderkey c n d e; run;", {"o": ORDERS}, "out",
    f"SELECT o_orderkey, format('{{:,}}', CAST(trunc(o_totalprice) AS BIGINT)) AS c, CAST(trunc(o_totalprice) AS BIGINT) AS n, upper(strftime(o_orderdate, '%d%b%Y')) AS d, CAST({DAY.format('o_orderdate')} AS BIGINT) AS e FROM orders", longs("o_orderkey", "n", "e"),
)
program(
    "q32_intck", "data out; set o; d = datepart(o_orderdate); m = intck('month', '01JAN1990'd, d); q = intck('qtr', '01JAN1990'd, d); y = intck('year', '01JAN1990'd, d); w = intck('week', '01JAN1990'd, d); keep o_orderkey m q y w; run;", {"o": ORDERS}, "out",
    "SELECT o_orderkey, date_diff('month', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS m, date_diff('quarter', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS q, date_diff('year', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS y, CAST(floor(date_diff('day', DATE '1989-12-31', CAST(o_orderdate AS DATE)) / 7.0) AS BIGINT) AS w FROM orders", longs("o_orderkey", "m", "q", "y", "w"),
)
program(
    "q33_intnx", "data out; set o; d = datepart(o_orderdate); b = intnx('month', d, 3); e = intnx('month', d, 0, 'e'); q = intnx('qtr', d, -1); keep o_orderkey b e q; run;", {"o": ORDERS}, "out",
    f"SELECT o_orderkey, CAST({DAY.format('date_trunc(' + chr(39) + 'month' + chr(39) + ', o_orderdate) + INTERVAL 3 MONTH')} AS BIGINT) AS b, CAST({DAY.format('last_day(CAST(o_orderdate AS DATE))')} AS BIGINT) AS e, CAST({DAY.format('date_trunc(' + chr(39) + 'quarter' + chr(39) + ', o_orderdate) - INTERVAL 3 MONTH')} AS BIGINT) AS q FROM orders", longs("o_orderkey", "b", "e", "q"),
)
program(
    "q34_date_parts", "data out; set o; d = datepart(o_orderdate); y = year(d); m = month(d); dd = day(d); q = qtr(d); w = weekday(d); keep o_orderkey y m dd q w; run;", {"o": ORDERS}, "out",
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q, dayofweek(o_orderdate) + 1 AS w FROM orders", longs("o_orderkey", "y", "m", "dd", "q", "w"),
)
program(
    "q35_mdy_invalid", "data out; set li; d = mdy(2, l_quantity, 2021); bad = missing(d); keep l_quantity d bad; run; proc sort data=out nodupkey; by l_quantity; run;", {"li": "lineitem: l_quantity"}, "out",
    f"SELECT DISTINCT CAST(l_quantity AS BIGINT) AS l_quantity, CASE WHEN l_quantity BETWEEN 1 AND 28 THEN {DAY.format('DATE ' + chr(39) + '2021-01-31' + chr(39))} + CAST(l_quantity AS BIGINT) END AS d, CAST(l_quantity NOT BETWEEN 1 AND 28 AS BIGINT) AS bad FROM lineitem", longs("l_quantity", "d", "bad"),
)
program(
    "q36_string_fns", "data out; set c; u = upcase(c_name); p = propcase(c_mktsegment); l = length(c_name); s = substr(c_name, 5, 6); r = reverse(c_mktsegment); i = index(c_name, '#'); keep c_custkey u p l s r i; run;", {"c": "customer: c_custkey; c_name; c_mktsegment"}, "out",
    "SELECT c_custkey, upper(c_name) AS u, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS p, strlen(rtrim(c_name)) AS l, substr(c_name, 5, 6) AS s, reverse(c_mktsegment) AS r, instr(c_name, '#') AS i FROM customer", longs("c_custkey", "l", "i"),
)
program("q37_scan_words", "data out; set p; a = scan(p_name, 1); z = scan(p_name, -1); k = scan(p_type, 2, ' '); keep p_partkey a z k; run;", {"p": "part: p_partkey; p_name; p_type"}, "out", "SELECT p_partkey, coalesce(w[1], '') AS a, coalesce(w[-1], '') AS z, coalesce(t[2], '') AS k FROM (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS w, list_filter(string_split(p_type, ' '), lambda x: x <> '') AS t FROM part)", longs("p_partkey"))
program("q38_catx", "data out; set p; a = catx('-', p_brand, p_size, p_type); b = cats(p_partkey, p_brand); keep p_partkey a b; run;", {"p": "part: p_partkey; p_brand; p_size; p_type"}, "out", "SELECT p_partkey, concat_ws('-', nullif(trim(p_brand), ''), CAST(p_size AS VARCHAR), nullif(trim(p_type), '')) AS a, CAST(p_partkey AS VARCHAR) || trim(p_brand) AS b FROM part", longs("p_partkey"))
program("q39_compress_tranwrd", "data out; set c; a = compress(c_name, '#0'); b = tranwrd(c_name, 'Customer', 'Client'); keep c_custkey a b; run;", {"c": "customer: c_custkey; c_name"}, "out", "SELECT c_custkey, replace(replace(c_name, '#', ''), '0', '') AS a, replace(c_name, 'Customer', 'Client') AS b FROM customer", longs("c_custkey"))
program(
    "q40_round_math", "data out; set o; r = round(o_totalprice, 10); f = floor(o_totalprice); c = ceil(o_totalprice); s = sum(o_totalprice, ., 1); m = max(., 3, o_orderkey); n = nmiss(., o_orderkey); keep o_orderkey r f c s m n; run;", {"o": ORDERS}, "out",
    "SELECT o_orderkey, CAST(floor(o_totalprice / 10 + 0.5) * 10 AS BIGINT) AS r, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c, round(o_totalprice + 1, 4) AS s, greatest(3, o_orderkey) AS m, CAST(1 AS BIGINT) AS n FROM orders", rounded(4, "s", whole=("o_orderkey", "r", "f", "c", "m", "n")),
)

# --- loops, outputs

program("q41_array_loop", "data out; set li; array a{3} l_quantity l_extendedprice l_discount; t = 0; do i = 1 to 3; t = t + a{i} * i; end; keep l_orderkey t; run;", {"li": LINES}, "out", "SELECT l_orderkey, round(l_quantity + l_extendedprice * 2 + l_discount * 3, 4) AS t FROM lineitem", rounded(4, "t", whole=("l_orderkey",)))
program("q42_do_loop_output", "data out; set n; do i = 1 to 3; v = n_nationkey * i; output; end; keep n_nationkey i v; run;", {"n": "nation: n_nationkey"}, "out", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, i, CAST(n_nationkey * i AS BIGINT) AS v FROM nation, range(1, 4) t(i)", longs("n_nationkey", "i", "v"))
program("q43_multi_output", "data low high; set o; if o_totalprice < 100000 then output low; else output high; run; proc sql; create table out as select 'low' as part, count(*) as n, sum(o_totalprice) as total from low union all select 'high', count(*), sum(o_totalprice) from high; quit;", {"o": "orders: o_totalprice"}, "out", "SELECT CASE WHEN o_totalprice < 100000 THEN 'low' ELSE 'high' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", rounded(2, "total", whole=("n",)))
program("q44_do_until", "data out; set n; k = n_nationkey + 1; steps = 0; do until (k >= 100); k = k * 2; steps = steps + 1; end; keep n_nationkey k steps; run;", {"n": "nation: n_nationkey"}, "out", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST((n_nationkey + 1) * pow(2, greatest(1, ceil(log2(100.0 / (n_nationkey + 1))))) AS BIGINT) AS k, CAST(greatest(1, ceil(log2(100.0 / (n_nationkey + 1)))) AS BIGINT) AS steps FROM nation", longs("n_nationkey", "k", "steps"))

# --- checks

PROOF = {"o": "orders: o_orderkey; o_custkey; o_totalprice; o_orderstatus", "c": "customer: c_custkey; c_mktsegment"}
program("q45_proof_out", "proc sort data=o; by o_orderkey; run; proc proof data=o out=out; range o_totalprice 1000 - 200000; values o_orderstatus in ('O' 'F'); run;", PROOF, "out", "WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS \"_obs_\" FROM orders) SELECT o_orderkey, 'range o_totalprice 1000 - 200000' AS \"_rule_\", \"_obs_\" FROM n WHERE o_totalprice NOT BETWEEN 1000 AND 200000 UNION ALL SELECT o_orderkey, 'values o_orderstatus in (O F)', \"_obs_\" FROM n WHERE o_orderstatus NOT IN ('O', 'F')", lambda d: longs("o_orderkey", "_obs_")(d.select("o_orderkey", "_rule_", "_obs_")))
program("q46_proof_unique", "proc sort data=o; by o_orderkey; run; proc proof data=o out=out; unique o_custkey o_orderstatus; run;", PROOF, "out", "WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS \"_obs_\", count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS m FROM orders) SELECT o_orderkey, 'unique o_custkey o_orderstatus' AS \"_rule_\", \"_obs_\" FROM n WHERE m > 1", lambda d: longs("o_orderkey", "_obs_")(d.select("o_orderkey", "_rule_", "_obs_")))
program("q47_proof_key", "proc sort data=o; by o_orderkey; run; data some; set c; if c_mktsegment = 'BUILDING'; run; proc proof data=o out=out; key o_custkey references some(c_custkey); run;", PROOF, "out", "WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS \"_obs_\" FROM orders) SELECT o_orderkey, 'key o_custkey references some(c_custkey)' AS \"_rule_\", \"_obs_\" FROM n WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", lambda d: longs("o_orderkey", "_obs_")(d.select("o_orderkey", "_rule_", "_obs_")))
program("q48_proof_rule", 'proc sort data=o; by o_orderkey; run; proc proof data=o out=out; rule "cheap if open": o_orderstatus <> \'O\' or o_totalprice < 150000; run;', PROOF, "out", "WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS \"_obs_\" FROM orders) SELECT o_orderkey, 'cheap if open' AS \"_rule_\", \"_obs_\" FROM n WHERE o_orderstatus = 'O' AND o_totalprice >= 150000", lambda d: longs("o_orderkey", "_obs_")(d.select("o_orderkey", "_rule_", "_obs_")))

# --- SQL

SQL = {"o": "orders: o_orderkey; o_custkey; o_totalprice; o_orderstatus; o_orderpriority", "li": "lineitem: l_orderkey; l_quantity; l_extendedprice", "p": "part: p_brand; p_size; p_name"}
program("q49_sql_group_having", "proc sql; create table out as select o_custkey, count(*) as n, sum(o_totalprice) as a from o group by o_custkey having count(*) > 12 order by o_custkey; quit;", SQL, "out", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS a FROM orders GROUP BY 1 HAVING count(*) > 12", rounded(2, "a", whole=("o_custkey", "n")))
program("q50_sql_setops", "proc sql; create table out as select o_custkey as k from o where o_totalprice > 250000 union select l_orderkey from li where l_quantity > 49 except select o_orderkey from o where o_orderstatus = 'F'; quit;", SQL, "out", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 250000 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", longs("k"))
program("q51_sql_window", "proc sql; create table out as select o_orderkey, rank() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as prev from o; quit;", SQL, "out", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders", longs("o_orderkey", "r", "prev"))
program("q52_sql_semi_anti", "proc sql; create table out as select o_orderkey, o_totalprice from o where o_orderkey in (select l_orderkey from li where l_quantity = 50) and not exists (select 1 from li x where x.l_orderkey = o_orderkey and x.l_extendedprice > 90000); quit;", SQL, "out", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_extendedprice > 90000)", longs("o_orderkey"))

# --- text in and out


def local_query(name: str, tables: dict[str, str], text: str, oracle: str, finish: Callable[[DataFrame], DataFrame]) -> None:
    """A query that writes a file and reads it back, in the shared folder where that is a folder of the file system."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        where = shared_dir(spark).removeprefix("file://")
        if "://" not in where:
            os.makedirs(where, exist_ok=True)
        scratch = tempfile.mkdtemp(prefix="stepframe-", dir=where if "://" not in where else None)
        s = Session(spark)
        for work, source in tables.items():
            table, _, exprs = source.partition(":")
            s.add(work, read(spark, sf, table.strip()).selectExpr(*(e.strip() for e in exprs.split(";"))))
        s.submit(text.replace("@DIR@", scratch))
        return finish(s.dataframe("out"))

    QUERIES[name] = run
    ORACLES[name] = oracle


NATION = {"n": "nation: n_nationkey; n_name; n_regionkey"}


local_query("q53_csv_roundtrip", NATION, 'proc export data=n outfile="@DIR@/n.csv" dbms=csv; run; proc import datafile="@DIR@/n.csv" out=out dbms=csv; run;', "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation", longs("n_nationkey", "n_regionkey"))
local_query("q54_text_column_input", NATION, 'data _null_; set n; file "@DIR@/n.txt"; put n_nationkey 1-4 n_name $ 6-30; run; data out; infile "@DIR@/n.txt"; input k 1-4 name $ 6-30; run;', "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation", longs("k"))
local_query("q55_dsd_input", {"r": "region: r_regionkey; r_name"}, 'data _null_; set r; file "@DIR@/r.csv" dsd; v = catx(",", r_name, r_regionkey); put r_regionkey v; run; data out; infile "@DIR@/r.csv" dsd; input k v $; run;', "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name || ',' || r_regionkey AS v FROM region", longs("k"))
local_query("q56_double_at_hold", NATION, 'data _null_; set n; file "@DIR@/h.txt"; put n_nationkey @@; run; data out; infile "@DIR@/h.txt"; input k @@; run;', "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation", longs("k"))


# --- the two published micro-benchmark shapes


@query("b1_set_transform", "SELECT l_orderkey AS id, round(l_extendedprice * 1.1, 4) AS gross, round(l_extendedprice * 1.1 - l_quantity, 4) AS net, CASE WHEN l_extendedprice > 500 THEN 'high' ELSE 'low' END AS band FROM lineitem")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    s = Session(spark)
    s.add("li", read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amt"), F.col("l_quantity").alias("q")))
    s.submit("data out; set li; gross = amt * 1.1; net = gross - q; if amt > 500 then band = 'high'; else band = 'low'; keep id gross net band; run;")
    return rounded(4, "gross", "net", whole=("id",))(s.dataframe("out"))


@query("b2_generate", "SELECT i, i * 2 AS double, CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM range(1, 50001) t(i)")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    s = Session(spark)
    s.submit("data out; do i = 1 to 50000; double = i * 2; if i / 2 = int(i / 2) then kind = 'even'; else kind = 'odd'; output; end; run;")
    return longs("i", "double")(s.dataframe("out"))


__all__ = ["ORACLES", "QUERIES"]
