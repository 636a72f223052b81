"""The query catalogue: one entry per operator, with a SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..functions.values import canonical, record_id, value_text
from ..operators import aggregates as agg
from ..operators import records as rec
from ..operators import recursion
from ..operators import relational as rel
from ..sources import inputs, outputs
from ..storage import fresh_path
from ..streaming import runner
from . import program as prog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (table reader) as a query, with its SQL."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

# Patterns, filters and joins.


@query("SELECT c_custkey, c_name FROM customer")
def find_project(t):
    return rel.find(t("customer"), "c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.05")
def filter_compare(t):
    li = t("lineitem")
    return li.filter(fn.greater(li.l_quantity, F.lit(45)) & fn.less_or_equal(li.l_discount, F.lit(0.05))).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def filter_const_attr(t):
    return rel.find(t("orders"), "o_orderkey", "o_custkey", o_orderstatus="F")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_one_of(t):
    return rel.find(t("orders"), "o_orderkey", "o_orderpriority", o_orderpriority=["1-URGENT", "2-HIGH"])


@query("SELECT p_partkey, p_size FROM part WHERE p_size + 1 = 10")
def expr_filter(t):
    return t("part").filter(fn.add(F.col("p_size"), F.lit(1)) == 10).select("p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE 10 < l_quantity AND l_quantity < 12")
def chained_compare(t):
    return t("lineitem").filter((F.col("l_quantity") > 10) & (F.col("l_quantity") < 12)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def unify_join(t):
    c = rel.find(t("customer"), "c_custkey", "c_name", c_mktsegment="BUILDING")
    return t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def path_join(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity = 50 AND o_orderpriority = '1-URGENT'")
def three_way_join(t):
    o = rel.find(t("orders"), "o_orderkey", "o_custkey", o_orderpriority="1-URGENT")
    lines = rel.find(t("lineitem"), "l_orderkey", "l_linenumber", "l_partkey", l_quantity=50)
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "l_partkey", "c_name")


@query("SELECT a.s_suppkey AS high, b.s_suppkey AS low FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal > b.s_acctbal")
def self_join_theta(t):
    s = t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_acctbal") > F.col("b.s_acctbal"))).select(F.col("a.s_suppkey").alias("high"), F.col("b.s_suppkey").alias("low"))


@query("SELECT a.r_name AS x, b.r_name AS y FROM region a, region b")
def cross_small(t):
    r = t("region")
    return r.select(F.col("r_name").alias("x")).crossJoin(F.broadcast(r.select(F.col("r_name").alias("y"))))


# Negation and existence.


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50)")
def anti_not(t):
    sold = rel.find(t("lineitem"), l_quantity=50).select(F.col("l_partkey").alias("p_partkey"))
    return rel.not_exists(t("part").select("p_partkey"), sold, ["p_partkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_not_filtered(t):
    urgent = rel.find(t("orders"), o_orderpriority="1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return rel.not_exists(t("customer").select("c_custkey"), urgent, ["c_custkey"])


@query("SELECT r_regionkey, r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)")
def anti_global(t):
    return rel.not_exists(t("region"), t("orders").filter("o_totalprice < 0"))


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50)")
def semi_exists(t):
    return rel.exists(t("part").select("p_partkey"), rel.find(t("lineitem"), l_quantity=50).select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT c_acctbal > 5000")
def attribute_not(t):
    return t("customer").filter((F.col("c_acctbal") > 0) & ~(F.col("c_acctbal") > 5000)).select("c_custkey")


# Unions and choices.


@query("SELECT o_orderkey, 'high' AS label FROM orders WHERE o_totalprice > 300000 UNION SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT'")
def union_branches(t):
    return rel.union_branches(
        t("orders"),
        lambda o: o.filter("o_totalprice > 300000").select("o_orderkey", F.lit("high").alias("label")),
        lambda o: rel.find(o, o_orderpriority="1-URGENT").select("o_orderkey", F.lit("urgent").alias("label")),
    )


@query("SELECT r_name, x AS label FROM region, (VALUES ('a'), ('b')) v(x)")
def union_static(t):
    return rel.union_branches(t("region"), *[lambda r, x=x: r.select("r_name", F.lit(x).alias("label")) for x in "ab"])


@query("SELECT DISTINCT o_custkey AS k FROM orders UNION SELECT s_suppkey FROM supplier")
def union_collapse(t):
    return rel.union_branches(t("orders"), lambda o: o.select(F.col("o_custkey").alias("k")), lambda o: t("supplier").select(F.col("s_suppkey").alias("k")))


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) ON c_custkey = o_custkey")
def choose_default(t):
    n = agg.gather_count(rel.find(t("orders"), o_orderpriority="1-URGENT").withColumnRenamed("o_custkey", "c_custkey"), ["o_orderkey"], ["c_custkey"], "n", unique=True)
    return rel.choose_or_default(t("customer").select("c_custkey"), n, ["c_custkey"], n=0)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS band FROM lineitem")
def choose_ladder(t):
    q = F.col("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rel.choose_value((q < 10, F.lit("small")), (q < 30, F.lit("medium")), otherwise=F.lit("large")).alias("band"))


@query("""SELECT c_custkey, o_orderkey AS v FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT c_custkey, -c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def choose_multirow(t):
    urgent = rel.find(t("orders"), o_orderpriority="1-URGENT")
    return rel.choose(
        t("customer").select("c_custkey"), ["c_custkey"],
        lambda c: c.join(urgent, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.col("o_orderkey").alias("v")),
        lambda c: c.select("c_custkey", (-F.col("c_custkey")).alias("v")),
    )


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side, abs(s_acctbal) AS amount FROM supplier")
def choose_multi_return(t):
    return rel.choose(
        t("supplier"), ["s_suppkey"],
        lambda s: s.filter("s_acctbal < 0").select("s_suppkey", F.lit("debt").alias("side"), fn.absolute(F.col("s_acctbal")).alias("amount")),
        lambda s: s.select("s_suppkey", F.lit("credit").alias("side"), fn.absolute(F.col("s_acctbal")).alias("amount")),
    )


@query("""SELECT n_nationkey, r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'
UNION ALL SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT LIKE 'A%' AND n_name NOT LIKE 'R%'""")
def choose_post_filter(t):
    return rel.choose(
        t("nation"), ["n_nationkey"],
        lambda n: n.join(t("region").filter("r_name LIKE 'A%'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("label")),
        lambda n: n.filter("n_name NOT LIKE 'R%'").select("n_nationkey", F.col("n_name").alias("label")),
    )


@query("SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'rich' END AS label FROM customer WHERE c_acctbal > 9000")
def choose_no_match(t):
    return rel.choose(t("customer"), ["c_custkey"], lambda c: c.filter("c_acctbal > 9000").select("c_custkey", F.lit("rich").alias("label")))


# Aggregates.


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY o_custkey")
def agg_count(t):
    return agg.gather_count(t("orders"), ["o_orderkey"], ["o_custkey"], "n", unique=True)


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey")
def agg_count_setproj(t):
    return agg.gather_count(t("orders"), ["o_orderpriority"], ["o_custkey"], "n")


@query("SELECT l_orderkey, sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::BIGINT AS revenue_cents FROM lineitem GROUP BY l_orderkey")
def agg_sum(t):
    li = t("lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long"))
    return agg.gather_sum(li, LINE, "cents", ["l_orderkey"], "revenue_cents", unique=True)


@query("SELECT o_custkey, sum(x)::BIGINT AS total FROM (SELECT DISTINCT o_custkey, round(o_totalprice)::BIGINT AS x FROM orders) GROUP BY o_custkey")
def agg_sum_setproj(t):
    return agg.gather_sum(t("orders").withColumn("x", F.round("o_totalprice").cast("long")), [], "x", ["o_custkey"], "total")


@query("SELECT sum(l_quantity)::BIGINT AS total FROM lineitem")
def agg_global(t):
    return agg.gather_sum(t("lineitem").withColumn("q", F.col("l_quantity").cast("long")), LINE, "q", [], "total", unique=True)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) OVER (PARTITION BY l_orderkey)::BIGINT AS total FROM lineitem")
def agg_joinback(t):
    li = t("lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return agg.with_group(li.select(*LINE), agg.gather_sum(li, LINE, "q", ["l_orderkey"], "total", unique=True), ["l_orderkey"])


@query("SELECT c_custkey, c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15) ON c_custkey = o_custkey")
def agg_having(t):
    n = agg.gather_count(t("orders"), ["o_orderkey"], ["o_custkey"], "n", unique=True).filter("n > 15")
    return t("customer").join(n, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "n")


@query("""SELECT c_custkey, coalesce(n::VARCHAR, 'none') AS label FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON c_custkey = o_custkey""")
def agg_in_choose(t):
    orders = rel.find(t("orders"), o_orderstatus="P").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")

    def counted(c):
        return agg.gather_count(rel.exists(orders, c, ["c_custkey"]), ["o_orderkey"], ["c_custkey"], "n", unique=True).select("c_custkey", F.col("n").cast("string").alias("label"))

    return rel.choose(t("customer").select("c_custkey"), ["c_custkey"], counted, lambda c: c.select("c_custkey", F.lit("none").alias("label")))


@query("SELECT o_custkey, max(x) AS longest FROM (SELECT o_custkey, round(o_totalprice)::DOUBLE AS x FROM orders) GROUP BY o_custkey")
def agg_custom(t):
    return agg.custom_aggregate(t("orders").withColumn("x", F.round("o_totalprice")), ["o_custkey"], "x", "double", "longest", lambda v: float(v.max()))


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_acctbal)::INT AS place FROM customer")
def sort_rank(t):
    return agg.gather_sort(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], name="place").select("c_custkey", "place")


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_acctbal DESC)::INT AS place FROM customer")
def sort_down(t):
    return agg.gather_sort(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "down", name="place").select("c_custkey", "place")


@query("SELECT s_suppkey, dense_rank() OVER (ORDER BY s_nationkey DESC, s_acctbal)::INT AS place FROM supplier")
def sort_multi(t):
    return agg.gather_sort(t("supplier"), ["s_nationkey", "s_acctbal"], "down", "up", name="place").select("s_suppkey", "place")


@query("SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)::INT AS place FROM orders")
def sort_group(t):
    return agg.gather_sort(t("orders"), ["o_totalprice"], "down", per=["o_custkey"], name="place").select("o_orderkey", "place")


@query("SELECT c_custkey, c_acctbal FROM (SELECT *, dense_rank() OVER (ORDER BY c_acctbal DESC) AS r FROM customer) WHERE r <= 10")
def limit_n(t):
    return agg.limit_to(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 10, "down")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 3")
def topk_per_group(t):
    return agg.limit_to(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_totalprice"], 3, "down", per=["o_custkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r = 1")
def argmax(t):
    return agg.best_per(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_totalprice"], "down", per=["o_custkey"]).select("o_custkey", "o_orderkey")


# Functions.


@query("SELECT p_partkey, p_retailprice + p_size AS plus, p_retailprice - p_size AS minus, p_retailprice * p_size AS times, p_retailprice / p_size AS quotient, floor(p_retailprice) AS low, ceil(p_retailprice) AS high, abs(p_size - 25)::DOUBLE AS distance FROM part")
def fn_math(t):
    p, s = F.col("p_retailprice"), F.col("p_size")
    return t("part").select("p_partkey", fn.add(p, s).alias("plus"), fn.subtract(p, s).alias("minus"), fn.multiply(p, s).alias("times"), fn.divide(p, s).alias("quotient"), fn.floor(p).alias("low"), fn.ceiling(p).alias("high"), fn.absolute(s - 25).alias("distance"))


@query("SELECT c_custkey, floor(c_acctbal + 0.5::DOUBLE) AS whole FROM customer")
def fn_round(t):
    return t("customer").select("c_custkey", fn.round_half_up(F.col("c_acctbal")).alias("whole"))


@query("SELECT p_partkey, round(sin(p_size / 180.0::DOUBLE * pi()), 9) AS s, round(cos(p_size / 180.0::DOUBLE * pi()), 9) AS c, round(tan(p_size / 180.0::DOUBLE * pi()), 9) AS t FROM part")
def fn_trig(t):
    s = F.col("p_size")
    return t("part").select("p_partkey", F.round(fn.sine(s), 9).alias("s"), F.round(fn.cosine(s), 9).alias("c"), F.round(fn.tangent(s), 9).alias("t"))


@query("SELECT p_partkey, (p_size % 7)::DOUBLE AS m, pow(p_size, 2)::DOUBLE AS square, round(ln(p_size), 9) AS l FROM part")
def fn_mod_pow_ln(t):
    s = F.col("p_size")
    return t("part").select("p_partkey", fn.modulo(s, F.lit(7)).alias("m"), fn.power(s, F.lit(2)).alias("square"), F.round(fn.natural_log(s), 9).alias("l"))


@query("SELECT c_custkey, greatest(c_acctbal, 1000.0::DOUBLE) AS high, least(c_acctbal, 1000.0::DOUBLE) AS low FROM customer")
def fn_minmax(t):
    return t("customer").select("c_custkey", fn.maximum(F.col("c_acctbal"), F.lit(1000.0)).alias("high"), fn.minimum(F.col("c_acctbal"), F.lit(1000.0)).alias("low"))


@query("SELECT p_partkey, printf('%.1f', p_size / 4.0::DOUBLE + 0.01::DOUBLE) AS text FROM part")
def fn_tofixed(t):
    return t("part").select("p_partkey", fn.to_fixed(F.col("p_size") / 4 + 0.01, 1).alias("text"))


@query("SELECT p_partkey, lower(printf('%x', p_partkey)) AS hex, bin(p_partkey) AS bits FROM part")
def fn_convert_base(t):
    return t("part").select("p_partkey", fn.convert_base(F.col("p_partkey"), 16).alias("hex"), fn.convert_base(F.col("p_partkey"), 2).alias("bits"))


@query("SELECT n_nationkey, unnest(generate_series(least(n_nationkey, 5), greatest(n_nationkey, 5)))::DOUBLE AS i FROM nation")
def fn_range(t):
    return fn.apply_rows(t("nation").select("n_nationkey"), "math/range", "i", F.col("n_nationkey"), F.lit(5))


@query("""SELECT p_partkey, replace(p_name, 'a', 'A') AS r, substr(p_name, 2, 1) AS g, upper(p_name) AS u, lower(p_brand) AS l, instr(p_type, 'e')::INT AS i, length(p_type)::INT AS n
FROM part WHERE length(p_name) >= 2 AND instr(p_type, 'e') > 0""")
def fn_string(t):
    name = F.col("p_name")
    return fn.defined(
        t("part"), r=fn.replace(name, F.lit("a"), F.lit("A")), g=fn.character_at(name, F.lit(2)), u=fn.uppercase(name), l=fn.lowercase(F.col("p_brand")),
        i=fn.index_of(F.col("p_type"), F.lit("e")), n=fn.codepoint_length(F.col("p_type")),
    ).select("p_partkey", "r", "g", "u", "l", "i", "n")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'false' ELSE 'true' END AS t FROM labels")
def fn_toggle(t):
    return t("labels").select("doc_id", fn.toggle(F.when(F.col("toxic") == 1, "true").otherwise("false")).alias("t"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d FROM orders")
def fn_date_format(t):
    return t("orders").select("o_orderkey", fn.date_format(F.unix_millis(F.col("o_orderdate").cast("timestamp")), "yyyy-mm-dd HH:MM:ss").alias("d"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey IS NOT NULL) AS inside, count(*) AS again FROM orders")
def fn_random(t):
    r, again = fn.random_number(F.col("o_orderkey")), fn.random_number(F.col("o_orderkey"))
    x = t("orders").select(r.alias("r"), again.alias("s"))
    return x.agg(F.count("*").alias("n"), F.count_if((F.col("r") >= 0) & (F.col("r") < 1)).alias("inside"), F.count_if(F.col("r") == F.col("s")).alias("again"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 5 = 0")
def fn_as_filter(t):
    return fn.apply(t("part").withColumn("zero", F.lit(0.0)), "math/mod", "zero", F.col("p_size"), F.lit(5)).select("p_partkey", "p_size")


# Records.


@query("SELECT 'tag|order|o_custkey|' || o_custkey || '|o_orderkey|' || o_orderkey AS id, o_orderstatus FROM orders")
def gen_id_record(t):
    o = t("orders")
    return o.select(record_id(o, ["order"], ["o_orderkey", "o_custkey"]).alias("id"), "o_orderstatus")


@query("SELECT c_custkey, c_name || ' owes ' || (CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END) AS text FROM customer")
def string_concat(t):
    c = t("customer")
    return c.select("c_custkey", fn.concat_values(F.col("c_name"), F.lit(" owes "), canonical(c, "c_acctbal")).alias("text"))


@query("SELECT 'region|' || r_regionkey AS e, 'r_name' AS a, r_name AS v FROM region UNION ALL SELECT 'region|' || r_regionkey, 'r_regionkey', r_regionkey::VARCHAR FROM region")
def lookup_unpivot(t):
    r = t("region")
    return rel.fact_text(rel.lookup(r, F.concat(F.lit("region|"), F.col("r_regionkey").cast("string")), ["r_name", "r_regionkey"]))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_regionkey::VARCHAR END AS value FROM nation")
def attr_variable_join(t):
    n = t("nation").withColumn("e", F.col("n_nationkey").cast("string"))
    asked = n.select("n_nationkey", "e", F.when(F.col("n_nationkey") % 2 == 0, "n_name").otherwise("n_regionkey").alias("which"))
    return rel.attribute_named(asked, rel.lookup(n, F.col("e"), ["n_name", "n_regionkey"]), "e", "which").select("n_nationkey", value_text("value").alias("value"))


@query("SELECT DISTINCT o_custkey::VARCHAR AS e, o_orderpriority AS v FROM orders")
def multi_value_attr(t):
    per = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("priority"))
    facts = rec.make_records(per, [], [], ["priority"], entity=F.col("o_custkey").cast("string"))
    return rel.fact_text(rel.scan(facts, a="priority")).select("e", "v")


@query("SELECT n_name AS e, 'tag' AS a, 'nation' AS v FROM nation UNION ALL SELECT n_name, 'region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def record_facts(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "region")
    return rel.fact_text(rec.make_records(n, ["nation"], [], ["region"], entity=F.col("n_name")))


@query("SELECT n_nationkey::VARCHAR AS e, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def watch_objects(t):
    n = t("nation")
    return rec.objects(rel.lookup(n, F.col("n_nationkey").cast("string"), ["n_name", "n_regionkey"]), ["n_name", "n_regionkey"])


@query("""SELECT o_custkey::VARCHAR AS e, 'lines' AS a, o_custkey || '|lines|' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS v FROM orders
UNION ALL SELECT o_custkey || '|lines|' || (row_number() OVER w - 1), 'key', o_orderkey::VARCHAR FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
UNION ALL SELECT o_custkey || '|lines|' || (row_number() OVER w - 1), 'index', (row_number() OVER w)::VARCHAR FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def nested_ingest(t):
    nested = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key")))).alias("lines"))
    return rel.fact_text(rec.flatten(nested, "o_custkey"))


# Rules that feed rules, and recursion.


@query("SELECT 'customer|' || c_custkey AS e, 'rich' AS v FROM customer WHERE c_acctbal > 9000 UNION SELECT 'customer|' || c_custkey, 'busy' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 20)")
def rule_chain(t):
    busy = agg.gather_count(t("orders"), ["o_orderkey"], ["o_custkey"], "n", unique=True).filter("n > 20")
    e = lambda k: F.concat(F.lit("customer|"), F.col(k).cast("string")).alias("e")
    return rel.union_branches(t("customer"), lambda c: c.filter("c_acctbal > 9000").select(e("c_custkey"), F.lit("rich").alias("v")), lambda c: busy.select(e("o_custkey"), F.lit("busy").alias("v")))


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT n_nationkey AS source, (n_nationkey + 5) % 25 AS target FROM nation),
paths AS (SELECT source, target FROM edges UNION SELECT p.source, e.target FROM paths p JOIN edges e ON p.target = e.source) SELECT source, target FROM paths""")
def transitive_closure(t):
    return recursion.closure(t("nation").select(F.col("n_nationkey").alias("source"), ((F.col("n_nationkey") + 5) % 25).alias("target")))


@query("WITH RECURSIVE n AS (SELECT r_regionkey AS i FROM region UNION SELECT i + 1 FROM n WHERE i < 9) SELECT i FROM n")
def recursive_count(t):
    return recursion.fixpoint(t("region").select(F.col("r_regionkey").alias("i")), lambda new, known: new.filter("i < 9").select((F.col("i") + 1).alias("i")))


# Changes, commits and transactions. Customers are records customer|key with balance and segment.


def _customers(t, most: int = 10**9) -> DataFrame:
    c = t("customer").filter(F.col("c_custkey") <= most).select(F.concat(F.lit("customer|"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return rec.make_records(c, ["customer"], [], ["balance", "segment"], entity=F.col("id"))


_SQL_FACTS = """WITH c AS (SELECT 'customer|' || c_custkey AS e, c_acctbal AS b, c_mktsegment AS s FROM customer),
f AS (SELECT e, 'tag' AS a, 'customer' AS v FROM c UNION ALL SELECT e, 'segment', s FROM c UNION ALL SELECT e, 'balance', CASE WHEN b = floor(b) THEN b::BIGINT::VARCHAR ELSE b::VARCHAR END FROM c) """


@query(_SQL_FACTS + "SELECT * FROM f UNION ALL SELECT e, 'tag', 'debtor' FROM c WHERE b < 0")
def commit_add(t):
    facts = _customers(t)
    poor = rel.scan(facts, a="balance").filter("v.n < 0")
    return rel.fact_text(rec.apply_changes(facts, rec.add_value(poor, F.col("e"), F.lit("tag"), rec.text("debtor"))))


@query(_SQL_FACTS + "SELECT * FROM f WHERE a <> 'segment' OR v <> 'BUILDING' UNION ALL SELECT e, a, 'HOUSES' FROM f WHERE a = 'segment' AND v = 'BUILDING'")
def commit_set(t):
    facts = _customers(t)
    return rel.fact_text(rec.apply_changes(facts, rec.set_value(rel.scan(facts, a="segment", v="BUILDING"), F.col("e"), F.lit("segment"), rec.text("HOUSES"))))


@query(_SQL_FACTS + "SELECT * FROM f WHERE NOT (a = 'segment' AND v = 'BUILDING')")
def commit_remove_value(t):
    facts = _customers(t)
    gone = rel.scan(facts, a="segment", v="BUILDING")
    return rel.fact_text(rec.apply_changes(facts, rec.remove_value(gone, F.col("e"), F.col("a"), F.col("v"))))


@query(_SQL_FACTS + "SELECT * FROM f WHERE a <> 'segment' OR e NOT IN (SELECT e FROM c WHERE b < 0)")
def commit_remove_attr(t):
    facts = _customers(t)
    return rel.fact_text(rec.apply_changes(facts, rec.remove_attribute(rel.scan(facts, a="balance").filter("v.n < 0"), F.col("e"), F.lit("segment"))))


@query(_SQL_FACTS + "SELECT * FROM f WHERE e NOT IN (SELECT e FROM c WHERE b < 0)")
def commit_remove_record(t):
    facts = _customers(t)
    return rel.fact_text(rec.apply_changes(facts, rec.remove_record(rel.scan(facts, a="balance").filter("v.n < 0"), F.col("e"))))


@query(_SQL_FACTS + "SELECT * FROM f WHERE a <> 'segment' OR v <> 'BUILDING' UNION ALL SELECT e, 'segment', 'HOUSES' FROM c WHERE s = 'BUILDING' UNION ALL SELECT e, 'tag', 'builder' FROM c WHERE s = 'BUILDING'")
def commit_merge(t):
    facts = _customers(t)
    rows = rel.scan(facts, a="segment", v="BUILDING").select("e", F.lit("HOUSES").alias("segment"), F.lit("builder").alias("tag"))
    return rel.fact_text(rec.apply_changes(facts, rec.merge_values(rows, F.col("e"), ["segment", "tag"])))


@query("SELECT 'counter' AS e, 'count' AS a, (SELECT count(*) FROM region)::VARCHAR AS v")
def commit_frames(t):
    """Each frame counts one event and removes it, until none is left."""
    spark = t("region").sparkSession

    def count(facts: DataFrame) -> DataFrame:
        event = agg.limit_to(rel.scan(facts, a="tag", v="click").select("e"), ["e"], 1)
        now = rel.scan(facts, e="counter", a="count").select(F.col("v.n").alias("n"))
        step = event.crossJoin(F.broadcast(now.limit(1)))
        changed = rec.remove_record(step, F.col("e")).unionByName(rec.set_value(step, F.lit("counter"), F.lit("count"), rec.number(F.col("n") + 1)))
        return changed.crossJoin(F.broadcast(step.select(F.col("e").alias("match"))))  # one event a frame

    clicks = t("region").select(F.concat(F.lit("event|"), F.col("r_regionkey").cast("string")).alias("e"), F.lit("tag").alias("a"), rec.text("click").alias("v"))
    p = prog.Program(spark).commit("count clicks", count)
    p.input(prog.changes(spark, [("add", "counter", "count", 0)]).unionByName(clicks.select(F.lit("add").alias("op"), "e", "a", "v")))
    return rel.fact_text(p.facts())


@query("SELECT 'add' AS change, 'o|' || o_orderkey AS e FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0 UNION ALL SELECT 'remove', 'o|' || o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def retract_diff(t):
    """What a watch of finished orders hears when the first two thirds come and the others go."""
    o = t("orders").filter("o_orderstatus = 'F'").withColumn("e", F.concat(F.lit("o|"), F.col("o_orderkey").cast("string")))
    before, after = o.filter("o_orderkey % 3 = 0").select("e"), o.filter("o_orderkey % 3 <> 0").select("e")
    came, went = prog.difference(before, after)
    return came.select(F.lit("add").alias("change"), "e").unionByName(went.select(F.lit("remove").alias("change"), "e"))


@query("SELECT 'region|' || r_regionkey AS e, 'label' AS a, upper(r_name) AS v FROM region")
def block_add_remove(t):
    """A rule is bound and unbound again; only the other's facts remain."""
    r = t("region").select(F.concat(F.lit("region|"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"))
    p = prog.Program(r.sparkSession)
    p.bind("upper", lambda f: rel.scan(f, a="name").select("e", F.lit("label").alias("a"), rec.text(F.upper("v.s")).alias("v")))
    p.bind("lower", lambda f: rel.scan(f, a="name").select("e", F.lit("label").alias("a"), rec.text(F.lower("v.s")).alias("v")))
    p.insert(rec.make_records(r, [], [], ["name"], entity=F.col("id")))
    p.unbind("lower")
    return rel.fact_text(rel.scan(p.facts(), a="label"))


@query("SELECT r_name AS e, 'nations' AS a, count(*)::VARCHAR AS v FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def program_strata(t):
    """A counting rule in a later stratum than the rule that links nations to their regions."""
    n, r = t("nation"), t("region")
    p = prog.Program(n.sparkSession)

    def link(f: DataFrame) -> DataFrame:
        nations = rel.scan(f, a="region").select("e", F.col("v.n").alias("key"))
        regions = rel.scan(f, a="key").select(F.col("e").alias("r"), F.col("v.n").alias("key"))
        return nations.join(regions, "key").select("e", F.lit("in").alias("a"), rec.text(F.col("r")).alias("v"))

    def count(f: DataFrame) -> DataFrame:
        members = rel.scan(f, a="in").select("e", F.col("v.s").alias("r"))
        return agg.gather_count(members, ["e"], ["r"], "n").select(F.col("r").alias("e"), F.lit("nations").alias("a"), rec.number(F.col("n")).alias("v"))

    p.bind("link", link).bind("count", count, stratum=1)
    named = rec.make_records(n.withColumnRenamed("n_regionkey", "region"), [], [], ["region"], entity=F.col("n_name")).unionByName(rec.make_records(r.withColumnRenamed("r_regionkey", "key"), [], [], ["key"], entity=F.col("r_name")))
    p.insert(named)
    return rel.fact_text(rel.scan(p.facts(), a="nations"))


# Programs: order of rules, support, watches, connectors.


def _regions(t, name: str = "name") -> DataFrame:
    """Regions as facts: region|key has its name."""
    r = t("region").select(F.concat(F.lit("region|"), F.col("r_regionkey").cast("string")).alias("e"), F.col("r_name").alias("s"))
    return r.select("e", F.lit(name).alias("a"), rec.text(F.col("s")).alias("v"))


def _copy(source: str, target: str) -> Callable[[DataFrame], DataFrame]:
    return lambda f: rel.scan(f, a=source).select("e", F.lit(target).alias("a"), "v")


@query("SELECT 'region|' || r_regionkey AS e, a, r_name AS v FROM region, (VALUES ('name'), ('x'), ('y'), ('z')) AS n(a)")
def rule_chain_program(t):
    """Rules that feed each other are complete in any order."""
    p = prog.Program(t("region").sparkSession)
    p.bind("third", _copy("y", "z")).bind("second", _copy("x", "y")).bind("first", _copy("name", "x"))
    return rel.fact_text(p.insert(_regions(t)).facts())


@query("SELECT 'foo' AS e, 'bar' AS a, 'baz' AS v")
def constants_block(t):
    """A rule without any pattern holds always."""
    spark = t("region").sparkSession
    p = prog.Program(spark).bind("constant", lambda f: prog.changes(spark, [("add", "foo", "bar", "baz")]).select("e", "a", "v"), recursive=False)
    return rel.fact_text(p.facts())


@query("SELECT 'region|' || r_regionkey AS e, 'tag' AS a, 'known' AS v FROM region WHERE r_regionkey <> 2")
def support_counting(t):
    """A fact that two rules derive stays while one of them does."""
    p = prog.Program(t("region").sparkSession)
    for source in ("name", "alias"):
        p.bind(source, lambda f, a=source: rel.scan(f, a=a).select("e", F.lit("tag").alias("a"), rec.text("known").alias("v")), recursive=False)
    p.insert(_regions(t).unionByName(_regions(t, "alias").filter("e <> 'region|2'")))
    p.delete(_regions(t))
    return rel.fact_text(rel.scan(p.facts(), a="tag"))


@query("SELECT 'add' AS change, r_name AS name FROM region WHERE r_regionkey >= 3 UNION ALL SELECT 'remove', r_name FROM region WHERE r_regionkey < 2")
def watch_program(t):
    """What a watch hears in a transaction that adds and removes."""
    heard: list[DataFrame] = []

    def handler(came: DataFrame, went: DataFrame) -> None:
        heard.append(came.select(F.lit("add").alias("change"), "name").unionByName(went.select(F.lit("remove").alias("change"), "name")))

    all_ = _regions(t)
    first, last = all_.filter("e < 'region|3'"), all_.filter("e >= 'region|3'")
    p = prog.Program(all_.sparkSession).watch("names", lambda f: rel.scan(f, a="name").select(F.col("v.s").alias("name")), handler)
    p.insert(first)
    p.input(last.select(F.lit("add").alias("op"), "e", "a", "v").unionByName(first.filter("e < 'region|2'").select(F.lit("remove").alias("op"), "e", "a", "v")))
    return heard[-1]


@query("SELECT 'region|' || r_regionkey AS e, 'label' AS a, upper(r_name) AS v FROM region")
def forward_program(t):
    """One program's matches are another's input; the rules come from a connector."""
    spark = t("region").sparkSession
    second, first = prog.Program(spark), prog.Program(spark)
    upper = lambda f: rel.scan(f, a="name").select("e", F.lit("label").alias("a"), rec.text(F.upper("v.s")).alias("v"))
    first.register("labels", lambda p: p.watch("labels", upper, prog.forward(second))).attach("labels").unregister("labels")
    first.insert(_regions(t))
    return rel.fact_text(second.facts())


@query("SELECT 'customer|' || c_custkey AS e, lower(c_mktsegment) AS a, CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END AS v FROM customer")
def commit_named_attribute(t):
    """A change whose attribute a column names."""
    rows = t("customer").withColumn("e", F.concat(F.lit("customer|"), F.col("c_custkey").cast("string")))
    change = rec.add_value(rows, F.col("e"), F.lower("c_mktsegment"), rec.number(F.col("c_acctbal")))
    return rel.fact_text(rec.apply_changes(rows.select("e", F.lit("x").alias("a"), rec.number(0).alias("v")).limit(0), change))


@query("SELECT 'region|' || r_regionkey AS e, r_name AS name FROM region")
def free_record(t):
    """Entities with an attribute, whatever they are."""
    return rel.records(_regions(t), ["name"]).select("e", F.col("name.s").alias("name"))


@query("""WITH b AS (SELECT r_name AS name, row_number() OVER (ORDER BY r_name) AS place FROM region),
a AS (SELECT r_name AS name, row_number() OVER (ORDER BY r_name) AS place FROM region WHERE r_name <> 'ASIA')
SELECT 'add' AS change, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'remove', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def re_rank(t):
    """Places change when a row goes; the difference tells which."""
    names = t("region").select(F.col("r_name").alias("name"))
    came, went = prog.difference(agg.gather_sort(names, ["name"], name="place"), agg.gather_sort(names.filter("name <> 'ASIA'"), ["name"], name="place"))
    return came.select(F.lit("add").alias("change"), "name", "place").unionByName(went.select(F.lit("remove").alias("change"), "name", "place"))


@query("SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN p_size END AS size FROM part ORDER BY size NULLS FIRST, p_partkey LIMIT 7")
def limit_n_nulls(t):
    """The first of all rows, whose projection may be null."""
    sized = t("part").select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("size"))
    return agg.limit_to(sized, ["size", "p_partkey"], 7)


@query("SELECT c_custkey, n FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN floor(c_acctbal)::BIGINT::VARCHAR ELSE 'none' END AS n FROM customer) WHERE try_cast(n AS DOUBLE) IS DISTINCT FROM c_acctbal")
def compare_mixed(t):
    """A number is unequal to a text that is another number, or none."""
    c = t("customer").withColumn("n", F.when(F.col("c_custkey") % 2 == 0, F.floor("c_acctbal").cast("string")).otherwise("none"))
    return c.filter(fn.not_equal(F.col("c_acctbal"), F.col("n"))).select("c_custkey", "n")


# Sources and streams.


@query("SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, (dayofweek(ts) + 1)::INT AS weekday, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, epoch_us(ts) // 1000 AS timestamp FROM events")
def timer_calendar(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = inputs.calendar(F.col("ts"))
    return e.select("event_id", *[c[n].alias(n) for n in ("year", "month", "day", "weekday", "hour", "minute", "second", "timestamp")])


@query("SELECT 'tag|region|r_regionkey|' || r_regionkey AS e, 'r_name' AS a, r_name AS v FROM region UNION ALL SELECT 'tag|region|r_regionkey|' || r_regionkey, 'r_regionkey', r_regionkey::VARCHAR FROM region UNION ALL SELECT 'tag|region|r_regionkey|' || r_regionkey, 'tag', 'region' FROM region")
def table_facts(t):
    return rel.fact_text(inputs.table_facts(t("region"), "region", ["r_regionkey"], ["r_name"]))


@query("SELECT r_name AS name, 'about ' || r_name AS contents, NULL::VARCHAR AS error FROM region UNION ALL SELECT 'missing', NULL, 'ENOENT'")
def file_read(t):
    """Texts written as files by name, then read back by path, with a path that has no file."""
    r = t("region")
    spark, folder = r.sparkSession, fresh_path(r.sparkSession, "files")
    done = outputs.write_texts(r.select(F.col("r_name").alias("name"), F.concat(F.lit("about "), F.col("r_name")).alias("contents")), folder)
    files = spark.read.format("binaryFile").load(f"{folder}/*/*.txt*").select("path", F.regexp_extract("path", "name=([^/]*)/", 1).alias("name"))
    paths = files.join(done.filter("complete"), "name").select("path", "name").unionByName(spark.range(1).select(F.lit(f"{folder}/none").alias("path"), F.lit("missing").alias("name")))
    read = inputs.read_texts(spark, paths).withColumn("contents", F.rtrim(F.col("contents"), F.lit("\n")))
    return read.join(paths, "path").select(F.url_decode(F.regexp_replace("name", r"\+", "%2B")).alias("name"), "contents", "error")


@query("SELECT (SELECT count(*) FROM customer) AS n")
def random_ids(t):
    """As many ids as rows."""
    return inputs.random_ids(t("customer")).agg(F.countDistinct("id").alias("n"))


@query("SELECT * FROM (VALUES ('B', 'tag', 'input'), ('B', 'arg0', '2'), ('B', 'arg1', 'foo'), ('C', 'tag', 'input')) AS f(e, a, v)")
def input_notation(t):
    """Two transactions of the test notation."""
    p = prog.Program(t("region").sparkSession)
    for change in inputs.sequence_changes(p.spark, "+A +B:2:foo;-A +C"):
        p.input(change)
    return rel.fact_text(p.facts())


@query("""WITH e AS (SELECT ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)
SELECT 'timer' AS e, a, v FROM (SELECT [['tag', 'timer'], ['year', year(ts)::VARCHAR], ['month', month(ts)::VARCHAR], ['day', day(ts)::VARCHAR], ['weekday', (dayofweek(ts) + 1)::VARCHAR], ['hour', hour(ts)::VARCHAR],
['minute', minute(ts)::VARCHAR], ['second', second(ts)::VARCHAR], ['millisecond', '0'], ['timestamp', ((epoch_us(ts) // 1000000) * 1000)::VARCHAR]] AS l FROM e), (SELECT unnest(range(1, 11)) AS k), LATERAL (SELECT l[k][1] AS a, l[k][2] AS v)""")
def timer_ticks(t):
    """Two ticks after each other: of the first nothing is left."""
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    ticks = e.select(F.col("event_id").alias("tick"), *[c.alias(n) for n, c in inputs.calendar(F.col("ts")).items()])
    p = prog.Program(e.sparkSession)
    for part in (ticks.filter("tick % 7 = 0"), ticks):
        p.input(inputs.tick_changes(part))
    return rel.fact_text(p.facts()).filter("a <> 'tick'")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def _stream(f: Callable, sql: str) -> None:
    QUERIES[f.__name__], SQL[f.__name__] = f, sql


def stream_events_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner.counts_of(spark, _event_stream(spark, sf_dir), ["event_type"])


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner.latest_of(spark, _event_stream(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


_stream(stream_events_count, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
_stream(stream_latest, "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
