"""The queries offered for the engine's own operators, with the SQL that states their results.

Answers are compared where they are deterministic: with a mutual-information bound of 0 the engine releases
world 0, and without noise the elastic mode releases clipped aggregates. The hash is then md5, which any engine has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import PrivacyError
from ..config import PrivacyConfig
from ..engine import PrivacySession
from ..functions import noise, pu_hash, worlds
from ..operators.diff import utility_diff
from ..sources import register_parquet
from ..streaming import windowed_counters

BASE = (
    "ALTER TABLE customer ADD PRIVACY_KEY (c_custkey)", "ALTER TABLE customer SET PU", "ALTER PU TABLE customer ADD PROTECTED (c_custkey, c_name, c_acctbal)",
    "ALTER TABLE orders ADD PRIVACY_LINK (o_custkey) REFERENCES customer(c_custkey)", "ALTER TABLE lineitem ADD PRIVACY_LINK (l_orderkey) REFERENCES orders(o_orderkey)",
)
SUPPLIER = ("ALTER TABLE supplier ADD PRIVACY_KEY (s_suppkey)", "ALTER TABLE supplier SET PU", "ALTER TABLE lineitem ADD PRIVACY_LINK (l_suppkey) REFERENCES supplier(s_suppkey)")
LINES = ("ALTER TABLE lineitem ADD PRIVACY_KEY (l_orderkey, l_linenumber)", "ALTER TABLE lineitem SET PU", "ALTER PU TABLE lineitem ADD PROTECTED (l_extendedprice)")
EXACT = {"pac_mi": 0.0, "pac_hash": "md5"}
ELASTIC = {"privacy_mode": "dp_elastic", "privacy_noise": False, "dp_sum_bound": 1000.0}
QH = PrivacyConfig(**EXACT).query_hash


def world(key: str, j: int = 0, qh: int = QH) -> str:
    """SQL: whether the unit of this key is in world j."""
    at, shift = (9, j) if j < 32 else (1, j - 32)
    return f"(((CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), {at}, 8) AS BIGINT) >> {shift}) & 1) = {1 ^ (qh >> j & 1)})"


def popcount(key: str) -> str:
    """SQL: in how many worlds the unit is."""
    half = lambda at, bits: f"bit_count(xor(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), {at}, 8) AS BIGINT), {bits}))"
    return f"({half(1, QH >> 32)} + {half(9, QH & 0xFFFFFFFF)})"


def tidy(df: DataFrame, digits: int = 2) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def session(spark: SparkSession, sf_dir: str, settings: dict, policy: tuple[str, ...] = BASE) -> PrivacySession:
    register_parquet(spark, sf_dir)
    s = PrivacySession(spark, PrivacyConfig(**settings))
    for line in policy:
        s.sql(line)
    return s


def run(sql: str, settings: dict | None = None, policy: tuple[str, ...] = BASE, digits: int = 2) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tidy(session(spark, sf_dir, EXACT if settings is None else settings, policy).sql(sql), digits)


C, O = world("c_custkey"), world("o_custkey")
LO = "lineitem JOIN orders ON l_orderkey = o_orderkey"
SQL: dict[str, tuple] = {}  # name: (query, settings, policy, statement of the result)


def add(name: str, query: str, truth: str, settings: dict | None = None, policy: tuple[str, ...] = BASE) -> None:
    SQL[name] = (query, settings, policy, truth)


def s2(value: str, bit: str) -> str:
    return f"round(2 * coalesce(sum(CASE WHEN {bit} THEN {value} END), 0), 2)"


def c2(bit: str, cond: str = "TRUE") -> str:
    return f"2 * count(CASE WHEN {bit} AND {cond} THEN 1 END)"


add(
    "pac_sum_fk_chain", "SELECT l_returnflag, l_linestatus, sum(l_extendedprice) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus",
    f"SELECT l_returnflag, l_linestatus, {s2('l_extendedprice', O)} AS total FROM {LO} GROUP BY ALL",
)
add("pac_count_direct", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment", f"SELECT c_mktsegment, {c2(C)} AS n FROM customer GROUP BY ALL")
add(
    "pac_avg", "SELECT c_mktsegment, avg(c_acctbal) AS a FROM customer GROUP BY c_mktsegment",
    f"SELECT c_mktsegment, round(sum(CASE WHEN {C} THEN c_acctbal END) / count(CASE WHEN {C} THEN c_acctbal END), 2) AS a FROM customer GROUP BY ALL",
)
for f in ("min", "max"):
    add(f"pac_{f}", f"SELECT c_mktsegment, {f}(c_acctbal) AS v FROM customer GROUP BY c_mktsegment", f"SELECT c_mktsegment, round(coalesce({f}(CASE WHEN {C} THEN c_acctbal END), 0), 2) AS v FROM customer GROUP BY ALL")
add(
    "pac_group_having", "SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS t FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority HAVING count(*) > 10 ORDER BY t DESC",
    f"SELECT * FROM (SELECT o_orderpriority, {c2(O)} AS n, {s2('o_totalprice', O)} AS t FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL) WHERE n > 10",
)
add(
    "pac_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS d FROM lineitem GROUP BY l_returnflag",
    f"SELECT l_returnflag, 2 * count(DISTINCT CASE WHEN {O} THEN l_partkey END) AS d FROM {LO} GROUP BY ALL",
)
add(
    "pac_mixed_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS d, sum(DISTINCT l_quantity) AS q, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY l_returnflag",
    f"SELECT l_returnflag, 2 * count(DISTINCT CASE WHEN {O} THEN l_partkey END) AS d, 2 * sum(DISTINCT CASE WHEN {O} THEN l_quantity END) AS q, {c2(O)} AS n, {s2('l_quantity', O)} AS s FROM {LO} GROUP BY ALL",
)
S = world("l_suppkey")
add(
    "pac_multi_pu", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q, min(l_quantity) AS lo FROM lineitem GROUP BY l_returnflag",
    f"SELECT l_returnflag, 4 * count(CASE WHEN {O} AND {S} THEN 1 END) AS n, 4 * sum(CASE WHEN {O} AND {S} THEN l_quantity END) AS q, min(CASE WHEN {O} AND {S} THEN l_quantity END) AS lo FROM {LO} GROUP BY ALL",
    policy=BASE + SUPPLIER,
)
both = f"(({world('l_orderkey', 0, 0)}) <> ({world('l_linenumber', 0, 0)})) = {'FALSE' if QH & 1 else 'TRUE'}"
add(
    "pac_composite_key", "SELECT l_linestatus, count(*) AS n, sum(l_tax) AS t FROM lineitem GROUP BY l_linestatus",
    f"SELECT l_linestatus, {c2(both)} AS n, {s2('l_tax', both)} AS t FROM lineitem GROUP BY ALL", policy=LINES,
)
add(
    "pac_q01",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    f"SELECT l_returnflag, l_linestatus, {s2('l_quantity', O)} AS sum_qty, {s2('l_extendedprice', O)} AS sum_base, {s2('l_extendedprice * (1 - l_discount)', O)} AS sum_disc, round(avg(CASE WHEN {O} THEN l_quantity END), 2) AS avg_qty, round(avg(CASE WHEN {O} THEN l_discount END), 2) AS avg_disc, {c2(O)} AS n FROM {LO} WHERE l_shipdate <= DATE '2000-09-02' GROUP BY ALL",
)
add(
    "pac_q04", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-04-01' AND EXISTS (SELECT 1 FROM part WHERE p_size > 10) GROUP BY o_orderpriority",
    f"SELECT o_orderpriority, {c2(O)} AS n FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-04-01' GROUP BY ALL",
)
add(
    "pac_q05", "SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey = 1 AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name",
    f"SELECT n_name, {s2('l_extendedprice * (1 - l_discount)', C)} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey = 1 AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY ALL",
)
add(
    "pac_q06", "SELECT sum(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    f"SELECT {s2('l_extendedprice * l_discount', O)} AS revenue FROM {LO} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
)
add(
    "pac_q08_ratio", "SELECT year(o_orderdate) AS y, sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY year(o_orderdate)",
    f"SELECT CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(CASE WHEN {O} AND p_type = 'PROMO' THEN l_extendedprice ELSE 0 END) / sum(CASE WHEN {O} THEN l_extendedprice END), 2) AS share FROM {LO} JOIN part ON l_partkey = p_partkey GROUP BY ALL",
)
add(
    "pac_q12_case", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority <> '1-URGENT' THEN 1 ELSE 0 END) AS low FROM orders, lineitem WHERE o_orderkey = l_orderkey GROUP BY l_linestatus",
    f"SELECT l_linestatus, {c2(O, chr(111) + '_orderpriority = ' + repr('1-URGENT'))} AS high, {c2(O, 'o_orderpriority <> ' + repr('1-URGENT'))} AS low FROM {LO} GROUP BY ALL",
)
add(
    "pac_q13_passthrough", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY c_count",
    f"SELECT c_count, {c2(C)} AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY c_count",
)
add(
    "pac_q14_ratio", "SELECT 100.0 * sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)) AS promo FROM lineitem, part WHERE l_partkey = p_partkey",
    f"SELECT round(100.0 * sum(CASE WHEN {O} AND p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(CASE WHEN {O} THEN l_extendedprice * (1 - l_discount) END), 2) AS promo FROM {LO}, part WHERE l_partkey = p_partkey",
)
add(
    "pac_q15_cte", "WITH revenue AS (SELECT l_returnflag AS f, sum(l_extendedprice) AS total FROM lineitem GROUP BY l_returnflag) SELECT max(total) AS best FROM revenue",
    f"SELECT max(total) AS best FROM (SELECT l_returnflag, {s2('l_extendedprice', O)} AS total FROM {LO} GROUP BY ALL)",
)
add(
    "pac_q19_or", "SELECT sum(l_extendedprice) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_size < 10 AND l_quantity < 10) OR (p_size > 30 AND l_quantity > 30))",
    f"SELECT {s2('l_extendedprice', O)} AS revenue FROM {LO}, part WHERE p_partkey = l_partkey AND ((p_size < 10 AND l_quantity < 10) OR (p_size > 30 AND l_quantity > 30))",
)
add(
    "pac_q22_select", "SELECT count(*) AS n, sum(c_acctbal) AS t FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)",
    f"WITH a AS (SELECT avg(c_acctbal) AS m FROM customer WHERE c_acctbal > 0 AND {C}) SELECT {c2(C)} AS n, {s2('c_acctbal', C)} AS t FROM customer, a WHERE c_acctbal > m",
)
add(
    "pac_in_subquery", "SELECT count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    f"SELECT {c2(O)} AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
)
add(
    "pac_q17_correlated", "SELECT sum(l_extendedprice) AS t, count(*) AS n FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 25 AND l_quantity < (SELECT avg(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)",
    f"WITH a AS (SELECT l_partkey AS k, avg(l_quantity) AS m FROM {LO} WHERE {O} GROUP BY ALL) SELECT {s2('l_extendedprice', O)} AS t, {c2(O)} AS n FROM {LO} JOIN part ON p_partkey = l_partkey JOIN a ON k = p_partkey WHERE p_size < 25 AND l_quantity < m",
)
add(
    "pac_q20_scaled", "SELECT count(*) AS n FROM lineitem, part WHERE p_partkey = l_partkey AND l_quantity > (SELECT 0.05 * sum(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)",
    f"WITH a AS (SELECT l_partkey AS k, 0.05 * 2 * sum(l_quantity) AS m FROM {LO} WHERE {O} GROUP BY ALL) SELECT {c2(O)} AS n FROM {LO} JOIN part ON p_partkey = l_partkey JOIN a ON k = p_partkey WHERE l_quantity > m",
)
add(
    "pac_q21_exists", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority",
    f"SELECT o_orderpriority, {c2(O)} AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY ALL",
)
add(
    "pac_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    f"SELECT o_orderstatus, o_orderpriority, {c2(O)} AS n, {s2('o_totalprice', O)} AS t FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
)
add(
    "pac_functions_in_sql", "SELECT o_orderstatus, pac_noised_sum(pac_hash(CAST(conv(substr(md5(CAST(o_custkey AS STRING)), 1, 16), 16, -10) AS BIGINT)), o_totalprice) AS t, pac_mean(pac_count(pac_hash(CAST(conv(substr(md5(CAST(o_custkey AS STRING)), 1, 16), 16, -10) AS BIGINT)))) AS m FROM orders GROUP BY o_orderstatus",
    f"SELECT o_orderstatus, {s2('o_totalprice', O)} AS t, round(2 * sum({popcount('o_custkey')}) / 64.0, 2) AS m FROM orders GROUP BY ALL",
)
P = f"sum(o_totalprice * {popcount('o_custkey')})"
for name, extra in (("pac_topk", {}), ("pac_topk_expansion", {"pac_topk_expansion": 2.0})):
    top = f"SELECT n_name, 2 * sum(CASE WHEN {C} THEN o_totalprice END) AS t, {P} AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY m DESC LIMIT {10 if extra else 5}"
    add(
        name, "SELECT n_name, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY t DESC LIMIT 5",
        f"SELECT n_name, round(t, 2) AS t FROM ({top}) ORDER BY t DESC LIMIT 5", EXACT | extra,
    )
add(
    "pac_union_all", "SELECT p, count(*) AS n FROM (SELECT o_orderpriority AS p, o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderpriority, o_custkey FROM orders WHERE o_totalprice > 100000) u GROUP BY p",
    f"SELECT p, {c2(O)} AS n FROM (SELECT o_orderpriority AS p, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderpriority, o_custkey FROM orders WHERE o_totalprice > 100000) u GROUP BY p",
)
add(
    "pac_filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 50000) AS n, sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS t FROM orders GROUP BY o_orderstatus",
    f"SELECT o_orderstatus, {c2(O, 'o_totalprice > 50000')} AS n, {s2('o_totalprice', O + ' AND o_orderpriority = ' + repr('1-URGENT'))} AS t FROM orders GROUP BY ALL",
)
add("pac_rollup_free_group", "SELECT o_orderstatus, o_orderpriority, max(o_orderdate) AS d FROM orders GROUP BY o_orderstatus, o_orderpriority", f"SELECT o_orderstatus, o_orderpriority, max(CASE WHEN {O} THEN o_orderdate END) AS d FROM orders GROUP BY ALL")
add("pac_not_in", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY o_orderstatus", f"SELECT o_orderstatus, {c2(O)} AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY ALL")
_SOME_NULL = "(o_orderkey NOT IN (SELECT CASE WHEN l_quantity > 49 THEN NULL ELSE l_orderkey END FROM lineitem WHERE l_quantity > 45)) IS NULL"
add("pac_not_in_null", f"SELECT o_orderstatus, count(*) AS n FROM orders WHERE {_SOME_NULL} GROUP BY o_orderstatus", f"SELECT o_orderstatus, {c2(O)} AS n FROM orders WHERE {_SOME_NULL} GROUP BY ALL")
_ODD = "'a  b' AS a, 'x -- y' AS b, '/* c */' AS c"
add("pac_literals", f"SELECT o_orderpriority, {_ODD}, count(*) AS n FROM orders -- of all\nWHERE o_orderpriority <> '4-NOT  SPECIFIED' /* one blank too many */ GROUP BY o_orderpriority;", f"SELECT o_orderpriority, {_ODD}, {c2(O)} AS n FROM orders GROUP BY o_orderpriority")
add(
    "pac_distinct_filters", "SELECT o_orderstatus, count(DISTINCT o_orderdate) FILTER (WHERE o_totalprice > 200000) AS a, count(DISTINCT o_orderdate) FILTER (WHERE o_totalprice > 100000) AS b, count(DISTINCT o_orderdate) AS c FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderstatus, " + ", ".join(f"2 * count(DISTINCT CASE WHEN {O} AND o_totalprice > {x} THEN o_orderdate END) AS {n}" for n, x in (("a", 200000), ("b", 100000), ("c", -1))) + " FROM orders GROUP BY ALL",
)
add(
    "pac_right_join", "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS t FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_nationkey < 5 GROUP BY o_orderstatus",
    f"SELECT o_orderstatus, {c2(O)} AS n, {s2('o_totalprice', O)} AS t FROM orders GROUP BY ALL",
)
add(
    "pac_join_counters", "SELECT l_linestatus, count(*) AS n, sum(l_tax) AS t FROM lineitem JOIN (SELECT l_returnflag AS f, avg(l_quantity) AS a FROM lineitem GROUP BY l_returnflag) m ON l_returnflag = f AND l_quantity < a GROUP BY l_linestatus",
    f"WITH m AS (SELECT l_returnflag AS f, avg(l_quantity) AS a FROM {LO} WHERE {O} GROUP BY ALL) SELECT l_linestatus, {c2(O)} AS n, {s2('l_tax', O)} AS t FROM {LO} JOIN m ON l_returnflag = f WHERE l_quantity < a GROUP BY ALL",
)
add(
    "pac_join_subquery", "SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity > (SELECT avg(l_quantity) FROM lineitem)",
    f"WITH m AS (SELECT avg(l_quantity) AS a FROM {LO} WHERE {O}) SELECT {c2(O)} AS n FROM {LO} JOIN part ON l_partkey = p_partkey, m WHERE l_quantity > a",
)
add(
    "pac_voted_filter", "SELECT r_regionkey FROM region WHERE r_regionkey * 400 < (SELECT count(*) FROM customer)",
    "SELECT r_regionkey FROM region, (SELECT " + ", ".join(f"{c2(world('c_custkey', j))} AS c{j}" for j in range(64)) + " FROM customer) WHERE " + " + ".join(f"CAST(r_regionkey * 400 < c{j} AS INTEGER)" for j in range(64)) + " >= 32",
)
add(
    "pac_window_released", "SELECT m, n, sum(n) OVER () AS total, rank() OVER (ORDER BY n, m) AS r FROM (SELECT c_mktsegment AS m, count(*) AS n FROM customer GROUP BY c_mktsegment) x",
    f"SELECT m, n, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(rank() OVER (ORDER BY n, m) AS INTEGER) AS r FROM (SELECT c_mktsegment AS m, {c2(C)} AS n FROM customer GROUP BY ALL) x", EXACT | {"pac_conservative_mode": False},
)
for name, sets in (("pac_cube", "CUBE (o_orderstatus, o_orderpriority)"), ("pac_grouping_sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")):
    add(name, f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY {sets}", f"SELECT o_orderstatus, o_orderpriority, {c2(O)} AS n FROM orders GROUP BY {sets}")
add(
    "pac_lambda_argument", "SELECT o_orderstatus, sum(aggregate(transform(array(o_totalprice, 1D), x -> x + 1), 0D, (a, x) -> a + x)) AS t FROM orders GROUP BY o_orderstatus",
    f"SELECT o_orderstatus, {s2('(o_totalprice + 3)', O)} AS t FROM orders GROUP BY ALL",
)
add(
    "pac_scalar_functions", "SELECT date_trunc('YEAR', o_orderdate) AS y, substring(o_orderpriority, 1, 1) AS p, count(*) AS n, sum(CASE WHEN o_orderpriority LIKE '%URGENT' THEN o_totalprice ELSE 0 END) AS t FROM orders WHERE regexp_replace(o_orderpriority, '[0-9]-', '') <> 'LOW' AND length(o_orderpriority) BETWEEN 5 AND 20 GROUP BY 1, 2",
    f"SELECT date_trunc('year', o_orderdate) AS y, substr(o_orderpriority, 1, 1) AS p, {c2(O)} AS n, round(2 * sum(CASE WHEN {O} AND o_orderpriority LIKE '%URGENT' THEN o_totalprice ELSE 0 END), 2) AS t FROM orders WHERE regexp_replace(o_orderpriority, '[0-9]-', '') <> 'LOW' AND length(o_orderpriority) BETWEEN 5 AND 20 GROUP BY 1, 2",
)
add("pac_select_distinct", "SELECT count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders) x", f"SELECT {c2(O)} AS n FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders) x")
add("pac_theta_join", "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey < n_nationkey", f"SELECT {c2(C)} AS n FROM customer JOIN nation ON c_nationkey < n_nationkey")
add("pac_unset_unit", "SELECT c_mktsegment, sum(c_acctbal) AS t FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS t FROM customer GROUP BY ALL", None, (*BASE, "ALTER TABLE customer UNSET PU"))
_HC = "pac_hash(CAST(conv(substr(md5(CAST(c_custkey AS STRING)), 1, 16), 16, -10) AS BIGINT))"
add(
    "pac_division_in_sql", f"SELECT c_mktsegment, pac_noised_div(pac_sum({_HC}, c_acctbal), pac_count({_HC})) AS a, pac_noised_avg({_HC}, c_acctbal) AS b, pac_mean(pac_coalesce(pac_count({_HC}))) AS m FROM customer GROUP BY c_mktsegment",
    f"SELECT c_mktsegment, round(avg(CASE WHEN {C} THEN c_acctbal END), 2) AS a, round(avg(CASE WHEN {C} THEN c_acctbal END), 2) AS b, round(2 * sum({popcount('c_custkey')}) / 64.0, 2) AS m FROM customer GROUP BY ALL",
)
add(
    "pac_list_count_in_sql", f"SELECT pac_mean(pac_count(c)) AS n, pac_mean(pac_sum(c)) AS t FROM (SELECT c_mktsegment, pac_count({_HC}) AS c FROM customer GROUP BY c_mktsegment) x",
    f"SELECT CAST(count(DISTINCT c_mktsegment) AS DOUBLE) AS n, round(2 * sum({popcount('c_custkey')}) / 64.0, 2) AS t FROM customer",
)
add("plain_passthrough", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL")
add("noise_off_exact", "SELECT c_mktsegment, sum(c_acctbal) AS t FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS t FROM customer GROUP BY ALL", {"privacy_noise": False})

_UNITS = "(SELECT c_mktsegment AS g, c_custkey AS k, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
_LEVELS = f"""WITH u AS {_UNITS}, l AS (SELECT *, v < 0 AS neg, CASE WHEN abs(v) < 256 THEN 0 ELSE least(CAST(floor((floor(log2(abs(v))) - 4) / 2) AS INTEGER), 29) END AS lv FROM u),
n AS (SELECT g, neg, lv, count(*) AS n FROM l GROUP BY ALL), e AS (SELECT g, neg, min(lv) AS a, max(lv) AS b FROM n WHERE n >= {{support}} GROUP BY ALL)
"""
_KEPT = "FROM l JOIN e USING (g, neg) WHERE lv BETWEEN a AND b"
K = world("k")
add(
    "pac_clip_sum", "SELECT c_mktsegment AS g, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    _LEVELS.format(support=40) + f"SELECT g, t FROM (SELECT DISTINCT g FROM u) LEFT JOIN (SELECT g, {s2('v', K)} AS t {_KEPT} GROUP BY g) USING (g)", EXACT | {"pac_clip_support": 40},
)
add(
    "pac_clip_minmax", "SELECT c_mktsegment AS g, max(t) AS hi, min(t) AS lo FROM (SELECT c_mktsegment, c_custkey, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey) x GROUP BY c_mktsegment",
    _LEVELS.format(support=40) + f"SELECT g, hi, lo FROM (SELECT DISTINCT g FROM u) LEFT JOIN (SELECT g, round(max(CASE WHEN {K} THEN v END), 2) AS hi, round(min(CASE WHEN {K} THEN v END), 2) AS lo {_KEPT} GROUP BY g) USING (g)", EXACT | {"pac_clip_support": 40},
)

_ACCOUNTS = _LEVELS.replace(_UNITS, "(SELECT c_mktsegment AS g, c_custkey AS k, c_acctbal AS v FROM customer)").format(support=20)
add(
    "pac_clip_in_sql", f"SELECT c_mktsegment AS g, pac_noised_clip_sum({_HC}, c_acctbal) AS t, pac_noised_clip_max({_HC}, c_acctbal) AS hi, pac_noised_clip_min({_HC}, c_acctbal) AS lo, pac_noised_clip_sumcount({_HC}, 1) AS n FROM customer GROUP BY c_mktsegment",
    _ACCOUNTS + f"SELECT g, t, hi, lo, n FROM (SELECT g, {c2(K)} AS n FROM u GROUP BY g) LEFT JOIN (SELECT g, {s2('v', K)} AS t, round(max(CASE WHEN {K} THEN v END), 2) AS hi, round(min(CASE WHEN {K} THEN v END), 2) AS lo {_KEPT} GROUP BY g) USING (g)", EXACT | {"pac_clip_support": 20},
)
add(
    "pac_clip_unsupported", "SELECT c_nationkey AS g, sum(c_acctbal) AS t FROM customer GROUP BY c_nationkey",
    "SELECT DISTINCT c_nationkey AS g, CAST(NULL AS DOUBLE) AS t FROM customer", EXACT | {"pac_clip_support": 1_000_000},
)

B = "greatest(least({}, 1000), -1000)"
add("dp_count", "SELECT count(*) AS n FROM orders", "SELECT count(*) AS n FROM orders", ELASTIC)
add("dp_sum_clip", "SELECT o_orderstatus, sum(o_totalprice) AS t FROM orders GROUP BY o_orderstatus", f"SELECT o_orderstatus, round(sum({B.format('o_totalprice')}), 2) AS t FROM orders GROUP BY ALL", ELASTIC)
add("dp_avg", "SELECT c_mktsegment, avg(c_acctbal) AS a FROM customer GROUP BY c_mktsegment", f"SELECT c_mktsegment, round(sum({B.format('c_acctbal')}) / count(*), 2) AS a FROM customer GROUP BY ALL", ELASTIC)
add(
    "dp_multi", f"SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q, avg(l_extendedprice) AS a FROM {LO} GROUP BY l_returnflag",
    f"SELECT l_returnflag, count(*) AS n, round(sum({B.format('l_quantity')}), 2) AS q, round(sum({B.format('l_extendedprice')}) / count(*), 2) AS a FROM {LO} GROUP BY ALL", ELASTIC,
)
add("dp_having_avg", "SELECT l_linenumber, avg(l_quantity) AS a FROM lineitem GROUP BY l_linenumber HAVING avg(l_quantity) > 25", f"SELECT * FROM (SELECT l_linenumber, round(sum({B.format('l_quantity')}) / count(*), 2) AS a FROM lineitem GROUP BY ALL) WHERE a > 25", ELASTIC)
add("dp_filter_clause", "SELECT o_orderstatus, sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS t FROM orders GROUP BY o_orderstatus", f"SELECT o_orderstatus, round(sum({B.format('o_totalprice')}) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS t FROM orders GROUP BY ALL", ELASTIC)
add("dp_implicit_chain", "SELECT l_linestatus, count(l_quantity) AS n FROM lineitem WHERE l_discount > 0.02 GROUP BY l_linestatus", "SELECT l_linestatus, count(l_quantity) AS n FROM lineitem WHERE l_discount > 0.02 GROUP BY ALL", ELASTIC)
add("dp_tau_noise", "SELECT p FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY o_orderpriority) x", "SELECT DISTINCT o_orderpriority AS p FROM orders", {"privacy_mode": "dp_elastic", "dp_epsilon": 20.0, "privacy_min_group_count": 3.0, "privacy_seed": 7})
add("dp_tau_withheld", "SELECT p FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY o_orderpriority) x", "SELECT o_orderpriority AS p FROM orders WHERE FALSE", {"privacy_mode": "dp_elastic", "privacy_min_group_count": 1e6, "privacy_seed": 7})
add("dp_tau_off", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL", ELASTIC | {"privacy_min_group_count": 3.0})

NOISY = {
    "noise_gaussian": ("SELECT o_orderpriority, sum(o_totalprice) AS t, count(*) AS n FROM orders GROUP BY o_orderpriority", {"privacy_seed": 7}),
    "noise_untracked": ("SELECT o_orderpriority, sum(o_totalprice) AS t FROM orders GROUP BY o_orderpriority", {"pac_ptracking": False, "privacy_seed": 7}),
    "noise_laplace": ("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", {"privacy_mode": "dp_elastic", "dp_delta": 1e-6, "privacy_seed": 7}),
    "noise_repaired_hash": ("SELECT count(*) AS n FROM customer", {"pac_hash_repair": True, "privacy_seed": 7}),
    "noise_min_group": ("SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY l_linenumber", {"privacy_min_group_count": 2.0, "privacy_seed": 7}),
}

COMPARISONS = {
    "gt": (lambda a, b: a > b, ">"), "gte": (lambda a, b: a >= b, ">="), "lt": (lambda a, b: a < b, "<"),
    "lte": (lambda a, b: a <= b, "<="), "eq": (lambda a, b: a == b, "="), "neq": (lambda a, b: a != b, "<>"),
}

REFUSED = {
    "protected_output": ("SELECT c_name FROM customer", "can only be accessed inside aggregate functions"),
    "link_output": ("SELECT o_custkey FROM orders", "can only be accessed inside aggregate functions"),
    "no_aggregate": ("SELECT o_orderstatus FROM orders", "does not contain any allowed aggregation"),
    "window": ("SELECT sum(o_totalprice) OVER (PARTITION BY o_orderstatus) AS t FROM orders", "window functions are not supported"),
    "except": ("SELECT count(*) AS n FROM (SELECT o_orderstatus FROM orders EXCEPT SELECT l_linestatus FROM lineitem) x", "subqueries are not supported"),
    "full_join": ("SELECT count(*) AS n FROM orders FULL OUTER JOIN lineitem ON o_orderkey = l_orderkey", "subqueries are not supported"),
    "unsupported": ("SELECT stddev(o_totalprice) AS s, count(*) AS n FROM orders", "unsupported aggregate function"),
    "union_root": ("SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation", "can only be accessed inside aggregate functions"),
    "list_of_names": ("SELECT collect_list(c_name) AS x FROM customer", "can only be accessed inside aggregate functions"),
    "first_name": ("SELECT first(c_name) AS x FROM customer", "can only be accessed inside aggregate functions"),
    "deviation": ("SELECT stddev(c_acctbal) AS x FROM customer", "can only be accessed inside aggregate functions"),
    "unlisted_aggregate": ("SELECT approx_count_distinct(c_mktsegment) AS x FROM customer", "unsupported aggregate function"),
    "name_by_subquery": ("SELECT r_name, (SELECT c_name FROM customer WHERE c_custkey = 1) AS x FROM region", "can only be accessed inside aggregate functions"),
    "name_by_lateral_view": ("SELECT x FROM customer LATERAL VIEW explode(array(c_name)) t AS x", "can only be accessed inside aggregate functions"),
    "lateral_view": ("SELECT count(x) AS n FROM customer LATERAL VIEW explode(array(c_name)) t AS x", "a table function is not supported"),
    "sum_beside_counters": ("SELECT sum(c_acctbal) AS s, pac_noised_count(pac_hash(xxhash64(c_custkey))) AS n FROM customer", "no other aggregate of private rows"),
    "counters_of_no_key": ("SELECT pac_noised_sum(7, c_acctbal) AS s FROM customer", "must be made of the privacy unit's key"),
    "counters_of_other_column": ("SELECT pac_noised_sum(xxhash64(c_mktsegment), c_acctbal) AS s FROM customer", "must be made of the privacy unit's key"),
    "window_of_balances": ("SELECT sum(c_acctbal) OVER () AS t FROM customer", "can only be accessed inside aggregate functions"),
    "window_of_rows": ("SELECT row_number() OVER (ORDER BY c_mktsegment) AS t FROM customer", "window functions are not supported"),
    "group_by_key": ("SELECT c_custkey, count(*) AS n FROM customer GROUP BY c_custkey", "can only be accessed inside aggregate functions"),
}


def reject_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, EXACT)
    rows = []
    for name, (sql, part) in REFUSED.items():
        try:
            s.sql(sql)
            rows.append((name, False))
        except PrivacyError as e:
            rows.append((name, part in str(e)))
    return spark.createDataFrame(rows, "query string, refused boolean")


def counters_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    h = pu_hash([F.col("o_custkey")], PrivacyConfig(**EXACT))
    lists = orders.withColumn("h", h).groupBy("o_orderstatus").agg(worlds.pac_sum(F.col("h"), F.col("o_totalprice")).alias("c"))
    return tidy(lists.select("o_orderstatus", F.posexplode("c").alias("world", "value")))


def list_reaggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    h = pu_hash([F.col("o_custkey")], PrivacyConfig(**EXACT))
    lists = orders.withColumn("h", h).groupBy("o_orderstatus", "o_orderpriority").agg(worlds.pac_count(F.col("h")).alias("c"))
    over = lists.groupBy("o_orderstatus").agg(worlds.pac_sum_list(F.col("c")).alias("s"), worlds.pac_max_list(F.col("c")).alias("m"))
    return tidy(over.select("o_orderstatus", F.posexplode(F.arrays_zip("s", "m")).alias("world", "z")).select("o_orderstatus", "world", "z.s", "z.m"))


def filter_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose counters exceed a value in most worlds."""
    cfg = PrivacyConfig(**EXACT)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    lists = orders.withColumn("h", pu_hash([F.col("c_custkey")], cfg)).groupBy("c_nationkey").agg(worlds.pac_count(F.col("h")).alias("c"), F.count("*").alias("n"))
    limit = orders.groupBy("c_nationkey").count().agg(F.avg("count").alias("limit"))
    return lists.crossJoin(F.broadcast(limit)).filter(worlds.pac_filter_cmp("lt", F.col("limit"), F.col("c"), cfg)).select("c_nationkey", "n")  # limit is one row


def derived_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, EXACT)
    name = f"mv_{uuid.uuid4().hex}"
    s.sql(f"CREATE TABLE {name} AS SELECT o_orderpriority AS p, sum(o_totalprice) AS t, count(*) AS n FROM orders GROUP BY o_orderpriority")
    return tidy(s.sql(f"SELECT p, t, n FROM {name}"), 0)


def selected_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worlds that each comparison with the world's own number leaves of a unit's hash."""
    h, numbers = pu_hash([F.col("c_custkey")], PrivacyConfig(**EXACT)), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: j.cast("double"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("h", h)
    return rows.groupBy("c_mktsegment").agg(*[F.sum(F.bit_count(getattr(worlds, f"pac_select_{op}")(F.col("h"), F.lit(20.0), numbers))).cast("long").alias(op) for op in COMPARISONS])


def filter_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the worlds on each comparison of a number with a group's count."""
    cfg = PrivacyConfig(**EXACT)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("h", pu_hash([F.col("c_custkey")], cfg))
    lists = rows.groupBy("c_nationkey").agg(worlds.pac_count(F.col("h")).alias("c"), F.count("*").alias("n"))
    return lists.select("c_nationkey", *[getattr(worlds, f"pac_filter_{op}")(F.col("n"), F.col("c"), cfg).alias(op) for op in COMPARISONS])


def derived_reads(sql: str, digits: int = 0) -> Callable[[SparkSession, str], DataFrame]:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, EXACT)
        name = f"mv_{uuid.uuid4().hex}"
        s.sql(f"CREATE TABLE {name} AS SELECT o_orderpriority AS p, o_orderstatus AS s, sum(o_totalprice) AS t, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority, o_orderstatus")
        s.sql(f"INSERT INTO {name} SELECT o_orderpriority, o_orderstatus, sum(o_totalprice), count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderpriority, o_orderstatus")
        return tidy(s.sql(sql.format(name)), digits)

    return make


def renamed_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows copied under new names keep their unit: the copy's answers are as private as the original's."""
    s = session(spark, sf_dir, EXACT)
    name = f"copy_{uuid.uuid4().hex}"
    s.sql(f"CREATE TABLE {name} AS SELECT o_custkey AS who, o_orderstatus AS s, o_totalprice AS price FROM orders")
    return tidy(s.sql(f"SELECT s, sum(price) AS t, count(*) AS n FROM {name} GROUP BY s"))


def window_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of time windows, as a stream keeps them, released window by window."""
    cfg = PrivacyConfig(**EXACT)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    counted = windowed_counters(events, "at", "1 day", "1 hour", pu_hash([F.col("user_id")], cfg), F.col("value"), ["event_type"])
    out = counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", noise.release(F.col("counters"), F.col("mask"), cfg, scale=2.0).alias("t"))
    return tidy(out)


def diff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(session(spark, sf_dir, EXACT | {"pac_diffcols": "1"}).sql("SELECT o_orderpriority, sum(o_totalprice) AS t FROM orders GROUP BY o_orderpriority"), 4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: run(q, settings, policy) for name, (q, settings, policy, _) in SQL.items()}
    found |= {name: run(q, settings) for name, (q, settings) in NOISY.items()}
    return found | {
        "reject_catalogue": reject_catalogue, "pac_counters_unnest": counters_unnest, "pac_list_reagg": list_reaggregation,
        "pac_filter_masks": filter_masks, "pac_derived_table": derived_table, "pac_utility_diff": diff_query,
        "pac_select_family": selected_worlds, "pac_filter_family": filter_family, "pac_renamed_copy": renamed_copy, "stream_window_counters": window_counters,
        "pac_derived_filter": derived_reads("SELECT p, s, n FROM {} WHERE n > 1000 AND s <> 'O' ORDER BY n"), "pac_derived_aggregate": derived_reads("SELECT s, sum(n) AS n, max(t) AS t, count(*) AS k FROM {} GROUP BY s"),
    }


def oracle_sql() -> dict[str, str]:
    found = {name: truth for name, (_, _, _, truth) in SQL.items()}
    found["reject_catalogue"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', TRUE)" for n in REFUSED) + ") t(query, refused)"
    each = " UNION ALL ".join(f"SELECT o_orderstatus, {j} AS world, {s2('o_totalprice', world('o_custkey', j))} AS value FROM orders GROUP BY ALL" for j in range(64))
    found["pac_counters_unnest"] = each
    lists = " UNION ALL ".join(f"SELECT o_orderstatus, o_orderpriority, {j} AS world, CAST({c2(world('o_custkey', j))} AS DOUBLE) AS c FROM orders GROUP BY ALL" for j in range(64))
    found["pac_list_reagg"] = f"SELECT o_orderstatus, world, sum(c) AS s, max(c) AS m FROM ({lists}) GROUP BY ALL"
    above = " + ".join(f"CAST({c2(world('c_custkey', j))} > m AS INTEGER)" for j in range(64))
    found["pac_filter_masks"] = f"WITH o AS (SELECT c_nationkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey), l AS (SELECT avg(n) AS m FROM (SELECT count(*) AS n FROM o GROUP BY c_nationkey)) SELECT c_nationkey, count(*) AS n FROM o, l GROUP BY c_nationkey, m HAVING {above} >= 32"
    found["pac_derived_table"] = f"SELECT o_orderpriority AS p, round(CAST(CAST({s2('o_totalprice', O)} AS FLOAT) AS DOUBLE), 0) AS t, CAST({c2(O)} AS DOUBLE) AS n FROM orders GROUP BY ALL"
    found["pac_select_family"] = "SELECT c_mktsegment, " + ", ".join(f"CAST({' + '.join([f'count(CASE WHEN {world("c_custkey", j)} THEN 1 END)' for j in range(64) if sign(20, j)])} AS BIGINT) AS {op}" for op, (sign, _) in COMPARISONS.items()) + " FROM customer GROUP BY ALL"
    votes = ", ".join(f"{' + '.join(f'CAST(n {text} c{j} AS INTEGER)' for j in range(64))} >= 32 AS {op}" for op, (_, text) in COMPARISONS.items())
    found["pac_filter_family"] = f"SELECT c_nationkey, {votes} FROM (SELECT c_nationkey, count(*) AS n, " + ", ".join(f"{c2(world('c_custkey', j))} AS c{j}" for j in range(64)) + " FROM customer GROUP BY ALL)"
    found["pac_renamed_copy"] = f"SELECT o_orderstatus AS s, {s2('o_totalprice', O)} AS t, {c2(O)} AS n FROM orders GROUP BY ALL"
    U = world("user_id")
    found["stream_window_counters"] = f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CASE WHEN bit_or(CASE WHEN value IS NOT NULL THEN xor(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT), {QH >> 32}) END) + bit_or(CASE WHEN value IS NOT NULL THEN xor(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 9, 8) AS BIGINT), {QH & 0xFFFFFFFF}) END) > 0 THEN {s2('value', U)} END AS t FROM events GROUP BY 1, 2"
    above_n = " + ".join(f"CAST({c2(world('o_custkey', j))} > 1000 AS INTEGER)" for j in range(64))
    found["pac_derived_filter"] = f"SELECT o_orderpriority AS p, o_orderstatus AS s, CAST({c2(O)} AS DOUBLE) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL HAVING {above_n} >= 32"
    found["pac_derived_aggregate"] = f"SELECT s, CAST(sum(n) AS DOUBLE) AS n, max(t) AS t, count(*) AS k FROM (SELECT o_orderpriority AS p, o_orderstatus AS s, round(CAST(CAST({s2('o_totalprice', O)} AS FLOAT) AS DOUBLE), 0) AS t, {c2(O)} AS n FROM orders GROUP BY ALL) GROUP BY s"
    found["pac_utility_diff"] = f"SELECT o_orderpriority, round(100 * abs(e - p) / greatest(1e-5, abs(e)), 4) AS t FROM (SELECT o_orderpriority, sum(o_totalprice) AS e, 2 * sum(CASE WHEN {O} THEN o_totalprice END) AS p FROM orders GROUP BY ALL)"
    return found


__all__ = ["noise", "oracle_sql", "queries", "utility_diff"]
