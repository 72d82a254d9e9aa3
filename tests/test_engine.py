import numpy as np
import pytest
from pyspark.sql import functions as F

from veilcast.catalog import PrivacyError
from veilcast.config import PrivacyConfig
from veilcast.engine import PrivacySession
from veilcast.functions import dp_laplace_noise, hashing, noise, worlds
from veilcast.operators.elastic import smooth_sensitivity


@pytest.fixture(scope="module")
def dp(spark):
    """Units 0..99; orders of 5 a unit; customer chain of two hops."""
    spark.range(100).selectExpr("id", "concat('r', id % 5) AS region").createOrReplaceTempView("u")
    spark.range(500).selectExpr("id % 100 AS uid", "(id % 7) * 1.0D AS amount").createOrReplaceTempView("uorders")
    spark.range(200).selectExpr("id % 100 AS uid", "cast(id % 5 AS int) AS score").createOrReplaceTempView("reviews")
    spark.range(100).selectExpr("id", "if(id % 2 = 0, 1000L, -1000L) AS v").createOrReplaceTempView("signed_u")
    spark.range(3).selectExpr("id AS x").createOrReplaceTempView("no_link")

    def make(**settings):
        s = PrivacySession(spark, PrivacyConfig(privacy_mode="dp_elastic", privacy_noise=False, **settings))
        for line in ("ALTER TABLE u ADD PRIVACY_KEY (id)", "ALTER TABLE u SET PU", "ALTER TABLE uorders ADD PRIVACY_LINK (uid) REFERENCES u(id)", "ALTER TABLE reviews ADD PRIVACY_LINK (uid) REFERENCES u(id)", "ALTER TABLE signed_u ADD PRIVACY_KEY (id)"):
            s.sql(line)
        return s

    return make


def value(df):
    return df.collect()[0][0]


def test_elastic_values(dp):
    assert value(dp().sql("SELECT count(*) FROM u")) == 100
    assert value(dp(dp_sum_bound=100).sql("SELECT sum(id) FROM u")) == 4950
    assert value(dp(dp_sum_bound=5).sql("SELECT sum(id) FROM u")) == 485
    assert value(dp(dp_sum_bound=10).sql("SELECT sum(amount) FROM uorders")) == 1494
    assert value(dp(dp_sum_bound=3).sql("SELECT sum(amount) FROM uorders JOIN u ON uid = id")) == 1068
    assert value(dp(dp_sum_bound=100).sql("SELECT avg(id) FROM u")) == 49.5
    assert value(dp(dp_sum_bound=40).sql("SELECT avg(id) FROM u")) == 31.8
    assert value(dp().sql("SELECT count(*) FROM u WHERE id < 0")) == 0


@pytest.mark.parametrize(
    "sql,part",
    [
        ("SELECT count(*) FROM uorders a JOIN uorders b ON a.uid = b.uid", "self-joins are not supported"),
        ("SELECT count(*) FROM uorders o JOIN reviews r ON o.uid = r.uid", "star/diamond"),
        ("SELECT count(*) FROM uorders JOIN no_link ON uid = x", "no PRIVACY_LINK path"),
        ("SELECT count(DISTINCT region) FROM u", "DISTINCT aggregates are not supported"),
        ("SELECT min(amount) FROM uorders", "only COUNT, SUM, and AVG are supported"),
        ("SELECT sum(amount) FROM uorders", "dp_sum_bound must be set"),
        ("SELECT max(n) FROM (SELECT uid % 2 AS k, count(*) AS n FROM uorders GROUP BY 1) x", "can only be accessed|exactly one aggregate"),
    ],
)
def test_elastic_refusals(dp, sql, part):
    with pytest.raises(PrivacyError, match=part):
        dp().sql(sql)


def test_elastic_noise_and_thresholds(spark, dp):
    s = dp(privacy_min_group_count=1e6)
    s.config.privacy_noise = True
    assert s.sql("SELECT amount, count(*) AS n FROM uorders GROUP BY amount").count() == 0
    assert smooth_sensitivity([5], 1.0, 1e-6) > 10
    with pytest.raises(PrivacyError):
        smooth_sensitivity([5], 1.0, 0.9)
    draws = spark.range(20000).select(dp_laplace_noise(F.lit(0.0), 3.0, PrivacyConfig(), "t", [F.col("id")]).alias("x")).toPandas()["x"]
    assert abs(draws.mean()) < 0.15 and abs(draws.abs().mean() - 3) < 0.15


def test_counters_and_masks(spark):
    df = spark.createDataFrame([(0b101, 2.0), (0b100, 5.0), (None, 9.0), (0b1, None)], "h long, v double")
    r = df.agg(worlds.pac_sum(F.col("h"), F.col("v")).alias("s"), worlds.pac_count(F.col("h"), F.col("v")).alias("c"), worlds.pac_max(F.col("h"), F.col("v")).alias("m"), worlds.pac_count(F.col("h")).alias("n")).first()
    assert r.s[:4] == [4.0, 0.0, 14.0, 0.0] and r.c[:3] == [2.0, 0.0, 4.0] and r.m[:3] == [2.0, 0.0, 5.0] and r.n[:3] == [4.0, 0.0, 4.0]
    bits = F.array(*[F.lit(j in (0, 3)) for j in range(64)])
    row = spark.range(1).select(worlds.pac_select(F.lit(0b1001 | 1 << 40).cast("long"), bits).alias("m"), worlds.pac_filter(bits, PrivacyConfig(pac_mi=0)).alias("f"), worlds.pac_mean(F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0))).alias("a"), worlds.pac_div(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("d")).first()
    assert row.m == 0b1001 and row.f is False and row.a == 2.0 and row.d[0] == float("inf") and np.isnan(row.d[1])


def test_empty_and_null_groups(spark):
    cfg = PrivacyConfig(pac_mi=0)
    df = spark.createDataFrame([], "h long, v double")
    r = df.agg(worlds.pac_noised_count(F.col("h"), cfg).alias("n"), worlds.pac_noised_sum(F.col("h"), F.col("v"), cfg).alias("s"), worlds.pac_count(F.col("h")).alias("c")).first()
    assert r.n is None and r.s is None and r.c == [0.0] * 64


def test_repair_sets_half():
    x = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    assert (np.bitwise_count(hashing.repair(x)) == 32).all()


def test_noise_is_calibrated(spark):
    c = [float(1000 + j) for j in range(64)]
    var = np.var(c, ddof=1) * 64
    cfg = PrivacyConfig()
    df = spark.range(4000).select(noise.release(F.array(*[F.lit(x) for x in c]), F.lit(-1).cast("long"), cfg, tag="t", keys=[F.col("id")]).alias("x")).toPandas()["x"]
    assert abs(df.mean() - c[cfg.secret_world]) < 4 * (var / 4000) ** 0.5 and abs(df.var() / var - 1) < 0.15


def test_single_unit_data_is_refused(spark):
    spark.range(1000).selectExpr("7L AS k", "1.0D AS v").createOrReplaceTempView("one_unit")
    spark.createDataFrame([(7,)], "k long").createOrReplaceTempView("one_pu")
    s = PrivacySession(spark, PrivacyConfig(pac_hash_repair=True))
    for line in ("ALTER TABLE one_pu ADD PRIVACY_KEY (k)", "ALTER TABLE one_pu SET PU", "ALTER TABLE one_unit ADD PRIVACY_LINK (k) REFERENCES one_pu(k)"):
        s.sql(line)
    with pytest.raises(Exception, match="detected absence of sample diversity"):
        s.sql("SELECT sum(v) FROM one_unit").collect()


def test_tables_settings_and_metadata(spark, tmp_path):
    path = str(tmp_path / "meta.json")
    s = PrivacySession(spark, PrivacyConfig(pac_mi=0), path)
    s.sql("DROP TABLE IF EXISTS people")
    s.sql("CREATE PU TABLE people (id INT, grp INT, secret INT, PRIVACY_KEY(id), PROTECTED(secret)) USING parquet")
    s.sql("INSERT INTO people VALUES (1, 1, 10), (2, 1, 20), (3, 2, 30)")
    with pytest.raises(PrivacyError, match="protected column 'people.secret'"):
        s.sql("SELECT secret FROM people")
    s.sql("SET pac_check = false")
    assert s.sql("SELECT secret FROM people").count() == 3
    s.sql("RESET pac_check")
    s.sql("DROP TABLE IF EXISTS renamed")
    s.sql("CREATE TABLE mv AS SELECT grp, sum(secret) AS total FROM people GROUP BY grp")
    assert s.catalog.get("mv").derived and s.catalog.get("mv").counter_columns == ["total"]
    assert s.sql("SELECT grp, total FROM mv").dtypes == [("grp", "int"), ("total", "double")]
    assert "people" in PrivacySession(spark, metadata=path).catalog.tables
    assert "Aggregate" in s.explain("SELECT grp, count(*) FROM people GROUP BY grp")
    for t in ("people", "mv"):
        s.drop_table(t)
    assert s.catalog.get("people") is None


def test_clip_drops_unsupported_levels(spark):
    from veilcast.functions import key_hash_column
    from veilcast.operators.clip import pac_clip_sum

    rows = [(k, 100.0) for k in range(50)] + [(99, 1e9)]
    df = spark.createDataFrame(rows, "k long, v double")
    h = key_hash_column(F.col("k"))
    clipped = pac_clip_sum(df, [], h, F.col("v"), PrivacyConfig(pac_clip_support=10)).first()["value"]
    scaled = pac_clip_sum(df, [], h, F.col("v"), PrivacyConfig(pac_clip_support=10, pac_clip_scale=True)).first()["value"]
    assert max(clipped) <= 2 * 50 * 100 and abs(sum(clipped) / 64 - 5000) < 1500 and max(scaled) < 1e5


def test_correlation_is_taken_apart():
    from veilcast.operators.emit import conjuncts

    assert conjuncts("((`a` = `b`) AND ((`c` > 1) AND (f(`d`, 2) OR (`e` AND `g`))))") == ["`a` = `b`", "`c` > 1", "f(`d`, 2) OR (`e` AND `g`)"]


def test_functions_in_sql_text():
    from veilcast.functions import sqltext

    text = sqltext.expand("SELECT pac_mean(pac_sum(h, v)), 'pac' FROM t", PrivacyConfig())
    assert not sqltext.calls(text.replace("'pac'", "")) and text.count("sum(") >= 64
    with pytest.raises(PrivacyError, match="unknown function"):
        sqltext.expand("SELECT pac_nothing(1)", PrivacyConfig())


def test_queries_share_no_draws(spark, sf_dir):
    """Answers that differ by one unit have noise of their own: their difference tells nothing."""
    from veilcast.plans.catalogue import session

    s = session(spark, sf_dir, {})
    first, second = (s.compiled_config(f"SELECT sum(c_acctbal) FROM customer WHERE c_custkey <> {k}") for k in (0, 7))
    again = s.compiled_config("SELECT  sum(c_acctbal)  FROM customer WHERE c_custkey <> 0")
    assert first.query_hash != second.query_hash and first.query_hash == again.query_hash
    assert session(spark, sf_dir, {}).config.seed != s.config.seed
    x = s.sql("SELECT sum(c_acctbal) AS t FROM customer")
    assert x.first() == x.first()


def test_statements_keep_what_is_quoted():
    from veilcast import ddl

    assert ddl.clean("SELECT 'a  b', 'x -- y' -- gone\n , \"/* in */\"  /* out */ FROM t ; ") == "SELECT 'a  b', 'x -- y' , \"/* in */\" FROM t"
    assert ddl.clean("SELECT /*+ BROADCAST(t) */ 'it''s  ;' FROM t;") == "SELECT /*+ BROADCAST(t) */ 'it''s  ;' FROM t"


def test_scalar_subqueries_have_one_row(spark, sf_dir):
    from veilcast.plans.catalogue import EXACT, session

    s = session(spark, sf_dir, EXACT)
    with pytest.raises(Exception, match="more than one row"):
        s.sql("SELECT count(*) FROM orders WHERE o_totalprice > (SELECT r_regionkey FROM region)").collect()
    with pytest.raises(PrivacyError, match="IN with several columns"):
        s.sql("SELECT count(*) FROM orders WHERE (o_orderkey, o_custkey) IN (SELECT l_orderkey, l_partkey FROM lineitem)").collect()


def test_copies_without_their_unit_are_refused(spark, sf_dir):
    from veilcast.plans.catalogue import EXACT, session

    s = session(spark, sf_dir, EXACT)
    with pytest.raises(PrivacyError, match="without the key or link"):
        s.sql("CREATE TABLE balances AS SELECT c_acctbal AS b FROM customer")
    assert not spark.catalog.tableExists("balances")


def test_derived_and_private_tables_are_read_apart(spark, sf_dir):
    from veilcast.plans.catalogue import EXACT, session

    s = session(spark, sf_dir, EXACT)
    s.drop_table("mv_apart")
    s.sql("CREATE TABLE mv_apart AS SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY o_orderstatus")
    with pytest.raises(PrivacyError, match="can't be read beside private tables"):
        s.sql("SELECT sum(o_totalprice) FROM orders JOIN mv_apart ON o_orderstatus = s")
    with pytest.raises(PrivacyError, match="not supported above a derived table"):
        s.sql("SELECT x FROM mv_apart LATERAL VIEW explode(array(n)) t AS x")
    s.drop_table("mv_apart")


def test_counting_in_many_parts(spark, monkeypatch):
    """Groups that leave a task in several parts, null and odd keys, and no rows at all."""
    from veilcast.operators import counting

    monkeypatch.setattr(counting, "HELD", 3)
    monkeypatch.setattr(counting, "ROWS", 5)
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(9)) or None, float("nan") if k % 7 == 0 else 1.5, int(rng.integers(-(1 << 63), 1 << 63)), None if k % 11 == 0 else float(rng.integers(100))) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, f double, __h long, v double").repartition(3)
    specs = [("c", "m", "sum", F.col("v")), ("hi", "hm", "max", F.col("v")), ("lo", "lm", "min", F.col("v"))]
    got = {(r.g, str(r.f)): r for r in counting.world_table(df, ["g", "f"], specs).collect()}
    want = {}
    for g, f, h, v in rows:
        want.setdefault((g, str(f)), []).append((h & ((1 << 64) - 1), v))
    assert set(got) == set(want)
    for k, own in want.items():
        assert got[k]["__updates"] == len(own)
        for j in range(64):
            here = [v for h, v in own if h >> j & 1 and v is not None]
            assert (got[k].c[j], got[k].hi[j], got[k].lo[j]) == ((sum(here), max(here), min(here)) if here else (0.0, 0.0, 0.0))
            assert (got[k].m >> j & 1) == bool(here)
    none = counting.world_table(df.limit(0), [], specs).collect()
    assert len(none) == 1 and none[0].c == [0.0] * 64 and none[0].m == 0 and none[0].hi == [0.0] * 64


def test_tracked_release_is_calibrated(spark):
    """The first answer's noise has the variance of an observer who knows nothing; later groups are released too."""
    cfg = PrivacyConfig(privacy_seed=3)
    rows = [(k, [float(1000 + j) for j in range(64)], -1) for k in range(50)]
    df = spark.createDataFrame(rows, "__g0 int, c array<double>, m long").repartition(4)
    out = noise.release_tracked(df, [("x", "c", "m", 1.0, 1.0, True)], ["__g0"], cfg)
    assert [r["__g0"] for r in out.collect()] == list(range(50)) and out.filter("x IS NULL").count() == 0
    dealt = noise.release_tracked(df, [("x", "c", "m", 1.0, 1.0, True)], ["__g0"], PrivacyConfig(privacy_seed=3, pac_ptracking_partitions=3))
    assert dealt.count() == 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "Exchange" in plan


def test_stream_of_counters(spark, tmp_path):
    from veilcast.functions import key_hash_column
    from veilcast.streaming import release_batch, windowed_counters

    rows = [(f"2024-01-01 00:{m:02d}:00", u, 2.0) for m in range(30) for u in range(40)]
    spark.createDataFrame(rows, "at string, u long, v double").selectExpr("CAST(at AS timestamp) AS at", "u", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, u long, v double").parquet(str(tmp_path / "in"))
    counted = windowed_counters(stream, "at", "10 minutes", "1 minute", key_hash_column(F.col("u")), F.col("v"))
    got = []
    query = counted.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(release_batch(PrivacyConfig(pac_mi=0), lambda df: got.extend(df.collect()))).start()
    query.awaitTermination(120)
    assert len(got) == 3 and all(r.value % 40 == 0 and 200 < r.value < 1400 for r in got)
