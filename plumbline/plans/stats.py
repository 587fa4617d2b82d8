"""Statistics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import ranks as R
from plumbline.operators import stats as S
from plumbline.operators.resampling import Spread, bootstrap, sql_weights
from plumbline.plans.registry import query
from plumbline.plans.tables import with_tables

col = F.col
B = 2000  # resamples, the library default

SQL_AUROC = """
WITH c AS (SELECT grp, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY 1, 2),
w AS (SELECT *, sum(neg) OVER (PARTITION BY grp ORDER BY score) - neg AS below FROM c)
SELECT grp, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, sum(pos * (below + neg / 2)) / CAST(sum(pos) * sum(neg) AS DOUBLE) AS auroc FROM w GROUP BY grp"""


@query("auroc", with_tables("scored", SQL_AUROC))
def auroc(t):
    return S.auroc(t.scored, ["grp"], col("label") == 1, col("score"))


POIS = " + ".join(f"CASE WHEN u >= {x} THEN 1 ELSE 0 END" for x in S.poisson_thresholds())


@query("clustered_bootstrap", with_tables("", f"""
WITH per AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS s, count(*) AS n FROM orders GROUP BY 1),
num AS (SELECT *, row_number() OVER (ORDER BY md5('boot:' || k), k) AS no, count(*) OVER () AS m FROM per),
pick AS (SELECT b, hl[['boot:' || b || ':' || no]] % m + 1 AS no FROM num, range(1, {B + 1}) r(b)),
st AS (SELECT b, sum(s) / CAST(sum(n) AS DOUBLE) AS stat FROM pick JOIN num USING (no) GROUP BY b)
SELECT (SELECT sum(s) / CAST(sum(n) AS DOUBLE) FROM per) AS point, round(quantile_cont(stat, 0.025), 9) AS lo, round(quantile_cont(stat, 0.975), 9) AS hi FROM st"""))
def clustered_bootstrap(t):
    parts = {"s": F.count(F.when(col("o_orderstatus") == "F", 1)), "n": F.count("*")}
    out = S.clustered_bootstrap(t.orders, "o_custkey", parts, S.ratio_statistic("s", "n"), "boot", B)
    return out.select("point", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


def _sql_mean_ci(table: str, group: str, value: str, cluster: str, seed: str, n: int = B) -> str:
    return f"""
WITH per AS (SELECT {group} AS g, {cluster} AS k, sum({value}) AS s, count({value}) AS n FROM {table} GROUP BY 1, 2),
dr AS ({sql_weights('per', 'k', seed, n)}),
w AS (SELECT g, b, sum(wt * s) / CAST(nullif(sum(wt * n), 0) AS DOUBLE) AS stat, sum(n) AS n FROM dr GROUP BY 1, 2)
SELECT g AS grp, round(max(stat) FILTER (b = 0), 9) AS point, CAST(max(n) AS BIGINT) AS n, round(quantile_cont(stat, 0.025) FILTER (b > 0), 9) AS lo, round(quantile_cont(stat, 0.975) FILTER (b > 0), 9) AS hi FROM w GROUP BY g"""


def _rounded(df):
    return df.select("grp", F.round("point", 9).alias("point"), "n", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query("rate_ci", with_tables("", _sql_mean_ci("(SELECT *, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS ok FROM orders) o", "o_orderpriority", "ok", "o_custkey", "rate")))
def rate_ci(t):
    o = t.orders.withColumnRenamed("o_orderpriority", "grp")
    return _rounded(S.rate_ci(o, ["grp"], col("o_totalprice") > 200000, "o_custkey", seed="rate", n_resamples=B))


@query("paired_difference_ci", with_tables("", _sql_mean_ci("(SELECT *, CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END - CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS DOUBLE) AS d FROM lineitem) l",
                                                           "l_returnflag", "d", "l_suppkey", "pair")))
def paired_difference_ci(t):
    d = t.lineitem.withColumnRenamed("l_returnflag", "grp")
    a, b = (col("l_quantity") > 25).cast("int"), (col("l_tax") > 0.04).cast("int")
    return _rounded(S.paired_difference_ci(d, ["grp"], a, b, "l_suppkey", seed="pair", n_resamples=B))


@query("auroc_ci", with_tables("", f"""
WITH sc AS (SELECT l_suppkey AS k, l_returnflag AS g, l_discount AS score, CASE WHEN l_quantity + l_discount * 200 > 35 THEN 1 ELSE 0 END AS y FROM lineitem),
per AS (SELECT k, g, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY ALL),
d0 AS (SELECT g, 0 AS b, score, sum(pos) AS pos, sum(neg) AS neg FROM per GROUP BY ALL),
dr AS (SELECT g, b, score, pos, neg, h[['au:' || b || ':' || k]] AS u FROM per, range(1, {B + 1}) r(b)),
d1 AS (SELECT g, b, score, sum(({POIS}) * pos) AS pos, sum(({POIS}) * neg) AS neg FROM dr GROUP BY 1, 2, 3),
w AS (SELECT *, sum(neg) OVER (PARTITION BY g, b ORDER BY score) - neg AS below FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1) z),
st AS (SELECT g, b, sum(pos) AS np, sum(neg) AS nn, sum(pos * (below + neg / 2)) / CAST(sum(pos) * sum(neg) AS DOUBLE) AS a FROM w GROUP BY 1, 2)
SELECT g AS grp, CAST(max(np) FILTER (b = 0) AS BIGINT) AS n_pos, CAST(max(nn) FILTER (b = 0) AS BIGINT) AS n_neg, round(max(a) FILTER (b = 0), 9) AS auroc,
  round(quantile_cont(a, 0.025) FILTER (b > 0), 9) AS lo, round(quantile_cont(a, 0.975) FILTER (b > 0), 9) AS hi FROM st GROUP BY g"""))
def auroc_ci(t):
    d = t.lineitem.select("l_suppkey", col("l_returnflag").alias("grp"), col("l_discount").alias("score"), (col("l_quantity") + col("l_discount") * 200 > 35).alias("y"))
    out = S.auroc_ci(d, ["grp"], col("y"), col("score"), "l_suppkey", seed="au", n_resamples=B)
    return out.select("grp", "n_pos", "n_neg", *[F.round(c, 9).alias(c) for c in ("auroc", "lo", "hi")])


@query("cohens_kappa", with_tables("", """
WITH l AS (SELECT d.lang AS grp, quality AS a, CASE WHEN h[['r3:' || doc_id]] % 5 = 0 THEN 1 - quality ELSE quality END AS b FROM labels JOIN documents d USING (doc_id)),
m AS (SELECT grp, count(*) AS n, avg(CASE WHEN a = b THEN 1.0e0 ELSE 0.0e0 END) AS o, CAST(sum(a) * sum(b) + sum(1 - a) * sum(1 - b) AS DOUBLE) / (count(*) * count(*)) AS e FROM l GROUP BY 1)
SELECT grp, n, round(CASE WHEN e <> 1 THEN (o - e) / (1 - e) END, 9) AS kappa FROM m"""))
def cohens_kappa(t):
    flipped = F.conv(F.substring(F.md5(F.concat(F.lit("r3:"), col("doc_id").cast("string"))), 1, 8), 16, 10).cast("bigint") % 5 == 0
    d = t.labels.join(t.documents.select("doc_id", col("lang").alias("grp")), "doc_id").withColumn("third", F.when(flipped, 1 - col("quality")).otherwise(col("quality")))
    return S.cohens_kappa(d, ["grp"], col("quality"), col("third")).withColumn("kappa", F.round("kappa", 9))


def _sql_fleiss(src: str, cats: str, group: str) -> str:
    return f"""
(WITH c AS (SELECT {group} AS g, doc_id, label, count(*) AS c FROM {src} WHERE label IN ({cats}) GROUP BY ALL),
i AS (SELECT g, doc_id, sum(c) AS n, sum(c * c) AS q FROM c GROUP BY ALL HAVING sum(c) = 3),
p AS (SELECT g, count(*) AS m, avg((q - n) / (n * (n - 1))) AS p FROM i GROUP BY g),
e AS (SELECT g, sum(s * s) AS e FROM (SELECT c.g, label, sum(c) / (3.0e0 * (SELECT m FROM p WHERE p.g = c.g)) AS s FROM c JOIN i ON c.g = i.g AND c.doc_id = i.doc_id GROUP BY c.g, label) z GROUP BY g)
SELECT p.g AS g, m, round((p - e) / (1 - e), 9) AS kappa FROM p JOIN e ON p.g = e.g)"""


@query("fleiss_kappa", with_tables("raters", f"SELECT m AS n_items, kappa FROM {_sql_fleiss('raters', chr(39) + '0' + chr(39) + ', ' + chr(39) + '1' + chr(39), '1')} f"))
def fleiss_kappa(t):
    return S.fleiss_kappa(t.raters, [], "doc_id", "rater", "label", ["0", "1"]).withColumn("kappa", F.round("kappa", 9))


RATED = """
SELECT doc_id, rater, CASE WHEN h[['sk:' || doc_id || rater]] % 9 = 0 THEN 'skip' WHEN h[['dm:' || doc_id || rater]] % 7 = 0 THEN 'damage' WHEN label = '1' THEN 'clean' ELSE 'visible' END AS label FROM raters"""
CATS = "'clean', 'visible', 'damage'"


@query("agreement_report", with_tables("raters", f"""
WITH ra AS ({RATED}), st AS (SELECT doc_id, CASE WHEN h[['st:' || doc_id]] % 3 = 0 THEN 'negative' ELSE 'random' END AS stratum FROM labels),
rs AS (SELECT ra.*, stratum FROM ra JOIN st USING (doc_id)), rb AS (SELECT doc_id, CASE WHEN label IN ('visible', 'damage') THEN 'not_clean' ELSE label END AS label FROM ra),
mc AS (SELECT doc_id, label, count(*) FILTER (label <> 'skip') AS c FROM ra GROUP BY 1, 2),
mj AS (SELECT doc_id, CASE WHEN max(c) * 2 > sum(c) THEN arg_max(label, c) END AS majority FROM mc GROUP BY 1),
hv AS (SELECT CASE WHEN majority = 'clean' THEN 1 ELSE 0 END AS a, quality AS b FROM mj JOIN labels USING (doc_id) JOIN st USING (doc_id) WHERE majority IS NOT NULL AND stratum = 'random'),
ck AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0e0 ELSE 0.0e0 END) AS o, CAST(sum(a) * sum(b) + sum(1 - a) * sum(1 - b) AS DOUBLE) / (count(*) * count(*)) AS e FROM hv)
SELECT 'fleiss_all' AS statistic, kappa AS value, m AS n FROM {_sql_fleiss('ra', CATS, '1')} f1
UNION ALL SELECT 'fleiss_binary', kappa, m FROM {_sql_fleiss('rb', "'clean', 'not_clean'", '1')} f2
UNION ALL SELECT 'fleiss_' || g, kappa, m FROM {_sql_fleiss('rs', CATS, 'stratum')} f3
UNION ALL SELECT 'cohen_human_vs_verifier', round((o - e) / (1 - e), 9), n FROM ck
UNION ALL SELECT 'skipped', CAST(count(*) AS DOUBLE), count(*) FROM ra WHERE label = 'skip'
UNION ALL SELECT 'no_majority', CAST(count(*) AS DOUBLE), count(*) FROM mj WHERE majority IS NULL"""))
def agreement_report(t):
    strata = t.sql("SELECT doc_id, CASE WHEN h[['st:' || doc_id]] % 3 = 0 THEN 'negative' ELSE 'random' END AS stratum FROM labels")
    verifier = t.labels.select("doc_id", (col("quality") == 1).alias("verifier"))
    out = S.agreement_report(t.sql(RATED), "doc_id", "rater", "label", ["label"], ["clean", "visible", "damage"], "clean", "skip", verifier, strata, "random")
    return out.withColumn("value", F.round("value", 9))


RUN_A = "SELECT item_id, dimension, h[['a:' || item_id]] % 10 < 6 AS correct FROM items"
RUN_B = "SELECT item_id, h[['b:' || item_id]] % 10 < 5 AS correct FROM items"


@query("mcnemar_exact", with_tables("items", f"""
WITH j AS (SELECT dimension, a.correct AS x, b.correct AS y FROM ({RUN_A}) a JOIN ({RUN_B}) b USING (item_id)),
g AS (SELECT dimension, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (y AND NOT x) AS c FROM j GROUP BY 1),
s AS (SELECT dimension, b, c, sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0e0))) AS p FROM (SELECT *, unnest(range(0, least(b, c) + 1)) AS i FROM g) z GROUP BY ALL)
SELECT dimension, b, c, round(least(1.0e0, 2 * p), 9) AS p FROM s"""))
def mcnemar_exact(t):
    d = S.discordant_counts(t.sql(RUN_A), t.sql(RUN_B), ["item_id"], [col("dimension")])
    return S.mcnemar_exact(d, ["dimension"], "b", "c").withColumn("p", F.round("p", 9))


@query("wald_interval", with_tables("items", f"""
WITH g AS (SELECT dimension, count(*) AS n, avg(CASE WHEN correct THEN 1.0e0 ELSE 0.0e0 END) AS rate FROM ({RUN_A}) a GROUP BY 1)
SELECT dimension, n, rate, round(rate - 1.96e0 * sqrt(rate * (1 - rate) / n), 9) AS lo, round(rate + 1.96e0 * sqrt(rate * (1 - rate) / n), 9) AS hi FROM g"""))
def wald_interval(t):
    g = t.sql(RUN_A).groupBy("dimension").agg(F.count("*").alias("n"), F.avg(col("correct").cast("int")).alias("rate"))
    lo, hi = S.wald_interval(col("rate"), col("n"))
    return g.select("dimension", "n", "rate", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


TINY = "SELECT l_returnflag AS grp, CASE WHEN l_discount = 0 THEN 0.0e0 ELSE power(10.0e0, -l_quantity) * l_discount END AS p FROM lineitem"


@query("median_log10", with_tables("", f"""
WITH x AS ({TINY}), o AS (SELECT grp, p, row_number() OVER (PARTITION BY grp ORDER BY p) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM x),
u AS (SELECT grp, max(CASE WHEN rn = n // 2 + 1 THEN p END) AS upper_mid, max(n) AS n FROM o GROUP BY 1), a AS (SELECT grp, quantile_cont(p, 0.5) AS mid, sum(p) AS total, avg(CASE WHEN p >= 0.1 THEN 1.0e0 ELSE 0.0e0 END) AS share FROM x GROUP BY 1)
SELECT grp, n, round(log10(greatest(mid, 1e-30)), 6) AS log_median, round(log10(greatest(upper_mid, 1e-30)), 6) AS log_upper, share FROM u JOIN a USING (grp)"""))
def median_log10(t):
    x = t.sql(TINY)
    mid = R.exact_quantiles(x, ["grp"], col("p"), {"mid": 0.5})
    up = R.upper_median(x, ["grp"], col("p"), "upper_mid").drop("n")
    share = x.groupBy("grp").agg(F.avg((col("p") >= 0.1).cast("int")).alias("share"))
    j = mid.join(up, "grp").join(share, "grp")
    return j.select("grp", "n", F.round(S.log10_floor(col("mid")), 6).alias("log_median"), F.round(S.log10_floor(col("upper_mid")), 6).alias("log_upper"), "share")


@query("user_statistic", with_tables("", f"""
WITH per AS (SELECT o_orderpriority AS g, o_custkey AS k, max(o_totalprice) AS top FROM orders GROUP BY 1, 2),
st AS (SELECT g, b, max(top) FILTER (wt > 0) - min(top) FILTER (wt > 0) AS stat, count(*) AS n FROM ({sql_weights('per', 'k', 'user', B)}) GROUP BY 1, 2)
SELECT g AS grp, round(max(stat) FILTER (b = 0), 6) AS point, CAST(max(n) AS BIGINT) AS n, round(quantile_cont(stat, 0.025) FILTER (b > 0), 6) AS lo, round(quantile_cont(stat, 0.975) FILTER (b > 0), 6) AS hi FROM st GROUP BY g"""))
def user_statistic(t):
    """A statistic that is no ratio of sums: how far apart the largest orders of the customers are."""
    per = t.orders.groupBy(col("o_orderpriority").alias("grp"), "o_custkey").agg(F.max("o_totalprice").alias("top"))
    out = bootstrap(per, ["grp"], "o_custkey", ["top"], Spread(), "user", B)
    return out.select("grp", "n", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")])
