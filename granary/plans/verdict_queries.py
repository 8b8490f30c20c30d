"""Votes, error metrics, gates and comparisons on order lines: N is a pass, R a fail, A invalid."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import votes
from granary.plans.registry import query, table

VOTES_SQL = """
v AS (SELECT l_orderkey AS ticket, l_linenumber AS line, CASE l_returnflag WHEN 'N' THEN 'pass' WHEN 'R' THEN 'fail' END AS verdict FROM lineitem),
m AS (SELECT ticket, count(*) FILTER (verdict = 'pass') AS n_pass, count(*) FILTER (verdict = 'fail') AS n_fail, count(*) FILTER (verdict IS NULL) AS n_invalid FROM v {where} GROUP BY ticket),
j AS (SELECT *, CASE WHEN n_pass + n_fail = 0 THEN NULL WHEN n_pass > n_fail THEN 'pass' ELSE 'fail' END AS pred,
  CASE WHEN n_pass + n_fail = 0 THEN 0.0 ELSE greatest(n_pass, n_fail)::DOUBLE / (n_pass + n_fail)::DOUBLE END AS agreement FROM m),
g AS (SELECT o_orderkey AS ticket, CASE o_orderstatus WHEN 'F' THEN 'fail' ELSE 'pass' END AS truth, o_orderpriority AS priority FROM orders)
"""
PAIRS_SQL = (
    "WITH "
    + VOTES_SQL.format(where="WHERE line % 2 = 1")
    + """, m2 AS (SELECT ticket, count(*) FILTER (verdict = 'pass') AS p, count(*) FILTER (verdict = 'fail') AS f FROM v WHERE line % 2 = 0 GROUP BY ticket),
pairs AS (
  SELECT j.ticket, g.truth, j.pred AS base, j.agreement AS base_agreement,
    CASE WHEN p + f = 0 THEN NULL WHEN p > f THEN 'pass' ELSE 'fail' END AS new,
    CASE WHEN p + f = 0 THEN 0.0 ELSE greatest(p, f)::DOUBLE / (p + f)::DOUBLE END AS new_agreement
  FROM j JOIN m2 USING (ticket) JOIN g USING (ticket)),
w AS (SELECT *, (NOT coalesce(base = truth, false))::INT AS b, (NOT coalesce(new = truth, false))::INT AS n FROM pairs)
"""
)


def _votes(spark, sf_dir):
    flag = F.col("l_returnflag")
    verdict = F.when(flag == "N", "pass").when(flag == "R", "fail")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ticket"), F.col("l_linenumber").alias("line"), verdict.alias("verdict"), flag.alias("reason"))


def _truth(spark, sf_dir):
    truth = F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket"), truth.alias("truth"), F.col("o_orderpriority").alias("priority"))


def _judged(spark, sf_dir):
    return votes.majority(_votes(spark, sf_dir)).join(_truth(spark, sf_dir), "ticket")


def _pairs(spark, sf_dir):
    rows = _votes(spark, sf_dir)
    base = votes.majority(rows.where("line % 2 = 1")).join(_truth(spark, sf_dir), "ticket")
    return votes.compare(base, votes.majority(rows.where("line % 2 = 0")))


@query(f"WITH {VOTES_SQL.format(where='')} SELECT ticket, n_pass, n_fail, n_invalid, pred, round(agreement, 6) AS agreement, round(CASE WHEN n_pass + n_fail = 0 THEN 0.5 ELSE 1 - agreement END, 6) AS difficulty FROM j")
def vote_majority(spark, sf_dir):
    return votes.majority(_votes(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("agreement", "difficulty")})


CONFUSION = """count(*) AS n, count(*) FILTER (pred = truth) AS correct, count(*) FILTER (truth = 'pass' AND pred IS DISTINCT FROM truth) AS fn,
  count(*) FILTER (truth = 'fail' AND pred IS DISTINCT FROM truth) AS fp, count(*) FILTER (truth = 'pass' AND pred = truth) AS tp, count(*) FILTER (truth = 'fail' AND pred = truth) AS tn"""
RATES = """*, CASE WHEN n = 0 THEN 0.0 ELSE round(correct::DOUBLE / n::DOUBLE, 6) END AS acc, CASE WHEN n = 0 THEN 0.0 ELSE round(fn::DOUBLE / n::DOUBLE, 6) END AS fn_rate, CASE WHEN n = 0 THEN 0.0 ELSE round(fp::DOUBLE / n::DOUBLE, 6) END AS fp_rate,
  CASE WHEN tp > 0 THEN round(fn::DOUBLE / tp::DOUBLE, 6) END AS fn_over_tp, CASE WHEN tp > 0 THEN round(fp::DOUBLE / tp::DOUBLE, 6) END AS fp_over_tp, tp = 0 AND fp > 0 AS fp_over_tp_infinite,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(fp::DOUBLE / (tp + fp)::DOUBLE, 6) END AS false_release, CASE WHEN tn + fn = 0 THEN 0.0 ELSE round(fn::DOUBLE / (tn + fn)::DOUBLE, 6) END AS false_block"""


@query(f"WITH {VOTES_SQL.format(where='')}, c AS (SELECT {CONFUSION} FROM j JOIN g USING (ticket)) SELECT {RATES} FROM c")
def vote_confusion(spark, sf_dir):
    return votes.confusion(_judged(spark, sf_dir))


@query(f"WITH {VOTES_SQL.format(where='')}, c AS (SELECT priority, {CONFUSION} FROM j JOIN g USING (ticket) GROUP BY priority) SELECT {RATES} FROM c")
def vote_confusion_by(spark, sf_dir):
    return votes.confusion(_judged(spark, sf_dir), by=["priority"])


STATS_SQL = "s AS (SELECT count(*) AS n, coalesce(avg(b), 0.0) AS err_base, coalesce(avg(n), 0.0) AS err_new, coalesce(avg((base IS DISTINCT FROM new)::INT), 0.0) AS changed FROM w)"


@query(f"{PAIRS_SQL}, {STATS_SQL} SELECT n, round(err_base, 6) AS err_base, round(err_new, 6) AS err_new, round(changed, 6) AS changed, round((err_base - err_new) / greatest(err_base, 1e-12), 6) AS rer FROM s")
def vote_compare(spark, sf_dir):
    return votes.comparison(_pairs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("err_base", "err_new", "changed", "rer")})


BOOT_SQL = """, cl AS (SELECT b, n AS w2, count(*) AS k FROM w GROUP BY b, n),
cu AS (SELECT b, w2, sum(k) OVER (ORDER BY b, w2) AS upto, sum(k) OVER (ORDER BY b, w2) - k AS since, sum(k) OVER () AS total FROM cl),
dr AS (SELECT i // t.total AS r, ('0x' || substr(md5('7:' || (i // t.total)::BIGINT || ':' || (i % t.total)::BIGINT), 1, 12))::BIGINT % t.total AS place FROM (SELECT max(total)::BIGINT AS total FROM cu) t, range(0, t.total * 25) x(i)),
sm AS (SELECT r, avg(b) AS e0, avg(w2) AS e1 FROM dr JOIN cu ON place >= since AND place < upto GROUP BY r),
bp AS (SELECT coalesce(avg(((e0 - e1) / greatest(e0, 1e-12) >= -0.01)::INT), 0.0) AS probability FROM sm)"""


@query(f"{PAIRS_SQL}{BOOT_SQL} SELECT round(probability, 6) AS probability FROM bp")
def bootstrap_rer(spark, sf_dir):
    out = votes.bootstrap_probability(_pairs(spark, sf_dir), theta=-0.01, iterations=25, seed=7)
    return out.select(F.round("probability", 6).alias("probability"))


@query(
    f"{PAIRS_SQL}{BOOT_SQL}, {STATS_SQL} SELECT round((err_base - err_new) / greatest(err_base, 1e-12), 6) AS rer, round(changed, 6) AS changed, round(probability, 6) AS probability, "
    "(err_base - err_new) / greatest(err_base, 1e-12) >= -0.05 AND changed <= 0.9 AND probability >= 0.1 AS passes FROM s, bp"
)
def gate(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    stats = votes.comparison(pairs).crossJoin(F.broadcast(votes.bootstrap_probability(pairs, theta=-0.01, iterations=25, seed=7)))
    passed = votes.gate(stats, min_rer=-0.05, max_changed=0.9, min_probability=0.1)
    return passed.select(*[F.round(c, 6).alias(c) for c in ("rer", "changed", "probability")], "passes")


TOP = "WITH {v} SELECT ticket, pred, truth, round(agreement, 6) AS agreement, row_number() OVER (ORDER BY agreement {d}, ticket)::INT AS rank FROM j JOIN g USING (ticket) WHERE pred IS NOT NULL AND pred <> truth ORDER BY agreement {d}, ticket LIMIT 20"


@query(TOP.format(v=VOTES_SQL.format(where=""), d="DESC"))
def hard_topk(spark, sf_dir):
    return votes.mismatches(_judged(spark, sf_dir), 20).select("ticket", "pred", "truth", F.round("agreement", 6).alias("agreement"), "rank")


@query(TOP.format(v=VOTES_SQL.format(where=""), d="ASC"))
def easy_topk(spark, sf_dir):
    return votes.mismatches(_judged(spark, sf_dir), 20, hardest=False).select("ticket", "pred", "truth", F.round("agreement", 6).alias("agreement"), "rank")


@query(f"{PAIRS_SQL} SELECT ticket, truth, base, new FROM w WHERE b = 0 AND n = 1 ORDER BY new_agreement DESC, base_agreement DESC, ticket LIMIT 50")
def regressions(spark, sf_dir):
    return votes.regressions(_pairs(spark, sf_dir)).select("ticket", "truth", "base", "new")


@query(
    "WITH c AS (SELECT l_orderkey AS ticket, l_returnflag AS reason, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY n DESC, first, reason) AS k FROM c) SELECT ticket, reason AS mode, n FROM r WHERE k = 1"
)
def reason_mode(spark, sf_dir):
    found = votes.top_reason(_votes(spark, sf_dir), "ticket", "reason", "line")
    return found.select("ticket", "mode", F.col("top")[0]["n"].alias("n"))


@query(
    "WITH d AS (SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id)), j AS (SELECT CASE WHEN n_chars >= 400 THEN 'pass' ELSE 'fail' END AS pred, CASE quality WHEN 1 THEN 'pass' ELSE 'fail' END AS truth FROM d), "
    f"c AS (SELECT {CONFUSION} FROM j) SELECT {RATES} FROM c"
)
def label_confusion(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    judged = labels.select(F.when(F.col("n_chars") >= 400, "pass").otherwise("fail").alias("pred"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("truth"))
    return votes.confusion(judged)
