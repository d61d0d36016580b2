"""Registered queries of sampling, evaluation and balance, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from laborlens.operators import balance as B
from laborlens.operators import evaluate as E
from laborlens.operators import sampling as S
from laborlens.operators.filters import active
from laborlens.plans.views import JOBS, Views
from laborlens.session import shared_dir

WITH = "WITH " + JOBS


def scored(v: Views):
    """Labelled documents with a score, a margin and categories that follow from their length."""
    d = v.table("documents").join(v.table("labels"), "doc_id")
    n = F.char_length("text")
    score = (n % 1000) / 50.0
    margin = (n % 97) / 16.0
    return d.select(
        F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("is_tech"), score.alias("score"), margin.alias("margin"), ((score >= 8) & (margin >= 3)).alias("predicted"),
        F.concat(F.lit("c"), (n % 5).cast("string")).alias("category"), F.concat(F.lit("c"), (n % 5 - F.when(n % 3 == 0, n % 2).otherwise(0)).cast("string")).alias("expected_category"),
        ((n % 101) / 100.0).alias("ambiguity"), F.when(score < 8, "SCORE_TOO_LOW").when(margin < 3, "MARGIN_TOO_LOW").otherwise("SUCCESS").alias("reason"),
    )


SCORED = """
s0 AS (SELECT doc_id AS id, quality = 1 AS is_tech, length(text) AS n FROM documents JOIN labels USING (doc_id)),
scored AS (SELECT id, is_tech, (n % 1000) / 50.0 AS score, (n % 97) / 16.0 AS margin, (n % 1000) / 50.0 >= 8 AND (n % 97) / 16.0 >= 3 AS predicted, 'c' || (n % 5) AS category,
  'c' || (n % 5 - CASE WHEN n % 3 = 0 THEN n % 2 ELSE 0 END) AS expected_category, (n % 101) / 100.0 AS ambiguity,
  CASE WHEN (n % 1000) / 50.0 < 8 THEN 'SCORE_TOO_LOW' WHEN (n % 97) / 16.0 < 3 THEN 'MARGIN_TOO_LOW' ELSE 'SUCCESS' END AS reason FROM s0)
"""
SC = "WITH " + SCORED


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


MEASURES = (
    f"{_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {_ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy,"
    f" {_ratio('tn', 'tn + fp')} AS specificity, ({_ratio('tp', 'tp + fn')} + {_ratio('tn', 'tn + fp')}) / 2 AS balanced_accuracy"
)
GRID = f"""{SC}, pol AS (SELECT CAST(t AS DOUBLE) AS tech_minimum, m / 2.0 AS minimum_margin FROM range(3, 20) a(t), range(2, 11) b(m)),
c AS (SELECT tech_minimum, minimum_margin, count(*) FILTER (is_tech AND y) AS tp, count(*) FILTER (NOT is_tech AND y) AS fp, count(*) FILTER (is_tech AND NOT y) AS fn, count(*) FILTER (NOT is_tech AND NOT y) AS tn
      FROM (SELECT *, score >= tech_minimum AND margin >= minimum_margin AS y FROM scored, pol) GROUP BY 1, 2),
g AS (SELECT tech_minimum, minimum_margin, tp, fp, fn, tn, {MEASURES} FROM c),
best AS (SELECT * FROM g ORDER BY round(f1, 9) DESC, round(precision, 9) DESC, tech_minimum, minimum_margin LIMIT 1)"""
ORDER = "md5('{0}:' || id)"


def _allocated(source: str, group: str, n: int, minimum: int = 0) -> str:
    return f"""g AS (SELECT {group} AS grp, count(*) AS count FROM {source} GROUP BY 1), m AS (SELECT *, CASE WHEN count(*) OVER () * {minimum} <= {n} THEN {minimum} ELSE 0 END AS kept FROM g),
x AS (SELECT *, CAST(count AS DOUBLE) * ({n} - sum(kept) OVER ()) / sum(count) OVER () AS exact FROM m), b AS (SELECT *, kept + CAST(floor(exact) AS BIGINT) AS base FROM x),
l AS (SELECT *, {n} - sum(base) OVER () AS rest FROM b), e AS (SELECT *, CASE WHEN base < count AND row_number() OVER (ORDER BY base < count DESC, round(exact - floor(exact), 9) DESC, count DESC, grp ASC NULLS FIRST) <= rest THEN 1 ELSE 0 END AS more FROM l),
z AS (SELECT *, rest - sum(more) OVER () AS last FROM e),
seats AS (SELECT grp, count, CAST(base + more + CASE WHEN base + more < count AND row_number() OVER (ORDER BY base + more < count DESC, count DESC, grp ASC NULLS FIRST) <= last THEN 1 ELSE 0 END AS BIGINT) AS seats FROM z)"""


def _strata(source: str, group: str, n: int, minimum: int = 0) -> str:
    return f"{_allocated(source, group, n, minimum)}, r AS (SELECT id, {group} AS grp, row_number() OVER (PARTITION BY {group} ORDER BY {ORDER.format(42)}, id) AS k FROM {source}) SELECT r.id, r.grp FROM r JOIN seats ON r.grp IS NOT DISTINCT FROM seats.grp WHERE k <= seats"


LEVEL = "CASE WHEN ambiguity >= 0.65 THEN 'high' WHEN ambiguity >= 0.35 THEN 'medium' ELSE 'low' END"


def _drawn(where: str, n: int, seed: int) -> str:
    return f"SELECT id FROM (SELECT id FROM t {where} ORDER BY {ORDER.format(seed)}, id LIMIT {n})"


HYBRID = f"""{SC}, t AS (SELECT *, {LEVEL} AS level FROM scored), p AS (SELECT DISTINCT id FROM ({_drawn('', 30, 42)} UNION ALL {_drawn("WHERE level = 'high'", 30, 43)} UNION ALL {_drawn('WHERE is_tech', 20, 44)} UNION ALL {_drawn('WHERE NOT is_tech', 20, 45)}))
SELECT id FROM (SELECT t.id, CASE WHEN p.id IS NOT NULL THEN 0 END AS picked FROM t LEFT JOIN p USING (id)) ORDER BY picked ASC NULLS LAST, {ORDER.format(46)}, id LIMIT 100"""

COMP = """
cg AS (SELECT country_code AS country, GROUPING(country_code) = 1 AS is_total, count(*) AS total, count(*) FILTER (is_tech_role) AS tech, count(*) FILTER (NOT is_tech_role) AS non_tech, count(*) FILTER (is_tech_role IS NULL) AS unclassified FROM jobs GROUP BY ROLLUP (country_code)),
cr AS (SELECT *, CASE WHEN tech + non_tech = 0 THEN 0.0 ELSE CAST(tech AS DOUBLE) / (tech + non_tech) END AS tech_ratio FROM cg),
comp AS (SELECT *, greatest(non_tech - tech, 0) AS deficit, abs(tech_ratio - 0.5) <= 0.05 AS parity FROM cr),
targets AS (SELECT country, is_total, CASE WHEN tech + non_tech = 0 OR parity THEN 'BALANCED' ELSE 'CATCH_UP' END AS mode, CAST(CASE WHEN tech + non_tech = 0 OR parity THEN 20 ELSE least(deficit, 40) END AS BIGINT) AS tech_target FROM comp)
"""
BAL = f"{WITH}, {COMP}"
GOT = "got AS (SELECT country_code AS country, count(*) FILTER (is_tech_role) AS got_tech, count(*) FILTER (NOT is_tech_role) AS got_broad FROM jobs GROUP BY 1)"
POOL = "pool AS (SELECT id, CASE WHEN id % 3 = 0 THEN CAST(id // 2 AS VARCHAR) END AS source_id, CASE WHEN id % 3 = 1 THEN 'u' || (id // 4) END AS source_url, title, company_name FROM jobs)"


def _got(v: Views):
    return v.jobs.groupBy(F.col("country_code").alias("country")).agg(F.count_if("is_tech_role").alias("got_tech"), F.count_if(~F.col("is_tech_role")).alias("got_broad"))


def _pool(v: Views):
    return v.jobs.select("id", F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 2).cast("string")).alias("source_id"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("u"), F.floor(F.col("id") / 4).cast("string"))).alias("source_url"), "title", "company_name")


def _queries(v: Views):
    return v.jobs.select(F.col("source_site").alias("query"), F.when(F.col("id") % 2 == 0, "tech").otherwise("broad").alias("intent"), F.when(F.col("id") % 7 != 0, F.col("is_tech_role")).alias("is_tech_role"))


def _levels(v: Views):
    return scored(v).withColumn("level", S.ambiguity_level(F.col("ambiguity")))


def _report(v: Views):
    """The report, written as JSON and read back; some of its fields."""
    path = f"{shared_dir(v.spark)}/report-{uuid.uuid4().hex}"
    document = E.report_document(scored(v))
    E.write_report(document, path)
    shown = {
        "tech": "class_distribution.tech", "non_tech": "class_distribution.non_tech", "default_tp": "default_policy.metrics.tp", "default_hash": "default_policy.policy_hash", "tech_minimum": "optimization.best_policy.policy.tech_minimum",
        "minimum_margin": "optimization.best_policy.policy.minimum_margin", "best_hash": "optimization.best_policy.policy_hash", "total_combinations": "optimization.total_combinations", "recommendation": "recommendations.recommendation",
        "top_reason": "recommendations.top_reason.reason", "top_count": "recommendations.top_reason.count",
    }
    rounded = {"default_f1": "default_policy.metrics.f1", "best_balanced_accuracy": "optimization.best_policy.metrics.balanced_accuracy"} | {f"{m}_gain": f"recommendations.improvement_over_default.{m}" for m in ("f1", "precision", "recall")}
    back = v.spark.read.schema(document.schema).json(path)
    return back.select("dataset_size", *(F.col(c).alias(n) for n, c in shown.items()), *(F.round(c, 9).alias(n) for n, c in rounded.items()))


ENTRIES = {
    "sa_dedupe": (
        lambda v: S.dedupe(v.drafts.withColumn("title", F.concat(F.lit(" t  "), (F.col("id") % 40).cast("string")))).select("id"),
        f"{WITH}, d AS (SELECT id, CASE WHEN id % 17 <> 0 THEN source_site || '|' || source_id ELSE lower(trim(regexp_replace(' t  ' || (id % 40) || '|' || coalesce(CASE WHEN id % 11 <> 0 THEN company_name END, '') || '|' || coalesce(substr(country_code, 1, 2), ''), '\\s+', ' ', 'g'))) END AS k FROM jobs) SELECT min(id) AS id FROM d GROUP BY k",
    ),
    "sa_levels": (lambda v: _levels(v).groupBy("level", "reason").count(), f"{SC} SELECT {LEVEL} AS level, reason, count(*) AS count FROM scored GROUP BY 1, 2"),
    "sa_allocate": (lambda v: S.allocate(active(v.jobs).groupBy(F.col("country_code").alias("grp")).count(), "grp", 333, 1), f"{WITH}, {_allocated('act', 'country_code', 333, 1)} SELECT * FROM seats"),
    "sa_random": (lambda v: S.random_sample(scored(v), 50).select("id"), f"{SC} SELECT id FROM scored ORDER BY {ORDER.format(42)}, id LIMIT 50"),
    "sa_country": (
        lambda v: S.stratified(active(v.jobs).withColumn("grp", F.coalesce("country_code", F.lit("unknown"))), "grp", 200, 1).select("id", "grp"),
        f"{WITH}, {_strata('act', 'country_code', 200, 1)}",
    ),
    "sa_class": (lambda v: S.by_class(scored(v), "is_tech", 61).select("id"), f"{SC}, t AS (SELECT * FROM scored) {_drawn('WHERE is_tech', 30, 42)} UNION ALL {_drawn('WHERE NOT is_tech', 31, 42)}"),
    "sa_ambiguity": (lambda v: S.stratified(_levels(v).withColumnRenamed("level", "grp"), "grp", 80).select("id", "grp"), f"{SC}, lv AS (SELECT *, {LEVEL} AS level FROM scored), {_strata('lv', 'level', 80)}"),
    "sa_hybrid": (lambda v: S.hybrid(_levels(v), 100).select("id"), HYBRID),
    "ev_binary": (lambda v: E.binary(scored(v)), f"{SC}, c AS (SELECT count(*) FILTER (is_tech AND predicted) AS tp, count(*) FILTER (NOT is_tech AND predicted) AS fp, count(*) FILTER (is_tech AND NOT predicted) AS fn, count(*) FILTER (NOT is_tech AND NOT predicted) AS tn FROM scored) SELECT *, {MEASURES} FROM c"),
    "ev_roc_auc": (
        lambda v: E.roc_auc(scored(v)).select(F.round("roc_auc", 9).alias("roc_auc")),
        f"{SC} SELECT round(CASE WHEN p * n = 0 THEN 0.0 ELSE (s - p * (p + 1) / 2.0) / (p * n) END, 9) AS roc_auc FROM (SELECT sum(r) FILTER (is_tech) AS s, count(*) FILTER (is_tech) AS p, count(*) FILTER (NOT is_tech) AS n FROM (SELECT is_tech, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored))",
    ),
    "ev_pr_auc": (
        lambda v: E.pr_auc(scored(v)).select(F.round("pr_auc", 9).alias("pr_auc")),
        f"""{SC}, d AS (SELECT score, count(*) FILTER (is_tech) AS pos, count(*) FILTER (NOT is_tech) AS neg FROM scored GROUP BY 1), c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p FROM d),
m AS (SELECT score, CAST(tp AS DOUBLE) / p AS r, CAST(tp AS DOUBLE) / (tp + fp) AS q FROM c), a AS (SELECT (r - lag(r, 1, 0.0) OVER (ORDER BY score DESC)) * (q + lag(q, 1, 1.0) OVER (ORDER BY score DESC)) / 2 AS area FROM m) SELECT round(sum(area), 9) AS pr_auc FROM a""",
    ),
    "ev_category_f1": (
        lambda v: E.category_f1(scored(v)).select(*(F.round(c, 9).alias(c) for c in ("category_accuracy", "macro_f1", "weighted_f1"))),
        f"""{SC}, t AS (SELECT expected_category AS label, count(*) AS support FROM scored GROUP BY 1), s AS (SELECT category AS label, count(*) AS said, count(*) FILTER (category = expected_category) AS hit FROM scored GROUP BY 1),
b AS (SELECT label, coalesce(support, 0) AS support, coalesce(said, 0) AS said, coalesce(hit, 0) AS hit FROM t FULL JOIN s USING (label)), f AS (SELECT *, {_ratio('2 * hit', 'support + said')} AS f1 FROM b)
SELECT round(CAST(sum(hit) AS DOUBLE) / sum(support), 9) AS category_accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM f""",
    ),
    "ev_reasons": (lambda v: E.reasons(scored(v)).withColumn("mean_ambiguity", F.round("mean_ambiguity", 9)), f"{SC} SELECT reason, count(*) AS count, round(avg(ambiguity), 9) AS mean_ambiguity, count(*) FILTER (ambiguity > 0.5) AS ambiguous FROM scored GROUP BY 1"),
    "ev_grid": (lambda v: E.grid(scored(v)), f"{GRID} SELECT * FROM g"),
    "ev_best_policy": (lambda v: E.best_policy(E.grid(scored(v))), f"{GRID} SELECT * FROM best"),
    "eval_report": (
        lambda v: E.report(scored(v)),
        f"{GRID}, j AS (SELECT d.f1 AS default_f1, b.tech_minimum, b.minimum_margin, b.f1 AS best_f1, (SELECT count(*) FROM scored) AS rows, (SELECT count(*) FROM scored WHERE is_tech) AS tech_rows FROM g d, best b WHERE d.tech_minimum = 8 AND d.minimum_margin = 3) SELECT *, round(best_f1 - default_f1, 9) AS improvement, CASE WHEN round(best_f1 - default_f1, 9) > 0.02 THEN 'adopt' WHEN round(best_f1 - default_f1, 9) > 0.005 THEN 'slight' ELSE 'keep' END AS recommendation FROM j",
    ),
    "snk_report": (
        _report,
        f"""{GRID}, d AS (SELECT * FROM g WHERE tech_minimum = 8 AND minimum_margin = 3), r AS (SELECT reason, count(*) AS n FROM scored GROUP BY 1 ORDER BY n DESC, reason LIMIT 1)
SELECT (SELECT count(*) FROM scored) AS dataset_size, (SELECT count(*) FROM scored WHERE is_tech) AS tech, (SELECT count(*) FROM scored WHERE NOT is_tech) AS non_tech, d.tp AS default_tp, round(d.f1, 9) AS default_f1, substr(md5('default|8.0|3.0'), 1, 8) AS default_hash,
  CAST(b.tech_minimum AS DOUBLE) AS tech_minimum, CAST(b.minimum_margin AS DOUBLE) AS minimum_margin, substr(md5('best|' || CAST(CAST(b.tech_minimum AS DOUBLE) AS VARCHAR) || '|' || CAST(CAST(b.minimum_margin AS DOUBLE) AS VARCHAR)), 1, 8) AS best_hash, round(b.balanced_accuracy, 9) AS best_balanced_accuracy, (SELECT count(*) FROM g) AS total_combinations,
  round(b.f1 - d.f1, 9) AS f1_gain, round(b.precision - d.precision, 9) AS precision_gain, round(b.recall - d.recall, 9) AS recall_gain, CASE WHEN round(b.f1 - d.f1, 9) > 0.02 THEN 'adopt' WHEN round(b.f1 - d.f1, 9) > 0.005 THEN 'slight' ELSE 'keep' END AS recommendation, r.reason AS top_reason, r.n AS top_count FROM d, best b, r""",
    ),
    "ev_hashes": (
        lambda v: E.hashes(v.posts.filter("title is not null").withColumn("skills", F.array("source_site", "language"))),
        "SELECT doc_id AS id, substr(md5('default|8.0|3.0'), 1, 8) AS policy, sha256('v1' || chr(31) || split_part(text, chr(10), 1) || chr(31) || text || chr(31) || array_to_string(list_sort([source, lang]), ',')) AS cache_key FROM documents",
    ),
    "bal_composition": (lambda v: B.composition(v.jobs), f"{BAL} SELECT * FROM comp"),
    "bal_targets": (lambda v: B.targets(B.composition(v.jobs), 40), f"{BAL} SELECT *, 40 - tech_target AS broad_target FROM targets"),
    "bal_next_intent": (
        lambda v: B.next_intent(B.composition(v.jobs), _got(v)),
        f"{BAL}, {GOT}, k AS (SELECT comp.country, CAST(tech + coalesce(got_tech, 0) AS DOUBLE) / (tech + non_tech + coalesce(got_tech, 0) + coalesce(got_broad, 0)) AS projected_ratio, coalesce(got_tech, 0) <= coalesce(got_broad, 0) AS fewer FROM comp LEFT JOIN got USING (country) WHERE NOT is_total) SELECT country, projected_ratio, CASE WHEN projected_ratio < 0.45 THEN 'tech' WHEN projected_ratio > 0.55 THEN 'broad' WHEN fewer THEN 'tech' ELSE 'broad' END AS intent FROM k",
    ),
    "bal_dedupe": (
        lambda v: B.dedupe(_pool(v)).select("id", "identity", "duplicate"),
        f"{WITH}, {POOL}, k AS (SELECT id, coalesce(source_id, source_url, md5(title || '_' || company_name)) AS identity FROM pool) SELECT id, identity, row_number() OVER (PARTITION BY identity ORDER BY id) > 1 AS duplicate FROM k",
    ),
    "bal_select": (
        lambda v: B.select_balanced(active(v.jobs), B.targets(B.composition(v.jobs), 40)).select("id"),
        f"{BAL}, r AS (SELECT id, country_code, is_tech_role, row_number() OVER (PARTITION BY country_code, is_tech_role ORDER BY id) AS place FROM act) SELECT id FROM r JOIN targets ON country = country_code AND NOT is_total WHERE place <= CASE WHEN is_tech_role THEN tech_target ELSE 40 - tech_target END",
    ),
    "bal_projected": (
        lambda v: B.composition(v.jobs.filter("id % 4 <> 0").unionByName(v.jobs.filter("id % 4 = 0").join(v.jobs.filter("id % 8 = 0").select("id"), "id", "left_semi").select(*v.jobs.columns))),
        f"{BAL.replace('FROM jobs GROUP BY ROLLUP', 'FROM jobs WHERE id % 4 <> 0 OR id % 8 = 0 GROUP BY ROLLUP')} SELECT * FROM comp",
    ),
    "bal_query_metrics": (
        lambda v: B.query_metrics(_queries(v)),
        f"{WITH}, q AS (SELECT source_site AS query, CASE WHEN id % 2 = 0 THEN 'tech' ELSE 'broad' END AS intent, CASE WHEN id % 7 <> 0 THEN is_tech_role END AS t FROM jobs) SELECT query, intent, count(*) AS new, count(*) FILTER (t) AS tech, count(*) FILTER (NOT t) AS non_tech, count(*) FILTER (t IS NULL) AS unclassified FROM q GROUP BY 1, 2",
    ),
    "bal_totals": (lambda v: B.totals(B.composition(v.jobs)), f"{BAL}, s AS (SELECT count(*) AS countries, CAST(sum(tech) AS BIGINT) AS tech, CAST(sum(non_tech) AS BIGINT) AS non_tech, bool_and(parity) AS all_at_parity FROM comp WHERE NOT is_total) SELECT *, CAST(tech AS DOUBLE) / (tech + non_tech) AS tech_ratio FROM s"),
}
