"""Registered queries of the classifier, and their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from laborlens.operators import classify as C
from laborlens.operators import dims as D
from laborlens.plans.views import Views
from laborlens.session import stored


def _values(rows, names: str) -> str:
    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, list):
            return "CAST([" + ", ".join(map(lit, x)) + "] AS VARCHAR[])"
        if isinstance(x, float):
            return f"CAST({x} AS DOUBLE)"
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names}))"


WORD = r"[^\p{L}\p{N}\p{M}_]"
NORM = r"trim(regexp_replace(translate(lower(coalesce({0}, '')), '!@$%^&*()=[]{{}}|;:''\",<>?', repeat(' ', 23)), '\s+', ' ', 'g'))".replace('\\"', '"')
DIMS = f"""
al AS {_values(D.ALIASES, 'keyword, canonical')}, kw AS (SELECT category, coalesce(canonical, keyword) AS keyword, sum(weight) AS weight FROM {_values(D.KEYWORDS, 'category, keyword, weight')} k LEFT JOIN al USING (keyword) GROUP BY 1, 2), neg AS {_values(D.NEGATIVES, 'category, keyword, penalty')}, cat AS {_values(D.CATEGORIES, 'category, parent, is_tech, file_rank, priority_rank')},
pat AS {_values(D.PATTERNS, 'rank, pattern, categories, weight, strength')}, pol AS {_values(D.POLICIES, 'policy, tech_minimum, minimum_margin, min_confidence')}, ovr AS {_values(D.OVERRIDES, 'policy, category, t, m')}"""
TEXTS = f"""WITH {DIMS}, posts AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS description FROM documents),
texts AS (SELECT id, {NORM.format('title')} AS title, {NORM.format('description')} AS description FROM posts)"""
PLAIN = r"regexp_full_match(keyword, '[a-zA-Z0-9\s]+')"
HITS = f"""{TEXTS}, src AS (SELECT id, 'title' AS source, title AS text FROM texts UNION ALL SELECT id, 'description', description FROM texts),
tok AS (SELECT id, source, unnest(regexp_split_to_array(text, '{WORD}+')) AS keyword FROM src),
one AS (SELECT id, source, keyword, count(*) AS n FROM tok WHERE keyword IN (SELECT keyword FROM kw WHERE keyword NOT LIKE '% %' AND {PLAIN}) GROUP BY 1, 2, 3),
ph AS (SELECT DISTINCT keyword FROM kw WHERE keyword LIKE '% %' AND {PLAIN}), sp AS (SELECT DISTINCT keyword FROM kw WHERE NOT {PLAIN}),
two AS (SELECT id, source, keyword, len(regexp_extract_all(' ' || regexp_replace(text, '({WORD})', '\\1\\1', 'g') || ' ', '{WORD}' || replace(keyword, ' ', '  ') || '{WORD}')) AS n FROM src, ph),
tri AS (SELECT id, source, keyword, (length(text) - length(replace(text, keyword, ''))) // length(keyword) AS n FROM src, sp),
hits AS (SELECT * FROM one UNION ALL SELECT * FROM two WHERE n > 0 UNION ALL SELECT * FROM tri WHERE n > 0)"""
FACTORS = "fac AS (SELECT id, source, CASE source WHEN 'title' THEN 0.5 ELSE 0.25 END::DOUBLE / (CASE WHEN title <> '' THEN 0.5 ELSE 0 END + CASE WHEN description <> '' THEN 0.25 ELSE 0 END)::DOUBLE AS factor FROM texts, (VALUES ('title'), ('description')) s(source) WHERE CASE source WHEN 'title' THEN title ELSE description END <> '')"
EVIDENCE = f"""{HITS}, {FACTORS}, app AS (SELECT id, category, keyword, weight * factor AS w, unnest(range(least(n, 3))) AS i FROM hits JOIN fac USING (id, source) JOIN kw USING (keyword)),
rk AS (SELECT id, category, keyword, w, row_number() OVER (PARTITION BY id, category, keyword ORDER BY w DESC) AS k FROM app),
evi AS (SELECT id, category, keyword, sum(least(w * CASE k WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.333 END::DOUBLE, 15.0)) AS contribution FROM rk WHERE k <= 3 GROUP BY 1, 2, 3)"""
SCORES = f"{EVIDENCE}, sc AS (SELECT id, category, round(sum(contribution), 9) AS score FROM evi GROUP BY 1, 2 HAVING round(sum(contribution), 9) > 0)"
TITLES = "mt AS (SELECT id, rank, weight, strength, categories FROM texts JOIN pat ON regexp_matches(title, pattern))"
BOOST = "bo AS (SELECT id, unnest(c) AS category, w AS boost FROM (SELECT id, first(categories ORDER BY weight DESC, rank) AS c, max(weight) AS w FROM mt GROUP BY 1))"
STRENGTH = "st AS (SELECT id, first(strength ORDER BY o, weight DESC, rank) AS strength, first(categories ORDER BY o, weight DESC, rank)[1] AS category FROM (SELECT *, list_position(['strong', 'potential', 'adjacent', 'ambiguous'], strength) AS o FROM mt) GROUP BY 1)"
BOOSTED = f"{SCORES}, {TITLES}, {BOOST}, bs AS (SELECT id, category, coalesce(score, 0) + coalesce(boost, 0) AS score FROM sc FULL JOIN bo USING (id, category))"
LESS = f"""{BOOSTED}, ng AS (SELECT DISTINCT keyword, NOT {PLAIN} OR keyword NOT IN (SELECT keyword FROM kw) AS inside FROM neg),
wd AS (SELECT id, keyword FROM (SELECT id, unnest(regexp_split_to_array(title || ' ' || description, '{WORD}+')) AS keyword FROM texts) t JOIN ng USING (keyword) WHERE NOT inside
  UNION SELECT id, keyword FROM texts, ng WHERE inside AND contains(title || ' ' || description, keyword)),
mi AS (SELECT id, neg.category, sum(coalesce(weight, penalty)) AS penalty FROM wd JOIN neg USING (keyword) LEFT JOIN kw ON kw.category = neg.category AND kw.keyword = neg.keyword GROUP BY 1, 2),
ls AS (SELECT id, category, greatest(score - coalesce(penalty, 0), 0) AS score FROM bs LEFT JOIN mi USING (id, category))"""
DECIDED = f"""{LESS}, rn AS (SELECT ls.*, parent, is_tech, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, file_rank, category) AS place FROM ls JOIN cat USING (category)),
be AS (SELECT id, category, score, parent, is_tech FROM rn WHERE place = 1),
se AS (SELECT rn.id, max(rn.score) AS second FROM rn JOIN be ON rn.id = be.id WHERE place > 1 AND NOT coalesce(rn.parent = be.category, false) AND NOT coalesce(rn.category = be.parent, false) GROUP BY 1),
de AS (SELECT id, category, score, second, coalesce(score - second, 0) AS margin, CASE WHEN score <= 0 THEN 1.0 WHEN coalesce(second, 0) <= 0 THEN 0.0 ELSE least(1.0, second / score) END AS ambiguity,
  CASE WHEN score < 8 THEN 'SCORE_TOO_LOW' WHEN second IS NOT NULL AND score - second < 3 THEN 'MARGIN_TOO_LOW' WHEN NOT is_tech THEN 'NON_TECH_CATEGORY' ELSE 'SUCCESS' END AS outcome FROM be LEFT JOIN se USING (id))"""
KW_MAX = "greatest(100.0, (SELECT max(m) FROM (SELECT sum(least(weight * 0.4, 15.0)) AS m FROM kw GROUP BY category)) + (SELECT max(weight * greatest(1, len(categories))) FROM pat))"
FINAL = f"""{DECIDED}, {STRENGTH}, ou AS (SELECT id, count(DISTINCT keyword) AS outside FROM hits WHERE source <> 'title' GROUP BY 1),
fj AS (SELECT posts.id, de.category, outcome, ambiguity, score, strength, st.category AS by_title, coalesce(outside, 0) AS outside, coalesce(strength = 'strong', false) AND st.category IS NOT NULL AS strong FROM posts LEFT JOIN de USING (id) LEFT JOIN st USING (id) LEFT JOIN ou USING (id)),
fi AS (SELECT id, strong OR (coalesce(outcome = 'SUCCESS', false) AND outside >= CASE WHEN strength = 'adjacent' THEN 2 ELSE 1 END) AS is_tech, strong, category, by_title, coalesce(outcome, 'NO_CATEGORIES') AS outcome, ambiguity, score FROM fj),
done AS (SELECT id, is_tech, CASE WHEN strong THEN by_title WHEN is_tech THEN category END AS category, outcome, ambiguity, CASE WHEN is_tech THEN least(1.0, coalesce(score, 0) / {KW_MAX}) END AS tech_confidence FROM fi)"""


#: Skills of the test texts: the first words of a title; some postings have none.
SKILLED = f"""{HITS}, sl AS (SELECT id, unnest(list_slice(string_split(posts.title, ' '), 1, 6)) AS skill FROM posts WHERE id % 5 <> 0),
hs AS (SELECT * FROM hits UNION ALL SELECT id, 'skills', coalesce(canonical, lower(trim(skill))) AS keyword, count(*) FROM sl LEFT JOIN al ON al.keyword = lower(trim(skill)) WHERE coalesce(canonical, lower(trim(skill))) IN (SELECT keyword FROM kw) GROUP BY 1, 2, 3),
tl AS (SELECT id, title <> '' AS t, description <> '' AS d, id % 5 <> 0 AS s FROM texts),
fs AS (SELECT id, source, w / CASE WHEN t AND d AND s THEN 1.0 ELSE (CASE WHEN t THEN 0.5 ELSE 0 END + CASE WHEN d THEN 0.25 ELSE 0 END + CASE WHEN s THEN 0.2 ELSE 0 END)::DOUBLE END * CASE source WHEN 'skills' THEN 1.5 ELSE 1.0 END::DOUBLE AS factor
  FROM tl, (VALUES ('title', 0.5::DOUBLE), ('description', 0.25::DOUBLE), ('skills', 0.2::DOUBLE)) v(source, w) WHERE CASE source WHEN 'title' THEN t WHEN 'description' THEN d ELSE s END),
ap AS (SELECT id, category, keyword, weight * factor AS w, unnest(range(least(n, 3))) AS i FROM hs JOIN fs USING (id, source) JOIN kw USING (keyword)),
ak AS (SELECT id, category, keyword, w, row_number() OVER (PARTITION BY id, category, keyword ORDER BY w DESC) AS k FROM ap),
ev AS (SELECT id, category, keyword, sum(least(w * CASE k WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.333 END::DOUBLE, 15.0)) AS contribution FROM ak WHERE k <= 3 GROUP BY 1, 2, 3)"""


def _skilled(v: Views):
    posts = v.posts.withColumn("skills", F.when(F.col("id") % 5 != 0, F.slice(F.split("title", " "), 1, 6)))
    known = C.keyword_dim(D.keywords(v.spark), D.aliases(v.spark))
    texts = C.normalized(posts)
    return C.evidence(C.keyword_hits(texts, known, D.aliases(v.spark)), C.field_weights(texts), known)


def _explained(v: Views):
    c = _Chain(v)
    shown = lambda name, of: F.array_join(F.transform(name, of), ";").alias(name)
    told = lambda x: F.concat_ws(":", x.keyword, F.format_number(x.score, 2))
    return C.explanations(c.hits, c.texts, c.kw, c.neg, c.decided.select("id", "category"), c.titles).select(
        "id", "category", shown("keywords", told), shown("phrases", lambda x: x), shown("negatives", told), "title_pattern_matched"
    )


class _Chain:
    """The steps up to the one that a query shows."""

    def __init__(self, v: Views):
        s = self.spark = v.spark
        self.alias = D.aliases(s)
        self.posts, self.kw, self.neg, self.cat = v.posts, C.keyword_dim(D.keywords(s), self.alias), D.negatives(s), D.categories(s)
        #: For what reads the texts once.
        self.fresh = C.normalized(v.posts)

    @functools.cached_property
    def texts(self):
        """For several steps: written once."""
        return stored(self.fresh, "texts")

    @functools.cached_property
    def hits(self):
        return stored(C.keyword_hits(self.texts, self.kw, self.alias), "hits")

    @functools.cached_property
    def evidence(self):
        return C.evidence(self.hits, self.factors, self.kw)

    factors = property(lambda s: C.field_weights(s.texts))
    scores = property(lambda s: C.category_scores(s.evidence))
    titles = property(lambda s: C.title_patterns(s.texts))
    boosted = property(lambda s: C.boosted(s.scores, C.title_boost(s.titles)))
    less = property(lambda s: C.less_negatives(s.boosted, s.texts, s.neg, s.kw))
    decided = property(lambda s: C.decisions(s.less, s.cat))
    final = property(lambda s: C.classify(s.posts, D.keywords(s.spark), s.neg, s.cat, s.alias))


def _r(df, *names: str):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _matched(v: Views):
    """Keywords of the decided category with their contributions."""
    c = _Chain(v)
    # read for the decision and for the result
    c.evidence = stored(c.evidence, "evidence")
    return _r(c.evidence.join(c.decided.select("id", "category"), ["id", "category"]).select("id", "category", "keyword", "contribution"), "contribution")


def _found(v: Views):
    c = _Chain(v)
    return C.keyword_hits(c.fresh, c.kw, c.alias)


#: category, keyword, rank of the older rule.
FIRST = [("licence", "apache license", 1), ("licence", "version 2.0", 2), ("german", "und", 3), ("spanish", "src3", 4), ("english", "of the", 5), ("english", "and", 6)]
_FIRST = " UNION ALL ".join(f"SELECT id, '{c}' AS category, {rank} AS rank FROM posts WHERE regexp_matches(t, '(^|{WORD}){k.replace('.', chr(92) + '.')}($|{WORD})')" for c, k, rank in FIRST)

ENTRIES = {
    "cl_normalize": (lambda v: C.normalized(v.posts).select("id", "title", F.md5("description").alias("digest")), f"{TEXTS} SELECT id, title, md5(description) AS digest FROM texts"),
    "cl_keyword_hits": (_found, f"{HITS} SELECT id, source, keyword, n FROM hits"),
    "cl_field_weights": (lambda v: _r(C.field_weights(_Chain(v).fresh), "factor"), f"{TEXTS}, {FACTORS} SELECT id, source, round(factor, 6) AS factor FROM fac"),
    "cl_evidence": (lambda v: _r(_Chain(v).evidence, "contribution"), f"{EVIDENCE} SELECT id, category, keyword, round(contribution, 6) AS contribution FROM evi"),
    "cl_category_scores": (lambda v: _r(_Chain(v).scores, "score"), f"{SCORES} SELECT id, category, round(score, 6) AS score FROM sc"),
    "cl_title_boost": (lambda v: C.title_boost(C.title_patterns(_Chain(v).fresh)), f"{TEXTS}, {TITLES}, {BOOST} SELECT * FROM bo"),
    "cl_title_strength": (lambda v: C.title_strength(C.title_patterns(_Chain(v).fresh)), f"{TEXTS}, {TITLES}, {STRENGTH} SELECT * FROM st"),
    "cl_negative": (lambda v: _r(_Chain(v).less, "score"), f"{LESS} SELECT id, category, round(score, 6) AS score FROM ls"),
    "cl_best_category": (
        lambda v: _r(C.ranked(_Chain(v).less, D.categories(v.spark)).filter("place = 1").select("id", "category", "score"), "score"),
        f"{LESS} SELECT id, category, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, priority_rank, category) AS place FROM ls JOIN cat USING (category)) WHERE place = 1",
    ),
    "cl_top5": (
        lambda v: _r(C.ranked(_Chain(v).less, D.categories(v.spark)).filter("place <= 5").select("id", "place", "category", "score"), "score"),
        f"{LESS} SELECT id, CAST(place AS INTEGER) AS place, category, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, priority_rank, category) AS place FROM ls JOIN cat USING (category)) WHERE place <= 5",
    ),
    "cl_skill_evidence": (lambda v: _r(_skilled(v), "contribution"), f"{SKILLED} SELECT id, category, keyword, round(contribution, 6) AS contribution FROM ev"),
    "cl_explanations": (
        _explained,
        f"""{DECIDED}, mk AS (SELECT DISTINCT hits.id, kw.category, keyword, least(weight, 15.0) AS w FROM hits JOIN kw USING (keyword)),
ks AS (SELECT id, category, string_agg(keyword || ':' || printf('%.2f', w), ';' ORDER BY w DESC, keyword) AS keywords FROM mk GROUP BY 1, 2),
ps AS (SELECT id, category, string_agg(keyword, ';' ORDER BY w DESC, keyword) AS phrases FROM (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY w DESC, keyword) AS k FROM mk WHERE contains(keyword, ' ')) WHERE k <= 10 GROUP BY 1, 2),
ns AS (SELECT id, neg.category, string_agg(keyword || ':' || printf('%.2f', coalesce(weight, penalty)), ';' ORDER BY coalesce(weight, penalty) DESC, keyword) AS negatives FROM wd JOIN neg USING (keyword) LEFT JOIN kw ON kw.category = neg.category AND kw.keyword = neg.keyword GROUP BY 1, 2)
SELECT de.id, de.category, coalesce(keywords, '') AS keywords, coalesce(phrases, '') AS phrases, coalesce(negatives, '') AS negatives, de.id IN (SELECT id FROM mt) AS title_pattern_matched
FROM de LEFT JOIN ks ON ks.id = de.id AND ks.category = de.category LEFT JOIN ps ON ps.id = de.id AND ps.category = de.category LEFT JOIN ns ON ns.id = de.id AND ns.category = de.category""",
    ),
    "cl_confidence": (
        lambda v: _Chain(v).decided.select("id", F.round(F.least(F.lit(1.0), F.col("score") / F.lit(C.theoretical_maximum(_Chain(v).kw))), 6).alias("confidence")),
        f"{DECIDED} SELECT id, round(least(1.0, score / {KW_MAX}), 6) AS confidence FROM de",
    ),
    "cl_matched_terms": (_matched, f"{DECIDED} SELECT evi.id, evi.category, keyword, round(contribution, 6) AS contribution FROM evi JOIN de ON evi.id = de.id AND evi.category = de.category"),
    "cl_first_category": (
        lambda v: C.first_category(v.posts.select("id", "title", F.array("source_site").alias("skills")), v.spark.createDataFrame(FIRST, "category string, keyword string, rank int")),
        f"""WITH posts AS (SELECT doc_id AS id, lower(split_part(text, chr(10), 1) || ' ' || source) AS t FROM documents), m AS ({_FIRST})
SELECT posts.id, coalesce(category, 'other') AS category FROM posts LEFT JOIN (SELECT id, first(category ORDER BY rank) AS category FROM m GROUP BY 1) b USING (id)""",
    ),
    "cl_decision": (lambda v: _r(_Chain(v).decided, "score", "second", "margin", "ambiguity"), f"{DECIDED} SELECT id, category, round(score, 6) AS score, round(second, 6) AS second, round(margin, 6) AS margin, round(ambiguity, 6) AS ambiguity, outcome FROM de"),
    "cl_final": (
        lambda v: _r(C.flags(_Chain(v).final), "ambiguity", "tech_confidence"),
        f"{FINAL} SELECT id, is_tech, category, outcome, round(ambiguity, 6) AS ambiguity, round(tech_confidence, 6) AS tech_confidence, coalesce(round(ambiguity, 9) > 0.5, false) AS is_ambiguous, coalesce(round(tech_confidence, 9) >= 0.7, false) AS high_confidence FROM done",
    ),
    "cl_batch_summary": (
        lambda v: C.batch_summary(_Chain(v).final),
        f"""{FINAL}, cn AS (SELECT count(*) AS total, count(*) FILTER (is_tech) AS tech, count(*) FILTER (round(ambiguity, 9) > 0.5) AS ambiguous, count(*) FILTER (round(tech_confidence, 9) >= 0.7) AS confident FROM done)
SELECT *, CAST(tech AS DOUBLE) / total * 100 AS tech_percentage, CAST(ambiguous AS DOUBLE) / total * 100 AS ambiguous_percentage, CAST(confident AS DOUBLE) / total * 100 AS confident_percentage FROM cn""",
    ),
}
