"""Explainable category scores of text postings (id, title, description).

Long tables (id, category, keyword, ...) keep cost in proportion to mentions of terms that the dictionary knows.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlens.operators import dims
from laborlens.operators.terms import inside_words, mentions
from laborlens.session import stored

#: Weights of the fields, and what skills count more.
FIELD_WEIGHTS = {"title": 0.5, "description": 0.25, "skills": 0.2}
SKILLS_FACTOR = 1.5
#: A keyword's further mentions count less, and the fourth no more; the most that one gives.
DIMINISHING = (1.0, 0.5, 0.333)
EVIDENCE_CAP = 15.0
MINIMUM, MARGIN = 8.0, 3.0
DEFAULT_PENALTY = 5.0


#: These become spaces.
PUNCTUATION = "!@$%^&*()=[]{}|;:'\",<>?"
_SPACED = re.escape(PUNCTUATION) + r"\t\n\x0B\f\r"
#: Runs of those and of white space, but single spaces. All characters are named: classes of classes take several times as long.
SPACES = rf"[ {_SPACED}]{{2,}}|[{_SPACED}]"


def normalize(column: str | Column) -> Column:
    """Lower case; punctuation but + # . - / becomes a space; spaces are squeezed. Single spaces stay as they are."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), SPACES, " "))


def normalized(posts: DataFrame) -> DataFrame:
    """id and normalised fields; skills, where posts has them, is a list of names in lower case."""
    skills = [F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.trim(F.lower(s))).alias("skills")] if "skills" in posts.columns else []
    return posts.select("id", normalize("title").alias("title"), normalize("description").alias("description"), *skills)


def keyword_dim(keywords: DataFrame, aliases: DataFrame) -> DataFrame:
    """(category, keyword, weight) with aliases(alias, canonical) put in place; weights that meet are added."""
    low = lambda c: F.trim(F.lower(c))
    named = keywords.withColumn("alias", low("keyword")).join(aliases.select(low("alias").alias("alias"), low("canonical").alias("canonical")), "alias", "left")
    return named.groupBy("category", F.coalesce("canonical", "alias").alias("keyword")).agg(F.sum("weight").alias("weight"))


def keyword_hits(texts: DataFrame, keywords: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(id, source, keyword, n): mentions of each keyword in title and description of normalised texts, and names in skills, where texts has
    them, that are the keyword or its alias. A keyword of letters, digits and blanks is a whole term; another one may stand inside a word."""
    sources = texts.select("id", F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.col(s).alias("text")) for s in ("title", "description") if s in texts.columns))).alias("s")).select("id", "s.*")
    terms = keywords.select(F.lower("keyword").alias("term")).distinct().withColumn("inside", inside_words(F.col("term")))
    found = mentions(sources, terms).select("id", "source", F.col("term").alias("keyword"), "n")
    if "skills" in texts.columns:
        named = texts.select("id", F.explode("skills").alias("alias"))
        if aliases is not None:
            named = named.join(aliases.select(F.trim(F.lower("alias")).alias("alias"), F.trim(F.lower("canonical")).alias("canonical")), "alias", "left")
            named = named.select("id", F.coalesce("canonical", "alias").alias("alias"))
        equal = named.join(terms.select(F.col("term").alias("alias")), "alias", "left_semi")
        found = found.unionByName(equal.select("id", F.lit("skills").alias("source"), F.col("alias").alias("keyword"), F.lit(1).cast("bigint").alias("n")))
    return found.groupBy("id", "source", "keyword").agg(F.sum("n").alias("n"))


def field_weights(texts: DataFrame) -> DataFrame:
    """(id, source, factor): weights of the fields that are there, scaled to add up to 1, which the three of them don't; skills count half as much again."""
    given = lambda s: F.size(s) > 0 if s == "skills" else F.col(s) != ""
    fields = {s: w for s, w in FIELD_WEIGHTS.items() if s in texts.columns}
    have = F.array_compact(F.array(*(F.when(given(s), F.struct(F.lit(s).alias("source"), F.lit(w).alias("w"))) for s, w in fields.items())))
    rows = texts.select("id", have.alias("have")).withColumn("total", F.when(F.size("have") == len(FIELD_WEIGHTS), 1.0).otherwise(F.aggregate("have", F.lit(0.0), lambda a, x: a + x.w)))
    extra = F.when(F.col("h.source") == "skills", SKILLS_FACTOR).otherwise(1.0)
    return rows.select("id", "total", F.explode("have").alias("h")).select("id", "h.source", (F.col("h.w") / F.col("total") * extra).alias("factor"))


def evidence(hits: DataFrame, factors: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, category, keyword, contribution): applied weights in descending order, each further mention less, each at most the cap. Mentions of
    the sources are put side by side by plain sums, and meet a category's keyword once: no lists are collected."""
    told = hits.join(factors, ["id", "source"]).groupBy("id", "keyword").agg(
        *(F.sum(F.when(F.col("source") == s, F.col("n"))).alias(f"n_{s}") for s in FIELD_WEIGHTS), *(F.max(F.when(F.col("source") == s, F.col("factor"))).alias(f"f_{s}") for s in FIELD_WEIGHTS)
    )
    # a category may name a keyword several times
    weights = keywords.groupBy("category", "keyword").agg(F.collect_list(F.struct("weight")).alias("weights"))
    times = lambda s: F.least(F.coalesce(f"n_{s}", F.lit(0)), F.lit(3)).cast("int")
    applied = F.flatten(F.transform("weights", lambda x: F.concat(*(F.array_repeat(x.weight * F.col(f"f_{s}"), times(s)) for s in FIELD_WEIGHTS))))
    lists = told.join(weights, "keyword").select("id", "category", "keyword", F.sort_array(applied, asc=False).alias("w"))
    parts = [F.when(F.size("w") > k, F.least(F.get("w", F.lit(k)) * f, F.lit(EVIDENCE_CAP))).otherwise(0.0) for k, f in enumerate(DIMINISHING)]
    return lists.select("id", "category", "keyword", functools.reduce(lambda a, x: a + x, parts).alias("contribution"))


def category_scores(found: DataFrame) -> DataFrame:
    return found.groupBy("id", "category").agg(F.round(F.sum("contribution"), 9).alias("score")).filter("score > 0")


def title_patterns(texts: DataFrame, patterns: list[tuple] = dims.PATTERNS) -> DataFrame:
    """(id, rank, weight, strength, categories) of each pattern that the title matches."""
    tests = [F.when(F.col("title").rlike(p), F.struct(F.lit(r).alias("rank"), F.lit(w).alias("weight"), F.lit(s).alias("strength"), F.array(*map(F.lit, c)).cast("array<string>").alias("categories"))) for r, p, c, w, s in patterns]
    return texts.select("id", F.explode(F.array_compact(F.array(*tests))).alias("p")).select("id", "p.*")


def title_boost(matches: DataFrame) -> DataFrame:
    """(id, category, boost): of the heaviest pattern, the first of equals; none where it has no category."""
    best = matches.groupBy("id").agg(F.max_by(F.struct("weight", "categories"), F.struct("weight", -F.col("rank"))).alias("b"))
    return best.select("id", F.explode("b.categories").alias("category"), F.col("b.weight").alias("boost"))


def title_strength(matches: DataFrame) -> DataFrame:
    """(id, strength, category): the strongest pattern, then the heaviest, and its first category."""
    order = F.array_position(F.array(*map(F.lit, dims.STRENGTHS)), F.col("strength"))
    best = matches.groupBy("id").agg(F.max_by(F.struct("strength", "categories"), F.struct(-order, "weight", -F.col("rank"))).alias("b"))
    return best.select("id", F.col("b.strength").alias("strength"), F.try_element_at("b.categories", F.lit(1)).alias("category"))


def boosted(scores: DataFrame, boost: DataFrame) -> DataFrame:
    both = scores.join(boost, ["id", "category"], "full_outer")
    return both.select("id", "category", (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score"))


def penalties(texts: DataFrame, negatives: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, category, keyword, penalty) of negative words that the text holds: the category's own weight of the word, else its penalty. A negative
    word that is no keyword counts wherever it stands, also inside another one."""
    whole = texts.select("id", F.concat_ws(" ", "title", "description").alias("text"))
    known = keywords.select("keyword").distinct().withColumn("known", F.lit(True))
    terms = negatives.select(F.lower("keyword").alias("keyword")).distinct().join(known, "keyword", "left")
    terms = terms.select(F.col("keyword").alias("term"), (inside_words(F.col("keyword")) | F.col("known").isNull()).alias("inside"))
    words = mentions(whole, terms).select("id", F.col("term").alias("keyword")).distinct()
    own = keywords.select("category", "keyword", "weight")
    return words.join(negatives, "keyword").join(own, ["category", "keyword"], "left").select("id", "category", "keyword", F.coalesce("weight", "penalty").alias("penalty"))


def less_negatives(scores: DataFrame, texts: DataFrame, negatives: DataFrame, keywords: DataFrame) -> DataFrame:
    """Scores less the penalties(), not below 0."""
    minus = penalties(texts, negatives, keywords).groupBy("id", "category").agg(F.sum("penalty").alias("penalty"))
    return scores.join(minus, ["id", "category"], "left").select("id", "category", F.greatest(F.col("score") - F.coalesce("penalty", F.lit(0.0)), F.lit(0.0)).alias("score"))


#: Phrases that an explanation tells.
PHRASES = 10


def explanations(hits: DataFrame, texts: DataFrame, keywords: DataFrame, negatives: DataFrame, decided: DataFrame, titles: DataFrame) -> DataFrame:
    """A row for each of decided(id, category): its category's keywords found with what they weigh (skills half as much again), heaviest first, at most
    the cap; the first PHRASES phrases among them; negative words with their penalties; whether a title pattern matched."""
    shares = hits.groupBy("id", "keyword").agg(F.bool_or(F.col("source") != "skills").alias("told"), F.sum(F.when(F.col("source") == "skills", F.col("n")).otherwise(0)).alias("named"))
    held = decided.join(shares, "id").join(keywords, ["category", "keyword"])
    text = F.when(F.col("told"), F.least("weight", F.lit(EVIDENCE_CAP))).otherwise(0.0)
    held = held.select("id", "keyword", F.least(text + F.col("named") * F.least(F.col("weight") * SKILLS_FACTOR, F.lit(EVIDENCE_CAP)), F.lit(EVIDENCE_CAP)).alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "keyword")
    # descending scores, then ascending words
    listed = lambda c, score: F.transform(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("m"), F.col(c).alias("keyword")))), lambda x: F.struct(x.keyword.alias("keyword"), (-x.m).alias("score")))
    found = held.groupBy("id").agg(listed("keyword", "score").alias("keywords"))
    phrases = held.filter("contains(keyword, ' ')").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= PHRASES)
    phrases = phrases.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "keyword"))), lambda x: x.keyword).alias("phrases"))
    minus = penalties(texts, negatives, keywords).join(decided, ["id", "category"]).groupBy("id").agg(listed("keyword", "penalty").alias("negatives"))
    matched = titles.select("id").distinct().withColumn("matched", F.lit(True))
    rows = decided.join(found, "id", "left").join(phrases, "id", "left").join(minus, "id", "left").join(matched, "id", "left")
    none = F.array().cast("array<struct<keyword:string,score:double>>")
    return rows.select(
        "id", "category", F.coalesce("keywords", none).alias("keywords"), F.coalesce("phrases", F.array().cast("array<string>")).alias("phrases"),
        F.coalesce("negatives", none).alias("negatives"), F.coalesce("matched", F.lit(False)).alias("title_pattern_matched"),
    )


def ranked(scores: DataFrame, categories: DataFrame, rank: str = "priority_rank") -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last(rank), "category")
    return scores.join(categories, "category", "left").withColumn("place", F.row_number().over(order))


def theoretical_maximum(keywords: DataFrame, patterns: list[tuple] = dims.PATTERNS) -> float:
    """The most that a category's keywords can give; not below 100."""
    boost = max((p[3] * max(1, len(p[2])) for p in patterns), default=0.0)
    best = keywords.groupBy("category").agg(F.sum(F.least(F.col("weight") * 0.4, F.lit(EVIDENCE_CAP))).alias("m")).agg(F.max("m")).first()[0] or 0.0
    return max(100.0, best + boost)


def decisions(scores: DataFrame, categories: DataFrame, minimum: float = MINIMUM, margin: float = MARGIN) -> DataFrame:
    """(id, category, score, second, margin, ambiguity, outcome): the best category against the best one that competes with it. A
    parent and its child don't compete."""
    rows = ranked(scores, categories, "file_rank")
    best = rows.filter("place = 1").select("id", F.col("category").alias("best"), F.col("score").alias("best_score"), F.col("parent").alias("best_parent"), "is_tech")
    rest = rows.filter("place > 1").join(best, "id").filter(~F.coalesce(F.col("parent") == F.col("best"), F.lit(False)) & ~F.coalesce(F.col("category") == F.col("best_parent"), F.lit(False)))
    second = rest.groupBy("id").agg(F.max("score").alias("second"))
    out = best.join(second, "id", "left")
    gap = F.coalesce(F.col("best_score") - F.col("second"), F.lit(0.0))
    outcome = F.when(F.col("best_score") < minimum, "SCORE_TOO_LOW").when(F.col("second").isNotNull() & (gap < margin), "MARGIN_TOO_LOW").when(~F.col("is_tech"), "NON_TECH_CATEGORY").otherwise("SUCCESS")
    ambiguity = F.when(F.col("best_score") <= 0, 1.0).when(F.coalesce("second", F.lit(0.0)) <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("second") / F.col("best_score")))
    return out.select("id", F.col("best").alias("category"), F.col("best_score").alias("score"), "second", gap.alias("margin"), ambiguity.alias("ambiguity"), outcome.alias("outcome"))


def final(posts: DataFrame, decided: DataFrame, strength: DataFrame, hits: DataFrame) -> DataFrame:
    """A strong title is tech in its pattern's category; otherwise the decision needs evidence outside the title, two keywords if the title
    is but adjacent. What isn't tech has no category."""
    outside = hits.filter("source <> 'title'").groupBy("id").agg(F.count_distinct("keyword").alias("outside"))
    rows = posts.select("id").join(decided, "id", "left").join(strength.select("id", "strength", F.col("category").alias("by_title")), "id", "left").join(outside, "id", "left")
    need = F.when(F.col("strength") == "adjacent", 2).otherwise(1)
    strong = F.coalesce(F.col("strength") == "strong", F.lit(False)) & F.col("by_title").isNotNull()
    tech = strong | (F.coalesce(F.col("outcome") == "SUCCESS", F.lit(False)) & (F.coalesce("outside", F.lit(0)) >= need))
    category = F.when(strong, F.col("by_title")).when(tech, F.col("category"))
    return rows.select("id", tech.alias("is_tech"), category.alias("category"), F.coalesce("outcome", F.lit("NO_CATEGORIES")).alias("outcome"), "ambiguity", "score")


def classify(posts: DataFrame, keywords: DataFrame, negatives: DataFrame, categories: DataFrame, aliases: DataFrame | None = None, patterns: list[tuple] = dims.PATTERNS) -> DataFrame:
    """(id, is_tech, category, outcome, ambiguity, tech_confidence): the whole chain. A posting that isn't tech has neither category nor confidence. Normalised
    texts and mentions are written once, as several steps read them."""
    known = keywords if aliases is None else keyword_dim(keywords, aliases)
    texts = stored(normalized(posts), "texts")
    hits = stored(keyword_hits(texts, known, aliases), "hits")
    matches = title_patterns(texts, patterns)
    scores = boosted(category_scores(evidence(hits, field_weights(texts), known)), title_boost(matches))
    done = final(posts, decisions(less_negatives(scores, texts, negatives, known), categories), title_strength(matches), hits)
    sure = F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)) / F.lit(theoretical_maximum(known, patterns)))
    return done.select("id", "is_tech", "category", "outcome", "ambiguity", F.when(F.col("is_tech"), sure).alias("tech_confidence"))


def first_category(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, category) by the older rule: the first category, by rank, of which a keyword stands in title or skills; 'other' where none does. posts(id,
    title, skills list), keywords(category, keyword, rank)."""
    texts = posts.select("id", F.concat_ws(" ", F.col("title"), F.array_join("skills", " ")).alias("text"))
    terms = keywords.select("category", "rank", F.trim(F.lower("keyword")).alias("term"))
    best = mentions(texts, terms.select("term")).join(terms, "term").groupBy("id").agg(F.min_by("category", F.struct("rank", "category")).alias("category"))
    return posts.select("id").join(best, "id", "left").select("id", F.coalesce("category", F.lit("other")).alias("category"))


#: Above the first a decision is ambiguous; from the second on it is a confident one.
AMBIGUOUS, CONFIDENT = 0.5, 0.7


def flags(decided: DataFrame) -> DataFrame:
    """Adds is_ambiguous and high_confidence to rows with ambiguity and tech_confidence; nulls are neither."""
    return decided.withColumns({"is_ambiguous": F.coalesce(F.round("ambiguity", 9) > AMBIGUOUS, F.lit(False)), "high_confidence": F.coalesce(F.round("tech_confidence", 9) >= CONFIDENT, F.lit(False))})


def batch_summary(done: DataFrame) -> DataFrame:
    """Counts and percentages of a batch of decisions."""
    counts = {"tech": "is_tech", "ambiguous": "is_ambiguous", "confident": "high_confidence"}
    out = flags(done).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    return out.select("*", *(F.when(F.col("total") == 0, 0.0).otherwise(F.col(n) / F.col("total") * 100).alias(f"{n}_percentage") for n in counts))


def policy_thresholds(policies: DataFrame, overrides: DataFrame, categories: DataFrame) -> DataFrame:
    """Thresholds of every policy and category; an override's fields go before the policy's."""
    every = policies.join(categories.select("category"), F.lit(True))
    o = overrides.select("policy", "category", F.col("tech_minimum").alias("t"), F.col("minimum_margin").alias("m"))
    return every.join(o, ["policy", "category"], "left").select("policy", "category", F.coalesce("t", "tech_minimum").alias("tech_minimum"), F.coalesce("m", "minimum_margin").alias("minimum_margin"), "min_confidence")


def competitors(categories: DataFrame) -> DataFrame:
    """Pairs that compete: all but parents and their children."""
    a, b = categories.select(F.col("category").alias("a"), F.col("parent").alias("pa")), categories.select(F.col("category").alias("b"), F.col("parent").alias("pb"))
    return a.join(b, (F.col("a") != F.col("b")) & ~F.coalesce(F.col("pa") == F.col("b"), F.lit(False)) & ~F.coalesce(F.col("pb") == F.col("a"), F.lit(False))).select("a", "b")


def dim_violations(keywords: DataFrame, categories: DataFrame) -> DataFrame:
    """What is wrong with the dictionaries: weights, unknown categories and parents, repeats."""
    known = categories.select("category")
    checks = [
        keywords.filter("weight <= 0").select(F.lit("weight").alias("rule"), F.col("keyword").alias("subject")),
        keywords.join(known, "category", "left_anti").select(F.lit("category").alias("rule"), F.col("category").alias("subject")).distinct(),
        categories.filter("parent is not null").join(known.withColumnRenamed("category", "parent"), "parent", "left_anti").select(F.lit("parent").alias("rule"), F.col("parent").alias("subject")).distinct(),
        keywords.groupBy("category", "keyword").count().filter("count > 1").select(F.lit("repeat").alias("rule"), F.concat_ws(":", "category", "keyword").alias("subject")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
