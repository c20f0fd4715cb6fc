"""Matching of seekers with profiles, and keyword search, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospecta.functions.text import before_pipe, dept_label, empty_to_null, occurrences, or_empty, strip, token_hits, tokenize
from prospecta.plans import blocks, word_index

TOP, MOST, LEAST_SCORE, RESUME_WEIGHT = 20, 50, 0.1, 0.35


def resume_tokens(*lists: Column) -> Column:
    """Tokens of themes, skills, coursework and techniques, in that order."""
    none = F.array().cast("array<string>")
    return tokenize(F.array_join(F.concat(*[F.coalesce(c, none) for c in lists]), " "))


def effective_interests(requested: Column, stored: Column, trim: bool = True) -> Column:
    asked = strip(or_empty(requested)) if trim else or_empty(requested)
    return F.coalesce(empty_to_null(asked), stored, F.lit(""))


def match_score(summary: Column, name: Column, department: Column, interests: Column, resume: Column) -> Column:
    """One profile's score by scanning its text."""
    lowered = F.lower(or_empty(summary))
    everything = F.concat_ws(" ", or_empty(summary), or_empty(name), or_empty(department))
    in_summary = F.aggregate(F.transform(interests, lambda t: F.when(F.contains(lowered, t), F.lit(2.0)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    return token_hits(interests, everything) + in_summary + F.lit(RESUME_WEIGHT) * token_hits(resume, or_empty(summary))


def search_score(summary: Column, name: Column, title: Column, department: Column, tokens: Column) -> Column:
    """One profile's score for a query by scanning its text; 1 without tokens. Lowered texts are made once, then bound to a lambda's variable."""
    own = F.struct(F.lower(F.concat_ws(" ", or_empty(summary), or_empty(name), or_empty(title), or_empty(department))).alias("text"), F.lower(or_empty(name)).alias("name"), F.lower(or_empty(summary)).alias("summary"))
    one = lambda o, t: occurrences(t, o["text"]) + F.when(F.contains(o["name"], t), F.lit(5.0)).otherwise(F.lit(0.0)) + F.when(F.contains(o["summary"], t), F.lit(2.0)).otherwise(F.lit(0.0))
    scored = F.get(F.transform(F.array(own), lambda o: F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + one(o, t))), F.lit(0))
    return F.when(F.size(tokens) == 0, F.lit(1.0)).otherwise(scored)


def fit_label(score: Column, best: Column) -> Column:
    ratio = F.try_divide(score, best)
    return F.when(best == 0, F.lit("adjacent_fit")).when(ratio >= 0.6, F.lit("strong_fit")).when(ratio >= 0.25, F.lit("exploratory_fit")).otherwise(F.lit("adjacent_fit"))


def explanation(name: Column, department: Column, summary: Column, interests: Column, themes: Column) -> Column:
    rtrim = lambda c: F.regexp_replace(c, r"(?U)\s+\z", "")
    hint = F.when(F.size(themes) > 0, F.concat(F.lit(" Their background in "), F.get(themes, F.lit(0)), F.lit(" helps."))).otherwise(F.lit(""))
    return F.concat(
        or_empty(name), F.lit(" ("), dept_label(department, "match"), F.lit(") works on "), rtrim(F.substring(or_empty(summary), 1, 120)), F.lit("…, close to the interest in "),
        rtrim(F.substring(or_empty(interests), 1, 80)), F.lit("."), hint,
    )


def short_explanation(name: Column, department: Column, summary: Column, interests: Column) -> Column:
    label = F.coalesce(dept_label(department, "match"), F.lit("their department"))
    return F.concat(or_empty(name), F.lit(" ("), F.when(or_empty(department) == "", F.lit("their department")).otherwise(label), F.lit("): "), before_pipe(F.substring(or_empty(summary), 1, 130)), F.lit("… for "), F.substring(or_empty(interests), 1, 80))


def explanation_prompt(name: Column, department: Column, summary: Column, interests: Column, themes: Column, skills: Column) -> Column:
    listed = lambda c, default: F.coalesce(empty_to_null(F.array_join(F.slice(c, 1, 5), ", ")), F.lit(default))
    return F.concat(
        F.lit("Profile: "), or_empty(name), F.lit(", "), or_empty(department), F.lit("\nResearch: "), F.substring(or_empty(summary), 1, 400), F.lit("\n\nInterests: "), or_empty(interests),
        F.lit("\nThemes: "), listed(themes, "general engineering"), F.lit("\nSkills: "), listed(skills, "various tools"), F.lit("\n\nExplain the match in two sentences."),
    )


def ranked(scored: DataFrame, by: str, n: int, ties: list[str]) -> DataFrame:
    """The best ``n`` of each ``by``, ranked from 1; ties in input order. Spark keeps n per group before it shuffles."""
    if n < 0:
        raise ValueError("n must not be negative")
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _weights(seekers: DataFrame, id_col: str, **lists: str) -> DataFrame:
    """(seeker, token, one count per list): repeats of a token count."""

    def counted(kind: str):
        return lambda t: F.struct(t.alias("token"), *[F.lit(int(kind == g)).alias(g) for g in lists])

    each = [F.transform(F.col(c), counted(k)) for k, c in lists.items()]
    rows = seekers.select(F.col(id_col).alias("seeker"), F.explode(F.concat(*each)).alias("t")).select("seeker", "t.*")
    return rows.groupBy("seeker", "token").agg(*[F.sum(k).alias(k) for k in lists])


def _match(counts: dict, weights: dict):
    """(profile, seeker) scores from token counts by field and the seekers' tokens."""
    everywhere, inside = counts["summary"] + counts["name"] + counts["department"], counts["summary"] > 0
    interest = everywhere + 1.5 * (everywhere > 0) + 2.0 * inside
    return interest @ weights["interest"] + RESUME_WEIGHT * ((counts["summary"] + 1.5 * inside) @ weights["resume"])


def _search(counts: dict, weights: dict):
    return (sum(counts.values()) + 5.0 * (counts["name"] > 0) + 2.0 * (counts["summary"] > 0)) @ weights["times"]


def match_scores(profiles: DataFrame, seekers: DataFrame, n: int = TOP, index: str | None = None) -> DataFrame:
    """(session_id, id, seed_ord, score) of pairs that score, each seeker's best ``n`` among them; seekers have session_id, interest_tokens, resume_tokens.

    With ``index``, the path of these profiles' word index, texts aren't read.
    """
    wanted = _weights(seekers, "session_id", interest="interest_tokens", resume="resume_tokens").withColumnRenamed("seeker", "key")
    how = (wanted, ["interest", "resume"], _match, ["summary", "name", "department"], n, LEAST_SCORE)
    found = word_index.best(profiles.sparkSession, index, *how) if index else blocks.best(profiles, *how)
    return found.withColumnRenamed("key", "session_id")


def _or_first(best: DataFrame, keys: DataFrame, key: str, profiles: DataFrame, n: int) -> DataFrame:
    """``best`` (key, id, score, rank) and, for ``keys`` that have no row there, the first ``n`` profiles with score 1."""
    order = profiles.select("id", "seed_ord")
    first = order.orderBy("seed_ord").limit(n).withColumn("rank", F.row_number().over(Window.orderBy("seed_ord")))
    # The first n profiles, one row each, go to every task; which of both a key keeps is decided in one pass over its rows.
    rest = keys.select(key).withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(max(n, 1))))).join(F.broadcast(first), "rank").select(key, "id", F.lit(1.0).alias("score"), "rank", F.lit(0).alias("found"))
    every = best.select(key, "id", "score", "rank", F.lit(1).alias("found")).unionByName(rest)
    return every.withColumn("_most", F.max("found").over(Window.partitionBy(key))).filter("found = _most").drop("found", "_most")


def match_profiles(profiles: DataFrame, seekers: DataFrame, n: int = TOP, digits: int = 4, index: str | None = None) -> DataFrame:
    """The best ``n`` profiles of each seeker with score, fit and rank; seekers without a match get the first ``n`` profiles.

    ``profiles`` carry seed_ord, the order that breaks ties. Texts are joined back after ranking.
    """
    n = min(n, MOST)
    best = ranked(match_scores(profiles, seekers, n, index), "session_id", n, ["seed_ord"])
    every = _or_first(best, seekers, "session_id", profiles, n)
    top = F.max("score").over(Window.partitionBy("session_id"))
    return every.withColumn("fit_label", fit_label(F.col("score"), top)).withColumn("score", F.round("score", digits))


def filter_profiles(profiles: DataFrame, department: str | None = None, has_research: bool = False) -> DataFrame:
    out = profiles.filter(F.col("department") == department) if department else profiles
    return out.filter(F.col("research_summary").rlike(r"(?U)\S")) if has_research else out


def scored(profiles: DataFrame, query: str, department: str | None = None, has_research: bool = False) -> DataFrame:
    """Profiles that match a query, with score, in no order; an empty query keeps all with score 1."""
    score = search_score(F.col("research_summary"), F.col("name"), F.col("title"), F.col("department"), tokenize(F.lit(query)))
    # Exploded from an array of one, the score is made once; a plain column would be made again for the filter and the sort.
    return filter_profiles(profiles, department, has_research).select("*", F.explode(F.array(score)).alias("score")).filter("score > 0")


def search_and_rank(profiles: DataFrame, query: str, department: str | None = None, has_research: bool = False) -> DataFrame:
    """Profiles that match a query, best first; without words all in input order."""
    return scored(profiles, query, department, has_research).orderBy(F.col("score").desc(), "seed_ord")


def search_batch(profiles: DataFrame, queries: DataFrame, k: int = 24, index: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` profiles for each row of ``queries`` (query_id, query); with ``index`` texts aren't read."""
    asked = queries.select("query_id", tokenize(F.col("query")).alias("tokens"))
    wanted = _weights(asked, "query_id", times="tokens").withColumnRenamed("seeker", "key")
    how = (wanted, ["times"], _search, list(blocks.FIELDS), k, 0.5)
    found = word_index.best(profiles.sparkSession, index, *how) if index else blocks.best(profiles, *how)
    found = found.withColumnRenamed("key", "query_id")
    none = asked.filter(F.size("tokens") == 0)
    return _or_first(ranked(found, "query_id", k, ["seed_ord"]), none, "query_id", profiles, k)


def paginate(df: DataFrame, page: int, order: list, size: int = 24) -> DataFrame:
    """One page by sorting up to it: for the first pages of a result. ``plans.ranks`` gives pages of any depth; numbers beyond the ends are taken as the nearest page."""
    if not isinstance(page, int):
        raise TypeError("page must be a whole number")
    pages = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(page, 1), pages) - 1) * size).limit(size)


def result_counts(df: DataFrame, size: int = 24) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("results")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("results") / size)).cast("long"))


def departments(profiles: DataFrame) -> DataFrame:
    return profiles.filter("department <> ''").select("department").distinct().orderBy("department")


def corpus_totals(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.count(F.lit(1)).alias("profiles"), F.count_distinct(F.expr("nullif(department, '')")).alias("departments"))


def profile_publications(profiles: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` publications of each profile with their position."""
    return profiles.select("id", F.posexplode(F.slice("publications", 1, n)).alias("position", "publication")).select("id", "position", "publication.*")
