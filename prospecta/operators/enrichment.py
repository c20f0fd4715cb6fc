"""Profile overviews made from research summaries, and scholar data joined in. Sentences are this library's own wording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.functions.lists import FILLER, HEADING_TOPIC, MENU_TOPIC
from prospecta.functions.text import dept_label, empty_to_null, join_list, last_name, or_empty, stable_choice, strip


def _texts(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def needs_review(summary: Column, review: Column, rule: str = "local") -> Column:
    """Whether a profile's overview is to be written: none yet, or (rules local and strict) one that is formulaic, a placeholder or menu text."""
    held = or_empty(review)
    long_enough = F.length(strip(F.replace(or_empty(summary), F.lit("|"), F.lit(",")) if rule == "missing" else or_empty(summary))) >= 40
    poor = (
        F.contains(F.substring(held, 1, 80), F.lit("faculty member in")) | F.startswith(held, F.lit("Please provide"))
        | F.contains(held, F.lit("Close the")) | F.contains(held, F.lit("Faculty & Research menu")) | F.contains(held, F.lit("Instructional Faculty"))
    )
    absent = held == ""
    return {"missing": absent & long_enough, "local": (absent & long_enough) | (~absent & poor), "strict": long_enough & (absent | poor)}[rule]


#: Every filler and menu topic holds one of these words.
_HINTS = ("research", "faculty", "seminar", "close the", "joint", "chemistry", "center", "people", "menu", "directory")


def clean_topics(summary: Column) -> Column:
    """A summary's topics: filler and menu text removed, each once, in its first spelling.

    Most texts hold no word of a filler; one pass tells, and they skip the passes that would remove them.
    """
    text = or_empty(summary)
    # What ignoring case takes for s and k, too.
    lowered = F.lower(F.translate(text, "\u017f\u212a", "sk"))
    hinted = F.get(F.transform(F.array(lowered), lambda t: reduce(Column.__or__, [F.contains(t, F.lit(h)) for h in _HINTS])), F.lit(0))
    removed = text
    for pattern in FILLER:
        removed = F.regexp_replace(removed, f"(?iU){pattern}", "")
    parts = lambda x: F.transform(F.split(x, r"(?U)\s*\|\s*|\n"), lambda p: F.regexp_replace(strip(p), r"\.+\z", ""))
    usable = lambda p: (F.length(p) >= 3) & (F.length(p) <= 300) & ~p.rlike(f"(?iU){HEADING_TOPIC}")
    return first_spellings(F.when(hinted, F.filter(parts(removed), lambda p: usable(p) & ~p.rlike(f"(?iU){MENU_TOPIC}"))).otherwise(F.filter(parts(text), usable)))


def _with_lowered(items: Column, pick) -> Column:
    """``pick(items, lowered items)``, with both arrays bound to variables, so that each is made once and not once an item."""
    lowered = lambda xs: F.get(F.transform(F.array(F.transform(xs, F.lower)), lambda lows: pick(xs, lows)), F.lit(0))
    return F.get(F.transform(F.array(items), lowered), F.lit(0))


def first_spellings(items: Column) -> Column:
    """Each item once, ignoring case."""
    return _with_lowered(items, lambda xs, lows: F.filter(xs, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1))


def most_specific(topics: Column) -> Column:
    """Topics that aren't part of another one."""
    inside_another = lambda lows, i: F.exists(lows, lambda o: (o != F.get(lows, i)) & F.contains(o, F.get(lows, i)))
    return _with_lowered(topics, lambda xs, lows: F.filter(xs, lambda _, i: ~inside_another(lows, i)))


def keyword_style(topics: Column) -> Column:
    """Whether topics are short ones: under 50 characters on average."""
    return F.aggregate(topics, F.lit(0).cast("long"), lambda n, t: n + F.length(t)) < F.size(topics) * 50


def new_interests(interests: Column, topics: Column, n: int = 4) -> Column:
    held = F.transform(topics, F.lower)
    return F.slice(F.filter(_texts(interests), lambda i: ~F.array_contains(held, F.lower(i))), 1, n)


def generate_review(df: DataFrame, out: str = "review") -> DataFrame:
    """``df`` (name, department, research_summary, scholar_interests) with an overview, empty where there are no topics.

    Which wording a sentence takes is decided by name and department alone, so reruns agree.
    """
    interests = F.col("scholar_interests") if "scholar_interests" in df.columns else F.lit(None).cast("array<string>")
    given = df.withColumn("_t", clean_topics(F.col("research_summary"))).withColumns({
        "_k": keyword_style(F.col("_t")) & (F.size("_t") >= 2), "_i": new_interests(interests, F.col("_t")), "_d": dept_label(F.col("department"), "review"),
        "_l": last_name(F.col("name"), "This researcher"), "_s": F.concat(or_empty(F.col("name")), or_empty(F.col("department"))),
    }).withColumn("_m", F.when(F.col("_k"), most_specific(F.col("_t"))).otherwise(F.col("_t")))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pick = lambda suffix, *options: stable_choice(list(options), F.concat(F.col("_s"), F.lit(suffix)))
    lower = F.transform(F.col("_m"), F.lower)
    last, dept = F.col("_l"), F.col("_d")
    part = lambda xs, at, n: join_list(F.slice(xs, at, n))
    long_ = F.filter("_m", lambda t: F.length(t) > 80)
    short = F.transform(F.filter("_m", lambda t: F.length(t) <= 80), F.lower)
    capital = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    dotted = lambda c: F.when(F.endswith(c, F.lit(".")), c).otherwise(F.concat(c, F.lit(".")))
    three = part(lower, 1, 3)
    opening = pick(
        "open", say("Dr. ", last, " of ", dept, " has expertise in ", three, "."), say("In ", dept, ", Dr. ", last, " centres research on ", three, "."), say("Dr. ", last, " leads work in ", dept, " on ", three, "."),
        say("At ", dept, ", Dr. ", last, " studies ", three, "."), say("Dr. ", last, ", of the ", dept, " department, specialises in ", three, "."),
    )
    middle = pick("mid", *[say(s, part(lower, 4, 4), ".") for s in ("The work also covers ", "Further interests are ", "Contributions extend to ", "Another focus is on ")])
    extra = pick("extra", *[say(s, part(lower, 8, 3), ".") for s in ("Other activity includes ", "A wider portfolio reaches ")])
    long_open = dotted(pick("longopen", say("The lab of Dr. ", last, " belongs to ", dept, ". ", capital(F.get(long_, F.lit(0)))), say("In ", dept, ", the research of Dr. ", last, " is as follows: ", capital(F.get(long_, F.lit(0))))))
    short_open = pick("shortopen", say("The research of Dr. ", last, " in ", dept, " is on ", part(short, 1, 3), "."), say("In ", dept, ", Dr. ", last, " works in the areas of ", part(short, 1, 3), "."))
    scholar = pick("scholar", *[say(s, join_list(F.col("_i")), ".") for s in ("Interests named on the scholar profile are ", "The scholar profile lists ", "Scholar topics include ")])
    close = pick(
        "close", say("Students with these interests may find the lab of Dr. ", last, " a good fit."), say("This breadth makes the group of Dr. ", last, " open to students of several fields."),
        say("Recent publications of Dr. ", last, " tell more."), say("The group of Dr. ", last, " works where several areas of ", dept, " meet."),
    )
    is_long = ~F.col("_k") & (F.size(long_) > 0)
    is_short = ~F.col("_k") & (F.size(long_) == 0)
    sentences = F.array(
        F.when(F.col("_k"), opening).when(is_long, long_open).when(is_short, short_open),
        F.when(F.col("_k") & (F.size("_m") > 3), middle).when(is_long & (F.size(long_) > 1), dotted(F.get(long_, F.lit(1)))).when(is_short & (F.size(short) > 3), say("Work on ", part(short, 4, 3), " goes on too.")),
        F.when(F.col("_k") & (F.size("_m") > 7), extra), F.when(F.size("_i") > 0, scholar),
    )
    made = given.withColumn("_made", F.when(F.size("_t") > 0, F.filter(sentences, lambda s: s.isNotNull())).otherwise(F.array().cast("array<string>")))
    whole = F.when(F.size("_made") >= 2, F.concat("_made", F.array(close))).otherwise(F.col("_made"))
    return made.withColumn(out, F.array_join(whole, " ")).drop("_t", "_k", "_i", "_d", "_l", "_s", "_m", "_made")


def apply_reviews(profiles: DataFrame, reviews: DataFrame) -> DataFrame:
    """Profiles with the overviews of ``reviews`` (id, review) that aren't empty."""
    return profiles.join(reviews.select("id", F.col("review").alias("_new")), "id", "left").withColumn("ai_review", F.coalesce(empty_to_null(F.col("_new")), F.col("ai_review"))).drop("_new")


def review_prompt(name: Column, department: Column, summary: Column, interests: Column | None = None) -> Column:
    """Prompt text; with ``interests`` as the strict rule has it."""
    strict = interests is not None
    cleaned = F.substring(strip(F.replace(or_empty(summary), F.lit("|"), F.lit(", " if strict else ","))), 1, 1000)
    listed = F.when(F.size(_texts(interests)) > 0, F.concat(F.lit("\nScholar interests: "), F.array_join(_texts(interests), ", "))).otherwise(F.lit("")) if strict else F.lit("")
    return F.concat(F.lit("Write an overview of this research for students, in one paragraph of four to six sentences.\n\nName: "), or_empty(name), F.lit("\nDepartment: "), or_empty(department), F.lit("\nResearch: "), cleaned, listed)


def accept_reply(reply: Column, least: int = 50) -> Column:
    trimmed = strip(or_empty(reply))
    return F.when(F.length(trimmed) >= least, trimmed)


def scholar_candidates(profiles: DataFrame) -> DataFrame:
    """(id, user) of profiles with a scholar link and no interests yet."""
    user = empty_to_null(F.regexp_extract(or_empty(F.col("google_scholar")), r"[?&]user=([^&]+)", 1))
    return profiles.filter(F.size(_texts(F.col("scholar_interests"))) == 0).select("id", user.alias("user")).filter("user is not null")


def apply_scholar(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """Profiles with interests and publications of ``found`` (id, scholar_interests, publications), where a page was read."""
    new = found.select("id", F.col("scholar_interests").alias("_i"), F.col("publications").alias("_p"), F.lit(True).alias("_read"))
    joined = profiles.join(new, "id", "left")
    put = {c: F.when(F.col("_read"), F.col(n)).otherwise(F.col(c)) for c, n in (("scholar_interests", "_i"), ("publications", "_p"))}
    return joined.withColumns(put).drop("_i", "_p", "_read")
