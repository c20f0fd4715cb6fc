"""Outreach drafts: texts from templates (this library's own wording), prompts, and replies read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.functions.text import before_pipe, empty_to_null, or_empty, strip

TONES = ("professional", "warm", "concise")
TONE_NOTES = {"professional": "Tone: formal.", "warm": "Tone: warm and respectful.", "concise": "Tone: very short, under 200 words."}


def subject_and_body(profile: dict[str, Column], seeker: dict[str, Column], interests: Column, tone: Column, variant: str = "py") -> Column:
    """struct(subject, body). ``profile``: name, research_summary; ``seeker``: name, major, year, technical_skills. Tones that aren't known are professional."""
    own = F.coalesce(empty_to_null(seeker["name"]), F.lit("Student"))
    field = F.coalesce(empty_to_null(seeker["major"]), F.lit("Engineering"))
    year = F.coalesce(F.concat(empty_to_null(seeker["year"]), F.lit(" ")), F.lit(""))
    default = "engineering tools and methods" if variant == "py" else "engineering tools"
    skills = F.coalesce(empty_to_null(F.array_join(F.slice(seeker["technical_skills"], 1, 3), ", ")), F.lit(default))
    start = F.substring(or_empty(profile["research_summary"]), 1, 160)
    research = F.regexp_replace(start, r"[.,]+\z", "") if variant == "py" else before_pipe(start)
    wish, to = F.substring(or_empty(interests), 1, 120), F.coalesce(profile["name"], F.lit("Professor"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    hello = say("Dear Prof. ", to, ",\n\n")
    me = say(own, ", a ", year, field, " student")
    body = (
        F.when(tone == "concise", say(hello, "I am ", me, ". Your work on ", research, "… meets my interest in ", wish, ".\n\nI know ", skills, ". Could we talk briefly?\n\nBest regards,\n", own))
        .when(tone == "warm", say(hello, "Of all the pages I read this week, yours stayed with me: ", research, "… is close to ", wish, ", which I can't stop thinking about.\n\nI am ", me, ". What I could bring along is ", skills, ". May I come by one day?\n\nWith all good wishes,\n", own))
        .otherwise(say(hello, "I am ", me, ". Exploring research in ", wish, ", I came across your work on ", research, "….\n\nMay I ask whether your group has openings? I have experience with ", skills, ".\n\nSincerely,\n", own))
    )
    return F.struct(say("Research opportunity: ", own).alias("subject"), body.alias("body"))


def draft_emails(matches: DataFrame, tone: str = "professional", variant: str = "py") -> DataFrame:
    """A draft per row of ``matches``: name, research_summary, parsed_profile, interests."""
    seeker = {c: F.col(f"parsed_profile.{c}") for c in ("name", "major", "year", "technical_skills")}
    made = subject_and_body({"name": F.col("name"), "research_summary": F.col("research_summary")}, seeker, F.col("interests"), F.lit(tone), variant)
    return matches.withColumn("_draft", made).withColumns({"subject": F.col("_draft.subject"), "body": F.col("_draft.body"), "tone": F.lit(tone)}).drop("_draft")


def draft_prompt(profile: dict[str, Column], seeker: dict[str, Column], interests: Column, tone: str = "professional", most: int = 500) -> Column:
    listed = lambda c, n, default: F.coalesce(empty_to_null(F.array_join(F.slice(c, 1, n), ", ")), default)
    return F.concat(
        F.lit("To: "), or_empty(profile["name"]), F.lit("\nTitle: "), or_empty(profile["title"]), F.lit("\nDepartment: "), or_empty(profile["department"]),
        F.lit("\nResearch: "), F.substring(or_empty(profile["research_summary"]), 1, most), F.lit("\n\nFrom: "), F.coalesce(empty_to_null(seeker["name"]), F.lit("the student")),
        F.lit("\nYear and major: "), or_empty(seeker["year"]), F.lit(" "), F.coalesce(empty_to_null(seeker["major"]), F.lit("engineering")), F.lit("\nInterests: "), or_empty(interests),
        F.lit("\nThemes: "), listed(seeker["inferred_themes"], 4, or_empty(interests)), F.lit("\nSkills: "), listed(seeker["technical_skills"], 5, F.lit("various tools")),
        F.lit("\n\n" + TONE_NOTES.get(tone, TONE_NOTES["professional"]) + "\n\nWrite the email."),
    )


def parse_draft(reply: Column) -> Column:
    """struct(subject, body): the last subject line before the body; the body starts after the first blank line that follows a subject."""
    start = F.struct(F.lit("").alias("subject"), F.lit(False).alias("in_body"), F.array().cast("array<string>").alias("lines"))
    is_subject = lambda line: F.startswith(F.lower(line), F.lit("subject:"))

    def step(acc: Column, line: Column) -> Column:
        subject = F.when(~acc["in_body"] & is_subject(line), strip(F.substr(line, F.lit(9)))).otherwise(acc["subject"])
        opens = ~acc["in_body"] & ~is_subject(line) & (acc["subject"] != "") & (strip(line) == "")
        return F.struct(subject.alias("subject"), (acc["in_body"] | opens).alias("in_body"), F.when(acc["in_body"], F.concat(acc["lines"], F.array(line))).otherwise(acc["lines"]).alias("lines"))

    return F.aggregate(F.split(strip(or_empty(reply)), "\r\n|\r|\n"), start, step, lambda acc: F.struct(acc["subject"].alias("subject"), strip(F.array_join(acc["lines"], "\n")).alias("body")))


def check_tone(df: DataFrame, tone_col: str = "tone") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): a missing tone is professional, one that isn't known is rejected."""
    filled = df.withColumn(tone_col, F.coalesce(F.col(tone_col), F.lit(TONES[0])))
    return filled.filter(F.col(tone_col).isin(*TONES)), filled.filter(~F.col(tone_col).isin(*TONES))


def draft_text(subject: Column, body: Column) -> Column:
    return F.concat(F.lit("Subject: "), or_empty(subject), F.lit("\n\n"), or_empty(body))
