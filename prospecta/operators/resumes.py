"""Structured profiles from résumé texts, by terms that the lowered text holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.functions.lists import MAJORS, SKILLS, TECHNIQUES, THEMES, YEARS
from prospecta.functions.text import or_empty, strip

PARSED = (
    "name string, year string, major string, gpa string, coursework array<string>, technical_skills array<string>, software_tools array<string>, lab_techniques array<string>, "
    "research_experiences array<struct<title:string,lab:string,description:string>>, project_experiences array<struct<title:string,description:string>>, inferred_themes array<string>"
)


def _present(terms: list[str], text: Column) -> Column:
    lowered = F.lower(or_empty(text))
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(lowered, t))


def skills(text: Column, variant: str = "py") -> Column:
    return _present(SKILLS[variant], text)


def techniques(text: Column, variant: str = "py") -> Column:
    return _present(TECHNIQUES[variant], text)


def themes(text: Column, variant: str = "py") -> Column:
    lowered = F.lower(or_empty(text))
    any_of = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(lowered, t))
    return F.filter(F.array(*[F.when(any_of(terms), F.lit(name)) for name, terms in THEMES[variant].items()]), lambda t: t.isNotNull())


def person_name(text: Column, variant: str = "py") -> Column:
    """The first line that isn't blank, if it has four words at most."""
    first = F.get(F.filter(F.transform(F.split(or_empty(text), "\n"), strip), lambda t: t != ""), F.lit(0))
    count = F.size(F.filter(F.split(first, r"(?U)\s+"), lambda w: w != "")) if variant == "py" else F.size(F.split(first, " "))
    return F.when(count <= 4, first)


def study_year(text: Column, variant: str = "py") -> Column:
    lowered = F.lower(or_empty(text))
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(k)), F.lit(v)) for k, v in YEARS[variant].items()])


def major(text: Column, variant: str = "py") -> Column:
    lowered = F.lower(or_empty(text))
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(m)), F.lit(m.title())) for m in MAJORS[variant]])


def parsed(text: Column, variant: str = "py") -> Column:
    """The whole record; what the text doesn't tell is null or empty."""
    none = F.array().cast("array<string>")
    return F.struct(
        person_name(text, variant).alias("name"), study_year(text, variant).alias("year"), major(text, variant).alias("major"), F.lit(None).cast("string").alias("gpa"), none.alias("coursework"),
        skills(text, variant).alias("technical_skills"), none.alias("software_tools"), techniques(text, variant).alias("lab_techniques"),
        F.array().cast("array<struct<title:string,lab:string,description:string>>").alias("research_experiences"), F.array().cast("array<struct<title:string,description:string>>").alias("project_experiences"),
        themes(text, variant).alias("inferred_themes"),
    )


def parse_resumes(df: DataFrame, text_col: str = "raw_text", variant: str = "py") -> DataFrame:
    return df.withColumn("parsed_profile", parsed(F.col(text_col), variant))


def valid_resume_text(df: DataFrame, text_col: str = "raw_text", most: int = 50_000) -> DataFrame:
    """Rows whose text isn't blank, cut to ``most`` characters for storing."""
    return df.filter(F.col(text_col).rlike(r"(?U)\S")).withColumn(text_col, F.substring(text_col, 1, most))


def resume_prompt(text: Column, most: int = 6000) -> Column:
    return F.concat(F.lit("Résumé text:\n\n"), F.substring(or_empty(text), 1, most))


def parse_model_json(reply: Column, text: Column, variant: str = "py") -> Column:
    """The record in a model's reply, with or without code fences; the terms' record where the reply isn't JSON."""
    bare = strip(or_empty(reply))
    inner = F.regexp_replace(F.regexp_replace(bare, r"(?s)^```[^\n]*\n", ""), r"(?s)```(?!.*```).*\z", "")
    body = strip(F.when(F.startswith(bare, F.lit("```")), inner).otherwise(bare))
    read = F.from_json(body, PARSED + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    kept = F.struct(*[read[f.split()[0]].alias(f.split()[0]) for f in ("name", "year", "major", "gpa", "coursework", "technical_skills", "software_tools", "lab_techniques", "research_experiences", "project_experiences", "inferred_themes")])
    return F.when(read.isNotNull() & read["_bad"].isNull() & F.startswith(body, F.lit("{")), kept).otherwise(parsed(text, variant))


def make_sessions(df: DataFrame, key_col: str = "filename", as_of: str | None = None) -> DataFrame:
    """Sessions with an id that the key decides (so reruns agree) and the time of creation."""
    made = F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()
    return df.withColumn("id", F.md5(or_empty(F.col(key_col)))).withColumn("created_at", made)
