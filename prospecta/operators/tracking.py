"""Saved profiles and tracked applications. Times never are read from a clock unless the caller leaves ``as_of`` out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.functions.lists import CSV_FIELDS, CSV_HEADERS, STATUSES
from prospecta.functions.text import or_empty, strip

AWAITING = ["Applied", "Follow Up Sent", "Drafting Email", "Not Started"]
IN_PROGRESS, RESOLVED = STATUSES[:4], STATUSES[4:]
DEFAULTS = {"professorName": "", "labName": "", "department": "", "researchArea": "", "status": "Not Started", "dateApplied": "", "followUpDate": "", "emailUsed": "", "notes": "", "sourceLink": ""}


def saved_from_events(events: DataFrame) -> DataFrame:
    """(user_id, profile_id) still saved, from events (ts, event_id, user_id, profile_id, action): toggles after the user's last clear, of odd number."""
    clears = events.filter("action = 'clear'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("cleared"))
    toggles = events.filter("action = 'toggle'").join(clears, "user_id", "left").filter(F.col("cleared").isNull() | (F.struct("ts", "event_id") > F.col("cleared")))
    return toggles.groupBy("user_id", "profile_id").agg((F.count(F.lit(1)) % 2).alias("odd")).filter("odd = 1").drop("odd")


def saved_profiles(profiles: DataFrame, saved: DataFrame) -> DataFrame:
    """The profiles that a user saved, per user, in profile order where the caller sorts by seed_ord."""
    return profiles.join(saved.select("user_id", F.col("profile_id").alias("id")).distinct(), "id")


def tracked_flag(profiles: DataFrame, apps: DataFrame) -> DataFrame:
    """Profiles with ``tracked``: an application has the same link and name."""
    pairs = apps.select(F.col("sourceLink").alias("_link"), F.col("professorName").alias("_name")).distinct().withColumn("_tracked", F.lit(True))
    same = F.col("profile_url").eqNullSafe(F.col("_link")) & F.col("name").eqNullSafe(F.col("_name"))
    return profiles.join(pairs, same, "left").withColumn("tracked", F.col("_tracked").isNotNull()).drop("_link", "_name", "_tracked")


def application_from_profile(profiles: DataFrame, with_email: bool = False) -> DataFrame:
    area = F.array_join(F.slice(F.coalesce("scholar_interests", F.array().cast("array<string>")), 1, 3), ", ")
    columns = [or_empty(F.col("name")).alias("professorName"), or_empty(F.col("department")).alias("department"), area.alias("researchArea"), or_empty(F.col("profile_url")).alias("sourceLink"), F.lit(STATUSES[0]).alias("status")]
    return profiles.select(*columns, *([or_empty(F.col("email")).alias("emailUsed")] if with_email else []))


def create_applications(fields: DataFrame, as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(created, rejected): defaults filled in, texts trimmed, an id and a time for each; rows without a name are rejected."""
    now = F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()
    filled = fields.select(*[(strip(F.coalesce(F.col(c), F.lit(d))) if c in fields.columns else F.lit(d)).alias(c) for c, d in DEFAULTS.items()], (F.coalesce("pinned", F.lit(False)) if "pinned" in fields.columns else F.lit(False)).alias("pinned"))
    named = F.col("professorName") != ""
    return filled.filter(named).withColumn("id", F.uuid()).withColumn("lastUpdated", now), filled.filter(~named)


def apply_changes(apps: DataFrame, changes: DataFrame, as_of: str | None = None) -> DataFrame:
    """Applications after ``changes`` (seq, id, op 'update' or 'delete', fields map), one after the other by seq.

    A deleted row stays away, whatever comes later; each field has the last value given for it, null included (of one seq, the greatest); fields never given stay;
    ids that aren't there are ignored. An id's changes are merged before they meet the table, partly before they are shuffled.
    """
    now = F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()
    gone = changes.groupBy("id").agg(F.bool_or(F.col("op") == "delete").alias("gone"))
    given = changes.filter("op = 'update'").select("id", "seq", F.explode("fields").alias("key", "value"))
    last = given.groupBy("id", "key").agg(F.max_by(F.struct("value"), F.struct("seq", "value")).alias("last"))
    fields = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "last.value"))).alias("fields"))
    merged = gone.join(fields, "id", "left").select("id", F.struct("gone", "fields").alias("merged change"))
    joined, change = apps.join(merged, "id", "left"), F.col("`merged change`")
    has = lambda c: F.coalesce(F.map_contains_key(change["fields"], c), F.lit(False))
    kinds = dict(apps.dtypes)
    columns = [F.when(has(c), F.element_at(change["fields"], c).cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c) if c not in ("id", "lastUpdated") else F.col(c) for c in apps.columns]
    columns = [F.when(change.isNotNull(), now).otherwise(F.col("lastUpdated")).alias("lastUpdated") if c == "lastUpdated" else x for c, x in zip(apps.columns, columns, strict=True)]
    return joined.filter(change.isNull() | ~change["gone"]).select(*columns)


def filter_applications(apps: DataFrame, query: str = "", status: str | None = None) -> DataFrame:
    out = apps.filter(F.col("status") == status) if status else apps
    q = query.lower().strip()
    if not q:
        return out
    held = F.lit(False)
    for c in ("professorName", "labName", "department", "researchArea", "notes"):
        held = held | F.contains(F.lower(or_empty(F.col(c))), F.lit(q))
    return out.filter(held)


def sort_applications(apps: DataFrame, mode: str = "newest", ties: tuple[str, ...] = ("seed_ord",)) -> DataFrame:
    order = {
        "newest": F.col("lastUpdated").desc(),
        "oldest": F.col("lastUpdated").asc(),
        "name": F.collate(F.col("professorName"), "UNICODE").asc(),
        "status": F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")).asc(),
    }
    return apps.orderBy(order[mode], *ties) if mode in order else apps


def status_summary(apps: DataFrame) -> DataFrame:
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return apps.agg(F.count(F.lit(1)).alias("total"), is_(*AWAITING).alias("awaiting"), is_("Interview Scheduled").alias("interview"), is_("Accepted").alias("accepted"), is_("Rejected").alias("rejected"))


def progress_summary(apps: DataFrame) -> DataFrame:
    return apps.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(*IN_PROGRESS)).alias("in_progress"), F.count_if(F.col("status").isin(*RESOLVED)).alias("resolved"))


def days_until(day: Column, as_of: str) -> Column:
    """Whole days until a date (text, '' for none); negative when overdue."""
    return F.date_diff(F.try_to_date(F.nullif(day, F.lit(""))), F.lit(as_of).cast("date"))


def follow_up_label(days: Column) -> Column:
    return (
        F.when(days.isNull() | (days > 7), F.lit(None).cast("string")).when(days < 0, F.concat(F.lit("Overdue by "), F.abs(days).cast("string"), F.lit("d")))
        .when(days == 0, F.lit("Due today")).when(days == 1, F.lit("Due tomorrow")).otherwise(F.concat(F.lit("Due in "), days.cast("string"), F.lit("d")))
    )


def follow_up_severity(days: Column) -> Column:
    """3 overdue, 2 today or tomorrow, 1 within a week, else null."""
    return F.when(days.isNull() | (days > 7), F.lit(None).cast("int")).when(days < 0, F.lit(3)).when(days <= 1, F.lit(2)).otherwise(F.lit(1))


def shows_reminder(days: Column) -> Column:
    return F.coalesce(days <= 3, F.lit(False))


def format_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMM d, yyyy"), F.lit(""))


def relative_time(ts: Column, as_of: str) -> Column:
    seconds = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(ts)
    ago = lambda per, unit: F.concat(F.floor(seconds / per).cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(ts.isNull(), F.lit("")).when(seconds < 60, F.lit("just now")).when(seconds < 3600, ago(60, "m")).when(seconds < 86400, ago(3600, "h"))
        .when(seconds < 7 * 86400, ago(86400, "d")).when(seconds < 30 * 86400, ago(7 * 86400, "w")).otherwise(format_date(ts))
    )


def csv_line(columns: list[Column]) -> Column:
    """One line: every value quoted, quotes doubled, runs of line ends made one space; null is empty."""
    quoted = [F.concat(F.lit('"'), F.regexp_replace(F.replace(or_empty(c.cast("string")), F.lit('"'), F.lit('""')), r"[\r\n]+", " "), F.lit('"')) for c in columns]
    return F.concat_ws(",", *quoted)


def applications_csv(apps: DataFrame) -> DataFrame:
    return apps.select(csv_line([F.col(c) for c in CSV_FIELDS]).alias("line"))


def write_applications_csv(apps: DataFrame, path: str, ties: tuple[str, ...] = ()) -> None:
    """Lines end in CRLF; the header comes first, in a file of its own that sorts before the others'."""
    header = apps.sparkSession.range(1).select(F.lit(",".join(CSV_HEADERS)).alias("line"))
    lines = applications_csv(apps.orderBy(*ties) if ties else apps)
    header.coalesce(1).union(lines).write.option("lineSep", "\r\n").text(path)
