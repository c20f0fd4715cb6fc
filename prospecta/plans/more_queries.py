"""Registered queries of the operators on crawled links, profiles as records, replies, drafts and applications, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospecta.functions import lists, text
from prospecta.operators import crawl, drafts, enrichment, matching, pages, resumes, terms, tracking
from prospecta.plans import bindings, blocks
from prospecta.plans.queries import _JOINED, _TREE, APPS, ORACLE_SQL, PROFILES, RESUMES, _every_reference, _matches, _strip_all, first_of, present, query, strip
from prospecta.sources import buckets, files, places, progress

AS_OF = f"{bindings.AS_OF} 12:00:00"


# Crawled links. Pages are directory pages; their links, seen from the page's host, are what a crawl would follow.

_LINKS = """lk AS (SELECT DISTINCT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS profile_url FROM pages)"""


def _links(spark, d):
    source = bindings.read(spark, d, "pages")
    hrefs = pages.page_links(source.filter("html is not null")).join(source.select("page_id", "url"), "page_id")
    return hrefs.filter("href like '/%'").select("page_id", "url", pages.join_url(F.col("url"), F.col("href")).alias("profile_url")).distinct()


@query(f"WITH {_LINKS} SELECT page_id, profile_url FROM lk")
def join_url(spark, d):
    return _links(spark, d).select("page_id", "profile_url")


@query(r"""WITH x AS (SELECT page_id, url, unnest(regexp_extract_all(replace(html, 'href="/', 'href="/profiles/'), '(?i)href\s*=\s*["'']([^"'']*/profiles/[^"''#?]+\.html)["'']', 1)) AS h FROM (SELECT page_id, url, replace(html, '">', '.html">') AS html FROM pages))
SELECT DISTINCT url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h AS profile_url FROM x WHERE NOT ends_with(h, 'index.html')""")
def profile_links(spark, d):
    """The pages' links as links to profiles."""
    source = bindings.read(spark, d, "pages")
    html = F.replace(F.replace(F.col("html"), F.lit('">'), F.lit('.html">')), F.lit('href="/'), F.lit('href="/profiles/'))
    return pages.profile_links(source.select("url", html.alias("html")))


@query("SELECT url, min(page_id) AS seed_ord FROM (SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS url, page_id FROM pages) GROUP BY url")
def dedupe_seeds(spark, d):
    site = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    return pages.dedupe_seeds(bindings.read(spark, d, "pages").select(site.alias("url"), F.col("page_id").alias("seed_ord")))


@query(f"WITH {_LINKS} SELECT profile_url, min(page_id) AS seed_ord, arg_min(url, page_id) AS seed_url FROM lk GROUP BY profile_url")
def assign_links(spark, d):
    return pages.assign_links(_links(spark, d).select(F.col("page_id").alias("seed_ord"), F.col("url").alias("seed_url"), "profile_url"))


@query(f"WITH {_LINKS} SELECT DISTINCT profile_url FROM lk WHERE md5(profile_url) >= '8'")
def crawl_frontier(spark, d):
    """Of all links, half of them crawled, those that aren't."""
    links = _links(spark, d).select("profile_url").distinct()
    return pages.crawl_frontier(links, links.filter("md5(profile_url) < '8'").select(F.col("profile_url").alias("url")))


def _crawl_sql(rounds: int) -> str:
    """Rounds, one after the other: links of the last round's pages that no round has, each with the first seed that leads there."""
    node = "(('0x' || substr(md5(page_id::VARCHAR || h), 1, 8))::BIGINT % (SELECT max(page_id) + 1 FROM pages))::VARCHAR"
    steps = [f"g AS (SELECT DISTINCT page_id::VARCHAR AS url, {node} AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages))", "r0 AS (SELECT page_id::VARCHAR AS url, page_id AS seed_ord, page_id::VARCHAR AS seed_url, 0 AS round FROM pages WHERE page_id % 50 = 7)"]
    for k in range(1, rounds + 1):
        known = " UNION ALL ".join(f"SELECT url FROM r{j}" for j in range(k))
        steps.append(f"r{k} AS (SELECT target AS url, min(seed_ord) AS seed_ord, arg_min(seed_url, seed_ord) AS seed_url, {k} AS round FROM r{k - 1} JOIN g USING (url) WHERE target NOT IN ({known}) GROUP BY target)")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(rounds + 1))


@query(_crawl_sql(3))
def crawl_rounds(spark, d):
    """Three rounds over all pages, whose links lead to one another by hash."""
    source = bindings.read(spark, d, "pages")
    n = source.agg(F.max("page_id") + 1).first()[0]
    nodes = source.select(F.col("page_id").cast("string").alias("url"), "html")

    def links(reached):
        hrefs = reached.select("url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"))
        target = F.conv(F.substring(F.md5(F.concat("url", "h")), 1, 8), 16, 10).cast("long") % F.lit(n)
        return hrefs.select("url", target.cast("string").alias("profile_url")).distinct()

    seeds = source.filter("page_id % 50 = 7").select(F.col("page_id").alias("seed_ord"), F.col("page_id").cast("string").alias("url"))
    return crawl.crawl(seeds, nodes, links, places.scratch(spark, "crawl"), 3)


_NAME = _strip_all(_every_reference("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))


@query(f"SELECT substr(md5(url), 1, 12) AS id, {_NAME} AS name, coalesce(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/'), lambda x: x NOT IN ('', 'engineering', 'profiles', 'index.html') AND NOT ends_with(x, '.html'))[1], 'unknown') AS department, url AS profile_url, page_id AS seed_ord, '' AS ai_review, 0 AS interests FROM pages")
def assemble_profiles(spark, d):
    # Pages may share a URL, so a link is to a page, not to all with its URL. Within a struct nulls are equal, and none is lost.
    source = bindings.read(spark, d, "pages").withColumn("page", F.struct("page_id", "url"))
    links = source.select("page", F.col("url").alias("profile_url"), F.col("page_id").alias("seed_ord"), F.col("url").alias("seed_url")).distinct()
    made = pages.assemble_profiles(links, pages.extract_fields(source).drop("page_id", "url"), "page")
    return made.select("id", "name", "department", "profile_url", "seed_ord", "ai_review", F.size("scholar_interests").alias("interests"))


# Profiles as records

@query(f"""WITH {PROFILES} SELECT id, CASE WHEN seed_ord % 3 = 0 THEN 'renamed ' || id ELSE name END AS name, CASE WHEN seed_ord % 3 = 0 THEN NULL ELSE title END AS title, department FROM p WHERE seed_ord % 2 = 0
UNION ALL SELECT id, 'renamed ' || id, NULL, NULL FROM p WHERE seed_ord % 2 = 1 AND seed_ord % 3 = 0""")
def upsert_profiles(spark, d):
    """Half of the profiles are there; a batch renames a third of all, which changes some and adds others."""
    known = bindings.profiles(spark, d)
    current = known.filter("seed_ord % 2 = 0").select("id", "name", "title", "department")
    item = F.create_map(F.lit("id"), F.col("id"), F.lit("name"), F.concat(F.lit("renamed "), F.col("id")), F.lit("title"), F.lit(None).cast("string"), F.lit("not a field"), F.lit("x"))
    return files.upsert_profiles(current, known.filter("seed_ord % 3 = 0").select(F.col("seed_ord").alias("pos"), item.alias("item")))


@query(ORACLE_SQL["upsert_profiles"])
def upsert_bucketed(spark, d):
    """The same on a table in buckets: first the ids that end in 7, then the rest."""
    known, path = bindings.profiles(spark, d), places.scratch(spark, "profiles-buckets")
    buckets.create(known.filter("seed_ord % 2 = 0").select("id", "name", "title", "department"), path)
    item = F.create_map(F.lit("id"), F.col("id"), F.lit("name"), F.concat(F.lit("renamed "), F.col("id")), F.lit("title"), F.lit(None).cast("string"), F.lit("not a field"), F.lit("x"))
    for part in (F.col("seed_ord") % 10 == 7, F.col("seed_ord") % 10 != 7):
        files.upsert_bucketed(spark, path, known.filter("seed_ord % 3 = 0").filter(part).select(F.col("seed_ord").alias("pos"), item.alias("item")))
    return buckets.read(spark, path)


@query(f"WITH {PROFILES} SELECT id, name, NULL::VARCHAR AS phone FROM p")
def bootstrap_if_empty(spark, d):
    known = bindings.profiles(spark, d)
    nothing = known.filter("id is null").select("id", "name", F.lit(None).cast("string").alias("phone"))
    return files.bootstrap_if_empty(files.bootstrap_if_empty(nothing, known), known.filter("id is null"))


_WORKS = "w AS (SELECT c_custkey::VARCHAR AS id, o_orderkey::VARCHAR AS title, extract(year FROM o_orderdate::DATE)::VARCHAR AS year, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS position FROM customer JOIN orders ON c_custkey = o_custkey)"


def _works(spark, d):
    work = F.struct(F.col("o_orderkey").alias("_k"), F.col("o_orderkey").cast("string").alias("title"), F.year(F.col("o_orderdate").cast("date")).cast("string").alias("year"), F.lit(None).cast("int").alias("cited_by"))
    per = bindings.read(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.sort_array(F.collect_list(work)).alias("p"))
    return per.select("id", F.transform("p", lambda x: F.struct(x["title"].alias("title"), x["year"].alias("year"), x["cited_by"].alias("cited_by"))).alias("publications"))


@query(f"WITH {_WORKS} SELECT id, position::INT AS position, title, year FROM w WHERE position < 10")
def profile_publications(spark, d):
    return matching.profile_publications(_works(spark, d)).select("id", "position", "title", "year")


@query("SELECT c_custkey::VARCHAR AS id, 'u' || c_custkey::VARCHAR AS \"user\" FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0")
def scholar_candidates(spark, d):
    n = F.col("c_custkey")
    link = F.when(n % 3 != 0, F.concat(F.lit("https://scholar.google.com/citations?hl=en&user=u"), n.cast("string"), F.lit("&view=1")))
    interests = F.when(n % 2 == 1, F.array(F.lit("sums"))).otherwise(F.array().cast("array<string>"))
    return enrichment.scholar_candidates(bindings.read(spark, d, "customer").select(n.cast("string").alias("id"), link.alias("google_scholar"), interests.alias("scholar_interests")))


@query(f"WITH {_WORKS}, c AS (SELECT id, count(*) AS n FROM w WHERE id::BIGINT % 2 = 0 GROUP BY id) SELECT c_custkey::VARCHAR AS id, CASE WHEN n IS NULL THEN 'old' ELSE 'new' END AS interest, coalesce(n, 0)::INT AS n FROM customer LEFT JOIN c ON c_custkey::VARCHAR = id")
def apply_scholar(spark, d):
    works = _works(spark, d).filter("cast(id as bigint) % 2 = 0").withColumn("scholar_interests", F.array(F.lit("new")))
    none = F.array().cast("array<struct<title:string,year:string,cited_by:int>>")
    profiles = bindings.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array(F.lit("old")).alias("scholar_interests"), none.alias("publications"))
    return enrichment.apply_scholar(profiles, works).select("id", F.get("scholar_interests", F.lit(0)).alias("interest"), F.size("publications").alias("n"))


@query(f"""WITH RECURSIVE {_TREE}, n AS (SELECT page_id, unnest(range(0, (page_id % 23)::INT)) AS i FROM pages),
li AS (SELECT page_id, string_agg(array_to_string(said, ''), '|' ORDER BY pos) AS interests FROM held WHERE name = 'a' AND len(said) > 0 GROUP BY page_id)
SELECT page_id::VARCHAR AS id, coalesce(interests, '') AS interests, coalesce((SELECT string_agg('t' || i::VARCHAR || '& more,' || CASE WHEN i % 3 = 0 THEN '-' ELSE (1900 + i)::VARCHAR END || ',' || CASE WHEN i % 4 = 0 THEN '-' ELSE i::VARCHAR END, '|' ORDER BY i) FROM n WHERE n.page_id = tk.page_id AND i BETWEEN 1 AND 20), '') AS works FROM tk LEFT JOIN li USING (page_id)""")
def parse_scholar_pages(spark, d):
    """Each page as a scholar's: its own menu lists the interests, and up to 22 works follow, the first without a title."""
    n = F.col("page_id")
    cell = lambda i: F.concat(F.lit('<tr class="gsc_a_tr"><td class="x gsc_a_t"><div><a href="#" class="gsc_a_at">'), F.when(i > 0, F.concat(F.lit("t"), i.cast("string"), F.lit(" <i>&amp; more</i>"))).otherwise(F.lit("")), F.lit('</a></div></td><td class="gsc_a_c"><p><a>'), F.when(i % 4 == 0, F.lit("*")).otherwise(i.cast("string")), F.lit("</a></td>"), F.when(i % 3 == 0, F.lit('<td class="gsc_a_y"></td>')).otherwise(F.concat(F.lit('<td class="gsc_a_y"><span>'), (i + 1900).cast("string"), F.lit("</span></td>"))), F.lit("</tr>"))
    rows = F.when(n % 23 > 0, F.array_join(F.transform(F.sequence(F.lit(0), (n % 23).cast("int") - 1), cell), "")).otherwise(F.lit(""))
    own = F.replace(text.or_empty(F.col("html")), F.lit("<nav>"), F.lit('<nav id="gsc_prf_int">'))
    read = pages.parse_scholar_pages(blocks.spread(bindings.read(spark, d, "pages"), 8).select(n.cast("string").alias("id"), F.concat(own, F.lit("<table>"), rows, F.lit("</table>")).alias("html")))
    work = lambda w: F.concat_ws(",", w["title"], F.coalesce(w["year"], F.lit("-")), F.coalesce(w["cited_by"].cast("string"), F.lit("-")))
    return read.select("id", F.array_join("scholar_interests", "|").alias("interests"), F.array_join(F.transform("publications", work), "|").alias("works"))


# Files: written, and read back

def _whole(spark, d):
    known, there = bindings.profiles(spark, d), ("id", "name", "title", "department", "profile_url", "research_summary")
    return known.select(*[F.col(f) if f in there else (F.array(F.col("id")) if f == "scholar_interests" else F.lit(None)).cast(files._LISTS.get(f, "string")).alias(f) for f in lists.PROFILE_FIELDS], "seed_ord")


_BACK = f"WITH {PROFILES} SELECT id, name, title, department, research_summary, {{}} AS interests FROM p"


@query(_BACK.format("id"))
def write_profiles_json(spark, d):
    path = places.scratch(spark, "profiles-json")
    files.write_profiles_json(_whole(spark, d), path)
    back = spark.read.schema(files.PROFILE_DDL).json(path)
    return back.select("id", "name", "title", "department", "research_summary", F.get("scholar_interests", F.lit(0)).alias("interests"))


@query(_BACK.format("'[\"' || id || '\"]'"))
def write_profiles_csv(spark, d):
    path = places.scratch(spark, "profiles-csv")
    files.write_profiles_csv(_whole(spark, d), path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(path)
    return back.select("id", "name", "title", "department", "research_summary", F.col("scholar_interests").alias("interests"))


@query(f"WITH {PROFILES} SELECT id, CASE WHEN department = 'src3' THEN 'new ' || name ELSE name END AS name, department FROM p WHERE department IS NOT NULL")
def write_by_department(spark, d):
    """All departments, then one of them anew: the others stay."""
    path, known = places.scratch(spark, "departments"), bindings.profiles(spark, d).filter("department is not null").select("id", "name", "department")
    files.write_by_department(known, path)
    files.write_by_department(known.filter("department = 'src3'").withColumn("name", F.concat(F.lit("new "), F.col("name"))), path)
    return spark.read.schema("id string, name string, department string").parquet(path)


@query(f"WITH {PROFILES} SELECT id, 'made ' || name AS name, department FROM p WHERE department IS NOT NULL")
def write_with_ledger(spark, d):
    """Departments written in jobs and entered in a ledger: first those of a few, then, started again, the rest."""
    path, known = places.scratch(spark, "ledger"), bindings.profiles(spark, d).filter("department is not null").select("id", "name", "department")
    made = lambda df: df.select("id", F.concat(F.lit("made "), F.col("name")).alias("name"), "department")
    for some in (known.filter("department < 'src3'"), known):
        progress.run(some, "department", path, made, 3)
    return progress.output(spark, path, made(known).schema)


# Replies of a model

@query(f"""WITH {RESUMES}, m AS (SELECT id, raw_text, id::BIGINT % 4 AS k FROM r) SELECT id, CASE WHEN k < 2 THEN 'N ' || id WHEN k = 2 AND len(string_split(f, ' ')) <= 4 THEN f WHEN k = 3 AND len(string_split(f, ' ')) <= 4 THEN f END AS name,
CASE WHEN k < 2 THEN 'Physics' ELSE {first_of({m: m.title() for m in lists.MAJORS["js"]}, 'raw_text')} END AS major, CASE WHEN k < 2 THEN 'a|b' ELSE array_to_string({present(lists.SKILLS['js'], 'raw_text')}, '|') END AS skills
FROM (SELECT *, list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')[1] AS f FROM m)""")
def parse_model_json(spark, d):
    """Replies that are JSON, bare or fenced, and replies that aren't."""
    own = F.to_json(F.struct(F.concat(F.lit("N "), F.col("id")).alias("name"), F.lit("Physics").alias("major"), F.array(F.lit("a"), F.lit("b")).alias("technical_skills")))
    k = F.col("id").cast("long") % 4
    reply = F.when(k == 0, own).when(k == 1, F.concat(F.lit("```json\n"), own, F.lit("\n```"))).when(k == 2, F.lit("I can't tell")).otherwise(F.lit('{"name": "cut'))
    read = resumes.parse_model_json(reply, F.col("raw_text"), "js")
    return bindings.resumes(spark, d).select("id", read["name"].alias("name"), read["major"].alias("major"), F.array_join(read["technical_skills"], "|").alias("skills"))


@query(f"WITH {RESUMES} SELECT md5(id) AS id, length(raw_text)::INT AS n, TIMESTAMP '{AS_OF}' AS created_at FROM r")
def make_sessions(spark, d):
    given = bindings.resumes(spark, d).withColumnRenamed("id", "filename")
    return resumes.make_sessions(given, as_of=AS_OF).select("id", F.length("raw_text").alias("n"), F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"SELECT doc_id, 'About ' || source AS subject, {strip('text')} AS body FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def parse_draft(spark, d):
    """Replies with a subject, another one, a blank line, and the whole text as body."""
    reply = F.concat(F.lit("Here it is\nSubject: first\nSUBJECT:  About "), F.col("source"), F.lit(" \n\n"), F.col("text"))
    read = drafts.parse_draft(reply)
    return bindings.read(spark, d, "documents").filter("text is not null and source is not null").select("doc_id", read["subject"].alias("subject"), read["body"].alias("body"))


_TONE = "CASE (doc_id % 5)::INT WHEN 1 THEN 'warm' WHEN 2 THEN 'concise' WHEN 3 THEN 'angry' WHEN 4 THEN 'professional' END"


@query(f"SELECT doc_id, coalesce({_TONE}, 'professional') AS tone, doc_id % 5 <> 3 AS kept FROM documents")
def check_tone(spark, d):
    tone = F.expr("case cast(doc_id % 5 as int) when 1 then 'warm' when 2 then 'concise' when 3 then 'angry' when 4 then 'professional' end")
    kept, rejected = drafts.check_tone(bindings.read(spark, d, "documents").select("doc_id", tone.alias("tone")))
    return kept.withColumn("kept", F.lit(True)).union(rejected.withColumn("kept", F.lit(False)))


@query("SELECT doc_id, 'Subject: ' || coalesce(source, '') || chr(10) || chr(10) || coalesce(text, '') AS draft FROM documents")
def draft_text(spark, d):
    return bindings.read(spark, d, "documents").select("doc_id", drafts.draft_text(F.col("source"), F.col("text")).alias("draft"))


# Terms

_TERMS = "tm AS (SELECT t AS term, row_number() OVER (ORDER BY t) AS place FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 5)) AS t FROM benchmark))"


@query(f"WITH {_TERMS} SELECT doc_id, coalesce(string_agg(term, '|' ORDER BY place), '') AS terms, count(term) AS n FROM documents LEFT JOIN tm ON contains(lower(text), term) GROUP BY doc_id")
def find_terms(spark, d):
    """All words of the benchmark, looked for in all documents at once."""
    words = F.filter(F.split(F.lower(F.col("text")), "[^a-z0-9]+"), lambda w: F.length(w) >= 5)
    known = bindings.read(spark, d, "benchmark").select(F.explode(words).alias("term")).distinct().withColumn("place", F.lit(0))
    found = terms.find_terms(blocks.spread(bindings.read(spark, d, "documents").select("doc_id", "text")), known, "text")
    return found.select("doc_id", F.array_join("terms", "|").alias("terms"), F.size("terms").cast("long").alias("n"))


# Drafts in all tones, by seekers with and without a name, a year and a major

_WHO = "CASE WHEN session_id::BIGINT % 2 = 0 THEN 'Kim ' || session_id END"
_FIELD = "coalesce(CASE session_id::BIGINT % 3 WHEN 0 THEN 'Physics' WHEN 1 THEN '' END, 'Engineering')"
_YEAR = "CASE WHEN session_id::BIGINT % 3 = 1 THEN 'Junior ' ELSE '' END"


def _drafts_sql() -> str:
    own, field = f"coalesce({_WHO}, 'Student')", f"coalesce(nullif({_FIELD}, ''), 'Engineering')"
    me = f"{own} || ', a ' || {_YEAR} || {field} || ' student'"
    research, wish = "rtrim(substring(research_summary, 1, 160), '.,')", "substring(interests, 1, 120)"
    skills = "coalesce(nullif(array_to_string(skills[1:3], ', '), ''), 'engineering tools and methods')"
    nl = "chr(10)"
    hello = f"'Dear Prof. ' || name || ',' || {nl} || {nl}"
    concise = f"{hello} || 'I am ' || {me} || '. Your work on ' || {research} || '… meets my interest in ' || {wish} || '.' || {nl} || {nl} || 'I know ' || {skills} || '. Could we talk briefly?' || {nl} || {nl} || 'Best regards,' || {nl} || {own}"
    warm = f"{hello} || 'Of all the pages I read this week, yours stayed with me: ' || {research} || '… is close to ' || {wish} || ', which I can''t stop thinking about.' || {nl} || {nl} || 'I am ' || {me} || '. What I could bring along is ' || {skills} || '. May I come by one day?' || {nl} || {nl} || 'With all good wishes,' || {nl} || {own}"
    formal = f"{hello} || 'I am ' || {me} || '. Exploring research in ' || {wish} || ', I came across your work on ' || {research} || '….' || {nl} || {nl} || 'May I ask whether your group has openings? I have experience with ' || {skills} || '.' || {nl} || {nl} || 'Sincerely,' || {nl} || {own}"
    return _JOINED + f" SELECT session_id, rank, tone, 'Research opportunity: ' || {own} AS subject, CASE tone WHEN 'concise' THEN {concise} WHEN 'warm' THEN {warm} ELSE {formal} END AS body FROM j CROSS JOIN (SELECT unnest(['professional', 'warm', 'concise']) AS tone)"


@query(_drafts_sql())
def draft_tones(spark, d):
    n = F.col("session_id").cast("long")
    text_or_null = lambda c: c.cast("string")
    known = F.col("parsed_profile").withField("name", text_or_null(F.when(n % 2 == 0, F.concat(F.lit("Kim "), F.col("session_id"))))).withField("year", text_or_null(F.when(n % 3 == 1, F.lit("Junior")))).withField("major", text_or_null(F.when(n % 3 == 0, F.lit("Physics")).when(n % 3 == 1, F.lit(""))))
    matches = _matches(spark, d).withColumn("parsed_profile", known)
    return matches.withColumn("asked", F.explode(F.array(*[F.lit(t) for t in drafts.TONES]))).withColumn(
        "made", drafts.subject_and_body({"name": F.col("name"), "research_summary": F.col("research_summary")}, {c: F.col(f"parsed_profile.{c}") for c in ("name", "major", "year", "technical_skills")}, F.col("interests"), F.col("asked"))
    ).select("session_id", "rank", F.col("asked").alias("tone"), F.col("made.subject").alias("subject"), F.col("made.body").alias("body"))


# Applications

@query(f"WITH {PROFILES} SELECT name AS \"professorName\", coalesce(department, '') AS department, CASE WHEN seed_ord % 2 = 0 THEN 'a, b, c' ELSE '' END AS \"researchArea\", profile_url AS \"sourceLink\", 'Not Started' AS status, '' AS \"emailUsed\" FROM p WHERE profile_url IS NOT NULL")
def application_from_profile(spark, d):
    interests = F.when(F.col("seed_ord") % 2 == 0, F.array(*[F.lit(x) for x in "abcd"]))
    profiles = bindings.profiles(spark, d).filter("profile_url is not null").withColumns({"scholar_interests": interests, "email": F.lit(None).cast("string")})
    return tracking.application_from_profile(profiles, True)


@query(f"WITH {APPS} SELECT \"professorName\", CASE WHEN \"professorName\" <> '' THEN status END AS status, \"professorName\" <> '' AS created, '' AS notes, \"lastUpdated\" FROM (SELECT CASE WHEN seed_ord % 7 = 0 THEN '' ELSE trim(\"professorName\") END AS \"professorName\", CASE WHEN seed_ord % 2 = 0 THEN status ELSE 'Not Started' END AS status, CASE WHEN seed_ord % 7 <> 0 THEN TIMESTAMP '{AS_OF}' END AS \"lastUpdated\" FROM a)")
def create_applications(spark, d):
    n = F.col("seed_ord")
    given = bindings.applications(spark, d).select(F.when(n % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("professorName"), F.lit("\n"))).alias("professorName"), F.when(n % 2 == 0, F.col("status")).alias("status"))
    created, rejected = tracking.create_applications(given, AS_OF)
    kept = created.select("professorName", "status", F.lit(True).alias("created"), "notes", F.col("lastUpdated").cast("timestamp_ntz").alias("lastUpdated"))
    return kept.union(rejected.select("professorName", F.lit(None).cast("string"), F.lit(False), "notes", F.lit(None).cast("timestamp_ntz")))


_CHANGES = """ch AS (SELECT 1 AS seq, id, 'update' AS op, {'status': 'Closed', 'notes': 'n' || id, 'labName': NULL} AS f, ['status', 'notes', 'labName'] AS given, seed_ord % 4 IN (0, 1) AS made FROM a
 UNION ALL SELECT 2, id, 'update', {'status': NULL, 'notes': 'again ' || id, 'labName': NULL}, ['notes'], seed_ord % 4 = 0 FROM a UNION ALL SELECT 3, id, 'delete', {'status': NULL, 'notes': NULL, 'labName': NULL}, [], seed_ord % 4 = 1 FROM a
 UNION ALL SELECT 4, id, 'update', {'status': 'Applied', 'notes': NULL, 'labName': NULL}, ['status'], seed_ord % 8 < 2 FROM a UNION ALL SELECT 5, 'no such ' || id, 'update', {'status': 'Closed', 'notes': NULL, 'labName': NULL}, ['status'], seed_ord % 4 = 2 FROM a)"""


def _folded(name: str) -> str:
    return f"CASE WHEN len(list_filter(log, lambda c: list_contains(c.given, '{name}'))) > 0 THEN list_extract(list_filter(log, lambda c: list_contains(c.given, '{name}')), -1).f.\"{name}\" ELSE a.\"{name}\" END"


@query(f"""WITH {APPS}, {_CHANGES}, lg AS (SELECT id, list({{'seq': seq, 'op': op, 'f': f, 'given': given}} ORDER BY seq) AS log FROM ch WHERE made GROUP BY id)
SELECT a.id, {_folded('status')} AS status, {_folded('notes')} AS notes, {_folded('labName')} AS "labName", CASE WHEN log IS NULL THEN "lastUpdated" ELSE TIMESTAMP '{AS_OF}' END AS "lastUpdated"
FROM a LEFT JOIN lg ON a.id = lg.id WHERE log IS NULL OR NOT list_contains(list_transform(log, lambda c: c.op), 'delete')""")
def apply_changes(spark, d):
    """A log of changes: some give several fields, then some of these again, then others; some delete, and an update follows; some name unknown ids."""
    apps = bindings.applications(spark, d)
    n, text_or_null = F.col("seed_ord"), lambda x: F.lit(x).cast("string") if not hasattr(x, "cast") else x
    change = lambda seq, op, when, **f: apps.filter(when).select(F.lit(seq).alias("seq"), "id", F.lit(op).alias("op"), F.create_map(*[x for k, v in f.items() for x in (F.lit(k), text_or_null(v))]).cast("map<string,string>").alias("fields"))
    own = lambda start: F.concat(F.lit(start), F.col("id"))
    log = change(1, "update", n % 4 < 2, status="Closed", notes=own("n"), labName=None).union(change(2, "update", n % 4 == 0, notes=own("again "))).union(change(3, "delete", n % 4 == 1))
    log = log.union(change(4, "update", n % 8 < 2, status="Applied")).union(change(5, "update", n % 4 == 2, status="Closed").withColumn("id", own("no such ")))
    return tracking.apply_changes(apps, log, AS_OF).select("id", "status", "notes", "labName", F.col("lastUpdated").cast("timestamp_ntz").alias("lastUpdated"))
