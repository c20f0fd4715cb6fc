"""The registered queries on the driver's tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.functions import lists, markup, text
from prospecta.operators import drafts, elements, enrichment, matching, pages, resumes, topics, tracking
from prospecta.plans import bindings, blocks, ranks, word_index
from prospecta.sources import buckets, places
from prospecta.streaming import history

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PROFILES = "p AS (SELECT doc_id::VARCHAR AS id, 'doc ' || doc_id::VARCHAR AS name, lang AS title, source AS department, text AS research_summary, 'https://example.org/' || source || '/profiles/' || doc_id::VARCHAR || '.html' AS profile_url, doc_id AS seed_ord FROM documents)"
SESSIONS = "s AS (SELECT item_id::VARCHAR AS session_id, substring(text, 1, 120) AS interests, text AS raw_text FROM benchmark)"
RESUMES = "r AS (SELECT conv_id::VARCHAR AS id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) AS raw_text FROM conversations WHERE role = 'user' GROUP BY conv_id)"
APPS = """a AS (SELECT o_orderkey::VARCHAR AS id, c_name AS "professorName", 'Lab ' || (o_custkey % 50)::VARCHAR AS "labName", n_name AS department, o_orderpriority AS "researchArea",
 CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority < '2' THEN 'Accepted' WHEN o_orderpriority < '3' THEN 'Rejected' ELSE 'Closed' END
      WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority < '3' THEN 'Interview Scheduled' ELSE 'Follow Up Sent' END
      WHEN o_orderpriority < '2' THEN 'Not Started' WHEN o_orderpriority < '4' THEN 'Drafting Email' ELSE 'Applied' END AS status,
 o_orderdate::DATE::VARCHAR AS "dateApplied", (o_orderdate::DATE + 14)::VARCHAR AS "followUpDate", '' AS "emailUsed", 'note "' || o_orderstatus || '"' || chr(13) || chr(10) || 'line' AS notes,
 'https://example.org/' || o_custkey::VARCHAR AS "sourceLink", (o_orderdate::DATE + (o_orderkey % 30)::INT)::TIMESTAMP AS "lastUpdated", o_orderkey AS seed_ord
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
TOPIC_TEXT = "replace(research_summary, chr(10), ' | ')"


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2)"


def occ(h: str, t: str) -> str:
    return f"((length({h}) - length(replace({h}, {t}, '')))::DOUBLE / length({t}))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def names(terms: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def present(terms: list[str], x: str) -> str:
    return f"list_filter({names(terms)}, lambda t: contains(lower({x}), t))"


def themes_sql(x: str, variant: str = "py") -> str:
    cases = ", ".join(f"CASE WHEN len({present(ks, x)}) > 0 THEN '{n}' END" for n, ks in lists.THEMES[variant].items())
    return f"list_filter([{cases}], lambda t: t IS NOT NULL)"


def first_of(pairs: dict[str, str], x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{k}') THEN '{v}'" for k, v in pairs.items()) + " END"


def label_sql(slug: str, style: str, other: str) -> str:
    return f"CASE {slug} " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in lists.DEPARTMENTS[style].items()) + f" ELSE {other} END"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# Text

@query(f"WITH {PROFILES} SELECT id, array_to_string({tok('research_summary')}, ' ') AS tokens, len({tok('research_summary')})::INT AS n FROM p")
def tokenize(spark, d):
    t = text.tokenize(F.col("research_summary"))
    return bindings.profiles(spark, d).select("id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


@query(f"WITH {PROFILES} SELECT id, list_sum(list_transform(['the', 'th', 'ion', 'zzz'], lambda t: {occ('lower(research_summary)', 't')} + CASE WHEN contains(lower(research_summary), t) THEN 1.5::DOUBLE ELSE 0::DOUBLE END))::DOUBLE AS hits FROM p")
def token_hits(spark, d):
    tokens = F.array(*[F.lit(t) for t in ("the", "th", "ion", "zzz")])
    return bindings.profiles(spark, d).select("id", text.token_hits(tokens, F.col("research_summary")).alias("hits"))


_SMALL = ", ".join(f"'{w}'" for w in lists.SMALL_WORDS)


@query(f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(\\w+|\\W+)', 1), lambda w, i: CASE WHEN i > 1 AND w IN ({_SMALL}) THEN w WHEN starts_with(w, 'ß') THEN 'SS' || substring(w, 2) ELSE upper(substring(w, 1, 1)) || substring(w, 2) END), '') AS titled FROM documents")
def title_case(spark, d):
    return bindings.read(spark, d, "documents").select("doc_id", text.title_case(F.col("text")).alias("titled"))


@query(f"WITH {PROFILES} SELECT id, substring(research_summary, 1, 300) AS card, length(research_summary) > 300 AS card_cut, substring(research_summary, 1, 200) AS short, length(research_summary) > 200 AS short_cut FROM p")
def snippet(spark, d):
    card, short = text.snippet(F.col("research_summary"), 300), text.snippet(F.col("research_summary"), 200)
    return bindings.profiles(spark, d).select("id", card["text"].alias("card"), card["cut"].alias("card_cut"), short["text"].alias("short"), short["cut"].alias("short_cut"))


@query("WITH w AS (SELECT doc_id, text AS x FROM documents), g AS (SELECT doc_id, regexp_split_to_array(x, '(?i)(the|ti)') AS plain, regexp_extract_all(x, '(?i)(the|ti)', 1) AS hit FROM w) SELECT doc_id, array_to_string(list_transform(plain, lambda t, i: t || CASE WHEN i <= len(hit) THEN '<' || hit[i] || '>' ELSE '' END), '') AS marked FROM g")
def highlight(spark, d):
    segments = text.highlight(F.col("text"), F.array(F.lit("the"), F.lit("ti")))
    marked = F.transform(segments, lambda s: F.when(s["highlight"], F.concat(F.lit("<"), s["text"], F.lit(">"))).otherwise(s["text"]))
    return bindings.read(spark, d, "documents").select("doc_id", F.array_join(marked, "").alias("marked"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}', 0), '') AS email FROM documents")
def find_email(spark, d):
    return bindings.read(spark, d, "documents").select("doc_id", text.find_email(F.col("text")).alias("email"))


@query(f"WITH {PROFILES} SELECT id, list_extract(list_filter(regexp_split_to_array(name, '\\s+'), lambda w: w <> ''), -1) AS last_name, substring(name, 1, 1) AS initial FROM p")
def last_name(spark, d):
    return bindings.profiles(spark, d).select("id", text.last_name(F.col("name")).alias("last_name"), text.initial(F.col("name")).alias("initial"))


_SEED = "concat(doc_id::VARCHAR, coalesce(source, ''))"


def _mod(n: int) -> str:
    return f"((('0x' || substr(md5({_SEED}), 1, 16))::UBIGINT::HUGEINT % {n}) * {2**64 % n} + ('0x' || substr(md5({_SEED}), 17, 16))::UBIGINT::HUGEINT % {n}) % {n}"


@query(f"SELECT doc_id, ['a', 'b'][({_mod(2)} + 1)::INT] AS of_two, ['a', 'b', 'c'][({_mod(3)} + 1)::INT] AS of_three, ['a', 'b', 'c', 'd', 'e'][({_mod(5)} + 1)::INT] AS of_five FROM documents")
def stable_choice(spark, d):
    seed = F.concat(F.col("doc_id").cast("string"), F.coalesce("source", F.lit("")))
    return bindings.read(spark, d, "documents").select("doc_id", *[text.stable_choice(list(x), seed).alias(n) for x, n in (("ab", "of_two"), ("abc", "of_three"), ("abcde", "of_five"))])


@query(f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN list_slice({tok('text')}, 1, (doc_id % 5)::INT) ELSE {tok('text')} END AS xs FROM documents) SELECT doc_id, CASE len(xs) WHEN 0 THEN '' WHEN 1 THEN xs[1] WHEN 2 THEN xs[1] || ' and ' || xs[2] ELSE array_to_string(xs[1:-2], ', ') || ', and ' || xs[-1] END AS joined FROM t")
def join_list(spark, d):
    """All words of a text, or none to three of them."""
    n = (F.col("doc_id") % 5).cast("int")
    items = F.when(n < 4, F.slice(text.tokenize(F.col("text")), F.lit(1), n)).otherwise(text.tokenize(F.col("text")))
    return bindings.read(spark, d, "documents").select("doc_id", text.join_list(items).alias("joined"))


# Pages

@query("""SELECT page_id, (unnest(range(1, len(h) + 1)) - 1)::INT AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""")
def page_links(spark, d):
    return pages.page_links(bindings.read(spark, d, "pages"))


_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_PARTS = f"string_split(regexp_replace({_PATH}, '^/+|/+$', '', 'g'), '/')"
_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"


@query(f"SELECT page_id, coalesce(CASE WHEN contains({_HOST}, 'example.net') THEN nullif({_PARTS}[1], '') ELSE list_filter({_PARTS}, lambda x: x NOT IN ('', 'engineering', 'profiles', 'index.html') AND NOT ends_with(x, '.html'))[1] END, 'unknown') AS slug FROM pages")
def dept_slug(spark, d):
    return bindings.read(spark, d, "pages").select("page_id", text.dept_slug(F.col("url"), "example.net").alias("slug"))


@query(f"SELECT page_id, contains({_HOST}, 'example.net') AS on_domain FROM pages")
def is_domain(spark, d):
    return bindings.read(spark, d, "pages").select("page_id", text.is_domain(F.col("url"), "example.net").alias("on_domain"))


@query("SELECT page_id, substr(md5(url), 1, 12) AS id FROM pages")
def record_id(spark, d):
    return bindings.read(spark, d, "pages").select("page_id", text.record_id(F.col("url")).alias("id"))


@query("SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS url FROM pages")
def resolve_url(spark, d):
    return bindings.read(spark, d, "pages").select("page_id", pages.resolve_url(F.col("url")).alias("url"))


# Pages as SQL reads them: tokens, then the stack of open elements tag by tag, and with each end tag what it closes.

_REFERENCES = {"&nbsp;": " ", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def _decoded(x: str) -> str:
    for name, char in _REFERENCES.items():
        x = f"replace({x}, '{name}', '{char}')"
    return x


# The same by the rule of the page operators (``markup.decoded``): every reference, by the longest name there is behind the ``&``, its semicolon optional; an
# unknown name stays, without its semicolon; a number that is no character is U+FFFD, and 128 to 159 mean Windows' bytes.
_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*);?"
_NUMBER = "CASE WHEN regexp_full_match(n, '#[0-9]{1,9}') THEN substring(n, 2)::BIGINT WHEN regexp_full_match(n, '#[xX][0-9a-fA-F]{1,7}') THEN ('0x' || substring(n, 3))::BIGINT END"
_CHARACTER = "translate(chr((CASE WHEN c > 0 AND c <= 1114111 AND c NOT BETWEEN 55296 AND 57343 THEN c ELSE 65533 END)::INT), '{}', '{}')".format("".join(markup.BYTES), "".join(markup.BYTES.values()))


def _character_names() -> str:
    return "MAP {" + ", ".join("'{}': '{}'".format(name, char.replace("'", "''")) for name, char in sorted(markup.NAMES.items())) + "}"


def _every_reference(x: str) -> str:
    numbered = f"list_transform([{_NUMBER}], lambda c: {_CHARACTER})[1]"
    meant = f"CASE n WHEN 'amp' THEN '&' WHEN 'lt' THEN '<' WHEN 'gt' THEN '>' WHEN 'quot' THEN '\"' ELSE CASE WHEN starts_with(n, '#') THEN {numbered} ELSE coalesce({_character_names()}[n], '&' || n) END END"
    chars = f"list_transform(regexp_extract_all({x}, '{_REFERENCE}'), lambda r: list_transform([regexp_replace(r, '^&|;$', '', 'g')], lambda n: {meant})[1])"
    pieces = f"list_zip(regexp_split_to_array({x}, '{_REFERENCE}'), {chars})"
    return f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform({pieces}, lambda z: z[1] || coalesce(z[2], '')), '') ELSE {x} END"


_TOKENS = r"(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)>|</?[a-z][^>]*>|<![^>]*>|[^<]+"
_TAG = r"lower(regexp_extract(t[i + 1], '^</?([a-zA-Z][a-zA-Z0-9]*)', 1))"
_ALONE = "('br', 'img', 'meta', 'link', 'hr', 'input', 'script', 'style')"
_BACK = f"list_position(list_reverse(list_transform(open, lambda o: o.name)), {_TAG})"
# White space of any kind, as ``text.strip`` and ``markup.one_line`` take it.
_SPACE = r"[\t-\r\x{85}\p{Z}]"


def _strip_all(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _tree(texts: str) -> str:
    return f"""tk AS (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), '{_TOKENS}') AS t FROM pages),
tx AS (SELECT page_id, url, t, list_transform(t, lambda k: CASE WHEN NOT starts_with(k, '<') THEN {texts} END) AS texts FROM tk),
st AS (SELECT page_id, t, 0 AS i, []::STRUCT(pos INT, name VARCHAR)[] AS open, []::STRUCT(pos INT, stop INT, name VARCHAR)[] AS shut FROM tk
 UNION ALL SELECT page_id, t, i + 1,
 CASE WHEN {_TAG} = '' THEN open WHEN NOT starts_with(t[i + 1], '</') THEN CASE WHEN {_TAG} IN {_ALONE} THEN open ELSE list_append(open, {{'pos': i + 1, 'name': {_TAG}}}) END
      WHEN coalesce({_BACK}, 0) > 0 THEN open[:len(open) - {_BACK}] ELSE open END,
 CASE WHEN {_TAG} <> '' AND starts_with(t[i + 1], '</') AND coalesce({_BACK}, 0) > 0 THEN list_transform(open[len(open) - {_BACK} + 1:], lambda o: {{'pos': o.pos, 'stop': i + 1, 'name': o.name}}) ELSE [] END
 FROM st WHERE i < len(t)),
el AS (SELECT page_id, unnest(shut, recursive := true) FROM st UNION ALL SELECT page_id, unnest(list_transform(open, lambda o: {{'pos': o.pos, 'stop': (len(t) + 1)::INT, 'name': o.name}}), recursive := true) FROM st WHERE i = len(t)),
held AS (SELECT page_id, pos, stop, name, list_filter(texts[pos + 1:stop - 1], lambda k: k <> '') AS said FROM el JOIN tx USING (page_id))"""


_TREE = _tree(strip(_decoded("k")))
_PAGES = _tree(_strip_all(_every_reference("k")))


def _tidy(x: str) -> str:
    return _strip_all(f"regexp_replace({x}, '{_SPACE}+', ' ', 'g')")


_NAMES = "nm AS (SELECT page_id, arg_min(array_to_string(said, ' '), pos) AS name FROM held WHERE name = 'h1' GROUP BY page_id)"


@query(f"WITH RECURSIVE {_PAGES} SELECT page_id, pos - 1 AS pos, stop - 1 AS \"end\", name, array_to_string(said, ' ') AS text FROM held")
def page_elements(spark, d):
    """Every element of every page but those that hold nothing."""
    found = elements.table(blocks.spread(bindings.read(spark, d, "pages").select("page_id", "html")))
    return found.filter(~F.col("name").isin(*markup.VOID, *markup.RAW)).select("page_id", "pos", "end", "name", "text")


@query(f"WITH RECURSIVE {_PAGES}, {_NAMES} SELECT page_id, coalesce(name, '') AS name FROM tk LEFT JOIN nm USING (page_id)")
def extract_name(spark, d):
    return _fields(spark, d).select("page_id", "name")


@query(f"""WITH RECURSIVE {_PAGES}, {_NAMES},
ps AS (SELECT page_id, pos, {_tidy("array_to_string(said, ' ')")} AS p FROM held WHERE name = 'p' AND length(array_to_string(said, '')) > 100),
lo AS (SELECT page_id, arg_min(p, (-length(p), pos)) AS p FROM ps GROUP BY page_id)
SELECT page_id, url, coalesce(name, '') AS name, '' AS title, '' AS email, coalesce({_strip_all("substring(p, 1, 1200)")}, '') AS research_summary,
'' AS lab_website, '' AS google_scholar, '' AS photo_url, '' AS phone, '' AS office FROM tk LEFT JOIN nm USING (page_id) LEFT JOIN lo USING (page_id)""")
def page_fields(spark, d):
    """The tables' pages have a heading and paragraphs, some never closed; other fields are in ``profile_page_fields`` and the tests."""
    return _fields(spark, d)


@query(f"""WITH RECURSIVE {_PAGES}, {_NAMES}
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Name of ' || page_id::VARCHAR ELSE coalesce(name, 'Name of ' || page_id::VARCHAR) END AS name, CASE WHEN page_id % 4 = 3 THEN '' ELSE 'Professor of Sums' END AS title,
CASE page_id % 4 WHEN 0 THEN 'm' || page_id::VARCHAR || '@x.org' WHEN 1 THEN 'a' || page_id::VARCHAR || '@x.org' ELSE '' END AS email,
CASE WHEN page_id % 3 = 0 THEN 'engines | notes and more' ELSE {_strip_all("substring(" + _tidy("array_to_string(list_concat(['Long ' || page_id::VARCHAR], list_filter(texts, lambda k: k <> '')), ' ')") + ", 1, 1200)")} END AS research_summary,
CASE WHEN page_id % 2 = 0 THEN 'https://lab' || page_id::VARCHAR || '.org/' ELSE '' END AS lab_website, CASE WHEN page_id % 2 = 1 THEN 'https://scholar.google.com/citations?user=U' || page_id::VARCHAR || '&hl=en' ELSE '' END AS google_scholar,
regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/p' || page_id::VARCHAR || '.jpg' AS photo_url, '555-' || page_id::VARCHAR AS phone, 'R ' || page_id::VARCHAR AS office FROM tx LEFT JOIN nm USING (page_id)""")
def profile_page_fields(spark, d):
    """Each page inside a profile's page of one of several layouts, so that every field has a value; names and summaries come from the page itself in part."""
    n, key = F.col("page_id"), F.col("page_id").cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    label = lambda kind, value: say('<li><div><span class="profile__contact-label">', kind, "</span></div> ", value, "</li>")
    own = text.or_empty(F.col("html"))
    html = F.concat(
        F.when(n % 2 == 0, say("<h1>Name <i>of</i> ", key, "</h1>")).otherwise(say("<h2>Name of ", key, "</h2>")),
        F.when(n % 4 == 0, F.lit('<div class="profile__titles"><div></div><ul><li>Professor of Sums</li><li>Dean</li></ul></div>')).when(n % 4 == 3, F.lit('<p class="title">gardener</p>')).otherwise(F.lit('<p class="page title">Professor <b>of</b> Sums</p>')),
        say('<div class="wide profile__image"><div>x</div><a href="/"><img alt="5 > 4" src="/a/../p', key, '.jpg"></a></div><ul class="profile__contact">'),
        F.when(n % 2 == 0, F.concat(label("Phone", say("555-", key)), label("Office", F.lit("old")), label("Office", say("R ", key)))).otherwise(say('<a href="tel:555-', key, '">call</a><b>Office location</b><span>R ', key, "</span>")),
        F.when(n % 4 == 0, label("Email", say('<a href="mailto:m', key, '@x.org">m</a>'))).when(n % 4 == 1, say('<div class="vcard"><div>write</div> to a', key, "@x.org</div>")).otherwise(F.lit("")), F.lit("</ul>"),
        F.when(n % 2 == 0, say('<a href="https://lab', key, '.org/">our lab</a>')).otherwise(say('<a href="https://scholar.google.com/citations?user=U', key, '&amp;hl=en">s</a>')),
        F.when(n % 3 == 0, say("<h3>Research Interests</h3><ul><li>engines</li><li>notes</li></ul><p>and <b>more</b></p><h3>Other</h3><div>", own)).otherwise(say('<div id="my-research-box"><div>Long ', key, "</div><section>", own, "</section></div>")),
    )
    made = blocks.spread(bindings.read(spark, d, "pages")).select("page_id", "url", html.alias("html"))
    return pages.extract_fields(made).drop("url")


def _fields(spark, d):
    return pages.extract_fields(blocks.spread(bindings.read(spark, d, "pages").select("page_id", "url", "html")))


# Matching and search

def _seekers(spark, d):
    s = bindings.sessions(spark, d).withColumn("parsed_profile", resumes.parsed(F.col("raw_text")))
    tokens = matching.resume_tokens(*[F.col(f"parsed_profile.{c}") for c in ("inferred_themes", "technical_skills", "coursework", "lab_techniques")])
    return s.withColumn("interest_tokens", text.tokenize(F.col("interests"))).withColumn("resume_tokens", tokens)


_RTOK = tok(f"array_to_string(list_concat(list_concat({themes_sql('raw_text')}, {present(lists.SKILLS['py'], 'raw_text')}), {present(lists.TECHNIQUES['py'], 'raw_text')}), ' ')")
_MATCHED = f"""{PROFILES}, {SESSIONS},
it AS (SELECT session_id, t, count(*) AS m FROM (SELECT session_id, unnest({tok('interests')}) AS t FROM s) GROUP BY ALL),
rt AS (SELECT session_id, t, count(*) AS m FROM (SELECT session_id, unnest({_RTOK}) AS t FROM s) GROUP BY ALL),
ts AS (SELECT DISTINCT t FROM (SELECT t FROM it UNION ALL SELECT t FROM rt)),
w AS (SELECT id, seed_ord, lower(research_summary) AS su, lower(research_summary || ' ' || name || ' ' || department) AS every FROM p),
h AS (SELECT t, id, {occ('every', 't')} + 1.5::DOUBLE + CASE WHEN contains(su, t) THEN 2::DOUBLE ELSE 0::DOUBLE END AS i, CASE WHEN contains(su, t) THEN {occ('su', 't')} + 1.5::DOUBLE ELSE 0::DOUBLE END AS r FROM ts JOIN w ON contains(every, t)),
c AS (SELECT session_id, id, sum(i) AS i, sum(r) AS r FROM (SELECT session_id, id, m * i AS i, 0::DOUBLE AS r FROM it JOIN h USING (t) UNION ALL SELECT session_id, id, 0::DOUBLE, m * r FROM rt JOIN h USING (t)) GROUP BY ALL),
f AS (SELECT session_id, id, i + 0.35::DOUBLE * r AS score FROM c WHERE i + 0.35::DOUBLE * r >= 0.1::DOUBLE),
x AS (SELECT session_id, id, score, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, seed_ord)::INT AS rank FROM f JOIN p USING (id)
      UNION ALL SELECT session_id, id, 1.0::DOUBLE, row_number() OVER (PARTITION BY session_id ORDER BY seed_ord)::INT FROM s CROSS JOIN p WHERE session_id NOT IN (SELECT session_id FROM f)),
y AS (SELECT *, max(score) OVER (PARTITION BY session_id) AS best FROM x WHERE rank <= 20),
z AS (SELECT session_id, id, rank, score AS raw, round(score, 4) AS score, CASE WHEN best = 0 THEN 'adjacent_fit' WHEN score / best >= 0.6::DOUBLE THEN 'strong_fit' WHEN score / best >= 0.25::DOUBLE THEN 'exploratory_fit' ELSE 'adjacent_fit' END AS fit_label FROM y)"""


@query(f"WITH {_MATCHED} SELECT session_id, id, rank, score, fit_label FROM z")
def match_topn(spark, d):
    return matching.match_profiles(bindings.profiles(spark, d), _seekers(spark, d)).select("session_id", "id", "rank", "score", "fit_label")


@query(f"WITH {_MATCHED} SELECT session_id, id, rank, score, fit_label FROM z")
def match_topn_indexed(spark, d):
    """The same from a word index, written first."""
    profiles = bindings.profiles(spark, d)
    index = word_index.scratch_index(blocks.spread(profiles))
    return matching.match_profiles(profiles, _seekers(spark, d), index=index).select("session_id", "id", "rank", "score", "fit_label")


@query(f"""WITH {PROFILES}, {SESSIONS} SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY seed_ord)::INT AS rank, 1.0::DOUBLE AS score, 'strong_fit' AS fit_label FROM s CROSS JOIN p QUALIFY rank <= 7""")
def match_without_words(spark, d):
    """Seekers whose words no profile has get the first profiles."""
    asked = F.array(F.lit("zzqqzz"))
    seekers = bindings.sessions(spark, d).select("session_id", asked.alias("interest_tokens"), asked.alias("resume_tokens"))
    return matching.match_profiles(bindings.profiles(spark, d), seekers, 7).select("session_id", "id", "rank", "score", "fit_label")


def _matches(spark, d):
    profiles, seekers = bindings.profiles(spark, d), _seekers(spark, d)
    return matching.match_profiles(profiles, seekers).join(profiles, "id").join(seekers, "session_id")


_JOINED = f"WITH {_MATCHED}, j AS (SELECT z.*, p.name, p.title, p.department, p.research_summary, s.interests, s.raw_text, {themes_sql('raw_text')} AS themes, {present(lists.SKILLS['py'], 'raw_text')} AS skills FROM z JOIN p USING (id) JOIN s USING (session_id))"
_DEPT = label_sql("department", "match", "coalesce(department, 'their department')")


@query(_JOINED + f" SELECT session_id, rank, name || ' (' || {_DEPT} || ') works on ' || regexp_replace(substring(research_summary, 1, 120), '\\s+$', '') || '…, close to the interest in ' || regexp_replace(substring(interests, 1, 80), '\\s+$', '') || '.' || CASE WHEN len(themes) > 0 THEN ' Their background in ' || themes[1] || ' helps.' ELSE '' END AS explanation FROM j")
def match_explanation(spark, d):
    made = matching.explanation(F.col("name"), F.col("department"), F.col("research_summary"), F.col("interests"), F.col("parsed_profile.inferred_themes"))
    return _matches(spark, d).select("session_id", "rank", made.alias("explanation"))


@query(_JOINED + f" SELECT session_id, rank, name || ' (' || {_DEPT} || '): ' || {strip("regexp_replace(substring(research_summary, 1, 130), '\\|[^\\n\\r]*$', '')")} || '… for ' || substring(interests, 1, 80) AS explanation FROM j")
def match_explanation_short(spark, d):
    made = matching.short_explanation(F.col("name"), F.col("department"), F.col("research_summary"), F.col("interests"))
    return _matches(spark, d).select("session_id", "rank", made.alias("explanation"))


@query(_JOINED + " SELECT session_id, rank, 'Profile: ' || name || ', ' || department || chr(10) || 'Research: ' || substring(research_summary, 1, 400) || chr(10) || chr(10) || 'Interests: ' || interests || chr(10) || 'Themes: ' || coalesce(nullif(array_to_string(themes[1:5], ', '), ''), 'general engineering') || chr(10) || 'Skills: ' || coalesce(nullif(array_to_string(skills[1:5], ', '), ''), 'various tools') || chr(10) || chr(10) || 'Explain the match in two sentences.' AS prompt FROM j WHERE rank <= 10")
def match_prompt(spark, d):
    made = matching.explanation_prompt(F.col("name"), F.col("department"), F.col("research_summary"), F.col("interests"), F.col("parsed_profile.inferred_themes"), F.col("parsed_profile.technical_skills"))
    return _matches(spark, d).filter("rank <= 10").select("session_id", "rank", made.alias("prompt"))


@query(f"WITH {RESUMES} SELECT id, array_to_string({_RTOK}, ' ') AS tokens FROM r")
def resume_tokens(spark, d):
    p = resumes.parsed(F.col("raw_text"))
    return bindings.resumes(spark, d).select("id", F.array_join(matching.resume_tokens(p["inferred_themes"], p["technical_skills"], p["coursework"], p["lab_techniques"]), " ").alias("tokens"))


@query(f"WITH {SESSIONS} SELECT session_id, coalesce(nullif({strip('asked')}, ''), interests, '') AS interests FROM (SELECT session_id, interests, CASE session_id::INT % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || substring(raw_text, 1, 20) || ' ' END AS asked FROM s) WHERE TRUE".replace("coalesce(nullif(regexp_replace(asked", "coalesce(nullif(regexp_replace(coalesce(asked, '')"))
def effective_interests(spark, d):
    n = F.col("session_id").cast("int") % 3
    asked = F.when(n == 0, F.lit("  ")).when(n == 1, F.concat(F.lit(" "), F.substring("raw_text", 1, 20), F.lit(" ")))
    return bindings.sessions(spark, d).select("session_id", matching.effective_interests(asked, F.col("interests")).alias("interests"))


def _combined(sep: str) -> str:
    own = strip("interests")
    return f"WITH {SESSIONS} SELECT session_id, array_to_string(list_concat(list_filter([{own}], lambda x: x <> ''), list_filter(['THE', 'robotics', 'Th', 'energy'], lambda c: NOT contains(lower({own}), lower(c)))), '{sep}') AS combined FROM s"


@query(_combined(", "))
def merge_interests(spark, d):
    chips = F.array(*[F.lit(c) for c in ("THE", "robotics", "Th", "energy")])
    return bindings.sessions(spark, d).select("session_id", text.add_missing(F.col("interests"), chips, ", ").alias("combined"))


@query(_combined(" "))
def combine_query(spark, d):
    chips = F.array(*[F.lit(c) for c in ("THE", "robotics", "Th", "energy")])
    return bindings.sessions(spark, d).select("session_id", text.add_missing(F.col("interests"), chips, " ").alias("combined"))


@query(rf"WITH {PROFILES} SELECT id FROM p WHERE department = 'src3' AND regexp_matches(research_summary, '\S')")
def filter_profiles(spark, d):
    return matching.filter_profiles(bindings.profiles(spark, d), "src3", True).select("id")


_EVERY = "lower(concat_ws(' ', research_summary, name, title, department))"
_SEARCH = f"""q AS (SELECT id, seed_ord, list_sum(list_transform(['thing', 'nation', 'en', 'doc'], lambda t: {occ(_EVERY, 't')} + CASE WHEN contains(lower(name), t) THEN 5::DOUBLE ELSE 0::DOUBLE END + CASE WHEN contains(lower(research_summary), t) THEN 2::DOUBLE ELSE 0::DOUBLE END))::DOUBLE AS score FROM p)"""


@query(f"WITH {PROFILES}, {_SEARCH} SELECT id, score FROM q WHERE score > 0")
def search_rank_one(spark, d):
    return matching.search_and_rank(blocks.spread(bindings.profiles(spark, d)), "Thing nation, en doc!").select("id", "score")


@query(f"WITH {PROFILES}, {_SEARCH} SELECT id, score, row_number() OVER (ORDER BY score DESC, seed_ord)::INT AS place FROM q WHERE score > 0 ORDER BY score DESC, seed_ord LIMIT 24 OFFSET 24")
def search_page(spark, d):
    """The second page of results, with places."""
    return ranks.page(spark, _ranked(spark, d), 2).select("id", "score", F.col("rank").cast("int").alias("place"))


def _ranked(spark, d) -> str:
    path = places.scratch(spark, "ranks")
    found = matching.scored(blocks.spread(bindings.profiles(spark, d)), "Thing nation, en doc!")
    ranks.write(found.select("id", "score", "seed_ord"), [F.col("score").desc(), F.col("seed_ord")], path)
    return path


@query(f"WITH {PROFILES}, {_SEARCH}, r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, seed_ord) AS place FROM q WHERE score > 0) SELECT id, score, place::INT AS place, ceil(place / 24)::BIGINT AS page FROM r")
def search_pages(spark, d):
    """All pages of the results: places without a sort in one task."""
    return ranks.rows(spark, _ranked(spark, d)).select("id", "score", F.col("rank").cast("int").alias("place"), F.ceil(F.col("rank") / 24).cast("long").alias("page"))


@query("""WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place, count(*) OVER (PARTITION BY source) AS total FROM documents WHERE source IS NOT NULL),
w AS (SELECT DISTINCT source, least(greatest(page, 1), greatest(ceil(total / 24), 1)) AS page FROM r, (SELECT unnest([2, 99]) AS page))
SELECT source, doc_id, place, ceil(place / 24)::BIGINT AS page FROM r JOIN w USING (source) WHERE ceil(place / 24) = page""")
def group_pages(spark, d):
    """A batch of pages: of each source's documents, longest first, the second page and the last."""
    docs, path = bindings.read(spark, d, "documents").filter("source is not null"), places.scratch(spark, "ranks")
    ranks.write(docs.select("source", "doc_id", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], path, ["source"])
    asked = docs.select("source").distinct().withColumn("page", F.explode(F.array(F.lit(2), F.lit(99))))
    return ranks.pages(spark, path, asked, "source").select("source", "doc_id", F.col("rank").alias("place"), "page")


@query(f"WITH {PROFILES}, {_SEARCH} SELECT count(*) AS results, greatest(1, ceil(count(*) / 24))::BIGINT AS pages FROM q WHERE score > 0")
def result_counts(spark, d):
    return matching.result_counts(matching.search_and_rank(blocks.spread(bindings.profiles(spark, d)), "Thing nation, en doc!"))


@query(f"""WITH {PROFILES}, b AS (SELECT item_id::VARCHAR AS query_id, text AS query FROM benchmark),
q AS (SELECT query_id, t, count(*) AS m FROM (SELECT query_id, unnest({tok('query')}) AS t FROM b) GROUP BY ALL), ts AS (SELECT DISTINCT t FROM q),
w AS (SELECT id, lower(name) AS nm, lower(research_summary) AS su, {_EVERY} AS every FROM p),
h AS (SELECT t, id, {occ('every', 't')} + CASE WHEN contains(nm, t) THEN 5::DOUBLE ELSE 0::DOUBLE END + CASE WHEN contains(su, t) THEN 2::DOUBLE ELSE 0::DOUBLE END AS x FROM ts JOIN w ON contains(every, t)),
f AS (SELECT query_id, id, sum(m * x)::DOUBLE AS score FROM q JOIN h USING (t) GROUP BY ALL),
k AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seed_ord)::INT AS rank FROM f JOIN p USING (id)) SELECT * FROM k WHERE rank <= 24""")
def search_batch(spark, d):
    asked = bindings.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    return matching.search_batch(bindings.profiles(spark, d), asked)


@query(ORACLE_SQL["search_batch"])
def search_batch_indexed(spark, d):
    """The same from a word index, written first."""
    asked, profiles = bindings.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")), bindings.profiles(spark, d)
    return matching.search_batch(profiles, asked, index=word_index.scratch_index(blocks.spread(profiles)))


@query("SELECT DISTINCT source AS department FROM documents WHERE source <> ''")
def departments(spark, d):
    return matching.departments(bindings.profiles(spark, d))


_SLUG = "[" + ", ".join(f"'{k}'" for k in [*lists.DEPARTMENTS["search"], "unknown-slug"]) + ", ''][(doc_id % 25 + 1)::INT]"


@query(f"WITH x AS (SELECT doc_id, {_SLUG} AS slug FROM documents) SELECT doc_id, slug, {label_sql('slug', 'search', "coalesce(nullif(slug, ''), 'Unknown')")} AS search, {label_sql('slug', 'tracker', 'upper(substring(slug, 1, 1)) || substring(slug, 2)')} AS tracker FROM x")
def dept_label(spark, d):
    slug = F.get(F.array(*[F.lit(k) for k in [*lists.DEPARTMENTS["search"], "unknown-slug", ""]]), (F.col("doc_id") % 25).cast("int"))
    return bindings.read(spark, d, "documents").select("doc_id", slug.alias("slug"), text.dept_label(slug, "search").alias("search"), text.dept_label(slug, "tracker").alias("tracker"))


@query(f"WITH {PROFILES} SELECT id, name, title, department, profile_url, length(research_summary)::INT AS n FROM p")
def list_profiles(spark, d):
    return bindings.profiles(spark, d).select("id", "name", "title", "department", "profile_url", F.length("research_summary").alias("n"))


@query(f"WITH {PROFILES} SELECT id, name, department FROM p WHERE id = '17'")
def get_profile(spark, d):
    return bindings.profiles(spark, d).filter("id = '17'").select("id", "name", "department")


@query("SELECT count(*) AS profiles, count(DISTINCT nullif(source, '')) AS departments FROM documents")
def corpus_totals(spark, d):
    return matching.corpus_totals(bindings.profiles(spark, d))


# Topics and history

def _piped(spark, d):
    return blocks.spread(bindings.profiles(spark, d)).withColumn("research_summary", F.replace(F.col("research_summary"), F.lit("\n"), F.lit(" | ")))


_TOPICS = f"""{PROFILES}, g AS (SELECT id, seed_ord, list_filter(list_transform(string_split({TOPIC_TEXT}, '|')[2:], lambda x: lower({strip('x')})), lambda x: length(x) >= 3 AND length(x) <= 40 AND (contains(x, ' ') OR x NOT IN ({', '.join(f"'{g}'" for g in lists.GENERIC_TOPICS)}))) AS ts FROM p),
e AS (SELECT id, seed_ord, unnest(ts) AS topic, unnest(range(1, len(ts) + 1)) AS pos FROM g), pt AS (SELECT id, seed_ord, topic, min(pos) AS pos FROM e GROUP BY ALL)"""


@query(f"WITH {_TOPICS} SELECT id, topic FROM pt")
def profile_topics(spark, d):
    return topics.profile_topics(_piped(spark, d)).select("id", "topic")


_TITLED = "array_to_string(list_transform(regexp_extract_all(q, '([0-9A-Za-z_]+|[^0-9A-Za-z_]+)', 1), lambda w, i: CASE WHEN i > 1 AND w IN (" + ", ".join(f"'{w}'" for w in lists.SMALL_WORDS) + ") THEN w ELSE upper(substring(w, 1, 1)) || substring(w, 2) END), '')"
_TOP = f"{_TOPICS}, tt AS (SELECT topic AS q, count(*) AS count, min((seed_ord, pos)) AS first FROM pt GROUP BY topic ORDER BY count(*) DESC, min((seed_ord, pos)) LIMIT 30)"


@query(f"WITH {_TOP} SELECT {_TITLED} AS label, q, count FROM tt")
def top_topics(spark, d):
    return topics.top_topics(_piped(spark, d)).select("label", "q", "count")


_SEARCHES = "se AS (SELECT lower(trim(event_type)) AS q, count(*) AS n FROM events WHERE length(trim(event_type)) >= 2 GROUP BY ALL)"


@query(f"WITH {_SEARCHES} SELECT q, n FROM se")
def record_search(spark, d):
    return topics.record_search(bindings.read(spark, d, "events"), "event_type")


@query(f"WITH {_TOP}, {_SEARCHES} SELECT label, q, score FROM (SELECT {_TITLED} AS label, q, coalesce(count, 0) + 3 * coalesce(n, 0) AS score, first FROM tt FULL OUTER JOIN se USING (q) WHERE count IS NOT NULL OR (n >= 2 AND length(q) >= 3)) ORDER BY score DESC, first IS NULL, first, q LIMIT 15")
def merge_topics(spark, d):
    return topics.merge_topics(topics.top_topics(_piped(spark, d)), topics.record_search(bindings.read(spark, d, "events"), "event_type"))


def _arriving(spark, df, order: list[str], files: int = 4):
    """A table as a stream of ``files`` files, one to a batch."""
    path = places.scratch(spark, "arrivals")
    df.repartitionByRange(files, *order).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(ORACLE_SQL["merge_topics"])
def live_topics(spark, d):
    """The same from a stream of searches, batch by batch."""
    events, path = bindings.read(spark, d, "events"), places.scratch(spark, "live-topics")
    found = topics.top_topics(_piped(spark, d)).persist()
    history.live_topics(_arriving(spark, events, ["event_id"]), found, places.scratch(spark, "stream"), path, query_col="event_type").awaitTermination()
    found.unpersist()
    return buckets.read(spark, path).select("label", "q", "score")


# Résumés

def _parts(variant: str) -> str:
    first = f"list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')[1]"
    count = f"len(list_filter(regexp_split_to_array({first}, '\\s+'), lambda x: x <> ''))" if variant == "py" else f"len(string_split({first}, ' '))"
    return (
        f"WITH {RESUMES} SELECT id, array_to_string({present(lists.SKILLS[variant], 'raw_text')}, '|') AS skills, array_to_string({present(lists.TECHNIQUES[variant], 'raw_text')}, '|') AS techniques, array_to_string({themes_sql('raw_text', variant)}, '|') AS themes, "
        f"CASE WHEN {count} <= 4 THEN {first} END AS name, {first_of(lists.YEARS[variant], 'raw_text')} AS year, {first_of({m: m.title() for m in lists.MAJORS[variant]}, 'raw_text')} AS major FROM r"
    )


def _parse(spark, d, variant):
    p = F.col("parsed_profile")
    return resumes.parse_resumes(bindings.resumes(spark, d), variant=variant).select(
        "id", F.array_join(p["technical_skills"], "|").alias("skills"), F.array_join(p["lab_techniques"], "|").alias("techniques"), F.array_join(p["inferred_themes"], "|").alias("themes"), p["name"].alias("name"), p["year"].alias("year"), p["major"].alias("major")
    )


@query(_parts("py"))
def parse_resumes(spark, d):
    return _parse(spark, d, "py")


@query(_parts("js"))
def parse_resumes_js(spark, d):
    return _parse(spark, d, "js")


@query(rf"WITH {RESUMES} SELECT id, length(substring(raw_text, 1, 50000))::INT AS n FROM r WHERE regexp_matches(raw_text, '\S')")
def valid_resume_text(spark, d):
    return resumes.valid_resume_text(bindings.resumes(spark, d)).select("id", F.length("raw_text").alias("n"))


@query(f"WITH {RESUMES} SELECT id, 'Résumé text:' || chr(10) || chr(10) || substring(raw_text, 1, 6000) AS prompt FROM r")
def resume_prompt(spark, d):
    return bindings.resumes(spark, d).select("id", resumes.resume_prompt(F.col("raw_text")).alias("prompt"))


# Overviews

_REVIEW = "CASE (seed_ord % 5)::INT WHEN 1 THEN 'A faculty member in ' || department WHEN 2 THEN 'Please provide text' WHEN 3 THEN 'A sound overview of the work.' WHEN 4 THEN 'Close the menu' ELSE '' END"
_POOR = "(contains(substring(review, 1, 80), 'faculty member in') OR starts_with(review, 'Please provide') OR contains(review, 'Close the') OR contains(review, 'Faculty & Research menu') OR contains(review, 'Instructional Faculty'))"


def _reviewed(spark, d):
    review = F.expr("case cast(seed_ord % 5 as int) when 1 then concat('A faculty member in ', department) when 2 then 'Please provide text' when 3 then 'A sound overview of the work.' when 4 then 'Close the menu' else '' end")
    return bindings.profiles(spark, d).withColumn("ai_review", review)


@query(f"WITH {PROFILES}, v AS (SELECT id, {_REVIEW} AS review, length({strip('research_summary')}) >= 40 AS long FROM p) SELECT id, review = '' AND long AS missing, (review = '' AND long) OR (review <> '' AND {_POOR}) AS local, long AND (review = '' OR {_POOR}) AS strict FROM v")
def needs_review(spark, d):
    return _reviewed(spark, d).select("id", *[enrichment.needs_review(F.col("research_summary"), F.col("ai_review"), r).alias(r) for r in ("missing", "local", "strict")])


def _cleaned(x: str) -> str:
    for pattern in lists.FILLER:
        x = f"regexp_replace({x}, '{pattern}', '', 'gi')"
    return x


_CLEAN = f"""{PROFILES}, c0 AS (SELECT id, name, department, list_transform(regexp_split_to_array({_cleaned(TOPIC_TEXT)}, '\\s*\\|\\s*|\\n'), lambda x: regexp_replace({strip('x')}, '\\.+$', '')) AS ts FROM p),
c1 AS (SELECT id, name, department, list_filter(ts, lambda x: length(x) >= 3 AND length(x) <= 300 AND NOT regexp_matches(x, '{lists.HEADING_TOPIC}', 'i') AND NOT regexp_matches(x, '{lists.MENU_TOPIC}', 'i')) AS ts FROM c0),
c2 AS (SELECT id, name, department, list_filter(ts, lambda x, i: list_position(list_transform(ts, lambda y: lower(y)), lower(x)) = i) AS ts FROM c1)"""


@query(f"WITH {_CLEAN} SELECT id, array_to_string(ts, '|') AS topics, len(ts)::INT AS n FROM c2")
def clean_topics(spark, d):
    return _topics(spark, d).select("id", F.array_join("ts", "|").alias("topics"), F.size("ts").alias("n"))


def _topics(spark, d):
    return _piped(spark, d).withColumn("ts", enrichment.clean_topics(F.col("research_summary")))


@query(f"WITH {_CLEAN} SELECT id, array_to_string(list_filter(ts, lambda t: NOT list_bool_or(list_transform(ts, lambda o: lower(o) <> lower(t) AND contains(lower(o), lower(t))))), '|') AS topics FROM c2")
def most_specific(spark, d):
    return _topics(spark, d).select("id", F.array_join(enrichment.most_specific(F.col("ts")), "|").alias("topics"))


@query(f"WITH {_CLEAN} SELECT id, coalesce(list_sum(list_transform(ts, lambda t: length(t))), 0) < len(ts) * 50 AS keywords FROM c2")
def keyword_style(spark, d):
    return _topics(spark, d).select("id", enrichment.keyword_style(F.col("ts")).alias("keywords"))


@query(f"WITH {_CLEAN} SELECT id, array_to_string(list_filter([replace(coalesce(ts[1], 'x'), 'e', 'E'), 'optics', department, 'the', 'robots', 'wind'], lambda i: NOT list_contains(list_transform(ts, lambda y: lower(y)), lower(i)))[1:4], '|') AS interests FROM c2")
def new_interests(spark, d):
    given = F.array(F.replace(F.coalesce(F.get("ts", F.lit(0)), F.lit("x")), F.lit("e"), F.lit("E")), F.lit("optics"), F.col("department"), F.lit("the"), F.lit("robots"), F.lit("wind"))
    return _topics(spark, d).select("id", F.array_join(enrichment.new_interests(given, F.col("ts")), "|").alias("interests"))


def _listed(xs: str) -> str:
    return f"CASE len({xs}) WHEN 0 THEN '' WHEN 1 THEN {xs}[1] WHEN 2 THEN {xs}[1] || ' and ' || {xs}[2] ELSE array_to_string({xs}[1:-2], ', ') || ', and ' || {xs}[-1] END"


def _picked(suffix: str, *options: str) -> str:
    n, seed = len(options), f"md5(coalesce(name, '') || coalesce(department, '') || '{suffix}')"
    at = f"((('0x' || substr({seed}, 1, 16))::UBIGINT::HUGEINT % {n}) * {2**64 % n} + ('0x' || substr({seed}, 17, 16))::UBIGINT::HUGEINT % {n}) % {n}"
    return "CASE (" + at + ")::INT " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


def _review_sql() -> str:
    capital = "CASE WHEN starts_with(lo[1], 'ß') THEN 'SS' ELSE upper(substring(lo[1], 1, 1)) END || substring(lo[1], 2)"
    dotted = lambda x: f"CASE WHEN ends_with({x}, '.') THEN {x} ELSE {x} || '.' END"
    opening = _picked(
        "open", "'Dr. ' || last || ' of ' || dept || ' has expertise in ' || three || '.'", "'In ' || dept || ', Dr. ' || last || ' centres research on ' || three || '.'", "'Dr. ' || last || ' leads work in ' || dept || ' on ' || three || '.'",
        "'At ' || dept || ', Dr. ' || last || ' studies ' || three || '.'", "'Dr. ' || last || ', of the ' || dept || ' department, specialises in ' || three || '.'",
    )
    middle = _picked("mid", *[f"'{x}' || four || '.'" for x in ("The work also covers ", "Further interests are ", "Contributions extend to ", "Another focus is on ")])
    extra = _picked("extra", *[f"'{x}' || eight || '.'" for x in ("Other activity includes ", "A wider portfolio reaches ")])
    long_open = _picked("longopen", f"'The lab of Dr. ' || last || ' belongs to ' || dept || '. ' || {capital}", f"'In ' || dept || ', the research of Dr. ' || last || ' is as follows: ' || {capital}")
    short_open = _picked("shortopen", "'The research of Dr. ' || last || ' in ' || dept || ' is on ' || s3 || '.'", "'In ' || dept || ', Dr. ' || last || ' works in the areas of ' || s3 || '.'")
    close = _picked(
        "close", "'Students with these interests may find the lab of Dr. ' || last || ' a good fit.'", "'This breadth makes the group of Dr. ' || last || ' open to students of several fields.'",
        "'Recent publications of Dr. ' || last || ' tell more.'", "'The group of Dr. ' || last || ' works where several areas of ' || dept || ' meet.'",
    )
    specific = "list_filter(ts, lambda t: NOT list_bool_or(list_transform(ts, lambda o: lower(o) <> lower(t) AND contains(lower(o), lower(t)))))"
    dept = label_sql("department", "review", "upper(substring(coalesce(department, ''), 1, 1)) || substring(coalesce(department, ''), 2)")
    return f"""WITH {_CLEAN}, k AS (SELECT *, len(ts) >= 2 AND list_sum(list_transform(ts, lambda t: length(t))) < len(ts) * 50 AS key FROM c2),
m AS (SELECT id, name, department, len(ts) AS n, coalesce(key, FALSE) AS key, CASE WHEN key THEN {specific} ELSE ts END AS ms, list_extract(string_split(name, ' '), -1) AS last, {dept} AS dept FROM k),
l AS (SELECT *, list_transform(ms, lambda t: lower(t)) AS low, list_filter(ms, lambda t: length(t) > 80) AS lo, list_transform(list_filter(ms, lambda t: length(t) <= 80), lambda t: lower(t)) AS sh FROM m),
j AS (SELECT *, {_listed('low[1:3]')} AS three, {_listed('low[4:7]')} AS four, {_listed('low[8:10]')} AS eight, {_listed('sh[1:3]')} AS s3, {_listed('sh[4:6]')} AS s4 FROM l),
o AS (SELECT *, {long_open} AS lopen FROM j),
x AS (SELECT *, list_filter([CASE WHEN key THEN {opening} WHEN len(lo) > 0 THEN {dotted('lopen')} ELSE {short_open} END,
 CASE WHEN key AND len(ms) > 3 THEN {middle} WHEN NOT key AND len(lo) > 1 THEN {dotted('lo[2]')} WHEN NOT key AND len(lo) = 0 AND len(sh) > 3 THEN 'Work on ' || s4 || ' goes on too.' END,
 CASE WHEN key AND len(ms) > 7 THEN {extra} END], lambda q: q IS NOT NULL) AS made FROM o)
SELECT id, CASE WHEN n = 0 THEN '' ELSE array_to_string(made, ' ') || CASE WHEN len(made) >= 2 THEN ' ' || {close} ELSE '' END END AS review FROM x"""


@query(_review_sql())
def generate_review(spark, d):
    return enrichment.generate_review(_piped(spark, d)).select("id", "review")


@query(f"WITH {PROFILES} SELECT id, CASE WHEN seed_ord % 2 = 0 AND title <> 'en' THEN 'new ' || title ELSE {_REVIEW} END AS ai_review FROM p")
def apply_reviews(spark, d):
    made = bindings.profiles(spark, d).filter("seed_ord % 2 = 0").select("id", F.when(F.col("title") == "en", F.lit("")).otherwise(F.concat(F.lit("new "), F.col("title"))).alias("review"))
    return enrichment.apply_reviews(_reviewed(spark, d), made).select("id", "ai_review")


_PROMPT = "'Write an overview of this research for students, in one paragraph of four to six sentences.' || chr(10) || chr(10) || 'Name: ' || name || chr(10) || 'Department: ' || department || chr(10) || 'Research: ' || substring({}, 1, 1000)"
_COMMA = chr(39) + "{}" + chr(39)


@query(f"WITH {PROFILES} SELECT id, {_PROMPT.format(strip('replace(research_summary, ' + _COMMA.format('|') + ', ' + _COMMA.format(',') + ')'))} AS plain, {_PROMPT.format(strip('replace(research_summary, ' + _COMMA.format('|') + ', ' + _COMMA.format(', ') + ')'))} || chr(10) || 'Scholar interests: a, b' AS strict FROM p")
def review_prompt(spark, d):
    own = [F.col(c) for c in ("name", "department", "research_summary")]
    return bindings.profiles(spark, d).select("id", enrichment.review_prompt(*own).alias("plain"), enrichment.review_prompt(*own, F.array(F.lit("a"), F.lit("b"))).alias("strict"))


@query(f"SELECT doc_id, CASE WHEN length({strip('text')}) >= 50 THEN {strip('text')} END AS accepted FROM documents")
def accept_reply(spark, d):
    return bindings.read(spark, d, "documents").select("doc_id", enrichment.accept_reply(F.col("text")).alias("accepted"))


# Drafts

_ME = "'Student, a Engineering student'"
_SK = "coalesce(nullif(array_to_string(skills[1:3], ', '), ''), '{}')"


def _draft_sql(research: str, default: str) -> str:
    skills = _SK.format(default)
    return (
        "SELECT session_id, rank, 'Research opportunity: Student' AS subject, 'Dear Prof. ' || name || ',' || chr(10) || chr(10) || 'I am ' || " + _ME + " || '. Exploring research in ' || substring(interests, 1, 120) || ', I came across your work on ' || "
        + research + " || '….' || chr(10) || chr(10) || 'May I ask whether your group has openings? I have experience with ' || " + skills + " || '.' || chr(10) || chr(10) || 'Sincerely,' || chr(10) || 'Student' AS body FROM j"
    )


def _nameless(spark, d):
    return _matches(spark, d).withColumn("parsed_profile", F.col("parsed_profile").withField("name", F.lit(None).cast("string")).withField("year", F.lit(None).cast("string")).withField("major", F.lit(None).cast("string")))


@query(_JOINED + _draft_sql("rtrim(substring(research_summary, 1, 160), '.,')", "engineering tools and methods"))
def draft_emails(spark, d):
    return drafts.draft_emails(_nameless(spark, d)).select("session_id", "rank", "subject", "body")


@query(_JOINED + _draft_sql(strip("regexp_replace(substring(research_summary, 1, 160), '\\|[^\\n\\r]*$', '')"), "engineering tools"))
def draft_emails_short(spark, d):
    return drafts.draft_emails(_nameless(spark, d), tone="unknown", variant="js").select("session_id", "rank", "subject", "body")


@query(_JOINED + " SELECT session_id, rank, 'To: ' || name || chr(10) || 'Title: ' || title || chr(10) || 'Department: ' || department || chr(10) || 'Research: ' || substring(research_summary, 1, 500) || chr(10) || chr(10) || 'From: the student' || chr(10) || 'Year and major:  engineering' || chr(10) || 'Interests: ' || interests || chr(10) || 'Themes: ' || coalesce(nullif(array_to_string(themes[1:4], ', '), ''), interests) || chr(10) || 'Skills: ' || coalesce(nullif(array_to_string(skills[1:5], ', '), ''), 'various tools') || chr(10) || chr(10) || 'Tone: formal.' || chr(10) || chr(10) || 'Write the email.' AS prompt FROM j")
def draft_prompt(spark, d):
    m = _nameless(spark, d)
    seeker = {c: F.col(f"parsed_profile.{c}") for c in ("name", "year", "major", "technical_skills", "inferred_themes")}
    made = drafts.draft_prompt({c: F.col(c) for c in ("name", "title", "department", "research_summary")}, seeker, F.col("interests"))
    return m.select("session_id", "rank", made.alias("prompt"))


# Saved profiles and applications

def _saves(spark, d):
    k = F.get_json_object("props", "$.k")
    return bindings.read(spark, d, "events").filter("event_type in ('click', 'signup')").select("ts", "event_id", "user_id", k.alias("profile_id"), F.when(F.col("event_type") == "click", F.lit("toggle")).otherwise(F.lit("clear")).alias("action"))


_SAVED = """ev AS (SELECT ts, event_id, user_id, json_extract_string(props, '$.k') AS profile_id, event_type FROM events), cl AS (SELECT user_id, max((ts, event_id)) AS cleared FROM ev WHERE event_type = 'signup' GROUP BY user_id),
sv AS (SELECT user_id, profile_id FROM ev LEFT JOIN cl USING (user_id) WHERE event_type = 'click' AND (cleared IS NULL OR (ts, event_id) > cleared) GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(f"WITH {_SAVED} SELECT user_id, profile_id FROM sv")
def saved_from_events(spark, d):
    return tracking.saved_from_events(_saves(spark, d))


@query(f"WITH {_SAVED} SELECT user_id, profile_id FROM sv")
def saved_stream(spark, d):
    """The same from a stream of events that come out of order."""
    path = places.scratch(spark, "saved")
    arriving = _arriving(spark, _saves(spark, d), ["profile_id", "event_id"])
    history.saved_profiles(arriving, places.scratch(spark, "stream"), path, "60 days").awaitTermination()
    return buckets.read(spark, path).select("user_id", F.explode("profiles").alias("profile_id"))


@query(f"WITH {PROFILES}, {_SAVED} SELECT user_id, id, name FROM sv JOIN p ON id = profile_id")
def saved_profiles(spark, d):
    return tracking.saved_profiles(bindings.profiles(spark, d), tracking.saved_from_events(_saves(spark, d))).select("user_id", "id", "name")


@query(f"WITH {APPS} SELECT c_custkey, EXISTS (SELECT 1 FROM a WHERE a.\"sourceLink\" = 'https://example.org/' || c_custkey::VARCHAR AND a.\"professorName\" = c_name) AS tracked FROM customer")
def tracked_flag(spark, d):
    people = bindings.read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("https://example.org/"), F.col("c_custkey").cast("string")).alias("profile_url"))
    return tracking.tracked_flag(people, bindings.applications(spark, d)).select("c_custkey", "tracked")


def _csv(c: str) -> str:
    return f"""'"' || regexp_replace(replace(coalesce({c}::VARCHAR, ''), '"', '""'), '[\\r\\n]+', ' ', 'g') || '"'"""


@query(f"WITH {APPS} SELECT " + " || ',' || ".join(_csv(f'"{c}"') for c in lists.CSV_FIELDS) + " AS line FROM a")
def applications_csv(spark, d):
    apps = bindings.applications(spark, d)
    return tracking.applications_csv(apps)


@query(f"WITH {APPS} SELECT id, status FROM a WHERE status = 'Applied' AND (contains(lower(\"professorName\"), '12') OR contains(lower(\"labName\"), '12') OR contains(lower(department), '12') OR contains(lower(\"researchArea\"), '12') OR contains(lower(notes), '12'))")
def filter_applications(spark, d):
    return tracking.filter_applications(bindings.applications(spark, d), " 12 ", "Applied").select("id", "status")


@query(f"WITH {APPS} SELECT id, status, list_position({names(lists.STATUSES)}, status)::BIGINT AS place FROM a ORDER BY place, seed_ord")
def sort_applications(spark, d):
    """By status, as a distributed sort; tests look at the order itself."""
    place = F.array_position(F.array(*[F.lit(x) for x in lists.STATUSES]), F.col("status"))
    return tracking.sort_applications(bindings.applications(spark, d), "status").select("id", "status", place.alias("place"))


@query(f"WITH {APPS} SELECT count(*) AS total, count(*) FILTER (status IN ('Applied', 'Follow Up Sent', 'Drafting Email', 'Not Started')) AS awaiting, count(*) FILTER (status = 'Interview Scheduled') AS interview, count(*) FILTER (status = 'Accepted') AS accepted, count(*) FILTER (status = 'Rejected') AS rejected FROM a")
def status_summary(spark, d):
    return tracking.status_summary(bindings.applications(spark, d))


@query(f"WITH {APPS} SELECT count(*) AS total, count(*) FILTER (status IN ('Not Started', 'Drafting Email', 'Applied', 'Follow Up Sent')) AS in_progress, count(*) FILTER (status IN ('Interview Scheduled', 'Accepted', 'Rejected', 'Closed')) AS resolved FROM a")
def progress_summary(spark, d):
    return tracking.progress_summary(bindings.applications(spark, d))


_DAYS = f"""{APPS}, dd AS (SELECT id, date_diff('day', DATE '{bindings.AS_OF}', "followUpDate"::DATE) AS days FROM a)"""


@query(f"WITH {_DAYS} SELECT id, days::INT AS days FROM dd")
def days_until(spark, d):
    return bindings.applications(spark, d).select("id", tracking.days_until(F.col("followUpDate"), bindings.AS_OF).alias("days"))


@query(f"WITH {_DAYS} SELECT id, CASE WHEN days > 7 THEN NULL WHEN days < 0 THEN 'Overdue by ' || abs(days)::VARCHAR || 'd' WHEN days = 0 THEN 'Due today' WHEN days = 1 THEN 'Due tomorrow' ELSE 'Due in ' || days::VARCHAR || 'd' END AS label, CASE WHEN days > 7 THEN NULL WHEN days < 0 THEN 3 WHEN days <= 1 THEN 2 ELSE 1 END AS severity, days <= 3 AS shown FROM dd")
def follow_up_label(spark, d):
    days = tracking.days_until(F.col("followUpDate"), bindings.AS_OF)
    return bindings.applications(spark, d).select("id", tracking.follow_up_label(days).alias("label"), tracking.follow_up_severity(days).alias("severity"), tracking.shows_reminder(days).alias("shown"))


@query(f"WITH {APPS} SELECT id, strftime(\"lastUpdated\", '%b %-d, %Y') AS shown FROM a")
def format_date(spark, d):
    return bindings.applications(spark, d).select("id", tracking.format_date(F.col("lastUpdated")).alias("shown"))


@query(f"""WITH {APPS}, ss AS (SELECT id, "lastUpdated" AS ts, epoch(TIMESTAMP '{bindings.AS_OF} 12:00:30') - epoch("lastUpdated") AS s FROM a)
SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN floor(s / 60)::BIGINT::VARCHAR || 'm ago' WHEN s < 86400 THEN floor(s / 3600)::BIGINT::VARCHAR || 'h ago' WHEN s < 604800 THEN floor(s / 86400)::BIGINT::VARCHAR || 'd ago' WHEN s < 2592000 THEN floor(s / 604800)::BIGINT::VARCHAR || 'w ago' ELSE strftime(ts, '%b %-d, %Y') END AS ago FROM ss""")
def relative_time(spark, d):
    return bindings.applications(spark, d).select("id", tracking.relative_time(F.col("lastUpdated"), f"{bindings.AS_OF} 12:00:30").alias("ago"))
