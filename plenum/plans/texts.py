"""Rules, identities, search and text structure (survey 2.9, 2.10, 2.13, 2.15) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import identity, rules, text
from plenum.operators import alerts, documents, search, textindex
from plenum.plans.base import query
from plenum.sources.commits import shared_folder
from plenum.sources.tables import table, tables

# Titles of our own, dealt to events by id: the driver tables hold no agenda.
TITLES = [
    "Roll Call and Invocation", "Approval of the Minutes", "Ordinance 2025-11 amending the zoning map for parcel 7", "Proclamation for Arbor Day",
    "Proclamations of a local emergency", "Appointment to the Library Board", "Liquor license for 12 Main Street", "Resolution to purchase a fire engine",
    "Adjournment", "Telecommunications franchise agreement", "Communications", "Recession outlook report", "Staff report", "12/31/2024", "R12345 7", "OK", "Staff Report.pdf", "- Cover Page", "Budget memo.DOCX ", "Cover page of the annual plan",
    "FIRST READING: Ordinance adopting the consolidated fee schedule for 2026", "Parcel list and tax parcel map", "Draft EIR for the harbour tunnel", "Notice of Public Hearing",
]


def titled(events):
    names = F.array(*[F.lit(t) for t in TITLES])
    return events.select("event_id", F.element_at(names, (F.col("event_id") % len(TITLES) + 1).cast("int")).alias("title"))


TITLE_SQL = f"SELECT event_id, [{', '.join(chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39) for t in TITLES)}][CAST(event_id % {len(TITLES)} AS INTEGER) + 1] AS title FROM events"


def re2(pattern: str) -> str:
    """Test in DuckDB's dialect, which has no look ahead: "not followed by" becomes a second test."""
    quoted = lambda p: "'" + ("(?i)" + p).replace("'", "''") + "'"
    if "(?!" in pattern:
        head, tail = pattern.split("(?!")
        return f"(regexp_matches(title, {quoted(head)}) AND NOT regexp_matches(title, {quoted(head + tail[:-1])}))"
    return f"regexp_matches(title, {quoted(pattern)})"


def case_of(families, column: str) -> str:
    tests = " ".join(f"WHEN {re2(r.pattern)} THEN '{getattr(r, column)}'" for r in rules.rule_list(families))
    return f"CASE {tests} END"


@query("rule_table_filter", f"SELECT event_id, {case_of(rules.ITEM_FAMILIES, 'reason')} AS reason, {case_of(rules.ITEM_FAMILIES, 'rule_id')} AS rule_id FROM ({TITLE_SQL})")
def rule_table_filter(spark, sf_dir):
    rows = titled(table(spark, sf_dir, "events")).withColumn("d", rules.item_filter(F.col("title")))
    return rows.select("event_id", "d.reason", "d.rule_id")


@query("attachment_filter", f"SELECT event_id, {case_of(rules.ATTACHMENT_FAMILIES, 'reason')} AS reason FROM ({TITLE_SQL})")
def attachment_filter(spark, sf_dir):
    return titled(table(spark, sf_dir, "events")).select("event_id", rules.attachment_filter(F.col("title"))["reason"].alias("reason"))


@query(
    "garbage_classifier",
    f"""SELECT event_id, CASE
      WHEN regexp_matches(lower(trim(title)), '[.](pdf|doc|docx|ppt|pptx|xls|xlsx)$') THEN 'filename'
      WHEN ltrim(lower(trim(title)), '-– ') IN ('cover page', 'coverpage') THEN 'cover_page'
      WHEN ltrim(lower(trim(title)), '-– ') IN ('agenda', 'attachment', 'staff report', 'staffreport', 'item', 'memo', 'memorandum', 'exhibit') THEN 'generic_label'
      WHEN translate(trim(title), '0123456789 .,()$/:–-', '') = '' AND trim(title) <> '' THEN 'numeric_or_date'
      WHEN regexp_full_match(upper(trim(title)), '[A-Z][0-9]{{5,}} +[0-9]+') THEN 'register_code'
      WHEN length(trim(title)) <= 2 THEN 'empty_or_tiny' END AS label
    FROM ({TITLE_SQL})""",
)
def garbage_classifier(spark, sf_dir):
    return titled(table(spark, sf_dir, "events")).select("event_id", rules.garbage_title(F.col("title")).alias("label"))


@query("filter_transitions", f"SELECT old, new, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(title, '(?i)minutes|adjourn|proclamation') THEN 'skip' END AS old, {case_of(rules.ITEM_FAMILIES, 'reason')} AS new FROM ({TITLE_SQL})) GROUP BY 1, 2")
def filter_transitions(spark, sf_dir):
    """Verdicts of an older rule against today's."""
    old = F.when(F.col("title").rlike("(?i)minutes|adjourn|proclamation"), "skip").alias("old")
    return titled(table(spark, sf_dir, "events")).select(old, rules.item_filter(F.col("title"))["reason"].alias("new")).groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


@query(
    "summary_quality",
    "SELECT doc_id, CASE WHEN length(s) < 100 THEN 'too_short' WHEN s LIKE '%...' THEN 'truncated' WHEN contains(s, '**') OR contains(s, '##') THEN 'good' ELSE 'suspicious' END AS quality FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN '...' WHEN 1 THEN '**' ELSE '' END AS s FROM documents)",
)
def summary_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 5 == 0, "...").when(F.col("doc_id") % 5 == 1, "**").otherwise("")
    summary = F.concat("text", tail)
    return docs.select("doc_id", text.summary_quality(summary)["quality"].alias("quality"))


@query(
    "garbled_padding",
    "SELECT doc_id, length(trim(s)) >= 200 AND solid > 0 AND (ascii + digits) / solid < 0.2 AND (letters + digits) / solid < 0.35 AND (letters - ascii) / greatest(letters, 1) >= 0.35 AS garbled, length(s) > 2000 AND (length(s) - length(replace(s, ' ', ''))) / length(s) > 0.85 AS padded FROM (SELECT doc_id, s, length(regexp_replace(s, '[^A-Za-z]', '', 'g')) AS ascii, length(regexp_replace(s, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(s, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(s, '\\s', '', 'g')) AS solid FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_replace(text, '[a-z]', '§', 'g') WHEN 1 THEN repeat(' ', CAST(2500 + 8 * length(text) AS INTEGER)) || text ELSE text END AS s FROM documents))",
)
def garbled_padding(spark, sf_dir):
    marred = F.regexp_replace("text", "[a-z]", "§")
    sample = F.when(F.col("doc_id") % 3 == 0, marred).when(F.col("doc_id") % 3 == 1, F.concat(F.repeat(F.lit(" "), 2500 + 8 * F.length("text")), "text")).otherwise(F.col("text"))
    # the last test of padding, one line over 2000 characters, holds for the padded third
    return table(spark, sf_dir, "documents").select("doc_id", text.garbled(sample).alias("garbled"), text.padded_layout(sample).alias("padded"))


@query(
    "contact_extraction",
    f"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '{text.EMAIL}'))) AS BIGINT) AS emails, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '\\(?\\b\\d{{3}}\\)?[-. ]\\d{{3}}[-. ]\\d{{4}}\\b'), lambda p: regexp_replace(p, '\\D', '', 'g')))) AS BIGINT) AS phones FROM documents",
)
def contact_extraction(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", text.contacts(F.col("text")).alias("c"))
    return found.select("doc_id", F.size("c.emails").cast("long").alias("emails"), F.size("c.phones").cast("long").alias("phones"))


@query(
    "keyword_alerts",
    "WITH a AS (SELECT item_id AS alert_id, [x FOR x IN list_distinct(string_split(lower(text), ' ')) IF regexp_full_match(x, '[a-z]{6,}')] AS k FROM benchmark), k AS (SELECT alert_id, unnest(k) AS keyword FROM a), d AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'))) AS keyword FROM documents) SELECT alert_id, doc_id, count(*) AS n FROM k JOIN d USING (keyword) GROUP BY 1, 2",
)
def keyword_alerts(spark, sf_dir):
    """Alerts made of the long words of benchmark passages, against all documents."""
    benchmark, docs = tables(spark, sf_dir, "benchmark", "documents")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " ", -1), lambda w: w.rlike("^[a-z]{6,}$")))
    wanted = benchmark.select(F.col("item_id").alias("alert_id"), F.explode(words).alias("keyword"))
    found = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+", -1))).alias("keyword")).join(wanted, "keyword")
    return found.groupBy("alert_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "first_keyword_alerts",
    "WITH a AS (SELECT item_id AS alert_id, [x FOR x IN string_split(lower(text), ' ') IF regexp_full_match(x, '[a-z]{6,}')] AS k FROM benchmark), k AS (SELECT alert_id, unnest(k) AS keyword, unnest(range(len(k))) AS place FROM a), f AS (SELECT alert_id, keyword, min(place) AS place FROM k GROUP BY 1, 2), d AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'))) AS keyword FROM documents) SELECT alert_id, doc_id, arg_min(keyword, place) AS keyword FROM f JOIN d USING (keyword) GROUP BY 1, 2",
)
def first_keyword_alerts(spark, sf_dir):
    benchmark, docs = tables(spark, sf_dir, "benchmark", "documents")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " ", -1), lambda w: w.rlike("^[a-z]{6,}$")))
    alerts = benchmark.select(F.col("item_id").alias("alert_id"), words.alias("keywords"))
    return search.keyword_alerts(alerts, docs, "doc_id", "text")


# Alerts are made of runs of four words at every seventh word of the benchmark passages, and of the same without their outer characters.
PHRASES_SQL = """s AS (SELECT list_sort(list(DISTINCT source)) AS sources FROM documents WHERE source IS NOT NULL),
    p AS (SELECT item_id AS alert_id, string_split(text, ' ') AS w FROM benchmark),
    q AS (SELECT alert_id, flatten(list_transform(range(0, len(w) - 3, 7), lambda i: [array_to_string(w[i + 1:i + 4], ' '), array_to_string(w[i + 1:i + 4], ' ')[2:-2]])) AS k FROM p),
    k AS (SELECT alert_id, unnest(k) AS phrase, unnest(range(len(k))) AS place FROM q),
    c AS (SELECT alert_id, unnest(list_filter(sources, lambda x: (length(x) + ascii(right(x, 1)) + alert_id) % 3 <> 0)) AS banana FROM (SELECT DISTINCT alert_id FROM q) CROSS JOIN s)"""


def dual_track_frames(spark, sf_dir):
    """Documents as items, each number modulo 211 a matter whose text is that of its first document."""
    benchmark, docs = tables(spark, sf_dir, "benchmark", "documents")
    sources = docs.where("source is not null").agg(F.array_sort(F.collect_set("source")).alias("sources"))  # one row
    w = F.split("text", " ", -1)
    run = lambda i: F.array_join(F.slice(w, i + 1, 4), " ")
    starts = F.when(F.size(w) > 3, F.sequence(F.lit(0), F.size(w) - 4, F.lit(7))).otherwise(F.array().cast("array<int>"))
    keywords = F.flatten(F.transform(starts, lambda i: F.array(run(i), F.substr(run(i), F.lit(2), F.length(run(i)) - 2))))
    mine = F.filter("sources", lambda x: (F.length(x) + F.ascii(F.right(x, F.lit(1))) + F.col("item_id")) % 3 != 0)
    alerts = benchmark.crossJoin(F.broadcast(sources)).select(F.col("item_id").alias("alert_id"), mine.alias("cities"), keywords.alias("keywords"), F.lit(True).alias("active"))
    day = F.lit("2025-01-01").cast("date")
    items = docs.select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 17).alias("meeting_id"), F.col("source").alias("banana"), day.alias("date"), F.when(F.col("doc_id") % 19 == 0, "Cancelled").alias("status"), F.lit(None).cast("string").alias("title"), F.col("text").alias("summary"))
    appearances = docs.select((F.col("doc_id") % 211).alias("matter_id"), F.col("doc_id").alias("item_id"), (F.col("doc_id") % 17).alias("meeting_id"), day.alias("date"), F.lit("heard").alias("action"))
    matters = docs.groupBy((F.col("doc_id") % 211).alias("matter_id")).agg(F.min_by(F.struct("source", "text"), "doc_id").alias("d")).select("matter_id", F.col("d.source").alias("banana"), F.lit(None).cast("string").alias("title"), F.col("d.text").alias("summary"), day.alias("last_seen"))
    return alerts, items, matters, appearances


@query(
    "dual_track_alerts",
    f"""WITH {PHRASES_SQL},
    m AS (SELECT doc_id % 211 AS matter_id, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM documents GROUP BY 1),
    t AS (SELECT 'keyword' AS match_type, doc_id AS id, doc_id AS item_id, source AS banana, text, CAST(NULL AS INTEGER) AS n_steps FROM documents WHERE doc_id % 19 <> 0
      UNION ALL SELECT 'matter', matter_id, last, source, text, CAST(n AS INTEGER) FROM m JOIN documents ON doc_id = first)
    SELECT alert_id, match_type, id, arg_min(phrase, place) AS keyword, any_value(item_id) AS item_id, any_value(item_id) % 17 AS meeting_id, any_value(n_steps) AS n_steps
    FROM t JOIN c USING (banana) JOIN k USING (alert_id) WHERE phrase <> '' AND contains(text, phrase) GROUP BY alert_id, match_type, id""",
)
def dual_track_alerts(spark, sf_dir):
    """Alerts on items and on matters at once, whole texts against all phrases."""
    return alerts.match_both(*dual_track_frames(spark, sf_dir), since=F.lit("2024-12-31").cast("date"))


@query("fulltext_match", "SELECT doc_id, source FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['ing', 'of', 'the']) OR source ILIKE '%src1_%'".replace("['ing', 'of', 'the']", "['ing', 'thin']"))
def fulltext_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hit = search.contains_all(F.col("text"), search.query_terms("of ing the thin")) | F.col("source").ilike("%src1_%")
    return docs.where(hit).select("doc_id", "source")


def stem_sql(word: str) -> str:
    """The light stemmer of :mod:`plenum.operators.search` in SQL: the first suffix that leaves three characters goes."""
    tests = [f"WHEN {word} LIKE '%{s}' AND length({word}) >= {len(s) + 3}{f' AND {word} NOT LIKE {chr(39)}%ss{chr(39)}' if s == 's' else ''} THEN left({word}, length({word}) - {len(s)}) || '{put}'" for s, put in search.SUFFIXES]
    return f"CASE {' '.join(tests)} ELSE {word} END"


def ranked_sql(query_text: str, limit: int) -> str:
    wanted = textindex.stems(query_text)
    names = ", ".join(f"'{t}'" for t in wanted)
    stops = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
    last = [f"max(CASE WHEN term = '{t}' THEN pos END) OVER so_far" for t in wanted]
    start = f"least({', '.join(last)})" if len(last) > 1 else last[0]
    whole = " AND ".join(f"{x} IS NOT NULL" for x in last)
    return f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
    p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
    t AS (SELECT doc_id, n, pos, {stem_sql("word")} AS term FROM p WHERE word NOT IN ({stops})),
    s AS (SELECT doc_id, n, pos, CASE WHEN {whole} THEN {start} END AS start FROM t WHERE term IN ({names})
      WINDOW so_far AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    c AS (SELECT *, lag(start) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM s)
    SELECT doc_id, round(sum({len(wanted)} / (pos - start + 1)) / (1 + ln(any_value(n))), 6) AS score FROM c
    WHERE start IS NOT NULL AND (before IS NULL OR start > before) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {limit}"""


def document_index(spark, docs) -> textindex.TextIndex:
    """All documents in a stored index, in two segments: a later one replaces documents of the first."""
    index = textindex.TextIndex(spark, shared_folder(spark, "text-index"))
    index.add(docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, "an older version").otherwise(F.col("text"))), "doc_id", "text")
    index.add(docs.where("doc_id % 5 = 0"), "doc_id", "text")
    return index


@query("fulltext_ranked", ranked_sql("thin of the tion", 50))
def fulltext_ranked(spark, sf_dir):
    """The best page of a search of a stored index: every term, ranked by cover density."""
    docs = table(spark, sf_dir, "documents")
    page = document_index(spark, docs).ranked("thin of the tion").withColumn("score", F.round("score", 6))
    return page.orderBy(F.desc("score"), "id").limit(50).select(F.col("id").alias("doc_id"), "score")


@query("fulltext_fragments")
def fulltext_fragments(spark, sf_dir):
    """The same page with the densest passage of each document, its hits marked."""
    docs = table(spark, sf_dir, "documents")
    found = textindex.search(document_index(spark, docs), docs, "doc_id", "text", "thin of the tion", 50)
    return found.select("doc_id", F.round("score", 6).alias("score"), "fragment")


@query("context_snippet")
def context_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.context(F.col("text"), "thin").alias("snippet")).where("snippet is not null")


SYNONYMS = {"steel": "metal", "brass": "metal", "tin": "metal", "copper": "metal", "nickel": "metal", "economy": "budget", "promo": "outreach", "standard": "standard"}


@query(
    "topic_normalize",
    "WITH s AS (SELECT unnest(['steel', 'brass', 'tin', 'copper', 'nickel', 'economy', 'promo', 'standard']) AS w, unnest(['metal', 'metal', 'metal', 'metal', 'metal', 'budget', 'outreach', 'standard']) AS t) SELECT p_partkey, string_agg(DISTINCT coalesce(t, word), ',' ORDER BY coalesce(t, word)) AS topics FROM (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS word FROM part) LEFT JOIN s ON s.w = word GROUP BY 1",
)
def topic_normalize(spark, sf_dir):
    known = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    words = F.transform(F.split(F.lower("p_type"), " ", -1), lambda w: F.coalesce(F.try_element_at(known, w), w))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(words)), ",").alias("topics"))


@query(
    "matter_ids",
    "SELECT p_partkey, 'x_' || substr(sha256('x:file:' || p_brand || CASE WHEN p_size % 2 = 0 THEN ':year:' || p_size ELSE '' END), 1, 16) AS matter_id, 'x_' || substr(md5('x:' || p_partkey || ':undated:' || p_name), 1, 8) AS meeting_id, 'm_seq' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '_' || substr(sha256('m:seq:' || p_size), 1, 8) AS item_id FROM part",
)
def matter_ids(spark, sf_dir):
    x, none = F.lit("x"), F.lit(None).cast("string")
    size = F.col("p_size").cast("string")
    matter = identity.matter_id(x, F.col("p_brand"), F.lit("ignored"), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, size))
    meeting = identity.meeting_id(x, F.col("p_partkey").cast("string"), F.lit(None).cast("timestamp"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", matter.alias("matter_id"), meeting.alias("meeting_id"), identity.item_id(F.lit("m"), F.col("p_size"), none).alias("item_id"))


@query(
    "url_identity",
    "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN regexp_matches(coalesce(regexp_extract(url, '\\?([^#]*)', 1), ''), '(?i)(?:^|&)(?:x-amz-signature|x-amz-credential|signature|sig|expires|token|awsaccesskeyid)=') THEN regexp_replace(url, '[?#].*$', '') ELSE url END AS identity, regexp_replace(url, '[?#].*$', '') AS bare FROM pages",
)
def url_identity(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    bare = F.element_at(identity.source_identities(F.col("url")), -1)
    return pages.select("page_id", F.parse_url(F.col("url"), F.lit("HOST")).alias("host"), identity.attachment_identity(F.col("url")).alias("identity"), bare.alias("bare"))


@query(
    "content_address_dedup",
    "SELECT sha256(text) AS sha, min(doc_id) AS first_doc, count(*) AS sightings, CAST(max(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY 1",
)
def content_address_dedup(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n_bytes"))
    return hashed.groupBy("sha").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("sightings"), F.max("n_bytes").cast("long").alias("n_bytes"))


@query("html_text")
def html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    clean = pages.select("page_id", documents.sanitize_html("html").alias("text"), documents.document_links(F.col("html")).alias("links"))
    return clean.select("page_id", "text", F.size("links").alias("n_links"))


@query(
    "html_links",
    "SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=\"([^\"]+)\"', 1))) AS BIGINT) AS links FROM pages",
)
def html_links(spark, sf_dir):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*\bhref="([^"]+)"')))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("links"))


@query(
    "rule_precision_recall",
    "WITH p AS (SELECT d.doc_id, length(text) - length(translate(text, '#$%&!|', '')) > 30 AS said, quality = 0 AS truth FROM documents d JOIN labels USING (doc_id)) SELECT count(*) FILTER (WHERE said AND truth) AS hits, count(*) FILTER (WHERE said) AS said, count(*) FILTER (WHERE truth) AS true_, count(*) FILTER (WHERE said AND truth) / greatest(count(*) FILTER (WHERE said), 1) AS precision, count(*) FILTER (WHERE said AND truth) / greatest(count(*) FILTER (WHERE truth), 1) AS recall FROM p",
)
def rule_precision_recall(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    said = F.length("text") - F.length(F.translate("text", "#$%&!|", "")) > 30
    rows = docs.join(labels, "doc_id").select(said.alias("s"), (F.col("quality") == 0).alias("t"))
    counts = rows.agg(F.count_if(F.col("s") & F.col("t")).alias("hits"), F.count_if("s").alias("said"), F.count_if("t").alias("true_"))
    return counts.withColumn("precision", F.col("hits") / F.greatest("said", F.lit(1))).withColumn("recall", F.col("hits") / F.greatest("true_", F.lit(1)))


@query("repeated_lines", "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE line <> '' GROUP BY 1, 2 HAVING count(*) >= 3")
def repeated_lines(spark, sf_dir):
    return documents.repeated_lines(table(spark, sf_dir, "documents"), "doc_id", "text", least=3)


@query("flat_text_split")
def flat_text_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    numbered = docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n").alias("text"))
    return numbered.select("doc_id", F.explode(documents.split_agenda("text")).alias("i")).select("doc_id", "i.number", "i.title")


@query("text_scalars", "SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[^A-Za-z0-9 ]', '', 'g'))) AS key, sha256(text) AS sha, split_part(source, 'c', 2) AS part FROM documents")
def text_scalars(spark, sf_dir):
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace("text", r"\s+", " "), "[^A-Za-z0-9 ]", "")))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), F.sha2("text", 256).alias("sha"), F.split_part("source", F.lit("c"), F.lit(2)).alias("part"))


@query("vote_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'not_voting' END AS vote FROM orders")
def vote_values(spark, sf_dir):
    word = F.when(F.col("o_orderstatus") == "F", " AYE").when(F.col("o_orderstatus") == "O", "Nay ").otherwise("??")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.vote_value(word).alias("vote"))


@query("people_names")
def people_names(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Council Member "), "c_name", F.lit(", Mayor Pro Tem José Núñez Jr. and Dr. Li")).alias("blob"))
    split = names.select("c_custkey", F.explode(text.split_names("blob")).alias("name"))
    return split.select("c_custkey", "name", text.fold("name").alias("folded"), text.looks_like_name(F.col("name")).alias("plausible"))


@query("compact_text")
def compact_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    small = docs.select("doc_id", F.length("text").alias("before"), text.dictionary_encode(text.compact_runs("text")).alias("t"))
    return small.select("doc_id", "before", F.length("t").alias("after"))
