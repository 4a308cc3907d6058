"""DuckDB SQL equivalents of the registered queries.

Written against the same given tables; see ``oracle_views`` for the news model.
"""

from __future__ import annotations

from pressgrid import constants as C
from pressgrid.plans.oracle_views import with_views

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
WS = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"
STOPS = ", ".join(f"'{w}'" for w in C.STOP_WORDS)


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g')"


def blank_null(col: str) -> str:
    return f"nullif({strip(col)}, '')"


def fold(col: str) -> str:
    marks = "||".join(f"chr({ord(c)})" for c in C.FOLD_FROM)
    plain = C.FOLD_TO.replace("'", "''")
    return f"lower({strip(f'''regexp_replace(replace(translate(coalesce({col}, ''), {marks}, '{plain}'), chr(8230), '...'), '{WS}+', ' ', 'g')''')})"


def stem(w: str) -> str:
    return (
        f"CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN regexp_replace({w}, 'ies$', 'y') "
        f"WHEN length({w}) > 5 AND {w} LIKE '%ing' THEN regexp_replace({w}, 'ing$', '') "
        f"WHEN length({w}) > 4 AND {w} LIKE '%ed' THEN regexp_replace({w}, 'ed$', '') "
        f"WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN regexp_replace({w}, 's$', '') ELSE {w} END"
    )


def unescape(col: str) -> str:
    out = col
    for name, char in (
        ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&copy;", "'©'"),
        ("&middot;", "'·'"), ("&ndash;", "'–'"), ("&mdash;", "'—'"), ("&lsquo;", "'‘'"), ("&rsquo;", "'’'"),
        ("&ldquo;", "'“'"), ("&rdquo;", "'”'"), ("&hellip;", "'…'"), ("&amp;", "'&'"),
    ):
        out = f"replace({out}, '{name}', {char})"
    return out


def main_text(html: str) -> str:
    """Chain of the page text rule over a column, as nested selects."""
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "nav", "table", "aside", "footer", "header", "form"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', chr(10), 'g')"
    return out


BLOCK = r"(?is)</?(?:p|br|h[1-6]|li|ul|ol|div|section|blockquote|article|figure|figcaption)(?:[ \t\r\n/][^>]*)?>"


def page_text(source: str, key: str) -> str:
    return rf"""
    SELECT {key}, nullif(array_to_string(list_filter(list_transform(string_split({unescape("bare")}, chr(10)),
               lambda l: {strip(f"regexp_replace(l, '{WS}+', ' ', 'g')")}), lambda l: l <> ''), chr(10)), '') AS main_text
    FROM (SELECT {key}, regexp_replace(regexp_replace(region, '{BLOCK}', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS bare
          FROM (SELECT {key}, coalesce(nullif(regexp_extract(x, '(?is)<article\b[^>]*>(.*)</article\s*>', 1), ''),
                                       nullif(regexp_extract(x, '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)', 1), ''), x) AS region
                FROM (SELECT {key}, {main_text("html")} AS x FROM {source})))"""


DOC = "(SELECT *, CAST(substr(source, 4) AS BIGINT) AS sno, 'https://' || source || '.example' AS site FROM documents)"
SQL: dict[str, str] = {}

# --- sources and upserts ---------------------------------------------------------

TITLE = r"regexp_replace(split_part(text, chr(10), 1), '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g')"
PUBLISHED = "TIMESTAMP '2024-01-01' + CAST((doc_id * 7919) % 43200 AS INTEGER) * INTERVAL 1 MINUTE"
USABLE = f"sno % 7 <> 6 AND doc_id % 43 <> 0 AND doc_id % 37 <> 0 AND doc_id % 41 <> 0 AND {blank_null(TITLE)} IS NOT NULL"
SQL["feed_entries"] = f"""
SELECT source AS outlet_slug, site || '/' || doc_id AS url, substr({blank_null(TITLE)}, 1, 1000) AS headline,
       CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'author_' || (doc_id % 17) END AS author, {ts(PUBLISHED)} AS published_at
FROM {DOC} WHERE {USABLE}"""
SQL["feed_image_url"] = f"""
SELECT source AS outlet_slug, site || '/' || doc_id AS url,
       CASE doc_id % 8 WHEN 0 THEN 'https://img.example/' || doc_id || '.jpg' WHEN 1 THEN site || '/img/' || doc_id || '.PNG?x=1'
            WHEN 2 THEN 'https://img.example/t' || doc_id || '.jpg' WHEN 3 THEN 'https://img.example/e' || doc_id
            WHEN 5 THEN 'https://img.example/i' || doc_id || '.jpg' WHEN 6 THEN site || '/inline' || doc_id || '.jpg' END AS image_url
FROM {DOC} WHERE {USABLE}"""
SQL["feed_health"] = rf"""
WITH items AS (
    SELECT source, sno, doc_id // 400 AS batch, doc_id, {blank_null(TITLE)} AS title,
           '<item><title>' || CASE WHEN doc_id % 43 = 0 THEN ' ' ELSE replace(replace(replace({TITLE}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END || '</title>'
           || CASE WHEN doc_id % 37 = 0 THEN '' WHEN doc_id % 6 = 1 THEN '<guid>https://' || source || '.example/' || doc_id || '</guid>'
                   ELSE '<link> https://' || source || '.example/' || doc_id || '</link>' END
           || CASE WHEN doc_id % 41 = 0 THEN '<pubDate>soon</pubDate>'
                   ELSE '<pubDate>' || strftime({PUBLISHED}, '%a, %d %b %Y %H:%M:%S') || CASE WHEN doc_id % 10 = 1 THEN '' ELSE ' +0000' END || '</pubDate>' END
           || CASE WHEN doc_id % 4 = 0 THEN '<author> </author>' WHEN doc_id % 3 = 0 THEN '<dc:creator>author_' || (doc_id % 17) || '</dc:creator>'
                   ELSE '<author>author_' || (doc_id % 17) || '</author>' END
           || CASE doc_id % 8
                WHEN 0 THEN '<media:content medium="image" url="https://img.example/' || doc_id || '.jpg"/>'
                WHEN 1 THEN '<media:content url="/img/' || doc_id || '.PNG?x=1"/><media:content url="/clip/' || doc_id || '.mp4"/>'
                WHEN 2 THEN '<media:content medium="video" url="https://v.example/' || doc_id || '.mp4"/><media:thumbnail url="https://img.example/t' || doc_id || '.jpg"/>'
                WHEN 3 THEN '<enclosure type="image/jpeg" url="https://img.example/e' || doc_id || '"/>'
                WHEN 4 THEN '<enclosure type="audio/mpeg" url="https://a.example/' || doc_id || '.mp3"/><link2/>'
                WHEN 5 THEN '<description>&lt;p&gt;x&lt;img alt="a" src="https://img.example/i' || doc_id || '.jpg"&gt;</description>'
                WHEN 6 THEN '<image>https://img.example/pixel' || doc_id || '.gif</image><description>&lt;img src=''inline' || doc_id || '.jpg''&gt;</description>'
                ELSE '' END || '</item>' AS item
    FROM {DOC})
SELECT source AS outlet_slug, {ts("TIMESTAMP '2024-01-01' + CAST(7200 * batch AS INTEGER) * INTERVAL 1 SECOND")} AS fetched_at,
       CAST(CASE WHEN sno % 7 = 6 THEN 404 ELSE 200 END AS BIGINT) AS http_status,
       CAST(sum(strlen(item)) + strlen('<rss xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel></channel></rss>') AS BIGINT) AS bytes,
       count(*) AS item_count, nullif(arg_min(CASE WHEN doc_id % 43 = 0 THEN '' ELSE coalesce(title, '') END, doc_id), '') AS first_headline,
       sno % 7 <> 6 AS usable
FROM items GROUP BY source, sno, batch"""
SQL["discover_new_urls"] = """
WITH offered AS (SELECT url, article_id, headline, outlet_id FROM n_articles
                 UNION ALL SELECT 'https://wire.example/' || (article_id // 3), article_id, headline, outlet_id FROM n_articles)
SELECT url, arg_min(article_id, article_id) AS article_id, arg_min(headline, article_id) AS headline, arg_min(outlet_id, article_id) AS outlet_id,
       'discovered' AS processing_state, CAST(0 AS BIGINT) AS attempt_count
FROM offered WHERE url NOT IN (SELECT url FROM n_articles WHERE processing_state <> 'discovered') GROUP BY url"""
PLAN = """
WITH specs AS (SELECT CASE WHEN outlet_id % 4 = 3 THEN 'new-' || slug ELSE slug END AS slug,
                      CASE WHEN outlet_id % 3 = 1 THEN name || ' News' ELSE name END AS name, rss_url, website
               FROM n_outlets),
plan AS (SELECT s.slug, o.outlet_id, s.name, s.rss_url, s.website, true AS active,
                CASE WHEN o.outlet_id IS NULL THEN 'insert' WHEN s.name = o.name AND s.rss_url = o.rss_url AND s.website = o.website AND o.active
                     THEN 'unchanged' ELSE 'update' END AS action
         FROM specs s LEFT JOIN n_outlets o ON s.slug = o.slug)"""
SQL["outlets_upsert_plan"] = PLAN + " SELECT * FROM plan"
SQL["outlets_upsert_counts"] = PLAN + " SELECT action, count(*) AS n FROM plan GROUP BY action"
RATING_PLAN = """
WITH records AS (
    SELECT CASE WHEN outlet_id % 7 = 6 THEN 'gone-' || slug ELSE slug END AS outlet_slug,
           CASE WHEN outlet_id % 2 = 0 THEN 'MBFC' ELSE 'AdFontes' END AS source,
           CASE WHEN outlet_id % 9 = 8 THEN 'Mostly Odd' WHEN outlet_id % 2 = 0 THEN ['Left-Center', 'Least Biased', 'Right-Center'][outlet_id % 3 + 1]
                ELSE ' Skews Right ' END AS original_label,
           CASE WHEN outlet_id % 9 = 8 THEN NULL WHEN outlet_id % 2 = 0 THEN ['left', 'center', 'right'][outlet_id % 3 + 1] ELSE 'right' END AS category,
           CASE WHEN outlet_id % 4 = 0 THEN 'https://ratings.example/' || slug ELSE 'https://ratings.example/moved' END AS rating_url,
           TIMESTAMP '2024-01-01' - CAST(outlet_id AS INTEGER) * INTERVAL 1 DAY AS rated_at
    FROM n_outlets),
plan AS (
    SELECT r.outlet_slug, o.outlet_id, r.source, r.original_label, r.category, r.rating_url, r.rated_at,
           CASE WHEN o.outlet_id IS NULL THEN 'skipped_no_outlet' WHEN r.category IS NULL THEN 'skipped_unmappable'
                WHEN x.outlet_id IS NULL THEN 'inserted'
                WHEN r.original_label = x.original_label AND r.category IS NOT DISTINCT FROM x.normalized_category
                     AND r.rating_url = x.rating_url AND r.rated_at IS NOT DISTINCT FROM x.rated_at THEN 'unchanged' ELSE 'updated' END AS action
    FROM records r LEFT JOIN n_outlets o ON o.slug = r.outlet_slug
    LEFT JOIN n_ratings x ON x.outlet_id = o.outlet_id AND x.source = r.source)"""
SQL["bias_ratings_upsert_plan"] = RATING_PLAN + f" SELECT * REPLACE ({ts('rated_at')} AS rated_at) FROM plan"
SQL["bias_ratings_upsert_counts"] = RATING_PLAN + " SELECT action, count(*) AS n FROM plan GROUP BY action"
SQL["latest_wins_upsert"] = """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id"""
SQL["article_main_text"] = page_text("pages", "page_id, url")
SQL["article_main_text_articles"] = page_text(
    """(SELECT doc_id AS page_id, '<body><nav>menu</nav><article>'
        || CASE WHEN doc_id % 6 = 0 THEN '<p>été → &noname; &amp;eacute;</p>' ELSE '' END || '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
        || '</p></article></body>' AS html FROM documents)""", "page_id")
SQL["image_url_clean"] = f"""
SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'https://img.example/' || doc_id || '.jpg' WHEN 1 THEN 'https://cdn.example/' || doc_id || '.png'
       WHEN 2 THEN site || '/a/' || doc_id || '.gif' WHEN 4 THEN site || '/news/pic-' || doc_id || '.avif'
       WHEN 8 THEN 'https://img.example/' || doc_id || '.jpg?width=64&height=640' END AS clean_url
FROM {DOC}"""
PAGE_IMAGE = """CASE doc_id % 10 WHEN 0 THEN 'https://img.example/' || doc_id || '.jpg?a=1&b=2' WHEN 1 THEN site || '/pics/' || doc_id || '.png'
       WHEN 2 THEN 'https://cdn.example/' || doc_id || '.webp' WHEN 3 THEN site || '/t/' || doc_id || '.gif'
       WHEN 5 THEN 'https://img.example/' || doc_id || '?width=1200&height=10' WHEN 8 THEN site || '/news/pic' || doc_id || '.jpg' END"""
SQL["page_image_url"] = f"SELECT doc_id AS page_id, site || '/news/' || doc_id AS url, {PAGE_IMAGE} AS image_url FROM {DOC}"
SQL["page_image_url_given"] = "SELECT page_id, url, CAST(NULL AS VARCHAR) AS image_url FROM pages"
BACKFILL = f"""
WITH batch AS (SELECT article_id FROM n_articles WHERE image_url IS NULL ORDER BY published_at, article_id LIMIT 100),
filled AS (SELECT b.article_id, CASE WHEN doc_id % 25 <> 24 AND doc_id % 17 <> 3 THEN {PAGE_IMAGE} END AS image_url, doc_id % 25 = 24 AS lost,
                  doc_id % 17 = 3 AS unreadable
           FROM batch b JOIN {DOC} d ON d.doc_id = b.article_id),
result AS (SELECT article_id, image_url, CASE WHEN lost THEN 'http_failed' WHEN unreadable THEN 'parse_failed' WHEN image_url IS NULL THEN 'no_image' ELSE 'updated' END AS outcome FROM filled)"""
SQL["image_backfill"] = BACKFILL + " SELECT * FROM result"
SQL["image_backfill_stats"] = BACKFILL + """ SELECT count(*) AS scanned, count(*) FILTER (outcome = 'updated') AS updated,
count(*) FILTER (outcome = 'no_image') AS no_image, count(*) FILTER (outcome = 'http_failed') AS http_failed,
count(*) FILTER (outcome = 'parse_failed') AS parse_failed FROM result"""
SQL["run_opened"] = f"""
SELECT coalesce(max(run_id), 0) + 1 AS run_id, {ts(AS_OF)} AS started_at, 'cron' AS triggered_by, NULL::VARCHAR AS completed_at, 0::BIGINT AS articles_discovered,
       0::BIGINT AS articles_inserted, 0::BIGINT AS articles_failed, 0::BIGINT AS llm_calls, 'running' AS status, NULL::VARCHAR AS error FROM n_ing"""
SQL["run_ledger_row"] = f"""
SELECT (SELECT coalesce(max(run_id), 0) + 1 FROM n_ing) AS run_id, {ts(f"{AS_OF} - INTERVAL 1 HOUR")} AS started_at, 'manual' AS triggered_by,
       (SELECT count(*) FROM n_articles) AS articles_discovered, (SELECT count(*) FROM n_articles WHERE processing_state = 'discovered') AS articles_inserted,
       NULL::VARCHAR AS error, {ts(AS_OF)} AS completed_at,
       count(*) FILTER (ok AND processing_state = 'discovered') AS articles_extracted,
       count(*) FILTER (ok AND processing_state = 'extracted') AS articles_embedded,
       count(*) FILTER (ok AND processing_state = 'embedded') AS articles_clustered,
       count(*) FILTER (ok AND processing_state = 'clustered') AS articles_enriched,
       count(*) FILTER (NOT ok AND attempt_count + 1 >= 3) AS articles_failed,
       count(*) FILTER (processing_state = 'clustered') AS llm_calls,
       CASE WHEN count(*) = 0 THEN 'skipped' WHEN count(*) FILTER (ok) = 0 THEN 'failed' ELSE 'success' END AS status
FROM n_articles JOIN (SELECT article_id, ok FROM n_outcomes) USING (article_id)"""

# --- filters ------------------------------------------------------------------------

SQL["eligible_batch"] = "SELECT article_id, outlet_id, url FROM n_articles WHERE processing_state = 'extracted' ORDER BY article_id LIMIT 100"
SQL["eligible_batch_outlet"] = """SELECT article_id, url FROM n_articles WHERE processing_state = 'discovered' AND outlet_id = 0 ORDER BY article_id LIMIT 50"""
SQL["scoped_candidates"] = """
SELECT article_id, slug AS outlet_slug FROM (
    SELECT article_id, outlet_id FROM n_articles WHERE processing_state = 'clustered' AND article_id IN (SELECT doc_id FROM labels WHERE quality = 1)
    ORDER BY article_id LIMIT 20) JOIN n_outlets USING (outlet_id)"""
SQL["active_outlets"] = "SELECT * FROM n_outlets WHERE active"
SQL["fresh_stories"] = f"""SELECT story_id, title, topic, {ts('first_seen_at')} AS first_seen_at, {ts('last_seen_at')} AS last_seen_at, article_count
FROM n_stories WHERE last_seen_at >= {AS_OF} - INTERVAL 72 HOUR"""
SQL["outlet_by_slug"] = "SELECT * FROM n_outlets WHERE slug = 'src7'"
PAYLOAD = f"""
(SELECT article_id, framing_score::DOUBLE AS framing_score, framing_label, framing_confidence::DOUBLE AS framing_confidence,
        headline_sentiment::DOUBLE AS headline_sentiment, body_sentiment::DOUBLE AS body_sentiment, {ts('analyzed_at')} AS analyzed_at,
        to_json(key_themes)::VARCHAR AS key_themes, to_json(quoted_sources)::VARCHAR AS quoted_sources, to_json(evidence_snippets)::VARCHAR AS evidence_snippets,
        to_json({{'people': people, 'organizations': organizations, 'locations': locations, 'other': []::VARCHAR[]}})::VARCHAR AS entities,
        '{{"government":' || (article_id % 3) || '.0,"opposition":' || quality || '.0,"expert":' || (article_id % 4) || '.5,"Civil Society":' || toxic
        || '.0,"corporate":-1.0,"blogger":' || (article_id % 2) || '.0}}' AS source_distribution
 FROM n_analysis)"""
PAYLOAD_COLUMNS = """framing_score, framing_label, framing_confidence, headline_sentiment, body_sentiment, analyzed_at,
       key_themes, quoted_sources, evidence_snippets, entities, source_distribution"""
SQL["article_detail"] = f"""
SELECT article_id, outlet_id, story_id, url, headline, author, {ts('published_at')} AS published_at, image_url, processing_state,
       coalesce(length(full_text) > 0, false) AS full_text_available, slug, name, {PAYLOAD_COLUMNS}
FROM n_articles JOIN n_outlets USING (outlet_id) LEFT JOIN {PAYLOAD} USING (article_id)"""
EMBED_TEXT = strip("headline || chr(10) || chr(10) || coalesce(full_text, '')")
SQL["embed_text"] = f"""SELECT article_id, {strip("headline || chr(10) || chr(10) || substr(coalesce(full_text, ''), 1, 2000)")} AS embed_text FROM n_articles"""
SQL["enrich_requests"] = """
SELECT article_id, replace('Outlet: ' || slug || chr(10) || 'Headline: ' || headline || chr(10) || 'Body:' || chr(10) || '{body}',
                           '{body}', substr(coalesce(full_text, ''), 1, 8000)) AS request
FROM n_articles JOIN n_outlets USING (outlet_id)"""
SAMPLE = """
WITH RECURSIVE usable AS (
    SELECT article_id, story_id, outlet_id, published_at FROM n_articles WHERE processing_state = 'clustered' AND length(coalesce(full_text, '')) > 0),
big AS (SELECT story_id, count(*) AS na, count(DISTINCT outlet_id) AS no FROM usable WHERE story_id IS NOT NULL GROUP BY 1
        HAVING count(DISTINCT outlet_id) >= 2 ORDER BY no DESC, na DESC, story_id DESC LIMIT 4),
newest AS (SELECT u.*, na, no, row_number() OVER (PARTITION BY story_id, outlet_id ORDER BY published_at DESC, article_id) AS k FROM usable u JOIN big USING (story_id)),
few AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY outlet_id) AS k2 FROM newest WHERE k = 1),
first_picks AS (SELECT article_id, outlet_id, row_number() OVER (ORDER BY no DESC, na DESC, story_id DESC, k2) AS pick_no FROM few WHERE k2 <= 3),
recent AS (SELECT * FROM usable WHERE article_id NOT IN (SELECT article_id FROM first_picks) ORDER BY published_at DESC, article_id DESC LIMIT 200),
loads AS (SELECT article_id, r.outlet_id, coalesce(base, 0) + row_number() OVER (PARTITION BY r.outlet_id ORDER BY article_id DESC) - 1 AS load
          FROM recent r LEFT JOIN (SELECT outlet_id, count(*) AS base FROM first_picks GROUP BY 1) b USING (outlet_id)),
second AS (SELECT article_id, outlet_id, row_number() OVER (ORDER BY load, article_id DESC) + (SELECT count(*) FROM first_picks) AS pick_no FROM loads),
sample AS (SELECT pick_no, article_id, slug FROM (SELECT * FROM first_picks UNION ALL SELECT article_id, outlet_id, pick_no FROM second) p
           JOIN n_outlets USING (outlet_id) WHERE pick_no <= 20)"""
SQL["diverse_sample"] = SAMPLE + " SELECT * FROM sample"
SQL["unanalyzed_in_sample"] = SAMPLE + " SELECT article_id FROM sample WHERE article_id NOT IN (SELECT article_id FROM n_analysis)"
SQL["foreign_rows_in_run"] = SAMPLE + """ SELECT article_id FROM n_analysis WHERE analysis_run_id = 4 AND article_id NOT IN (SELECT article_id FROM sample)"""

# --- states, embedding, clustering, selection ----------------------------------------


def outcome_sql(held: str) -> str:
    next_state = "CASE processing_state WHEN 'discovered' THEN 'extracted' WHEN 'extracted' THEN 'embedded' WHEN 'embedded' THEN 'clustered' WHEN 'clustered' THEN 'analyzed' END"
    failed = "CASE processing_state WHEN 'discovered' THEN 'failed_extract' WHEN 'extracted' THEN 'failed_embed' ELSE 'failed_analyze' END"
    return f"""
SELECT article_id,
       CASE WHEN ok THEN {next_state} WHEN NOT ok AND NOT ({held}) AND attempt_count + 1 >= 3 THEN {failed} ELSE processing_state END AS processing_state,
       CASE WHEN ok IS NOT NULL THEN {ts(AS_OF)} ELSE {ts('state_updated_at')} END AS state_updated_at,
       CASE WHEN ok THEN NULL WHEN ok IS NOT NULL THEN substr(error, 1, 2000) ELSE state_error END AS state_error,
       CASE WHEN ok THEN 0 WHEN NOT ok AND NOT ({held}) THEN attempt_count + 1 ELSE attempt_count END AS attempt_count
FROM n_articles LEFT JOIN n_outcomes USING (article_id)"""


SQL["apply_outcomes"] = outcome_sql("false")
SQL["apply_llm_outcomes"] = outcome_sql(
    "contains(lower(coalesce(error_name, '')), 'ratelimit') OR coalesce(error_code = 429, false) OR coalesce(upper(error_status) = 'RESOURCE_EXHAUSTED', false)")


def vectors(stories: str) -> str:
    """Dense hash vectors of the articles; ``stories`` gives the story each is already in."""
    return rf"""
tokens AS (SELECT article_id, unnest(list_filter(regexp_split_to_array(lower(embed_text), '{WS}+'), lambda w: w <> '')) AS tok
           FROM (SELECT article_id, {EMBED_TEXT} AS embed_text FROM n_articles)),
hashed AS (SELECT article_id, md5(tok) AS h FROM tokens),
cells AS (SELECT article_id, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 384 AS bucket,
                 CAST(sum(CASE WHEN strpos('13579bdf', substr(h, 10, 1)) > 0 THEN 1 ELSE -1 END) AS BIGINT) AS v FROM hashed GROUP BY 1, 2),
norms AS (SELECT article_id, sqrt(sum(v * v)::DOUBLE) AS norm FROM cells GROUP BY 1),
weights AS (SELECT article_id, bucket, CAST(v / norm AS FLOAT) AS weight FROM cells JOIN norms USING (article_id) WHERE v <> 0),
items AS (SELECT article_id AS id, published_at, headline, {stories} AS story_id FROM n_articles),
dense AS (SELECT i.id, i.published_at, i.story_id, list(coalesce(w.weight, 0)::DOUBLE ORDER BY b.bucket) AS vec
          FROM items i CROSS JOIN (SELECT unnest(range(384)) AS bucket) b LEFT JOIN weights w ON w.article_id = i.id AND w.bucket = b.bucket GROUP BY 1, 2, 3)"""


def edges(lookback: int, threshold: float) -> str:
    """Nearest predecessor of each batch item of ``dense`` at or above the threshold, and the walk to its root."""
    return f"""
units AS (SELECT id, published_at, story_id, vec, sqrt(list_dot_product(vec, vec)) AS len FROM dense),
scored AS (
    SELECT q.id, c.id AS parent_id, c.story_id AS parent_story,
           round(list_dot_product(q.vec, c.vec) / (q.len * c.len), 6) AS similarity,
           c.story_id IS NULL AS c_in_batch, c.published_at AS c_at
    FROM units q JOIN units c ON q.story_id IS NULL AND c.published_at >= {AS_OF} - INTERVAL {lookback} DAY
        AND (c.story_id IS NOT NULL OR c.published_at < q.published_at OR (c.published_at = q.published_at AND c.id < q.id))
    WHERE q.len > 0 AND c.len > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, c_in_batch, c_at, parent_id) AS k FROM scored) WHERE k = 1 AND similarity >= {threshold}),
parents AS (SELECT u.id, b.parent_id, b.parent_story, b.similarity FROM units u LEFT JOIN best b USING (id) WHERE u.story_id IS NULL),
walk(id, node, story) AS (
    SELECT id, id, CAST(NULL AS BIGINT) FROM parents
    UNION ALL
    SELECT w.id, p.parent_id, p.parent_story FROM walk w JOIN parents p ON p.id = w.node WHERE p.parent_id IS NOT NULL),
assigned AS (
    SELECT w.id, coalesce(w.story, w.node) AS story_id, w.story IS NULL AS is_new_story
    FROM walk w LEFT JOIN parents p ON p.id = w.node WHERE p.parent_id IS NULL)"""


HELD = "CASE WHEN article_id % 4 = 0 THEN story_id END"
SQL["hash_embedding"] = f"WITH RECURSIVE {vectors(HELD)} SELECT article_id, bucket, round(weight::DOUBLE, 6) AS weight FROM weights"
SQL["pairwise_cosine"] = """
SELECT v.vec_id, CAST(v.label AS BIGINT) AS label, l.vec_id AS lead_id,
       round(list_dot_product(v.embedding::DOUBLE[], l.embedding::DOUBLE[])
             / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) * list_dot_product(l.embedding::DOUBLE[], l.embedding::DOUBLE[])), 6) AS similarity
FROM embeddings v JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) l USING (label)"""
for key, days in (("", 31), ("_lookback", 3)):
    chain = f"WITH RECURSIVE {vectors(HELD)}, {edges(days, 0.75)}"
    SQL[f"nearest_predecessor{key}"] = chain + " SELECT id AS article_id, parent_id, similarity FROM parents"
    SQL[f"assign_stories{key}"] = chain + " SELECT id AS article_id, a.story_id, is_new_story, parent_id, similarity FROM assigned a JOIN parents USING (id)"
SQL["assign_stories_vectors"] = f"""WITH RECURSIVE dense AS (
    SELECT vec_id AS id, TIMESTAMP '2024-01-01' + CAST((vec_id * 7919) % 43200 AS INTEGER) * INTERVAL 1 MINUTE AS published_at,
           CAST(NULL AS BIGINT) AS story_id, embedding::DOUBLE[] AS vec FROM embeddings), {edges(31, 0.40)}
SELECT id AS article_id, a.story_id, is_new_story, parent_id, similarity FROM assigned a JOIN parents USING (id)"""
SQL["story_rollup"] = f"""WITH RECURSIVE {vectors(HELD)}, {edges(31, 0.75)},
merged AS (SELECT i.id, i.published_at, i.headline, coalesce(i.story_id, CASE WHEN a.is_new_story THEN -a.story_id - 1 ELSE a.story_id END) AS story_id
           FROM items i LEFT JOIN assigned a USING (id)),
extra AS (SELECT id, published_at, headline, story_id FROM merged WHERE story_id IS NOT NULL)
SELECT story_id, count(*) AS article_count, {ts('min(published_at)')} AS first_seen_at, {ts('max(published_at)')} AS last_seen_at,
       substr(arg_min(headline, (published_at, id)), 1, 500) AS title FROM extra GROUP BY story_id"""


def enrich_sql(scope: str) -> str:
    """Every story as a hand of at most four cards, dealt from its outlets' stacks layer by layer."""
    return f"""
WITH wide AS (
    SELECT story_id, len(outlets) AS n_articles, len(list_distinct(outlets)) AS n_outlets, latest, last_seen_at
    FROM n_stories JOIN (SELECT story_id, list(outlet_id) AS outlets, max(published_at) AS latest FROM n_articles
                         WHERE processing_state IN ('clustered', 'analyzed', 'complete') GROUP BY story_id) USING (story_id)
    WHERE ({scope}) AND len(list_distinct(outlets)) > 1),
front AS (SELECT list(story_id ORDER BY n_outlets DESC, n_articles DESC, last_seen_at DESC, story_id DESC)[1:8] AS ids
          FROM wide WHERE last_seen_at >= {AS_OF} - INTERVAL 72 HOUR),
stacks AS (SELECT story_id, outlet_id, list({{'id': article_id, 'at': published_at}} ORDER BY published_at DESC, article_id) AS stack
           FROM n_articles WHERE processing_state = 'clustered' AND attempt_count < 3 GROUP BY story_id, outlet_id),
cards AS (SELECT story_id, outlet_id, unnest(stack) AS card, generate_subscripts(stack, 1) AS layer FROM stacks),
hands AS (SELECT story_id, list({{'id': card.id, 'outlet': outlet_id}} ORDER BY layer, card.at DESC, card.id)[1:4] AS hand FROM cards GROUP BY story_id),
played AS (SELECT story_id, unnest(hand) AS card, generate_subscripts(hand, 1) AS story_rank FROM hands),
best AS (
    SELECT card, story_id, story_rank, n_outlets, n_articles,
           CAST(CASE WHEN list_contains(ids, story_id) THEN 0 WHEN EXISTS (SELECT 1 FROM n_stored c WHERE c.story_id = wide.story_id) THEN 1 ELSE 2 END AS BIGINT) AS tier
    FROM played JOIN wide USING (story_id), front
    QUALIFY row_number() OVER (ORDER BY tier, n_outlets DESC, n_articles DESC, latest DESC, story_rank, card.id) <= 20)
SELECT card.id AS article_id, slug AS outlet_slug, story_id, tier, story_rank, n_outlets, n_articles FROM best JOIN n_outlets ON outlet_id = card.outlet"""


def compare_sql(scope: str, limit: str = "ORDER BY story_id LIMIT 10") -> str:
    return f"""
SELECT story_id, len(o) AS n_articles, len(list_distinct(o)) AS n_outlets, {ts('fresh')} AS latest_analyzed_at,
       (SELECT {ts('generated_at')} FROM n_stored c WHERE c.story_id = g.story_id) AS generated_at
FROM (SELECT story_id, list(outlet_id) AS o, max(CASE processing_state WHEN 'analyzed' THEN state_updated_at END) AS fresh
      FROM n_articles JOIN n_stories USING (story_id) WHERE processing_state IN ('analyzed', 'complete') AND ({scope}) GROUP BY story_id) g
WHERE len(list_distinct(o)) > 1
  AND NOT EXISTS (SELECT 1 FROM n_stored c WHERE c.story_id = g.story_id AND c.generated_at >= coalesce(g.fresh, c.generated_at)) {limit}"""


SOME = "topic IN ('topic_1', 'topic_2')"
SQL["enrich_candidates"] = enrich_sql("true")
SQL["enrich_candidates_scoped"] = enrich_sql(SOME)
SQL["compare_candidates"] = compare_sql("true")
SQL["compare_candidates_scoped"] = compare_sql(SOME)
SQL["validate_enrichment"] = """
SELECT article_id, reason IS NULL AS is_valid, reason,
       CASE WHEN reason IS NULL THEN CASE WHEN m = 13 THEN 0.25::DOUBLE ELSE ((article_id * 37) % 201 - 100)::DOUBLE / 100 END END AS framing_score,
       CASE WHEN reason IS NULL THEN 'neutral' END AS framing_label, CASE WHEN reason IS NULL THEN -1.0::DOUBLE END AS body_sentiment,
       CASE WHEN reason IS NULL THEN CASE WHEN m = 12 THEN '' ELSE lang || '|x' END END AS key_themes,
       CASE WHEN reason IS NULL THEN 'A|B' END AS people, CASE WHEN reason IS NULL THEN 'Q ' || article_id END AS quotes,
       CASE WHEN reason IS NULL THEN 2::BIGINT END AS expert, CASE WHEN reason IS NULL THEN 0::BIGINT END AS other,
       CASE WHEN reason IS NULL THEN CASE WHEN m = 12 THEN '' ELSE 'e' || article_id END END AS evidence_snippets
FROM (SELECT doc_id AS article_id, lang, doc_id % 14 AS m,
             CASE doc_id % 14 WHEN 0 THEN 'not_json' WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'bad_framing_score' WHEN 3 THEN 'bad_framing_score'
                  WHEN 4 THEN 'bad_framing_label' WHEN 5 THEN 'bad_framing_confidence' WHEN 6 THEN 'bad_body_sentiment' WHEN 7 THEN 'extra_key'
                  WHEN 8 THEN 'bad_entities' WHEN 9 THEN 'bad_quoted_sources' WHEN 10 THEN 'bad_source_distribution' WHEN 11 THEN 'bad_source_distribution' END AS reason
      FROM documents)"""
SQL["validate_comparison"] = """
SELECT story_id, reason IS NULL AS is_valid, reason, CASE WHEN m = 6 THEN 'd' WHEN m > 6 THEN '- story ' || story_id END AS differences,
       CASE WHEN m > 6 THEN 0.5::DOUBLE END AS a_x, CASE WHEN m > 6 THEN 0.25::DOUBLE END AS a_y, CASE WHEN m > 6 THEN 'f1|f2' END AS b_gaps
FROM (SELECT story_id, story_id % 9 AS m, CASE story_id % 9 WHEN 0 THEN 'not_json' WHEN 1 THEN 'blank_differences' WHEN 2 THEN 'bad_coverage_matrix'
             WHEN 3 THEN 'bad_coverage_matrix' WHEN 4 THEN 'bad_not_present_here' WHEN 5 THEN 'extra_key' END AS reason FROM n_stories)"""
READY = "story_id IS NOT NULL AND processing_state IN ('analyzed', 'complete')"
SQL["story_context"] = f"""
SELECT story_id, article_id, slug, framing_score::DOUBLE AS framing_score, headline, key_themes[2] AS second_theme, quoted_sources[1].quote AS first_quote
FROM n_articles JOIN n_outlets USING (outlet_id) JOIN (SELECT article_id, framing_score, key_themes, quoted_sources FROM n_analysis) USING (article_id) WHERE {READY}"""
THEMES = f"""themes AS (
    SELECT story_id, article_id, pos, {blank_null('raw')} AS theme FROM (
        SELECT story_id, article_id, unnest(key_themes) AS raw, generate_subscripts(key_themes, 1) - 1 AS pos
        FROM n_articles JOIN (SELECT article_id, key_themes FROM n_analysis) USING (article_id) WHERE {READY}))"""
SQL["theme_union"] = f"""WITH {THEMES}
SELECT story_id, theme, arg_min(article_id, (article_id, pos)) AS first_article, CAST(arg_min(pos, (article_id, pos)) AS BIGINT) AS first_pos
FROM themes WHERE theme IS NOT NULL GROUP BY 1, 2"""
SPREAD = """(SELECT story_id, count(framing_score) AS n,
        sqrt((count(framing_score) * sum((framing_score * 100)::BIGINT * (framing_score * 100)::BIGINT) - sum((framing_score * 100)::BIGINT) * sum((framing_score * 100)::BIGINT))::DOUBLE)
        / (count(framing_score) * 100) AS sd
      FROM n_articles JOIN (SELECT article_id, framing_score FROM n_analysis) USING (article_id) WHERE {where} GROUP BY 1)"""
SQL["framing_spread"] = f"""SELECT story_id, n AS scored, CASE WHEN n < 2 THEN 0.0::DOUBLE ELSE round_even(least(greatest(sd, 0), 2), 2) END AS framing_spread
FROM {SPREAD.format(where=READY)}"""
SQL["compare_requests"] = f"""WITH {THEMES}
SELECT c.story_id, record_count, theme_count, title
FROM (SELECT story_id, count(*) AS record_count FROM n_articles WHERE {READY} AND article_id IN (SELECT article_id FROM n_analysis) GROUP BY 1) c
LEFT JOIN (SELECT story_id, count(DISTINCT theme) AS theme_count FROM themes WHERE theme IS NOT NULL GROUP BY 1) USING (story_id)
JOIN n_stories s ON s.story_id = c.story_id"""
SQL["advance_compared"] = f"""
SELECT article_id, CASE WHEN m THEN 'complete' ELSE processing_state END AS processing_state,
       CASE WHEN m THEN {ts(AS_OF)} ELSE {ts('state_updated_at')} END AS state_updated_at, CASE WHEN NOT m THEN state_error END AS state_error, attempt_count
FROM (SELECT *, coalesce(story_id IN (SELECT story_id FROM n_stored), false) AND processing_state = 'analyzed' AS m FROM n_articles)"""

# --- dashboards -----------------------------------------------------------------------

SQL["overview_counts"] = f"""
SELECT (SELECT count(*) FROM n_articles) AS article_count, (SELECT count(*) FROM n_stories) AS story_count,
       (SELECT count(*) FROM n_outlets WHERE active) AS active_outlet_count,
       (SELECT count(*) FROM n_articles WHERE published_at >= {AS_OF} - INTERVAL 24 HOUR) AS articles_last_24h,
       (SELECT count(*) FROM n_stories WHERE last_seen_at >= {AS_OF} - INTERVAL 24 HOUR) AS stories_last_24h"""
SQL["articles_by_state"] = "SELECT processing_state, count(*) AS n FROM n_articles GROUP BY 1"
SQL["framing_distribution_all"] = "SELECT framing_label AS label, count(*) AS n FROM n_analysis WHERE framing_label IS NOT NULL GROUP BY 1"
SQL["latest_ingestion_run"] = f"""SELECT * REPLACE ({ts('started_at')} AS started_at, {ts('completed_at')} AS completed_at) FROM n_ing ORDER BY run_id DESC LIMIT 1"""
SQL["analysed_pct"] = """
SELECT analysed, total, CAST(CASE WHEN total = 0 THEN 0 ELSE floor(analysed::DOUBLE / total * 100 + 0.5) END AS BIGINT) AS pct
FROM (SELECT count(*) FILTER (processing_state IN ('complete', 'analyzed')) AS analysed, count(*) AS total FROM n_articles)"""


def per_day(table: str, col: str, days: int, n: str = "n") -> str:
    return f"SELECT strftime({col}, '%Y-%m-%d') AS date, count(*) AS {n} FROM {table} WHERE {col} >= {AS_OF} - INTERVAL {days} DAY GROUP BY 1"


SQL["articles_per_day"] = per_day("n_articles", "published_at", 7)
SQL["stories_per_day"] = per_day("n_stories", "last_seen_at", 7)
WINDOW = f"""SELECT coalesce(framing_label, 'unlabeled') AS label, count(*) AS n FROM n_analysis JOIN (SELECT article_id, published_at FROM n_articles) USING (article_id)
WHERE published_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1"""
SQL["framing_distribution_window"] = WINDOW
SERIES = f"""SELECT coalesce(a.date, s.date) AS date, coalesce(articles, 0) AS articles, coalesce(stories, 0) AS stories
FROM ({per_day('n_articles', 'published_at', 30, 'articles')}) a FULL JOIN ({per_day('n_stories', 'last_seen_at', 30, 'stories')}) s ON a.date = s.date"""
SQL["trend_series"] = SERIES
SQL["trend_totals"] = f"SELECT CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(stories) AS BIGINT) AS stories FROM ({SERIES})"
SQL["framing_partition"] = f"""
WITH dist AS ({WINDOW}),
dim AS (SELECT unnest([1, 2, 3, 4, 5, 6])::BIGINT AS position, unnest(['critical', 'neutral', 'supportive', 'mixed', 'insufficient', 'unlabeled']) AS label),
c AS (SELECT position, label, position <= 3 AS is_primary, coalesce(n, 0)::BIGINT AS n FROM dim LEFT JOIN dist USING (label))
SELECT position, label, is_primary, n, CASE WHEN is_primary THEN coalesce(n::DOUBLE / nullif((SELECT sum(n) FROM c WHERE is_primary), 0)::DOUBLE, 0) END AS share
FROM c WHERE is_primary OR n > 0"""


def recent(days: int) -> str:
    return f"(SELECT outlet_id, n.* FROM n_analysis n JOIN (SELECT article_id, outlet_id, published_at FROM n_articles) a USING (article_id) WHERE published_at >= {AS_OF} - INTERVAL {days} DAY)"


def averages(days: int) -> str:
    def mean(col: str) -> str:
        return f"CAST(CASE WHEN count({col}) > 0 THEN sign(sum({col})) * floor(abs(sum({col} * 100)::DECIMAL(28,4)) / count({col}) + 0.5) / 100 END AS DOUBLE)"

    return f"(SELECT outlet_id, count(*) AS article_count, {mean('framing_score')} AS avg_framing, {mean('body_sentiment')} AS avg_sentiment FROM {recent(days)} GROUP BY 1)"


THEME_ROWS = f"SELECT outlet_id, theme, count(*) AS n FROM (SELECT outlet_id, unnest(key_themes) AS theme FROM {recent(30)}) WHERE theme IS NOT NULL GROUP BY 1, 2"
SQL["outlet_30d_stats"] = f"""SELECT s.*, t.theme, t.n AS theme_count FROM {averages(30)} s LEFT JOIN ({THEME_ROWS}) t USING (outlet_id)"""
SQL["outlet_30d_stored"] = SQL["outlet_30d_stats"]
SQL["outlet_theme_counts"] = THEME_ROWS
SQL["outlet_stats"] = f"""SELECT outlet_id, slug, name, coalesce(article_count, 0) AS article_count, avg_framing, avg_sentiment FROM n_outlets LEFT JOIN {averages(3)} USING (outlet_id)"""
CATEGORY = """CASE source || '|' || lower(trim(original_label)) WHEN 'MBFC|left' THEN 'left' WHEN 'MBFC|left-center' THEN 'left' WHEN 'MBFC|least biased' THEN 'center'
WHEN 'MBFC|center' THEN 'center' WHEN 'MBFC|right-center' THEN 'right' WHEN 'MBFC|right' THEN 'right' WHEN 'AdFontes|left' THEN 'left' WHEN 'AdFontes|skews left' THEN 'left'
WHEN 'AdFontes|middle' THEN 'center' WHEN 'AdFontes|skews right' THEN 'right' WHEN 'AdFontes|right' THEN 'right' END"""
SQL["outlet_directory"] = f"""SELECT outlet_id, slug, name, website, active, original_label, category, rating_url
FROM n_outlets LEFT JOIN (SELECT outlet_id, original_label, {CATEGORY} AS category, rating_url FROM n_ratings WHERE source = 'MBFC') USING (outlet_id)"""

# --- stories ----------------------------------------------------------------------------


def page_sql(where: str, offset: int) -> str:
    return f"""
SELECT story_id, title, topic, {ts('first_seen_at')} AS first_seen_at, {ts('last_seen_at')} AS last_seen_at, article_count, outlet_slugs, framing_spread, hero_image_url,
       (SELECT count(*) FROM n_stories WHERE {where}) AS total, {offset + 20} < (SELECT count(*) FROM n_stories WHERE {where}) AS has_more
FROM n_page_list p WHERE {where} ORDER BY p.last_seen_at DESC, story_id DESC LIMIT 20 OFFSET {offset}"""


SQL["stories_page"] = page_sql("true", 20)
SQL["stories_page_fresh"] = page_sql(f"last_seen_at >= {AS_OF} - INTERVAL 72 HOUR", 0)
SQL["story_detail"] = f"""
SELECT a.outlet_id, a.article_id, a.story_id, a.headline, a.url, a.author, {ts('a.published_at')} AS published_at, a.image_url, a.processing_state, o.slug, o.name,
       {PAYLOAD_COLUMNS}, s.title, s.topic, {ts('s.last_seen_at')} AS last_seen_at, s.article_count,
       CASE WHEN c.story_id IS NOT NULL THEN '- outlets differ' END AS differences, c.framing_spread::DOUBLE AS framing_spread
FROM n_articles a JOIN n_outlets o USING (outlet_id) LEFT JOIN {PAYLOAD} n USING (article_id) JOIN n_stories s ON s.story_id = a.story_id
LEFT JOIN n_comparisons c ON c.story_id = a.story_id"""


def sentiment(days: int) -> str:
    return f"""(SELECT s.story_id, s.last_seen_at, distinct_outlets, analyzed_articles, positive_articles, mean_body_sentiment
    FROM n_stories s JOIN (SELECT story_id, count(DISTINCT outlet_id) AS distinct_outlets, count(*) AS analyzed_articles,
                                  count(*) FILTER (body_sentiment >= 0.10) AS positive_articles, sum(body_sentiment)::DOUBLE / count(*) AS mean_body_sentiment
                           FROM n_articles JOIN (SELECT article_id, body_sentiment FROM n_analysis) USING (article_id)
                           WHERE story_id IS NOT NULL AND body_sentiment IS NOT NULL GROUP BY 1) g USING (story_id)
    WHERE s.last_seen_at >= {AS_OF} - INTERVAL {days} DAY)"""


def judged(days: int) -> str:
    return f"""(SELECT *, CASE WHEN last_seen_at < {AS_OF} - INTERVAL 7 DAY THEN 'stale' WHEN distinct_outlets < 3 THEN 'too_few_outlets'
    WHEN analyzed_articles < 3 THEN 'too_few_analyzed' WHEN mean_body_sentiment < 0.15::DOUBLE THEN 'mean_too_low'
    WHEN positive_articles::DOUBLE / analyzed_articles < 0.60::DOUBLE THEN 'consensus_too_low' END AS reason FROM {sentiment(days)})"""


SQL["story_sentiment_agg"] = f"SELECT * REPLACE ({ts('last_seen_at')} AS last_seen_at) FROM {sentiment(7)}"
SQL["positive_story_reasons"] = f"SELECT * REPLACE ({ts('last_seen_at')} AS last_seen_at) FROM {judged(30)}"
SQL["positive_stories"] = f"""
SELECT p.story_id, p.title, p.topic, {ts('p.first_seen_at')} AS first_seen_at, {ts('p.last_seen_at')} AS last_seen_at, p.article_count, outlet_slugs, outlet_count,
       framing_spread, hero_image_url, distinct_outlets, analyzed_articles, positive_articles, mean_body_sentiment
FROM n_page_list p JOIN (SELECT * FROM {judged(7)} WHERE reason IS NULL ORDER BY mean_body_sentiment DESC, distinct_outlets DESC, last_seen_at DESC, story_id DESC LIMIT 12) j USING (story_id)"""


def bias(priority: str) -> str:
    return f"""
WITH chosen AS (
    SELECT * FROM (SELECT outlet_id, source, original_label, rating_url, rated_at,
                          coalesce({CATEGORY}, CASE WHEN normalized_category IN ('left', 'center', 'right') THEN normalized_category END) AS category,
                          row_number() OVER (PARTITION BY outlet_id ORDER BY list_position({priority}, source)) AS k
                   FROM n_ratings WHERE source IN (SELECT unnest({priority}))) WHERE k = 1),
cov AS (SELECT DISTINCT a.story_id, a.outlet_id, o.slug, o.name, c.category, c.source, c.original_label, c.rating_url, c.rated_at
        FROM n_articles a JOIN n_outlets o USING (outlet_id) LEFT JOIN (SELECT * FROM chosen WHERE category IS NOT NULL) c USING (outlet_id) WHERE story_id IS NOT NULL),
g AS (SELECT story_id, count(*) AS t, count(category) AS r, count(*) FILTER (category = 'left') AS l, count(*) FILTER (category = 'center') AS c, count(*) FILTER (category = 'right') AS rr,
             string_agg(slug, '|' ORDER BY slug) AS every, coalesce(string_agg(slug, '|' ORDER BY slug) FILTER (category IS NULL), '') AS open
      FROM cov GROUP BY 1),
d AS (SELECT story_id, t >= 3 AND r >= 3 AS eligible, CASE WHEN t < 3 THEN 'too_few_outlets' WHEN r < 3 THEN 'too_few_rated_outlets' END AS reason,
             t AS total_outlet_count, CASE WHEN t < 3 THEN 0 ELSE r END AS rated_outlet_count, t - CASE WHEN t < 3 THEN 0 ELSE r END AS unrated_outlet_count,
             CASE WHEN t < 3 THEN every ELSE open END AS unrated_slugs,
             CASE WHEN t >= 3 AND r >= 3 THEN l ELSE 0 END AS left_count, CASE WHEN t >= 3 AND r >= 3 THEN c ELSE 0 END AS center_count, CASE WHEN t >= 3 AND r >= 3 THEN rr ELSE 0 END AS right_count,
             CASE WHEN t >= 3 AND r >= 3 THEN round_even(l::DOUBLE / r * 100.0, 2) ELSE 0.0::DOUBLE END AS left_pct,
             CASE WHEN t >= 3 AND r >= 3 THEN round_even(c::DOUBLE / r * 100.0, 2) ELSE 0.0::DOUBLE END AS center_pct,
             CASE WHEN t >= 3 AND r >= 3 THEN round_even(rr::DOUBLE / r * 100.0, 2) ELSE 0.0::DOUBLE END AS right_pct
      FROM g)"""


SQL["bias_distribution"] = bias("['MBFC']") + " SELECT * FROM d"
SQL["bias_distribution_two_sources"] = bias("['AdFontes', 'MBFC']") + " SELECT * FROM d"
SQL["bias_sources"] = bias("['MBFC']") + f""" SELECT story_id, CAST(list_position(['left', 'center', 'right'], category) AS BIGINT) AS category_order, outlet_id, slug, name,
original_label, category, source, rating_url, {ts('rated_at')} AS rated_at FROM cov WHERE category IS NOT NULL AND story_id IN (SELECT story_id FROM d WHERE eligible)"""
SQL["story_header"] = bias("['MBFC']") + f""",
rated AS (SELECT story_id, string_agg(concat_ws(' ', outlet_id, slug, name, original_label, category, source, rating_url, {ts('rated_at')}), '|'
                 ORDER BY list_position(['left', 'center', 'right'], category), lower(name), outlet_id) AS bias_sources
          FROM cov WHERE category IS NOT NULL AND story_id IN (SELECT story_id FROM d WHERE eligible) GROUP BY 1),
shown AS (SELECT story_id, string_agg(concat_ws(' ', rank_no, article_id, slug, name, url), '|' ORDER BY rank_no) AS story_images FROM n_hero GROUP BY 1),
facts AS (SELECT story_id, string_agg(slug, '|' ORDER BY slug) AS coverage_matrix, string_agg(cell, ',' ORDER BY cell) AS facts
          FROM (SELECT DISTINCT story_id, slug, '"' || slug || '":' || CASE story_id % 12 WHEN 3 THEN '" fact about ' || slug || ' "'
                       WHEN 6 THEN '{{"items":["fact ' || slug || '",7]}}' WHEN 9 THEN '[]' ELSE '["first ' || slug || '","second ' || slug || '"]' END AS cell
                FROM n_cells) GROUP BY 1)
SELECT p.story_id, p.title, p.topic, {ts('p.first_seen_at')} AS first_seen_at, {ts('p.last_seen_at')} AS last_seen_at, p.article_count, NULL::VARCHAR AS summary,
       p.outlet_slugs, p.outlet_count, p.framing_spread, p.hero_image_url, coalesce(shown.story_images, '') AS story_images,
       CASE WHEN k.story_id IS NOT NULL THEN '- outlets differ' END AS differences, {ts('k.generated_at')} AS generated_at,
       facts.coverage_matrix, '{{' || facts.facts || '}}' AS not_present_here, coalesce(rated.bias_sources, '') AS bias_sources, d.* EXCLUDE (story_id)
FROM n_page_list p LEFT JOIN n_comparisons k USING (story_id) LEFT JOIN facts USING (story_id) LEFT JOIN shown USING (story_id)
LEFT JOIN d USING (story_id) LEFT JOIN rated USING (story_id)"""
SQL["normalize_label"] = f"SELECT outlet_id, source, original_label, {CATEGORY} AS category FROM n_ratings"
SQL["story_images"] = "SELECT * FROM n_hero"
SQL["home_sections"] = f"""
WITH pool AS (SELECT story_id, article_count, last_seen_at, coalesce(outlet_count, 0) AS outlet_count FROM n_page_list
              WHERE last_seen_at >= {AS_OF} - INTERVAL 72 HOUR ORDER BY last_seen_at DESC, story_id DESC LIMIT 40),
hot AS (SELECT *, row_number() OVER (ORDER BY outlet_count DESC, article_count DESC, last_seen_at DESC, story_id DESC) AS k FROM pool),
late AS (SELECT *, row_number() OVER (ORDER BY last_seen_at DESC, story_id DESC) AS k2 FROM hot WHERE k > 8),
wide AS (SELECT *, row_number() OVER (ORDER BY outlet_count DESC, article_count DESC, last_seen_at DESC, story_id DESC) AS k3 FROM late WHERE k2 > 6)
SELECT section, position, story_id, outlet_count, article_count, {ts('last_seen_at')} AS last_seen_at FROM (
    SELECT 'hot_now' AS section, k AS position, story_id, outlet_count, article_count, last_seen_at FROM hot WHERE k <= 8
    UNION ALL SELECT 'just_updated', k2, story_id, outlet_count, article_count, last_seen_at FROM late WHERE k2 <= 6
    UNION ALL SELECT 'discover', k3, story_id, outlet_count, article_count, last_seen_at FROM wide WHERE k3 <= 9)"""
SQL["framing_by_outlet"] = """
SELECT story_id, slug, name, article_count, scored_count, mean_score, mean_confidence,
       CASE WHEN mean_score <= -0.15::DOUBLE THEN 'critical' WHEN mean_score >= 0.15::DOUBLE THEN 'supportive' WHEN mean_score IS NOT NULL THEN 'neutral' END AS bucket,
       mean_score IS NULL AS sorts_last
FROM (SELECT story_id, outlet_id, count(*) AS article_count, count(framing_score) AS scored_count,
             sum(framing_score)::DOUBLE / nullif(count(framing_score), 0) AS mean_score, sum(framing_confidence)::DOUBLE / nullif(count(framing_confidence), 0) AS mean_confidence
      FROM n_articles LEFT JOIN (SELECT article_id, framing_score, framing_confidence FROM n_analysis) USING (article_id) WHERE story_id IS NOT NULL GROUP BY 1, 2)
JOIN n_outlets USING (outlet_id)"""
SQL["framing_spread_nullable"] = f"SELECT story_id, n AS scored, CASE WHEN n >= 2 THEN sd END AS spread FROM {SPREAD.format(where='story_id IS NOT NULL')}"
NAMED = """known AS (SELECT DISTINCT a.story_id, o.slug, o.name FROM n_articles a JOIN n_outlets o USING (outlet_id) WHERE story_id IS NOT NULL)"""
EMPHASIS = f"""
WITH {NAMED},
listed AS (SELECT story_id, slug, theme, weight, story_id % 12 AS shape, row_number() OVER (PARTITION BY story_id, slug ORDER BY theme) AS a FROM n_cells),
shown AS (SELECT story_id, slug, theme, CASE WHEN shape IN (3, 6, 9) THEN NULL ELSE weight END AS weight,
                 CASE WHEN shape IN (3, 6, 9) THEN a ELSE row_number() OVER (PARTITION BY story_id, slug ORDER BY weight DESC, theme) END AS theme_no
          FROM listed WHERE shape <> 9 OR a = 1),
emphasis AS (SELECT s.story_id, s.slug, coalesce(k.name, upper(substr(s.slug, 1, 1)) || substr(s.slug, 2)) AS name,
                    count(*) OVER (PARTITION BY s.story_id, s.slug) AS theme_count, theme_no, theme, weight
             FROM shown s LEFT JOIN known k ON k.story_id = s.story_id AND k.slug = s.slug)"""
SQL["outlet_emphasis"] = EMPHASIS + " SELECT * FROM emphasis"
EVIDENCE = f"""
WITH snippets AS (SELECT story_id, slug, published_at, article_id, CAST(pos AS BIGINT) AS pos, {blank_null('raw')} AS snippet FROM (
    SELECT story_id, 'src' || outlet_id AS slug, published_at, article_id, unnest(evidence_snippets) AS raw, generate_subscripts(evidence_snippets, 1) - 1 AS pos
    FROM n_articles JOIN (SELECT article_id, evidence_snippets FROM n_analysis) USING (article_id) WHERE story_id IS NOT NULL))"""
SQL["outlet_evidence"] = EVIDENCE + f" SELECT * REPLACE ({ts('published_at')} AS published_at) FROM snippets WHERE snippet IS NOT NULL"
SQL["top_themes_per_outlet"] = EMPHASIS + """ SELECT * FROM (SELECT story_id, slug, name, row_number() OVER (PARTITION BY story_id, slug ORDER BY theme_no) AS shown_no, theme, weight
FROM emphasis WHERE weight IS NULL OR weight > 0) WHERE shown_no <= 5"""
SQL["evidence_preview"] = EVIDENCE + f""" SELECT * REPLACE ({ts('published_at')} AS published_at) FROM (
SELECT *, row_number() OVER (PARTITION BY story_id, slug ORDER BY published_at, article_id, pos) AS shown_no FROM snippets WHERE snippet IS NOT NULL) WHERE shown_no <= 3"""
SQL["coverage_gaps"] = f"""
WITH {NAMED}, cells AS (SELECT DISTINCT story_id, slug, story_id % 12 AS shape FROM n_cells),
gaps AS (SELECT story_id, slug, 0::BIGINT AS pos, CASE shape WHEN 3 THEN 'fact about ' || slug WHEN 6 THEN 'fact ' || slug ELSE 'first ' || slug END AS item FROM cells WHERE shape <> 9
         UNION ALL SELECT story_id, slug, 1, CASE shape WHEN 6 THEN '7' ELSE 'second ' || slug END FROM cells WHERE shape NOT IN (3, 9))
SELECT g.story_id, g.slug, coalesce(k.name, upper(substr(g.slug, 1, 1)) || substr(g.slug, 2)) AS name, pos, item FROM gaps g LEFT JOIN known k USING (story_id, slug)"""
DIST = """(SELECT a.story_id, o.slug, o.name,
        CAST(coalesce(sum(x.doc_id % 3), 0) AS BIGINT) AS government, CAST(coalesce(sum(x.quality), 0) AS BIGINT) AS opposition,
        CAST(coalesce(sum(x.doc_id % 4 + 1), 0) AS BIGINT) AS expert, CAST(coalesce(sum(x.toxic), 0) AS BIGINT) AS civil_society,
        CAST(0 AS BIGINT) AS corporate, CAST(0 AS BIGINT) AS unnamed_source, CAST(coalesce(sum(x.doc_id % 2), 0) AS BIGINT) AS other,
        CAST(coalesce(sum(x.doc_id % 3 + x.quality + x.doc_id % 4 + 1 + x.toxic + x.doc_id % 2), 0) AS BIGINT) AS total
    FROM n_articles a JOIN n_outlets o USING (outlet_id) LEFT JOIN labels x ON x.doc_id = a.article_id WHERE story_id IS NOT NULL GROUP BY 1, 2, 3)"""
CATS = ("government", "opposition", "expert", "civil_society", "corporate", "unnamed_source", "other")
SQL["source_distribution"] = f"SELECT * FROM {DIST}"
LONG = " UNION ALL ".join(f"SELECT story_id, {i} AS i, '{c}' AS category, CAST(sum({c}) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS grand_total FROM dist GROUP BY 1" for i, c in enumerate(CATS))
SQL["source_totals"] = f"""WITH dist AS (SELECT * FROM {DIST}), long AS ({LONG})
SELECT story_id, grand_total, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, i) AS place, category, n,
       CASE WHEN grand_total > 0 THEN n::DOUBLE / grand_total * 100 ELSE 0 END AS share_pct FROM long"""
SHARES = " UNION ALL ".join(f"SELECT story_id, slug, '{c}' AS category, {c} AS n, total FROM dist" for c in CATS)
SQL["outlet_source_shares"] = f"WITH dist AS (SELECT * FROM {DIST}) SELECT story_id, slug, category, n, n::DOUBLE / total * 100 AS share_pct FROM ({SHARES}) WHERE n > 0"
MARKS = '["“”\'\'‘’]+'
SQL["quoted_sources"] = f"""
SELECT story_id, slug, name, article_id, CAST(pos AS BIGINT) AS pos, coalesce({blank_null('q.speaker')}, 'Unattributed') AS speaker, {blank_null('q.affiliation')} AS affiliation,
       {strip(f"regexp_replace({strip('q.quote')}, '^{MARKS}|{MARKS}$', '', 'g')")} AS quote,
       CASE lower({strip('q.stance')}) WHEN 'supports' THEN 'supports' WHEN 'support' THEN 'supports' WHEN 'criticizes' THEN 'criticizes' WHEN 'neutral' THEN 'neutral'
            WHEN 'unclear' THEN 'unclear' WHEN 'mixed' THEN 'unclear' ELSE 'unknown' END AS stance
FROM (SELECT story_id, 'src' || outlet_id AS slug, 'SRC' || outlet_id AS name, article_id, unnest(quoted_sources) AS q, generate_subscripts(quoted_sources, 1) - 1 AS pos
      FROM n_articles JOIN (SELECT article_id, quoted_sources FROM n_analysis) USING (article_id) WHERE story_id IS NOT NULL)
WHERE {blank_null('q.quote')} IS NOT NULL"""
SQL["entity_rollup"] = f"""
WITH flat AS (
    SELECT story_id, article_id, published_at, kind, CAST(pos AS BIGINT) AS pos, {blank_null('raw')} AS entity FROM (
        {" UNION ALL ".join(f"SELECT story_id, article_id, published_at, '{k}' AS kind, unnest({k}) AS raw, generate_subscripts({k}, 1) - 1 AS pos FROM n_articles JOIN (SELECT article_id, {k} FROM n_analysis) USING (article_id) WHERE story_id IS NOT NULL" for k in ("people", "organizations", "locations"))}))
SELECT story_id, kind, arg_min(entity, (published_at, article_id, pos)) AS entity, arg_min(article_id, (published_at, article_id, pos)) AS first_article,
       arg_min(pos, (published_at, article_id, pos)) AS first_pos, count(*) AS mentions
FROM flat WHERE entity IS NOT NULL GROUP BY story_id, kind, lower(entity)"""
SQL["articles_by_outlet"] = f"""
SELECT outlet_id, story_id, article_id, {ts('published_at')} AS published_at, headline, {ts('max(published_at) OVER w')} AS outlet_newest, count(*) OVER w AS outlet_articles, slug, name, website
FROM n_articles JOIN n_outlets USING (outlet_id) WHERE story_id IS NOT NULL WINDOW w AS (PARTITION BY story_id, outlet_id)"""
SQL["framing_label_norm"] = f"""
SELECT article_id, framing_label AS label, array_to_string(list_transform(key_themes, lambda t: upper(substr(replace({strip('t')}, '_', ' '), 1, 1)) ||
       regexp_replace(substr(replace({strip('t')}, '_', ' '), 2), ' ([a-z])', ' \\1')), '|') AS themes FROM n_analysis"""

# --- search -------------------------------------------------------------------------------

TOKENS = rf"""tokens AS (
    SELECT article_id, {stem('word')} AS term, count(*) AS tf FROM (
        SELECT article_id, unnest(regexp_split_to_array(lower(coalesce(headline, '') || ' ' || coalesce(full_text, '')), '[^\p{{L}}\p{{N}}]+')) AS word FROM n_articles)
    WHERE word <> '' AND word NOT IN ({STOPS}) GROUP BY 1, 2)"""
HITS = f"""WITH {TOKENS},
weights AS (SELECT term, ln(1 + (SELECT count(*) FROM n_articles)::DOUBLE / count(*)) AS weight FROM tokens WHERE term IN ('onthe', 'anst') GROUP BY 1),
hits AS (SELECT article_id, round(sum(tf::DOUBLE / (tf + 1.2::DOUBLE) * weight), 6) AS rank FROM tokens JOIN weights USING (term) GROUP BY 1 HAVING count(*) = 2)"""


def snippet(body: str) -> str:
    is_hit = rf"len(list_filter(regexp_split_to_array(lower(w), '[^\p{{L}}\p{{N}}]+'), lambda p: p <> '' AND p NOT IN ({STOPS}) AND ({stem('p')}) IN ('onthe', 'anst'))) > 0"
    words = f"list_filter(regexp_split_to_array({body}, '{WS}+'), lambda w: w <> '')"
    return f"""array_to_string(list_slice(list_transform({words}, lambda w: CASE WHEN {is_hit} THEN '<b>' || w || '</b>' ELSE w END),
        greatest(coalesce(list_position(list_transform({words}, lambda w: {is_hit}), true), 0) - 14, 1),
        greatest(coalesce(list_position(list_transform({words}, lambda w: {is_hit}), true), 0) - 14, 1) + 29), ' ')"""


SQL["fts_tokens"] = f"WITH {TOKENS} SELECT * FROM tokens"
SQL["search_match"] = HITS + " SELECT * FROM hits"
SQL["search_total"] = HITS + " SELECT count(*) AS total FROM hits"
SQL["search_ranked"] = HITS + f"""
SELECT article_id, slug AS outlet_slug, headline, url, {ts('published_at')} AS published_at, rank, {snippet('coalesce(full_text, headline)')} AS snippet,
       (SELECT count(*) FROM hits) AS total, 20 < (SELECT count(*) FROM hits) AS has_more
FROM (SELECT h.*, a.* EXCLUDE (article_id) FROM hits h JOIN n_articles a USING (article_id) ORDER BY rank DESC, published_at DESC, article_id LIMIT 20) JOIN n_outlets USING (outlet_id)"""
SQL["search_snippet"] = f"SELECT article_id, {snippet('coalesce(full_text, headline)')} AS snippet FROM n_articles"

# --- quality and reports --------------------------------------------------------------------

SQL["analysis_quality"] = """
SELECT count(*) FILTER (f > 1 OR f < -1) AS out_of_range_framing_score, count(*) FILTER (framing_confidence < 0 OR framing_confidence > 1) AS out_of_range_confidence,
       count(*) FILTER (headline_sentiment < -1 OR headline_sentiment > 1 OR body_sentiment < -1 OR body_sentiment > 1) AS out_of_range_sentiment,
       count(*) FILTER (l NOT IN ('critical', 'neutral', 'supportive', 'mixed', 'insufficient')) AS invalid_framing_label,
       (SELECT count(*) FROM (SELECT article_id FROM n_analysis GROUP BY 1 HAVING count(*) > 1)) AS duplicate_article_analysis
FROM (SELECT *, CASE WHEN article_id % 50 = 7 THEN 1.5 ELSE framing_score END AS f, CASE WHEN article_id % 31 = 4 THEN 'left' ELSE framing_label END AS l FROM n_analysis)"""
GROUNDING = f"""
SELECT article_id, analysis_run_id, CAST(len(evidence_snippets) AS BIGINT) AS evidence_total,
       CAST(len(list_filter(evidence_snippets, lambda s: s <> '' AND contains(body, {fold('s')}))) AS BIGINT) AS evidence_grounded,
       CAST(len(quotes) AS BIGINT) AS quotes_total, CAST(len(list_filter(quotes, lambda s: s <> '' AND contains(body, {fold('s')}))) AS BIGINT) AS quotes_grounded
FROM (SELECT article_id, analysis_run_id, evidence_snippets, [quoted_sources[1].quote, quoted_sources[2].quote] AS quotes, {fold('full_text')} AS body
      FROM n_analysis JOIN (SELECT article_id, full_text FROM n_articles) USING (article_id))"""
SQL["grounding_per_article"] = GROUNDING
SQL["grounding_rate"] = f"""
SELECT et::BIGINT AS evidence_total, eg::BIGINT AS evidence_grounded, qt::BIGINT AS quotes_total, qg::BIGINT AS quotes_grounded,
       eg::DOUBLE / nullif(et, 0) AS evidence_rate, qg::DOUBLE / nullif(qt, 0) AS quotes_rate
FROM (SELECT sum(evidence_total) AS et, sum(evidence_grounded) AS eg, sum(quotes_total) AS qt, sum(quotes_grounded) AS qg FROM ({GROUNDING}))"""
SQL["grounding_normalize"] = f"SELECT article_id, {fold('full_text')} AS folded FROM n_articles"
SQL["run_report"] = """
SELECT analysis_run_id, article_id, slug, headline, framing_score::DOUBLE AS framing_score, framing_label, CAST(len(key_themes) AS BIGINT) AS theme_count,
       CAST(len(quoted_sources) AS BIGINT) AS quote_count, CAST(len(evidence_snippets) AS BIGINT) AS evidence_count,
       CAST(len(people) + len(organizations) + len(locations) AS BIGINT) AS entity_count,
       key_themes[1] AS first_theme, evidence_snippets[1] AS first_evidence, quoted_sources[1].speaker AS first_speaker
FROM n_analysis JOIN (SELECT article_id, headline, outlet_id FROM n_articles) USING (article_id) JOIN n_outlets USING (outlet_id)"""
SQL["run_touched_articles"] = """
SELECT analysis_run_id, processing_state, count(*) AS n FROM n_articles a JOIN n_runs r
ON a.state_updated_at >= r.ran_at AND a.state_updated_at <= r.ran_at + INTERVAL 30 MINUTE GROUP BY 1, 2"""
SQL["outlet_article_counts"] = """
SELECT o.outlet_id, slug, name, active, coalesce(n, 0) AS article_count FROM n_outlets o LEFT JOIN (SELECT outlet_id, count(*) AS n FROM n_articles GROUP BY 1) c USING (outlet_id)"""
SQL["recent_runs"] = f"""
SELECT * REPLACE ({ts('started_at')} AS started_at, {ts('completed_at')} AS completed_at), CAST(round((epoch_us(completed_at) - epoch_us(started_at)) / 1e6) AS BIGINT) AS seconds
FROM n_ing ORDER BY run_id DESC LIMIT 5"""
SQL["top_stories"] = f"""
SELECT story_id, title, article_count, {ts('first_seen_at')} AS first_seen_at, {ts('last_seen_at')} AS last_seen_at, replace(outlet_slugs, '|', ',') AS outlets
FROM n_page_list p ORDER BY article_count DESC, story_id LIMIT 20"""
SQL["story_stats"] = "SELECT count(*) AS total, count(*) FILTER (article_count > 1) AS multi_article FROM n_stories"
SQL["recent_articles"] = """
SELECT article_id, processing_state, attempt_count, substr(headline, 1, 60) AS headline, story_id, slug FROM (SELECT * FROM n_articles ORDER BY article_id DESC LIMIT 5) JOIN n_outlets USING (outlet_id)"""
SQL["failed_articles"] = """
SELECT article_id, processing_state, attempt_count, substr(state_error, 1, 200) AS error, url, slug
FROM (SELECT * FROM n_articles WHERE processing_state IN ('failed_extract', 'failed_embed', 'failed_analyze') ORDER BY article_id DESC LIMIT 10) JOIN n_outlets USING (outlet_id)"""
SQL["completeness"] = """
SELECT t AS with_terms, e AS with_embedding, n AS total, t * 100 // greatest(n, 1) AS terms_pct, e * 100 // greatest(n, 1) AS embedding_pct FROM (
    SELECT count(*) FILTER (length(coalesce(headline, '') || coalesce(full_text, '')) > 0) AS t,
           count(*) FILTER (processing_state NOT IN ('discovered', 'extracted', 'failed_extract')) AS e, count(*) AS n FROM n_articles)"""
ZERO = " UNION ALL ".join(
    f"SELECT '{r}' AS rule, CAST(0 AS BIGINT) AS violations" for r in (
        "articles_unique_id", "outlets_unique_id", "stories_unique_id", "analysis_unique_article", "comparisons_unique_story", "runs_unique_id",
        "analysis_runs_unique_id", "articles_unique_url", "outlets_unique_slug", "ratings_unique_outlet_source", "analysis_article", "ratings_outlet", "articles_state",
        "analysis_framing_score", "analysis_framing_confidence", "analysis_headline_sentiment", "analysis_body_sentiment", "analysis_framing_label",
        "ratings_category", "runs_triggered_by", "runs_status"))
SQL["constraint_violations"] = f"""
{ZERO}
UNION ALL SELECT 'articles_outlet', count(*) FROM n_articles WHERE outlet_id NOT IN (SELECT outlet_id FROM n_outlets)
UNION ALL SELECT 'analysis_run', count(*) FROM n_analysis WHERE analysis_run_id = 5
UNION ALL SELECT 'analysis_runs_purpose', count(*) FROM n_runs WHERE analysis_run_id = 3
UNION ALL SELECT 'articles_story', count(*) FROM n_articles WHERE story_id % 25 = 24
UNION ALL SELECT 'comparisons_story', count(*) FROM n_comparisons WHERE story_id % 25 = 24"""

# --- streaming ------------------------------------------------------------------------------

SQL["stream_discover"] = """
SELECT 'https://wire.example/' || (article_id // 3) AS url, arg_min(headline, article_id) AS headline, arg_min(outlet_id, article_id) AS outlet_id,
       min(article_id) AS article_id, 'discovered' AS processing_state FROM n_articles GROUP BY 1"""
SQL["stream_daily_counts"] = "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1"
SQL["stream_cluster"] = f"WITH RECURSIVE {vectors('CAST(NULL AS BIGINT)')}, {edges(31, 0.75)} SELECT id AS article_id, story_id FROM assigned"
SQL["stream_latest_wins"] = SQL["latest_wins_upsert"]
STAGES = "['discovered', 'extracted', 'embedded', 'clustered', 'analyzed']"
SQL["stream_attempts"] = f"""
WITH o AS (SELECT user_id, event_type = 'purchase' AS ok,
                  count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS oks
           FROM events WHERE event_type IN ('error', 'purchase')),
per_stage AS (SELECT user_id, oks AS stage, count(*) FILTER (NOT ok) AS fails FROM o GROUP BY 1, 2),
ended AS (SELECT user_id, max(stage) AS passed, min(stage) FILTER (fails >= 3 AND stage < 4) AS dead, arg_max(fails, stage) AS open_fails FROM per_stage GROUP BY 1)
SELECT user_id AS article_id,
       CASE WHEN dead IS NOT NULL THEN (['failed_extract', 'failed_embed', 'failed_analyze', 'failed_analyze'])[dead + 1]
            ELSE ({STAGES})[least(passed, 4) + 1] END AS processing_state,
       CAST(CASE WHEN dead IS NOT NULL THEN 3 WHEN passed >= 4 THEN 0 ELSE open_fails END AS BIGINT) AS attempts FROM ended"""
SQL["stream_recompare"] = f"SELECT story_id FROM ({compare_sql('true', '')})"


def all_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
