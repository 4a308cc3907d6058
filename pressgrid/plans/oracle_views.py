"""The news model once more, as DuckDB SQL over the same given tables.

``with_views`` puts the views a query names (and those they name) in front of it.
"""

from __future__ import annotations

import re

VIEWS = {
    "n_outlets": """
        SELECT CAST(substr(source, 4) AS BIGINT) AS outlet_id, upper(source) AS name, source AS slug,
               'https://' || source || '.example/rss' AS rss_url,
               'https://' || source || '.example' AS website,
               CAST(substr(source, 4) AS BIGINT) % 10 <> 9 AS active
        FROM (SELECT DISTINCT source FROM documents)""",
    "n_articles": r"""
        SELECT doc_id AS article_id, source, lang,
               CASE WHEN story_id % 10 = 0 THEN 0 WHEN story_id % 10 = 5 THEN source_no % 2 ELSE source_no END AS outlet_id,
               'https://' || source || '.example/' || doc_id AS url,
               trim(split_part(text, chr(10), 1)) AS headline,
               CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'author_' || (doc_id % 17) END AS author,
               TIMESTAMP '2024-01-01' + CAST((doc_id * 7919) % 43200 AS INTEGER) * INTERVAL 1 MINUTE AS published_at,
               CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN ' '
                    ELSE 'https://cdn.example/' || (doc_id // 2) || '.jpg' END AS image_url,
               nullif(text, '') AS full_text,
               story_id,
               CASE doc_id % 10 WHEN 0 THEN 'discovered' WHEN 1 THEN 'extracted' WHEN 2 THEN 'embedded'
                    WHEN 3 THEN 'clustered' WHEN 4 THEN 'clustered' WHEN 5 THEN 'analyzed' WHEN 6 THEN 'analyzed'
                    WHEN 7 THEN 'complete' WHEN 8 THEN 'complete'
                    ELSE CASE WHEN doc_id % 20 = 9 THEN 'failed_extract' ELSE 'failed_analyze' END END AS processing_state,
               TIMESTAMP '2024-01-01' + CAST((doc_id * 7919) % 43200 + doc_id % 240 AS INTEGER) * INTERVAL 1 MINUTE AS state_updated_at,
               CASE WHEN doc_id % 10 = 9 THEN 'HTTP 503 for ' || source || '/' || doc_id END AS state_error,
               doc_id % 4 AS attempt_count
        FROM (SELECT *, CAST(substr(source, 4) AS BIGINT) AS source_no,
                     CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id // 8 END AS story_id FROM documents)""",
    "n_stories": """
        SELECT story_id, arg_min(headline, article_id) AS title,
               CASE WHEN story_id % 3 <> 0 THEN 'topic_' || (story_id % 5) END AS topic,
               min(published_at) AS first_seen_at, max(published_at) AS last_seen_at,
               count(*) AS article_count
        FROM n_articles WHERE story_id IS NOT NULL GROUP BY story_id""",
    "n_analysis": r"""
        SELECT doc_id AS article_id, doc_id % 8 + 1 AS analysis_run_id,
               CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(((doc_id * 37) % 201 - 100) / 100.0 AS DECIMAL(3,2)) END AS framing_score,
               CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 'mixed' WHEN doc_id % 23 = 0 THEN 'insufficient'
                    WHEN (doc_id * 37) % 201 - 100 <= -33 THEN 'critical'
                    WHEN (doc_id * 37) % 201 - 100 >= 33 THEN 'supportive' ELSE 'neutral' END AS framing_label,
               CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(((doc_id * 29) % 101) / 100.0 AS DECIMAL(3,2)) END AS framing_confidence,
               CAST(((doc_id * 41) % 201 - 100) / 100.0 AS DECIMAL(3,2)) AS headline_sentiment,
               CASE WHEN doc_id % 21 = 0 THEN NULL ELSE CAST(((doc_id * 53) % 201 - 100) / 100.0 AS DECIMAL(3,2)) END AS body_sentiment,
               [lang, CASE WHEN doc_id % 9 = 0 THEN '  theme_' || (doc_id % 7) || ' ' ELSE 'theme_' || (doc_id % 7) END,
                CASE WHEN doc_id % 15 = 0 THEN ' ' ELSE 'tone_' || (doc_id % 5) END] AS key_themes,
               text, lang, quality, toxic,
               ['Person ' || (doc_id % 6), 'PERSON ' || (doc_id % 4)] AS people,
               [' Org ' || (doc_id % 5)] AS organizations, [lang, ''] AS locations,
               [{'speaker': CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE 'Speaker ' || (doc_id % 12) END,
                 'affiliation': CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE 'Council ' END,
                 'quote': CASE WHEN doc_id % 5 = 0 THEN 'never printed ' || doc_id ELSE substr(text, 11, 60) END,
                 'stance': ['supports', 'criticizes', 'neutral', 'unclear', 'Support', 'mixed', 'odd'][doc_id % 7 + 1]},
                {'speaker': 'Second ' || (doc_id % 3), 'affiliation': 'Board',
                 'quote': CASE WHEN doc_id % 7 = 0 THEN '' ELSE '“' || substr(text, 31, 20) || '”' END,
                 'stance': 'neutral'}] AS quoted_sources,
               [substr(text, 1, 80), 'fabricated ' || doc_id,
                CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE translate(substr(text, 5, 30), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END] AS evidence_snippets,
               TIMESTAMP '2024-01-01' + CAST((doc_id * 7919) % 43200 + doc_id % 240 AS INTEGER) * INTERVAL 1 MINUTE AS analyzed_at
        FROM labels JOIN (SELECT doc_id, text, lang FROM documents) USING (doc_id)""",
    "n_runs": """
        SELECT analysis_run_id, min(analyzed_at) AS ran_at FROM n_analysis GROUP BY 1""",
    "n_cells": """
        SELECT story_id, slug, theme, n,
               CASE WHEN theme = 'tone_0' THEN 0.0::DOUBLE
                    ELSE CAST(n AS DOUBLE) / CAST(max(n) OVER (PARTITION BY story_id) + 1 AS DOUBLE) END AS weight
        FROM (SELECT story_id, 'src' || outlet_id AS slug, trim(theme) AS theme, count(*) AS n
              FROM (SELECT story_id, outlet_id, unnest(key_themes) AS theme
                    FROM n_articles JOIN (SELECT article_id, key_themes FROM n_analysis) USING (article_id)
                    WHERE story_id IS NOT NULL)
              WHERE trim(theme) <> '' GROUP BY 1, 2, 3)""",
    "n_comparisons": """
        SELECT story_id, CAST((story_id % 100) / 100.0 AS DECIMAL(3,2)) AS framing_spread,
               last_seen_at - CAST(story_id % 48 AS INTEGER) * INTERVAL 1 HOUR AS generated_at
        FROM n_stories WHERE story_id IN (SELECT story_id FROM n_cells)""",
    "n_stored": "SELECT * FROM n_comparisons WHERE story_id % 3 = 0",
    "n_ratings": """
        SELECT outlet_id, 'MBFC' AS source,
               CASE WHEN outlet_id = 10 THEN 'Questionable' ELSE ['Left-Center', 'Least Biased', 'Right-Center'][outlet_id % 3 + 1] END AS original_label,
               CASE WHEN outlet_id = 10 THEN NULL ELSE ['left', 'center', 'right'][outlet_id % 3 + 1] END AS normalized_category,
               'https://ratings.example/' || slug AS rating_url,
               TIMESTAMP '2024-01-01' - CAST(outlet_id AS INTEGER) * INTERVAL 1 DAY AS rated_at
        FROM n_outlets WHERE outlet_id % 5 IN (0, 1)
        UNION ALL
        SELECT outlet_id, 'AdFontes', 'Skews Left', 'left', 'https://adfontes.example/' || slug, NULL
        FROM n_outlets WHERE outlet_id % 10 = 0""",
    "n_ing": """
        SELECT run_id, started_at, CASE WHEN run_id % 7 <> 3 THEN last_ts END AS completed_at,
               CASE WHEN run_id % 5 = 0 THEN 'manual' ELSE 'cron' END AS triggered_by,
               articles_discovered, articles_inserted, articles_failed, llm_calls,
               CASE WHEN run_id % 7 = 3 THEN 'running' WHEN run_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status
        FROM (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS run_id,
                     min(ts) AS started_at, max(ts) AS last_ts,
                     count(*) FILTER (event_type = 'view') AS articles_discovered,
                     count(*) FILTER (event_type = 'click') AS articles_inserted,
                     count(*) FILTER (event_type = 'error') AS articles_failed,
                     count(*) FILTER (event_type = 'purchase') AS llm_calls
              FROM events GROUP BY 1)""",
    "n_outcomes": """
        SELECT article_id, article_id % 3 <> 1 AS ok,
               CASE WHEN article_id % 3 = 1 THEN 'HTTP 500 at ' || url END AS error,
               CASE WHEN article_id % 6 = 1 THEN 'RateLimitError' WHEN article_id % 3 = 1 THEN 'ClientError' END AS error_name,
               CASE WHEN article_id % 12 = 4 THEN 429 WHEN article_id % 3 = 1 THEN 500 END AS error_code,
               CASE WHEN article_id % 15 = 10 THEN 'resource_exhausted' END AS error_status
        FROM n_articles WHERE processing_state IN ('discovered', 'extracted', 'embedded', 'clustered')""",
    "n_hero": """
        WITH cand AS (
            SELECT a.story_id, a.article_id, a.image_url, a.published_at, o.slug, o.name, s.article_count
            FROM n_articles a JOIN n_outlets o USING (outlet_id) JOIN n_stories s USING (story_id)
            WHERE a.image_url IS NOT NULL AND trim(a.image_url) <> ''),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY story_id, slug ORDER BY published_at DESC, article_id) AS turn,
                   max(published_at) OVER (PARTITION BY story_id, slug) AS newest FROM cand),
        seq AS (
            SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY turn, newest DESC, slug) AS pos FROM ranked),
        firsts AS (
            SELECT *, row_number() OVER (PARTITION BY story_id, image_url ORDER BY pos) AS url_no FROM seq),
        dead AS (
            SELECT story_id, min(turn) AS dead_turn
            FROM (SELECT story_id, turn, count(*) FILTER (url_no = 1) AS fresh FROM firsts GROUP BY 1, 2) WHERE fresh = 0 GROUP BY 1),
        kept AS (
            SELECT f.*, row_number() OVER (PARTITION BY f.story_id ORDER BY pos) AS rank_no
            FROM firsts f LEFT JOIN dead d USING (story_id)
            WHERE url_no = 1 AND (dead_turn IS NULL OR turn < dead_turn))
        SELECT story_id, rank_no, article_id, slug, name, image_url AS url FROM kept
        WHERE rank_no <= CASE WHEN article_count < 2 THEN 0 WHEN article_count <= 6 THEN 1 WHEN article_count <= 10 THEN 2 ELSE 3 END""",
    "n_page_list": """
        SELECT s.story_id, s.title, s.topic, s.first_seen_at, s.last_seen_at, s.article_count,
               o.outlet_slugs, CAST(c.framing_spread AS DOUBLE) AS framing_spread, h.url AS hero_image_url, o.outlet_count
        FROM n_stories s
        LEFT JOIN (SELECT story_id, string_agg(slug, '|' ORDER BY slug) AS outlet_slugs, count(*) AS outlet_count
                   FROM (SELECT DISTINCT a.story_id, o.slug FROM n_articles a JOIN n_outlets o USING (outlet_id)
                         WHERE a.story_id IS NOT NULL) GROUP BY 1) o USING (story_id)
        LEFT JOIN n_comparisons c USING (story_id)
        LEFT JOIN (SELECT * FROM n_hero WHERE rank_no = 1) h USING (story_id)""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bn_[a-z_]+\b", text)):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    body = sql.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            return f"{opening}{ctes},\n{body[len(opening):]}"
    return f"WITH {ctes}\n{body}"
