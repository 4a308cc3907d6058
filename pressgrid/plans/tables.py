"""The news model as views over the given Parquet tables.

Every view is a plain projection, join or aggregation of the given tables, so
its size grows with them.  The clock is fixed: ``AS_OF``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-01-31 00:00:00"
EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC


def as_of():
    return F.lit(AS_OF).cast("timestamp")


class Tables:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    @staticmethod
    def outlets_from(documents: DataFrame) -> DataFrame:
        return documents.select("source").distinct().selectExpr(
            "cast(substr(source, 4) as bigint) as outlet_id",
            "upper(source) as name",
            "source as slug",
            "concat('https://', source, '.example/rss') as rss_url",
            "concat('https://', source, '.example') as website",
            "cast(null as string) as logo_url",
            "cast(substr(source, 4) as bigint) % 10 <> 9 as active",
        )

    @staticmethod
    def articles_from(documents: DataFrame) -> DataFrame:
        base = documents.selectExpr(
            "doc_id as article_id",
            "lang",
            "source",
            "text",
            "cast(substr(source, 4) as bigint) as source_no",
            "case when doc_id % 11 = 0 then null else doc_id div 8 end as story_id",
            "doc_id % 10 as step",
        )
        return base.selectExpr(
            "article_id",
            """case when story_id % 10 = 0 then 0L when story_id % 10 = 5 then source_no % 2
               else source_no end as outlet_id""",
            "concat('https://', source, '.example/', article_id) as url",
            r"trim(split_part(text, '\n', 1)) as headline",
            "case when article_id % 4 = 0 then null else concat('author_', article_id % 17) end as author",
            f"timestamp_seconds({EPOCH} + 60 * ((article_id * 7919) % 43200)) as published_at",
            """case when article_id % 3 = 0 then null when article_id % 29 = 0 then ' '
               else concat('https://cdn.example/', article_id div 2, '.jpg') end as image_url""",
            "nullif(text, '') as full_text",
            "story_id",
            """case step when 0 then 'discovered' when 1 then 'extracted' when 2 then 'embedded'
               when 3 then 'clustered' when 4 then 'clustered' when 5 then 'analyzed'
               when 6 then 'analyzed' when 7 then 'complete' when 8 then 'complete'
               else if(article_id % 20 = 9, 'failed_extract', 'failed_analyze') end as processing_state""",
            f"""timestamp_seconds({EPOCH} + 60 * ((article_id * 7919) % 43200 + article_id % 240))
               as state_updated_at""",
            "case when step = 9 then concat('HTTP 503 for ', source, '/', article_id) end as state_error",
            "article_id % 4 as attempt_count",
            "lang",
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.given("documents")

    @cached_property
    def outlets(self) -> DataFrame:
        return self.outlets_from(self.documents)

    @cached_property
    def articles(self) -> DataFrame:
        return self.articles_from(self.documents)

    @cached_property
    def stories(self) -> DataFrame:
        grouped = (
            self.articles.where("story_id is not null")
            .groupBy("story_id")
            .agg(
                F.min_by("headline", "article_id").alias("title"),
                F.min("published_at").alias("first_seen_at"),
                F.max("published_at").alias("last_seen_at"),
                F.count(F.lit(1)).alias("article_count"),
            )
        )
        return grouped.selectExpr(
            "story_id",
            "title",
            "case when story_id % 3 <> 0 then concat('topic_', story_id % 5) end as topic",
            "first_seen_at",
            "last_seen_at",
            "article_count",
            "cast(null as string) as summary",
        )

    @cached_property
    def analysis(self) -> DataFrame:
        """One analysis row per labelled document."""
        joined = self.given("labels").join(
            self.documents.select("doc_id", "text", "lang"), "doc_id", "inner"
        )
        return joined.selectExpr(
            "doc_id as article_id",
            "doc_id % 8 + 1 as analysis_run_id",
            """case when doc_id % 17 = 0 then null
               else cast(((doc_id * 37) % 201 - 100) / 100 as decimal(3,2)) end as framing_score""",
            """case when doc_id % 13 = 0 then null when doc_id % 19 = 0 then 'mixed'
               when doc_id % 23 = 0 then 'insufficient'
               when (doc_id * 37) % 201 - 100 <= -33 then 'critical'
               when (doc_id * 37) % 201 - 100 >= 33 then 'supportive' else 'neutral' end as framing_label""",
            """case when doc_id % 17 = 0 then null
               else cast(((doc_id * 29) % 101) / 100 as decimal(3,2)) end as framing_confidence""",
            "cast(((doc_id * 41) % 201 - 100) / 100 as decimal(3,2)) as headline_sentiment",
            """case when doc_id % 21 = 0 then null
               else cast(((doc_id * 53) % 201 - 100) / 100 as decimal(3,2)) end as body_sentiment""",
            """array(lang, if(doc_id % 9 = 0, concat('  theme_', doc_id % 7, ' '), concat('theme_', doc_id % 7)),
               if(doc_id % 15 = 0, ' ', concat('tone_', doc_id % 5))) as key_themes""",
            """named_struct(
                 'people', array(concat('Person ', doc_id % 6), upper(concat('person ', doc_id % 4))),
                 'organizations', array(concat(' Org ', doc_id % 5)),
                 'locations', array(lang, ''),
                 'other', cast(array() as array<string>)) as entities""",
            """array(
                 named_struct('speaker', if(doc_id % 6 = 0, ' ', concat('Speaker ', doc_id % 12)),
                   'affiliation', case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then '' else 'Council ' end,
                   'quote', if(doc_id % 5 = 0, concat('never printed ', doc_id), substr(text, 11, 60)),
                   'stance', element_at(array('supports', 'criticizes', 'neutral', 'unclear', 'Support', 'mixed', 'odd'),
                                        cast(doc_id % 7 + 1 as int))),
                 named_struct('speaker', concat('Second ', doc_id % 3), 'affiliation', 'Board',
                   'quote', if(doc_id % 7 = 0, '', concat('“', substr(text, 31, 20), '”')),
                   'stance', 'neutral')) as quoted_sources""",
            """map('government', cast(doc_id % 3 as double), 'opposition', cast(quality as double),
                   'expert', doc_id % 4 + 0.5D, 'Civil Society', cast(toxic as double),
                   'corporate', -1D, 'blogger', cast(doc_id % 2 as double)) as source_distribution""",
            """array(substr(text, 1, 80), concat('fabricated ', doc_id), if(doc_id % 3 = 0, ' ', translate(substr(text, 5, 30), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')))
               as evidence_snippets""",
            f"timestamp_seconds({EPOCH} + 60 * ((doc_id * 7919) % 43200 + doc_id % 240)) as analyzed_at",
        )

    @cached_property
    def analysis_runs(self) -> DataFrame:
        return (
            self.analysis.groupBy("analysis_run_id")
            .agg(F.min("analyzed_at").alias("ran_at"))
            .selectExpr(
                "analysis_run_id", "ran_at", "'model-a' as model_id", "'v2' as prompt_version",
                "'enrich' as purpose",
            )
        )

    @cached_property
    def matrix_cells(self) -> DataFrame:
        """(story, outlet slug, theme, weight): theme count over the largest count of the story."""
        themes = (
            self.articles.where("story_id is not null")
            .join(self.analysis.select("article_id", "key_themes"), "article_id")
            .selectExpr("story_id", "concat('src', outlet_id) as slug", "explode(key_themes) as theme")
            .selectExpr("story_id", "slug", "trim(theme) as theme")
            .where("theme <> ''")
            .groupBy("story_id", "slug", "theme")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        top = themes.groupBy("story_id").agg((F.max("n") + 1).alias("top"))
        return themes.join(top, "story_id").selectExpr(
            "story_id", "slug", "theme", "if(theme = 'tone_0', 0D, n / top) as weight"
        )

    @cached_property
    def comparisons(self) -> DataFrame:
        """One per story with themes; the two JSON documents come in four tolerated shapes."""
        per_outlet = self.matrix_cells.groupBy("story_id", "slug").agg(
            F.to_json(F.map_from_entries(F.collect_list(F.struct("theme", "weight")))).alias("weights"),
            F.to_json(F.array_sort(F.collect_set("theme"))).alias("names"),
            F.min("theme").alias("first"),
        )
        shaped = per_outlet.selectExpr(
            "story_id",
            "slug",
            """case story_id % 12 when 3 then names when 6 then concat('{"themes":', names, '}')
               when 9 then to_json(array(first)) else weights end as cell""",
        )
        folded = shaped.groupBy("story_id").agg(
            F.concat(
                F.lit("{"),
                F.array_join(
                    F.array_sort(F.collect_list(F.concat(F.lit('"'), "slug", F.lit('":'), "cell"))), ","
                ),
                F.lit("}"),
            ).alias("coverage_matrix"),
            F.concat(
                F.lit("{"),
                F.array_join(
                    F.array_sort(
                        F.collect_list(
                            F.expr(
                                """concat('"', slug, '":', case story_id % 12
                                   when 3 then concat('" fact about ', slug, ' "')
                                   when 6 then concat('{"items":["fact ', slug, '",7]}')
                                   when 9 then '[]'
                                   else concat('["first ', slug, '","second ', slug, '"]') end)"""
                            )
                        )
                    ),
                    ",",
                ),
                F.lit("}"),
            ).alias("not_present_here"),
        )
        return folded.join(self.stories.select("story_id", "last_seen_at"), "story_id").selectExpr(
            "story_id",
            "'- outlets differ' as differences",
            "cast((story_id % 100) / 100 as decimal(3,2)) as framing_spread",
            "coverage_matrix",
            "not_present_here",
            "last_seen_at - make_dt_interval(0, cast(story_id % 48 as int)) as generated_at",
        )

    @cached_property
    def stored_comparisons(self) -> DataFrame:
        """Those of every third story: the selectors need stories that have none yet."""
        return self.comparisons.where("story_id % 3 = 0")

    @cached_property
    def ratings(self) -> DataFrame:
        primary = self.outlets.where("outlet_id % 5 in (0, 1)").selectExpr(
            "outlet_id",
            "'MBFC' as source",
            """case when outlet_id = 10 then 'Questionable'
               else element_at(array('Left-Center', 'Least Biased', 'Right-Center'), cast(outlet_id % 3 + 1 as int))
               end as original_label""",
            """case when outlet_id = 10 then null
               else element_at(array('left', 'center', 'right'), cast(outlet_id % 3 + 1 as int))
               end as normalized_category""",
            "concat('https://ratings.example/', slug) as rating_url",
            f"timestamp_seconds({EPOCH} - 86400 * outlet_id) as rated_at",
        )
        second = self.outlets.where("outlet_id % 10 = 0").selectExpr(
            "outlet_id",
            "'AdFontes' as source",
            "'Skews Left' as original_label",
            "'left' as normalized_category",
            "concat('https://adfontes.example/', slug) as rating_url",
            "cast(null as timestamp) as rated_at",
        )
        return primary.unionByName(second)

    @cached_property
    def events(self) -> DataFrame:
        return self.given("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def ingestion_runs(self) -> DataFrame:
        """One run per event day; event types stand for the stage counters."""
        daily = (
            self.events.groupBy(F.date_trunc("day", "ts").alias("day"))
            .agg(
                F.min("ts").alias("started_at"),
                F.max("ts").alias("last_ts"),
                F.count_if(F.col("event_type") == "view").alias("articles_discovered"),
                F.count_if(F.col("event_type") == "click").alias("articles_inserted"),
                F.count_if(F.col("event_type") == "error").alias("articles_failed"),
                F.count_if(F.col("event_type") == "purchase").alias("llm_calls"),
            )
        )
        return daily.selectExpr(
            f"(unix_seconds(day) - {EPOCH}) div 86400 + 1 as run_id",
            "started_at",
            "last_ts",
            "articles_discovered", "articles_inserted", "articles_failed", "llm_calls",
        ).selectExpr(
            "run_id",
            "started_at",
            "case when run_id % 7 <> 3 then last_ts end as completed_at",
            "case when run_id % 5 = 0 then 'manual' else 'cron' end as triggered_by",
            "articles_discovered", "articles_inserted", "articles_failed", "llm_calls",
            "case when run_id % 7 = 3 then 'running' when run_id % 11 = 0 then 'failed' else 'success' end as status",
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """One stage outcome per article that a run touched (every article not finished)."""
        return self.articles.where("processing_state in ('discovered','extracted','embedded','clustered')").selectExpr(
            "article_id",
            "article_id % 3 <> 1 as ok",
            "case when article_id % 3 = 1 then concat('HTTP 500 at ', url) end as error",
            "case when article_id % 6 = 1 then 'RateLimitError' when article_id % 3 = 1 then 'ClientError' end as error_name",
            "case when article_id % 12 = 4 then 429 when article_id % 3 = 1 then 500 end as error_code",
            "case when article_id % 15 = 10 then 'resource_exhausted' end as error_status",
        )

    @cached_property
    def web_pages(self) -> DataFrame:
        """Each article's page, with the meta-tag spellings found in the wild; some have nested menus and tables."""
        return self.documents.selectExpr(
            "doc_id as page_id",
            "concat('https://', source, '.example/news/', doc_id) as url",
            r"""concat('<!DOCTYPE html><html><head><meta charset="utf-8"><title>', doc_id, '</title>',
                 case doc_id % 10
                   when 0 then concat('<meta property="og:image" content="https://img.example/', doc_id, '.jpg?a=1&amp;b=2#top">')
                   when 1 then concat('<META content=\'/pics/', doc_id, '.png\' PROPERTY=\'og:image:url\' />')
                   when 2 then concat('<meta name=twitter:image content=//cdn.example/', doc_id, '.webp>')
                   when 3 then concat('<meta property="og:image" content="https://img.example/logo-', doc_id, '.png"><meta name="twitter:image:src" content="../t/', doc_id, '.gif">')
                   when 4 then concat('<meta property="og:image" content="https://img.example/', doc_id, '.jpg?w=32&h=64">')
                   when 5 then concat('<meta property="og:image" content=" "><meta property="og:image:secure_url" content="HTTPS://img.example/', doc_id, '?width=1200&height=10">')
                   when 6 then concat('<meta property="og:image" content="data:image/png;base64,', doc_id, '">')
                   when 7 then concat('</head><body><meta property="og:image" content="https://img.example/late', doc_id, '.jpg">')
                   when 8 then concat('<meta name="og:image" content="pic', doc_id, '.jpg">')
                   else '' end,
                 '</head><body><nav>menu', if(doc_id % 6 = 0, '<nav>inner</nav>rest of the menu', ''), '</nav><article>',
                 if(doc_id % 6 = 0, '<table><tr><td>a<TABLE><tr><td>b</td></tr></TABLE>c</td></tr></table><p>&eacute;t&eacute; &rarr; &noname; &amp;eacute;</p>', ''),
                 '<p>',
                 replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
                 '</p></article></body></html>') as html""",
            "case when doc_id % 25 = 24 then 503 else 200 end as http_status",
        )

    @cached_property
    def raw_feeds(self) -> DataFrame:
        """RSS documents: one per outlet and run of 400 article ids."""
        item = r"""concat('<item><title>', if(doc_id % 43 = 0, ' ', title), '</title>',
            if(doc_id % 37 = 0, '', if(doc_id % 6 = 1, concat('<guid>https://', source, '.example/', doc_id, '</guid>'), concat('<link> https://', source, '.example/', doc_id, '</link>'))),
            if(doc_id % 41 = 0, '<pubDate>soon</pubDate>',
               concat('<pubDate>', date_format(at, 'EEE, dd MMM yyyy HH:mm:ss'), if(doc_id % 10 = 1, '', ' +0000'), '</pubDate>')),
            case when doc_id % 4 = 0 then '<author> </author>' when doc_id % 3 = 0 then concat('<dc:creator>author_', doc_id % 17, '</dc:creator>')
              else concat('<author>author_', doc_id % 17, '</author>') end,
            case doc_id % 8
              when 0 then concat('<media:content medium="image" url="https://img.example/', doc_id, '.jpg"/>')
              when 1 then concat('<media:content url="/img/', doc_id, '.PNG?x=1"/><media:content url="/clip/', doc_id, '.mp4"/>')
              when 2 then concat('<media:content medium="video" url="https://v.example/', doc_id, '.mp4"/><media:thumbnail url="https://img.example/t', doc_id, '.jpg"/>')
              when 3 then concat('<enclosure type="image/jpeg" url="https://img.example/e', doc_id, '"/>')
              when 4 then concat('<enclosure type="audio/mpeg" url="https://a.example/', doc_id, '.mp3"/><link2/>')
              when 5 then concat('<description>&lt;p&gt;x&lt;img alt="a" src="https://img.example/i', doc_id, '.jpg"&gt;</description>')
              when 6 then concat('<image>https://img.example/pixel', doc_id, '.gif</image><description>&lt;img src=\'inline', doc_id, '.jpg\'&gt;</description>')
              else '' end,
            '</item>')"""
        items = self.documents.selectExpr(
            "doc_id",
            "source",
            r"""replace(replace(replace(regexp_replace(split_part(text, '\n', 1), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' '),
                '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as title""",
            f"timestamp_seconds({EPOCH} + 60 * ((doc_id * 7919) % 43200)) as at",
        ).selectExpr("source", "doc_id div 400 as batch", "doc_id", f"{item} as item")
        return (
            items.groupBy("source", "batch")
            .agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items"))
            .selectExpr(
                "source as outlet_slug",
                "batch",
                f"timestamp_seconds({EPOCH} + 7200 * batch) as fetched_at",
                "case when cast(substr(source, 4) as bigint) % 7 = 6 then 404 else 200 end as http_status",
                r"""concat('<rss xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>',
                    array_join(transform(items, x -> x.item), ''), '</channel></rss>') as xml""",
            )
        )
