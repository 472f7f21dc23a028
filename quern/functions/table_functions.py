"""The library's searches as SQL table functions: registered views and functions by name."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="chunk_index int, chunk string")
class SlidingChunks:
    """sliding_chunks(text, size, overlap)."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        if text and size > overlap >= 0:
            for i, at in enumerate(range(0, max(len(text) - overlap, 1), size - overlap)):
                yield i, text[at : at + size]


def register(spark: SparkSession, sf_dir: str) -> None:
    """sliding_chunks and the SQL functions news_search, news_detail, related_news, recommend_news and recent_history over views of the tables."""
    from ..sources.tables import item_events, news

    spark.udtf.register("sliding_chunks", SlidingChunks)
    news(spark, sf_dir).createOrReplaceTempView("quern_news")
    item_events(spark, sf_dir).createOrReplaceTempView("quern_events")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION news_search(term STRING) RETURNS TABLE (doc_id BIGINT, title STRING) RETURN SELECT doc_id, title FROM quern_news WHERE contains(lower(title), lower(news_search.term)) ORDER BY publish_ts DESC, doc_id LIMIT 8")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION recent_history(who BIGINT) RETURNS TABLE (item BIGINT, seen TIMESTAMP_NTZ) RETURN SELECT item, max(ts) FROM quern_events WHERE user_id = recent_history.who AND event_type = 'view' GROUP BY item ORDER BY max(ts) DESC, item LIMIT 5")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION news_detail(id BIGINT) RETURNS TABLE (doc_id BIGINT, title STRING, content STRING) RETURN SELECT doc_id, title, content FROM quern_news WHERE doc_id = news_detail.id")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION related_news(id BIGINT) RETURNS TABLE (doc_id BIGINT, title STRING) RETURN SELECT n.doc_id, n.title FROM quern_news n JOIN (SELECT max(category) AS c FROM quern_news WHERE doc_id = related_news.id) s ON n.category = s.c WHERE n.doc_id <> related_news.id ORDER BY n.views DESC, n.publish_ts DESC, n.doc_id LIMIT 5")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION recommend_news(who BIGINT) RETURNS TABLE (doc_id BIGINT, title STRING) RETURN SELECT n.doc_id, n.title FROM quern_news n LEFT ANTI JOIN (SELECT item FROM quern_events WHERE user_id = recommend_news.who AND event_type = 'view') s ON n.doc_id = s.item ORDER BY n.views DESC, n.publish_ts DESC, n.doc_id LIMIT 5")
