"""Explicit schemas of the tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {
    "string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "timestamp": TimestampType(), "array<float>": ArrayType(FloatType()),
}


def _schema(ddl: str) -> StructType:
    """Without a session, which Spark's own parser needs."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in ddl.split(","))])


DOC_REGISTRY = _schema("id string, document_name string, document_code string, source_type string, total_pages string")
CHUNKS = _schema(
    "id string, document_id string, document_name string, page_start int, page_end int, section_title string, content string, "
    "embedding array<float>, token_count int, language string"
)
SESSIONS = _schema("session_id string, user_id string")
MESSAGES = _schema("message_id string, session_id string, user_id string, user_message string, assistant_message string, timestamp timestamp")
SUMMARIES = _schema("session_id string, user_id string, summary_text string, summary_json string, message_count int")
FEEDBACK = _schema("session_id string, user_id string, message_id string, feedback int, comments string, user_message string, assistant_message string")
SOURCES = _schema(
    "source_id bigint, message_id string, document_name string, page_start int, page_end int, section_title string, similarity double, snippet string"
)
PAGES = _schema("document_name string, source_type string, page int, total_pages int, text string")
CACHE = _schema("entry_id bigint, embedding array<float>, result string, stored_at timestamp")
EVENTS = _schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
STREAM_EVENTS = StructType(
    [
        StructField("type", StringType()),
        StructField("text", StringType()),
        StructField(
            "sources",
            ArrayType(_schema("document_name string, page_start int, page_end int, section_title string, similarity double, snippet string")),
        ),
        StructField("message_id", StringType()),
        StructField("cached", BooleanType()),
        StructField("method", StringType()),
        StructField("message", StringType()),
    ]
)
