"""The same results in SQL, computed from the tables without any JSON or stream."""

from __future__ import annotations

from feedlift.schema import TARGET_COLUMNS, WIRE_COLUMNS

# Per feed: the wire columns, ``created_at`` (the typed created_utc) and lineage.

EVENTS = """
SELECT CAST(event_id AS VARCHAR) AS id,
       CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS title,
       CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE concat('u', user_id) END AS author,
       event_type AS subreddit,
       CAST(trunc(value) AS INTEGER) AS score,
       value / 100 AS upvote_ratio,
       CAST(user_id AS INTEGER) AS num_comments,
       epoch_us(ts) / CAST(1000000 AS DOUBLE) AS created_utc,
       date_trunc('second', ts) AS created_at,
       CASE WHEN event_id % 11 = 0 THEN ''
            ELSE concat('https://example.com/', event_id) END AS url,
       props AS selftext,
       ts AS kafka_timestamp,
       CAST(event_id % 3 AS INTEGER) AS kafka_partition,
       event_id // 3 AS kafka_offset,
       event_id AS n
FROM events
"""

DOCUMENTS = """
SELECT concat('d', doc_id) AS id,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS title,
       CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE lang END AS author,
       source AS subreddit,
       CAST(trunc(CAST(n_chars AS DOUBLE) / 7) AS INTEGER) AS score,
       CAST(n_chars AS DOUBLE) / 100000 AS upvote_ratio,
       CAST(doc_id AS INTEGER) AS num_comments,
       CAST(1700000000 AS DOUBLE) + doc_id * CAST(0.5 AS DOUBLE) AS created_utc,
       TIMESTAMP '2023-11-14 22:13:20' + to_seconds(doc_id // 2) AS created_at,
       CASE WHEN doc_id % 11 = 0 THEN ''
            ELSE concat('https://example.com/d/', doc_id) END AS url,
       text AS selftext,
       TIMESTAMP '2023-11-14 22:13:20' + to_seconds(doc_id) AS kafka_timestamp,
       CAST(doc_id % 3 AS INTEGER) AS kafka_partition,
       doc_id // 3 AS kafka_offset,
       doc_id AS n
FROM documents
"""

PAGES = """
SELECT concat('p', page_id) AS id,
       CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS title,
       CASE WHEN page_id % 7 = 0 THEN 'unknown' ELSE 'crawler' END AS author,
       'pages' AS subreddit,
       CAST(trunc(-CAST(length(html) AS DOUBLE) / 7) AS INTEGER) AS score,
       CAST(length(html) AS DOUBLE) / 100000 AS upvote_ratio,
       CAST(page_id AS INTEGER) AS num_comments,
       CAST(1700000000 AS DOUBLE) + page_id * CAST(0.25 AS DOUBLE) AS created_utc,
       TIMESTAMP '2023-11-14 22:13:20' + to_seconds(page_id // 4) AS created_at,
       CASE WHEN page_id % 11 = 0 THEN '' ELSE url END AS url,
       html AS selftext,
       TIMESTAMP '2023-11-14 22:13:20' + to_seconds(page_id) AS kafka_timestamp,
       CAST(page_id % 3 AS INTEGER) AS kafka_partition,
       page_id // 3 AS kafka_offset,
       page_id AS n
FROM pages
"""

CONVERSATIONS = """
SELECT concat(conv_id, '-', turn) AS id,
       CASE WHEN n % 5 = 0 THEN '' ELSE role END AS title,
       CASE WHEN n % 7 = 0 THEN 'unknown' ELSE role END AS author,
       role AS subreddit,
       CAST(length(text) AS INTEGER) AS score,
       CAST(length(text) AS DOUBLE) / 100000 AS upvote_ratio,
       CAST(turn AS INTEGER) AS num_comments,
       CAST(1700000000 AS DOUBLE) + n * CAST(0.5 AS DOUBLE) AS created_utc,
       TIMESTAMP '2023-11-14 22:13:20' + to_seconds(n // 2) AS created_at,
       CASE WHEN n % 11 = 0 THEN '' ELSE concat('https://example.com/c/', conv_id) END AS url,
       text AS selftext,
       TIMESTAMP '2023-11-14 22:13:20' + to_seconds(n) AS kafka_timestamp,
       CAST(n % 3 AS INTEGER) AS kafka_partition,
       n // 3 AS kafka_offset,
       n
FROM (SELECT *, conv_id * 1000 + turn AS n FROM conversations)
"""

_TYPED = ", ".join("created_at AS created_utc" if c == "created_utc" else c for c in TARGET_COLUMNS)


def _wire(feed: str, **changed: str) -> str:
    columns = [f"{changed[c]} AS {c}" if c in changed else c for c in WIRE_COLUMNS]
    return f"SELECT {', '.join(columns)} FROM ({feed})"


# Counts are BIGINT until they come to the target.
_SENT = {c: f"CAST({c} AS BIGINT)" for c in ("score", "num_comments")}


def _target(*feeds: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT {_TYPED} FROM ({feed})" for feed in feeds)


# What damage of each kind (n % 12) leaves of a message.
_LOST = "n % 12 IN (0, 2, 3, 4, 11)"
_REPAIRS = {
    "id": f"CASE WHEN {_LOST} OR n % 12 = 7 THEN NULL WHEN n % 12 = 6 THEN 'again' ELSE id END",
    "title": f"CASE WHEN {_LOST} THEN NULL WHEN n % 12 = 9 THEN repeat('x', 1025) ELSE title END",
    "score": f"CASE WHEN {_LOST} OR n % 12 IN (1, 8) THEN NULL ELSE score END",
}


def _damaged(*more: str) -> str:
    columns = list(more)
    for name in TARGET_COLUMNS:
        source = "created_at" if name == "created_utc" else name
        if name.startswith("kafka_"):
            columns.append(name)
        else:
            kept = f"CASE WHEN {_LOST} THEN NULL ELSE {source} END"
            columns.append(f"{_REPAIRS.get(name, kept)} AS {name}")
    return f"SELECT {', '.join(columns)} FROM ({EVENTS})"


_GAPS = """concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'score' END,
                 CASE WHEN event_id % 19 = 0 THEN 'num_comments' END,
                 CASE WHEN event_id % 23 = 0 THEN 'upvote_ratio' END,
                 CASE WHEN event_id % 17 = 0 THEN 'created_utc' END)"""

_ENVELOPE = f"""
SELECT CAST(NULL AS VARCHAR) AS key, 'posts' AS topic, kafka_partition AS "partition",
       kafka_offset AS "offset", kafka_timestamp AS "timestamp",
       CAST(0 AS INTEGER) AS "timestampType", CAST(1 AS INTEGER) AS has_value
FROM ({EVENTS})
"""

_OUTCOME = f"""CASE WHEN {_LOST} OR n % 12 IN (1, 8) THEN 'unreadable'
                 WHEN n % 12 = 9 THEN 'too long: title' ELSE 'ok' END"""
_OUTCOMES = _damaged(
    f"{_OUTCOME} AS outcome",
    f"CASE WHEN {_OUTCOME} != 'ok' THEN CAST(1 AS INTEGER) END AS raw_kept",
)

# Posts without a wire record are set aside as they came.
_ASIDE = f"""
SELECT CAST(event_id AS VARCHAR) AS id,
       CASE WHEN event_id % 5 != 0 THEN event_type END AS title,
       CASE WHEN event_id % 7 != 0 THEN concat('u', user_id) END AS author,
       event_type AS subreddit,
       CASE WHEN event_id % 13 != 0 THEN value END AS score,
       CASE WHEN event_id % 23 != 0 THEN value / 100 END AS upvote_ratio,
       CASE WHEN event_id % 19 != 0 THEN CAST(user_id AS DOUBLE) END AS num_comments,
       CASE WHEN event_id % 17 != 0 THEN epoch_us(ts) / CAST(1000000 AS DOUBLE) END AS created_utc,
       CASE WHEN event_id % 11 != 0 THEN concat('https://example.com/', event_id) END AS url,
       props AS selftext,
       {_GAPS} AS outcome
FROM events WHERE {_GAPS} != ''
"""
_BEYOND = "CASE WHEN event_id % 7 = 0 THEN 3000000000 ELSE 0 END"

ORACLES: dict[str, str] = {
    "normalize_posts": _wire(EVENTS, **_SENT),
    "normalize_bigint": f"""
        SELECT CAST(event_id AS VARCHAR) AS id,
               CAST(trunc(value) AS BIGINT) + {_BEYOND} AS score,
               CAST(user_id AS BIGINT) - {_BEYOND} AS num_comments
        FROM events""",
    "normalize_unusable": f"""
        SELECT CAST(event_id AS VARCHAR) AS id, nullif({_GAPS}, '') AS reject_reason FROM events""",
    "json_encode": _wire(EVENTS),
    "json_encode_ascii": """
        SELECT concat('d', doc_id) AS id, text AS selftext, CAST(0 AS INTEGER) AS wide_bytes
        FROM documents""",
    "json_decode": _wire(EVENTS),
    "json_decode_bytes": _wire(
        EVENTS,
        id="concat(id, CASE WHEN n % 4 = 0 THEN concat(chr(65533), chr(65533)) ELSE '' END)",
    ),
    "json_decode_malformed": _damaged(),
    "flatten_typed": _target(EVENTS),
    "roundtrip_documents": _target(DOCUMENTS),
    "roundtrip_pages": _target(PAGES),
    "roundtrip_conversations": _target(CONVERSATIONS),
    "lineage_columns": f"""
        SELECT id, kafka_timestamp, kafka_partition, kafka_offset FROM ({EVENTS})""",
    "epoch_to_string": """
        SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_text
        FROM events""",
    "epoch_to_timestamp": """
        SELECT CAST(event_id AS VARCHAR) AS id, date_trunc('second', ts) AS created_utc
        FROM events""",
    "epoch_shipdates": """
        SELECT l_orderkey, l_linenumber, shipped_utc,
               strftime(shipped_utc, '%Y-%m-%d %H:%M:%S') AS shipped_text
        FROM (SELECT l_orderkey, l_linenumber,
                     date_trunc('second', l_shipdate + to_milliseconds(l_linenumber * 750))
                         AS shipped_utc
              FROM lineitem)""",
    "topic_envelope": _ENVELOPE,
    "topic_publish_stream": _target(EVENTS),
    "topic_publish_rejects": f"""
        SELECT * REPLACE (CAST(score AS DOUBLE) AS score,
                          CAST(num_comments AS DOUBLE) AS num_comments), 'sent' AS outcome
        FROM ({_wire(f"SELECT * FROM ({EVENTS}) JOIN events ON n = event_id WHERE {_GAPS} = ''")})
        UNION ALL BY NAME {_ASIDE}""",
    "topic_publish_mixed": _target(EVENTS, DOCUMENTS),
    "src_stream_scan": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "src_topic_scan": _ENVELOPE,
    "src_skip_existing": _target(DOCUMENTS),
    "src_skip_restart": _target(EVENTS),
    "stream_foreach_batch": _target(EVENTS),
    "stream_micro_batches": _target(EVENTS, DOCUMENTS, PAGES, CONVERSATIONS),
    "stream_empty_batch": """
        SELECT CAST(1 AS INTEGER) AS batch, count(*) AS n_rows FROM events""",
    "stream_resume": _target(EVENTS, DOCUMENTS),
    "stream_replay": _target(EVENTS),
    "stream_rejects": _OUTCOMES,
    "stream_rejects_one_pass": _OUTCOMES,
    "stream_long_text": f"""
        SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN repeat('y', 1100)
                               ELSE title END AS title)
        FROM ({_target(EVENTS)})""",
    "sink_ensure_table": _target(EVENTS),
    "sink_append": _target(EVENTS, CONVERSATIONS),
    "sink_append_format": _target(EVENTS, PAGES),
    "batch_row_counts": """
        SELECT CAST(0 AS INTEGER) AS batch, count(*) AS n_rows, count(*) AS n_observed FROM events
        UNION ALL
        SELECT CAST(1 AS INTEGER) AS batch, count(*) AS n_rows, count(*) AS n_observed
        FROM documents""",
    "repartition_by_key": """
        SELECT event_type AS subreddit, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_split,
               count(*) AS n_fixed, CAST(1 AS BIGINT) AS n_places, CAST(0 AS BIGINT) AS n_outside
        FROM events GROUP BY event_type""",
    "repartition_rebalanced": _target(EVENTS),
    "topic_replay": _target(EVENTS, DOCUMENTS),
    "feed_mixed_types": """
        SELECT CAST(event_id AS VARCHAR) AS id,
               CAST(trunc(value) AS BIGINT)
                   + CASE WHEN event_id % 3 = 1 THEN 3000000000 ELSE 0 END AS score,
               CAST(user_id AS BIGINT)
                   - CASE WHEN event_id % 3 = 1 THEN 3000000000 ELSE 0 END AS num_comments
        FROM events""",
    "stream_dedup": f"SELECT DISTINCT * FROM ({_target(EVENTS)})",
    "sink_merge": _target(EVENTS, PAGES),
    "resume_without_checkpoint": _target(EVENTS),
    "offset_gaps": f"""
        SELECT kafka_partition, before + 1 AS "first", kafka_offset - 1 AS "last",
               kafka_offset - before - 1 AS n_missing
        FROM (SELECT kafka_partition, kafka_offset,
                     lag(kafka_offset) OVER (PARTITION BY kafka_partition ORDER BY kafka_offset)
                         AS before
              FROM ({EVENTS}) WHERE n % 50 >= 9 AND n % 331 != 0)
        WHERE kafka_offset > before + 1""",
    "placement_skewed": f"""
        SELECT key, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_split
        FROM (SELECT CASE WHEN kafka_offset % 3 = 0 THEN 'hot'
                          WHEN kafka_offset % 7 = 0 THEN 'light' END AS key
              FROM ({_target(EVENTS, DOCUMENTS, PAGES)}))
        GROUP BY key
        UNION ALL
        SELECT 'all', count(*), 0 FROM ({_target(EVENTS, DOCUMENTS, PAGES)})""",
    "ingest_lag": """
        SELECT source AS subreddit, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_lag_off,
               CAST(0 AS BIGINT) AS n_size_off
        FROM documents GROUP BY source""",
    "sink_evolve": f"""
        SELECT * REPLACE (CAST(score AS BIGINT) AS score), CAST(NULL AS VARCHAR) AS note
        FROM ({_target(EVENTS)})
        UNION ALL
        SELECT * REPLACE (CAST(score AS BIGINT) AS score, CAST(NULL AS VARCHAR) AS url,
                          CAST(NULL AS VARCHAR) AS selftext,
                          CAST(NULL AS TIMESTAMP) AS kafka_timestamp), 'older' AS note
        FROM ({_target(DOCUMENTS)})""",
}
