"""Schemas of raw records and derived tables.

Raw keys such as ``U``/``u`` and ``e``/``E`` differ by case only, so raw JSON is read as text and its fields
are taken by case-exact paths; these are the names they get.
"""

from __future__ import annotations

from pyspark.sql import types as T

LEVEL = T.ArrayType(T.ArrayType(T.StringType()))

RAW = T.StructType([T.StructField("value", T.StringType()), T.StructField("path", T.StringType()), T.StructField("line_no", T.LongType())])

DEPTH = T.StructType([
    T.StructField("recv_ns", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("event_ms", T.LongType()),
    T.StructField("first_id", T.LongType()),
    T.StructField("final_id", T.LongType()),
    T.StructField("prev_id", T.LongType()),
    T.StructField("bids", LEVEL),
    T.StructField("asks", LEVEL),
])

TRADE = T.StructType([
    T.StructField("recv_ns", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("event_ms", T.LongType()),
    T.StructField("trade_id", T.LongType()),
    T.StructField("price", T.StringType()),
    T.StructField("qty", T.StringType()),
    T.StructField("trade_ms", T.LongType()),
    T.StructField("buyer_is_maker", T.BooleanType()),
])

SNAPSHOT = T.StructType([
    T.StructField("recv_ns", T.LongType()),
    T.StructField("sent_ns", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("update_id", T.LongType()),
    T.StructField("bids", LEVEL),
    T.StructField("asks", LEVEL),
])

GAP = T.StructType([
    T.StructField("recv_ns", T.LongType()),
    T.StructField("event_ms", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("expected_prev", T.LongType()),
    T.StructField("got_prev", T.LongType()),
    T.StructField("first_id", T.LongType()),
    T.StructField("final_id", T.LongType()),
    T.StructField("delta", T.LongType()),
])

OUTAGE = T.StructType([
    T.StructField("recv_ns", T.LongType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("start_ns", T.LongType()),
    T.StructField("end_ns", T.LongType()),
    T.StructField("duration_s", T.DoubleType()),
])

PRICE_LEVEL = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("q", T.DoubleType())])

#: One row of the replay: a book state, or the record of a break (``outcome``).
STATE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("segment_id", T.LongType()),
    T.StructField("event_ms", T.LongType()),
    T.StructField("update_id", T.LongType()),
    T.StructField("expected", T.LongType()),
    T.StructField("got", T.LongType()),
    T.StructField("bids", T.ArrayType(PRICE_LEVEL)),
    T.StructField("asks", T.ArrayType(PRICE_LEVEL)),
])
