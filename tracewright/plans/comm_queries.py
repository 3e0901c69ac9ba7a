"""Communication: conversations as call events of two endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import channels as ch
from ..operators.ordered import settled
from ..sources.adapters import table
from .registry import query

# every turn of a conversation is sent by its role and received by the other; a handle is the conversation's id
EV = """WITH c AS (SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
 d AS (SELECT DISTINCT conv_id, turn, role, text, last FROM c),
 e AS (
  SELECT CASE WHEN role = 'user' THEN 'a' ELSE 'b' END AS trace, conv_id AS handle, turn * 2 + 1 AS line, 'send' AS type, text AS payload FROM d
  UNION ALL SELECT CASE WHEN role = 'user' THEN 'b' ELSE 'a' END, conv_id, turn * 2 + 2, 'receive', text FROM d WHERE conv_id % 7 <> 0 OR turn <> 1
  UNION ALL SELECT DISTINCT s.trace, conv_id, -1, 'open', NULL FROM d, (VALUES ('a'), ('b')) s(trace)
  UNION ALL SELECT DISTINCT s.trace, conv_id, last * 2 + 3, 'close', NULL FROM d, (VALUES ('a'), ('b')) s(trace) WHERE conv_id % 5 <> 0),
 st AS (SELECT o.trace, o.handle, o.handle % 40 AS channel_id, o.line AS open_line, c.line AS close_line, c.line IS NOT NULL AS closed FROM e o LEFT JOIN e c ON c.trace = o.trace AND c.handle = o.handle AND c.type = 'close' WHERE o.type = 'open'),
 p AS (SELECT trace, handle, coalesce(list(payload ORDER BY line, payload) FILTER (type = 'send' AND payload IS NOT NULL), []) AS sends, coalesce(list(payload ORDER BY line, payload) FILTER (type = 'receive' AND payload IS NOT NULL), []) AS receives FROM e WHERE type IN ('send', 'receive') GROUP BY trace, handle)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("payload"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    c = c.distinct()
    user = F.col("role") == "user"
    side = lambda yes: F.when(user, F.lit("a" if yes else "b")).otherwise(F.lit("b" if yes else "a"))
    send = c.select(side(True).alias("trace"), F.col("conv_id").alias("handle"), (F.col("turn") * 2 + 1).alias("line"), F.lit("send").alias("type"), "payload")
    got = c.where("conv_id % 7 <> 0 OR turn <> 1").select(side(False).alias("trace"), F.col("conv_id").alias("handle"), (F.col("turn") * 2 + 2).alias("line"), F.lit("receive").alias("type"), "payload")
    ends = last.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("trace"), "conv_id", "last")
    none = F.lit(None).cast("string").alias("payload")
    opens = ends.select("trace", F.col("conv_id").alias("handle"), F.lit(-1).cast("long").alias("line"), F.lit("open").alias("type"), none)
    closes = ends.where("conv_id % 5 <> 0").select("trace", F.col("conv_id").alias("handle"), (F.col("last") * 2 + 3).alias("line"), F.lit("close").alias("type"), none)
    e = send.unionByName(got).unionByName(opens).unionByName(closes)
    return e.withColumn("channel_id", F.col("handle") % 40)


def full_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    data = ch.payloads(ch.stream_events(e))
    empty = F.array().cast("array<string>")
    s = ch.streams(e).join(data, ["trace", "handle", "open_line"], "left")
    return s.withColumns({"sends": F.array_compact(F.coalesce("sends", empty)), "receives": F.array_compact(F.coalesce("receives", empty))})


@query(f"{EV} SELECT trace, handle, channel_id, open_line, close_line, closed FROM st")
def channel_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.streams(events(spark, sf_dir))


@query(f"{EV} SELECT a.handle AS handle_1, b.handle AS handle_2, a.channel_id FROM st a JOIN st b ON a.channel_id = b.channel_id WHERE a.trace = 'a' AND b.trace = 'b'")
def channel_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ch.streams(events(spark, sf_dir))
    return ch.matched(s.where("trace = 'a'"), s.where("trace = 'b'")).select("handle_1", "handle_2", "channel_id")


PAIR = f"{EV}, v AS (SELECT a.handle AS handle_1, b.handle AS handle_2, pa.sends AS s1, pa.receives AS r1, pb.sends AS s2, pb.receives AS r2 FROM st a JOIN st b ON a.channel_id = b.channel_id JOIN p pa ON pa.trace = 'a' AND pa.handle = a.handle JOIN p pb ON pb.trace = 'b' AND pb.handle = b.handle WHERE a.trace = 'a' AND b.trace = 'b')"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = settled(full_streams(spark, sf_dir).where("size(sends) + size(receives) > 0"))
    return s.where("trace = 'a'"), s.where("trace = 'b'")


@query(f"{PAIR} SELECT handle_1, handle_2, starts_with(array_to_string(s2, ''), array_to_string(r1, '')) AND starts_with(array_to_string(s1, ''), array_to_string(r2, '')) AS ok FROM v")
def verify_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.verify_bytes(*_sides(spark, sf_dir)).select("handle_1", "handle_2", "ok")


@query(f"{PAIR} SELECT handle_1, handle_2, s1[1:least(len(s1), len(r2))] = r2[1:least(len(s1), len(r2))] AND s2[1:least(len(s2), len(r1))] = r1[1:least(len(s2), len(r1))] AS ok FROM v")
def verify_tcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.verify_in_turn(*_sides(spark, sf_dir), ch.tcp_ok).select("handle_1", "handle_2", "ok")


@query(
    f"""WITH RECURSIVE {PAIR[len('WITH '):]}, dd AS (SELECT handle_1, handle_2, 1 AS d, s1 AS s, r2 AS r FROM v UNION ALL SELECT handle_1, handle_2, 2, s2, r1 FROM v),
 g(handle_1, handle_2, d, i, n) AS (SELECT handle_1, handle_2, d, 0, 0 FROM dd UNION ALL
  SELECT g.handle_1, g.handle_2, g.d, g.i + 1, g.n + CASE WHEN dd.s[g.i + 1] = dd.r[g.n + 1] THEN 1 ELSE 0 END FROM g JOIN dd ON dd.handle_1 = g.handle_1 AND dd.handle_2 = g.handle_2 AND dd.d = g.d WHERE g.i < len(dd.s)),
 y AS (SELECT g.handle_1, g.handle_2, g.d, max(g.n) AS n FROM g GROUP BY 1, 2, 3)
 SELECT dd.handle_1, dd.handle_2, bool_and(y.n = len(dd.r)) AS ok FROM dd JOIN y ON y.handle_1 = dd.handle_1 AND y.handle_2 = dd.handle_2 AND y.d = dd.d GROUP BY 1, 2"""
)
def verify_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receives in order among the sends."""
    return ch.verify_in_turn(*_sides(spark, sf_dir), ch.queue_ok).select("handle_1", "handle_2", "ok")


@query(
    f"""{PAIR}, r AS (SELECT handle_1, handle_2, d, m, count(*) AS n FROM (SELECT handle_1, handle_2, 1 AS d, unnest(r2) AS m FROM v UNION ALL SELECT handle_1, handle_2, 2, unnest(r1) FROM v) GROUP BY 1, 2, 3, 4),
 s AS (SELECT handle_1, handle_2, d, m, count(*) AS n FROM (SELECT handle_1, handle_2, 1 AS d, unnest(s1) AS m FROM v UNION ALL SELECT handle_1, handle_2, 2, unnest(s2) FROM v) GROUP BY 1, 2, 3, 4),
 y AS (SELECT r.handle_1, r.handle_2, bool_and(r.n <= coalesce(s.n, 0)) AS ok FROM r LEFT JOIN s ON s.handle_1 = r.handle_1 AND s.handle_2 = r.handle_2 AND s.d = r.d AND s.m = r.m GROUP BY 1, 2)
 SELECT v.handle_1, v.handle_2, coalesce(y.ok, true) AS ok FROM v LEFT JOIN y ON y.handle_1 = v.handle_1 AND y.handle_2 = v.handle_2"""
)
def verify_udp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.verify_counts(*_sides(spark, sf_dir)).select("handle_1", "handle_2", "ok")


@query(f"{EV} SELECT s.handle AS send_handle, s.line AS send_line, r.handle AS recv_handle, r.line AS recv_line FROM e s JOIN e r ON s.handle % 40 = r.handle % 40 AND starts_with(r.payload, s.payload) WHERE s.type = 'send' AND r.type = 'receive' AND s.trace = 'a' AND r.trace = 'b'")
def payload_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    s = e.where("type = 'send' AND trace = 'a'").select("channel_id", F.col("handle").alias("send_handle"), F.col("line").alias("send_line"), F.col("payload").alias("sent"))
    r = e.where("type = 'receive' AND trace = 'b'").select("channel_id", F.col("handle").alias("recv_handle"), F.col("line").alias("recv_line"), F.col("payload").alias("recv"))
    return ch.prefix_pairs(s, r).select("send_handle", "send_line", "recv_handle", "recv_line")


# events of a user: signup opens, error closes, purchases and clicks are data
ASOF = """WITH x AS (SELECT event_id AS line, user_id AS handle, event_type FROM events)"""


@query(f"{ASOF} SELECT c.line AS close_line, c.handle, max(o.line) AS open_line FROM x c LEFT JOIN x o ON o.handle = c.handle AND o.event_type = 'signup' AND o.line < c.line WHERE c.event_type = 'error' GROUP BY 1, 2")
def handle_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest open of a handle before each close: a scan instead of a range join."""
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'error')")
    kind = F.when(F.col("event_type") == "signup", "open").otherwise("close")
    e = e.select(F.lit("a").alias("trace"), F.col("user_id").alias("handle"), F.col("event_id").alias("line"), kind.alias("type"))
    return ch.latest_opens(e).select("close_line", "handle", "open_line")


# opens, then closes that each end the latest stream opened before them (a later close again), then data: the last stream that is open
THREE = f"""{ASOF}, c AS (SELECT c.line AS close_line, c.handle, max(o.line) AS open_line FROM x c JOIN x o ON o.handle = c.handle AND o.event_type = 'signup' AND o.line < c.line WHERE c.event_type = 'error' GROUP BY 1, 2),
 s AS (SELECT o.handle, o.line AS open_line, max(c.close_line) AS end_line FROM x o LEFT JOIN c ON c.handle = o.handle AND c.open_line = o.line WHERE o.event_type = 'signup' GROUP BY 1, 2)"""


def _three_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'error', 'purchase')")
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close").otherwise("send")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    # every third result is zero in its low half, whatever its high half holds
    result = F.concat(F.lpad(F.hex(k), 8, "0"), F.lpad(F.hex(k % 3), 8, "0"))
    return e.select(F.lit("a").alias("trace"), F.col("event_id").alias("line"), F.col("user_id").alias("handle"), kind.alias("type"), result.alias("result"))


@query(f"{THREE} SELECT handle, open_line, end_line FROM s")
def stream_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream from every open, with the last close that ends it."""
    return ch.ended_opens(_three_passes(spark, sf_dir)).select("handle", "open_line", "end_line")


@query(f"{THREE} SELECT d.line, d.handle, max(s.open_line) AS open_line FROM x d JOIN s ON s.handle = d.handle AND s.open_line < d.line AND (s.end_line IS NULL OR s.end_line > d.line) WHERE d.event_type = 'purchase' GROUP BY 1, 2")
def handle_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data events with the last opened of the streams that are open when they happen."""
    return ch.assigned(_three_passes(spark, sf_dir)).select("line", "handle", "open_line")


@query(f"{ASOF}, n AS (SELECT *, CASE WHEN handle % 65536 >= 32768 THEN handle % 65536 - 65536 ELSE handle % 65536 END AS id16 FROM x) SELECT m.line, CAST(m.id16 AS INT) AS channel, max(o.line) AS create_line FROM n m LEFT JOIN n o ON o.id16 = m.id16 AND o.event_type = 'signup' AND o.line < m.line WHERE m.event_type = 'click' GROUP BY 1, 2")
def channel_name_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the latest creation of their channel, ids cut to signed 16 bits."""
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'click')")
    at = lambda kind: e.where(F.col("event_type") == kind).select(F.lit("a").alias("trace"), F.col("user_id").alias("id"), F.col("event_id").alias("line"))
    creates, messages = at("signup").withColumn("name", F.col("line").cast("string")), at("click").withColumn("message", F.lit(""))
    named = ch.named_messages(creates, messages, unnamed=True)
    return named.select("line", ch.signed16(F.col("id")).cast("int").alias("channel"), F.col("channel_name").cast("long").alias("create_line"))


@query(
    f"""{PAIR}, x AS (SELECT handle_1, handle_2, 1 AS d, unnest(s1) AS m FROM v UNION ALL SELECT handle_1, handle_2, 2, unnest(s2) FROM v),
 z AS (SELECT handle_1, handle_2, 1 AS d, unnest(r2) AS r FROM v UNION ALL SELECT handle_1, handle_2, 2, unnest(r1) FROM v),
 h AS (SELECT x.handle_1, x.handle_2, x.d, x.m, bool_or(z.r IS NOT NULL) AS hit FROM x LEFT JOIN z ON z.handle_1 = x.handle_1 AND z.handle_2 = x.handle_2 AND z.d = x.d AND starts_with(z.r, x.m) GROUP BY 1, 2, 3, 4),
 k AS (SELECT handle_1, handle_2, bool_and(hit) AS ok FROM h GROUP BY 1, 2)
 SELECT v.handle_1, v.handle_2, coalesce(k.ok, true) AS ok FROM v LEFT JOIN k ON k.handle_1 = v.handle_1 AND k.handle_2 = v.handle_2"""
)
def verify_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every send of either side has a receive on the other that starts with it."""
    return ch.verify_prefixes(*_sides(spark, sf_dir)).select("handle_1", "handle_2", "ok")


@query(
    f"""{EV}, ev AS (SELECT trace, handle, line, type, payload FROM e WHERE type IN ('send', 'receive')),
 x AS (SELECT l.handle AS handle_1, l.line AS line_1, r.handle AS handle_2, max(r.line) AS line_2 FROM ev l JOIN ev r ON r.handle % 40 = l.handle % 40 AND r.type <> l.type AND l.payload <> '' AND r.payload <> ''
  AND CASE WHEN l.type = 'send' THEN starts_with(r.payload, l.payload) ELSE starts_with(l.payload, r.payload) END WHERE l.trace = 'a' AND r.trace = 'b' GROUP BY 1, 2, 3),
 n AS (SELECT handle, count(*) AS need FROM ev WHERE trace = 'a' GROUP BY 1), m AS (SELECT handle_1, handle_2, count(*) AS got FROM x GROUP BY 1, 2)
 SELECT x.handle_1, x.line_1, x.handle_2, x.line_2 FROM x JOIN m USING (handle_1, handle_2) JOIN n ON n.handle = x.handle_1 WHERE m.got = n.need"""
)
def message_pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partners of all messages of streams that match."""
    e = events(spark, sf_dir)
    data = settled(ch.stream_events(e).drop("channel_id").join(ch.streams(e).select("trace", "handle", "open_line", "channel_id"), ["trace", "handle", "open_line"]))
    return ch.pairings(data.where("trace = 'a'"), data.where("trace = 'b'")).select("handle_1", "line_1", "handle_2", "line_2")


# events of a user: purchases are receives into a buffer, clicks are checks of it
@query(
    f"""{ASOF}, b AS (SELECT event_id AS line, user_id AS handle, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
 SELECT c.line, c.handle, r.k AS buffer, r.k % 7 AS buffer_length FROM (SELECT c.line, c.handle, max(r.line) AS r_line FROM b c LEFT JOIN b r ON r.handle = c.handle AND r.event_type = 'purchase' AND r.line < c.line WHERE c.event_type = 'click' GROUP BY 1, 2) c LEFT JOIN b r ON r.line = c.r_line"""
)
def carried_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a handle with the buffer that its last receive named."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'click')")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    e = e.select(F.lit("a").alias("trace"), F.col("user_id").alias("handle"), F.col("event_id").alias("line"), F.when(F.col("event_type") == "click", "check").otherwise("receive").alias("type"), k.alias("address"), (k % 7).alias("length"))
    return ch.carried_buffers(e).select("line", "handle", "buffer", "buffer_length")


@query(
    f"""{THREE}, r AS (SELECT event_id AS line, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 AS low FROM events)
 SELECT d.line, d.handle, max(s.open_line) AS open_line FROM x d JOIN r ON r.line = d.line AND r.low <> 0 JOIN s ON s.handle = d.handle AND s.open_line < d.line AND (s.end_line IS NULL OR s.end_line > d.line) WHERE d.event_type = 'purchase' GROUP BY 1, 2"""
)
def stream_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data events that returned something, with their stream: by opens, then closes, then data."""
    return ch.assigned(ch.successful(_three_passes(spark, sf_dir))).select("line", "handle", "open_line")


@query(
    f"""{EV}, m AS (SELECT s.trace, s.handle, s.line, s.type, s.payload, s.handle % 40 AS name FROM e s WHERE s.type IN ('send', 'receive') AND s.payload IS NOT NULL)
 SELECT 'c' || s.name AS channel_name, s.handle AS send_id, s.line AS send_line, r.handle AS recv_id, r.line AS recv_line FROM m s JOIN m r ON r.name = s.name AND starts_with(r.payload, s.payload) WHERE s.type = 'send' AND s.trace = 'a' AND r.type = 'receive' AND r.trace = 'b'"""
)
def message_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one type: channels by their latest creation, sends and receives that agree on name and beginning."""
    e = events(spark, sf_dir)
    creates = e.where("type = 'open'").select("trace", F.col("handle").alias("id"), "line", F.concat(F.lit("c"), F.col("channel_id").cast("string")).alias("name"))
    of = lambda kind, trace: ch.named_messages(creates, e.where((F.col("type") == kind) & (F.col("trace") == trace) & F.col("payload").isNotNull()).select("trace", F.col("handle").alias("id"), "line", F.col("payload").alias("message")))
    return ch.message_matches(of("send", "a"), of("receive", "b"))


# events of a user: signups make sockets, purchases bind or connect them, errors accept a child
@query(
    f"""WITH b AS (SELECT event_id AS line, user_id AS handle, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
 s AS (SELECT handle, line AS open_line, lead(line) OVER (PARTITION BY handle ORDER BY line) AS next_open FROM b WHERE event_type = 'signup'),
 n AS (SELECT s.handle, s.open_line, min_by(b.k, b.line) AS k, min(b.line) AS at_line FROM s JOIN b ON b.handle = s.handle AND b.event_type = 'purchase' AND b.line > s.open_line AND (s.next_open IS NULL OR b.line < s.next_open) GROUP BY 1, 2)
 SELECT s.handle, s.open_line, 'port' || n.k AS channel_id FROM s LEFT JOIN n ON n.handle = s.handle AND n.open_line = s.open_line
 UNION ALL SELECT 1000000 + b.line, b.line, CASE WHEN n.at_line < b.line THEN 'port' || n.k END FROM b JOIN s ON s.handle = b.handle AND s.open_line < b.line AND (s.next_open IS NULL OR b.line < s.next_open) LEFT JOIN n ON n.handle = s.handle AND n.open_line = s.open_line WHERE b.event_type = 'error'"""
)
def socket_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of sockets and of what they accept, named by bind and connect."""
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase', 'error')")
    kind = F.when(F.col("event_type") == "signup", "socket").when(F.col("event_type") == "error", "accept").when(F.col("event_id") % 2 == 0, "bind").otherwise("connect")
    address = F.concat(F.lit("port"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").cast("string"))
    e = e.select(F.lit("a").alias("trace"), F.col("user_id").alias("handle"), F.col("event_id").alias("line"), kind.alias("type"), address.alias("address"), (F.col("event_id") + 1_000_000).alias("child"))
    return ch.socket_streams(e).select("handle", "open_line", "channel_id")
