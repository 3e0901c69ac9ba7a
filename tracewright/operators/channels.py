"""Communication streams from call events, and their matching across two traces.

Events: (trace, line, func, type, handle, channel_id, payload), type one of open, send, receive,
check, close.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import succeeded
from .ordered import carried_after, previous, scan, scans, settled


#: Handles are groups of the scans, so that the events of one handle are spread over many tasks.
HANDLE = ("trace", "handle")


def _last_line(kind: str) -> tuple[Column, str]:
    """For scans: the line of the last event of a type."""
    return F.when(F.col("type") == kind, F.col("line")), "last"


def _bounds(events: DataFrame) -> DataFrame:
    """Opens and closes, with their order: a close on an open's own line stands before it."""
    return events.where("type IN ('open', 'close')").withColumn("_at", F.col("line") * 2 + (F.col("type") == "open").cast("int"))


def _first_opens(events: DataFrame) -> DataFrame:
    """Opens and closes with _first: whether an open stands at the handle's begin or behind a close."""
    e = previous(_bounds(events), "_at", {"_before": "type"}, HANDLE)
    return e.withColumn("_first", (F.col("type") == "open") & (F.col("_before").isNull() | (F.col("_before") == "close"))).drop("_before", "_at")


def streams(events: DataFrame) -> DataFrame:
    """(trace, handle, channel_id, open_line, close_line, closed): a stream from each open to the handle's next close.

    An open of a handle that is open already is ignored. Streams never closed are kept, marked.
    """
    e = carried_after(settled(_first_opens(events)), "line", _last_line("close")[0], "close_line", group=HANDLE)
    return e.where("_first").select("trace", "handle", "channel_id", F.col("line").alias("open_line"), "close_line", F.col("close_line").isNotNull().alias("closed"))


def stream_events(events: DataFrame) -> DataFrame:
    """Send, receive and check events with the open_line of the stream they fall in; those outside any stream go.

    The streams are those of streams(): the latest open before an event counts if no close lies between.
    """
    # opens of an open handle do not start a stream: the state before each event is that of the last open or close
    marks = _first_opens(events).where("_first OR type = 'close'").select(*HANDLE, "line", F.struct(F.when(F.col("_first"), F.col("line")).alias("at")).alias("_mark"))
    both = settled(events.where("type NOT IN ('open', 'close')").unionByName(marks, allowMissingColumns=True))
    # a close leaves a mark without a line
    both = scan(both, "line", F.col("_mark"), "_state", "last", HANDLE)
    return both.where("_mark IS NULL AND _state.at IS NOT NULL").withColumn("open_line", F.col("_state.at")).drop("_mark", "_state")


def payloads(stream_data: DataFrame) -> DataFrame:
    """(trace, handle, open_line, sends, receives): payloads in line order; bounded by one stream's events."""
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("line", "payload")))), lambda x: x["payload"])
    return stream_data.groupBy("trace", "handle", "open_line").agg(of("send").alias("sends"), of("receive").alias("receives"))


def matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of streams of two traces with equal channel id."""
    names = ["handle", "open_line", "sends", "receives"]
    a = left.select("channel_id", *[F.col(c).alias(f"{c}_1") for c in names if c in left.columns])
    b = right.select("channel_id", *[F.col(c).alias(f"{c}_2") for c in names if c in right.columns])
    return a.join(b, "channel_id")


STREAM = ["handle", "open_line"]


def _of(d: DataFrame, side: int, *more: str) -> DataFrame:
    """The key of one side's streams under that side's names."""
    return d.select("channel_id", *[F.col(c).alias(f"{c}_{side}") for c in STREAM], *more)


def _classes(streams: DataFrame, column: str, side: int) -> DataFrame:
    """(channel_id, handle, open_line, m, n): the distinct messages of a column of payloads, and how often each occurs in its stream."""
    d = _of(streams, side, F.explode(column).alias("m"))
    return d.groupBy(*d.columns).agg(F.count("*").alias("n"))


#: Streams of one side that meet a stream of the other in one row.
TOGETHER = 256


def _full(found: DataFrame, need: DataFrame, side: int) -> DataFrame:
    """The pairs of streams for which as many messages of one side's stream were found as it has."""
    mine = [f"{c}_{side}" for c in STREAM]
    got = found.groupBy(*[f"{c}_{i}" for i in (1, 2) for c in STREAM]).agg(F.count("*").alias("_got"))
    return got.join(need.groupBy(*mine).agg(F.count("*").alias("_need")), mine).where("_got = _need").drop("_got", "_need")


def _both_ways(left: DataFrame, right: DataFrame, checked: str, asks: Callable[[Column], Column], check: Callable[[DataFrame, DataFrame, int, int], DataFrame]) -> DataFrame:
    """All pairs of streams of equal channel with ok: whether the check holds for what each side sent and the other received.

    check(senders, receivers, sending side, receiving side) gives the pairs it holds for. It asks something of streams whose
    `checked` column (sends or receives) satisfies `asks`; it holds for all pairs of the others, which need not be given. Only pairs that it
    gives are shuffled: the others come from each stream beside groups of streams of the other side, as the last step.
    """
    keys = [f"{c}_{i}" for i in (1, 2) for c in STREAM]
    a, b = (_of(d, i, asks(F.col(checked)).cast("int").alias(f"_need_{i}")) for i, d in ((1, left), (2, right)))
    held = check(left, right, 1, 2).select(*keys).unionByName(check(right, left, 2, 1).select(*keys)).groupBy(*keys).agg(F.count("*").alias("_held"))
    groups = b.groupBy("channel_id").agg(F.ceil(F.count("*") / TOGETHER).alias("_groups"))
    b = b.join(groups, "channel_id").withColumn("_group", F.pmod(F.xxhash64("handle_2", "open_line_2"), "_groups"))
    b = settled(b.groupBy("channel_id", "_group").agg(F.array_sort(F.collect_list(F.struct("handle_2", "open_line_2", "_need_2"))).alias("_streams")))
    places = b.select("_group", F.posexplode("_streams").alias("_at", "_s")).select("_group", "_at", "_s.*")
    ok = held.join(a.drop("channel_id"), keys[:2]).join(places, keys[2:]).where("_held = _need_1 + _need_2")
    ok = ok.groupBy(*keys[:2], "_group").agg(F.collect_list("_at").alias("_ok"))
    pairs = a.join(b.select("channel_id", "_group"), "channel_id").join(ok, [*keys[:2], "_group"], "left")
    # few bytes make many rows: the number of tasks is fixed, so that it is not taken from the bytes
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(tasks, "channel_id", "_group").join(b, ["channel_id", "_group"])
    pairs = pairs.select(*keys[:2], "_need_1", "_ok", F.posexplode("_streams").alias("_at", "_s"))
    free = (F.col("_need_1") == 0) & (F.col("_s._need_2") == 0)
    return pairs.select(*keys[:2], *[F.col(f"_s.{c}").alias(c) for c in keys[2:]], (free | F.coalesce(F.array_contains("_ok", F.col("_at")), F.lit(False))).alias("ok"))


def verify_bytes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of streams(channel_id, handle, open_line, sends, receives) with ok: what each side received is a prefix of what the other sent, as byte streams.

    A sent stream is cut at the lengths that may_begin() gives, and the 256-bit digests of these beginnings meet those of whole
    received streams. So a prefix may end within a message, and no pair carries bytes.
    """
    whole = lambda c: F.array_join(c, "")

    def check(senders: DataFrame, receivers: DataFrame, s: int, r: int) -> DataFrame:
        got = _of(receivers, r, whole("receives").alias("sent")).where("sent <> ''")
        cut = may_begin(got, _of(senders, s, whole("sends").alias("recv")))
        cut = cut.withColumn("d", F.sha2(F.substring(F.col("recv"), F.lit(1), F.col("_n")).cast("binary"), 256)).drop("recv")
        got = got.withColumns({"_n": F.length("sent"), "d": F.sha2(F.col("sent").cast("binary"), 256)}).drop("sent")
        return cut.join(got, ["channel_id", "_n", "d"])

    return _both_ways(left, right, "receives", lambda c: whole(c) != "", check)


def verify_in_turn(left: DataFrame, right: DataFrame, ok: Callable[[Column, Column], Column]) -> DataFrame:
    """As verify_bytes, for checks of the order of messages (tcp_ok, queue_ok): pairs carry a 64-bit digest a message, so unequal messages are taken for equal by chance only."""
    digests = lambda c: F.transform(c, lambda m: F.xxhash64(m))
    pairs = _of(left, 1, digests("sends").alias("s1"), digests("receives").alias("r1")).join(_of(right, 2, digests("sends").alias("s2"), digests("receives").alias("r2")), "channel_id")
    return pairs.withColumn("ok", ok(F.col("s1"), F.col("r2")) & ok(F.col("s2"), F.col("r1"))).drop("channel_id", "s1", "r1", "s2", "r2")


def verify_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """As verify_bytes: each message was received at most as often as it was sent. Distinct messages meet by join, once a stream however often they occur."""

    def check(senders: DataFrame, receivers: DataFrame, s: int, r: int) -> DataFrame:
        got = _classes(receivers, "receives", r).withColumnRenamed("n", "_r")
        found = _classes(senders, "sends", s).join(got, ["channel_id", "m"]).where("_r <= n")
        return _full(found, got, r)

    return _both_ways(left, right, "receives", lambda c: F.size(c) > 0, check)


def verify_prefixes(left: DataFrame, right: DataFrame) -> DataFrame:
    """As verify_bytes: every message that a side sent begins one that the other received. Messages are known within their stream by 64-bit digests."""

    def check(senders: DataFrame, receivers: DataFrame, s: int, r: int) -> DataFrame:
        sent = settled(_classes(senders, "sends", s).drop("n").withColumn("_mark", F.xxhash64("m")))
        found = prefix_pairs(sent.withColumnRenamed("m", "sent"), settled(_classes(receivers, "receives", r).drop("n")).withColumnRenamed("m", "recv"))
        found = found.select("_mark", *[f"{c}_{i}" for i in (1, 2) for c in STREAM]).distinct()
        return _full(found, sent, s)

    return _both_ways(left, right, "sends", lambda c: F.size(c) > 0, check)


def pairings(left: DataFrame, right: DataFrame) -> DataFrame:
    """(handle_1, open_line_1, line_1, handle_2, open_line_2, line_2): how the messages of matching streams pair up.

    left, right: sends and receives (channel_id, handle, open_line, line, type, payload) of the streams of two traces. Two streams match
    if every message of the left one pairs with one of the other: a sent message with a received one that begins with it, a
    received one with a sent one that it begins with; the last such line is its partner. Empty and null messages pair with nothing, so their streams match none. Messages
    that a stream repeats meet once.
    """
    keys = [f"{c}_{i}" for i in (1, 2) for c in STREAM]
    said = lambda d, side, *more: _of(d.where("type IN ('send', 'receive')"), side, "type", "payload", *more)
    mine = said(left, 1, F.col("line").alias("line_1"), F.xxhash64("type", "payload").alias("_mark"))
    # a message is known within its stream by a 64-bit digest, so that found pairs carry no payload
    own = settled(mine.where("payload <> ''").groupBy("channel_id", "handle_1", "open_line_1", "type", "payload", "_mark").agg(F.count("*").alias("_times")))
    other = said(right, 2, "line").where("payload <> ''")
    other = settled(other.groupBy(*[c for c in other.columns if c != "line"]).agg(F.max("line").alias("line_2")))
    of = lambda d, kind, name: d.where(F.col("type") == kind).withColumnRenamed("payload", name).drop("type", "_times")
    sent = prefix_pairs(of(own, "send", "sent"), of(other, "receive", "recv"))
    got = prefix_pairs(of(other, "send", "sent"), of(own, "receive", "recv"))
    found = sent.select(*keys, "_mark", "line_2").unionByName(got.select(*keys, "_mark", "line_2"))
    found = settled(found.groupBy(*keys, "_mark").agg(F.max("line_2").alias("line_2")))
    need = mine.groupBy("handle_1", "open_line_1").agg(F.count("*").alias("_need"))
    message = ["handle_1", "open_line_1", "_mark"]
    full = found.join(own.select(*message, "_times"), message).groupBy(*keys).agg(F.sum("_times").alias("_got"))
    full = full.join(need, ["handle_1", "open_line_1"]).where("_got = _need").select(*keys)
    lines = mine.where("payload <> ''").select(*message, "line_1")
    return found.join(full, keys).join(lines, message).select("handle_1", "open_line_1", "line_1", "handle_2", "open_line_2", "line_2")


def tcp_ok(sends: Column, receives: Column) -> Column:
    """The i-th receive equals the i-th send, up to the shorter."""
    n = F.least(F.size(sends), F.size(receives))
    return F.slice(sends, 1, n) == F.slice(receives, 1, n)


def queue_ok(sends: Column, receives: Column) -> Column:
    """Receives are a subsequence of the sends, in order: one greedy pass over the sends."""
    seen = F.aggregate(sends, F.lit(0), lambda i, s: F.when(F.get(receives, i) == s, i + 1).otherwise(i))
    return seen == F.size(receives)


def may_begin(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """receives(channel_id, recv, …) with _n: once for each length of a sent text (channel_id, sent) of the channel that may begin theirs.

    A sent text is marked by its beginning of the greatest power of two that it holds, a received one by all such beginnings of
    its own; a received text takes the lengths of the sent ones that share a mark with it, not all that occur on the channel. Marks are 64-bit hashes,
    so a chance collision adds a length and loses none; whether a text does begin another is left to the caller.
    """
    power = lambda n: F.pow(F.lit(2), F.length(F.bin(n)) - 1).cast("int")
    mark = lambda c, n: F.xxhash64(F.substring(F.col(c), F.lit(1), n))
    s = sends.where("sent IS NOT NULL").select("channel_id", "sent", F.length("sent").alias("_n"))
    s = s.withColumn("_size", F.when(F.col("_n") == 0, 0).otherwise(power(F.col("_n"))))
    lengths = s.select("channel_id", "_size", mark("sent", F.col("_size")).alias("_mark"), "_n").groupBy("channel_id", "_size", "_mark").agg(F.collect_set("_n").alias("_lengths"))
    m = F.length("recv")
    sizes = F.when(m == 0, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.length(F.bin(m))), lambda i: F.when(i == 0, 0).otherwise(F.pow(F.lit(2), i - 1).cast("int"))))
    r = receives.where("recv IS NOT NULL").withColumn("_text", F.xxhash64("recv"))
    marks = r.select("channel_id", "_text", F.explode(F.transform(sizes, lambda n: F.struct(n.alias("_size"), mark("recv", n).alias("_mark")))).alias("_m"))
    known = marks.select("channel_id", "_text", "_m.*").distinct().join(lengths, ["channel_id", "_size", "_mark"])
    # texts of one hash share their lengths
    known = known.groupBy("channel_id", "_text").agg(F.array_distinct(F.flatten(F.collect_list("_lengths"))).alias("_lengths"))
    r = r.join(known, ["channel_id", "_text"]).withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("recv"))))
    return r.drop("_lengths", "_text")


def prefix_pairs(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """Pairs on one channel whose received payload starts with the sent one: joined on the beginnings of the lengths that may_begin() gives."""
    r = may_begin(sends, receives)
    return sends.join(r.withColumn("sent", F.substring(F.col("recv"), F.lit(1), F.col("_n"))).drop("_n"), ["channel_id", "sent"])


def child_channels(events: DataFrame, links: DataFrame) -> DataFrame:
    """events with channel ids of accepted sockets: links(trace, parent, child) hand the parent's id to the child."""
    known = events.where("type = 'open' AND channel_id IS NOT NULL").groupBy("trace", "handle").agg(F.min_by("channel_id", "line").alias("_id"))
    inherited = links.join(known.withColumnRenamed("handle", "parent"), ["trace", "parent"]).select("trace", F.col("child").alias("handle"), F.col("_id").alias("_inherited"))
    return events.join(inherited, ["trace", "handle"], "left").withColumn("channel_id", F.coalesce("channel_id", "_inherited")).drop("_inherited")


def latest_opens(events: DataFrame) -> DataFrame:
    """Close events (trace, handle, close_line, open_line) with the latest open of their handle before them, or null: a scan instead of a range join."""
    e = scans(_bounds(events), "_at", {"open_line": _last_line("open")}, HANDLE)
    return e.where("type = 'close'").select(*HANDLE, F.col("line").alias("close_line"), "open_line")


def socket_streams(events: DataFrame) -> DataFrame:
    """(trace, handle, open_line, channel_id): streams of sockets, from events(trace, handle, line, type, address, child).

    A `socket` opens a stream of its handle, named by the first `bind` or `connect` after it; an `accept`
    opens one of its child handle, which takes the name that the listening socket has by then.
    Sockets that are never bound or connected have no name.
    """
    e = events.where("type IN ('socket', 'bind', 'connect', 'accept')")
    e = settled(scans(e, "line", {"_open": _last_line("socket")}, HANDLE))
    opened = F.when(F.col("type") == "socket", F.col("line")).otherwise(F.col("_open")).alias("open_line")
    names = F.min(F.when(F.col("type").isin("bind", "connect"), F.struct("line", "address"))).alias("_name")
    name = e.where("type <> 'accept'").groupBy(*HANDLE, opened).agg(names).where("open_line IS NOT NULL")
    name = name.select(*HANDLE, "open_line", F.col("_name.line").alias("_at"), F.col("_name.address").alias("channel_id"))
    sockets = name.drop("_at")
    accepts = e.where("type = 'accept' AND _open IS NOT NULL").select(*HANDLE, "line", "child", F.col("_open").alias("open_line"))
    # a name given after the accept is not the child's
    accepted = accepts.join(name, [*HANDLE, "open_line"], "left").select("trace", F.col("child").alias("handle"), F.col("line").alias("open_line"), F.when(F.col("_at") < F.col("line"), F.col("channel_id")).alias("channel_id"))
    return sockets.unionByName(accepted)


def carried_buffers(events: DataFrame) -> DataFrame:
    """Check events with the buffer that their handle's last receive before them named: (…, buffer, buffer_length) or null."""
    held = F.when(F.col("type") == "receive", F.struct("address", "length"))
    e = scan(events.where("type IN ('receive', 'check')"), "line", held, "_held", "last", HANDLE).where("type = 'check'")
    return e.select(*HANDLE, "line", F.col("_held.address").alias("buffer"), F.col("_held.length").alias("buffer_length"))


def ended_opens(events: DataFrame) -> DataFrame:
    """(trace, handle, open_line, end_line): a stream from every open, in passes and not in line order.

    Each close ends the latest stream of its handle that was opened before its line, and takes the place of an earlier
    close of that stream: the end is the last close before the next open. Streams that no close ends have a null end.
    """
    ends = latest_opens(events).where("open_line IS NOT NULL").select(*HANDLE, "open_line", F.col("close_line").alias("end_line"))
    opens = events.where("type = 'open'").select(*HANDLE, F.col("line").alias("open_line"), F.lit(None).cast("long").alias("end_line"))
    return opens.unionByName(ends).groupBy(*HANDLE, "open_line").agg(F.max("end_line").alias("end_line"))


def assigned(events: DataFrame) -> DataFrame:
    """Data events with the open_line of their stream: of those of ended_opens() that are open at the event's line, the last opened.

    A stream is open behind its open and before its end. A later open of the handle bounds the end of all streams before it, so an event
    belongs to the last stream opened before it, if that one is open, and else to the last one before it that never ended. Both are carried
    to the event in one scan over the handle's opens and data. Events without a stream go.
    """
    state = F.struct(F.col("open_line").alias("at"), F.col("end_line").alias("end"))
    marks = ended_opens(events).select(*HANDLE, F.col("open_line").alias("line"), state.alias("_mark"))
    data = events.where("type NOT IN ('open', 'close')")
    # an event on an open's own line stands before it
    both = data.unionByName(marks, allowMissingColumns=True).withColumn("_at", F.col("line") * 2 + F.col("_mark").isNotNull().cast("int"))
    endless = F.when(F.col("_mark.end").isNull(), F.col("_mark.at"))
    both = scans(settled(both), "_at", {"_last": (F.col("_mark"), "last"), "_endless": (endless, "last")}, HANDLE).where("_mark IS NULL")
    open_now = F.col("_last.end").isNull() | (F.col("_last.end") > F.col("line"))
    both = both.withColumn("open_line", F.when(F.col("_last").isNotNull() & open_now, F.col("_last.at")).otherwise(F.col("_endless")))
    return both.where("open_line IS NOT NULL").drop("_mark", "_at", "_last", "_endless")


def successful(events: DataFrame) -> DataFrame:
    """Opens, closes, and the data events whose call returned something: those whose result (hex) has a low half of zero or is null go."""
    return events.where(F.col("type").isin("open", "close") | succeeded(F.col("result")))


def signed16(c: Column) -> Column:
    """The low 16 bits of a number, signed."""
    low = F.pmod(c, F.lit(65536))
    return F.when(low >= 32768, low - 65536).otherwise(low)


def named_messages(creates: DataFrame, messages: DataFrame, unnamed: bool = False) -> DataFrame:
    """messages(trace, id, line, message) with the name of the channel last created under their id before them; others go, or stay if `unnamed`.

    Ids count as signed 16-bit numbers. creates: (trace, id, line, name).
    """
    key = signed16(F.col("id")).alias("_id")
    c = creates.select("trace", key, "line", F.col("name").alias("_name"), F.lit(0).alias("_order"))
    m = messages.select("trace", key, "line", "id", "message", F.lit(1).alias("_order"))
    # a creation on a message's own line stands behind it
    both = m.unionByName(c, allowMissingColumns=True).withColumn("_at", F.col("line") * 2 + (1 - F.col("_order")))
    both = scan(both, "_at", F.col("_name"), "channel_name", "last", ("trace", "_id"))
    named = both.where("_order = 1") if unnamed else both.where("_order = 1 AND channel_name IS NOT NULL")
    return named.select("trace", "id", "line", "message", "channel_name")


def message_matches(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """Pairs of sends and receives, both from named_messages, on equal channel names whose received message starts with the sent one (prefix_pairs)."""
    s = settled(sends.select(F.col("channel_name").alias("channel_id"), F.col("id").alias("send_id"), F.col("line").alias("send_line"), F.col("message").alias("sent")))
    r = settled(receives.select(F.col("channel_name").alias("channel_id"), F.col("id").alias("recv_id"), F.col("line").alias("recv_line"), F.col("message").alias("recv")))
    return prefix_pairs(s, r).select(F.col("channel_id").alias("channel_name"), "send_id", "send_line", "recv_id", "recv_line")
