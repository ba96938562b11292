"""Data lineage from tool results to peer messages by byte shingles.

Which tagged value a message sees first is decided without pairing messages with all values that share a shingle: for
every (run, shingle) one row names the earliest tagged value. A message looks that row up, and the value counts if it was
tagged before the message, so a shingle that occurs everywhere costs one row per occurrence and no more.

Both sides are thinned before anything is shuffled: a window is looked at only where a gram that its content selects (``functions.winnow``) was
selected on the other side too. Equal windows select equal grams, so nothing is lost, and about one row in seven bytes is made
where values and messages share nothing.

A run remembers all it tagged (within ``ttl``, if given). ``max_per_run`` bounds the memory to a run's last values, as
a small sensor does; then values are numbered per run and the lookup is cut into blocks of numbers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.asof import broadcast_if_small, carry_last, running_count, running_sum
from tracewarden.functions.text import normalize_array, plain_views, shingles, truncate_bytes
from tracewarden.functions.winnow import anchors, windows_around
from tracewarden.schema import FINDING

TTL = dt.timedelta(hours=2)
#: bytes of a tagged value that hits quote; None quotes it whole
SAMPLE_BYTES: int | None = None
MIN_CANDIDATE = 16
#: largest set of tagged windows that is sent to all tasks as a filter
PREFILTER_BYTES = 64 << 20


def numbered(taints: DataFrame) -> DataFrame:
    """Add ``taint_no``: the 1-based number of each tagged value within its run, in order of time and id.

    What earlier times contribute comes from one row per distinct (run, time); only values of one run and
    instant are sorted together.
    """
    if "taint_no" in taints.columns:
        return taints
    per_time = taints.groupBy("agent_run_id", "ts").agg(F.count("*").alias("_here"))
    earlier = running_sum(per_time, ["agent_run_id"], ["ts"], F.col("_here"), "_n").select("agent_run_id", "ts", "_n")
    at_once = Window.partitionBy("agent_run_id", "ts").orderBy("taint_id")
    return taints.withColumn("_r", F.row_number().over(at_once)).join(earlier, ["agent_run_id", "ts"]).withColumn(
        "taint_no", F.col("_n") + F.col("_r")).drop("_n", "_r")


def taint_tags(messages: DataFrame, exclude_blocked: bool = False) -> DataFrame:
    """Tagged values of outbound tools/call results: one row per non-blank ``result*`` leaf.

    Needs ``msg_id, agent_run_id, ts, method, direction, fields``; takes the tool from ``tool``
    when the request was joined in, and skips blocked messages on request.
    """
    rows = messages.where(
        (F.col("method") == "tools/call") & (F.col("direction") == "outbound")
        & (F.coalesce("agent_run_id", F.lit("")) != ""))
    if exclude_blocked:
        rows = rows.where(F.col("action") != "block")
    tool = F.col("tool") if "tool" in messages.columns else F.lit("")
    leaves = rows.select(
        "msg_id", "agent_run_id", "ts", tool.alias("tool"), F.posexplode("fields").alias("_pos", "_f")
    ).where(F.col("_f.name").startswith("result") & (F.trim(F.col("_f.value")) != ""))
    tagged = leaves.select(
        "agent_run_id", "ts",
        F.concat(F.lit("t-"), F.format_string("%s-%05d", F.col("msg_id").cast("string"), "_pos")).alias("taint_id"),
        F.lit("mcp").alias("protocol"), F.lit("tools/call").alias("method"), "tool",
        F.col("_f.name").alias("field"), F.col("_f.value").alias("value"),
        truncate_bytes(F.col("_f.value"), SAMPLE_BYTES).alias("sample"))
    return tagged


def live_taints(taints: DataFrame, max_per_run: int | None = None) -> DataFrame:
    """Tagged values a run still remembers at the end of the table."""
    if not max_per_run:
        return taints
    taints = numbered(taints)
    last = taints.groupBy("agent_run_id").agg(F.max("taint_no").alias("_last"))
    return taints.join(last, "agent_run_id").where(F.col("taint_no") > F.col("_last") - max_per_run).drop("_last")


def taint_stats(taints: DataFrame) -> DataFrame:
    return taints.agg(F.count_distinct("agent_run_id").alias("runs"), F.count("*").alias("taints"))


def sweep_taints(taints: DataFrame, as_of: dt.datetime, ttl: dt.timedelta = TTL) -> DataFrame:
    """Drop runs whose newest tagged value is older than the TTL.

    The newest time per run is a partial aggregate joined back, not a window, so a run that holds a
    large part of the table stays spread out.
    """
    kept = taints.groupBy("agent_run_id").agg(F.max("ts").alias("_newest")).where(
        F.col("_newest") >= F.lit(as_of - ttl)).select("agent_run_id")
    return taints.join(kept, "agent_run_id", "left_semi")


def _anchored(df: DataFrame, value: str, *keep: str) -> DataFrame:
    """(kept columns, _h, _around) rows of all canonical views of ``value``: hash of run and kept gram, bytes around it."""
    # outer: a plain explode adds a filter on its array, for which the Python functions would run a second time
    # payloads have a column of their own, or each of the three places that normalizing reads them from would decode them again
    decoded = df.select(*keep, plain_views(F.col(value)).alias("_plain"))
    views = decoded.select(*keep, F.explode_outer(normalize_array("_plain")).alias("_view"))
    placed = views.select(*keep, anchors("_view").alias("_anchors")).select(*keep, F.explode_outer("_anchors").alias("_a")).where("_a is not null")
    return placed.select(*keep, F.xxhash64("agent_run_id", "_a.gram").alias("_h"), F.col("_a.around").alias("_around"))


def _expanded(anchored: DataFrame) -> DataFrame:
    """All windows around the kept grams that are left."""
    keep = [c for c in anchored.columns if c not in ("_h", "_around")]
    return anchored.select(*keep, F.explode(windows_around("_around")).alias("_win"))


def _first_tagged(windows: DataFrame, key: str) -> DataFrame:
    """(run, window) -> the tagged value that came first."""
    return windows.groupBy("agent_run_id", key).agg(F.min(F.struct("ts", "taint_id")).alias("_first"))


def _lookup(windows: DataFrame, key: str, max_per_run: int) -> DataFrame:
    """(run, window, block) -> which live taint number comes first for a message in the block.

    A message that follows N tagged values sees numbers N-max+1..N. Blocks are ``max`` numbers
    wide: ``_old`` are the numbers of the previous block (they go out of sight one by one),
    ``_new`` is the first number of the block itself.
    """
    own = F.floor(F.col("taint_no") / max_per_run)
    placed = windows.select("agent_run_id", key, "taint_no", F.explode(F.array(
        F.struct(own.alias("b"), F.lit(False).alias("old")),
        F.struct((own + 1).alias("b"), F.lit(True).alias("old")))).alias("_p"))
    return placed.groupBy("agent_run_id", key, F.col("_p.b").alias("_block")).agg(
        F.array_sort(F.collect_set(F.when(F.col("_p.old"), F.col("taint_no")))).alias("_old"),
        F.min(F.when(~F.col("_p.old"), F.col("taint_no"))).alias("_new"))


def _seen_before(messages: DataFrame, taints: DataFrame) -> DataFrame:
    """(run, ts, n): how many values the run had tagged strictly before each time at which it sent messages."""
    times = messages.select("agent_run_id", "ts").distinct().withColumn("_here", F.lit(0).cast("bigint"))
    tagged = taints.groupBy("agent_run_id", "ts").agg(F.count("*").alias("_here"))
    per_time = times.unionByName(tagged).groupBy("agent_run_id", "ts").agg(F.sum("_here").alias("_here"))
    return running_sum(per_time, ["agent_run_id"], ["ts"], F.col("_here"), "_n").select("agent_run_id", "ts", "_n")


def _first_hits(found: DataFrame, messages: DataFrame, taints: DataFrame, tagged: DataFrame, key: str,
                max_per_run: int | None) -> DataFrame:
    """First (field, taint) per message from (msg_id, run, ts, field position, key) occurrences."""
    columns = ["agent_run_id", "taint_id", "protocol", "method", "tool", "field", "sample"]
    if not max_per_run:
        hits = found.join(_first_tagged(tagged, key), ["agent_run_id", key]).where(F.col("_first.ts") < F.col("ts"))
        first = hits.groupBy("msg_id", "agent_run_id").agg(F.min(F.struct("_fpos", "_first")).alias("_h"))
        return first.select("msg_id", "agent_run_id", F.col("_h._first.taint_id").alias("taint_id")).join(taints.select(*columns), ["agent_run_id", "taint_id"])
    placed = found.join(_seen_before(messages, taints), ["agent_run_id", "ts"]).withColumn("_block", F.floor(F.col("_n") / max_per_run))
    fresh = F.when(F.col("_new") <= F.col("_n"), F.col("_new"))
    live = F.coalesce(F.get(F.filter("_old", lambda r: r > F.col("_n") - max_per_run), F.lit(0)), fresh)
    hits = placed.join(_lookup(tagged, key, max_per_run), ["agent_run_id", key, "_block"]).withColumn("taint_no", live).where(
        F.col("taint_no").isNotNull())
    first = hits.groupBy("msg_id", "agent_run_id").agg(F.min(F.struct("_fpos", "taint_no")).alias("_h"))
    return first.select("msg_id", "agent_run_id", F.col("_h.taint_no").alias("taint_no")).join(
        taints.select("taint_no", *columns), ["agent_run_id", "taint_no"])


def allowed_out(messages: DataFrame, allowed_peers: DataFrame | list[str] | None) -> DataFrame:
    """Drop messages to peers that may receive tagged data."""
    if allowed_peers is None:
        return messages
    if isinstance(allowed_peers, list):
        return messages.where(~F.coalesce("counterparty", F.lit("")).isin(*allowed_peers)) if allowed_peers else messages
    peers = broadcast_if_small(allowed_peers.select("counterparty").distinct())
    return messages.join(peers, "counterparty", "left_anti")


def leak_hits(messages: DataFrame, taints: DataFrame, max_per_run: int | None = None) -> DataFrame:
    """Messages (``msg_id, agent_run_id, ts, fields``) that repeat tagged data, with the value hit first."""
    run = messages.where(F.coalesce("agent_run_id", F.lit("")) != "")
    leaves = run.select("msg_id", "agent_run_id", "ts", F.posexplode("fields").alias("_fpos", "_f")).where(
        F.octet_length(F.col("_f.value")) >= MIN_CANDIDATE
    ).select("msg_id", "agent_run_id", "ts", "_fpos", F.col("_f.value").alias("_value"))
    if max_per_run:
        taints = numbered(taints)
    tagged = _anchored(taints, "value", "agent_run_id", "ts", "taint_id", *(["taint_no"] if max_per_run else []))
    candidates = _anchored(leaves, "_value", "msg_id", "agent_run_id", "ts", "_fpos")
    # grams nobody tagged are dropped before any shuffle when the tagged values are provably small: a value has no more grams than bytes
    size = taints.agg(F.sum(F.octet_length("value")).alias("b")).first()["b"] or 0
    small = 16 * size <= PREFILTER_BYTES
    known = tagged.select("_h").distinct()
    candidates = candidates.join(F.broadcast(known) if small else known, "_h", "left_semi")
    if not small:  # a small side is cheaper to expand as it is than messages are to read a second time
        tagged = tagged.join(candidates.select("_h").distinct(), "_h", "left_semi")
    return _first_hits(_expanded(candidates), run.select("msg_id", "agent_run_id", "ts"), taints, _expanded(tagged), "_win", max_per_run)


def leak_finding() -> Column:
    """The finding of a leak row that carries ``counterparty``."""
    peer = F.coalesce("counterparty", F.lit(""))
    text = F.concat(
        F.lit("tainted data from "), "protocol", F.lit(":"), "method",
        F.when(F.col("tool") != "", F.concat(F.lit("("), "tool", F.lit(")"))).otherwise(F.lit("")),
        F.lit(" reached A2A counterparty"), F.when(peer != "", F.concat(F.lit(" "), peer)).otherwise(F.lit("")))
    return F.struct(
        F.lit("taint.cross_protocol_leak").alias("rule_id"), F.lit("policy").alias("category"),
        F.lit("high").alias("severity"), text.alias("description"), F.col("sample").alias("match"),
        F.col("field").alias("field"), F.lit(0.95).alias("confidence"),
        F.create_map(
            F.lit("taint_id"), F.col("taint_id"), F.lit("counterparty"), peer,
            F.lit("source"), F.to_json(F.struct("protocol", "method", "tool", "field"))).alias("metadata")).cast(FINDING)


def taint_leaks(messages: DataFrame, taints: DataFrame, allowed_peers: DataFrame | list[str] | None = None,
                max_per_run: int | None = None, ttl: dt.timedelta | None = None) -> DataFrame:
    """Leaks of tagged data to peers outside the allow-list: the finding and the forced block."""
    rows = allowed_out(messages, allowed_peers)
    if ttl is not None:
        rows, taints = _split_epochs(rows, taints, ttl)
    hits = leak_hits(rows, taints, max_per_run)
    peers = rows.select("msg_id", F.coalesce("counterparty", F.lit("")).alias("counterparty"))
    out = hits.join(peers, "msg_id").select(
        "msg_id", "agent_run_id", "counterparty", "taint_id", F.col("field").alias("taint_field"), "sample",
        leak_finding().alias("finding"), F.lit("block").alias("action"))
    return out.withColumn("agent_run_id", F.regexp_replace("agent_run_id", "\x1f[0-9]+$", "")) if ttl is not None else out


def _split_epochs(messages: DataFrame, taints: DataFrame, ttl: dt.timedelta) -> tuple[DataFrame, DataFrame]:
    """Cut each run where it tagged nothing for longer than the TTL: older values are forgotten there."""
    micros = int(ttl.total_seconds() * 1_000_000)
    gap = carry_last(taints, ["agent_run_id"], ["ts", "taint_id"], {"_prev": F.col("ts")})
    opens = F.col("_prev").isNull() | (F.unix_micros("ts") - F.unix_micros("_prev") > micros)
    marked = gap.withColumn("_opens", opens)
    taint_epochs = running_count(marked, ["agent_run_id"], ["ts", "taint_id"], F.col("_opens"), "_e")
    taint_epochs = taint_epochs.withColumn("_e", F.col("_e") + F.col("_opens").cast("int"))
    stream = messages.select("agent_run_id", "ts", F.lit(0).alias("_kind"), F.col("msg_id").cast("string").alias("_id"),
                             F.lit(None).cast("struct<e:bigint,ts:timestamp>").alias("_t")).unionByName(
        taint_epochs.select("agent_run_id", "ts", F.lit(1).alias("_kind"), F.col("taint_id").alias("_id"),
                            F.struct(F.col("_e").cast("bigint").alias("e"), F.col("ts").alias("ts")).alias("_t")))
    last = carry_last(stream, ["agent_run_id"], ["ts", "_kind", "_id"], {"_last": F.col("_t")}).where(
        (F.col("_kind") == 0) & (F.unix_micros("ts") - F.unix_micros("_last.ts") <= micros)
    ).select("agent_run_id", F.col("_id").alias("_msg"), F.col("_last.e").alias("_e"))
    tag = F.concat("agent_run_id", F.lit("\x1f"), F.col("_e").cast("string"))
    rows = messages.withColumn("_msg", F.col("msg_id").cast("string")).join(last, ["agent_run_id", "_msg"]).withColumn(
        "agent_run_id", tag).drop("_e", "_msg")
    # numbers restart with the epoch; only their order and distance matter
    return rows, taint_epochs.withColumn("agent_run_id", tag).drop("_prev", "_opens", "_e")


def register_fingerprints(taints: DataFrame) -> DataFrame:
    """What may leave a producer: source, sample and fingerprints, no values."""
    return taints.select("agent_run_id", "ts", "taint_id", *(["taint_no"] if "taint_no" in taints.columns else []), "protocol", "method", "tool", "field", "sample",
                         shingles("value").alias("fingerprints"))


def match_fingerprints(messages: DataFrame, registered: DataFrame, max_per_run: int | None = None) -> DataFrame:
    """Same answer as ``leak_hits`` from fingerprints alone.

    Messages carry ``fingerprints`` (array<array<string>>, one array per candidate value).
    """
    # outer: a plain explode adds a filter on its array, for which all fingerprints would be made a second time
    found = messages.select("msg_id", "agent_run_id", "ts", F.posexplode_outer("fingerprints").alias("_fpos", "_fps")).select(
        "msg_id", "agent_run_id", "ts", "_fpos", F.explode_outer("_fps").alias("_fp")).where("_fp is not null")
    if max_per_run:
        registered = numbered(registered)
    tagged = registered.select("agent_run_id", "ts", "taint_id", *(["taint_no"] if max_per_run else []), F.explode_outer("fingerprints").alias("_fp")).where("_fp is not null")
    return _first_hits(found, messages.select("msg_id", "agent_run_id", "ts"), registered, tagged, "_fp", max_per_run)
