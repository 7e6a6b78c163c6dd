"""Session files of seven tools as the relation of messages, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterglass.functions.names import agent_name, custom_model, default_model, provider_of
from meterglass.functions.values import millis_of_csv_date, millis_of_rfc3339, money, whole
from meterglass.operators.reports import cost_to_you
from meterglass.schema import COLUMNS, MESSAGES
from meterglass.sources.files import PLACES, decoded, messages, roots, stem, texts

USAGE = "struct<input_tokens: bigint, output_tokens: bigint, cached_input_tokens: bigint, cache_read_input_tokens: bigint>"


def opencode(spark: SparkSession, root: str | list[str]) -> DataFrame:
    return opencode_messages(texts(spark, root, PLACES["opencode"].pattern)).select(*COLUMNS)


def opencode_messages(files: DataFrame) -> DataFrame:
    """One message per file: assistant's, with model and tokens. It states its own cost."""
    schema = (
        "id string, sessionID string, role string, modelID string, providerID string, cost double, agent string, mode string,"
        " tokens struct<input: bigint, output: bigint, reasoning: bigint, cache: struct<read: bigint, write: bigint>>,"
        " time struct<created: double, completed: double>"
    )
    rows = decoded(files, schema).select("path", "r.*")
    required = ("id", "sessionID", "modelID", "time.created", "tokens.input", "tokens.output", "tokens.cache.read", "tokens.cache.write")
    rows = rows.filter("role = 'assistant'")
    for c in required:
        rows = rows.filter(F.col(c).isNotNull())
    return messages(
        rows,
        source="opencode",
        model_id=F.col("modelID"),
        provider_id=F.coalesce("providerID", F.lit("unknown")),
        session_id=F.col("sessionID"),
        timestamp_ms=F.col("time.created").cast("bigint"),
        input=F.col("tokens.input"),
        output=F.col("tokens.output"),
        cache_read=F.col("tokens.cache.read"),
        cache_write=F.col("tokens.cache.write"),
        reasoning=F.col("tokens.reasoning"),
        cost=F.col("cost"),
        agent=agent_name(F.coalesce("mode", "agent")),
    )


def claude(spark: SparkSession, root: str | list[str]) -> DataFrame:
    return claude_messages(texts(spark, root, PLACES["claude"].pattern, whole=False)).select(*COLUMNS)


def claude_messages(rows: DataFrame) -> DataFrame:
    """A message per assistant line with model, usage and a time; lines that repeat count again."""
    usage = "struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>"
    schema = f"type string, timestamp string, message struct<model: string, usage: {usage}>"
    rows = decoded(rows, schema)
    rows = rows.withColumn("ms", millis_of_rfc3339(F.col("r.timestamp")))
    rows = rows.filter("r.type = 'assistant' and r.message.model is not null and r.message.usage is not null and ms <> 0")
    used = "r.message.usage."
    return messages(
        rows,
        source="claude",
        model_id=F.col("r.message.model"),
        provider_id="anthropic",
        session_id=stem(F.col("path")),
        timestamp_ms=F.col("ms"),
        input=F.col(used + "input_tokens"),
        output=F.col(used + "output_tokens"),
        cache_read=F.col(used + "cache_read_input_tokens"),
        cache_write=F.col(used + "cache_creation_input_tokens"),
    )


def lines(spark: SparkSession, root: str | list[str], pattern: str) -> DataFrame:
    """path, pos, value, split: a file's lines and their places, which grow along the file.

    A large file is read in blocks by many tasks, which ``split`` tells; a place is the block's start and
    a number that grows within it.
    """
    rows = texts(spark, root, pattern, whole=False)
    return rows.withColumn("pos", F.struct("block", F.monotonically_increasing_id().alias("n")))


def usage_deltas(events: DataFrame, file: str = "path", pos: str = "pos", block: Column | None = None, split: Column | None = None) -> DataFrame:
    """What each event of a running log used, from its own usage or from running totals.

    ``events`` has, per file and position: sets_model (bool), model, is_usage (bool), last and total,
    structs of input, output and cached. The model is that of the last event that set one, also to
    none. An event's use is ``last``, else the growth of ``total`` over the latest total known, which
    counts only once an event with both has been seen; without either it is dropped, as are uses of
    nothing.

    A log is one task's work, unless ``block`` says in which part of it an event lies; parts follow each
    other as their events do. What a part leaves behind, the model set last, the latest total and whether
    both were seen, is summed up first; those few rows are scanned along each log; then every part is
    worked on by itself from what comes to it. ``split`` tells logs of more than one part, all if None:
    the others are summed up for nothing.
    """
    usage = F.col("is_usage")
    set_ = F.when(F.col("sets_model"), F.struct("model"))
    total = F.when(usage, F.col("total"))
    both = F.when(usage & F.col("last").isNotNull() & F.col("total").isNotNull(), 1)
    keys = [file]
    came = {"came_model": F.lit(None).cast("struct<model: string>"), "came_total": F.lit(None).cast(events.schema["total"].dataType), "came_armed": F.lit(None).cast("int")}
    if block is None:
        rows = events.withColumns(came)
    else:
        keys = [file, "part"]
        rows = events.withColumn("part", block)
        whole = rows if split is None else rows.filter(split)
        latest = lambda v: F.max(F.when(v.isNotNull(), F.struct(F.col(pos).alias("at"), v.alias("v"))))
        left = whole.groupBy(*keys).agg(latest(set_).alias("m"), latest(total).alias("t"), F.max(both).alias("b"))
        along = Window.partitionBy(file).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        carried = lambda c: F.last(F.col(c), ignorenulls=True).over(along)
        left = left.select(F.col(file).alias("f"), F.col("part").alias("p"), carried("m")["v"].alias("came_model"), carried("t")["v"].alias("came_total"), F.max("b").over(along).alias("came_armed"))
        rows = rows.join(left, F.col(file).eqNullSafe(F.col("f")) & F.col("part").eqNullSafe(F.col("p")), "left").drop("f", "p")
    order = Window.partitionBy(*keys).orderBy(pos)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "current": F.coalesce(F.last(set_, ignorenulls=True).over(upto), F.col("came_model")),
            "known": F.coalesce(F.last(total, ignorenulls=True).over(before), F.col("came_total")),
            "armed": F.coalesce(F.max(both).over(before), F.col("came_armed"), F.lit(0)) == 1,
        }
    ).filter(usage)
    grown = F.when(
        F.col("armed") & F.col("total").isNotNull() & F.col("known").isNotNull(),
        F.struct(*[F.greatest(F.col(f"total.{k}") - F.col(f"known.{k}"), F.lit(0)).alias(k) for k in ("input", "output", "cached")]),
    )
    rows = rows.withColumn("used", F.coalesce("last", grown)).filter("used is not null")
    rows = rows.filter("used.input <> 0 or used.output <> 0 or used.cached <> 0")
    return rows.drop(*came, *keys[1:]).withColumn("model_id", F.coalesce("current.model", F.lit("unknown")))


def codex_events(kept: DataFrame) -> DataFrame:
    """Lines (path, pos, value) as events that ``usage_deltas`` takes, with their timestamp; further columns go along.

    Only two types of events count; a line without either word is never decoded or ordered.
    """
    info = f"struct<model: string, model_name: string, last_token_usage: {USAGE}, total_token_usage: {USAGE}>"
    schema = f"type string, timestamp string, payload struct<type: string, model: string, model_name: string, info: {info}>"
    others = [c for c in kept.columns if c not in ("path", "pos", "value", "block", "modified")]
    kept = kept.filter("contains(value, 'turn_context') or contains(value, 'event_msg')")
    rows = decoded(kept, schema).filter("r.payload is not null")
    p = "r.payload."
    named = F.nullif(F.coalesce(p + "model", p + "model_name", p + "info.model", p + "info.model_name"), F.lit(""))
    in_info = F.coalesce(p + "info.model", p + "info.model_name")
    context = F.col("r.type") == "turn_context"
    counted = (F.col("r.type") == "event_msg") & (F.col(p + "type") == "token_count")

    def struct(name: str) -> Column:
        u = f"{p}info.{name}."
        cached = F.coalesce(u + "cached_input_tokens", u + "cache_read_input_tokens", F.lit(0))
        whole_ = F.struct(
            F.coalesce(u + "input_tokens", F.lit(0)).alias("input"),
            F.coalesce(u + "output_tokens", F.lit(0)).alias("output"),
            cached.alias("cached"),
        )
        return F.when(F.col(u[:-1]).isNotNull(), whole_)

    return rows.filter(F.coalesce(context | counted, F.lit(False))).select(
        "path",
        "pos",
        *others,
        F.col("r.timestamp").alias("timestamp"),
        F.coalesce(context | in_info.isNotNull() | named.isNotNull(), F.lit(False)).alias("sets_model"),
        F.when(context, named).otherwise(F.coalesce(in_info, named)).alias("model"),
        F.coalesce(counted & F.col(p + "info").isNotNull(), F.lit(False)).alias("is_usage"),
        struct("last_token_usage").alias("last"),
        struct("total_token_usage").alias("total"),
    )


def codex_messages(deltas: DataFrame, as_of_ms: int = 0) -> DataFrame:
    """Messages of deltas (path, timestamp, model_id, used); one without a usable time has ``as_of_ms``."""
    return messages(
        deltas,
        source="codex",
        model_id=F.col("model_id"),
        provider_id="openai",
        session_id=stem(F.col("path")),
        timestamp_ms=F.coalesce(millis_of_rfc3339(F.col("timestamp")), F.lit(as_of_ms)),
        input=F.col("used.input"),
        output=F.col("used.output"),
        cache_read=F.col("used.cached"),
    )


def codex(spark: SparkSession, root: str, as_of_ms: int = 0) -> DataFrame:
    """Deltas of token_count events. A log that is read in several blocks is worked on by block."""
    return codex_of_lines(lines(spark, root, PLACES["codex"].pattern), as_of_ms).select(*COLUMNS)


def codex_of_lines(rows: DataFrame, as_of_ms: int = 0) -> DataFrame:
    deltas = usage_deltas(codex_events(rows), block=F.col("pos.block"), split=F.col("split"))
    return codex_messages(deltas, as_of_ms)


def gemini(spark: SparkSession, root: str | list[str]) -> DataFrame:
    return gemini_messages(texts(spark, root, PLACES["gemini"].pattern)).select(*COLUMNS)


def gemini_messages(rows: DataFrame) -> DataFrame:
    """Messages of type gemini with tokens, model and time, of documents that decode as a whole."""
    tokens = "struct<input: bigint, output: bigint, cached: bigint, thoughts: bigint, tool: bigint, total: bigint>"
    schema = (
        "sessionId string, projectHash string, startTime string, lastUpdated string,"
        f" messages array<struct<id: string, type: string, timestamp: string, content: string, model: string, tokens: {tokens}>>"
    )
    content = F.try_variant_get(F.try_parse_json("value"), "$.messages", "array<struct<content: variant>>")
    strange = F.exists(content, lambda m: ~F.schema_of_variant(m["content"]).isin("STRING", "VOID"))
    rows = decoded(rows.filter(~F.coalesce(strange, F.lit(False))), schema)
    rows = rows.filter(
        "r.sessionId is not null and r.projectHash is not null and r.startTime is not null and r.lastUpdated is not null"
        " and r.messages is not null and not exists(r.messages, m -> m.id is null or m.type is null)"
    )
    rows = rows.select("path", "r.sessionId", F.explode("r.messages").alias("m"))
    rows = rows.withColumn("ms", millis_of_rfc3339(F.col("m.timestamp")))
    rows = rows.filter("m.type = 'gemini' and m.tokens is not null and m.model is not null and ms <> 0")
    return messages(
        rows,
        source="gemini",
        model_id=F.col("m.model"),
        provider_id="google",
        session_id=F.col("sessionId"),
        timestamp_ms=F.col("ms"),
        input=F.col("m.tokens.input"),
        output=F.col("m.tokens.output"),
        cache_read=F.col("m.tokens.cached"),
        reasoning=F.col("m.tokens.thoughts"),
    )


def first_kind(preferred: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """All of ``preferred``, and of ``fallback`` the rows whose key ``preferred`` lacks."""
    return preferred.unionByName(fallback.join(preferred.select(key).distinct(), key, "left_anti").select(preferred.columns))


def amp(spark: SparkSession, root: str | list[str]) -> DataFrame:
    return amp_messages(texts(spark, root, PLACES["amp"].pattern)).select(*COLUMNS)


def amp_messages(files: DataFrame) -> DataFrame:
    """A thread's ledger events; the usage of its messages only where the ledger has no usable event."""
    tokens = "struct<input: bigint, output: bigint, cacheReadInputTokens: bigint, cacheCreationInputTokens: bigint>"
    usage = "struct<model: string, inputTokens: bigint, outputTokens: bigint, cacheReadInputTokens: bigint, cacheCreationInputTokens: bigint, credits: double>"
    schema = (
        "id string, created bigint,"
        f" usageLedger struct<events: array<struct<timestamp: string, model: string, credits: double, tokens: {tokens}>>>,"
        f" messages array<struct<role: string, messageId: bigint, usage: {usage}>>"
    )
    rows = decoded(files, schema)
    rows = rows.select("path", F.coalesce("r.id", stem(F.col("path"))).alias("thread"), "r.created", "r.usageLedger", "r.messages")
    events = rows.select("path", "thread", F.explode("usageLedger.events").alias("e"))
    events = events.withColumn("ms", millis_of_rfc3339(F.col("e.timestamp"))).filter("e.model is not null and ms <> 0")
    t = "e.tokens."
    ledger = events.select(
        "path", "thread", "ms", F.col("e.model").alias("model"), F.col(t + "input").alias("input"), F.col(t + "output").alias("output"),
        F.col(t + "cacheReadInputTokens").alias("read"), F.col(t + "cacheCreationInputTokens").alias("write"), F.col("e.credits").alias("credits"),
    )
    said = rows.select("path", "thread", "created", F.explode("messages").alias("m"))
    said = said.filter("m.role = 'assistant' and m.usage.model is not null")
    ms = F.coalesce("created", F.lit(0)) + F.coalesce("m.messageId", F.lit(0)) * 1000
    u = "m.usage."
    spoken = said.select(
        "path", "thread", ms.alias("ms"), F.col(u + "model").alias("model"), F.col(u + "inputTokens").alias("input"), F.col(u + "outputTokens").alias("output"),
        F.col(u + "cacheReadInputTokens").alias("read"), F.col(u + "cacheCreationInputTokens").alias("write"), F.col(u + "credits").alias("credits"),
    )
    both = first_kind(ledger, spoken, "path")
    return messages(
        both,
        source="amp",
        model_id=F.col("model"),
        provider_id=provider_of(F.col("model"), "amp"),
        session_id=F.col("thread"),
        timestamp_ms=F.col("ms"),
        input=F.col("input"),
        output=F.col("output"),
        cache_read=F.col("read"),
        cache_write=F.col("write"),
        cost=F.col("credits"),
    )


def droid(spark: SparkSession, root: str | list[str]) -> DataFrame:
    return droid_messages(texts(spark, root, PLACES["droid"].pattern), lines(spark, root, "*.jsonl")).select(*COLUMNS)


#: A log names the session's model in so many of its first lines, or not at all.
FIRST_LINES = 500


def first_named(logs: DataFrame) -> DataFrame:
    """path, named: the model that a log (path, pos, value) names first, in its first lines.

    Lines are counted block by block, and only those that name a model are looked at: none is put in order.
    """
    counts = logs.groupBy("path", F.col("pos.block").alias("block")).agg(F.min("pos.n").alias("least"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter(F.col("skip") < FIRST_LINES)
    model = F.trim(F.regexp_extract("value", r'Model:([^\[\\"]*)', 1))
    named = logs.filter("contains(value, 'Model:')").select("path", F.col("pos.block").alias("block"), "pos.n", model.alias("named")).filter("named <> ''")
    named = named.join(counts.select("path", "block", "least", "skip"), ["path", "block"])
    nth = F.col("n") - F.col("least") + F.col("skip")
    return named.withColumn("nth", nth).filter(F.col("nth") < FIRST_LINES).groupBy("path").agg(F.min_by("named", "nth").alias("named"))


def droid_messages(files: DataFrame, logs: DataFrame) -> DataFrame:
    """One message per settings file that used any token.

    Without a model in the settings it is the one that the session's own log names first, in its
    first 500 lines, else the provider's stand-in. Without a usable time it is the file's.
    """
    tokens = "struct<inputTokens: bigint, outputTokens: bigint, cacheCreationTokens: bigint, cacheReadTokens: bigint, thinkingTokens: bigint>"
    schema = f"model string, providerLock string, providerLockTimestamp string, tokenUsage {tokens}"
    rows = decoded(files, schema).filter("r.tokenUsage is not null")
    kinds = ("inputTokens", "outputTokens", "cacheCreationTokens", "cacheReadTokens", "thinkingTokens")
    u = {k: F.coalesce(f"r.tokenUsage.{k}", F.lit(0)) for k in kinds}
    rows = rows.filter(sum(u.values(), F.lit(0)) != 0)
    session = F.replace(stem(F.col("path")), F.lit(".settings"))
    rows = rows.withColumn("log", F.regexp_replace("path", r"\.settings\.json$", ".jsonl"))
    rows = rows.join(first_named(logs).withColumnRenamed("path", "log"), "log", "left")
    provider = F.coalesce("r.providerLock", provider_of(F.col("r.model"), "droid"))
    ms = F.coalesce(millis_of_rfc3339(F.col("r.providerLockTimestamp")), F.col("modified"))
    rows = rows.withColumns({"provider": provider, "ms": ms}).filter("ms <> 0")
    return messages(
        rows,
        source="droid",
        model_id=F.coalesce(custom_model(F.col("r.model")), custom_model(F.col("named")), default_model(F.col("provider"))),
        provider_id=F.col("provider"),
        session_id=session,
        timestamp_ms=F.col("ms"),
        input=u["inputTokens"],
        output=u["outputTokens"],
        cache_read=u["cacheReadTokens"],
        cache_write=u["cacheCreationTokens"],
        reasoning=u["thinkingTokens"],
    )


def csv_rows(rows: DataFrame) -> DataFrame:
    """path, head, f: the fields of the first line and of each further line of the files with Date and Model.

    A field may be quoted and hold commas; fields are trimmed, empty lines left out.
    """
    fields = F.transform(F.split("value", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda f: F.trim(F.replace(F.trim(f), F.lit('"'))))
    heads = rows.groupBy("path").agg(F.min(F.struct("pos", "value")).alias("h")).select("path", "h.*")
    heads = heads.filter("contains(value, 'Date') and contains(value, 'Model')").select("path", F.col("pos").alias("at"), fields.alias("head"))
    rows = rows.filter("trim(value) <> ''").join(heads, "path").filter("pos > at")
    return rows.select("path", "head", fields.alias("f"))


def cursor(spark: SparkSession, root: str | list[str]) -> DataFrame:
    return cursor_messages(lines(spark, root, PLACES["cursor"].pattern)).select(*COLUMNS)


def cursor_messages(rows: DataFrame) -> DataFrame:
    """Rows of exported CSV files of either layout, by position.

    With a Kind column, tokens begin at the fifth field, else at the third. Rows that are short,
    without model or without a usable date are dropped.
    """
    rows = csv_rows(rows)
    rows = rows.withColumn("kind", F.exists("head", lambda h: F.contains(h, F.lit("Kind"))))
    at = F.when(F.col("kind"), 4).otherwise(2)
    rows = rows.filter(F.size("f") > F.when(F.col("kind"), 9).otherwise(7))
    field = lambda i: F.get("f", i)
    with_write, without = whole(field(at)), whole(field(at + 1))
    model = field(F.when(F.col("kind"), 2).otherwise(1))
    rows = rows.withColumns({"model": model, "ms": millis_of_csv_date(field(F.lit(0)))}).filter("model <> '' and ms <> 0")
    return messages(
        rows,
        source="cursor",
        model_id=F.col("model"),
        provider_id=provider_of(F.col("model"), "cursor"),
        session_id=field(F.lit(0)),
        timestamp_ms=F.col("ms"),
        input=without,
        output=whole(field(at + 3)),
        cache_read=whole(field(at + 2)),
        cache_write=F.greatest(with_write - without, F.lit(0)),
        cost=money(field(F.when(F.col("kind"), 9).otherwise(7))),
    )


def cursor_by_name(spark: SparkSession, root: str) -> DataFrame:
    return cursor_messages_by_name(lines(spark, root, PLACES["cursor"].pattern)).select(*COLUMNS)


def cursor_messages_by_name(rows: DataFrame) -> DataFrame:
    """Rows of exported CSV files by the names of their columns, whatever their order and number.

    The cost is what was paid, where that is stated and not 0, else what it would cost. A row without
    a usable date stays, with time 0; one without date or model is dropped.
    """
    rows = csv_rows(rows)
    field = lambda name: F.get("f", (F.array_position("head", name) - 1).cast("int"))
    number = lambda name: whole(F.regexp_extract(F.coalesce(field(name), F.lit("")), r"^[+-]?\d+", 0))
    day = F.coalesce(field("Date"), F.lit(""))
    midnight = F.unix_millis(F.concat(day, F.lit("T00:00:00Z")).try_cast("timestamp"))
    ms = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), midnight).otherwise(millis_of_csv_date(day))
    rows = rows.withColumns({"model": field("Model"), "day": day, "ms": F.coalesce(ms, F.lit(0))}).filter("day <> '' and model <> ''")
    short = F.when(F.col("ms") != 0, F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd")).otherwise(F.substring("day", 1, 10))
    without = number("Input (w/o Cache Write)")
    found = messages(
        rows,
        source="cursor",
        model_id=F.col("model"),
        provider_id=provider_of(F.col("model"), "cursor"),
        session_id=F.concat(F.lit("cursor-"), short, F.lit("-"), F.col("model")),
        timestamp_ms=F.col("ms"),
        input=without,
        output=number("Output Tokens"),
        cache_read=number("Cache Read"),
        cache_write=F.greatest(number("Input (w/ Cache Write)") - without, F.lit(0)),
        cost=cost_to_you(money(field("Cost to you")), money(F.coalesce(field("Cost"), field("API Cost")))),
    )
    stated = F.regexp_extract("session_id", r"^cursor-(\d{4}-\d{2}-\d{2})-", 1).try_cast("date")
    return found.withColumn("date", F.when(F.col("timestamp_ms") == 0, stated).otherwise(F.col("date")))


def by_file(spark: SparkSession, source: str, files: list[str]) -> DataFrame:
    """The messages of some files of a source, with their path; of droid also the sessions' logs are read."""
    pattern = PLACES[source].pattern
    if source == "droid":
        logs = [p.removesuffix(".settings.json") + ".jsonl" for p in files if p.endswith(".settings.json")]
        return droid_messages(texts(spark, files, pattern), lines(spark, logs, "*.jsonl"))
    if source in ("codex", "cursor"):
        return {"codex": codex_of_lines, "cursor": cursor_messages}[source](lines(spark, files, pattern))
    decode = {"opencode": opencode_messages, "claude": claude_messages, "gemini": gemini_messages, "amp": amp_messages}[source]
    return decode(texts(spark, files, pattern, whole=source != "claude"))


READERS = {"opencode": opencode, "claude": claude, "codex": codex, "gemini": gemini, "cursor": cursor, "amp": amp, "droid": droid}


def load_usage(spark: SparkSession, home: str, sources: list[str] | None = None, include_cursor: bool = True, **where) -> DataFrame:
    """Messages of all named sources (None is all) below a home folder."""
    found = None
    for source, root in roots(home, sources, **where).items():
        if source != "cursor" or include_cursor:
            one = READERS[source](spark, root)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], MESSAGES)
    return found
