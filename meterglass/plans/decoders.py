"""The decoders of session files over the table events: its rows are rendered as each tool's files and read back.

Every rendering has records that must not count beside those that must: other roles and types, missing or
mistyped fields, times of several forms. The SQL says what should come out from the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.plans.adapter import usage, with_sql
from meterglass.plans.registry import query
from meterglass.schema import TOKENS
from meterglass.sources import sessions

#: The messages of a day by model, and what tells them apart.
SUMMED = ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in TOKENS)
GROUPS = "source, model_id, provider_id, agent, date"


def summed(messages: DataFrame) -> DataFrame:
    """What was decoded, by day: sums of everything, and the sessions as a distinct count and the smallest."""
    return messages.groupBy(*GROUPS.split(", ")).agg(
        *[F.sum(t).alias(t) for t in TOKENS], F.sum(F.round(F.col("cost") * 1000)).cast("bigint").alias("cost"), F.sum("timestamp_ms").alias("ms"),
        F.count("*").alias("messages"), F.count_distinct("session_id").alias("sessions"), F.min("session_id").alias("session"),
    )


def summed_sql(rows: str) -> str:
    """The same of SQL rows (GROUPS, token kinds, cost in thousandths, timestamp_ms, session_id)."""
    return with_sql("usage", body=f"""SELECT {GROUPS}, {SUMMED}, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(timestamp_ms) AS BIGINT) AS ms, count(*) AS messages,
count(DISTINCT session_id) AS sessions, min(session_id) AS session FROM ({rows}) GROUP BY {GROUPS}""")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with k and user_id, numbers by which renderings vary."""
    rows = usage(spark, sf_dir).withColumns({"k": F.floor(F.col("cost") / 1000), "user_id": F.col("session_id").cast("bigint")})
    return rows.withColumn("at", F.timestamp_millis("timestamp_ms"))


def rfc3339(ms: Column, east: Column) -> Column:
    """A time as UTC, or where ``east`` as of a zone two hours ahead."""
    text = lambda t: F.date_format(F.timestamp_millis(t), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.when(east, F.concat(text(ms + 7_200_000), F.lit("+02:00"))).otherwise(F.concat(text(ms), F.lit("Z")))


def json_of(**fields) -> Column:
    return F.to_json(struct(**fields))


def struct(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def unless(bad: Column, value) -> Column:
    return F.when(~bad, value if isinstance(value, Column) else F.lit(value))


def as_files(rows: DataFrame, path: Column, value: Column) -> DataFrame:
    return rows.select(path.alias("path"), F.lit(1_700_000_000_000).alias("modified"), value.alias("value"))


ZERO = "CAST(NULL AS VARCHAR) AS agent, date"


@query(summed_sql("""SELECT 'opencode' AS source, model_id, CASE WHEN k % 4 = 0 THEN 'unknown' ELSE provider_id END AS provider_id,
  CASE k % 3 WHEN 0 THEN 'Planner-Sisyphus' WHEN 1 THEN 'Sisyphus' END AS agent, date, input, output, cache_read, cache_write, reasoning, k * 250 AS cost, timestamp_ms, session_id
  FROM usage WHERE k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0"""))
def decoded_opencode(spark, sf_dir):
    """A file per message: users' ones, without model, and with a text for a number don't count; mode comes before agent."""
    rows, k = facts(spark, sf_dir), F.col("k")
    tokens = {"output": F.col("output"), "reasoning": F.col("reasoning"), "cache": struct(read=F.col("cache_read"), write=F.col("cache_write"))}
    record = dict(
        id="m", sessionID=F.col("session_id"), role=F.when(k % 7 == 0, "user").otherwise("assistant"), modelID=unless(k % 13 == 0, F.col("model_id")),
        providerID=unless(k % 4 == 0, F.col("provider_id")), cost=k / 4, mode=F.when(k % 3 == 0, "omo-plan"), agent=unless(k % 3 == 2, "OmO"), time=struct(created=F.col("timestamp_ms") + 0.25),
    )
    whole = json_of(**record, tokens=struct(input=F.col("input"), **tokens))
    mistyped = json_of(**record, tokens=struct(input=F.lit("many"), **tokens))
    return summed(sessions.opencode_messages(as_files(rows, F.col("session_id"), F.when(k % 11 == 0, mistyped).otherwise(whole))))


@query(summed_sql(f"""SELECT 'claude' AS source, model_id, 'anthropic' AS provider_id, {ZERO}, input, output, cache_read, cache_write, 0 AS reasoning, 0 AS cost, timestamp_ms, 's-' || session_id AS session_id
  FROM usage WHERE k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0"""))
def decoded_claude(spark, sf_dir):
    """Lines of a log: other types, no model, no usage and days without a time don't count; zones do."""
    rows, k = facts(spark, sf_dir), F.col("k")
    used = struct(input_tokens=F.col("input"), output_tokens=F.col("output"), cache_read_input_tokens=F.col("cache_read"), cache_creation_input_tokens=F.col("cache_write"))
    stamp = F.when(k % 17 == 0, F.date_format("at", "yyyy-MM-dd")).otherwise(rfc3339(F.col("timestamp_ms"), k % 2 == 0))
    message = struct(model=unless(k % 13 == 0, F.col("model_id")), usage=unless(k % 11 == 0, used))
    value = json_of(type=F.when(k % 7 == 0, "user").otherwise("assistant"), timestamp=stamp, message=message, uuid="x")
    return summed(sessions.claude_messages(as_files(rows, F.concat(F.lit("/p/s-"), "session_id", F.lit(".jsonl")), value)))


@query(summed_sql(f"""SELECT 'gemini' AS source, model_id, 'google' AS provider_id, {ZERO}, input, output, cache_read, 0 AS cache_write, reasoning, 0 AS cost, timestamp_ms, session_id
  FROM usage WHERE k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AND user_id % 5 <> 0"""))
def decoded_gemini(spark, sf_dir):
    """A document per session; one without projectHash doesn't count at all, of the others messages of type gemini that are whole."""
    rows, k = facts(spark, sf_dir), F.col("k")
    tokens = struct(input=F.col("input"), output=F.col("output"), cached=F.col("cache_read"), thoughts=F.col("reasoning"), tool=0, total=0)
    message = struct(
        id="m", type=F.when(k % 7 == 0, "user").otherwise("gemini"), timestamp=rfc3339(F.col("timestamp_ms"), k % 3 == 0), content="text",
        model=unless(k % 13 == 0, F.col("model_id")), tokens=unless(k % 11 == 0, tokens),
    )
    docs = rows.groupBy("user_id", "session_id", "date").agg(F.collect_list(message).alias("messages"))
    value = json_of(sessionId=F.col("session_id"), projectHash=unless(F.col("user_id") % 5 == 0, "h"), startTime="t", lastUpdated="t", messages=F.col("messages"))
    return summed(sessions.gemini_messages(as_files(docs, F.col("session_id"), value)))


AMP_PROVIDER = "CASE WHEN regexp_matches(lower(model_id), 'claude|opus|sonnet|haiku') THEN 'anthropic' WHEN regexp_matches(lower(model_id), 'gpt|o1|o3') THEN 'openai' WHEN regexp_matches(lower(model_id), 'gemini') THEN 'google' WHEN regexp_matches(lower(model_id), 'grok') THEN 'xai' ELSE 'anthropic' END"


@query(summed_sql(f"""SELECT 'amp' AS source, model_id, {AMP_PROVIDER} AS provider_id, CAST(NULL AS VARCHAR) AS agent, CAST(to_timestamp(ms // 1000) AS DATE) AS date, input, output, cache_read, cache_write, 0 AS reasoning, k * 250 AS cost, ms AS timestamp_ms, 'T-' || session_id AS session_id
  FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN 1700000000000 + k * 1000 ELSE timestamp_ms END AS ms FROM usage WHERE CASE WHEN user_id % 3 = 0 THEN k % 7 <> 0 ELSE k % 13 <> 0 END)"""))
def decoded_amp(spark, sf_dir):
    """A thread per session: the ledger's events, and its messages' usage only where there is no ledger; names in place of ids."""
    rows, k = facts(spark, sf_dir), F.col("k")
    event = struct(
        timestamp=rfc3339(F.col("timestamp_ms"), k % 2 == 0), model=unless(k % 13 == 0, F.col("model_id")), credits=k / 4,
        tokens=struct(input=F.col("input"), output=F.col("output"), cacheReadInputTokens=F.col("cache_read"), cacheCreationInputTokens=F.col("cache_write")),
    )
    used = struct(model=F.col("model_id"), inputTokens=F.col("input"), outputTokens=F.col("output"), cacheReadInputTokens=F.col("cache_read"), cacheCreationInputTokens=F.col("cache_write"), credits=k / 4)
    message = struct(role=F.when(k % 7 == 0, "user").otherwise("assistant"), messageId=k, usage=used)
    docs = rows.groupBy("user_id", "session_id").agg(F.collect_list(event).alias("events"), F.collect_list(message).alias("messages"))
    thread = F.concat(F.lit("T-"), "session_id")
    value = json_of(id=unless(F.col("user_id") % 2 == 0, thread), created=1_700_000_000_000, usageLedger=unless(F.col("user_id") % 3 == 0, struct(events=F.col("events"))), messages=F.col("messages"))
    return summed(sessions.amp_messages(as_files(docs, F.concat(F.lit("/a/"), thread, F.lit(".json")), value)))


@query(summed_sql("""SELECT 'droid' AS source, CASE k % 4 WHEN 0 THEN 'claude-opus-4-5-0' WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'gpt-5-codex' ELSE
    CASE WHEN provider_id = 'p0' THEN 'claude' WHEN provider_id = 'p1' THEN 'gpt' ELSE 'unknown' END || '-unknown' END ELSE lower(replace(replace(model_id, '.', '-'), '--', '-')) END AS model_id,
  CASE provider_id WHEN 'p0' THEN 'anthropic' WHEN 'p1' THEN 'openai' ELSE CASE k % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'unknown' ELSE
    CASE WHEN regexp_matches(lower(model_id), 'claude|anthropic|opus|sonnet|haiku') THEN 'anthropic' WHEN regexp_matches(lower(model_id), 'gpt|openai|o1|o3') THEN 'openai'
    WHEN regexp_matches(lower(model_id), 'gemini|google') THEN 'google' WHEN regexp_matches(lower(model_id), 'grok') THEN 'xai' ELSE 'unknown' END END END AS provider_id,
  CAST(NULL AS VARCHAR) AS agent, CASE WHEN k % 5 = 0 THEN DATE '2023-11-14' ELSE date END AS date, input, output, cache_read, cache_write, reasoning, 0 AS cost,
  CASE WHEN k % 5 = 0 THEN 1700000000000 ELSE timestamp_ms END AS timestamp_ms, session_id || '-' || timestamp_ms || '-' || k AS session_id
  FROM usage WHERE input + output + cache_read + cache_write + reasoning <> 0 AND k % 11 <> 0"""))
def decoded_droid(spark, sf_dir):
    """A settings file per message, some with the session's log beside it, which names the model; without a time it is the file's."""
    rows, k = facts(spark, sf_dir), F.col("k")
    name = F.concat(F.lit("/d/"), F.concat_ws("-", "session_id", "timestamp_ms", k))
    used = struct(inputTokens=F.col("input"), outputTokens=F.col("output"), cacheCreationTokens=F.col("cache_write"), cacheReadTokens=F.col("cache_read"), thinkingTokens=F.col("reasoning"))
    value = json_of(
        model=F.when(k % 4 == 0, "custom:Claude-Opus-4.5-[Anthropic]-0").when(k % 4 != 1, F.col("model_id")),
        providerLock=F.when(F.col("provider_id") == "p0", "anthropic").when(F.col("provider_id") == "p1", "openai"),
        providerLockTimestamp=unless(k % 5 == 0, rfc3339(F.col("timestamp_ms"), k % 2 == 0)), tokenUsage=unless(k % 11 == 0, used),
    )
    files = as_files(rows, F.concat(name, F.lit(".settings.json")), value)
    # The second line names the model; a third one comes too late, as does one beyond the first lines.
    said = F.array(F.lit('{"type":"start"}'), F.lit('"text":"Model: GPT-5-Codex [x]"'), F.lit("Model: other"))
    logs = rows.filter("k % 3 = 0").select(F.concat(name, F.lit(".jsonl")).alias("path"), F.posexplode(said).alias("n", "value"))
    late = rows.filter("k % 3 = 1").select(F.concat(name, F.lit(".jsonl")).alias("path"), F.explode(F.array(F.lit(0), F.lit(sessions.FIRST_LINES))).alias("n"))
    late = late.withColumn("value", F.when(F.col("n") == 0, "{}").otherwise("Model: late"))
    block = lambda df: df.select("path", F.struct(F.lit(0).cast("bigint").alias("block"), F.col("n").cast("bigint").alias("n")).alias("pos"), "value")
    return summed(sessions.droid_messages(files, block(logs).unionByName(block(late))))


CURSOR_PROVIDER = "CASE WHEN regexp_matches(lower(model_id), 'claude|sonnet|opus|haiku') THEN 'anthropic' WHEN regexp_matches(lower(model_id), 'gpt|o1|o3') THEN 'openai' WHEN regexp_matches(lower(model_id), 'gemini') THEN 'google' WHEN regexp_matches(lower(model_id), 'deepseek') THEN 'deepseek' WHEN regexp_matches(lower(model_id), 'llama|mixtral') THEN 'meta' ELSE 'cursor' END"
#: What a CSV row's date means: a time with or without zone mark, a bare date (noon), or nothing.
CSV_MS = "CASE k % 4 WHEN 0 THEN timestamp_ms WHEN 1 THEN timestamp_ms // 1000 * 1000 ELSE epoch_ms(CAST(date AS TIMESTAMP)) + 43200000 END"
CSV_DAY = "CASE k % 4 WHEN 0 THEN strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') WHEN 1 THEN strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S') ELSE strftime(date, '%Y-%m-%d') END"


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, pos, value: exports of two layouts, one per user; some rows are short, without model or date."""
    rows, k = facts(spark, sf_dir), F.col("k")
    stamp = F.when(k % 4 == 0, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k % 4 == 1, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("at", "yyyy-MM-dd"))
    stamp = F.when(k % 19 == 0, "soon").otherwise(stamp)
    model = F.when(k % 13 == 0, "").otherwise(F.col("model_id"))
    numbers = [F.col("input") + F.col("cache_write"), F.col("input"), F.col("cache_read"), F.col("output"), F.lit(1)]
    cost = F.concat(F.lit('"$'), F.format_number(k * 25.0, 2), F.lit('"'))
    text = lambda *fields: F.concat_ws(",", *[f.cast("string") for f in fields])
    long = text(stamp, F.lit("Included"), F.concat(F.lit('"'), model, F.lit('"')), F.lit("No"), *numbers, cost)
    short = text(stamp, model, *numbers, cost)
    two = F.col("user_id") % 2 == 0
    value = F.when(k % 11 == 0, text(stamp, model)).when(two, long).otherwise(short)
    path = F.concat(F.lit("/c/"), "session_id", F.lit(".csv"))
    body = rows.select(path.alias("path"), F.col("timestamp_ms").alias("n"), value.alias("value"))
    names = "Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens,Total Tokens,Cost"
    heads = rows.select(path.alias("path"), two.alias("two")).distinct()
    heads = heads.select("path", F.lit(-1).cast("bigint").alias("n"), F.when(F.col("two"), f"Date,Kind,Model,Max Mode,{names}").otherwise(f"Date,Model,{names}").alias("value"))
    return body.unionByName(heads).select("path", F.struct(F.lit(0).cast("bigint").alias("block"), "n").alias("pos"), "value")


@query(summed_sql(f"""SELECT 'cursor' AS source, model_id, {CURSOR_PROVIDER} AS provider_id, {ZERO}, input, output, cache_read, cache_write, 0 AS reasoning, k * 25000 AS cost,
  {CSV_MS} AS timestamp_ms, {CSV_DAY} AS session_id FROM usage WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 19 <> 0"""))
def decoded_cursor(spark, sf_dir):
    """CSV rows by position, quoted fields and costs with commas among them."""
    return summed(sessions.cursor_messages(csv_files(spark, sf_dir)))


NAMED_MS = CSV_MS.replace("epoch_ms(CAST(date AS TIMESTAMP)) + 43200000", "epoch_ms(CAST(date AS TIMESTAMP))")


@query(summed_sql(f"""SELECT 'cursor' AS source, model_id, {CURSOR_PROVIDER} AS provider_id, CAST(NULL AS VARCHAR) AS agent, CASE WHEN k % 19 = 0 THEN NULL ELSE date END AS date,
  CASE WHEN k % 11 = 0 THEN 0 ELSE input END AS input, CASE WHEN k % 11 = 0 THEN 0 ELSE output END AS output, CASE WHEN k % 11 = 0 THEN 0 ELSE cache_read END AS cache_read,
  CASE WHEN k % 11 = 0 THEN 0 ELSE cache_write END AS cache_write, 0 AS reasoning, CASE WHEN k % 11 = 0 THEN 0 ELSE k * 25000 END AS cost, CASE WHEN k % 19 = 0 THEN 0 ELSE {NAMED_MS} END AS timestamp_ms,
  'cursor-' || CASE WHEN k % 19 = 0 THEN 'soon' ELSE strftime(date, '%Y-%m-%d') END || '-' || model_id AS session_id FROM usage WHERE k % 13 <> 0 AND NOT (k % 11 = 0 AND user_id % 2 = 0)"""))
def decoded_cursor_by_name(spark, sf_dir):
    """CSV rows by the names of their columns: a short row has no numbers, one without a usable date stays, of no day."""
    return summed(sessions.cursor_messages_by_name(csv_files(spark, sf_dir)))


@query(summed_sql(f"""SELECT 'codex' AS source, coalesce(m, 'unknown') AS model_id, 'openai' AS provider_id, {ZERO}, input, output, cache_read, 0 AS cache_write, 0 AS reasoning, 0 AS cost, timestamp_ms, session_id
  FROM (SELECT *, last_value(CASE WHEN k % 10 = 9 THEN {{'m': CASE WHEN k % 20 <> 9 THEN model_id END}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY timestamp_ms, k ROWS UNBOUNDED PRECEDING).m AS m FROM usage)
  WHERE k % 10 <> 9 AND input + output + cache_read <> 0"""))
def decoded_codex(spark, sf_dir):
    """Lines of running logs: contexts set the model, also to none; every count states its own usage."""
    rows, k = facts(spark, sf_dir), F.col("k")
    context = json_of(type="turn_context", payload=struct(model=F.when(k % 20 != 9, F.col("model_id")).otherwise("")))
    used = struct(input_tokens=F.col("input"), output_tokens=F.col("output"), cached_input_tokens=F.col("cache_read"))
    count = json_of(type="event_msg", timestamp=rfc3339(F.col("timestamp_ms"), k % 2 == 0), payload=struct(type="token_count", info=struct(last_token_usage=used)))
    value = F.when(k % 10 == 9, context).otherwise(count)
    events = rows.select(F.concat(F.lit("/x/"), "session_id", F.lit(".jsonl")).alias("path"), F.struct(F.col("timestamp_ms").alias("n"), "k").alias("pos"), value.alias("value"))
    deltas = sessions.usage_deltas(sessions.codex_events(events), block=F.floor(F.col("pos.n") / 86_400_000))
    return summed(sessions.codex_messages(deltas))
