"""Readers for conversation datasets, versioned event logs and entity mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SESSION_SCHEMA = (
    "id string, date string, turns array<struct<role:string,speaker:string,content:string,sourceId:string>>"
)
CASE_SCHEMA = (
    "id string, benchmark string, category string, question string, reference string, "
    "evidenceIds array<string>, options array<string>, rubric array<string>, "
    f"sessions array<struct<id:string,date:string,turns:array<struct<role:string,speaker:string,content:string,sourceId:string>>>>"
)
EVENT_SCHEMA = "version int, type string, graphId string, sessionId bigint, recordedAt timestamp_ntz, value double"
MENTION_SCHEMA = (
    "pageid string, title string, text string, "
    "entities array<struct<text:string,start:int,`end`:int,tag:string>>"
)
LOCOMO_SCHEMA = (
    "sample_id string, qa array<struct<question:string,answer:string,category:int,evidence:array<string>>>, "
    "conversation map<string,string>"
)


def normal_role(role: Column) -> Column:
    """Map source role names onto user / assistant / system."""
    low = F.lower(F.trim(role))
    return (
        F.when(low.isin("assistant", "ai", "bot", "model"), "assistant")
        .when(low == "system", "system")
        .otherwise("user")
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array (or one object per file) of evaluation cases."""
    return spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path)


def questions(cases: DataFrame) -> DataFrame:
    return cases.select(
        F.col("id").alias("question_id"), "benchmark", "category", "question", "reference",
        F.col("evidenceIds").alias("evidence_ids"), "options", "rubric",
    )


def case_turns(cases: DataFrame) -> DataFrame:
    """One row per turn with the session position and the turn ordinal inside it."""
    sessions = cases.select(F.col("id").alias("question_id"), F.posexplode("sessions").alias("session_pos", "s"))
    turns = sessions.select(
        "question_id", "session_pos", F.col("s.id").alias("session"), F.col("s.date").alias("date"),
        F.posexplode("s.turns").alias("ordinal", "turn"),
    )
    return turns.select(
        "question_id", "session_pos", "session", "date", "ordinal", normal_role(F.col("turn.role")).alias("role"),
        F.col("turn.speaker").alias("speaker"), F.col("turn.content").alias("content"),
        F.col("turn.sourceId").alias("source_id"),
    )


def read_locomo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """LoCoMo: sessions are keys ``session_<n>`` of a map, each holding a JSON list of turns."""
    raw = spark.read.schema(LOCOMO_SCHEMA).option("multiLine", True).json(path)
    qs = raw.select("sample_id", F.posexplode("qa").alias("pos", "qa")).select(
        F.concat_ws("-", "sample_id", "pos").alias("question_id"), F.col("qa.question").alias("question"),
        F.col("qa.answer").alias("reference"), F.col("qa.category").cast("string").alias("category"),
        F.col("qa.evidence").alias("evidence_ids"),
    )
    turn = "array<struct<speaker:string,dia_id:string,text:string>>"
    keyed = raw.select("sample_id", "conversation", F.explode("conversation").alias("key", "body")).where(
        F.col("key").rlike(r"^session_\d+$")
    )
    ts = keyed.select(
        "sample_id", F.col("key").alias("session"),
        F.element_at("conversation", F.concat("key", F.lit("_date_time"))).alias("date"),
        F.posexplode(F.from_json("body", turn)).alias("ordinal", "t"),
    ).select("sample_id", "session", "date", "ordinal", F.col("t.speaker").alias("speaker"),
             F.col("t.text").alias("content"), F.col("t.dia_id").alias("source_id"))
    return qs, ts


def read_personamem(spark: SparkSession, questions_csv: str, contexts_jsonl: str) -> tuple[DataFrame, DataFrame]:
    """PersonaMem: a quoted CSV of questions and JSON lines mapping a context id to messages."""
    qs = (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .csv(questions_csv)
    )
    message = "map<string,array<struct<role:string,content:string>>>"
    lines = spark.read.text(contexts_jsonl).select(F.explode(F.from_json("value", message)).alias("context_id", "m"))
    ts = lines.select("context_id", F.posexplode("m").alias("ordinal", "t")).select(
        "context_id", "ordinal", normal_role(F.col("t.role")).alias("role"), F.col("t.content").alias("content")
    )
    return qs, ts


def read_longmemeval(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    schema = (
        "question_id string, question_type string, question string, answer string, question_date string, "
        "haystack_session_ids array<string>, haystack_dates array<string>, answer_session_ids array<string>, "
        "haystack_sessions array<array<struct<role:string,content:string>>>"
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    qs = raw.drop("haystack_sessions", "haystack_session_ids", "haystack_dates")
    ss = raw.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("pos", "s"))
    ts = ss.select(
        "question_id", F.col("s.haystack_session_ids").alias("session"), F.col("s.haystack_dates").alias("date"),
        F.posexplode("s.haystack_sessions").alias("ordinal", "t"),
    ).select("question_id", "session", "date", "ordinal", normal_role(F.col("t.role")).alias("role"),
             F.col("t.content").alias("content"))
    return qs, ts


def read_beam(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """BEAM: one folder per conversation with ``chat.json`` and ``probing_questions.json``."""
    chat = spark.read.option("multiLine", True).schema(
        "batch_number int, turns array<array<struct<id:string,role:string,content:string>>>"
    ).option("recursiveFileLookup", True).option("pathGlobFilter", "chat.json").json(root)
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    ts = chat.select(folder.alias("conversation"), "batch_number", F.posexplode(F.flatten("turns")).alias("ordinal", "t")).select(
        "conversation", "batch_number", "ordinal", normal_role(F.col("t.role")).alias("role"),
        F.col("t.content").alias("content"), F.col("t.id").alias("source_id"),
    )
    probe = "map<string,array<struct<question:string,answer:string,rubric:array<string>>>>"
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "probing_questions.json").text(root)
    qs = files.select(folder.alias("conversation"), F.explode(F.from_json("value", probe)).alias("category", "items")).select(
        "conversation", "category", F.posexplode("items").alias("pos", "q")
    ).select("conversation", "category", "pos", F.col("q.question").alias("question"),
             F.col("q.answer").alias("reference"), F.col("q.rubric").alias("rubric"))
    return qs, ts


def pinned_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """First ``n`` rows by key, each carrying the digest of the sampled key set."""
    sample = df.orderBy(key).limit(n)
    digest = sample.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.col(key).cast("string")))), 256).alias("digest"))
    return sample.crossJoin(digest)  # one digest row


def parse_event_log(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Versioned JSON lines to events; anything malformed or of another version is quarantined."""
    parsed = lines.withColumn("e", F.from_json(column, EVENT_SCHEMA))
    good = F.col("e.version").isin(1, 2) & F.col("e.graphId").isNotNull()
    flagged = parsed.withColumn("good", F.coalesce(good, F.lit(False)))
    return flagged.where("good").select("e.*"), flagged.where("not good").drop("e", "good")


def read_event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All rotated files of one log (``events.jsonl`` and ``events.jsonl.1`` …)."""
    return parse_event_log(spark.read.text(f"{path}*").where("trim(value) <> ''"))


def parse_mentions(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Entity-mention JSON lines; structurally invalid rows go to quarantine."""
    parsed = lines.withColumn("m", F.from_json(column, MENTION_SCHEMA))
    entity_ok = F.forall(
        "m.entities",
        lambda e: e["text"].isNotNull() & e["start"].isNotNull() & e["end"].isNotNull()
        & F.coalesce(e["tag"].isin("Same", "Other"), F.lit(False)),
    )
    good = F.col("m.text").isNotNull() & F.col("m.entities").isNotNull() & entity_ok
    flagged = parsed.withColumn("good", F.coalesce(good, F.lit(False)))
    return flagged.where("good").select("m.*"), flagged.where("not good").drop("m", "good")


def read_mentions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_mentions(spark.read.text(path).where("trim(value) <> ''"))


def merge_shards(shards: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Union of shard results plus the keys that more than one row claims."""
    merged = shards[0]
    for shard in shards[1:]:
        merged = merged.unionByName(shard)
    repeated = merged.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")
    return merged, repeated
