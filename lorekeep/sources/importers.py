"""Readers and writers for other stores' exports, Markdown fact files and audit files."""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.dates import parse_timestamp
from lorekeep.functions.udf import arrow_udf


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """A SQLite table's columns as strings, read in one task in batches: such a file has one reader."""
    if not re.fullmatch(r"\w+", table) or not all(re.fullmatch(r"\w+", c) for c in columns):
        raise ValueError("table and columns are plain names")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["path"]:
                with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
                    cursor = db.execute(f"SELECT {', '.join(columns)} FROM {table}")
                    while rows := cursor.fetchmany(5000):
                        yield pd.DataFrame([[None if v is None else str(v) for v in r] for r in rows], columns=columns)

    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def sqlite_tables(path: str) -> dict[str, list[str]]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
        return {n: [c[1] for c in db.execute(f'PRAGMA table_info("{n}")')] for n in names}


def import_history(spark: SparkSession, path: str) -> DataFrame:
    """Memory texts (text, created_at) of a SQLite store: JSON payloads with `messages` or `memories`, or plain text columns."""
    tables = sqlite_tables(path)
    if "history" in tables and "data" in tables["history"]:
        when = "created_at" if "created_at" in tables["history"] else "data"
        raw = read_sqlite(spark, path, "history", list(dict.fromkeys(["data", when])))
        shape = "struct<messages:array<struct<content:string>>,memories:array<string>>"
        doc = raw.select(F.from_json("data", shape).alias("d"), F.col(when).alias("created_at"))
        texts = F.concat(F.coalesce(F.expr("transform(d.messages, m -> m.content)"), F.array().cast("array<string>")), F.coalesce("d.memories", F.array().cast("array<string>")))
        return doc.select(F.explode(texts).alias("text"), "created_at").where("text is not null and trim(text) <> ''")
    for name in ("memories", "embeddings"):
        for column in ("data", "memory", "text", "document", "documents", "content"):
            if name in tables and column in tables[name]:
                when = next((c for c in ("created_at",) if c in tables[name]), None)
                raw = read_sqlite(spark, path, name, [column, *([when] if when else [])])
                return raw.select(F.col(column).alias("text"), (F.col(when) if when else F.lit(None).cast("string")).alias("created_at")).where("trim(text) <> ''")
    raise ValueError("no table of memories found")


def import_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(triples, texts) of a JSON Lines export; triples keep their interval, malformed lines are skipped."""
    schema = "subject string, relation string, object string, valid_at string, invalid_at string, text string, created_at string, _bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = rows.where("_bad is null")
    is_triple = F.col("subject").isNotNull() & F.col("relation").isNotNull() & F.col("object").isNotNull()
    triples = good.where(is_triple).select("subject", "relation", F.col("object").alias("value"), parse_timestamp(F.col("valid_at")).alias("valid_from"), parse_timestamp(F.col("invalid_at")).alias("valid_to"))
    return triples, good.where(~is_triple & F.col("text").isNotNull()).select("text", parse_timestamp(F.col("created_at")).alias("ts"))


def parse_front_matter(text: str) -> tuple[dict[str, str], str]:
    """Scalars of a leading --- block and the body behind it."""
    m = re.match(r"\A---\n(.*?)\n---\n?(.*)\Z", text, re.S)
    if not m:
        return {}, text
    fields = {}
    for line in m[1].split("\n"):
        key, sep, value = line.partition(":")
        if sep and key.strip():
            v = value.strip()
            fields[key.strip()] = json.loads(v) if v.startswith('"') and v.endswith('"') and len(v) > 1 else v
    return {k: str(v) for k, v in fields.items() if v not in ("null", "~", "")}, m[2].strip()


@arrow_udf("struct<fields:map<string,string>,body:string>")
def front_matter(texts: pd.Series) -> pd.DataFrame:
    parsed = [parse_front_matter(t or "") for t in texts]
    return pd.DataFrame({"fields": [p[0] for p in parsed], "body": [p[1] for p in parsed]})


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Facts of Markdown files, one file each."""
    raw = spark.read.text(path, wholetext=True).select(front_matter("value").alias("m"))
    names = ("id", "user_id", "agent_id", "run_id", "subject", "relation", "value", "source_hash", "source_id")
    return raw.where("m.fields['id'] is not null").select(
        *[F.col("m.fields")[n].alias(n) for n in names],
        *[parse_timestamp(F.col("m.fields")[n]).alias(n) for n in ("valid_from", "valid_to", "tx_from", "tx_to")],
        F.expr("try_cast(m.fields['confidence'] AS DOUBLE)").alias("confidence"),
        F.col("m.body").alias("body"),
    )


def write_markdown(facts: DataFrame, path: str) -> None:
    """One text file per fact, in folders by id, written by the executors."""
    quoted = lambda c: F.to_json(F.struct(F.col(c).cast("string").alias("v")))
    keys = [c for c in ("id", "user_id", "agent_id", "run_id", "subject", "relation", "value", "valid_from", "valid_to", "tx_from", "confidence", "source_id", "source_hash") if c in facts.columns]
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.regexp_extract(quoted(c), r'^\{"v":(.*)\}$', 1), F.lit("null"))) for c in keys]
    lines = [F.when(F.col(c).isNull(), F.lit(f"{c}: null")).otherwise(line) for c, line in zip(keys, lines)]
    body = F.concat_ws(" ", "subject", F.regexp_replace("relation", "_", " "), "value")
    text = F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""), body)
    facts.select(F.col("id").alias("file"), text.alias("value")).write.partitionBy("file").mode("overwrite").text(path)


def upsert_markdown(facts: DataFrame, files: DataFrame) -> DataFrame:
    """What a folder of fact files would change: id and new, changed, same or gone."""
    a = facts.select("id", F.col("value").alias("old"))
    b = files.select("id", F.col("value").alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, "id", "full").select("id", change.alias("change"), "new")


def export_audit(log: DataFrame, path: str, style: str = "jsonl") -> None:
    if style == "jsonl":
        log.write.mode("overwrite").json(path)
    else:
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        log.select(F.format_string("<13>1 %s lorekeep audit %s - actor=%s action=%s resource=%s", stamp, F.col("seq").cast("string"), "actor", "action", "resource").alias("value")).write.mode("overwrite").text(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Tables as Parquet with a manifest of row counts and order-free content sums."""
    spark = next(iter(tables.values())).sparkSession
    manifest = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        n, total = fingerprint(spark.read.parquet(f"{path}/{name}"))
        manifest.append((name, n, total))
    spark.createDataFrame(manifest, "name string, rows bigint, content decimal(38,0)").write.mode("overwrite").parquet(f"{path}/_manifest")
    return {name: n for name, n, _ in manifest}


def fingerprint(df: DataFrame):
    row = F.xxhash64(*[F.col(f"`{c}`") if not t.startswith("map") else F.to_json(F.col(f"`{c}`")) for c, t in df.dtypes]).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("total")).first()
    return r["n"], r["total"]


def restore(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    manifest = {r["name"]: (r["rows"], r["content"]) for r in spark.read.parquet(f"{path}/_manifest").collect()}
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest}
    if verify:
        for name, df in tables.items():
            if tuple(fingerprint(df)) != tuple(manifest[name]):
                raise ValueError(f"table {name} differs from its manifest")
    return tables


def read_dialogues(rows: DataFrame) -> DataFrame:
    """Nested benchmark conversations (conversation_id, chat: batches of turns) as one row per turn."""
    return (
        rows.select("conversation_id", F.posexplode("chat").alias("batch", "b"))
        .select("conversation_id", "batch", F.posexplode("b.turns").alias("turn", "t"))
        .select("conversation_id", "batch", "turn", "t.*")
    )


def flatten_chats(rows: DataFrame) -> DataFrame:
    """Benchmark rows with nested chats (conversation_id, chat: sessions of batches of turns) as one row per turn.

    conversation_id, session, batch_number, position (from 0 within its batch), role, content.
    """
    sessions = rows.select("conversation_id", F.posexplode("chat").alias("session", "batches"))
    batches = sessions.select("conversation_id", "session", F.explode("batches").alias("b"))
    turns = batches.select("conversation_id", "session", F.col("b.batch_number").alias("batch_number"), F.posexplode("b.turns").alias("position", "t"))
    return turns.select("conversation_id", "session", "batch_number", "position", "t.role", "t.content")


def compact_table(df: DataFrame, path: str, target_bytes: int = 128 << 20, sort_by: tuple[str, ...] = ()) -> DataFrame:
    """A table rewritten under `path` in files of about `target_bytes`, sorted within, and read back: many small files become few.

    The number of files is taken from the size of the files the table lies in; a table that isn't read from files keeps its partitions.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for name in df.inputFiles():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        size += p.getFileSystem(hadoop).getFileStatus(p).getLen()
    out = df.repartition(max(1, -(-size // target_bytes))) if size else df
    (out.sortWithinPartitions(*sort_by) if sort_by else out).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
