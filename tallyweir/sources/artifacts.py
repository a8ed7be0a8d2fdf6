"""Measurement artifacts: envelopes, readers with a status, staged publication, SARIF."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import finding_level

#: File that the one writer of a folder holds.
LOCK = ".publication.lock"
# Versions and names that readers of the artifacts expect.
ENVELOPE_VERSION = 3
MODEL_ID, MODEL_VERSION = "evidence-risk", 4

_CONFIDENCE = "struct<complete: boolean, partial: boolean, missing_input: array<string>, stale_input: array<string>, unsupported_pattern: array<string>>"
_HEADER = f"schema_version int, tool string, generated_at string, risk_model_id string, risk_model_version int, input_fingerprint struct<algorithm: string, digest: string, file_count: bigint, complete: boolean>, measurement_confidence {_CONFIDENCE}"

# Output file and payload kind of each tool.
TOOLS = {
    "hotspots": ("hotspots.json", "records"), "clones": ("clones.json", "records"), "escape-hatches": ("escape_hatches.json", "records"), "reliability": ("reliability.json", "records"),
    "api-health": ("api_health.json", "records"), "type-health": ("type_health.json", "records"), "locality": ("locality.json", "records"), "leverage": ("leverage.json", "records"),
    "map": ("map.json", "data"), "coverage": ("coverage.json", "data"), "correctness": ("correctness_review.json", "data"), "cohesion": ("cohesion.json", "data"), "function-risk": ("function_risk.json", "data"),
}


def payload(document: Column, order: tuple[str, ...] = ("$.records", "$.data")) -> Column:
    """The payload of a JSON document: records, else data, else the document itself (or in another order)."""
    return F.coalesce(*(F.get_json_object(document, p) for p in order), document)


def envelope(tool: str, rows: DataFrame, digest: str, files: int, complete: bool, generated_at: str, missing: list[str]) -> DataFrame:
    """One row a record with the run's metadata beside it, and which payload the tool has."""
    kind = TOOLS[tool][1]
    confidence = F.struct(F.lit(not missing and complete).alias("complete"), F.lit(bool(missing) or not complete).alias("partial"), F.array(*map(F.lit, missing)).cast("array<string>").alias("missing_input"))
    fingerprint = F.struct(F.lit("sha256-content-v1").alias("algorithm"), F.lit(digest).alias("digest"), F.lit(files).cast("bigint").alias("file_count"), F.lit(complete).alias("complete"))
    meta = [F.lit(ENVELOPE_VERSION).alias("schema_version"), F.lit(tool).alias("tool"), F.lit(generated_at).alias("generated_at"), F.lit(MODEL_ID).alias("risk_model_id"), F.lit(MODEL_VERSION).alias("risk_model_version"), fingerprint.alias("input_fingerprint"), confidence.alias("measurement_confidence")]
    return rows.select(*meta, F.struct(*rows.columns).alias(kind))


def read_artifacts(spark: SparkSession, folder: str, tools: list[str], digest: str, digest_complete: bool = True, strict: bool = False) -> DataFrame:
    """One row a tool: file, status, reason and the JSON payload (only if available or partial).

    status is missing, unreadable, incompatible, stale, partial or available, the first
    that applies. With ``strict`` anything but available raises.
    """
    wanted = spark.createDataFrame([(t, TOOLS[t][0], TOOLS[t][1]) for t in tools], "tool string, file string, kind string")
    present = [f"{folder.rstrip('/')}/{TOOLS[t][0]}" for t in tools if _exists(spark, f"{folder.rstrip('/')}/{TOOLS[t][0]}")]
    texts = spark.read.text(present, wholetext=True).select(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("_file"), F.col("value").alias("_text")) if present else spark.createDataFrame([], "_file string, _text string")
    joined = wanted.join(texts, F.col("file") == F.col("_file"), "left").withColumn("_h", F.from_json("_text", _HEADER)).withColumn("_ok", F.try_parse_json("_text").isNotNull() & F.col("_text").rlike(r"^\s*\{"))
    h = F.col("_h")
    has = lambda k: F.get_json_object("_text", f"$.{k}").isNotNull()
    only = F.when(F.col("kind") == "records", has("records") & ~has("data")).otherwise(has("data") & ~has("records"))
    contradictory = F.coalesce(h["measurement_confidence"]["complete"] == h["measurement_confidence"]["partial"], F.lit(True))
    problem = (
        F.when(~F.coalesce(h["schema_version"] == ENVELOPE_VERSION, F.lit(False)), "unsupported or missing schema version")
        .when(~F.coalesce(h["tool"] == F.col("tool"), F.lit(False)), "tool does not match the file")
        .when(~F.coalesce(h["risk_model_version"] == MODEL_VERSION, F.lit(False)), "different or missing risk model version")
        .when(F.coalesce(h["input_fingerprint"]["digest"], F.lit("")) == "", "missing input fingerprint digest")
        .when(~only, "missing or ambiguous payload")
        .when(contradictory, "contradictory confidence")
    )
    status = (
        F.when(F.col("_text").isNull(), "missing")
        .when(~F.coalesce("_ok", F.lit(False)), "unreadable")
        .when(problem.isNotNull(), "incompatible")
        .when(~F.coalesce(h["input_fingerprint"]["complete"], F.lit(False)) | F.lit(not digest_complete), "partial")
        .when(h["input_fingerprint"]["digest"] != digest, "stale")
        .when(h["measurement_confidence"]["partial"], "partial")
        .otherwise("available")
    )
    reason = F.when(F.col("status") == "missing", "artifact has not been produced").when(F.col("status") == "unreadable", "artifact is not valid JSON").when(F.col("status") == "incompatible", problem).when(F.col("status") == "stale", "inputs have changed").when(F.col("status") == "partial", "partial inputs or confidence")
    found = joined.withColumn("status", status).select("tool", "file", "status", reason.alias("reason"), F.when(F.col("status").isin("available", "partial"), payload(F.col("_text"))).alias("payload"))
    if strict:
        found = found.withColumn("payload", F.when(F.col("status") == "available", F.col("payload")).otherwise(F.raise_error(F.concat("file", F.lit(": "), "status"))))
    return found


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def publish(spark: SparkSession, outputs: dict[str, DataFrame], target: str, unchanged: Callable[[], bool]) -> None:
    """Write several tables so that none appears unless all were written and the inputs are still the same.

    Everything is staged beside the target; after the check each table is renamed into
    place. A reader sees whole tables only, though not all of them at one instant. One
    writer publishes at a time: it holds a lock file, which another writer finds and
    fails. A writer that died leaves it for somebody to look at.
    """
    stage = f"{target.rstrip('/')}/.stage-{uuid.uuid4().hex}"
    fs, where = _fs(spark, stage)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    lock = jvm_path(f"{target.rstrip('/')}/{LOCK}")
    fs.mkdirs(lock.getParent())
    if not fs.createNewFile(lock):
        raise RuntimeError(f"{target} is being published by another writer, or one that died: {LOCK}")
    try:
        for name, df in outputs.items():
            df.write.parquet(f"{stage}/{name}")
        if not unchanged():
            raise RuntimeError("inputs changed while measuring; nothing was published")
        for name in outputs:
            final = jvm_path(f"{target.rstrip('/')}/{name}")
            fs.delete(final, True)
            fs.rename(jvm_path(f"{stage}/{name}"), final)
    finally:
        fs.delete(where, True)
        fs.delete(lock, False)


def write_json(path: str, document: object) -> None:
    """One small document on the driver: written beside its place, synced and renamed."""
    place = Path(path)
    place.parent.mkdir(parents=True, exist_ok=True)
    beside = place.with_name(f".{place.name}.{uuid.uuid4().hex}")
    with beside.open("w") as f:
        json.dump(document, f, indent=1, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    beside.replace(place)


def sarif_results(findings: DataFrame) -> DataFrame:
    """rule_id and the SARIF 2.1.0 result of each finding, as JSON.

    An unknown line or column is left out rather than invented; a waived finding keeps
    its result with an accepted suppression. ``findings`` has rule_id, message, path,
    line, column, disposition, severity, id, waiver_reason.
    """
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine"), F.when(F.col("column") > 0, F.col("column")).alias("startColumn")))
    where = F.when(F.coalesce(F.col("path") != "", F.lit(False)), F.array(F.struct(F.struct(F.struct(F.replace("path", F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))))
    suppressed = F.when(F.col("waiver_reason").isNotNull(), F.array(F.struct(F.lit("external").alias("kind"), F.lit("accepted").alias("status"), F.col("waiver_reason").alias("justification"))))
    prints = F.when(F.col("id").isNotNull(), F.struct(F.col("id").alias("source-anchor-v1")))
    result = F.struct(F.col("rule_id").alias("ruleId"), finding_level(F.col("disposition"), F.col("severity")).alias("level"), F.struct(F.coalesce("message", "rule_id").alias("text")).alias("message"), where.alias("locations"), prints.alias("partialFingerprints"), suppressed.alias("suppressions"))
    return findings.filter(F.col("rule_id").isNotNull()).select("rule_id", F.to_json(result).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One SARIF rule a rule_id, described by its first message in (path, line) order."""
    named = findings.filter(F.col("rule_id").isNotNull()).groupBy("rule_id").agg(F.min_by(F.coalesce("message", "rule_id"), F.struct("path", "line", "message")).alias("m"))
    rule = F.struct(F.col("rule_id").alias("id"), F.regexp_replace("rule_id", "[.-]", "_").alias("name"), F.struct(F.col("m").alias("text")).alias("shortDescription"))
    return named.select("rule_id", F.to_json(rule).alias("rule"))


def write_sarif(findings: DataFrame, path: str, tool: str) -> None:
    """A whole SARIF log; results stream to the driver row by row into the file."""
    rules = ",".join(r["rule"] for r in sarif_rules(findings).orderBy("rule_id").toLocalIterator())
    place = Path(path)
    beside = place.with_name(f".{place.name}.{uuid.uuid4().hex}")
    with beside.open("w") as f:
        f.write('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":' + json.dumps(tool) + ',"rules":[' + rules + ']}},"results":[')
        for i, r in enumerate(sarif_results(findings).orderBy("rule_id", "result").toLocalIterator()):
            f.write(("," if i else "") + r["result"])
        f.write("]}]}")
    beside.replace(place)


def schema_registry(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """JSON schemas of tables, by name."""
    return {name: json.loads(df.schema.json()) for name, df in sorted(tables.items())}


def check_schema(df: DataFrame, expected: StructType) -> list[str]:
    """What differs from an expected schema: missing, extra and differently typed fields."""
    have, want = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (df.schema, expected))
    return sorted([f"missing {n}" for n in want.keys() - have.keys()] + [f"unknown {n}" for n in have.keys() - want.keys()] + [f"{n} is {have[n]}, not {want[n]}" for n in want.keys() & have.keys() if want[n] != have[n]])
