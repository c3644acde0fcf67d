"""SRC-1, SNK-3: audit logs as JSON lines, read in file order by many tasks.

Every line carries ``log`` (the file, or the folder when a log spans several files), ``_blk``
(the file split it came from) and ``_at`` (its place inside the split). Splits have a bounded
size, so ordered work is done per split and only split summaries are put in sequence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import predicates as P
from cloakframe.functions.digests import digest_hex
from cloakframe.functions.text import utf8
from cloakframe.plans.jobs import compute_once

# Fixed values of the record format.
RECORD_VERSION = "cf-audit-v1"
CHECKPOINT_VERSION = "cf-checkpoint-v1"
RECORD_MAX_BYTES = 16 * 1024
TEXT_MAX_CHARS = 256
CHECKPOINT_EVERY = 10_000
GENESIS_EVENT = "audit.chain.started"
GENESIS_ACTION = "chain-start"
ZERO_HASH = "0" * 64
DEFAULT_HASH = "SHA-256"
RECORD_DOMAIN = b"cloakframe/audit-record/v1\0"

RECORD = (
    "action string, actor string, actor_fp string, admin boolean, chain_id string, "
    "event string, event_hash string, hash_alg string, kid string, outcome string, "
    "prev_hash string, reason string, remote_kid string, request_id string, root boolean, "
    "sequence bigint, timestamp string, version string"
)
CHECKPOINT = (
    "chain_id string, created_at string, head_hash string, last_sequence bigint, "
    "seal string, version string"
)
TEXT_FIELDS = [
    "event",
    "outcome",
    "actor",
    "actor_fp",
    "kid",
    "remote_kid",
    "action",
    "reason",
    "request_id",
]


def field_names(ddl: str) -> list[str]:
    """Names in a ``name type, name type`` list of simple types."""
    return [part.split()[0] for part in ddl.split(", ")]


RECORD_FIELDS = field_names(RECORD)
BODY_FIELDS = [f for f in RECORD_FIELDS if f != "event_hash"]
CHECKPOINT_FIELDS = field_names(CHECKPOINT)
_DOCUMENT = (
    RECORD
    + ", created_at string, head_hash string, last_sequence bigint, seal string, "
    + "_corrupt_record string"
)
_CHAIN_ID = "^[0-9A-Fa-f]{32}\\z"
_SECONDS = "^[0-9]+\\z"
_COMPRESSED = "\\.(gz|bz2|lz4|snappy|zst|deflate|xz)\\z"


def json_of(source: str, names: list[str]) -> Column:
    """Canonical JSON of some fields of a struct column; ``names`` are already sorted."""
    return F.to_json(
        F.struct(*[F.col(f"{source}.{n}").alias(n) for n in names]),
        {"ignoreNullFields": "false"},
    )


def record_hash(source: str, alg: str) -> Column:
    message = F.concat(F.lit(RECORD_DOMAIN), utf8(json_of(source, BODY_FIELDS)))
    return digest_hex(message, alg)


def scan_lines(spark: SparkSession, path: str, unit: str = "file") -> DataFrame:
    """Raw lines with their order. ``unit='directory'`` joins the files of a folder by name."""
    if unit not in ("file", "directory"):
        raise ValueError(f"unknown unit: {unit}")
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    file = F.col("_metadata.file_path")
    start = F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
    folder = F.regexp_replace(file, "/[^/]*\\z", "")
    # The position is taken directly on the scan, before any exchange.
    return text.select(
        (file if unit == "file" else folder).alias("log"),
        F.concat(file, F.lit("|"), start).alias("_blk"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    )


def cut_lines(spark: SparkSession, path: str) -> DataFrame:
    """``_blk, _at`` of the last line of every file that does not end with a line feed.

    Lines and their line feeds add up to the size of the file unless the last one is missing. This
    is a second pass over the text, with one partial sum per task and file; compressed files, whose
    size says nothing, are left out.
    """
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    start = F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
    file = F.col("_metadata.file_path")
    sizes = text.select(
        file.alias("file"),
        F.struct(start.alias("start"), F.monotonically_increasing_id().alias("at")).alias("place"),
        F.octet_length("value").alias("n"),
        F.col("_metadata.file_size").alias("size"),
    )
    ends = sizes.where(~F.lower("file").rlike(_COMPRESSED)).groupBy("file").agg(
        F.sum(F.col("n") + 1).alias("read"), F.max("size").alias("size"), F.max("place").alias("last")
    )
    return ends.where("read > size").select(
        F.concat("file", F.lit("|"), F.col("last.start")).alias("_blk"), F.col("last.at").alias("_at")
    )


def _reason(*checks: tuple[Column, str]) -> Column:
    bad, text = checks[0]
    case = F.when(bad, F.lit(text))
    for bad, text in checks[1:]:
        case = case.when(bad, F.lit(text))
    return case


def _not(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def parse_lines(lines: DataFrame, alg: str = DEFAULT_HASH) -> DataFrame:
    """Add ``doc`` (the parsed line), ``kind`` (record, checkpoint, other) and the first
    ``reason`` a line is bad on its own: size, JSON, shape, canonical form, hash.

    Each line is parsed once, against the fields of both line kinds.
    """
    line, doc = F.col("line"), F.col("doc")
    made = compute_once(lines, {"doc": F.from_json(line, _DOCUMENT)})
    valid = doc["_corrupt_record"].isNull() & doc["version"].isNotNull()
    kind = (
        F.when(doc["version"] == RECORD_VERSION, "record")
        .when(doc["version"] == CHECKPOINT_VERSION, "checkpoint")
        .otherwise("other")
    )
    made = made.withColumn("kind", kind)
    cut = F.col("_cut") if "_cut" in lines.columns else F.lit(False)
    general = _reason(
        (F.octet_length(line) > RECORD_MAX_BYTES, "record exceeds maximum size"),
        (cut, "record is truncated (missing trailing newline)"),
        (line == "", "record is empty"),
        (_not(valid), "record contains invalid JSON"),
        (F.col("kind") == "other", "record version is unsupported"),
    )
    text_bad = F.char_length(doc["reason"]) > TEXT_MAX_CHARS
    texts = F.concat_ws("", *[doc[name] for name in TEXT_FIELDS])
    text_bad = text_bad | ~P.no_control(texts)
    record = _reason(
        (_missing(RECORD_FIELDS), "record contains invalid JSON"),
        (doc["hash_alg"] != alg, "record version or hash algorithm is unsupported"),
        (~doc["chain_id"].rlike(_CHAIN_ID), "record chain_id is invalid"),
        (~P.hash_hex_ok(doc["prev_hash"], alg), "prev_hash is invalid"),
        (~P.hash_hex_ok(doc["event_hash"], alg), "event_hash is invalid"),
        (~doc["timestamp"].rlike(_SECONDS), "record timestamp is invalid"),
        (
            (doc["event"] == "") | (doc["outcome"] == ""),
            "record event and outcome must not be empty",
        ),
        (text_bad, "record contains invalid text fields"),
        (
            record_hash("doc", alg) != doc["event_hash"],
            "event hash does not match record content",
        ),
        (json_of("doc", RECORD_FIELDS) != line, "record JSON is not canonical"),
        (
            (doc["event"] == GENESIS_EVENT)
            & _not(
                (doc["sequence"] == 0)
                & (doc["prev_hash"] == ZERO_HASH)
                & (doc["outcome"] == "success")
                & (doc["action"] == GENESIS_ACTION)
            ),
            "chain genesis is invalid",
        ),
    )
    checkpoint = _reason(
        (_missing(CHECKPOINT_FIELDS), "checkpoint contains invalid JSON"),
        (json_of("doc", CHECKPOINT_FIELDS) != line, "checkpoint JSON is not canonical"),
        (~doc["chain_id"].rlike(_CHAIN_ID), "checkpoint chain_id is invalid"),
        (~P.hash_hex_ok(doc["head_hash"], alg), "checkpoint head_hash is invalid"),
        (~doc["created_at"].rlike(_SECONDS), "checkpoint created_at is invalid"),
    )
    # Two steps: the JIT leaves a generated method above 8000 bytes uncompiled.
    parts = {
        "_general": F.coalesce(general, F.when(F.col("kind") == "checkpoint", checkpoint)),
        "_record": F.when(F.col("kind") == "record", record),
    }
    for name, part in parts.items():
        made = compute_once(made, {name: part})
    return made.withColumn("reason", F.coalesce("_general", "_record")).drop(*parts)


def _missing(names: list[str]) -> Column:
    """Some field is absent or NULL."""
    return reduce(lambda a, b: a | b, [F.col(f"doc.{n}").isNull() for n in names])


def read_audit_log(
    spark: SparkSession, path: str, unit: str = "file", alg: str = DEFAULT_HASH
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(records, checkpoints, bad lines)``; a last line without its line feed is bad."""
    cut = cut_lines(spark, path).withColumn("_cut", F.lit(True))
    lines = scan_lines(spark, path, unit).join(cut, ["_blk", "_at"], "left")
    lines = lines.withColumn("_cut", F.coalesce("_cut", F.lit(False)))
    return split_lines(parse_lines(lines, alg))


def split_lines(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    place = ["log", "_blk", "_at"]
    good = parsed.filter(F.col("reason").isNull())
    return (
        good.filter("kind = 'record'").select(*place, *[f"doc.{n}" for n in RECORD_FIELDS]),
        good.filter("kind = 'checkpoint'").select(
            *place, *[f"doc.{n}" for n in CHECKPOINT_FIELDS]
        ),
        parsed.filter(F.col("reason").isNotNull()).select(*place, "line", "reason"),
    )


def write_audit_log(lines: DataFrame, path: str) -> None:
    """Write chain lines (``chain_id, place, line``) as text files in chain order.

    Range partitioning lets one long chain continue over several files; read such a folder
    back with ``unit='directory'``.
    """
    (
        lines.repartitionByRange("chain_id", "place")
        .sortWithinPartitions("chain_id", "place")
        .select("line")
        .write.text(path)
    )
