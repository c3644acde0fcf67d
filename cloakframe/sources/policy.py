"""SRC-2: the policy document as one small DataFrame per section."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed value: largest policy document that is accepted, in bytes. It bounds every table
# that is derived from a policy.
POLICY_MAX_BYTES = 8 * 1024 * 1024

# Sections of a policy document and their fields.
SECTIONS = {
    "routes": "kid string, name string, final_app_addr string, final_app_path string",
    "remote_routes": (
        "remote_kid string, name string, remote_addr string, "
        "allowed_local_kids array<string>, status string"
    ),
    "permissions": (
        "client string, apikey_hash string, status string, "
        "permissions array<struct<kid:string,actions:array<string>>>"
    ),
    "fpe_profiles": (
        "name string, fpe_version string, alphabet string, min_len int, max_len int, "
        "tweak_aad string, kid string"
    ),
    "tokenization_profiles": (
        "name string, kid string, token_prefix string, token_len int, "
        "max_plaintext_len int, one_time boolean"
    ),
    "mac_profiles": "name string, kid string, context string",
    "masking_profiles": (
        "name string, kid string, visible_first int, visible_last int, mask_char string, "
        "min_len int, max_len int"
    ),
    "commitment_profiles": (
        "name string, kid string, context string, max_plaintext_len int, opening_len int"
    ),
    "sharing_profiles": (
        "name string, kid string, threshold int, shares int, max_secret_len int, context string"
    ),
}


def policy_schema() -> T.StructType:
    fields = [T.StructField("version", T.StringType())]
    for name, ddl in SECTIONS.items():
        item = T.StructType.fromDDL(ddl)
        fields.append(T.StructField(name, T.ArrayType(item)))
    return T.StructType(fields)


def _document_size(spark: SparkSession, path: str) -> int | None:
    """Size in bytes, or None when there is no such file."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(jpath).getLen() if fs.exists(jpath) else None


def read_policy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One DataFrame per section. A missing section or a missing file reads as empty."""
    size = _document_size(spark, path)
    if size is None:
        document = spark.createDataFrame([], policy_schema())
    elif size > POLICY_MAX_BYTES:
        raise ValueError(f"policy document exceeds {POLICY_MAX_BYTES} bytes")
    else:
        document = (
            spark.read.schema(policy_schema())
            .options(multiLine=True, mode="FAILFAST")
            .json(path)
        )
    return local_sections(document)


def split_policy(document: DataFrame, keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Explode each section, keeping the position of an entry as ``pos``.

    ``document`` may hold one policy or many; ``keep`` names columns to carry along.
    """
    sections = {}
    for name, ddl in SECTIONS.items():
        fields = [f.name for f in T.StructType.fromDDL(ddl).fields]
        sections[name] = document.select(*keep, F.posexplode(name).alias("pos", "item")).select(
            *keep, "pos", *[F.col(f"item.{f}").alias(f) for f in fields]
        )
    return sections


def local_sections(document: DataFrame) -> dict[str, DataFrame]:
    """Sections of one policy as driver-held tables, so that later use never re-reads it.

    The document is bounded by ``POLICY_MAX_BYTES``.
    """
    row = document.first()
    sections = {}
    for name, ddl in SECTIONS.items():
        schema = T.StructType([T.StructField("pos", T.IntegerType())])
        schema = T.StructType(schema.fields + T.StructType.fromDDL(ddl).fields)
        items = [] if row is None or row[name] is None else row[name]
        rows = [{"pos": i, **item.asDict(recursive=True)} for i, item in enumerate(items)]
        columns = pa.Table.from_pylist(rows, schema=to_arrow_schema(schema))
        sections[name] = document.sparkSession.createDataFrame(columns, schema)
    return sections


def parse_policy(df: DataFrame, column: str) -> DataFrame:
    """JSON texts to policy documents; other columns are kept."""
    keep = [c for c in df.columns if c != column]
    parsed = F.from_json(column, policy_schema(), {"mode": "FAILFAST"})
    return df.select(*keep, parsed.alias("d")).select(*keep, "d.*")


def policy_from_text(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """The sections of a JSON text held by the caller."""
    if len(text.encode()) > POLICY_MAX_BYTES:
        raise ValueError(f"policy document exceeds {POLICY_MAX_BYTES} bytes")
    held = spark.createDataFrame(pa.table({"doc": pa.array([text], pa.string())}))
    return local_sections(parse_policy(held, "doc"))
