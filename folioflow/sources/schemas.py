"""The service's seven tables, as declared, and scans that hold to them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGES = "ARRAY<STRUCT<page_number: INT, text: STRING, confidence: DOUBLE, character_count: INT>>"
DOCUMENT = (
    "filename STRING NOT NULL, file_path STRING, file_type STRING NOT NULL, file_size INT NOT NULL, ocr_mode STRING NOT NULL, ocr_engine STRING NOT NULL, "
    f"languages ARRAY<STRING> NOT NULL, extracted_text STRING NOT NULL, confidence DOUBLE NOT NULL, total_pages INT NOT NULL, pages_data {PAGES}, processing_time DOUBLE, character_count INT"
)
# Columns, types and which of them may be null.
TABLES = {
    "users": "id BIGINT NOT NULL, username STRING NOT NULL, email STRING NOT NULL, hashed_password STRING, full_name STRING, google_id STRING, auth_provider STRING NOT NULL, role STRING NOT NULL, "
    "is_active BOOLEAN NOT NULL, is_verified BOOLEAN NOT NULL, free_ocr_used INT NOT NULL, subscription_pages_total INT NOT NULL, subscription_pages_used INT NOT NULL, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP, last_login TIMESTAMP",
    "ocr_documents": f"id BIGINT NOT NULL, user_id BIGINT NOT NULL, {DOCUMENT}, is_deleted BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP",
    "enterprises": "id BIGINT NOT NULL, name STRING NOT NULL, phone STRING, email STRING, description STRING, total_pages INT NOT NULL, unit_price DOUBLE NOT NULL, total_cost DOUBLE NOT NULL, start_date DATE, end_date DATE, duration_days INT, "
    "advance_bill DOUBLE NOT NULL, due_amount DOUBLE NOT NULL, payment_status STRING NOT NULL, no_of_documents INT NOT NULL, pages_used INT NOT NULL, created_by BIGINT NOT NULL, is_deleted BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP",
    "enterprise_ocr_documents": f"id BIGINT NOT NULL, enterprise_id BIGINT NOT NULL, processed_by BIGINT NOT NULL, {DOCUMENT}, created_at TIMESTAMP NOT NULL",
    "payment_history": "id BIGINT NOT NULL, user_id BIGINT NOT NULL, invoice_number STRING NOT NULL, pages_purchased INT NOT NULL, payment_amount DOUBLE NOT NULL, currency STRING NOT NULL, status STRING NOT NULL, "
    "initiation_response STRING, callback_payload STRING, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP, paid_at TIMESTAMP",
    "free_trial_users": "id BIGINT NOT NULL, device_id STRING NOT NULL, usage_count INT NOT NULL, max_usage INT NOT NULL, first_used_at TIMESTAMP NOT NULL, last_used_at TIMESTAMP, cookie_id STRING, cookie_consent_given BOOLEAN, cookie_consent_at TIMESTAMP, "
    "user_agent STRING, ip_address STRING, is_blocked BOOLEAN NOT NULL",
    "email_otps": "id BIGINT NOT NULL, email STRING NOT NULL, otp_code STRING NOT NULL, user_data STRING NOT NULL, expires_at TIMESTAMP NOT NULL, is_used BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL",
}


@cache
def schema_of(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A declared table at a path: its columns and types, and a scan that fails at the first null where none may be.

    Parquet itself takes every column as nullable. The check is part of the projection, so columns that a query doesn't
    read are neither read nor checked.
    """
    schema = schema_of(name)
    rows = spark.read.schema(schema).parquet(path)
    said = lambda c: F.raise_error(F.lit(f"{name}.{c} is null"))
    return rows.select(*[F.col(f.name) if f.nullable else F.coalesce(F.col(f.name), said(f.name).cast(f.dataType)).alias(f.name) for f in schema])


def conformed(df: DataFrame, name: str, **defaults) -> DataFrame:
    """df as a declared table: columns that it lacks get their default, or null where that may be; others are cast."""
    columns = []
    for f in schema_of(name):
        have = F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))
        columns.append((F.coalesce(have, F.lit(defaults[f.name])) if f.name in defaults else have).cast(f.dataType).alias(f.name))
    return df.select(*columns)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, tasks: int, **options: str) -> DataFrame:
    """A table read by ranges of a numeric key between the source's own least and largest, so that no task reads all of it.

    The key is spelled as the source has it. Rows with a null key come with the first range; an empty table is read in one task.
    """
    source = lambda: spark.read.format("jdbc").options(url=url, **options)
    low, high = source().option("query", f'SELECT min("{key}") AS low_, max("{key}") AS high_ FROM {name}').load().first()
    if low is None:
        return source().option("dbtable", name).load()
    bounds = {"partitionColumn": key, "lowerBound": str(int(low)), "upperBound": str(int(high) + 1), "numPartitions": str(tasks)}
    return source().options(dbtable=name, **bounds).load()
