"""Schemas of the account, job and audit tables, and their scans.

Every scan of a tenant's rows filters by tenant in the reader, so the filter reaches the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MONEY = "decimal(12,4)"
#: Table names, their keys, and their fields (name and type; the rest of the model is what readers of a table need).
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "users": (("id",), "id long, email string, full_name string, is_email_verified boolean, active boolean, banned_at timestamp, timezone string, locale string, lifecycle_opt_out_at timestamp, email_suppressed_at timestamp, email_suppression_reason string, created_at timestamp, updated_at timestamp"),
    "api_keys": (("id",), "id long, active boolean, key_prefix string, key_type string, name string, project_id long, allowed_domains array<string>, allowed_endpoints array<string>, allowed_ips array<string>, first_used_at timestamp, last_used_at timestamp, first_used_surface string, created_at timestamp, updated_at timestamp"),
    "projects": (("id",), "id long, name string, is_default boolean, storage_used long, created_at timestamp, updated_at timestamp"),
    "project_members": (("id",), "id long, project_id long, user_id long, role string, created_at timestamp"),
    "widgets": (("id",), "id string, user_id string, name string, endpoint string, api_key_id long, active boolean, created_at timestamp, updated_at timestamp"),
    "activity": (("id",), "id long, project_id string, endpoint string, url string, source_url string, status string, duration string, input_file_size string, output_file_size string, batch_id string, content_hash string, error_message string, timestamp timestamp"),
    "alerts": (("id",), "id long, project_id long, alert_type string, severity string, title string, message string, metadata string, is_visible boolean, created_at timestamp"),
    "plans": (("slug",), f"id long, slug string, name string, price_monthly int, max_file_size long, file_retention_hours int, batch_limit int, crawl_mode string, overage_rate_cents double, overage_allowed boolean, is_active boolean, ops_month int, ai_credits_cents_month {MONEY}, max_watchers int"),
    "storage_plans": (("slug",), "id long, slug string, name string, storage_bytes long, price_monthly int, is_active boolean"),
    "subscriptions": (("project_id",), f"id long, project_id long, plan_id long, storage_plan_id long, status string, overage_enabled boolean, pending_plan_id long, current_period_start timestamp, current_period_end timestamp, override_ops_month int, override_ai_credits_cents_month {MONEY}, override_max_file_size long, override_file_retention_hours int, override_batch_limit int, effective_ops_month int, effective_max_file_size long, effective_file_retention_hours int, effective_batch_limit int, effective_storage_bytes long"),
    "usage_periods": (("project_id", "period_start"), f"id long, project_id long, period_start timestamp, period_end timestamp, plan_id long, ops_used int, overage_ops int, bonus_ops int, storage_bytes_peak long, ai_credits_granted_cents {MONEY}, llm_cost_cents {MONEY}"),
    "usage_ledger": (("idempotency_key",), f"id long, idempotency_key string, project_id long, usage_period_id long, counter string, event_type string, delta_units int, delta_cost_cents {MONEY}, context string, created_at timestamp"),
    "payments": (("id",), "id long, project_id long, transaction_id string, subscription_type string, amount_value string, amount_currency string, status string, payment_time timestamp"),
    "email_log": (("email_key",), "id long, project_id long, user_id long, email_type string, email_key string, recipient string, sent_ok boolean, attempts int, last_error string, context string, created_at timestamp, sent_at timestamp"),
    "verify_tokens": (("token_hash",), "id long, user_id long, token_hash string, expires_at timestamp, used_at timestamp"),
    "conversion_jobs": (("id",), "id string, project_id string, status string, object_key string, error_message string, created_at timestamp"),
    "scheduled_deletions": (("object_key",), "id long, object_key string, project_id long, delete_at timestamp, deleted_at timestamp, attempts int, last_error string"),
    "operations": (("operation_id",), f"id long, operation_id string, project_id long, url string, url_final string, status string, fingerprint string, content_hash string, outputs_requested array<string>, output_keys map<string,string>, cache_hit boolean, batch_id string, llm_cost_cents {MONEY}, created_at timestamp, completed_at timestamp"),
    "batches": (("batch_id",), "id long, batch_id string, project_id long, status string, total int, completed int, failed int, zip_object_key string, created_at timestamp, completed_at timestamp"),
    "ingest_jobs": (("job_id",), "id long, job_id string, project_id long, status string, pages_discovered int, pages_found int, discovery_truncated boolean, pages_processed int, pages_failed int, total_chunks int, created_at timestamp, completed_at timestamp"),
    "ingest_pages": (("job_id", "url"), "id long, job_id string, url string, source_type string, filename string, status string, chunk_count int, word_count int, content_hash string, error_message string, processed_at timestamp"),
    "watchers": (("watcher_id",), "id long, watcher_id string, project_id long, url string, status string, frequency_minutes int, consecutive_errors int, checks_count int, last_check_at timestamp, next_check_at timestamp, last_change_at timestamp"),
    "watcher_snapshots": (("id",), "id long, watcher_id string, content_hash string, structured_data string, render_quality_score double, has_changes boolean, changes string, created_at timestamp"),
    "lookups": (("id",), f"id long, project_id long, query string, category string, results_count int, cost_cents {MONEY}, created_at timestamp"),
    "distills": (("operation_id",), f"id long, operation_id string, project_id long, url string, status string, result_data string, fields_from_css int, fields_from_llm int, llm_cost_cents {MONEY}, created_at timestamp"),
    "feedback": (("id",), "id long, project_id long, operation_id string, field_name string, original_value string, corrected_value string, created_at timestamp"),
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name][1])


def scan(spark: SparkSession, folder: str, name: str, project: int | None = None) -> DataFrame:
    """A table below folder, of one tenant if it is given."""
    df = spark.read.schema(schema(name)).parquet(f"{folder}/{name}")
    if project is None:
        return df
    if "project_id" not in df.columns:
        raise ValueError(f"{name} has no tenant column")
    kind = df.schema["project_id"].dataType.simpleString()
    return df.where(F.col("project_id") == F.lit(project).cast(kind))


def newest(df: DataFrame, at: str, tie: str, offset: int, limit: int) -> DataFrame:
    """A page of rows, newest first, and one row over: if it is there, there are more."""
    return df.orderBy(F.desc(at), F.desc(tie)).offset(offset).limit(limit + 1)


def owners(spark: SparkSession, folder: str) -> DataFrame:
    """project_id and user_id of each project's owner, the lowest user first."""
    m = scan(spark, folder, "project_members").where("role = 'owner'")
    return m.groupBy("project_id").agg(F.min("user_id").alias("user_id"))


def entitlements(spark: SparkSession, folder: str) -> DataFrame:
    """Subscriptions with their plan (the pending one first) and storage plan: three dimension joins."""
    s, p, t = scan(spark, folder, "subscriptions"), scan(spark, folder, "plans"), scan(spark, folder, "storage_plans")
    p = p.select(F.col("id").alias("__p"), F.col("slug").alias("plan_slug"), "ops_month", "overage_allowed", "overage_rate_cents", "max_watchers", "crawl_mode")
    t = t.select(F.col("id").alias("__t"), "storage_bytes")
    joined = s.join(p, F.coalesce("pending_plan_id", "plan_id") == F.col("__p"), "left").join(t, F.col("storage_plan_id") == F.col("__t"), "left").drop("__p", "__t")
    return joined.withColumn("ops_cap", F.coalesce("override_ops_month", F.nullif("effective_ops_month", F.lit(0)), "ops_month", F.lit(0)))
