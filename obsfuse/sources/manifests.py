"""JSON manifests: window bundles and provider-neutral payload lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsfuse.functions.scalars import exact_string
from obsfuse.runtime import violations
from obsfuse.sources.archives import decode_archives

BUNDLE = (
    "overlap_windows array<struct<window_id string, path string, start_frame bigint, stop_frame bigint>>,"
    " disjoint_baseline string, latent_linear_baseline string"
)
PROVIDER = (
    "artifact_id string, sequence_id string, provider_family string, coordinate_semantics string,"
    " payloads array<struct<payload_id string, product_role string, window_id string, path string, sha256 string, byte_count bigint,"
    " view_id string, stochastic_member_id string, dependence_group_ids array<string>, dense_storage_dtype string,"
    " has_scene_flow boolean, has_ray_directions boolean,"
    " frame_lineage array<struct<output_frame_id bigint, source_frame_start bigint, source_frame_stop_exclusive bigint, contributor_ids array<string>>>>>"
)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path).withColumn("manifest_path", F.input_file_name())


def bundle_windows(spark: SparkSession, path: str) -> DataFrame:
    """Windows and baselines of every bundle manifest, with absolute member paths."""
    m = _read(spark, path, BUNDLE)
    root = F.regexp_replace(F.regexp_replace("manifest_path", r"[^/]*$", ""), "^file:/+", "file:/")
    base = F.array(
        F.struct(F.lit("baseline_disjoint").alias("window_id"), F.col("disjoint_baseline").alias("path"), F.lit(0).cast("bigint").alias("start_frame"), F.lit(None).cast("bigint").alias("stop_frame")),
        F.struct(F.lit("baseline_latent_linear").alias("window_id"), F.col("latent_linear_baseline").alias("path"), F.lit(0).cast("bigint").alias("start_frame"), F.lit(None).cast("bigint").alias("stop_frame")),
    )
    def rows(items, kind: str) -> DataFrame:  # noqa: ANN001
        return m.select("manifest_path", root.alias("root"), F.explode(items).alias("w")).where("w.path IS NOT NULL").select(
            "manifest_path", F.lit(kind).alias("kind"), F.col("w.window_id").alias("window_id"), F.concat("root", F.col("w.path")).alias("path"),
            F.col("w.start_frame").alias("start_frame"), F.col("w.stop_frame").alias("stop_frame"),
        )
    return rows(F.col("overlap_windows"), "overlap").unionByName(rows(base, "baseline"))


def read_bundle(spark: SparkSession, path: str, case_id: str, schema_name: str | None = None) -> DataFrame:
    """Scan only the listed members of a bundle; a listed but absent file raises."""
    listed = bundle_windows(spark, path)
    roots = [r[0] for r in listed.select(F.regexp_replace("path", r"[^/]*$", "")).distinct().collect()]  # folders of one bundle
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(roots)
    files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    violations(listed.join(files.select("path"), "path", "left_anti"), "listed archive is missing")
    j = files.select("path", "content").join(listed, "path")
    return decode_archives(j.withColumn("case_id", F.lit(case_id)), schema_name)


def provider_payloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, lineage) of provider-neutral manifests, guarded for exactness."""
    m = _read(spark, path, PROVIDER)
    p = m.select("artifact_id", "sequence_id", "coordinate_semantics", F.explode("payloads").alias("p"))
    payloads = p.select(
        "artifact_id", "sequence_id", "coordinate_semantics",
        *[F.col(f"p.{c}").alias(c) for c in (
            "payload_id", "product_role", "window_id", "path", "sha256", "byte_count", "view_id", "stochastic_member_id",
            "dependence_group_ids", "dense_storage_dtype", "has_scene_flow", "has_ray_directions")],
    )
    bad = ~exact_string(F.col("payload_id")) | ~exact_string(F.col("window_id")) | (F.col("byte_count") < 1) | ~F.col("sha256").rlike("^[0-9a-f]{64}$")
    violations(payloads.where(F.coalesce(bad, F.lit(True))), "malformed payload descriptor")
    violations(payloads.groupBy("artifact_id", "payload_id").count().where("count > 1"), "repeated payload id")
    lineage = p.select(F.col("p.payload_id").alias("payload_id"), F.explode("p.frame_lineage").alias("l")).select(
        "payload_id", F.col("l.output_frame_id").alias("output_frame"), F.col("l.source_frame_start").alias("source_start"),
        F.col("l.source_frame_stop_exclusive").alias("source_stop"), F.col("l.contributor_ids").alias("contributors"),
    )
    violations(lineage.where("source_start < 0 OR source_stop <= source_start"), "malformed lineage interval")
    violations(lineage.groupBy("payload_id", "output_frame").count().where("count > 1"), "repeated output frame")
    return payloads, lineage
