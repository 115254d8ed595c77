"""Intake of pages, files and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import ids
from kbspark.functions import text as tx


def page_sources(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` to source rows keyed by the hash of their readable text."""
    text = F.col("text")
    return pages.withColumn("text", tx.readable_text(F.col("html"))).select(
        "*",
        ids.source_id("url", F.col("url")).alias("source_id"),
        ids.text_version(text).alias("source_version"),
        F.lit("url").alias("source_type"),
        F.col("url").alias("source_uri"),
        F.length(text).cast("long").alias("text_chars"),
        tx.word_count(text).cast("long").alias("text_words"),
        F.length("html").cast("long").alias("html_chars"),
    )


def prefer_longer(first: Column, second: Column, minimum: int = 200) -> Column:
    """``first`` unless it is thin and ``second`` is strictly longer."""
    return F.when((F.length(first) < minimum) & (F.length(second) > F.length(first)), second).otherwise(first)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))


def is_web_url(url: Column) -> Column:
    return url.rlike(r"^https?://[^/?#]+")


def link_kind(item: Column) -> Column:
    host = url_host(item)
    return (
        F.when(is_web_url(item) & (host.contains("youtube.com") | host.contains("youtu.be")), "youtube")
        .when(is_web_url(item), "url")
        .when(item.rlike(r"^(?:file://|/|\./)\S"), "file")
        .otherwise("unknown")
    )


# Suffixes of files still being written.
TEMPORARY_SUFFIXES = (".tmp", ".part", ".crdownload", ".download")


def settled_path(path: Column) -> Column:
    """True for paths without hidden parts and without a temporary suffix."""
    hidden = path.rlike(r"(?:^|/)\.[^/]")
    suffixes = "|".join(s.replace(".", r"\.") for s in TEMPORARY_SUFFIXES)
    return ~hidden & ~F.lower(path).rlike(rf"(?:{suffixes})$")


def bounded_listing(files: DataFrame, limit: int | None = None) -> DataFrame:
    """All files, or the first ``limit`` of every root by path; ``truncated`` tells that the
    bound was reached."""
    if limit is None:
        return files.withColumn("truncated", F.lit(False))
    window = Window.partitionBy("root").orderBy("path")
    kept = files.withColumn("position", F.row_number().over(window)).where(F.col("position") <= limit)
    full = kept.groupBy("root").agg((F.count(F.lit(1)) >= limit).alias("truncated"))
    return kept.join(full, "root")


def parents_of(path: Column) -> Column:
    """A path and all its ancestors, scheme and host included."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def allowed_paths(paths: DataFrame, roots: DataFrame, column: str = "path") -> DataFrame:
    """Paths equal to an allowed root or below one. Without roots nothing passes.

    A path is looked up by each of its ancestors, so containment is a plain equality join
    whatever the number of roots.
    """
    clean_roots = roots.select(F.regexp_replace("root", "/+$", "").alias("_root")).where("_root <> ''").distinct()
    # A root below another root adds nothing; without those a path meets one root at most.
    above = clean_roots.select(
        F.col("_root").alias("_inner"), F.explode(parents_of(F.col("_root"))).alias("_root")
    ).where("_inner <> _root")
    nested = above.join(clean_roots, "_root", "left_semi").select(F.col("_inner").alias("_root"))
    outer = clean_roots.join(nested, "_root", "left_anti")
    keyed = paths.withColumn("_root", F.explode(F.array_distinct(parents_of(F.col(column)))))
    return keyed.join(outer, "_root", "left_semi").drop("_root")


def new_file_versions(files: DataFrame, manifests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every file version with the reason it is taken or skipped.

    ``files(source_id, source_version)``; a version is skipped when a manifest holds it or a
    queued or running job carries it.
    """
    key = ["source_id", "source_version"]
    known = manifests.select(*key).distinct().withColumn("_known", F.lit(True))
    busy = jobs.where(F.col("status").isin("queued", "running")).select(*key).distinct()
    busy = busy.withColumn("_busy", F.lit(True))
    reason = (
        F.when(F.col("_known"), "already_ingested").when(F.col("_busy"), "already_queued").otherwise("enqueued")
    )
    return files.join(known, key, "left").join(busy, key, "left").withColumn("reason", reason).drop("_known", "_busy")


def merge_intake_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fold one new annotation per source into the stored intake metadata.

    Tags are appended and deduped, the last eight distinct contexts stay, and given fields
    replace stored ones.
    """
    joined = old.alias("o").join(new.alias("n"), "source_id", "full")

    def given(name: str) -> Column:
        fresh = tx.strip(F.coalesce(F.col(f"n.{name}"), F.lit("")))
        return F.when(fresh != "", fresh).otherwise(F.col(f"o.{name}"))

    empty = F.array().cast("array<string>")
    context = F.substring(tx.strip(F.coalesce(F.col("n.context"), F.lit(""))), 1, 4000)
    stored = F.coalesce(F.col("o.contexts"), empty)
    appended = F.when((context == "") | F.array_contains(stored, context), stored).otherwise(
        F.concat(stored, F.array(context))
    )
    last8 = F.when(F.size(appended) > 8, F.slice(appended, -8, 8)).otherwise(appended)
    date = F.when(tx.is_date_text(F.col("n.event_date")), F.col("n.event_date")).otherwise(F.col("o.event_date"))
    return joined.select(
        "source_id",
        tx.normalize_tags(F.concat(F.coalesce(F.col("o.tags"), empty), F.coalesce(F.col("n.tags"), empty))).alias(
            "tags"
        ),
        F.when(context != "", context).otherwise(F.col("o.context")).alias("context"),
        last8.alias("contexts"),
        given("speaker").alias("speaker"),
        given("organization").alias("organization"),
        date.alias("event_date"),
    )


def listing_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Difference of two folder listings: ``deleted``, ``created`` or ``changed`` paths."""
    both = previous.select("path", F.col("source_version").alias("old_version")).join(
        current.select("path", F.col("source_version").alias("new_version")), "path", "full"
    )
    change = (
        F.when(F.col("new_version").isNull(), "deleted")
        .when(F.col("old_version").isNull(), "created")
        .when(F.col("old_version") != F.col("new_version"), "changed")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull())
