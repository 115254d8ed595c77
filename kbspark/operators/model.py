"""Model output: parsing, validation, the apply hook, plan clean-up, capped payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions import text as tx


def json_span(raw: Column) -> Column:
    """From the first opening to the last closing brace or bracket."""
    return F.nullif(F.regexp_extract(raw, r"(?s)[{\[].*[}\]]", 0), F.lit(""))


def parse_output(df: DataFrame, raw: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """Add ``parsed`` and ``valid``; rejected rows stay with ``valid = false``."""
    probe = T.StructType(list(schema.fields) + [T.StructField("_corrupt", T.StringType())])
    parsed = df.withColumn(
        "_p", F.from_json(json_span(F.col(raw)), probe, {"columnNameOfCorruptRecord": "_corrupt"})
    )
    ok = F.col("_p").isNotNull() & F.col("_p._corrupt").isNull()
    for name in required:
        ok = ok & F.col(f"_p.{name}").isNotNull()
    return parsed.withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn(
        "parsed", F.when(F.col("valid"), F.struct(*[F.col(f"_p.{n}") for n in schema.names]))
    ).drop("_p")


def apply_model(chunks: DataFrame, fn: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Run ``fn`` (texts to raw model output) over Arrow batches of chunks."""
    schema = T.StructType(list(chunks.schema.fields) + [T.StructField("raw_output", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(raw_output=fn(batch["text"]))

    return chunks.mapInPandas(run, schema)


def clamp_int(value: Column, default: int, low: int, high: int) -> Column:
    number = F.coalesce(value.try_cast("int"), F.lit(default))
    return F.least(F.greatest(number, F.lit(low)), F.lit(high))


def clamp_float(value: Column, default: float, low: float = 0.0, high: float = 1.0) -> Column:
    number = F.coalesce(value.try_cast("double"), F.lit(default))
    return F.least(F.greatest(number, F.lit(low)), F.lit(high))


MEMORY_KINDS = ("semantic", "episodic", "procedural")  # fixed values


def sanitize_plans(plans: DataFrame) -> DataFrame:
    """Retrieval plans with lists, dates, kinds and limits forced into bounds. Columns a plan lacks are null."""
    have = dict(plans.dtypes)
    # Normalised first, so that the expressions below are free of Python.
    fields = ("intent", "source_type", "memory_type", "memory_kind", "user_id", "project_id", "session_id", "date_from", "date_to", "reason")
    none = F.lit(None).cast("string")
    staged = plans.withColumns(
        {f"_{n}": tx.normalize_space(F.col(n)) if n in have else none for n in fields}
        | {f"_{n}": tx.nfkc_list(F.coalesce(n, F.array().cast("array<string>"))) for n in ("topics", "entities")}
    )

    def text_list(name: str) -> Column:
        items = F.transform(f"_{name}", lambda v: tx.cut(tx.collapse_space(v), 80))
        return F.slice(F.array_distinct(F.filter(items, lambda v: v != "")), 1, 10)

    def short(name: str, limit: int) -> Column:
        return F.nullif(tx.cut(F.col(f"_{name}"), limit), F.lit(""))

    def date(name: str) -> Column:
        value = short(name, 30)
        return F.when(tx.is_date_text(value), value)

    kind = F.lower(short("memory_kind", 20))
    return staged.select(
        "plan_id",
        F.coalesce(short("intent", 80), F.lit("ask")).alias("intent"),
        text_list("topics").alias("topics"),
        text_list("entities").alias("entities"),
        short("source_type", 40).alias("source_type"),
        short("memory_type", 20).alias("memory_type"),
        F.when(kind.isin(*MEMORY_KINDS), kind).alias("memory_kind"),
        *[short(n, 120).alias(n) for n in ("user_id", "project_id", "session_id")],
        date("date_from").alias("date_from"),
        date("date_to").alias("date_to"),
        clamp_int(F.col("retrieve_top_k"), 8, 1, 20).alias("retrieve_top_k"),
        F.coalesce("need_strong_model", F.lit(False)).alias("need_strong_model"),
        short("reason", 320).alias("reason"),
    )


def capped_payload(encoded: Column, limit: int, field: str) -> Column:
    """JSON text within ``limit`` characters; a longer one becomes a wrapper with a preview.

    The wrapper's preview is cut so that its escaped form fits.
    """
    room = max(60, limit - 220)
    wrapper = F.to_json(
        F.struct(
            F.lit(field).alias("field"),
            F.lit(f"{field} truncated to {limit} chars").alias("note"),
            F.substring(encoded, 1, room).alias("preview"),
            F.length(encoded).alias("raw_chars"),
            F.lit(True).alias("truncated"),
        )
    )
    # Escaping can double the preview, so shrink by the excess where it does.
    excess = F.greatest(F.length(wrapper) - limit, F.lit(0))
    smaller = F.greatest(F.lit(60), F.lit(room) - F.ceil(excess / 40).cast("int") * 40)
    tight = F.to_json(
        F.struct(
            F.lit(field).alias("field"),
            F.lit(f"{field} truncated to {limit} chars").alias("note"),
            F.substring(encoded, F.lit(1), smaller).alias("preview"),
            F.length(encoded).alias("raw_chars"),
            F.lit(True).alias("truncated"),
        )
    )
    return F.when(F.length(encoded) <= limit, encoded).otherwise(F.when(excess == 0, wrapper).otherwise(tight))


def validate_initiatives(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Initiative JSON in ``payload`` to rows with ``valid`` and the missing field names."""
    parsed = parse_output(raw, "payload", schema)
    strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    missing = F.filter(
        F.array(*[F.when(F.col(f"parsed.{n}").isNull(), F.lit(n)) for n in strings]), lambda x: x.isNotNull()
    )
    return parsed.withColumn("missing", F.when(F.col("valid"), missing)).withColumn(
        "valid", F.col("valid") & (F.size(missing) == 0)
    )
