"""What an extraction will cost, from the chunks' sizes alone."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.profile import Profile

CHARS_PER_TOKEN, OVERHEAD_CHARS, OUTPUT_SHARE, ALARM = 4, 700, 0.35, 0.4


def schema_chars(profile: Profile) -> int:
    return len(json.dumps({"labels": [k.label for k in profile.labels], "relations": [k.label for k in profile.relations], "patterns": profile.patterns}))


def estimate(chunks: DataFrame, schema_size: int, prices: DataFrame | None = None) -> DataFrame:
    """chunks, body_chars, input_tokens, output_tokens, schema_share, schema_heavy; with prices (model, input_price, output_price a token), a row and a cost for each model."""
    own = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("body_chars"))
    body, fixed = F.col("body_chars") / CHARS_PER_TOKEN, F.lit((schema_size + OVERHEAD_CHARS) / CHARS_PER_TOKEN) * F.col("chunks")
    own = own.withColumns({"input_tokens": fixed + body, "output_tokens": body * OUTPUT_SHARE})
    own = own.withColumn("schema_share", F.coalesce(fixed / F.nullif(F.col("input_tokens"), F.lit(0.0)), F.lit(0.0))).withColumn("schema_heavy", F.col("schema_share") > ALARM)
    if prices is None:
        return own
    # One row meets the short list of models.
    met = prices.withColumn("one", F.lit(1)).join(F.broadcast(own.withColumn("one", F.lit(1))), "one").drop("one")
    return met.withColumn("cost", F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price"))
