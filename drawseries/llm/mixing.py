"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate, target bytes / present bytes.  A
document's copy count is the inverse of the Poisson distribution with that mean
at a uniform number that its id and the seed decide; the document is exploded by
the count and all copies are shuffled globally by another seeded number.

Weights: given per source, or ``present bytes ** power`` (power 1 keeps the
present mix, 0 makes sources equal).  The target size is ``size`` times the
corpus.  Rates come from one aggregation over all rows and are written before
use, so that the planner sees the table's true size: small, it is broadcast;
large, the join is a shuffled one on (source, salt) that no hot source blocks.

Defined cases: null source is a source of its own; a null or empty text counts
one byte; rows that share an id share its count; an unlisted source in given
weights gets rate 0 (no copies); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, uniform

POWER = 0.5
SEED = 17
SALTS = 16


def poisson_cdf(rate: float) -> tuple[int, list[float]]:
    """(first k, CDF from k on): all k that a 52-bit uniform number can tell apart."""
    if rate <= 0:
        return 0, [1.0]
    spread = 12 * math.sqrt(rate) + 40
    lo, hi = max(0, math.floor(rate - spread)), math.ceil(rate + spread)
    k = np.arange(lo, hi + 1)
    log_p = k * math.log(rate) - rate - np.array([math.lgamma(x + 1) for x in k])
    return lo, np.cumsum(np.exp(log_p)).tolist()


def _tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        got = [poisson_cdf(r) for r in f["rate"]]
        yield f.assign(first=[a for a, _ in got], cdf=[b for _, b in got])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER,
                 size: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(src, bytes, rate): the mean number of copies of a document of each source."""
    sizes = (docs.select(docs[source].alias("src"), (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 1).alias("b"))
             .groupBy("src").agg(F.sum("b").alias("bytes")))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("bytes").cast("double"), F.lit(float(power))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        sizes = (sizes.join(given, F.col("src").eqNullSafe(F.col("name")), "left")
                 .select("src", "bytes", F.coalesce("w", F.lit(0.0)).alias("w")))
    total = sizes.agg(F.sum("bytes").alias("all_bytes"), F.sum("w").alias("all_w"))
    return (sizes.join(F.broadcast(total))            # one row
            .select("src", "bytes",
                    F.coalesce(F.lit(float(size)) * F.col("w") * F.col("all_bytes")
                               / F.nullif("all_w", F.lit(0.0)) / F.col("bytes"), F.lit(0.0)).alias("rate")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, size: float = 1.0,
        seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """All columns of ``docs`` once per copy, plus mix_copy (from 0) and mix_order, globally shuffled.

    Input columns named mix_copy or mix_order are replaced.
    """
    rates = source_rates(docs, weights, power, size, source, text)
    rates = rates.mapInPandas(_tables, "src string, bytes long, rate double, first int, cdf array<double>")
    rates = staged(rates, "mix-rates").withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the row travels as one struct, so its column names cannot clash with the operator's own
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("k"),
                       docs[source].alias("s"), uniform(seed, docs[key]).alias("u"),
                       F.pmod(F.xxhash64(docs[key]), F.lit(SALTS)).cast("int").alias("salt"))
    joined = base.join(rates, base["s"].eqNullSafe(rates["src"]) & (base["salt"] == rates["mix_salt"]))
    copies = (joined.withColumn("n", F.col("first") + F.size(F.filter("cdf", lambda c: c <= F.col("u"))))
              .where("n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
              .withColumn("mix_order", uniform(seed + 1, F.col("k"), F.col("mix_copy"))))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("mix_copy", "mix_order")]
    return copies.select(*kept, "mix_copy", "mix_order").sort("mix_order")


def oracle(power: float = POWER, seed: int = SEED) -> str:
    """DuckDB SQL for (doc_id, source, mix_copy, mix_key) of ``mix``."""
    return f"""
WITH d AS (SELECT *, ('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT::DOUBLE
                     / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(coalesce(octet_length(encode(text)), 0) + 1)::DOUBLE AS bytes FROM documents GROUP BY source),
r AS (SELECT source, pow(bytes, {power}) * sum(bytes) OVER () / sum(pow(bytes, {power})) OVER () / bytes AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
n AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
m AS (SELECT d.doc_id, d.source, d.text, len(list_filter(n.cdf, lambda x: x <= d.u)) AS copies
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, source, CAST(copy AS BIGINT) AS mix_copy, md5(coalesce(text, '')) AS text_md5
FROM (SELECT doc_id, source, text, unnest(range(0, copies)) AS copy FROM m WHERE copies > 0)"""
