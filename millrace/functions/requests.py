"""Generation requests: validation, defaults, effective sampling values, throughput."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.constants import GENERATE_LIMITS
from millrace.options import GenerationDefaults

DEFAULTS = GenerationDefaults()


def violations(limits=GENERATE_LIMITS) -> Column:
    """Names of the columns outside their limits; empty for a valid request."""
    checks = [
        F.when(~F.col(name).between(low, high), F.lit(name)) for name, low, high in limits
    ]
    return F.array_compact(F.array(*checks))


def or_default(value: Column, default) -> Column:
    """Null and zero both fall back, so an explicit 0.0 is replaced as well."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def effective_sampling(do_sample: Column, defaults: GenerationDefaults = DEFAULTS) -> dict[str, Column]:
    """Greedy requests run with neutral values; a request that does not say samples."""
    do_sample = F.coalesce(do_sample, F.lit(defaults.do_sample))
    return {
        "temperature": F.when(do_sample, F.col("temperature")).otherwise(F.lit(1.0)),
        "top_p": F.when(do_sample, F.col("top_p")).otherwise(F.lit(1.0)),
        "top_k": F.when(do_sample, F.col("top_k")).otherwise(F.lit(50)),
    }


def tokens_per_second(tokens: Column, elapsed: Column) -> Column:
    """Two decimals, from the unrounded time; null when no time passed."""
    return F.bround(F.try_divide(tokens, elapsed), 2)
