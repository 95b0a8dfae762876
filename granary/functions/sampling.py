"""Reproducible choices: numbers in [0, 1) from md5, equal in other SQL engines."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column | str, salt: str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def uniform_sql(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(({key})::VARCHAR || '{salt}'), 1, 8))::BIGINT / 4294967296.0)"
