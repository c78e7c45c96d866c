"""Numbers from digests of text: the same in every run, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*keys: Column) -> Column:
    """A number below 2 ** 48 from the keys' text."""
    text = F.concat_ws("/", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def digest_sql(*keys: str) -> str:
    return f"('0x' || substr(md5({' || chr(47) || '.join(f'({k})::VARCHAR' for k in keys)}), 1, 12))::BIGINT"
