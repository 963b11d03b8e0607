"""Layer requests as a table: decoding, filling, size flag and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hexatlas.functions import keys


def decoded_requests(requests: DataFrame, q: str = "q", res: Column | None = None,
                     urlsafe: bool = False) -> DataFrame:
    """Add ``text`` (NULL when undecodable) and ``too_large`` to a table of requests.

    The whole text is decoded and kept; the flag only reports its size.
    """
    decode = keys.decode_urlsafe if urlsafe else keys.decode_strict
    text = decode(F.col(q))
    if res is not None:
        text = keys.fill_res(text, res)
    return (requests.withColumn("text", keys.drop_bbox(text))
            .withColumn("too_large", keys.too_large(F.col("text"))))


def request_counts(requests: DataFrame, url: str) -> DataFrame:
    """Hits per canonical request; a request repeated a billion times combines map-side."""
    return (requests.groupBy(keys.canonical_url(F.col(url)).alias("request"))
            .agg(F.count(F.lit(1)).alias("hits")))
