"""Content keys, request decoding and placeholder filling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Placeholder patterns, strict base64 shape, request size limit in bytes.
RES_SLOT = r"\{\{\s*res\s*\}\}"
BBOX_SLOT = r"\{\{\s*bbox\s*\}\}"
STRICT_BASE64 = r"^[A-Za-z0-9+/]*={0,2}\z"
URLSAFE_BASE64 = r"^[A-Za-z0-9_-]+={0,2}\z"
MAX_REQUEST_BYTES = 16 * 1024


def _utf8(b64: Column) -> Column:
    # a bad byte sequence gives NULL; the plain decoder would fail the job
    return F.try_validate_utf8(F.try_to_binary(b64, F.lit("base64")).cast("string"))


def decode_strict(q: Column) -> Column:
    """Standard base64 to text; NULL for absent, empty, malformed or non-UTF-8 input."""
    return F.when(q.rlike(STRICT_BASE64) & (F.length(q) > 0) & (F.length(q) % 4 == 0), _utf8(q))


def decode_urlsafe(q: Column) -> Column:
    """URL-safe base64 to text, padding optional."""
    bare = F.rtrim(q, F.lit("="))
    whole = F.translate(bare, "-_", "+/")
    padded = F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), F.lit("="))
    return F.when(q.rlike(URLSAFE_BASE64) & (F.length(bare) % 4 != 1), _utf8(padded))


def fill_res(text: Column, res: Column) -> Column:
    """Put the resolution into every ``{{res}}`` slot."""
    return F.regexp_replace(text, F.lit(RES_SLOT), res.cast("string"))


def drop_bbox(text: Column) -> Column:
    return F.regexp_replace(text, BBOX_SLOT, "")


def too_large(text: Column) -> Column:
    return F.octet_length(text) > MAX_REQUEST_BYTES


def _digest(*parts: Column) -> Column:
    # concat_ws skips NULLs, which would shift the fields: absent parts become ''
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *filled), 256)


def tile_key(db: Column, q: Column, z: Column, x: Column, y: Column, res: Column,
             release: Column, mtime: Column) -> Column:
    return _digest(db, q, z, x, y, res, release, mtime)


def summary_key(db: Column, q: Column, release: Column, mtime: Column,
                res: Column | None = None) -> Column:
    """Key of a layer summary; give ``res`` when the text still has an unfilled slot."""
    parts = [F.lit("stats"), db, q, release, mtime]
    return _digest(*parts, res) if res is not None else _digest(*parts)


def canonical_url(url: Column) -> Column:
    """The URL with its query parameters in sorted order; other URLs unchanged."""
    path = F.substring_index(url, "?", 1)
    query = F.substr(url, F.length(path) + 2)
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.when(F.contains(url, F.lit("?")), F.concat_ws("?", path, ordered)).otherwise(url)
