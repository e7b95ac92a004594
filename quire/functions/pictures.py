"""Pictures: data URIs, formats by their first bytes, sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

#: Types that are read, their extensions, and first bytes in hex (fixed values).
EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png"}
FORMATS = {".png": "PNG", ".jpg": "JPEG", ".jpeg": "JPEG"}
MAGIC = {"PNG": "89504E470D0A1A0A", "JPEG": "FFD8FF", "GIF": "47494638", "BMP": "424D", "TIFF": "49492A00"}


def mime_type(uri) -> Column:
    """The type that a data URI states, lower-cased; empty if it is none."""
    return F.lower(strip(F.regexp_extract(strip(uri), r"(?is)^data:([^;,]*)", 1)))


def extension(mime) -> Column:
    known = F.create_map(*[F.lit(v) for pair in EXTENSIONS.items() for v in pair])
    return F.coalesce(F.try_element_at(known, F.lower(strip(mime))), F.lit(""))


def report_source(uri) -> Column:
    """A data URI as reports name it, without its payload."""
    return F.concat(F.lit("inline data URI image ("), F.coalesce(F.nullif(mime_type(uri), F.lit("")), F.lit("unknown type")), F.lit(")"))


def detected(data: Column) -> Column:
    """The format by the first bytes; null if unknown."""
    first = F.hex(F.substring(data, 1, 8))
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, magic in MAGIC.items():
        rule = rule.when(first.startswith(magic), name)
    return rule


def data_uri(uri) -> Column:
    """struct(data, ext, error) of a data URI: its bytes if they are a picture of the stated type (by their first bytes)."""
    raw, mime = strip(uri), mime_type(uri)
    ext = extension(mime)
    payload = F.regexp_extract(raw, r"(?s)^[^,]*,(.*)$", 1)
    data = F.when(F.lower(F.regexp_extract(raw, r"(?s)^([^,]*),", 1)).contains(";base64"), F.when(payload.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(payload) % 4 == 0), F.try_to_binary(payload, F.lit("base64")))).otherwise(F.try_url_decode(F.replace(payload, F.lit("+"), F.lit("%2B"))).cast("binary"))
    kinds = F.create_map(*[F.lit(v) for pair in FORMATS.items() for v in pair])
    error = (
        F.when(~raw.contains(","), "data URI is missing a comma separator")
        .when(ext == "", F.concat(F.lit("unsupported data URI image type: "), F.coalesce(F.nullif(mime, F.lit("")), F.lit("unknown"))))
        .when(data.isNull(), "invalid data URI image payload")
        .when(F.octet_length(data) == 0, "empty data URI image payload")
        .when(detected(data).isNull(), "unreadable data URI image payload")
        .when(detected(data) != F.try_element_at(kinds, ext), F.concat(F.lit("data URI MIME type "), mime, F.lit(" does not match detected format "), detected(data)))
        .otherwise("")
    )
    return F.struct(F.when(error == "", data).alias("data"), F.when(raw.contains(","), ext).otherwise("").alias("ext"), error.alias("error"))


def file_error(path, content: Column) -> Column:
    """Why a picture file can't be used, from its name and bytes; empty if it can."""
    ext = F.lower(F.regexp_extract(col(path), r"(\.[^./\\]*)$", 1))
    kinds = F.create_map(*[F.lit(v) for pair in FORMATS.items() for v in pair])
    wanted = F.try_element_at(kinds, ext)
    return (
        F.when(wanted.isNull(), F.concat(F.lit("unsupported local image format: "), F.coalesce(F.nullif(ext, F.lit("")), F.lit("(no extension)"))))
        .when(detected(content).isNull(), "unreadable image")
        .when(detected(content) != wanted, F.concat(F.lit("image extension "), ext, F.lit(" does not match detected format "), detected(content)))
        .otherwise("")
    )


def is_landscape(width: Column, height: Column, orientation=None) -> Column:
    wide = F.coalesce((width > height) & (height > 0), F.lit(False))
    return wide if orientation is None else F.coalesce(F.col(orientation) == "landscape", F.lit(False)) | wide


def size_differs(a_width: Column, a_height: Column, b_width: Column, b_height: Column, tolerance: float = 2.0) -> Column:
    """Whether two page sizes, all positive, differ by more than the tolerance."""
    known = (a_width > 0) & (a_height > 0) & (b_width > 0) & (b_height > 0)
    return F.coalesce(known & ((F.abs(a_width - b_width) > tolerance) | (F.abs(a_height - b_height) > tolerance)), F.lit(False))


def pages_missing(first: Column, second: Column) -> Column:
    """Whether a second rendering lacks more pages with text than an eighth, two at least."""
    a, b = F.coalesce(first, F.lit(0)), F.coalesce(second, F.lit(0))
    return (a > 0) & ((b <= 0) | (a - b > F.greatest(F.lit(2), F.floor(a / 8))))
