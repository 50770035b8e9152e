"""Columns over raw files: type, MIME, admission, routing, stored names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal signatures by type, in the order in which they are tried.
TYPE_SIGNATURES = (("pdf", "25504446"), ("image", "FFD8FF"), ("image", "89504E47"), ("image", "474946383761"), ("image", "474946383961"), ("image", "424D"), ("image", "49492A00"), ("image", "4D4D002A"))
#: Likewise by MIME type.
MIME_SIGNATURES = (("image/jpeg", "FFD8"), ("image/png", "89504E470D0A1A0A"), ("image/gif", "47494638"), ("image/bmp", "424D"), ("image/webp", "52494646"), ("image/tiff", "49492A00"), ("image/tiff", "4D4D002A"))
#: Extensions.
EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp", "image/tiff": "tiff"}
MIMES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tiff": "image/tiff"}
MB = 1024 * 1024
#: Largest upload by channel, in bytes.
UPLOAD_LIMITS = {"user": 100 * MB, "trial": 10 * MB, "enterprise": 50 * MB}
COMPRESS_ABOVE, ENGINE_LIMIT = 45 * MB, 50 * MB
#: What an engine's error says when a file is too large.
TOO_LARGE_ERRORS = ("413", "Payload Too Large", "Request size limit")
RIFF, WEBP = "52494646", "57454250"


def header(content: Column, n: int = 12) -> Column:
    """The first bytes in hexadecimal; nothing else of the file is touched."""
    return F.hex(F.substring(content, 1, n))


def has_webp(head: Column) -> Column:
    """Whether RIFF bytes have WEBP among the first twelve, at any byte."""
    at = [F.substring(head, 2 * i + 1, 8) == WEBP for i in range(9)]
    found = at[0]
    for x in at[1:]:
        found = found | x
    return head.startswith(RIFF) & found


def file_type(content: Column) -> Column:
    """pdf, image or unknown from magic bytes; fewer than ten bytes are unknown, and so is null."""
    head = header(content)
    out = F.when(F.coalesce(F.length(content), F.lit(0)) < 10, "unknown")
    for kind, start in TYPE_SIGNATURES:
        out = out.when(head.startswith(start), kind)
    return out.when(has_webp(head), "image").otherwise("unknown")


def image_mime(content: Column) -> Column:
    """MIME type from magic bytes; JPEG where none fits."""
    head = header(content)
    out = None
    for mime, start in MIME_SIGNATURES:
        test = has_webp(head) if mime == "image/webp" else head.startswith(start)
        out = F.when(test, mime) if out is None else out.when(test, mime)
    return out.otherwise("image/jpeg")


def base64_mime(encoded: Column) -> Column:
    """MIME type from the first 16 characters of base64 text; JPEG where they don't decode."""
    return image_mime(F.try_to_binary(F.substring(encoded, 1, 16), F.lit("base64")))


def extension_of(mime: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[mime], F.lit("jpg"))


def mime_of(extension: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MIMES.items() for x in kv])[F.lower(extension)], F.lit("image/jpeg"))


def upload_limit(channel: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in UPLOAD_LIMITS.items() for x in kv])[channel]


def admission(size: Column, kind: Column, channel: Column) -> Column:
    """The first failing rule of an upload: empty, too large, of unknown type; else ok."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, "400 empty").when(size > upload_limit(channel), "413 too large").when(kind == "unknown", "415 unknown").otherwise("ok")


def engine(role: Column, active: Column) -> Column:
    """OCR engine of a caller; role is null for anonymous callers."""
    return F.when(role.isNull(), "docai").when(role.isin("super_user", "admin"), "mistral").when(F.coalesce(active, F.lit(False)), "mistral").otherwise("docai")


def size_route(engine: Column, size: Column, compressed: Column, error: Column) -> Column:
    """struct(route, reason): of files for mistral, compress large ones, fall back if still too large or refused as such, else an error.

    Files for another engine go to docai whatever their size.
    """
    refused = F.lit(False)
    for text in TOO_LARGE_ERRORS:
        refused = refused | F.coalesce(F.contains(error, F.lit(text)), F.lit(False))
    left = F.when(size > COMPRESS_ABOVE, F.coalesce(compressed, size)).otherwise(size)
    other = engine != "mistral"
    route = F.when(other, "docai").when(left > ENGINE_LIMIT, "docai").when(refused, "docai").when(error.isNotNull(), "error").when(size > COMPRESS_ABOVE, "compress").otherwise("mistral")
    reason = F.when(other, None).when(left > ENGINE_LIMIT, "size").when(refused, "refused").when(error.isNotNull(), "error")
    return F.struct(route.alias("route"), reason.alias("reason"))


def stored_name(filename: Column, at: Column, key: Column) -> Column:
    """timestamp_id_stem.extension: the stem keeps letters, digits, - and _, 50 at most; the id is a hash of key."""
    extension = F.when(F.contains(filename, F.lit(".")), F.concat(F.lit("."), F.substring_index(filename, ".", -1))).otherwise("")
    base = F.when(F.contains(filename, F.lit(".")), F.substring(filename, F.lit(1), F.length(filename) - F.length(extension))).otherwise(filename)
    safe = F.substring(F.regexp_replace(base, r"[^\p{L}\p{N}_-]", ""), 1, 50)
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.sha2(key.cast("string"), 256), 1, 8), F.lit("_"), safe, extension)
