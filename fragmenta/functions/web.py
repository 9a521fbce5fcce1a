"""What the HTTP side computes: ranges, content types, kinds, escapes, labels and states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content types by last extension.
OPAQUE_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "ppt": "application/vnd.ms-powerpoint",
    "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "zip": "application/zip",
    "tar": "application/x-tar",
    "gz": "application/gzip",
    "gzip": "application/gzip",
    "bz2": "application/x-bzip2",
    "xz": "application/x-xz",
    "7z": "application/x-7z-compressed",
    "rar": "application/vnd.rar",
    "epub": "application/epub+zip",
    "mobi": "application/x-mobipocket-ebook",
    "rtf": "application/rtf",
    "sqlite": "application/vnd.sqlite3",
    "db": "application/vnd.sqlite3",
    "exe": "application/vnd.microsoft.portable-executable",
    "dll": "application/vnd.microsoft.portable-executable",
    "dmg": "application/x-apple-diskimage",
    "iso": "application/x-iso9660-image",
}
TEXT_TYPES = {
    "md": "text/markdown; charset=utf-8",
    "markdown": "text/markdown; charset=utf-8",
    "html": "text/html; charset=utf-8",
    "htm": "text/html; charset=utf-8",
    "json": "application/json; charset=utf-8",
    "css": "text/css; charset=utf-8",
    "csv": "text/csv; charset=utf-8",
}
# HTTP status by kind of error.
STATUS = {"NotFound": 404, "NotADirectory": 400, "IsDirectory": 400, "BadRequest": 400, "PreviewUnsupported": 400, "LayerLost": 503, "Conflict": 409, "Unavailable": 503}
# File signatures in hex, by kind.
MAGIC = {"image": ("89504e470d0a1a0a", "ffd8ff", "47494638", "424d"), "audio": ("52494646........57415645", "664c6143", "4f676753", "494433", "fffb")}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def opaque_type(name: Column) -> Column:
    """By what follows the last dot; a name without one counts whole."""
    return F.coalesce(F.element_at(_map(OPAQUE_TYPES), F.substring_index(_ascii_lower(name), ".", -1)), F.lit("application/octet-stream"))


def text_type(name: Column) -> Column:
    ext = F.when(F.contains(name, F.lit(".")), F.substring_index(_ascii_lower(name), ".", -1)).otherwise("")
    return F.coalesce(F.element_at(_map(TEXT_TYPES), ext), F.lit("text/plain; charset=utf-8"))


def kind_of(body: Column) -> Column:
    """image, audio, text or opaque, tried in this order, by signature and by whether the bytes are UTF-8."""
    head = F.lower(F.hex(F.substring(body, 1, 16)))
    match = lambda kind: reduce(lambda a, b: a | b, (head.rlike(f"^{m}") for m in MAGIC[kind]))
    return F.when(match("image"), "image").when(match("audio"), "audio").when(F.is_valid_utf8(body.cast("string")), "text").otherwise("opaque")


def status(error: Column) -> Column:
    return F.coalesce(F.element_at(_map(STATUS), error), F.lit(500))


def parse_range(header: Column, total: Column) -> Column:
    """Struct of outcome, first, last and status for a Range header over `total` bytes: a single range is cut, others are answered whole."""
    h = F.btrim(F.coalesce(header, F.lit("")))
    parts = F.filter(F.transform(F.split(F.substring(h, 7, 1 << 30), ","), lambda x: F.btrim(x)), lambda x: x != "")
    one = F.get(parts, F.lit(0))
    a, b = F.btrim(F.substring_index(one, "-", 1)), F.btrim(F.regexp_extract(one, r"^[^-]*-(.*)$", 1))
    number = lambda x: F.when(x.rlike(r"^\+?[0-9]+$"), F.try_to_number(F.regexp_replace(x, r"^\+", ""), F.lit("9" * 18)).cast("long"))
    na, nb = number(a), number(b)
    lost, bad = F.lit("Unsatisfiable"), F.lit("Malformed")
    suffix = F.when(nb.isNull(), bad).when((nb == 0) | (total == 0), lost).otherwise("Range")
    closed = F.when(na.isNull(), bad).when((total == 0) | (na >= total), lost).when(b == "", "Range").when(nb.isNull(), bad).when(nb < na, lost).otherwise("Range")
    outcome = F.when(h == "", "NoRange").when(~F.startswith(h, F.lit("bytes=")), bad).when(F.size(parts) == 0, bad).when(F.size(parts) > 1, "Multiple")
    outcome = outcome.when(~F.contains(one, F.lit("-")), bad).when(a == "", suffix).otherwise(closed)
    first = F.when(outcome == "Range", F.when(a == "", total - F.least(nb, total)).otherwise(na))
    last = F.when(outcome == "Range", F.when((a == "") | (b == ""), total - 1).otherwise(F.least(nb, total - 1)))
    code = F.when(outcome == "Range", 206).when(outcome == "Unsatisfiable", 416).otherwise(200)
    return F.struct(outcome.alias("outcome"), first.alias("first"), last.alias("last"), code.alias("status"))


def form_decode(value: Column) -> Column:
    """Plus is a blank, %XX one Latin-1 character; a broken escape stays as it is."""
    spaced = F.translate(value, "+", " ")
    parts = F.regexp_extract_all(spaced, F.lit(r"(?s)(%[0-9A-Fa-f]{2}|.)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), F.chr(F.conv(F.substring(p, 2, 2), 16, 10).cast("int"))).otherwise(p)), "")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def json_escape(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":"(.*)"\}$', 1)


def hex_block(data: Column, width: int = 16) -> Column:
    """Lower-case hex, `width` bytes a line."""
    return F.regexp_replace(F.lower(F.hex(data)), f"(.{{{2 * width}}})(?=.)", "$1\n")


def channel_label(channel: Column, channels: Column) -> Column:
    rgb = F.when(channel == 0, "R").when(channel == 1, "G").when(channel == 2, "B")
    return F.when((channels == 3) & rgb.isNotNull(), rgb).when((channels == 2) & channel.isin(0, 1), F.when(channel == 0, "L").otherwise("R")).otherwise(F.concat(F.lit("ch"), channel))


def margin_state(margin: Column) -> Column:
    return F.when(margin < 0, "bad").when(margin == 0, "partial").otherwise("ok")


def similarity_state(percent: Column) -> Column:
    return F.when(percent > 90, "ok").when(percent > 50, "partial").otherwise("bad")


def share_label(percent: Column) -> Column:
    return F.when((percent > 0) & (percent < 0.1), "<0.1%").otherwise(F.format_string("%.1f%%", percent))


def zone_label(resolution: Column) -> Column:
    """What a resolution leaves: L0, L0-Lx or, for null, DEAD."""
    return F.coalesce(F.when(resolution == 0, "L0").otherwise(F.concat(F.lit("L0-L"), resolution.cast("string"))), F.lit("DEAD"))
