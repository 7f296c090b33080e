"""File kinds by name and by content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their types.
BY_EXTENSION = {
    "pdf": "application/pdf",
    "html": "text/html",
    "htm": "text/html",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain",
}
#: Further types that the name of a file tells where its content does not.
FURTHER = {"doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint", "csv": "text/csv", "md": "text/markdown", "xml": "text/xml", "log": "text/plain"}
IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}
UNKNOWN = "application/octet-stream"


def _lookup(known: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.lower(key)), F.lit(default))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def mime_by_name(path: Column) -> Column:
    return _lookup(BY_EXTENSION, extension(path), UNKNOWN)


def image_type(kind: Column) -> Column:
    return _lookup(IMAGES, kind, "image/png")


def mime(content: Column, path: Column) -> Column:
    """By the first bytes; zip containers and texts by the name."""
    head = F.hex(F.substring(content, 1, 4))
    start = F.lower(F.substring(content, 1, 512).cast("string"))
    named = _lookup(BY_EXTENSION | FURTHER, extension(path), UNKNOWN)
    return (
        F.when(head == "25504446", "application/pdf")
        .when(head == "504B0304", F.when(named.startswith("application/vnd"), named).otherwise("application/zip"))
        .when(head == "D0CF11E0", F.when(named.isin("application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint"), named).otherwise("application/x-ole-storage"))
        .when(head == "89504E47", "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(start.rlike(r"^\s*(<!doctype html|<html|<head|<body)"), "text/html")
        .when((named == UNKNOWN) & F.is_valid_utf8(content), "text/plain")
        .otherwise(named)
    )


def sub_structure(kind: Column, content: Column) -> Column:
    """A label for each type; a PDF without a font in its first 64 KB is a scan."""
    has_font = F.contains(F.substring(content, 1, 65536), F.lit(bytearray(b"/Font")))
    return (
        F.when(kind == "application/pdf", F.when(has_font, "text-native-pdf").otherwise("scanned-pdf"))
        .when(kind.contains("spreadsheetml") | (kind == "application/vnd.ms-excel"), "spreadsheet-xlsx")
        .when(kind.contains("wordprocessingml") | (kind == "application/msword"), "docx-document")
        .when(kind.contains("presentationml"), "pptx-presentation")
        .when(kind == "text/html", "html-document")
        .when(kind.startswith("text/"), "plain-text")
        .otherwise("unknown")
    )


def encoding(kind: Column, content: Column) -> Column:
    """Of office files UTF-8, of PDF its own; else a byte order mark, or UTF-8 where the bytes are valid."""
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(kind.contains("openxmlformats"), "utf-8")
        .when(kind == "application/pdf", "pdf-internal")
        .when(head == "EFBBBF", "utf-8-sig")
        .when(head.startswith("FFFE"), "utf-16-le")
        .when(head.startswith("FEFF"), "utf-16-be")
        .when(F.is_valid_utf8(content), "utf-8")
        .otherwise("unknown")
    )
