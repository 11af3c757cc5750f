"""File-name, media-type and size functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: extension -> media type
MIME_TYPES = {
    "csv": "text/csv", "txt": "text/plain", "tsv": "text/tab-separated-values", "json": "application/json",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "parquet": "application/vnd.apache.parquet", "png": "image/png", "pdf": "application/pdf",
}
UNKNOWN_MIME = "application/octet-stream"
# fixed values: file classes
CSV_EXTENSIONS = ["csv", "txt"]
EXCEL_EXTENSIONS = ["xls", "xlsx", "xlsm", "xlsb"]
# fixed values: admission rule
ALLOWED_EXTENSIONS = ["csv", "xlsx", "xls"]
ALLOWED_TYPES = ["text/csv", MIME_TYPES["xls"], MIME_TYPES["xlsx"]]
MAX_BYTES = 100 * 1024 * 1024


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def mime_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit(UNKNOWN_MIME))


def category(name: Column) -> Column:
    ext, mime = extension(name), mime_type(name)
    return (
        F.when(ext.isin(CSV_EXTENSIONS) | (mime == "text/csv"), "csv")
        .when(ext.isin(EXCEL_EXTENSIONS), "excel")
        .when(ext == "json", "json")
        .otherwise("other")
    )


def kilobytes(size: Column) -> Column:
    return F.round(size / 1024.0, 2)


def megabytes(size: Column) -> Column:
    return F.round(size / (1024.0 * 1024.0), 2)


def gigabytes(size: Column) -> Column:
    return size / (1024.0 * 1024.0 * 1024.0)


def admission_reason(name: Column, size: Column, allowed_types: list[str] | None = None,
                     allowed_extensions: list[str] | None = None, max_bytes: int = MAX_BYTES) -> Column:
    """Null when a file is admitted, otherwise why not.  ``image/*`` style types are prefixes."""
    types = ALLOWED_TYPES if allowed_types is None else allowed_types
    exts = ALLOWED_EXTENSIONS if allowed_extensions is None else allowed_extensions
    if not types and not exts:
        raise ValueError("name allowed types or allowed extensions")
    mime, ok = mime_type(name), F.lit(False)
    for kind in types:
        ok = ok | (mime.startswith(kind[:-1]) if kind.endswith("/*") else mime == kind)
    if exts:
        ok = ok | extension(name).isin([e.lstrip(".").lower() for e in exts])
    return F.when(~ok, "type not allowed").when(size > max_bytes, "too large")
