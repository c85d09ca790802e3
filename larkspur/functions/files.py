"""Columns over file names, sizes and types. The tables below are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of each category, in three schemes.
CATEGORIES = {
    "document": ".pdf .doc .docx .txt .rtf .odt .md .tex",
    "spreadsheet": ".xls .xlsx .csv .ods",
    "presentation": ".ppt .pptx .odp",
    "image": ".jpg .jpeg .png .gif .bmp .tiff .tif .webp .svg .ico .raw",
    "audio": ".mp3 .wav .flac .aac .ogg .m4a .wma",
    "video": ".mp4 .avi .mov .wmv .flv .webm .mkv .m4v",
    "archive": ".zip .rar .7z .tar .gz .bz2",
    "code": ".py .js .html .css .java .cpp .c .h .php .rb .go .rs .json .xml .yml .yaml .sql",
    "executable": ".exe .msi .dmg .app .deb .rpm",
    "font": ".ttf .otf .woff .woff2",
    "database": ".db .sqlite .mdb",
    "config": ".ini .cfg .conf .properties",
}
PLURAL = {
    "documents": ".pdf .docx .doc .txt .rtf .odt",
    "spreadsheets": ".xlsx .xls .csv .ods",
    "presentations": ".pptx .ppt .odp",
    "images": ".jpg .jpeg .png .gif .bmp .tiff .webp",
    "archives": ".zip .rar .7z .tar .gz",
    "code": ".py .js .java .cpp .c .html .css .php .rb",
}
CONVERSIONS = {
    "pdf": "docx txt", "docx": "pdf txt", "doc": "pdf docx txt", "txt": "pdf docx", "csv": "xlsx json", "xlsx": "csv pdf",
    "jpg": "png webp pdf", "jpeg": "png webp pdf", "png": "jpg webp pdf", "gif": "png jpg pdf", "webp": "png jpg pdf",
    "json": "csv yaml xml", "yaml": "json xml", "xml": "json yaml",
}
#: Categories as the scanner, the file record and the type detector have them.
SCANNED = {
    "document": ".txt .md .pdf .doc .docx .rtf",
    "code": ".py .js .html .css .java .cpp .c .h",
    "image": ".jpg .jpeg .png .gif .bmp .tiff .webp",
    "audio": ".mp3 .wav .flac .aac .ogg",
    "video": ".mp4 .avi .mov .mkv .webm",
    "archive": ".zip .tar .gz .7z .rar",
    "spreadsheet": ".xls .xlsx .csv",
    "presentation": ".ppt .pptx",
}
RECORDED = {
    "text": ".txt .md .rst",
    "code": ".py .js .html .css",
    "image": ".jpg .jpeg .png .gif",
    "document": ".pdf .doc .docx",
    "spreadsheet": ".xls .xlsx .csv",
    "archive": ".zip .tar .gz",
    "audio": ".mp3 .wav .flac",
    "video": ".mp4 .avi .mov",
}
DETECTED = {
    "document": ".pdf .docx .doc .txt .rtf .odt",
    "spreadsheet": ".csv .xlsx .xls .ods",
    "image": ".jpg .jpeg .png .gif .bmp .webp .tiff",
    "presentation": ".pptx .ppt .odp",
    "data": ".json .yaml .xml",
}
#: Programming languages by extension, conversion tools by both extensions, messages that let a file be skipped.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".java": "java", ".cpp": "cpp", ".c": "c", ".html": "html", ".css": "css", ".php": "php", ".rb": "ruby", ".go": "go",
    ".rs": "rust", ".ts": "typescript", ".sql": "sql", ".json": "json", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".txt": "text",
}
TOOLS = (
    (".csv", ".xlsx", "convert_csv_to_xlsx"),
    (".docx", ".pdf", "convert_docx_to_pdf"),
    (".doc", ".pdf", "convert_docx_to_pdf"),
    (".pdf", ".docx", "convert_pdf_to_docx"),
    (".txt", ".pdf", "convert_txt_to_pdf"),
)
SKIPPED = ("Permission denied", "File not found", "Unsupported format", "Corrupted file")
MAGIC = (
    ("25504446", "application/pdf"), ("504B0304", "application/zip"), ("D0CF11E0", "application/msword"), ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("424D", "image/bmp"), ("52494646", "video/avi"), ("1A45DFA3", "video/webm"),
    ("00000018", "video/mp4"), ("494433", "audio/mpeg"), ("4F676753", "audio/ogg"), ("526172211A07", "application/x-rar-compressed"),
    ("377ABCAF271C", "application/x-7z-compressed"), ("1F8B08", "application/gzip"), ("425A68", "application/x-bzip2"), ("FD377A585A", "application/x-xz"),
)
MIME = {".txt": "text/plain", ".py": "text/x-python", ".csv": "text/csv", ".pdf": "application/pdf", ".jpg": "image/jpeg", ".zip": "application/zip", ".mp3": "audio/mpeg"}
PREFIXES = (("text/", "document"), ("image/", "image"), ("audio/", "audio"), ("video/", "video"), ("application/", "binary"))


def by_extension(scheme: dict[str, str]) -> dict[str, str]:
    return {ext: name for name, exts in scheme.items() for ext in exts.split()}


def lookup(key: Column, table: dict[str, str], default: str | None) -> Column:
    """A literal map; for the small fixed tables that beats a join."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def category(ext: Column, scheme: dict[str, str] = CATEGORIES, default: str = "unknown") -> Column:
    return lookup(F.lower(ext), by_extension(scheme), default)


def magic(head_hex: Column) -> Column:
    """The type of the first signature that the bytes, in hex, start with."""
    return reduce(lambda rest, m: F.when(head_hex.startswith(m[0]), m[1]).otherwise(rest), reversed(MAGIC), F.lit(None).cast("string"))


def mime_category(mime: Column) -> Column:
    return reduce(lambda rest, p: F.when(mime.startswith(p[0]), p[1]).otherwise(rest), reversed(PREFIXES), F.lit("unknown"))


def human_size(n: Column, digits: int = 2, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """The size in the largest unit with a value of at least 1."""
    def in_unit(i: int) -> Column:
        # halves are rounded up here, as formatting differs between engines
        value = F.floor(n.cast("double") / F.lit(float(1024**i)) * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))
        return F.concat(F.format_string(f"%.{digits}f", value), F.lit(" " + units[i]))

    out = reduce(lambda rest, i: F.when(n >= 1024**i, in_unit(i)).otherwise(rest), range(1, len(units)), in_unit(0))
    return F.when(n == 0, F.lit("0 B")).otherwise(out)


def size_bucket(n: Column) -> Column:
    return F.when(n < 1024, "under_1K").when(n < 1048576, "under_1M").when(n < 10485760, "under_10M").otherwise("10M_up")


def mode_string(mode: Column) -> Column:
    """rwxr-xr-x of the low nine bits."""
    return F.array_join(F.transform(F.sequence(F.lit(8), F.lit(0), F.lit(-1)), lambda i: F.when((F.call_function("getbit", mode, i) == 1), F.element_at(F.array(F.lit("x"), F.lit("w"), F.lit("r")), (i % 3 + 1).cast("int"))).otherwise("-")), "")


def glob(pattern: str) -> str:
    """A glob of ``*``, ``?`` as a regular expression for whole names."""
    import re

    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"
