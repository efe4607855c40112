"""Path, file-type and CSV text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the default image file pattern.
IMAGE_PATTERN = r"\.(png|jpg|jpeg|bmp|tiff?)$"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    """Directory part, empty for a root file."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of the stem."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def sequence_name(path: Column, folders_as_sequences: bool = True) -> Column:
    if not folders_as_sequences:
        return path
    folder = parent(path)
    bare = stem(path)
    return F.when(folder != "", folder).when(bare != "", bare).otherwise(F.lit("unnamed"))


def below(path: Column, root: str) -> Column:
    """A file's path relative to the folder it was read from."""
    return F.substring_index(path, root.rstrip("/").rpartition("://")[2].removeprefix("file:") + "/", -1)


def bare_path(path: Column) -> Column:
    """A relative path without its ending."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def sniff_mime(content: Column) -> Column:
    """Image type from the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    # File signatures in hexadecimal.
    return (
        F.when(F.length(content) < 8, "application/octet-stream")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("424D"), "image/bmp")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .otherwise("application/octet-stream")
    )


def csv_field(text: Column) -> Column:
    """Quote a field that holds a comma, a quote or a newline."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, r'[/\\:*?"<>|]', "_")
