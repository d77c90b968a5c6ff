"""Column expressions that build file records. All are built-in functions: none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filequarry.config import Config

NO_CREATION = "1990-01-01 00:00:00"
NO_TYPE = "unk/unk"


def relative_path(file: Column, root: str, everywhere: bool = False, above: bool = False) -> Column:
    """file below root, without it; a file elsewhere as it is, or (above) with .. for each folder to leave, if both are absolute.

    everywhere: root's text is taken out wherever it stands, as older records have it.
    """
    if everywhere:
        return F.replace(file, F.lit(root), F.lit(""))
    root = root.rstrip("/") + "/"
    below = F.substring(file, F.lit(len(root) + 1), F.length(file))
    if not above or not root.startswith("/"):
        return F.when(F.startswith(file, F.lit(root)), below).otherwise(file)
    folders = [f for f in root.split("/") if f not in ("", ".")]
    steps = F.filter(F.split(file, "/"), lambda s: ~s.isin("", "."))
    known = F.array(*map(F.lit, folders)).cast("array<string>")
    same = F.zip_with(known, F.slice(steps, 1, max(1, len(folders))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    common = F.coalesce(F.nullif(F.array_position(F.slice(same, 1, len(folders)), False), F.lit(0)) - 1, F.lit(len(folders))).cast("int")
    elsewhere = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.lit(len(folders)) - common), F.slice(steps, common + 1, F.size(steps) + 1)), "/")
    return F.when(F.startswith(file, F.lit(root)), below).when(F.startswith(file, F.lit("/")), elsewhere).otherwise(file)


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, r"(?s)([^/]*)\z", 1)


def suffix(path: Column) -> Column:
    """The extension with its dot, in its own case; empty where only leading dots stand before it."""
    return F.regexp_extract(basename(path), r"(?s)\A\.*[^.].*(\.[^.]*)\z", 1)


def ftype(suf: Column, config: Config | None = None) -> Column:
    """doc, pic, vid or null for a suffix in any case."""
    config = config or Config()
    low = F.lower(suf)
    return F.when(low.isin(*config.docsuf), "doc").when(low.isin(*config.picsuf), "pic").when(low.isin(*config.vidsuf), "vid")


def nul_scrubbed(text: Column) -> Column:
    """text with every NUL character written as null, which the stores behind it can hold."""
    return F.replace(text, F.lit("\x00"), F.lit("null"))


def meta_value(meta: Column, key: str) -> Column:
    """The value under a top-level key of a JSON object, of a list its first entry; null where missing, null or an empty list."""
    value = F.get_json_object(meta, f"$['{key}']")
    return F.when(F.substring(F.ltrim(value), 1, 1) == "[", F.get_json_object(meta, f"$['{key}'][0]")).otherwise(value)


def meta_keys(meta: Column) -> Column:
    """Top-level keys in the order they stand in; empty where there is no object."""
    return F.coalesce(F.json_object_keys(meta), F.array().cast("array<string>"))


def wall_time(text: Column) -> Column:
    """The local date and time that an ISO text gives, its zone left out; null where it gives none."""
    return F.regexp_replace(F.trim(text), r"\s*(?:[Zz]|[+-]\d{2}:?\d{2})\z", "").try_cast("timestamp_ntz")


def content_length(meta: Column) -> Column:
    return F.coalesce(meta_value(meta, "Content-Length").try_cast("bigint"), F.lit(0).cast("bigint"))


def content_type(meta: Column) -> Column:
    return F.coalesce(meta_value(meta, "Content-Type"), F.lit(NO_TYPE))


def sort_date_of_file(meta: Column, fdate: Column) -> Column:
    """The creation date, else the file's date."""
    return F.coalesce(wall_time(meta_value(meta, "dcterms:created")), fdate)


def sort_date_of_document(meta: Column) -> Column:
    """The creation date, else the first day of 1990."""
    return F.coalesce(wall_time(meta_value(meta, "dcterms:created")), F.lit(NO_CREATION).cast("timestamp_ntz"))


def sha256(content: Column) -> Column:
    """The 32 bytes of the content's hash."""
    return F.unhex(F.sha2(content, 256))


def search_text(fname: Column, text: Column, fused: bool = False, most: int = 800_000) -> Column:
    """What full-text search sees: the name, then the text, up to `most` characters. fused: without a blank between, as older indexes have it."""
    return F.left(F.concat(fname, F.lit("" if fused else " "), F.coalesce(text, F.lit(""))), F.lit(most))
