"""Functions of paths, versions and addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col


def natural_key(path: Column | str) -> Column:
    """A sortable key: parts of a path in turn, digits by value, then fewer zeros in front, other characters without ASCII case, last the part as it is.

    A part is an array of (character, digits of the number, number, its length as written); a run of digits has character '0'.
    """

    def units(part: Column) -> Column:
        number = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
        digit = lambda x: x.rlike("^[0-9]")
        ascii_lower = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.transform(
            F.regexp_extract_all(part, F.lit("(?s)[0-9]+|[^0-9]"), F.lit(0)),
            lambda x: F.struct(
                F.when(digit(x), F.lit("0")).otherwise(ascii_lower(x)).alias("c"),
                F.when(digit(x), F.length(number(x))).otherwise(F.lit(0)).alias("n"),
                F.when(digit(x), number(x)).otherwise(F.lit("")).alias("v"),
                F.when(digit(x), F.length(x)).otherwise(F.lit(0)).alias("z"),
            ),
        )

    return F.transform(F.split(col(path), "/"), lambda p: F.struct(units(p).alias("u"), p.alias("raw")))


def path_key(path: Column | str) -> Column:
    """Orders paths part by part."""
    return F.split(col(path), "/")


def is_book(path: Column | str) -> Column:
    return col(path).rlike(r"(?i)\.(pdf|cbz)\z")


def is_junk(path: Column | str) -> Column:
    """What archivers and desktops leave behind."""
    return F.exists(F.split(col(path), "/"), lambda p: F.lower(p).isin("__macosx", ".ds_store", "thumbs.db") | F.startswith(p, F.lit("._")))


def is_unsafe(path: Column | str) -> Column:
    """Absolute, with a drive, with a part that leads upwards, or with a null character."""
    x = F.translate(col(path), "\\", "/")
    return F.startswith(x, F.lit("/")) | (F.substring(x, 2, 1) == ":") | F.exists(F.split(x, "/"), lambda p: (p == "..") | (F.instr(p, "\0") > 0))


def has_image_extension(path: Column | str) -> Column:
    return col(path).rlike(r"(?i)\.(jpg|jpeg|png)\z")


def normalized(path: Column | str) -> Column:
    """Without parts that say nothing."""
    return F.array_join(F.filter(F.split(F.translate(col(path), "\\", "/"), "/"), lambda p: ~p.isin("", ".")), "/")


def basename(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"[^/\\]*\z", 0)


def with_extension(path: Column | str, extension: str = "epub") -> Column:
    """The last part's extension exchanged, or added where there is none."""
    x = col(path)
    return F.concat(F.regexp_replace(x, r"(?<=[^/])\.[^./]*\z", ""), F.lit(f".{extension}"))


def ratio_exceeded(expanded: Column | str, compressed: Column | str, most: int = 1000) -> Column:
    """More than `most` bytes from each compressed one; compared without overflow."""
    e, c = col(expanded).cast("decimal(38,0)"), col(compressed).cast("decimal(38,0)")
    return (e > 0) & ((c == 0) | (e > c * most))


def version_parts(version: Column | str) -> Column:
    """Numbers of a version, without a leading v and what follows - or +; 0 for what is none."""
    x = F.regexp_extract(F.regexp_replace(col(version), r"^\s*[vV]", ""), r"^[^\-+]*", 0)
    return F.transform(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(0).cast("bigint")))


def is_newer(version: Column | str, than: Column | str) -> Column:
    """Compares number by number, however many there are; missing ones are 0."""
    a, b = version_parts(version), version_parts(than)
    pair = F.zip_with(a, b, lambda x, y: F.struct(F.coalesce(x, F.lit(0)).alias("a"), F.coalesce(y, F.lit(0)).alias("b")))
    differs = F.filter(pair, lambda p: p["a"] != p["b"])
    return F.coalesce(F.get(differs, F.lit(0))["a"] > F.get(differs, F.lit(0))["b"], F.lit(False))


def is_release_url(url: Column | str, host: str = "github.com", root: str = "/") -> Column:
    """https, this host, no user, password or port, and a path at or below root."""
    u = col(url)
    part = lambda p: F.parse_url(u, F.lit(p))
    path = F.coalesce(part("PATH"), F.lit(""))
    below = (path == root.rstrip("/")) | F.startswith(path, F.lit(root.rstrip("/") + "/")) | (F.lit(root == "/") & (path == ""))
    return F.coalesce((F.lower(part("PROTOCOL")) == "https") & (F.lower(part("AUTHORITY")) == host) & below, F.lit(False))
