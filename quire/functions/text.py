"""Text functions as Column expressions: nothing here leaves the JVM.

White space is Unicode's, as in the documents' own tooling, unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The five characters that XML reserves, the ampersand first.
XML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
# HTML elements that have no end tag.
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr")
# Media types by extension.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp"}
# What marks a line that names an author.
AUTHOR_MARKERS = ("by ", "author:", "written by ", "edited by ", "translated by ")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column, pairs) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def trim(c: Column | str) -> Column:
    """Without white space at either end (Spark's own trim takes off spaces alone)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+\z", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def clean_value(c: Column | str, unknown: tuple[str, ...] = ("unknown",)) -> Column:
    """A metadata value squeezed; null where nothing is left, or a word that says so. Generated values also say "null"."""
    x = squeeze(c)
    return F.when((x != "") & ~F.lower(x).isin(*unknown), x)


def clean_generated(c: Column | str) -> Column:
    return clean_value(c, ("unknown", "null"))


def first_value(*cs: Column | str) -> Column:
    """The first that is neither null nor empty after cleaning."""
    return F.coalesce(*map(clean_value, cs))


def slug(c: Column | str, empty: str = "chapter") -> Column:
    """Lower-case ASCII letters and digits with single hyphens between."""
    x = F.btrim(F.lower(F.regexp_replace(col(c), "[^A-Za-z0-9]+", "-")), F.lit("-"))
    return F.when(x == "", F.lit(empty)).otherwise(x)


def asset_name(c: Column | str) -> Column:
    """A file name of safe characters, each other one a hyphen; with an extension in any case."""
    x = F.btrim(F.regexp_replace(col(c), r"[^A-Za-z0-9\-_.]", "-"), F.lit("-"))
    return F.when(x == "", F.lit("image.bin")).when(F.instr(x, ".") == 0, F.concat(x, F.lit(".bin"))).otherwise(x)


def media_type(c: Column | str) -> Column:
    end = F.substring_index(F.lower(col(c)), ".", -1)
    known = reduce(lambda w, e: w.when(end == e[0], e[1]), list(MEDIA_TYPES.items())[1:], F.when(end == "jpg", MEDIA_TYPES["jpg"]))
    return F.when(F.instr(col(c), ".") == 0, F.lit("application/octet-stream")).otherwise(known.otherwise("application/octet-stream"))


def file_stem(c: Column | str, empty: str = "Document") -> Column:
    """The last part of a path without its last extension."""
    base = F.substring_index(col(c), "/", -1)
    x = trim(F.regexp_replace(base, r"(?<=.)\.[^.]*\z", ""))
    return F.when(x == "", F.lit(empty)).otherwise(x)


def decode_base64(c: Column | str) -> Column:
    """Bytes of base64 text: after the first comma of a data URI, without ASCII white space; null unless the alphabet and padding are right."""
    x = trim(c)
    x = F.when(x.rlike(r"^data:[^,]*;base64,"), F.regexp_replace(x, r"^[^,]*,", "")).otherwise(x)
    x = F.regexp_replace(x, r"[ \t\n\r\f]+", "")
    return F.when((F.length(x) % 4 == 0) & x.rlike(r"^[A-Za-z0-9+/]*={0,2}\z"), F.unbase64(x))


def strip_running(c: Column | str, header: Column | str, footer: Column | str) -> Column:
    """Text without its running header and footer, and the newlines next to them; untouched where they don't stand at its ends."""
    x, head, foot = col(c), trim(F.coalesce(col(header), F.lit(""))), trim(F.coalesce(col(footer), F.lit("")))
    left = F.regexp_replace(x, r"(?U)^\s+", "")
    x = F.when((head != "") & F.startswith(left, head), F.regexp_replace(F.substr(left, F.length(head) + 1), r"^\n+", "")).otherwise(x)
    right = F.regexp_replace(x, r"(?U)\s+\z", "")
    return F.when((foot != "") & F.endswith(right, foot), F.regexp_replace(F.substr(right, F.lit(1), F.length(right) - F.length(foot)), r"\n+\z", "")).otherwise(x)


def strip_images(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"!\[[^\]]*\]\([^\)]+\)", "")


def first_image_target(c: Column | str) -> Column:
    """What the first image of a markdown text points to; null without one."""
    return F.nullif(F.regexp_extract(col(c), r"!\[[^\]]*\]\(([^\)\s]+)", 1), F.lit(""))


def escape_ampersands(c: Column | str) -> Column:
    """Ampersands that begin no entity reference."""
    return F.regexp_replace(col(c), r"&(?!(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z0-9]+);)", "&amp;")


def close_void_elements(c: Column | str) -> Column:
    """Void elements closed, their names in lower case. A name ends where its tag's name does: colgroup is none."""
    x = col(c)
    for tag in VOID_ELEMENTS:
        x = F.regexp_replace(x, rf"(?i)<{tag}\b\s*([^<>]*?)\s*/?>", f"<{tag} $1 />")
        x = F.replace(x, F.lit(f"<{tag}  />"), F.lit(f"<{tag} />"))
    return x


def xhtml_fragment(c: Column | str) -> Column:
    return escape_ampersands(close_void_elements(c))


def xml_escape(c: Column | str) -> Column:
    return fold(col(c), XML_ENTITIES)


def xml_unescape(c: Column | str) -> Column:
    """The five named entities; the ampersand last, so that nothing is undone twice."""
    return fold(col(c), [(b, a) for a, b in reversed(XML_ENTITIES)])


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"<[^>]+>", "")


def cover_line(c: Column | str) -> Column:
    """A line of a cover page as plain text; null for images, tables and what is blank."""
    x = trim(c)
    y = trim(F.regexp_replace(x, r"^#+", ""))
    y = trim(F.regexp_replace(y, r"^[>\-*+\s]+", ""))
    y = trim(F.regexp_replace(y, r"^[*_`]+|[*_`]+\z", ""))
    link = F.regexp_extract(y, r"^\[([^\]]+)\]\(", 1)
    y = squeeze(strip_tags(F.when(link != "", link).otherwise(y)))
    return F.when((x != "") & ~F.startswith(x, F.lit("![")) & ~F.startswith(x, F.lit("|")) & (y != ""), y)


def marked_author(c: Column | str) -> Column:
    """Who a line names after a marker such as "by"; the first marker that fits decides."""
    low, out = F.lower(col(c)), None
    for m in AUTHOR_MARKERS:
        rest = clean_value(F.substr(col(c), F.lit(len(m) + 1)))
        out = F.when(F.startswith(low, F.lit(m)), rest) if out is None else out.when(F.startswith(low, F.lit(m)), rest)
    return out


def keywords(c: Column | str) -> Column:
    """A list of keywords parted by commas, semicolons or newlines."""
    return F.filter(F.transform(F.split(col(c), r"[,;\n]"), lambda x: clean_value(x)), lambda x: x.isNotNull())


def json_object(c: Column | str) -> Column:
    """From the first opening to the last closing brace; null without both."""
    return F.nullif(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), F.lit(""))


def error_message(c: Column | str) -> Column:
    """What a service's error body says: its message, its error's message, or the whole body; blanks are passed over."""
    ways = (F.get_json_object(col(c), "$.message"), F.get_json_object(col(c), "$.error.message"), col(c))
    return F.coalesce(*[F.nullif(trim(x), F.lit("")) for x in ways])


def lines(c: Column | str) -> Column:
    """Lines of a text without their ends; a newline at the very end begins no further line."""
    return F.transform(F.split(F.regexp_replace(col(c), r"\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))


def exit_code(kind: Column | str) -> Column:
    """Of an error's kind."""
    codes = {"BadArgs": 2, "Api": 3, "OcrSchema": 4, "Epub": 5, "Validation": 6}  # fixed values; any other, Internal, is 1
    return reduce(lambda w, e: w.when(col(kind) == e[0], e[1]), list(codes.items())[1:], F.when(col(kind) == "BadArgs", 2)).otherwise(1)


def cache_key(content: Column | str, model: Column, table_format: Column, header: Column, footer: Column, version: str) -> Column:
    """sha256 of the bytes and the options that change a recognition's result, without separators."""
    flag = lambda c: F.when(c, F.lit("1")).otherwise(F.lit("0"))
    rest = F.concat(model, table_format, flag(header), flag(footer), F.lit("1"), F.lit(version))
    return F.sha2(F.concat(col(content).cast("binary"), rest.cast("binary")), 256)


def language(configured: Column | str, pdf: Column | str, generated: Column | str) -> Column:
    """A configured language other than "en" wins; "en" stands for none given, and gives way to what the file or a model says."""
    own = clean_value(configured)
    return F.when(own.isNotNull() & (F.lower(own) != "en"), own).otherwise(F.coalesce(clean_value(pdf), clean_generated(generated), own, F.lit("en")))
