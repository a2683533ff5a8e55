"""Checks of e-book packages: what their documents refer to as rows, held against what there is.

    faults = packages.faults(entries)     # (doc_id, path, rule, detail): no row, no fault

Each document of a package is read once, as a stream of tags; everything else is joins over its ids and references, so a package's size, and
a batch's, don't matter.
"""

from __future__ import annotations

import xml.parsers.expat as expat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.session import Staged, reachable

# Where a reader starts, and what it must find there.
MIMETYPE, CONTAINER = "application/epub+zip", "META-INF/container.xml"
#: Elements of a package's metadata that must have a text.
REQUIRED = ("identifier", "title", "language")
#: kind: item (of the manifest: name is its id, target its file, more its media type and properties), itemref (target is an id), rootfile, link, id, text (of a
#: metadata element: name), nav (name is its type), broken (target says why).
MARK = "doc_id string, path string, kind string, name string, target string, more string, line int"
_LINKS = {"a": "href", "link": "href", "image": "href", "img": "src", "script": "src", "audio": "src", "video": "src", "source": "src", "iframe": "src"}


def marks_of(data: bytes, package: bool) -> list[tuple]:
    """(kind, name, target, more, line) of one document, as its tags stream by; what is no well-formed XML has a row that says so."""
    found: list[tuple] = []
    texts: list[list] = []
    parser = expat.ParserCreate(namespace_separator=" ")

    def start(tag: str, own: dict) -> None:
        name, line = tag.rpartition(" ")[2], parser.CurrentLineNumber
        get = {k.rpartition(" ")[2]: v for k, v in own.items()}.get
        if get("id") is not None:
            found.append(("id", get("id"), None, None, line))
        if name == "rootfile":
            found.append(("rootfile", None, get("full-path"), get("media-type"), line))
        elif package and name == "item":
            found.append(("item", get("id"), get("href"), f"{get('media-type', '')} {get('properties', '')}".strip(), line))
        elif package and name == "itemref":
            found.append(("itemref", None, get("idref"), None, line))
        elif package and tag.startswith("http://purl.org/dc/elements/1.1/ "):
            texts.append([name, "", line])
        elif not package and name in _LINKS and get(_LINKS[name]) is not None:
            found.append(("link", name, get(_LINKS[name]), None, line))
        elif name == "nav":
            found.append(("nav", get("type"), None, None, line))

    def text(s: str) -> None:
        if texts:
            texts[-1][1] += s

    parser.StartElementHandler, parser.CharacterDataHandler = start, text
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        return [("broken", None, str(e), None, e.lineno)]
    return found + [("text", n, s.strip(), None, line) for n, s, line in texts]


def marks(entries: DataFrame) -> DataFrame:
    """MARK rows of every XML document among (doc_id, path, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [c.split()[0] for c in MARK.split(", ")], [pa.int32() if c.endswith(" int") else pa.string() for c in MARK.split(", ")]
        for b in batches:
            for doc, path, data in zip(*(b.column(i) for i in range(3)), strict=True):
                rows = [(doc.as_py(), path.as_py(), *m) for m in marks_of(data.as_py(), path.as_py().endswith(".opf"))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    reachable(entries.sparkSession)
    xml = F.col("path").rlike(r"\.(opf|xhtml|xml|ncx|svg)\z")
    return entries.where(xml & F.col("bytes").isNotNull()).select(F.col("doc_id").cast("string"), "path", "bytes").mapInArrow(run, MARK)


def resolved(base: Column, target: Column) -> Column:
    """The entry that a reference in the document `base` leads to: relative parts are followed, percent signs decoded, fragment and query dropped."""
    own = F.regexp_replace(target, r"[#?].*\z", "")
    own = F.when(own.contains("%"), F.try_url_decode(F.replace(own, F.lit("+"), F.lit("%2B")))).otherwise(own)
    whole = F.when(own == "", base).when(own.startswith("/"), F.substring(own, 2, 1 << 30)).otherwise(F.concat(F.regexp_replace(base, r"[^/]*\z", ""), own))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    followed = F.aggregate(parts, F.array().cast("array<string>"), lambda seen, p: F.when((p == "..") & (F.size(seen) > 0), F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(p))))
    return F.array_join(followed, "/")


def faults(entries: DataFrame) -> DataFrame:
    """(doc_id, path, rule, detail) for each fault of the packages whose entries (doc_id, entry_no, path, method, bytes) are given; sound ones have none.

    Rules: mimetype (must be the first entry, stored, and say what it is), duplicate_entry, no_container, no_package, not_well_formed, missing_metadata,
    duplicate_id, item_missing (a manifest's file isn't there), undeclared (an entry isn't in the manifest), spine_missing (an itemref's
    id isn't), empty_spine, no_nav, link_missing, fragment_missing. Links to other places (with a scheme) aren't followed. An empty table has no faults.
    """
    staged = Staged(entries.sparkSession, "packages")
    files = staged.put(entries.select(F.col("doc_id").cast("string").alias("doc_id"), "entry_no", "path", "method", F.when(F.col("path") == "mimetype", F.col("bytes").cast("string")).alias("says")))
    found = staged.put(marks(entries))
    books = files.select("doc_id").distinct()
    fault = lambda df, rule, detail=None, path="path": df.select("doc_id", (F.col(path) if path else F.lit(None).cast("string")).alias("path"), F.lit(rule).alias("rule"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
    of = lambda kind: found.where(F.col("kind") == kind)
    places = files.select("doc_id", F.col("path").alias("at")).distinct()

    def absent(refs: DataFrame, rule: str) -> DataFrame:
        """References (doc_id, path, at, target) that lead to no entry."""
        return fault(refs.join(places, ["doc_id", "at"], "left_anti"), rule, F.col("target"))

    first = files.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("entry_no", "path"))).where("n = 1")
    wrong = ~((F.col("path") == "mimetype") & (F.col("method") == "stored") & F.coalesce(F.col("says") == MIMETYPE, F.lit(False)))
    twice = files.groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    roots = of("rootfile").where(F.col("path") == CONTAINER).select("doc_id", "path", "target", resolved(F.lit(""), F.col("target")).alias("at"))
    opf = places.join(roots.select("doc_id", "at"), ["doc_id", "at"], "left_semi").select("doc_id", F.col("at").alias("path"))
    within = lambda kind: of(kind).join(opf, ["doc_id", "path"], "left_semi")
    items = staged.put(within("item").withColumn("at", resolved(F.col("path"), F.col("target"))))
    need = opf.withColumn("name", F.explode(F.array(*map(F.lit, REQUIRED))))
    declared = items.select("doc_id", "at").distinct()
    loose = places.where((F.col("at") != "mimetype") & ~F.col("at").startswith("META-INF/")).join(opf.select("doc_id", F.col("path").alias("at")), ["doc_id", "at"], "left_anti").join(declared, ["doc_id", "at"], "left_anti").join(opf.select("doc_id"), "doc_id", "left_semi")
    refs = within("itemref")
    navs = items.where(F.col("more").rlike(r"(^|\s)nav(\s|\z)")).select("doc_id", "at").join(of("nav").where("name = 'toc'").select("doc_id", F.col("path").alias("at")), ["doc_id", "at"], "left_semi")
    links = staged.put(of("link").where(~F.col("target").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")).withColumn("at", resolved(F.col("path"), F.col("target"))).withColumn("fragment", F.regexp_extract("target", r"#(.+)\z", 1)))
    ids = of("id").select("doc_id", F.col("path").alias("at"), F.col("name").alias("fragment")).distinct()
    read = found.where("kind <> 'broken'").select("doc_id", F.col("path").alias("at")).distinct()
    lost = links.where("fragment <> ''").join(read, ["doc_id", "at"], "left_semi").join(ids, ["doc_id", "at", "fragment"], "left_anti")
    told = [
        fault(first.where(wrong), "mimetype", F.col("method")),
        fault(twice, "duplicate_entry", F.col("n")),
        fault(books.join(files.where(F.col("path") == CONTAINER), "doc_id", "left_anti"), "no_container", path=None),
        fault(books.join(opf, "doc_id", "left_anti"), "no_package", path=None),
        fault(of("broken"), "not_well_formed", F.col("target")),
        fault(need.join(within("text").where("target <> ''").select("doc_id", "name").distinct(), ["doc_id", "name"], "left_anti"), "missing_metadata", F.col("name")),
        fault(of("id").groupBy("doc_id", "path", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate_id", F.col("name")),
        absent(items, "item_missing"),
        fault(loose, "undeclared", path="at"),
        fault(refs.join(items.select("doc_id", F.col("name").alias("target")), ["doc_id", "target"], "left_anti"), "spine_missing", F.col("target")),
        fault(opf.join(refs.select("doc_id").distinct(), "doc_id", "left_anti"), "empty_spine"),
        fault(opf.join(navs, "doc_id", "left_anti"), "no_nav"),
        absent(links, "link_missing"),
        fault(lost, "fragment_missing", F.col("target")),
    ]
    return reduce(DataFrame.unionByName, told)
