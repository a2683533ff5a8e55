"""E-book packages as rows: documents, navigation, manifest, and the entries of each package in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T

# What the packages' format prescribes, here and in the documents below: names of elements, namespaces and properties.
CONTAINER = '<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'
CSS = (
    "body { margin: 5%; line-height: 1.5; }\nimg { max-width: 100%; height: auto; }\ntable { border-collapse: collapse; }\ntd, th { border: 1px solid; padding: 0.2em 0.5em; }\naside.callout { margin: 1em; padding-left: 1em; border-left: 3px solid; }\n"
    "body.whole-page { margin: 0; padding: 0; text-align: center; }\nbody.whole-page img { display: block; margin: 0 auto; width: 100%; max-height: 100%; object-fit: contain; }\n"
)
#: Media that are stored as they are; everything else is deflated.
STORED = ("image/jpeg", "image/png", "image/gif", "image/webp")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def page(title: Column, body: Column, language: Column, whole: bool = False) -> Column:
    """A whole XHTML document; a whole page has no margins."""
    lang = T.xml_escape(language)
    head = _text('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="', lang, '" xml:lang="', lang, '">\n<head><title>', T.xml_escape(title), '</title><link rel="stylesheet" type="text/css" href="../styles/book.css"/></head>\n<body', ' class="whole-page"' if whole else "", ">\n")
    return _text(head, body, "\n</body>\n</html>\n")


def comic_page(title: Column, image: Column, language: Column, width: Column, height: Column) -> Column:
    """A page that is one image, in a viewport of its size."""
    lang = T.xml_escape(language)
    size = _text("width=", width.cast("string"), ", height=", height.cast("string"))
    return _text('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="', lang, '" xml:lang="', lang, '">\n<head><title>', T.xml_escape(title), '</title><meta name="viewport" content="', size, '"/><link rel="stylesheet" type="text/css" href="../styles/book.css"/></head>\n<body class="whole-page"><img src="', T.xml_escape(image), '" alt="', T.xml_escape(title), '"/></body>\n</html>\n')


def nav(chapters: DataFrame, books: DataFrame, fixed: bool = False) -> DataFrame:
    """(doc_id, nav): the contents of each book from (doc_id, chapter_no, title, file_name); a fixed layout has the list of pages too."""
    item = _text('<li><a href="text/', T.xml_escape("file_name"), '">', T.xml_escape("title"), "</a></li>")
    by = chapters.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter_no", item.alias("item")))).alias("own"))
    x = by.join(books.select("doc_id", F.col("language").alias("_lang")), "doc_id")
    items, lang = F.array_join(F.col("own.item"), ""), T.xml_escape(F.coalesce("_lang", F.lit("")))
    pages = _text('<nav epub:type="page-list" id="page-list"><h2>Pages</h2><ol>', items, "</ol></nav>") if fixed else F.lit("")
    head = _text('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="', lang, '" xml:lang="', lang, '"><head><title>Contents</title><link rel="stylesheet" type="text/css" href="styles/book.css"/></head>')
    whole = _text(head, '<body><nav epub:type="toc" id="toc"><h1>Contents</h1><ol>', items, "</ol></nav>", pages, "</body></html>\n")
    return x.select("doc_id", whole.alias("nav"))


def opf(books: DataFrame, chapters: DataFrame, assets: DataFrame, modified: str, fixed: bool = False) -> DataFrame:
    """(doc_id, opf): the manifest, spine and metadata of each book.

    books: (doc_id, source_hash, title, author, language, publisher, description, subjects, cover_image, direction);
    chapters: (doc_id, chapter_no, chapter_id, file_name); assets: (doc_id, asset_no, file_name, media_type). modified is an
    argument, so that the same books give the same packages.
    """
    chap = chapters.select("doc_id", "chapter_no", _text('<item id="', F.col("chapter_id"), '" href="text/', T.xml_escape("file_name"), '" media-type="application/xhtml+xml"/>').alias("item"), _text('<itemref idref="', F.col("chapter_id"), '"/>').alias("ref"))
    chap = chap.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter_no", "item", "ref"))).alias("c"))
    covers = books.select(F.col("doc_id").alias("_doc"), "cover_image")
    own = assets.join(covers, (F.col("doc_id") == F.col("_doc")) & (F.col("cover_image") == F.col("file_name")), "left")
    flag = F.when(F.col("cover_image").isNotNull(), ' properties="cover-image"').otherwise("")
    img = own.select("doc_id", "asset_no", _text('<item id="', F.format_string("img-%04d", "asset_no"), '" href="images/', T.xml_escape("file_name"), '" media-type="', F.col("media_type"), '"', flag, "/>").alias("item"))
    img = img.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("asset_no", "item"))).alias("i"))
    x = books.join(chap, "doc_id", "left").join(img, "doc_id", "left")
    maybe = lambda name, c: F.coalesce(_text(f"<dc:{name}>", T.xml_escape(c), f"</dc:{name}>"), F.lit(""))
    subjects = F.coalesce(F.array_join(F.transform("subjects", lambda s: _text("<dc:subject>", T.xml_escape(s), "</dc:subject>")), ""), F.lit(""))
    layout = '<meta property="rendition:layout">pre-paginated</meta><meta property="rendition:orientation">auto</meta><meta property="rendition:spread">none</meta>' if fixed else ""
    prefix = ' prefix="rendition: http://www.idpf.org/vocab/rendition/#"' if fixed else ""
    covered = lambda s: F.when(F.col("cover_image").isNotNull(), s).otherwise("") if not fixed else F.lit("")
    head = _text('<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"' + prefix + '><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:sha256:', F.col("source_hash"), "</dc:identifier>", maybe("title", F.col("title")), maybe("language", F.col("language")), maybe("creator", F.col("author")), maybe("publisher", F.col("publisher")), maybe("description", F.col("description")), subjects, f'<meta property="dcterms:modified">{modified}</meta>{layout}</metadata>')
    items = _text('<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="styles/book.css" media-type="text/css"/>', covered('<item id="cover" href="text/cover.xhtml" media-type="application/xhtml+xml"/>'), F.coalesce(F.array_join(F.col("c.item"), ""), F.lit("")), F.coalesce(F.array_join(F.col("i.item"), ""), F.lit("")), "</manifest>")
    way = F.coalesce(_text(' page-progression-direction="', F.col("direction"), '"'), F.lit("")) if fixed else F.lit("")
    spine = _text("<spine", way, ">", covered('<itemref idref="cover"/>'), F.coalesce(F.array_join(F.col("c.ref"), ""), F.lit("")), "</spine></package>\n")
    return x.select("doc_id", _text(head, items, spine).alias("opf"))


def entries(books: DataFrame, chapters: DataFrame, assets: DataFrame, modified: str, fixed: bool = False) -> DataFrame:
    """(doc_id, entry_no, path, method, bytes): what a package holds, in its order; mimetype first and stored.

    chapters also have xhtml, assets bytes. Reflowable books with a cover get a page for it.
    """
    row = lambda no, path, method, data: F.struct(F.lit(no).cast("long").alias("entry_no"), F.lit(path).alias("path"), F.lit(method).alias("method"), (data if isinstance(data, Column) else F.lit(data)).cast("binary").alias("bytes"))
    heads = books.select("doc_id", "title", "language", "cover_image").join(nav(chapters, books, fixed), "doc_id", "left").join(opf(books, chapters, assets, modified, fixed), "doc_id")
    cover = page(F.col("title"), _text('<img src="../images/', T.xml_escape("cover_image"), '" alt="', T.xml_escape("title"), '"/>'), F.col("language"), whole=True)
    fixed_rows = [row(0, "mimetype", "stored", "application/epub+zip"), row(1, "META-INF/container.xml", "deflated", CONTAINER), row(2, "OEBPS/styles/book.css", "deflated", CSS), row(3, "OEBPS/nav.xhtml", "deflated", F.col("nav")), row(4, "OEBPS/content.opf", "deflated", F.col("opf"))]
    if not fixed:
        fixed_rows.append(row(5, "OEBPS/text/cover.xhtml", "deflated", F.when(F.col("cover_image").isNotNull(), cover)))
    own = heads.select("doc_id", F.inline(F.array(*fixed_rows))).where("bytes is not null")
    text = chapters.select("doc_id", (F.col("chapter_no") + 5).cast("long").alias("entry_no"), F.concat(F.lit("OEBPS/text/"), "file_name").alias("path"), F.lit("deflated").alias("method"), F.col("xhtml").cast("binary").alias("bytes"))
    images = assets.select("doc_id", (F.col("asset_no") + (1 << 32)).cast("long").alias("entry_no"), F.concat(F.lit("OEBPS/images/"), "file_name").alias("path"), F.when(F.col("media_type").isin(*STORED), "stored").otherwise("deflated").alias("method"), F.col("bytes"))
    return own.unionByName(text).unionByName(images)
