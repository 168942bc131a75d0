"""Ids, media types and typed properties as columns (inventory T10-T17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_SIZE = "application/x-zerosize"

# Media types that stand for kinds of documents beyond what their names say.
KINDS_BY_TYPE = {
    "document": (
        "text/plain application/msword application/x-scribus application/pdf application/postscript application/x-dvi application/rtf application/epub+zip "
        "application/vnd.amazon.mobi8-ebook application/x-mobipocket-ebook application/vnd.comicbook-rar application/vnd.comicbook+zip application/x-cb7 application/x-cbt "
        "application/wps-office.doc application/wps-office.xls application/wps-office.pot application/wps-office.wps application/wps-office.docx application/wps-office.xlsx "
        "application/wps-office.pptx text/markdown image/vnd.djvu+multipage application/x-lyx"
    ).split(),
    "presentation": (
        "application/vnd.openxmlformats-officedocument.presentationml.presentation application/vnd.openxmlformats-officedocument.presentationml.slideshow "
        "application/vnd.openxmlformats-officedocument.presentationml.template application/vnd.oasis.opendocument.presentation application/wps-office.pot application/wps-office.pptx"
    ).split(),
    "spreadsheet": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet application/vnd.oasis.opendocument.spreadsheet application/wps-office.xls application/wps-office.xlsx".split(),
    "archive": (
        "application/gzip application/x-tar application/x-tarz application/x-arc application/x-archive application/x-bzip application/x-cpio application/x-lha application/x-lhz "
        "application/x-lrzip application/x-lz4 application/x-lzip application/x-lzma application/x-lzop application/x-7z-compressed application/x-ace application/x-astrotite-afa "
        "application/x-alz application/vnd.android.package-archive application/x-arj application/vnd.ms-cab-compressed application/x-cfs-compressed application/x-dar application/x-lzh "
        "application/x-lzx application/vnd.rar application/x-stuffit application/x-stuffitx application/x-tzo application/x-ustar application/x-xar application/x-xz application/x-zoo "
        "application/zip application/zlib application/zstd"
    ).split(),
}


def kinds(mime: Column, size: Column | None = None, is_dir: Column | None = None) -> Column:
    """The sorted kinds (audio, video, image, text, document ...) of a media type; folders are only folders, empty files nothing."""
    rules = {
        "audio": mime.startswith("audio/"),
        "video": mime.startswith("video/"),
        "image": mime.startswith("image/"),
        "text": mime.startswith("text/"),
        "document": mime.contains("document") | mime.contains("powerpoint") | mime.contains("excel") | mime.isin(KINDS_BY_TYPE["document"]),
        "presentation": mime.contains("powerpoint") | mime.isin(KINDS_BY_TYPE["presentation"]),
        "spreadsheet": mime.contains("excel") | mime.isin(KINDS_BY_TYPE["spreadsheet"]),
        "archive": (mime.startswith("application/x-") & mime.endswith("-compressed-tar")) | mime.isin(KINDS_BY_TYPE["archive"]),
    }
    found = F.array_sort(F.array_compact(F.array(*[F.when(rule, F.lit(kind)) for kind, rule in rules.items()])))
    if size is not None:
        found = F.when(size == 0, F.array().cast("array<string>")).otherwise(found)
    return found if is_dir is None else F.when(is_dir, F.array(F.lit("folder"))).otherwise(found)


def effective_mime(mime: Column, size: Column) -> Column:
    return F.when(size == 0, F.lit(ZERO_SIZE)).otherwise(mime)


def pack_id(device: Column, inode: Column) -> Column:
    """Device in the low half, inode in the high half of a long; both lose their high bits."""
    return F.shiftleft(inode.cast("long"), 32).bitwiseOR(device.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def device_of(doc_id: Column) -> Column:
    return doc_id.bitwiseAND(F.lit(0xFFFFFFFF))


def inode_of(doc_id: Column) -> Column:
    return F.shiftrightunsigned(doc_id, 32)


def hex_id(doc_id: Column) -> Column:
    return F.lower(F.hex(doc_id))


def property_term(value: Column, kind: str) -> Column:
    """The terms of a typed property: presence for booleans, decimal text for whole numbers, ISO text for times, words for the rest."""
    from .text import portable_tokens

    if kind == "boolean":
        return F.when(value.isNotNull(), F.array(F.lit("")))
    if kind in ("int", "uint"):
        return F.array(value.cast("string"))
    if kind == "datetime":
        return F.array(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"))
    if kind == "date":
        return F.array(F.date_format(value, "yyyy-MM-dd"))
    return portable_tokens(value.cast("string"))


def property_json(name: Column, value: Column, order: Column) -> Column:
    """An aggregate: names and values to one JSON object. A single value stands as it is, several of a name as an array, in order; numbers stay numbers."""
    entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), name.alias("k"), value.alias("v"))))
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["k"])))

    def member(key: Column) -> Column:
        many = F.to_json(F.transform(F.filter(entries, lambda e: e["k"] == key), lambda e: e["v"]))
        one = F.size(F.filter(entries, lambda e: e["k"] == key)) == 1
        return F.concat(bare(F.to_json(F.array(key))), F.lit(":"), F.when(one, bare(many)).otherwise(many))

    return F.concat(F.lit("{"), F.array_join(F.transform(names, member), ","), F.lit("}"))


def bare(array: Column) -> Column:
    """The JSON text of an array without its brackets."""
    return F.substr(array, F.lit(2), F.length(array) - 2)


def property_values(json: Column) -> Column:
    """A JSON object to name -> values, single values as arrays of one; numbers and booleans as their text."""
    parsed = F.from_json(json, "map<string,string>")
    return F.transform_values(parsed, lambda _, v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v)))


def term_class(term: Column) -> Column:
    """(kind, number, value): property terms ``X<number>-<value>``, other capital prefixes, malformed ones, plain words."""
    number = F.regexp_extract(term, r"^X(\d+)-", 1)
    kind = F.when(~term.rlike("^[A-Z]"), "plain").when(number != "", "property").when(term.startswith("X"), "malformed").otherwise("prefixed")
    value = F.when(number != "", F.regexp_extract(term, r"^X\d+-(.*)$", 1)).otherwise(term)
    return F.struct(kind.alias("kind"), F.when(number != "", number.try_cast("int")).alias("number"), value.alias("value"))
