"""Markup and binary sources: body units, titles, document intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that are units of a body, that have no content, that stand inside a line, and the references that markup itself defines.
UNITS = ("h1", "h2", "h3", "h4", "h5", "h6", "head", "p")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
INLINE = ("a", "b", "big", "code", "em", "font", "hi", "i", "ref", "s", "small", "span", "strong", "sub", "sup", "tt", "u")
REFERENCES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&"))

#: Comments, CDATA, scripts and styles with their content, declarations, tags (quoted values may hold `>`), texts, and a `<` that begins nothing.
TOKEN = r"""(?is)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>|</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]+|<"""
_UNIT = "array<struct<at:int,stop:int,name:string>>"


def _once(column: Column, use) -> Column:
    """use(column), with the column worked out once: an array of one element."""
    return F.get(F.transform(F.array(column), use), 0)


def decode(text: Column) -> Column:
    """Numeric character references and the five that markup itself defines, each once; others stay."""

    def one(part: Column) -> Column:
        digits, hexa = F.regexp_extract(part, "^#([0-9]{1,7});", 1), F.regexp_extract(part, "^#[xX]([0-9A-Fa-f]{1,6});", 1)
        code = F.coalesce(F.nullif(digits, F.lit("")), F.conv(F.nullif(hexa, F.lit("")), 16, 10)).cast("int")
        known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for name, own in REFERENCES:
            char = F.coalesce(char, F.when(F.startswith(part, F.lit(f"{name};")), F.lit(own)))
        return F.coalesce(F.concat(char, F.regexp_replace(part, "^[^;]*;", "")), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, 2, 2**30), one)), "")).otherwise(text)


def _last(found: Column) -> Column:
    """The place (from 1) of the last true of an array, 0 without one."""
    back = F.array_position(F.reverse(found), F.lit(True))
    return F.when(back > 0, F.size(found) - back + 1).otherwise(0).cast("int")


def _tags(tokens: Column) -> Column:
    """Tags that open or close an element: their place among the tokens, local name in lower case, and whether they close."""
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?(?:[^\s>/:]+:)?([^\s>/:]+)", 1))
    tag = lambda t: F.rlike(t, F.lit(r"(?i)^</?[a-z]")) & ~F.rlike(t, F.lit(r"(?i)^<(script|style)\b")) & ~F.endswith(t, F.lit("/>"))
    every = F.transform(tokens, lambda t, i: F.when(tag(t), F.struct(i.cast("int").alias("at"), name(t).alias("name"), F.startswith(t, F.lit("</")).alias("closes"))))
    return F.filter(F.array_compact(every), lambda t: ~t["name"].isin(*VOID))


def _spans(tags: Column, names: tuple, stop: Column) -> Column:
    """Elements of the names: where they begin and end. A fold over the tags with the stack of open elements.

    An end tag closes what stands open above its element; one without an element is passed over. Where an element of the names begins
    directly in another (inline elements do not count), that one's end tag was left out.
    """
    begin = F.struct(F.array().cast("array<struct<name:string,at:int>>").alias("stack"), F.array().cast(_UNIT).alias("out"))
    ended = lambda entries, at: F.transform(F.filter(entries, lambda e: e["name"].isin(*names)), lambda e: F.struct(e["at"].alias("at"), at.cast("int").alias("stop"), e["name"].alias("name")))

    def step(s: Column, t: Column) -> Column:
        stack = s["stack"]
        block = _last(F.transform(stack, lambda e: ~e["name"].isin(*INLINE)))
        left_out = t["name"].isin(*names) & F.coalesce(F.try_element_at(stack, F.nullif(block, F.lit(0)))["name"].isin(*names), F.lit(False))
        own = _last(F.transform(stack, lambda e: e["name"] == t["name"]))
        keep = F.when(t["closes"], F.when(own > 0, own - 1).otherwise(F.size(stack))).when(left_out, block - 1).otherwise(F.size(stack))

        def moved(keep: Column) -> Column:
            opened = F.when(t["closes"], F.array().cast("array<struct<name:string,at:int>>")).otherwise(F.array(F.struct(t["name"].alias("name"), t["at"].alias("at"))))
            return F.struct(F.concat(F.slice(stack, 1, keep), opened).alias("stack"), F.concat(s["out"], ended(F.slice(stack, keep + 1, F.size(stack)), t["at"])).alias("out"))

        return _once(keep, moved)

    return F.aggregate(tags, begin, step, lambda s: F.array_sort(F.concat(s["out"], ended(s["stack"], stop))))


def _text(tokens: Column, span: Column) -> Column:
    """The texts inside a span: elements part them by a space, comments do not; collapsed."""
    piece = lambda t: (
        F.when(F.startswith(t, F.lit("<![CDATA[")), F.substring(t, 10, F.length(t) - 12))
        .when(F.rlike(t, F.lit(r"(?i)^<([!?]|script\b|style\b)")), "")
        .when(F.rlike(t, F.lit(r"(?i)^</?[a-z].*>$")) | F.rlike(t, F.lit(r"(?is)^</?[a-z][^<]*>$")), " ")
        .otherwise(decode(t))
    )
    inside = F.slice(tokens, span["at"] + 2, span["stop"] - span["at"] - 1)
    return F.trim(F.regexp_replace(F.array_join(F.transform(inside, piece), ""), r"[ \t\n\r]+", " "))


def elements(markup: Column, names: tuple, inside: str | None = None) -> Column:
    """Elements of the local names in document order, an array of struct(name, text); those inside the first element `inside`, if there is one.

    Names count whatever their case, prefix and attributes; elements inside each other are all given, the text of the inner ones also being the outer's.
    """

    def found(tokens: Column) -> Column:
        def within(tags: Column) -> Column:
            if inside is None:
                return _spans(tags, names, F.size(tokens))
            start = F.get(F.filter(tags, lambda t: (t["name"] == inside) & ~t["closes"]), 0)["at"]
            end = F.coalesce(F.array_min(F.transform(F.filter(tags, lambda t: (t["name"] == inside) & t["closes"] & (t["at"] > start)), lambda t: t["at"])), F.size(tokens))
            bounds = F.struct(F.coalesce(start, F.lit(-1)).alias("a"), F.when(start.isNull(), F.size(tokens)).otherwise(end).alias("b"))
            return _once(bounds, lambda x: _spans(F.filter(tags, lambda t: (t["at"] > x["a"]) & (t["at"] < x["b"])), names, x["b"]))

        return F.transform(_once(_tags(tokens), within), lambda u: F.struct(u["name"].alias("name"), _text(tokens, u).alias("text")))

    return _once(F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(TOKEN), 0), found)


def body_units(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Headings and paragraphs of the first body (of the whole text without one) in document order: id, unit_no, tag, text.

    The texts of all elements inside a unit are joined by a space and collapsed; a unit inside a unit is one of its own as well.
    """
    found = pages.select(F.col(id_col), F.posexplode(elements(F.col(html_col), UNITS, "body")).alias("unit_no", "u"))
    return found.select(id_col, "unit_no", F.col("u.name").alias("tag"), "u.text")


def roles(units: DataFrame) -> DataFrame:
    """Units with text, headings and paragraphs told apart."""
    return units.where("text <> ''").withColumn("role", F.when(F.col("tag") == "p", "paragraph").otherwise("heading"))


def title(html: Column) -> Column:
    """The first title element's text that is not blank, null without one."""
    return F.get(F.filter(elements(html, ("title",)), lambda t: t["text"] != ""), 0)["text"]


def intake(files: DataFrame, content_col: str, name_col: str, magic: str | None = None) -> DataFrame:
    """Files that begin with the magic bytes, by the SHA-256 of their bytes."""
    content = F.col(content_col).cast("binary")
    if magic:
        files = files.where(F.substring(content, 1, len(magic.encode())) == F.lit(magic).cast("binary"))
    return files.select(F.sha2(content, 256).alias("document_id"), F.col(name_col).alias("source_name"), F.octet_length(content).alias("n_bytes"))


def valid_id(document_id: Column) -> Column:
    """Whether a text can be a document's id."""
    return document_id.rlike("^[a-f0-9]{64}$")


def read_binary(spark, path: str, magic: str = "%PDF") -> DataFrame:
    """Intake of a folder of binary documents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return intake(files, "content", "path", magic)
