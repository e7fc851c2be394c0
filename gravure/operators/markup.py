"""Markup jobs: cleaning and auditing of SVG and similar documents, as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravure.functions.text import html_unescape

# Elements removed with their content.
FORBIDDEN_ELEMENTS = ("script", "iframe", "form")
# Event-handler attributes that are removed.
EVENT_ATTRIBUTES = tuple(
    """
    onafterprint onafterscriptexecute onanimationcancel onanimationend onanimationiteration onanimationstart
    onauxclick onbeforecopy onbeforecut onbeforeinput onbeforeprint onbeforescriptexecute onbeforeunload onbegin
    onblur onbounce oncanplay oncanplaythrough onchange onclick onclose oncontextmenu oncopy oncuechange oncut
    ondblclick ondrag ondragend ondragenter ondragleave ondragover ondragstart ondrop ondurationchange onend onended
    onerror onfinish onfocus onfocusin onfocusout onfullscreenchange onhashchange oninput oninvalid onkeydown
    onkeypress onkeyup onload onloadeddata onloadedmetadata onloadend onloadstart onmessage onmousedown onmouseenter
    onmouseleave onmousemove onmouseout onmouseover onmouseup onmousewheel onmozfullscreenchange onpagehide
    onpageshow onpaste onpause onplay onplaying onpointerdown onpointerenter onpointerleave onpointermove
    onpointerout onpointerover onpointerrawupdate onpointerup onpopstate onprogress onratechange onrepeat onreset
    onresize onscroll onsearch onseeked onseeking onselect onselectionchange onselectstart onshow onstart onsubmit
    ontimeupdate ontoggle ontouchend ontouchmove ontouchstart ontransitioncancel ontransitionend ontransitionrun
    ontransitionstart onunhandledrejection onunload onvolumechange onwebkitanimationend onwebkitanimationiteration
    onwebkitanimationstart onwebkittransitionend onwheel
    """.split()
)
HREF_SCHEMES = ("http", "https")
IMAGE_HREF_SCHEMES = HREF_SCHEMES + ("data",)

# Possessive repeats: a tag is matched in a loop, so that no number of attributes exhausts the stack.
TAG = r"""<[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>"""
PIECES = rf"(?s:<!--.*?-->)|(?s:<!\[CDATA\[.*?\]\]>)|{TAG}|[^<]+|<"
# Patterns both engines' regular expressions understand alike.
PREFIX = r"(?:[A-Za-z_][A-Za-z0-9_.-]*:)?"
# A tag in parts: its head, attributes with the white space before them (value and white space may be missing), the rest.
PARTS = r"""^<[^\s/>"'=]+|\s*+[^\s"'=<>/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']*+))?|(?s:.)"""
TAG_NAME = rf"^<{PREFIX}([A-Za-z_][A-Za-z0-9_.-]*)"
HREF_VALUE = r"""=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))$"""

END_NAME = rf"^</{PREFIX}([A-Za-z_][A-Za-z0-9_.-]*)\s*>$"


def without_forbidden(pieces: Column) -> Column:
    """The pieces outside forbidden elements.

    Inside one, only tags of its own name count, so that an element nested in its like ends with the
    outer one; an element that is never closed reaches to the end, an end tag alone stays.
    """
    tag, end = (lambda p: F.regexp_extract(p, TAG_NAME, 1)), (lambda p: F.regexp_extract(p, END_NAME, 1))
    kind = lambda p: F.when(end(p) != "", F.lit("end")).when(p.endswith("/>"), F.lit("whole")).otherwise(F.lit("start"))
    marks = F.filter(
        F.transform(pieces, lambda p, i: F.struct(i.alias("at"), F.concat(tag(p), end(p)).alias("name"), kind(p).alias("kind"))),
        lambda m: m["name"].isin(*FORBIDDEN_ELEMENTS),
    )
    kept = lambda acc, until: F.array_append(acc["kept"], F.struct(acc["since"].alias("at"), (until - acc["since"]).alias("size")))

    def step(acc, m):
        closed, own = acc["depth"] == 0, m["name"] == acc["name"]
        change = F.when(m["kind"] == "start", 1).when(m["kind"] == "end", -1).otherwise(0)
        depth = F.when(closed, (m["kind"] == "start").cast("int")).when(own, acc["depth"] + change).otherwise(acc["depth"])
        opens = closed & (m["kind"] != "end")
        ends = F.when(closed, m["kind"] == "whole").otherwise(depth == 0)
        return F.struct(
            F.when(closed, m["name"]).otherwise(acc["name"]).alias("name"),
            depth.alias("depth"),
            F.when(ends, m["at"] + 1).otherwise(acc["since"]).alias("since"),
            F.when(opens, kept(acc, m["at"])).otherwise(acc["kept"]).alias("kept"),
        )

    none = F.expr("CAST(array() AS array<struct<at: int, size: int>>)")
    start = F.struct(F.lit("").alias("name"), F.lit(0).alias("depth"), F.lit(0).alias("since"), none.alias("kept"))
    finish = lambda acc: F.when(acc["depth"] > 0, acc["kept"]).otherwise(kept(acc, F.size(pieces)))
    return F.flatten(F.transform(F.aggregate(marks, start, step, finish), lambda k: F.slice(pieces, k["at"] + 1, k["size"])))


def parts_of(tag: Column) -> Column:
    """A tag cut into its head, its attributes and what stands between them; joined they are the tag."""
    return F.regexp_extract_all(tag, F.lit(PARTS), F.lit(0))


def local_name(part: Column) -> Column:
    """Name of an attribute without its prefix; empty for other parts of a tag."""
    return F.regexp_extract(part, r"""^\s*(?:[^\s"'=<>/:]*:)*([^\s"'=<>/:]+)""", 1)


def href_value(attribute: Column) -> Column:
    """Value of an href attribute, trimmed and with entities resolved."""
    value = F.concat(*[F.regexp_extract(attribute, HREF_VALUE, i) for i in (1, 2, 3)])
    return html_unescape(F.regexp_replace(value, r"^\s+|\s+$", ""))


def scheme_of(value: Column) -> Column:
    return F.lower(F.regexp_extract(value, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def href_safe(tag: Column, attribute: Column) -> Column:
    """Whether an element may carry the link: `use` fragments only, `image` also data, others web or relative."""
    value = href_value(attribute)
    scheme = scheme_of(value)
    fragment = (value == "") | value.startswith("#")
    web = fragment | (scheme == "") | scheme.isin(*HREF_SCHEMES)
    return F.when(tag == "use", fragment).when(tag == "image", web | (scheme == "data")).otherwise(web)


def sanitize_markup(docs: DataFrame, body: str = "body") -> DataFrame:
    """Documents without forbidden elements, event handlers and unsafe links.

    Textual: the body is cut into comments, tags and text, and only tags are rewritten: cut into attributes,
    which are dropped by their local name, with or without a value or white space before them (those left get a space); a forbidden
    element that is never closed is cut to the end.
    """

    def clean(piece: Column) -> Column:
        tag = F.regexp_extract(piece, TAG_NAME, 1)
        named = F.transform(
            parts_of(piece), lambda part, i: F.struct(part.alias("part"), F.when(i > 0, local_name(part)).otherwise("").alias("name"))
        )
        safe = lambda n: ~n["name"].isin(*EVENT_ATTRIBUTES) & ((n["name"] != "href") | href_safe(tag, n["part"]))
        apart = lambda n: F.when((n["name"] != "") & ~n["part"].rlike(r"^\s"), F.concat(F.lit(" "), n["part"])).otherwise(n["part"])
        return F.when(piece.rlike(r"^<[A-Za-z_]"), F.array_join(F.transform(F.filter(named, safe), apart), "")).otherwise(piece)

    return (
        docs.withColumn("_pieces", F.regexp_extract_all(F.col(body), F.lit(PIECES), F.lit(0)))
        .withColumn(body, F.array_join(F.transform(without_forbidden(F.col("_pieces")), clean), ""))
        .drop("_pieces")
    )


def start_tags(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per start tag: doc_id, pos, tag, markup."""
    found = docs.select(
        "doc_id", F.posexplode(F.regexp_extract_all(F.col(body), F.lit(PIECES), F.lit(0))).alias("pos", "markup")
    )
    tags = found.withColumn("tag", F.regexp_extract("markup", TAG_NAME, 1))
    return tags.filter(F.col("tag") != "").withColumn("pos", F.col("pos").cast("bigint"))


def attributes(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per attribute of a start tag: doc_id, pos, tag, attribute (as written), name (local)."""
    parts = F.expr("slice(parts, 2, greatest(size(parts) - 1, 0))")
    cut = start_tags(docs, body).withColumn("parts", parts_of(F.col("markup")))
    rows = cut.select("doc_id", "pos", "tag", F.explode(parts).alias("attribute"))
    return rows.withColumn("name", local_name(F.col("attribute"))).where("name <> ''")


def href_audit(docs: DataFrame) -> DataFrame:
    """Every link with its verdict: doc_id, tag, href, safe."""
    links = attributes(docs).where("name = 'href'")
    return links.select(
        "doc_id",
        "pos",
        "tag",
        href_value(F.col("attribute")).alias("href"),
        href_safe(F.col("tag"), F.col("attribute")).alias("safe"),
    )


def unsafe_attr_audit(docs: DataFrame) -> DataFrame:
    """Event-handler attributes per document."""
    found = attributes(docs).where(F.col("name").isin(*EVENT_ATTRIBUTES))
    return found.groupBy("doc_id", F.col("name").alias("attr")).agg(F.count(F.lit(1)).alias("n"))


def element_audit(docs: DataFrame) -> DataFrame:
    """Forbidden elements per document."""
    tags = start_tags(docs).filter(F.col("tag").isin(*FORBIDDEN_ELEMENTS))
    return tags.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))
