"""Blocks of documents as rows, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import blocks as B
from foliant.functions.udfs import chunks as chunk_udf
from foliant.functions import text as X


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, numbers, x) of (doc_id, text): x are the lines (line, s), without white space around them; ornaments are blank lines. A bullet that stands
    alone moves to the beginning of the next line; before a blank line or the end it stays, and before another it goes. Null texts have no row."""
    s, none = F.col("s"), F.lit("")
    own = X.bound(docs.filter("text is not null").select("doc_id", "text"), {"own": F.transform(X.lines(F.col("text")), X.strip)})
    alone = lambda x: F.when(F.length(x) == 1, B.like(x, B.LONE_BULLET)).otherwise(F.lit(False))
    own = X.bound(own, {"s": F.transform("own", lambda x: F.when(x.rlike(B.ORNAMENT), "").otherwise(x))})
    own = X.bound(own, {"glyph": F.concat(F.array(none), F.transform("s", lambda x: F.when(alone(x), x).otherwise(""))), "next": F.concat(F.slice(s, 2, F.size("s")), F.array(none))})
    each = F.transform(F.arrays_zip("s", "glyph", "next"), lambda x, i: F.struct(i.alias("line"), x["s"].alias("s"), x["glyph"].alias("glyph"), x["next"].alias("next")))
    stays = F.filter(F.slice(each, 1, F.size("s")), lambda x: ~alone(x["s"]) | (x["next"] == ""))
    joined = F.transform(stays, lambda x: F.struct(x["line"].alias("line"), F.when(~alone(x["s"]) & (x["s"] != "") & (x["glyph"] != ""), F.concat(x["glyph"], F.lit(" "), x["s"])).otherwise(x["s"]).alias("s")))
    return own.select("doc_id", B.references(F.col("text")).alias("numbers"), joined.alias("x"))


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, line, sub, role, text, label, value, is_title): what each line adds to which kind of block, or "more" to the open one. Lines stay in their document's row until their roles are known."""
    own = X.bound(document_lines(docs), {"lines": F.col("x")}).drop("x")
    played = X.bound(own, {"signs": F.transform("lines", lambda x: B.signs(x["s"], F.col("numbers")))})
    played = X.bound(played.select("doc_id", "lines", "signs", B.roles("signs").alias("_r")), {"r": F.col("_r")})
    rows = played.select("doc_id", F.explode(F.arrays_zip("lines", "signs", "r")).alias("z")).select("doc_id", "z.lines.line", "z.lines.s", "z.signs.kind", F.col("z.r").alias("role")).filter("role <> 'end'")
    s, none = F.col("s"), F.lit(None).cast("string")
    piece = lambda role, text, label=none, value=none, title=F.lit(False): F.struct(role.alias("role"), text.alias("text"), label.alias("label"), value.alias("value"), title.alias("is_title"))
    rest = B.heading_rest(s)
    heading = F.array(piece(F.col("role"), B.heading_label(s), title=rest.isNull() & B.like(s, B.TITLE)))
    parts = F.when(F.col("role") == "heading", F.when(rest != "", F.concat(heading, F.array(piece(F.lit("body"), rest)))).otherwise(heading))
    parts = parts.when(F.col("role") == "field", F.array(piece(F.col("role"), none, B.field_label(s), B.field_value(s))))
    parts = parts.otherwise(F.array(piece(F.col("role"), F.when(F.col("kind") == "bullet", B.repaired_bullet(s)).otherwise(s))))
    return rows.select("doc_id", "line", F.posexplode(parts).alias("sub", "p")).select("doc_id", "line", "sub", "p.*")


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, type, text, label, value, is_title). Ids are unique; a null text has no blocks."""
    order = Window.partitionBy("doc_id").orderBy("line", "sub")
    rows = pieces(docs).withColumn("n", F.sum((F.col("role") != "more").cast("int")).over(order))
    one = lambda c: F.max(c).alias(c)
    got = rows.groupBy("doc_id", "n").agg(
        F.max(F.when(F.col("role") != "more", F.col("role"))).alias("type"), F.transform(F.array_sort(F.collect_list(F.struct("line", "sub", "text"))), lambda x: x["text"]).alias("t"),
        one("label"), one("value"), one("is_title"),
    )
    flat = (F.col("type") == "table") | ((F.col("type") == "bullet") & X.flattened_table(F.array_join("t", " ")))
    got = got.select("doc_id", (F.col("n") - 1).cast("int").alias("pos"), F.when(flat, "table").otherwise(F.col("type")).alias("type"), "label", "value", "is_title",
                     F.when(F.col("type") != "field", F.when(flat, F.array_join("t", "\n")).otherwise(F.array_join("t", " "))).alias("text"))
    # a title before a heading numbered 2 or more has lost its 1
    along, number = Window.partitionBy("doc_id").orderBy("pos"), r"(?U)^(\d{1,2})[.)]\s"
    first = F.col("is_title") & (F.sum(F.col("is_title").cast("int")).over(along) == 1)
    after = F.regexp_extract(F.coalesce(F.when(F.lead("type").over(along) == "heading", F.lead("text").over(along)), F.lit("")), number, 1)
    lost = first & ~F.col("text").rlike(number) & (F.coalesce(F.when(after != "", after.cast("int")), F.lit(0)) >= 2)
    got = got.withColumn("text", F.when(lost, F.concat(F.lit("1. "), "text")).otherwise(F.col("text")))
    shown = lambda c: F.replace(c, F.lit(B.DEPARTMENT), F.lit(B.DEPARTMENT_SHOWN)).alias(c)
    return got.select("doc_id", "pos", "type", *[shown(c) for c in ("text", "label", "value")], "is_title")


def toc(rows: DataFrame, least: int = 3) -> DataFrame:
    """Headings but the title, numbered as all headings are; none for documents with fewer than ``least`` of them."""
    heads = rows.filter("type = 'heading'").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    listed = heads.filter("not is_title").withColumn("_c", F.count("*").over(Window.partitionBy("doc_id")))
    return listed.filter(F.col("_c") >= least).select("doc_id", F.concat(F.lit("heading-"), F.col("n").cast("string")).alias("anchor"), "text")


def footnotes(rows: DataFrame) -> DataFrame:
    own = rows.filter("type = 'footnote'")
    return own.select("doc_id", F.regexp_extract("text", r"^(\d{1,2})\)", 1).cast("int").alias("number"), F.regexp_replace("text", r"^\d{1,2}\)\s*", "").alias("text"))


def render_anomalies(docs: DataFrame) -> DataFrame:
    """(doc_id, reasons) of documents with any: oversized blocks, footnotes without definition, lost content, no headings."""
    size = F.length(F.coalesce("text", F.lit("")))
    long = {k: (F.col("type") == k) & (size > n) for k, n in B.LONG.items()}
    solid = lambda *c: F.length(X.squeezed(F.concat(*[F.coalesce(x, F.lit("")) for x in c])))
    start = lambda c, p: F.regexp_extract(c, p, 1)
    found = blocks(docs).groupBy("doc_id").agg(
        *[F.count_if(c).alias(f"n_{k}") for k, c in long.items()], *[F.max(F.when(c, size)).alias(f"most_{k}") for k, c in long.items()],
        F.count_if(F.col("type") == "heading").alias("headings"), F.count_if(F.col("type") == "footnote").alias("notes"), F.sum(solid("label", "value", "text")).alias("shown"),
        F.collect_set(F.when(F.col("type") == "heading", start("text", r"(?U)^(\d+)\)\s"))).alias("heads"),
    )
    text, none = F.col("text"), F.array().cast("array<string>")
    lines = F.transform(X.lines(text), lambda x: start(X.strip(x), r"(?U)^(\d+)\)\s*\S"))
    own = docs.filter("text is not null").select("doc_id", F.length("text").alias("size"), solid("text").alias("there"), B.strict_references(text).alias("numbers"), lines.alias("starts"))
    rows = own.join(found, "doc_id", "left")
    n, defined = lambda c: F.coalesce(c, F.lit(0)), F.array_intersect("numbers", "starts")
    why = F.when(F.size(F.array_except(defined, F.coalesce("heads", none))) > 0, B.ABSORBED).when(F.size(defined) > 0, B.HEADING_LIKE).otherwise(B.MISSING)
    say = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    reasons = [F.when(n(f"n_{k}") > 0, say(f"long {k}: ", F.col(f"n_{k}"), ", up to ", F.col(f"most_{k}"))) for k in B.LONG]
    reasons.append(F.when((F.size("numbers") > 0) & (n("notes") == 0) & (why != B.HEADING_LIKE), say("footnotes: ", F.size("numbers"), " references, ", why)))
    reasons.append(F.when((F.col("there") > 0) & (n("shown") < B.LOSS_RATIO * F.col("there")), say("lost content: ", n("shown"), " of ", F.col("there"))))
    reasons.append(F.when((F.col("size") >= B.HEADING_LENGTH) & (n("headings") == 0), say("no heading in ", F.col("size"))))
    return rows.select("doc_id", F.array_compact(F.array(*reasons)).alias("reasons")).filter(F.size("reasons") > 0)


def line_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text, kind)"""
    rows = docs.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("line", "text"))
    return rows.withColumn("kind", B.line_class(X.strip(F.col("text"))))


def field_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, line, label, value) of the lines that give the value of a known field."""
    rows = docs.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("line", "text")).withColumn("text", X.strip(F.col("text")))
    return rows.select("doc_id", "line", B.field_label(F.col("text")).alias("label"), B.field_value(F.col("text")).alias("value")).filter("label is not null")


def caption_flags(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("line", "text")).withColumn("text", X.strip(F.col("text")))
    return rows.select("doc_id", "line", *[c.alias(n) for n, c in B.caption_tests(F.col("text")).items()])


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(document_id, chunk_index, chunk_id, text)"""
    rows = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(chunk_udf("text")).alias("chunk_index", "text"))
    return rows.withColumn("chunk_id", X.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("text")))
