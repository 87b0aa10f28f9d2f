"""Tables of HTML pages and paragraphs of zipped documents, from tags and the text between them as rows.

A tag closes the nearest open one of its kind if no other of that kind opened in between; windows over the rows of a page find
that opening, so pages are read in parallel and nothing is parsed in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions.udfs import html_unescape, zip_sections

TOKEN = r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>|[^<]+|<"
NAME = r"^</?([A-Za-z][^\s/>]*)"


def tokens(rows: DataFrame, id: str, markup: str) -> DataFrame:
    """(id, pos, token, tag, opens): tag is null for text; comments are left out."""
    own = rows.select(id, F.posexplode(F.regexp_extract_all(markup, F.lit(TOKEN), F.lit(0))).alias("pos", "token")).filter(~F.col("token").startswith("<!--"))
    tag = X.none_if_empty(F.lower(F.regexp_extract("token", NAME, 1)))
    return own.select(id, "pos", "token", tag.alias("tag"), (tag.isNotNull() & ~F.col("token").startswith("</")).alias("opens"))


def last_of(tags: list[str], order) -> Column:
    """(pos, opens) of the last of some tags before a row."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(F.col("tag").isin(tags), F.struct("pos", "opens")), ignorenulls=True).over(before)


def html_tables(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, n, cells): the outermost closed tables of each page in order, as rows of cells. What nested tables hold joins the table around
    them; a row is what stands between a row's tag and its end without another row's tag between, and so is a cell."""
    order = Window.partitionBy(id).orderBy("pos")
    step = F.when(F.col("tag") == "table", F.when(F.col("opens"), 1).otherwise(-1)).otherwise(0)
    rows = tokens(pages, id, html).withColumn("sum", F.sum(step).over(order))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(order)))  # ends without a beginning count for nothing
    outer = (F.col("tag") == "table") & F.col("opens") & (F.col("depth") == 1)
    rows = rows.withColumn("n", F.sum(F.coalesce(outer, F.lit(False)).cast("int")).over(order))
    rows = rows.withColumn("cell", last_of(["td", "th"], order)).withColumn("row", last_of(["tr"], order))
    ends = F.max(F.when((F.col("tag") == "table") & ~F.col("opens") & (F.col("depth") == 0), F.col("n"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    inside = rows.withColumn("closed", ends)
    data = inside.filter("tag is null and cell.opens").groupBy(id, F.col("cell.pos").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("text"))
    closing = inside.filter("tag in ('td', 'th') and not opens and cell.opens and row.opens").select(id, F.col("cell.pos").alias("at"), F.col("row.pos").alias("row_at"))
    cells = closing.join(data, [id, "at"], "left").groupBy(id, "row_at").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("text", F.lit("")).alias("text")))).alias("own"))
    listed = inside.filter("tag = 'tr' and not opens and row.opens and depth > 0 and closed >= n").select(id, "n", F.col("row.pos").alias("row_at"))
    filled = listed.join(cells, [id, "row_at"], "left").select(id, "n", "row_at", F.explode_outer("own").alias("c"))
    clean = F.trim(F.regexp_replace(html_unescape(F.coalesce("c.text", F.lit(""))), r"(?U)\s+", " "))
    filled = filled.select(id, "n", "row_at", F.col("c.at").alias("at"), clean.alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "text")))), lambda x: x["text"])
    grouped = filled.groupBy(id, "n", "row_at").agg(texts.alias("row")).groupBy(id, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_at", "row"))), lambda x: x["row"]).alias("cells"))
    tables = inside.filter("tag = 'table' and not opens and depth = 0 and n > 0").select(id, "n").distinct()
    return tables.join(grouped, [id, "n"], "left").select(id, (F.col("n") - 1).cast("int").alias("n"), F.coalesce("cells", F.array().cast("array<array<string>>")).alias("cells"))


RUN = r"<hp:t[^>]*>([^<]*)</hp:t>"


def archive_runs(files: DataFrame, id: str = "id", content: str = "content") -> DataFrame:
    """(id, naive): all text runs of all sections in order, cells' as they come."""
    runs = F.flatten(F.transform(zip_sections(content), lambda x: F.regexp_extract_all(x, F.lit(RUN), F.lit(1))))
    return files.select(id, F.array_join(runs, "\n").alias("naive"))


def archive_paragraphs(files: DataFrame, id: str = "id", content: str = "content") -> DataFrame:
    """(id, text): paragraphs with the runs they hold themselves, in the order of their beginnings; a cell's paragraphs are its own."""
    sections = files.select(id, F.posexplode(zip_sections(content)).alias("section", "xml")).withColumn("key", F.struct(id, "section"))
    order = Window.partitionBy("key").orderBy("pos")
    paragraph = F.col("tag") == "hp:p"
    closed = F.col("token").endswith("/>")
    step = F.when(paragraph & ~closed, F.when(F.col("opens"), 1).otherwise(-1)).otherwise(0)
    rows = tokens(sections, "key", "xml").withColumn("depth", F.sum(step).over(order))
    at_depth = Window.partitionBy("key", "depth").orderBy("pos")
    own = rows.withColumn("p", F.last(F.when(paragraph & F.col("opens"), F.col("pos")), ignorenulls=True).over(at_depth))
    run = F.lag("tag").over(order).eqNullSafe("hp:t") & F.lag("opens").over(order)
    runs = own.withColumn("is_run", run).filter("tag is null and is_run and p is not null")
    texts = runs.groupBy("key", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("t")).filter("t <> ''")
    joined = texts.groupBy(F.col(f"key.{id}").alias(id)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key.section", "p", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return files.select(id).join(joined, id, "left").select(id, html_unescape(F.coalesce("text", F.lit(""))).alias("text"))
