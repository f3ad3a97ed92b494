"""Page-table operators. Key of a page table: (method, document, page)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from blattwerk import fixed
from blattwerk.functions import paths, text
from blattwerk.functions.lookups import method_order
from blattwerk.operators.ordering import number_rows, running_total

# Page numbers that are put together or numbered in one group first; the blocks of a
# document are then joined. Nothing in a result depends on it.
PAGES_PER_BLOCK = 1024


def block_of(page: Column) -> Column:
    return F.floor((page - 1) / PAGES_PER_BLOCK).cast("int")


def texts_in_order(
    pages: DataFrame, shown: Column, separator: str, keys: tuple[str, ...] = ("method", "document")
) -> DataFrame:
    """One row per document: ``text`` joins what its pages show, in page order (null where none shows any).

    Also counts the ``pages`` and, where there are any, sums their ``seconds``.
    Every document takes the same two levels, page blocks first and then their
    texts, so that no task sorts more pages than a block has.
    """
    seconds = ["seconds"] if "seconds" in pages.columns else []
    joined = lambda text, order: F.expr(
        f"listagg({text}, '{separator}') WITHIN GROUP (ORDER BY {order}, {text})"
    )
    blocks = (
        pages.withColumn("__shown", shown)
        .groupBy(*keys, block_of(F.col("page")).alias("__block"))
        .agg(F.count("*").alias("pages"), *[F.sum(n).alias(n) for n in seconds], joined("__shown", "page").alias("__text"))
    )
    return blocks.groupBy(*keys).agg(
        F.sum("pages").alias("pages"), *[F.sum(n).alias(n) for n in seconds], joined("__text", "__block").alias("text")
    )


def select_pages(
    pages: DataFrame, numbers: list[int] | Column | None = None, bounds: Column | None = None
) -> DataFrame:
    """Pages with one of the numbers, or within one of the ``bounds``. None at all means every page.

    Apply before a model pass, so that the filter reaches the scan.
    """
    if bounds is not None:
        inside = F.exists(bounds, lambda b: F.col("page").between(b["first"], b["last"]))
        return pages.where((F.size(bounds) <= 0) | inside)
    if numbers is None or (isinstance(numbers, list) and not numbers):
        return pages
    if isinstance(numbers, list):
        return pages.where(F.col("page").isin(numbers))
    return pages.where((F.size(numbers) <= 0) | F.array_contains(numbers, F.col("page")))


def drop_blank_pages(pages: DataFrame) -> DataFrame:
    return pages.where(~text.is_blank(F.col("content")))


def sort_pages(pages: DataFrame) -> DataFrame:
    return pages.orderBy("document", "page", "method")


def document_text(pages: DataFrame, keys: tuple[str, ...] = ("method", "document")) -> DataFrame:
    """Text of each document: its non-blank pages in order, a blank line between.

    Also counts the pages and, where there are any, sums their ``seconds``.
    """
    kept = F.when(~text.is_blank(F.col("content")), F.col("content"))
    return texts_in_order(pages, kept, r"\n\n", keys).withColumn("text", F.coalesce("text", F.lit("")))


def number_pages_in_document(
    pages: DataFrame, name: str = "number", keys: tuple[str, ...] = ("method", "document")
) -> DataFrame:
    """Adds the place of a page in its document, from 1.

    Pages are counted within blocks; a block's pages get the sizes of the blocks
    before theirs. The same plan for every size. Numbers are made on the keys alone;
    other columns are joined once.
    """
    blocks, key = [*keys, "__block"], [*keys, "page"]
    narrow = pages.select(*key).withColumn("__block", block_of(F.col("page")))
    upto = Window.partitionBy(*keys).orderBy("__block")
    sizes = narrow.groupBy(*blocks).agg(F.count("*").alias("__pages"))
    offsets = sizes.select(*blocks, (F.sum("__pages").over(upto) - F.col("__pages")).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*blocks).orderBy("page"))
    numbers = (
        narrow.join(offsets, blocks)
        .withColumn(name, (place + F.col("__before")).cast("int"))
        .select(*key, name)
    )
    return numbers if set(pages.columns) == set(key) else pages.join(numbers, key)


def number_documents(documents: DataFrame, name: str = "number") -> DataFrame:
    """Adds the place of a document (distinct ``path``) in path order, from 1."""
    return number_rows(documents, paths.path_order(F.col("path")), name)


def number_pages_global(
    pages: DataFrame, name: str = "slide_number", number: str = "page"
) -> DataFrame:
    """Adds one running page number over all documents of a method in path order.

    ``number`` is the page's place in its document. Only the document table is
    ordered; pages get the page count of the documents before theirs.
    """
    sizes = pages.groupBy("method", "document").agg(F.count("*").alias("__pages"))
    totals = running_total(
        sizes, F.col("__pages"), paths.path_order(F.col("document")), "__upto", by="method"
    )
    offsets = totals.select("method", "document", (F.col("__upto") - F.col("__pages")).alias("__before"))
    return (
        pages.join(offsets, ["method", "document"])
        .withColumn(name, F.col("__before") + F.col(number))
        .drop("__before")
    )


def image_records(images: DataFrame) -> DataFrame:
    """Images (distinct ``path``) numbered in path order, titled by file stem."""
    return number_rows(images, paths.path_order(F.col("path")), "page").withColumn(
        "title", paths.stem(F.col("path"))
    )


def image_page_records(pages: DataFrame) -> DataFrame:
    """Pages that are one image each: numbered in path order over all of them, titled by file stem.

    Numbers are made on the paths alone; the other columns are joined once.
    """
    numbers = image_records(pages.select(F.col("document").alias("path")).distinct()).withColumnRenamed("path", "document")
    return pages.drop("page", "title").join(numbers, "document").select(*pages.columns)


def pdf_records(pages: DataFrame) -> DataFrame:
    """Pages of PDFs renumbered from 1 and titled ``<stem>_page_<number>``."""
    number = F.col("number").cast("string")
    padded = F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))
    return (
        number_pages_in_document(pages)
        .withColumn("title", F.concat(paths.stem(F.col("document")), F.lit("_page_"), padded))
        .withColumn("page", F.col("number"))
        .drop("number")
    )


def folder_records(pages: DataFrame) -> DataFrame:
    """Pages of a folder run: running number, title ``<name> / Seite <n>``, source in the notes.

    Numbers are made on the keys alone; the other columns are joined once.
    """
    key = ["method", "document", "page"]
    numbers = number_pages_global(number_pages_in_document(pages.select(*key)), number="number")
    return (
        pages.join(numbers, key)
        .withColumn(
            "title",
            F.concat(
                paths.base_name(F.col("document")), F.lit(" / Seite "), F.col("number").cast("string")
            ),
        )
        .withColumn("notes", F.concat(F.lit("source_file="), F.col("document")))
        .drop("number")
    )


def with_source(pages: DataFrame) -> DataFrame:
    """Adds ``source`` from the notes; the unknown document where they name none."""
    source = F.nullif(text.source_from_notes(F.col("notes")), F.lit(""))
    return pages.withColumn("source", F.coalesce(source, F.lit(fixed.UNKNOWN_SOURCE)))


def sources(pages: DataFrame, number: str = "page") -> DataFrame:
    """One row per method and source, with its first page number, which orders the groups."""
    return (
        with_source(pages)
        .groupBy("method", "source")
        .agg(F.min(number).alias("first_page"), F.count("*").alias("pages"))
        .withColumn("name", paths.base_name(F.col("source")))
    )


# Shares of documents that a source's pages are dealt over.
SOURCE_SHARES = 4096


def group_pages_by_source(pages: DataFrame, number: str = "page") -> DataFrame:
    """Pages with ``source``, ``name`` and the ``first_page`` of their group.

    A source may hold most pages (the unknown one does where notes are missing), so
    pages are grouped in shares of a source first: those of a share of documents and
    of a block of page numbers. Shares meet in a narrow window, and pages meet
    their share. A source of one short document is a single share.
    """
    share = ["method", "source", "__share", "__block"]
    dealt = (
        with_source(pages)
        .withColumn("__share", F.pmod(F.xxhash64("document"), F.lit(SOURCE_SHARES)))
        .withColumn("__block", block_of(F.col(number)))
    )
    first = F.min("__first").over(Window.partitionBy("method", "source"))
    shares = (
        dealt.groupBy(*share).agg(F.min(number).alias("__first"))
        .withColumn("first_page", first)
        .withColumn("name", paths.base_name(F.col("source")))
        .drop("__first")
    )
    return dealt.join(shares, share).drop("__share", "__block")


def batch_time_share(pages: DataFrame, batch: str = "batch", seconds: str = "batch_seconds") -> DataFrame:
    """Adds ``seconds``: the time of a batch divided evenly over its pages."""
    sizes = pages.groupBy(batch).agg(F.count("*").alias("__pages"))
    return pages.join(sizes, batch).withColumn("seconds", F.col(seconds) / F.col("__pages")).drop("__pages")


def zip_pages_texts(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Pages with the texts of the same page; unpaired rows of either side drop out.

    The key is (method, document, page) where texts have a method, else (document, page).
    """
    key = [name for name in ("method", "document", "page") if name in texts.columns]
    return pages.join(texts, key)


def pages_by_method(pages: DataFrame, methods: list[str]) -> DataFrame:
    """Every page once per chosen method (each taken once, in the fixed order)."""
    chosen = [name for name in fixed.METHODS if name in methods]
    return pages.withColumn("method", F.explode(F.array(*[F.lit(name) for name in chosen])))


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def union_method_results(results: list[DataFrame]) -> DataFrame:
    """Results of several methods in one table, with the fixed method order."""
    return union_all(results).withColumn("method_order", method_order(F.col("method")))


def preview_pages(pages: DataFrame, length: int = 200, count: int = 3) -> DataFrame:
    """First pages of each method: beginning of the text on one line, and full length.

    Only ``count`` rows per method and task reach the shuffle, with the beginning
    of their text alone.
    """
    first = Window.partitionBy("method").orderBy(paths.path_order(F.col("document")), "page")
    shown = pages.select(
        "method", "document", "page", F.length("content").alias("chars"),
        F.replace(F.substring("content", 1, length), F.lit("\n"), F.lit(" ")).alias("preview"),
    )
    return (
        shown.withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= count)
        .select("method", "place", "document", "page", "chars", "preview")
    )


def more_pages(pages: DataFrame, count: int = 3) -> DataFrame:
    """How many pages of each method the preview leaves out."""
    return pages.groupBy("method").agg(
        F.greatest(F.count("*") - F.lit(count), F.lit(0)).alias("more")
    )
