"""Article text of pages, found from the pages of a host together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import html as H
from wordloom.functions.text import strip_ruby, text_id

#: A block on more than this share of a host's different pages is boilerplate, if it is
#: on ``REPEATED_ON_PAGES`` of them at least: on a host of two pages a share says nothing.
REPEATED_SHARE = 0.1
REPEATED_ON_PAGES = 3
#: A page with less of its text left than this is a variant of another page, and keeps it all.
MIN_OWN_SHARE = 0.3
#: A block with a larger share of link text is navigation.
MAX_LINK_SHARE = 0.5


def page_metadata(pages: DataFrame) -> DataFrame:
    """Source columns of a page: title, author and site."""
    return pages.select(
        F.col("page_id").alias("source_id"),
        F.lit("website_article").alias("source_type"),
        H.page_title(F.col("html")).alias("title"),
        H.page_author(F.col("html")).alias("author"),
        H.page_site(F.col("html"), F.col("url")).alias("website"),
        "url",
        F.lit("").alias("meta"),
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    """``(page_id, host, content_id, block_idx, block_id, block, link_chars)`` of all blocks with text.

    ``content_id`` is the same for pages with the same blocks. A page without any text keeps one
    row with NULLs.
    """
    markup = H.block_markup(H.content_markup(strip_ruby(F.col("html"))))
    blocks = F.filter(
        F.transform(
            markup,
            lambda m: F.struct(
                H.plain_text(m).alias("block"), H.link_chars(m).alias("link_chars")
            ),
        ),
        lambda b: b["block"] != "",
    )
    return pages.select(
        "page_id",
        H.url_host(F.col("url")).alias("host"),
        blocks.alias("blocks"),
    ).select(
        "page_id",
        "host",
        text_id(F.array_join("blocks.block", "\n")).alias("content_id"),
        F.posexplode_outer("blocks").alias("at", "b"),
    ).select(
        "page_id",
        "host",
        "content_id",
        F.col("at").cast("bigint").alias("block_idx"),
        F.when(F.col("b").isNotNull(), text_id(F.col("b.block"))).alias("block_id"),
        F.col("b.block").alias("block"),
        F.col("b.link_chars").alias("link_chars"),
    )


def repeated_blocks(blocks: DataFrame, share: float = REPEATED_SHARE) -> DataFrame:
    """``(host, block_id)`` of blocks that many different pages of a host share. Moves keys, not text.

    Copies of a page count as one page, under however many addresses a host shows it.
    """
    keys = blocks.where(F.col("block_id").isNotNull()).select("host", "block_id", "content_id")
    counted = keys.distinct().groupBy("host", "block_id").agg(F.count(F.lit(1)).alias("pages"))
    hosts = keys.select("host", "content_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    often = (F.col("pages") >= REPEATED_ON_PAGES) & (F.col("pages") > share * F.col("of"))
    return counted.where(F.col("pages") >= REPEATED_ON_PAGES).join(hosts, "host").where(often).select(
        "host", "block_id")


def main_text(blocks: DataFrame, share: float = REPEATED_SHARE) -> DataFrame:
    """``(page_id, n_blocks, text)``: the blocks that are neither navigation nor boilerplate.

    A page that would lose most of its text is a variant of other pages of the host, not
    boilerplate around an article of its own, and keeps all blocks that are no navigation.
    Every page keeps its row, if only with empty text. Only keys take part in the count and
    the join; text is shuffled once, by page, where it meets the positions to leave out.
    ``blocks`` is read several times, mostly without its text: write ``page_blocks`` to a
    table and pass that, so that the markup is parsed once.
    """
    repeated = blocks.join(
        repeated_blocks(blocks, share), ["host", "block_id"], "left_semi"
    ).select("page_id", "block_idx", F.lit(None).cast("string").alias("block"))
    is_text = F.col("link_chars") <= MAX_LINK_SHARE * F.length("block")
    candidates = blocks.select(
        "page_id", "block_idx", F.when(is_text, F.col("block")).alias("block")
    )
    # A repeated block leaves a NULL next to its text, which sorts first and strikes it out.
    merged = (
        candidates.unionByName(repeated)
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("block_idx", "block"))).alias("all"))
    )
    before = F.transform(F.col("all"), lambda b, i: F.get(F.col("all"), i - 1)["block_idx"])
    kept = F.filter(
        F.arrays_zip(F.col("all").alias("b"), before.alias("before")),
        lambda z: z["b"]["block"].isNotNull()
        & (F.coalesce(z["before"], F.lit(-1)) != z["b"]["block_idx"]),
    )
    def chars(texts: Column) -> Column:
        return F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t))

    whole = F.filter(F.col("all.block"), lambda t: t.isNotNull())
    chosen = merged.select("page_id", F.transform(kept, lambda z: z["b"]["block"]).alias("own"), whole.alias("whole"))
    variant = chars(F.col("own")) < MIN_OWN_SHARE * chars(F.col("whole"))
    return chosen.select("page_id", F.when(variant, F.col("whole")).otherwise(F.col("own")).alias("kept")).select(
        "page_id",
        F.size("kept").cast("bigint").alias("n_blocks"),
        F.array_join("kept", "\n").alias("text"),
    )
