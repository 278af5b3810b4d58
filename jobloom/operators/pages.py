"""Pages to rows: links, cards, details, pagers, archives, plain-text listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import html as H
from jobloom.functions.text import clean, nonempty, resolve, url_path
from jobloom.operators.records import first_per_key
from jobloom.sources.profiles import SourceProfile


def page_links(pages: DataFrame, base_url: Column | str, pattern: str = ".") -> DataFrame:
    """(page url, pos, source_url, text): links matching a pattern, each once per page."""
    found = pages.select("url", F.posexplode(H.links("html")).alias("pos", "link")).filter(
        F.col("link.href").rlike(pattern)
    )
    resolved = found.select(
        "url", "pos", resolve(base_url, "link.href").alias("source_url"), F.col("link.text").alias("text")
    )
    return first_per_key(resolved, ["url", "source_url"], [F.col("pos")])


def expand_pager(pages: DataFrame, pattern: str = r"page=(\d+)") -> DataFrame:
    """The page itself and one row per further page its pager announces."""
    last = F.coalesce(H.last_page("html", pattern), F.lit(0))
    sep = F.when(F.contains(F.col("url"), F.lit("?")), "&").otherwise("?")
    numbers = F.sequence(F.lit(0), last)
    return pages.select("url", sep.alias("_s"), F.explode(numbers).alias("page")).select(
        "url",
        "page",
        F.when(F.col("page") == 0, F.col("url"))
        .otherwise(F.concat("url", "_s", F.lit("page="), F.col("page").cast("string")))
        .alias("page_url"),
    )


def expand_offsets(pages: DataFrame, page_size: int = 50, default_pages: int = 2000) -> DataFrame:
    """Listing offsets from an announced total: pages = total // size + 1."""
    total = F.replace(
        F.regexp_extract(H.visible_text("html"), r"Total jobs:\s*([\d,]+)", 1), F.lit(","), F.lit("")
    ).try_cast("bigint")
    count = F.when(total > 0, F.floor(total / page_size) + 1).otherwise(default_pages).cast("int")
    return pages.select("url", F.explode(F.sequence(F.lit(0), count - 1)).alias("page")).select(
        "url", "page", (F.col("page") * page_size).alias("start")
    )


def real_posting(url: Column | str, base_url: str) -> Column:
    """Own host, a slug, and none of the paths that are not postings."""
    c = F.col(url) if isinstance(url, str) else url
    path = F.lower(url_path(c))
    other = r"/page/|/category/|/tag/|/wp-|/feed|/scholarships/|/tenders/|/tender-"
    return F.startswith(c, F.lit(base_url)) & ~path.rlike(other) & path.rlike(r"[^/]")


# fixed values: what marks a post as a list of other posts
ROUNDUP = r"job.positions.trending|trending.on.mucuruzi"


def is_roundup(title: Column | str, url: Column | str, pattern: str = ROUNDUP) -> Column:
    return F.lower(F.concat_ws(" ", title, url)).rlike(pattern)


def roundup_links(pages: DataFrame, base_url: str) -> DataFrame:
    """Posting links inside roundup bodies: anchors and bare addresses, distinct."""
    bare = F.regexp_extract_all(
        H.text_of("html"), F.lit(base_url.replace(".", r"\.").replace("https", "https?") + r"/[^\s,\"'<>]+"), 0
    )
    bare = F.transform(bare, lambda u: F.regexp_replace(u, r"[.,/]+$", ""))
    anchors = F.transform(H.links("html"), lambda link: link["href"])
    return (
        pages.select("url", F.explode(F.array_union(anchors, bare)).alias("source_url"))
        .filter(real_posting("source_url", base_url))
        .distinct()
    )


def archive_stubs(pages: DataFrame, base_url: str) -> DataFrame:
    """(url, source_url, title) of an archive page: article headings, else heading links."""

    def heading_links(fragments: Column) -> Column:
        each = F.transform(fragments, lambda f: F.get(H.links(f), F.lit(0)))
        return F.filter(each, lambda x: F.coalesce(F.startswith(x["href"], F.lit(base_url)), F.lit(False)))

    in_articles = heading_links(H.elements("html", "article"))
    headings = heading_links(H.elements("html", "h[23]"))
    chosen = F.when(F.size(in_articles) > 0, in_articles).otherwise(headings)
    return pages.select("url", F.posexplode(chosen).alias("pos", "a")).select(
        "url", "pos", F.col("a.href").alias("source_url"), F.coalesce(clean("a.text"), F.lit("")).alias("title")
    )


def extract_cards(pages: DataFrame, profile: SourceProfile) -> DataFrame:
    """Listing pages to stubs, one row per card; cards without link or title are dropped."""
    cards = F.regexp_extract_all(F.col("html"), F.lit(profile.card), F.lit(profile.card_group))
    rows = pages.select("url", F.posexplode(cards).alias("pos", "card"))
    fields = profile.stub(F.col("card"), F.col("url"))
    stubs = rows.select("url", "pos", *[c.alias(n) for n, c in fields.items()])
    return stubs.filter(nonempty("source_url").isNotNull() & nonempty("title").isNotNull()).withColumn(
        "source", F.lit(profile.name)
    )


def extract_details(pages: DataFrame, profile: SourceProfile) -> DataFrame:
    """Posting pages to detail fields, keyed by ``source_url``."""
    text = H.visible_text("html", profile.boilerplate)
    read = pages.select(F.col("url").alias("source_url"), "html", text.alias("text"))
    fields = profile.detail(F.col("html"), F.col("text"))
    return read.select("source_url", *[c.alias(n) for n, c in fields.items()])


# fixed values: layout of one record in the plain-text listing
PLAIN_RECORD = (
    r"([^\n]+)\n([^\n]+\([A-Z\-]+\))\nAPPLY\n(Level:[^\n]+)\n(Posts?:\d+)\n"
    r"(Under (?:Contract|Statute))\nPosted on\n([A-Z][a-z]{2} \d{1,2}, \d{4})\n"
    r"Deadline\n([A-Z][a-z]{2} \d{1,2}, \d{4})"
)


def plain_listing(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Seven-line records of a plain-text listing, one row each."""
    names = ["title", "company", "level", "posts", "contract", "posted", "deadline"]
    groups = [
        F.regexp_extract_all(F.col(text), F.lit(PLAIN_RECORD), i + 1).alias(n)
        for i, n in enumerate(names)
    ]
    return df.select(*keep, F.posexplode(F.arrays_zip(*groups)).alias("pos", "r")).select(
        *keep, "pos", *[F.trim(f"r.{n}").alias(n) for n in names]
    )


