"""Main text of HTML pages: template deduction by equivalence classes over the pages of a host.

A page's tokens are its element paths and its texts at their paths. A token's occurrence vector has
its number of occurrences in every page of the host; tokens with the same vector form an
equivalence class. Vectors are compared as an exclusive-or of hashes of (page, number), so they
add up in any order and a host of very many pages is summed by many tasks. A class is valid if it
has two tokens or more and occurs in ``least_pages`` pages and ``least_percent`` percent of the
host's. Valid classes nest: a class hangs below the class of its tokens' parent path. Texts of
valid classes are the template's own words, and its elements that stand once on their pages bound the slots.

The slot that is extracted is the innermost such element that holds more than half of the host's text outside
of links: there is one such chain of elements at most. An <article> or <main> on it goes before elements
inside of it, and elements of a single text, such as paragraphs, bound no slot. Its texts are the main text, less the template's
own and less what an article never holds (menus, sidebars, forms, scripts, and elements whose class is
a word for adverts or reader comments). Names of elements and classes decide more than that only where a host
has no such slot, as with fewer than ``least_pages`` pages: there <article> or <main> is the slot, or else
all blocks that aren't lists of links, without elements that bear a listed word.

The template of a host is at most a few times an average page. Templates are joined to the pages by
host, broadcast only if they have ``broadcast_tokens`` tokens at most in all.

Null and empty pages have an empty text. A null URL has the empty host. Pages of a host with the same three longest
texts, whatever their ids and the rest of their HTML, count as one page in vectors and numbers of pages, so a group of
copies is no template; results are per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentariff.llm.html_blocks import ARTICLE, blocks_and_paths, token_hash
from tokentariff.llm.text import prepare_workers, work_folder, written
from tokentariff.llm.url_templates import url_host

LEAST_PAGES, LEAST_PERCENT = 5, 30
BROADCAST_TOKENS = 200_000
LINKED = 0.5


TOKEN_ROW = ("host string, page long, token long, parent long, text boolean, n int, rank int, "
             "chars long")
# Elements of the HTML standard that hold a text each.
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre caption figcaption summary".split())
NAMED = 1_000  # above any depth
LONGEST = 3  # texts by which pages of a host are told apart


def tokens_of(source: str | None) -> tuple[int, list[tuple]]:
    """What tells the page from others of its host, and (token, parent, text, n, rank, chars) of its
    tokens; chars are those of texts below an element, without the linked ones, and the rank says
    which element to choose for a slot, 0 for none."""
    blocks, paths = blocks_and_paths(source)
    chars = dict.fromkeys(paths, 0)
    texts: dict[int, list] = {}
    for block in blocks:
        token = token_hash(block.path, block.text)
        if token in texts:
            texts[token][3] += 1
        else:
            texts[token] = [token, token_hash(block.path), True, 1, 0, 0]
        own = round(len(block.text) * (1 - block.links))
        path = block.path
        while path in paths:
            chars[path] += own
            path = paths[path][0]

    def rank(path: str) -> int:
        tag = path.rpartition("/")[2].partition(".")[0]
        return 0 if tag in SINGLE else path.count("/") + NAMED * (tag in ARTICLE)

    rows = [(token_hash(path), token_hash(parent), False, n, rank(path), chars[path])
            for path, (parent, n) in paths.items()]
    longest = sorted({b.text for b in blocks}, key=lambda text: (-len(text), text))[:LONGEST]
    return token_hash("", "\n".join(longest) or source or ""), rows + [tuple(x) for x in texts.values()]


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row for every distinct token of every distinct page. Pages are parsed where they are, and
    tasks drop what their own copies repeat; no page is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, source in zip(batch["host"], batch["html"]):
                page, tokens = tokens_of(source)
                rows += [(host, page, *token) for token in tokens]
            yield pd.DataFrame(rows, columns=["host", "page", "token", "parent", "text", "n", "rank",
                                              "chars"])

    parsed = pages.select(url_host(F.col("url")).alias("host"), "html").mapInPandas(run, TOKEN_ROW)
    return parsed.groupBy("host", "page", "token").agg(
        *[F.max(c).alias(c) for c in ("parent", "text", "n", "rank", "chars")])


def valid_tokens(tokens: DataFrame, least_pages: int = LEAST_PAGES,
                 least_percent: int = LEAST_PERCENT) -> DataFrame:
    """(host, token, parent, text, class, pages, total, rank, chars) of the tokens of valid classes."""
    vectors = tokens.groupBy("host", "token").agg(
        *[F.max(c).alias(c) for c in ("parent", "text", "rank")], F.count("*").alias("pages"),
        F.sum("n").alias("total"), F.sum("chars").alias("chars"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"))
    sizes = tokens.select("host", "page").distinct().groupBy("host").agg(
        F.count("*").alias("all_pages"))
    often = vectors.where(F.col("pages") >= least_pages).join(sizes, "host").where(
        F.col("pages") * 100 >= F.col("all_pages") * least_percent)
    members = Window.partitionBy("host", "pages", "vector")
    return (often.withColumn("size", F.count("*").over(members))
            .withColumn("class", F.min("token").over(members)).where(F.col("size") >= 2)
            .drop("size", "vector", "all_pages"))


def host_templates(pages: DataFrame, **options) -> DataFrame:
    """(host, token, parent, text, class, parent_class, pages) of the tokens of valid classes."""
    prepare_workers(pages.sparkSession)
    classes = valid_tokens(
        written(page_tokens(pages), work_folder(pages.sparkSession, "tokens")), **options)
    above = classes.where(~F.col("text")).select(
        "host", F.col("token").alias("parent"), F.col("class").alias("parent_class"))
    return classes.join(above, ["host", "parent"], "left").select(
        "host", "token", "parent", "text", "class", "parent_class", "pages")


def host_models(tokens: DataFrame, **options) -> DataFrame:
    """(host, slot, words): of every host with a template, the element that bounds its slot, null if
    none does, and the template's own texts."""
    valid = valid_tokens(tokens, **options)
    # Elements without a parent hold all texts of a page.
    top = ~F.col("text") & (F.col("parent") == token_hash(""))
    whole = tokens.where(top).groupBy("host").agg(F.sum("chars").alias("host_chars"))
    inner = F.max_by("token", F.struct("rank", "token"))
    slots = (valid.where(~F.col("text") & (F.col("rank") > 0) & (F.col("total") == F.col("pages")))
             .join(whole, "host")
             .where(2 * F.col("chars") > F.col("host_chars")).groupBy("host")
             .agg(inner.alias("slot")))
    words = valid.where("text").groupBy("host").agg(F.collect_list("token").alias("words"))
    return words.join(slots, "host", "full")


def main_text(source: str | None, slot: int | None = None, template: frozenset = frozenset()) -> str:
    """The texts of the slot, joined by empty lines; by names where there is no slot on this page."""
    blocks, paths = blocks_and_paths(source)
    kept = [b for b in blocks if token_hash(b.path, b.text) not in template]
    inside: dict[str, bool] = {"": False}

    def within(path: str) -> bool:
        if path not in inside:
            inside[path] = token_hash(path) == slot or within(paths[path][0] if path in paths else "")
        return inside[path]

    if slot is not None and any(token_hash(path) == slot for path in paths):
        kept = [b for b in kept if not b.never and within(b.path)]
    else:
        kept = [b for b in kept if not b.outside]
        if any(b.article for b in kept):
            kept = [b for b in kept if b.article]
        else:
            kept = [b for b in kept if b.links <= LINKED]
    return "\n\n".join(b.text for b in kept)


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"),
                 broadcast_tokens: int = BROADCAST_TOKENS, **options) -> DataFrame:
    """``keep`` columns with text and n_chars of every row."""
    spark = pages.sparkSession
    prepare_workers(spark)
    folder = work_folder(spark, "templates")
    tokens = written(page_tokens(pages), f"{folder}/tokens")
    models = written(host_models(tokens, **options).select(
        F.col("host").alias("_host"), F.col("slot").alias("_slot"), F.col("words").alias("_words")),
        f"{folder}/models")
    size = models.agg(F.sum(1 + F.coalesce(F.size("_words"), F.lit(0)))).first()[0] or 0
    if size <= broadcast_tokens:
        models = F.broadcast(models)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, slots, templates in batches:
            yield pd.Series([
                main_text(source, None if not slot else int(slot),
                          frozenset(() if template is None else template))
                for source, slot, template in zip(sources, slots, templates)], dtype="object")

    named = [F.col(f"`{c}`") for c in keep]
    joined = pages.select(*named, F.col("html").alias("_html"),
                          url_host(F.col("url")).alias("_of")).join(
        models, F.col("_of") == F.col("_host"), "left")
    # Slots go to Python as text, since pandas would round large numbers beside a null.
    return joined.select(*named, text_of("_html", F.col("_slot").cast("string"), "_words")
                         .alias("text")).withColumn("n_chars", F.length("text").cast("long"))
