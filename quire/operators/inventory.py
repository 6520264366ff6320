"""The inventory: titles, words, images, estimates, prices and front matter of documents, with their total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.selection import FRONT_PATH
from quire.plans.settings import OUTPUT_RATIO


def heading(markup: Column) -> Column:
    """The first heading's or title's text; empty if the element is there and empty, null if there is none."""
    found = F.regexp_extract(markup, r"(?is)<(h1|h2|title)\b[^>]*>(.*?)</\1>", 2)
    return F.when(markup.rlike(r"(?is)<(h1|h2|title)\b[^>]*>.*?</\1>"), T.unescape(T.visible_text(found)))


def title(markup: Column, label: Column, path: Column) -> Column:
    """Heading, else navigation label, else the file's stem."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)/?$", 1), r"(.)\.[^.]*$", "$1")
    return F.coalesce(heading(markup), label, stem)


def cost(body_tokens: Column, prompt_tokens: int, input_price: float, output_price: float, density: str = "balanced", mode: str = "summary", language: str = "en", local: bool = False) -> Column:
    """Expected dollars of a document."""
    if local:
        return F.lit(0.0)
    share = (1.0 if mode == "full" else OUTPUT_RATIO[density]) * (2 if language == "zh-Hant" else 1)
    return ((body_tokens + prompt_tokens) * input_price + body_tokens * share * output_price) / 1_000_000


def inventory(documents: DataFrame, prompt_tokens: int = 300, input_price: float = 1.0, output_price: float = 4.0) -> DataFrame:
    """One row a document (id, path, markup): title, words, images, tokens, dollars, front_matter."""
    tokens = T.estimate_tokens(F.col("markup"))
    rows = documents.select("id", "path", title(F.col("markup"), F.lit(None).cast("string"), F.col("path")).alias("title"), T.word_count(T.visible_text(F.col("markup"))).alias("words"), T.image_count(F.col("markup")).alias("images"), tokens.alias("tokens"), F.col("path").rlike(FRONT_PATH).alias("front_matter"))
    return rows.withColumn("dollars", F.round(cost(F.col("tokens"), prompt_tokens, input_price, output_price), 6))


def with_total(rows: DataFrame) -> DataFrame:
    """The rows, and one that sums them, of one pass over them."""
    each = rows.select(F.monotonically_increasing_id().alias("_row"), "id", "title", "words", "images", "tokens", "dollars")
    total = F.grouping_id() != 0
    own = lambda c: F.when(~total, F.first(c))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    dollars = F.round(F.coalesce(F.sum("dollars"), F.lit(0.0)), F.lit(4))
    found = each.groupingSets([[F.col("_row")], []], F.col("_row")).agg(own("id").alias("id"), F.when(total, "TOTAL").otherwise(F.first("title")).alias("title"), *map(whole, ("words", "images", "tokens")), F.when(total, dollars).otherwise(F.first("dollars")).alias("dollars"))
    return found.drop("_row")
