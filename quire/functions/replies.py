"""Of a model's endpoint and its replies, as columns inside the JVM: local or not, priced or not, usable, when to ask
again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A loopback endpoint on the usual port, without user or query.
LOOPBACK = r"^https?://(localhost|127\.0\.0\.1|\[::1\]):11434/v1/*$"
#: Seconds that a server's own wish is followed at most, and that a wait grows to.
LONGEST, GROWN = 600.0, 60.0


def local_endpoint(url: Column, *models: Column) -> Column:
    """A loopback endpoint, and no model that runs in a cloud behind it; a missing model is none."""
    cloud = F.lit(False)
    for m in models:
        cloud = cloud | F.coalesce(F.lower(m).contains("cloud"), F.lit(False))
    return F.coalesce(url.rlike(LOOPBACK), F.lit(False)) & ~cloud


def priced(url: Column, model: Column, vision_model: Column, input_price: Column, output_price: Column) -> Column:
    """Whether a price can be told where pictures are described too: nothing is paid, or all that is paid has a price."""
    with_pictures, without = local_endpoint(url, model, vision_model), local_endpoint(url, model)
    known = (F.coalesce(input_price, F.lit(0)) != 0) | (F.coalesce(output_price, F.lit(0)) != 0)
    return with_pictures | (~without & known)


def usable(finish: Column, text: Column, finished: tuple[str, ...] = ("stop", "end_turn")) -> Column:
    """A reply that ended by itself (a missing reason is one) and has text."""
    return (finish.isNull() | finish.isin(*finished)) & F.coalesce(text.rlike(r"\S"), F.lit(False))


def retry_delay(asked: Column, attempt: Column, now: Column | None = None) -> Column:
    """Seconds to wait before the next try, without the random part: what the server asks for, as a number or a date,
    within bounds; else twice as long each time."""
    date = F.try_to_timestamp(F.regexp_replace(asked, "^[A-Za-z]+, *", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    seconds = F.coalesce(asked.try_cast("double"), (F.unix_micros(date) - F.unix_micros(now if now is not None else F.current_timestamp())) / 1e6)
    return F.when(seconds.isNotNull() & ~F.isnan(seconds), F.least(F.greatest(seconds, F.lit(0.0)), F.lit(LONGEST))).otherwise(F.least(F.lit(GROWN), F.pow(F.lit(2.0), attempt)))
