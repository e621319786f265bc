"""One load for all pairs: what has landed is routed to its parser, what no parser takes is kept.

A landed row is a response with the pair it answers for (``base``, ``quote``), its ``kind``
(``prices`` or ``indicators``) and its text. The feed follows from the pair: exchange rates,
candles, or indicators. Each feed has one bronze table for all its pairs. A response counts once:
the manifest of what was loaded before is left out first, so a delivery may be repeated. Responses
that are not of their feed's shape go to a table of their own, with the feed that refused them.
"""

from pyspark.sql import functions as F

from pricemill.functions.scalars import feed_kind, series_table_name
from pricemill.plans import bronze
from pricemill.sources import evolving, payloads, planning

FEEDS = ("candles", "fx", "indicators")
_SHAPES = {
    "candles": payloads.is_candles, "fx": payloads.is_rates, "indicators": payloads.is_indicators,
}


def routed(landed):
    """Landed rows with feed, table name, an id of the response, and whether its shape is known."""
    feed = F.when(F.col("kind") == "indicators", "indicators").otherwise(feed_kind("base", "quote"))
    identity = F.sha2(F.concat_ws("\u0001", "kind", "base", "quote", F.coalesce("payload", F.lit(""))), 256)
    known = F.lit(False)
    for name, test in _SHAPES.items():
        known = F.when(F.col("feed") == name, test("payload")).otherwise(known)
    return landed.withColumns({"feed": feed, "payload_id": identity}).withColumns(
        {"table_name": series_table_name("base", "quote"), "known": F.coalesce(known, F.lit(False))}
    ).dropDuplicates(["payload_id"])


def parsed(rows, feed):
    """The bronze rows of one feed."""
    mine = rows.where((F.col("feed") == feed) & F.col("known")).select(
        F.lower("base").alias("series"), "table_name", F.upper("quote").alias("wanted"), "payload"
    )
    if feed == "candles":
        return payloads.parse_candles(mine, "payload", ["series", "table_name"])
    if feed == "indicators":
        return payloads.parse_indicators(mine, "payload", ["series"])
    every = payloads.parse_all_rates(mine, "payload", ["series", "table_name", "wanted"])
    wanted = F.upper("quote") == F.col("wanted")
    return every.where(wanted & F.col("rate").isNotNull()).drop("wanted")


def load_all(spark, landed, root, loaded_at=None):
    """Load everything that landed and was not loaded before; the rows written by feed."""
    manifest = f"{root}/manifest"
    rows = routed(landed)
    if evolving.exists(spark, manifest):
        rows = rows.join(evolving.read(spark, manifest).select("payload_id"), "payload_id", "left_anti")
    rows = rows.persist()
    try:
        written = {
            feed: bronze.load(spark, parsed(rows, feed), f"{root}/{feed}", loaded_at) for feed in FEEDS
        }
        now = F.current_timestamp() if loaded_at is None else F.lit(loaded_at).cast("timestamp")
        stamps = {"time": now}
        refused = rows.where(~F.col("known")).select(
            "payload_id", "feed", "base", "quote", "payload"
        ).withColumns(stamps)
        written["rejected"] = bronze.load(spark, refused, f"{root}/rejected", loaded_at)
        # last, so that a load that failed on the way is done again
        seen = rows.select("payload_id", "feed", "table_name").withColumns(stamps)
        bronze.load(spark, seen, manifest, loaded_at)
    finally:
        rows.unpersist()
    return written


def pairs_seen(spark, root):
    """The price pairs of the manifest, as request planning takes them."""
    seen = evolving.read(spark, f"{root}/manifest").where("feed <> 'indicators'")
    return seen.select("table_name", "feed").distinct()


def next_requests(spark, root, as_of):
    """The windows to ask for next: each pair begins where its bronze rows end."""
    loaded = None
    for feed in ("candles", "fx"):
        rows = evolving.read(spark, f"{root}/{feed}").select("table_name", "date")
        loaded = rows if loaded is None else loaded.unionByName(rows)
    return planning.plan_requests(pairs_seen(spark, root), loaded, as_of)
