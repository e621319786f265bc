"""URL filtering by rules and, where no rule fits, by a cascade of Bloom filters.

The cascade decides exactly whether a host of the corpus is listed. Level 1 holds the listed
hosts; level 2 holds those unlisted hosts of the corpus that level 1 lets through by mistake;
level 3 the listed hosts that level 2 holds by mistake; and so on until no host is mistaken. A
host is listed if it falls out at an even level. The filters are binary literals in the plan, so
pages are neither shuffled nor joined. Their total size is checked while they are built; lists
beyond it are met by a salted join, which is as exact.

Only DataFrame functions are used. Defined cases: a url that is null or has no ``://`` has empty
host and path, fits no rule and is not listed; repeated rows are judged each on its own; an empty
list blocks nothing; empty tables give no rows; other columns are ignored.
"""

import string

from pyspark.sql import functions as F

from pricemill.llm.common import stored

# The rules as (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Parts of host names that put a host on the list
BLOCKED_TERMS = ("adult", "ads", "bets", "casino", "pills", "spam")

BITS_PER_KEY = 6
HASHES = 3
MAX_BYTES = 8 << 20
_BITMAP_BITS = 32768


def url_parts(url):
    """(host, path) of a url column."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(
        F.instr(text, "://") > 0, F.substr(text, F.instr(text, "://") + F.lit(3))
    ).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def longest_rule(host, path, rules=RULES):
    """(rule, verdict) columns of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def has_blocked_term(host, terms=BLOCKED_TERMS):
    return F.exists(F.split(host, "[.-]"), lambda part: part.isin(*terms))


class Level:
    """One Bloom filter: its bits as bytes, and the seed of its hashes."""

    def __init__(self, seed, bits, data=None):
        self.seed, self.bits, self.data = seed, bits, data

    def positions(self, key):
        return [
            F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(j)), F.lit(self.bits))
            for j in range(HASHES)
        ]

    def holds(self, key):
        """All bits of the key are set."""
        found = F.lit(True)
        for at in self.positions(key):
            byte = F.substr(F.lit(self.data), (at / 8).cast("int") + 1, F.lit(1))
            value = F.conv(F.hex(byte), 16, 10).cast("int")
            found = found & (F.getbit(value, (at % 8).cast("int")) == 1)
        return found


class Cascade:
    def __init__(self, levels):
        self.levels = levels

    @property
    def size(self):
        return sum(len(level.data) for level in self.levels)

    def contains(self, key):
        """Whether a key of the universe is listed."""
        answer = F.lit(False)
        for level in reversed(self.levels):
            answer = level.holds(key) & ~answer
        return answer


def build_level(keys, count, seed):
    """Encode ``keys``; the bits come to the driver in pieces of 4 KB, MAX_BYTES at most."""
    level = Level(seed, max(64, -(-count * BITS_PER_KEY // 64) * 64))
    places = F.array(*[at + 1 for at in level.positions(F.col("key"))])
    pieces = (
        keys.select(F.explode(places).alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        .collect()
    )
    data = bytearray(-(-level.bits // _BITMAP_BITS) * (_BITMAP_BITS // 8))
    for bucket, bits in pieces:
        start = (bucket - 1) * (_BITMAP_BITS // 8)
        data[start:start + len(bits)] = bits
    level.data = bytes(data[:level.bits // 8])
    return level


def build_cascade(universe, max_bytes=MAX_BYTES):
    """The cascade over ``universe`` (key, listed; keys distinct), or None if it grows too large."""
    inside = universe.where("listed").select("key")
    outside = universe.where("not listed").select("key")
    levels, size, count = [], 0, inside.count()
    while count:
        size += count * BITS_PER_KEY // 8 + 8
        if size > max_bytes:
            return None
        level = build_level(inside, count, len(levels))
        levels.append(level)
        inside, outside = stored(outside.where(level.holds(F.col("key")))), inside
        count = inside.count()
    return Cascade(levels)


def with_listed(frame, universe, salts=32):
    """The join that stands in for a cascade beyond its size: adds ``listed`` by ``host``."""
    marked = universe.where("listed").select(
        "key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("key_salt")
    )
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int")
    salted = frame.withColumn("salt", salt)
    joined = salted.join(
        marked, (salted.host == marked.key) & (salted.salt == marked.key_salt), "left"
    )
    return joined.withColumn("listed", F.col("key").isNotNull()).drop("key", "key_salt", "salt")


def filter_urls(pages, rules=RULES, listed=has_blocked_term, max_bytes=MAX_BYTES):
    """page_id, host, path, rule and verdict of every page; ``listed`` maps a host to a condition."""
    host, path = url_parts(F.col("url"))
    parts = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")
    )
    # the empty host is a key like any other: the cascade is exact only for keys of the universe
    universe = stored(
        parts.groupBy(F.col("host").alias("key")).agg(
            F.any_value(listed(F.col("host")) & (F.col("host") != "")).alias("listed")
        )
    )
    cascade = build_cascade(universe, max_bytes)
    if cascade is None:
        judged = with_listed(parts, universe)
    else:
        judged = parts.withColumn("listed", cascade.contains(F.col("host")))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )
