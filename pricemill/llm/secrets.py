"""Secret scans: known formats, and a battery of randomness tests for everything else.

Known formats (``assign``, ``access``, ``hex``) are found by pattern. Any run of 20 or more
characters that an encoding could have produced is a candidate, less the known spans in it. So
are its parts between ``/``, ``-`` and ``_`` if they are as long: words joined to a key must not
hide it. A part is listed only where the whole is dismissed. A candidate's encoding is inferred (hex,
base32, base62, base64), its characters become digits of that alphabet, and four tests ask
whether the digits are uniform and independent: chi-squared over the alphabet and over its
quarters, runs about the middle, and serial correlation. The smallest of the four probabilities,
times four, is the candidate's p-value for being random. Words and paths fail clearly; keys do not.

Candidates that are not random are dismissed by the Benjamini-Hochberg rule, within strata of
encoding and length, since short runs give weaker evidence and must not share a threshold with
long ones. So at most ``alpha`` of the dismissed are expected to be random. What is left is a
span of kind ``random``; it never overlaps a span of a known format.

Everything is DataFrame functions. Positions are code points, ends exclusive. Defined cases: a
null text is empty and has no spans; repeated rows are scanned each on its own; empty tables give
no rows; other columns are ignored or, by ``redact``, kept.
"""

import math
import string

from pyspark.sql import functions as F

from pricemill.llm.common import documents_columns

# The known formats, in the order in which spans of equal start are listed
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 8

LEAST_CANDIDATE = 20
CANDIDATE = "[A-Za-z0-9+/_-]{%d,}" % LEAST_CANDIDATE
PART = "[A-Za-z0-9+]{%d,}" % LEAST_CANDIDATE
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "base62": string.ascii_uppercase + string.ascii_lowercase + string.digits,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
}
LENGTH_BANDS = (32, 64)
ALPHA = 0.01
BINS_PER_DECADE = 10
LAST_BIN = 200

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _found(text, pattern, group):
    """Pieces between the matches, and (match, group) pairs; null where nothing matches."""
    hit = F.when(
        text.rlike(pattern),
        F.struct(
            F.split(text, pattern, -1).alias("pieces"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
        ),
    )
    return hit


def _located(found, kind):
    """Spans of the matches: each starts after all pieces and matches before it."""
    steps = F.arrays_zip(
        F.slice(found["pieces"], 1, F.size(found["matches"])).alias("piece"),
        found["matches"].alias("match"),
        found["values"].alias("value"),
    )
    zero = F.struct(
        F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans")
    )

    def step(state, x):
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
            end.alias("end"), x["value"].alias("value"),
        )
        return F.struct(
            end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans")
        )

    spans = F.aggregate(steps, zero, step, lambda state: state["spans"])
    return F.coalesce(spans, F.array().cast(_SPAN))


def base_spans(frame):
    """Adds ``base_spans``: spans of the known formats as (start, kind, end), sorted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = frame.withColumns(
        {
            "_assign": _found(text, ASSIGN, 2),
            "_access": _found(text, ACCESS, 0),
            "_hex": _found(text, HEX, 0),
        }
    )
    return found.withColumn(
        "base_spans",
        F.concat(
            F.filter(
                _located(F.col("_assign"), "assign"),
                lambda s: F.length(s["value"]) >= LEAST_ASSIGNED,
            ),
            _located(F.col("_access"), "access"),
            _located(F.col("_hex"), "hex"),
        ),
    ).withColumn(
        "base_spans",
        F.array_sort(F.transform(F.col("base_spans"), _bare)),
    ).drop("_assign", "_access", "_hex")


def candidate_spans(frame):
    """Adds ``candidates`` to ``base_spans``: spans of possible encodings, tested.

    Each has ``whole``, a span with its stratum and p-value bin, and ``parts``, the same of its
    parts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = frame.withColumn("_found", _found(text, CANDIDATE, 0))
    runs = found.withColumn("_runs", _located(F.col("_found"), "random"))
    pieces = runs.withColumn(
        "_pieces", F.flatten(F.transform("_runs", lambda run: _clear(run, F.col("base_spans"))))
    )
    both = pieces.withColumns(
        {
            "_whole": tested(F.col("_pieces")),
            "_parts": F.transform("_pieces", lambda piece: tested(_parts(piece))),
        }
    )
    return both.withColumn(
        "candidates", F.arrays_zip(F.col("_whole").alias("whole"), F.col("_parts").alias("parts"))
    ).drop("_found", "_runs", "_pieces", "_whole", "_parts")


def _span(s, start, end):
    """The part of span ``s`` from ``start`` to ``end``."""
    value = F.substring(s["value"], start - s["start"] + 1, end - start)
    return F.struct(
        start.alias("start"), s["kind"].alias("kind"), end.alias("end"), value.alias("value")
    )


def _clear(run, known):
    """What the ``known`` spans, sorted by start, leave of a run, if long enough."""
    touching = F.filter(known, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    zero = F.struct(run["start"].alias("at"), F.array().cast(_SPAN).alias("spans"))

    def more(state, end):
        gap = F.array(_span(run, state["at"], end))
        long = end - state["at"] >= LEAST_CANDIDATE
        return F.concat(state["spans"], F.when(long, gap).otherwise(F.array().cast(_SPAN)))

    def step(state, b):
        return F.struct(
            F.greatest(state["at"], b["end"]).alias("at"), more(state, b["start"]).alias("spans")
        )

    return F.aggregate(touching, zero, step, lambda state: more(state, run["end"]))


def _parts(piece):
    """The parts of a span between separators, if long enough and not all of it."""
    parts = _located(_found(piece["value"], PART, 0), "random")
    whole = F.length(piece["value"])
    return F.transform(
        F.filter(parts, lambda part: part["end"] - part["start"] < whole),
        lambda part: F.struct(
            (piece["start"] + part["start"]).alias("start"), part["kind"].alias("kind"),
            (piece["start"] + part["end"]).alias("end"), part["value"].alias("value"),
        ),
    )


def tested(spans):
    """Each span with ``stratum`` and ``bin``; every step is stored in the array once."""
    return F.transform(
        F.transform(F.transform(F.transform(spans, _encoded), _digits), _statistics), _judged
    )


def _encoded(s):
    value = s["value"]
    encoding = (
        F.when(value.rlike("^[0-9a-f]+$"), "hex")
        .when(value.rlike("^[0-9A-F]+$"), "upper_hex")
        .when(value.rlike("^[A-Z2-7]+$"), "base32")
        .when(value.rlike("^[A-Za-z0-9]+$"), "base62")
        .otherwise("base64")
    )
    return F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.translate(value, "-_", "+/").alias("value"), encoding.alias("encoding"),
    )


def _alphabet(encoding):
    chosen = F.lit(None).cast("string")
    for name, letters in ALPHABETS.items():
        chosen = F.when(encoding == name, letters).otherwise(chosen)
    return chosen


def _digits(s):
    letters = F.filter(F.split(s["value"], ""), lambda c: F.length(c) > 0)
    places = F.transform(letters, lambda c: F.instr(_alphabet(s["encoding"]), c) - 1)
    return F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        s["encoding"].alias("encoding"), places.alias("digits"),
        F.length(_alphabet(s["encoding"])).alias("size"),
    )


def _statistics(s):
    digits, size = s["digits"], s["size"].cast("double")
    n = F.size(digits).cast("double")

    def squared(classes, of):
        """The squared numbers of digits in each class, summed."""
        return F.aggregate(
            F.sequence(F.lit(0), classes - 1), F.lit(0.0),
            lambda total, v: total
            + F.pow(F.size(F.filter(digits, lambda d: of(d) == v)).cast("double"), F.lit(2.0)),
        )

    squares = squared(s["size"], lambda d: d)
    quarters = squared(F.lit(4), lambda d: F.floor(d * 4 / size).cast("int"))
    pairs = F.arrays_zip(
        F.slice(digits, 1, F.size(digits) - 1).alias("a"),
        F.slice(digits, 2, F.size(digits) - 1).alias("b"),
    )
    middle = (size - 1) / 2
    changes = F.size(F.filter(pairs, lambda p: (p["a"] > middle) != (p["b"] > middle)))
    products = F.aggregate(
        pairs, F.lit(0.0), lambda total, p: total + (p["a"] - middle) * (p["b"] - middle)
    )
    return F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        s["encoding"].alias("encoding"), n.alias("n"), (size - 1).alias("freedom"),
        (squares * size / n - n).alias("chi"),
        (quarters * 4 / n - n).alias("coarse"),
        ((2.0 * changes - (n - 1)) / F.sqrt(n - 1)).alias("runs"),
        (products * 12 / (size * size - 1) / F.sqrt(n - 1)).alias("serial"),
    )


def upper_tail(z):
    """1 - Phi(z) by the rational approximation of Abramowitz and Stegun (26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = t * (
        0.319381530
        + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def chi_tail(chi, freedom):
    """The upper tail of chi-squared, by Wilson and Hilferty."""
    ratio = 2 / (9 * freedom)
    root = F.pow(F.greatest(chi, F.lit(0.0)) / freedom, F.lit(1 / 3))
    return upper_tail((root - (1 - ratio)) / F.sqrt(ratio))


def _judged(s):
    p = F.least(
        F.lit(1.0),
        4 * chi_tail(s["chi"], s["freedom"]), 4 * chi_tail(s["coarse"], F.lit(3.0)),
        8 * upper_tail(F.abs(s["runs"])), 8 * upper_tail(F.abs(s["serial"])),
    )
    level = F.least(
        F.lit(float(LAST_BIN)),
        F.floor(-BINS_PER_DECADE * F.log10(F.greatest(p, F.lit(1e-300)))).cast("double"),
    )
    band = sum((s["n"] >= edge).cast("int") for edge in LENGTH_BANDS)
    return F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.concat_ws(":", s["encoding"], band.cast("string")).alias("stratum"),
        level.cast("int").alias("bin"),
    )


def dismissal_levels(docs, alpha=ALPHA):
    """{stratum: p-value bin from which candidates are dismissed}, over all documents.

    The histogram has a row per stratum and bin, at most 15 x 201.
    """
    histogram = (
        candidate_spans(base_spans(documents_columns(docs).select("text")))
        .select(F.explode("candidates").alias("c"))
        .select(F.explode(F.concat(F.array("c.whole"), "c.parts")).alias("c"))
        .groupBy("c.stratum", "c.bin")
        .count()
        .collect()
    )
    return benjamini_hochberg([tuple(row) for row in histogram], alpha)


def benjamini_hochberg(histogram, alpha=ALPHA):
    """The rule over (stratum, bin, count); a bin stands for its largest p-value."""
    strata = {}
    for stratum, level, count in histogram:
        strata.setdefault(stratum, {})[level] = count
    levels = {}
    for stratum, counts in strata.items():
        total, beyond = sum(counts.values()), 0
        for level in sorted(counts, reverse=True):
            beyond += counts[level]
            if 10 ** (-level / BINS_PER_DECADE) <= alpha * beyond / total:
                levels[stratum] = level
    return levels


def with_spans(docs, levels):
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, kind, end), sorted."""
    tried = candidate_spans(base_spans(docs))

    def kept(c):
        bound = F.lit(LAST_BIN + 1)
        for stratum, level in sorted(levels.items()):
            bound = F.when(c["stratum"] == stratum, level).otherwise(bound)
        return c["bin"] < bound

    def found(c):
        parts = F.transform(F.filter(c["parts"], kept), _bare)
        return F.when(kept(c["whole"]), F.array(_bare(c["whole"]))).otherwise(parts)

    return tried.withColumn(
        "spans",
        F.array_sort(
            F.concat(F.col("base_spans"), F.flatten(F.transform("candidates", found)))
        ),
    ).drop("candidates")


def _bare(s):
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))


def listed(spans):
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
                s["end"].cast("string"),
            ),
        ),
        ",",
    )


def scan(docs, alpha=ALPHA):
    """The digest of every document: counts of the known kinds, and all spans as text."""
    spans = with_spans(documents_columns(docs), dismissal_levels(docs, alpha))

    def count(kind):
        number = KINDS.index(kind)
        return F.size(F.filter("base_spans", lambda s: s["kind"] == number)).cast("long")

    return spans.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(docs, alpha=ALPHA, mark="[SECRET]"):
    """All rows and columns of ``docs``, with every span of the text replaced by ``mark``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string"))
    spans = with_spans(rows, dismissal_levels(docs, alpha))
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mark)))
            .otherwise(state["out"]).alias("out"),
        )

    cleaned = F.aggregate(
        "spans", zero, step,
        lambda state: F.concat(
            state["out"], F.substring(text, state["at"] + 1, F.length(text))
        ),
    )
    changed = F.when(F.size("spans") > 0, cleaned).otherwise(text)
    return spans.select(
        *[changed.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    )
