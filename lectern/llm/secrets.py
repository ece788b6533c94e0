"""Secret scan in DataFrame functions only: three fixed patterns and a battery of randomness tests.

Candidates of the battery are long runs of base-64 letters. Each gets the smallest alphabet that holds it (its inferred
encoding) and three tests of the hypothesis that its symbols are drawn uniformly and independently: chi-squared for the
alphabet, runs above and below the alphabet's middle, and lag-one serial correlation; the smallest of the three p-values counts,
times three. A random string has a large one. What has a small one is no secret; but short strings that aren't random often
pass, too, so the share of such false secrets is controlled, for each class of lengths by itself: each candidate has a
decoy of its length, the words around it joined as long names are. The share of decoys that pass a limit tells how many of the
candidates that are no secrets do, and the limit of a class is the widest at which they make up at most FALSE_DISCOVERY.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

# The patterns of the base kinds, in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "random"]

MIN_RANDOM = 20
RANDOM = r"[A-Za-z0-9+/_-]{%d,}" % MIN_RANDOM
FALSE_DISCOVERY = 0.05
BINS = 4096
BIN_WIDTH = 0.02  # of -ln p
LENGTHS = (20, 28, 40, 56)  # where the classes of lengths begin
UNLIKELY = 7.0  # -ln p beyond which hardly any random string is

HEX_LOWER = "0123456789abcdef"
HEX_UPPER = "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"


def matches(text: Column, kind: str, pattern: str, at_least: str, keep) -> Column:
    """Array of (kind, start, end, value) of a pattern's leftmost non-overlapping matches, in code points, end exclusive.

    What lies between the matches comes from split(), so a match begins at the sum of the lengths before it. ``at_least``
    is a pattern that any text with a match worth keeping has; other texts aren't cut. ``keep`` is the filter of a match.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["g"]
        end = begin + F.char_length(p["m"])
        one = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), p["m"].alias("value"))
        return F.struct(end.alias("at"), F.when(keep(p["m"]), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    none = F.expr("array()").cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(text.rlike(at_least), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """The spans of the three base kinds; matches that fail a length are dropped after matching."""
    group2 = lambda m: F.regexp_extract(m, f"(?s)^{ASSIGN}$", 2)
    return (
        matches(text, "assign", ASSIGN, r"(?i:password|passwd|secret|token|api_?key)", lambda m: F.char_length(group2(m)) >= 12),
        matches(text, "access", ACCESS, r"AKIA[A-Z0-9]{14}", lambda m: F.char_length(m) >= 18),
        matches(text, "hex", HEX, r"[0-9a-f]{16}", lambda m: F.char_length(m) >= 16),
    )


def _let(x: Column, f) -> Column:
    """``f`` of ``x``, which is evaluated once however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the logistic approximation of its distribution function."""
    return _let(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z)), lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.070565992) * z * z * z)))


def _squares(symbols: Column) -> Column:
    """The sum over the symbols of their count squared; equal ones are neighbours once sorted."""
    return F.aggregate(
        F.array_sort(symbols), F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sq")),
        lambda a, x: F.when(x == a["last"], F.struct(x.alias("last"), (a["k"] + 1.0).alias("k"), (a["sq"] + 2.0 * a["k"] + 1.0).alias("sq"))).otherwise(F.struct(x.alias("last"), F.lit(1.0).alias("k"), (a["sq"] + 1.0).alias("sq"))),
        lambda a: a["sq"],
    )


def _walk(symbols: Column, middle: Column) -> Column:
    """What the other two tests need of the symbols in their order."""
    return F.aggregate(
        symbols, F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("hi"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("lag"), F.lit(0.0).alias("first")),
        lambda a, x: F.struct(
            x.alias("last"), (a["hi"] + F.when(x > middle, 1.0).otherwise(0.0)).alias("hi"),
            (a["runs"] + F.when((a["last"] < 0) | ((x > middle) != (a["last"] > middle)), 1.0).otherwise(0.0)).alias("runs"),
            (a["s"] + x).alias("s"), (a["ss"] + x * x).alias("ss"), (a["lag"] + F.when(a["last"] < 0, 0.0).otherwise(a["last"] * x)).alias("lag"),
            F.when(a["last"] < 0, x).otherwise(a["first"]).alias("first"),
        ),
    )


def _chi_squared(squares: Column, size: Column, n: Column) -> Column:
    """The p-value of the alphabet's uniformity, by the cube root of chi-squared."""
    chi, df = size / n * squares - n, size - 1.0
    cube = F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3))
    return _upper_tail((cube - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df)))


def _runs(w: Column, n: Column) -> Column:
    """The p-value of the number of runs above and below the alphabet's middle."""
    hi, lo = w["hi"], n - w["hi"]

    def of(expected: Column) -> Column:
        spread = (expected - 1.0) * (expected - 2.0) / (n - 1.0)
        z = F.when((hi == 0) | (lo == 0) | (spread <= 0), F.lit(8.0)).otherwise(F.abs(w["runs"] - expected) / F.sqrt(F.greatest(spread, F.lit(1e-9))))
        return 2.0 * _upper_tail(z)

    return _let(2.0 * hi * lo / n + 1.0, of)


def _serial(w: Column, n: Column) -> Column:
    """The p-value of the correlation of each symbol with the next, the last with the first."""
    mean = w["s"] / n

    def of(variance: Column) -> Column:
        lag = (w["lag"] + w["last"] * w["first"]) / n - mean * mean
        return 2.0 * _upper_tail(F.when(variance <= 1e-9, F.lit(8.0)).otherwise(F.abs(lag / F.greatest(variance, F.lit(1e-9)) + 1.0 / n) * F.sqrt(n)))

    return _let(w["ss"] / n - mean * mean, of)


def log_p(value: Column) -> Column:
    """-ln of the p-value that ``value`` is random in its inferred encoding, from 0 to 80: the smallest of the three, times three."""

    def tested(v: Column, alphabet: Column) -> Column:
        places = F.transform(F.filter(F.split(v, ""), lambda c: c != ""), lambda c: (F.position(c, alphabet) - 1).cast("double"))
        size, n = F.least(F.char_length(alphabet), F.lit(64)).cast("double"), F.char_length(v).cast("double")

        def battery(symbols: Column) -> Column:
            least = _let(_walk(symbols, (size - 1.0) / 2.0), lambda w: F.least(_chi_squared(_squares(symbols), size, n), _runs(w, n), _serial(w, n)))
            return F.least(F.lit(80.0), -F.log(F.least(F.lit(1.0), 3.0 * least)))

        # "-" and "_" stand for "+" and "/" in the other base-64 alphabet.
        return _let(F.transform(places, lambda x: F.when(x >= 64.0, x - 2.0).otherwise(x)), battery)

    def encoding(v: Column) -> Column:
        return (
            F.when(v.rlike("^[0-9a-f]+$"), F.lit(HEX_LOWER)).when(v.rlike("^[0-9A-F]+$"), F.lit(HEX_UPPER))
            .when(v.rlike("^[A-Z2-7]+$"), F.lit(BASE32)).otherwise(F.lit(BASE64))
        )

    return _let(value, lambda v: _let(encoding(v), lambda alphabet: tested(v, alphabet)))


def length_class(n: Column) -> Column:
    """The number of the class of lengths, from 0."""
    return sum(((n >= low).cast("int") for low in LENGTHS[1:]), F.lit(0))


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, bin, size, value) of the runs that the battery tests: the bin of -ln p and the class of lengths."""
    runs = matches(text, "random", RANDOM, RANDOM, lambda m: F.lit(True))
    return F.transform(runs, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _bin(s["value"]).alias("bin"), length_class(s["end"] - s["start"]).alias("size")))


def _bin(value: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(log_p(value) / BIN_WIDTH)).cast("int")


def decoy(text: Column, start: Column, end: Column) -> Column:
    """A string as long as the run from ``start`` to ``end``: the words around it, in camel case; null if there are too few."""
    n = end - start
    low = F.greatest(F.lit(0), start - 4 * n)
    around = F.concat(F.substring(text, low + 1, start - low), F.lit(" "), F.substring(text, end + 1, 4 * n))
    joined = F.regexp_replace(F.initcap(F.regexp_replace(around, "[^A-Za-z]+", " ")), " ", "")
    return F.when(F.char_length(joined) >= n, F.substring(joined, F.lit(1), n))


def limits(tested: DataFrame, q: float = FALSE_DISCOVERY) -> list[int]:
    """For each class of lengths the bin below which a candidate is reported, from rows (size, bin, decoy): ``decoy`` is the bin of its decoy.

    Among the candidates below a limit, those that are no secrets number their whole number times the share of decoys below it;
    and their whole number follows from the candidates and decoys beyond UNLIKELY, where hardly any secrets are. Only counts of
    bins (2 * BINS rows for each class at most) reach the driver. A class without decoys takes those of all classes; without
    any, what the tests don't reject at level ``q`` each is reported.
    """
    each = tested.select("size", F.explode(F.array(F.struct(F.lit(True).alias("real"), F.col("bin").alias("b")), F.struct(F.lit(False).alias("real"), F.col("decoy").alias("b")))).alias("x"))
    counts = {(s, real): [0] * BINS for s in range(len(LENGTHS)) for real in (True, False)}
    for size, real, b, c in each.select("size", "x.*").where("b IS NOT NULL").groupBy("size", "real", "b").count().collect():
        counts[size, real][b] = c
    pooled = [sum(counts[s, False][b] for s in range(len(LENGTHS))) for b in range(BINS)]
    return [_limit(counts[s, True], counts[s, False] if any(counts[s, False]) else pooled, q) for s in range(len(LENGTHS))]


def _limit(real: list[int], decoys: list[int], q: float) -> int:
    n, m, far = sum(real), sum(decoys), int(UNLIKELY / BIN_WIDTH)
    if not m:
        return math.ceil(-math.log(q) / BIN_WIDTH)
    beyond = sum(decoys[far:]) / m
    plain = min(n, sum(real[far:]) / beyond) if beyond else n
    best = below = false = 0
    for b in range(BINS):
        below += real[b]
        false += decoys[b]
        if plain * false / m <= q * below:
            best = b + 1
    return best


def scan_secrets(df: DataFrame, text_col: str = "text", q: float = FALSE_DISCOVERY) -> DataFrame:
    """Append ``base_spans`` and ``spans``, arrays of (kind, start, end) ordered by start, then kind as listed in KINDS.

    Null and empty texts have empty arrays; a row's base spans depend on its text alone, so ties and repeated rows change
    nothing there; the battery's limits depend on all candidates of the table, repeated ones counted each. An empty
    table gives an empty one; columns of the same names are replaced. No shuffle but the histogram's.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = df.select(text.alias("t")).where(F.col("t").rlike(RANDOM)).select("t", F.explode(candidates(F.col("t"))).alias("c"))
    most = limits(runs.select("c.size", "c.bin", _bin(decoy(F.col("t"), F.col("c.start"), F.col("c.end"))).alias("decoy")), q)
    assign, access, hexes = base_spans(text)
    base, other = unused(df, "base", "other")
    out = df.withColumn(base, F.concat(assign, access, hexes)).withColumn(other, candidates(text))
    order = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.lit(KINDS), s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    shape = lambda a: F.transform(order(a), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    short = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    more = F.filter(other, lambda s: s["bin"] < F.get(F.lit(most), s["size"]))
    out = out.withColumn("base_spans", shape(F.col(base))).withColumn("spans", shape(F.concat(short(F.col(base)), short(more))))
    return out.drop(base, other)
