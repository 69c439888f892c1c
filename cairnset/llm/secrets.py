"""Secret scans with built-in functions only.

Base kinds are found by their patterns. Other long tokens are put to a battery of randomness tests: the encoding is
inferred (hex, base32, base36 or base64; letters of one case are upper or lower), which gives the alphabet; a chi-squared test of uniformity against
ordinary, skewed use of the alphabet gives a p-value that takes the length into account; the runs test, the serial
correlation and, where letters of both cases occur, the share of small ones, else the shares of digits and vowels and the
changes between digits and letters must not contradict randomness. Benjamini and Hochberg's rule on all tokens' p-values, from
a histogram of at most BINS bins, says which are secrets.

Where matches stand: split() by the pattern gives the texts between them, so their lengths and those of the
matches add up to positions, in code points.

Defined cases: a null or empty text has no span. Spans of the battery that overlap a base span are dropped. Rows
are scanned one by one, also those that share a doc_id. Other columns, whatever their names, pass through redact() unchanged.
Positions add up by blocks and texts are cut by chunks, so that a text of very many matches takes little longer for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, prefix

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs: the lengths asked for may stand in the pattern. For assign they may not, as a short value still uses up its text.
ACCESS, HEX, RANDOM = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: For each encoding: pattern of the whole token, its alphabet, and by how much ordinary tokens' chi-squared grows a character.
ENCODINGS = {
    "hex": (r"^(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 2.5),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567", 2.0),
    "base36": (r"^(?=.*[0-9])(?=.*[a-zA-Z])(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 2.5),
    "base64": (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.0),
}
#: For the shares in tokens with letters of one case: ordinary words with numbers in them are nearer to randomness there.
RATE, LEAST_Z, SHARE_Z, BINS = 0.01, 3.3, 2.5, 600
#: Bits of the length of a block of numbers, and of a chunk of a text that is cut.
BLOCK_BITS, CHUNK_BITS = 8, 10


def matched(docs: DataFrame, p: str = "_") -> DataFrame:
    """docs with the matches of each kind and, where there are any, the lengths of what lies between them; p begins the new columns' names."""
    text = f"{p}text"
    out = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, RANDOM)):
        out = out.withColumn(p + kind, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, RANDOM)):
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
        out = out.withColumn(f"{p}{kind}_gaps", F.when(F.size(p + kind) > 0, gaps))
    return out.drop(text)


def let(value: Column, body) -> Column:
    """body(value). The value is computed once: the optimizer may put what a column stands for into a lambda, which computes it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine, zero: int) -> Column:
    """For each number of an array, those before it combined.

    By blocks, whose totals come first: an aggregate copies its state at each step, so one that builds a long array
    would take the square of its length.
    """

    def scanned(xs: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def by_blocks(v: Column) -> Column:
        ids = F.sequence(F.lit(0), F.greatest(F.shiftright(F.size(v) - 1, BLOCK_BITS), F.lit(0)))
        block = lambda i: F.slice(v, F.shiftleft(i, BLOCK_BITS) + 1, F.lit(1 << BLOCK_BITS))
        totals = F.transform(ids, lambda i: F.aggregate(block(i), F.lit(zero), combine))
        return let(scanned(totals, F.lit(zero)), lambda starts: F.flatten(F.transform(ids, lambda i: scanned(block(i), F.get(starts, i)))))

    return let(values, by_blocks)


def most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def span(start: Column, end: Column, *more: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), *more)


def placed(m: Column, gaps: Column) -> Column:
    """array<struct<start, end, token>> of matches, from the lengths of what lies between them."""

    def by_gaps(g: Column) -> Column:
        before = running(F.transform(m, lambda x, i: F.get(g, i) + F.char_length(x)), lambda x, y: x + y, 0)

        def one(x: Column, start: Column) -> Column:
            return span(start, start + F.char_length(x), x.alias("token"))

        return let(before, lambda at: F.transform(m, lambda x, i: let(F.get(at, i) + F.get(g, i), lambda start: one(x, start))))

    return F.when(F.size(m) > 0, let(gaps, by_gaps)).otherwise(F.array().cast("array<struct<start:int,end:int,token:string>>"))


def apart(base: Column, tokens: Column) -> Column:
    """Those of the tokens, which don't overlap each other, that overlap no base span.

    In order of start, a token overlaps an earlier base span if one reaches beyond its start, and a later one only if that comes
    next: after another token a base span starts beyond the token's end.
    """
    event = lambda rank: lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), (x["token"] if rank else F.lit(None).cast("string")).alias("token"))
    events = F.array_sort(F.concat(F.transform(base, event(0)), F.transform(tokens, event(1))))

    def kept(e: Column, reach: Column) -> Column:
        def free_(x: Column, i: Column) -> Column:
            after = lambda y: y.isNull() | (y["rank"] == 1) | (y["start"] >= x["end"])
            return (x["rank"] == 1) & (x["start"] >= F.get(reach, i)) & after(F.get(e, i + 1))

        return F.transform(F.filter(e, free_), lambda x: span(x["start"], x["end"], x["token"].alias("token")))

    ends = lambda e: F.transform(e, lambda x: F.when(x["rank"] == 0, x["end"]).otherwise(0))
    return F.when(F.size(tokens) > 0, let(events, lambda e: let(running(ends(e), most, 0), lambda reach: kept(e, reach)))).otherwise(tokens)


def candidates(rows: DataFrame, p: str = "_") -> DataFrame:
    """matched() rows with base, spans of the base kinds in order, and tokens, other tokens with p-values."""
    out = rows
    for kind in KINDS:
        out = out.withColumn(p + kind, placed(F.col(p + kind), F.col(f"{p}{kind}_gaps"))).drop(f"{p}{kind}_gaps")
    value = F.regexp_extract  # group 2 of the match
    out = out.withColumn(f"{p}assign", F.filter(f"{p}assign", lambda x: F.char_length(value(x["token"], ASSIGN, 2)) >= 6))
    spans = [F.transform(p + kind, ranked(r)) for r, kind in enumerate(KINDS[:3])]
    out = out.withColumn(f"{p}base", F.array_sort(F.concat(*spans)))
    out = out.withColumn(f"{p}random", F.filter(f"{p}random", lambda t: encoding(t["token"]).isNotNull()))
    out = out.withColumn(f"{p}random", apart(F.col(f"{p}base"), F.col(f"{p}random")))
    tested = F.transform(f"{p}random", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), p_value(t["token"]).alias("p")))
    return out.withColumn(f"{p}tokens", tested).drop(*(p + k for k in KINDS))


def ranked(rank: int):
    """A span of a kind; its fields stand in the order that spans are sorted by."""
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))


def of_kind(rank: int):
    return lambda s: s["rank"] == rank


def encoding(token: Column) -> Column:
    out = None
    for name, (pattern, _, _) in ENCODINGS.items():
        out = F.when(token.rlike(pattern), F.lit(name)) if out is None else out.when(token.rlike(pattern), F.lit(name))
    return out


def p_value(token: Column) -> Column:
    """Probability that an ordinary token of this length and encoding looks as random; 1 if runs or serial correlation say it isn't random."""
    out = None
    for name, (_, alphabet, skew) in ENCODINGS.items():
        text = F.lower(token) if alphabet.lower() == alphabet else token
        p = _battery(text, alphabet, skew)
        out = F.when(encoding(token) == name, p) if out is None else out.when(encoding(token) == name, p)
    return F.coalesce(out, F.lit(1.0))


def _battery(text: Column, alphabet: str, skew: float) -> Column:
    k = len(alphabet)
    chars = F.split(text, "")
    code = F.filter(F.transform(chars, lambda c: F.instr(F.lit(alphabet), c) - 1), lambda x: x >= 0)
    sorted_ = F.array_sort(chars)
    # sum of squared counts, from runs of equal characters in sorted order
    zero = F.struct(F.lit("").alias("c"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    squares = F.aggregate(
        sorted_,
        zero,
        lambda s, x: F.when(s["c"] == x, F.struct(s["c"].alias("c"), (s["n"] + 1).alias("n"), (s["s"] + 2 * s["n"] + 1).alias("s"))).otherwise(F.struct(x.alias("c"), F.lit(1).cast("long").alias("n"), (s["s"] + 1).alias("s"))),
        lambda s: s["s"],
    )
    n = F.char_length(text).cast("double")
    chi = squares * k / n - n
    mean, var = (k - 1) + skew * n, 2 * ((k - 1) + 2 * skew * n)
    p = _normal_below((chi - mean) / F.sqrt(var))
    # one pass for runs above and below the middle of the alphabet and for the lag-1 correlation
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "hi", "runs", "sx", "sxx", "sxy")], F.lit(-1.0).alias("last"))

    def step(s: Column, x: Column) -> Column:
        x, first, mid = x.cast("double"), s["last"] < 0, k / 2
        turn = F.when(first | ((x >= mid) != (s["last"] >= mid)), 1.0).otherwise(0.0)
        return F.struct(
            (s["n"] + 1).alias("n"), (s["hi"] + F.when(x >= mid, 1.0).otherwise(0.0)).alias("hi"), (s["runs"] + turn).alias("runs"), (s["sx"] + x).alias("sx"),
            (s["sxx"] + x * x).alias("sxx"), (s["sxy"] + F.when(first, 0.0).otherwise(x * s["last"])).alias("sxy"), x.alias("last"),
        )

    def good(s: Column) -> Column:
        n, hi, lo = s["n"], s["hi"], s["n"] - s["hi"]
        mean = 1 + 2 * hi * lo / n
        var = F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.05))
        centre = s["sx"] / n
        spread = F.greatest(s["sxx"] / n - centre * centre, F.lit(1e-9))
        serial = (s["sxy"] / F.greatest(n - 1, F.lit(1.0)) - centre * centre) / spread * F.sqrt(n)
        return (F.abs((s["runs"] - mean) / F.sqrt(var)) <= LEAST_Z) & (F.abs(serial) <= LEAST_Z + 0.5)

    small = sum(c.islower() for c in alphabet) / k
    if alphabet.lower() == alphabet:
        digits, letters = sum(c.isdigit() for c in alphabet) / k, [c for c in alphabet if c.isalpha()]
        vowels, change = sum(c in "aeiou" for c in letters) / len(letters), 2 * digits * (1 - digits)
        n_digits, n_vowels = (F.char_length(F.regexp_replace(text, c, "")) for c in ("[^0-9]", "[^aeiou]"))
        changes = F.char_length(F.regexp_replace(text, "(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])", " ")) - n
        even = F.abs(n_digits - n * digits) <= SHARE_Z * F.sqrt(n * (digits * (1 - digits)))
        even &= changes >= (n - 1) * change - SHARE_Z * F.sqrt((n - 1) * (change * (1 - change)))
        even &= n_vowels <= (n - n_digits) * vowels + SHARE_Z * F.sqrt((n - n_digits) * (vowels * (1 - vowels)))
    else:
        even = F.abs(F.char_length(F.regexp_replace(text, "[^a-z]", "")) - n * small) <= LEAST_Z * F.sqrt(n * (small * (1 - small)))
    return F.when(even & F.aggregate(code, zero, step, good), p).otherwise(1.0)


def _normal_below(z: Column) -> Column:
    """P(N(0, 1) < z), by Abramowitz and Stegun 26.2.17."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    tail = 0.3989422804 * F.exp(-a * a / 2) * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def cutoff(tokens: DataFrame) -> float:
    """Benjamini and Hochberg's greatest p-value that is a discovery; tokens (p). At most BINS rows leave the aggregate."""
    bins = tokens.select(F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-60))) * (BINS / 60)), F.lit(BINS)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    counts = {r.bin: r.n for r in bins.collect()}
    total, seen, best = sum(counts.values()), 0, 0.0
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        most = 10 ** (-b * 60 / BINS)  # the bin's greatest p-value
        if most <= RATE * seen / max(total, 1):
            best = most
    return best


def spans_of(tested: DataFrame, limit: float, p: str = "_") -> DataFrame:
    """candidates() rows with spans: all spans in order of start, then kind."""
    extra = F.transform(F.filter(f"{p}tokens", lambda t: t["p"] <= limit), ranked(3))
    return tested.withColumn(f"{p}spans", F.array_sort(F.concat(f"{p}base", extra)))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_tested); n_tested: tokens that were put to the battery."""
    tested = scratch.save(candidates(matched(docs.select("doc_id", "text"))).select("doc_id", "_base", "_tokens"), "tested")
    limit = cutoff(tested.select(F.explode("_tokens").alias("t")).select("t.p"))
    out = spans_of(tested, limit)
    counts = [F.size(F.filter("_base", of_kind(r))).cast("long").alias(f"n_{kind}") for r, kind in enumerate(KINDS[:3])]
    return out.select("doc_id", *counts, F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"), F.size("_tokens").cast("long").alias("n_tested"))


def redact(docs: DataFrame, scratch: Scratch, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by a mark (overlapping and touching spans by one). Texts are scanned once."""
    p = prefix(docs.columns)
    tested = scratch.save(candidates(matched(docs, p), p), "tested")
    out = spans_of(tested, cutoff(tested.select(F.explode(f"{p}tokens").alias("t")).select("t.p")), p)
    text = F.col("text").cast("string")
    out = out.withColumn(f"{p}spans", joined(F.col(f"{p}spans")))
    n = F.size(f"{p}spans")
    out = out.withColumn(f"{p}chunks", F.when(n > 0, F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % (1 << CHUNK_BITS)), F.lit(0))))
    begin = lambda spans, i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
    end = lambda spans, i: F.when(i < F.size(spans), F.get(spans, i)["start"]).otherwise(F.char_length(text))
    pieces = lambda chunks, spans: F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: between(chunks, begin(spans, i), end(spans, i)))
    left = let(F.col(f"{p}chunks"), lambda chunks: let(F.col(f"{p}spans"), lambda spans: pieces(chunks, spans)))
    redacted = F.when(n > 0, F.array_join(left, mark)).otherwise(text)
    return out.select(*(redacted.alias(c) if c == "text" else col(c) for c in docs.columns))


def joined(spans: Column) -> Column:
    """The union of sorted spans, as array<struct<start, end>>; touching ones are one."""
    ends = F.transform(spans, lambda s: s["end"])
    first = lambda reach: F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.get(reach, i).alias("before"))), lambda r: r["start"] > r["before"])
    last = F.coalesce(F.array_max(ends), F.lit(0))

    def closed(runs: Column) -> Column:
        return F.transform(runs, lambda r, i: span(r["start"], F.coalesce(F.get(runs, i + 1)["before"], last)))

    return let(running(ends, most, -1), lambda reach: let(first(reach), closed))


def between(chunks: Column, a: Column, b: Column) -> Column:
    """The characters from a to b of a text in chunks: each step looks at the chunks it needs, not at the text before them."""
    i, j = F.shiftright(a, CHUNK_BITS), F.shiftright(b - 1, CHUNK_BITS)
    at, size = a - F.shiftleft(i, CHUNK_BITS) + 1, F.lit(1 << CHUNK_BITS)
    over = F.concat(F.substring(F.get(chunks, i), at, size), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), F.substring(F.get(chunks, j), F.lit(1), b - F.shiftleft(j, CHUNK_BITS)))
    return F.when(b <= a, "").when(i == j, F.substring(F.get(chunks, i), at, b - a)).otherwise(over)
