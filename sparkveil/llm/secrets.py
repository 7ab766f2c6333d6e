"""Secret scan in DataFrame functions only: patterns plus a battery of randomness tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("assign", "access", "hex", "random")

# The patterns that the contract names.
ASSIGN_HEAD = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
ASSIGN_VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 or more in all: a run of these letters matches once or not at all
HEX = r"[0-9a-f]{32,}"

#: Candidates of the battery: maximal runs of 20 or more code symbols with a digit, and padding.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings in the order of inference, each with its alphabet.
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Chance that two symbols of written text are equal.
TEXT_COLLISION = 0.065
#: Share of false discoveries allowed in each length class, of tokens that are not written text and of
#: tokens that are not random.
FALSE_SHARE = 0.01
LENGTH_CLASSES, P_BINS, BINS_PER_NAT = 8, 600, 8
#: The same bins for the battery, whose p-values are not looked at below exp(-R_BINS / R_PER_NAT).
R_BINS, R_PER_NAT = 100, 4
#: Matches whose ends are summed together, see _matches.
BLOCK = 256


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str, gate: Column, keep=None) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches, in code points.

    ``\\G`` with a lazy gap makes every match carry the text before it, so ends are running sums. They are
    summed in blocks, then the blocks, so that very many matches of a text cost little more than each.
    """
    anchored = rf"\G((?s:.*?))({pattern})"
    sizes = F.transform(F.regexp_extract_all(text, F.lit(anchored), F.lit(0)), F.length)
    value = F.regexp_extract_all(text, F.lit(anchored), F.lit(2))

    def running(values: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("ends"))
        return F.aggregate(values, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + n)).alias("ends")), lambda acc: acc["ends"])

    def blocked(sizes: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
        return _let(F.transform(places, lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))), summed)

    def summed(blocks: Column) -> Column:
        totals = F.concat(F.array(F.lit(0)), running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda x, n: x + n)), F.lit(0)))
        return F.flatten(F.zip_with(blocks, F.slice(totals, F.lit(1), F.size(blocks)), lambda b, t: running(b, t)))

    ends = _let(sizes, lambda s: F.when(F.size(s) == 0, s).when(F.size(s) <= BLOCK, running(s, F.lit(0))).otherwise(blocked(s)))
    found = F.zip_with(ends, value, lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["value"]))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(gate, found).otherwise(none)


def _base(text: Column) -> Column:
    """array<struct<start,kind,end>> of the three pattern kinds, in order."""
    found = (
        _matches(
            text, ASSIGN_HEAD + ASSIGN_VALUE, text.rlike(ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]{8}"),
            lambda v: F.length(F.regexp_extract(v, rf"^{ASSIGN_HEAD}({ASSIGN_VALUE})$", 1)) >= 8,
        ),
        _matches(text, ACCESS, text.contains("AKIA"), lambda v: F.length(v) >= 16),
        _matches(text, HEX, text.rlike("[0-9a-f]{32}"), lambda v: F.length(v) >= 32),
    )
    return F.array_sort(F.concat(*(_tagged(m, k) for k, m in enumerate(found))))


def _tagged(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def normal_cdf(z: Column) -> Column:
    """Phi(z) by a logistic form that is within 0.0002 in the middle and exact enough in the tails."""
    def two(x: Column) -> Column:
        tail = F.exp(-x * x / 2) / (F.lit(math.sqrt(2 * math.pi)) * (F.lit(0.661) * F.abs(x) + F.lit(0.339) * F.sqrt(x * x + 5.51)))
        return F.when(x < 0, tail).otherwise(1 - tail)

    return _let(z, two)


def _battery(value: Column) -> Column:
    """struct<n, p, r> of a token.

    p: chance of so even an alphabet if the token were written or patterned text, from the sum of squared
    symbol counts. It falls with the length, so a short token cannot pass on little evidence. r: chance
    of so odd a token if it were random. It joins, by Fisher's method, three tests over the inferred
    encoding: chi-squared uniformity of its alphabet, runs above and below the middle of it, and lag-one
    serial correlation.
    """

    def alphabet(body: Column) -> Column:
        found: Column = F.lit(ENCODINGS[-1][1].replace("+/", "+/-_"))
        for _, letters in reversed(ENCODINGS[:-1]):
            found = F.when(body.rlike(f"^[{letters}]+$"), F.lit(letters)).otherwise(found)
        return found

    add = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def counted(body: Column) -> Column:
        return _let(alphabet(body), lambda letters: _let(F.transform(F.split(body, ""), lambda c: F.instr(letters, c).cast("double")), lambda values: figures(body, letters, values)))

    def figures(body: Column, letters: Column, values: Column) -> Column:
        k, n = F.least(F.length(letters), F.lit(64)).cast("double"), F.size(values).cast("double")
        each = lambda c: F.pow((F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2.0))
        squares = add(F.transform(F.array_distinct(F.split(body, "")), each))
        high = add(F.transform(values, lambda v: F.when(v > k / 2, 1.0).otherwise(0.0)))
        first, rest = F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1)
        runs = 1 + add(F.zip_with(first, rest, lambda a, b: F.when((a > k / 2) != (b > k / 2), 1.0).otherwise(0.0)))
        spread = lambda mean: add(F.transform(values, lambda v: (v - mean) * (v - mean)))
        lagged = lambda mean: add(F.zip_with(first, rest, lambda a, b: (a - mean) * (b - mean)))
        serial = _let(add(values) / n, lambda mean: _let(spread(mean), lambda s: F.when(s > 0, lagged(mean) / s * F.sqrt(n)).otherwise(F.lit(99.0))))
        return F.struct(k.alias("k"), n.alias("n"), squares.alias("squares"), high.alias("high"), runs.alias("runs"), serial.alias("serial"))

    def tested(f: Column) -> Column:
        n, k, high = f["n"], f["k"], f["high"]
        rate = F.greatest(F.lit(TEXT_COLLISION), 2 / k)
        z = (f["squares"] - n - n * (n - 1) * rate) / F.sqrt(2 * n * n * rate)
        # chi-squared against equal shares of the alphabet, to a normal by the cube root
        spare = 2 / (9 * (k - 1))
        chi_z = (F.cbrt(F.greatest(f["squares"] * k / n - n, F.lit(0.0)) / (k - 1)) - (1 - spare)) / F.sqrt(spare)
        expected = 2 * high * (n - high) / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        run_z = F.when(variance > 0, (f["runs"] - expected) / F.sqrt(variance)).otherwise(F.lit(99.0))
        tails = (1 - normal_cdf(chi_z), 2 * normal_cdf(-F.abs(run_z)), 2 * normal_cdf(-F.abs(f["serial"])))
        half = sum((-F.log(F.least(F.greatest(t, F.lit(1e-300)), F.lit(1.0))) for t in tails), F.lit(0.0))
        # half of Fisher's statistic is a sum of three exponentials: P(X > x) = e^-x (1 + x + x^2 / 2)
        return F.struct(n.cast("int").alias("n"), normal_cdf(z).alias("p"), _let(half, lambda x: F.exp(-x) * (1 + x + x * x / 2)).alias("r"))

    return _let(_let(F.regexp_replace(value, "=+$", ""), counted), tested)


def _candidates(text: Column) -> Column:
    """array<struct<start,end,test>>: tokens that the battery judges."""
    found = _matches(text, CANDIDATE, text.rlike(CANDIDATE))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _battery(m["value"]).alias("test")))


def _class_of(n: Column) -> Column:
    return F.least(F.floor(n / 16) - 1, F.lit(LENGTH_CLASSES - 1)).cast("int")


def _bin_of(p: Column, per_nat: int = BINS_PER_NAT, most: int = P_BINS) -> Column:
    return F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * per_nat), F.lit(most)).cast("int")


def _least_bin(counts: dict[int, int], per_nat: int, total: int) -> int | None:
    """Benjamini-Hochberg over binned p-values: the smallest bin of -ln p that is discovered."""
    seen, least = 0, None
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        if math.exp(-b / per_nat) <= FALSE_SHARE * seen / total:
            least = b
    return least


def discovery_bins(found: DataFrame) -> dict[int, tuple[int, int]]:
    """Length class -> (bin of p from which a token is no text, bin of r from which it is not random).

    False discoveries are controlled twice in each length class: first of tokens that are not random,
    among all; then of tokens that are not text, among the rest. ``found`` has a column ``candidates``.
    The counts are over all tokens of all documents; only a histogram of at most LENGTH_CLASSES x P_BINS
    x R_BINS cells is gathered.
    """
    tests = found.select(F.explode("candidates").alias("c")).select(
        _class_of(F.col("c.test.n")).alias("length"), _bin_of(F.col("c.test.p")).alias("p"), _bin_of(F.col("c.test.r"), R_PER_NAT, R_BINS).alias("r")
    )
    cells: dict[int, list[tuple[int, int, int]]] = {}
    for row in tests.groupBy("length", "p", "r").count().collect():
        cells.setdefault(row["length"], []).append((row["p"], row["r"], row["count"]))
    least = {}
    for length, counts in cells.items():
        odd: dict[int, int] = {}
        for _, r, n in counts:
            odd[r] = odd.get(r, 0) + n
        bar = _least_bin(odd, R_PER_NAT, sum(odd.values()))
        bar = R_BINS + 1 if bar is None else bar
        even: dict[int, int] = {}
        for p, r, n in counts:
            if r < bar:
                even[p] = even.get(p, 0) + n
        if even and (text := _least_bin(even, BINS_PER_NAT, sum(even.values()))) is not None:
            least[length] = (text, bar)
    return least


def _spans(least: dict[int, tuple[int, int]]) -> Column:
    """All spans from columns ``base`` and ``candidates``: base spans, and random tokens clear of them."""

    def discovered(c: Column) -> Column:
        text, odd = F.lit(P_BINS + 1), F.lit(0)
        for length, (p, r) in sorted(least.items()):
            here = _class_of(c["test"]["n"]) == length
            text, odd = F.when(here, F.lit(p)).otherwise(text), F.when(here, F.lit(r)).otherwise(odd)
        return (_bin_of(c["test"]["p"]) >= text) & (_bin_of(c["test"]["r"], R_PER_NAT, R_BINS) < odd)

    clear = lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    extra = F.filter("candidates", lambda c: discovered(c) & clear(c))
    return F.array_sort(F.concat("base", _tagged(extra, KINDS.index("random"))))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans): one row per row of ``docs``.

    Null and empty texts have no spans (the digest of the empty string). Repeated rows give repeated
    results; other columns are ignored. Texts are read once and not shuffled: what later steps need
    are the spans, written to the shared folder.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    found = cut(rows.select("doc_id", _base(F.col("text")).alias("base"), _candidates(F.col("text")).alias("candidates")), "spans")
    least = discovery_bins(found)
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    return found.withColumn("all", _spans(least)).select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans")
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", count_col: str | None = "n_chars") -> DataFrame:
    """The documents with every span of :func:`scan` replaced by ``mark``, and their columns.

    Two passes over the texts, the first for the discovery thresholds; no shuffle and no join by id.
    A null text stays null; ``count_col``, where it exists, gets the new length of changed texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # clashes with our own columns are impossible
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    here = F.coalesce(F.col(names[text_col]), F.lit(""))
    found = rows.select("*", _base(here).alias("base"), _candidates(here).alias("candidates"))
    least = discovery_bins(docs.select(_candidates(text).alias("candidates")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substr(here, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("all", start, step, lambda acc: F.concat(acc["out"], F.substr(here, acc["at"] + 1)))
    done = found.withColumn("all", _spans(least)).withColumn("clean", F.when(F.size("all") > 0, clean))
    out = []
    for c, n in names.items():
        col = F.col(n)
        if c == text_col:
            col = F.coalesce(F.col("clean"), col)
        elif c == count_col:
            col = F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema[c].dataType)).otherwise(col)
        out.append(col.alias(c))
    return done.select(*out)
