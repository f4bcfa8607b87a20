"""Secret scan (DataFrame operations only).

Base patterns give spans of three kinds. Beside them a randomness test battery looks at every other long token:

1. candidates are maximal runs of 20 or more base64/URL-safe characters outside the base spans;
2. each candidate's encoding (decimal, hex, base32, base36, base62, base64) is inferred from the characters it uses;
3. under the hypothesis "drawn evenly from that alphabet", a chi-squared test of the character counts, a runs test about
   the alphabet's middle and a lag-one serial correlation give three p-values, of which three times the least is kept;
4. under the hypothesis "ordinary", that is, a word, name, path or number, whose digits, vowels, frequent and rare consonants
   and capitals are shared out as in written words, the likelihood ratio of the two hypotheses gives another p-value. Its
   spread is widened by `WIDER`, as characters of words hang together;
5. Benjamini-Hochberg control in strata of encoding and length (powers of two) over the whole corpus is applied to both: a
   candidate is reported as kind `random` if "ordinary" is rejected at `fdr`, which bounds false reports, and "drawn evenly" is
   not, at `battery_fdr`, which bounds the loss of random tokens. Short tokens are judged against short ones.

A number by itself is ordinary by hypothesis. Ranks come from histograms of p-values in
twentieths of a decade (rounded up, so the control is conservative): strata times bins is a constant, whatever the corpus.

Defined results: null and empty texts have no span; rows that repeat a doc_id are each returned; an empty table gives an
empty result; other columns are ignored. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from functools import reduce
from math import log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, prefix_sums

# The base patterns and their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SPAN = "array<struct<start:bigint,kind:int,end:bigint,size:bigint,token:string>>"
P_BINS, P_STEP, WIDER = 200, 20, 1.5
# Classes of characters, and their shares in words and names of Latin script (v, c, r: vowels, frequent and rare consonants; d: digits; u: capitals among small letters; s: signs).
CLASSES = ("v", "aeiou"), ("c", "cdhlmnrst"), ("r", "bfgjkpqvwxyz"), ("d", "0123456789"), ("u", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("s", "+/")
SHARES = {"v": 0.32, "c": 0.38, "r": 0.15, "d": 0.045, "u": 0.1, "s": 0.005}


def _spans(text: Column, pattern: str, kind: int, found: Column, size: Column) -> Column:
    """Spans of the leftmost matches `found`, with their positions from the gaps between them."""

    def placed(gaps: Column) -> Column:
        ahead = prefix_sums(F.zip_with(found, gaps, lambda m, g: (F.length(g) + F.length(m)).cast("bigint")))
        starts = F.zip_with(ahead, gaps, lambda at, g: (at + F.length(g)).cast("bigint"))
        ended = F.zip_with(starts, found, lambda at, m: F.struct(at.alias("start"), m.alias("token")))
        return F.zip_with(
            ended, size,
            lambda p, s: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), (p["start"] + F.length(p["token"])).cast("bigint").alias("end"), F.length(s).cast("bigint").alias("size"), p["token"].alias("token")),
        )

    return F.when(F.size(found) > 0, let(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), placed)).otherwise(F.array().cast(SPAN))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z (logistic approximation, error below 2e-4)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z, F.lit(700.0))))


# Alphabets in the order in which they are tried.
ALPHABETS = (
    ("decimal", r"^[0-9_-]+$", "0123456789"),
    ("hex", r"^(?:[0-9a-f_-]+|[0-9A-F_-]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^(?:[0-9a-z_-]+|[0-9A-Z_-]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[0-9A-Za-z_-]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r".", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"),
)


def _battery(token: Column) -> Column:
    """Encoding (its place among ALPHABETS), length, alphabet's size and character codes of one token, and the token in one case where one stands for both."""
    which, alphabet = F.lit(len(ALPHABETS) - 1), F.lit(ALPHABETS[-1][2])
    for i, (_, pattern, chars) in reversed(list(enumerate(ALPHABETS))):
        hit = token.rlike(pattern)
        which = F.when(hit, F.lit(i)).otherwise(which)
        alphabet = F.when(hit, F.lit(chars)).otherwise(alphabet)

    def coded(t: Column) -> Column:
        codes = F.transform(F.split(t["folded"], ""), lambda c: (F.instr(t["alphabet"], c) - 1).cast("double"))
        return F.struct(t["which"].alias("which"), F.length(t["folded"]).cast("double").alias("n"), F.length(t["alphabet"]).cast("double").alias("k"), codes.alias("codes"), F.when(t["which"] == 2, F.lower(t["folded"])).otherwise(t["folded"]).alias("folded"))

    def folded(t: Column) -> Column:
        letters = F.regexp_replace(t["token"], r"[_-]", "")
        return let(F.struct(t["which"].alias("which"), t["alphabet"].alias("alphabet"), F.when(t["which"].isin(1, 3), F.lower(letters)).otherwise(letters).alias("folded")), coded)

    return let(F.struct(token.alias("token"), which.alias("which"), alphabet.alias("alphabet")), folded)


def _tests(b: Column) -> Column:
    n, k, codes = b["n"], b["k"], b["codes"]
    zero = F.lit(0.0)
    total = lambda a: F.aggregate(a, zero, lambda acc, x: acc + x)
    squares = total(F.transform(F.array_distinct(codes), lambda c: F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), 2)))
    chi = k / n * squares - n
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    high = F.transform(codes, lambda c: (c >= k / 2).cast("double"))
    ups = total(high)
    downs = n - ups
    runs = F.lit(1.0) + total(F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high)), lambda a, c: F.when(c.isNotNull() & (a != c), 1.0).otherwise(0.0)))
    expected = 2 * ups * downs / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    z_runs = F.abs(runs - expected) / spread
    mean = total(codes) / n
    variance = F.greatest(let(mean, lambda mu: total(F.transform(codes, lambda c: (c - mu) * (c - mu)))), F.lit(1e-9))
    lagged = let(mean, lambda mu: total(F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, c: F.coalesce((a - mu) * (c - mu), zero))))
    z_serial = F.abs(lagged / variance + 1 / n) * F.sqrt(n)
    p = F.least(F.lit(1.0), 3 * F.least(_upper_tail(z_chi), 2 * _upper_tail(z_runs), 2 * _upper_tail(z_serial)))
    p = F.when(F.size(F.array_distinct(codes)) < 6, F.lit(0.0)).otherwise(p)
    return _bin(p)


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-12))) * P_STEP), F.lit(P_BINS)).cast("int")


def _ordinary(b: Column) -> Column:
    """Bin of the p-value under "ordinary": the likelihood ratio of the token's classes against its mean and spread there."""
    marked = F.translate(b["folded"], "".join(c for _, cs in CLASSES for c in cs), "".join(k * len(cs) for k, cs in CLASSES))
    count = {k: (F.length(marked) - F.length(F.replace(marked, F.lit(k), F.lit("")))).cast("double") for k, _ in CLASSES}
    out = F.lit(0)
    for i, (name, _, chars) in enumerate(ALPHABETS):
        if name == "decimal":
            continue
        # one case stands for both where the encoding has only one
        small = chars.lower() if name in ("hex", "base32", "base36") else chars
        even = {k: sum(c in cs for c in small) / len(small) for k, cs in CLASSES}
        held = [k for k, n in even.items() if n]
        whole = sum(SHARES[k] for k in held)
        ratio = {k: log(even[k] * whole / SHARES[k]) for k in held}
        mean = sum(SHARES[k] / whole * ratio[k] for k in held)
        spread = sqrt(sum(SHARES[k] / whole * ratio[k] ** 2 for k in held) - mean * mean) * WIDER
        total = reduce(lambda a, c: a + c, (count[k] * F.lit(ratio[k]) for k in held))
        out = F.when(b["which"] == i, _bin(_upper_tail((total - b["n"] * F.lit(mean)) / (F.sqrt(b["n"]) * F.lit(spread))))).otherwise(out)
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05, battery_fdr: float = 0.05) -> DataFrame:
    """One row per row of `docs`: doc_id, base (array of spans of the base patterns), added (array of spans of the battery)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    # plain substring tests spare most texts the dearer patterns
    small = F.lower("t")
    assigned = reduce(lambda a, b: a | b, (small.contains(w) for w in WORDS))
    access = F.col("t").contains("AKIA")
    matches = lambda test, pattern, group: F.when(test, F.regexp_extract_all("t", F.lit(pattern), group)).otherwise(F.array().cast("array<string>"))
    step = step.select("doc_id", "t", assigned.alias("assigned"), access.alias("access"))
    step = step.select(
        "doc_id", "t",
        matches(F.col("assigned"), ASSIGN, 0).alias("a"), matches(F.col("assigned"), ASSIGN, 2).alias("a2"),
        matches(F.col("access"), ACCESS, 0).alias("k"), F.regexp_extract_all("t", F.lit(HEX), 0).alias("h"), F.regexp_extract_all("t", F.lit(CANDIDATE), 0).alias("c"),
    )
    step = step.select(
        "doc_id",
        F.concat(F.filter(_spans(F.col("t"), ASSIGN, 0, F.col("a"), F.col("a2")), lambda s: s["size"] >= 6), _spans(F.col("t"), ACCESS, 1, F.col("k"), F.col("k")), _spans(F.col("t"), HEX, 2, F.col("h"), F.col("h"))).alias("base"),
        _spans(F.col("t"), CANDIDATE, 3, F.col("c"), F.col("c")).alias("c"),
    )
    step = step.withColumn("c", let(F.col("base"), lambda base: F.filter("c", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))))
    step = step.withColumn("c", F.transform("c", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _battery(s["token"]).alias("b"))))
    # a run of separators alone has no characters to test
    step = step.withColumn("c", F.filter("c", lambda s: s["b"]["n"] > 1))
    step = step.withColumn("c", F.transform("c", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (s["b"]["which"] * 100 + F.floor(F.log2(s["b"]["n"]))).cast("int").alias("stratum"), _tests(s["b"]).alias("pbin"), _ordinary(s["b"]).alias("obin"))))

    counts = step.where(F.size("c") > 0).select(F.explode("c").alias("s")).groupBy("s.stratum", "s.pbin", "s.obin").agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select("stratum", "n", F.explode(F.array(F.struct(F.lit("even").alias("side"), F.col("pbin").alias("bin")), F.struct(F.lit("ordinary").alias("side"), F.col("obin").alias("bin")))).alias("b"))
    bins = sides.groupBy("stratum", "b.side", "b.bin").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("stratum", "side").orderBy(F.col("bin").desc())
    ranked = bins.withColumn("at_least", F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy("stratum", "side")))
    level = F.when(F.col("side") == "even", F.lit(battery_fdr)).otherwise(F.lit(fdr))
    cut = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / P_STEP) <= level * F.col("at_least") / F.col("all")).groupBy("stratum", "side").agg(F.min("bin").alias("cut"))
    cuts = cut.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "side", "stratum").alias("k"), F.col("cut")))).alias("cuts")).scalar()
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    at = lambda side, s: F.coalesce(F.try_element_at("cuts", F.concat_ws(":", F.lit(side), s["stratum"].cast("string"))), F.lit(P_BINS + 1))
    found = F.filter("c", lambda s: (s["pbin"] < at("even", s)) & (s["obin"] >= at("ordinary", s)))
    kept = step.withColumn("cuts", F.when(F.size("c") > 0, cuts)).withColumn(
        "added", F.when(F.size("c") > 0, F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))).otherwise(empty)
    )
    return kept.select("doc_id", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"), "added")


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_digest(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_random"),
    )
