"""Secret scans: fixed patterns, and a battery of randomness tests.

Besides three base patterns, every maximal run of at least MIN_RUN characters of
base-64 alphabets is a candidate.  Its encoding is inferred from its characters, and
three tests ask whether it may be uniform over that alphabet: chi-squared for the
counts, Wald and Wolfowitz' runs about the middle, and the serial correlation of
neighbours.  A candidate that a test rejects is no secret.  For the others there are
two pieces of evidence against ordinary text: the lower tail of the same chi-squared
under letters that coincide as often as in text, and the upper tail of the number
of neighbours of different kinds (upper case, lower case, digit, other), which is low
in words, names and paths and high in random characters of several kinds.  Their
p-values are combined by Fisher's rule; the evidence grows with the length.
Candidates of an encoding and a length class form a stratum, in which Benjamini and
Hochberg's rule over all documents bounds the share of false discoveries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastrum.llm.common import LOWER, UPPER, let, sums_before, written

#: The base patterns, and what a match of each needs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
RUN = f"[A-Za-z0-9+/_-]{{{MIN_RUN},}}"
#: A gate closes at this many standard deviations.
GATE = 3.7
#: Share of false discoveries among those of a stratum.
FDR = 0.01
#: Chance that neighbours in a run of text are of different kinds: a change every eight characters.
CHANGES = 0.125
#: Frequencies of a to z in ordinary English text, in per mille.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: p-values are ranked by -BINS_PER_DIGIT * log10(p), at most MAX_BIN.
BINS_PER_DIGIT, MAX_BIN = 4, 400
#: Private-use characters that no pattern matches: marks, and what stands for marks in texts.
MARK, STAND_IN = "", ""

#: Encodings as (what all characters are, alphabet in order); the first that fits is inferred.
DIGITS = "0123456789"
ENCODINGS = (
    ("[0-9]+", DIGITS),
    ("[0-9a-f]+|[0-9A-F]+", DIGITS + "abcdef"),
    ("[a-z]+|[A-Z]+", LOWER),
    ("[A-Z2-7]+", UPPER + "234567"),
    ("[a-z0-9]+|[A-Z0-9]+", DIGITS + LOWER),
    ("[A-Za-z]+", UPPER + LOWER),
    ("[A-Za-z0-9]+", DIGITS + UPPER + LOWER),
    ("[^-_]+|[^+/]+", DIGITS + UPPER + LOWER + "+/"),
    (".*", DIGITS + UPPER + LOWER + "+/-_"),
)
CASELESS = (1, 2, 4)
#: Encodings of characters of one kind, where no change says anything.
ONE_KIND = (0, 2)


def coincidence(alphabet: str, of: int) -> float:
    """Chance that `of` characters of text in this alphabet are the same: by the letters' frequencies among those it has, or even digits."""
    shares = [f for c, f in zip(LOWER, LETTERS, strict=True) if c in alphabet.lower()] or [1] * len(alphabet)
    return sum((f / sum(shares)) ** of for f in shares)


def pieces(text: Column, pattern: str) -> Column:
    """The text cut before and after each match: others at even places, matches at odd ones."""
    return F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), pattern, f"{MARK}$0{MARK}"), MARK)


def spans(text: Column, pattern: str, passes) -> Column:
    """array<struct<start, end, match>> of the matches that pass."""

    def found(p: Column) -> Column:
        starts = sums_before(F.transform(p, lambda x: F.length(x)))
        placed = let(starts, lambda s: F.transform(p, lambda x, k: F.when((k % 2 == 1) & passes(x), F.struct(F.get(s, k).alias("start"), (F.get(s, k) + F.length(x)).alias("end"), x.alias("match")))))
        return F.filter(placed, lambda x: x.isNotNull())

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return let(pieces(text, pattern), lambda p: F.when(F.size(p) > 1, found(p)).otherwise(none))


PASSES = {
    "assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8,
    "access": lambda m: F.length(m) >= 16,
    "hex": lambda m: F.length(m) >= 32,
}
#: Runs of hex digits are asked for with their least length at once: leftmost greedy runs are whole runs either way, and short ones are in every word.
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX.replace("+", "{32,}")}


def encoding(m: Column) -> Column:
    return reduce(lambda rest, k: F.when(m.rlike(f"^({ENCODINGS[k][0]})$"), F.lit(k)).otherwise(rest), range(len(ENCODINGS) - 2, -1, -1), F.lit(len(ENCODINGS) - 1))


def pick(enc: Column, values: list) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), enc)


def upper_tail(x: Column) -> Column:
    """log10 of the normal distribution's upper tail for x >= 0, to a few hundredths."""
    return (-x * x / 2 - F.log(1.64 * x + F.sqrt(0.76 * x * x + 4))) / 2.302585092994046


def rank_bin(m: Column) -> Column:
    """The candidate's bin of -log10(p), 0 where a gate closes; a row of struct<enc, size, bin>."""

    def judged(enc: Column) -> Column:
        plain = F.when(enc.isin(*CASELESS), F.lower(m)).otherwise(m)
        k, n = pick(enc, [float(len(a)) for _, a in ENCODINGS]), F.length(m).cast("double")
        chars = F.filter(F.split(plain, ""), lambda c: c != "")
        values = F.transform(chars, lambda c: F.instr(pick(enc, [a for _, a in ENCODINGS]), c).cast("double") - 1)
        square = let(plain, lambda s: F.aggregate(F.transform(F.array_distinct(F.split(s, "")), lambda c: F.when(c == "", F.lit(0.0)).otherwise(F.pow(F.length(s) - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))), F.lit(0.0), lambda a, b: a + b))
        chi2 = k / n * square - n
        two, three = (pick(enc, [coincidence(a, of) for _, a in ENCODINGS]) for of in (2, 3))
        text_mean = k + k * (n - 1) * two - n
        text_sd = k / n * F.sqrt(2 * n * (n - 1) * two + 4 * n * (n - 1) * (n - 2) * F.greatest(three - two * two, F.lit(0.0)))
        df = k - 1
        uniform_z = (F.cbrt(F.greatest(chi2, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        text_z = (text_mean - chi2) / text_sd

        def orders(v: Column) -> Column:
            middle = (k - 1) / 2
            pairs = F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.struct(F.get(v, i - 1).alias("a"), F.get(v, i).alias("b")))
            mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
            above = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(x > middle, 1.0).otherwise(0.0))
            runs = F.aggregate(pairs, F.lit(1.0), lambda s, p: s + F.when((p["a"] > middle) != (p["b"] > middle), 1.0).otherwise(0.0))
            expected = 2 * above * (n - above) / n + 1
            runs_z = (runs - expected) / F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
            about = let(mean, lambda mu: F.struct(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - mu) * (p["b"] - mu)).alias("lag"), F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mu) * (x - mu)).alias("all")))
            serial_z = let(about, lambda a: (a["lag"] / F.greatest(a["all"], F.lit(1e-9)) + 1 / n) * F.sqrt(n))
            return (F.abs(runs_z) <= GATE) & (F.abs(serial_z) <= GATE)

        kinds = F.translate(m, UPPER + LOWER + DIGITS + "+/-_", "A" * 26 + "a" * 26 + "0" * 10 + "++++")
        same = F.length(F.regexp_replace(kinds, "A+|a+|0+|[+]+", "~"))  # a character per stretch of a kind
        change_z = (same - 1 - 0.5 - CHANGES * (n - 1)) / F.sqrt(CHANGES * (1 - CHANGES) * (n - 1))
        tail = lambda z: let(z, lambda x: F.when(x <= 0, F.lit(0.0)).otherwise(-upper_tail(x)))
        single = enc.isin(*ONE_KIND)
        both = let(tail(text_z) + tail(change_z), lambda d: F.greatest(F.lit(0.0), d - F.log10(1 + 2.302585092994046 * d)))
        digits = F.when(single, tail(text_z)).otherwise(both)
        random = (uniform_z <= GATE) & let(values, orders)
        bin_no = F.when(random, F.least(F.floor(BINS_PER_DIGIT * digits), F.lit(MAX_BIN))).otherwise(0).cast("int")
        return F.struct(enc.alias("enc"), F.floor(2 * F.log2(n)).cast("int").alias("size"), bin_no.alias("bin"))

    return let(encoding(m), judged)


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column per base kind and candidates (array<struct<start, end, test>>); null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = lambda s: F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    base = {f"_rs_{k}": bare(spans(text, p, PASSES[k])) for k, p in PATTERNS.items()}
    tested = F.transform(spans(text, RUN, lambda m: F.lit(True)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), rank_bin(x["match"]).alias("test")))
    return docs.withColumns(base | {"_rs_candidates": tested})


def least_bins(tests: DataFrame, fdr: float = FDR) -> dict[tuple[int, int], int]:
    """Per stratum (encoding, length class) the least bin that counts as a discovery.

    tests has a column test; only counts per stratum and bin reach the driver, of
    which there are at most 9 encodings x 64 length classes.
    """
    counts = tests.groupBy("test.enc", "test.size", "test.bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy("enc", "size")
    ranked = counts.select("enc", "size", "bin", F.sum("c").over(w).alias("all"), F.sum("c").over(w.orderBy(F.desc("bin"))).alias("least"))
    found = ranked.where((F.col("bin") > 0) & (F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DIGIT) <= fdr * F.col("least")))
    return {(r["enc"], r["size"]): r["b"] for r in found.groupBy("enc", "size").agg(F.min("bin").alias("b")).collect()}


def discovered(test: Column, least: dict[tuple[int, int], int]) -> Column:
    if not least:
        return F.lit(False)
    table = F.create_map(*(F.lit(x) for (e, s), b in sorted(least.items()) for x in (e * 100 + s, b)))
    return F.coalesce(test["bin"] >= F.element_at(table, test["enc"] * 100 + test["size"]), F.lit(False))


def judged(found: DataFrame) -> Column:
    """The spans of a written table of scanned rows: array<struct<start, kind_no, end>> by start and then kind."""
    least = least_bins(found.select(F.explode("_rs_candidates.test").alias("test")))
    tagged = lambda col, no: F.transform(col, lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), x["end"].alias("end")))
    random = F.filter("_rs_candidates", lambda x: discovered(x["test"], least))
    every = [tagged(F.col(f"_rs_{k}"), i) for i, k in enumerate(KINDS[:3])] + [tagged(random, 3)]
    return F.array_sort(F.concat(*every))


def scan_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col and spans, array<struct<start, kind_no, end>> by start and then kind (see KINDS), in code points.

    Base spans are those of the fixed patterns; the method adds those of kind
    random, which may overlap base ones.  Texts are scanned once; their spans are
    written to the shared folder before candidates are judged over all documents.
    Null and empty texts have no span; very long ones are scanned whole; rows that
    repeat, or have no id, are scanned each and count each among the candidates; other
    columns are not looked at; an empty table gives an empty one.
    """
    found = written(scanned(docs.select(id_col, F.col(text_col).alias("_rs_text")), "_rs_text").drop("_rs_text"))
    return found.select(id_col, judged(found).alias("spans"))


def span_text(s: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def covered(spans: Column) -> Column:
    """array<struct<start, end>>: the spans with those that overlap or touch made one, in order."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(out: Column, x: Column) -> Column:
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"))
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(F.size(out) == 0, F.array(own)).when(x["start"] <= last["end"], joined).otherwise(F.concat(out, F.array(own)))

    apart = lambda s: F.forall(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i - 1)["end"] < F.get(s, i)["start"], F.lit(True)))
    bare = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return let(spans, lambda s: F.when(F.size(s) == 0, empty).when(apart(s), F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))).otherwise(F.aggregate(bare, empty, add)))


def redact(docs: DataFrame, text_col: str = "text", placeholder: str = "[SECRET]") -> DataFrame:
    """docs with the placeholder instead of each secret that ``scan_report`` finds; every row stays, with all its columns.

    Spans that overlap or touch give way to one placeholder.  Null texts stay null,
    texts without a secret as they are; an empty table gives an empty one.  Rows are
    written once with their spans.
    """
    own = docs.select(F.struct("*").alias("_rs_row"), F.col(text_col).alias("_rs_text"))
    found = written(scanned(own, "_rs_text"))

    def cut_out(spans: Column, text: Column) -> Column:
        before = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: let(F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), lambda a: F.substring(text, a + 1, F.coalesce(F.get(spans, i)["start"], F.length(text)) - a)))
        return F.array_join(before, placeholder)

    clean = let(judged(found), lambda s: F.when(F.size(s) == 0, F.col("_rs_text")).otherwise(let(covered(s), lambda c: cut_out(c, F.col("_rs_text")))))
    rows = found.select("_rs_row", clean.alias("_rs_clean"))
    return rows.select(*(F.col("_rs_clean").alias(c) if c == text_col else F.col(f"_rs_row.`{c}`").alias(c) for c in docs.columns))
