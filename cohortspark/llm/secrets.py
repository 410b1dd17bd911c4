"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Everything on the main path is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table, text_or_empty, written

#: Kinds in the order in which they are listed, with their patterns and the group and length a match needs.
#: The patterns are the query's contract.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
RANDOM = "random"
#: Tokens that the battery tests.
MIN_TOKEN = 20
#: Their alphabets: signs that an alphabet does not hold separate tokens, '=' only pads the end.
TOKENS = tuple(
    f"[{letters}]{{{MIN_TOKEN},}}(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?" for letters in ("A-Za-z0-9", "A-Za-z0-9+/", "A-Za-z0-9_-")
)
#: Encodings by their alphabets, the first that holds a whole token is inferred.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    (_DIGITS, r"^[0-9]+$"),
    (_DIGITS + "abcdef", r"^[0-9a-f]+$"),
    (_DIGITS + "ABCDEF", r"^[0-9A-F]+$"),
    (_UPPER + "234567", r"^[A-Z2-7]+$"),
    (_UPPER + _LOWER + _DIGITS, r"^[A-Za-z0-9]+$"),
    (_UPPER + _LOWER + _DIGITS + "+/", r"^[A-Za-z0-9+/]+$"),
    (_UPPER + _LOWER + _DIGITS + "-_", r"^[A-Za-z0-9_-]+$"),
)
#: Lower ends of the length bands, the p-values tried as thresholds, and the false-discovery rate allowed.
BANDS = (20, 24, 32, 40, 64)
P_GRID = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5)
FDR = 0.1
#: Share of pieces of ordinary prose (letters and digits of texts in four languages) with a p-value of at least each of
#: ``P_GRID``, per band: what the decoys are taken to be where a table has few. It counts as so many decoys.
PROSE = (
    (0.17, 0.13, 0.09, 0.07, 0.045, 0.022, 0.012, 0.005, 0.0012),
    (0.05, 0.037, 0.023, 0.016, 0.0095, 0.0045, 0.0024, 0.001, 0.0004),
    (0.0055, 0.004, 0.0026, 0.0017, 0.001, 0.0006, 0.0003, 0.0002, 0.0001),
    (0.0011, 0.0008, 0.0005, 0.0003, 0.0002, 0.0001, 0.0001, 0.0001, 0.0001),
    (0.0011, 0.0008, 0.0005, 0.0003, 0.0002, 0.0001, 0.0001, 0.0001, 0.0001),
)
PROSE_DECOYS = 1000


def _spans(text: Column, pattern: str, group: int = 0, at_least: int = 1) -> Column:
    """array<struct<s,e>> of the matches, in code points, e exclusive.

    Between the matches lie the parts that ``split`` gives, so their lengths add up to positions.
    """
    gaps = F.split(text, pattern, -1)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    parts = [F.transform(gaps, lambda g: F.length(g)).alias("g"), whole.alias("m")]
    if group:
        parts.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)).alias("n"))
    lengths = F.arrays_zip(*parts)
    empty = F.array().cast("array<struct<s:int,e:int>>")
    walked = F.aggregate(
        F.slice(lengths, F.lit(1), F.size(lengths) - 1),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["m"]).alias("at"),
            F.when(
                x["n" if group else "m"] >= at_least,
                F.concat(
                    acc["out"],
                    F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["m"]).alias("e"))),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )["out"]
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is evaluated once however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _upper_normal(z: Column) -> Column:
    """P(Z > z) for z >= 0 by a polynomial in 1 / (1 + 0.2316419 z); off by less than 1e-7."""

    def poly(t: Column) -> Column:
        return t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))

    return _let(z, lambda z: F.exp(-z * z / 2) / 2.5066282746310002 * _let(1 / (1 + 0.2316419 * z), poly))


def _one_sided(z: Column) -> Column:
    return _let(z, lambda z: _let(_upper_normal(F.abs(z)), lambda p: F.when(z >= 0, p).otherwise(1 - p)))


def _two_sided(z: Column) -> Column:
    return 2 * _upper_normal(F.abs(z))


def randomness(token: Column) -> Column:
    """p-value of "uniform and independent over the inferred alphabet"; null where no encoding fits.

    Chi-squared uniformity, runs about the middle of the alphabet, and lag-1 serial correlation;
    the three p-values are combined by Fisher's method (six degrees of freedom, closed form).
    What is used several times is bound once: written out, the plan would hold it as often.
    """

    def alphabet(bare: Column) -> Column:
        found = F.when(F.length(bare) < MIN_TOKEN, F.lit(None).cast("string"))
        for letters, shape in ENCODINGS:
            found = found.when(bare.rlike(shape), letters)
        return found

    def battery(x: Column) -> Column:
        counted = F.aggregate(  # sorted values: sum of squared counts = sum over values of (2 * run - 1)
            F.array_sort(x["v"]),
            F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("sq")),
            lambda a, v: F.struct(
                v.alias("last"),
                F.when(v == a["last"], a["run"] + 1).otherwise(1).alias("run"),
                (a["sq"] + F.when(v == a["last"], 2 * a["run"] + 1).otherwise(1)).alias("sq"),
            ),
        )["sq"].cast("double")
        moved = F.aggregate(
            x["v"],
            F.struct(
                F.lit(-1).alias("last"), F.lit(0).alias("runs"), F.lit(0).alias("high"),
                F.lit(0.0).alias("sum"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("lag"),
            ),
            lambda a, v: F.struct(
                v.alias("last"),
                (a["runs"] + F.when((a["last"] < 0) | ((a["last"] * 2 >= x["k"]) != (v * 2 >= x["k"])), 1).otherwise(0)).alias("runs"),
                (a["high"] + F.when(v * 2 >= x["k"], 1).otherwise(0)).alias("high"),
                (a["sum"] + v).alias("sum"),
                (a["sq"] + v * v).alias("sq"),
                (a["lag"] + F.when(a["last"] < 0, 0).otherwise(a["last"] * v)).alias("lag"),
            ),
        )

        def known(m: Column) -> Column:
            n, high = F.size(x["v"]).cast("double"), m["high"].cast("double")
            return F.struct(n.alias("n"), x["k"].cast("double").alias("k"), counted.alias("counted"), high.alias("high"), m.alias("m"))

        def moments(y: Column) -> Column:
            n, m, df = y["n"], y["m"], y["k"] - 1
            third = F.pow(F.greatest(y["counted"] * y["k"] / n - n, F.lit(0.0)) / df, F.lit(1 / 3))
            mean = m["sum"] / n
            return F.struct(
                n.alias("n"), m.alias("m"), ((third - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))).alias("z_chi"),
                (2 * y["high"] * (n - m["high"])).alias("both"), mean.alias("mean"), (m["sq"] / n - mean * mean).alias("variance"),
            )

        def tests(y: Column) -> Column:
            n, m, both, mean, variance = (y[c] for c in ("n", "m", "both", "mean", "variance"))
            expected, spread = both / n + 1, both * (both - n) / (n * n * (n - 1))
            p_runs = _let(spread, lambda s: F.when(s > 0, _two_sided((m["runs"] - expected) / F.sqrt(s))).otherwise(0.0))
            first, last = F.element_at(x["v"], 1), F.element_at(x["v"], -1)
            lagged = m["lag"] - mean * (2 * m["sum"] - first - last) + (n - 1) * mean * mean
            z_lag = (lagged / (n * variance) + 1 / n) * F.sqrt(n)
            p_lag = F.when(variance > 0, _two_sided(z_lag)).otherwise(0.0)
            tiny = F.lit(1e-300)
            half = -(F.log(F.greatest(_one_sided(y["z_chi"]), tiny)) + F.log(F.greatest(p_runs, tiny)) + F.log(F.greatest(p_lag, tiny)))
            return _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

        return _let(_let(_let(moved, known), moments), tests)

    def coded(x: Column) -> Column:
        letters = F.filter(F.split(x["b"], ""), lambda c: c != "")
        return F.struct(F.transform(letters, lambda c: F.instr(x["a"], c) - 1).alias("v"), F.length(x["a"]).alias("k"))

    bare = F.rtrim(F.replace(token, F.lit("="), F.lit(" ")))  # padding carries no information
    read = _let(bare, lambda b: F.struct(b.alias("b"), alphabet(b).alias("a")))
    return _let(read, lambda x: F.when(x["a"].isNotNull(), _let(coded(x), battery)))


def _candidates(text: Column) -> Column:
    """array<struct<s,e,p,decoy>>: each long token with its p-value, and that of a decoy.

    A run of letters, digits and signs is tested in each of its readings: whole where one alphabet
    holds it, and the parts between '/' and '+', between '-' and '_', and between any sign.

    The decoy is ordinary text of the same length from around the token: what stands after it (or
    before it, near the end) without anything but letters and digits. Tokens of letters alone, of
    one case or with a capital first, are words and no candidates.
    """

    def after(x: Column) -> Column:
        n = x["e"] - x["s"]
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), n.alias("n"), F.substring(text, x["s"] + 1, n).alias("token"),
            F.regexp_replace(F.substring(text, x["e"] + 1, n * 2), "[^A-Za-z0-9]", "").alias("after"),
        )

    def near(x: Column) -> Column:
        before = F.regexp_replace(F.substring(text, F.greatest(x["s"] + 1 - x["n"] * 2, F.lit(1)), F.least(x["n"] * 2, x["s"])), "[^A-Za-z0-9]", "")
        found = F.when(F.length(x["after"]) >= x["n"], x["after"]).otherwise(before)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["n"].alias("n"), x["token"].alias("token"), found.alias("near"))

    def tested(x: Column) -> Column:
        return F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            F.when(~x["token"].rlike("^([A-Z]?[a-z]+|[A-Z]+)$"), randomness(x["token"])).alias("p"),
            F.when(F.length(x["near"]) >= x["n"], randomness(F.substring(x["near"], F.lit(1), x["n"]))).alias("decoy"),
        )

    spans = F.array_distinct(F.concat(*[_spans(text, t) for t in TOKENS]))
    return F.transform(F.transform(F.transform(spans, after), near), tested)


def _merged(spans: Column) -> Column:
    """array<struct<s,e>>: spans that overlap become one."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def closed(a: Column) -> Column:
        return F.when(a["e"] < 0, a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))))

    return F.aggregate(
        F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))),
        F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), empty.alias("out")),
        lambda a, x: F.struct(
            F.when(x["s"] < a["e"], a["s"]).otherwise(x["s"]).alias("s"),
            F.when(x["s"] < a["e"], F.greatest(a["e"], x["e"])).otherwise(x["e"]).alias("e"),
            F.when(x["s"] < a["e"], a["out"]).otherwise(closed(a)).alias("out"),
        ),
        closed,
    )


def _band(length: Column) -> Column:
    return F.greatest(*[F.when(length >= b, i).otherwise(0) for i, b in enumerate(BANDS)])


def thresholds(found: DataFrame, candidates: str, fdr: float = FDR) -> dict[int, float]:
    """Least p-value per length band at which a token counts as random, from a column of ``_candidates``.

    Over all tokens of all documents: the share of decoys that pass a threshold, those of ``PROSE`` included, times the
    tokens tested is what would pass if no token were random; it must be at most ``fdr`` of the tokens that do pass.
    So one token is found in a table of its own as in a large one, and the table's own decoys
    decide where there are many. At most bands x grid counts come to the driver.
    """
    tokens = found.select(F.explode(candidates).alias("x")).select(_band(F.col("x.e") - F.col("x.s")).alias("band"), "x.p", "x.decoy")
    counts = tokens.groupBy("band").agg(
        *[F.count(c).alias(f"{c}s") for c in ("p", "decoy")],
        *[F.coalesce(F.sum((F.col(c) >= t).cast("long")), F.lit(0)).alias(f"{c}{i}") for c in ("p", "decoy") for i, t in enumerate(P_GRID)],
    )
    return {row.band: t for row in counts.collect() if (t := threshold(row.asDict(), fdr)) is not None}


def threshold(counts: dict[str, int], fdr: float = FDR) -> float | None:
    """The least of ``P_GRID`` that holds the rate, from one band's counts of tokens (p) and decoys; None if none does."""
    for i, t in enumerate(P_GRID):
        share = (counts[f"decoy{i}"] + PROSE_DECOYS * PROSE[counts["band"]][i]) / (counts["decoys"] + PROSE_DECOYS)
        if counts[f"p{i}"] and share * counts["ps"] <= fdr * counts[f"p{i}"]:
            return t
    return None


def _base(text: Column) -> Column:
    """array<struct<s,k,e>> of the fixed patterns' spans, ``k`` the kind's number in the order of listing."""
    return F.concat(*[_of_kind(_spans(text, pattern, group, n), i) for i, (_, pattern, group, n) in enumerate(BASE)])


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def _random(candidates: Column, limits: dict[int, float]) -> Column:
    if not limits:
        return F.array().cast("array<struct<s:int,k:int,e:int>>")
    least = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])
    return _of_kind(_merged(F.filter(candidates, lambda x: x["p"] >= F.element_at(least, _band(x["e"] - x["s"])))), len(BASE))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k, *_ in BASE], F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def scan(docs: DataFrame, fdr: float = FDR, with_text: bool = True) -> DataFrame:
    """``docs`` with an array column ``secrets`` (underscores if taken) of spans, sorted by start, then kind.

    One pass over whole texts finds the fixed patterns' spans and the test results of all tokens, and writes
    them beside the columns of ``docs`` (all but the text without ``with_text``); the thresholds and the
    random spans come from what was written. No text is shuffled. A null text counts as empty and has no span.
    """
    base, candidates = spare(docs, "base_spans"), spare(docs, "candidates")
    columns = [c for c in docs.columns if with_text or c != "text"]
    text = text_or_empty()
    found = written(docs.select(*columns, _base(text).alias(base), _candidates(text).alias(candidates)), "secret-candidates")
    spans = F.array_sort(F.concat(F.col(base), _random(F.col(candidates), thresholds(found, candidates, fdr))))
    return found.withColumn(spare(docs, "secrets"), spans).drop(base, candidates)


def redact(docs: DataFrame, marker: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with each secret replaced by ``marker``; overlapping spans become one; n_chars follows.

    Texts without a secret, null ones included, stay as they are.
    """
    name = spare(docs, "secrets")
    found = scan(docs, fdr)
    text = F.col("text")
    cut = F.aggregate(
        F.col(name),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(x["e"] <= a["at"], a["out"])
            .when((x["s"] < a["at"]) & (a["at"] > 0), a["out"])
            .otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit(marker)))
            .alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    out = found.withColumn("text", F.when(F.size(name) > 0, cut).otherwise(text)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secrets")
    base = F.filter(spans, lambda x: x["k"] < len(BASE))

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("bigint")

    return scan(docs, with_text=False).select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )
