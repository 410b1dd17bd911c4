import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import secrets

SF = "/root/testdata/sf0.001"


def brute(text):
    out = []
    for i, (kind, pattern, group, least) in enumerate(secrets.BASE):
        flags = 0
        out += [(m.start(), i, m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


ODD = [
    None, "", "AKIA" + "Z" * 14, "AKIAB AKIA" + "0" * 20, "éé Token = 'abcdefghijkl' x", "token=short token:abcdefghijklm",
    "TOKEN=secret=abcdefghijklmnop", "password: password: abcdefghijklmnop", "0123456789abcdef" * 3, "𝔸 api_key=\"ZZZZZZZZZZZZ\"",
    "deadbeefdeadbeefg0123456789abcdef", "apikey:=abcdefghijkl passwd=abcdefghijklmn", "token=aaaaaaaaaaaaaaaa" * 50,
]


def test_base_spans_match_python(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, secrets string")
    out = secrets.scan(docs)
    assert "secrets_" in out.columns
    rows = out.select("doc_id", secrets._joined(F.filter("secrets_", lambda x: x["k"] < 3)).alias("j")).collect()
    assert {r.doc_id: r.j for r in rows} == {i: brute(t or "") for i, t in enumerate(ODD)}


def test_query_matches_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = secrets.op6_secret_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in want.split(",") if x]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))


def test_randomness_tells_random_from_structured(spark):
    key = [hashlib.sha256(str(i).encode()).hexdigest()[:40] for i in range(200)]
    plain = ["0123456789abcdef" * 3, "aaaaaaaaaaaaaaaaaaaaaaaabbbb", "thereanderingtionthehaerinationtheof"]
    rows = spark.createDataFrame([(t,) for t in key + plain], "t string").select("t", secrets.randomness(F.col("t")).alias("p")).collect()
    p = {r.t: r.p for r in rows}
    assert sum(p[k] >= 0.05 for k in key) >= 180
    assert all(p[k] < 0.001 for k in plain[:2]) and p[plain[2]] < 0.001


def test_battery_adds_random_tokens_and_spares_words(spark):
    words = "ordinary words and internationalisation of counterrevolutionaries stay as they are in this text "
    token = lambda i: hashlib.sha256(str(i).encode()).hexdigest().upper()[:32]
    docs = spark.createDataFrame([(i, f"{words}{token(i)} {words}" if i < 60 else words) for i in range(120)], "doc_id long, text string")
    rows = secrets.scan(docs).collect()
    hits = {r.doc_id: [(x.s, x.e) for x in r.secrets] for r in rows}
    assert sum(hits[i] == [(len(words), len(words) + 32)] for i in range(60)) >= 55
    assert all(hits[i] == [] for i in range(60, 120))


@pytest.mark.parametrize(
    "before, letters, after",
    [
        ("AUTH=", "A-Za-z0-9", ""), ("https://host.org/get?id=7&sig=", "A-Za-z0-9", "&x=1"), ("SESSION_ID=", "0-9a-f", "; "),
        ("srv/path/", "A-Za-z0-9", "-x"), ("number ", "0-9", " "), ("KEY=", "A-Za-z0-9+/", "=="),
    ],
)
def test_glued_tokens_are_found(spark, before, letters, after):
    rng = random.Random(before)
    signs = [chr(c) for c in range(33, 127) if re.match(f"[{letters}]", chr(c))]
    words = "ordinary words and internationalisation of counterrevolutionaries stay as they are in this text "
    made = ["".join(rng.choice(signs) for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame([(i, f"{words}{before}{t}{after} {words}") for i, t in enumerate(made)], "doc_id long, text string")
    start = len(words) + len(before)
    found = [[(x.s, x.e) for x in r.secrets if x.k == len(secrets.BASE)] for r in secrets.scan(docs).collect()]
    assert sum(any(s <= start and e >= start + 40 for s, e in spans) for spans in found) >= 50
    assert all(len(spans) <= 1 for spans in found)


def test_redact_and_empty(spark):
    docs = spark.createDataFrame(
        [(1, "a token=abcdefghijklmnop0123456789abcdef b", 5), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long"
    )
    rows = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert rows[1].text == "a [SECRET] b" and rows[1].n_chars == 12
    assert rows[2].text is None and rows[3].text == "clean"
    assert secrets.redact(docs.limit(0)).count() == 0
    assert secrets.redact(docs).columns == docs.columns


def battery(token):
    """The three tests and Fisher's method in plain Python, with the normal law's own tails."""
    bare = token.rstrip("=")
    letters = next((a for a, shape in secrets.ENCODINGS if re.match(shape, bare)), None)
    if letters is None or len(bare) < secrets.MIN_TOKEN:
        return None
    v, k, n = [letters.index(c) for c in bare], len(letters), len(bare)
    upper = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi = sum((v.count(i) - n / k) ** 2 / (n / k) for i in range(k))
    df = k - 1
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [2 * x >= k for x in v]
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    both = 2 * sum(high) * (n - sum(high))
    spread = both * (both - n) / (n * n * (n - 1))
    p_runs = 2 * upper(abs(runs - both / n - 1) / math.sqrt(spread)) if spread > 0 else 0.0
    mean = sum(v) / n
    var = sum((x - mean) ** 2 for x in v) / n
    lag = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:]))
    p_lag = 2 * upper(abs((lag / (n * var) + 1 / n) * math.sqrt(n))) if var > 0 else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (upper(z_chi), p_runs, p_lag))
    return math.exp(-half) * (1 + half + half * half / 2)


def test_battery_equals_plain_python(spark):
    rng = random.Random(3)
    alphabets = [a for a, _ in secrets.ENCODINGS]
    tokens = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(15, 80))) for _ in range(200)]
    tokens += ["".join(rng.choice(a) for _ in range(rng.randint(20, 70))) for a in alphabets for _ in range(20)] + ["a" * 30, "ab" * 20, "0123456789" * 3]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string").select("i", secrets.randomness(F.col("t")).alias("p")).collect()
    for r in got:
        want = battery(tokens[r.i])
        assert (r.p is None) == (want is None)
        assert want is None or r.p == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("copies", [1, 9, 30])
def test_a_token_is_found_whatever_the_size_of_the_table(spark, copies):
    rng = random.Random(copies)
    words = "ordinary words and internationalisation of counterrevolutionaries stay as they are in this text "
    made = []
    while len(made) < copies:  # tokens of p-values that every threshold for their length lets pass
        token = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
        if battery(token) > 0.05:
            made.append(token)
    docs = spark.createDataFrame([(i, f"{words}{t} {words}") for i, t in enumerate(made)], "doc_id long, text string")
    found = [[(x.s, x.e) for x in r.secrets] for r in secrets.scan(docs).collect()]
    assert found == [[(len(words), len(words) + 40)]] * copies


def test_thresholds_hold_the_rate():
    none = {f"{c}{i}": 0 for c in ("p", "decoy") for i in range(len(secrets.P_GRID))} | {"decoys": 0}
    full = lambda n: {f"p{i}": n for i in range(len(secrets.P_GRID))}
    assert secrets.threshold(none | full(1) | {"ps": 1, "band": 3}) == 0.001
    assert secrets.threshold(none | full(1) | {"ps": 1, "band": 0}) == 0.005
    assert secrets.threshold(none | full(1) | {"ps": 5000, "band": 3}) is None  # one of many: as many pass in prose
    many = {f"decoy{i}": 900_000 for i in range(len(secrets.P_GRID))} | {"decoys": 1_000_000}
    assert secrets.threshold(none | full(800_000) | many | {"ps": 1_000_000, "band": 3}) is None  # the table's own decoys decide


def test_prose_has_few_random_spans_and_long_texts_are_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.regexp_replace("text", "[0-9A-Z=:+/_-]", "").alias("text")).withColumn("doc_id", F.monotonically_increasing_id())
    assert sum(len([x for x in r.secrets if x.k == len(secrets.BASE)]) for r in secrets.scan(docs).collect()) <= 2
    token = hashlib.sha256(b"x").hexdigest()
    long = "plain words " * 100_000 + token
    (row,) = secrets.scan(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert (len(long) - 64, len(long)) in [(x.s, x.e) for x in row.secrets]


def test_plan_of_the_scan_holds_each_value_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(secrets._candidates(F.col("text")).alias("c"))
    assert len(docs._jdf.queryExecution().toString()) < 200_000  # a million before: it is held by the driver many times over
