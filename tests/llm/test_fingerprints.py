import hashlib

import numpy as np

from cohortspark.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"


def test_query_matches_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    order = sorted(texts)
    rows = fp.op8_document_fingerprints(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == order
    sketch = {i: fp.sketches([texts[i]]) for i in order}
    for r in rows:
        t = texts[r.doc_id]
        following = order[(order.index(r.doc_id) + 1) % len(order)]
        changed = fp.edited(t, texts[following])
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fp.shown(sketch[r.doc_id])[0] and r.edited_fingerprint == fp.shown(fp.sketches([changed]))[0]
        assert r.near_next == fp.likeness(sketch[r.doc_id], sketch[following])[0]
    long = [r for r in rows if r.n_chars > 2000]
    assert 0.2 < np.mean([r.near_edited for r in long]) < 0.6
    assert np.mean([r.near_next for r in long]) < 0.2


def test_equal_substrings_share_interior_phrases():
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefghij "), 3000))
    own = set(fp.parse([passage])[0].tolist())
    for offset in (1, 7, 50, 333):
        for tail in (0, 11):
            text = "".join(rng.choice(list("klmnop "), offset)) + passage + "".join(rng.choice(list("klmnop "), tail))
            shared = own & set(fp.parse([text])[0].tolist())
            assert len(shared) >= len(own) - 12


def test_batches_do_not_matter_and_phrases_shrink():
    texts = ["", "a", "aaaaaaaa", "abab" * 50, "x" * 100_000, "é𝔸" * 30, "some words here and there " * 40, ""]
    together = fp.sketches(texts)
    assert all((together[i] == fp.sketches([t])[0]).all() for i, t in enumerate(texts))
    names, _ = fp.parse([texts[6] * 20])
    assert names.size < len(texts[6]) * 20 / 8
    assert fp.likeness(together[:1], together[7:])[0] == 1.0 and fp.likeness(together[:1], together[1:2])[0] == 0.0


def test_labels_differ_for_neighbours():
    names = fp._mix(np.arange(5000, dtype=np.uint64))
    first = np.zeros(5000, bool)
    first[0] = True
    labels = fp._tossed(names, first)
    assert labels[6:].max() < 6 and (labels[6:][1:] != labels[6:][:-1]).all()


def test_odd_rows(spark):
    rows = [(None, "null id", 1), (1, None, 2), (1, None, 2), (2, "ab", 3), (5, "", 4), (2, "ab", 3)]
    out = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")).collect()
    assert len(out) == 6 and len({r.fingerprint for r in out if r.doc_id == 2}) == 1
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (only,) = fp.fingerprints(spark.createDataFrame([(9, "abcd")], "doc_id long, text string")).collect()
    assert only.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and only.near_next == 1.0


def plain_mix(x):
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & (2**64 - 1)
    return x ^ (x >> 32)


def plain_sketch(text):
    """The fingerprint by a parser of its own: symbols in lists, one at a time."""
    names = [plain_mix(ord(c)) for c in text]
    for _ in range(fp.LEVELS):
        runs = []
        for n in names:
            if runs and runs[-1][0] == n:
                runs[-1][1] += 1
            else:
                runs.append([n, 1])
        names = [n if k == 1 else plain_mix((n + k) % 2**64) for n, k in runs]
        labels = names
        for _ in range(4):
            new = []
            for i, v in enumerate(labels):
                differ = v ^ labels[i - 1] if i else 1
                low = (differ & -differ).bit_length() - 1
                new.append(2 * low + (v >> low & 1))
            labels = new
        phrases = []
        for i, n in enumerate(names):
            if i == 0 or 0 < i < len(names) - 1 and labels[i - 1] < labels[i] > labels[i + 1]:
                phrases.append([])
            phrases[-1].append(n)
        names = [plain_mix(sum(plain_mix(n ^ plain_mix(min(j, 255) + 1)) for j, n in enumerate(p)) % 2**64) for p in phrases]
    slots = [0xFFFF] * fp.SLOTS
    for n in names:
        slots[n % fp.SLOTS] = min(slots[n % fp.SLOTS], min(n >> 16 & 0xFFFF, 0xFFFE))
    return "".join(f"{v:04x}" for v in slots)


def test_query_matches_a_plain_parser(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    ids = sorted(texts)
    following = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    for r in fp.op8_document_fingerprints(spark, SF).collect():
        t, f = texts[r.doc_id], texts[following[r.doc_id]]
        if len(t) > 6000:
            continue  # the plain parser is slow; the lengths above are in the other tests
        assert r.fingerprint == plain_sketch(t)
        assert r.edited_fingerprint == plain_sketch(t[: len(t) - len(t) // 2] + f[: len(t) // 2])


def test_plain_parser_on_odd_texts():
    for text in ["", "a", "aa", "ab" * 50, "a" * 300 + "b", "é𝔸 ꙮ\n\t", "abc" * 100 + "x" * 9, "\u0000\u0001"]:
        assert fp.shown(fp.sketches([text]))[0] == plain_sketch(text)
