from cohortspark.llm import line_dedup as ld

SF = "/root/testdata/sf0.001"


def brute(rows, least):
    sites, first = {}, {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\r")
            if k:
                if s is not None:
                    sites.setdefault(k, set()).add(s)
                if i is not None:
                    first[k] = min(first.get(k, i), i)
    gone = {k for k, v in sites.items() if len(v) >= least}
    out = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        stay = [x for x in lines if x.strip(" \t\r") not in gone or first[x.strip(" \t\r")] == i]
        out.append((i, None if t is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def test_threshold_and_edges(spark):
    rows = [(i, f"menu\n own {i}\n\n menu \nrare" if i < 7 else f"menu\r\nown {i}", f"s{i % 12}") for i in range(40)]
    rows += [(100, None, "s1"), (101, "", "s2"), (102, "menu", None), (None, "menu\nx", "s3"), (103, "menu\n" * 3000 + "end", "s4"), (104, "only", "s5"), (104, "only", "s5")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, source string, n_lines int, cut string")
    for least in (5, 7, 8, 11, 12, 13):
        got = ld.line_dedup(docs, least).select("doc_id", "text", "n_lines_", "n_removed").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, least), least


def test_many_sites_are_counted_by_sketch(spark):
    rows = [(i, "wide\nnear\nown %d" % i if i < 104 else "wide\nown %d" % i, f"s{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (100, 104, 105, 300):
        got = ld.line_dedup(docs, least).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, least)


def test_query_and_empty(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = ld.op3_line_dedup(spark, SF).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, ld.MIN_SITES)
    docs = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    assert ld.line_dedup(docs).count() == 0


def test_clashing_names_and_long_lines(spark):
    line = "w " * 30_000
    rows = [(i, f"{line}\nown {i}", f"s{i % 12}", 1, 2, 3) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, id_ int, cut_ int, line_key int")
    out = {r.doc_id: r for r in ld.line_dedup(docs).collect()}
    assert out[0].text == rows[0][1] and all(out[i].text == f"own {i}" and out[i].n_removed == 1 for i in range(1, 24))
    assert all((r.id_, r.cut_, r.line_key) == (1, 2, 3) for r in out.values())


def test_sketches_decide_as_exact_counts(spark):
    """Lines on 5 to 40 sites, many times each: those from 10 sites on go, whatever side of the threshold they are on."""
    rows = [(1000 * k + i, f"line {k}", f"site {i % k}") for k in range(5, 41) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.first_doc // 1000 for r in ld.boilerplate_lines(docs).collect()}
    assert found == set(range(10, 41))
