from collections import defaultdict

from sumwright.llm import line_dedup

SCHEMA = "doc_id long, source string, text string, n_lines string, keys string, site string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA)


def brute(rows, ratio, least):
    pages, of = defaultdict(int), defaultdict(set)
    for n, (_, source, text) in enumerate(rows):
        pages[source] += 1
        for line in (text or "").split("\n"):
            if line.strip(" \t\r"):
                of[source, line.strip(" \t\r")].add(n)
    drop = {k for k, v in of.items() if len(v) >= least and len(v) > ratio * pages[k[0]]}
    result = []
    for doc, source, text in rows:
        if text is None:
            result.append((doc, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if (source, x.strip(" \t\r")) not in drop]
        if len(kept) < len(lines) and not any(x.strip(" \t\r") for x in kept):
            kept = lines
        result.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return result


def test_against_brute_force(spark):
    rows = []
    for i in range(200):
        source = (None, "a", "b", "tiny")[i % 4 if i < 196 else 0]
        lines = [f"own {i}", "menu", "", " menu\r" if i % 8 == 1 else "menu", "rare" if i % 40 == 1 else f"x {i}"]
        rows.append((i, source, "\n".join(lines)))
    rows += [(900, "a", None), (901, "a", ""), (902, "a", "menu"), (903, "a", "menu\n\n menu"), (1, "a", "menu\nlast\n")]
    rows += [(904, "b", "\n".join(["menu"] * 20_000 + ["end"]))]
    got = line_dedup.drop_boilerplate(docs(spark, rows), ratio=0.2, min_pages=3)
    assert got.columns == [*docs(spark, []).columns, "n_dropped"]
    found = sorted((r.doc_id, str(r.text), r.n_lines, r.n_dropped) for r in got.collect())
    assert found == sorted((d, str(t), n, k) for d, t, n, k in brute(rows, 0.2, 3))
    assert any(k for *_, k in found) and got.first()["keys"] == "own"


def test_a_line_at_the_ratio_stays(spark):
    rows = [(i, "a", f"{i}\nhalf" if i < 5 else f"{i}") for i in range(10)]
    assert {r.n_dropped for r in line_dedup.drop_boilerplate(docs(spark, rows), 0.5, 1).collect()} == {0}
    rows.append((10, "a", "10\nhalf"))
    got = line_dedup.drop_boilerplate(docs(spark, rows), 0.5, 1).collect()
    assert sum(r.n_dropped for r in got) == 6


def test_empty_table(spark):
    assert line_dedup.drop_boilerplate(docs(spark, [])).count() == 0


def test_small_sites_lose_lines_by_the_ratio_alone(spark):
    import corpus_pipeline

    for pages in (3, 9, 40):
        rows = [(i, "a", f"own {i}\nmenu" if i < max(pages // 15, 2) + 1 else f"own {i}") for i in range(pages)]
        want = sorted((d, t, k) for d, t, _, k in brute(rows, 0.05, 2))
        assert sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.drop_boilerplate(docs(spark, rows)).collect()) == want
        assert sum(k for *_, k in want) > 1
        frame = docs(spark, rows).selectExpr("doc_id", "text", "source", "0L AS n_chars")
        assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_lines(spark, frame, "").collect()) == [(d, t) for d, t, _ in want]
