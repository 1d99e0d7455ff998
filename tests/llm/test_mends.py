"""Licences of rows that share an id or have none, repeated words against benchmark items, and texts of one id."""

from tickloom.llm import decontaminate, licences

MIT = "Released under the MIT License."


def test_licences_of_shared_and_null_ids(spark):
    rows = [(None, None, MIT), (None, "a/x.py", "just words"), (5, "b/x.py", MIT), (5, "b/x.py", "just words"), (5, "b/y.py", None), (6, "c/z.py", MIT), (6, "c/z.py", MIT)]
    files = spark.createDataFrame([(*r, "extra") for r in rows], "file_id long, path string, text string, row string")
    got = sorted((str(r.file_id), str(r.path), str(r.licence), r.origin) for r in licences.scan(files).collect())
    assert got == [
        ("5", "b/x.py", "MIT", "header"), ("5", "b/x.py", "None", "none"), ("5", "b/y.py", "None", "none"), ("6", "c/z.py", "MIT", "header"),
        ("6", "c/z.py", "MIT", "header"), ("None", "None", "MIT", "header"), ("None", "a/x.py", "None", "none"),
    ]
    assert licences.scan(files.limit(0)).count() == 0


def plain_leaks(docs, items, match=decontaminate.MATCH):
    """The best passage of each item in each document, by loops over all pairs of places."""
    span, context, best = decontaminate.SPAN, decontaminate.CONTEXT, {}
    for d, dw in docs:
        for i, iw in items:
            for da in range(len(dw) - span + 1):
                for ia in range(len(iw) - span + 1):
                    if not any(all(dw[da + o] == iw[ia + o] for o in mask) for mask in decontaminate.MASKS):
                        continue
                    before = min(da, ia, context)
                    compared = before + min(len(dw) - da, len(iw) - ia, span + context)
                    matched = sum(dw[da - before + k] == iw[ia - before + k] for k in range(compared))
                    if matched >= match * compared:
                        best[d, i] = max(best.get((d, i), (-1,)), (matched, -compared, before - da))
    return {key: (m, -c, -p) for key, (m, c, p) in best.items()}


def test_repeated_words_are_laid_once_for_each_diagonal(spark, monkeypatch):
    docs = [(1, ["so"] * 120), (2, (["a", "b", "c"] * 40)[:100] + ["so"] * 20), (3, [f"w{k}" for k in range(60)]), (None, ["so"] * 15 + ["x"] * 30)]
    items = [(7, ["so"] * 50), (8, ["a", "b", "c"] * 9 + ["so"] * 5), (9, [f"w{k}" if k % 9 else "other" for k in range(20, 50)])]
    laid, inner = [], decontaminate._laid
    monkeypatch.setattr(decontaminate, "_laid", lambda docs, hits, texts: laid.append(hits) or inner(docs, hits, texts))
    got = decontaminate.leaks(
        spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"),
    ).collect()
    wanted = plain_leaks(docs, items)
    found = {(r.doc_id, r.item_id): (r.matched, r.compared, r.position) for r in got}
    assert len(found) == len(got) and wanted.items() <= found.items()
    assert {(1, 7), (2, 8), (3, 9)} <= wanted.keys()
    diagonals = sum(len(dw) + len(iw) for _, dw in docs for _, iw in items)
    assert laid[0].count() < diagonals and all(len(r.places) <= 50 for r in laid[0].collect())


def test_texts_of_one_id_are_laid_on_their_own_words(spark):
    item = " ".join(f"q{k}" for k in range(30))
    docs = spark.createDataFrame([(4, f"one two three {item}", "x"), (4, " ".join(f"z{k}" for k in range(50)), "y"), (4, None, "z")], "doc_id long, text string, hit_doc string")
    bench = spark.createDataFrame([(1, item), (1, "other words stand here and they never meet any text at all anywhere"), (2, "")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.leaks(docs, bench).collect()] == [(4, 1, 30, 30, 3)]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == decontaminate.leaks(docs.limit(0), bench).count() == 0
