from collections import defaultdict

from lexigrid.llm.line_dedup import dedup_lines, line_keys

WHITE = "\t\n\x0b\x0c\r "


def slow(rows, least=20, docs=3):
    lower = {c: c + 32 for c in range(65, 91)}
    keyed = [(i, [(line, line.strip(WHITE).translate(lower)) for line in (t or "").split("\n")]) for i, t in rows]
    holders = defaultdict(set)
    for i, lines in keyed:
        for _, key in lines:
            if len(key) >= least and i is not None:
                holders[key].add(i)
    out = []
    for i, lines in keyed:
        kept = [line for line, k in lines if len(holders[k]) < docs or i == max(holders[k])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_tables(small):
    got = [tuple(r) for r in dedup_lines(small).select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=str) == slow([(r.doc_id, r.text) for r in small.collect()])


def test_odd_rows(odd, empty):
    out = dedup_lines(odd)
    assert sorted(out.columns) == sorted(odd.columns)
    got = [tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=str) == slow([(r.doc_id, r.text) for r in odd.collect()])
    assert dedup_lines(empty).count() == 0


def test_keys_strip_and_lower_ascii_only():
    assert line_keys("\x1f AÄ \x0b\r\n b".encode()) == ["\x1f aÄ".encode(), " b".encode()]


def test_twenty_code_points(spark):
    rows = [(k, "é" * 19 + "\n" + "é" * 20) for k in range(3)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_dropped"] for r in got] == [1, 1, 0]


def test_rows_of_one_document_hold_a_line_once(spark):
    line = "a line that is long enough"
    for ids in ([1, 1, 2], [1, 1, 2, 3], [1, None, None, 2], [None, 1, 2, 3], [None] * 4):
        rows = [(i, f"{line}\nown {k}") for k, i in enumerate(ids)]
        got = [tuple(r) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert sorted(got, key=str) == slow(rows)
    assert [d for *_, d in slow([(1, line), (1, line), (2, line)])] == [0, 0, 0]
