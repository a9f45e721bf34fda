from collections import defaultdict

from askloom.llm import line_dedup

SCHEMA = "doc_id long, text string, lines int, pos string, hash int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p", 2) for i, t in rows], SCHEMA)


def brute(rows, size=3):
    places = defaultdict(list)
    split = {i: (t or "").split("\n") for i, t in rows}
    for i, lines in split.items():
        for p in range(len(lines) - size + 1):
            run = "\n".join(lines[p : p + size])
            if run.encode().split():
                places[run].append((i, p))
    gone = defaultdict(set)
    for found in places.values():
        (doc, start), *later = sorted(found)
        for i, p in later:
            gone[i] |= {k for k in range(p, p + size) if i != doc or k >= start + size}
    return {
        i: (len(lines), len(gone[i]), "\n".join(x for k, x in enumerate(lines) if k not in gone[i]))
        for i, lines in split.items()
    }


def got(df):
    return {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in df.collect()}


def test_matches_brute_force(spark):
    a = "one x\ntwo x\nthree x\nfour x"
    rows = [
        (1, a), (2, "start\n" + a + "\nend"), (3, "two x\nthree x\nfour x\nfive x"), (4, "one x\ntwo x"), (5, None), (6, ""),
        (7, "\n\n\n\n\n"), (8, "\n\n\n\n"), (9, "r r\nr r\nr r\nr r\nr r\nr r"), (10, a + "\n"), (11, "\n".join(f"line {k % 50}" for k in range(5000))),
    ]
    assert got(line_dedup.remove_repeated(table(spark, rows))) == brute(rows)


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(line_dedup.remove_repeated(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_null_ids_come_last_and_empty_tables_stay_empty(spark):
    rows = [(None, "a b\nc d\ne f"), (5, "a b\nc d\ne f")]
    assert got(line_dedup.remove_repeated(table(spark, rows))) == {None: (3, 3, ""), 5: (3, 0, "a b\nc d\ne f")}
    assert line_dedup.remove_repeated(table(spark, [])).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = line_dedup.remove_repeated(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    shared = "a b\nc d\ne f"
    for doc_id in (None, 7):
        first = "one x\ntwo x\nthree x\n" + shared
        second = shared + "\nfour x\nfive x\nsix x"
        rows = [(doc_id, first), (doc_id, second), (1, "p q\nr s\nt u"), (doc_id, "p q\nr s\nt u\nv w"), (doc_id, shared)]
        out = line_dedup.remove_repeated(table(spark, rows).coalesce(1)).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in out), key=str) == sorted(
            [
                (doc_id, 6, 0, first), (doc_id, 6, 3, "four x\nfive x\nsix x"), (1, 3, 0, "p q\nr s\nt u"),
                (doc_id, 4, 3, "v w"), (doc_id, 3, 3, ""),
            ],
            key=str,
        )


def test_short_lines_and_texts_without_spaces(spark):
    chinese = "第一段落没有空格\n\n第二段落也没有空格"
    rows = [(1, chinese), (2, chinese), (3, "a\nb\nc\nd"), (4, "x\nb\nc\nd\ne"), (5, "\n\n \n\t\n"), (6, "\n\n \n\t\n")]
    out = got(line_dedup.remove_repeated(table(spark, rows)))
    assert out == brute(rows)
    assert out[1][1] == 0 and out[2] == (3, 3, "") and out[4] == (5, 3, "x\ne") and out[6][1] == 0


def test_a_first_occurrence_stays_whole(spark):
    rows = [(1, "a b c\na b c\na b c\na b c\nend"), (2, "p q\nr s\n" * 4), (3, "a b c\na b c\na b c")]
    out = got(line_dedup.remove_repeated(table(spark, rows)))
    assert out == brute(rows)
    assert out[1] == (5, 1, "a b c\na b c\na b c\nend") and out[3] == (3, 3, "")
