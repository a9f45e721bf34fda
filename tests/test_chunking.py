import random

import pytest
from pyspark.sql import functions as F

from askloom.operators import chunking, corpus
from askloom.settings import Settings

SMALL = Settings(parent_size=12, parent_overlap=3, child_size=5, child_overlap=1)


def python_windows(tokens, size, overlap):
    out = []
    for start in range(0, len(tokens), max(size - overlap, 1)):
        out.append(tokens[start:start + size])
        if start + size >= len(tokens):
            break
    return out


@pytest.mark.parametrize(("n", "size", "overlap", "count"), [(0, 5, 1, 0), (5, 5, 1, 1), (6, 5, 1, 2), (10, 4, 6, 7)])
def test_window_count(value, n, size, overlap, count):
    assert value(chunking.window_count(F.lit(n), size, overlap)) == count


def docs(spark, sizes):
    rng = random.Random(3)
    rows = [
        (f"f{i}", " ".join(rng.choice(["a", "bb", "ccc"]) + str(j) for j in range(n)))
        for i, n in enumerate(sizes)
    ]
    return rows, spark.createDataFrame(rows, "source string, text string")


def test_hierarchy_against_loop(spark):
    rows, df = docs(spark, [1, 5, 11, 12, 13, 22, 40, 101])
    got = {
        (r["source"], r["chunk_index"]): (r["parent_index"], r["child_index"], r["text"].split())
        for r in chunking.chunk_children(df, SMALL).collect()
    }
    want = {}
    for source, text in rows:
        n = 0
        for p, parent in enumerate(python_windows(text.split(), 12, 3)):
            for c, child in enumerate(python_windows(parent, 5, 1)):
                want[(source, n)] = (p, c, child)
                n += 1
    assert got == want


def test_no_overlap_joins_back(spark):
    rows, df = docs(spark, [3, 17, 60])
    chunks = chunking.chunk_flat(df, 7, 0).orderBy("chunk_index").collect()
    for source, text in rows:
        assert "".join(c["text"] for c in chunks if c["source"] == source) == text


def test_children_need_no_shuffle(spark):
    _, df = docs(spark, [30])
    plan = chunking.chunk_children(df, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, 2, " two ", []), (1, 1, "", ["| t |"]), (1, 3, "  ", [""]), (1, 10, "x" * 60, [])],
        "doc_id int, page int, text string, tables array<string>",
    )
    text = corpus.assemble_pages(pages).first()["text"]
    assert text == f"[Page 1]\n\n[Table 1 on Page 1]\n| t |\n\n[Page 2]\n\ntwo\n\n[Page 10]\n\n{'x' * 60}"
    stats = corpus.page_stats(pages).first()
    assert (stats["page_count"], stats["table_page_count"], stats["scanned_page_count"]) == (4, 1, 2)


def test_topic_rollup_counts_all_hits_but_top_areas_only(spark):
    areas = {"a": ("x",), "b": ("y",), "c": ("z",), "d": ("w", "x")}
    df = spark.createDataFrame([(1, "x x x y y z w"), (2, "y")], "doc_id int, text string")
    hits = corpus.topic_hits(df, areas)
    got = {r["area"]: (r["area_doc_count"], r["area_hits"]) for r in corpus.topic_rollup(hits, 2).collect()}
    assert got == {"a": (1, 3), "b": (1, 3), "c": (0, 1), "d": (1, 4)}
