import re
from collections import Counter, defaultdict

import pytest

from askloom.llm import quality

SCHEMA = "doc_id long, source string, text string, host string, kept string, n_words int"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, rows):
    return spark.createDataFrame([(i, s, t, "h", "k", 1) for i, s, t in rows], SCHEMA)


def measures(text):
    text = text or ""
    words = re.findall(WORD, text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if counts[r] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


GOOD = "every word of this clean text stands here only once or maybe twice "


@pytest.mark.parametrize(
    "text",
    ["", None, "a", "a b c d e", "a b c d e a b c d e", "x " * 30, "é ü 漢字 # * $ % & | < >", "l\nl\n \n \nl\nm", "    a\x0bb\x0cc\x1cd",
     "one two three four five six one two three four five seven", GOOD * 3000],
)
def test_measures(text):
    assert quality.measure((text or "").encode()) == measures(text)


def brute(rows, limit=0.5):
    found = [(i, s, *measures(t)) for i, s, t in rows]
    failed = [m[2] < 10 or 100 * m[6] > 20 * m[2] for m in found]
    n, bad = Counter(m[1] for m in found), defaultdict(int)
    for m, f in zip(found, failed, strict=True):
        bad[m[1]] += f
    rates = [bad[s] / n[s] for s in n]
    mean, size = sum(rates) / len(rates), len(rows) / len(n)
    var = sum((r - mean) ** 2 for r in rates) / (len(rates) - 1) if len(rates) > 1 else None
    strength = max(1.0, min(mean * (1 - mean) / var - 1, max(size, 1.0))) if var and 0 < mean < 1 else size
    ok = {s: (bad[s] + strength * mean) / (n[s] + strength) <= limit for s in n}
    return sorted(((*m[:1], *m[2:], f, not f and ok[m[1]]) for m, f in zip(found, failed, strict=True)), key=str)


def test_a_bad_host_goes_and_a_small_one_is_judged_by_the_corpus(spark):
    rows = [(i, "bad", "spam" if i % 10 else GOOD) for i in range(200)]
    rows += [(1000 + i, f"good{i % 5}", GOOD + str(i)) for i in range(400)]
    rows += [(2000, "one", "short"), (2001, "one", GOOD), (3000, None, GOOD), (3001, None, None), (3000, None, GOOD)]
    got = quality.judge(table(spark, rows)).drop("host_rate")
    assert got.columns == ["doc_id", *quality.MEASURES, "base_failed", "kept"]
    result = sorted(map(tuple, got.collect()), key=str)
    assert result == brute(rows)
    kept = {r[0]: r[-1] for r in result}
    assert not any(kept[i] for i in range(200)) and all(kept[1000 + i] for i in range(400)) and kept[2001] and kept[3000]


def test_one_host_and_no_rows(spark):
    rows = [(1, "a", GOOD), (2, "a", "x")]
    assert sorted(map(tuple, quality.judge(table(spark, rows)).drop("host_rate").collect()), key=str) == brute(rows)
    assert quality.judge(table(spark, [])).count() == 0
