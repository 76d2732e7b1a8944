import re
from collections import Counter

import pytest

from corvane.llm.quality_rules import filter_quality, judge, metrics


def slow(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(hit), sum(text.count(c) for c in "#*$%&|<>")


TEXTS = [None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 30, "\n\na b\n a b\na b\n", "#a *b $%&|<> ü\x0bé\x0cz\r\n", "one two three four five six seven eight nine ten eleven", "p q r s t u p q r s t v w " * 900 + "end", "𝒳𝒴 𝒵" * 4]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    for r in metrics(docs).collect():
        assert (r.q_n_words, r.q_word_chars, r.q_n_dup_lines, r.q_n_repeat_words, r.q_symbols) == slow(TEXTS[r.doc_id]), r.doc_id


@pytest.mark.parametrize("n", [5, 400])
def test_thresholds_follow_the_group(spark, n):
    """A source that uses symbols throughout keeps them; elsewhere they stand out."""
    word = lambda i, j: f"w{i:04d}x{j:02d}"
    prose = lambda i: " ".join(word(i, j) for j in range(40))
    table = lambda i: " | ".join(word(i, j) for j in range(40))
    rows = [(i, table(i), "en", "tables") for i in range(n)] + [(n + i, prose(i), "en", "prose") for i in range(n)] + [(2 * n, table(7), "en", "prose"), (2 * n + 1, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in filter_quality(docs).collect()}
    assert kept >= set(range(n, 2 * n)) and 2 * n + 1 not in kept
    if n > 30:
        assert kept == set(range(2 * n))


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert judge(metrics(spark.createDataFrame([], schema))).count() == 0
    row = (1, "a b c d e f g h i j k", "en", None)
    assert filter_quality(spark.createDataFrame([row, row], schema)).count() == 2


def test_columns_of_any_name(spark):
    schema = "doc_id long, text string, lang string, source string, q_w int, q_kept string, `a.b` int"
    row = (1, "a b c d e f g h i j k", "en", None, 5, "x", 6)
    assert filter_quality(spark.createDataFrame([row], schema)).collect() == [row]


def test_thresholds_differ_between_groups():
    """On the given tables the thresholds of most languages and sources aren't the least ones."""
    import duckdb

    from corvane.llm.quality_rules import JUDGED_SQL

    sql = f"WITH docs0 AS (SELECT * FROM '/root/testdata/sf0.01/documents.parquet'),{JUDGED_SQL} SELECT count(*), count(DISTINCT t3), count(*) FILTER (t1 > 10 OR t2 > 200 OR t3 > 20) FROM q15"
    groups, stutter, moved = duckdb.sql(sql).fetchall()[0]
    assert stutter > 5 and moved > groups / 2
