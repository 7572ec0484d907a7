import re

import regex

from cases import LONG, empty, odd

from arborspark.llm import rules


def good(text):
    """The rules in plain Python."""
    if text is None or not re.search(r"[^ \n\t\r]", text):
        return False
    words = text.count(" ") + text.count("\n") + 1
    count = lambda chars: sum(text.count(c) for c in chars)
    if count("#$%&*") / words > 0.5 or text.count("|") / words > 0.2 or text.count("!") / words > 0.3:
        return False
    if len(regex.findall(r"\p{Lu}", text)) / len(text) > 0.4 or len(regex.findall(r"\p{L}", text)) / len(text) < 0.4:
        return False
    if (len(text) - words + 1) / words > 40 and len(regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]", text)) / len(text) < 0.3:
        return False
    lines = text.split("\n")
    if len(lines) > 3 and len(set(lines)) / len(lines) < 0.5:
        return False
    pieces = re.split("[ \n]", text)
    return not (words >= 10 and sum(a == b != "" for a, b in zip(pieces, pieces[1:])) / words > 0.2)


TEXTS = ["fine words in a row", "ALL LOUD WORDS", "a | b | c | d", "so! many! marks!", "#$% a", "1234 5678 9", "x" * 50, "l\nl\nl\nl\nl", "l\nl\nk\nm", "no no no no no no no no no no no", "é à ü ö", "  ", "\r\n", LONG, "a b", "!", "Über Äpfel", "😀 😀", "Русский текст без латиницы", "ΕΛΛΗΝΙΚΑ", "это это это это это это это это это это", "中文" * 60, "文章" * 60 + " mixed words", "สวัสดี" * 20, "a a\na  a b b\n\nb b c c c c", "aa a aa a aa a aa a aa aa", "x y x y x y x y x x", "no\tno no\tno no\tno no\tno no no no no no no no", "l\n\n\n\nl"]


def test_against_plain_python(spark):
    got = {r.doc_id: r.keep for r in rules.quality(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")).collect()}
    assert got == {i: good(t) for i, t in enumerate(TEXTS)}


def test_any_order_keeps_the_same(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    every = rules.default_rules()
    assert {r.doc_id for r in df.filter(rules.cascade(every)).collect()} == {r.doc_id for r in df.filter(rules.cascade(every[::-1])).collect()} == {i for i, t in enumerate(TEXTS) if good(t)}


def test_order_by_rejections_per_cost():
    some = [rules.Rule(x, None) for x in "abcd"]
    costs = [rules.RuleCost("a", 1.0, 0.1), rules.RuleCost("b", 0.1, 0.1), rules.RuleCost("c", 1.0, 0.0), rules.RuleCost("d", 2.0, 0.2)]
    assert [r.name for r in rules.order(some, costs)] == ["b", "a", "d", "c"]


def test_order_by_what_is_left():
    """c rejects what a rejects and a little more; after a, it is worth less than b."""
    some = [rules.Rule(x, None) for x in "abc"]
    costs = [rules.RuleCost("a", 1.0, 0.5), rules.RuleCost("b", 1.0, 0.2), rules.RuleCost("c", 1.2, 0.55)]
    patterns = [((True, False, True), 50), ((False, False, True), 5), ((False, True, False), 20), ((False, False, False), 25)]
    assert [r.name for r in rules.order(some, costs)] == ["a", "c", "b"] and [r.name for r in rules.order(some, costs, patterns)] == ["a", "b", "c"]


def test_estimate_counts_rejections(spark):
    df = spark.createDataFrame([(i, "ALL LOUD" if i % 4 == 0 else "quiet words") for i in range(400)], "doc_id bigint, text string")
    costs = {c.name: c for c in rules.estimate(df, rules.default_rules(), runs=1)}
    assert costs["capitals"].rejected == 0.25 and costs["bars"].rejected == 0 and all(c.seconds > 0 for c in costs.values())


def test_odd_rows(spark):
    df = odd(spark)
    got = sorted(((r.doc_id, r.keep) for r in rules.quality(df).collect()), key=repr)
    assert got == sorted(((r.doc_id, good(r.text)) for r in df.select("doc_id", "text").collect()), key=repr)
    kept = rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(k for _, k in got)
    assert rules.quality(empty(spark)).collect() == [] and rules.keep_good(empty(spark)).collect() == []
