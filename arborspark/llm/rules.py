"""Quality rules as a short-circuit cascade.

Each rule rejects a document.  On a sample, every rule's CPU time in tasks is measured, and which rules reject which rows; the
cascade then asks the rule with the most rejections per cost first, after it the one with the most among what it
leaves, and so on.  A document leaves at the first rule that rejects.  The order changes what the cascade costs,
never what it keeps.  Counts that several rules need are computed once a text.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.common import cut

#: Letters of scripts that don't part words by blanks.
UNSPACED = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


@dataclass(frozen=True)
class RuleCost:
    name: str
    seconds: float
    rejected: float


#: Which rules reject a row, in their order, and how many such rows there are.
Patterns = list[tuple[tuple[bool, ...], int]]


def _count(text: Column, characters: str) -> Column:
    """How many of a class's characters there are in the text."""
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def _single(text: Column, *characters: str) -> Column:
    """The same for a few ASCII characters, by the length that is gone without them."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def features(text: Column) -> dict[str, Column]:
    """What several rules need of a text: its characters, line ends and words, which are white space plus one."""
    return {"size": F.greatest(F.length(text), F.lit(1)).cast("double"), "ends": _single(text, "\n"), "words": (_single(text, " ", "\n") + 1).cast("double")}


def default_rules(text_col: str = "text", counted: dict[str, Column] | None = None) -> list[Rule]:
    """Rules over a text column, whose features may stand in columns of their own.

    A null text or one of white space alone is rejected.  All ratios are over the whole text; letters are those of any script.
    """
    t = F.col(text_col)
    counted = features(t) if counted is None else counted
    size, ends, words = counted["size"], counted["ends"], counted["words"]
    lines = F.split(t, "\n")
    again = F.regexp_count(t, F.lit(r"(?<![^ \n])([^ \n]++)(?=[ \n]\1(?![^ \n]))"))
    return [
        Rule("empty", t.isNull() | ~t.rlike("[^ \\n\\t\\r]")),
        Rule("symbols", _single(t, *"#$%&*") / words > 0.5),
        Rule("bars", _single(t, "|") / words > 0.2),
        Rule("shouting", _single(t, "!") / words > 0.3),
        Rule("capitals", _count(t, "\\p{Lu}") / size > 0.4),
        Rule("letters", (size - _count(t, "^\\p{L}")) / size < 0.4),
        Rule("word_length", ((size - words + 1) / words > 40) & (_count(t, UNSPACED) / size < 0.3)),
        Rule("repeated_lines", F.when(ends >= 3, F.size(F.array_distinct(lines)) / (ends + 1) < 0.5).otherwise(False)),
        Rule("repeated_words", (words >= 10) & (again / words > 0.2)),
    ]


def _cpu_seconds(spark: SparkSession, job) -> float:
    """CPU seconds that a job's tasks took; without what planning and scheduling took."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "rule costs")
    try:
        job()
    finally:
        context._jsc.clearJobGroup()
    scala = context._jsc.sc()
    scala.listenerBus().waitUntilEmpty()
    stages = {s for j in context.statusTracker().getJobIdsForGroup(group) for s in context.statusTracker().getJobInfo(j).stageIds}
    known = {x.stageId(): x for x in (scala.statusStore().lastStageAttempt(s) for s in stages)}
    return sum(x.executorCpuTime() for x in known.values()) / 1e9


def measure(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 2000, runs: int = 2, seed: int = 7) -> tuple[list[RuleCost], Patterns]:
    """Each rule's CPU seconds for the sample, above those of a scan, and its share of rejections; and which rules reject together.

    The sample holds about ``sample_rows`` rows, drawn evenly from the whole table.  Of an empty table all shares are 0.
    """
    spark, n = docs.sparkSession, docs.count()
    sample = cut(docs.sample(min(1.0, sample_rows / n), seed)) if n > sample_rows else cut(docs)
    rejects = [F.coalesce(r.rejects, F.lit(False)) for r in rules]
    rows = sample.groupBy(*[c.alias(f"r{i}") for i, c in enumerate(rejects)]).count().collect()
    patterns = [(tuple(bool(x) for x in r[:-1]), r[-1]) for r in rows]
    kept = sum(c for _, c in patterns)
    width = F.sum(F.crc32(F.to_json(F.struct(*[F.col(c) for c in sorted(set(docs.columns))][:1]))))
    run = lambda condition: min(_cpu_seconds(spark, lambda: sample.agg(F.count_if(condition), width).collect()) for _ in range(runs))
    base = run(F.lit(False))
    costs = []
    for i, rule in enumerate(rules):
        found = sum(c for p, c in patterns if p[i])
        costs.append(RuleCost(rule.name, max(run(rejects[i]) - base, 1e-4), found / kept if kept else 0.0))
    return costs, patterns


def estimate(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 2000, runs: int = 2, seed: int = 7) -> list[RuleCost]:
    """The costs of ``measure``."""
    return measure(docs, rules, sample_rows, runs, seed)[0]


def order(rules: Sequence[Rule], costs: Sequence[RuleCost], patterns: Patterns | None = None) -> list[Rule]:
    """The rules by rejections per second, most first; ties by name.  With patterns, rejections are those among what the rules before leave."""
    by = {c.name: c for c in costs}
    if patterns is None:
        return sorted(rules, key=lambda r: (-by[r.name].rejected / by[r.name].seconds, r.name))
    left, todo, out = list(patterns), dict(enumerate(rules)), []
    while todo:
        gain = lambda i: sum(c for p, c in left if p[i]) / by[todo[i].name].seconds  # noqa: B023, E731
        i = min(todo, key=lambda i: (-gain(i), -by[todo[i].name].rejected / by[todo[i].name].seconds, todo[i].name))
        left = [x for x in left if not x[0][i]]
        out.append(todo.pop(i))
    return out


def cascade(rules: Sequence[Rule]) -> Column:
    """True for a document that no rule rejects.  The expression stops at the first rule that rejects."""
    keep = F.lit(True)
    for rule in reversed(rules):
        keep = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(False)).otherwise(keep)
    return keep


def _judged(docs: DataFrame, text_col: str, rules: Sequence[Rule] | None, sample_rows: int, flag: str) -> DataFrame:
    """``docs`` with the cascade's decision in a new column."""
    columns = docs.columns
    if rules is None:
        prefix = "_"
        while any(c.startswith(prefix) for c in columns):
            prefix += "_"
        counted = features(F.col(text_col))
        docs = docs.select("*", *[c.alias(prefix + name) for name, c in counted.items()])
        rules = default_rules(text_col, {name: F.col(prefix + name) for name in counted})
    return docs.select(*columns, cascade(order(rules, *measure(docs, rules, sample_rows))).alias(flag))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """(doc_id, keep) for every row.

    - A null id stays as null; a null, empty or blank text is rejected.
    - Repeated rows are judged one by one and alike; long texts whole; no rows in, no rows out.
    - Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _judged(docs, "text", rules, sample_rows, "keep").select("doc_id", "keep")


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The rows that the cascade keeps, with all their columns, whatever their names.

    - A row with a null, empty or blank text goes; a null id doesn't matter.
    - Repeated rows are judged alike and stay as often; long texts are judged whole; no rows in, no rows out.
    """
    flag = "_keep"
    while flag in docs.columns:
        flag += "_"
    return _judged(docs, text_col, rules, sample_rows, flag).filter(F.col(flag)).drop(flag)


_WORDS = "(length(text) - length(translate(text, ' ' || chr(10), '')) + 1)::double"
SQL = f"""
select doc_id, not coalesce(
    text is null or translate(text, ' ' || chr(10) || chr(9) || chr(13), '') = ''
    or (length(text) - length(translate(text, '#$%&*', ''))) / {_WORDS} > 0.5
    or (length(text) - length(translate(text, '|', ''))) / {_WORDS} > 0.2
    or (length(text) - length(translate(text, '!', ''))) / {_WORDS} > 0.3
    or (length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g'))) / greatest(length(text), 1)::double > 0.4
    or length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / greatest(length(text), 1)::double < 0.4
    or (length(text) - length(text) + length(translate(text, ' ' || chr(10), ''))) / {_WORDS} > 40 and length(regexp_replace(text, '[^\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Thai}}\\p{{Lao}}\\p{{Khmer}}\\p{{Myanmar}}]', '', 'g')) / greatest(length(text), 1)::double < 0.3
    or (len(string_split(text, chr(10))) > 3 and len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10)))::double < 0.5)
    or ({_WORDS} >= 10 and len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] and w[i] <> '')) / {_WORDS} > 0.2), false) as keep
from (select doc_id, text, string_split(replace(text, chr(10), ' '), ' ') as w from documents)
"""
