"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Every rule has an expression. A sample of rows (`SAMPLE`, whatever the table's size) gives
how often each rule rejects, and timed passes over it what its expression costs. Rules run
in the order of rejections per cost, nested so that a row stops at its first rejection: a
later rule, such as the count of letters, is worked out for survivors alone. The verdict is
the same in any order; the order only saves work. The counts that every row returns are no
part of the cascade.
"""

from __future__ import annotations

import statistics
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia.llm.common import BLANKS, fresh, let, released, words, written

SYMBOLS = "#*$%&|<>"


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return let(full, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def n_repeat_words(ws: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the text."""

    def windows(a):
        return F.transform(F.slice(a, 1, F.greatest(F.size(a) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2)))

    def covered(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s):
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def spread(p):
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x)

        return let(let(pairs, repeated), spread)

    def count(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return let(let(ws, windows), count).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """documents with n_words and the four base features; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    (ws,) = fresh(docs, "quality_words")
    return docs.drop(*FEATURES).withColumn(ws, words(text)).withColumns({
        "n_words": F.size(ws).cast("long"), "word_chars": word_chars(text), "n_symbols": n_symbols(text),
        "n_dup_lines": n_dup_lines(text), "n_repeat_words": n_repeat_words(F.col(ws)),
    }).drop(ws)


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LETTERS = "length(regexp_replace(coalesce(text, ''), '[^\\\\p{L}]', ''))"
_LINES = "size(split(coalesce(text, ''), '\n', -1))"
#: The contract's rules: they and the features they read are worked out for every row.
BASE_RULES: dict[str, str] = {"few_words": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
#: Rules of the cascade: true where a row is rejected. Loose bounds, to spare plain prose.
RULES: dict[str, str] = {
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": f"2 * n_dup_lines > {_LINES}",
    "long_words": "word_chars > 15 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "few_letters": f"{_LETTERS} * 2 < word_chars",
}
#: Rows of the sample on which rules are ordered, timed passes of each rule, copies of the sample's rows in a pass.
SAMPLE, PASSES, TIMES = 500, 3, 8


def sample_of(docs: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows of documents at most, by the hash of the doc_id; their number doesn't grow with the table."""
    n = docs.count()
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    return docs.filter(at < F.lit(int(min(1.0, rows / max(n, 1)) * (1 << 30)))).limit(4 * rows)


def rule_order(docs: DataFrame, rules: dict[str, str], rows: int = SAMPLE) -> list[str]:
    """Rule names by rejections per cost on a sample of documents, best first.

    The features are worked out for the sample alone, which is written once. A rule's
    rejections come from one aggregation; its cost is the median time of some passes that
    evaluate its expression over copies of the sample's texts, less that of passes without
    a rule. With an empty sample the given order stands.
    """
    sample = written(features(sample_of(docs.select("doc_id", "text"), rows)), "rule-sample")
    got = sample.agg(F.count("*").alias("n"), *[F.sum(F.expr(r).cast("long")).alias(k) for k, r in rules.items()]).first()
    if not got["n"]:
        released(sample)
        return list(rules)
    copies = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(rule):
        taken = []
        for _ in range(PASSES):
            began = time.perf_counter()
            copies.agg(F.sum(F.expr(rule).cast("int"))).collect()
            taken.append(time.perf_counter() - began)
        return statistics.median(taken)

    nothing = seconds("doc_id is null")
    gain = {k: (got[k] or 0) / max(seconds(r) - nothing, 1e-3) for k, r in rules.items()}
    released(sample)
    return sorted(rules, key=lambda k: (-gain[k], k))


def cascade(rules: dict[str, str], order: list[str]) -> Column:
    """Name of the first rule, in order, that rejects the row; null where all pass.

    Nested, so a rule's expression is evaluated only where no rule before it rejects.
    """
    out = F.lit(None).cast("string")
    for k in reversed(order):
        out = F.when(F.expr(rules[k]), F.lit(k)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """documents with the features, base_failed, failed_rule and kept.

    base_failed: n_words < 50 or 100 * n_repeat_words > 50 * n_words; failed_rule names a
    base rule there. kept is false there, else whether no rule of RULES rejects. Null texts
    count as empty and fail; repeated rows give repeated rows; no rows give no rows;
    clashing columns are replaced.
    """
    plain = docs.drop("base_failed", "failed_rule", "kept")
    order = rule_order(plain, RULES, rows)
    base = F.expr(" or ".join(f"({r})" for r in BASE_RULES.values()))
    failed = cascade(BASE_RULES | RULES, [*BASE_RULES, *order])
    return features(plain).withColumns({"base_failed": base, "failed_rule": failed}).withColumn("kept", F.col("failed_rule").isNull())
