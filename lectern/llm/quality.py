"""Quality rules as a short-circuit cascade.

Each rule is a Spark SQL predicate that rejects a text.  On a bounded sample
every rule is timed, warm, and its rejections are noted; then, greedily, the next rule
is the one with most rejections among the sample's survivors per second.  The
whole table runs the rules in that order as one CASE, so a row stops at its
first rejection.  The order changes the time, never the result.

Defined cases: a null or blank text is rejected; repeated rows get equal rows;
an empty table gives an empty result and any order; other columns are ignored.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, ensure_columns

BLANK = r" \\t\\n\\x0B\\f\\r"
WORDS = f"array_remove(split(text, '[{BLANK}]+'), '')"
GAPS = r"(2 * length(text) - length(replace(text, ' ', '')) - length(replace(text, '\n', '')))"
BREAKS = r"(length(text) - length(replace(text, '\n', '')))"
LINES = r"filter(split(text, '\\n'), x -> trim(x) <> '')"
TWICE = rf"regexp_count(text, '(?<![^{BLANK}])([^{BLANK}]++)(?=[{BLANK}]++\\1(?![^{BLANK}]))')"

#: name -> predicate over ``text`` that is true where the text is rejected.  Cheap necessary conditions stand first
RULES = {
    "symbols": r"length(regexp_replace(text, '[^#*&%$|~^<>{}=+\\\\]+', '')) > 0.05 * length(text)",
    "exclamations": "length(text) - length(replace(text, '!', '')) > 0.05 * length(text)",
    "capitals": "length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]+', '')) > 0.4 * length(text)",
    "digits": "length(regexp_replace(text, '[^0-9]+', '')) > 0.3 * length(text)",
    "broken_characters": "length(text) - length(replace(text, '�', '')) > 0.01 * length(text)",
    "word_length": f"{GAPS} not between (length(text) - 25) / 26 and (length(text) - 1.5) / 2.5",  # 1.5 to 25 characters a word
    "ellipses": rf"(length(text) - length(replace(text, '...\n', ''))) / 4 + (length(text) - length(replace(text, '…\n', ''))) / 2 > 0.3 * ({BREAKS} + 1)",
    "bullets": rf"{BREAKS} > 0 and regexp_count(text, '\\n[ \\t]*[-*•]') > 0.9 * ({BREAKS} + 1)",
    "repeated_lines": f"{BREAKS} >= 3 and element_at(transform(array({LINES}), a -> size(a) >= 4 and size(array_distinct(a)) < 0.5 * size(a)), 1)",
    # vocabularies grow about as the square root of long texts, so beyond 1,000 words the limit does too
    "repeated_words": f"element_at(transform(array({WORDS}), a -> size(a) >= 20 and size(array_distinct(a)) < 0.3 * least(size(a), sqrt(1000 * size(a)))), 1)",
    "adjacent_repeats": f"element_at(transform(array({TWICE}), n -> n > 1 and size({WORDS}) >= 5 and n > 0.3 * size({WORDS})), 1)",
}


def _rounded(seconds: float) -> float:
    """The nearest power of the square root of 2, 2 ms at least, so that noise seldom changes an order."""
    return 2.0 ** (round(2 * math.log2(max(seconds, 0.002))) / 2)


def measure(docs: DataFrame, rules: dict[str, str], rows: int, id_col: str, text_col: str, repeats: int = 2) -> list[str]:
    """Names of the rules in the order of rejections among survivors per second, on a sample of about ``rows``.

    Each rule runs over the sample in one task, once to compile and ``repeats`` times
    for its cost, the least of these; equal scores go by cost, then by name.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("trim(text) <> ''")
    total = docs.count()
    sample = cut(base.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(total, 1)))).select("text").limit(2 * rows), "quality-sample")
    sample = sample.coalesce(1)
    took = {}
    for name, rule in {"": "true", **rules}.items():
        counted = sample.agg(F.count_if(F.expr(rule)))
        times = []
        for _ in range(1 + repeats):  # the first run compiles
            start = time.perf_counter()
            counted.collect()
            times.append(time.perf_counter() - start)
        took[name] = min(times[1:])
    cost = {n: _rounded(took[n] - took[""]) for n in rules}
    hits = sample.select(*(F.expr(r).alias(n) for n, r in rules.items())).collect()
    left, order = list(rules), []
    while left:
        best = max(left, key=lambda n: (sum(h[n] for h in hits) / cost[n], -cost[n], n))
        order.append(best)
        left.remove(best)
        hits = [h for h in hits if not h[best]]
    return order


def quality_cascade(docs: DataFrame, rules: dict[str, str] | None = None, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and keep for every row."""
    ensure_columns(docs, id_col, text_col)
    rules = rules or RULES
    order = measure(docs, rules, sample_rows, id_col, text_col)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select(F.col("id").alias("doc_id"), _case(order, rules).alias("keep"))


def _case(order: list[str], rules: dict[str, str]):
    return F.expr("case when text is null or trim(text) = '' then false " + " ".join(f"when {rules[n]} then false" for n in order) + " else true end")
