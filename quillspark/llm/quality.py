"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate that rejects. Its cost (seconds, from the raw text on) and selectivity (share rejected) are measured
on a sample; rules then run in the order of rejection per cost, and a row stops at the first that rejects it. The verdict
doesn't depend on the order, only the time does. ``assess`` returns the counts of words, symbols, lines and repeats of every row; what
other rules need is computed within the cascade, for rows that no rule before has rejected.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WHITE_RE

#: Characters that count as symbols: fixed values of the contract.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a predicate over the columns of ``counts`` in its groups; null counts as not rejecting."""

    name: str
    rejects: str
    groups: tuple[str, ...] = ()


#: Counts by group; a rule computes the groups that it needs.
GROUPS = {"words": ("n_words", "word_chars"), "symbols": ("n_symbols",), "lines": ("n_lines", "n_dup_lines"), "repeats": ("n_repeat_words",), "capitals": ("n_capitals",), "letters": ("letters",)}
#: The two rules that the contract calls the base.
BASE = (Rule("few_words", "n_words < 50", ("words",)), Rule("repeated_words", "100 * n_repeat_words > 50 * n_words", ("words", "repeats")))
#: Thresholds of production, over whole texts.
RULES = (
    *BASE,
    Rule("symbols", "10 * n_symbols > 3 * n_words", ("words", "symbols")),
    Rule("repeated_lines", "5 * n_dup_lines > 2 * n_lines", ("lines",)),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", ("words",)),
    Rule("capitals", "n_capitals > 0.5 * word_chars", ("words", "capitals")),
    Rule("no_letters", "NOT letters", ("letters",)),
)


def _groups(rules) -> tuple[str, ...]:
    return tuple(g for g in GROUPS if any(g in r.groups for r in rules))


def counts(df: DataFrame, text: str = "text", groups: tuple[str, ...] = ("words", "symbols", "lines", "repeats")) -> DataFrame:
    """Adds the counts of ``groups``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals (long) and letters (boolean) of the whole text.

    A null text has no words and no lines. A window of three words is known by a 64-bit hash less the bits of its place;
    equal hashes are confirmed by the words themselves. Columns of these names in ``df`` are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = df
    if "words" in groups or "repeats" in groups:
        d = d.withColumn("__w", F.array_remove(F.split(t, f"{WHITE_RE}+"), ""))
        d = d.withColumn("n_words", F.size("__w").cast("long"))
        d = d.withColumn("word_chars", F.length(F.translate(t, WHITE, "")).cast("long"))
    if "repeats" in groups:
        # places take the low bits that the text's own length needs; the hash keeps the others
        d = d.withColumn("__bits", F.length(F.bin("n_words")))
        d = d.withColumn(
            "__s",
            F.sort_array(F.expr("CASE WHEN n_words >= 4 THEN transform(sequence(0, cast(n_words AS int) - 3), i -> shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __bits) | cast(i AS bigint)) ELSE cast(array() AS array<bigint>) END")),
        )
        same = "(i > 0 AND shiftright(x, __bits) = shiftright(__s[i - 1], __bits) AND {eq1}) OR (i + 1 < size(__s) AND shiftright(x, __bits) = shiftright(__s[i + 1], __bits) AND {eq2})"
        at = lambda y: f"cast({y} & (shiftleft(1L, __bits) - 1) AS int)"
        equal = lambda a, b: " AND ".join(f"__w[{at(a)} + {k}] = __w[{at(b)} + {k}]" for k in range(3))
        twice = same.format(eq1=equal("x", "__s[i - 1]"), eq2=equal("x", "__s[i + 1]"))
        d = d.withColumn("__p", F.expr(f"sort_array(transform(filter(__s, (x, i) -> {twice}), x -> {at('x')}))"))
        d = d.withColumn("n_repeat_words", F.expr("cast(coalesce(aggregate(transform(__p, (p, i) -> CASE WHEN i + 1 < size(__p) THEN least(3, __p[i + 1] - p) ELSE 3 END), 0, (a, x) -> a + x), 0) AS bigint)"))
    if "lines" in groups:
        d = d.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WHITE_RE[1:-1]}]")))
        d = d.withColumn("n_lines", F.size("__lines").cast("long"))
        d = d.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("__lines")))
    if "symbols" in groups:
        d = d.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    if "capitals" in groups:
        d = d.withColumn("n_capitals", F.length(F.regexp_replace(t, r"[^\p{Lu}]", "")).cast("long"))
    if "letters" in groups:
        d = d.withColumn("letters", t.rlike(r"\p{L}"))
    return d.drop("__w", "__lines", "__bits", "__s", "__p")


def failed(rules: tuple[Rule, ...]) -> Column:
    """True where any of the rules rejects; never null."""
    out = F.lit(False)
    for r in rules:
        out = out | F.coalesce(F.expr(r.rejects), F.lit(False))
    return out


def order_by_yield(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, text: str = "text") -> list[tuple[Rule, float, float]]:
    """Rules with their cost (seconds) and selectivity on about ``sample_rows`` random rows, best rejection per cost first.

    The sample holds raw texts, so a rule's time is that of the counts it needs, from the text on. Ties keep the given order.
    """
    rows = docs.select(F.col(text).alias("text"))
    n = rows.count()
    sample = (rows.sample(min(1.0, sample_rows / n), 7) if n else rows).persist()
    try:
        if not (n := sample.count()):
            return [(r, 0.0, 0.0) for r in rules]

        def timed(f) -> tuple[float, int]:
            """The faster of two runs, of which the first compiles."""
            took = []
            for _ in range(2):
                began = time.perf_counter()
                hit = f()
                took.append(time.perf_counter() - began)
            return min(took), hit

        idle, _ = timed(lambda: sample.agg(F.count("*")).collect()[0][0])
        out = []
        for r in rules:
            # what is counted must be computed once a row, before the predicate
            found = counts(sample, "text", _groups((r,))).withColumn("__row", F.monotonically_increasing_id()).where("__row >= 0")
            cost, hit = timed(lambda found=found, r=r: found.agg(F.count_if(failed((r,)))).collect()[0][0])
            out.append((r, max(1e-4, cost - idle), hit / n))
    finally:
        sample.unpersist()
    return sorted(out, key=lambda x: -x[2] / x[1])


#: The counts that only rules need, as SQL over the text.
LAZY = {"n_capitals": r"length(regexp_replace(coalesce(text, ''), '[^\\p{Lu}]', ''))", "letters": r"(coalesce(text, '') RLIKE '\\p{L}')"}


def cascade(counted: DataFrame, rules: list[Rule], lazy: dict[str, str] | None = None) -> DataFrame:
    """Adds ``rejected_by``: the first rule, in the given order, that rejects; null for a row that is kept.

    A count of ``lazy`` is put into its rule's own branch, which a row reaches only if no earlier rule rejects it.
    """
    if not rules:
        return counted.withColumn("rejected_by", F.lit(None).cast("string"))

    def rejects(r: Rule) -> Column:
        sql = r.rejects
        for name, by in (lazy or {}).items():
            sql = re.sub(rf"\b{name}\b", lambda _, by=by: by, sql)
        return F.expr(sql)

    first, *rest = rules
    case = F.when(rejects(first), F.lit(first.name))
    for r in rest:
        case = case.when(rejects(r), F.lit(r.name))
    return counted.withColumn("rejected_by", case)


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """All columns of ``docs`` with the counts, ``base_failed``, ``rejected_by`` and ``kept``.

    Null or empty texts fail the base; ids may be null, rows may repeat, an empty table gives an empty result. Columns of
    ``docs`` that have a name which is added here are replaced.
    """
    counted = counts(docs.drop("base_failed", "rejected_by", "kept"))
    ordered = [r for r, _, _ in order_by_yield(docs, rules, sample_rows)]
    return cascade(counted, ordered, LAZY).withColumn("base_failed", failed(BASE)).withColumn("kept", F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with its own columns: the short circuit.

    Rules come by rejection per cost. Each computes the counts that no earlier one has, and for a row that was rejected
    from no text, so what comes after a rejection costs nothing. An explode of one row parts the steps: no optimizer
    moves a count across it or computes one twice. Null and empty texts go; rows may repeat; an empty table stays empty.
    """
    inner = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"), F.lit(None).cast("string").alias("__by"))
    have: tuple[str, ...] = ()
    for rule, _, _ in order_by_yield(docs, rules, sample_rows):
        new = tuple(g for g in _groups((rule,)) if g not in have)
        names = [c for g in have for c in GROUPS[g]]
        if new:
            if "repeats" in new and "words" not in new:
                new = ("words", *new)
            inner = counts(inner.withColumn("__t", F.when(F.col("__by").isNull(), F.col("text"))), "__t", new)
            have = tuple(g for g in GROUPS if g in have or g in new)
            names = [c for g in have for c in GROUPS[g]]
        by = F.coalesce("__by", F.when(F.expr(rule.rejects), F.lit(rule.name))).alias("__by")
        inner = inner.select("__row", "text", F.explode(F.array(F.struct(by, *names))).alias("__x")).select("__row", "text", "__x.__by", *[f"__x.{c}" for c in names])
    return inner.where("__by IS NULL").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
