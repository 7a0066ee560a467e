"""Edit integrity: multiset differences of what two versions of a text say.

Both versions stay in one row; bags are arrays, differences come from counts of distinct
values, so there is no shuffle.  ``bag_diff_rows`` is the relational form for bags that are
tables.  Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions import text as T
from tessera.operators.features import once

#: Bag, patterns with flags, code, severity.
BAGS = (
    ("numbers", ((L.NUMBER, T.U),), "numeric-change", "high"),
    ("dates", ((L.DATE, T.U),), "date-change", "high"),
    ("currencies", ((L.CURRENCY, T.UI),), "currency-change", "high"),
    ("urls", ((L.URL, T.UI),), "url-change", "high"),
    ("measures", ((L.MEASURE, T.UI),), "measurement-change", "high"),
    ("entities", ((L.ENTITY, T.U), (L.ACRONYM, T.U)), "entity-like-change", "medium"),
)
LOSSES = (("negation", "negation-loss", "high"), ("condition", "condition-loss", "high"), ("attribution", "attribution-loss", "high"), ("causal", "causal-relation-change", "medium"))


def bag(text: Column, name: str) -> Column:
    """The values of a bag, repeats included."""
    patterns = next(p for n, p, _, _ in BAGS if n == name)
    found = F.concat(*[T.matches(text, p, flags) for p, flags in patterns])
    return F.transform(found, lambda x: T.normalize_url(x) if name == "urls" else T.folded(x))


def quotes(text: Column) -> Column:
    inside = [F.regexp_extract_all(text, F.lit(T.U + L.QUOTE), F.lit(k)) for k in (1, 2)]
    return F.transform(F.arrays_zip(inside[0].alias("a"), inside[1].alias("b")), lambda q: T.folded(F.when(F.coalesce(q["a"], F.lit("")) != "", q["a"]).otherwise(q["b"])))


def minus(left: Column, right: Column) -> Column:
    """What is left of a bag: each value as often as it is more frequent on the left."""
    often = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    more = F.transform(F.array_distinct(left), lambda x: F.struct(x.alias("v"), F.greatest(often(left, x) - often(right, x), F.lit(0)).alias("n")))
    return F.flatten(F.transform(F.filter(more, lambda m: m["n"] > 0), lambda m: F.array_repeat(m["v"], m["n"])))


def bag_diff_rows(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows removed and rows added, with multiplicity."""
    return before.exceptAll(after), after.exceptAll(before)


def phrase_count(folded: Column, family: str, words: dict[str, tuple[str, ...]] = L.MODALITY) -> Column:
    total = F.lit(0).cast("long")
    for phrase in words[family]:
        total = total + T.count(folded, rf"(?<![\p{{L}}\p{{N}}_])\Q{phrase}\E(?![\p{{L}}\p{{N}}_])")
    return total


def integrity_findings(pairs: DataFrame, before: str = "source", after: str = "edited") -> DataFrame:
    """One row for each finding: columns of ``pairs``, then ``code, severity, removed, added, before_count, after_count``."""
    df = once(pairs, b_text=F.coalesce(F.col(before), F.lit("")), a_text=F.coalesce(F.col(after), F.lit("")))
    bags = {}
    for name, *_ in BAGS:
        bags |= {f"b_{name}": bag(F.col("b_text"), name), f"a_{name}": bag(F.col("a_text"), name)}
    df = once(df, **bags, b_quotes=quotes(F.col("b_text")), a_quotes=quotes(F.col("a_text")), b_fold=T.folded(F.col("b_text")), a_fold=T.folded(F.col("a_text")))
    df = once(df, **{f"{side}_{family}": phrase_count(F.col(f"{side}_fold"), family) for family in L.MODALITY for side in "ba"})
    texts, counts = "array<string>", "map<string,bigint>"

    def row(code: str, severity: str, removed=None, added=None, was=None, now=None) -> Column:
        typed = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), typed(removed, texts).alias("removed"), typed(added, texts).alias("added"), typed(was, counts).alias("before_count"), typed(now, counts).alias("after_count"))

    found = []
    for name, _, code, severity in BAGS:
        removed, added = minus(F.col(f"b_{name}"), F.col(f"a_{name}")), minus(F.col(f"a_{name}"), F.col(f"b_{name}"))
        found.append(F.when((F.size(removed) > 0) | (F.size(added) > 0), row(code, severity, removed, added)))
    degrees = lambda side: F.create_map(F.lit("weak"), F.col(f"{side}_weak"), F.lit("strong"), F.col(f"{side}_strong"))
    weaker = F.col("a_weak") < F.col("b_weak")
    found.append(F.when(weaker & (F.col("a_strong") > F.col("b_strong")), row("modality-strengthened", "high", was=degrees("b"), now=degrees("a"))).when(weaker, row("modality-marker-loss", "high", was=degrees("b"), now=degrees("a"))))
    for family, code, severity in LOSSES:
        one = lambda side, family=family: F.create_map(F.lit(family), F.col(f"{side}_{family}"))
        found.append(F.when(F.col(f"a_{family}") < F.col(f"b_{family}"), row(code, severity, was=one("b"), now=one("a"))))
    lost = minus(F.col("b_quotes"), F.col("a_quotes"))
    found.append(F.when(F.size(lost) > 0, row("quote-changed-or-removed", "medium", removed=lost)))
    return df.withColumn("f", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))).select(*pairs.columns, "f.*")
