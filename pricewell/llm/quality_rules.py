"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a document whose measure is over (or under) a cut. For every stratum the cuts are taken
from labelled holdouts: going from the loosest cut to the strictest, a cut stands while the exact binomial
tail P(at most the false rejections seen | share ALPHA) stays under the level, and the first that fails
ends the walk (fixed-sequence testing, so the cuts of a rule need no correction among themselves). The
level is DELTA divided by the number of strata times rules (Bonferroni). With probability 1 - DELTA at
least, in every stratum at once, each rule then rejects at most a share ALPHA of the good documents, and all
rules together at most the number of rules times ALPHA. All cuts that stand are certified at once, so any may
be taken: of those that reject the most labelled bad documents, the loosest is.

A stratum with fewer than least_labels() good labels can't certify any cut, so its part of DELTA is never
spent. With pooled=True one such part pays for the same walk over the labels of all strata together, and
its cuts hold in each stratum that has no cut of its own for the rule, up to the first that rejects more
than a share ALPHA of that stratum's own good labels. What is certified for them is the share among the
good documents of all languages, not of that language alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Strata are these languages and, together, all others: a fixed list, so the table of cuts is small at any size.
STRATA = ("en", "de", "fr", "es")
OTHER = "other"
#: Share of good documents that a rule may reject, and the risk of missing that anywhere.
ALPHA, DELTA = 0.02, 0.05
#: Least words, and the share of repeated words in percent that fails a document whatever its labels say.
MIN_WORDS, MAX_REPEATED = 50, 50
#: rule -> (measure, cuts from the loosest to the strictest); measures are whole numbers.
RULES = {
    "symbols": ("1000 * n_symbols DIV n_words", (2000, 1000, 500, 300, 200, 100, 50)),
    "dup_lines": ("1000 * n_dup_lines DIV greatest(n_lines, 1)", (900, 800, 700, 600, 500, 400, 300, 200)),
    "repeats": ("1000 * n_repeat_words DIV n_words", (500, 450, 400, 350, 300, 250, 200)),
    "long_words": ("100 * word_chars DIV n_words", (2000, 1500, 1200, 1000, 900, 800, 700)),
    "short_words": ("-100 * word_chars DIV n_words", (-150, -200, -250, -300, -350, -400)),
}
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the list holds at least twice."""
    place = F.sequence(F.lit(0), F.size(words) - 3)
    hashed = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    window = lambda i: F.struct(hashed(i).alias("h"), F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    twice = lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
    # a window reaches over three words or up to the next such window
    reach = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    exact = _let(F.sort_array(F.transform(place, window)), lambda s: _let(F.sort_array(F.transform(twice(s), lambda x: x["i"])), reach))
    unique = _let(F.transform(place, hashed), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) < 4, F.lit(0)).when(unique, F.lit(0)).otherwise(exact)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs of characters other than ASCII white space; lines are split at \\n and count if they
    hold a word; a line equal to an earlier one is a duplicate. Null texts are as empty ones: all zero.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = lambda drop: F.length(text) - F.length(F.translate(text, drop, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    by_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")))
    by_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    lang = F.col(lang_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.when(lang.isin(*STRATA), lang).otherwise(F.lit(OTHER)).alias("stratum"),
        by_words.alias("w"),
        by_lines.alias("l"),
        (F.length(text) - length(BLANKS)).cast("long").alias("not_blank"),
        length(SYMBOLS).cast("long").alias("n_symbols"),
    ).select(
        "id",
        "stratum",
        F.col("w.n").cast("long").alias("n_words"),
        F.col("not_blank").alias("word_chars"),
        "n_symbols",
        F.col("l.n").cast("long").alias("n_lines"),
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.repeated").cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words")


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, stepped back."""
    z = x + 8.0
    back = sum((F.ln(x + float(k)) for k in range(1, 8)), F.ln(x))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - back


def binomial_tail(x: Column, n: Column, share: float) -> Column:
    """P(X <= x) for X binomial (n, share): the largest term times the sum of the ratios of those below.

    1 where x is no less than the mean: such a cut never passes a test.
    """
    xd, nd, odds = x.cast("double"), n.cast("double"), (1 - share) / share
    log_top = _log_gamma(nd + 1) - _log_gamma(xd + 1) - _log_gamma(nd - xd + 1) + xd * math.log(share) + (nd - xd) * math.log1p(-share)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc, j):
        term = acc["term"] * (xd - j + 1) / (nd - xd + j) * odds
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(x > 0, F.sequence(F.lit(1), F.greatest(x, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(xd >= nd * share, F.lit(1.0)).otherwise(F.exp(log_top) * F.aggregate(steps, zero, add, lambda a: a["total"]))


def least_labels(alpha: float = ALPHA, delta: float = DELTA) -> int:
    """How many good labels, none of them rejected, certify a cut: 308 by default."""
    return math.ceil(math.log(delta / ((len(STRATA) + 1) * len(RULES))) / math.log1p(-alpha))


def cuts(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", label_col: str = "quality", pooled: bool = False) -> DataFrame:
    """For each stratum and rule with a certified cut: stratum, rule, cut, false_rejections, n_good, tail, true_rejections, pooled.

    Counts run over all labelled documents (label 1: good, 0: bad) that pass the base rules. Null labels or ids
    are not used; an id labelled twice counts as good only if each label says so. With pooled=True strata
    without a cut of their own take that of all strata together, and the counts are those of all strata.
    """
    label = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("good"))
    seen = measured.where(~base_failed()).join(label, "id")
    over = [(rule, k, good, F.count_if(F.expr(f"good = {good} AND {m} > {c}"))) for rule, (m, cs) in RULES.items() for k, c in enumerate(cs) for good in (1, 0)]
    total = seen.groupBy("stratum").agg(F.count_if(F.col("good") == 1).alias("n"), *[f.alias(f"{r}_{k}_{good}") for r, k, good, f in over])
    # strata without good labels too: they may take a pooled cut
    every = measured.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in (*STRATA, OTHER)])).alias("stratum"))
    total = every.join(total, "stratum", "left").na.fill(0)
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(k).alias("k"), F.lit(RULES[r][1][k]).cast("long").alias("cut"), F.col(f"{r}_{k}_1").alias("x"), F.col(f"{r}_{k}_0").alias("y")) for r, k, good, _ in over if good])
    level = delta / ((len(STRATA) + 1) * len(RULES))
    walk, all_strata = Window.partitionBy("stratum", "rule").orderBy("k"), Window.partitionBy("rule", "k")
    # the pooled walk needs the unspent part of a stratum with too few labels
    unspent = F.count_if(F.col("n") < least_labels(alpha, delta)).over(all_strata) > 0
    allowed = F.lit(pooled) & (F.col("all_tail") <= level) & F.col("unspent") & (F.col("x") <= F.col("n") * alpha)
    told = lambda p: F.struct("cut", F.col(f"{p}x").alias("false_rejections"), F.col(f"{p}n").alias("n_good"), F.col(f"{p}tail").alias("tail"), F.col(f"{p}y").alias("true_rejections"), F.lit(p != "").alias("pooled"))
    best = lambda p: F.max_by(told(p), F.when(F.col(f"{p}stands"), F.struct(f"{p}y", -F.col("k"))))
    return (
        total.select("stratum", "n", F.explode(tests).alias("t"))
        .select("stratum", "n", "t.*")
        .withColumns({f"all_{c}": F.sum(c).over(all_strata) for c in ("n", "x", "y")} | {"unspent": unspent})
        .withColumns({"tail": binomial_tail(F.col("x"), F.col("n"), alpha), "all_tail": binomial_tail(F.col("all_x"), F.col("all_n"), alpha)})
        .withColumns({"stands": F.min(F.col("tail") <= level).over(walk), "all_stands": F.min(allowed).over(walk)})
        .where("stands OR all_stands")
        .groupBy("stratum", "rule")
        .agg(F.coalesce(best(""), best("all_")).alias("b"))
        .select("stratum", "rule", "b.*")
    )


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", pooled: bool = False) -> DataFrame:
    """measures() of every document with n_words, base_failed, failed (the rules that reject it) and kept.

    kept is false if the base rules fail, else true unless a certified cut rejects. Without labels, or with
    too few to certify a cut, only the base rules reject; pooled is that of cuts(). Documents with null or repeated ids are judged each.
    """
    found = checkpointed(measures(docs, id_col, text_col, lang_col))
    # at most one row for each stratum of the fixed list
    per_stratum = F.broadcast(cuts(found, labels, alpha, delta, id_col, label_col, pooled).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cut")))
    failed = F.filter(F.array(*[F.when(F.expr(f"n_words > 0 AND {m} > {r}"), F.lit(r)) for r, (m, _) in RULES.items()]), lambda x: x.isNotNull())
    judged = found.join(per_stratum, "stratum", "left").withColumn("base_failed", base_failed()).withColumn("failed", failed)
    return judged.select(F.col("id").alias(id_col), "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
