"""URL filters: host and path rules first, then association rules mined with FP-growth.

The labelled URLs are the transactions: their items are URL tokens and the verdict. Labels come from a table,
or else from the host and path rules themselves; then all that stands where those rules look is left out, and a
mined rule must hold under several host suffixes, so that what is mined does not restate the rules where they don't hold. Spark's FP-growth finds the frequent
item sets; rules `tokens -> verdict` that reach the support and confidence wanted, and that no shorter rule
of equal confidence covers, judge the other URLs through an inverted index from token to rules.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: (verdict, host, path): fixed values of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of the model: shares of the labelled URLs and of the URLs with the tokens, tokens in a rule, rules in all.
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS, MAX_RULES = 0.01, 0.9, 4, 5000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(host: Column, path: Column, rules, pick) -> Column:
    """pick(rule) for the longest rule that fits, else null; rules are a short list given by the caller."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
        out = F.when(fits, F.lit(pick(r))).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct items of a URL: scheme, host labels and suffix, path segments without numbers, file ending, query keys."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"^[0-9]+(\.|$)"))
    keys = F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), 1)
    one = lambda name, c: F.when(c != "", F.array(F.concat(F.lit(name), c))).otherwise(F.array().cast("array<string>"))
    many = lambda name, c: F.transform(c, lambda s: F.concat(F.lit(name), s))
    parts = F.concat(
        one("scheme:", F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]{0,20})://", 1)),
        F.when(host != "", many("host:", labels)).otherwise(F.array().cast("array<string>")),
        one("suffix:", F.element_at(labels, -1)),
        many("path:", segments),
        one("ending:", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)),
        many("key:", keys),
    )
    return F.coalesce(F.array_distinct(parts), F.array().cast("array<string>"))


def untested(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(host, path) without what host and path rules look at: as many labels at the end of the host, and segments at the
    start of the path, as the longest rule has. Not only a rule's own words go: where one rule tests `/de/`, `/es/` in
    its place tells no more than which rules could not fit."""
    labels = max([len([x for x in h.split(".") if x]) for _, h, _ in rules], default=0)
    segments = max([len([x for x in p.split("/") if x]) for _, _, p in rules], default=0)
    parts, places = F.split(host, r"\."), F.split(path, "/")
    kept = F.when(F.size(parts) > labels, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - labels, F.lit(0))), ".")).otherwise("")
    return kept, F.array_join(F.slice(places, segments + 2, F.greatest(F.size(places), F.lit(0))), "/")


def free_tokens(url: Column, host: Column, path: Column, rules) -> Column:
    """tokens_of() less all that stands where the rules look."""
    labels, rest = untested(host, path, rules)
    return F.filter(tokens_of(url, labels, rest), lambda t: ~t.startswith("suffix:"))


def widespread(rules: list[tuple], labelled: DataFrame, least: int) -> list[tuple]:
    """The rules whose tokens occur together under at least so many suffixes. labelled: (tokens, suffix). A rule that one
    suffix alone supports has learnt that suffix, not its tokens."""
    if not rules or least < 2:
        return rules

    @F.pandas_udf("array<int>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        all_ = holding(rules)
        for tokens in batches:
            yield tokens.map(all_)

    seen = labelled.where("suffix IS NOT NULL").select("suffix", F.explode(held("tokens")).alias("k")).distinct()
    kept = {r.k for r in seen.groupBy("k").count().where(F.col("count") >= least).collect()}  # at most one row a rule
    return [r for k, r in enumerate(rules) if k in kept]


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, max_rules: int = MAX_RULES) -> list[tuple]:
    """(tokens, verdict, confidence, support) from a table (tokens, verdict); none from an empty one.

    Rules that a shorter one of the same verdict and no less confidence covers are pruned first. The list
    goes to every task, so more than max_rules of the others are an error, not cut.
    """
    verdict = "verdict:"
    items = labelled.where("verdict IS NOT NULL").select(F.array_append("tokens", F.concat(F.lit(verdict), "verdict")).alias("items"))
    if items.isEmpty():
        return []
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = checkpointed(
        model.associationRules.where(F.element_at("consequent", 1).startswith(verdict) & (F.size("antecedent") <= max_tokens))
        .where(~F.exists("antecedent", lambda t: t.startswith(verdict)))
        .select(F.sort_array("antecedent").alias("tokens"), F.expr(f"substring(consequent[0], {len(verdict) + 1})").alias("verdict"), "confidence", "support")
    )
    # the proper subsets of at most max_tokens tokens, as bit masks over their places
    subsets = F.expr("transform(sequence(1, shiftleft(1, size(tokens)) - 2), m -> filter(tokens, (t, i) -> (shiftright(m, i) & 1) = 1))")
    shorter = rules.select(F.col("tokens").alias("covering"), "verdict", F.col("confidence").alias("least"))
    covered = (
        rules.where(F.size("tokens") > 1)
        .select("tokens", "verdict", "confidence", F.explode(subsets).alias("covering"))
        .join(shorter, ["covering", "verdict"])
        .where("least >= confidence")
        .select("tokens", "verdict")
        .distinct()
    )
    found = (
        rules.join(covered, ["tokens", "verdict"], "left_anti")
        .orderBy(F.desc("confidence"), F.size("tokens"), F.desc("support"), F.col("tokens").cast("string"), "verdict")
        .limit(max_rules + 1)
        .collect()
    )
    if len(found) > max_rules:
        raise ValueError(f"more than max_rules = {max_rules} rules after pruning; raise it, or min_support or min_confidence")
    return [(tuple(r.tokens), r.verdict, r.confidence, r.support) for r in found]


def holding(rules: list[tuple]):
    """A function from a URL's tokens to the numbers of the rules that hold.

    Inverted index: each rule stands under its rarest token, so that few are tried.
    """
    uses = defaultdict(int)
    for tokens, *_ in rules:
        for t in tokens:
            uses[t] += 1
    index = defaultdict(list)
    for k, (tokens, *_) in enumerate(rules):
        index[min(tokens, key=lambda t: (uses[t], t))].append((k, frozenset(tokens)))

    def hold(tokens) -> list[int]:
        have = set(tokens)
        return [k for t in have for k, need in index.get(t, ()) if need <= have]

    return hold


def matcher(rules: list[tuple]):
    """A function from a URL's tokens to the verdict of the best rule that holds, or None: that of the greatest
    confidence, then support, then number of tokens, then the first."""
    hold = holding(rules)
    rank = [(-confidence, -support, -len(tokens), k) for k, (tokens, _, confidence, support) in enumerate(rules)]

    def judge(tokens):
        fits = hold(tokens)
        return rules[min(fits, key=rank.__getitem__)][1] if fits else None

    return judge


def url_verdicts(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, max_rules: int = MAX_RULES, labels: DataFrame | None = None, min_suffixes: int = 2) -> DataFrame:
    """One row per page: id, host, path, rule (null where none fits), verdict, mined (true if a mined rule decided).

    labels: (url, verdict) of URLs to learn from, with any verdicts. Without it the URLs that `rules` judge are
    learnt from, less all that stands where those rules look (free_tokens()), and a mined rule must hold under
    min_suffixes host suffixes at least. A null url, or one without `://`, has an empty host
    and path and no tokens, and gets the default. With no rules, no labelled URL, or no token combination of
    the support and confidence wanted, nothing is mined. Rules of more than max_tokens tokens are not used;
    more than max_rules others are an error. Ids may be null or repeat; other columns are not read.
    """
    url = F.col(url_col)
    page = pages.select(F.col(id_col), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    tokens = free_tokens(F.col("_url"), F.col("host"), F.col("path"), rules) if labels is None else tokens_of(F.col("_url"), F.col("host"), F.col("path"))
    page = page.select("*", _ruled(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2]).alias("rule"), _ruled(F.col("host"), F.col("path"), rules, lambda r: r[0]).alias("ruled"), tokens.alias("tokens"))
    if labels is None:
        suffix = F.element_at(F.split("host", r"\."), -1)
        labelled = page.where("ruled IS NOT NULL").select("tokens", F.col("ruled").alias("verdict"), suffix.alias("suffix"))
        found = widespread(mined_rules(labelled.select("tokens", "verdict"), min_support, min_confidence, max_tokens, max_rules), labelled, min_suffixes)
    else:
        at = F.col("url")
        found = mined_rules(labels.select(tokens_of(at, host_of(at), path_of(at)).alias("tokens"), "verdict"), min_support, min_confidence, max_tokens, max_rules)

    @F.pandas_udf("string")
    def mined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = matcher(found)  # once a task
        for tokens in batches:
            yield tokens.map(judge)

    guess = mined("tokens") if found else F.lit(None).cast("string")
    page = page.withColumn("guess", guess)
    return page.select(id_col, "host", "path", "rule", F.coalesce("ruled", "guess", F.lit(default)).alias("verdict"), (F.col("ruled").isNull() & F.col("guess").isNotNull()).alias("mined"))
