"""Jaccard join of documents on their 5-word shingles, with prefix filters under several token orders.

Equal sets are one class, found by a name of the set. Of the others, two can only be similar if under every
order of the shingles their prefixes share one: a set of n loses n - ceil(t n) shingles at most. Those of one
set alone are always lost, so of the m that other sets have too, the first m - ceil(t n) + 1 can't all be
missing; a set for which that is less than one is similar to none and leaves. The first order is rarest
first; each other order is that of a hash of its own, and has nothing to do with the first. Candidates meet in
a prefix shingle of the first order, must meet in those of the others, and are then verified exactly.

Similar sets are joined to classes without listing the pairs of a group: the sets that share a shingle are
compared with a few of them, the pivots; sets already in one class need no more comparison; what is left
together uncompared after the rounds is compared in blocks, again under all the filters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange
from .common import checkpointed, lean, place_names, shuffle_partitions, text_slices, whole_ids
from .word_hash import PLACES, hashes, joined, mixed, words_of

WORDS, PERCENT, ORDERS = 5, 75, 2
#: Bytes of a shingle's name that sets are compared by.
NAME_BYTES = 7
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.ones(256, bool)
INSIDE[[32, *range(9, 14)]] = False


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit names of each text's shingles."""
    parts = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    data, bounds = joined(parts)
    data = LOWER[data]
    data[bounds[1:] - 1] = 32
    start, end = words_of(data, INSIDE)
    word = hashes(data, start, end)
    at = np.searchsorted(start, bounds)  # words of text k: at[k] .. at[k + 1] - 1
    n = max(0, len(word) - words + 1)
    full = mixed(sum(word[j : j + n] * PLACES[j] for j in range(words))) if n else word[:0]
    out = []
    for i, j in zip(at[:-1], at[1:], strict=True):
        if j - i >= words:
            out.append(np.unique(full[i : j - words + 1]))
        elif j > i:
            out.append(mixed((word[i:j] * PLACES[: j - i]).sum(dtype=np.uint64) + np.array([j - i], np.uint64)))
        else:
            out.append(word[:0])
    return out


def set_name(s: np.ndarray) -> int:
    """A name of the set, as a signed 64-bit number."""
    total = mixed(s ^ PLACES[10]).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def named_sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_name, set, n): each document's set by name, and its size; the set is null if it is empty."""

    def run(batches):
        for b in text_slices(batches, 1):
            sets = shingles(b.column(1).to_pylist(), words)
            names, sizes = [set_name(s) if len(s) else None for s in sets], [len(s) for s in sets]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(names, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "text_name", "set", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, text_name(text_col)).mapInArrow(lean(run), f"id {kind}, text_name long, set long, n long")


def shared_shingles(docs: DataFrame, words: int, text_col: str, buckets: int | None = None) -> DataFrame:
    """(set, shared): for each set the shingles that other sets have too, as packed (name, number of sets)."""
    buckets = buckets or shuffle_partitions(docs.sparkSession)

    def run(batches):
        out = exchange.Flushed(buckets, NAME_BYTES, with_b=False)
        for b in text_slices(batches):
            sets = [s for s in shingles(b.column(0).to_pylist(), words) if len(s)]
            if sets:
                yield from out.add(np.concatenate(sets), None, np.repeat([set_name(s) for s in sets], [len(s) for s in sets]))
        yield from out.flush()

    found = exchange.exchanged(docs.select(text_col).mapInArrow(lean(run), exchange.PACKED), buckets, NAME_BYTES, exchange.count_owners)
    return found.select(F.col("owner").alias("set"), F.array("open").alias("shared"))


def prefixes(sets: DataFrame, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """(rep, n, tokens, hot, p0, p1, ...): the shared shingles of each set that may be similar to another one, and
    those in its prefix under each order; hot: those of p0 that very many sets have. sets: (rep, n, shared)."""

    def run(batches):
        for b in batches:
            rows = []
            for rep, n, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = np.frombuffer(b"".join(parts), exchange.COUNTED)
                # one name can come from several tasks that each found it hot
                token, at = np.unique(got["a"], return_index=True)
                count = got["count"][at]
                length = n - -(-percent * n // 100) + 1 - (n - len(token))
                if length < 1:
                    continue
                first = np.lexsort((mixed(token * PLACES[20]), count))[:length]
                others = [np.argsort(mixed(token * PLACES[20 + k]), kind="stable")[:length] for k in range(1, orders)]
                rows.append((rep, n, token.astype(np.int64), token[first[count[first] >= exchange.HOT]].astype(np.int64), *[token[k].astype(np.int64) for k in (first, *others)]))
            columns = list(zip(*rows, strict=True)) or [()] * (4 + orders)
            types = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * (2 + orders)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["rep", "n", "tokens", "hot", *[f"p{k}" for k in range(orders)]])

    return sets.select("rep", "n", "shared").mapInArrow(lean(run), "rep long, n long, tokens array<long>, hot array<long>, " + ", ".join(f"p{k} array<long>" for k in range(orders)))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """The pairs (a, b) whose sets are similar. The size and the other orders' prefixes are tried first."""
    side = lambda x: sets.select(F.col("rep").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in sets.columns if c not in ("rep", "p0", "hot")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    for k in range(1, orders):
        both = both.where(F.arrays_overlap(f"a_p{k}", f"b_p{k}"))
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(100 * common >= percent * (F.col("a_n") + F.col("b_n") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(rep, label): the least id that each end of a link can reach.

    Each round gives every node the least label among itself and its neighbours, then the label's own label.
    """
    edges = checkpointed(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = edges.groupBy(F.col("a").alias("rep")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    while True:
        near = edges.join(labels.select(F.col("rep").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("rep")).agg(F.min("l").alias("near"))
        step = labels.join(near, "rep").select("rep", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("rep").alias("label"), F.col("label").alias("jump"))
        step = checkpointed(step.join(jump, "label", "left").select("rep", "old", F.least("label", "jump").alias("label")))
        labels = step.select("rep", "label")
        if step.where("label < old").isEmpty():
            return labels


def set_classes(sets: DataFrame, percent: int = PERCENT, orders: int = ORDERS, turns: int = 2, pivots: int = 4) -> DataFrame:
    """(rep, label) of the sets given; label is the least rep of the class.

    A round looks at the groups of sets that share a prefix shingle and are not yet one class, and compares
    all with a few pivots, which then leave the group: they have met all others. The pivots are the sets
    with the least of their own, since edited copies are nearer to what they were copied from than to each
    other. What is left together after these rounds is compared in blocks (`block_links`). Rows of a hot
    shingle are salted, so that no join has them all in one task.
    """
    sets = checkpointed(sets)
    hot = F.array_contains("hot", F.col("token"))
    members = sets.select(F.explode("p0").alias("token"), "rep", "hot", (F.size("tokens") / F.col("n")).alias("common")).select("token", "rep", "common", F.when(hot, F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(F.lit(-1)).alias("salt"))
    labels = checkpointed(sets.select("rep", F.col("rep").alias("label")))
    first = Window.partitionBy("token").orderBy(F.desc("common"), "rep")
    for turn in range(turns + 1):
        known = members.join(labels, "rep").select("token", "salt", "rep", "common", "label")
        several = known.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("rep").alias("hub"), F.max("salt").alias("salt")).where("lo < hi")  # the others are one class
        known = checkpointed(known.join(_at_each_salt(several.select("token", "salt", "hub")), ["token", "salt"]))
        if known.isEmpty():
            return labels
        if turn < turns:
            chosen = known.withColumn("k", F.row_number().over(first)).where(F.col("k") <= pivots)
            chosen = checkpointed(chosen.select("token", "salt", F.col("rep").alias("b"), F.col("label").alias("b_label")))
            pairs = known.join(_at_each_salt(chosen), ["token", "salt"]).where("label <> b_label").select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
            found = verified(pairs, sets, percent, orders)
            members = known.join(chosen.select("token", F.col("b").alias("rep")), ["token", "rep"], "left_anti").select("token", "salt", "rep", "common")
        else:
            groups = remaining_groups(known).join(labels, "rep").join(sets.select("rep", "n", "tokens", *[f"p{k}" for k in range(orders)]), "rep")
            found = block_links(groups, percent, orders)
        by_label = lambda c: labels.select(F.col("rep").alias(c), F.col("label").alias(f"l{c}"))
        joined_ = found.join(by_label("a"), "a").join(by_label("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        roots = components(joined_).select(F.col("rep").alias("label"), F.col("label").alias("root"))
        labels = checkpointed(labels.join(roots, "label", "left").select("rep", F.coalesce("root", "label").alias("label")))
    return labels


#: Sets in a block; tasks that the rows of a hot shingle are dealt to.
BLOCK, SALTS = 128, 64


def _at_each_salt(rows: DataFrame) -> DataFrame:
    """Rows of a hot shingle, which have a salt, once for each."""
    return rows.withColumn("salt", F.explode(F.when(F.col("salt") >= 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1))).cast("array<bigint>")))


def remaining_groups(known: DataFrame) -> DataFrame:
    """(group_id, rep): groups within which each two sets of known that share a prefix shingle are together.
    known: (token, rep, hub), where hub is one of the token's sets.

    Either each shingle's sets are a group, or a family is: all sets that shingles chain together. In a family
    of copies, whose sets share many shingles, one group of the family costs less; in a long chain, whose
    sets share a few with their neighbours, groups by shingle do. The cost is that of the blocks to be sent.
    """
    families = checkpointed(components(known.select(F.col("rep").alias("a"), F.col("hub").alias("b"))).select("rep", F.col("label").alias("family")))
    placed = checkpointed(known.select("token", "rep").join(families, "rep"))
    cost = lambda n: F.col(n) * F.ceil(F.col(n) / BLOCK)
    by_token = placed.groupBy("family", "token").agg(F.count("*").alias("m")).groupBy("family").agg(F.sum(cost("m")).alias("apart"))
    whole = families.groupBy("family").agg(F.count("*").alias("m")).select("family", cost("m").alias("together"))
    sparse = checkpointed(by_token.join(whole, "family").where("apart < together").select("family"))
    group = lambda kind, c: F.xxhash64(F.lit(kind), c).alias("group_id")  # noqa: E731  two groups of one id only meet once more
    return placed.join(sparse, "family", "left_semi").select(group(0, "token"), "rep").unionByName(families.join(sparse, "family", "left_anti").select(group(1, "family"), "rep")).distinct()


def block_links(members: DataFrame, percent: int, orders: int = ORDERS) -> DataFrame:
    """(a, b): links that join the classes of each group. members: (rep, group_id, label, n, tokens, p0, p1, ...).

    A group is cut into blocks of about BLOCK sets, and each two blocks meet in one row. A row's links are
    thinned to those that join classes within it, so that no more leave it than it holds sets.
    """
    columns = ["rep", "label", "n", "tokens", *[f"p{k}" for k in range(orders)]]
    count = members.groupBy("group_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    # the sets of a large group are dealt by a salt, so that no task has them all
    large = count.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    cut = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS))).join(large, ["group_id", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    blocks = cut.groupBy("group_id", "blocks", "block").agg(F.collect_list(F.struct(*columns)).alias("sets"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sent = blocks.select("group_id", "block", "sets", other).select("group_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sets")
    met = sent.groupBy("group_id", "i", "j").agg(F.flatten(F.collect_list("sets")).alias("sets")).select("sets")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                s = b.column(0).slice(k, 1).flatten()
                rep, label, n = (s.field(c).to_numpy() for c in ("rep", "label", "n"))
                lists = [(c.flatten().to_numpy(), np.diff(c.offsets.to_numpy())) for c in (s.field(x) for x in columns[3:])]
                links = _links(rep, label, n, lists[0], lists[1:], percent)
                yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return met.mapInArrow(lean(run), "a long, b long").distinct()


def _common(names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many names each two of the lists share; list k has sizes[k] of the names."""
    n = len(sizes)
    _, column = np.unique(names, return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    common = np.zeros((n, n))  # 100 times a count must stay exact
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):  # some shingles at a time
        i, j = np.searchsorted(column, (start, start + 4096))
        dense = np.zeros((n, 4096), np.float32)
        dense[row[i:j], column[i:j] - start] = 1
        common += dense @ dense.T
    return common


def _links(rep, label, n, tokens, prefixes_, percent) -> list[tuple[int, int]]:
    """Links that join classes: of sets near in size whose prefixes meet under every order, those that verify."""
    able = (label[:, None] != label[None, :]) & (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n))
    for names, sizes in prefixes_:
        if able.any():
            able &= _common(names, sizes) > 0
    some = np.flatnonzero(able.any(1))
    if not len(some):
        return []
    ends = np.cumsum(tokens[1])
    names = np.concatenate([tokens[0][ends[k] - tokens[1][k] : ends[k]] for k in some])
    common = _common(names, tokens[1][some])
    rep, label, n = rep[some], label[some], n[some]
    near = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & able[np.ix_(some, some)]
    up = {x: x for x in label.tolist()}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        p, q = find(int(label[x])), find(int(label[y]))
        if p != q:
            up[p] = q
            out.append((int(rep[x]), int(rep[y])))
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, orders: int = ORDERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id reachable by links, its own included).

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A set is the distinct shingles
    of `words` words; fewer words are one shingle. Documents link if percent of the union is shared at least.
    Null and empty texts have no shingle and no link. A null id takes no part: its component is null. Rows of
    one id are judged each by its own text. Ids must be whole numbers, else TypeError. Other columns are not read.
    """
    found = judged(docs, words, percent, orders, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def judged(docs: DataFrame, words: int, percent: int, orders: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_name, n, component) of each row; text_name tells the texts of one id apart."""
    whole_ids(docs, id_col)
    found = checkpointed(named_sets(docs, words, id_col, text_col))
    kept = found.where("id IS NOT NULL AND set IS NOT NULL")
    # sets are nodes by their names: one id may have several, and is then in several classes
    reps = checkpointed(kept.groupBy(F.col("set").alias("rep")).agg(F.min(F.col("id").cast("long")).alias("least"), F.max("n").alias("n")))
    buckets = exchange.buckets_for(kept.agg(F.sum("n")).first()[0] or 0, shuffle_partitions(docs.sparkSession))
    shared = shared_shingles(docs.where(F.col(id_col).isNotNull()), words, text_col, buckets).withColumnRenamed("set", "rep").join(reps.select("rep", "n"), "rep")
    labels = set_classes(prefixes(shared, percent, orders), percent, orders)
    classed = checkpointed(reps.join(labels, "rep"))  # the other sets are classes of their own
    of_class = classed.groupBy("label").agg(F.min("least").alias("component"))
    several = classed.join(of_class, "label").select("rep", "component")
    classes = checkpointed(reps.join(several, "rep", "left").select(F.col("rep").alias("set"), F.coalesce("component", "least").alias("component")))
    return found.join(classes, "set", "left").select("id", "text_name", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", F.col("id").cast("long"))).alias("component"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """docs with one document of each component, that with the least id. Rows with a null id stay.

    Rows of one id are judged each by its own text: only those whose text is a copy go. Of a component's least
    id all rows stay. Columns may have any names.
    """
    whole_ids(docs, id_col)
    columns = place_names(docs.columns)
    plain = docs.toDF(*columns)
    key, text = columns[docs.columns.index(id_col)], columns[docs.columns.index(text_col)]
    found = judged(plain, words, percent, orders, key, text).where("component <> id")
    gone = found.select(F.col("id").alias("copied_id"), F.col("text_name").alias("copied_text")).distinct()
    mine = (F.col(key) == F.col("copied_id")) & (text_name(text) == F.col("copied_text"))
    return plain.join(gone, mine, "left_anti").toDF(*docs.columns)


def text_name(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
