"""Jaccard self-join of word n-gram sets over a distributed prefix tree.

1. Every text becomes a set of 64-bit hashes of its n-grams.  Equal sets are one node,
   named by the smallest doc_id.
2. Sets are put in one global order: frequent n-grams last (a bounded list of those that
   many different sets of an input partition share), hash order otherwise.  Two sets
   that link share at least ``l`` n-grams among the first ``n - ceil(t n) + l`` of each, so only that
   much of a set, its prefix, is indexed.
3. First links: nodes that agree on at least two of four minimum hashes are checked
   against the group's smallest node.  So large groups of near copies fall into
   components by a number of checks in proportion to their size.
4. The rest, exactly: for each n-gram whose prefix holders lie in more than one component,
   the holders' prefixes go in a trie.  Each holder descends it with its overlap so
   far; a branch is left when the overlap plus the shorter of both remainders can't
   reach ``l``, or when a common n-gram comes before the block's own (another block has
   that pair); at its end the pair's own bound is put in ``l``'s place.  Pairs of one component are not looked for:
   branches that hold nothing else are left.  N-grams of ``SMALL`` or fewer
   holders need no trie: their few pairs are counted.  A pair that shares an eighth of ``l`` of these is checked
   from there; any other shares the rest, ``y``, of its ``m`` n-grams of many holders, so its first common one, rarest first,
   is among the first ``m - y + 1``.  Only these get blocks: what long texts share by chance with ever more others does not.
5. Candidates of 3 and 4 are checked on whole sets, and components follow from the links.

Blocks of more than ``BLOCK`` holders are split into pairs of parts, so no group grows with
the data.  Links are as exact as 64-bit hashes of n-grams.

Defined results: a text of fewer than ``size`` words is one n-gram, the whole sequence; without
words (or null) the set is empty, links with nothing and is its own component; rows that
share a doc_id are one node; a null doc_id has a null component; a tie in any minimum goes
to the smaller doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import memory, store, wordhash as wh
from tessera.llm.components import components

#: Frequent n-grams that are moved to the end of the order: at most so many, each held by
#: ``COMMON`` or more different sets within one input partition.
FREQUENT, COMMON = 1 << 19, 3
BLOCK = 2048
#: N-grams with at most so many holders are unfolded to pairs at once; others get a trie.
SMALL = 4
#: N-grams are ordered by the power of two of their holders' number; so much is added to that of many holders.
_MANY = 32
#: A place in the global order is a hash's upper 62 bits; frequent n-grams have the highest places.
_TOP = (1 << 62) - FREQUENT - 1
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


@dataclass(frozen=True)
class Rule:
    """Sets link when ``den * common >= num * union``."""

    size: int = 5
    num: int = 80
    den: int = 100

    def need(self, n: np.ndarray) -> np.ndarray:
        """Least overlap of a set of ``n`` with any partner."""
        return -(-self.num * n // self.den)

    def common(self, n: np.ndarray) -> np.ndarray:
        """n-grams that linked sets share in their prefixes, at least (by the smaller one's size)."""
        return 1 + 2 * (n - self.need(n)) // 5

    def shared(self, a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
        """n-grams that two linked sets share in their prefixes, at least; each is (size, prefix length, last place of the prefix).

        All n-grams up to the smaller last place are known of both, and a set of ``n`` that
        overlaps by ``o`` has at most ``n - o`` others among them.
        """
        overlap = -(-self.num * (a[0] + b[0]) // (self.num + self.den))
        n, length, _ = min(a, b, key=lambda x: x[2])
        return max(1, length - n + overlap)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(n - self.need(n) + self.common(n), n)


def sets_of(text_column, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, laid end to end, with ``n + 1`` offsets."""
    data, offs = wh.text_buffers(text_column)
    starts, ends, at = wh.words(data, offs)
    h = wh.word_hashes(data, starts, ends, lower)
    count = np.diff(at)
    grams = wh.window_hashes(h, size)
    per = np.where(count >= size, count - size + 1, np.where(count > 0, 1, 0))
    owner, place = wh.ragged(per)
    short = (count > 0) & (count < size)
    values = np.zeros(len(owner), np.uint64)
    long = ~short[owner]
    values[long] = grams[at[:-1][owner[long]] + place[long]]
    if short.any():
        values[~long] = wh.run_hashes(h, at[:-1][short], at[1:][short])
    order = np.lexsort((values, owner)) if len(per) > 1 else np.argsort(values)
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(per) + 1))


def _identity(values: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that name each set."""
    out = []
    for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wh.mix(values ^ salt), dtype=np.uint64)])
        out.append(wh.mix(total[cut[1:]] - total[cut[:-1]] + np.diff(cut).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def frequent_grams(docs: DataFrame, rule: Rule) -> np.ndarray:
    """The most widely shared n-grams, rarest first (at most ``FREQUENT``)."""

    @memory.task("ngramjoin")
    def run(batches):
        seen: set[int] = set()
        pieces: list[np.ndarray] = []
        known, tally = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold():
            nonlocal known, tally, pieces
            every = np.concatenate([known, *pieces])
            weight = np.concatenate([tally, np.ones(len(every) - len(known), np.int64)])
            known, inverse = np.unique(every, return_inverse=True)
            tally, pieces = np.bincount(inverse, weight, len(known)).astype(np.int64), []
            if len(known) > 1 << 20:  # what is rare so far within this partition is forgotten; this only sets an order
                keep = tally > 1
                known, tally = known[keep], tally[keep]

        held = 0
        for batch in batches:
            for part in wh.slices(batch):
                values, cut = sets_of(part.column("text"), rule.size)
                name, _ = _identity(values, cut)
                fresh = np.array([not (x in seen or seen.add(x)) for x in name.tolist()], bool)
                pieces.append(values[np.repeat(fresh, np.diff(cut))])
                held += len(pieces[-1])
                if held > 1 << 19:
                    fold()
                    held = 0
        fold()
        hot = tally >= COMMON
        yield pa.RecordBatch.from_pydict({"gram": known[hot].view(np.int64), "n": tally[hot]})

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    return rows.column("gram").to_numpy().view(np.uint64)[::-1].copy()


def nodes_of(docs: DataFrame, rule: Rule, frequent: np.ndarray) -> DataFrame:
    """Per document: ``n``, the set's name (``s1``, ``s2``), its prefix in global order and four minimum hashes."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order))  # at most FREQUENT entries

    @memory.task("ngramjoin")
    def run(batches):
        hot, rank = shared.value
        for batch in batches:
            for part in wh.slices(batch):
                values, cut = sets_of(part.column("text"), rule.size)
                n = np.diff(cut)
                s1, s2 = _identity(values, cut)
                place = np.minimum((values >> np.uint64(2)).astype(np.int64), _TOP - 1)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
                    late = hot[at] == values
                    place[late] = _TOP + rank[at[late]]
                    owner = np.repeat(np.arange(len(n)), n)
                    for d in np.flatnonzero(np.bincount(owner, late, len(n))):  # sets are in hash order; only those with frequent n-grams change
                        place[cut[d] : cut[d + 1]].sort()
                size = np.where(n > 0, rule.prefix(n), 0)
                who, i = wh.ragged(size)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(place[cut[:-1][who] + i]))
                some = np.flatnonzero(n)
                mins = []
                for seed in _SEEDS:
                    m = np.zeros(len(n), np.uint64)
                    if len(some):
                        m[some] = np.minimum.reduceat(wh.mix(values ^ seed), cut[:-1][some])
                    mins.append(pa.array(m.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), prefix, *mins], ["doc_id", "n", "s1", "s2", "prefix", "m0", "m1", "m2", "m3"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix array<long>, m0 long, m1 long, m2 long, m3 long")


def _close(rule: Rule, a: str, b: str):
    """Sizes that may link at all."""
    return F.least(a, b) * rule.den >= F.greatest(a, b) * rule.num


def first_pairs(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of a node and the smallest node of a minimum-hash group, where two or more of four agree."""
    keys = nodes.select("node", "n", F.posexplode(F.array("m0", "m1", "m2", "m3")).alias("k", "m"))
    heads = keys.groupBy("k", "m").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("held")).where("held > 1").select("k", "m", F.col("head.node").alias("b"), F.col("head.n").alias("nb"))
    heads = store.materialise(heads, "heads")  # written first, so that adaptive execution splits a large group's rows in the join
    pairs = keys.join(heads, ["k", "m"]).where((F.col("node") != F.col("b")) & _close(rule, "n", "nb"))
    return pairs.groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("agree")).where("agree > 1").select("a", "b")


def trie_pairs(token: int, holders: list[tuple[int, int, tuple[int, int, int], int, list[int]]], rule: Rule, cross: bool) -> list[tuple[int, int]]:
    """Pairs of ``holders`` (node, component, (n, prefix length, its last place), part, ordered places) whose first common n-gram with a block is ``token`` and that share enough.

    An odd place has a block of its own.  Trie nodes are ``[children, longest remainder
    below, holders that end here, the one component of all holders below or None]``.
    """
    root: list = [{}, 0, [], holders[0][1] if holders else None]
    for h in holders:
        at = root
        for i, gram in enumerate(h[4]):
            at[1] = max(at[1], len(h[4]) - i)
            at[3] = at[3] if at[3] == h[1] else None
            at = at[0].setdefault(gram, [{}, 0, [], h[1]])
        at[3] = at[3] if at[3] == h[1] else None
        at[2].append(h)
    out = []
    for node, comp, size, part, prefix in holders:
        place = {g: i for i, g in enumerate(prefix)}
        n = size[0]
        low = -(-rule.num * n // rule.den)
        need = int(rule.common(np.int64(low)))  # no partner is smaller than low
        stack = [(root, 0, 0, False)]
        while stack:
            at, common, passed, met = stack.pop()
            for other, c2, size2, p2, _ in at[2]:
                if node < other and comp != c2 and (not cross or part != p2) and size2[0] * rule.den >= n * rule.num and n * rule.den >= size2[0] * rule.num and common >= rule.shared(size, size2):
                    out.append((node, other))
            for gram, child in at[0].items():
                if child[3] == comp:
                    continue
                i = place.get(gram)
                if i is not None:
                    if gram & 1 and gram < token:
                        continue  # the block of that n-gram has this pair
                    now, after, here = common + 1, i + 1, met or gram == token
                else:
                    now, after, here = common, passed, met
                if not here and gram > token:
                    continue
                if now + min(child[1], len(prefix) - after) >= need:
                    stack.append((child, now, after, here))
    return out


def _sharing(grams: np.ndarray, size: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """What two or more holders of a block share, without holders that share too little; None if fewer than two stay."""
    owner = np.repeat(np.arange(len(size)), size)
    while True:
        _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
        left = np.bincount(owner[count[inverse] > 1], minlength=len(size))
        keep = (count[inverse] > 1) & (left >= need)[owner]
        if keep.all():
            return (grams, owner) if len(grams) else None
        grams, owner = grams[keep], owner[keep]
        if not len(grams):
            return None


def _rarest_first(grams: np.ndarray, rare: np.ndarray, token: int) -> tuple[np.ndarray, int]:
    """Places of a block's n-grams in the order of their holders' number (to a power of two), odd where they have many, and the token's."""
    known, first, inverse = np.unique(grams, return_index=True, return_inverse=True)
    level = rare[first].astype(np.int64)
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known, level))] = np.arange(len(known))
    odd = 2 * rank + (level >= _MANY)
    return odd[inverse], int(odd[np.searchsorted(known, token)])


def rest_pairs(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of nodes of different components that share enough of their prefixes (``nodes`` has component)."""
    entries = nodes.select("node", "component", "n", F.explode("prefix").alias("gram"))
    # counted with map-side combination, written, then joined: adaptive execution splits a hot n-gram's rows in a join of plain exchanges
    grams = entries.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("held")).where("low <> high").select("gram", "held")
    grams = store.materialise(grams, "shared-grams")
    mixed = store.materialise(entries.join(grams, "gram").select("node", "component", "n", "gram", "held"), "mixed")
    store.discard(grams)
    low = F.ceil(F.col("n") * rule.num / rule.den)

    def least(n):
        return (1 + F.floor(2 * (n - F.ceil(n * rule.num / rule.den)) / 5)).cast("long")

    def counted(l):
        """Common n-grams of few holders from which a pair is taken from there, of ``l`` in all."""
        return F.ceil(l / 8)

    power = (F.length(F.bin("held")) + F.when(F.col("held") > SMALL, _MANY).otherwise(0)).cast("byte")
    lists = F.array_sort(F.collect_list(F.struct(power.alias("rare"), "gram")))
    short = mixed.groupBy("node", "component", "n").agg(lists.alias("x"), F.count_if(F.col("held") > SMALL).alias("many"))

    # few holders: their pairs, counted
    few = mixed.where(F.col("held") <= SMALL).groupBy("gram").agg(F.collect_list(F.struct("node", "component", "n")).alias("h"))
    each = few.select(F.explode(F.flatten(F.transform("h", lambda x: F.transform("h", lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p")).where("p.x.node < p.y.node AND p.x.component <> p.y.component")
    pairs = each.select(F.col("p.x.node").alias("a"), F.col("p.y.node").alias("b"), F.col("p.x.n").alias("na"), F.col("p.y.n").alias("nb")).where(_close(rule, "na", "nb"))
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common")).where(F.col("common") >= counted(least(F.least("na", "nb"))))
    known = nodes.select("node", F.size("prefix").alias("length"), F.element_at("prefix", -1).alias("last"))
    pairs = pairs.join(known.select(F.col("node").alias("a"), F.col("length").alias("la"), F.col("last").alias("ea")), "a").join(known.select(F.col("node").alias("b"), F.col("length").alias("lb"), F.col("last").alias("eb")), "b")
    besides = mixed.where(F.col("held") > SMALL).groupBy("node").agg(F.count("*").alias("many"))  # of these, as many may be common too
    pairs = pairs.join(besides.select(F.col("node").alias("a"), F.col("many").alias("ha")), "a", "left").join(besides.select(F.col("node").alias("b"), F.col("many").alias("hb")), "b", "left")
    common = F.col("common") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    overlap = F.ceil((F.col("na") + F.col("nb")) * rule.num / (rule.num + rule.den))
    pairs = pairs.where(common >= F.when(F.col("ea") <= F.col("eb"), F.col("la") - F.col("na")).otherwise(F.col("lb") - F.col("nb")) + overlap).select("a", "b")

    rest = least(low) - counted(least(low)) + 1  # what a pair that is not taken from there has in common of many holders, at least
    short = short.where((F.size("x") >= least(low)) & (F.col("many") >= rest)).join(known, "node")
    short = short.withColumn("key", F.slice(F.filter("x", lambda x: x["rare"] >= _MANY), F.lit(1), (F.col("many") - rest + 1).cast("int")))
    short = store.materialise(short.select("node", "component", "n", "length", "last", F.col("x.gram").alias("grams"), F.col("x.rare").alias("rare"), F.col("key.gram").alias("key")), "keys")
    blocks = short.select("node", F.explode("key").alias("gram"))
    held = blocks.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1")  # one left has no partner here
    many = store.materialise(blocks.join(held, "gram"), "blocks")
    parts = F.ceil(F.col("held") / BLOCK).cast("int")
    blocks = many.join(short.drop("key"), "node").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    blocks = blocks.select("gram", "node", "component", "n", "length", "last", "grams", "rare", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("with")).select("*", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"))

    def run(table: pa.Table) -> pa.Table:
        node, comp, n, part, length, last = (table.column(c).to_numpy() for c in ("node", "component", "n", "part", "length", "last"))
        grams, rare = (pa.concat_arrays(table.column(c).chunks) for c in ("grams", "rare"))
        place, token = _rarest_first(grams.flatten().to_numpy(), rare.flatten().to_numpy(), table.column("gram")[0].as_py())
        found = []
        keep = _sharing(place, np.diff(grams.offsets.to_numpy()), rule.common(rule.need(n)))
        if keep is not None:
            grams, owner = keep
            who = np.unique(owner)
            cut = np.searchsorted(owner, np.append(who, len(node)))
            holders = [(int(node[i]), int(comp[i]), (int(n[i]), int(length[i]), int(last[i])), int(part[i]), grams[a:b].tolist()) for i, a, b in zip(who, cut[:-1], cut[1:], strict=True)]
            found = trie_pairs(token, holders, rule, table.column("p")[0] != table.column("q")[0])
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return pairs.unionByName(blocks.groupBy("gram", "p", "q").applyInArrow(run, "a long, b long"))


def linked(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose whole sets link.  Only the texts of nodes in a pair are turned into sets again."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    @memory.task("ngramjoin")
    def to_sets(batches):
        for batch in batches:
            for part in wh.slices(batch):
                values, cut = sets_of(part.column("text"), rule.size)
                offs = pa.py_buffer((cut * 8).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, offs, pa.py_buffer(values.tobytes())])], ["node", "grams"])

    sets = store.materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.hint("merge"), "doc_id").mapInArrow(to_sets, "node long, grams binary"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")

    @memory.task("ngramjoin")
    def check(batches):
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("a", "b"))
            ga, gb = (batch.column(batch.schema.get_field_index(c)) for c in ("ga", "gb"))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(ga[i].as_buffer(), np.uint64), np.frombuffer(gb[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum()) if len(y) else 0
                good[i] = common > 0 and rule.den * common >= rule.num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return both.select("a", "b", "ga", "gb").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id."""
    docs = docs.select("doc_id", "text")
    store.reach_workers(docs.sparkSession)
    nodes = store.materialise(nodes_of(docs, rule, frequent_grams(docs, rule)), "nodes")
    rows = store.materialise(nodes.select("doc_id", "s1", "s2", "n"), "names")
    named = nodes.where("doc_id IS NOT NULL AND n > 0")
    classes = named.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("prefix", "m0", "m1", "m2", "m3"), "doc_id").alias("x"))
    classes = store.materialise(classes.select("node", "n", "s1", "s2", "x.*"), "classes")
    store.discard(nodes)
    first = store.materialise(linked(first_pairs(classes, rule), docs, rule), "links")
    ends = components(first)
    store.discard()
    joined = classes.join(ends, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = store.materialise(rest_pairs(joined.select("node", "n", "prefix", "component"), rule).distinct(), "pairs")
    store.discard()
    links = first.unionByName(store.materialise(linked(rest, docs, rule), "links"))
    store.discard()
    # a doc_id with several rows ties their sets together
    twice = rows.where("doc_id IS NOT NULL").join(classes.select("s1", "s2", "n", "node"), ["s1", "s2", "n"]).select("doc_id", "node")
    ties = twice.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b").select("a", "b")
    ends = components(links.unionByName(ties))
    final = classes.select("s1", "s2", "n", "node").join(ends, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component"))
    out = rows.join(final, ["s1", "s2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
