"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct word 5-grams as 64-bit hashes. Equal sets form one class; only one
document of a class goes on, so copies are never paired. A class's prefix holds enough of its tokens,
taken rare ones first, that a class similar to it must share one of the prefix's signatures:

* a rare token is a signature of its own;
* frequent tokens are dealt into groups by their hash, and the pairs within a group are signatures. A
  group with m tokens in the prefix survives m - 1 losses, so the prefix is extended until its
  groups and rare tokens together survive as many losses as the similarity allows;
* a class too small for that also lists the frequent tokens of its plain prefix, under a mark of their own,
  to meet other classes of that kind.

Frequent means: counted in more than ``frequent`` classes' lowest hashes, folded into a bit map of bounded size. A
false bit only makes a token frequent for every class alike, so the join is exact at any size.

Classes that share a signature are verified in steps. First each with at most two others, chosen from its
signatures' most central classes, which is linear even where thousands of near copies share one; what is linked
becomes a component. A link inside a component adds nothing to the result. Between different components:

* Each class has a hub, the most central class of its signatures; where a hub has many (``CROWD``) they are compared
  with it. Two classes of one hub share
  at most as much as the lesser of their overlaps with the hub, and besides only tokens that the hub lacks. So either
  their sizes are small enough for those overlaps, which a join on ranges of sizes finds, or they share a token that both
  have added to the hub's, which a join on (a prefix of) the added tokens finds. Near copies of one text have little in
  common but that text, so neither join grows with the square of their number.
* Other classes meet by their signatures; a bound on the overlap from sizes and shared signatures comes
  first.

What is left is compared as whole sets. No link is lost: each step leaves out only pairs that cannot reach the similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm import words
from fundtrace.llm.bits import bit_map, maybe
from fundtrace.llm.components import components
from fundtrace.llm.store import documents, drop, prepare, table, trim

SHINGLE = 5
PERCENT = 80
FREQUENT = 20
GROUPS = 256
CROWD = 64  # classes of a hub beyond which they meet by sizes and added tokens instead of signatures
STARS = 2  # linear rounds before all pairs of different components are compared
_U = np.uint64
_PAIR, _SMALL = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def _sets(column: pa.Array, shingle: int):
    """Per row the sorted array of distinct shingle hashes; shorter texts give one for all their words."""
    found = words.Words(column)
    grams, _ = found.windows(shingle)
    for i in range(len(found.bounds) - 1):
        a, b = int(found.bounds[i]), int(found.bounds[i + 1])
        if b - a >= shingle:
            own = np.sort(grams[a : b - shingle + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            yield words.mix(np.array([np.sum(found.hashes[a:b] * words._LANES[32 : 32 + b - a], dtype=_U)], _U) + _U(b - a))
        else:
            yield np.zeros(0, _U)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, _U)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): by the key a text is found again; rows without an id go by their text's hash."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))


def shingle_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, key, n, digest, low): set size, digest of the set and its lowest hashes."""

    def scan(batches):
        for batch in batches:
            sizes, digests, low = [], [], []
            for own in _sets(batch.column(2), shingle):
                n = len(own)
                sizes.append(n)
                digests.append(_digest(own))
                low.append(own[: min(n, 3 * (n // 5 + 1) // 2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), _lists(low)],
                names=["row", "doc_id", "key", "n", "digest", "low"],
            )
            trim()

    rows = _keyed(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "key")
    return rows.mapInArrow(scan, "row long, doc_id long, key long, n int, digest binary, low array<long>")


def signatures(own: np.ndarray, n: int, whole: bool, bits: np.ndarray, groups: int = GROUPS):
    """Signatures of a set: single tokens, combinations, prefix length, frequent tokens in the prefix and their groups.

    ``own`` holds its lowest hashes, or all if ``whole``. None if these do not suffice.
    """
    flag = maybe(own, bits)
    need = n // 5 + 1  # one more than the tokens a similar set may lack
    rare = own[~flag]
    if len(rare) >= need:
        return rare[:need], np.zeros(0, _U), need, 0, 0
    if not whole:
        return None
    often = own[flag]
    group = (words.mix(often) % _U(groups)).astype(np.int64)
    first = np.zeros(len(often), bool)
    first[np.unique(group, return_index=True)[1]] = True
    survives = np.cumsum(~first)
    missing = need - len(rare)
    singles = [rare]
    if len(often) and survives[-1] >= missing:
        taken = int(np.searchsorted(survives, missing)) + 1
    else:
        taken = len(often)
        singles.append(words.mix(often[:missing] ^ _SMALL))
    often, group = often[:taken], group[:taken]
    order = np.argsort(group, kind="stable")
    often, group = often[order], group[order]
    pairs = []
    for step in range(1, len(often)):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        pairs.append(words.mix(often[:-step][same] * _PAIR + often[step:][same]))
    return np.concatenate(singles), np.concatenate(pairs) if pairs else np.zeros(0, _U), len(rare) + taken, taken, len(np.unique(group))


_INDEX = "node long, n int, taken int, often int, groups int, single array<long>, pair array<long>"


def _index(rows: DataFrame, bits, whole: bool) -> DataFrame:
    """Signature rows of sets; those that need their whole set get no signature but ``taken`` = -1."""

    def scan(batches):
        for batch in batches:
            node, sizes, lists = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(_U)
            ends = np.cumsum([0, *lists.value_lengths().to_numpy(zero_copy_only=False)])
            single, pair, taken, often, groups = [], [], [], [], []
            for i, n in enumerate(sizes):
                own = flat[ends[i] : ends[i + 1]]
                got = signatures(own, int(n), whole or len(own) == n, bits.value)
                s, p, *facts = got or (np.zeros(0, _U), np.zeros(0, _U), -1, 0, 0)
                single.append(s), pair.append(p)
                taken.append(facts[0]), often.append(facts[1]), groups.append(facts[2])
            yield pa.RecordBatch.from_arrays(
                [node, batch.column(1), *(pa.array(x, pa.int32()) for x in (taken, often, groups)), _lists(single), _lists(pair)],
                names=["node", "n", "taken", "often", "groups", "single", "pair"],
            )
            trim()

    return rows.select("node", "n", "own").mapInArrow(scan, _INDEX)


def whole_sets(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, n, own) of the classes in ``nodes`` (node, key, digest), read from the texts again."""

    def scan(batches):
        for batch in batches:
            node, digest = batch.column(0), batch.column(1).to_pylist()
            keep, arrays = [], []
            for i, own in enumerate(_sets(batch.column(2), shingle)):
                if _digest(own) == digest[i]:
                    keep.append(i)
                    arrays.append(own)
            yield pa.RecordBatch.from_arrays(
                [node.take(pa.array(keep, pa.int64())), pa.array(list(map(len, arrays)), pa.int32()), _lists(arrays)],
                names=["node", "n", "own"],
            )
            trim()

    # The filter tells the optimizer that these are few, so it reduces the scan of the texts before its shuffle.
    wanted = nodes.filter("node >= 0").select("node", "key", "digest")
    found = _keyed(docs).join(wanted, "key").select("node", "digest", "text")
    return found.mapInArrow(scan, "node long, n int, own array<long>").dropDuplicates(["node"])


def _similar(x: str, y: str, common: F.Column) -> F.Column:
    """Whether ``common`` shared tokens make sets of sizes ``x`` and ``y`` similar enough."""
    return 100 * common >= PERCENT * (F.col(x) + F.col(y) - common)


def _shared(pairs: DataFrame) -> DataFrame:
    """Shared single tokens and combinations of each pair (a, b, one, shares)."""
    one = F.col("one").cast("int")
    return pairs.groupBy("a", "b").agg(F.sum(one).alias("shared"), F.sum(1 - one).alias("combined"), F.first("shares").alias("shares"))


def _possible(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs (a, b, shared, combined) whose sizes and shared signatures leave a link possible.

    Of two prefixes the one that ends first lies in the other as far as they overlap, so both sets share at
    most: the shared single tokens, the frequent tokens in a prefix, and all that follows a prefix. A group of
    which m frequent tokens are shared gives m - 1 or more shared combinations, so the frequent ones shared
    are no more than groups and shared combinations together.
    """
    columns = pairs.columns
    for side in ("a", "b"):
        facts = index.select(*(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "taken", "often", "groups")))
        pairs = pairs.join(facts, F.col(side) == F.col(f"node_{side}")).drop(f"node_{side}")
    often = F.least("often_a", "often_b", F.least("groups_a", "groups_b") + F.col("combined"))
    most = F.col("shared") + often + F.greatest(F.col("n_a") - F.col("taken_a"), F.col("n_b") - F.col("taken_b"))
    most = F.least(most, F.col("n_a"), F.col("n_b"))
    return pairs.filter(_similar("n_a", "n_b", most)).select(*columns)


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, as a table."""
    pairs = table(pairs)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = table(ends.join(nodes, "node").select("node", "key", "digest"))
    sets = table(whole_sets(docs, wanted, shingle))
    both = pairs
    for side in ("a", "b"):
        own = sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("own").alias(f"own_{side}"))
        both = both.join(own, side)
    linked = both.filter(_similar("n_a", "n_b", F.size(F.array_intersect("own_a", "own_b"))))
    linked = table(linked.select("a", "b"))
    drop(pairs, wanted, sets)
    return linked


def _placed(entries: DataFrame, joined: DataFrame) -> DataFrame:
    """Table of the entries (mark, node, one, shares) with their components, for marks of more than one component."""
    placed = entries.join(joined, "node", "left").select("mark", "node", "one", "shares", F.coalesce("component", "node").alias("component"))
    placed = table(placed)
    mixed = placed.groupBy("mark").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    mixed = table(mixed.select("mark", "low"))
    chosen = table(placed.join(mixed.filter("low >= 0").select("mark"), "mark"))
    drop(placed, mixed)
    return chosen


def _measured(docs: DataFrame, nodes: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """``members`` (node, component, hub) with the set's size ``n``, its overlap ``o`` with the hub's and the tokens ``added`` to it."""
    members = table(members)
    ends = members.select("node").unionByName(members.select(F.col("hub").alias("node"))).distinct()
    wanted = table(ends.join(nodes, "node").select("node", "key", "digest"))
    sets = table(whole_sets(docs, wanted, shingle))
    hub = sets.select(F.col("node").alias("hub"), F.col("own").alias("of_hub"))
    added = F.array_except("own", "of_hub")
    both = members.join(sets, "node").join(hub, "hub").withColumn("added", added)
    measured = table(both.select("node", "component", "hub", "n", (F.col("n") - F.size("added")).alias("o"), "added"))
    drop(members, wanted, sets)
    return measured


def _probes(members: DataFrame, key: str) -> DataFrame:
    """``members`` outside of the component that has most of them under their ``key``."""
    sizes = members.groupBy(key, "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy(key).agg(F.max(F.struct("size", "component"))["component"].alias("main"))
    return members.join(main, key).filter(F.col("component") != F.col("main")).drop("main")


def _linkable(common: F.Column) -> F.Column:
    """For the sides x and y of a join: different components, and ``common`` tokens would be enough."""
    return (F.col("x.component") != F.col("y.component")) & _similar("x.n", "y.n", common)


def _by_size(probes: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of one hub that can be similar by what each shares with the hub.

    Sizes are dealt into ranges of about 2 percent; a probe goes to those that its own overlap allows.
    """
    of_size = lambda n: F.floor(F.log(n) * 50).cast("int")
    # The largest partner: n + partner is at most 180 / 80 of the overlap.
    most = F.least((F.lit(100 + PERCENT) * F.col("o") / PERCENT).cast("long") - F.col("n"), (F.lit(100) * F.col("n") / PERCENT).cast("long"))
    least = F.greatest(F.ceil(F.lit(PERCENT) * F.col("n") / 100), F.lit(1))
    probes = probes.withColumn("most", most).withColumn("least", least).filter("most >= least").drop("added")
    probes = probes.withColumn("range", F.explode(F.sequence(of_size(F.col("least")), of_size(F.col("most")))))
    sized = members.drop("added").withColumn("range", of_size(F.col("n")))
    same = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.range") == F.col("y.range"))
    pairs = probes.alias("x").join(sized.alias("y"), same & _linkable(F.least("x.o", "y.o")))
    return pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))


def _by_added(probes: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of one hub that share a token the hub lacks.

    A partner is no smaller than the similarity allows, so of what a set shares with it at least ``need`` tokens are added
    ones: one of them is among all but the last ``need`` - 1.
    """
    need = F.greatest(F.ceil(F.lit(PERCENT) * F.col("n") / 100) - F.col("o"), F.lit(1))
    prefix = F.slice(F.array_sort("added"), F.lit(1), F.greatest(F.size("added") - need.cast("int") + 1, F.lit(0)))
    x, y = (side.withColumn("token", F.explode(prefix)).drop("added") for side in (probes, members))
    same = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.token") == F.col("y.token"))
    most = F.least("x.o", "y.o") + F.least(F.col("x.n") - F.col("x.o"), F.col("y.n") - F.col("y.o"))
    pairs = x.alias("x").join(y.alias("y"), same & _linkable(most))
    return pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))


def classes_and_links(docs: DataFrame, shingle: int = SHINGLE, frequent: int = FREQUENT):
    """Tables of the rows (doc_id, n, digest), of the classes, and of links that join their components."""
    spark = prepare(docs.sparkSession)
    found = table(shingle_table(docs, shingle))
    rows = table(found.drop("low"))
    classes = rows.filter("n > 0").groupBy("digest").agg(
        F.min(F.struct("row", "key")).alias("first"), F.min("doc_id").alias("least_id"), F.first("n").alias("n")
    )
    nodes = table(classes.select("digest", "least_id", "n", F.col("first.row").alias("node"), F.col("first.key").alias("key")))
    chosen = nodes.filter("node >= 0").select(F.col("node").alias("row"))
    sets = table(found.join(chosen, "row", "left_semi").select(F.col("row").alias("node"), "n", F.col("low").alias("own")))
    drop(found)

    def often(own: DataFrame) -> DataFrame:
        counted = own.select(F.explode("own").alias("token")).groupBy("token").count()
        return counted.filter(F.col("count") > frequent).select("token")

    def whole(marked: DataFrame) -> DataFrame:
        wanted = marked.filter("taken < 0").select("node").join(nodes, "node").select("node", "key", "digest")
        return table(whole_sets(docs, table(wanted), shingle))

    def known(tokens: DataFrame):
        return spark.sparkContext.broadcast(bit_map(tokens))

    # Sets with too few rare tokens among their lowest hashes are read whole, and then the rest of their tokens counted.
    low = table(often(sets))
    first = table(_index(sets, known(low), False))
    wide = whole(first)
    bits = known(table(low.unionByName(often(wide)).distinct()))
    narrow = sets.join(first.filter("taken >= 0").select("node"), "node", "left_semi")
    second = table(_index(narrow, bits, False))
    drop(sets, low, first)
    more = whole(second)
    index = second.filter("taken >= 0").unionByName(_index(wide, bits, True)).unionByName(_index(more, bits, True))
    index = table(index)
    facts = table(index.select("node", "n", "taken", "often", "groups"))
    drop(wide, more, second)

    lists = (("single", True), ("pair", False))
    entries = None
    for column, one in lists:
        part = index.select(F.explode(column).alias("mark"), "node", F.lit(one).alias("one"))
        entries = part if entries is None else entries.unionByName(part)
    marks = entries.groupBy("mark").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("of"))
    marks = table(marks.filter("least < most").select("mark", "of"))
    # What is left are the signatures that several classes share.
    counted = table(entries.join(marks.filter("of > 1"), "mark"))
    drop(index, marks)
    # The text others were copied from shares its signatures with most of them.
    shares = table(counted.groupBy("node").agg(F.sum("of").alias("shares")))
    entries = table(counted.join(shares, "node").select("mark", "node", "one", "shares"))
    drop(counted, shares)

    links, hubs, joined = None, None, table(nodes.limit(0).select("node", F.col("node").alias("component")))
    for _ in range(STARS):
        # Each class with the most central class of another component in each signature, at most two of
        # these: linear in the index. What the bound leaves out here is looked at again below.
        placed = _placed(entries, joined)
        near = placed.groupBy("mark").agg(F.max(F.struct("shares", "node", "component")).alias("to"))
        to = table(near)
        if hubs is None:
            central = placed.select("mark", "node").join(to, "mark").groupBy("node").agg(F.max(F.struct("to.shares", "to.node")).alias("hub"))
            hubs = table(central.select("node", F.col("hub.node").alias("hub")))
        near = placed.join(to.filter("mark is not null"), "mark").filter("component <> to.component")
        near = _shared(near.select(F.col("node").alias("a"), F.col("to.node").alias("b"), "one", F.col("to.shares").alias("shares")))
        marks = F.col("shared") + F.col("combined")
        best = _possible(near, facts).groupBy("a").agg(F.max(F.struct(marks, "b")).alias("best"), F.max(F.struct("shares", "b")).alias("central"))
        pairs = best.select("a", F.explode(F.array_distinct(F.array("best.b", "central.b"))).alias("b"))
        found = _verified(docs, nodes, pairs, shingle)
        links = found if links is None else table(links.unionByName(found))
        joined = table(components(links))
        drop(placed, to)

    placed = _placed(entries, joined)
    drop(entries)
    members = table(placed.select("node", "component").distinct().join(hubs, "node"))
    crowded = table(members.groupBy("hub").agg(F.count(F.lit(1)).alias("of")).filter(F.col("of") > CROWD).select("hub"))
    members = members.join(crowded.filter("hub is not null"), "hub")
    measured = _measured(docs, nodes, members, shingle)
    # Of each hub's and signature's classes, those of its largest component need not meet each other.
    of_hub = _probes(measured, "hub")
    pairs = _by_size(of_hub, measured).unionByName(_by_added(of_hub, measured)).distinct()
    ends = placed.join(facts.select("node", "n"), "node").join(measured.select("node", "hub"), "node", "left")
    probes = _probes(ends.select("mark", "node", "component", "hub", "n", "one"), "mark")
    apart = (F.col("x.component") != F.col("y.component")) & ~F.coalesce(F.col("x.hub") == F.col("y.hub"), F.lit(False)) & _similar("x.n", "y.n", F.least("x.n", "y.n"))
    across = probes.alias("x").join(ends.alias("y"), (F.col("x.mark") == F.col("y.mark")) & apart)
    across = across.select("x.mark", F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"), "x.one", F.lit(0).alias("shares")).distinct()
    other = _possible(_shared(across.drop("mark")), facts).select("a", "b")
    more = _verified(docs, nodes, pairs.unionByName(other), shingle)
    drop(placed, hubs, crowded, measured, facts)
    return rows, nodes, links.unionByName(more), joined, more


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    The component id is the least doc_id among the documents that links join, over any number of
    steps. Texts without words (empty, null, white space) have size 0 and are linked with nothing:
    their component is their own doc_id. Null ids are ignored in the least; repeated rows and repeated ids
    are rows of their own with one result each. Other columns are ignored. An empty table gives no rows.
    """
    rows, nodes, _, joined, more = classes_and_links(docs, shingle, frequent)
    # Components of the first step are single nodes in the second.
    place = lambda side: F.coalesce(f"{side}_component", side)
    lifted = more
    for side in ("a", "b"):
        lifted = lifted.join(joined.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component")), side, "left")
    top = components(lifted.select(place("a").alias("a"), place("b").alias("b")))
    top = top.select(F.col("node").alias("component"), F.col("component").alias("upper"))
    placed = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.join(top, "component", "left").withColumn("component", F.coalesce("upper", "component"))
    placed = table(placed.select("digest", "least_id", "component"))
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = table(placed.join(table(least), "component").select("digest", "component_id"))
    wordless = rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rest = rows.filter("n > 0").select("doc_id", "n", "digest").join(of_class, "digest")
    return rest.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(wordless)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the least doc_id; documents without words all stay.

    Rows that repeat both id and text are one document. Rows without an id have no least id: they stay.
    """
    kept = near_duplicates(docs).filter((F.col("component_id") == F.col("doc_id")) | (F.col("n_shingles") == 0))
    kept = table(kept.select("doc_id").filter("doc_id is not null").distinct())
    found = docs.join(kept.filter("doc_id is not null"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return found.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
), m AS (
  SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
