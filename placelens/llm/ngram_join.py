"""N-gram Jaccard join by vertical partitioning.

The hash order of all n-grams is the global order. It is cut into fragments, so a
document's set falls into segments. Before that, sets that can't link are left out:
of the first n-grams of a set in hash order so many lie in any partner's first ones,
and one with fewer that another set has too is done. Segments serve twice:

* Candidates. Two sets that link differ in at most k n-grams, so of k + 1 or more
  fragments at least one is equal in both. Equal fragments meet by their hash;
  no other pair can link. Buckets of the same sets tell the same, so one of them stays.
* Counting. A pair's overlap is counted fragment by fragment, each on its own, and
  summed per pair. The decision is made on that exact sum.

Copies are one node. In a large group of near copies pairs aren't all made: nodes
first meet one hub of their bucket, linked ones become one component, and only
nodes of different components meet after that. So no link between components is
lost. Links are counted afterwards: both ends of a link are in one component, whose
sets meet in blocks. A task counts the links of two blocks as products of matrices
and gives one row for each set, never one for each pair.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.llm.components import components
from placelens.llm.storage import staged
from placelens.llm.words import Words, grams, in_chunks, mix

CLASS_GROWTH = 1.3
SEGMENT_GRAMS = 128
PARITY_WORDS = 16
SEEN_KEYS = 50_000
COUNT_PASSES = 4
# A component's blocks have about BLOCK_SETS sets, or more where that makes more than BLOCKS of them, but at most MOST_SETS.
BLOCK_SETS, BLOCKS, MOST_SETS = 256, 16, 4096
BLOCK_GRAMS = 2_000_000
COLUMNS = 1024
MOST_HALVINGS = 32  # cuts end long before, when each n-gram stands alone


class Rule(NamedTuple):
    words: int
    percent: int

    def most_different(self, larger: int) -> int:
        """Most n-grams in which two linking sets can differ when the larger one has so many."""
        return 2 * larger * (100 - self.percent) // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        return size * 100 // self.percent

    def least_shared(self, size: int) -> int:
        """Fewest n-grams that a set of this size shares with a partner; no partner is smaller."""
        return -(-size * self.percent // 100)

    def links(self, overlap: Column, left: Column, right: Column) -> Column:
        return overlap * 100 >= (left + right - overlap) * self.percent


def _class_bounds(size: int) -> list[int]:
    bounds = [1]
    while bounds[-1] <= size:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * CLASS_GROWTH)))
    return bounds


def _fragments(rule: Rule, bounds: list[int], c: int) -> tuple[int, int]:
    """(fragments of a size class, n-grams in which two linking sets of it can differ)."""
    k = rule.most_different(bounds[c + 1] - 1)
    return k + 1 + (2 if k >= 8 else 0), k


def _first_shared(rule: Rule, size: int) -> int:
    """How many of the n-grams that a set of this size shares with a partner its first ones must hold; grows with size."""
    shared = rule.least_shared(size)
    return min(shared, (size - shared) // 2 + 1)


def _first_grams(rule: Rule, size: int) -> int:
    """So many n-grams in order, of which all but ``_first_shared`` may be a set's own."""
    return size - rule.least_shared(size) + _first_shared(rule, size)


def _cuts(ordered: np.ndarray, pieces: int) -> np.ndarray:
    """Where the segments of an ordered set begin, and its length."""
    part = ((ordered >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(pieces + 1, dtype=np.uint64))


def _segments_for(size: int) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1, size / SEGMENT_GRAMS)))))


def _parity_level(size: int) -> int:
    """Doublings of the parity cells so that there are at least two for each n-gram."""
    return max(0, int(np.ceil(np.log2(max(1, size / (32 * PARITY_WORDS))))))


def _parity(own: np.ndarray, level: int) -> np.ndarray:
    """For each of many cells, whether an odd number of n-grams falls into it."""
    cells = (64 * PARITY_WORDS) << level
    cell = (mix(own + np.uint64(1)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=cells) & 1).astype(np.uint8)).view(np.int64)


def sets_of(words: Words, i: int, all_grams: np.ndarray, n: int) -> np.ndarray:
    """The ordered distinct n-grams of one text; fewer words than n are one n-gram."""
    a, b = words.first[i], words.first[i + 1]
    if b - a >= n:
        return np.unique(all_grams[a : b - n + 1])
    if b > a:
        return grams(words.hashes[a:b], int(b - a)) ^ np.uint64(b - a)
    return np.zeros(0, np.uint64)


def _each_set(batches: Iterator[pa.RecordBatch], n: int):
    """(batch, row, ordered set, node) of every text. The node is a 128-bit hash of the set."""
    for batch in batches:
        for at, _, words in in_chunks(batch.column("text"), lower=True):
            all_grams = grams(words.hashes, n)
            for i in range(len(words.first) - 1):
                own = sets_of(words, i, all_grams, n)
                yield batch, at + i, own, xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def _half(node: bytes | None) -> int | None:
    return int.from_bytes(node[:8], "little", signed=True) if node else None


def _new_to_task(sets, seen: set):
    """Of what ``_each_set`` gives, sets with n-grams, without copies that this task has had lately."""
    for found in sets:
        node = found[3]
        if node is None or node in seen:
            continue
        if len(seen) >= SEEN_KEYS:
            seen.clear()
        seen.add(node)
        yield found


def _noded(rule: Rule):
    """(node, half, text) of texts with words; every set comes at least once."""

    def run(batches):
        seen = set()
        for batch in batches:
            found = [(node, _half(node), at) for _, at, _, node in _new_to_task(_each_set(iter([batch]), rule.words), seen)]
            nodes, halves, rows = zip(*found) if found else ((), (), ())
            texts = batch.column("text").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(halves, pa.int64()), texts], ["node", "half", "text"])

    return run


def _members(rule: Rule):
    def run(batches):
        for batch in batches:
            nodes, halves, sizes, least = [], [], [], []
            for _, _, own, node in _each_set(iter([batch]), rule.words):
                nodes.append(node)
                halves.append(_half(node))
                sizes.append(len(own))
                # A partner's first n-grams hold as many shared ones as its own size asks for.
                least.append(_first_shared(rule, rule.least_shared(len(own))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(nodes, pa.binary()), *(pa.array(x, pa.int64()) for x in (halves, sizes, least))],
                ["id", "node", "half", "n", "least"],
            )

    return run


def _firsts(rule: Rule):
    """(n-gram, first half of the node) of each set's first n-grams."""

    def run(batches):
        seen, out, keys, count = set(), [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(keys))], ["gram", "half"])

        for _, _, own, node in _new_to_task(_each_set(batches, rule.words), seen):
            first = own[: _first_grams(rule, len(own))]
            out.append(first)
            keys.append(np.full(len(first), _half(node)))
            count += len(first)
            if count >= 200_000:
                yield flush()
                out, keys, count = [], [], 0
        if count:
            yield flush()

    return run


def _signatures(rule: Rule):
    """(signature of a segment, first half of the node) for each size class a set can meet partners in.

    Empty segments tell nothing, as many sets share them, and have no signature. A set
    with no more than k others, as few n-grams leave, is cut once more in halves, and
    again, until more than k segments hold n-grams; it lists those of all cuts. Of two
    linking sets take the finest cut that both list: one of them fills more than k
    segments there, no more than k differ, so one that holds n-grams is equal in both.
    """

    def rows(own: np.ndarray, bounds: list[int]) -> Iterator[np.ndarray]:
        size, hashed = len(own), mix(own)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed)])
        home, last = np.searchsorted(bounds, [size, rule.largest_partner(size)], "right") - 1
        for c in range(int(home), int(last) + 1):
            pieces, k = _fragments(rule, bounds, c)
            if k == 0:
                continue  # only equal sets link here, and those are one node
            for level in range(MOST_HALVINGS):
                cuts = _cuts(own, pieces << level)
                begin, end = cuts[:-1], cuts[1:]
                filled = np.flatnonzero(begin < end)
                label = mix(filled.astype(np.uint64) + np.uint64((c << 40) + (level << 34)))
                yield mix((sums[end[filled]] - sums[begin[filled]]) ^ label)
                if len(filled) > min(k, size - 1):
                    break

    def run(batches):
        bounds = _class_bounds(1000)
        out, keys, count = [], [], 0
        for _, _, own, node in _each_set(batches, rule.words):
            if rule.largest_partner(len(own)) >= bounds[-2]:
                bounds = _class_bounds(4 * len(own) + 1000)
            half = _half(node)
            for signature in rows(own, bounds):
                out.append(signature)
                keys.append(np.full(len(signature), half))
                count += len(signature)
            if count >= 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(keys))], ["sig", "half"])
                out, keys, count = [], [], 0
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(keys))], ["sig", "half"])

    return run


def repeated_runs(batches: Iterator[pa.RecordBatch], distinct: bool = True) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by (first, second column), those whose first value comes in several rows.

    With ``distinct``, repeats of a pair go first. Holds one row besides the batch,
    however long a run is.
    """
    held = None  # the last row of the previous batch, and whether it was given out

    for batch in batches:
        if not batch.num_rows:
            continue
        table, done = (pa.Table.from_batches([batch]), False) if held is None else (pa.concat_tables([held[0], pa.Table.from_batches([batch])]), held[1])
        a, b = (table.column(i).to_numpy() for i in (0, 1))
        same_key = a[1:] == a[:-1]
        new = np.concatenate([[True], ~(same_key & (b[1:] == b[:-1]) & distinct)])
        table, a = table.filter(pa.array(new)), a[new]
        same = a[1:] == a[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        first_given = done
        if done:
            keep[0] = False
        last_given = bool(keep[-1]) or (len(a) == 1 and first_given)
        held = (table.slice(len(a) - 1, 1).combine_chunks(), last_given)
        if keep.any():
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()


def _parts(rule: Rule):
    """(node, n, parity, pieces, piece, grams): a set's segments, for as many pieces as its partners may use."""

    def run(batches):
        kept = {k: [] for k in ("node", "half", "n", "level", "parity", "parity_above", "pieces", "piece", "grams")}

        def flush():
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(kept["node"], pa.binary()),
                    pa.array(kept["half"], pa.int64()),
                    pa.array(kept["n"], pa.int64()),
                    pa.array(kept["level"], pa.int32()),
                    pa.array(kept["parity"], pa.list_(pa.int64())),
                    pa.array(kept["parity_above"], pa.list_(pa.int64())),
                    pa.array(kept["pieces"], pa.int32()),
                    pa.array(kept["piece"], pa.int32()),
                    pa.array(kept["grams"], pa.list_(pa.int64())),
                ],
                list(kept),
            )
            for v in kept.values():
                v.clear()
            return out

        for batch in batches:
            wanted = set(batch.column("half").to_pylist())
            for _, _, own, node in _each_set(iter([batch]), rule.words):
                half = _half(node)
                if half not in wanted:
                    continue
                level, above = _parity_level(len(own)), _parity_level(rule.largest_partner(len(own)))
                facts = (level, _parity(own, level), _parity(own, above) if above != level else None)
                for pieces in {_segments_for(len(own)), _segments_for(rule.largest_partner(len(own)))}:
                    cuts = _cuts(own, pieces)
                    for j in range(pieces):
                        if cuts[j + 1] > cuts[j]:
                            for k, v in zip(kept, (node, half, len(own), *facts, pieces, j, own[cuts[j] : cuts[j + 1]].view(np.int64))):
                                kept[k].append(v)
                            facts = (level, None, None)  # a set's first row has them
                if len(kept["node"]) >= 2000:
                    yield flush()
        if kept["node"]:
            yield flush()

    return run


def _may_have_partners(texts: DataFrame, members: DataFrame, rule: Rule, parts_n: int) -> DataFrame:
    """(half) of sets of whose first n-grams enough are first ones of other sets too. All others link with none.

    Two linking sets share at least ``least_shared`` of each one's size. So the first n-grams
    of each hold the first ``_first_shared`` of the shared ones, and both hold as many as the
    smaller set must.
    """
    firsts = texts.mapInArrow(_firsts(rule), "gram long, half long").repartition(parts_n, "gram").sortWithinPartitions("gram", "half")
    shared = staged(firsts.mapInArrow(repeated_runs, "gram long, half long").groupBy("half").agg(F.count("*").alias("shared")), "set-shared")
    least = members.where("n > 0").groupBy("half").agg(F.min("least").alias("least"))
    return shared.join(least.hint("merge"), "half").where("shared >= least").select("half")


def _one_of_each(buckets: DataFrame) -> DataFrame:
    """Of buckets that hold the same sets, one. Near copies meet in most of their segments, but one meeting tells as much."""
    held = [F.bit_xor(F.xxhash64(F.lit(k), F.col("half"))).alias(f"held_{k}") for k in (1, 2)]
    held = buckets.groupBy("sig").agg(*held, F.count("*").alias("sets"))
    one = held.groupBy("held_1", "held_2", "sets").agg(F.min("sig").alias("sig")).select("sig")
    return staged(buckets.join(one.hint("merge"), "sig", "left_semi"), "set-buckets")


def _counted(pairs: DataFrame, parts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (left, right, n_left, n_right, pieces) that link: overlaps per fragment, summed per pair.

    Fragments are counted in ``COUNT_PASSES`` passes, so that only a part of all segments moves at a time.
    """
    pairs = staged(pairs, "set-pairs")
    counts = []
    for turn in range(COUNT_PASSES):
        own = parts.where(F.pmod(F.col("piece") + F.col("pieces"), F.lit(COUNT_PASSES)) == turn)
        left = own.select(F.col("node").alias("left"), "pieces", "piece", F.col("grams").alias("left_grams"))
        right = own.select(F.col("node").alias("right"), "pieces", "piece", F.col("grams").alias("right_grams"))
        both = pairs.join(left, ["left", "pieces"]).join(right, ["right", "pieces", "piece"])
        partial = both.select("left", "right", "n_left", "n_right", "piece", F.size(F.array_intersect("left_grams", "right_grams")).alias("overlap"))
        once = partial.groupBy("left", "right", "n_left", "n_right", "piece").agg(F.max("overlap").alias("overlap"))
        counts.append(staged(once.groupBy("left", "right", "n_left", "n_right").agg(F.sum("overlap").alias("overlap")), "set-overlaps"))
    partial = counts[0]
    for df in counts[1:]:
        partial = partial.unionByName(df)
    total = partial.groupBy("left", "right", "n_left", "n_right").agg(F.sum("overlap").alias("overlap"))
    return total.where(rule.links(F.col("overlap"), F.col("n_left"), F.col("n_right"))).select("left", "right", "overlap", "n_left", "n_right")


def _odd_cells(left: str, right: str) -> Column:
    """Cells whose parities differ: no more than n-grams in which the sets differ. Null if the sizes are too far apart."""
    both = F.greatest(f"{left}.level", f"{right}.level")
    a, b = (F.when(F.col(f"{x}.level") == both, F.col(f"{x}.parity")).otherwise(F.col(f"{x}.parity_above")) for x in (left, right))
    short = sum((F.bit_count(F.col(f"{left}.parity")[i].bitwiseXOR(F.col(f"{right}.parity")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    long = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return F.when(both == 0, short).otherwise(long)


def _may_link(rule: Rule, left: str, right: str) -> Column:
    """Bounds that every linking pair keeps: sizes, and the parities of cells, which differ in no more cells than the sets in n-grams."""
    a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
    odd = _odd_cells(left, right)
    sizes = (F.least(a, b) * 100 >= F.greatest(a, b) * rule.percent)
    return sizes & F.coalesce(odd * (100 + rule.percent) <= (a + b) * (100 - rule.percent), F.lit(False))


def _pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """Distinct candidate pairs with the number of pieces that their segments are cut into."""
    larger = F.greatest("n_left", "n_right")
    pieces = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(larger / F.lit(float(SEGMENT_GRAMS)))))).cast("int")
    return rows.distinct().withColumn("pieces", pieces)


def _block_links(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        """Links of each set with those of the other block, or of its own where there is one block only."""
        lists = table.column("grams").combine_chunks()
        nodes, row_node = np.unique(np.array(table.column("node").to_pylist(), object), return_inverse=True)
        block, size = np.empty(len(nodes), np.int64), np.empty(len(nodes), np.int64)
        block[row_node], size[row_node] = table.column("block").to_numpy(), table.column("n").to_numpy()
        at = np.repeat(row_node, lists.value_lengths().to_numpy())
        # Only n-grams of several sets overlap; repeated rows of a set count once.
        _, gram, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        keep = times[gram] > 1
        _, gram = np.unique(gram[keep], return_inverse=True)
        at, order = at[keep], np.argsort(gram, kind="stable")
        gram, at = gram[order], at[order]
        one = block.min() == block.max()
        left = np.flatnonzero(block == block.min())
        right = left if one else np.flatnonzero(block == block.max())
        overlap = np.zeros((len(left), len(right)), np.int64)
        for first in range(0, int(gram[-1]) + 1 if len(gram) else 0, COLUMNS):
            a, b = np.searchsorted(gram, [first, first + COLUMNS])
            holds = np.zeros((len(nodes), COLUMNS), np.float32)
            holds[at[a:b], gram[a:b] - first] = 1
            overlap += (holds[left] @ holds[right].T).astype(np.int64)
        linked = overlap * 100 >= (size[left][:, None] + size[right][None, :] - overlap) * rule.percent
        count = np.zeros(len(nodes), np.int64)
        if one:
            np.fill_diagonal(linked, False)
            count[left] = linked.sum(axis=1)
        else:
            count[left], count[right] = linked.sum(axis=1), linked.sum(axis=0)
        return pa.table({"node": pa.array(nodes.tolist(), pa.binary()), "n_links": pa.array(count)})

    return run


def _link_counts(groups: DataFrame, facts: DataFrame, parts: DataFrame, rule: Rule) -> DataFrame:
    """(node, n_links): with how many other nodes each node of ``groups`` links, all pairs of a component compared."""
    sized = staged(groups.join(facts.select("node", "n"), "node"), "set-sized")
    total = sized.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    few = F.least(F.ceil(F.col("sets") / BLOCK_SETS), F.lit(BLOCKS))
    total = total.select("group", "sets", F.greatest(few, F.ceil(F.col("sets") / MOST_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS)).alias("blocks"))
    placed = sized.join(total, "group")
    pairs = placed.where("sets = 2").select("node", F.lit(1).cast("long").alias("n_links"))
    own = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("n") / F.lit(float(SEGMENT_GRAMS)))))).cast("int")
    larger = placed.where("sets > 2").select("node", "group", "n", own.alias("pieces"), F.pmod(F.xxhash64("node"), "blocks").alias("block"), "blocks")
    larger = larger.join(parts, ["node", "pieces"])
    met = larger.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "n", "block", "grams")
    counted = met.groupBy("group", "low", "high").applyInArrow(_block_links(rule), "node binary, n_links long")
    return staged(counted.groupBy("node").agg(F.sum("n_links").alias("n_links")).unionByName(pairs), "set-degrees")


class Linked(NamedTuple):
    members: DataFrame  # id, node, half, n, least: every row
    links: DataFrame  # left, right, overlap, n_left, n_right: links that span every component, not all of them
    groups: DataFrame  # node, group: every node with a link; group is a node
    counts: DataFrame | None  # node, n_links: every node with a link, all its links counted


def ngram_links(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, count_links: bool = True) -> Linked:
    """Links texts whose sets of ``words``-grams have 100 * Jaccard >= ``percent``.

    Words are runs without blanks, A-Z lower-cased. Fewer words than ``words`` are one
    n-gram; texts without words (null, empty, blank) have no node and no link. Equal
    sets are one node. ``rounds`` rounds join nodes with one hub of each bucket before
    the last round, which compares all that are not joined yet. With ``count_links``
    all links of each node are counted then. Ids may be null or repeat: every row is a
    member of its own.
    """
    if not 50 <= percent <= 100 or words < 1:
        raise ValueError("percent must lie in [50, 100] and words be at least 1")
    rule = Rule(words, percent)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = texts.select("id").schema.add("node", "binary").add("half", "long").add("n", "long").add("least", "long")
    members = staged(texts.mapInArrow(_members(rule), schema), "set-members")

    parts_n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    near = _may_have_partners(texts.select("text"), members, rule, parts_n)
    # Each set is taken once, from any row that has it: most copies go before they move.
    # What is wanted grows with the input, so it is never broadcast, however little it is here.
    texts_of = texts.select("text").mapInArrow(_noded(rule), "node binary, half long, text string")
    texts_of = texts_of.join(near.hint("merge"), "half", "left_semi").dropDuplicates(["half", "node"])
    texts_of = staged(texts_of.select("half", "text"), "set-texts")

    signatures = texts_of.select("text").mapInArrow(_signatures(rule), "sig long, half long")
    ordered = signatures.repartition(parts_n, "sig").sortWithinPartitions("sig", "half")
    buckets = _one_of_each(staged(ordered.mapInArrow(repeated_runs, "sig long, half long"), "set-repeats"))

    wanted = buckets.select("half").distinct()
    picked = texts_of.join(wanted.hint("merge"), "half", "left_semi").select("text", "half")
    cut = picked.mapInArrow(_parts(rule), "node binary, half long, n long, level int, parity array<long>, parity_above array<long>, pieces int, piece int, grams array<long>")
    parts = staged(cut, "set-parts")
    facts = parts.where("parity IS NOT NULL").select("node", "half", "n", "level", "parity", "parity_above")
    facts = staged(facts.dropDuplicates(["node"]), "set-facts")
    parts = parts.select("node", "pieces", "piece", "grams")
    placed = staged(buckets.join(facts.select("half", "node"), "half").select("sig", "node"), "set-placed")

    links, groups = None, None
    for k in range(rounds + 1):
        rows = placed.withColumn("group", F.col("node")) if groups is None else placed.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
        mixed = rows.groupBy("sig").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("sig")
        rows = rows.join(mixed, "sig", "left_semi")
        if k < rounds:
            degree = F.lit(0)
            if links is not None:
                ends = links.select(F.explode(F.array("left", "right")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
                rows, degree = rows.join(ends, "node", "left"), F.coalesce("degree", F.lit(0))
            rank = F.struct(degree.alias("degree"), F.xxhash64("node", F.lit(k)).alias("draw"), F.col("node"), F.col("group"))
            hubs = rows.groupBy("sig").agg(F.max(rank).alias("hub")).select("sig", "hub.node", "hub.group")
            met = hubs.alias("a").join(rows.alias("b"), (F.col("a.sig") == F.col("b.sig")) & (F.col("a.group") != F.col("b.group")))
            met = met.select(F.col("a.node").alias("hub"), F.col("b.node").alias("other")).distinct()
            a, b = facts.alias("a"), facts.alias("b")
            met = met.join(a, F.col("hub") == F.col("a.node")).join(b, F.col("other") == F.col("b.node")).where(_may_link(rule, "a", "b"))
            # One hub for each node, the one that differs least: what that leaves out, the last round compares.
            best = F.min_by(F.struct("a.node", "a.n"), F.struct(_odd_cells("a", "b"), "hub")).alias("a")
            met = met.groupBy("other").agg(best, F.first("b.n").alias("n")).select("a", F.struct(F.col("other").alias("node"), "n").alias("b"))
            swap = F.col("a.node") > F.col("b.node")
            met = met.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
        else:
            rows = rows.select("sig", "node", "group").join(facts, "node")
            apart = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.group") != F.col("b.group"))
            met = rows.alias("a").join(rows.alias("b"), apart & _may_link(rule, "a", "b"))
        met = met.select(F.col("a.node").alias("left"), F.col("b.node").alias("right"), F.col("a.n").alias("n_left"), F.col("b.n").alias("n_right"))
        found = staged(_counted(_pairs(met, rule), parts, rule), "set-links")
        links = found if links is None else links.unionByName(found)
        groups = components(links.select("left", "right"))
    return Linked(members, links, groups, _link_counts(groups, facts, parts, rule) if count_links else None)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every row of ``docs``.

    ``component_id`` is the smallest id reachable by links, its own included; a row
    without words is its own component. ``n_links`` is the number of all other
    different sets that link with the row's; without ``count_links`` it is left out.
    Null ids reach others like any row; a component of null ids only has a null
    component_id.
    """
    linked = ngram_links(docs, words, percent, id_col, text_col, count_links=count_links)
    per_node = linked.members.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    per_node = per_node.join(linked.groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = per_node.groupBy("group").agg(F.min("least").alias("component_id"))
    per_node = per_node.join(least, "group").select("node", "component_id")
    if count_links:
        per_node = per_node.join(linked.counts, "node", "left")
    return linked.members.join(per_node, "node", "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []),
    )
