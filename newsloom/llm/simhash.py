"""Near-duplicates by SimHash: generalised pigeonhole search over 64-bit fingerprints.

Correlated bits are grouped into partitions; a dynamic programme over estimated candidate counts
gives each partition its own threshold (two fingerprints within ``radius`` agree, in some partition,
up to that partition's threshold); each fingerprint probes the values within the threshold, and
what it meets is verified.

Equal fingerprints are one node, so exact copies cost nothing. Near copies would meet in the same
values pair by pair; so a first round links each probe to a few members, drawn by hash, of the value it
meets, and a second, complete round compares only fingerprints of different groups: where one group holds
most of a value's members, its own probes skip those members.

Defined results: a null or empty text has fingerprint zero and links like any other; the component is
named by the smallest doc_id that is not null (null if there is none); repeated rows give repeated
results; an empty table gives an empty result; other columns take no part. Texts are read whole.

The pipeline's stage (``drop_near_copies``) makes the same search over fingerprints of its shingle sets and verifies
what it meets by the exact similarity. Near copies beyond the radius are found after it, by the least hashes of the sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import aside, bucketed, by_shuffle, mixed, partitions, restored, settled, stored, stream
from newsloom.llm.graph import components

BITS = 64
#: Members of a value that the first round compares with each probe of it.
MEMBERS = 8


def shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    runs = words if size == 1 else map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, len(words) - size + 1)


def majority_bits(hashes: np.ndarray, step: int = 1 << 15) -> int:
    """The number whose bits are set in over half of ``hashes``."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[at : at + step]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = 3, seed: int = 42, distinct: bool = False) -> int:
    """SimHash over word shingles of the text with A-Z lower-cased; ``distinct`` counts repeats once."""
    hashes = shingle_hashes((text or "").encode().lower().split(), size, seed)
    return majority_bits(np.unique(hashes) if distinct else hashes)


def fingerprints(docs: DataFrame, keep: list[str], sizes: dict[str, tuple[int, bool]], seed: int = 42) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, for each name in ``sizes``, a fingerprint as a signed long."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]

    def mark(batches):
        for batch in batches:
            texts, found = batch.column(len(keep)), {name: [] for name in sizes}
            for value in texts:
                words = (value.as_py() or "").encode().lower().split()
                for name, (size, distinct) in sizes.items():
                    hashes = shingle_hashes(words, size, seed)
                    found[name].append(majority_bits(np.unique(hashes) if distinct else hashes))
            new = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in found.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], [*keep, *found])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(mark, ", ".join([*fields, *(f"{n} long" for n in sizes)]))


# -- the plan: partitions and thresholds ------------------------------------------------------


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bit_agreement(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, how many have both set; over all rows."""

    def count(batches):
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 1 << 14):
                part = np.ascontiguousarray(values[at : at + (1 << 14)]).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float64)
                total += bits.T @ bits
                rows += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([total.ravel().astype(np.int64)])], ["rows", "both"])

    made = nodes.select("fp").mapInArrow(count, "rows long, both array<long>")
    sums = made.select("rows", F.posexplode("both")).groupBy("pos").agg(F.sum("rows").alias("rows"), F.sum("col").alias("both")).collect()
    both = np.zeros(BITS * BITS)
    for row in sums:  # 64 x 64, whatever the input
        both[row.pos] = row.both
    return (sums[0].rows if sums else 0), both.reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """``m`` groups of bits of nearly equal size; each bit joins the group it goes with most closely."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, groups = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (tie[b, rest].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(tuple(sorted(group)))
    return groups


def estimated_candidates(equal: float, share: np.ndarray, bits: tuple[int, ...], threshold: int) -> float:
    """Pairs within ``threshold`` in these bits, from the pairs that are equal there and each bit's share of ones."""
    agree = share[list(bits)] ** 2 + (1 - share[list(bits)]) ** 2
    terms = [1.0] + [0.0] * threshold
    for odds in (1 - agree) / agree:
        for k in range(threshold, 0, -1):
            terms[k] += terms[k - 1] * odds
    return equal * sum(terms)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of at least -1 that sum to ``total`` at the least cost; ``costs[i][t + 1]`` is the cost of ``t``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, more in enumerate(options, -1):
                at = spent + t + 1
                if at not in step or cost + more < step[at][0]:
                    step[at] = (cost + more, [*chosen, t])
        best = step
    return best[total + len(costs)]


def plan(nodes: DataFrame, radius: int, most_parts: int = 6, probe_cost: float = 8.0) -> list[Part]:
    """Partitions and thresholds for all pairs within ``radius``, at the least estimated work over all fingerprints."""
    n, both = bit_agreement(nodes)
    share = np.diag(both) / max(n, 1)
    layouts = {m: correlated_groups(n, both, m) for m in range(2, min(most_parts, radius + 1) + 1)} or {1: [tuple(range(BITS))]}
    flat = [(m, i, g) for m, groups in layouts.items() for i, g in enumerate(groups)]
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(Part(g, 0).mask)).alias("v")) for k, (_, _, g) in enumerate(flat)])
    counts = nodes.select(F.inline(values)).groupBy("k", "v").agg(F.count("*").cast("double").alias("c"))
    equal = {r.k: r.pairs for r in counts.groupBy("k").agg(F.sum(F.col("c") * F.col("c")).alias("pairs")).collect()}
    choices = []
    for m, groups in layouts.items():
        costs = []
        for k, (_, _, bits) in ((k, x) for k, x in enumerate(flat) if x[0] == m):
            row = [0.0]
            for t in range(min(radius, len(bits)) + 1):
                probes = max(n, 1) * sum(comb(len(bits), j) for j in range(t + 1))  # without rows too, the fewest win
                row.append(estimated_candidates(equal.get(k, 0.0), share, bits, t) + probe_cost * probes)
            costs.append(row)
        cost, thresholds = allocate(costs, radius - m + 1)
        choices.append((cost, [Part(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(choices, key=lambda x: x[0])[1]


# -- probing and verifying -----------------------------------------------------------------------


def held_values(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """``part, value`` of every node: its own bits in each partition."""
    own = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(p.mask)).alias("value")) for i, p in enumerate(parts)])
    return nodes.select("*", F.inline(own))


def probed_values(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """``part, value`` for every value within the partition's threshold of the node's own bits."""
    def of(i: int, p: Part) -> Column:
        flips = [signed(sum(1 << b for b in c)) for t in range(p.threshold + 1) for c in combinations(p.bits, t)]
        base = F.col("fp").bitwiseAND(F.lit(p.mask))
        listed = F.array(*map(F.lit, flips)).cast("array<long>")
        return F.transform(listed, lambda x: F.struct(F.lit(i).alias("part"), base.bitwiseXOR(x).alias("value")))

    probes = [of(i, p) for i, p in enumerate(parts)]
    return nodes.select("*", F.inline(F.flatten(F.array(*probes))))


def near(pairs: dict[str, tuple[Column, Column]], limits: dict[str, int]) -> Column:
    """Whether two nodes differ in at most the given number of bits of each fingerprint."""
    told = F.lit(True)
    for name, (a, b) in pairs.items():
        told = told & (F.bit_count(a.bitwiseXOR(b)) <= limits[name])
    return told


def search(nodes: DataFrame, limits: dict[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between nodes (distinct ``fp``, maybe further fingerprints) in two rounds, and the groups between them.

    The first links (``a, b``) are those to drawn members; the groups that they make are ``root`` of each node; the
    second links (``a, b, root_a, root_b``) are all between different groups, so both together leave no link's ends apart.
    ``limits['fp']`` is the search radius; further fingerprints only verify.
    """
    marks = list(limits)
    parts = plan(nodes, limits["fp"])
    drawn = [F.min(F.struct(F.xxhash64("fp", "part", F.lit(salt)).alias("order"), *marks)) for salt in range(MEMBERS)]
    some = F.array_distinct(F.transform(F.array(*[F.col(f"m{salt}") for salt in range(MEMBERS)]), lambda m: F.struct(*[m[c].alias(c) for c in marks])))
    ends = held_values(nodes, parts).groupBy("part", "value").agg(*[d.alias(f"m{salt}") for salt, d in enumerate(drawn)]).select("part", "value", some.alias("some"))
    met = probed_values(nodes, parts).join(by_shuffle(ends), ["part", "value"])
    links = F.filter("some", lambda m: (m["fp"] != F.col("fp")) & near({c: (F.col(c), m[c]) for c in marks}, limits))
    first = met.select(F.col("fp").alias("a"), F.explode(F.transform(links, lambda m: m["fp"])).alias("b"))
    named = lambda: nodes.join(by_shuffle(components(first, "a", "b").withColumnRenamed("node", "fp")), "fp", "left").select(*marks, F.coalesce("root", "fp").alias("root"))
    known = settled(nodes.sparkSession, named, "simhash-groups")

    held = held_values(known, parts)
    sizes = held.groupBy("part", "value", "root").agg(F.count("*").alias("c"))
    top = sizes.groupBy("part", "value").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("n"))
    top = top.select("part", "value", F.col("m.root").alias("top"), (F.col("n") > F.col("m.c")).alias("mixed"))
    asking = probed_values(known, parts).join(by_shuffle(top), ["part", "value"])
    sides = F.array_compact(F.array(F.when(F.col("root") != F.col("top"), F.lit(True)), F.when(F.col("mixed"), F.lit(False))))
    asking = asking.select("part", "value", *marks, "root", F.explode(sides).alias("is_top"))
    there = held.join(by_shuffle(top), ["part", "value"]).select("part", "value", *marks, "root", (F.col("root") == F.col("top")).alias("is_top"))
    meets = asking.alias("q").join(by_shuffle(there).alias("x"), ["part", "value", "is_top"])
    second = meets.where((F.col("q.root") != F.col("x.root")) & near({c: (F.col(f"q.{c}"), F.col(f"x.{c}")) for c in marks}, limits))
    return first, known, second.select(F.col("q.fp").alias("a"), F.col("x.fp").alias("b"), F.col("q.root").alias("root_a"), F.col("x.root").alias("root_b"))


def linked_groups(nodes: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``fp, root`` of all nodes; nodes that link, directly or by others, have one root."""
    _, known, second = search(nodes, limits)
    over = components(second.select("root_a", "root_b"), "root_a", "root_b")
    joined = known.join(by_shuffle(over.select(F.col("node").alias("root"), F.col("root").alias("over"))), "root", "left")
    return joined.select("fp", F.coalesce("over", "root").alias("root"))


def simhash_components(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id``: fingerprints within ``radius`` bits link."""
    marked = stored(fingerprints(docs, ["doc_id"], {"fp": (shingle, False)}), "simhash")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    groups = linked_groups(nodes.select("fp"), {"fp": radius})
    named = nodes.join(by_shuffle(groups), "fp")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "root").join(by_shuffle(names), "root").select("fp", "component_id")
    written = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(by_shuffle(of), "fp").select("doc_id", written.alias("fingerprint"), "component_id")


# -- the pipeline's stage -----------------------------------------------------------------------

#: Two texts are near copies when the cosine of their sets of distinct five-word shingles is at least this.
STAGE_SHINGLE, STAGE_COSINE = 5, 0.8
#: Bits within which the stage searches its fingerprints, as ``simhash_components`` does.
STAGE_RADIUS = 3
#: At cosine 0.8 a 64-bit SimHash differs in 13 bits on average and in over 20 for some pairs, which no
#: pigeonhole plan can search. Candidates beyond the radius come from the sets' least hashes: a cosine of 0.8 means a
#: Jaccard share of 0.64 or more, so a pair meets in none of 32 bands of 3 with odds (1 - 0.64 ** 3) ** 32 = 0.00006 at most.
BANDS, ROWS = 32, 3
_PICKS = stream(21, BANDS * ROWS) | np.uint64(1)
_BAND_MARKS = stream(22, BANDS)


#: Bits of a set's sketch, a power of two: a bit is set where one of the set's hashes begins with its number.
SKETCH = 1024


#: Members of a value, drawn by hash, that the first round of bands compares with each other member.
DRAWN = 4


def shingle_set(text: str | None) -> tuple[bytes, np.ndarray]:
    """A 128-bit key of the words of the text with A-Z lower-cased, and the hashes of its distinct shingles in order."""
    import xxhash

    words = (text or "").encode().lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words)), np.unique(shingle_hashes(words, STAGE_SHINGLE, 42))


def band_values(sets: list[np.ndarray]) -> np.ndarray:
    """For each set (not empty) a value for each band, made of the least of its hashes in each of ``ROWS`` orders."""
    hashes, first = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            value = np.full(len(sets), _BAND_MARKS[band])
            for pick in _PICKS[band * ROWS : (band + 1) * ROWS]:
                value = mixed(value + np.minimum.reduceat((hashes ^ (pick >> np.uint64(7))) * pick, first))
            out[:, band] = value
    return out


def sketched(hashes: np.ndarray) -> tuple[int, list[int]]:
    """The size of a set and its sketch, as longs."""
    bits = np.zeros(SKETCH, np.uint8)
    bits[hashes >> np.uint64(65 - SKETCH.bit_length())] = 1
    return len(hashes), np.packbits(bits).view(np.int64).tolist()


def may_be_near(a: Column, b: Column) -> Column:
    """Whether two sets, by ``size`` and ``sketch``, can have cosine ``STAGE_COSINE`` or more; never false for two that have.

    Each bit that one sketch lacks of the other stands for a hash that the sets do not share.
    """
    lacks = lambda x, y: F.aggregate(F.zip_with(x.sketch, y.sketch, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda n, m: n + m)
    most = F.least(a["size"] - lacks(a, b), b["size"] - lacks(b, a))
    return most >= STAGE_COSINE * F.sqrt(a["size"].cast("double") * b["size"])


def with_bands(rows: DataFrame, group: int = 256) -> DataFrame:
    """``rows`` (with a ``text``) with ``key``, equal for texts of equal words, ``fp`` (the SimHash of the set), ``bands`` and ``sketch`` (size and bits of the set); a text without words has no bands."""
    names = rows.columns
    out = T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.StructType([T.StructField("size", T.IntegerType()), T.StructField("sketch", T.ArrayType(T.LongType()))]))])
    told = pa.struct([("size", pa.int32()), ("sketch", pa.list_(pa.int64()))])

    def mark(batches):
        for batch in batches:
            texts, keys, marks, bands, sketches = batch.column(names.index("text")), [], [], [], []
            for at in range(0, len(texts), group):
                made = [shingle_set(t.as_py()) for t in texts.slice(at, group)]
                keys += [k for k, _ in made]
                marks += [signed(majority_bits(s)) for _, s in made]
                full = [s for _, s in made if len(s)]
                found = iter(band_values(full).view(np.int64) if full else ())
                bands += [next(found) if len(s) else [] for _, s in made]
                sketches += [dict(zip(("size", "sketch"), sketched(s))) for _, s in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(marks, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, told)], [*names, "key", "fp", "bands", "sketch"])

    return rows.mapInArrow(mark, out)


def near_enough(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose texts in ``nodes`` have cosine ``STAGE_COSINE`` or more, exactly.

    ``nodes`` lie in buckets of ``key``, so only the texts of pairs move; ``b`` may be a text that very
    many pairs share, so its side is a table of its own, whose join Spark can split.
    """

    def judge(batches):
        held: dict[bytes, np.ndarray] = {}

        def of(key, text):
            if key not in held:
                if len(held) > 256:
                    held.clear()
                held[key] = shingle_set(text)[1]
            return held[key]

        for batch in batches:
            good = []
            for a, b, x, y in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "x", "y"))):
                one, two = of(a, x), of(b, y)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(both > 0 and both >= STAGE_COSINE * np.sqrt(len(one) * len(two)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    text = lambda key, name: nodes.select(F.col("key").alias(key), F.col("text").alias(name))
    there = stored(pairs.select("b").distinct().join(text("b", "y"), "b"), "near-copies-texts")
    return pairs.join(text("a", "x"), "a").join(by_shuffle(there), "b").select("a", "b", "x", "y").mapInArrow(judge, "a binary, b binary")


def spanning(links: DataFrame) -> DataFrame:
    """``a, b``: fewer links with the same components. A node keeps the link to its least neighbour, which takes over its
    other ones; drawn members are neighbours of many nodes, so these fall together.

    A node has at most ``DRAWN`` neighbours for each band, so its set is bounded.
    """
    held = links.groupBy("a").agg(F.collect_set("b").alias("several"))
    least = F.array_min("several")
    moved = F.concat(F.array(F.struct("a", least.alias("b"))), F.transform("several", lambda x: F.struct(x.alias("a"), least.alias("b"))))
    return held.select(F.explode(moved).alias("x")).select("x.a", "x.b").where("a <> b").distinct()


def bit_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b``: keys of ``nodes`` whose ``fp`` differ in at most ``STAGE_RADIUS`` bits, by the pigeonhole search.

    Nodes of one ``fp`` meet its least key, which stands for them towards other fingerprints.
    """
    marks = stored(nodes.select("key", "fp"), "near-copies-marks")
    first = stored(marks.groupBy("fp").agg(F.min("key").alias("key")), "near-copies-fps")
    drawn, _, across = search(first.select("fp"), {"fp": STAGE_RADIUS})
    met = drawn.union(across.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    key = lambda fp, name: first.select(F.col("fp").alias(fp), F.col("key").alias(name))
    met = met.join(by_shuffle(key("a", "key_a")), "a").join(by_shuffle(key("b", "key_b")), "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    equal = marks.select(F.col("key").alias("a"), "fp").join(by_shuffle(key("fp", "b")), "fp").where("a <> b").select("a", "b")
    return met.union(equal)


def near_groups(nodes: DataFrame) -> DataFrame:
    """``node, root`` of ``nodes`` (distinct ``key``, ``fp``, ``bands``, ``sketch``, ``text``) that link to another, directly or by others.

    The pigeonhole search over fingerprints comes first. A first round of bands compares each node with ``DRAWN``
    members of each value that it has; a second, complete one compares the nodes of a value that are in different
    groups, but for pairs that their sketches rule out.
    """
    either = lambda df: df.union(df.select("b", "a"))
    close = stored(bit_pairs(nodes), "near-copies-bits")
    links = stored(near_enough(close, nodes), "near-copies-by-bits")
    held = nodes.select("key", F.explode("bands").alias("value"))
    several = stored(held.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value"), "near-copies-values")
    held = stored(held.join(by_shuffle(several), "value"), "near-copies-held")  # few values are shared at all
    drawn = [F.min(F.struct(F.xxhash64("key", F.lit(salt)).alias("order"), "key")).alias(f"m{salt}") for salt in range(DRAWN)]
    some = F.array_distinct(F.array(*[F.col(f"m{salt}")["key"] for salt in range(DRAWN)]))
    ends = stored(held.groupBy("value").agg(*drawn).select("value", some.alias("some")), "near-copies-drawn")
    met = held.join(by_shuffle(ends), "value").select(F.col("key").alias("a"), F.explode("some").alias("b")).where("a <> b").distinct()
    pairs = stored(met.join(by_shuffle(either(close)), ["a", "b"], "left_anti"), "near-copies-first")
    links = links.union(stored(spanning(near_enough(pairs, nodes)), "near-copies-links"))
    groups = components(links, "a", "b")

    known = nodes.select("key", "bands").join(held.select("key").distinct(), "key", "left_semi").join(groups.select(F.col("node").alias("key"), "root"), "key", "left")
    known = known.select("key", "bands", F.coalesce("root", "key").alias("root"), F.explode("bands").alias("value"))
    known = stored(known.join(by_shuffle(several), "value"), "near-copies-roots")
    sizes = known.groupBy("value", "root").agg(F.count("*").alias("c"))
    mixed_values = sizes.groupBy("value").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1")
    mixed_values = stored(mixed_values.select("value", F.col("m.root").alias("top")), "near-copies-mixed")
    # of two nodes in different groups, one at least is outside the value's largest group
    side = lambda df, s: df.select("value", F.col("key").alias(s), F.col("root").alias(f"root_{s}"), F.col("bands").alias(f"bands_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    known = stored(known.join(mixed_values, "value").join(nodes.select("key", "sketch"), "key"), "near-copies-mixed-roots")
    q = stored(side(known.where("root <> top"), "a"), "near-copies-open")
    # a pair that shares several values is met at the least of them
    here = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("value")
    able = may_be_near(F.col("sketch_a"), F.col("sketch_b"))
    rest = by_shuffle(q).join(side(known, "b"), "value").where((F.col("root_a") != F.col("root_b")) & here & able).select("a", "b")
    rest = rest.join(by_shuffle(either(close.union(pairs))), ["a", "b"], "left_anti").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = near_enough(stored(rest, "near-copies-second"), nodes)
    # the groups of the first round stand for its links
    return components(groups.select("node", "root").union(more), "node", "root")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest doc_id (nulls last) stays.

    Rows with the same words meet in one node first, which carries the row that would stay, so the
    table is written once. Of rows equal in every column one stays. Columns of any name and type pass
    through; an empty table gives an empty result; texts without words are alike.
    """
    n = partitions(docs.sparkSession)
    marked = with_bands(aside(docs).withColumn("at", F.monotonically_increasing_id()))
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), F.col("at"))
    best = F.min_by(F.struct(order.alias("order"), "row", "text", "fp", "bands", "sketch"), order)
    nodes = bucketed(marked.groupBy("key").agg(best.alias("best")).select("key", "best.*").repartition(n, "key"), n, ["key"], "near_copies")
    groups = settled(docs.sparkSession, lambda: near_groups(nodes), "near-copies-groups")
    first = groups.join(nodes.select(F.col("key").alias("node"), "order"), "node").groupBy("root").agg(F.min(F.struct("order", "node")).alias("first"))
    gone = groups.select(F.col("node").alias("key")).join(first.select(F.col("first.node").alias("key")), "key", "left_anti")
    return nodes.join(gone, "key", "left_anti").select(*restored(docs.columns))
