"""Near-duplicates by a chosen-path set similarity join.

1. Documents with equal shingle sets form a class, and one text stands for it from then on.
2. Each class has ``TOKENS`` minwise tokens. In a tree, a node keeps the classes whose tokens agree along its path; it
   chooses one or two tokens by a hash of the path, on average ``1 / similarity``, and every class goes to the child
   of its own token there. A pair is found in a tree if it is still together in some node when that node is compared.
   The deeper that is, the less likely: a class whose nodes were branched goes through so many more independent trees
   that missing a pair at the threshold is less likely than ``MISS`` at the depth its nodes reached (``trees_needed``).
3. Before any tree, classes that agree in all tokens of a band are compared with one class of that band, which makes
   most of a group of near copies one component at once. Pairs inside a component need no link any more, and nodes
   whose classes are all of one component are not looked at.
4. Nodes of up to ``SMALL`` classes are compared exhaustively: first on all tokens, which splits a node into groups
   whose members may be similar, then, group by group, on the full sets of shingles. Only texts of classes in such a
   group are fetched. Nodes of up to ``BLOCKS`` times that size are compared block by block. In a larger node all
   classes are first compared with a central one, and what that connects is one component. If at most ``SMALL`` classes
   are outside the node's largest component, they are compared with each other and with that component, part by part,
   as pairs inside it need no link any more; otherwise the node branches on. A group of near copies of any size thus
   costs a few rows for each of its classes, and never all its pairs. Nodes that do not fall apart in ``DEPTH`` levels
   are compared block by block, as deeper ones would need more trees than the blocks cost.
5. Each node reports stars of what confirmed links connect in it, at most one row less than its classes; a pair is
   only left out where links connect its ends already. Links are joined into components.

Texts without words are linked with nothing; a null text has none; shorter texts than a shingle count as one shingle.
A null id is larger than all others. Repeated rows have equal sets; other columns are ignored; an empty table gives an
empty result. Classes are named by 64 bits of a hash of their set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.llm.components import components
from hourgrid.llm.staging import WORD_PATTERN, identified
from hourgrid.llm.words import find_words, mixed, sequence_hashes, slices, texts_of
from hourgrid.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
TOKENS = 128
#: Trees for all classes.
TREES = 10
#: The chance, at most, that a pair at the threshold is in no compared node.
MISS = 1e-5
#: Levels that a class walks before the sizes of its nodes are looked at.
STEP = 2
SMALL = 512
#: Nodes of up to so many times ``SMALL`` classes are compared block by block, larger ones around their central class.
BLOCKS = 8
#: Classes among which a large node looks for its central one.
CANDIDATES = 64
DEPTH = 10
#: Bands of tokens whose agreement makes two classes candidates before any tree, and the tokens of each.
BANDS = 16
BAND_TOKENS = 4
#: Pairs whose tokens agree this many standard deviations less than those of sets at the threshold are not confirmed.
DEVIATIONS = 5
#: Bits of the filter that keeps texts that are not needed out of a shuffle: 4 MB, whatever the number of documents. The
#: fuller it is, the more texts are shuffled for nothing; the join behind it is exact.
FILTER_BITS = 1 << 25
_ROTATE = np.random.default_rng(99).integers(1, 1 << 32, TOKENS, dtype=np.uint64).astype(np.uint32)
_FACTORS = np.random.default_rng(98).integers(1, 1 << 31, TOKENS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where those of each text begin."""
    words = find_words(texts, lower=True)
    hashes, owner = sequence_hashes(words.hashes(), words.first, shingle)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def minwise_tokens(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bits of each of ``TOKENS`` minima, by text; texts without shingles have zeros."""
    filled = np.flatnonzero(np.diff(first))
    tokens = np.zeros((len(first) - 1, TOKENS), np.uint16)
    if len(filled):
        low = (sets >> np.uint64(32)).astype(np.uint32)
        for k in range(TOKENS):
            least = np.minimum.reduceat((low ^ _ROTATE[k]) * _FACTORS[k], first[filled])
            tokens[filled, k] = (mixed(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return tokens


def _sketch(shingle: int):
    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, first = shingle_sets(texts_of(batch), shingle)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)))])
            count = np.diff(first)
            name = mixed(sums[first[1:]] - sums[first[:-1]] + count.astype(np.uint64)).view(np.int64)
            tokens = minwise_tokens(sets, first)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "row_id", "row_hash")), pa.array(name), pa.array(count, pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())],
                names=["doc_id", "row_id", "row_hash", "class", "n_shingles", "tokens"],
            )

    return sketch


def _walk(nodes: np.ndarray, members: np.ndarray, tokens: np.ndarray, similarity: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Where classes ``members`` (rows of ``tokens``) at ``nodes`` are ``steps`` levels below."""
    for _ in range(steps):
        first = mixed(nodes ^ np.uint64(0x8EBC6AF09C88C6E3))
        second = mixed(nodes ^ np.uint64(0x589965CC75374CC3))
        twice = (mixed(nodes ^ np.uint64(0x1D8E4E27C47D124F)) >> np.uint64(11)).astype(np.float64) / (1 << 53) < 1 / similarity - 1
        places = [first % np.uint64(TOKENS)]
        # the second token is another one than the first
        places.append((places[0] + np.uint64(1) + second % np.uint64(TOKENS - 1)) % np.uint64(TOKENS))
        found = []
        for place, use in zip(places, (np.ones(len(nodes), bool), twice), strict=True):
            at = place[use].astype(np.int64)
            token = tokens[members[use], at].astype(np.uint64)
            found.append((mixed(nodes[use] * np.uint64(3) + mixed(token << np.uint64(8) | place[use])), members[use]))
        nodes, members = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    return nodes, members


def miss_chance(similarity: float, depth: int, trees: int) -> float:
    """The chance that a pair of this similarity is apart in all nodes ``depth`` levels down in each of the trees.

    The trees share the pair's tokens, so the chance is taken for each number of tokens that may agree.
    """
    agree = np.arange(TOKENS + 1)
    weight = np.array([comb(TOKENS, k) * similarity**k * (1 - similarity) ** (TOKENS - k) for k in range(TOKENS + 1)])
    both, neither = (n * (n - 1) / (TOKENS * (TOKENS - 1)) for n in (agree, TOKENS - agree))
    apart = np.zeros(TOKENS + 1)
    for _ in range(depth):
        once = 1 - agree / TOKENS * (1 - apart)
        twice = neither + (1 - both - neither) * apart + both * apart**2
        apart = (2 - 1 / similarity) * once + (1 / similarity - 1) * twice
    return float((weight * apart**trees).sum())


@cache
def trees_needed(similarity: float, depth: int) -> int:
    """The least number of trees that miss a pair at the threshold with a chance of at most ``MISS``."""
    trees = 1
    while miss_chance(similarity, depth, trees) > MISS:
        trees += 1
    return trees


def _tokens_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint16).reshape(batch.num_rows, TOKENS)


def _branch(similarity: float, roots: bool):
    """Emits ``node, class, label``: from the roots of the trees from ``begin`` to before ``end``, or from each row's ``node``."""

    def branch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                name, label, tokens = part.column("class").to_numpy(), part.column("label").to_numpy(), _tokens_of(part)
                members = np.arange(part.num_rows)
                if roots:
                    begin, end = (part.column(c).to_numpy() for c in ("begin", "end"))
                    members = np.repeat(members, end - begin)
                    tree = np.arange(len(members)) - np.repeat(np.cumsum(end - begin) - end, end - begin)
                    nodes = mixed(tree.astype(np.uint64) + np.uint64(1))
                else:
                    nodes = part.column("node").to_numpy().view(np.uint64)
                nodes, members = _walk(nodes, members, tokens, similarity, STEP)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(name[members]), pa.array(label[members])], names=["node", "class", "label"])

    return branch


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``band, class``: a hash of the tokens of each band and its number."""
    numbers = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        if batch.num_rows:
            packed = np.ascontiguousarray(_tokens_of(batch)[:, : BANDS * BAND_TOKENS]).view(np.uint64).reshape(batch.num_rows, BANDS)
            band = mixed(packed ^ mixed(numbers + np.uint64(1))).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(np.repeat(batch.column("class").to_numpy(), BANDS))], names=["band", "class"])


def _band_pairs(own: DataFrame, similarity: float) -> DataFrame:
    """Likely pairs (``a, b``) of each class with the smallest class of a band: of that which it shares most bands with."""
    banded = own.select("class", "tokens").mapInArrow(_bands, "band long, class long")
    centers = materialize(banded.groupBy("band").agg(F.min("class").alias("center"), F.count("*").alias("n")).where("n > 1").select("band", "center"), "centers")
    shared = banded.join(centers, "band").where("class <> center").groupBy("class", "center").agg(F.count("*").alias("n"))
    best = materialize(shared.groupBy("class").agg(F.max(F.struct("n", "center")).alias("best")).select("class", "best.center"), "best")
    center = own.select(F.col("class").alias("center"), F.col("n_shingles").alias("center_size"), F.col("tokens").alias("center_tokens"))
    fits = F.least("n_shingles", "center_size") >= (similarity - 1e-9) * F.greatest("n_shingles", "center_size")
    pairs = best.join(own, "class").join(center, "center").where(fits)
    return pairs.select("class", "tokens", "center", "center_tokens").mapInArrow(_near_center(similarity), "a long, b long").distinct()


def _least_agreement(similarity: float) -> int:
    return int(np.ceil(TOKENS * (similarity - DEVIATIONS * np.sqrt(similarity * (1 - similarity) / TOKENS))))


def _central(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node's candidates, the one whose tokens agree most with the others'."""
    for batch in batches:
        best = []
        for members in batch.column("members").to_pylist():
            tokens = np.frombuffer(b"".join(m["tokens"] for m in members), np.uint16).reshape(len(members), TOKENS)
            best.append(members[int(np.argmax([(tokens == t).sum() for t in tokens]))])
        arrays = [batch.column("node"), *(pa.array([b[c] for b in best], t) for c, t in (("class", pa.int64()), ("label", pa.int64()), ("n_shingles", pa.int64()), ("tokens", pa.binary())))]
        yield pa.RecordBatch.from_arrays(arrays, names=["node", "center", "center_label", "center_size", "center_tokens"])


def _near_center(similarity: float):
    least = _least_agreement(similarity)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, center = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, TOKENS) for c in ("tokens", "center_tokens"))
                a, b = batch.column("class").to_numpy(), batch.column("center").to_numpy()
                keep = (own == center).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])

    return near


def likely_groups(tokens: np.ndarray, sizes: np.ndarray, labels: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Groups of rows, two at least, that pairs of different labels with agreeing tokens and possible sizes connect.

    Every pair is looked at, but for pairs of one label.
    """
    least, label = _least_agreement(similarity), np.arange(len(sizes))
    for i in range(len(sizes) - 1):
        if (label[i:] == label[i]).all():
            continue
        fits = np.minimum(sizes[i], sizes[i + 1 :]) >= (similarity - 1e-9) * np.maximum(sizes[i], sizes[i + 1 :])
        other = np.flatnonzero(fits & (labels[i + 1 :] != labels[i]))
        near = i + 1 + other[(tokens[i + 1 :][other] == tokens[i]).sum(axis=1) >= least]
        if len(near):
            joined = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, joined)] = joined[0]
    order = np.argsort(label, kind="stable")
    return [g for g in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(g) > 1]


def _likely(similarity: float):
    """The likely groups of each node, as ``members``; the rows of a node follow each other."""

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def groups(rows: pa.Table) -> pa.RecordBatch:
            nodes, names, sizes, labels = (rows.column(c).to_numpy() for c in ("node", "class", "n_shingles", "label"))
            tokens = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), np.uint16).reshape(-1, TOKENS)
            ends = [0, *(np.flatnonzero(np.diff(nodes)) + 1), len(nodes)]
            found = [names[a:b][g] for a, b in zip(ends, ends[1:], strict=False) for g in likely_groups(tokens[a:b], sizes[a:b], labels[a:b], similarity)]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["members"])

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                nodes = rows.column("node").to_numpy()
                last = int(np.flatnonzero(nodes != nodes[-1])[-1]) + 1 if (nodes != nodes[-1]).any() else 0
                yield groups(rows.slice(0, last))
                rest = rows.slice(last)
        if rest is not None:
            yield groups(rest)

    return likely


def _likely_members(nodes: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """Distinct ``members``, sorted arrays of classes of one of the ``nodes`` that may be similar."""
    sets = nodes.groupBy("node").agg(F.array_sort(F.collect_set("class")).alias("members")).where(F.size("members") > 1).select("members").distinct()
    # written, so that Spark knows its size
    spread = materialize(sets.select(F.xxhash64("members").alias("node"), F.explode("members").alias("class")), "spread")
    together = spread.join(own, "class").repartition("node").sortWithinPartitions("node", "class").select("node", "class", "n_shingles", "label", "tokens")
    return together.mapInArrow(_likely(similarity), "members array<long>").distinct()


def _blocks(nodes: DataFrame, small: int) -> DataFrame:
    """``node, class``, where each pair of blocks of a node's classes is a node; ``nodes`` has ``node, class, size``."""
    parts = F.ceil(F.col("size") / small).cast("int")
    split = nodes.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("class", "node"), parts).cast("int")})
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, F.col("part")), F.greatest(x, F.col("part")))))
    return split.select("class", "node", pair.alias("pair")).select(F.xxhash64("node", "pair").alias("node"), "class")


def _labelled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their class as ``label``, or the class itself where it has no links."""
    if found is None:
        return rows.withColumn("label", F.col("class"))
    return rows.join(found.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("label", F.coalesce("component", "class")).drop("component")


def _stars(found: DataFrame) -> DataFrame:
    """The links of components to their smallest classes."""
    return found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _around_centers(large: DataFrame, own: DataFrame, found: DataFrame | None, similarity: float) -> DataFrame:
    """Likely pairs (``a, b``) of each class of the large nodes with its node's central class."""
    few = large.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("class"))).where(F.col("place") <= CANDIDATES)
    member = F.struct("class", "label", "n_shingles", "tokens")
    centers = _labelled(few.join(own, "class"), found).groupBy("node").agg(F.collect_list(member).alias("members"))
    centers = materialize(centers.mapInArrow(_central, "node long, center long, center_label long, center_size long, center_tokens binary"), "centers")
    fits = F.least("n_shingles", "center_size") >= (similarity - 1e-9) * F.greatest("n_shingles", "center_size")
    pairs = _labelled(large.join(own, "class"), found).join(centers, "node").where("label <> center_label").where(fits)
    return pairs.select("class", "tokens", "center", "center_tokens").mapInArrow(_near_center(similarity), "a long, b long").distinct()


def meeting_classes(classes: DataFrame, texts_of_classes, shingle: int, similarity: float, trees: int = TREES, small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """Classes that met in nodes and may be similar, and stars (``a, b``) of the links already confirmed.

    The first table has ``members``, distinct sorted arrays of about ``2 * small`` classes at most.
    """
    said = "node long, class long, label long"
    own = classes.select("class", "n_shingles", "tokens")
    needed = F.array(*[F.lit(trees_needed(similarity, d)) for d in range(STEP, DEPTH + 1, STEP)])

    def linked(pairs: DataFrame, found: DataFrame | None) -> DataFrame | None:
        """The components of all links, those among ``pairs`` included; None without any."""
        pairs = materialize(pairs, "pairs")
        compared = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        new = materialize(links(pairs, materialize(texts_of_classes(compared), "texts"), shingle, similarity), "links")
        if new.isEmpty():
            return found
        # links of earlier levels come back as stars
        return components(new if found is None else new.unionByName(_stars(found)))

    found = linked(_band_pairs(own, similarity), None)
    groups = []
    # classes, the trees they go through next, and the depth that their nodes have reached
    first = max(trees, trees_needed(similarity, STEP))
    asked = materialize(_labelled(own.select("class", "tokens"), found), "labelled").select("*", F.lit(0).alias("begin"), F.lit(first).alias("end"), F.lit(STEP).alias("depth"))
    while True:
        deeper = []
        frontier = asked.select("class", "label", "tokens", "begin", "end").mapInArrow(_branch(similarity, True), said)
        for level in range(0, DEPTH, STEP):
            # nodes of one component are done
            sizes = frontier.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
            met = materialize(frontier.join(materialize(sizes.select("node", "size"), "sizes"), "node"), "met")
            groups.append(met.where(F.col("size") <= small).select("node", "class"))
            groups.append(_blocks(met.where((F.col("size") > small) & (F.col("size") <= BLOCKS * small)), small))
            large = materialize(met.where(F.col("size") > BLOCKS * small).select("node", "class"), "large")
            if large.isEmpty():
                break
            found = linked(_around_centers(large, own, found, similarity), found)
            rows = materialize(_labelled(large.select("node", "class"), found), "labelled")
            shares = rows.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node")
            shares = shares.agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size"))
            shares = materialize(shares.select("node", F.col("top.label").alias("top"), F.col("top.n").alias("joined"), (F.col("size") - F.col("top.n")).alias("apart")), "shares")
            apart = rows.join(shares.where("apart > 0"), "node")
            # classes apart, with every part of the node's largest component
            parts = F.greatest(F.ceil(F.col("joined") / small).cast("int"), F.lit(1))
            part = F.when(F.col("label") == F.col("top"), F.array(F.pmod(F.xxhash64("class", "node"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
            resolved = apart.where(F.col("apart") <= small).select("node", "class", F.explode(part).alias("part"))
            groups.append(resolved.select(F.xxhash64("node", "part").alias("node"), "class"))
            large = materialize(apart.where(F.col("apart") > small).select("node", "class", "label", (F.col("joined") + F.col("apart")).alias("size")), "large")
            if large.isEmpty():
                break
            if level + STEP < DEPTH:
                frontier = large.select("node", "class", "label").join(own.select("class", "tokens"), "class").mapInArrow(_branch(similarity, False), said)
                deeper.append(large.select("class", F.lit(level + 2 * STEP).alias("depth")).distinct())
            else:
                groups.append(_blocks(large, small))
        if not deeper:
            break
        # a pair is found if one of its classes has had its trees
        reached = reduce(DataFrame.unionByName, deeper).groupBy("class").agg(F.max("depth").alias("reached"))
        depth = F.greatest("depth", "reached")
        asked = asked.join(reached, "class").select("class", "label", "tokens", F.col("end").alias("begin"), F.element_at(needed, (depth / STEP).cast("int")).alias("end"), depth.alias("depth"))
        asked = materialize(_labelled(asked.where("end > begin").drop("label"), found), "asked")
        if asked.isEmpty():
            break
    nodes = groups[0]
    for more in groups[1:]:
        nodes = nodes.unionByName(more)
    return materialize(_likely_members(nodes, _labelled(own, found), similarity), "nodes"), None if found is None else _stars(found)


def spanning_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect all sets that similar ones connect; every pair of sets is looked at."""
    percent = round(similarity * 100)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    marked, root, found = np.zeros(len(values), np.int32), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        if (root[i:] == root[i]).all():
            continue
        own = number[starts[i] : starts[i] + sizes[i]]
        marked[own] = 1
        both = np.add.reduceat(marked[number[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        marked[own] = 0
        for j in i + 1 + np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[i + 1 :] - both)):
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                found.append((i, int(j)))
    return found


def _compare(shingle: int, similarity: float):
    """Stars around the smallest of the classes that links within a node connect; the rows of a node follow each other."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, names, sets = None, [], []

        def linked() -> pa.RecordBatch:
            least = np.arange(len(sets))
            for i, j in spanning_links(sets, similarity) if len(sets) > 1 else []:
                least[least == max(least[i], least[j])] = min(least[i], least[j])
            named = np.array(names, np.int64)
            away = np.flatnonzero(least != np.arange(len(sets)))
            return pa.RecordBatch.from_arrays([pa.array(named[least[away]]), pa.array(named[away])], names=["a", "b"])

        for batch in slices(batches):
            shingles, first = shingle_sets(texts_of(batch), shingle)
            for i, (own, name) in enumerate(zip(batch.column("node").to_pylist(), batch.column("class").to_pylist(), strict=True)):
                if own != node:
                    yield linked()
                    node, names, sets = own, [], []
                names.append(name)
                sets.append(shingles[first[i] : first[i + 1]].copy())
        yield linked()

    return compare


def _confirm(shingle: int, similarity: float):
    percent = round(similarity * 100)

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a"), "text_b"):
            a, from_a = shingle_sets(texts_of(batch, "text_a"), shingle)
            b, from_b = shingle_sets(texts_of(batch, "text_b"), shingle)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = a[from_a[i] : from_a[i + 1]], b[from_b[i] : from_b[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return confirm


def links(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (``a, b``) whose full shingle sets are similar; ``texts`` has ``class, text``."""
    a = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(shingle, similarity), "a long, b long")


def _places() -> list[Column]:
    """The two bits of a row's key in the filter."""
    return [F.pmod(F.xxhash64("row_id", "row_hash", F.lit(k)), F.lit(FILTER_BITS)).alias(f"place_{k}") for k in range(2)]


def _may_be_chosen(chosen: DataFrame) -> np.ndarray:
    """A bit for each place of a chosen key; Spark builds it in pieces of 32,768 bits."""
    place = chosen.select(F.explode(F.array(*_places())).alias("place")).select((F.col("place") + 1).alias("place"))
    pieces = place.groupBy(F.bitmap_bucket_number("place").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for row in pieces.collect():
        bits[row["piece"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(-1)


def _passing(bits: np.ndarray):
    def passing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [batch.column(c).to_numpy() for c in ("place_0", "place_1")]
            set_bits = [(bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 for p in places]
            yield batch.select(["row_id", "row_hash", "text"]).filter(pa.array((set_bits[0] & set_bits[1]).astype(bool)))

    return passing


def _texts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``class, text`` of the ``chosen`` keys, one of each class; repeated rows give their text once.

    They are told by the key of the join, so that texts are neither shuffled nor sorted again for it.
    """
    kinds = dict(rows.dtypes)
    near = rows.select("row_id", "row_hash", "text", *_places())
    near = near.mapInArrow(_passing(_may_be_chosen(chosen)), f"row_id {kinds['row_id']}, row_hash long, text string")
    return near.join(chosen, ["row_id", "row_hash"]).dropDuplicates(["row_id", "row_hash"]).select("class", "text")


def near_duplicate_classes(rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """Rows of ``identified`` documents with their class, and each class's component, if it has links.

    The first table has ``doc_id, row_id, row_hash, class, n_shingles``, the second ``node, component``.
    """
    kind = dict(rows.dtypes)["doc_id"]
    said = f"doc_id {kind}, row_id {dict(rows.dtypes)['row_id']}, row_hash long, class long, n_shingles long, tokens binary"
    sketched = materialize(rows.mapInArrow(_sketch(shingle), said), "sketches")
    classes = sketched.where("n_shingles > 0").groupBy("class").agg(F.min(F.struct("row_id", "row_hash", "n_shingles", "tokens")).alias("one"))
    classes = materialize(classes.select("class", "one.*"), "classes")

    def texts_of_classes(compared: DataFrame) -> DataFrame:
        # written, as it is read for the filter and for the join
        return _texts(rows, materialize(classes.join(compared, "class").select("class", "row_id", "row_hash"), "chosen"))

    nodes, around = meeting_classes(classes, texts_of_classes, shingle, similarity, trees)

    spread = materialize(nodes.select(F.xxhash64("members").alias("node"), F.explode("members").alias("class")), "spread")
    together = spread.join(texts_of_classes(spread.select("class").distinct()), "class")
    together = together.repartition("node").sortWithinPartitions("node", "class").select("node", "class", "text")
    confirmed = materialize(together.mapInArrow(_compare(shingle, similarity), "a long, b long"), "links")
    if around is not None:
        confirmed = confirmed.unionByName(around)
    return sketched.drop("tokens"), components(confirmed)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, trees: int = TREES) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``; a component is named by its smallest id."""
    sketched, found = near_duplicate_classes(identified(docs, doc_id, text), shingle, similarity, trees)
    label = F.coalesce("component", "class").alias("label")
    smallest = sketched.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("smallest"))
    smallest = materialize(smallest.join(found.withColumnRenamed("node", "class"), "class", "left").select("class", label, "smallest"), "smallest")
    named = smallest.groupBy("label").agg(F.min("smallest").alias("component_id"))
    named = materialize(smallest.join(named, "label").select("class", "component_id"), "named")
    whole = sketched.where("n_shingles > 0").join(named, "class").select("doc_id", "n_shingles", "component_id")
    alone = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all columns, that remain if one document of each component stays.

    Rows without words stay, all of them; of rows that repeat the chosen one, one stays.
    """
    key = ["row_id", "row_hash"]
    sketched, found = near_duplicate_classes(identified(docs, doc_id, text), **options)
    label = F.coalesce("component", "class")
    marked = sketched.where("n_shingles > 0").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("label", label)
    stay = materialize(marked.groupBy("label").agg(F.min(F.struct(*key)).alias("one")).select("one.*"), "staying")
    body = docs[f"`{text}`"]
    marks = [F.coalesce(docs[f"`{doc_id}`"], F.lit(0)).alias("row_id"), F.xxhash64(body).alias("row_hash"), F.coalesce(F.rlike(body, F.lit(WORD_PATTERN)), F.lit(False)).alias("worded")]
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *marks)
    worded = packed.where("worded").join(stay, key, "left_semi")
    # only rows that are repeated are shuffled, to let one of them stay
    repeated = materialize(sketched.where("n_shingles > 0").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "repeated")
    once = worded.join(repeated, key, "left_anti").unionByName(worded.join(repeated, key, "left_semi").dropDuplicates(key))
    return once.unionByName(packed.where("NOT worded")).select("row.*")
