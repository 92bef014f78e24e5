"""N-gram Jaccard join: prefixes of MinHash signatures in several trees, then exact verification.

Texts are sets of word shingles. Texts with the same words form one class, which takes part once, with its number of members as
weight. A class's signature is split over `trees` trees; a tree's node at depth d holds the classes that agree in that tree's
first d minima. Prefixes are shortened from `depth` until a pair at the threshold shares a node in some tree with the
target probability (1 - (1 - t^d)^trees); all pairs in a node of that depth are candidates. As every pair at the threshold has
to be met with that probability, whatever else its texts are like, the depth is the same for all texts and known before one is read
(4 for the defaults): this is the end state of an LSH forest whose prefixes are shortened to a recall target, without the longer ones.

Nodes with the same members are kept once. A node's pairs are verified inside tasks, on whole texts: members are dealt into
blocks of bounded size and each pair of blocks is one unit of work, so no task holds a whole node and no pair leaves the task.
A unit gives, for each member, the weight of its verified partners (a pair counts only in the first tree that brings it together)
and its group within the unit. Groups are joined to components by repeated minimum labels over tables in the shared folder.

Result: one row per input row with class_id, the smallest id of its component (rows linked directly or over others), and
n_links, the number of other rows at the threshold or above, copies included.

Defined cases: texts of fewer than five words have one shingle, all their words; texts without a word (null counts as empty)
are linked to equal texts only; repeated rows are links of each other; a row with a null id is linked like any other and
never names a class (class_id is null only where all ids of the component are); a text is read whole however long it is; other columns
are ignored by `join` and kept by `keep_one`, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from lectern.llm.words import SHINGLE, distinct, minima, mix, multipliers, shingle_sequence, word_hashes
from lectern.session import materialize

THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.9995
#: Members of a block; a unit of work holds two blocks at most.
BLOCK = 500
SEED = 20240131


def depth_for(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is met with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


@lru_cache(4)
def _factors(trees: int, depth: int) -> np.ndarray:
    return multipliers(trees * depth, SEED)


def sign(text: str | None, trees: int, depth: int) -> tuple[bytes, list[int]]:
    """A text's class key and its node in every tree; no nodes without a word."""
    hashed = word_hashes(text)
    if not len(hashed):
        return xxh3_128_digest(b"t" + (text or "").encode("utf-8", "surrogatepass")), []
    key = xxh3_128_digest(b"w" + hashed.tobytes())
    lows = minima(distinct(shingle_sequence(hashed)), _factors(trees, depth)).reshape(trees, depth)
    node = np.zeros(trees, np.uint64)
    for level in range(depth):
        node = mix(node + lows[:, level])
    return key, node.view(np.int64).tolist()


def _signed(docs: DataFrame, id_col: str, text_col: str, trees: int, depth: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__th"), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType(
        [rows.schema["__id"], T.StructField("__th", T.LongType()), T.StructField("__key", T.BinaryType()), T.StructField("__nodes", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = [sign(t.as_py(), trees, depth) for t in batch.column(2)]
            keys, nodes = zip(*signed) if signed else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of two lists of sorted sets, by products of bounded 0/1 matrices."""
    shared = np.zeros((len(left), len(right)), np.float32)
    values, where = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = np.array([len(s) for s in [*left, *right]])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    frequent = np.bincount(where, minlength=len(values)) > 1
    column = np.cumsum(frequent) - 1
    keep = frequent[where]
    rows, where = rows[keep], column[where[keep]]
    width = int(frequent.sum())
    for start in range(0, width, 4096):
        part = (where >= start) & (where < start + 4096)
        grid = np.zeros((len(sizes), min(4096, width - start)), np.float32)
        grid[rows[part], where[part] - start] = 1
        shared += grid[: len(left)] @ grid[len(left) :].T
    return shared


def verify(members: list[tuple], threshold: float, tree: int, across: bool) -> tuple[list[int], list[int]]:
    """Members are (key, weight, nodes, shingle set, side). Returns each one's weight of linked partners first met in this tree, and
    the position of the first member of its group. With `across`, only pairs of both sides count."""
    count = len(members)
    sizes = np.array([len(m[3]) for m in members], float)
    if across:
        sides = [[k for k in range(count) if members[k][4] == s] for s in (0, 1)]
    else:
        sides = [list(range(count))] * 2
    if not sides[0] or not sides[1]:
        return [0] * count, list(range(count))
    shared = _overlaps([members[k][3] for k in sides[0]], [members[k][3] for k in sides[1]]) if count > 2 else None
    if shared is None:
        a, b = sides[0][0], sides[1][-1]
        both = len(members[a][3]) + len(members[b][3]) - len(distinct(np.concatenate([members[a][3], members[b][3]])))
        linked = np.zeros((len(sides[0]), len(sides[1])), bool)
        if a != b:
            linked[0, -1] = both >= threshold * (sizes[a] + sizes[b] - both)
            if not across:
                linked |= linked.T
    else:
        union = sizes[sides[0]][:, None] + sizes[sides[1]][None, :] - shared
        linked = shared >= threshold * union - 1e-9
        if not across:
            np.fill_diagonal(linked, False)
    root = list(range(count))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first, second = np.nonzero(linked)
    for x, y in zip(first.tolist(), second.tolist()):
        a, b = find(sides[0][x]), find(sides[1][y])
        if a != b:
            root[max(a, b)] = min(a, b)
    links = np.zeros(count, np.int64)
    if len(first):
        nodes = np.array([m[2] for m in members], np.int64)[:, :tree] if tree else None
        weights = np.array([m[1] for m in members], np.int64)
        a, b = np.array(sides[0])[first], np.array(sides[1])[second]
        if tree:
            new = np.zeros(len(a), bool)
            for start in range(0, len(a), 65536):
                part = slice(start, start + 65536)
                new[part] = ~(nodes[a[part]] == nodes[b[part]]).any(axis=1)
            a, b = a[new], b[new]
        np.add.at(links, a, weights[b])
        if across:
            np.add.at(links, b, weights[a])
    return links.tolist(), [find(k) for k in range(count)]


def _verified(units: DataFrame, threshold: float) -> DataFrame:
    """Units of work are runs of equal (__tree, __node, __i, __j); gives __key, __links and __root for members with a partner."""
    schema = T.StructType([T.StructField("__key", T.BinaryType()), T.StructField("__links", T.LongType()), T.StructField("__root", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, members, sets = None, [], {}

        def done() -> pa.RecordBatch:
            tree, _, i, j = unit
            links, roots = verify(members, threshold, tree, i != j)
            rows = [(m[0], n, members[r][0]) for k, (m, n, r) in enumerate(zip(members, links, roots)) if n or r != k]
            columns = list(zip(*rows)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()))], names=schema.names)

        for batch in batches:
            columns = [batch.column(k) for k in range(8)]
            for tree, node, i, j, side, key, weight, nodes, text in zip(*(c.to_pylist() for c in columns[:7]), columns[7], batch.column(8)):
                if (tree, node, i, j) != unit:
                    if len(members) > 1:
                        yield done()
                    unit, members, sets = (tree, node, i, j), [], set()
                if key not in sets:
                    sets.add(key)
                    members.append((key, weight, nodes.as_py(), distinct(shingle_sequence(word_hashes(text.as_py()))), int(side != i)))
        if len(members) > 1:
            yield done()

    return units.mapInArrow(run, schema)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(v, label): the smallest vertex of each vertex's component, for vertices that have an edge.

    Rounds of minimum labels over neighbours and then over labels; each round is a table in the shared folder.
    """
    both = edges.select(F.col(left).alias("v"), F.col(right).alias("u")).unionByName(edges.select(F.col(right).alias("v"), F.col(left).alias("u")))
    both = materialize(both.where("v <> u").distinct(), "edges")
    labels = materialize(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("v").alias("u"), "label").hint("merge"), "u").groupBy("v").agg(F.min("label").alias("near"))
        step = labels.join(around.hint("merge"), "v").select("v", F.least("label", "near").alias("next"), "label")
        ahead = labels.select(F.col("v").alias("next"), F.col("label").alias("ahead"))
        step = step.join(ahead.hint("merge"), "next", "left").select("v", F.least("next", F.coalesce("ahead", "next")).alias("next"), "label")
        step = materialize(step, "labels")
        moved = step.where("next <> label").limit(1).count()
        labels = step.select("v", F.col("next").alias("label"))
        if not moved:
            return labels


def join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, class_id, n_links. See the module's text for the method and the defined cases."""
    members = linked(docs, threshold, id_col, text_col, trees, depth, recall, block)
    return members.select(F.col("__id").alias(id_col), "class_id", "n_links")


def linked(docs: DataFrame, threshold: float, id_col: str, text_col: str, trees: int, depth: int, recall: float, block: int) -> DataFrame:
    depth = depth_for(threshold, trees, depth, recall)
    signed = materialize(_signed(docs, id_col, text_col, trees, depth), "signed")
    classes = signed.groupBy("__key").agg(
        F.count(F.lit(1)).alias("__weight"),
        F.min("__id").alias("__least"),
        F.min(F.struct("__id", "__th")).alias("__rep"),
        F.first("__nodes").alias("__nodes"),
    )
    classes = materialize(classes, "classes")
    nodes = classes.select("__key", F.posexplode("__nodes").alias("__tree", "__node"))
    crowd = nodes.groupBy("__tree", "__node").agg(F.count(F.lit(1)).alias("__n"), F.bit_xor(F.xxhash64("__key")).alias("__x"), F.bit_xor(F.xxhash64("__key", F.lit(1))).alias("__y"))
    crowd = crowd.where("__n > 1").groupBy("__n", "__x", "__y").agg(F.min(F.struct("__tree", "__node")).alias("__at")).select("__at.__tree", "__at.__node", "__n")
    crowd = materialize(crowd, "nodes")
    places = nodes.join(crowd.hint("merge"), ["__tree", "__node"]).groupBy("__key").agg(F.collect_list(F.struct("__tree", "__node", "__n")).alias("__in"))
    wanted = places.join(classes.hint("merge"), "__key").select("__key", "__weight", "__nodes", "__in", "__rep.__id", "__rep.__th")
    texts = docs.select(F.col(id_col).alias("__doc"), F.xxhash64(text_col).alias("__dth"), F.col(text_col).cast("string").alias("__text"))
    with_text = texts.join(wanted.hint("merge"), F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__dth") == F.col("__th")))
    blocks = F.ceil(F.col("__p.__n") / F.lit(block)).cast("int")
    units = (
        with_text.select("__key", "__weight", "__nodes", "__text", F.explode("__in").alias("__p"))
        .withColumn("__blocks", blocks)
        .withColumn("__side", F.pmod(F.xxhash64("__key", F.lit(7)), F.col("__blocks")).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .select(
            F.col("__p.__tree").alias("__tree"),
            F.col("__p.__node").alias("__node"),
            F.least("__side", "__other").alias("__i"),
            F.greatest("__side", "__other").alias("__j"),
            "__side",
            "__key",
            "__weight",
            "__nodes",
            "__text",
        )
    )
    unit = ["__tree", "__node", "__i", "__j"]
    found = materialize(_verified(units.repartition(*unit).sortWithinPartitions(*unit), threshold), "links")
    links = found.groupBy("__key").agg(F.sum("__links").alias("__links"))
    labels = components(found.where("__root <> __key"), "__key", "__root").withColumnRenamed("v", "__key")
    known = classes.select("__key", "__weight", "__least").join(links.hint("merge"), "__key", "left").join(labels.hint("merge"), "__key", "left")
    # tables of their own, so that a label of very many classes can be split when they are joined
    known = materialize(known.withColumn("label", F.coalesce("label", "__key")), "known")
    least = materialize(known.groupBy("label").agg(F.min("__least").alias("class_id")), "least")
    known = known.join(least.hint("merge"), "label").select("__key", "label", "class_id", (F.coalesce("__links", F.lit(0)) + F.col("__weight") - 1).alias("n_links"))
    return signed.select("__id", "__th", "__key").join(known.hint("merge"), "__key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each group: the one with the smallest id (ties: of equal rows one stays; a null id comes before others).

    Defined cases: as in the module's text; other columns are kept, whatever their names.
    """
    found = linked(docs, threshold, id_col, text_col, TREES, DEPTH, RECALL, BLOCK)
    place = [F.coalesce(F.col("__id").cast("string"), F.lit("")).alias("__name"), F.col("__id").isNull().alias("__none")]
    best = found.groupBy("label").agg(F.min(F.struct("__id", "__th")).alias("__best")).select("__best.__id", "__best.__th").select(*place, "__th")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__th")).select("__row", *place, "__th")
    kept = rows.join(best.hint("merge"), ["__name", "__none", "__th"], "left_semi")
    return kept.dropDuplicates(["__name", "__none", "__th"]).select("__row.*")
