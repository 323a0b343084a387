"""N-gram Jaccard self-join by prefix trees, with components of its links.

Sets are ordered by token hash. Two sets that link share, among the first tokens of both, at least `need` tokens (the
prefix bound with a required overlap); a set with fewer tokens there that any other set has can't link and goes, which
leaves only what is close to something. What is left meets in blocks: first under two tokens a set (small tries that
join most groups), then, for sets of which other components still have enough tokens, under the rarest of these, as many
as the prefix bound asks for. Inside a block the sets form a trie; a set walks it, sharing the partial overlap of
common prefixes, and leaves a subtree when the lengths that remain can't reach the needed overlap or when everything
below is in its component already. No pair of one component is looked at twice, no list of pairs is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dubflow.llm.common import columns, join_classes, lean, materialize, prepare, release, utf8

#: Sets in one block; larger ones are dealt to cells.
BLOCK_SETS = 2_000
_POWERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)]


def ceil_share(n, percent: int):
    return -(-percent * n // 100)


def extra(n: int) -> int:
    """The overlap asked of two sets of at least n tokens inside their prefixes."""
    return max(1, n * 6 // 100)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - ceil_share(n, percent) + extra(n))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word n-grams; A-Z lower-cased, words by ASCII white space."""
    from xxhash import xxh3_64_intdigest

    w = text.lower().split()
    if not w:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w))
    n = min(words, len(w))
    s = np.full(len(w) - n + 1, np.uint64(n * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    for k in range(n):
        s = (s ^ (s >> np.uint64(31))) * np.uint64(_POWERS[1]) + h[k : len(w) - n + 1 + k] * np.uint64(_POWERS[2 * k + 3] | 1)
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique((s >> np.uint64(1)).astype(np.int64))


def _batch(columns: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], names=list(types))


SETS = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n": pa.int64(), "digest": pa.binary(), "cls": pa.int64(), "e": pa.list_(pa.int64())}
#: Sets whose prefix a task remembers to have sent.
SEEN_SETS = 1_000_000


def set_digest(tokens: bytes) -> tuple[bytes, int]:
    digest = hashlib.blake2b(tokens, digest_size=16).digest()
    return digest, int.from_bytes(digest[:8], "little", signed=True)


def set_rows(batches: Iterator[pa.RecordBatch], words: int, percent: int, remembered: int = SEEN_SETS) -> Iterator[pa.RecordBatch]:
    """Per document: size and digest of its set; the prefix once a task and set."""
    seen: set[int] = set()
    for b in batches:
        out = {k: [] for k in SETS}
        for doc, text, text_hash in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            s = shingles(text, words)
            digest, cls = set_digest(s.tobytes())
            new = len(s) > 0 and cls not in seen
            if new:
                if len(seen) > remembered:
                    seen.clear()
                seen.add(cls)
            for k, v in zip(SETS, (doc, text_hash, len(s), digest, cls, s[: prefix_length(len(s), percent)] if new else None), strict=True):
                out[k].append(v)
        yield _batch(out, SETS)


class _Node:
    __slots__ = ("edge", "children", "least", "most", "comp", "sets")

    def __init__(self, edge, n, comp):
        self.edge, self.children, self.least, self.most, self.comp, self.sets = edge, {}, n, n, comp, []


class Trie:
    """Sets of a block in hash order along compressed edges, and the components that their links make."""

    def __init__(self, percent: int) -> None:
        self.percent, self.root, self.parent = percent, _Node(np.zeros(0, np.int64), 0, -1), {}
        self.root.least = 1 << 60

    def find(self, a: int) -> int:
        parent = self.parent
        while (b := parent.setdefault(a, a)) != a:
            parent[a] = parent.setdefault(b, b)
            a = parent[a]
        return a

    def unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def insert(self, x: np.ndarray, comp: int) -> None:
        node, at, n = self.root, 0, len(x)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if node is not self.root or node.comp != -1:
                node.comp = comp if node.comp is not None and self.find(node.comp) == self.find(comp) else None
            else:
                node.comp = comp
            if at == n:
                node.sets.append((n, comp))
                return
            child = node.children.get(first := int(x[at]))
            if child is None:
                leaf = _Node(x[at:].copy(), n, comp)
                leaf.sets.append((n, comp))
                node.children[first] = leaf
                return
            k = min(len(child.edge), n - at)
            differ = np.flatnonzero(child.edge[:k] != x[at : at + k])
            k = int(differ[0]) if len(differ) else k
            if k < len(child.edge):
                upper = _Node(child.edge[:k], child.least, child.comp)
                upper.most = child.most
                child.edge = child.edge[k:]
                upper.children[int(child.edge[0])] = child
                node.children[first] = upper
                child = upper
            node, at = child, at + k

    def link(self, x: np.ndarray, comp: int) -> Iterator[int]:
        """Walks the trie; joins comp with the component of each set that links with x and yields that set's own comp."""
        n, percent = len(x), self.percent
        low, high = ceil_share(n, percent), n * 100 // percent
        stack = [(c, 0, 0, 0) for c in self.root.children.values()]
        while stack:
            node, depth, overlap, at = stack.pop()
            if node.most < low or node.least > high or node.comp is not None and self.find(node.comp) == self.find(comp):
                continue
            edge = node.edge
            where = np.searchsorted(x, edge)
            overlap += int((x[np.minimum(where, n - 1)] == edge).sum())
            at, depth = int(np.searchsorted(x, edge[-1], "right")), depth + len(edge)
            least = max(node.least, low)
            # 100 * overlap >= percent * union, union = n + m - overlap
            if (100 + percent) * (overlap + min(n - at, max(0, min(node.most, high) - depth))) < percent * (n + least):
                continue
            for m, other in node.sets:
                if (100 + percent) * overlap >= percent * (n + m) and self.find(other) != self.find(comp):
                    self.unite(other, comp)
                    yield other
            stack.extend((c, depth, overlap, at) for c in node.children.values())


def block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning links (a, b) of each block; rows (k1, k2, k3, comp, tokens) come block by block."""
    now, trie, out = None, None, []
    for b in batches:
        for k1, k2, k3, comp, tokens in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (k1, k2, k3) != now:
                now, trie = (k1, k2, k3), Trie(percent)
            x = np.frombuffer(tokens, np.int64)
            out += [(min(comp, o), max(comp, o)) for o in trie.link(x, comp)]
            trie.insert(x, comp)
        if len(out) > 50_000:
            yield _batch(dict(zip("ab", zip(*out, strict=True), strict=True)), {"a": pa.int64(), "b": pa.int64()})
            out = []
    if out:
        yield _batch(dict(zip("ab", zip(*out, strict=True), strict=True)), {"a": pa.int64(), "b": pa.int64()})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for nodes with links. Alternating large and small stars.

    A node that very many links share is joined by broadcast, so no task holds a star.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        stars = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() and edges.join(edges.select(F.col("b").alias("x")), F.col("a") == F.col("x"), "left_semi").isEmpty()
        if stars:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        total = edges.count()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_classes(both, least, "a", "n", 2 * total, F.col("b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_classes(large, least, "a", "n", total, F.col("b"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        before, edges = edges, materialize(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        release(before, large)


def _joined(narrow: DataFrame, full: DataFrame, percent: int, exact: bool, total: int) -> DataFrame:
    """Links of the blocks (key, id, comp). A block of over BLOCK_SETS sets is dealt to cells.

    When exact, all pairs of its parts; but if one component has all of the block save BLOCK_SETS others at most, each part
    of that component meets the others, who meet each other once, so copies stay in proportion to the block. Else each part
    with one set that all parts have.
    """
    main = F.min_by("comp", F.xxhash64("id"))
    sizes = narrow.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"), F.min("id").alias("pivot"), main.alias("main"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("cnt > 1 and c0 <> c1")
    sizes = blocks = materialize(sizes.select("key", "cnt", "pivot", "main"), "blocks")
    large = sizes.where(F.col("cnt") > BLOCK_SETS)
    if exact and not large.isEmpty():
        others = join_classes(narrow, large, "key", "cnt", total, F.col("id")).where("cnt is not null and comp <> main").groupBy("key").agg(F.count(F.lit(1)).alias("others"))
        sizes = sizes.join(others, "key", "left")
    else:
        sizes = sizes.withColumn("others", F.col("cnt"))
    rows = join_classes(narrow, sizes, "key", "cnt", total, F.col("id")).where("cnt is not null").withColumn("parts", F.ceil(F.col("cnt") / BLOCK_SETS).cast("int"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda a, b: F.struct(a.alias("k2"), b.alias("k3"))
    none = F.lit(-1)
    if exact:
        cells = (
            F.when((F.col("parts") == 1) | (F.col("others") > BLOCK_SETS), F.transform(every, lambda j: cell(F.least(part, j), F.greatest(part, j))))
            .when(F.col("comp") == F.col("main"), F.array(cell(part, none)))
            .otherwise(F.concat(F.transform(every, lambda j: cell(j, none)), F.array(cell(none, none))))
        )
    else:
        cells = F.transform(F.when(F.col("id") == F.col("pivot"), every).otherwise(F.array(part)), lambda j: cell(j, j))
    rows = rows.select("key", "id", "comp", F.explode(cells).alias("cell")).select("key", "cell.k2", "cell.k3", "id", "comp")
    rows = rows.join(full.select(F.col("node").alias("id"), "n", "tokens"), "id").select("key", "k2", "k3", "comp", "tokens", "n")
    rows = rows.repartition("key", "k2", "k3").sortWithinPartitions("key", "k2", "k3", "n", "comp").drop("n")
    edges = materialize(rows.mapInArrow(lean(lambda it: block_links(it, percent)), "a long, b long"), "edges")
    release(blocks)
    return edges


def _flag(token: np.ndarray, ident: np.ndarray, who: np.ndarray, sure: bool = False) -> Iterator[pa.RecordBatch]:
    if len(token) < 2 and not sure:
        return
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    mixed = np.minimum.reduceat(who, begin) != np.maximum.reduceat(who, begin)
    keep = np.repeat(mixed | sure, np.diff(np.append(begin, len(token))))
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(ident[keep]), pa.array(np.zeros(int(keep.sum()), bool))], names=["token", "id", "hot"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their tokens and ids, distinct ones whose token more than one `who` has; memory is bounded
    for any token."""
    kept = last_row = None
    for b in batches:
        rows = [b.column(i).to_numpy() for i in range(3)]
        if len(rows[0]):
            new = np.concatenate([[(rows[0][0], rows[1][0]) != last_row], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
            last_row = (rows[0][-1], rows[1][-1])
            rows = [x[new] for x in rows]
        if kept is not None:
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
        if len(rows[0]):
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from _flag(*(x[:last] for x in rows))
            # of the token that goes on, what is sure to be shared leaves at once, but for a row of each of two sides
            rows = [x[last:] for x in rows]
            other = np.flatnonzero(rows[2] != rows[2][0])
            if len(rows[0]) > 50_000 and len(other):
                two = np.zeros(len(rows[0]), bool)
                two[[0, other[0]]] = True
                yield from _flag(*(x[~two] for x in rows), True)
                rows = [x[two] for x in rows]
            kept = rows
    if kept is not None:
        yield from _flag(*kept)


def shared_tokens(rows: DataFrame, total: int) -> DataFrame:
    """Distinct (token, id, hot) of the rows (token, id, who) whose token more than one `who` has.

    Tokens that a sample of ids shows to be very common go without a shuffle by token, and are marked hot; at most 20,000.
    """
    often = rows.where("pmod(xxhash64(id), 64) = 0").groupBy("token").agg(F.count_distinct("who").alias("c")).where(F.col("c") >= max(8, total // 6400))
    hot = F.broadcast(often.orderBy(F.desc("c"), "token").limit(20_000).select(F.col("token").alias("t"), F.lit(True).alias("hot")))
    rows = rows.join(hot, F.col("token") == F.col("t"), "left")
    spread = rows.where("hot is null").select("token", "id", "who").repartition("token").sortWithinPartitions("token", "id").mapInArrow(lean(_shared), "token long, id long, hot boolean")
    return spread.unionByName(rows.where("hot").select("token", "id", "hot").distinct())


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs. What holds there holds here."""
    return _groups(docs, words, percent, id_col, text_col).drop("text_hash", "group_no")


def _groups(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_shingles, component_id and group_no, which tells groups apart that share an id.

    Sets of distinct word n-grams (with fewer words: the whole sequence); two link when 100 * intersection >= percent *
    union; component_id is the smallest doc_id that links reach, itself included. Null or blank texts have no shingles
    and are components of their own, as are rows of other texts without an id; rows that repeat an id are documents each.
    An empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), F.xxhash64(utf8(text_col)).alias("text_hash"))
    sets = materialize(texts.mapInArrow(lean(lambda it: set_rows(it, words, percent)), "doc_id long, text_hash long, n long, digest binary, cls long, e array<long>"), "sets")
    classes = materialize(sets.where("n > 0 and doc_id is not null").groupBy("digest", "cls", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "set-classes")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    # a class is known by its smallest doc_id; of classes that share that, all but one by a number of their own
    repeated = not classes.groupBy("rep").count().where("count > 1").isEmpty()
    node = F.when(F.row_number().over(Window.partitionBy("rep").orderBy("digest")) == 1, F.col("rep")).otherwise(F.xxhash64("digest") % (1 << 61) - (1 << 62)) if repeated else F.col("rep")
    classes = classes.withColumn("node", node)

    rows = sets.where("e is not null").select(F.explode("e").alias("token"), F.col("cls").alias("id"), F.col("cls").alias("who"))
    tokens = materialize(shared_tokens(rows, total), "shared-tokens")
    members = materialize(sets.select("doc_id", "text_hash", "n", "digest"), "members")
    release(sets)  # the prefixes are its larger part

    least = F.ceil(F.col("n") * percent / 100).cast("long")
    need = F.greatest(F.lit(1), F.floor(least * 6 / 100).cast("int"))
    close = tokens.groupBy(F.col("id").alias("cls")).agg(F.count(F.lit(1)).alias("have")).join(classes.select("cls", "rep", "node", "n"), "cls").where(F.col("have") >= need)
    close = materialize(close.select("cls", "rep", "node", "n", need.alias("need")), "close-sets")

    def whole(batches):
        for b in batches:
            tokens = [shingles(t, words).tobytes() for t in b.column(0).to_pylist()]
            # a repeated id may bring another text: only the set of the class counts
            same = pa.array([set_digest(t)[1] == c for t, c in zip(tokens, b.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(tokens, pa.binary())], names=["node", "n", "tokens"]).filter(same)

    wanted = close.select("rep", "cls", "node", "n").hint("shuffle_hash")
    found = texts.join(wanted, F.col("doc_id") == F.col("rep")).select("text", "cls", "node", "n").mapInArrow(lean(whole), "node long, n long, tokens binary")
    full = materialize(found.dropDuplicates(["node"]), "full-sets")

    mine = tokens.join(close.select("cls", "node", "need"), F.col("id") == F.col("cls")).select("token", "hot", F.col("node").alias("id"), "need")
    mine = materialize(mine, "close-tokens")
    release(tokens)
    least_two = [mine.where("not hot").groupBy("id").agg(F.min_by("token", F.xxhash64("token", F.lit(k))).alias("key")) for k in range(2)]
    pairs = materialize(least_two[0].unionByName(least_two[1]).distinct().withColumn("comp", F.col("id")), "first-keys")
    first = _joined(pairs, full, percent, False, total)
    release(pairs)
    comps = components(first)

    # sets whose prefix, then whose whole set, has enough tokens that another component has too
    label = comps.select(F.col("node").alias("id"), "component")
    known = mine.join(label, "id", "left").withColumn("comp", F.coalesce("component", "id"))
    mixed = known.where("not hot").groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select(F.col("token").alias("t"))
    active = known.where("not hot").join(mixed, F.col("token") == F.col("t"), "left_semi").unionByName(known.where("hot"))
    active = active.groupBy("id", "comp", "need").agg(F.count(F.lit(1)).alias("have")).where("have >= need").select(F.col("id").alias("node"), "comp")
    active = full.join(active, "node").select("node", "comp", "tokens")

    def exploded(batches):
        for b in batches:
            for node, comp, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                token = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), node)), pa.array(np.full(len(token), comp))], names=["token", "id", "who"])

    wide = shared_tokens(active.mapInArrow(lean(exploded), "token long, id long, who long"), total)
    wide = mixed_tokens = materialize(wide.join(label, "id", "left").select("token", "id", F.coalesce("component", "id").alias("comp")), "mixed-tokens")
    release(mine)
    bound = F.ceil(F.col("n") * percent / 100)
    have = wide.groupBy("id").agg(F.count(F.lit(1)).alias("have")).join(close.select(F.col("node").alias("id"), "n"), "id").where(F.col("have") >= bound)
    have = active_sets = materialize(have.select("id", (F.col("have") - bound + 1).cast("int").alias("most")), "active-sets")
    wide = wide.join(have, "id")
    freq = wide.groupBy("token").agg(F.count(F.lit(1)).alias("f")).select(F.col("token").alias("t"), "f")
    ordered = wide.join(freq, F.col("token") == F.col("t")).groupBy("id", "comp", "most").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("l"))  # a set's own tokens
    narrow = keys = materialize(ordered.select("id", "comp", F.explode(F.slice("l", F.lit(1), F.col("most"))).alias("x")).select(F.col("x.token").alias("key"), "id", "comp"), "keys")
    release(mixed_tokens, active_sets)
    # of blocks with the same sets, one
    same = narrow.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2"))
    same = same.where("c > 1").groupBy("c", "h1", "h2").agg(F.min("key").alias("k"))
    narrow = materialize(narrow.join(same.select("k"), F.col("key") == F.col("k"), "left_semi"), "block-keys")
    release(keys)
    second = _joined(narrow, full, percent, True, total)
    release(narrow, full, close)
    final = components(first.unionByName(second))

    final = final.withColumnRenamed("node", "linked")
    named = classes.join(final, F.col("node") == F.col("linked"), "left").select("digest", "copies", "rep", F.coalesce("component", "node").alias("component"))
    if repeated:
        least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = named.join(least_id, "component")
    else:
        named = named.withColumn("component_id", F.col("component"))
    named = materialize(named.select("digest", "copies", "component_id", F.col("component").alias("group_no")), "set-components")
    out = join_classes(members, named, "digest", "copies", total, F.col("doc_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("group_no")).alias("group_no"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of similar ones: that with the smallest doc_id, of several the smallest hash of
    the text, of rows equal in both the first by its columns' JSON. All columns, whatever their names, stay; so
    do rows without words, and rows without id whose set of shingles no row with an id has."""
    groups = _groups(docs, words, percent, "doc_id", "text")
    groups = materialize(groups.where("group_no is null or doc_id = component_id"), "candidates")
    alone = groups.where("group_no is null").select("doc_id", "text_hash").distinct().withColumn("one", F.lit(False))
    first = groups.where("group_no is not null").groupBy("group_no").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("rows"))
    first = materialize(first, "kept")
    repeated = not first.where("rows > 1").isEmpty()
    kept = alone.unionByName(first.select("doc_id", "text_hash", F.lit(True).alias("one"))).withColumnRenamed("doc_id", "keep")
    rows = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(utf8("text")).alias("hash"))
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("keep")) & (F.col("hash") == F.col("text_hash")))
    if repeated:
        once = out.where("one").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
        return out.where("not one").select("row.*").unionByName(once.select("row.*"))
    return out.select("row.*")
