"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of minhash groups are made for each document: ``u_1..u_m``
and ``v_1..v_m``, each group ``r`` minhashes. A table key is a pair ``(u_i, v_j)``,
so ``m * m`` tables of ``2 r`` minhashes each cost ``2 m r`` minhashes and not
``2 m m r``. Documents that share a key are candidates; a link is made only
after the full shingle sets were compared.

Documents with equal shingle sets are one class first. Classes that share keys
are then compared in two rounds:

1. each class with the one it resembles most among the least members of its keys;
2. where a key still holds several components, the classes of those keys meet
   once for each of their ``u`` groups. The group's largest component is only met
   by the others: its own members need no comparison. A task finds the pairs
   that may be linked by the rarest shingles of each set (a set shares one of
   them with every set it is linked with) and by what the rest can still add, and
   compares those on their full sets, unless both are in one component by then.
   What leaves it are links that join two components, bounded by its classes.
   Large groups are dealt over blocks of bounded size.

Classes already in one component need no comparison, since a further link could
not change the result. In round 1 pairs whose set sizes rule a link out, or whose
64-bit sketches differ more than those of linked pairs do, are not compared;
they are met again in round 2.

Defined cases: a null or blank text has the empty set and is linked with
nothing; with fewer words than a shingle has, the whole sequence is the
shingle; texts are read whole; each row is linked by its own text, so rows that
repeat an id with different texts may be in different components; rows with a
null id are linked like others but name no component (one without any id is
null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.storage import cut, discard, numbered
from fraudlens.operators.graph import connected_components

WORDS = 5
SIMILARITY_PERCENT = 80
#: m and r: 8 x 8 tables on 4 minhashes each. At similarity 0.8 a pair shares a key in 99.9 of 100 cases.
GROUPS, GROUP_SIZE = 8, 2
#: Bits of 64 that two sketches must agree in.
SKETCH_AGREES = 46
TABLE_WORDS = 500_000
#: Shingles of a block in round 2, at most (16 MB of hashes), and of a group that is one block.
BLOCK_SHINGLES, SMALL_SHINGLES = 2_000_000, 100_000
#: Tasks that the rows of one group meet its block counts in.
SALTS = 16


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= TABLE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHashes()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    size = min(words, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for i, seed in enumerate(_seeds(size)):
        h += w[i : i + n] * seed
    h = np.sort(_mixed(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _seeds(count: int) -> np.ndarray:
    return _mixed(np.arange(1, count + 1, dtype=np.uint64) * _MIX) | np.uint64(1)


def minhashes(s: np.ndarray, count: int) -> np.ndarray:
    """The least of each of ``count`` 32-bit hashes over a set."""
    seeds = _seeds(count)
    times, plus = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds * _MIX >> np.uint64(32)).astype(np.uint32)
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        h = low[None, at : at + 2048] * times[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h += plus[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out.astype(np.uint64)


def table_keys(signature: np.ndarray, groups: int = GROUPS, size: int = GROUP_SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The ``groups * groups`` table keys of ``2 * groups * size`` minhashes, and the names of the ``u`` groups."""
    parts = signature.reshape(2, groups, size)
    names = np.zeros((2, groups), np.uint64)
    for k in range(size):
        names = _mixed(names * _MIX + parts[:, :, k])
    names = _mixed(names + np.arange(groups, dtype=np.uint64)[None, :] * _MIX)
    pair = names[0][:, None] * np.uint64(3) + names[1][None, :]
    number = np.arange(groups * groups, dtype=np.uint64).reshape(groups, groups)
    return _mixed(_mixed(pair) + number * _MIX).ravel(), names[0]


def _signatures(words: int, groups: int, size: int):
    count = 2 * groups * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, shifts = np.uint64(3), np.arange(0, 64, 2, dtype=np.uint64)[: min(32, count)]
        for batch in batches:
            sizes, digests, signatures, sketches = [], [], [], []
            for text in batch["text"].to_pylist():
                s = shingles(text, words)
                signature = minhashes(s, count)
                sizes.append(len(s))
                digests.append(hashlib.sha256(s.tobytes()).digest() if len(s) else None)
                signatures.append(signature.astype("<u4").tobytes() if len(s) else None)
                sketches.append(((_mixed(signature)[:32] & two) << shifts).sum())
            columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(np.array(sketches, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], *columns], names=["doc_id", "h", "n", "digest", "signature", "sketch"])

    return run


def _keyed(groups: int, size: int):
    """A row for each table key of each class, with the name of the ``u`` group it is made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [table_keys(np.frombuffer(x, "<u4").astype(np.uint64), groups, size) for x in batch["signature"].to_pylist()]
            keys = np.concatenate([tables for tables, _ in found]).view(np.int64)
            firsts = np.concatenate([np.repeat(first, groups) for _, first in found]).view(np.int64)
            same = [pa.array(np.repeat(batch[c].to_numpy(), groups * groups)) for c in ("class", "n", "sketch")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(keys), pa.array(firsts)], names=["class", "n", "sketch", "key", "first"])

    return run


def _compared(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_set = None, None
        for batch in batches:
            linked = []
            for one, other in zip(batch["a_text"].to_pylist(), batch["b_text"].to_pylist()):
                if one != last_text:
                    last_text, last_set = one, shingles(one, words)
                s = shingles(other, words)
                small, large = (s, last_set) if len(s) <= len(last_set) else (last_set, s)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                linked.append(100 * both >= percent * (len(s) + len(last_set) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _joining(percent: int):
    """Links of one block, or pair of blocks, of classes that join two components."""

    def run(table: pa.Table) -> pa.Table:
        out = [[], []]
        ids, at = table["class"].to_numpy(), table["_b"].to_numpy()
        low, high = table["_low"][0].as_py(), table["_high"][0].as_py()
        component = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        sets = [np.frombuffer(x, "<u8") for x in table["shingles"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        # each set with its rarest shingles first; ``number`` ranks shingles by how many of these sets have them
        _, value, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.empty(len(counts), np.int64)
        number[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        rows = np.repeat(np.arange(len(sets)), sizes)
        order = np.lexsort((number[value], rows))
        number, counts = number[value[order]], counts[value[order]]
        begins = np.concatenate(([0], np.cumsum(sizes)))
        place = np.arange(len(rows)) - begins[rows]
        rare = place < (sizes + (-percent * sizes) // 100 + 1)[rows]  # a linked set has one of these among its own rare ones
        index = np.flatnonzero(rare & (at == high)[rows] & (counts > 1))
        index = index[np.argsort(number[index], kind="stable")]
        names = number[index]
        above = np.arange(component.max() + 1)

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        asks = at == low
        if low == high:  # of two components one at least is not the largest, and its members ask
            asks &= component != np.bincount(component).argmax()
        for i in np.flatnonzero(asks).tolist():
            own = np.arange(begins[i], begins[i + 1])
            own = own[rare[own] & (counts[own] > 1)]
            left, right = np.searchsorted(names, number[own]), np.searchsorted(names, number[own], "right")
            met = right - left
            if not met.sum():
                continue
            entries = index[np.repeat(left - np.cumsum(met) + met, met) + np.arange(met.sum())]
            other, first = np.unique(rows[entries], return_index=True)  # the first shingle that both have
            mine, theirs = np.repeat(place[own], met)[first], place[entries[first]]
            both = sizes[i] + sizes[other]
            may = (100 + percent) * np.minimum(sizes[i] - mine, sizes[other] - theirs) >= percent * both
            for j in other[may & (component[other] != component[i])].tolist():
                one, two = root(component[i]), root(component[j])
                if one != two:
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                        above[max(one, two)] = min(one, two)
                        out[0].append(ids[i])
                        out[1].append(ids[j])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text, words).astype("<u8", copy=False).tobytes() for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["class"], pa.array(found, pa.binary())], names=["class", "shingles"])

    return run


def _may_link(a: str, b: str, percent: int):
    """Size and sketch conditions on two classes, as a join condition."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return sizes & (F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch"))) <= 64 - SKETCH_AGREES)


def _class_texts(wanted: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(class, text) of the wanted classes: the text of one row that each is known by."""
    names = classes.join(wanted, "class", "left_semi").select("class", F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    rows = names.join(texts, (texts["h"] == names["_h"]) & texts["doc_id"].eqNullSafe(names["_id"]))
    return rows.select("class", "text").dropDuplicates(["class"])


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    found = _class_texts(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), classes, texts)
    text = lambda x: found.select(F.col("class").alias(x), F.col("text").alias(f"{x}_text"))
    both = pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(_compared(words, percent), "a long, b long, linked boolean").filter("linked").select("a", "b")


def _blocks(meets: DataFrame) -> DataFrame:
    """``meets`` with the blocks each class is in: _b its own, and a row for each
    pair (_low, _high) of blocks that it has a part in. Blocks from 0 hold what
    is outside a group's largest component and meet each other and all others;
    the blocks after them hold the largest component and do not meet each other.
    These are no larger than what they meet, so that a hot group with few others
    in it is spread over many small tasks, and sending the others there costs no
    more than the group itself."""
    parts = meets.groupBy("first", "component").agg(F.sum("n").alias("_n"))
    most = parts.groupBy("first").agg(F.max(F.struct("_n", "component")).alias("_most"), F.sum("_n").alias("_all"))
    full = lambda n, most: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    one, rest = F.col("_all") <= SMALL_SHINGLES, F.col("_all") - F.col("_most._n")
    main_size = F.greatest(F.lit(SMALL_SHINGLES), F.least(F.lit(BLOCK_SHINGLES), rest))
    blocks = most.select("first", F.col("_most.component").alias("_main"), F.when(one, 1).otherwise(full(rest, F.lit(BLOCK_SHINGLES))).alias("_rest"), F.when(one, 0).otherwise(full(F.col("_most._n"), main_size)).alias("_mains"))
    # the rows of a large group meet its row, which stands once for each salt, in many tasks
    salted = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = meets.withColumn("_salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(salted, ["first", "_salt"])
    is_main = (F.col("component") == F.col("_main")) & (F.col("_mains") > 0)
    dealt = dealt.withColumn("_b", F.when(is_main, F.col("_rest") + F.pmod(F.xxhash64("class", F.lit(1)), F.col("_mains"))).otherwise(F.pmod(F.xxhash64("class", F.lit(1)), F.col("_rest"))).cast("int"))
    last = F.when(is_main, F.col("_rest") - 1).otherwise(F.col("_rest") + F.col("_mains") - 1)
    pairs = F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.least(x, F.col("_b")).alias("_low"), F.greatest(x, F.col("_b")).alias("_high")))
    return dealt.withColumn("_at", F.explode(pairs)).select("first", "class", "component", "_b", "_at.*")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILARITY_PERCENT, groups: int = GROUPS, size: int = GROUP_SIZE) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    signed = cut(texts.mapInArrow(_signatures(words, groups, size), "doc_id long, h long, n long, digest binary, signature binary, sketch long"), "signatures")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    classes = signed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(rank).alias("rank"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    classes = cut(classes.select("digest", "rank.doc_id", "rank.h", "n", "signature", "sketch", F.monotonically_increasing_id().alias("class")), "classes")

    # keys that more than one class has
    keyed = classes.select("class", "n", "sketch", "signature").mapInArrow(_keyed(groups, size), "class long, n long, sketch long, key long, first long")
    shared = keyed.groupBy("key").agg(F.min(F.struct("class", "n", "sketch")).alias("least"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = cut(shared.select("key", "least.*"), "shared_keys")
    buckets = cut(keyed.join(shared.select("key"), "key", "left_semi"), "buckets")

    def merged(links: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Labels (class, component) after more links; only contracted links are walked."""
        if labels is None:
            return cut(connected_components(links, "a", "b").select(F.col("node").alias("class"), "component"), "labels")
        of = lambda x: labels.select(F.col("class").alias(x), F.col("component").alias(f"{x}_at"))
        met = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_at", "a").alias("a"), F.coalesce("b_at", "b").alias("b"))
        moved = connected_components(met, "a", "b").select(F.col("node").alias("_from"), F.col("component").alias("_to"))
        nodes = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(labels, "class", "left_anti").withColumn("component", F.col("class")))
        return cut(nodes.join(moved, nodes["component"] == moved["_from"], "left").select("class", F.coalesce("_to", "component").alias("component")), "labels")

    # round 1
    star = buckets.alias("b").join(shared.alias("a"), (F.col("a.key") == F.col("b.key")) & (F.col("a.class") < F.col("b.class")) & _may_link("a", "b", percent))
    agreed = F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch")))
    best = cut(star.groupBy(F.col("b.class").alias("b")).agg(F.min(F.struct(agreed.alias("off"), F.col("a.class").alias("a"))).alias("best")).select(F.col("best.a").alias("a"), "b"), "best")
    links = cut(_links(best, classes, texts, words, percent), "links")
    labels = merged(links, None)
    discard(best, links, shared)

    # round 2
    placed = buckets.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    several = placed.groupBy("key").agg((F.min("component") < F.max("component")).alias("open")).filter("open").select("key")
    meets = cut(placed.join(several, "key", "left_semi").select("first", "class", "n", "component").distinct(), "meets")
    discard(buckets)
    found = _class_texts(meets.select("class").distinct(), classes, texts)
    sets = cut(found.mapInArrow(_sets(words), "class long, shingles binary"), "sets")
    joined = _blocks(meets).join(sets, "class").select("first", "class", "component", "shingles", "_b", "_low", "_high")
    links = cut(joined.groupBy("first", "_low", "_high").applyInArrow(_joining(percent), "a long, b long").distinct(), "links")
    if not links.isEmpty():
        labels = merged(links, labels)
    discard(meets, sets, links)

    named = classes.join(labels, "class", "left").select("digest", "doc_id", F.coalesce("component", "class").alias("component"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = cut(named.join(names, "component").select("digest", "component_id"), "components")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The documents, all columns, without those of a component that are not
    its first by id, null ids last. Rows are told apart by a written number, so
    ids may be null or repeated."""
    names = docs.columns
    rows = numbered(docs, "near_rows")
    found = near_components(rows, "_row", text_col, words, percent).select("doc_id", "component_id")
    # only components of several rows: all others stay as they are
    several = found.filter("doc_id <> component_id").select("component_id").distinct()
    linked = cut(found.join(several, "component_id", "left_semi"), "linked")
    ranked = linked.join(rows.select("_row", F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("_row").alias("row")).alias("_rank")), linked["doc_id"] == F.col("_row"))
    first = ranked.groupBy("component_id").agg(F.min("_rank").alias("_first")).select(F.col("_first.row").alias("doc_id"))
    gone = linked.join(first, "doc_id", "left_anti").select(F.col("doc_id").alias("_gone"))
    return rows.join(gone, rows["_row"] == gone["_gone"], "left_anti").select(*names)
