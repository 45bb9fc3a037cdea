"""Spelling variants of the corpus' words by a frequency-vector trie.

A word's frequency vector counts its letters by groups of letters. Words stand in
a trie by these counts, one level for each group. Two words one edit apart
differ in one count by one (an insertion or deletion), in two counts, once up and
once down (a replacement), or not at all (a replacement inside a group, letters
that moved do not matter to the counts). So a depth-first search from a word may
spend one surplus and one deficit on its way down; the words of the leaves that
it reaches are verified letter by letter.

The first levels (the length, then the commonest groups) are the keys by which Spark
deals the trie over tasks: a word goes to its own node and, as a query, to the nodes
that the budget can reach. The number of these levels follows the vocabulary: the fewest for
which no node holds more than ``NODE_WORDS`` words. Below them each task searches the
nodes that it holds, level by level for many words at once. Each pair is found once:
from its longer word, or from the word whose first differing count is the larger.

Defined cases: null and empty texts have no words; a null id counts as the empty
string in the checksum that picks the runs to be damaged; rows that repeat count
as often as they stand; an empty table, or one without words, gives no rows; of equally
common near words the smallest is the form; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.storage import cut, discard

#: The runs of letters, of which A-Z is lower-cased.
RUN = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_LETTER = 0xFF
#: Letter groups, levels of the trie below the length.
GROUPS = 24
#: Words of a node that one task searches, unless all levels that may be keys are used; words that tasks are cut for.
NODE_WORDS, TASK_WORDS, MOST_KEYS = 20_000, 20_000, 8
#: Queries searched at once and candidates verified at once.
BLOCK_QUERIES, BLOCK_LETTERS = 50_000, 8_000_000
#: What a row may still spend below its node: one surplus, one deficit.
SURPLUS, DEFICIT = 1, 2
HOME = SURPLUS | DEFICIT


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97) -> DataFrame:
    """``word``: the runs of all texts; of those whose checksum with the id ``every`` divides one letter is lost."""
    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(docs[text_col], UPPER, LOWER), F.lit(RUN), F.lit(1))).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))).withColumn("at", F.pmod("h", F.length("run")).cast("int"))
    lost = F.concat(F.col("run").substr(F.lit(1), F.col("at")), F.col("run").substr(F.col("at") + 2, F.length("run")))
    return rows.select(F.when(F.pmod("h", F.lit(every)) == 0, lost).otherwise(F.col("run")).alias("word"))


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters of each group, commonest first: letter by letter down the groups, then up, and so on. There are
    at most 90 letters, so 90 rows reach the driver."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").count().collect()
    found = [""] * groups
    for rank, row in enumerate(sorted(letters, key=lambda r: (-r["count"], r["letter"]))):
        turn, place = divmod(rank, groups)
        found[groups - 1 - place if turn % 2 else place] += row["letter"]
    return found


def _count(group: str) -> Column:
    return F.length("word") - F.length(F.translate("word", group, "")) if group else F.lit(0)


def key_levels(words: DataFrame, groups: list[str], most: int = NODE_WORDS) -> int:
    """The fewest levels below the length for which no node holds more than ``most`` words; MOST_KEYS if none is enough."""
    names = [f"g{i}" for i in range(min(MOST_KEYS, len(groups)))]
    nodes = cut(words.select(F.length("word").alias("size"), *[_count(group).alias(name) for group, name in zip(groups, names)]).groupBy("size", *names).count(), "trie_nodes")
    levels = next((k for k in range(1, len(names)) if (nodes.groupBy("size", *names[:k]).agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0] or 0) <= most), len(names))
    discard(nodes)
    return levels


def _visits(counts: list[Column]) -> Column:
    """(node, size, left) of each node that a word is sent to: its own, and those that spending above them reaches."""
    size = F.length("word")

    def visit(size: Column, left: int, surplus: int | None = None, deficit: int | None = None) -> Column:
        changed = [c - 1 if i == surplus else c + 1 if i == deficit else c for i, c in enumerate(counts)]
        node = F.struct(F.concat_ws(".", size.cast("string"), *[c.cast("string") for c in changed]).alias("node"), size.cast("int").alias("size"), F.lit(left).alias("left"))
        return node if surplus is None else F.when(counts[surplus] > 0, node)

    k = range(len(counts))
    same = [visit(size, HOME), *[visit(size, DEFICIT, i) for i in k], *[visit(size, 0, i, j) for i in k for j in k if i < j]]
    shorter = [visit(size - 1, SURPLUS), *[visit(size - 1, 0, i) for i in k]]
    return F.array(*same, *shorter)


class Trie:
    """The words of some nodes by their remaining counts: for each level the numbers of (parent, count)."""

    def __init__(self, node: np.ndarray, counts: np.ndarray, base: int):
        self.base, self.levels, at = base, [], node.astype(np.int64)
        for level in range(counts.shape[1]):
            known, at = np.unique(at * base + counts[:, level], return_inverse=True)
            self.levels.append(known)
        self.order = np.argsort(at, kind="stable")
        self.first = np.searchsorted(at[self.order], np.arange(at.max() + 2))

    def leaves(self, node: np.ndarray, counts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves within the budgets; a deficit is spent only after the surplus."""
        query, at = np.arange(len(node)), node.astype(np.int64)
        for level, known in enumerate(self.levels):
            wanted, some = [], [(slice(None), 0, 0), (left & SURPLUS > 0, -1, SURPLUS), (left == DEFICIT, 1, DEFICIT)]
            for which, change, spent in some:
                q = query[which]
                key = at[which] * self.base + counts[q, level] + change
                place = np.searchsorted(known, key)
                hit = (known[np.minimum(place, len(known) - 1)] == key) & (counts[q, level] + change >= 0)
                wanted.append((q[hit], place[hit], left[which][hit] ^ spent))
            query, at, left = (np.concatenate(x) for x in zip(*wanted))
        done = (left == 0) | (left == HOME)
        return query[done], at[done]


def one_edit(longer: np.ndarray, other: np.ndarray, size: int, extra: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one edit; ``other`` has ``size`` letters, ``longer`` one more where ``extra``."""
    unlike = longer[:, :size] != other[:, :size]
    moved = longer[:, 1 : size + 1] != other[:, :size]
    first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), size)
    last = np.where(moved.any(axis=1), size - moved[:, ::-1].argmax(axis=1), 0)
    return np.where(extra, last <= first, unlike.sum(axis=1) == 1)


def _pairs_of_size(words: np.ndarray, letters: np.ndarray, node: np.ndarray, left: np.ndarray, size: int, group_of: np.ndarray, skipped: int, groups: int):
    """(query, word) numbers of all near pairs in the nodes of one length."""
    rows = np.repeat(np.arange(len(words)), letters.shape[1])
    counts = np.bincount(rows * (groups + 1) + group_of[letters.ravel()], minlength=len(words) * (groups + 1)).reshape(len(words), groups + 1)[:, skipped:groups]
    home = np.flatnonzero(left == HOME)
    trie = Trie(node[home], counts[home], int(counts.max(initial=0)) + 3)
    extra = letters[:, size] > 0
    for start in range(0, len(words), BLOCK_QUERIES):
        query, leaf = trie.leaves(*(x[start : start + BLOCK_QUERIES] for x in (node, counts, left)))
        some = trie.first[leaf + 1] - trie.first[leaf]
        ends = np.cumsum(some)
        step = max(1, BLOCK_LETTERS // (size + 1))
        done = 0
        while done < len(query):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + step, side="right")))
            n = some[done:upto]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = np.repeat(query[done:upto], n) + start
            b = home[trie.order[np.repeat(trie.first[leaf[done:upto]], n) + inside]]
            once = (left[a] != HOME) | (node[a] != node[b]) | (counts[a] != counts[b]).any(axis=1) | (words[a] < words[b])
            a, b = a[once], b[once]
            near = one_edit(letters[a], letters[b], size, extra[a])
            yield a[near], b[near]
            done = upto


def _search(groups: list[str], skipped: int):
    group_of = np.full(LAST_LETTER + 1, len(groups), np.int64)
    for i, group in enumerate(groups):
        group_of[[ord(x) for x in group]] = i
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        found = []
        sizes = table["size"].to_numpy()
        for size in np.unique(sizes).tolist():
            part = table.filter(pa.array(sizes == size))
            left = part["left"].to_numpy()
            if not (left == HOME).any():
                continue
            words, n = np.array(part["word"].to_pylist()), part["n"].to_numpy()
            words = words.astype(f"<U{size + 1}")  # a blank column where no word is longer
            letters = words.view(np.uint32).reshape(len(words), size + 1)
            node = part["node"].combine_chunks().dictionary_encode().indices.to_numpy()
            for a, b in _pairs_of_size(words, letters, node, left, size, group_of, skipped, len(groups)):
                for x, y in ((a, b), (b, a)):
                    found.append(pa.Table.from_arrays([pa.array(words[x].tolist(), pa.string()), pa.array(n[x]), pa.array(words[y].tolist(), pa.string()), pa.array(n[y])], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    return run


def near_words(words: DataFrame, groups: int = GROUPS, node_words: int = NODE_WORDS) -> DataFrame:
    """(word, n, near, near_n): all pairs of (word, n) one edit apart, both ways round."""
    total = words.count()
    letters = letter_groups(words, groups)
    levels = key_levels(words, letters, node_words)
    counted = words.select("word", "n", *[_count(letters[i]).alias(f"g{i}") for i in range(levels)])
    visits = counted.select("word", "n", F.explode(_visits([F.col(f"g{i}") for i in range(levels)])).alias("v")).filter("v IS NOT NULL").select("word", "n", "v.*")
    tasks = -(-total // TASK_WORDS) or 1
    visits = visits.withColumn("task", F.pmod(F.xxhash64("node"), F.lit(tasks)))
    return visits.groupBy("task").applyInArrow(_search(letters, levels), "word string, n long, near string, near_n long")


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form) that have a form: pointers are doubled until none moves.
    A form is at least twice as common as its word, so there are no circles and at most 6 rounds."""
    links = cut(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        discard(links)
        links = moved
        if moved.filter("moved").isEmpty():
            return links.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3, times: int = 2, every: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of at least ``least_letters`` letters and ``least_count`` occurrences."""
    words = damaged_words(docs, id_col, text_col, every).filter(F.length("word") >= least_letters)
    words = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count), "vocabulary")
    own = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    forms = own.unionByName(near_words(words)).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    far = -F.col("best.less") >= times * F.col("n")
    forms = cut(forms.select("word", "n", "n_near", F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")), "near_words")
    roots = follow_forms(forms)
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
