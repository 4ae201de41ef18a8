"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

The probability of a word is that of its class times that of the word in its class, and both follow from hashed features of the
two words before. The class is chosen by a softmax over the classes, with an n-gram feature of the word before and a skip feature of
the one before that. Within its class a word is reached along a Huffman tree of the class's words by softmaxes over
the two sides of each node, with both features of that node and a bias from the corpus counts. So without trained
weights a word has its corpus share of the class, and all words of a class always sum to one. Words too rare to tell of contexts
share a leaf and have their corpus share of it.

The weights are trained by distributed gradient updates: in each round the tasks run stochastic gradient steps from the shared
weights over their part of the corpus, and each weight moves by the mean of the tasks that moved it. Every training document is
used. Counts, vocabulary, tree, and the number of weights follow the corpus.

Word counts come from the whole corpus by a shuffle. The most frequent words (a fixed number, sent to the tasks) get classes by
spelling; all others form one class, and their counts reach the documents through a join, so nothing that grows with the
vocabulary is broadcast.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialise, pieces, whole_id, words_of

#: Stands for the end of a document among the words; white space cannot occur in a word.
END = b"\n"
#: Classes of their own: a word that repeats the one before, and all words beyond the head.
REPEAT, REST = 0, 1
#: Codes of words beyond the head: one, and one that repeats the word before. The word at place p of the head has code p + HEAD.
BEYOND, AGAIN, HEAD = 0, 1, 2


@dataclass(frozen=True)
class Vocabulary:
    """The head of the vocabulary: place of each word, its class and log10 count + 1; the trees of the classes; corpus totals.

    Nodes of the trees are the places of the words and, from ``len(place)`` on, the inner ones; ``parent`` is -1 at a root, ``side``
    tells on which side of its parent a node is, ``leaf`` at which node a word's climb begins and ``share`` its log share of that node,
    and ``bias`` is the log odds of side 1 by the corpus counts, for inner nodes.
    """

    place: dict[bytes, int]
    classes: np.ndarray
    counts: np.ndarray
    leaf: np.ndarray
    share: np.ndarray
    parent: np.ndarray
    side: np.ndarray
    bias: np.ndarray
    n_classes: int
    tokens: int
    types: int
    rest_log: float


def word_counts(docs: DataFrame, parts: int, held: int, flush: int = 800_000) -> DataFrame:
    """(w, c): how often each word and the end stand in the training documents. Tasks count first, so frequent words are few rows."""

    def of_piece(b: pa.RecordBatch) -> pa.Table:
        text = b.column(0)
        large = pa.types.is_large_binary(text.type) or pa.types.is_large_string(text.type)
        # Views: the functions go by bytes, and a cast would refuse texts that are no UTF-8.
        found = pc.ascii_split_whitespace(pc.ascii_lower(text.view(pa.large_string() if large else pa.string()))).flatten().value_counts()
        words = pa.table({"w": found.field(0).cast(pa.binary()), "c": found.field(1)})
        # White space at the ends of a text leaves empty words there.
        return pa.concat_tables([words.filter(pc.not_equal(words["w"], b"")), pa.table({"w": pa.array([END], pa.binary()), "c": pa.array([b.num_rows], pa.int64())})])

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("w", use_threads=False).aggregate([("c", "sum")]).select(["w", "c_sum"]).rename_columns(["w", "c"])

    def run(batches):
        tables, new = [], 0
        for b in pieces(batches):
            tables.append(of_piece(b))
            new += tables[-1].num_rows
            if new > flush:
                tables, new = [added(tables)], 0
                if tables[0].num_rows > flush:
                    yield from tables.pop().combine_chunks().to_batches()
        if tables:
            yield from added(tables).combine_chunks().to_batches()

    rows = docs.where(crc_mod("doc_id", parts) != held).select("text")
    return rows.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _spelling(words: list[bytes], width: int = 64) -> np.ndarray:
    """Unit vectors of hashed letter pairs."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    letters = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.int64)
    pairs = (letters[:-1] * 256 + letters[1:]) * 40503 % 65521 % width
    inside = np.ones(len(letters), bool)
    inside[np.cumsum(sizes) - 1] = False
    row = np.repeat(np.arange(len(words)), sizes)
    x = np.bincount(row[inside] * width + pairs[inside[:-1]], minlength=len(words) * width).astype(np.float32).reshape(len(words), width)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def word_classes(words: list[bytes], counts: np.ndarray, n_classes: int, own: int) -> np.ndarray:
    """Classes of words in falling order of count: the first ``own`` and the end have their own, the others go by spelling (spherical k-means)."""
    out = np.full(len(words), -1)
    single = [i for i, w in enumerate(words) if w == END] + [i for i, w in enumerate(words) if w != END][:own]
    out[single] = np.arange(2, 2 + len(single))
    rest = np.flatnonzero(out < 0)
    k = min(n_classes - 2 - len(single), len(rest))
    if k > 0:
        x = _spelling([words[i] for i in rest])
        centres = x[np.linspace(0, min(len(rest), 4 * k) - 1, k).astype(int)].copy()
        x *= np.sqrt(counts[rest])[:, None].astype(np.float32)
        for _ in range(8):
            near = (x @ centres.T).argmax(1)
            sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1).astype(np.float32)
            filled = np.linalg.norm(sums, axis=1) > 0
            centres[filled] = sums[filled] / np.linalg.norm(sums[filled], axis=1, keepdims=True)
        out[rest] = 2 + len(single) + (x @ centres.T).argmax(1)
    return out


def class_trees(counts: np.ndarray, classes: np.ndarray, n_classes: int, least: int = 256) -> tuple[np.ndarray, ...]:
    """(leaf, share, parent, side, bias) of a Huffman tree for the words of each class; ``counts`` are in falling order.

    Words whose common node has a count under ``least`` are one leaf, in which each has its log share of the count: so few
    occurrences tell nothing of contexts. ``leaf`` is the node of a word's leaf.
    """
    n = len(counts)
    total = np.concatenate([counts, np.zeros(n, np.int64)])
    parent, side, bias = np.full(2 * n, -1, np.int32), np.zeros(2 * n, np.int8), np.zeros(n, np.float32)
    new = n
    for c in range(REST + 1, n_classes):
        own = np.flatnonzero(classes == c)[::-1]
        leaves, inner, i, j = [*zip(counts[own].tolist(), own.tolist())], [], 0, 0
        for _ in range(len(leaves) - 1):
            pair = []
            for _ in range(2):
                if j == len(inner) or (i < len(leaves) and leaves[i][0] <= inner[j][0]):
                    pair.append(leaves[i])
                    i += 1
                else:
                    pair.append(inner[j])
                    j += 1
            (less, a), (more, b) = pair
            parent[a] = parent[b] = new
            side[b] = 1
            bias[new - n] = np.log(more / less)
            total[new] = less + more
            inner.append((less + more, new))
            new += 1
    leaf = np.arange(n)
    while n:
        up = parent[leaf]
        joins = (up >= 0) & (total[up] < least)
        if not joins.any():
            break
        leaf = np.where(joins, up, leaf)
    return leaf, np.log(counts / total[leaf]), parent[:new], side[:new], bias[: new - n]


def vocabulary(counts: DataFrame, head: int, n_classes: int, own: int) -> Vocabulary:
    """From the counts of all words: the most frequent, at most ``head``, are those above a count found from a table of counts."""
    tokens, types = counts.agg(F.sum("c"), F.count("*")).first()
    by_count = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(head + 1).toArrow()
    above = np.cumsum(by_count["n"].to_numpy())
    fits = int(np.searchsorted(above, head, "right"))
    least = int(by_count["c"][fits - 1].as_py()) if fits else 1 << 62
    top = counts.where(F.col("c") >= least).toArrow().sort_by([("c", "descending"), ("w", "ascending")])
    words, c = top["w"].to_pylist(), top["c"].to_numpy().astype(np.int64)
    classes = word_classes(words, c, n_classes, own)
    n_classes = max(2, int(classes.max(initial=1)) + 1)
    rest_tokens, rest_types = (tokens or 0) - int(c.sum()), types - len(words)
    return Vocabulary({w: i for i, w in enumerate(words)}, classes, np.log10(c + 1.0), *class_trees(c, classes, n_classes), n_classes, int(tokens or 0), int(types), float(-np.log10(rest_tokens + rest_types + 1)))


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(13)



def _power(x: float, low: int, high: int) -> int:
    """The power of two at or under x, within bounds that are powers of two."""
    return min(max(1 << max(int(x), 1).bit_length() - 1, low), high)


class Model:
    """Weights of the class softmax (``buckets`` x classes) and of the tree nodes (``buckets`` x ``SPAN`` slots), in one vector.

    A row of the class weights is a hash of the word before, in the first half of the buckets, or of the word before that (the skip
    feature), in the second; row 0 is the bias. A slot of the tree weights is a hash of a node with the word before or with the
    one before that.
    """

    #: Bound of a weight.
    LIMIT = 20.0
    SPAN = 32

    def __init__(self, vocab: Vocabulary, buckets: int, weights: np.ndarray | None = None):
        self.vocab, self.buckets, n, c = vocab, buckets, len(vocab.place), vocab.n_classes
        cut = buckets * c
        # Views, as unpickled arrays carry a dtype object of their own, with which np.add.at takes a path that is 30 times slower.
        self.weights = np.zeros(cut + buckets * self.SPAN, np.float32) if weights is None else weights.view(np.float32)
        self.bias = vocab.bias.view(np.float32)
        self.top, self.slots = self.weights[:cut].reshape(buckets, c), self.weights[cut:]
        self.mask = buckets * self.SPAN - 1
        # Codes, and last the lack of a word; both codes beyond the head are one word.
        ids = np.arange(n + HEAD + 1, dtype=np.uint64) + np.uint64(1)
        ids[AGAIN] = ids[BEYOND]
        h = [(_scrambled(ids * np.uint64(2 * i + 1) + np.uint64(i << 40)) >> np.uint64(11)).astype(np.int64) for i in range(4)]
        half = buckets // 2
        self.one, self.two = 1 + h[0] % (half - 1), half + h[1] % half
        self.near, self.skip = h[2], h[3]
        nodes = np.arange(len(vocab.bias), dtype=np.uint64) + np.uint64(1)
        self.node = (_scrambled(nodes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.int64)
        self.outcome = np.concatenate([[REST, REPEAT], vocab.classes]).astype(np.int64)
        self.parent, self.side = vocab.parent.astype(np.int64), vocab.side.astype(np.float32)

    def contexts(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(outcome classes, codes of the word before, codes of the one before that) for documents laid end to end."""
        none = len(self.vocab.place) + HEAD
        one, two = np.full((2, len(codes)), none, np.int64)
        one[1:] = codes[:-1]
        one[starts] = none
        two[1:] = one[:-1]
        two[starts] = none
        outcome = self.outcome.take(codes)
        outcome[(codes >= HEAD) & (codes == one)] = REPEAT
        return outcome, one, two

    def rows(self, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        """The feature rows of the class softmax."""
        return [self.one.take(one), self.two.take(two)]

    def exponents(self, rows: list[np.ndarray]) -> np.ndarray:
        """Sums of the class weights of each row's features and the bias. Weights are within LIMIT, so exponents stay finite."""
        z = self.top.take(rows[0], axis=0)
        for r in rows[1:]:
            z += self.top.take(r, axis=0)
        z += self.top[0]
        return z

    def class_logs(self, outcome: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log probability of each outcome class."""
        z = self.exponents(self.rows(one, two))
        own = z[np.arange(len(z)), outcome]
        np.exp(z, out=z)
        return own - np.log(z.sum(1))

    def climb(self, leaves: np.ndarray, one: np.ndarray, two: np.ndarray):
        """(which words, slots of both features, exponent of side 1, side) of the nodes over each word, from the bottom up."""
        n, at = len(self.vocab.place), np.arange(len(leaves))
        leaves = leaves.astype(np.int64)
        near, skip = self.near.take(one), self.skip.take(two)
        while True:
            up = self.parent.take(leaves)
            live = np.flatnonzero(up >= 0)
            if not len(live):
                return
            if len(live) < len(up):
                leaves, up, near, skip, at = leaves.take(live), up.take(live), near.take(live), skip.take(live), at.take(live)
            b = self.node.take(up - n)
            i, j = (near ^ b) & self.mask, (skip ^ b) & self.mask
            z = self.bias.take(up - n)
            z += self.slots.take(i)
            z += self.slots.take(j)
            yield at, i, j, z, self.side.take(leaves)
            leaves = up

    def token_logs(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outcome classes, log10 probability of class and word); for words beyond the head that of the class and ``rest_log``."""
        outcome, one, two = self.contexts(codes, starts)
        logs = self.class_logs(outcome, one, two).astype(np.float64)
        inside = np.flatnonzero(outcome > REST)
        words = codes[inside] - HEAD
        logs[inside] += self.vocab.share.take(words)
        for at, _, _, z, side in self.climb(self.vocab.leaf.take(words), one[inside], two[inside]):
            z *= 1 - 2 * side
            logs[inside[at]] -= np.log1p(np.exp(np.minimum(z, 60)))
        logs /= np.log(10)
        logs[outcome == REST] += self.vocab.rest_log
        return outcome, logs


def _grouped_sums(values: np.ndarray, order: np.ndarray, first: np.ndarray, few: int = 12) -> np.ndarray:
    """Sums of the rows of each group, which starts at ``first`` in ``order``: small groups member by member together, large ones alone."""
    sizes = np.diff(first, append=len(order))
    out = values.take(order[first], axis=0)
    for r in range(1, few):
        more = np.flatnonzero(sizes > r)
        if not len(more):
            return out
        out[more] += values.take(order[first[more] + r], axis=0)
    for j in np.flatnonzero(sizes > few).tolist():
        out[j] += values.take(order[first[j] + few : first[j] + sizes[j]], axis=0).sum(0)
    return out


class Trainer:
    """Mini-batch gradient steps, with step sizes that fall with the gradients a row or slot has seen (Adagrad)."""

    def __init__(self, model: Model, rate: float):
        self.m, self.rate, self.seen = model, np.float32(rate), 0
        self.row_squares, self.slot_squares = (np.full(len(x), 1e-2, np.float32) for x in (model.top, model.slots))

    def _move(self, names: np.ndarray, grad: np.ndarray) -> None:
        self.row_squares[names] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
        grad *= (-self.rate / np.sqrt(self.row_squares[names]))[:, None]
        grad += self.m.top[names]
        self.m.top[names] = np.clip(grad, -Model.LIMIT, Model.LIMIT, out=grad)

    def classes(self, outcome: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        rows = self.m.rows(one, two)
        pull = self.m.exponents(rows)
        np.exp(pull, out=pull)
        pull /= pull.sum(1, keepdims=True)
        pull[np.arange(len(pull)), outcome] -= 1
        self._move(np.zeros(1, np.int64), pull.sum(0, keepdims=True))
        for r in rows:
            order = np.argsort(r.astype(np.uint16) if self.m.buckets <= 1 << 16 else r, kind="stable")
            ordered = r[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            self._move(ordered[first], _grouped_sums(pull, order, first))

    def words(self, leaves: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        for _, i, j, z, side in self.m.climb(leaves, one, two):
            np.clip(z, -30, 30, out=z)
            np.exp(np.negative(z, out=z), out=z)
            z += 1
            np.reciprocal(z, out=z)
            z -= side
            squares = z * z
            z *= -self.rate
            for slot in (i, j):
                np.add.at(self.slot_squares, slot, squares)
                np.add.at(self.m.slots, slot, z / np.sqrt(self.slot_squares.take(slot)))

    def step(self, codes: np.ndarray, starts: np.ndarray, size: int = 8192) -> None:
        outcome, one, two = self.m.contexts(codes, starts)
        for i in range(0, len(codes), size):
            self.classes(outcome[i : i + size], one[i : i + size], two[i : i + size])
        inside = np.flatnonzero(outcome > REST)
        self.words(self.m.vocab.leaf.take(codes[inside] - HEAD), one[inside], two[inside])
        self.seen += len(codes)


def _packed(codes: np.ndarray) -> bytes:
    """Codes as their low two bytes and then the third, which is mostly zero."""
    return codes.astype(np.uint16).tobytes() + (codes >> 16).astype(np.uint8).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    n = len(packed) // 3
    return np.frombuffer(packed, np.uint16, n).astype(np.int32) | (np.frombuffer(packed, np.uint8, n, 2 * n).astype(np.int32) << 16)


def encoded(rows: DataFrame, held) -> DataFrame:
    """(uid, doc_id, codes, n_tokens, n_known, base, rare) of each row: codes of its words and the end, what the head knows of them,
    and each word beyond the head with its number and the number of times it does not repeat the word before. ``held``: the broadcast vocabulary."""

    def run(batches):
        vocab = held.value
        place = vocab.place.get
        for b in pieces(batches):
            out, words_, n_, m_, offsets = [], [], [], [], [0]
            for t in b.column(2).to_pylist():
                words = words_of(t)
                words.append(END)
                codes = np.fromiter(map(place, words, (-HEAD,) * len(words)), np.int32, len(words))
                beyond = np.flatnonzero(codes == -HEAD).tolist()
                codes += HEAD
                again = [i for i in beyond if i and words[i] == words[i - 1]]
                codes[again] = AGAIN
                rare = Counter(words[i] for i in beyond)
                twice = Counter(words[i] for i in again)
                known = codes[codes >= HEAD] - HEAD
                out.append((_packed(codes), len(words), len(known), float(vocab.counts[known].sum()) if len(known) else 0.0))
                words_ += rare
                n_ += rare.values()
                m_ += [n - twice[w] for w, n in rare.items()]
                offsets.append(len(words_))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64())
            rare = pa.StructArray.from_arrays([pa.array(words_, pa.binary()), pa.array(n_, pa.int32()), pa.array(m_, pa.int32())], ["w", "n", "m"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*out), kinds)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare)], ["uid", "doc_id", "codes", "n_tokens", "n_known", "base", "rare"])

    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return numbered.mapInArrow(run, "uid long, doc_id long, codes binary, n_tokens long, n_known long, base double, rare array<struct<w binary, n int, m int>>")


def _in_batches(packed, size: int):
    """(codes, starts, ends) of whole documents laid end to end, about ``size`` tokens at a time."""
    docs, n = [], 0
    for x in packed:
        docs.append(_unpacked(x))
        n += len(docs[-1])
        if n >= size:
            ends = np.cumsum([len(d) for d in docs])
            yield np.concatenate(docs), np.concatenate([[0], ends[:-1]]), ends
            docs, n = [], 0
    if docs:
        ends = np.cumsum([len(d) for d in docs])
        yield np.concatenate(docs), np.concatenate([[0], ends[:-1]]), ends


#: Weights that travel together, and how many tasks' moves are added up at once.
CHUNK, FAN_IN = 1 << 16, 16
MOVES = "chunk int, part int, total binary, moved binary"


def _added(t: pa.Table) -> pa.Table:
    """Moves of up to FAN_IN tasks or groups of them: their total, and for each weight the number of tasks that moved it."""
    total, moved = None, None
    for s, n in zip(t["total"].to_pylist(), t["moved"].to_pylist()):
        own = np.frombuffer(s, np.float16 if n is None else np.float32).astype(np.float32)
        times = (own != 0).astype(np.uint32) if n is None else np.frombuffer(n, np.uint32)
        total, moved = (own, times) if total is None else (total + own, moved + times)
    return pa.table({"chunk": t["chunk"][:1], "part": pa.array([t["part"][0].as_py() // FAN_IN], pa.int32()), "total": pa.array([total.tobytes()], pa.binary()), "moved": pa.array([moved.tobytes()], pa.binary())})


def train(docs: DataFrame, held, buckets: int, rounds: int, rate: float, batch: int = 65_536, least_tokens: int = 1_000_000) -> np.ndarray:
    """Weights after one pass over all of ``docs(doc_id, codes)`` in ``rounds`` disjoint rounds; ``held`` is the broadcast vocabulary.

    Each round deals its documents to tasks of as many tokens as there are weights of a kind, twice, or more; so what they return is
    a bounded part of what they read. They start from the round's weights and return their moves in chunks, which are added up in a
    tree: no group holds more than FAN_IN of them, whatever the number of tasks.
    """
    spark = docs.sparkSession
    weights = Model(held.value, buckets).weights
    tasks = max(1, held.value.tokens // (rounds * max(least_tokens, 2 * buckets * Model.SPAN)))
    for r in range(rounds):
        start = spark.sparkContext.broadcast(weights)

        def run(batches, start=start):
            from pyspark import TaskContext

            trainer = Trainer(Model(held.value, buckets, start.value.copy()), rate)
            for b in batches:
                for codes, starts, _ in _in_batches(b.column(0).to_pylist(), batch):
                    trainer.step(codes, starts)
            if trainer.seen:
                moves = (trainer.m.weights - start.value).astype(np.float16)
                cut = [(c, moves[i : i + CHUNK]) for c, i in enumerate(range(0, len(moves), CHUNK))]
                cut = [(c, x.tobytes()) for c, x in cut if x.any()]
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in cut], pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array([x for _, x in cut], pa.binary()), pa.nulls(len(cut), pa.binary())], ["chunk", "part", "total", "moved"])

        own = docs.where(F.pmod(F.xxhash64(F.lit(r), "doc_id"), F.lit(rounds)) == r) if rounds > 1 else docs
        found = own.select("codes").coalesce(tasks).mapInArrow(run, MOVES)
        last = tasks - 1
        while True:
            found = found.groupBy("chunk", F.floor(F.col("part") / FAN_IN)).applyInArrow(_added, MOVES)
            last //= FAN_IN
            if not last:
                break
        weights = weights.copy()
        for x in found.toLocalIterator():
            at = slice(x.chunk * CHUNK, (x.chunk + 1) * CHUNK)
            weights[at] += np.frombuffer(x.total, np.float32) / np.maximum(np.frombuffer(x.moved, np.uint32), 1)
        start.unpersist()
    return weights


def score(docs: DataFrame, parts: int = 7, held: int = 2, head: int = 262_144, n_classes: int = 32, own: int = 12, buckets: int | None = None, max_buckets: int = 1 << 17, rounds: int = 2, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Trained on the rows whose crc32(doc_id as text) mod ``parts`` is not ``held``; rows with a null id are neither trained on nor
    held out. ``base_score`` is the add-one unigram log10 probability of the words and the end. ``score`` is the model's: a word
    that repeats the one before is a class of its own, so the probabilities of the next word sum to at most 1. Null and blank
    texts are the end alone. Repeated rows are trained on and scored as often as they stand. An empty table gives none.

    ``buckets``: rows of class weights, and a 32nd of the tree's slots; by default a 128th of the number of different training
    words, from 4,096 to ``max_buckets``, which bounds what each task holds (33 MB).
    """
    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    counts = materialise(word_counts(rows, parts, held), "counts")
    vocab = vocabulary(counts, head, n_classes, own)
    buckets = buckets or _power(vocab.types / 128, 1 << 12, max_buckets)
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(vocab)
    coded = materialise(encoded(rows, words), "coded")
    sent = spark.sparkContext.broadcast(train(coded.where(crc_mod("doc_id", parts) != held).select("doc_id", "codes"), words, buckets, rounds, rate))

    def run(batches):
        model = Model(words.value, buckets, sent.value)
        for b in batches:
            sums = [np.add.reduceat(model.token_logs(codes, starts)[1], starts) for codes, starts, _ in _in_batches(b.column(5).to_pylist(), 32_768)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(np.concatenate(sums) if sums else np.zeros(0))], ["uid", "doc_id", "n_tokens", "n_known", "base", "score"])

    scored = coded.select("uid", "doc_id", "n_tokens", "n_known", "base", "codes").mapInArrow(run, "uid long, doc_id long, n_tokens long, n_known long, base double, score double")
    met = coded.select("uid", F.inline("rare")).join(counts, "w").withColumn("log", F.log10(F.col("c") + 1))
    more = met.groupBy("uid").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.col("log")).alias("base_more"), F.sum(F.col("m") * F.col("log")).alias("score_more"))
    full = scored.join(more, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("base") + zero("base_more") - F.col("n_tokens") * F.log10(F.lit(float(vocab.tokens + vocab.types + 1)))
    return full.select("doc_id", (crc_mod("doc_id", parts) == held).alias("held_out"), "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + zero("score_more")).alias("score"))
