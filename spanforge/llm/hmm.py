"""A hidden Markov language model over words, trained by Baum-Welch on all training documents.

Every word that occurs OWN_COUNT times in the training documents has emissions of its own, however large the corpus; a rarer one
shares those of all rare words with its ending, of which it has its part by its count. That part doesn't depend on the state, so
that the chain runs over classes: words and endings. Of words with a least share there are at most as many as its inverse
says, whatever the corpus: their emissions and the endings' are a table of bounded size, which every task gets. Those of the other
words stand apart, in parts of a table that grows with the corpus; a block asks each part for the places of its own words.
Neither these nor the counts of all words ever come to the driver or into one task; documents meet the counts in a join.

Documents become blocks of class numbers. In a round the parts answer the blocks, every block is run through scaled forward and
backward recursions over its training documents, and the expected counts of classes and transitions are added up over all blocks,
those of words apart by part. Expected counts are whole numbers of 1 / 4096, so that their sums don't depend on the order of adding.

The recursions go step by step over many sequences at once. A text beyond SEGMENT tokens is cut into segments whose transfer
matrices are found side by side and then composed, so that its likelihood and its counts are those of the whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from spanforge.llm._shared import Scratch, small_batches, table
from spanforge.llm.text import LOWER, SLICE_BYTES, SPACE, Texts, classes, slices

STATES, ROUNDS = 8, 4
#: Share of the training tokens from which on a word's emissions are in every task's table; occurrences from which on they are
#: its own, in that table or apart; different endings of the others.
OWN_SHARE, OWN_COUNT, ENDINGS = 2e-6, 5, 256
#: Training tokens of the words of one part, on average: no more blocks than these ask it for a place.
PART_TOKENS = 1 << 20
#: A block is closed at so many tokens; one text is never in two blocks.
BLOCK_TOKENS = 6_000_000
#: Tokens of a sequence beyond which it is cut, and tokens that are worked on at once.
SEGMENT, AT_ONCE = 1 << 13, 1 << 19
#: The share of an emission that comes from the counts of all states together, and the first probability to stay in a state.
SHARED, STAY = 0.05, 0.95
UNIT = 4096
HELD_OUT_OF, HELD_OUT = 7, 2
END = ""


@dataclass
class Model:
    """start, move: initial and transition probabilities; in_state: tokens of each state, unknown: its probability of a word never seen."""

    start: np.ndarray
    move: np.ndarray
    in_state: np.ndarray
    unknown: np.ndarray
    train_tokens: int = 1

    def emissions(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each state's probability of classes with counts c over all and n by state; c = 0: of all words never seen together."""
        out = np.broadcast_to(self.unknown, n.shape).copy()
        seen = c > 0
        own = n[seen] / np.maximum(self.in_state, 1e-300)
        # A state that holds nothing emits as all do together.
        mixed = np.where(self.in_state > 0, (1 - SHARED) * own + SHARED * c[seen, None] / self.train_tokens, c[seen, None] / self.train_tokens)
        out[seen] = (1 - self.unknown) * mixed
        return out


class Packed:
    """Sequences side by side: step after step, the longest first; order[j] is the sequence at place j of a step."""

    def __init__(self, start: np.ndarray, size: np.ndarray):
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
        offset = np.concatenate([[0], np.cumsum(self.live)])
        step = np.repeat(np.arange(len(self.live)), self.live)
        self.place = np.arange(int(offset[-1])) - offset[step]
        self.at = start[self.order][self.place] + step
        self.last = offset[np.maximum(size, 1) - 1] + np.arange(len(size))


def forward(b: np.ndarray, live: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state probabilities after each token, its probability given those before). b: emissions, packed; start: by sequence."""
    alpha, scale = np.empty_like(b), np.empty(len(b), b.dtype)
    expected, i, one = start, 0, np.ones(b.shape[1], b.dtype)
    for n in live.tolist():
        now = expected[:n] * b[i : i + n]
        total = now @ one
        now /= total[:, None]
        alpha[i : i + n], scale[i : i + n] = now, total
        expected, i = now @ move, i + n
    return alpha, scale


def backward(b: np.ndarray, live: np.ndarray, end: np.ndarray, move: np.ndarray, alpha: np.ndarray, scale: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Expected transitions; alpha becomes the probability of each state given the whole sequence.

    end: by sequence, what follows it, as a factor for each state; before: the states ahead of its first token, zero if there is none.
    """
    beta, pairs, i, back = end.copy(), np.zeros(move.shape), len(b), np.ascontiguousarray(move.T)
    for step in range(len(live) - 1, -1, -1):
        n = int(live[step])
        i -= n
        ahead = beta[:n] * b[i : i + n]
        ahead /= scale[i : i + n, None]
        alpha[i : i + n] *= beta[:n]
        if step:
            j = i - int(live[step - 1])
            pairs += alpha[j : j + n].T @ ahead
        else:
            pairs += before.T @ ahead
        beta[:n] = ahead @ back
    return pairs * move


def _groups(size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Sequences of about most tokens together, those of like length with each other."""
    order = np.argsort(-size, kind="stable")
    which = np.cumsum(size[order]) // most
    for k in np.unique(which).tolist():
        yield order[which == k]


class Sequences:
    """Documents of one block: whole ones and segments of long ones, with what comes before and after each."""

    def __init__(self, model: Model, tokens: np.ndarray, emit: np.ndarray, start: np.ndarray, size: np.ndarray, segment: int, at_once: int):
        self.model, self.tokens, self.emit, self.at_once = model, tokens, emit, at_once
        self.move = model.move.astype(emit.dtype)
        k = len(model.start)
        parts = -(-size // segment)
        self.doc = np.repeat(np.arange(len(size)), parts)
        part = np.arange(len(self.doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = start[self.doc] + part * segment
        self.size = np.minimum(segment, size[self.doc] - part * segment)
        self.first = part == 0
        n = len(self.doc)
        self.given = np.broadcast_to(model.start.astype(emit.dtype), (n, k)).copy()
        self.before, self.end = np.zeros((n, k), emit.dtype), np.ones((n, k), emit.dtype)
        #: Natural log likelihood of documents in several segments.
        self.log_of_cut: dict[int, float] = {}
        for d in np.flatnonzero(parts > 1).tolist():
            self._compose(d, np.flatnonzero(self.doc == d))

    def _compose(self, d: int, of: np.ndarray) -> None:
        """What comes before and after each segment of a document, from the segments' transfer matrices."""
        model, k = self.model, len(self.model.start)
        reached, log = self._transfer(of)
        given, total = model.start, 0.0
        states = []
        for s, i in enumerate(of.tolist()):
            self.given[i] = given
            weight = given * np.exp(log[s] - log[s].max())
            total += log[s].max() + np.log(weight.sum())
            states.append(weight @ reached[s] / weight.sum())
            given = states[-1] @ model.move
            if s + 1 < len(of):
                self.before[of[s + 1]] = states[-1]
        after = np.ones(k)
        for s in range(len(of) - 1, -1, -1):
            self.end[of[s]] = after / (states[s] @ after)
            factor = np.exp(log[s] - log[s].max()) * (reached[s] @ self.end[of[s]])
            after = model.move @ factor
        self.log_of_cut[d] = total

    def _transfer(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment and each state it may begin in: the states at its end, and the log probability of its tokens."""
        k = len(self.model.start)
        reached, log = np.empty((len(of), k, k)), np.empty((len(of), k))
        for some in np.array_split(np.arange(len(of)), int(self.size[of].sum()) * k // self.at_once + 1):
            if len(some):
                packed = Packed(np.repeat(self.start[of[some]], k), np.repeat(self.size[of[some]], k))
                unit = np.tile(np.eye(k, dtype=self.emit.dtype), (len(some), 1))
                alpha, scale = forward(self.emit[self.tokens[packed.at]], packed.live, unit[packed.order], self.move)
                last, sums = np.empty((len(some) * k, k)), np.empty(len(some) * k)
                last[packed.order] = alpha[packed.last]
                sums[packed.order] = np.bincount(packed.place, weights=np.log(scale), minlength=len(sums))
                reached[some], log[some] = last.reshape(-1, k, k), sums.reshape(-1, k)
        return reached, log

    def log_likelihoods(self, n_docs: int) -> np.ndarray:
        """The natural log of each document's probability."""
        out = np.zeros(n_docs)
        alone = np.flatnonzero(~np.isin(self.doc, list(self.log_of_cut)))
        for some in _groups(self.size[alone], self.at_once):
            some = alone[some]
            packed = Packed(self.start[some], self.size[some])
            _, scale = forward(self.emit[self.tokens[packed.at]], packed.live, self.given[some][packed.order], self.move)
            out[self.doc[some][packed.order]] = np.bincount(packed.place, weights=np.log(scale), minlength=len(some))
        for d, log in self.log_of_cut.items():
            out[d] = log
        return out

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(classes by state, first states, transitions, log likelihood): expected counts, those of classes for each row of emit."""
        k = len(self.model.start)
        words, firsts, pairs, log = np.zeros(self.emit.shape), np.zeros(k), np.zeros((k, k)), sum(self.log_of_cut.values())
        for some in _groups(self.size, self.at_once):
            packed = Packed(self.start[some], self.size[some])
            some = some[packed.order]
            tokens = self.tokens[packed.at]
            b = self.emit[tokens]
            alpha, scale = forward(b, packed.live, self.given[some], self.move)
            cut = np.isin(self.doc[some], list(self.log_of_cut))[packed.place]
            log += float(np.log(scale, dtype=float)[~cut].sum())
            pairs += backward(b, packed.live, self.end[some], self.move, alpha, scale, self.before[some])
            for s in range(k):
                words[:, s] += np.bincount(tokens, weights=alpha[:, s], minlength=len(words))
            firsts += alpha[: len(some)][self.first[some]].sum(0, dtype=float)
        return words, firsts, pairs, log


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as compressed bytes, all their lowest bytes first."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int32)


class _Block:
    """Documents on the way to a block: their token numbers, and a number for each different word. Number 0 is the end."""

    def __init__(self):
        self.ids: list = []
        self.held: list[bool] = []
        self.sizes: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.number: dict[bytes, int] = {END.encode(): 0}
        self.n = 0

    def add(self, texts: Texts) -> None:
        """The words of texts, of which an end follows each."""
        words = texts.words(SPACE)

        def name(k: int) -> bytes:
            return texts.buf[words.start[k] : words.end[k]].tobytes()

        which, first = classes(words.hashes(), lambda a, b: words.same(a, b), name)
        number = np.array([self.number.setdefault(name(k), len(self.number)) for k in first.tolist()], np.int32)
        self.tokens.append(np.insert(number[which] if len(first) else np.zeros(0, np.int32), words.first[1:], 0))
        self.n += len(self.tokens[-1])

    def row(self, name: str) -> dict:
        tokens = np.concatenate(self.tokens)
        training = tokens[np.repeat(~np.array(self.held), self.sizes)]
        return {
            "block": name, "ids": self.ids, "held": self.held, "sizes": self.sizes, "tokens": packed(tokens),
            "words": [w.decode() for w in self.number], "counts": np.bincount(training, minlength=len(self.number)).tolist(),
        }


def _added(block: _Block, texts: Texts) -> None:
    """texts as tokens of block. One long text goes in piece by piece, cut at white space, and gets one end."""
    before = [sum(map(len, block.tokens))] if texts.n == 1 else []
    if texts.n > 1 or len(texts.buf) <= SLICE_BYTES:
        block.add(texts)
        block.sizes += (texts.words(SPACE).count + 1).tolist()
        return
    spaces = np.flatnonzero(SPACE[texts.buf])
    a = 0
    while a < len(texts.buf):
        cut = np.searchsorted(spaces, a + SLICE_BYTES)
        b = int(spaces[cut]) if cut < len(spaces) else len(texts.buf)
        block.add(Texts(texts.buf[a:b], np.array([0, b - a])))
        if b < len(texts.buf):
            block.tokens[-1] = block.tokens[-1][:-1]
            block.n -= 1
        a = b
    block.sizes.append(sum(map(len, block.tokens)) - before[0])


def blocks(docs: DataFrame, id: str, text: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(block, ids, held, sizes, tokens, words, counts): documents as token numbers, and for each number its word and training count."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    schema = f"block string, ids array<{kind}>, held array<boolean>, sizes array<int>, tokens binary, words array<string>, counts array<long>"
    narrow = docs.select(F.col(id).alias("id"), F.col(id).cast("string").alias("name"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, block, shape = TaskContext.get().partitionId(), 0, _Block(), None
        for batch in batches:
            shape = batch.schema.field("id").type
            names = batch.column(1).fill_null("").to_pylist()
            ids = batch.column(0).to_pylist()
            for i, j, texts in slices(batch.column(2)):
                block.ids += ids[i:j]
                block.held += [zlib.crc32(x.encode()) % HELD_OUT_OF == HELD_OUT for x in names[i:j]]
                _added(block, Texts(LOWER[texts.buf], texts.at))
                if block.n >= block_tokens:
                    yield _arrow(block.row(f"{part}-{made}"), shape)
                    made, block = made + 1, _Block()
        if block.ids:
            yield _arrow(block.row(f"{part}-{made}"), shape)

    def _arrow(row: dict, shape: pa.DataType) -> pa.RecordBatch:
        types = [pa.string(), pa.list_(shape), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

    return narrow.mapInArrow(run, schema)


def words_of(written: DataFrame) -> DataFrame:
    """(word, c): every word of the training documents and its count."""
    return written.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("c")).where("c > 0")


@dataclass
class Classes:
    """own: the number of each word in every task's table; then come, by ending, the words met once and the other rare ones, and the unknown.

    count: occurrences of each of these classes in the training documents; total, different: those of all words, and how many there
    are; often: the count from which on a word is in own. Words of OWN_COUNT occurrences and less than often stand apart.
    """

    own: dict[str, int]
    count: np.ndarray
    total: int
    different: int
    often: float

    @property
    def parts(self) -> int:
        """Parts into which the words apart are dealt."""
        return max(1, -(-(self.total - int(self.count.sum())) // PART_TOKENS))

    def number(self, word: str, c: int) -> int:
        """The class of a word with count c that doesn't stand apart."""
        n = len(self.own)
        if c == 0:
            return n + 2 * ENDINGS
        return self.own[word] if word in self.own else n + (c > 1) * ENDINGS + zlib.crc32(word[-2:].encode()) % ENDINGS

    @property
    def once(self) -> slice:
        return slice(len(self.own), len(self.own) + ENDINGS)


def classes_of(words: DataFrame) -> Classes:
    """The classes of words(word, c). To the driver come 1 / OWN_SHARE words at most, and a number for each ending."""
    total, different = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = max(OWN_COUNT, OWN_SHARE * total)
    own = words.where(F.col("c") >= often).toArrow()
    order = sorted(range(own.num_rows), key=lambda k, c=own["c"].to_pylist(), w=own["word"].to_pylist(): (-c[k], w[k]))
    names, counts = own["word"].to_pylist(), own["c"].to_pylist()
    ending = F.crc32(F.encode(F.substring("word", -2, 2), "UTF-8")) % ENDINGS
    few = np.zeros(2 * ENDINGS + 1, np.int64)
    for r in words.where(F.col("c") < OWN_COUNT).groupBy(F.when(F.col("c") == 1, 0).otherwise(ENDINGS).alias("kind"), ending.alias("ending")).agg(F.sum("c").alias("c")).collect():
        few[r["kind"] + r["ending"]] = r["c"]
    return Classes({names[k]: at for at, k in enumerate(order)}, np.concatenate([np.array([counts[k] for k in order], np.int64), few]), int(total), int(different), often)


def _apart(classes: Classes):
    return (F.col("c") >= OWN_COUNT) & (F.col("c") < classes.often)


def words_apart(words: DataFrame, classes: Classes) -> DataFrame:
    """(word, c, part, at): the words with emissions of their own that are not in every task's table, and their places in parts."""
    dealt = words.where(_apart(classes)).select("word", "c", F.pmod(F.xxhash64("word"), F.lit(classes.parts)).cast("int").alias("part"))
    return dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("word")) - 1)


def _bounds(block: pa.RecordBatch | pa.Table, row: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, starts, sizes, held) of a block's documents."""
    size, held = (np.array(block[x][row].as_py(), t) for x, t in (("sizes", np.int64), ("held", bool)))
    return unpacked(block["tokens"][row].as_py()), np.cumsum(size) - size, size, held


def coded(written: DataFrame, words: DataFrame, classes: Classes, apart: DataFrame | None = None) -> DataFrame:
    """(block, ids, held, sizes, known, base, within, tokens, parts, places): the blocks as numbers of classes.

    known, base: a document's known tokens and its base score; within: the log of what its words are of their classes. The counts
    of a block's words come to it by a join. parts, places: for its words apart, in order of their numbers, which follow those
    of the classes. apart: words_apart, where that is written.
    """
    apart = words_apart(words, classes) if apart is None else apart
    own = F.shiftleft(F.col("part").cast("long"), 32) + F.col("at")
    counts = words.where(~_apart(classes)).select("word", "c", F.lit(None).cast("long").alias("own")).unionByName(apart.select("word", "c", own.alias("own")))
    places = written.select(F.col("block").alias("of"), F.posexplode("words").alias("number", "word")).join(counts, "word").select("of", "number", "c", "own")
    given = written.sparkSession.sparkContext.broadcast(classes)
    names = ["block", "ids", "held", "sizes", "known", "base", "within", "tokens", "parts", "places"]
    kind = written.schema["ids"].dataType.simpleString()

    def code(key: tuple, block: pa.Table, places: pa.Table) -> pa.Table:
        classes = given.value
        tokens, _, size, held = _bounds(block)
        words = block["words"][0].as_py()
        c, own = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        at = places["number"].to_numpy()
        c[at], own[at] = places["c"].to_numpy(), places["own"].fill_null(-1).to_numpy()
        far = np.flatnonzero(own >= 0)
        far = far[np.argsort(own[far])]
        number = np.array([0 if o >= 0 else classes.number(w, n) for w, n, o in zip(words, c.tolist(), own.tolist(), strict=True)], np.int64)
        of_class = classes.count[number]
        number[far], of_class[far] = len(classes.count) + np.arange(len(far)), c[far]
        parts, first = np.unique(own[far] >> 32, return_index=True)
        asked = [packed(x) for x in np.split(own[far] & 0xFFFFFFFF, first[1:])] if len(far) else []
        part = np.log(np.maximum(c, 1) / np.maximum(of_class, 1))
        owner = np.repeat(np.arange(len(size)), size)
        known, base, within = (np.bincount(owner, weights=x[tokens], minlength=len(size)) for x in (c > 0, np.log10((c + 1) / (classes.total + classes.different + 1)), part))
        lists = [pa.array([v], pa.list_(t)) for v, t in ((known.astype(np.int64), pa.int64()), (base, pa.float64()), (within, pa.float64()))]
        asks = [pa.array([parts.tolist()], pa.list_(pa.int32())), pa.array([asked], pa.list_(pa.binary()))]
        return pa.table([*(block[x] for x in names[:4]), *lists, pa.array([packed(number[tokens])]), *asks], names=names)

    schema = f"block string, ids {kind}, held array<boolean>, sizes array<int>, known array<long>, base array<double>, within array<double>, tokens binary, parts array<int>, places array<binary>"
    return written.select("block", "ids", "held", "sizes", "tokens", "words").groupBy("block").cogroup(places.groupBy("of")).applyInArrow(code, schema)


@dataclass
class Counts:
    """Counts by state: classes has those of the classes, parts(part, c, n, in_state) those of the words apart, in_state their sums."""

    classes: np.ndarray
    parts: DataFrame
    in_state: np.ndarray


_PARTS = "part int, c binary, n binary, in_state array<long>"


def _part(part: int, c: np.ndarray, n: np.ndarray) -> pa.Table:
    """A row of the words apart: occurrences and counts by state, each word's in its place. in_state is in 1 / UNIT."""
    sums = np.rint(n.sum(0) * UNIT).astype(np.int64)
    return pa.table([pa.array([part], pa.int32()), pa.array([c.astype("<i8").tobytes()]), pa.array([n.astype("<f8").tobytes()]), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["part", "c", "n", "in_state"])


def _sums(parts: DataFrame, states: int) -> np.ndarray:
    found = parts.agg(*(F.coalesce(F.sum(F.col("in_state")[k]), F.lit(0)) for k in range(states))).first()
    return np.array(found, float) / UNIT


def _model(classes: Classes, counts: Counts, start: np.ndarray, move: np.ndarray) -> Model:
    """A word never seen is as likely as the words met once would be, each left out; half of a state at most."""
    in_state, seldom = counts.classes.sum(0) + counts.in_state, counts.classes[classes.once].sum(0)
    unknown = (np.minimum(seldom, in_state / 2) + 1) / (in_state + 2) if classes.total else np.ones(len(start))
    return Model(start, move, in_state, unknown, max(1, classes.total))


def _uneven(names: list[str], c: np.ndarray, states: int) -> np.ndarray:
    uneven = 1 + np.array([[zlib.crc32(f"{k} {x}".encode()) % 1024 for k in range(states)] for x in names]) / 512
    return c[:, None] * uneven / uneven.sum(1, keepdims=True)


def first_counts(classes: Classes, apart: DataFrame, states: int, scratch: Scratch) -> Counts:
    """Counts of each class and word apart by state before the first round: uneven by a checksum of state and class."""

    def begin(words: pa.Table) -> pa.Table:
        words = words.sort_by("at")
        c = words["c"].to_numpy()
        return _part(words["part"][0].as_py(), c, _uneven(words["word"].to_pylist(), c, states))

    parts = scratch.written(apart.groupBy("part").applyInArrow(begin, _PARTS), "parts")
    names = [*classes.own, *(f" {k}" for k in range(2 * ENDINGS + 1))]
    return Counts(_uneven(names, classes.count, states), parts, _sums(parts, states))


def _answered(blocks: DataFrame, parts: DataFrame, model: Model, kind: type) -> DataFrame:
    """(of, part, emissions): what each part says of the words that a block asks it for."""
    given = blocks.sparkSession.sparkContext.broadcast(model)

    def answer(key: tuple, asked: pa.Table, part: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows:
            c = np.frombuffer(part["c"][0].as_buffer(), "<i8")
            emit = given.value.emissions(c, np.frombuffer(part["n"][0].as_buffer(), "<f8").reshape(len(c), -1)).astype(kind)
            out = [emit[unpacked(x.as_py())].tobytes() for x in asked["places"]]
        return pa.table([asked["of"], asked["part"], pa.array(out, pa.binary())], names=["of", "part", "emissions"])

    asked = blocks.select(F.col("block").alias("of"), F.explode(F.arrays_zip("parts", "places")).alias("x")).select("of", "x.parts", "x.places").toDF("of", "part", "places")
    return asked.groupBy("part").cogroup(parts.select("part", "c", "n").groupBy("part")).applyInArrow(answer, "of string, part int, emissions binary")


def _with_emissions(blocks: DataFrame, columns: list[str], classes: Classes, model: Model, counts: Counts, kind: type, work: Callable[[pa.Table, Model, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """work(block, model, emissions) for each block: emissions has the rows of the classes, then those of its words apart."""
    given = blocks.sparkSession.sparkContext.broadcast((model, model.emissions(classes.count, counts.classes).astype(kind)))

    def run(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        model, emit = given.value
        rows = answers.sort_by("part")["emissions"]
        far = [np.frombuffer(x.as_buffer(), kind).reshape(-1, emit.shape[1]) for x in rows]
        return work(block, model, np.concatenate([emit, *far]))

    return blocks.select("block", *columns).groupBy("block").cogroup(_answered(blocks, counts.parts, model, kind).groupBy("of")).applyInArrow(run, schema)


def expected_counts(blocks: DataFrame, classes: Classes, model: Model, counts: Counts, scratch: Scratch, segment: int = SEGMENT, at_once: int = AT_ONCE) -> tuple[Counts, np.ndarray, np.ndarray, float]:
    """(counts by state, first states, transitions, log likelihood), expected over all training documents under model.

    Added up in each block and then over all of them, by class and by part; of these the sums by class are what comes to the driver.
    """
    states, n = len(model.start), len(classes.count)
    names = [f"n{k}" for k in range(states)]

    def expect(block: pa.Table, model: Model, emit: np.ndarray) -> pa.Table:
        tokens, start, size, held = _bounds(block)
        words, firsts, pairs, log = Sequences(model, tokens, emit, start[~held], size[~held], segment, at_once).expected()
        last = np.zeros((1, states))
        last[0, 0] = log
        total = np.rint(np.concatenate([words[:n], firsts[None], pairs, last]) * UNIT).astype(np.int64)
        some = np.flatnonzero(total.any(1))
        parts, asked = block["parts"][0].as_py(), block["places"][0].as_py()
        ends = np.cumsum([len(unpacked(x)) for x in asked])[:-1]
        far = np.split(np.rint(words[n:] * UNIT).astype("<i8"), ends) if parts else []
        shrink = zstandard.ZstdCompressor(level=1).compress
        rows = [np.concatenate([some, np.full(len(parts), -1)]), *(np.concatenate([total[some, k], np.zeros(len(parts), np.int64)]) for k in range(states))]
        absent = [None] * len(some)
        columns = [*map(pa.array, rows), pa.array(absent + parts, pa.int32()), pa.array(absent + asked, pa.binary()), pa.array(absent + [shrink(x.tobytes()) for x in far], pa.binary())]
        return pa.table(columns, names=["row", *names, "part", "places", "counts"])

    def gather(key: tuple, found: pa.Table, part: pa.Table) -> pa.Table:
        c = np.frombuffer(part["c"][0].as_buffer(), "<i8")
        total = np.zeros((len(c), states), np.int64)
        for places, some in zip(found["places"], found["counts"], strict=True):
            total[unpacked(places.as_py())] += np.frombuffer(zstandard.ZstdDecompressor().decompress(some.as_py()), "<i8").reshape(-1, states)
        return _part(part["part"][0].as_py(), c, total / UNIT)

    schema = "row long, " + "".join(f"{x} long, " for x in names) + "part int, places binary, counts binary"
    found = scratch.written(_with_emissions(blocks, ["held", "sizes", "tokens", "parts", "places"], classes, model, counts, np.float32, expect, schema), "round")
    by_class = found.where("part IS NULL").groupBy("row").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    far = found.where("part IS NOT NULL").select("part", "places", "counts")
    parts = scratch.written(far.groupBy("part").cogroup(counts.parts.select("part", "c").groupBy("part")).applyInArrow(gather, _PARTS), "parts")
    out = np.zeros((n + states + 2, states))
    out[by_class["row"].to_numpy()] = np.stack([by_class[x].to_numpy() for x in names], 1) / UNIT if by_class.num_rows else 0
    return Counts(out[:n], parts, _sums(parts, states)), out[n], out[n + 1 : n + 1 + states], float(out[-1, 0])


def train(blocks: DataFrame, classes: Classes, states: int = STATES, rounds: int = ROUNDS, segment: int = SEGMENT, at_once: int = AT_ONCE, apart: DataFrame | None = None, scratch: Scratch | None = None) -> tuple[Model, Counts, list[float]]:
    """(model, counts by state, log likelihood of the training documents before each round).

    apart: words_apart, none if it is left out. The counts' table is the last one of scratch, which must have no other.
    """
    spark, scratch = blocks.sparkSession, scratch or Scratch(blocks.sparkSession)
    apart = spark.createDataFrame([], "word string, c long, part int, at int") if apart is None else apart
    start, move = np.full(states, 1 / states), np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    counts, logs = first_counts(classes, apart, states, scratch), []
    for _ in range(rounds if classes.total else 0):
        counts, firsts, pairs, log = expected_counts(blocks, classes, _model(classes, counts, start, move), counts, scratch, segment, at_once)
        scratch.forget(1)
        # One count is added to all, so that no way is closed.
        start, move = (firsts + 1) / (firsts + 1).sum(), (pairs + 1) / (pairs + 1).sum(1, keepdims=True)
        logs.append(log)
    return _model(classes, counts, start, move), counts, logs


def scores(blocks: DataFrame, classes: Classes, model: Model, counts: Counts, id: str, segment: int = SEGMENT, at_once: int = AT_ONCE) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document, from one exact forward pass."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    train_tokens = classes.total

    def score(block: pa.Table, model: Model, emit: np.ndarray) -> pa.Table:
        tokens, start, size, held = _bounds(block)
        log = Sequences(model, tokens, emit, start, size, segment, at_once // 2 + 1).log_likelihoods(len(size))
        ids, known, base, within = (block[x].combine_chunks().flatten() for x in ("ids", "known", "base", "within"))
        columns = [ids, pa.array(held), pa.array(size), known, pa.array(np.full(len(size), train_tokens)), base, pa.array((log + within.to_numpy()) / np.log(10))]
        return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    columns = ["ids", "held", "sizes", "known", "base", "within", "tokens"]
    return _with_emissions(blocks, columns, classes, model, counts, np.float64, score, schema).withColumnRenamed("id", id)


def scored(docs: DataFrame, id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, block_tokens: int = BLOCK_TOKENS, segment: int = SEGMENT, at_once: int = AT_ONCE) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Learned from the rows that are not held out. Null, empty and blank texts are an end alone; a null id counts as an empty one,
    which is not held out; repeated rows are each counted and scored; a very long text is scored whole; without training
    documents every word is the one unknown word, of probability one; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    written = scratch.written(blocks(docs, id, text, block_tokens), "blocks")
    words = scratch.written(words_of(written), "words")
    classes = classes_of(words)
    apart = scratch.written(words_apart(words, classes), "apart")
    by_class = scratch.written(coded(written, words, classes, apart), "classed")
    in_rounds = Scratch(docs.sparkSession)
    model, counts, _ = train(by_class, classes, states, rounds, segment, at_once, apart, in_rounds)
    out = scratch.result(scores(by_class, classes, model, counts, id, segment, at_once), "scores")
    in_rounds.forget()
    return out


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; scored says what each case gets."""
    return scored(table(spark, sf_dir, "documents"))
