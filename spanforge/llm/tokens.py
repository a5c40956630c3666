"""A byte-level BPE tokenizer as finite-state machines: a lexer over characters and a counting transducer over bytes.

The lexer is the split pattern of the tokenizer as a deterministic automaton of eight states. A stretch of text maps each
state it may be entered in to the state it is left in; these maps compose, so a text is cut into chunks whose maps are made
side by side and composed in a prefix scan, after which every chunk is run once more from its now known state.

The transducer reads a word byte by byte and adds up the tokens of the prefix read so far (a step may take some back: a
longer token then replaces shorter ones). Its states hold what later bytes can depend on: for each suffix of the prefix
that begins a token, its place in the trie of tokens, the last token before it and the count there. States and their
annotated transitions are compiled as texts first need them.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm._shared import small_batches, table
from spanforge.llm.text import mix
from spanforge.llm.wordtable import PADDING, Generation, WordTable

TOKENIZER = "byte_bpe_50k.json"
#: Tokens beyond which a document is over the limit.
LIMIT = 512
#: Characters that are worked on at once; longer texts are cut where a word must begin.
PIECE = 1 << 20
#: States and transitions of the transducer that a worker keeps.
MOST_STATES = 200_000
#: Words that the transducer reads side by side; a longer one than LONG_WORD bytes is read by itself.
TOGETHER, LONG_WORD = 4096, 64
#: Characters of a chunk.
CHUNK = 64

# States of the lexer: what the current word is made of so far.
BETWEEN, LETTERS, NUMBERS, OTHERS, SPACES, ONE_SPACE, ONE_MORE, TWO_MORE = range(8)
# Symbols: classes of characters, told apart by what follows.
(S_LETTER, S_NUMBER, S_OTHER, S_SPACE_IN, S_SPACE_END, S_SPACE_LAST, S_BLANK_LAST, S_SHORT, S_LONG, S_SPECIAL, S_REST, S_BREAK, S_NONE) = range(13)
BREAK = 0x110000


def _transitions() -> np.ndarray:
    """next state + 8 if a word begins with this character, for [symbol, state]."""
    begin = 8
    t = np.zeros((13, 8), np.uint8)
    for symbol, own in ((S_LETTER, LETTERS), (S_NUMBER, NUMBERS), (S_OTHER, OTHERS), (S_SHORT, ONE_MORE), (S_LONG, TWO_MORE)):
        t[symbol] = own + begin
        inner = OTHERS if symbol in (S_SHORT, S_LONG) else own
        t[symbol, ONE_SPACE] = t[symbol, inner] = inner
    t[S_LETTER, ONE_MORE], t[S_LETTER, TWO_MORE] = BETWEEN, ONE_MORE
    for symbol in (S_SPACE_IN, S_SPACE_END):
        t[symbol] = SPACES + begin
        t[symbol, SPACES] = SPACES
    t[S_SPACE_LAST] = ONE_SPACE + begin
    t[S_BLANK_LAST] = t[S_SPECIAL] = t[S_BREAK] = BETWEEN + begin
    t[S_REST] = BETWEEN
    t[S_NONE] = np.arange(8)
    return t


TRANSITIONS = _transitions()


@functools.cache
def classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for each code point; 4 for the break between texts."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110001, 2, np.uint8)
    for k, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
            out[a:b] = k
    out[0xD800:0xE000] = 2
    out[BREAK] = 4
    return out


def symbols(cps: np.ndarray, special: np.ndarray) -> np.ndarray:
    """The symbol of each character. special: 1 where a special string begins, 2 in its rest, else 0."""
    kind = classes()[cps]
    after = np.append(kind[1:], 4)
    after[np.append(special[1:], 0) > 0] = 4
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_SPACE_IN, S_BREAK], np.uint8)[kind]
    space = kind == 3
    out[space & (after == 4)] = S_SPACE_END
    last = space & (after < 3)
    out[last] = S_BLANK_LAST
    out[last & (cps == 32)] = S_SPACE_LAST
    quote = np.flatnonzero(cps == 39)
    if len(quote):
        one = np.append(cps, [BREAK, BREAK])[quote + 1]
        two = np.append(cps, [BREAK, BREAK])[quote + 2]
        out[quote[np.isin(one, [*map(ord, "stmd")])]] = S_SHORT
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quote[long]] = S_LONG
    out[special == 1] = S_SPECIAL
    out[special == 2] = S_REST
    return out


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray]:
    """(maps, after): the state maps that stretches of symbols can have, and the number of each one followed by a symbol.

    Maps are numbered as they are met; number 0 is that of the empty stretch. There are a few dozen, so that a chunk's map is
    found in one step for each of its characters, whatever state it may be entered in.
    """
    step = TRANSITIONS & 7
    maps, after = [np.arange(8)], []
    number = {tuple(range(8)): 0}
    for m in maps:
        row = []
        for symbol in range(len(step)):
            made = step[symbol][m]
            at = number.setdefault(tuple(made.tolist()), len(maps))
            if at == len(maps):
                maps.append(made)
            row.append(at)
        after.append(row)
    return np.array(maps, np.intp), np.array(after, np.int16)


def state_maps(symbol: np.ndarray) -> np.ndarray:
    """For each column of symbols (a chunk), the state in which it ends for each state in which it may begin."""
    maps, after = monoid()
    width, flat = after.shape[1], after.ravel()
    at = np.zeros(symbol.shape[1], np.int16)
    for row in symbol:
        at = flat[at * np.int16(width) + row]
    return maps[at]


def prefix_states(maps: np.ndarray, start: int = BETWEEN) -> np.ndarray:
    """The state before each chunk: a prefix scan that composes the maps, twice as far in each round."""
    done = maps.copy()
    far = 1
    while far < len(done):
        done[far:] = np.take_along_axis(done[far:], done[:-far].copy(), axis=1)
        far *= 2
    return np.concatenate([[start], done[:-1, start]]) if len(done) else np.zeros(0, np.intp)


def word_starts(symbol: np.ndarray) -> np.ndarray:
    """Where words begin."""
    n = len(symbol)
    rows = np.full((-(-n // CHUNK)) * CHUNK, S_NONE, np.uint8)
    rows[:n] = symbol
    # One chunk is one column: a step of all chunks then reads one stretch of memory.
    rows = np.ascontiguousarray(rows.reshape(-1, CHUNK).T)
    at = prefix_states(state_maps(rows)).astype(np.uint8)
    begins = np.zeros(rows.shape, bool)
    flat = TRANSITIONS.ravel().astype(np.uint8)
    for k in range(CHUNK):
        go = flat[rows[k] * np.uint8(8) + at]
        begins[k] = go > 7
        at = go & np.uint8(7)
    return np.flatnonzero(begins.T.ravel()[:n])


class Bpe:
    """The vocabulary and merges of a byte-level BPE file, and its counting transducer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in visible)}
        raw = {c: b for b, c in shown.items()}
        self.shown = {b: ord(c) for b, c in shown.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_bytes = {x.encode(): k for x, k in self.special.items()}
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.path, self.raw = path, raw
        self.counts = Counts(self)
        self.trie = {}

    def _compile(self) -> None:
        """The trie of the tokens and the ranks of the merges; only counting needs them."""
        raw = self.raw
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        token_of = {bytes(raw[c] for c in shown): k for k, shown in enumerate(model["vocab"])}
        joined = [(token_of[bytes(raw[c] for c in a)], token_of[bytes(raw[c] for c in b)], token_of[bytes(raw[c] for c in a + b)]) for a, b in pairs]
        # By token: the merge that makes it (-1: none) and its two parts; by two tokens: their merge.
        self.made, self.parts, self.ranks = [-1] * len(token_of), [(0, 0)] * len(token_of), {}
        for k, (a, b, whole) in enumerate(joined):
            self.ranks[a << 17 | b] = k
            if self.made[whole] < 0:
                self.made[whole], self.parts[whole] = k, (a, b)
        self.trie: dict[int, int] = {}
        self.token_at, self.goes_on = [-1], [True]
        for word, token in token_of.items():
            node = 0
            for byte in word:
                self.goes_on[node] = True
                node = self.trie.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.goes_on.append(False)
            self.token_at[node] = token
        self.fits: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[int, ...]] = [(0,)]
        self.number = {self.states[0]: 0}
        self.steps = Generation(20)

    def fit(self, a: int, b: int) -> bool:
        """Whether the tokens a, b stay as they are when they stand side by side.

        The merges that made a and b are taken back, the latest first; a merge across the border that would have come
        before the one taken back breaks the pair.
        """
        got = self.fits.get(a << 17 | b)
        if got is None:
            left, right, ranks, parts, made = a, b, self.ranks, self.parts, self.made
            latest, got = 1 << 60, True
            while True:
                if ranks.get(left << 17 | right, 1 << 60) < latest:
                    got = False
                    break
                made_left, made_right = made[left], made[right]
                if made_left < 0 and made_right < 0:
                    break
                if made_left > made_right:
                    latest, left = made_left, parts[left][1]
                else:
                    latest, right = made_right + 1, parts[right][0]
            self.fits[a << 17 | b] = got
        return got

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the count) for a byte.

        A state's entries are numbers: the place in the trie in 20 bits, above it the last token plus one in 20 more, and above
        that the count there.
        """
        entries, token, change = [], -1, 0
        trie, token_at, goes_on = self.trie, self.token_at, self.goes_on
        for entry in self.states[state]:
            node = entry & 0xFFFFF
            child = trie.get(node << 8 | byte)
            if child is not None:
                if token < 0 and token_at[child] >= 0:
                    last = (entry >> 20 & 0xFFFFF) - 1
                    if last < 0 or self.fit(last, token_at[child]):
                        token, change = token_at[child], (entry >> 40) + 1
                # What no token goes on from has no part in what follows.
                if goes_on[child]:
                    entries.append(entry + child - node)
        after = (*[entry - (change << 40) for entry in entries], token + 1 << 20)
        at = self.number.setdefault(after, len(self.states))
        if at == len(self.states):
            self.states.append(after)
        return at, change

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """256 * next state + change + 128 for each state and byte; transitions that are not there yet are compiled."""
        key = state.astype(np.uint64) * np.uint64(256) + byte
        none, size, h = np.zeros(len(key), np.uint64), np.zeros(len(key), np.uint8), mix(key)
        got = self.steps.find(key, none, size, h)
        miss = np.flatnonzero(got < 0)
        if len(miss):
            new, inverse = np.unique(key[miss], return_inverse=True)
            made = np.array([(a << 8) + change + 128 for a, change in (self.compile(k >> 8, k & 255) for k in new.tolist())], np.int64)
            self.steps.add(new, none[: len(new)], size[: len(new)], mix(new), made)
            got[miss] = made[inverse]
        return got

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word of the lexer: the transducer reads as many words side by side, a byte of each at a time."""
        out = np.zeros(len(words), np.int64)
        if not self.trie:
            self._compile()
        plain = [k for k, w in enumerate(words) if len(w) <= LONG_WORD and w not in self.special_bytes]
        for some in (plain[a : a + TOGETHER] for a in range(0, len(plain), TOGETHER)):
            self._make_room()
            length = np.array([len(words[k]) for k in some])
            buf = np.frombuffer(b"".join([words[k] for k in some]), np.uint8)
            start = np.cumsum(length) - length
            state, total = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
            for far in range(int(length.max())):
                live = np.flatnonzero(length > far)
                got = self.step(state[live], buf[start[live] + far])
                state[live] = got >> 8
                total[live] += (got & 255) - 128
            out[some] = total
        for k in set(range(len(words))).difference(plain):
            out[k] = 1 if words[k] in self.special_bytes else self._count_long(words[k])
        return out

    def _make_room(self) -> None:
        if len(self.states) > MOST_STATES or self.steps.n > MOST_STATES:
            self._reset()
        if len(self.fits) > 4 * MOST_STATES:
            self.fits.clear()

    def _count_long(self, word: bytes) -> int:
        """Byte by byte, for a long word: its transitions are kept by themselves."""
        state = total = 0
        steps: dict[int, tuple[int, int]] = {}
        self._make_room()
        for byte in word:
            key = state * 256 + byte
            step = steps.get(key)
            if step is None:
                if len(steps) > MOST_STATES:
                    # Start anew with the present state alone.
                    here = self.states[state]
                    self._reset()
                    steps, state = {}, self.number.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                    key = state * 256 + byte
                step = steps[key] = self.compile(state, byte)
            state = step[0]
            total += step[1]
        return total

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of text, in bytes."""
        return self.words_of([text])[1:3]

    def words_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts as bytes one after another, starts and ends of their words in these, and for each text its first word."""
        joined = "\0".join(texts) + "\0"
        raw = joined.encode()
        buf = np.frombuffer(raw + bytes(PADDING), np.uint8)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        cps[stops] = BREAK
        special = np.zeros(len(cps), np.uint8)
        if self.find_special:
            for m in self.find_special.finditer(joined):
                special[m.start()], special[m.start() + 1 : m.end()] = 1, 2
        begin = word_starts(symbols(cps, special))
        end = np.append(begin[1:], len(cps))
        real = cps[begin] != BREAK
        begin, end = begin[real], end[real]
        first = np.searchsorted(begin, np.concatenate([[0], stops + 1]), "left")
        if len(raw) > len(cps):
            at = np.append(np.flatnonzero((buf[: len(raw)] & 0xC0) != 0x80), len(raw))
            begin, end = at[begin], at[end]
        return buf, begin, end, first

    def count_texts(self, texts: list[str]) -> np.ndarray:
        buf, begin, end, first = self.words_of(texts)
        total = np.concatenate([[0], np.cumsum(self.counts.numbers(buf, begin, end))])
        return total[first[1:]] - total[first[:-1]]


class Counts(WordTable):
    """Tokens of words."""

    def __init__(self, machine: Bpe):
        super().__init__()
        self.machine = machine

    def learn(self, words: list[bytes]) -> np.ndarray:
        return self.machine.count_words(words)


@functools.cache
def bpe(path: str) -> Bpe:
    return Bpe(path)


#: A blank before a letter always begins a word, whatever came before.
_CUT = re.compile(r"(?<=\S)(?= [A-Za-z])")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of about size characters that begin with a word."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def grouped(texts: list[str], size: int = PIECE) -> Iterator[list[tuple[int, str]]]:
    """(text number, piece) in groups of about size characters."""
    group, chars = [], 0
    for k, text in enumerate(texts):
        for piece in pieces(text, size):
            group.append((k, piece))
            chars += len(piece)
            if chars >= size:
                yield group
                group, chars = [], 0
    if group:
        yield group


def token_counts(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row: tokens of the whole text without added ones. Null: no bytes, no tokens.

    tokenizer: the path of the vocabulary file, which every executor must have. Special strings in a text count as one token.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(id, F.col(text).alias("__text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = bpe(tokenizer)
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for group in grouped([t or "" for t in batch.column(1).to_pylist()]):
                np.add.at(counts, [k for k, _ in group], machine.count_texts([t for _, t in group]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts), pa.array(counts > limit)], names=[id, "n_bytes", "n_tokens", "over_limit"])

    return narrow.mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; null and empty texts have none.

    Very long texts are counted in pieces that begin with a word; repeated rows are each counted; an empty table gives an
    empty one.
    """
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path(TOKENIZER)))
