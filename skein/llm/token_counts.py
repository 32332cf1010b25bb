"""Token counts of a byte-level BPE by finite-state machines compiled from its published file.

Two deterministic transducers stand in for the tokenizer:

* ``Splitter`` works on character classes and marks where pre-tokens begin. Its transitions carry the marks. The text is
  cut into chunks of equal length; each chunk becomes a map from every state at its start to the state at its end, the
  maps are composed by a parallel prefix scan, and with the true start states all chunks emit their marks at once.
* ``Counter`` works on the bytes of a pre-token. A state is what the future can still depend on: the longest suffix that
  may grow into a token and, for each place where such a token may begin, the token that ends there and how many tokens
  lie between. A transition is annotated with the number of tokens that it adds (which may be negative, as "th" is one
  token after "t" was one). States are made as texts reach them.

No text is tokenized to be counted; tests hold the counts against the library that the file belongs to.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_characters, slices

#: Code points in one chunk of the prefix scan.
CHUNK = 512
#: Compiled states and remembered pre-tokens in a worker; beyond that it starts again with empty tables, in the middle of a
#: word if need be. Pre-tokens of more characters than LONGEST are not remembered.
MAX_STATES, MAX_WORDS, LONGEST = 200_000, 300_000, 64

# Character classes of the pre-tokenizer.
END, LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, C_STMD, C_RV, C_L, C_E = range(11)
# States: what the pre-token before the next character is.
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK, AT_QUOTE, AT_QUOTE_RV, AT_QUOTE_L) = range(11)
# Marks: a pre-token begins at this character, at the one before, or at both.
HERE, BEFORE = 1, 2
#: Code points that the pre-tokenizer takes for white space (fixed values: Unicode White_Space).
WHITE_SPACE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point; 0x110000 is the end of a text."""
    out = np.full(0x110001, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[list(WHITE_SPACE)] = BLANK
    out[ord(" ")], out[ord("'")], out[0x110000] = SPACE, QUOTE, END
    for chars, kind in (("stmd", C_STMD), ("rv", C_RV), ("l", C_L), ("e", C_E)):
        out[[ord(c) for c in chars]] = kind
    return out


def _begin(kind: int, quote: int) -> int:
    """The state after the first character of a pre-token; ``quote``: that for an apostrophe."""
    if kind in (LETTER, C_STMD, C_RV, C_L, C_E):
        return IN_LETTERS
    return {END: FRESH, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: quote, SPACE: ONE_SPACE, BLANK: ONE_BLANK}[kind]


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark by state and class, for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ L N]+|white space not followed by a character|white space."""
    step, mark = np.zeros((11, 11), np.uint8), np.zeros((11, 11), np.uint8)
    letters = (LETTER, C_STMD, C_RV, C_L, C_E)
    for state in range(11):
        for kind in range(11):
            to, m = _begin(kind, AT_QUOTE), HERE
            if state == IN_LETTERS and kind in letters or state == IN_NUMBERS and kind == NUMBER:
                to, m = state, 0
            elif state == IN_OTHERS and kind in (OTHER, QUOTE):
                to, m = state, 0
            elif state == AT_QUOTE:
                if kind == C_STMD:
                    to, m = FRESH, 0
                elif kind in (C_RV, C_L):  # whether it is a contraction shows at the next character
                    to, m = (AT_QUOTE_RV if kind == C_RV else AT_QUOTE_L), 0
                elif kind in (OTHER, QUOTE):
                    to, m = IN_OTHERS, 0
            elif state in (AT_QUOTE_RV, AT_QUOTE_L):
                if kind == (C_E if state == AT_QUOTE_RV else C_L):
                    to, m = FRESH, 0
                else:  # none: the letter before began a pre-token
                    m = BEFORE
                    if kind in letters:
                        to = IN_LETTERS
                    else:
                        m |= HERE
            elif state in (ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK):
                if kind in (SPACE, BLANK):
                    to, m = (MORE_SPACE if kind == SPACE else MORE_BLANK), 0
                elif kind != END:
                    # The last of several leaves the others; a space then leads the next pre-token, another is alone.
                    m = BEFORE * (state in (MORE_SPACE, MORE_BLANK))
                    if state in (ONE_SPACE, MORE_SPACE):
                        to = _begin(kind, IN_OTHERS)
                    else:
                        m |= HERE
            step[state, kind], mark[state, kind] = to, m
    return step, mark


def starts(code_points: np.ndarray) -> np.ndarray:
    """True where a pre-token begins; the texts in ``code_points`` are each followed by 0x110000, which is marked too."""
    step, mark = splitter()
    n = len(code_points)
    rows = -(-n // CHUNK)
    kinds = np.full(rows * CHUNK, END, np.uint8)
    kinds[:n] = classes()[code_points]
    kinds = np.ascontiguousarray(kinds.reshape(rows, CHUNK).T)
    flat = step.ravel()
    maps = np.tile(np.arange(11, dtype=np.uint8), (rows, 1))  # of each chunk: start state -> end state
    for column in kinds:
        maps = flat[maps * np.uint8(11) + column[:, None]]
    scan, width = maps, 1
    while width < rows:  # inclusive prefix scan: composition of maps is associative
        scan = np.concatenate([scan[:width], np.take_along_axis(scan[width:], scan[:-width].astype(np.intp), axis=1)])
        width *= 2
    state = np.concatenate([[FRESH], scan[:-1, FRESH]]).astype(np.intp)
    marks, flat_marks = np.empty((CHUNK, rows), np.uint8), mark.ravel()
    for i, column in enumerate(kinds):
        at = state * 11 + column
        marks[i] = flat_marks[at]
        state = flat[at].astype(np.intp)
    marks = marks.T.ravel()
    out = (marks & HERE).astype(bool)
    out[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return out[:n]


class Counter:
    """Counts the tokens of pre-tokens with a transducer that is determinised as bytes arrive."""

    def __init__(self, path: str):
        model = json.loads(open(path, encoding="utf-8").read())
        self.specials = [t["content"] for t in model["added_tokens"]]
        byte_of = {c: b for b, c in byte_characters().items()}
        raw = lambda t: bytes(byte_of[c] for c in t)
        # Tokens are numbered by the order in which they arise: bytes first, then one for each merge.
        self.tokens = {bytes([b]): b for b in range(256)}
        self.parts = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for merge in model["model"]["merges"]:
            a, b = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            whole = self.tokens.setdefault(a + b, len(self.parts))
            if whole == len(self.parts):
                self.parts.append((self.tokens[a], self.tokens[b]))
            self.joined[self.tokens[a], self.tokens[b]] = whole
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.step: dict[int, tuple[int, int]] = {}
        self.words: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        #: A state: the text that may still grow into a token, and (length back, last token there, tokens since) for each place to begin one.
        self.states: list[tuple[bytes, tuple]] = [(b"", ((0, -1, 0),))]
        self.number = {self.states[0]: 0}
        self.step.clear()
        self.apart: dict[tuple[int, int], bool] = {}

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether the tokenizer, given the bytes of tokens a and b in a row, returns just these two.

        It undoes the merges of both from the last on, and looks whether the pieces that then touch would have merged sooner.
        """
        known = self.apart.get((a, b))
        if known is None:
            known = self.apart[a, b] = self._stays_apart(a, b)
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        before = len(self.parts)
        while True:
            if self.joined.get((a, b), before) < before:
                return False
            for side in (0, 1) if a > b else (1, 0):
                if side == 0 and a > 255:
                    before, a = a, self.parts[a][1]
                    break
                if side == 1 and b > 255:
                    before, b = b + 1, self.parts[b][0]
                    break
            else:
                return True

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Compiles a transition: (next state, tokens added). Full tables are emptied first; the next state is in the new ones."""
        tail, places = self.states[state]
        full = len(self.states) > MAX_STATES
        if full:
            self.clear()
        text = tail + bytes([byte])
        token = added = None
        for back, last, since in places:  # longest first: of the tokens that may end here just one can follow
            t = self.tokens.get(text[len(text) - back - 1 :])
            if t is not None and (last < 0 or self.stays_apart(last, t)):
                token, added = t, 1 - since
                break
        new = [(back + 1, last, since + added) for back, last, since in places if text[len(text) - back - 1 :] in self.prefixes]
        new.append((0, token, 0))
        key = (text[len(text) - new[0][0] :] if new[0][0] else b"", tuple(new))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        out = (self.number[key], added)
        if not full:  # the state that it leads from is gone otherwise
            self.step[state << 8 | byte] = out
        return out

    def word(self, word: str) -> int:
        """Tokens of one pre-token."""
        state = total = 0
        step = self.step.get
        for b in word.encode("utf-8", "surrogatepass"):
            state, added = step(state << 8 | b) or self.move(state, b)
            total += added
        return total

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; special strings inside a text are one token each, as the library's default has it."""
        if len(self.words) > MAX_WORDS:
            self.words = {}
        out = np.zeros(len(texts), np.int64)
        pieces, owners = [], []
        special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        for i, text in enumerate(texts):
            if special and any(s in text for s in self.specials):
                parts = special.split(text)
                out[i] += len(parts) - 1
            else:
                parts = [text]
            for part in parts:
                if part:
                    pieces.append(part)
                    owners.append(i)
        if not pieces:
            return out
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths + 1) - 1  # where the end marks lie
        points = np.full(int(ends[-1]) + 1, 0x110000, np.uint32)
        inside = np.ones(len(points), bool)
        inside[ends] = False
        whole = "".join(pieces)
        points[inside] = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero(starts(points) & inside)
        of = np.searchsorted(ends, at)  # the piece of each pre-token
        cut = (at - of).tolist()  # positions in ``whole``
        cut.append(len(whole))
        known = self.words
        words = list(map(whole.__getitem__, map(slice, cut, cut[1:])))
        counts = list(map(known.get, words))
        if None in counts:
            new = {w: self.word(w) for w in set(words).difference(known)}
            counts = [new[w] if n is None else n for w, n in zip(words, counts, strict=True)]
            known.update((w, n) for w, n in new.items() if len(w) <= LONGEST)
        out += np.bincount(np.asarray(owners)[of], counts, len(texts)).astype(np.int64)
        return out


@lru_cache(4)
def counter(name: str) -> Counter:
    import public_tokenizers

    return Counter(public_tokenizers.path(name))


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens. Whole texts are counted, very long words too, with tables of bounded
    size. Rows that repeat are counted one by one; nothing is shuffled; an empty table gives an empty result. Only doc_id
    and text are read, so other columns of docs cannot clash. name: a byte-level BPE file of the package.
    """

    def run(batches):
        machine = counter(name)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = pa.array(machine.count(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), tokens], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
