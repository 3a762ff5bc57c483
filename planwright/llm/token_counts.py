"""Token counts by finite-state transducers.

Method: the byte-level tokenizer's word split is compiled into a deterministic transducer over
character classes whose transitions carry the boundaries they emit (before the character read,
before the one preceding it, or both).  A text is cut into chunks of equal length; every chunk's
map from entry state to exit state is run for all states at once, the maps compose by a parallel
prefix scan, and a last run from the now known entry states reads off the boundaries.  The second
transducer maps each pre-token to the number of tokens it emits; its transitions are compiled on
first use (one per distinct pre-token, from the library's own model) and kept in a bounded cache,
so counts equal the library's by construction.

Strings of added tokens inside a text count as the library's default has them: one token, and the
text is split there first.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by
one; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
#: Characters handled at once, characters in a chunk of the scan, and pre-tokens kept.
BLOCK, STRIDE, CACHE = 1_000_000, 128, 1_000_000
COUNTS = "doc_id long, n_bytes long, n_tokens long"

# Character classes.
SPACE, OTHER_SPACE, LETTER, SHORT, R, V, L, E, NUMBER, APOSTROPHE, OTHER, END = range(12)
# States: the kind of pre-token that is open, and for white space what its last character is.
START, IN_LETTERS, IN_NUMBER, IN_OTHER, AFTER_SPACE, SPACE_1, WHITE_1, SPACE_2, WHITE_2, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CLOSED = range(14)
N_STATES = 14
HERE, BACK = 1, 2


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and emitted[class, state] of the word split.

    The split takes, in this order: an apostrophe with s, t, re, ve, m, ll or d; an optional space
    with letters; with numbers; with other characters; white space that nothing else follows, or
    all but the last of a run of it; white space.
    """
    nxt = np.zeros((12, N_STATES), np.uint8)
    out = np.zeros((12, N_STATES), np.uint8)
    letters = {LETTER, SHORT, R, V, L, E}
    pending = {QUOTE_R: E, QUOTE_V: E, QUOTE_L: L}
    for c in range(12):
        for s in range(N_STATES):
            if c == END:
                nxt[c, s], out[c, s] = START, HERE | (BACK if s in pending else 0)
                continue
            kind = IN_LETTERS if c in letters else IN_NUMBER if c == NUMBER else QUOTE if c == APOSTROPHE else IN_OTHER if c == OTHER else SPACE_1 if c == SPACE else WHITE_1
            emitted, to = HERE, kind
            solid = c not in (SPACE, OTHER_SPACE)
            if s in pending:
                if c == pending[s]:
                    emitted, to = 0, CLOSED
                elif c in letters:
                    emitted, to = BACK, IN_LETTERS
                else:
                    emitted = HERE | BACK
            elif s == QUOTE:
                if c == SHORT:
                    emitted, to = 0, CLOSED
                elif c in (R, V, L):
                    emitted, to = 0, {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c]
                elif c in (APOSTROPHE, OTHER):
                    emitted, to = 0, IN_OTHER
            elif s in (SPACE_1, SPACE_2) and solid:
                # the last space opens the pre-token of what follows
                emitted, to = (BACK if s == SPACE_2 else 0), IN_OTHER if c == APOSTROPHE else kind
            elif s == WHITE_2 and solid:
                emitted = HERE | BACK
            elif s in (SPACE_1, WHITE_1, SPACE_2, WHITE_2) and not solid:
                emitted, to = 0, SPACE_2 if c == SPACE else WHITE_2
            elif (s == IN_LETTERS and c in letters) or (s == IN_NUMBER and c == NUMBER):
                emitted = 0
            elif s == IN_OTHER and c in (APOSTROPHE, OTHER):
                emitted, to = 0, IN_OTHER
            nxt[c, s], out[c, s] = to, emitted
    return nxt, out


def boundaries(classes: np.ndarray, tables: tuple[np.ndarray, np.ndarray], stride: int = STRIDE) -> np.ndarray:
    """Whether a pre-token starts at each character, by a parallel prefix scan over chunk maps."""
    nxt, out = tables
    n = len(classes)
    rows = max(1, -(-n // stride))
    grid = np.full(rows * stride, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, stride).T)
    flat, emit = nxt.reshape(-1), out.reshape(-1)
    # each chunk's map from entry state to exit state
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for step in range(stride):
        maps = flat[(grid[step].astype(np.int16) * N_STATES)[:, None] + maps]
    # inclusive scan: after the pass with gap g, row i holds the map of chunks i - 2g + 1 to i
    gap = 1
    while gap < rows:
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].copy(), axis=1)
        gap *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[:-1, START]
    emitted = np.empty((stride, rows), np.uint8)
    for step in range(stride):
        at = grid[step].astype(np.int16) * N_STATES + state
        emitted[step] = emit[at]
        state = flat[at]
    emitted = emitted.T.reshape(-1)[:n]
    starts = (emitted & HERE) > 0
    starts[:-1] |= (emitted[1:] & BACK) > 0
    return starts


class Counter:
    """The compiled tokenizer of one worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE tokenizer without prefix space or normalizer is expected")
        added = spec.get("added_tokens") or []
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("added tokens that strip or need word borders are not handled")
        found = sorted((a["content"] for a in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, found))) if found else None
        self.tables = transducer()
        self.split = self.library.pre_tokenizer
        self.classes = np.full(0x110000, 255, np.uint8)
        for c, k in {" ": SPACE, "'": APOSTROPHE, "s": SHORT, "t": SHORT, "m": SHORT, "d": SHORT, "r": R, "v": V, "l": L, "e": E}.items():
            self.classes[ord(c)] = k
        self.emits: dict[str, int] = {}
        self.newline = self.library.encode("\n", add_special_tokens=False).ids[0]

    def _classify(self, codes: np.ndarray) -> None:
        """Learns the class of new characters from how the library splits them."""
        for code in codes.tolist():
            c = chr(code)
            pieces = lambda t: len(self.split.pre_tokenize_str(t))
            if pieces("a" + c) == 1:
                kind = LETTER
            elif pieces("1" + c) == 1:
                kind = NUMBER
            elif pieces("!" + c) == 1:
                kind = OTHER
            else:
                kind = OTHER_SPACE
            self.classes[code] = kind

    def _compile(self, tokens: set[str]) -> None:
        """Adds the transitions of new pre-tokens: the number of tokens each emits.

        Pre-tokens without white space but a leading space keep their borders between newlines, so
        the library reads many in one line-separated text; the rest are read one by one.
        """
        if len(self.emits) + len(tokens) > CACHE:
            self.emits.clear()
        plain, rest = [], []
        for t in tokens:
            (plain if t[1:].isprintable() and " " not in t[1:] and (t[0] == " " or t[0].isprintable()) and t != " " else rest).append(t)
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = np.array(self.library.encode("\n" + "\n".join(part) + "\n", add_special_tokens=False).ids)
            breaks = np.flatnonzero(ids == self.newline)
            if len(breaks) == len(part) + 1:
                self.emits.update(zip(part, (np.diff(breaks) - 1).tolist(), strict=True))
            else:
                rest += part
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for t, got in zip(part, self.library.encode_batch(part, add_special_tokens=False), strict=True):
                self.emits[t] = len(got.ids)

    def pre_tokens(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all texts and the text each belongs to."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.classes[codes]
        if (kinds == 255).any():
            self._classify(np.unique(codes[kinds == 255]))
            kinds = self.classes[codes]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        stops = np.cumsum(lengths)
        # a text ends with a class of its own
        ended = np.insert(kinds, stops, END)
        place = np.arange(len(codes)) + np.repeat(np.arange(len(texts)), lengths)
        starts = np.flatnonzero(boundaries(ended, self.tables)[place])
        edges = [*starts.tolist(), len(codes)]
        tokens = [joined[a:b] for a, b in zip(edges, edges[1:])]
        return tokens, np.searchsorted(stops, starts, side="right")

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if self.added is not None and (parts := self.added.split(t)) != [t]:
                extra[i] = len(parts) - 1
                parts = [p for p in parts if p]
                pieces += parts
                owner += [i] * len(parts)
            elif t:
                pieces.append(t)
                owner.append(i)
        if not pieces:
            return extra
        tokens, doc = self.pre_tokens(pieces)
        distinct = set(tokens)
        if new := distinct.difference(self.emits):
            # where the cache overflows, all that this block needs is compiled again
            self._compile(distinct if len(self.emits) + len(new) > CACHE else new)
        emitted = np.array(list(map(self.emits.__getitem__, tokens)), np.int64)
        of = np.bincount(doc, weights=emitted, minlength=len(pieces)).astype(np.int64)
        np.add.at(extra, np.array(owner), of)
        return extra


_counters: dict[str, Counter] = {}


def _counting(path: str, name: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        where = path if os.path.exists(path) else SparkFiles.get(name)
        counter = _counters.get(where) or _counters.setdefault(where, Counter(where))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = np.zeros(len(texts), np.int64)
            lo, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BLOCK or i + 1 == len(texts):
                    found[lo : i + 1] = counter.counts(texts[lo : i + 1])
                    lo, size = i + 1, 0
            n_bytes = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(found)], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def counted(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer_path`` is the tokenizer's JSON file; where a worker lacks it, the copy that Spark
    ships with the job is read.
    """
    import os

    sc = docs.sparkSession.sparkContext
    sc.addFile(tokenizer_path)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = source.mapInArrow(_counting(tokenizer_path, os.path.basename(tokenizer_path)), COUNTS)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
