"""Token counts by a compiled finite-state transducer.

For BPE by piece scores a segmentation is the canonical one if and only if every two
neighbouring tokens are canonical together. So the last token of each prefix decides how
the next character continues, and the last tokens within the longest suffix that still
begins a piece are a finite state. Transitions are compiled when first met and carry the
change of the token count. At a space that follows another character the state starts anew.

A text of more than ``PART`` characters is cut into chunks. Within a task their maps go through
a prefix scan by doubling; the chunks of a text of more than ``LONG`` bytes are rows of their own
and dealt to many tasks, whose maps are composed in a tree, some neighbours at a time. A chunk becomes a state map: for each state in which the text before it can end, the state in which
the chunk ends and the tokens between. The states before a chunk follow from the characters
right before it: one if a word begins there, else those of all places where a piece can begin.
Maps compose associatively. Where a map lacks the state that the text does end in, the text is counted in one run instead.

Defined cases: a null text counts as empty; an empty text has no bytes and no tokens;
characters outside the vocabulary count as their bytes; a text of any length, with or without
spaces, takes time in proportion to it; repeated rows and ids stay; extra columns are not
read; an empty table gives an empty table. Models of another kind are refused.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import Memo, workers_ready, written

SPACE = "▁"
#: Bytes from which a text is long, characters of its chunks and of what is read before a chunk, maps composed at a time.
LONG, CHUNK, BEFORE, FAN = 1 << 20, 1 << 17, 256, 32
#: Characters of a chunk within a task.
PART = 1 << 12
#: Compiled transitions and units kept in a worker, and the longest unit kept.
TRANSITIONS, UNITS, UNIT = 1_500_000, 200_000, 64
#: Added to a change of the count, which is then positive.
BIAS = 128
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: A unit begins after this character, at the space.
_EDGE = re.compile(f"[^{SPACE}](?={SPACE})")
#: Stands for any state before a chunk, where a unit begins with it.
ANY = b""


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a message in the wire format of protocol buffers."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, raw[at : at + n]
            at += n


def refusal(raw: bytes) -> str | None:
    """Why a model can't be compiled: its pieces' types, its kind, or its normaliser."""
    top = list(fields(raw))
    types = {dict(fields(v)).get(3, 1) for k, v in top if k == 1}
    trainer, normalizer = (dict(fields(v)) for n in (2, 3) for k, v in top if k == n)
    if trainer.get(3, 1) != 2:
        return "only BPE models are compiled"
    if 4 in types:
        return "user-defined symbols are not compiled"
    if 6 not in types:
        return "only models with byte fallback are compiled"
    if normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
        return "only models that leave texts as they are, but for a space in front, are compiled"
    return None


class PieceTransducer:
    """Deterministic transducer for a sentencepiece BPE model with byte fallback."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.prefixes = {p[:k] for p in scores for k in range(len(p))}  # proper ones: they can go on
        if any(p[k] == SPACE != p[k - 1] for p in scores for k in range(1, len(p))):
            raise ValueError("a piece holds a space after another character: units are not separable")
        self.together = Memo(self._canonical, TRANSITIONS)
        self.units = Memo(self.counted, UNITS)
        self.reset()

    @classmethod
    def from_model(cls, path: str) -> PieceTransducer:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        if why := refusal(m.serialized_model_proto()):
            raise ValueError(why)
        ids = range(m.get_piece_size())
        return cls({m.id_to_piece(i): m.get_score(i) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))})

    def reset(self) -> None:
        """Forget the compiled transitions; state 0 is the start of a unit."""
        self.states = {("", ((None, 0),)): 0}
        self.keys = [("", ((None, 0),))]
        #: state << 21 | character -> (next state << 21) << 8 | change + BIAS
        self.moves: dict[int, int] = {}

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, the leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[w], -k) for k in range(len(parts) - 1) if (w := parts[k] + parts[k + 1]) in self.scores), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _canonical(self, pair: tuple[str | None, str]) -> bool:
        left, right = pair
        return self.merged((left or "") + right) == [x for x in pair if x]

    def _compile(self, move: int) -> int:
        """From a state by a character: the next state and the change of the count.

        A state is the longest suffix that begins a piece and, for each place in it from
        which a piece may still go on, the last token there and its count less the present one.
        """
        suffix, trail = self.keys[move >> 21]
        word = suffix + chr(move & 0x1FFFFF)
        for k in range(len(word)):
            token = word[k:]
            known = token in self.scores
            if (known or len(token) == 1) and trail[k] is not None:
                last, behind = trail[k]
                if self.together[last, token]:
                    change = behind + (1 if known else len(token.encode()))
                    break
        else:
            raise AssertionError("no canonical token")
        alive = [word[k:] in self.prefixes for k in range(len(word) + 1)]
        keep = alive.index(True)
        full = [x and (x[0], x[1] - change) for x in trail] + [(sys.intern(token), 0)]
        key = (sys.intern(word[keep:]), tuple(x if ok else None for x, ok in zip(full[keep:], alive[keep:], strict=True)))
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        found = self.moves[move] = self.states[key] << 29 | change + BIAS
        return found

    def walk(self, state: int, text: str) -> tuple[int, int]:
        """The state after a text within one unit, and its tokens."""
        get, compiled, count = self.moves.get, self._compile, 0
        for char in map(ord, text):
            found = get(state | char) or compiled(state | char)
            state = found >> 8
            count += found & 255
        return state, count - BIAS * len(text)

    def counted(self, unit: str) -> int:
        """Tokens of one unit (spaces, then other characters)."""
        if len(self.moves) > TRANSITIONS:
            self.reset()
        return self.walk(0, unit)[1]

    def all_units(self, text: str) -> int:
        """Tokens of a text that begins with a unit and ends with one."""
        return sum(self.units[u] if len(u) <= UNIT else self.counted(u) for u in map(re.Match.group, _UNIT.finditer(text)))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text, with the model's space before it."""
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        parts = text.split(" ")
        if "" not in parts and len(max(parts, key=len)) < UNIT:
            units = self.units
            return sum([units[SPACE + x] for x in parts])
        return self.all_units(SPACE + text.replace(" ", SPACE))

    def states_after(self, before: str, whole: bool) -> set[int]:
        """The states in which what stands before a chunk can end; whole: nothing stands before that."""
        edges = [m.end() for m in _EDGE.finditer(before)]
        if edges or whole:
            return {self.walk(0, before[edges[-1] if edges else 0 :])[0]}
        return {self.walk(0, before[k:])[0] for k in range(min(self.longest, len(before)))}

    def name_of(self, state: int) -> bytes:
        """The same name for a state in every worker."""
        return hashlib.blake2b(repr(self.keys[state >> 21]).encode(), digest_size=16).digest()

    def chunk_map(self, before: str, whole: bool, chunk: str) -> dict[bytes, tuple[bytes, int]]:
        """State before -> (state after, tokens between) of a chunk, both with spaces as the model writes them."""
        if len(self.moves) > TRANSITIONS:
            self.reset()
        starts = [ANY] if before and before[-1] != SPACE == chunk[0] else None
        edges = [0] if starts else [m.end() for m in [_EDGE.search(chunk)] if m]
        head, rest = (chunk[: edges[0]], chunk[edges[0] :]) if edges else (chunk, "")
        ends = {ANY: (0, 0)} if starts else {self.name_of(s): self.walk(s, head) for s in self.states_after(before, whole)}
        if not rest:
            return {name: (self.name_of(state), n) for name, (state, n) in ends.items()}
        last = rest.rfind(_UNIT.findall(rest)[-1])
        state, open_ = self.walk(0, rest[last:])
        after = self.name_of(state)  # named before the units below may forget the states
        closed = self.all_units(rest[:last])
        return {name: (after, n + closed + open_) for name, (_, n) in ends.items()}


def composed(first: dict, then: dict) -> dict:
    """The map of two neighbours; a state that the second lacks is left out."""
    on = lambda state: then.get(ANY) or then.get(state)
    return {a: (on(b)[0], n + on(b)[1]) for a, (b, n) in first.items() if on(b)}


@lru_cache(maxsize=4)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer.from_model(path)


def prefixes(maps: list[dict]) -> list[dict]:
    """The maps from the text's start to the end of each chunk, by a scan that doubles its step."""
    step = 1
    while step < len(maps):
        maps = [m if k < step else composed(maps[k - step], m) for k, m in enumerate(maps)]
        step *= 2
    return maps


def chunks(text: str, size: int) -> Iterator[tuple[str, bool, str]]:
    """(what stands before, whether that is all, chunk) of a text as the model writes it."""
    whole = SPACE + text.replace(" ", SPACE)
    for at in range(0, len(whole), size):
        yield whole[max(0, at - BEFORE) : at], at <= BEFORE, whole[at : at + size]


def scanned(t: PieceTransducer, text: str, part: int = PART) -> int:
    """Tokens of a text, by the scan over its chunks where it has several."""
    if len(text) <= part:
        return t.count(text)
    found = prefixes([t.chunk_map(*c) for c in chunks(text, part)])[-1].get(t.name_of(0))
    return t.count(text) if found is None else found[1]


#: What a row of chunks carries of its text.
_TEXT = "row long, doc_id long, n_bytes long, own long"
_MAP = "k long, starts array<binary>, ends array<binary>, counts array<long>"
_SEEN = f"{_TEXT}, n_tokens long, k long, whole boolean, before string, chunk string"


def seen(sized: DataFrame, path: str, long: int, chunk: int, part: int) -> DataFrame:
    """Of (doc_id, n_bytes, own, text): a row with the count, or for a long text a row for each chunk."""
    ints = [pa.field(c, pa.int64()) for c in ("row", "doc_id", "n_bytes", "own", "n_tokens", "k")]
    schema = pa.schema([*ints, ("whole", pa.bool_()), ("before", pa.string()), ("chunk", pa.string())])

    def run(batches):
        t, row = transducer(path), TaskContext.get().partitionId() << 33
        for b in batches:
            short = []
            for doc, n_bytes, own, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row += 1
                of = {"row": row, "doc_id": doc, "n_bytes": n_bytes, "own": own}
                if n_bytes <= long:
                    short.append(of | {"n_tokens": scanned(t, text, part)})
                    continue
                for k, (before, whole, piece) in enumerate(chunks(text, chunk)):
                    yield pa.RecordBatch.from_pylist([of | {"k": k, "whole": whole, "before": before, "chunk": piece}], schema=schema)
            yield pa.RecordBatch.from_pylist(short, schema=schema)

    return sized.select("doc_id", "n_bytes", "own", "text").mapInArrow(run, _SEEN)


def state_maps(cut: DataFrame, path: str) -> DataFrame:
    """One row of a map for each chunk; chunks are dealt to many tasks."""

    def run(batches):
        t = transducer(path)
        for b in batches:
            maps = [t.chunk_map(*x) for x in zip(*(b.column(c).to_pylist() for c in (6, 5, 7)), strict=True)]
            sides = [[list(m) for m in maps], [[e for e, _ in m.values()] for m in maps], [[n for _, n in m.values()] for m in maps]]
            kinds = [pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(x, k) for x, k in zip(sides, kinds, strict=True))], names=["row", "doc_id", "n_bytes", "own", "k", "starts", "ends", "counts"])

    return cut.select("row", "doc_id", "n_bytes", "own", "k", "whole", "before", "chunk").repartition("row", "k").mapInArrow(run, f"{_TEXT}, {_MAP}")


def in_a_tree(maps: DataFrame, fan: int = FAN) -> DataFrame:
    """Compose the maps of each text, ``fan`` neighbours at a time, until one is left."""

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        total = None
        for r in group.itertuples():
            own = {bytes(a): (bytes(b), int(n)) for a, b, n in zip(r.starts, r.ends, r.counts, strict=True)}
            total = own if total is None else composed(total, own)
        first = group.iloc[0]
        return pd.DataFrame([{"row": first.row, "doc_id": first.doc_id, "n_bytes": first.n_bytes, "own": first.own, "k": first.k // fan, "starts": list(total), "ends": [b for b, _ in total.values()], "counts": [n for _, n in total.values()]}])

    most = maps.agg(F.max("k")).first()[0] or 0
    while most > 0:
        maps = written(maps.groupBy("row", F.floor(F.col("k") / fan)).applyInPandas(compose, f"{_TEXT}, {_MAP}"), "maps")
        most //= fan
    return maps


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, long: int = LONG, chunk: int = CHUNK, fan: int = FAN, part: int = PART) -> DataFrame:
    """Per row: doc_id, UTF-8 bytes, tokens, and whether they exceed the limit."""
    workers_ready(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("own"), text.alias("text"))
    out = ["doc_id", "n_bytes", "n_tokens"]
    short, own = sized.filter(F.col("n_bytes") <= long), sized.filter(F.col("n_bytes") > long)
    counted = seen(short, path, long, chunk, part).select(out)
    maps = written(state_maps(seen(own, path, long, chunk, part), path), "maps")
    if not maps.isEmpty():
        start = transducer(path).name_of(0)
        total = F.try_element_at(F.map_from_arrays("starts", "counts"), F.lit(start))
        done = written(in_a_tree(maps, fan).select("doc_id", "n_bytes", "own", total.alias("n_tokens")), "counts")
        counted = counted.union(done.filter("n_tokens is not null").select(out))
        lost = done.filter("n_tokens is null").select("own").distinct()
        if not lost.isEmpty():
            # A text with a lost state is counted in one run, as are its copies; those are not counted twice.
            again = seen(own.join(lost, "own", "left_semi"), path, sys.maxsize, chunk, sys.maxsize)
            counted = seen(short, path, long, chunk, part).select(out).union(done.join(lost, "own", "left_anti").select(out)).union(again.select(out))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
