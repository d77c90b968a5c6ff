"""Byte-pair encoding with a public vocabulary by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that can end its encoding: the one whose predecessor's prefix ends in
a token it may follow. Storing that last token for each prefix gives the encoding by walking back, lets text be appended exactly,
and lets an edit be re-encoded around its place only.
"""

from __future__ import annotations

import array
import base64
import hashlib
from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

CACHED_PIECES = 200_000
CACHED_PAIRS = 1_000_000
LONGEST_CACHED = 48


class PrefixEncoder:
    """Encoder for a rank file (token in base64 and its rank, one a line) and the pattern that parts text before the merges."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.parts = regex.compile(pattern).findall
        self.longest = max(map(len, self.ranks), default=1)
        self._known: dict[str, list[int]] = {}
        self._follows: dict[int, bool] = {}

    @cached_property
    def _matches(self):
        """Finds every token that ends at each byte."""
        machine = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            machine.add_word(token.decode("latin-1"), (len(token), rank))
        machine.make_automaton()
        return machine.iter

    def merged(self, data: bytes) -> list[int]:
        """The encoding by definition: merge the adjacent pair of lowest rank, the first of equals, until none is left. For short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, place = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, place = rank, i
            if best is None:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether the two tokens' bytes encode to these two tokens. An encoding is valid exactly if this holds for all neighbours."""
        key = first << 32 | second
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= CACHED_PAIRS:
                self._follows.clear()
            known = self._follows[key] = self.merged(self.tokens[first] + self.tokens[second]) == [first, second]
        return known

    def extend(self, data: bytes, last: list[int], start: int, stop_early=None) -> int:
        """Fill last[start:] so that last[i] is the last token of data[:i + 1]; last[:start] is given. Returns where it stopped.

        stop_early(i) may end the work after prefix i.
        """
        tokens = self.tokens
        origin = max(0, start - self.longest)
        ending: dict[int, list[tuple[int, int]]] = {}
        text = data[origin:].decode("latin-1")
        done = start
        for at, found in self._matches(text):
            at += origin
            if at < start:
                continue
            if at != done:
                if self._settle(ending.pop(done, ()), last, done, tokens):
                    done += 1
                    if stop_early is not None and stop_early(done - 1):
                        return done
            ending.setdefault(at, []).append(found)
        while done < len(data):
            self._settle(ending.pop(done, ()), last, done, tokens)
            done += 1
            if stop_early is not None and stop_early(done - 1):
                return done
        return done

    def _settle(self, found, last: list[int], at: int, tokens) -> bool:
        for size, rank in sorted(found, reverse=True):
            before = at - size
            if before < 0 or self.may_follow(last[before], rank):
                if at == len(last):
                    last.append(rank)
                else:
                    last[at] = rank
                return True
        raise ValueError("the vocabulary does not hold every byte")

    def walk_back(self, last: list[int], upto: int | None = None) -> list[int]:
        ids, at = [], (len(last) if upto is None else upto) - 1
        while at >= 0:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]

    def piece(self, part: str) -> list[int]:
        """The ids of one part of the pattern."""
        ids = self._known.get(part)
        if ids is None:
            data = part.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is not None:
                ids = [whole]
            else:
                last: list[int] = []
                self.extend(data, last, 0)
                ids = self.walk_back(last)
            if len(part) <= LONGEST_CACHED:
                if len(self._known) >= CACHED_PIECES:
                    self._known.clear()
                self._known[part] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; text that looks like a special token is ordinary text; [] for empty and null."""
        ids: list[int] = []
        if text:
            piece = self.piece
            for part in self.parts(text):
                ids += piece(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


class Prefixes:
    """The last tokens of all prefixes of one part of text, kept so that it can grow or be edited exactly."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        kept = len(self.data)
        self.data += more
        self.encoder.extend(self.data, self.last, kept)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start:end by new; returns how many prefixes were worked out again.

        After the edit the last tokens are worked out until as many in a row as the longest token has bytes equal the old ones; from
        there on each depends on equal predecessors alone, so all others stay.
        """
        old, moved = self.last, len(new) - (end - start)
        data = self.data[:start] + new + self.data[end:]
        last = old[:start]
        equal = 0

        def settled(i: int) -> bool:
            nonlocal equal
            equal = equal + 1 if i >= start + len(new) and last[i] == old[i - moved] else 0
            return equal >= self.encoder.longest

        done = self.encoder.extend(data, last, start, settled)
        self.last = last[:done] + old[done - moved :]
        self.data = data
        return done - start

    def ids(self, upto: int | None = None) -> list[int]:
        """The encoding of the whole, or of the first `upto` bytes."""
        return self.encoder.walk_back(self.last, upto)


_ENCODERS: dict[str, PrefixEncoder] = {}


def vocabulary(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """A public rank file, sent once to every executor: its size is that of the vocabulary, under 1 MB, whatever the data.

    path: the rank file, by default byte_bpe_50k; pattern: how text is parted, by default the one that belongs to it.
    """
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        content = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(content).hexdigest(), content, pattern or public_tokenizers.PATTERN))


def encoder_of(shared) -> PrefixEncoder:
    """The encoder of a vocabulary, built once in each Python worker."""
    digest, content, pattern = shared.value
    if (digest + pattern) not in _ENCODERS:
        _ENCODERS[digest + pattern] = PrefixEncoder(content, pattern)
    return _ENCODERS[digest + pattern]


def encode_column(df: DataFrame, keys: list[str], text: str, path: str | None = None) -> DataFrame:
    """keys and ids: the ids of each row's text, [] for empty and null text. One row for each row, whole texts, no shuffle."""
    shared = vocabulary(df.sparkSession, path)

    def encoded(batches):
        encode = encoder_of(shared).encode
        for batch in batches:
            flat, ends = array.array("i"), array.array("i", [0])
            for value in batch.column("_text"):
                flat.extend(encode(value.as_py()))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, ids], names=[*keys, "ids"])

    rows = df.select(*keys, df[text].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(encoded, f"{schema}, ids array<int>")


def count_column(df: DataFrame, keys: list[str], text: str, path: str | None = None) -> DataFrame:
    """keys and tokens: the number of ids of each row's text, without moving the ids."""
    shared = vocabulary(df.sparkSession, path)

    def counted(batches):
        encode = encoder_of(shared).encode
        for batch in batches:
            sizes = pa.array([len(encode(value.as_py())) for value in batch.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, sizes], names=[*keys, "tokens"])

    rows = df.select(*keys, df[text].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(counted, f"{schema}, tokens bigint")
