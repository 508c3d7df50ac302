"""Byte-level BPE as a transducer that is determinised while it runs.

A sequence of tokens is the BPE result of its bytes if and only if each two neighbours are the result of their own bytes.
So each prefix of a piece has one last token, and the chains of last tokens form a tree. A state is that tree from the last
place on which all chains agree: of each place from which a token can still go on, the last token and the node in the vocabulary's
byte trie; and the places that lie between. On each byte the transducer moves the nodes, finds the new prefix's last token, drops the
places from which no token goes on, and emits what the chains left have in common: the lookahead is bounded by the longest token. States
that differ only in a token already emitted are one if the tokens to come can't tell them apart. States and transitions are made when first met
and kept in a table that all pieces of a batch walk in step, a byte at a time. When the table is full, the transitions that weren't used
again since it last was go, with the states that none leads to; so neither memory nor the cost of a piece grows with the input.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, by_bytes, table
from .tokens import ID, public_file

#: White space as Unicode has it; Python's \s also takes U+001C to U+001F.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = re.compile(f"(?<=[^{WHITE}]) ")
_LOOSE = "^[{0}]| (?:[{0}]|$)".format(re.sub(r"\\u(\w{4})", r"\\x{\1}", WHITE))
#: Bytes of text, or of ids, that a Python step holds at once, but for a single longer row.
STEP_BYTES = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int], without: int = -1) -> list[int]:
    """BPE by its definition, for a few bytes: again and again the first of the pairs of lowest rank becomes one. without: a rank that no merge makes."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((r if (r := ranks.get(a + b, 1 << 60)) != without else 1 << 60, i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Aging(dict):
    """Values of make(key) in two generations of at most `size` keys each."""

    def __init__(self, size: int, make: Callable | None = None):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None and self.make is not None:
            value = self.make(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Transducer:
    """encode(piece): the ids of one piece of bytes, as a library would give them that looks a whole piece up first."""

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.shift = max(self.tokens).bit_length()
        self.in_order, self.longest = sorted(ranks), max(map(len, ranks))
        self.child: dict[int, int] = {}  # by node * 256 + byte
        self.token_at, self.beginning = [-1], [b""]
        for token, rank in ranks.items():
            node = 0
            for i, byte in enumerate(token):
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.beginning.append(token[: i + 1])
                node = to
            self.token_at[node] = rank
        self.grows = bytearray(len(self.token_at))
        for key in self.child:
            self.grows[key >> 8] = 1
        self.made_of: dict[int, tuple[int, int] | None] = {}  # by id: what its last merge joined; itself twice for one byte; None if no merges reach it
        self.ranks_after: dict[bytes, list[int]] = {}  # by beginning of a token: bounded by the vocabulary
        self.unmade = pa.array([t for t, i in ranks.items() if self.parts(i) is None], pa.large_binary())
        self.fits = Aging(100_000, lambda key: self.apart(key >> self.shift, key & (1 << self.shift) - 1))
        self.alike, self.first_with = Aging(100_000), Aging(100_000)
        # a state's places as a flat tuple: of each the place where its last token begins, that token, and the node of the bytes since (-1: none goes on)
        self.most, self.count = most, 1
        self.places: dict[int, tuple[int, ...]] = {0: (0, -1, 0)}
        self.numbers = {places: number for number, places in self.places.items()}
        self._renew(np.empty(0, np.int64), np.empty(0, np.int64), [])

    def _renew(self, keys: np.ndarray, to: np.ndarray, emitted: list[tuple[int, ...]]) -> None:
        """An empty table with these transitions: by state * 512 + byte (256: the piece ends) the next state and what is emitted."""
        slots = 1 << max(10, int(4 * len(keys)).bit_length())
        self.filled, self.keys = 0, np.full(slots, -1, np.int64)
        self.to, self.out, self.again = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(slots, bool)
        self.emissions: dict[tuple[int, ...], int] = {(): 0}
        for x in emitted:
            self.emissions.setdefault(x, len(self.emissions))
        self._insert(keys, to, np.fromiter((self.emissions[x] for x in emitted), np.int64, len(emitted)))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Of each key its slot, or the free one at which the search for it ends."""
        mask = len(self.keys) - 1
        at = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).view(np.int64) & mask
        held = self.keys[at]
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = at[left] + 1 & mask
            held = self.keys[at[left]]
            left = left[(held != keys[left]) & (held >= 0)]
        return at

    def _insert(self, keys: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Distinct keys that aren't there."""
        if 2 * (self.filled + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.keys >= 0)
            before, again = (self.keys[old], self.to[old], self.out[old]), self.again[old]
            slots = 1 << int(4 * (self.filled + len(keys))).bit_length()
            self.keys, self.to, self.out, self.again = np.full(slots, -1, np.int64), np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(slots, bool)
            self.filled = 0
            self._insert(*before)
            self.again[self._slots(before[0])] = again
        self.filled += len(keys)
        while len(keys):
            at = self._slots(keys)
            free, first = np.unique(at, return_index=True)  # of keys that end at one slot the first gets it
            self.keys[free], self.to[free], self.out[free] = keys[first], to[first], out[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to, out = keys[rest], to[rest], out[rest]

    def _age(self) -> None:
        """Keeps the transitions that were used again, three quarters of the bound at most, and the states that they touch."""
        stay = np.flatnonzero((self.keys >= 0) & self.again)[: self.most * 3 // 4]
        known = list(self.emissions)
        keys, to, emitted = self.keys[stay], self.to[stay], [known[i] for i in self.out[stay].tolist()]
        touched = {0, *(keys >> 9).tolist(), *to.tolist()}
        self.places = {n: self.places[n] for n in touched}
        self.numbers = {places: n for n, places in self.places.items()}
        self._renew(keys, to, emitted)

    def moves(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and numbers of emissions; transitions that aren't known are made."""
        at = self._slots(keys)
        known = self.keys[at] == keys
        self.again[at[known]] = True
        if not known.all():
            new = np.unique(keys[~known])
            made = [self.follow(key >> 9, key & 511) for key in new.tolist()]
            self._insert(new, np.array([x[0] for x in made], np.int64), np.array([x[1] for x in made], np.int64))
            at = self._slots(keys)
        return self.to[at], self.out[at]

    def number(self, places: tuple[int, ...]) -> int:
        known = self.numbers.get(places)
        if known is None:
            known, self.count = self.count, self.count + 1
            self.numbers[places] = known
            self.places[known] = places
        return known

    def parts(self, token: int) -> tuple[int, int] | None:
        if token not in self.made_of:
            whole = self.tokens[token]
            found = [token, token] if len(whole) == 1 else merge(whole, self.ranks, token)
            self.made_of[token] = (found[0], found[1]) if len(found) == 2 else None
        return self.made_of[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether the two stay apart: undo their merges from the latest on, and see if what meets at the border would have merged before."""
        left, right, before = a, b, (1 << 60, 0)  # of two equal merges the left one comes first
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and (joined, 1) < before:
                return False
            undo_left, undo_right = len(self.tokens[left]) > 1, len(self.tokens[right]) > 1
            if undo_left and (left > right or not undo_right):
                before, left = (left, 1), self.parts(left)[1]
            elif undo_right:
                before, right = (right, 2), self.parts(right)[0]
            else:
                return True

    def extending(self, whole: bytes, n: int) -> list[int]:
        """The ranks of the tokens that begin with whole, and of what they are after n bytes, in order."""
        if whole not in self.ranks_after:
            lo, hi = bisect_left(self.in_order, whole), bisect_left(self.in_order, whole + b"\xff" * self.longest)
            found = self.in_order[lo:hi]
            self.ranks_after[whole] = sorted({self.ranks[t] for t in found} | {self.ranks[t[n:]] for t in found if t[n:] in self.ranks})
        return self.ranks_after[whole]

    def like(self, token: int, node: int) -> int:
        """A token that allows and forbids the same neighbours that begin with the node's bytes; so that states which differ in the last token only are one.
        What counts are the parts at the token's end that a token can extend by the first byte, and which of those tokens' ranks come before the part is used up."""
        byte = self.beginning[node][:1]
        key = token << 8 | byte[0]
        found = self.alike[key]
        if found is None:
            marks, at, limit = [], token, None
            while True:
                whole = self.tokens[at] + byte
                node = 0
                for b in whole:
                    node = self.child.get(node << 8 | b, -1)
                    if node < 0:
                        break
                if node >= 0:
                    ranks = self.extending(whole, len(self.tokens[at]))
                    if count := len(ranks) if limit is None else bisect_left(ranks, limit):
                        marks.append((at, count))
                if len(self.tokens[at]) == 1:
                    break
                limit, at = at, self.parts(at)[1]
            sign = (byte, *marks)
            found = self.first_with[sign]
            if found is None:
                found = token
                self.first_with.put(sign, token)
            self.alike.put(key, found)
        return found

    def step(self, places: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The places after one more byte, and the tokens that are certain now."""
        child, token_at, grows = self.child, self.token_at, self.grows
        parent, token, node = list(places[::3]), list(places[1::3]), list(places[2::3])
        n, begin, last = len(node), -1, -1
        for k in range(n):
            at = node[k]
            if at >= 0:
                at = child.get(at << 8 | byte, -1)
                if at >= 0:
                    if last < 0 and (found := token_at[at]) >= 0 and self.parts(found) and (token[k] < 0 or self.fits[token[k] << self.shift | found]):
                        begin, last = k, found
                    if not grows[at]:
                        at = -1
                node[k] = at
        parent.append(begin)
        token.append(last)
        node.append(0)
        # the last place that lies on all chains which a token can still continue
        stays = [at >= 0 for at in node]
        left, cut = sum(stays), n
        while left > 1:
            if stays[cut]:
                p = parent[cut]
                if stays[p]:
                    left -= 1
                else:
                    stays[p] = True
            cut -= 1
        while not stays[cut]:
            cut -= 1
        emitted, at = [], cut
        while at:
            emitted.append(token[at])
            at = parent[at]
        first = node[cut]
        out = [0, -1 if first < 0 or token[cut] < 0 else self.like(token[cut], first) if first else token[cut], first]
        place = {cut: 0}
        for k in range(cut + 1, n + 1):
            if stays[k]:
                place[k] = len(place)
                out += (place[parent[k]], token[k], node[k])
        return tuple(out), tuple(reversed(emitted))

    def follow(self, number: int, byte: int) -> tuple[int, int]:
        places = self.places[number]
        if byte < 256:
            places, emitted = self.step(places, byte)
            number = self.number(places)
        else:
            number, emitted = 0, self.end(places)
        return number, self.emissions.setdefault(emitted, len(self.emissions))

    @staticmethod
    def end(places: tuple[int, ...]) -> tuple[int, ...]:
        out, at = [], len(places) // 3 - 1
        while at:
            out.append(places[3 * at + 1])
            at = places[3 * at]
        return tuple(reversed(out))

    def encode(self, piece: bytes) -> list[int]:
        """One piece, without the table: for long ones, and to compare."""
        whole = self.ranks.get(piece)
        if whole is not None and self.parts(whole) is None:  # no merges make it, but a whole piece is looked up
            return [whole]
        places, out, known = self.places[0], [], {}
        for byte in piece:
            found = known.get((places, byte))
            if found is None:
                found = known[places, byte] = self.step(places, byte)
                if len(known) > 10_000:
                    known.clear()
            places, emitted = found
            out += emitted
        return [*out, *self.end(places)]

    def batch(self, pieces: pa.Array, longest: int = 64) -> pa.Array:
        """The ids of each piece of a string or binary column without nulls, as little-endian 32-bit numbers."""
        pieces = pieces.cast(pa.large_binary())
        starts = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        sizes = np.diff(starts)
        alone = {k: self.encode(pieces[k].as_py()) for k in np.flatnonzero(sizes > longest).tolist()}
        for k in np.flatnonzero(np.asarray(pc.is_in(pieces, self.unmade))).tolist():
            alone[k] = self.encode(pieces[k].as_py())
        sizes = sizes.copy()
        sizes[list(alone)] = 0
        order = np.argsort(-sizes, kind="stable")
        begin, size = starts[:-1][order], sizes[order]
        edges = np.concatenate(([0], np.cumsum(size + 1)))
        state, out = np.zeros(len(order), np.int64), np.zeros(int(edges[-1]), np.int64)
        counts = len(order) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), "right")
        for i, n in enumerate(counts.tolist()):
            state[:n], out[edges[:n] + i] = self.moves(state[:n] << 9 | data[begin[:n] + i])
        out[edges[1:] - 1] = self.moves(state << 9 | 256)[1]
        known = [np.array(x, ID).tobytes() for x in self.emissions]
        if alone:
            for k, own in zip(np.argsort(order)[list(alone)].tolist(), alone.values(), strict=True):
                out[edges[k]] = len(known)
                known.append(np.array(own, ID).tobytes())
        if self.filled > self.most:
            self._age()
        tokens = pa.array(known, pa.large_binary()).take(pa.array(out))
        return joined(tokens, edges).take(pa.array(np.argsort(order)))


def joined(values: pa.Array, edges: np.ndarray) -> pa.Array:
    """Runs of a large binary column put together: one value for each two edges, without a copy."""
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[edges])), values.buffers()[2] or pa.py_buffer(b"")])


class Utf8Stream:
    """Text from bytes that arrive in parts: a state machine over bytes. feed() gives what is complete; a begun character waits.

    A state says which bytes may come next and how many more follow. What can't be a character becomes U+FFFD, one for each longest
    beginning of a character, as Unicode recommends; the byte that ended it is looked at anew.
    """

    #: By lead byte: the range of the next byte and the count of bytes to come, as the Unicode standard's table of well-formed UTF-8 has them.
    LEADS = {b: (0x80, 0xBF, 1) for b in range(0xC2, 0xE0)} | {b: (0x80, 0xBF, 2) for b in range(0xE1, 0xF0)} | {b: (0x80, 0xBF, 3) for b in range(0xF1, 0xF4)}
    LEADS |= {0xE0: (0xA0, 0xBF, 2), 0xED: (0x80, 0x9F, 2), 0xF0: (0x90, 0xBF, 3), 0xF4: (0x80, 0x8F, 3)}

    def __init__(self, wait: bytes = b""):
        self.low = self.high = self.more = self.code = 0
        self.wait = b""
        self.feed(wait)

    def feed(self, data: bytes) -> str:
        if not self.more and data.isascii():
            return data.decode("ascii")
        out = []
        for byte in data:
            if self.more:
                if self.low <= byte <= self.high:
                    self.code, self.more, self.wait = self.code << 6 | byte & 0x3F, self.more - 1, self.wait + bytes([byte])
                    self.low, self.high = 0x80, 0xBF
                    if not self.more:
                        out.append(chr(self.code))
                        self.wait = b""
                    continue
                out.append(self.close())
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self.LEADS:
                self.low, self.high, self.more = self.LEADS[byte]
                self.code, self.wait = byte & 0x3F >> self.more, bytes([byte])
            else:
                out.append("\ufffd")
        return "".join(out)

    def close(self) -> str:
        rest = "\ufffd" if self.more else ""
        self.more, self.wait = 0, b""
        return rest


class TokenDecoder:
    """Texts of ids. The UTF-8 machine's moves over whole tokens are kept, by the bytes that wait and the token; runs of tokens that are whole
    characters by themselves move it from its first state to its first state and are gathered at once."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.moves = tokens, Aging(200_000, self._move)
        alone = [self._move((b"", i)) for i in range(len(tokens))]
        self.whole = np.array([not wait for _, wait in alone])
        self.alone = [text if not wait else "" for text, wait in alone]
        self.texts = pa.array([x.encode() for x in self.alone], pa.large_binary())

    def _move(self, key: tuple[bytes, int]) -> tuple[str, bytes]:
        stream = Utf8Stream(key[0])
        return stream.feed(self.tokens[key[1]]), stream.wait

    def _mixed(self, ids: np.ndarray) -> str:
        numbers, at, n = ids.tolist(), 0, len(ids)
        out = [self.alone[i] for i in numbers]
        for k in np.flatnonzero(~self.whole[ids]).tolist():
            if k < at:
                continue
            wait, at = b"", k
            while at < n and (wait or at == k):
                out[at], wait = self.moves[wait, numbers[at]]
                at += 1
            if wait:
                out.append("\ufffd")
        return "".join(out)

    def batch(self, column: pa.Array) -> pa.Array:
        """The texts of a binary column of ids; null for null."""
        if not len(column):
            return pa.array([], pa.large_string())
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        ids = np.frombuffer(column.buffers()[2] or b"", ID)[ends[0] // 4 : ends[-1] // 4]
        edges = (ends - ends[0]) // 4
        partial = np.concatenate(([0], np.cumsum(~self.whole[ids])))[edges]
        mixed = np.flatnonzero(np.diff(partial)).tolist()
        texts = joined(self.texts.take(pa.array(ids)), edges).cast(pa.large_string())
        if not mixed and not column.null_count:
            return texts
        out, null = texts.to_pylist(), np.asarray(column.is_null())
        for k in mixed:
            out[k] = self._mixed(ids[edges[k] : edges[k + 1]])
        return pa.array([None if n else x for n, x in zip(null.tolist(), out, strict=True)], pa.large_string())


def pattern(source: str):
    import regex

    return regex.compile(source.replace("[^\\s", f"[^{WHITE}").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]"))


class TextEncoder:
    """Ids of whole texts.

    A space that follows a character other than white space always begins a new match of the byte-level pattern, whatever
    stands around it. A text may therefore be cut there and the parts encoded one by one: the ids are those of the whole
    text. Of a batch, each distinct part is matched once, and each distinct match goes through the transducer once.
    """

    def __init__(self, source: str, machine: Transducer):
        self.find, self.machine = pattern(source).findall, machine

    def _matches(self, part: str) -> list[str]:
        """Of a space and the part."""
        if part.isalpha():  # letters only
            return [" " + part]
        if part[-1:] in (".", ",") and part[:-1].isalpha():
            return [" " + part[:-1], part[-1]]
        return self.find(" " + part)

    def batch(self, texts: pa.Array) -> pa.Array:
        """Ids of a string column without nulls, as little-endian 32-bit numbers."""
        if not len(texts):
            return pa.array([], pa.large_binary())
        loose = np.asarray(pc.match_substring_regex(texts, _LOOSE))  # with a space before white space or at an end: cut one by one
        cut = [_CUT.split(texts[k].as_py()) for k in np.flatnonzero(loose).tolist()]
        lists = pc.split_pattern(texts.filter(pa.array(~loose)), " ")
        sizes = np.concatenate((np.diff(lists.offsets.to_numpy()), np.array([len(c) for c in cut], np.int64)))
        parts = pa.concat_arrays([lists.flatten(), pa.array([p for c in cut for p in c], pa.string())]).dictionary_encode()
        edges = np.concatenate(([0], np.cumsum(sizes)))
        kinds, which = parts.dictionary.to_pylist(), parts.indices.to_numpy().copy()
        heads = [kinds[k] for k in which[edges[:-1]].tolist()]
        which[edges[:-1]] = len(kinds) + np.arange(len(heads))
        found = [self._matches(p) for p in kinds] + [self.find(p) for p in heads]
        pieces = pa.array([m for f in found for m in f], pa.string()).dictionary_encode()
        ids = self.machine.batch(pieces.dictionary).take(pieces.indices)
        units = joined(ids, np.concatenate(([0], np.cumsum([len(f) for f in found]))))
        order = np.concatenate((np.flatnonzero(~loose), np.flatnonzero(loose)))
        return joined(units.take(pa.array(which)), edges).take(pa.array(np.argsort(order)))

    def ids(self, text: str) -> bytes:
        return self.batch(pa.array([text]))[0].as_py()


_CODECS: dict[str, tuple[TextEncoder, TokenDecoder]] = {}


def codec(path: str) -> tuple[TextEncoder, TokenDecoder]:
    """The encoder and the decoder of a file of ranks; one a process."""
    if path not in _CODECS:
        import gc

        import public_tokenizers

        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        _CODECS[path] = TextEncoder(public_tokenizers.PATTERN, Transducer(ranks)), TokenDecoder(tokens)
        gc.freeze()
        gc.set_threshold(500_000)  # the tables hold no cycles; looking for some in them takes long
    return _CODECS[path]


def _mapped(df: DataFrame, vocabulary: str, of: str, made: Callable[[tuple[TextEncoder, TokenDecoder], pa.Array], dict[str, pa.Array]], names: str) -> DataFrame:
    """doc_id, and what is made of one column, in steps of bounded bytes."""
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {names}"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, STEP_BYTES):
            columns = {"doc_id": batch.column(0), **made(codec(vocabulary), batch.column(1))}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.select("doc_id", of).mapInArrow(run, schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian 32-bit). A null text counts as empty: no ids. Null ids and repeated rows are kept, an
    empty table gives no rows, a very long text is a step of its own, other columns are not read, whatever their names."""
    return _mapped(_texts(docs, id_col, text_col), vocabulary, "text", lambda c, x: {"ids": c[0].batch(x)}, "ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, text: the tokens' bytes through the UTF-8 machine. Null ids: null text. Bytes that are no UTF-8 become U+FFFD."""
    return _mapped(encoded, vocabulary, "ids", lambda c, x: {"ids": x, "text": c[1].batch(x)}, "ids binary, text string")


def encode_and_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass, so that ids go to and from Python once."""

    def both(c: tuple[TextEncoder, TokenDecoder], x: pa.Array) -> dict[str, pa.Array]:
        ids = c[0].batch(x)
        return {"ids": ids, "text": c[1].batch(ids)}

    return _mapped(_texts(docs, id_col, text_col), vocabulary, "text", both, "ids binary, text string")


def op10_bpe_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_and_decode(table(spark, sf_dir, "documents"), public_file("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
