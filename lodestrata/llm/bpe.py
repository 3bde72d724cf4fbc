"""BPE encoding and decoding by tree concatenation.

A text of more than `half` bytes is cut into halves of halves, wherever the cuts fall: mostly inside a word.  All leaves of a
group of texts are encoded side by side, each as a text of its own, and then neighbours are concatenated pairwise up a tree.
At each join the last k runs without white space on the left and the first k on the right are encoded anew as one window,
with k doubling until the window begins with the ids of the left side's own run and ends with those of the right side's.
White space ends a token whatever stands beside it, so such a window is exact, and with it the joined ids.

A single run that is longer than `leaf` is "long unsplit text": no cut is made inside it at first.  Its letter, digit and
symbol pieces are found, and a piece that is still longer is cut into leaves of its own, which are joined by windows of
tokens in the same way (`encode_batch` uses every thread it is given).  A token sequence is the one that the merges give
exactly if every adjacent pair in it occurs in some such sequence.

The ids of short runs are kept in a bounded table, without those that only cuts have made.

Cases: null text gives no ids and decodes to ""; empty text likewise.  Special tokens spelled out in a text give their ids,
as the library does.  Ids outside the vocabulary are skipped on decoding.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import give_back, kept

#: Characters in a leaf, and entries and bytes a worker keeps for short runs.
LEAF, CACHE_ENTRIES, CACHE_KEY_BYTES = 256, 400_000, 40
#: Bytes of a text above which it is cut into halves; 0: never.
HALF = 512
#: Texts that are encoded together; without halves, bytes of them (a longer text is a group), and runs gathered at a time.
GROUP, GROUP_BYTES, STEP = 128, 4_000_000, 200_000
#: Runs that are learned, and that the library encodes, in one call: what it makes of them is many times their size.
CALL = 10_000
_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: ASCII and Latin-1 letters: one piece; before ASCII symbols: two pieces.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_BEFORE_SYMBOLS = re.compile(rb"(" + _LETTERS.pattern + rb")([!-/:-@\[-`]+)")


def _threads(several: bool) -> None:
    """Whether the library's batch calls use several threads from now on."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if several else "false"


class _Runs(dict):
    """Run of UTF-8 bytes -> ids as little-endian unsigned 32-bit, kept for the first `entries` short runs."""

    def __init__(self, encoder: TreeEncoder, entries: int):
        super().__init__()
        self.encoder, self.entries = encoder, entries

    def learn(self, runs: list[bytes], passing=()) -> dict[bytes, bytes]:
        """Ids of runs that are not known; all short pieces are encoded in one call.  Those in `passing` are not kept."""
        _threads(False)  # a task has one core; only leaves of long text are worth more
        leaf = self.encoder.leaf
        cut, pieces, others = {}, set(), []
        for run in runs:
            if len(run) > leaf:
                others.append(run)
            elif _LETTERS.fullmatch(run):
                pieces.add(run)
            elif m := _BEFORE_SYMBOLS.fullmatch(run):
                cut[run] = m.groups()
                pieces.update(x for x in m.groups() if x not in self)
            else:
                others.append(run)
        new, pieces, short = {}, list(pieces), [x for x in others if len(x) <= leaf]
        for a in range(0, len(pieces), CALL):
            new |= self.encoder.encode_pieces(pieces[a : a + CALL])
        for a in range(0, len(short), CALL):
            some = short[a : a + CALL]
            batch = self.encoder.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in some], add_special_tokens=False)
            new |= {x: self.encoder.packed(e.ids) for x, e in zip(some, batch)}
        new |= {x: self.encoder.encode_run(x.decode("utf-8", "replace")) for x in others if len(x) > leaf}
        for run, (letters, symbols) in cut.items():
            new[run] = (new.get(letters) or self[letters]) + (new.get(symbols) or self[symbols])
        if (room := self.entries - len(self)) > 0:
            self.update([kv for kv in new.items() if len(kv[0]) <= CACHE_KEY_BYTES and kv[0] not in passing][:room])
        return new


class TreeEncoder:
    def __init__(self, path: str, leaf: int = LEAF, cache_entries: int = CACHE_ENTRIES, half: int = HALF):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.is_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(n)]
        self.plain = [x.removesuffix(self.suffix) if self.suffix else x for x in self.names]
        self.is_end = np.array([bool(self.suffix) and x.endswith(self.suffix) for x in self.names])
        self.leaf, self.half = max(2, leaf), half
        #: Joins of halves so far, and those of them that had to look further than the first window.
        self.joins, self.wider = 0, 0
        self.runs = _Runs(self, cache_entries)

    @functools.cached_property
    def inner(self):
        """The same merges for text that goes on: no end-of-word mark, nothing split or normalised.  Only long runs need it."""
        from tokenizers import Tokenizer

        spec = json.loads(self.tokenizer.to_str())
        spec["model"]["end_of_word_suffix"] = None
        spec |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        return Tokenizer.from_str(json.dumps(spec))

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        return out.tobytes()

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    @staticmethod
    def prepared(text: str | bytes | None) -> bytes:
        raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")
        # ASCII capitals may be lowered before composing, unless a combining mark or a special token could be changed
        return raw if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw else raw.lower()

    def leaves(self, raw: bytes) -> list[tuple[list[bytes], bool, bool]]:
        """Runs of each leaf of a text, and whether the leaf begins and ends with white space."""
        if not self.half or len(raw) <= self.half:
            return [(raw.split(), True, True)]
        n, cuts = 1 << (-(-len(raw) // self.half) - 1).bit_length(), [0]
        for i in range(1, n):
            c = max(cuts[-1], len(raw) * i // n)
            if not (_BLANK.search(raw, c, c + self.leaf) and _BLANK.search(raw, max(0, c - self.leaf), c)):
                found = _BLANK.search(raw, c)  # inside long unsplit text, or near its end: cut behind it
                c = found.start() if found else len(raw)
            while c < len(raw) and raw[c] & 0xC0 == 0x80:
                c += 1
            cuts.append(c)
        cuts.append(len(raw))
        parts = [raw[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]
        return [(x.split(), x[:1].isspace(), x[-1:].isspace()) for x in parts]

    def encode_many(self, texts) -> Iterator[bytes]:
        """Ids of whole texts (a list or an Arrow array) as little-endian unsigned 32-bit numbers, one text after another.

        Texts are taken in groups of GROUP; only one group is held at a time.
        """
        if not self.half:
            yield from self.encode_flat(texts)
            return
        known = self.runs
        for at in range(0, len(texts), GROUP):
            some = texts[at : at + GROUP]
            trees = [self.leaves(self.prepared(t)) for t in (some.to_pylist() if isinstance(some, pa.Array) else some)]
            distinct, passing, whole = set(), set(), set()
            for tree in trees:
                distinct.update(*(leaf[0] for leaf in tree))
                for (left, _, blank), (right, follows, _) in zip(tree, tree[1:]):
                    if not (blank or follows):
                        passing |= {left[-1], right[0]}
                        whole.add(left[-1] + right[0])
            distinct |= whole
            own = dict(zip(distinct, map(known.get, distinct)))
            if new := [x for x, ids in own.items() if ids is None]:
                own |= known.learn(new, passing - whole)
            for tree in trees:
                level = [(runs, list(map(own.__getitem__, runs)), begins, ends) for runs, begins, ends in tree]
                while len(level) > 1:
                    level = [self.joined(*level[i : i + 2], own) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
                yield b"".join(level[0][1])

    def encode_flat(self, texts) -> Iterator[bytes]:
        """The same without halves: each distinct run of a group of about GROUP_BYTES is looked up once."""
        some, size = [], 0
        for t in texts:
            if isinstance(t, pa.Scalar):
                t = b"" if t.as_buffer() is None else t.as_buffer().to_pybytes()
            raw = self.prepared(t)
            if some and size + len(raw) > GROUP_BYTES:
                yield from self._flat_group(some)
                some, size = [], 0
            some.append(raw)
            size += len(raw)
        if some:
            yield from self._flat_group(some)

    def _flat_group(self, raws: list[bytes]) -> Iterator[bytes]:
        ends = np.cumsum([0, *map(len, raws)]).astype(np.int32)
        split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(raws), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(raws))]))
        runs = split.values.dictionary_encode()
        # blanks at the ends of a text leave empty runs
        distinct = runs.dictionary.cast(pa.binary()).to_pylist()
        own = [self.runs.get(x) if x else b"" for x in distinct]
        if new := [x for x, ids in zip(distinct, own) if ids is None]:
            learnt = {}
            for a in range(0, len(new), CALL):
                learnt |= self.runs.learn(new[a : a + CALL])
            own = [learnt[x] if ids is None else ids for x, ids in zip(distinct, own)]
            del learnt, new
        del distinct
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts, flat, at = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(own), "<u4"), runs.indices.to_numpy()
        parts = []
        for a in range(0, len(at), STEP):
            n = lengths[at[a : a + STEP]]
            before = np.cumsum(n) - n
            parts.append(flat[np.repeat(starts[at[a : a + STEP]] - before, n) + np.arange(n.sum())].tobytes())
        ids = b"".join(parts)
        cuts = (4 * np.concatenate([[0], np.cumsum(lengths[at])])[split.offsets.to_numpy()]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield ids[a:b]

    def joined(self, left: tuple, right: tuple, own: dict[bytes, bytes]) -> tuple:
        """Two neighbours (runs, ids of each, begins and ends with white space) as one, by a window that both agree with."""
        (a_runs, a_ids, begins, blank), (b_runs, b_ids, follows, ends) = left, right
        between, k = b" " if blank or follows else b"", 1
        self.joins += 1
        while True:
            a, b = min(k, len(a_runs)), min(k, len(b_runs))
            runs = (b" ".join(a_runs[len(a_runs) - a :]) + between + b" ".join(b_runs[:b])).split()
            ids = [own.get(x) or self.run_ids(x) for x in runs]
            if (a == len(a_runs) or ids[0] == a_ids[-a]) and (b == len(b_runs) or ids[-1] == b_ids[b - 1]):
                return a_runs[: len(a_runs) - a] + runs + b_runs[b:], a_ids[: len(a_ids) - a] + ids + b_ids[b:], begins, ends
            self.wider += k == 1
            k *= 2

    def run_ids(self, run: bytes) -> bytes:
        """Ids of one run without white space."""
        found = self.runs.get(run)
        return self.runs.learn([run])[run] if found is None else found

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of short pieces that the library does not split, each of which ends with an end-of-word token."""
        if not pieces:
            return {}
        ids = np.array(self._library(b" ".join(pieces).decode("utf-8", "replace")), np.uint32)
        ends = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
        if len(ends) != len(pieces):  # a vocabulary that does not mark the ends of words
            return {x: self.packed(self._library(x.decode("utf-8", "replace"))) for x in pieces}
        raw = ids.astype("<u4").tobytes()
        return {x: raw[a:b] for x, a, b in zip(pieces, [0, *ends], ends)}

    def encode(self, text: str | bytes | None) -> bytes:
        return next(self.encode_many([text]))

    def ids(self, text: str | None) -> list[int]:
        return array("I", self.encode(text)).tolist()

    def decode(self, ids) -> str:
        names, n = self.names, len(self.names)
        try:
            return " ".join([names[i] for i in ids])
        except IndexError:
            return " ".join([names[i] for i in ids if i < n])

    def encode_run(self, run: str) -> bytes:
        if len(run) <= self.leaf:
            return self.packed(self._library(run))
        ids: list[int] = []
        for part in self.is_special.split(run) if self.is_special else [run]:
            if part in self.special:
                ids.append(self.tokenizer.token_to_id(part))
            elif part:
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    ids += self.encode_piece(piece)
        return self.packed(ids)

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, which may be of any length, by concatenating up a tree of leaves."""
        if len(piece) <= self.leaf:
            return [t.id for t in self.tokenizer.model.tokenize(piece)]
        # halves of halves: a power of two of leaves, so that every level joins neighbours of like size
        n = 1 << (-(-len(piece) // self.leaf) - 1).bit_length()
        cuts = [len(piece) * i // n for i in range(n + 1)]
        leaves = [piece[a:b] for a, b in zip(cuts, cuts[1:])]
        _threads(True)
        level = [e.ids for e in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)]
        level.append([t.id for t in self.tokenizer.model.tokenize(leaves[-1])])
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1], i + 2 == len(level)) for i in range(0, len(level), 2)]
        return level[0]

    def join(self, left: list[int], right: list[int], at_end: bool) -> list[int]:
        """Ids of two neighbours; at_end: the right one ends the piece."""
        k = 2
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            text = "".join(self.plain[i] for i in left[-a:]) + "".join(self.plain[i] for i in right[:b])
            model = self.tokenizer.model if at_end and b == len(right) else self.inner.model
            window = [t.id for t in model.tokenize(text)]
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:-a] + window + right[b:]
            k *= 2


def encoder(path: str, leaf: int = LEAF, cache_entries: int = CACHE_ENTRIES, half: int = HALF) -> TreeEncoder:
    """One encoder for each Python worker."""
    own, key = kept("bpe"), (path, leaf, cache_entries, half)
    if key not in own:
        own[key] = TreeEncoder(*key)
        give_back()
    return own[key]


def encode_column(text: Column, path: str, leaf: int = LEAF) -> Column:
    """array<int> of ids of every whole text."""
    def run(texts: pa.Array) -> pa.Array:
        e = encoder(path, leaf)
        return pa.array([array("I", x).tolist() for x in e.encode_many(texts)], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def decode_column(ids: Column, path: str) -> Column:
    """Text of an array of ids, special tokens included; null ids decode to an empty text."""
    def run(rows: pa.Array) -> pa.Array:
        e = encoder(path)
        return pa.array([e.decode(x or ()) for x in rows.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(ids)


def digests_column(text: Column, path: str, leaf: int = LEAF) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> of encoding a text and decoding its ids, in one pass."""
    import hashlib

    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(texts: pa.Array) -> pa.Array:
        e, out = encoder(path, leaf), []
        for packed in e.encode_many(texts):
            ids = array("I", packed)
            out.append((
                len(ids),
                hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(e.decode(ids).encode()).hexdigest(),
            ))
        n, a, b = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], fields=list(kind))

    return F.arrow_udf(run, "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")(text)
