"""Whole-text tokenizing inside Arrow tasks, with a word cache per worker.

A byte-pair tokenizer treats stretches between white space independently, so a
text is cut there, each distinct stretch is encoded once by the tokenizers
library, and the ids of the stretches are put together.  The cut never changes
the ids: stretches end only where the tokenizer itself must start a new word,
and texts that hold an added token can be given to the tokenizer whole.
Stretches are cut, told apart and put together with Arrow and numpy over all
texts of a slice; only those never seen before reach the tokenizer, many as one
text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space that only some engines take as such; texts holding it are encoded in one piece.
_UNUSUAL = re.compile("[" + "".join(map(chr, (0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: Entries and bytes of a worker's cache.  When it is full, the half used last stays, without long stretches.
CACHE_ENTRIES = 500_000
CACHE_BYTES = 32_000_000
CACHE_CHARS = 64
#: Rare signs; one that a vocabulary holds as one id can stand between words.
_SIGNS = "\u00a4\u00a7\u00b6\u2020\u2021|"
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 13, 32]] = True
#: Bytes that begin the UTF-8 form of unusual white space.
_MAYBE_UNUSUAL = np.zeros(256, bool)
_MAYBE_UNUSUAL[[0x0B, 0x0C, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class _Engine:
    """A tokenizer and the ids of the stretches it has seen: those of place k are flat[starts[k] : starts[k + 1]]."""

    def __init__(self, width: int, size: int):
        self.width, self.kind = width, f"<u{width}"
        if size > 1 << 8 * width:
            raise ValueError(f"ids of this vocabulary do not fit into {width} bytes")
        self.flat, self.starts = np.zeros(0, self.kind), np.zeros(1, "i8")

    def spelled(self, found, group):
        """Ids of stretches encoded as one text, and how many each has by the bytes they stand for; None if these don't part them."""
        want = np.cumsum(np.fromiter(map(len, group), "i8", len(group)))
        ends = np.cumsum(self.lengths[found])
        if not len(ends) or ends[-1] != want[-1]:
            return None
        cuts = np.searchsorted(ends, want)
        return (found, np.diff(cuts, prepend=-1)) if (ends[cuts] == want).all() else None

    def learn(self, words: list[bytes], at_once: int = 500):
        """Ids of stretches, one after the other, and how many each has; many go to the tokenizer as one text."""
        groups = [words[k : k + at_once] for k in range(0, len(words), at_once)]
        out = []
        for group, found in zip(groups, self.grouped(groups)):
            if found is None:
                one = self.singly([w.decode() for w in group])
                found = np.frombuffer(b"".join(one), self.kind), np.fromiter(map(len, one), "i8", len(one)) // self.width
            out.append(found)
        return [ids for ids, _ in out], [n for _, n in out]

    def store(self, joined: list[bytes], single: list[bytes]) -> None:
        """Add stretches at the next places."""
        ids, sizes = self.learn(joined)
        one = self.singly([w.decode() for w in single])
        sizes = np.concatenate([*sizes, np.fromiter(map(len, one), "i8", len(one)) // self.width])
        self.flat = np.concatenate([self.flat, *ids, np.frombuffer(b"".join(one), self.kind)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def keep(self, slots) -> None:
        sizes = self.starts[slots + 1] - self.starts[slots]
        self.flat = self.flat[ragged(self.starts[slots], sizes)]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    def gather(self, slots, rows):
        """Ids of the stretches at ``slots``, and offsets of the texts that begin at stretches ``rows``."""
        starts, sizes = self.starts[slots], self.starts[slots + 1] - self.starts[slots]
        return self.flat[ragged(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])[rows]


class BytePairs(_Engine):
    """A vocabulary of the tokenizers library.

    Where white space is kept, each letter of a token stands for a byte, and
    stretches bring their own white space in front; else a sign that is one id
    is put between them.
    """

    def __init__(self, path: str, spaces_kept: bool, width: int, encode_special_tokens: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.marks = [] if encode_special_tokens else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        super().__init__(width, self.tokenizer.get_vocab_size())
        self.kept = spaces_kept
        if spaces_kept:
            self.lengths = np.zeros(self.tokenizer.get_vocab_size(), "i8")
            for token, i in self.tokenizer.get_vocab().items():
                self.lengths[i] = len(token)
        else:
            signs = {x: self.tokenizer.encode(x, add_special_tokens=False).ids for x in _SIGNS}
            self.sign = next(x for x, ids in signs.items() if len(ids) == 1)
            self.sign_id = signs[self.sign][0]

    def singly(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that hold added tokens or unusual white space."""
        self.tokenizer.encode_special_tokens = not self.marks
        try:
            return self.singly(texts)
        finally:
            self.tokenizer.encode_special_tokens = True

    def grouped(self, groups):
        between = b"" if self.kept else f" {self.sign} ".encode()
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([between.join(g).decode() for g in groups], add_special_tokens=False)):
            held = np.array(found.ids, self.kind)
            if self.kept:
                yield self.spelled(held, group)
                continue
            parts = held == self.sign_id
            yield (held[~parts], np.diff(np.flatnonzero(parts), prepend=-1, append=len(held)) - 1) if parts.sum() == len(group) - 1 else None

    def spelling(self) -> list[bytes]:
        """Bytes of each id."""
        out = [b""] * self.tokenizer.get_vocab_size()
        letters = byte_letters()
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = bytes(letters.get(c, 0) for c in token)
        return out


class Pieces(_Engine):
    """A byte-pair vocabulary of the sentencepiece library, whose pieces begin at white space; texts begin with a space."""

    def __init__(self, path: str, width: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__(width, self.model.vocab_size())
        names = [self.model.id_to_piece(i).replace("\u2581", " ") for i in range(self.model.vocab_size())]
        # White space that pieces can hold after other characters; texts with it are encoded whole.
        self.marks = sorted({c for n in names for c in re.findall(r"\S(\s)", n)})
        if " " in self.marks:
            raise ValueError("a piece of this vocabulary runs over the start of a word")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.encode() for i, n in enumerate(names)]
        self.lengths = np.fromiter(map(len, self.bytes), "i8", len(names))

    def _after(self, texts: list[str]):
        # The library puts a space before each text; a letter keeps it apart from white space that follows.
        return self.model.encode(["a" + t for t in texts], num_threads=1)

    def singly(self, words: list[str]) -> list[bytes]:
        return [np.array(ids[1:], self.kind).tobytes() for ids in self._after(words)]

    whole = singly

    def grouped(self, groups):
        for group, ids in zip(groups, self._after([b"".join(g).decode() for g in groups])):
            yield self.spelled(np.array(ids[1:], self.kind), group)

    def spelling(self) -> list[bytes]:
        return self.bytes


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others come from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts to little-endian unsigned ids.

    ``spaces_kept``: the tokenizer keeps white space, joined to the next word;
    else it drops white space and marks the end of each word.  ``width``: bytes
    per id, 2 or 4.  ``encode_special_tokens``: added tokens that stand in a
    text are encoded as other text is.  Without it, which is the library's
    default, they become their ids; texts that hold one go to the tokenizer
    whole, as such tokens end words where the cut and the cache do not.
    ``also``: further engines that share the cut and the cache.
    """

    def __init__(self, path: str, spaces_kept: bool, width: int, encode_special_tokens: bool = True, also: tuple = ()):
        self.engines = [BytePairs(path, spaces_kept, width, encode_special_tokens), *also]
        self.marks, self.kept, self.width = [m for e in self.engines for m in e.marks], spaces_kept, width
        # Of each known stretch its place in the engines, and of each place when it was last used.
        self.known: dict[bytes, int] = {}
        self.used = np.zeros(0, "i8")
        self.turn = self.size = 0

    def _cuts(self, data, offsets):
        """Places of white space and where stretches start, for the bytes of several texts."""
        white = _WHITE[data]
        starts = white.copy() if self.kept else ~white
        starts[1:] &= white[:-1] ^ self.kept
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        return white, starts

    def _stretches(self, data, offsets):
        """Stretches of several texts as an Arrow array of bytes, and the first one of each text."""
        import pyarrow as pa

        white, starts = self._cuts(data, offsets)
        if self.kept:
            begins = np.flatnonzero(starts)
            edges = np.append(begins, len(data)).astype("i4")
            found = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(data)])
            return found, np.searchsorted(begins, offsets)
        # White space is dropped: every second piece between the edges is a word.
        begins = np.flatnonzero(starts & ~white)
        ends = ~white
        ends[:-1] &= white[1:]
        ends[offsets[1:][np.diff(offsets) > 0] - 1] |= ~white[offsets[1:][np.diff(offsets) > 0] - 1]
        edges = np.append(np.stack([begins, np.flatnonzero(ends) + 1], 1).ravel(), len(data)).astype("i4")
        found = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        return found.take(pa.array(np.arange(0, 2 * len(begins), 2))), np.searchsorted(begins, offsets)

    def _slots(self, words: list[bytes]):
        """Places of the words' ids in the cache; words never seen are encoded first."""
        self.turn += 1
        slots = np.fromiter(map(self.known.get, words, repeat(-1)), "i8", len(words))
        new = np.flatnonzero(slots < 0)
        if len(new) and (len(self.known) + len(new) > CACHE_ENTRIES or self.size > CACHE_BYTES):
            self._shrink()
            slots = np.fromiter(map(self.known.get, words, repeat(-1)), "i8", len(words))
            new = np.flatnonzero(slots < 0)
        if len(new):
            learnt = [words[k] for k in new.tolist()]
            # Only stretches with white space in front and none behind can be put together.
            alone = np.array([w[0] > 32 or w[-1] <= 32 for w in learnt]) if self.kept else np.zeros(len(learnt), bool)
            new = np.concatenate([new[~alone], new[alone]])
            joined, single = [learnt[k] for k in np.flatnonzero(~alone).tolist()], [learnt[k] for k in np.flatnonzero(alone).tolist()]
            for engine in self.engines:
                engine.store(joined, single)
            slots[new] = np.arange(len(self.used), len(self.used) + len(new))
            self.known.update(zip([*joined, *single], slots[new].tolist()))
            self.used = np.concatenate([self.used, np.zeros(len(new), "i8")])
            self.size += sum(map(len, learnt))
        self.used[slots] = self.turn
        return slots

    def _shrink(self) -> None:
        """Keep the words used last, half as many as the cache may hold at most, and no long ones."""
        words = list(self.known)
        old = np.fromiter(self.known.values(), "i8", len(words))
        recent = np.argsort(-self.used[old], kind="stable")[: CACHE_ENTRIES // 2].tolist()
        kept = [k for k in recent if len(words[k]) <= CACHE_CHARS]
        slots, names = old[kept], [words[k] for k in kept]
        for engine in self.engines:
            engine.keep(slots)
        self.used = self.used[slots]
        self.known = dict(zip(names, range(len(names))))
        self.size = sum(map(len, names))

    def encode_column(self, column):
        """Ids of all rows of an Arrow text column, and the offsets of the rows in them; a null counts as empty."""
        return self.encode_columns(column)[0]

    def encode_columns(self, column) -> list:
        """Ids and offsets by each engine.

        The distinct stretches of a column are looked up or encoded once, and
        the ids are put together by one gather.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column.cast(pa.string()), "")
        whole = self._whole_rows(column)
        offsets, data = text_bytes(pc.if_else(pa.array(whole), "", column) if whole.any() else column)
        slots, rows = np.zeros(0, "i8"), np.zeros(len(offsets), "i8")
        if len(data):
            words, rows = self._stretches(data, offsets)
            coded = words.dictionary_encode()
            slots = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        out = [engine.gather(slots, rows) for engine in self.engines]
        at = np.flatnonzero(whole)
        if not len(at):
            return out
        texts = column.take(pa.array(at)).to_pylist()
        for n, (engine, (ids, ends)) in enumerate(zip(self.engines, out)):
            pieces, last, sizes = [], 0, np.diff(ends)
            for k, found in zip(at.tolist(), engine.whole(texts)):
                more = np.frombuffer(found, engine.kind)
                pieces += [ids[last : ends[k]], more]
                last, sizes[k] = ends[k], len(more)
            out[n] = np.concatenate([*pieces, ids[last:]]), np.concatenate([[0], np.cumsum(sizes)])
        return out

    def _whole_rows(self, column):
        """Rows that must go to the tokenizer in one piece: with added tokens, or white space that only some engines take as such."""
        import pyarrow.compute as pc

        whole = np.zeros(len(column), bool)
        for mark in self.marks:
            whole |= pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
        if self.kept:
            offsets, data = text_bytes(column)
            # Their bytes begin with one of these; only rows that hold one are searched.
            if _MAYBE_UNUSUAL[data].any():
                for k in np.unique(np.searchsorted(offsets, np.flatnonzero(_MAYBE_UNUSUAL[data]), "right") - 1).tolist():
                    whole[k] |= bool(_UNUSUAL.search(column[k].as_py()))
        return whole

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text; a null text counts as empty."""
        import pyarrow as pa

        ids, ends = self.encode_column(pa.array(list(texts), pa.string()))
        held, cuts = ids.tobytes(), (ends * self.width).tolist()
        return [held[a:b] for a, b in zip(cuts, cuts[1:])]


def text_bytes(column):
    """Offsets of the rows of an Arrow text column without nulls, and their bytes."""
    offsets = np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + len(column) + 1].astype("i8")
    return offsets - offsets[0], np.frombuffer(column.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]


def with_end(ids, ends, end_id: int):
    """Ids and offsets with one more id after each row."""
    n = np.arange(len(ends))
    out = np.full(len(ids) + len(ends) - 1, end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(n[:-1], np.diff(ends))] = ids
    return out, ends + n


def ragged(starts, sizes):
    """Places ``start, start + 1, ...`` of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, spaces_kept: bool, width: int, encode_special_tokens: bool = True) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    key = (path, spaces_kept, width, encode_special_tokens)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


def forget() -> None:
    """Free the worker's encoders; a worker that turns to other work has no use for their caches."""
    _ENCODERS.clear()


def slices(batch, bytes_at_once: int = 4_000_000):
    """Cut an Arrow batch by the size of the texts in its last column."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    texts = batch.column(batch.num_columns - 1)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8"))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + bytes_at_once, "right")))
        yield batch.slice(start, end - start)
        start = end


def with_scores(df: DataFrame, text: str, scores: dict[str, str], score) -> DataFrame:
    """Add columns computed from a text column, in place of columns of their names; all others pass through.

    ``scores``: names and types of the new columns; ``score`` gives their arrays
    for an Arrow text column.
    """
    kept = [c for c in df.columns if c not in scores]
    names = [*(f"c{k}" for k in range(len(kept))), *(f"s{k}" for k in range(len(scores)))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)), F.col(f"`{text}`").cast("string").alias("text"))

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            for some in slices(batch, 1_000_000):
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *map(pa.array, score(some.column(some.num_columns - 1)))], names)

    kinds = [*(k for _, k in rows.dtypes[:-1]), *scores.values()]
    out = rows.mapInArrow(task, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, [*kept, *scores])))
