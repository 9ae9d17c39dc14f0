"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.encoding import BytePairs, Pieces, WordEncoder, ragged, slices, text_bytes
from framesleuth.llm.registry import query, table

SLICE_BYTES = 1_000_000
#: Columns that ``align`` can add to the counts, and their types.
PARTS = {"a_ids": "array<int>", "b_ids": "array<int>", "a_cuts": "array<int>", "b_cuts": "array<int>", "groups_sha256": "string", "links": "binary"}


def diagonal_runs(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Runs ``(i, j, n)``: tokens i + k and j + k end together for k < n.

    ``a`` and ``b`` are rising end offsets with the same last value.  At the
    current shift j - i a run is probed in steps that double while both stretches
    are equal, then halve.  Where it stops, the side that is behind moves on until
    both end together again, which gives the next shift.
    """
    last_a, last_b = len(a), len(b)
    a, b = [*a, -1], [*b, -2]  # ends that never agree
    i = j = 0
    out = []
    while i < last_a and j < last_b:
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        n = step = 1
        while a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        while step > 1:
            step //= 2
            if a[i + n : i + n + step] == b[j + n : j + n + step]:
                n += step
        out.append((i, j, n))
        i += n
        j += n
    return out


def possible_links(a: list[bytes], b: list[bytes]):
    """All pairs of ids that can end together, as sorted numbers ``id_a * len(b) + id_b``.

    Of two such tokens one's bytes end the other's, so there are at most as many
    pairs as the vocabularies' tokens have endings, however large a corpus is.
    """
    import numpy as np

    by_a, by_b = {}, {}
    for ids, names in ((by_a, a), (by_b, b)):
        for i, name in enumerate(names):
            if name:
                ids.setdefault(name, []).append(i)
    found = [x * len(b) + y for name, ids in by_a.items() for k in range(len(name)) for y in by_b.get(name[k:], ()) for x in ids]
    found += [x * len(b) + y for name, ids in by_b.items() for k in range(1, len(name)) for x in by_a.get(name[k:], ()) for y in ids]
    return np.array(sorted(found), "i8")


class Aligner:
    """Both tokenizers, the bytes of their tokens and the pairs that can be linked."""

    def __init__(self, path_a: str, path_b: str):
        import numpy as np

        second = Pieces(path_b, 4)
        self.encoder = WordEncoder(path_a, True, 4, also=(second,))
        self.spelling = [engine.spelling() for engine in self.encoder.engines]
        self.flat = [np.frombuffer(b"".join(x), "u1") for x in self.spelling]
        self.sizes = [np.fromiter(map(len, x), "i8", len(x)) for x in self.spelling]
        self.starts = [np.cumsum(n) - n for n in self.sizes]
        self.second_ids = len(self.spelling[1])
        self.possible = possible_links(*self.spelling)
        # How each token is written after the sign before it: first of a group, or later; of the second tokenizer likewise.
        self.names = [[x % k for k in range(len(n))] for n, signs in zip(self.spelling, ((b";%d", b",%d"), (b"|%d", b",%d"))) for x in signs]

    def tokens(self, column):
        """Of an Arrow text column without nulls, each text after a space: ids and offsets by both, and the rows that both spell right.

        Rows that one does not spell right, and empty ones, have no ids.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        spaced = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise("", column, " "))
        found = self.encoder.encode_columns(spaced)
        offsets, data = text_bytes(spaced.cast(pa.string()))
        right = np.diff(offsets) > 0
        for n, (ids, ends) in enumerate(found):
            sizes = self.sizes[n][ids]
            held = np.concatenate([[0], np.cumsum(sizes)])[ends]
            right &= np.diff(held) == np.diff(offsets)
            if (held == offsets).all():
                spelt = self.flat[n][ragged(self.starts[n][ids], sizes)]
                wrong = np.flatnonzero(spelt != data)
                right[np.searchsorted(offsets, wrong, "right") - 1] = False
            else:
                for k in np.flatnonzero(right).tolist():
                    mine = ids[ends[k] : ends[k + 1]].tolist()
                    right[k] = b"".join([self.spelling[n][x] for x in mine]) == data[offsets[k] : offsets[k + 1]].tobytes()
        if right.all():
            return found
        out = []
        for ids, ends in found:
            sizes = np.where(right, np.diff(ends), 0)
            out.append((ids[ragged(ends[:-1], sizes)], np.concatenate([[0], np.cumsum(sizes)])))
        return out

    def align(self, column, parts=()) -> dict:
        """Counts of tokens, groups and links of each row of an Arrow text column, and what ``parts`` names."""
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column.cast(pa.string()), "")
        (a, a_ends), (b, b_ends) = self.tokens(column)
        # Texts lie behind one another, so the last tokens of each end together too.
        runs = diagonal_runs(*(np.cumsum(self.sizes[n][ids]).tolist() for n, ids in enumerate((a, b))))
        i, j, n = np.array(runs, "i8").reshape(-1, 3).T
        a_last, b_last = ragged(i, n), ragged(j, n)
        cuts = np.searchsorted(a_last, a_ends)
        out = {"n_a": np.diff(a_ends), "n_b": np.diff(b_ends), "n_groups": np.diff(cuts)}
        lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(values.astype("i4")))
        if "a_ids" in parts:
            out["a_ids"] = lists(a, a_ends)
        if "b_ids" in parts:
            out["b_ids"] = lists(b, b_ends)
        if "a_cuts" in parts:
            out["a_cuts"] = lists(a_last + 1 - np.repeat(a_ends[:-1], np.diff(cuts)), cuts)
        if "b_cuts" in parts:
            out["b_cuts"] = lists(b_last + 1 - np.repeat(b_ends[:-1], np.diff(cuts)), cuts)
        if "links" in parts:
            held = np.searchsorted(self.possible, a[a_last].astype("i8") * self.second_ids + b[b_last]).astype("<i4")
            out["links"] = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer((4 * cuts).astype("i4")), pa.py_buffer(held.tobytes())])
        if "groups_sha256" in parts:
            # Tokens of a group stand together, those of the first tokenizer before those of the second.
            a_sizes, b_sizes = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
            places = [np.arange(len(a)) + np.repeat(b_last + 1 - b_sizes, a_sizes), np.arange(len(b)) + np.repeat(a_last + 1, b_sizes)]
            text = np.empty(len(a) + len(b), object)
            for k, (ids, place, last) in enumerate(((a, places[0], a_last), (b, places[1], b_last))):
                first, later = self.names[2 * k], self.names[2 * k + 1]
                text[place] = list(map(later.__getitem__, ids.tolist()))
                begins = np.concatenate([[0], last[:-1] + 1])[: len(last)]
                text[place[begins]] = list(map(first.__getitem__, ids[begins].tolist()))
            text, ends = text.tolist(), (a_ends + b_ends).tolist()
            out["groups_sha256"] = [hashlib.sha256(b"".join(text[x:y])[1:]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]
        return out


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(*paths: str) -> Aligner:
    """The worker's aligner for two vocabulary files."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def align(docs: DataFrame, path_a: str, path_b: str, parts: tuple[str, ...] = ("a_ids", "b_ids", "a_cuts", "b_cuts")) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups`` of every row and the ``parts`` asked for.

    The first file is a byte-level vocabulary of the tokenizers library, the
    second a model of sentencepiece; each text is encoded after a space.  Offsets
    where tokens of both end cut the tokens into groups: ``a_cuts`` and ``b_cuts``
    hold how many tokens end with each group.  ``links`` holds, for each group, the
    place among ``possible_links`` of its last tokens, which end together, as
    32-bit integers.  Null or empty texts, and those that a tokenizer does not
    spell back, have no tokens.  Each row counts by itself, repeated ones too;
    an empty table gives no rows and other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_a", "n_b", "n_groups", *parts]

    def task(batches):
        import pyarrow as pa

        both = aligner(path_a, path_b)
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                found = both.align(some.column(1), parts)
                yield pa.RecordBatch.from_arrays([some.column(0), *(x if isinstance(x, pa.Array) else pa.array(x) for x in (found[n] for n in names[1:]))], names)

    kinds = {"doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long"} | PARTS
    return rows.mapInArrow(task, ", ".join(f"{n} {kinds[n]}" for n in names))


def count_links(aligned: DataFrame, possible: int):
    """How many links of all rows hold each possible pair, in the order of ``possible_links``."""
    import numpy as np

    def task(batches):
        import pyarrow as pa

        counts = np.zeros(possible, "i8")
        for batch in batches:
            held = b"".join(x.as_buffer() for x in batch.column(0))
            counts += np.bincount(np.frombuffer(held, "<i4"), minlength=possible)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["pair", "n"])

    # At most one row for each possible pair, a number fixed by the vocabularies.
    found = aligned.select("links").mapInArrow(task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(possible, "i8")
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return counts


def link_strength(docs: DataFrame, path_a: str, path_b: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """As ``align``, with ``n_links``, ``n_best`` and ``count_sum``.

    A link joins two tokens that end together.  Its count is that of links with
    the same two ids in all of ``docs``.  ``n_best``: links whose count is the
    highest of their second id, ties included; ``count_sum``: the sum of counts.
    Texts are encoded once; the table of links is read by the result, so it stays
    in the shared folder.
    """
    import numpy as np

    possible = possible_links(BytePairs(path_a, True, 4).spelling(), second := Pieces(path_b, 4).spelling())
    aligned, _ = scratch.write(align(docs, path_a, path_b, (*parts, "links")), "aligned")
    counts = count_links(aligned, len(possible))
    highest = np.zeros(len(second), "i8")
    np.maximum.at(highest, possible % len(second), counts)
    best = counts == highest[possible % len(second)]
    others = [c for c in aligned.columns if c != "links"]

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            n_links, n_best, total = [], [], []
            for x in batch.column(len(others)):
                held = np.frombuffer(x.as_buffer(), "<i4")
                n_links.append(len(held))
                n_best.append(int(best[held].sum()))
                total.append(int(counts[held].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *(pa.array(x, pa.int64()) for x in (n_links, n_best, total))], [*others, "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"{n} {k}" for n, k in aligned.select(*others).dtypes)
    return aligned.select(*others, "links").mapInArrow(task, f"{kinds}, n_links long, n_best long, count_sum long")


@query("op11_cross_tokenizer")
def op11_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of the byte-level and the piece vocabulary over every document."""
    import public_tokenizers

    docs = table(spark, folder, "documents")
    found = link_strength(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), ("groups_sha256",))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
