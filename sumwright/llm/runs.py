"""Periodic runs of words by Lyndon arrays.

A run is a stretch of words with a smallest period that no neighbouring word extends. Every run of
two periods holds a Lyndon word of the length of its period that is the longest one to start at its
place, under the order of words or under its reverse. So the Lyndon arrays of both orders, which the
first phase of Baier's suffix sorter gives, name all roots, and equal extensions to either side make
runs of them.

A word of a run is part of an n-gram that the run repeats. Batches are searched for repeated n-grams
first, and only unbroken stretches of them, which no run leaves, are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwright.llm.shared import col, mixed, packed, row_blocks, unpacked

#: Words of a run at least, and how often it holds its period at least.
MIN_WORDS = 24
TIMES = 3

RUNS = "array<struct<start:long,length:long,period:long>>"


def lyndon_lengths(ranks: Sequence[int]) -> list[int]:
    """For each place the length of the longest Lyndon word that starts there.

    Baier's grouping: places begin in groups by their letter. The highest group that is left is
    final; each nearest place to the left in a lower group takes its members on: one with ``k``
    of them grows by ``k`` times their length and moves right above its own group, the higher the
    more it has taken.
    """
    n = len(ranks)
    letters = max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(letters)]
    for place, rank in enumerate(ranks):
        members[rank].append(place)
    group = list(ranks)
    length = [1] * letters
    below = list(range(-1, letters - 1))
    above = list(range(1, letters + 1))
    top = letters - 1
    final = [0] * n
    # left[i + 1] leads to the nearest place at or before i that is not final, plus 1.
    left = list(range(n + 1))
    while top >= 0:
        own = [i for i in members[top] if group[i] == top]
        size = length[top]
        for i in own:
            final[i] = size
            left[i + 1] = i
        taken: dict[int, int] = {}
        for i in own:
            j = i
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            if j:
                taken[j - 1] = taken.get(j - 1, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for i, k in taken.items():
            parts.setdefault((k, group[i]), []).append(i)
        for k, old in sorted(parts, reverse=True):
            new = len(members)
            places = parts[k, old]
            members.append(places)
            length.append(length[old] + k * size)
            for i in places:
                group[i] = new
            up = above[old]  # there is one, since the group that takes part is below the top
            below.append(old)
            above.append(up)
            below[up] = above[old] = new
        top = below[top]
    return final


def extension(codes: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words agree from ``a`` and ``b > a`` on, going right (1) or left (-1)."""
    most = len(codes) - b if step > 0 else a + 1
    done, block = 0, 32
    while done < most:
        size = min(block, most - done)
        if step > 0:
            apart = codes[a + done : a + done + size] != codes[b + done : b + done + size]
        else:
            apart = (codes[a - done - size + 1 : a - done + 1] != codes[b - done - size + 1 : b - done + 1])[::-1]
        first = int(apart.argmax())
        if apart[first]:
            return done + first
        done += size
        block *= 2
    return most


def runs_of(codes: np.ndarray, min_words: int = MIN_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs in a sequence, by start and period.

    A run of three periods or more holds two roots side by side under one of the orders; its first
    pair is extended, the others are inside of what was found.
    """
    ranks = np.unique(codes, return_inverse=True)[1]
    found = set()
    for order in (ranks, ranks.max(initial=0) - ranks):
        roots = np.array(lyndon_lengths(order.tolist()), np.int64)
        place = np.flatnonzero(np.arange(len(roots)) + roots < len(roots))
        pairs = place[roots[place] == roots[place + roots[place]]]
        until: dict[int, int] = {}
        for i, period in zip(pairs.tolist(), roots[pairs].tolist(), strict=True):
            if i + period < until.get(period, 0):
                continue
            end = i + period + extension(codes, i, i + period, 1)
            start = i - (extension(codes, i - 1, i + period - 1, -1) if i else 0)
            if end - start >= 2 * period:
                until[period] = end
            if end - start >= max(min_words, times * period):
                found.add((start, end - start, period))
    return sorted((s, n, p) for s, n, p in found)


def repeated_stretches(codes: np.ndarray, text_of: np.ndarray, min_words: int, gram: int) -> Iterator[tuple[int, int]]:
    """``(begin, end)`` of the stretches of one text whose n-grams all occur again in that text."""
    ids, size = mixed(codes.astype(np.uint64), np.uint64(0)), 1
    while size < gram:
        ids = mixed(ids[:-size], ids[size:])
        size *= 2
    if not len(ids):
        return
    inside = np.flatnonzero(text_of[: len(ids)] == text_of[gram - 1 :])
    keys = mixed(ids[inside], text_of[inside].astype(np.uint64))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(order), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    places = inside[again]
    if not len(places):
        return
    cut = np.flatnonzero((np.diff(places) != 1) | (text_of[places[1:]] != text_of[places[:-1]])) + 1
    begins = places[np.concatenate([[0], cut])]
    ends = places[np.concatenate([cut - 1, [len(places) - 1]])] + gram
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        if end - begin >= min_words:
            yield begin, end


def find_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, times: int = TIMES) -> DataFrame:
    """All rows with ``n_words``, ``runs`` and ``collapsed``; columns of these names are replaced.

    Words are what stands between blanks, tabs and line ends. ``runs`` has each run of at least
    ``min_words`` words and ``times`` (3 or more) periods, by start and period; words count from 0.
    ``collapsed`` is the text's words joined by blanks, of every run only the first period. Null and
    blank texts have no words, no runs and collapse to the empty text. Repeated rows get the same.
    """
    if times < 3 or min_words < times:
        raise ValueError("runs need three periods and as many words at least")
    most = min(min_words - 2 * (min_words // times) + 1, min_words // times + 2)
    gram = 1 << (most.bit_length() - 1)

    @F.arrow_udf(f"struct<n_words:long,runs:{RUNS},collapsed:string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(texts.slice(at, n)) for at, n in row_blocks(texts)] or [part(texts)])

    def part(texts: pa.Array) -> pa.Array:
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        text_of = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
        words = split.flatten()
        full = pc.not_equal(words, "")
        words, text_of = words.filter(full), text_of[full.to_numpy(zero_copy_only=False)]
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(text_of, minlength=len(texts))
        starts = np.concatenate([[0], np.cumsum(counts)])
        keep = np.ones(len(codes), bool)
        runs: list[list[dict]] = [[] for _ in range(len(texts))]
        for begin, end in repeated_stretches(codes, text_of, min_words, gram):
            row = int(text_of[begin])
            for at, size, period in runs_of(codes[begin:end], min_words, times):
                first = begin + at
                keep[first + period : first + size] = False
                runs[row].append({"start": first - int(starts[row]), "length": size, "period": period})
        for own in runs:
            own.sort(key=lambda r: (r["start"], r["period"]))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text_of[keep], minlength=len(texts)))])
        kept = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.filter(pa.array(keep)))
        place = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        columns = [
            pa.array(counts, pa.int64()),
            pa.array(runs, pa.list_(place)),
            pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string()),
        ]
        return pa.StructArray.from_arrays(columns, ["n_words", "runs", "collapsed"])

    rows = packed(docs, found=found(col(text)))
    return unpacked(rows, docs, **{name: F.col("found").getField(name) for name in ("n_words", "runs", "collapsed")})


def strongest(runs: Column) -> Column:
    """The run with the greatest quotient of length and period; of equal ones the first.

    Quotients are compared as products of whole numbers, so that no two are mistaken for equal.
    """
    empty = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.reduce(
        runs,
        empty,
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )


def periodic(text: Column, doc_id: Column) -> Column:
    """The text of which one document in ten, by the checksum of its id, becomes periodic from some word on.

    With ``h`` the checksum and ``g`` a tenth of it, word ``i`` from ``a = g % n`` on is replaced by
    word ``a + (i - a) % p``, where ``p = 1 + floor((n - a) / (3 + g % 8))``. Others stay.
    """
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def made(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        whole = F.concat(F.slice(words, 1, a), F.slice(again, 1, n - a))
        return F.when(n > 0, F.array_join(whole, " ")).otherwise(text)

    # The words are an element of a row, so that they are found once and not in each of their uses.
    return F.when(F.pmod(h, F.lit(10)) == 0, F.transform(F.array(words), made)[0]).otherwise(text)
