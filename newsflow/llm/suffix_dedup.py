"""Removal of byte strings that start in an earlier document too, by distributed suffix sorting.

Only suffixes that can matter are sorted. Each window of ``LENGTH`` bytes is assigned to the k-gram
in it with the least hash, its anchor; equal windows have equal anchors at equal places. Anchors
whose k-gram occurs in a single document are left out, and each of the others stands for a suffix:
the bytes from the anchor on, then those before it, read backwards.

A run of documents sorts its suffixes, keeps one of equal ones with the smallest document, and sends
them front-coded, by k-gram, to the parts of the merge. A part merges its runs with a loser tree that
knows each head's common prefix with the last output and compares only beyond it. From the prefix
lengths come the groups of equal windows and, for each, the smallest document, which goes back to
the run.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from newsflow.llm.common import bounded_batches, release, table, trim

LENGTH, GRAM = 50, 20
#: A window's anchor starts at most this many bytes after the window.
REACH = LENGTH - GRAM
#: Bytes of a suffix: ahead, back, and the lengths of both.
WIDTH = LENGTH + REACH + 2
#: Bytes of text per run and, about, of suffixes per part.
RUN_BYTES = 6 << 20
#: Window starts worked on at a time.
CHUNK = 1 << 18
#: Suffixes compared with their neighbours at a time.
COMPARED = 1 << 14
NO_DOC = np.iinfo(np.int64).max

MESSAGE = T.StructType([T.StructField("run", T.LongType()), T.StructField("part", T.LongType()),
                        *[T.StructField(c, T.BinaryType()) for c in "abcd"]])


# -- anchors ---------------------------------------------------------------------------------

def _words8(x):
    """The eight bytes from each position on, as one number; zeros follow the last byte."""
    out = np.r_[x, np.zeros(LENGTH + 8, np.uint8)].astype(np.uint64)
    for step in (1, 2, 4):
        out = out[:-step] | out[step:] << np.uint64(8 * step)
    return out


def _slide(values, width, pick):
    """``pick`` (minimum or maximum) over each ``width`` values in a row."""
    done = 1
    while 2 * done <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return pick(values[:-rest], values[rest:]) if rest else values


def _hash(x):
    """64-bit hash of the k-gram at each position."""
    eight = _words8(x)
    n, m = len(x), [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F,
                                          0x165667B19E3779F9)]
    h = (eight[:n] * m[0]) ^ (eight[8:n + 8] * m[1] >> np.uint64(7))
    h = (h ^ (h >> np.uint64(32))) + (eight[16:n + 16] & np.uint64(0xFFFFFFFF)) * m[2]
    h *= m[0]
    return h ^ (h >> np.uint64(29))


def anchors(flat, ends):
    """Positions and hashes of the anchors of all windows; ``ends`` are the ends of the texts."""
    found, hashes = [], []
    last = len(flat) - LENGTH
    for begin in range(0, last + 1, CHUNK):
        n = min(CHUNK, last + 1 - begin)
        x = flat[begin:begin + n + LENGTH - 1]
        h = _hash(x)
        order = (h >> np.uint64(33)).astype(np.int32)[:n + REACH]
        least = _slide(order, REACH + 1, np.minimum)
        starts = np.arange(begin, begin + n)
        nth = np.searchsorted(ends, starts, side="right")
        least[starts + LENGTH > ends[nth]] = -1  # reaches into the next text
        edge = np.full(REACH, -1, np.int32)
        most = _slide(np.r_[edge, least, edge], REACH + 1, np.maximum)
        at = np.flatnonzero(most == order)
        found.append(at + begin)
        hashes.append(h[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found, first = np.unique(np.concatenate(found), return_index=True)
    return found, np.concatenate(hashes)[first]


class Run:
    """The texts of a run as one array of bytes, and their anchors.

    ``part`` and ``key`` (40 bits of the hash) name an anchor's k-gram.
    """

    def __init__(self, texts: pa.Table, parts: int):
        release()
        text = pc.fill_null(texts["text"], "").cast(pa.large_binary()).combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = text.chunk(0) if text.num_chunks else pa.array([], pa.large_binary())
        sizes = np.array(pc.binary_length(text).to_numpy(False), np.int64)
        _, offsets, data = text.buffers()
        begin = int(np.frombuffer(offsets, np.int64)[text.offset]) if len(text) else 0
        flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        self.flat = flat[begin:begin + int(sizes.sum())]  # the texts lie one after the other
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.docs = texts["doc"].combine_chunks().to_numpy(zero_copy_only=False)
        self.at, hashes = anchors(self.flat, self.ends)
        self.row = np.searchsorted(self.ends, self.at, side="right")
        self.part = (hashes % np.uint64(parts)).astype(np.int64)
        self.key = (hashes >> np.uint64(24)).astype(np.int64)
        order = np.lexsort((self.key, self.part))
        part, key = self.part[order], self.key[order]
        new = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])][:len(order)]
        self.gram = np.empty(len(order), np.int64)  # of each anchor: the number of its k-gram
        self.gram[order] = np.cumsum(new) - 1
        self.gram_part, self.gram_key = part[new], key[new]

    def several(self):
        """For each k-gram, whether more than one document of the run has it."""
        doc = self.docs[self.row]
        low = np.full(len(self.gram_key), NO_DOC)
        high = np.full(len(self.gram_key), np.iinfo(np.int64).min)
        np.minimum.at(low, self.gram, doc)
        np.maximum.at(high, self.gram, doc)
        return low < high

    def slices(self, parts_of):
        """(part, slice) for each part in a sorted array of parts."""
        parts, begins = np.unique(parts_of, return_index=True)
        return zip(parts.tolist(), [slice(a, b) for a, b in
                                    zip(begins, [*begins[1:], len(parts_of)])])

    def suffixes(self, shared, rows=True):
        """Set up the sorted distinct suffixes at anchors whose k-gram is shared.

        ``matrix`` has a row per suffix, ordered by part first, if ``rows`` are asked for;
        ``suffix`` gives each anchor's.
        """
        use = shared[self.gram]
        self.at, self.row, self.part = self.at[use], self.row[use], self.part[use]
        room = self.ends[self.row] - self.at
        back = self.at - self.begins[self.row]
        self.n_right, self.n_left = np.minimum(room, LENGTH), np.minimum(back, REACH)
        n = len(self.at)
        padded = np.r_[np.zeros(REACH, np.uint8), self.flat, np.zeros(LENGTH, np.uint8)]
        matrix = np.empty((n, WIDTH), np.uint8)
        for i in range(LENGTH):
            matrix[:, i] = np.where(i < self.n_right, padded[self.at + REACH + i], 0)
        for i in range(REACH):
            matrix[:, LENGTH + i] = np.where(i < self.n_left, padded[self.at + REACH - 1 - i], 0)
        matrix[:, -2], matrix[:, -1] = self.n_right, self.n_left
        del padded
        order = np.argsort(matrix.view(f"S{WIDTH}").ravel(), kind="stable")
        order = order[np.argsort(self.part[order], kind="stable")]
        part = self.part[order]
        new = np.ones(n, bool)
        new[1:] = part[1:] != part[:-1]
        for begin in range(1, n, COMPARED):  # in pieces: the matrix is the largest thing here
            at = order[begin - 1:begin + COMPARED]
            new[begin:begin + COMPARED] |= (matrix[at[1:]] != matrix[at[:-1]]).any(1)
        self.suffix = np.empty(n, np.int64)
        self.suffix[order] = np.cumsum(new) - 1
        self.matrix, self.suffix_part = matrix[order[new]] if rows else None, part[new]
        del matrix
        doc = self.docs[self.row]
        self.least = np.full(len(self.suffix_part), NO_DOC)
        np.minimum.at(self.least, self.suffix, doc)


# -- messages between runs and parts ---------------------------------------------------------

def _five(keys):
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw):
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel().astype(np.int64)


def front_code(matrix):
    """Common prefix of each row with the one before, and all bytes beyond these."""
    prefix = np.zeros(len(matrix), np.uint8)
    differs = matrix[1:] != matrix[:-1]
    prefix[1:] = np.where(differs.any(1), differs.argmax(1), WIDTH)
    return prefix, matrix[np.arange(WIDTH) >= prefix[:, None]]


def front_decode(prefix, rest):
    n = len(prefix)
    own = np.arange(WIDTH) >= prefix[:, None]
    matrix = np.zeros((n, WIDTH), np.uint8)
    matrix[own] = rest
    source = np.where(own, np.arange(n, dtype=np.int32)[:, None], 0)
    np.maximum.accumulate(source, axis=0, out=source)
    return np.take_along_axis(matrix, source, 0)


def _rows(run, rows):
    rows = list(rows)
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.table({"run": pa.array(columns[0] if run is None else [run] * len(rows), pa.int64()),
                     "part": pa.array(columns[0 if run is not None else 1], pa.int64()),
                     **{c: pa.array(columns[i + (1 if run is not None else 2)], pa.binary())
                        for i, c in enumerate("abcd")}})


def _send_grams(parts):
    def send(texts: pa.Table) -> pa.Table:
        run = Run(texts, parts)
        several = run.several()
        return _rows(texts["run"][0].as_py(), [
            (part, _five(run.gram_key[s]), np.packbits(several[s]).tobytes(), None, None)
            for part, s in run.slices(run.gram_part)])
    return send


def _shared_grams(messages: pa.Table) -> pa.Table:
    """Back to each run: which of its k-grams are in several documents, as bits."""
    rows = messages.to_pylist()
    keys = [_from_five(row["a"]) for row in rows]
    all_ = np.sort(np.concatenate(keys))
    twice = np.unique(all_[1:][all_[1:] == all_[:-1]])
    out = []
    for row, own in zip(rows, keys):
        several = np.unpackbits(np.frombuffer(row["b"], np.uint8), count=len(own)).astype(bool)
        if len(twice):
            at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
            several |= twice[at] == own
        out.append((row["run"], row["part"], np.packbits(several).tobytes(), None, None, None))
    return _rows(None, out)


def _read_shared(run, rows):
    """The bits of all parts, in the order of the run's k-grams."""
    shared = np.zeros(len(run.gram_key), bool)
    of_part = {row["part"]: row["a"] for row in rows}
    for part, s in run.slices(run.gram_part):
        shared[s] = np.unpackbits(np.frombuffer(of_part[part], np.uint8),
                                  count=s.stop - s.start).astype(bool)
    return shared


def _send_suffixes(parts):
    def send(texts: pa.Table, bits: pa.Table) -> pa.Table:
        out = []
        if len(texts) and len(bits):
            run = Run(texts, parts)
            run.suffixes(_read_shared(run, bits.to_pylist()))
            for part, s in run.slices(run.suffix_part):
                prefix, rest = front_code(run.matrix[s])
                out.append((part, prefix.tobytes(), zlib.compress(rest.tobytes(), 1),
                            run.least[s].tobytes(), None))
        return _rows(texts["run"][0].as_py() if len(texts) else 0, out)
    return send


# -- merge -----------------------------------------------------------------------------------

def merge(runs):
    """Merge sorted runs, given as (keys, prefixes): the run of each output in turn, and its common
    prefix with the output before it.

    A loser tree over the runs. ``known`` is the common prefix of a run's head with the winner that
    it lost to, so on the path of the last winner it is that with the last output. Of two heads the
    one that shares more with the output is smaller; only if they share the same are bytes compared,
    from there on. An exhausted run knows -1 and loses to all.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    heads = [keys[0] if keys else None for keys, _ in runs] + [None] * (size - len(runs))
    known = [0 if head is not None else -1 for head in heads]
    losers, at = [0] * size, [0] * size

    def differ(a, b, i):
        while a[i:i + 16] == b[i:i + 16]:
            i += 16
        while a[i] == b[i]:
            i += 1
        return i

    def play(node):
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        if known[a] == known[b] and known[a] >= 0:
            if heads[a] == heads[b]:
                known[b] = len(heads[b])
            else:
                i = differ(heads[a], heads[b], known[a])
                if heads[a][i] > heads[b][i]:
                    a, b = b, a
                known[b] = i
        elif known[a] < known[b]:
            a, b = b, a
        losers[node] = b
        return a

    order, prefixes = [], []
    winner = play(1)
    while known[winner] >= 0:
        order.append(winner)
        prefixes.append(known[winner])
        keys, own = runs[winner]
        i = at[winner] = at[winner] + 1
        if i < len(keys):
            heads[winner], known[winner] = keys[i], own[i]
        else:
            known[winner] = -1
        node = (winner + size) >> 1
        while node:
            other = losers[node]
            k, o = known[winner], known[other]
            if k < o:
                losers[node], winner = winner, other
            elif k == o and k >= 0:
                a, b = heads[winner], heads[other]
                if a == b:
                    known[other] = len(b)
                else:
                    i = differ(a, b, k)
                    if a[i] < b[i]:
                        known[other] = i
                    else:
                        known[winner] = i
                        losers[node], winner = winner, other
            node >>= 1
    return np.array(order, np.int64), np.array(prefixes, np.int64)


def least_documents(matrix, prefix, least):
    """For each sorted suffix and each distance from a window to its anchor: the smallest document
    that has the same window, or NO_DOC if the suffix does not reach as far.

    Windows at one distance are equal within an LCP interval of their length ahead of the anchor
    whose suffixes agree as far back.
    """
    n = len(matrix)
    out = np.full((n, REACH + 1), NO_DOC)
    n_right, n_left = matrix[:, -2].astype(int), matrix[:, -1].astype(int)
    back = np.ascontiguousarray(matrix[:, LENGTH:LENGTH + REACH])
    by_back = np.argsort(back.view(f"S{REACH}").ravel(), kind="stable")
    differs = back[by_back][1:] != back[by_back][:-1]
    agree = np.r_[0, np.where(differs.any(1), differs.argmax(1), REACH)]
    left = np.empty(n, np.int64)
    for distance in range(REACH + 1):
        left[by_back] = np.cumsum(agree < distance)
        ahead = np.cumsum(prefix < LENGTH - distance)
        ok = np.flatnonzero((n_left >= distance) & (n_right >= LENGTH - distance))
        if len(ok):
            group = ahead[ok] * (n + 1) + left[ok]
            order = np.argsort(group, kind="stable")
            group = group[order]
            begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            smallest = np.minimum.reduceat(least[ok][order], begins)
            out[ok[order], distance] = np.repeat(smallest, np.diff(np.r_[begins, len(ok)]))
    return out


def _merge_part(messages: pa.Table) -> pa.Table:
    """Back to each run: for suffixes with windows in a smaller document than the run's own, those
    documents; one per suffix where it is the same for all windows, else one per window."""
    rows = sorted(messages.to_pylist(), key=lambda row: row["run"])
    runs, matrices = [], []
    for row in rows:
        prefix = np.frombuffer(row["a"], np.uint8)
        matrix = front_decode(prefix, np.frombuffer(zlib.decompress(row["b"]), np.uint8))
        raw = matrix.tobytes()
        runs.append(([raw[i:i + WIDTH] for i in range(0, len(raw), WIDTH)], prefix.tolist()))
        matrices.append(matrix)
    order, prefix = merge(runs)
    sizes = np.array([len(m) for m in matrices])
    place = np.argsort(order, kind="stable")  # of each suffix, run by run, its place in the merge
    least = np.concatenate([np.frombuffer(row["c"], np.int64) for row in rows])
    sorted_least, source = np.empty_like(least), np.empty(len(least), np.int64)
    sorted_least[place], source[place] = least, np.arange(len(least))
    gram = np.cumsum(prefix < GRAM) - 1
    n_grams = int(gram[-1]) + 1
    alike = np.ones(n_grams, bool)
    alike[gram[1:][(prefix[1:] < WIDTH) & (prefix[1:] >= GRAM)]] = False
    overall = np.full(n_grams, NO_DOC)
    np.minimum.at(overall, gram, sorted_least)
    mixed = np.flatnonzero(~alike[gram])
    one = np.where(alike[gram], overall[gram], NO_DOC)
    many = np.zeros((0, REACH + 1), np.int64)
    if len(mixed):
        stacked = np.concatenate(matrices)[source[mixed]]
        many = least_documents(stacked, prefix[mixed], sorted_least[mixed])
    row_of = np.full(len(least), -1)
    row_of[mixed] = np.arange(len(mixed))
    out, begin = [], 0
    for row, n in zip(rows, sizes.tolist()):
        at = place[begin:begin + n]
        begin += n
        own = sorted_least[at]
        single = np.flatnonzero(one[at] < own)
        inside = np.flatnonzero(row_of[at] >= 0)
        lists = many[row_of[at[inside]]]
        useful = (lists < own[inside, None]).any(1)
        out.append((row["run"], row["part"], single.astype(np.int32).tobytes(),
                    one[at[single]].tobytes(), inside[useful].astype(np.int32).tobytes(),
                    zlib.compress(lists[useful].tobytes(), 1)))
    trim()
    return _rows(None, out)


# -- removal ---------------------------------------------------------------------------------

def _covered(run, found):
    """Mask of the bytes that a window with a smaller document covers."""
    n, doc = len(run.at), run.docs[run.row]
    begins = {part: s.start for part, s in run.slices(run.suffix_part)}
    single = run.least.copy()  # the run itself may hold an earlier document
    lists, list_of = [], np.full(len(single), -1)
    for row in found:
        base = begins[row["part"]]
        single[base + np.frombuffer(row["a"], np.int32)] = np.frombuffer(row["b"], np.int64)
        at = base + np.frombuffer(row["c"], np.int32)
        if len(at):
            list_of[at] = np.arange(len(at)) + sum(map(len, lists))
            lists.append(np.frombuffer(zlib.decompress(row["d"]), np.int64).reshape(len(at), -1))
    nearest = np.maximum(0, LENGTH - run.n_right)
    farthest = np.minimum(REACH, run.n_left)
    hit = (single[run.suffix] < doc) & (nearest <= farthest)
    if lists:
        lists = np.concatenate(lists)
        several = np.flatnonzero(list_of[run.suffix] >= 0)
        for begin in range(0, len(several), 1 << 16):
            part = several[begin:begin + (1 << 16)]
            earlier = lists[list_of[run.suffix[part]]] < doc[part, None]
            hit[part] = earlier.any(1)
            nearest[part] = earlier.argmax(1)
            farthest[part] = REACH - earlier[:, ::-1].argmax(1)
    edges = np.zeros(len(run.flat) + 1, np.int32)
    np.add.at(edges, (run.at - farthest)[hit], 1)
    np.add.at(edges, (run.at - nearest + LENGTH)[hit], -1)
    np.cumsum(edges, out=edges)
    return edges[:-1] > 0


def _cut(parts, kept_text):
    def cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
        run = Run(texts, parts)
        rows = answers.to_pylist()
        bits = [row for row in rows if row["kind"] == 0]
        gone = np.zeros(len(run.flat), bool)
        if bits:
            run.suffixes(_read_shared(run, bits), rows=False)
            del run.gram, run.key
            gone = _covered(run, [row for row in rows if row["kind"] == 1])
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        heads = run.begins[run.begins < len(gone)]  # a run of removed bytes ends with its text
        starts[heads] = gone[heads]
        removed, spans = (np.bincount(np.searchsorted(run.ends, np.flatnonzero(mask), "right"),
                                      minlength=len(texts)) for mask in (gone, starts))
        kept = run.flat[~gone].tobytes()
        ends = np.cumsum(run.ends - run.begins - removed).tolist()
        digests, texts_kept = [], []
        for a, b in zip([0, *ends], ends):
            digests.append(hashlib.sha256(kept[a:b]).hexdigest())
            if kept_text:
                texts_kept.append(kept[a:b].decode("utf-8", "ignore"))
        out = {"row": texts["row"], "text": pa.array(texts_kept, pa.string()) if kept_text
               else pa.nulls(len(texts), pa.string()),
               "n_bytes": pa.array(run.ends - run.begins, pa.int64()),
               "n_removed": pa.array(removed, pa.int64()),
               "n_spans": pa.array(spans, pa.int64()),
               "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out)
    return cut


def cut_repeats(docs: DataFrame, id_col="doc_id", text_col="text", kept_text=False,
                run_bytes: int = RUN_BYTES) -> DataFrame:
    """Per row of ``docs``: ``row`` (a struct of its columns but the text), ``n_bytes``,
    ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, the kept ``text``.

    Null texts count as empty. A row without an id counts as later than all others, and rows of one
    id as one document. Removal may cut a character; ``text`` leaves out what is left of it.
    """
    bounded_batches(docs.sparkSession)
    n_bytes = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    parts = max(1, -(-n_bytes // run_bytes))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    row_type = T.StructType([f for f in docs.schema.fields if f.name != text_col])
    texts = docs.select(F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("bigint").alias("run"),
                        F.coalesce(F.col(id_col).cast("bigint"),
                                   F.lit(int(NO_DOC) - 1)).alias("doc"),
                        F.col(text_col).alias("text"), F.struct(*others).alias("row"))
    by_run = texts.groupBy("run")
    grams = by_run.applyInArrow(_send_grams(parts), MESSAGE)
    bits = grams.groupBy("part").applyInArrow(_shared_grams, MESSAGE)
    sent = by_run.cogroup(bits.groupBy("run")).applyInArrow(_send_suffixes(parts), MESSAGE)
    found = sent.groupBy("part").applyInArrow(_merge_part, MESSAGE)
    answers = bits.withColumn("kind", F.lit(0)).unionAll(found.withColumn("kind", F.lit(1)))
    result = T.StructType([T.StructField("row", row_type), T.StructField("text", T.StringType()),
                           *[T.StructField(c, T.LongType())
                             for c in ("n_bytes", "n_removed", "n_spans")],
                           T.StructField("kept_sha256", T.StringType())])
    return by_run.cogroup(answers.groupBy("run")).applyInArrow(_cut(parts, kept_text), result)


def op3_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
