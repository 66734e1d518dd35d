"""Substring deduplication: matching statistics of documents over suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.llm.common import LAST_ID, col, columns_of, field, join_spread, materialize, release, row_of, stream_groups, tidied, words

WINDOW = 20
#: Words of an anchor: a window's anchor is the run of so many words in it that has the least hash.
ANCHOR = 6
#: Contexts of one anchor that one automaton takes; beyond, they are cut anew by longer anchors.
MAX_CONTEXTS = 4096
#: Words of one automaton, unless a single anchor has more.
SHARD_WORDS = 60_000
#: Windows of a segment at most.
MOST = 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x):
    """Bits of a polynomial hash stirred, so that the least of some runs is as good as random."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Powers of the base and of its inverse, as far as a text needed them.
_POWERS: list = []


def _powers(n: int):
    import numpy as np

    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 15, 2 * n)
        out = []
        for base in (_BASE, _BASE_INVERSE):
            power = np.full(size + 1, np.uint64(base))
            power[0] = 1
            out.append(np.multiply.accumulate(power))
        _POWERS[:] = out
    return _POWERS


class Segments:
    """The windows of some texts, cut into segments of neighbouring windows that have the same anchor.

    A window's anchor depends on its words alone, so equal windows have equal anchors wherever they are. Arrays:
    first and count (of a segment's windows, at most `most`), text (its number), anchor (hash of the anchor's words),
    context (hash of all words of the segment). Runs of words have polynomial hashes by prefix sums. The texts' words
    stand one after the other; ends says where each text begins and ends, if there are more than one.
    """

    def __init__(self, hashes, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST, ends=None) -> None:
        import numpy as np

        n = len(hashes)
        ends = np.array([0, n]) if ends is None else ends
        power, self.inverse = _powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:n], dtype=np.uint64, out=self.sums[1:])
        starts = n - window + 1
        if starts < 1:
            self.first = self.count = self.text = np.zeros(0, np.int64)
            self.anchor = self.context = np.zeros(0, np.uint64)
            return
        least = _mix((self.sums[anchor:] - self.sums[: n - anchor + 1]) * self.inverse[: n - anchor + 1])
        wide, have = window - anchor + 1, 1
        while have < wide:
            step = min(have, wide - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        whole = text[:starts] == text[window - 1 :]
        first = np.concatenate([[0], np.flatnonzero((least[1:] != least[:-1]) | (whole[1:] != whole[:-1])) + 1])
        count = np.diff(first, append=starts)[whole[first]]
        first = first[whole[first]]
        if len(count) and count.max() > most:
            parts = -(-count // most)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, count = np.repeat(first, parts) + most * nth, np.minimum(np.repeat(count, parts) - most * nth, most)
        self.first, self.count, self.text, self.anchor = first, count, text[first], least[first]
        self.context = _mix(self.run(first, first + count + window - 1) + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def once(self):
        """Numbers of segments, one of each context of a text."""
        import numpy as np

        order = np.argsort(self.context, kind="stable")
        context, text = self.context[order], self.text[order]
        new = np.ones(len(order), bool)
        new[1:] = (context[1:] != context[:-1]) | (text[1:] != text[:-1])
        return order[new]

    def run(self, begin, end):
        """Hashes of the words from begin to end, wherever they are in the text."""
        return (self.sums[end] - self.sums[begin]) * self.inverse[begin]


class SuffixAutomaton:
    """All runs of words of the texts added so far; a state knows the least document of those that hold its runs.

    Texts have to be added by rising document: what a state stands for was first seen when the state was made, and a
    state split off another one stands for runs as old as the other's.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.doc = [-1], [0], [None]

    def add(self, words: list, doc: int) -> None:
        step, link, length, of = self.next, self.link, self.len, self.doc
        last = 0
        for w in words:
            q = step[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            new = None
            if q is None:
                new = len(step)
                step.append({})
                link.append(0)
                length.append(length[last] + 1)
                of.append(doc)
            p = last
            if q is None:
                while p >= 0 and w not in step[p]:
                    step[p][w] = new
                    p = link[p]
                if p < 0:
                    last = new
                    continue
                q = step[p][w]
                if length[q] == length[p] + 1:
                    link[new] = q
                    last = new
                    continue
            split = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            of.append(of[q])
            link[q] = split
            while p >= 0 and step[p].get(w) == q:
                step[p][w] = split
                p = link[p]
            if new is None:
                last = split
            else:
                link[new] = split
                last = new

    def first_documents(self, words: list, window: int) -> list[int | None]:
        """Matching statistics of a text, cut at the window: the least document of each of its windows, None if unseen."""
        step, link, length, of = self.next, self.link, self.len, self.doc
        v = matched = 0
        out = []
        for i, w in enumerate(words):
            while v and w not in step[v]:
                v = link[v]
                matched = length[v]
            v = step[v].get(w, 0)
            matched = matched + 1 if v else 0
            while v and length[link[v]] >= window:
                v = link[v]
                matched = min(matched, length[v])
            if i + 1 >= window:
                out.append(of[v] if matched >= window else None)
        return out


def _automata(window: int):
    """Streams the contexts of whole anchors through automata built of these contexts."""

    def run(table) -> Iterator:
        import pyarrow as pa

        anchor, context, doc = (table.column(c).to_pylist() for c in ("anchor", "context", "first"))
        texts = [t.split(" ") for t in table.column("words").to_pylist()]
        out: list[list] = [[], [], []]
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (size < SHARD_WORDS or anchor[hi] == anchor[hi - 1]):
                size += len(texts[hi])
                hi += 1
            shard, number = SuffixAutomaton(), {}
            coded = [[number.setdefault(w, len(number)) for w in t] for t in texts[lo:hi]]
            for i in sorted(range(lo, hi), key=doc.__getitem__):
                shard.add(coded[i - lo], doc[i])
            for i in range(lo, hi):
                out[0].append(anchor[i])
                out[1].append(context[i])
                out[2].append(shard.first_documents(coded[i - lo], window))
            lo = hi
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], names=["anchor", "context", "firsts"])

    return run


def _hashes(text: str) -> Column:
    return F.transform(words(F.col(text)), lambda w: F.xxhash64(w))


def _rows_of(lists) -> Iterator:
    """The rows of a list column of longs as unsigned arrays, without copies."""
    import numpy as np

    offsets, flat = lists.offsets.to_numpy().tolist(), lists.values.to_numpy().view(np.uint64)
    for lo, hi in zip(offsets, offsets[1:], strict=False):
        yield flat[lo:hi]


def _runs(lists, size: int = 1 << 15) -> Iterator:
    """(lo, hi, hashes, ends): rows lo to hi of a list column of longs, of some `size` longs together or one row of more."""
    import numpy as np

    offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _segments(keyed: DataFrame, window: int) -> DataFrame:
    """(anchor, context, id) of every different segment of every text."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows: list = [[], [], []]
            ids = batch.column(0).to_numpy()
            for lo, hi, hashes, ends in _runs(batch.column(1)):
                found = Segments(hashes, window, ends=ends)
                once = found.once()
                rows[0].append(found.anchor[once])
                rows[1].append(found.context[once])
                rows[2].append(ids[lo:hi][found.text[once]])
            anchor, context = (np.concatenate([np.zeros(0, np.uint64), *r]).view(np.int64) for r in rows[:2])
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(context), pa.array(np.concatenate([np.zeros(0, np.int64), *rows[2]]))], names=["anchor", "context", "id"])

    return keyed.select("id", _hashes("text").alias("h")).mapInArrow(run, "anchor long, context long, id long")


def _met_segments(keyed: DataFrame, window: int) -> DataFrame:
    """Segments of anchors that occur more than once: the only ones that can hold a repeated window."""
    every = materialize(_segments(keyed, window))
    twice = every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    return materialize(every.join(twice, "anchor"))


def _first_texts(keyed: DataFrame, met: DataFrame, window: int) -> DataFrame:
    """(anchor, context, first, words): every different context once, with its least document and its words."""
    asked = met.groupBy("anchor", "context").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_list("context").alias("asked"))

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], []]
            ids, texts, lists = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()), batch.column(2)
            offsets, every = lists.offsets.to_numpy(), lists.values.to_numpy()
            for low, high, hashes, ends in _runs(batch.column(3)):
                found = Segments(hashes, window, ends=ends)
                # a context is asked of one id only
                asked = every[offsets[low] : offsets[high]]
                of = np.repeat(ids[low:high], np.diff(offsets[low : high + 1]))
                order = np.argsort(asked)
                asked, of = asked[order], of[order]
                once = found.once()
                contexts, doc = found.context.view(np.int64)[once], ids[low:high][found.text[once]]
                at = np.minimum(np.searchsorted(asked, contexts), len(asked) - 1)
                once = np.sort(once[(asked[at] == contexts) & (of[at] == doc)])
                text = found.text[once]
                begin = found.first[once] - ends[text]
                end = begin + found.count[once] + window - 1
                out[0] += found.anchor.view(np.int64)[once].tolist()
                out[1] += found.context.view(np.int64)[once].tolist()
                out[2] += ids[low:high][text].tolist()
                own, last = [], -1
                for t, lo, hi in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True):
                    if t != last:
                        own, last = _split(texts[low + t].as_py()), t
                    out[3].append(b" ".join(own[lo:hi]).decode("utf-8", "replace"))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["anchor", "context", "first", "words"])

    return materialize(keyed.join(asked, "id").select("id", "text", "asked", _hashes("text").alias("h")).mapInArrow(cut, "anchor long, context long, first long, words string"))


def _cut_anew(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """The contexts of texts in pieces of windows that have the same longer anchor: (whole, of, j, anchor, context, first, words)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for whole, of, first, text, hashes in zip(*[batch.column(i).to_pylist() for i in range(4)], _rows_of(batch.column(4)), strict=True):
                own, found = text.split(" "), Segments(hashes, window, anchor)
                # a piece's anchor also tells the anchor it was cut from
                parent = np.uint64(whole % (1 << 64)) * np.uint64(_BASE)
                anchors, contexts = _mix(found.anchor + parent).view(np.int64).tolist(), found.context.view(np.int64).tolist()
                for lo, n, a, c in zip(found.first.tolist(), found.count.tolist(), anchors, contexts, strict=True):
                    for column, value in zip(out, (whole, of, lo, a, c, first, " ".join(own[lo : lo + n + window - 1])), strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["whole", "of", "j", "anchor", "context", "first", "words"])

    hashed = texts.select("anchor", "context", "first", "words", F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("h"))
    return hashed.mapInArrow(run, "whole long, of long, j long, anchor long, context long, first long, words string")


def _earliest(texts: DataFrame, window: int, anchor: int = ANCHOR) -> DataFrame:
    """(anchor, context, firsts): the least document of each window of every context.

    Contexts of anchors that have too many for one automaton are cut by anchors of more words, at last by whole
    windows, of which an anchor has a few contexts only; what that gives for the pieces is put together again.
    """
    kind = "anchor long, context long, firsts array<long>"
    counts = texts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MAX_CONTEXTS)
    many = materialize(counts) if anchor < window else None
    if many is None or many.isEmpty():
        return materialize(stream_groups(texts, ["anchor"], _automata(window), kind).dropDuplicates(["anchor", "context"]))
    few = stream_groups(texts.join(many.select("anchor"), "anchor", "left_anti"), ["anchor"], _automata(window), kind)
    longer = min(window, 2 * anchor + 1)
    pieces = materialize(_cut_anew(join_spread(texts, many, "anchor"), window, longer))
    # equal pieces have equal words
    once = pieces.groupBy("anchor", "context").agg(F.min("first").alias("first"), F.min("words").alias("words"))
    firsts = _earliest(materialize(once), window, longer)
    whole = pieces.select("whole", "of", "j", "anchor", "context").join(firsts, ["anchor", "context"])
    whole = whole.groupBy("whole", "of").agg(F.sort_array(F.collect_set(F.struct("j", "firsts"))).alias("all"))
    whole = whole.select(F.col("whole").alias("anchor"), F.col("of").alias("context"), F.flatten("all.firsts").alias("firsts"))
    return materialize(few.union(whole).dropDuplicates(["anchor", "context"]))


def _claims(met: DataFrame, earliest: DataFrame) -> DataFrame:
    """(id, claims): for every document its contexts and which of their windows (as bits) a smaller document has."""
    bits = F.aggregate(F.transform("firsts", lambda first, j: F.when(first < F.col("id"), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    found = met.join(earliest, ["anchor", "context"]).select("id", "context", bits.alias("bits")).where("bits <> 0")
    return found.groupBy("id").agg(F.collect_list(F.struct("context", "bits")).alias("claims"))


@tidied
def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows of docs with all columns, the text without repeated words (kept ones joined by one space), n_words, n_removed.

    Words are runs of anything but ASCII white space, unchanged. A word goes if a window of `window` words of its
    document covers it whose words also start earlier: in a document with a smaller doc_id, or before it in its own.
    Windows are judged on the input.

    Every window belongs to its anchor, the run of six of its words with the least hash; neighbouring windows of one
    anchor are a segment. Windows can only be equal if their anchors are, so segments are dealt out by anchor, and
    those with an anchor of their own go no further. The different contexts of an anchor, each once with its least
    document, are the reference: suffix automata of shards of them give the matching statistics of every context,
    hence the least document of each window, word by word. Shards aren't sent to all tasks, as every shard would have
    to meet every document; contexts go to the one shard that can hold their windows. An anchor with more contexts
    than an automaton takes gets the least document of each window by a minimum per window instead. Repeats within a
    document are found, word by word, where it lies.

    Null texts have no words and stay null; empty ones stay empty. A null doc_id comes after all others. Rows with
    equal doc_id don't start earlier than one another. Columns named n_words or n_removed give way. Windows of up to
    64 words can be asked for. Other columns may have any names. An empty table gives an empty result.
    """
    if not ANCHOR <= window <= 64:
        raise ValueError("windows have 6 to 64 words")
    keyed = docs.select(F.coalesce(col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), col(text).alias("text"))
    met = _met_segments(keyed, window)
    release(docs.sparkSession)
    texts = _first_texts(keyed, met, window)
    release(docs.sparkSession)
    earliest = _earliest(texts, window)
    release(docs.sparkSession)
    claims = _claims(met, earliest)
    own = columns_of(docs, ("n_words", "n_removed"))
    rows = docs.select(F.coalesce(col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), col(text).alias("text"), row_of([c for c in own if c != text] or own[:1]))
    joined = rows.join(claims, "id", "left").select("row", "text", "claims", _hashes("text").alias("h"))

    def kept(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts, total, gone = [], [], []
            given, claims = batch.column(1).cast(pa.binary()), batch.column(2)
            asked_ends = claims.offsets.to_numpy().tolist()
            asked_contexts, asked_bits = (claims.values.field(i).to_numpy() for i in range(2))
            for low, high, hashes, ends in _runs(batch.column(3)):
                found = Segments(hashes, window, ends=ends)
                of = np.searchsorted(found.text, np.arange(high - low + 1)).tolist()
                contexts = found.context.view(np.int64).tolist()
                runs = (found.sums[window:] - found.sums[:-window]) * found.inverse[: max(0, len(hashes) - window + 1)]
                for t, begin in enumerate(ends[:-1].tolist()):
                    text = given[low + t].as_py()
                    words, starts = _split(text), None
                    if len(words) >= window:
                        starts = np.zeros(len(words) - window + 1, bool)
                        lo, hi = asked_ends[low + t : low + t + 2]
                        if lo < hi:
                            asked = dict(zip(asked_contexts[lo:hi].tolist(), asked_bits[lo:hi].tolist(), strict=True))
                            hit = [s for s in range(of[t], of[t + 1]) if contexts[s] in asked]
                            bits = np.array([asked[contexts[s]] for s in hit], np.int64)
                            claimed = (bits[:, None] >> np.arange(MOST)) & 1 == 1
                            starts[((found.first[hit] - begin)[:, None] + np.arange(MOST))[claimed]] = True
                        own = runs[begin : begin + len(starts)]
                        rising = np.sort(own)
                        if (rising[1:] == rising[:-1]).any():
                            _, before, which = np.unique(own, return_index=True, return_inverse=True)
                            for s in np.flatnonzero((before[which] < np.arange(len(starts))) & ~starts).tolist():
                                e = int(before[which[s]])
                                starts[s] = words[s : s + window] == words[e : e + window]
                    left = words
                    if starts is not None and starts.any():
                        edge = np.zeros(len(words) + 1, np.int64)
                        edge[:-window][starts] += 1
                        np.subtract.at(edge, np.flatnonzero(starts) + window, 1)
                        left = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                    total.append(len(words))
                    gone.append(len(words) - len(left))
                    texts.append(None if text is None else b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = joined.mapInArrow(kept, schema)
    return done.select(*[F.col("text").alias(c) if c == text else field(c) for c in own], "n_words", "n_removed")
