"""Best documents by BM25: each task scores whole documents for all queries and keeps its own best, so no pair of a query and a document leaves it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Documents compared at once: few at first, for the first scores say what later ones must reach. Pairs of a posting and a query at once.
FIRST_ROWS, MOST_ROWS, PAIRS = 64, 4096, 1 << 18
#: A term that one of so many documents holds is looked up in a row for all documents.
OFTEN = 32
#: Rows of best documents that a task holds.
ROWS = 1 << 19
#: Scores are compared after rounding to four digits; what may be skipped lies this far below.
MARGIN = 1e-4


def lists(rows: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """values, whose rows (ascending) are given, as list columns of n rows."""
    ends = pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in values]


def count_terms(terms: pa.Array, fields: list[int], width: int):
    """(id, tokens) to (id, codes, ns): how often a document holds each of the terms, and its length, per field.

    tokens has an array for each of `width` fields; those in fields count. The code of term t in the j-th field is
    t * len(fields) + j, the code of its length -1 - j.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, codes, ns = [], [], []
            each = pc.list_flatten(b.column("tokens"))
            for j, f in enumerate(fields):
                own = each.take(pa.array(np.arange(b.num_rows) * width + f))
                size = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
                at = pc.fill_null(pc.index_in(pc.list_flatten(own), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                key = (np.repeat(np.arange(b.num_rows), size) * max(1, len(terms)) + at)[at >= 0]
                key, n = np.unique(key, return_counts=True)
                there = np.flatnonzero(size)
                rows += [there, key // max(1, len(terms))]
                codes += [np.full(len(there), -1 - j), key % max(1, len(terms)) * len(fields) + j]
                ns += [size[there], n]
            rows, codes, ns = np.concatenate(rows), np.concatenate(codes), np.concatenate(ns)
            order = np.argsort(rows, kind="stable")
            yield pa.RecordBatch.from_arrays([b.column("id"), *lists(rows[order], b.num_rows, codes[order], ns[order])], ["id", "codes", "ns"])

    return run


def tasks(df: DataFrame) -> DataFrame:
    """df in as many tasks as keep all cores busy: each passes its k best on, so their number must not grow with the input."""
    return df.coalesce(max(16, 2 * df.sparkSession.sparkContext.defaultParallelism))


def rounded(s: np.ndarray) -> np.ndarray:
    """To four digits, halves away from zero."""
    return np.sign(s) * np.floor(np.abs(s) * 1e4 + 0.5) / 1e4


class Best:
    """The k best documents of each query so far, ties by id; least: the score that a further one must reach."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least, self.parts, self.fresh = k, np.full(queries, -np.inf), [], 0

    def add(self, q: np.ndarray, ids: pa.Array, s: np.ndarray) -> None:
        self.parts.append((q, ids, s))
        self.fresh += len(q)
        if self.fresh > max(50_000, len(self.parts[0][0]) // 4):
            self.reduce()

    def reduce(self) -> None:
        if not self.parts:
            return
        q, s = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2))
        ids = pa.concat_arrays([p[1] for p in self.parts])
        order = np.lexsort((-s, q))
        first = np.searchsorted(q[order], np.arange(len(self.least)))
        last = first + self.k - 1
        full = np.flatnonzero((last < len(q)) & (q[order][np.minimum(last, len(q) - 1)] == np.arange(len(self.least))))
        self.least[full] = s[order][last[full]]
        keep = order[s[order] >= self.least[q[order]]]  # with all ties, unless they are many
        if len(keep) > 2 * np.minimum(np.bincount(q, minlength=len(self.least)), self.k).sum():
            tied = pa.table({"q": q[keep], "s": s[keep], "id": ids.take(pa.array(keep)), "at": keep}).sort_by([("q", "ascending"), ("s", "descending"), ("id", "ascending")])
            own = tied.column("q").to_numpy()
            keep = tied.column("at").to_numpy()[np.arange(len(own)) - np.searchsorted(own, own) < self.k]
        self.parts, self.fresh = [(q[keep], ids.take(pa.array(keep)), s[keep])], 0

    def result(self, names: pa.Array) -> Iterator[pa.RecordBatch]:
        """(qid, id, score), the queries by their names."""
        self.reduce()
        for q, ids, s in self.parts:
            for a in range(0, len(q), 100_000):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q[a : a + 100_000])), ids.slice(a, 100_000), pa.array(s[a : a + 100_000])], ["qid", "id", "score"])


def best_documents(names: pa.Array, q: np.ndarray, t: np.ndarray, qtf: np.ndarray, idf: np.ndarray, avgdl: np.ndarray, k: int, k1: float, b: float, positive: bool):
    """(id, codes, ns) to (qid, id, score): the k best documents of the task per query.

    The rows of q, t and qtf say how often a query (by its place in names) asks for a term; idf is by code. A query's
    weakest terms, which together cannot lift a document to its k-th best score, are only looked up in documents that
    hold one of its others: the result is that of scoring every pair.
    """
    fields, size = len(avgdl), len(idf) // len(avgdl)

    def scan(best: Best, ids: pa.Array, row: np.ndarray, term: np.ndarray, w: np.ndarray) -> None:
        wide = len(ids)
        key, at = np.unique(term * wide + row, return_inverse=True)
        w = np.bincount(at, w, len(key))
        held, start = np.unique(key // wide, return_index=True)
        count, doc = np.diff(np.append(start, len(key))), key % wide
        # postings of a term, heaviest first; their places on a line of all terms
        down = np.lexsort((-w, key // wide))
        heavy, light = w.max(), max(w.max() - w.min(), 1e-300)
        line = np.repeat(2.0 * np.arange(len(held)), count) + (heavy - w[down]) / light
        often = np.flatnonzero(count * OFTEN >= wide)
        level, table = np.full(len(held), -1), np.zeros((len(often), wide))
        level[often] = np.arange(len(often))
        inside = np.repeat(level, count)
        table[inside[inside >= 0], doc[inside >= 0]] = w[inside >= 0]
        most, place = np.maximum(np.maximum.reduceat(w, start), 0), np.full(size, -1)
        place[held] = np.arange(len(held))
        use = place[t] >= 0
        aq, ap, af = q[use], place[t[use]], qtf[use]
        order = np.lexsort((af * most[ap], aq))
        aq, ap, af = aq[order], ap[order], af[order]
        if not len(aq):
            return
        own = af * most[ap]
        upto = np.cumsum(own)
        begin = np.flatnonzero(np.append(True, aq[1:] != aq[:-1]))
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(aq))))
        upto -= (upto[begin] - own[begin])[group]
        weak = upto < best.least[aq] - MARGIN
        weak_n = np.bincount(group[weak], minlength=len(begin))
        rest = np.where(weak_n > 0, upto[np.maximum(begin + weak_n - 1, 0)], 0.0)
        # a posting counts if it and the most of the query's other terms reach the k-th best
        whole = upto[np.append(begin[1:], len(aq)) - 1][group]
        need = np.clip((heavy - (best.least[aq] - MARGIN - (whole - own)) / af) / light, -0.5, 1.5)
        enough_n = np.clip(np.searchsorted(line, 2.0 * ap + need + 1e-9, "right") - start[ap], 0, count[ap])
        strong = np.flatnonzero(~weak & (enough_n > 0))
        if not len(strong):
            return
        pairs = np.cumsum(enough_n[strong])
        cut, ends = 0, np.append(np.flatnonzero(np.diff(group[strong])) + 1, len(strong))
        while cut < len(strong):  # whole queries at a time
            enough = np.searchsorted(pairs[ends - 1], (pairs[cut - 1] if cut else 0) + PAIRS, "right")
            stop = ends[max(enough - 1, np.searchsorted(ends, cut, "right"))]
            rows = strong[cut:stop]
            cut = stop
            n = enough_n[rows]
            p = down[np.repeat(start[ap[rows]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            low = group[rows[0]]
            pair, score = np.repeat((group[rows] - low) * wide, n) + doc[p], np.repeat(af[rows], n) * w[p]
            cells = int(group[rows[-1]] - low + 1) * wide
            if cells <= 8 * len(pair):
                sums = np.bincount(pair, score, cells)
                pair = np.flatnonzero(np.bincount(pair, minlength=cells))
                score = sums[pair]
            else:
                order = np.argsort(pair, kind="stable")
                pair, score = pair[order], score[order]
                each = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                pair, score = pair[each], np.add.reduceat(score, each)
            g, d = pair // wide + low, pair % wide
            least = best.least[aq[begin]]
            good = score + rest[g] >= least[g] - MARGIN
            g, d, score = g[good], d[good], score[good]
            at = begin[g] + weak_n[g] - 1  # the weak terms, strongest first, as long as the others can lift the document
            some = np.flatnonzero(weak_n[g] > 0)
            while len(some):
                line_at, to = at[some], d[some]
                own_at, found = ap[line_at], np.zeros(len(some))
                full = level[own_at] >= 0
                found[full] = table[level[own_at[full]], to[full]]
                want = held[own_at[~full]] * wide + to[~full]
                place_of = np.minimum(np.searchsorted(key, want), len(key) - 1)
                found[~full] = np.where(key[place_of] == want, w[place_of], 0.0)
                score[some] += af[line_at] * found
                more = line_at > begin[g[some]]
                left = np.where(more, upto[line_at - 1], 0.0)
                out = score[some] + left < least[g[some]] - MARGIN
                score[some[out]] = -np.inf
                at[some] -= 1
                some = some[more & ~out]
            good = score > -np.inf
            g, d, score = g[good], d[good], score[good]
            if positive:
                g, d, score = g[score > 0], d[score > 0], score[score > 0]
            score = rounded(score)
            good = score >= least[g]
            if good.any():
                best.add(aq[begin[g[good]]], ids.take(pa.array(d[good])), score[good])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = Best(len(names), k), FIRST_ROWS
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                part = batch.slice(done, rows)
                done, rows = done + rows, min(4 * rows, MOST_ROWS)
                code, n = (pc.list_flatten(part.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("codes", "ns"))
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("codes")).to_numpy(zero_copy_only=False))
                length = np.zeros((part.num_rows, fields))
                length[row[code < 0], -1 - code[code < 0]] = n[code < 0]
                row, tf, code = row[code >= 0], n[code >= 0], code[code >= 0]
                if not len(row):
                    continue
                f = code % fields
                with np.errstate(all="ignore"):
                    w = idf[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row, f] / avgdl[f]))
                scan(best, part.column("id"), row, code // fields, w)
        yield from best.result(names)

    return run


def numbered(rows: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct queries and terms of rows (qid, term, qtf), and each row's place in them and qtf."""

    def places(c: Any) -> tuple[pa.Array, np.ndarray]:
        at = pa.concat_arrays(c.chunks).dictionary_encode("encode") if c.num_chunks else pa.array([], c.type).dictionary_encode("encode")
        return at.dictionary, at.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    (names, q), (terms, t) = places(rows.column("qid")), places(rows.column("term"))
    return names, terms, q, t, rows.column("qtf").to_numpy().astype(np.float64)
