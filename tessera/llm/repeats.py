"""Repeated passages: maximal repeats from a sparse enhanced suffix array.

Every byte that lies in a ``LENGTH``-byte string starting anywhere else too is found
and cut.  Only *anchors* enter the suffix array: the leftmost least hash of the
``GRAM``-byte strings in each window of ``LENGTH`` bytes.  Equal windows have their
anchor at the same place, so two occurrences always meet under the hash of their anchor.

1.  Each anchor gives its hash and a hash of its context, the bytes that any window
    around it can reach.  Hashes seen once are done; where all contexts under a hash are
    equal, all of them are repeats as they stand.
2.  Where contexts differ, one text of each distinct context is fetched.  Its suffixes are
    sorted, a stack scan over common prefixes gives the interval tree, and in each interval
    the extension to the left is compared: members that agree far enough to the left are a
    maximal repeat, with all of its occurrences.
3.  The exact way for a hash with more distinct contexts than one task should hold: the
    windows themselves are counted by two hashes.  It finds the same bytes.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes keep everything; copies
of a text are cut entirely; overlapping occurrences in one text count; matches never cross
texts; ids may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import renamed, table
from tessera.llm.textkernel import _powers, buffers, fmix, text_groups
from tessera.plans.scratch import discard, materialize

LENGTH, GRAM = 200, 32
#: Distinct contexts of one hash that a task takes together, and contexts in one suffix array.
MOST, CHUNK = 50_000, 20_000
_WINDOW = LENGTH - GRAM + 1
_LEFT = LENGTH - GRAM
_PART = 1 << 18

_rng = np.random.Generator(np.random.PCG64(5))
_T1, _T2 = (_rng.integers(1, 2**63, 256, dtype=np.uint64) for _ in range(2))
_C = [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, 2)]
_B1, _B2 = (int(x) | 1 for x in _rng.integers(1, 2**63, 2))
_N = 2 * _PART + 4 * LENGTH
_P1, _P2 = _powers(_B1, _N), _powers(_B2, _N)
_I1, _I2 = (_powers(pow(b, -1, 1 << 64), _N) for b in (_B1, _B2))


def _prefix(x: np.ndarray, bytes_: np.ndarray, power: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(bytes_[x] * power[: len(x)], out=out[1:])
    return out


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours, from prefix and suffix minima of blocks."""
    n = len(v) - w + 1
    pad = -len(v) % w
    b = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    back = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _anchors(x: np.ndarray, begin: np.ndarray, end: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """Of the texts at ``begin``..``end`` (offsets into x, may reach beyond it), for windows that start in lo..hi:
    (text number, position in text, bytes to the right, hash, context hash)."""
    whole = begin + LENGTH <= end
    first, last = np.maximum(begin[whole], lo), np.minimum(end[whole] - LENGTH + 1, hi)
    some = last > first
    if not some.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    edge = np.zeros(len(x) + 1, dtype=np.int8)
    np.add.at(edge, first[some], 1)
    np.add.at(edge, last[some], -1)
    h = _prefix(x, _T1, _P1)
    gram = fmix((h[GRAM:] - h[:-GRAM]) * _I1[: len(x) - GRAM + 1])
    low = np.uint64((1 << 20) - 1)
    least = sliding_min((gram & ~low) | np.arange(len(gram), dtype=np.uint64), _WINDOW)
    at = np.unique((least[np.cumsum(edge)[: len(least)] > 0] & low).astype(np.int64))
    text = np.searchsorted(begin, at, side="right") - 1
    pos = at - begin[text]
    left, right = np.minimum(pos, _LEFT), np.minimum(end[text] - at, LENGTH)
    g = _prefix(x, _T2, _P2)
    around = fmix((g[at + right] - g[at - left]) * _I2[at - left] + left.astype(np.uint64) * _C[0] + right.astype(np.uint64) * _C[1])
    return text, pos, right, gram[at].view(np.int64), around.view(np.int64)


def anchors(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of consecutive texts."""
    for i, j in text_groups(at, _PART):
        lo, hi = int(at[i]), int(at[j])
        if hi - lo <= _PART:
            text, *rest = _anchors(raw[lo:hi], at[i:j] - lo, at[i + 1 : j + 1] - lo, 0, hi - lo)
            yield text + i, *rest
            continue
        before = -1  # a part's first windows may have the last anchor of the part before
        for s in range(lo, hi, _PART):  # one long text, part by part with what windows and contexts reach
            a, b = max(lo, s - _LEFT), min(hi, s + _PART + 2 * LENGTH)
            text, pos, *rest = _anchors(raw[a:b], np.array([lo - a]), np.array([hi - a]), s - a, s - a + _PART)
            new = pos > before
            before = int(pos[-1]) if len(pos) else before
            yield text[new] + i, pos[new], *(x[new] for x in rest)


# --- the suffix array of one chunk ---------------------------------------------


def _common(a: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the next."""
    other = a[1:] != a[:-1]
    return np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1])


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan of a common-prefix array: (depth, first, last) of every interval whose depth is ``least`` or more."""
    stack: list[tuple[int, int]] = []
    values = [*lcp.tolist(), -1]
    for i, depth in enumerate(values):
        begin = i
        while stack and stack[-1][0] > depth:
            d, begin = stack.pop()
            if d >= least:
                yield d, begin, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))


class _RangeMin:
    def __init__(self, v: np.ndarray):
        self.rows = [v]
        while 2 << (len(self.rows) - 1) <= len(v):
            r, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(r[:-step], r[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of v[a:b] for each pair, b > a."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=self.rows[0].dtype)
        for j in np.unique(k):
            m = k == j
            out[m] = np.minimum(self.rows[j][a[m]], self.rows[j][b[m] - (1 << int(j))])
        return out


def maximal_repeats(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each anchor's repeats reach to the left and to the right; (0, 0) if it has none.

    ``left`` holds the bytes before each anchor, nearest first, ``right`` those from it on, both
    padded with 0xFF, which no text contains.
    """
    n = len(right)
    reach_l, reach_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return reach_l, reach_r
    order = np.argsort(np.ascontiguousarray(right).view(f"S{LENGTH}").ravel(), kind="stable")
    by_left = np.argsort(np.ascontiguousarray(left).view(f"S{_LEFT}").ravel(), kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    between = _RangeMin(_common(left[by_left]))
    for depth, first, last in intervals(_common(right[order]), GRAM):
        members = order[first : last + 1]
        members = members[np.argsort(rank[members])]
        r = rank[members]
        step = between(r[:-1], r[1:])
        if not (step + depth >= LENGTH).any():
            continue  # no two members agree far enough to the left
        agree = np.zeros(len(members), np.int64)
        agree[1:] = step
        np.maximum(agree[:-1], step, out=agree[:-1])
        a, b = np.minimum(agree, n_left[members]), np.minimum(depth, n_right[members])
        ok = a + b >= LENGTH
        hit = members[ok]
        reach_l[hit], reach_r[hit] = np.maximum(reach_l[hit], a[ok]), np.maximum(reach_r[hit], b[ok])
    return reach_l, reach_r


def _padded(column: pa.Array, n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, raw = buffers(column)
    left, right = np.full((len(column), _LEFT), 255, np.uint8), np.full((len(column), LENGTH), 255, np.uint8)
    for i in range(len(column)):
        p = at[i] + n_left[i]
        left[i, : n_left[i]] = raw[at[i] : p][::-1]
        right[i, : n_right[i]] = raw[p : p + n_right[i]]
    return left, right


def _repeat_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of anchors that come sorted by hash: (tk, b, e)."""
    held: list[pa.RecordBatch] = []

    def flush(t: pa.Table) -> pa.RecordBatch:
        pos, nr, alone = (t.column(c).to_numpy() for c in ("pos", "right", "alone"))
        nl = np.minimum(pos, _LEFT)
        reach_l, reach_r = maximal_repeats(*_padded(t.column("context").combine_chunks(), nl, nr), nl, nr)
        ok = (reach_r > 0) & alone
        return pa.RecordBatch.from_arrays([t.column("tk").combine_chunks().filter(pa.array(ok)), pa.array((pos - reach_l)[ok]), pa.array((pos + reach_r)[ok])], names=["tk", "b", "e"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK:
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if cut:
                yield flush(t.slice(0, cut))
                held = t.slice(cut).to_batches()
    if held and sum(x.num_rows for x in held):
        yield flush(pa.Table.from_batches(held))


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every window in each context: (w1, w2, tk, start)."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        pos = t.column("pos").to_numpy()
        at, raw = buffers(batch.column(batch.schema.get_field_index("context")))
        tk = t.column("tk").to_numpy()
        for i, j in text_groups(at, _PART):
            x = raw[at[i] : at[j]]
            g, h = _prefix(x, _T1, _P1), _prefix(x, _T2, _P2)
            n = np.diff(at[i : j + 1]) - LENGTH + 1
            which = np.repeat(np.arange(i, j), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s = at[which] - at[i] + offset
            w1, w2 = fmix((g[s + LENGTH] - g[s]) * _I1[s]), fmix((h[s + LENGTH] - h[s]) * _I2[s])
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(tk[which]), pa.array(pos[which] - np.minimum(pos[which], _LEFT) + offset)], names=["w1", "w2", "tk", "start"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, anchors of it) to one row an anchor with its context."""
    for batch in batches:
        at, raw = buffers(batch.column(batch.schema.get_field_index("text")))
        listed = batch.column(batch.schema.get_field_index("wanted"))
        rows = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
        flat = listed.flatten()
        pos, right = flat.field("pos").to_numpy(), flat.field("right").to_numpy()
        begin = at[rows] + pos - np.minimum(pos, _LEFT)
        end = at[rows] + pos + right
        texts = [raw[b:e].tobytes() for b, e in zip(begin, end, strict=True)]
        tk = batch.column(batch.schema.get_field_index("tk")).to_numpy()[rows]
        for s in range(0, len(texts), CHUNK):
            cut = slice(s, s + CHUNK)
            yield pa.RecordBatch.from_arrays(
                [flat.field("key")[cut], flat.field("many")[cut], flat.field("alone")[cut], pa.array(tk[cut]), pa.array(pos[cut]), pa.array(right[cut]), pa.array(texts[cut], pa.binary())],
                names=["key", "many", "alone", "tk", "pos", "right", "context"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tk, text, spans) to (tk, n_removed, n_spans, kept_sha)."""
    for batch in batches:
        at, raw = buffers(batch.column(batch.schema.get_field_index("text")))
        listed = batch.column(batch.schema.get_field_index("spans"))
        offs = listed.offsets.to_numpy()
        flat = listed.flatten()
        b, e = flat.field("b").to_numpy(), flat.field("e").to_numpy()
        removed, spans, sha = [], [], []
        for i in range(batch.num_rows):
            bi, ei = b[offs[i] - offs[0] : offs[i + 1] - offs[0]], e[offs[i] - offs[0] : offs[i + 1] - offs[0]]
            o = np.argsort(bi, kind="stable")
            bi, top = bi[o], np.maximum.accumulate(ei[o])
            new = np.concatenate([[True], bi[1:] > top[:-1]])  # spans that touch are one run
            starts, ends = bi[new], top[np.concatenate([new[1:], [True]])]
            text, digest, p = raw[at[i] : at[i + 1]], hashlib.sha256(), 0
            for s, t in zip(starts, ends, strict=True):
                digest.update(text[p:s])
                p = t
            digest.update(text[p:])
            removed.append(int((ends - starts).sum()))
            spans.append(len(starts))
            sha.append(digest.digest())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("tk")), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.binary())], names=["tk", "n_removed", "n_spans", "kept_sha"])


# --- the operator -------------------------------------------------------------


def repeated_spans(texts: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Of ``texts`` (id, text, tk; equal texts share tk): spans (tk, b, e) to cut, one (tk, text) for each tk that has any, and the tables that both read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = buffers(batch.column(1))
            tk = batch.column(0).to_numpy()
            for text, pos, right, gram, around in anchors(raw, at):
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(around), pa.array(tk[text]), pa.array((pos << 8) | right)], names=["key", "around", "tk", "place"])

    found = materialize(texts.select("tk", "text").mapInArrow(scan, "key long, around long, tk long, place long"), "repeat-anchors")
    seen = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi"))
    again = materialize(seen.where("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("mixed")), "repeat-keys")
    # the join stands alone in its stage, so a hot hash is split; copies are then counted map-side first
    met = materialize(found.join(again, "key"), "repeat-met")
    discard(found, again)
    hits = materialize(met.groupBy("key", "around", "tk", "place", "mixed").agg(F.count(F.lit(1)).alias("n")), "repeat-hits")
    discard(met)
    place = [F.shiftright("place", 8).alias("pos"), F.col("place").bitwiseAND(F.lit(255)).alias("right")]
    begin, end = F.col("pos") - F.least("pos", F.lit(_LEFT)), F.col("pos") + F.col("right")
    equal = hits.where("not mixed").select("tk", *place).select("tk", begin.alias("b"), end.alias("e"))

    mixed = hits.where("mixed")
    kinds = mixed.groupBy("key", "around").agg(F.sum("n").alias("n"), F.min("tk").alias("tk"), F.min_by("place", F.struct("tk", "place")).alias("place"))
    kinds = materialize(kinds, "repeat-kinds")
    same = mixed.join(kinds.where("n > 1").select("key", "around"), ["key", "around"]).select("tk", *place).select("tk", begin.alias("b"), end.alias("e"))
    many = kinds.groupBy("key").agg((F.count(F.lit(1)) > most).alias("many"))
    many = materialize(many, "repeat-many")  # written, so that the join's two sides are dealt out and a hot hash is split
    wanted = kinds.join(many, "key").select("tk", F.struct("key", "many", (F.col("n") == 1).alias("alone"), *place).alias("w"))
    wanted = wanted.groupBy("tk").agg(F.collect_list("w").alias("wanted"))  # at most the anchors of one text

    # one row of each text that has a hit
    first = texts.groupBy("tk").agg(F.min("id").alias("first_id"))
    need = hits.select("tk").distinct().join(first, "tk").join(wanted, "tk", "left")
    need = materialize(need, "repeat-need")
    held = texts.join(need, "tk").where("id <=> first_id").select("tk", "text", "wanted")
    held = materialize(held, "repeat-texts")
    context = held.where("wanted IS NOT NULL").mapInArrow(_contexts, "key long, many boolean, alone boolean, tk long, pos long, right long, context binary")
    context = materialize(context, "repeat-contexts")
    ranked = context.where("not many").repartition("key").sortWithinPartitions("key").mapInArrow(_repeat_spans, "tk long, b long, e long")
    windows = context.where("many").mapInArrow(_window_hashes, "w1 long, w2 long, tk long, start long").distinct()
    windows = materialize(windows, "repeat-windows")
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    twice = materialize(twice, "repeat-twice")
    dense = windows.join(twice, ["w1", "w2"]).select("tk", F.col("start").alias("b"), (F.col("start") + LENGTH).alias("e"))
    spans = equal.unionByName(same).unionByName(ranked).unionByName(dense).distinct()
    return spans, held.select("tk", "text"), [hits, kinds, many, need, held, context, windows, twice]


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    rows = renamed(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    prints = materialize(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "repeat-prints")
    for seed in range(100):  # a 64-bit name for each distinct text; another seed if two ever share one
        named = prints.groupBy("sha").agg(F.xxhash64(F.lit(seed), F.first("sha")).alias("tk"))
        if named.groupBy("tk").count().where("count > 1").isEmpty():
            break
    tk = lambda sha: F.xxhash64(F.lit(seed), sha)
    long = rows.where(F.octet_length("text") >= LENGTH).select("id", "text", tk(F.unhex(F.sha2("text", 256))).alias("tk"))
    spans, held, read = repeated_spans(long, most)
    listed = spans.groupBy("tk").agg(F.collect_list(F.struct("b", "e")).alias("spans"))  # at most the anchors of one text
    listed = materialize(listed, "repeat-spans")
    done = held.dropDuplicates(["tk"]).join(listed, "tk").select("tk", "text", "spans").mapInArrow(_cut, "tk long, n_removed long, n_spans long, kept_sha binary")
    done = materialize(done, "repeat-cut")
    discard(listed, *read)
    out = prints.withColumn("tk", tk(F.col("sha"))).join(done, "tk", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.lower(F.hex(F.coalesce("kept_sha", "sha"))).alias("kept_sha256"),
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH bytes AS (
    SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents
), piece AS (
    SELECT doc_id, 512 * c AS o, x[1024 * c + 1 : 1024 * c + 1422] AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 1024 + 1)) AS c FROM bytes)
), start AS (
    SELECT doc_id, o + p AS p, hash(y[2 * p + 1 : 2 * p + 400]) AS h FROM (SELECT doc_id, o, y, unnest(range(0, length(y) // 2 - 199)) AS p FROM piece)
), twice AS (
    SELECT h FROM start GROUP BY h HAVING count(*) > 1
), hit AS (
    SELECT doc_id, p, max(p + 200) OVER w AS upto FROM start SEMI JOIN twice USING (h) WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), run AS (
    SELECT doc_id, p, sum(CASE WHEN upto >= p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit
), gone AS (
    SELECT doc_id, run, min(p) AS b, max(p) + 200 AS e FROM run GROUP BY doc_id, run
), gap AS (
    SELECT doc_id, coalesce(lag(e) OVER w, 0) AS b, b AS e, e AS next FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY b)
), total AS (
    SELECT g.doc_id, sum(next - e)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(x[2 * b + 1 : 2 * e], '' ORDER BY b) || any_value(x)[2 * max(next) + 1 :] AS kept
    FROM gap g JOIN bytes USING (doc_id) GROUP BY g.doc_id
)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM bytes LEFT JOIN total USING (doc_id)
"""
