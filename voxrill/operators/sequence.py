"""Timeline operators: ends, runs, gaps, pairing, chunks, pages, clusters, windows.

Every operator takes ``block``, a monotone function of the order, so that a long
recording is processed block by block (see ``ordered``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrill.functions import scalar as S
from voxrill.operators.ordered import islands, neighbours, scan



def phone_ends(items: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, start: str = "start") -> DataFrame:
    """Interval end = next start; 0.1 s after the start where that is missing or not later.

    Items of unknown start are neighbours like any other but do not appear themselves.
    """
    s = F.col(start)
    out = neighbours(items, keys, order, block, next={"_next": s})
    end = F.when(F.col("_next") > s, F.col("_next")).otherwise(s + 0.1)
    return out.withColumn("end", F.round(end, 3)).withColumn(start, F.round(s, 3)).where(s.isNotNull()).drop("_next")


def weighted_mean(value: Column, start: Column, end: Column, keep: Column | None = None) -> Column:
    """Duration-weighted mean aggregate over known values with positive duration."""
    d = end - start
    ok = value.isNotNull() & (d > 0)
    if keep is not None:
        ok = ok & keep
    return F.sum(F.when(ok, value * d)) / F.nullif(F.sum(F.when(ok, d)), F.lit(0.0))


def char_groups(phones: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, gap_s: float = 0.02, formants: Sequence[str] = ()) -> DataFrame:
    """Merge consecutive phones of one non-empty character less than ``gap_s`` apart.

    A cell has the duration-weighted means of pitch (voiced phones only), score and the named formants.
    """
    joined = (F.col("char") != "") & (F.col("_pc") == F.col("char")) & (F.abs(F.col("_pe") - F.col("start")) < gap_s)
    runs = islands(phones, keys, order, block, {"_pc": F.col("char"), "_pe": F.col("end")}, joined, "cell")
    last = F.struct(*[F.col(o) for o in order])
    st, en = F.col("start"), F.col("end")
    return runs.groupBy(*keys, "cell").agg(
        F.min("start").alias("start"), F.max_by("end", last).alias("end"), F.first("char").alias("char"),
        F.count(F.lit(1)).alias("phones"),
        weighted_mean(F.col("pitch"), st, en, F.col("pitch") > 0).alias("pitch"),
        weighted_mean(F.col("score"), st, en).alias("score"), *[weighted_mean(F.col(f), st, en).alias(f) for f in formants],
    )


def fill_pitch(cells: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Interpolate missing pitch in time between voiced neighbours; hold at the edges; skip spacers."""
    real = F.col("char") != ""
    voiced = real & F.col("pitch").isNotNull()
    out = scan(
        cells, keys, order, block,
        fills={"_p": F.when(voiced, F.struct("pitch", "end"))},
        back_fills={"_n": F.when(voiced, F.struct("pitch", "start"))},
    )
    span = F.col("_n.start") - F.col("_p.end")
    at = F.when(span > 0, S.clamp01((F.col("start") - F.col("_p.end")) / span)).otherwise(F.lit(0.5))
    between = F.col("_p.pitch") + (F.col("_n.pitch") - F.col("_p.pitch")) * at
    filled = F.coalesce(F.col("pitch"), between, F.col("_p.pitch"), F.col("_n.pitch"))
    return out.withColumn("pitch_filled", F.when(real, filled)).drop("_p", "_n")


def merge_runs(items: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Merge consecutive rows of one label; confidence is the duration-weighted mean, clamped.

    Rows without duration are left out before runs are formed.
    """
    rows = items.where(F.col("end") > F.col("start"))
    runs = islands(rows, keys, order, block, {"_pl": F.col("label")}, F.col("_pl") == F.col("label"), "run")
    last = F.struct(*[F.col(o) for o in order])
    d = F.col("end") - F.col("start")
    return runs.groupBy(*keys, "run").agg(
        F.first("label").alias("label"), F.min("start").alias("start"), F.max_by("end", last).alias("end"),
        S.clamp01(F.sum(F.col("confidence") * d) / F.sum(d)).alias("confidence"),
    )


def frame_runs(frames: DataFrame, keys: Sequence[str], block: Column, hop_s: float = 0.02) -> DataFrame:
    """Decoded frames (frame_idx, label_idx, probs) to segments with the mean winning probability."""
    runs = islands(frames, keys, ["frame_idx"], block, {"_pl": F.col("label_idx")}, F.col("_pl") == F.col("label_idx"), "run")
    return runs.groupBy(*keys, "run").agg(
        F.first("label_idx").alias("label_idx"),
        (F.min("frame_idx") * hop_s).alias("start_s"), ((F.max("frame_idx") + 1) * hop_s).alias("end_s"),
        F.avg(F.element_at("probs", F.col("label_idx") + 1)).alias("confidence"),
    )


def locate(points: DataFrame, cells: DataFrame, keys: Sequence[str], block_s: float) -> DataFrame:
    """Cell index holding each point (start <= t < end), NULL outside; cells are disjoint.

    points: (keys, ref, t); cells: (keys, idx, start, end).  An ordered merge,
    not a range join: each point looks at the last cell that has started.
    """
    both = cells.select(*keys, F.col("start").alias("t"), F.lit(0).alias("_o"), F.col("idx").alias("ref"), F.struct("idx", "end").alias("_c")).unionByName(
        points.select(*keys, "t", F.lit(1).alias("_o"), "ref"), allowMissingColumns=True
    )
    out = scan(both, keys, ["t", "_o", "ref"], F.floor(F.col("t") / block_s), fills={"_in": F.col("_c")})
    return out.where("_o = 1").select(*keys, "ref", "t", F.when(F.col("t") < F.col("_in.end"), F.col("_in.idx")).alias("idx"))


def cut_candidates(silences: DataFrame, words: DataFrame, keys: Sequence[str], block_s: float, min_silence_s: float = 0.5) -> DataFrame:
    """Midpoints of long silences that lie strictly inside no word (overlapping words allowed)."""
    mids = silences.where(F.col("end") - F.col("start") >= min_silence_s).select(
        *keys, ((F.col("start") + F.col("end")) / 2).alias("t"), F.lit(0).alias("_o"), F.col("ref")
    )
    both = mids.unionByName(
        words.select(*keys, F.col("start").alias("t"), F.lit(1).alias("_o"), "ref", F.col("end").alias("_e")), allowMissingColumns=True
    )
    out = scan(both, keys, ["t", "_o", "ref"], F.floor(F.col("t") / block_s), maxes={"_reach": F.col("_e")})
    free = F.col("_reach").isNull() | (F.col("_reach") <= F.col("t"))
    return out.where((F.col("_o") == 0) & free).select(*keys, F.col("t").alias("mid"), "ref")


def words_to_chunks(words: DataFrame, chunks: DataFrame, keys: Sequence[str], block_s: float) -> DataFrame:
    """Words per chunk by word midpoint; a recording with an empty chunk is dropped.

    chunks: (keys, chunk, start, end, is_last) contiguous and disjoint; the last
    one also owns a midpoint equal to its end.  Chunks are length-limited, so a
    chunk's transcript fits a row.
    """
    starts = chunks.select(*keys, F.col("start").alias("t"), F.lit(0).alias("_o"), F.col("chunk").alias("ref"), F.struct("chunk", "end", "is_last").alias("_c"))
    mids = words.select(*keys, ((F.col("start") + F.col("end")) / 2).alias("t"), F.lit(1).alias("_o"), "ref", "word")
    out = scan(
        starts.unionByName(mids, allowMissingColumns=True), keys, ["t", "_o", "ref"], F.floor(F.col("t") / block_s), fills={"_in": F.col("_c")}
    )
    inside = (F.col("t") < F.col("_in.end")) | (F.col("_in.is_last") & (F.col("t") <= F.col("_in.end")))
    got = out.where((F.col("_o") == 1) & inside).select(*keys, F.col("_in.chunk").alias("chunk"), "t", "ref", "word")
    texts = got.groupBy(*keys, "chunk").agg(
        F.count(F.lit(1)).alias("word_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "ref", "word"))), lambda x: x["word"]), " ").alias("transcript"),
    )
    full = chunks.join(texts, [*keys, "chunk"], "left")
    empty = full.where(F.col("word_count").isNull()).select(*keys).distinct()
    return full.join(empty, list(keys), "left_anti")


def pair_events(events: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Pair each silence start with the first unused end after it.

    events: (keys, t, is_start, ref).  Walking the timeline, ends are matched to
    open starts first in, first out; an end with nothing open is stray.  The
    stray count is the running deficit of starts, so the i-th start meets the
    i-th end that is not stray, which is an equi join.
    """
    order = ["t", "is_start", "ref"]  # at equal time an end does not close a start
    step = F.when(F.col("is_start"), 1).otherwise(-1)
    depth = scan(events, keys, order, block, sums={"_depth": step, "_starts": F.col("is_start").cast("long"), "_ends": (~F.col("is_start")).cast("long")})
    low = scan(depth, keys, order, block, mins={"_low": F.least(F.col("_depth"), F.lit(0))})
    starts = low.where("is_start").select(*keys, F.col("_starts").alias("pair"), F.col("t").alias("start"))
    prior = neighbours(low, keys, order, block, prev={"_was": F.col("_low")})
    used = (~F.col("is_start")) & (F.col("_low") == F.coalesce("_was", F.lit(0)))
    ends = prior.where(used).select(*keys, (F.col("_ends") + F.col("_low")).alias("pair"), F.col("t").alias("end"))
    return starts.join(ends, [*keys, "pair"]).select(*keys, "pair", "start", "end")


def merge_chunks(words: DataFrame, phones: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shift chunk phones to recording time and recording word numbers.

    A recording is dropped if any chunk has no phones.  A recording has few
    chunks, so the running word count is a small window over chunk rows.
    """
    k = [*keys, "chunk"]
    nw = words.groupBy(*k).agg(F.count(F.lit(1)).alias("_nw"))
    np_ = phones.groupBy(*k).agg(F.count(F.lit(1)).alias("_np"))
    c = chunks.join(nw, k, "left").join(np_, k, "left")
    w = Window.partitionBy(*keys).orderBy("chunk")
    c = c.select(
        *k, "offset",
        F.coalesce(F.sum("_nw").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"),
        F.min(F.coalesce("_np", F.lit(0))).over(Window.partitionBy(*keys)).alias("_least"),
    ).where("_least > 0")
    return phones.join(c, k).select(
        *phones.columns, (F.col("t_local") + F.col("offset")).alias("t"), (F.col("word_local") + F.col("_shift")).alias("word_index")
    )


# --- pages -------------------------------------------------------------------------------


def cell_weight(char: Column) -> Column:
    """Visual width: 1 for one CJK or Hangul character, letters clamped to 2..10 otherwise, 0 for a spacer."""
    single = char.rlike("^[一-鿿㐀-䶿가-힣]$")
    letters = F.regexp_count(char, F.lit("[A-Za-z]"))
    size = F.when(letters > 0, letters).otherwise(F.char_length(char))
    return F.when(F.coalesce(char, F.lit("")) == "", 0).when(single, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(10), size))).cast("int")


def weight_pages(cells: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, budget: int) -> DataFrame:
    """Number the pages of a greedy packing: a page closes before the cell that would overflow it.

    The packing of a block depends on the past only through the weight already
    on the open page, a whole number up to the larger of budget and one cell.
    Each block is summarised for every such weight, the summaries (one row per
    block) are chained along each recording, and each block is then numbered
    from its true carry.  All three passes stream over sorted partitions and
    hold one row of state, never a whole group.
    """
    most = max(budget, 10)
    rows = cells.where(F.col("weight") > 0).select("*", block.alias("_blk"))
    names = [*keys, "_blk"]

    def ddl(df: DataFrame, *, drop=()) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop)

    def sorted_by(df: DataFrame, part: Sequence[str], then: Sequence[str]) -> DataFrame:
        return df.repartition(*[F.col(c) for c in part]).sortWithinPartitions(*part, *then)

    def effect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ends, pages = None, None, None
        for b in batches:
            done = []
            for key, w in zip(b[names].itertuples(index=False, name=None), b["weight"].to_numpy()):
                if key != at:
                    if at is not None:
                        done.append((*at, ends, pages))
                    at, ends, pages = key, np.arange(most + 1), np.zeros(most + 1, dtype=np.int64)
                over = (ends > 0) & (ends + w > budget)
                ends, pages = np.where(over, w, ends + w), pages + over
            yield pd.DataFrame(done, columns=[*names, "ends", "pages"])
        if at is not None:
            yield pd.DataFrame([(*at, ends, pages)], columns=[*names, "ends", "pages"])

    slim = rows.select(*names, *order, "weight")
    shape = ddl(slim.select(*names))
    effects = sorted_by(slim, names, order).mapInPandas(effect, f"{shape}, ends array<bigint>, pages array<bigint>")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, carry, page = None, 0, 0
        for b in batches:
            out = []
            for key, ends, pages in zip(b[names].itertuples(index=False, name=None), b["ends"], b["pages"]):
                if key[:-1] != at:
                    at, carry, page = key[:-1], 0, 0
                out.append((*key, carry, page))
                carry, page = int(ends[carry]), page + int(pages[carry])
            yield pd.DataFrame(out, columns=[*names, "carry", "page0"])

    entry = sorted_by(effects, keys, ["_blk"]).mapInPandas(chain, f"{shape}, carry bigint, page0 bigint")

    joined = rows.join(entry, names)
    keep = [c for c in rows.columns if c != "_blk"]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, carry, page = None, 0, 0
        for b in batches:
            out = []
            for key, w, c0, p0 in zip(b[names].itertuples(index=False, name=None), b["weight"], b["carry"], b["page0"]):
                if key != at:
                    at, carry, page = key, c0, p0
                if carry and carry + w > budget:
                    page, carry = page + 1, 0
                carry += w
                out.append(page)
            yield b[keep].assign(page=out)

    return sorted_by(joined, names, order).mapInPandas(number, f"{ddl(rows, drop=('_blk',))}, page bigint")


# --- chunk planning -------------------------------------------------------------------------


def best_cuts(cuts: list[float], total: float, n: int, lo: float, hi: float) -> list[float] | None:
    """The n-1 cuts with the shortest longest chunk, then the least spread; fewer chunks if impossible.

    Two small tables over (chunks left, position) replace trying every subset:
    the first finds the best longest chunk, the second the largest shortest
    chunk that it allows.  Equal plans resolve to the earliest cuts.
    """
    pts = [0.0, *sorted(cuts), total]
    last, eps = len(pts) - 1, 1e-6
    for parts in range(min(n, len(cuts) + 1), 1, -1):
        def solve(limit: float, better, worst: float, start: float, combine):
            best = {last: start}
            table = []
            for _ in range(parts):
                nxt = {}
                for i in range(last):
                    opts = [
                        combine(best[j], pts[j] - pts[i]) for j in best
                        if j > i and lo <= pts[j] - pts[i] <= limit
                    ]
                    if opts:
                        nxt[i] = better(opts)
                table.append(best)
                best = nxt
            return best.get(0, worst), table

        longest, _ = solve(hi, min, float("inf"), 0.0, max)
        if longest == float("inf"):
            continue
        limit = longest + eps
        shortest, table = solve(limit, max, -1.0, float("inf"), min)
        plan, i = [], 0
        for step in range(parts - 1, 0, -1):
            reach = table[step]
            i = next(
                j for j in range(i + 1, last)
                if j in reach and lo <= pts[j] - pts[i] <= limit and min(reach[j], pts[j] - pts[i]) >= shortest - 1e-12
            )
            plan.append(pts[i])
        return plan
    return None


def chunkable(words: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Recordings whose word timings can be trusted: two words and two positive gaps; with their duration."""
    g = neighbours(words, keys, ["start", "ref"], block, prev={"_pe": F.col("end")})
    a = g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("start") > F.col("_pe")).alias("_gaps"), F.max("end").alias("duration_s")
    )
    return a.where("_n >= 2 AND _gaps >= 2").select(*keys, "duration_s")


def plan_chunks(
    candidates: DataFrame, recordings: DataFrame, keys: Sequence[str],
    min_s: float = 3.0, max_s: float = 20.0, target_s: float = 10.0, max_chunks: int = 8,
) -> DataFrame:
    """Balanced chunks per recording: (keys, chunk, start, end, is_last).

    No plan exists for a recording longer than ``max_chunks * max_s`` or shorter
    than two minimal chunks, so both are filtered out first; that also bounds
    the rows of the group handed to the solver.  recordings: (keys, duration_s).
    """
    fit = recordings.where((F.col("duration_s") >= 2 * min_s) & (F.col("duration_s") <= max_chunks * max_s))
    rows = candidates.select(*keys, "mid").join(fit.select(*keys, "duration_s"), list(keys))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = float(pdf["duration_s"].iloc[0])
        want = min(max_chunks, max(2, int(total // max(target_s, min_s))), len(pdf) + 1)
        cuts = best_cuts(pdf["mid"].tolist(), total, want, min_s, max_s)
        edges = [0.0, *(cuts or []), total]
        out = pd.DataFrame({"chunk": range(len(edges) - 1), "start": edges[:-1], "end": edges[1:]})
        out["is_last"] = out["chunk"] == len(out) - 1
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out if cuts else out.iloc[:0]

    return rows.groupBy(*keys).applyInPandas(solve, f"{schema}, chunk int, start double, end double, is_last boolean")


# --- layout, retention, windows ----------------------------------------------------------------


def gap_clusters(points: DataFrame, keys: Sequence[str], y: str, idx: str, gap: float, y_block: float, idx_block: float) -> DataFrame:
    """Cluster values closer than ``gap`` to the next one and split each cluster's width equally."""
    near = F.col(y) - F.col("_py") < gap
    c = islands(points, keys, [y, idx], F.floor(F.col(y) / y_block), {"_py": F.col(y)}, near, "cluster")
    size = c.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    placed = scan(c, [*keys, "cluster"], [idx], F.floor(F.col(idx) / idx_block), sums={"slot": F.lit(1)})
    return placed.join(size, [*keys, "cluster"]).withColumn("slot", F.col("slot") - 1)


def newest(rows: DataFrame, keys: Sequence[str], at: str, tie: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows per key; the per-task limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def within_budget(rows: DataFrame, keys: Sequence[str], at: str, tie: str, size: Column, budget: float, block: Column) -> DataFrame:
    """Newest rows whose running size stays within ``budget``; ``block`` falls as ``at`` rises."""
    neg = rows.withColumn("_at", -F.col(at)).withColumn("_tie", -F.col(tie))
    out = scan(neg, keys, ["_at", "_tie"], block, sums={"used": size})
    return out.where(F.col("used") <= budget).drop("_at", "_tie")


def pane_windows(
    frames: DataFrame, recordings: DataFrame, keys: Sequence[str], lengths: Sequence[int], step_s: float, min_count: int, duration: str = "dur",
) -> DataFrame:
    """(keys, length_s, win, n, median) of every full window of every length, one step apart.

    frames: (keys, t, f0), voiced ones; recordings: (keys, duration). Frames are counted once, by value, in panes
    of one step; windows of all lengths are put together from the same panes, so what is multiplied are counts,
    not frames. A window with fewer than ``min_count`` values has no median; one without any has n = 0.
    """
    if any(round(n / step_s) * step_s != n for n in lengths):
        raise ValueError("a window is a whole number of steps long")
    pane = F.floor(F.col("t") / step_s).cast("long")
    counts = frames.where(F.col("f0").isNotNull()).groupBy(*keys, pane.alias("_pane"), "f0").agg(F.count(F.lit(1)).alias("_c"))
    last = lambda n: F.floor((F.col(duration) - n) / step_s).cast("long")
    # Every window once without a value, so that silent ones are there too.
    spans = F.array(*[F.struct(F.lit(n).alias("length_s"), last(n).alias("last"), F.lit(round(n / step_s)).cast("long").alias("panes")) for n in lengths])
    each = recordings.select(*keys, F.explode(spans).alias("_l")).where("_l.last >= 0")
    empty = each.select(*keys, "_l.length_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_l.last"))).alias("win"), F.lit(None).cast("double").alias("f0"), F.lit(1).cast("long").alias("_c"))
    spread = counts.select(*keys, "_pane", "f0", "_c", F.explode(F.lit(list(lengths))).alias("length_s"))
    first = F.greatest(F.lit(0).cast("long"), F.col("_pane") - F.round(F.col("length_s") / step_s).cast("long") + 1)
    filled = spread.select(*keys, "length_s", F.explode(F.sequence(first, F.col("_pane"))).alias("win"), "f0", "_c")
    both = empty.withColumn("_full", F.lit(True)).unionByName(filled.withColumn("_full", F.lit(False)))
    n = F.coalesce(F.sum(F.when(F.col("f0").isNotNull(), F.col("_c"))), F.lit(0))
    # A window holds no more values than its length has frames, so it fits the built-in aggregate. Windows past the end have no row of their own.
    out = both.groupBy(*keys, "length_s", "win").agg(n.alias("n"), F.percentile("f0", 0.5, F.col("_c")).alias("_m"), F.max("_full").alias("_full"))
    return out.where("_full").select(*keys, "length_s", "win", "n", F.when(F.col("n") >= min_count, F.col("_m")).alias("median"))
