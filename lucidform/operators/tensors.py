"""Matrices and tensors held as tables of (index.., v), and spectra of small ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucidform.functions.formulas import sanitize_array


def group_gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, i, j, v, n): sums of products per group, i and j 0-based column numbers.

    One aggregate with map-side partial sums, so a large group is spread over
    all tasks.  For wide tables use ``group_gram_wide``.
    """
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in pairs]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    cell = lambda i, j, s: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(s).alias("v"))
    cells = []
    for i, j in pairs:
        cells.append(cell(i, j, f"s{i}_{j}"))
        if i != j:
            cells.append(cell(j, i, f"s{i}_{j}"))
    return g.select(*keys, "n", F.explode(F.array(*cells)).alias("c")).select(*keys, "c.i", "c.j", "c.v", "n")


def group_gram_wide(df: DataFrame, key: str, columns: Sequence[str], flush: int = 256) -> DataFrame:
    """The same for many columns and one key: outer products of Arrow batches.

    A task holds at most ``flush`` group matrices and sends them on when more
    appear; Spark adds up what the tasks sent.
    """
    d = len(columns)
    src = df.select(F.col(key).cast("string").alias("k"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    rows_i, rows_j = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(d), np.arange(d), indexing="ij"))

    def batch(acc: dict) -> pa.RecordBatch:
        ks = list(acc)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(ks, dtype=object), d * d), type=pa.string()),
                pa.array(np.tile(rows_i, len(ks))),
                pa.array(np.tile(rows_j, len(ks))),
                pa.array(np.concatenate([acc[k][0].ravel() for k in ks])),
                pa.array(np.repeat(np.array([acc[k][1] for k in ks], dtype=np.int64), d * d)),
            ],
            names=["k", "i", "j", "v", "n"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            x = np.column_stack([sanitize_array(b.column(i + 1).to_numpy(zero_copy_only=False)) for i in range(d)])
            codes, names = pd.factorize(b.column(0).to_pandas())
            order = np.argsort(codes, kind="stable")
            starts = np.r_[0, np.nonzero(np.diff(codes[order]))[0] + 1, len(order)]
            for lo, hi in zip(starts[:-1], starts[1:]):
                part = x[order[lo:hi]]
                k = names[codes[order[lo]]]
                m, n = acc.get(k, (0.0, 0))
                acc[k] = (m + part.T @ part, n + hi - lo)
            if len(acc) > flush:
                yield batch(acc)
                acc = {}
        if acc:
            yield batch(acc)

    out = src.mapInArrow(task, "k string, i int, j int, v double, n long")
    return out.groupBy("k", "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def spectrum(cells: DataFrame, keys: Sequence[str], symmetric: bool = True) -> DataFrame:
    """(keys, sv, eigs, failed): singular values and eigenvalues per small matrix.

    ``cells`` are (keys, i, j, v) with the entries of one matrix per key: the
    group a task sees is one matrix, not the table rows behind it.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema.fields)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        m = np.zeros((n, n))
        np.add.at(m, (pdf["i"].to_numpy(), pdf["j"].to_numpy()), pdf["v"].to_numpy())
        head = {k: [pdf[k].iloc[0]] for k in keys}
        try:
            sv = np.linalg.svd(m, compute_uv=False)
            eigs = np.linalg.eigvalsh(m) if symmetric else np.zeros(0)
            return pd.DataFrame({**head, "sv": [sv.tolist()], "eigs": [eigs.tolist()], "failed": [False]})
        except np.linalg.LinAlgError:
            return pd.DataFrame({**head, "sv": [[]], "eigs": [[]], "failed": [True]})

    return cells.select(*keys, "i", "j", "v").groupBy(*keys).applyInPandas(
        solve, f"{schema}, sv array<double>, eigs array<double>, failed boolean"
    )


#: Entries of one combination of the other modes that meet in one piece; larger ones are split into blocks of so many.
BLOCK = 1024


def _outer(rows: pa.RecordBatch, keep: Sequence[str], keys: Sequence[str], starts: np.ndarray) -> pa.Table:
    """Products of all pairs of entries inside the groups that begin at ``starts``, added up by (keys, a.., b..)."""
    sizes = np.diff(np.append(starts, rows.num_rows))
    each = np.repeat(sizes, sizes)
    left = np.repeat(np.arange(rows.num_rows), each)
    right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(starts, sizes), each)
    own, cross = rows.column("_own").to_numpy(), rows.column("_cross").to_numpy(zero_copy_only=False)
    ok = ~cross[left] | (own[left] != own[right])  # two blocks meet: only pairs across
    left, right = left[ok], right[ok]
    v = rows.column("v").to_numpy()
    cols = {k: rows.column(k).take(pa.array(left)) for k in keys}
    for m in keep:
        cols |= {f"{m}_a": rows.column(m).take(pa.array(left)), f"{m}_b": rows.column(m).take(pa.array(right))}
    table = pa.table({**cols, "v": pa.array(v[left] * v[right])})
    return table.group_by(list(cols)).aggregate([("v", "sum")]).rename_columns([*cols, "v"])


def mode_gram(coo: DataFrame, modes: Sequence[str], keep: Sequence[str], keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(keys, a.., b.., v): the unfolding of the tensor along ``keep`` times its transpose.

    Entries with the same index are added first.  Entries are then brought together by the other modes and multiplied
    where they meet, so only sums of products are shuffled again.  A combination of the other modes with more than
    ``block`` entries, by count, is split into blocks, and every two blocks meet in a group of their own.
    """
    rest = [m for m in modes if m not in keep]
    on, order = [*keys, *rest], [*keys, *keep]
    t = coo.groupBy(*keys, *modes).agg(F.sum("v").cast("double").alias("v"))
    key = F.struct(*on) if on else F.struct(F.lit(0))
    t = t.select(*order, "v", F.xxhash64(key).alias("_g1"), F.xxhash64(F.lit(1), key).alias("_g2"))
    many = t.groupBy("_g1", "_g2").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")).where("_blocks > 1")
    t = t.join(many, ["_g1", "_g2"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    t = t.withColumn("_own", F.pmod(F.xxhash64(*keep, F.lit(2)), F.col("_blocks")).cast("int"))
    t = t.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    t = t.withColumns({"_x": F.least("_own", "_other"), "_y": F.greatest("_own", "_other"), "_cross": F.col("_own") != F.col("_other")})
    group = ["_g1", "_g2", "_x", "_y"]
    rows = t.select(*group, *order, "v", "_own", "_cross").repartition(*group).sortWithinPartitions(*group)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"`{m}_{s}` {types[m]}" for m in keep for s in "ab"), "v double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            cols = [held.column(c).to_numpy() for c in group]
            starts = np.append(0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1)
            yield from pieces(held.slice(0, starts[-1]), starts[:-1])
            held = held.slice(starts[-1])  # may go on in the next batch
        if held is not None:
            yield from pieces(held, np.zeros(1, dtype=np.int64))

    def pieces(rows: pa.RecordBatch, starts: np.ndarray, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, rows.num_rows))
        work, lo = np.cumsum(sizes.astype(np.int64) ** 2), 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + most, side="right")))
            end = starts[hi] if hi < len(starts) else rows.num_rows
            yield from _outer(rows.slice(starts[lo], end - starts[lo]), keep, keys, starts[lo:hi] - starts[lo]).to_batches()
            lo = hi

    idx = [f"{m}_{s}" for m in keep for s in "ab"]
    return rows.mapInArrow(run, schema).groupBy(*keys, *idx).agg(F.sum("v").alias("v"))


def block_norms(cells: DataFrame, keys: Sequence[str], block: Column, block_col: Column) -> DataFrame:
    """(keys, bi, bj, norm, rel): Frobenius norm of each block and its ratio to max |v|."""
    d = cells.withColumn("bi", block).withColumn("bj", block_col)
    n = d.groupBy(*keys, "bi", "bj").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.max(F.abs("v")).alias("_m"))
    scale = F.max("_m").over(Window.partitionBy(*keys))  # one row per block
    return n.withColumn("rel", F.col("norm") / F.when(scale < 1e-30, F.lit(1.0)).otherwise(scale)).drop("_m")


def block_structure(norms: DataFrame, keys: Sequence[str], threshold: float = 1e-6) -> DataFrame:
    """(keys, cross, is_block_diagonal) from block norms: off-diagonal blocks against the threshold."""
    off = F.max(F.when(F.col("bi") != F.col("bj"), F.col("rel")).otherwise(F.lit(0.0)))
    return norms.groupBy(*keys).agg(off.alias("cross")).withColumn("is_block_diagonal", F.col("cross") < threshold)


def body_structure(cells: DataFrame, keys: Sequence[str], kind: tuple[Column, Column], body: tuple[Column, Column], threshold: float = 1e-6) -> DataFrame:
    """(keys, cross, coupling, is_block_diagonal, is_separable) of a matrix whose rows and
    columns each have a kind and a body: the largest norm, relative to max |v|, of a block
    between bodies of one kind, and of a block between kinds."""
    parts = cells.select(*keys, "v", *[c.alias(n) for n, c in zip(("_k1", "_k2", "_b1", "_b2"), (*kind, *body))])
    blocks = parts.groupBy(*keys, "_k1", "_k2", "_b1", "_b2").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_f"), F.max(F.abs("v")).alias("_m"))
    same = F.col("_k1") == F.col("_k2")
    out = blocks.groupBy(*keys).agg(
        F.max("_m").alias("_s"),
        F.coalesce(F.max(F.when(same & (F.col("_b1") != F.col("_b2")), F.col("_f"))), F.lit(0.0)).alias("_c"),
        F.coalesce(F.max(F.when(~same, F.col("_f"))), F.lit(0.0)).alias("_q"),
    )
    scale = F.when(F.col("_s") < 1e-30, F.lit(1.0)).otherwise(F.col("_s"))
    out = out.withColumns({"cross": F.col("_c") / scale, "coupling": F.col("_q") / scale}).drop("_s", "_c", "_q")
    flat = F.col("cross") < threshold
    return out.withColumn("is_block_diagonal", flat).withColumn("is_separable", flat & (F.col("coupling") < threshold))


def mode_symmetry(coo: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, symmetry): 1 - |S - S'| / |S| of the matrix S over two modes, summed over all others."""
    s = coo.groupBy(*keys, a, b).agg(F.sum("v").alias("v"))
    turned = s.select(*keys, F.col(a).alias(b), F.col(b).alias(a), (-F.col("v")).alias("v"))
    both = s.withColumn("own", F.col("v")).unionByName(turned.withColumn("own", F.lit(0.0)))
    cells = both.groupBy(*keys, a, b).agg(F.sum("v").alias("_d"), F.sum("own").alias("_v"))
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    return cells.groupBy(*keys).agg((F.lit(1.0) - norm("_d") / (norm("_v") + 1e-30)).alias("symmetry"))


def exchange_symmetry(coo: DataFrame, swap: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, symmetry): 1 - |T - T'| / (2 |T|) where T' has the given modes exchanged."""
    modes = [*swap, *swap.values()]
    t = coo.groupBy(*keys, *modes).agg(F.sum("v").alias("v"))
    back = {**swap, **{b: a for a, b in swap.items()}}
    s = t.select(*keys, *[F.col(back[m]).alias(m) for m in modes], F.col("v").alias("w"))
    j = t.join(s, [*keys, *modes], "full_outer")
    v, w = F.coalesce("v", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
    norm = F.sqrt(F.sum(v * v))
    diff = F.sqrt(F.sum((v - w) * (v - w)))
    return j.groupBy(*keys).agg(norm.alias("_n"), diff.alias("_d")).select(
        *keys, F.when(F.col("_n") > 1e-30, F.lit(1.0) - F.col("_d") / (F.lit(2.0) * F.col("_n"))).otherwise(F.lit(0.0)).alias("symmetry")
    )


def decoupling(coo: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, decoupling): 1 - share of the norm where the two modes differ."""
    v2 = F.col("v") * F.col("v")
    return coo.groupBy(*keys).agg(
        (F.lit(1.0) - F.sqrt(F.sum(F.when(F.col(a) < F.col(b), v2).otherwise(F.lit(0.0)))) / (F.sqrt(F.sum(v2)) + 1e-30)).alias("decoupling")
    )


def invariants(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, tr1, tr2, tr3, frobenius) of square matrices by sums and self-joins."""
    k = list(keys)
    one = cells.groupBy(*k).agg(
        F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(F.lit(0.0))).alias("tr1"),
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("frobenius"),
    )
    a = cells.select(*k, F.col("i").alias("p"), F.col("j").alias("q"), F.col("v").alias("va"))
    b = cells.select(*k, F.col("i").alias("q"), F.col("j").alias("r"), F.col("v").alias("vb"))
    sq = a.join(b, [*k, "q"]).groupBy(*k, "p", "r").agg(F.sum(F.col("va") * F.col("vb")).alias("w"))
    c = cells.select(*k, F.col("i").alias("r"), F.col("j").alias("p"), F.col("v").alias("vc"))
    two = sq.groupBy(*k).agg(F.sum(F.when(F.col("p") == F.col("r"), F.col("w")).otherwise(F.lit(0.0))).alias("tr2"))
    three = sq.join(c, [*k, "p", "r"]).groupBy(*k).agg(F.sum(F.col("w") * F.col("vc")).alias("tr3"))
    return one.join(two, k).join(three, k)


def unflatten_index(flat: Column, shape: Sequence[int]) -> list[Column]:
    """Mixed-radix digits of a flat index, last mode fastest."""
    out, left = [], flat
    for n in reversed(shape):
        out.append(F.pmod(left, F.lit(n)).cast("int"))
        left = F.floor(left / n)
    return list(reversed(out))


def flatten_index(digits: Sequence[Column], shape: Sequence[int]) -> Column:
    return reduce(lambda acc, x: acc * x[1] + x[0], zip(digits, shape), F.lit(0)).cast("int")


#: Modes up to this size have their Gram matrix on the driver; larger ones a block of a few columns.
GRAM_SIZE = 512
BLOCK_COLUMNS, BLOCK_ROUNDS = 16, 40


def _unfolded_twice(t: DataFrame, modes: Sequence[str], m: str, v: np.ndarray) -> np.ndarray:
    """The unfolding along ``m`` times its transpose times ``v``: two sparse products as aggregates.

    The columns of ``v`` (mode size times a few) are broadcast, and as many numbers come back.
    """
    rest, k = [x for x in modes if x != m], v.shape[1]
    table = pa.table({m: pa.array(np.arange(len(v)), pa.int32()), **{f"_c{j}": pa.array(v[:, j]) for j in range(k)}})
    left = t.join(F.broadcast(t.sparkSession.createDataFrame(table)), m)
    inner = left.groupBy(*rest).agg(*[F.sum(F.col("v") * F.col(f"_c{j}")).alias(f"_z{j}") for j in range(k)])
    out = t.join(inner, rest).groupBy(m).agg(*[F.sum(F.col("v") * F.col(f"_z{j}")).alias(f"_z{j}") for j in range(k)]).toArrow()
    w = np.zeros_like(v)
    w[out.column(m).to_numpy()] = np.stack([out.column(f"_z{j}").to_numpy() for j in range(k)], axis=1)
    return w


def leading_directions(multiply, size: int, columns: int, rounds: int = BLOCK_ROUNDS, tolerance: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of a symmetric matrix and their vectors by block power iterations, from products with
    ``columns`` vectors alone: a QR of that many columns a round, and a small matrix that turns them at the end."""
    q = np.linalg.qr(np.random.default_rng(42).standard_normal((size, columns)))[0]
    before = np.zeros(columns)
    for _ in range(rounds):
        w = multiply(q)
        values, turn = np.linalg.eigh((q.T @ w + w.T @ q) / 2)
        order = np.argsort(values)[::-1]
        values, vectors = values[order], q @ turn[:, order]
        if np.abs(values - before).max() <= tolerance * max(values[0], 1e-300):
            break
        before, q = values, np.linalg.qr(w)[0]
    return np.maximum(values, 0.0), vectors


def hosvd_factors(coo: DataFrame, modes: Sequence[str], sizes: Sequence[int], share: float = 0.99) -> dict[str, tuple[np.ndarray, int]]:
    """Per mode: leading vectors of the unfolding and the rank that keeps ``share``.

    A mode of up to GRAM_SIZE has its Gram matrix on the driver.  A larger one sends a block of columns, doubled until
    the share is reached; the whole is the sum of squares of the entries.
    """
    out = {}
    t = coo.groupBy(*modes).agg(F.sum("v").cast("double").alias("v")).persist()
    try:
        total = t.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
        for m, n in zip(modes, sizes):
            if n <= GRAM_SIZE:
                g = np.zeros((n, n))
                for r in mode_gram(t, modes, [m]).toLocalIterator():
                    g[r[f"{m}_a"], r[f"{m}_b"]] = r["v"]
                w, u = np.linalg.eigh(g)
                w, u = np.maximum(w[::-1], 0.0), u[:, ::-1]
            else:
                k = BLOCK_COLUMNS
                while True:
                    w, u = leading_directions(lambda v, m=m: _unfolded_twice(t, modes, m, v), n, min(k, n))
                    if k >= n or w[: max(1, k - 4)].sum() >= share * total:
                        break
                    k *= 2
            u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
            rank = int(np.searchsorted(np.cumsum(w), share * total) + 1) if total > 0 else 1
            out[m] = (u, min(rank, u.shape[1]))
    finally:
        t.unpersist()
    return out


def hosvd_core(coo: DataFrame, modes: Sequence[str], factors: dict[str, tuple[np.ndarray, int]]) -> DataFrame:
    """(modes, v): the core tensor, by joining the entries with each factor table."""
    spark = coo.sparkSession
    cur = coo.groupBy(*modes).agg(F.sum("v").alias("v"))
    for m in modes:
        u, r = factors[m]
        f = spark.createDataFrame(
            [(i, k, float(u[i, k])) for i in range(u.shape[0]) for k in range(r)], f"{m} int, _k int, _u double"
        )
        rest = [x for x in modes if x != m]
        cur = cur.join(F.broadcast(f), m).groupBy(*rest, F.col("_k").alias(m)).agg(F.sum(F.col("v") * F.col("_u")).alias("v"))
    return cur.select(*modes, "v")


def core_sparsity(core: DataFrame, share: float = 0.01) -> DataFrame:
    """(total, small, sparsity): entries below ``share`` of the largest."""
    top = core.agg(F.max(F.abs("v")).alias("_t"))
    return core.crossJoin(F.broadcast(top)).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.abs("v") < F.lit(share) * F.col("_t"), 1).otherwise(0)).alias("small"),
    ).withColumn("sparsity", F.col("small") / F.col("total"))


def laplacian(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, re, im): admittance matrix from edges (src, dst, r, x, b).

    An edge contributes four stamps; the sums are partial before the shuffle, so
    a hub node is no bottleneck.
    """
    e = edges.where(F.abs("r") + F.abs("x") >= 1e-20)
    den = F.col("r") * F.col("r") + F.col("x") * F.col("x")
    e = e.withColumns({"g": F.col("r") / den, "s": -F.col("x") / den})

    def stamp(i: str, j: str, re: Column, im: Column) -> Column:
        return F.struct(F.col(i).alias("i"), F.col(j).alias("j"), re.alias("re"), im.alias("im"))

    half = F.col("b") / 2.0
    stamps = F.array(
        stamp("src", "dst", -F.col("g"), -F.col("s")),
        stamp("dst", "src", -F.col("g"), -F.col("s")),
        stamp("src", "src", F.col("g"), F.col("s") + half),
        stamp("dst", "dst", F.col("g"), F.col("s") + half),
    )
    return (
        e.select(*keys, F.explode(stamps).alias("c"))
        .select(*keys, "c.*")
        .groupBy(*keys, "i", "j")
        .agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    )


def scenario_sweep(edges: DataFrame, scales: Sequence[float]) -> DataFrame:
    """Edges times impedance scales, with the scale as a key."""
    s = edges.sparkSession.createDataFrame([(float(x),) for x in scales], "scale double")
    return edges.crossJoin(F.broadcast(s)).withColumns({"r": F.col("r") * F.col("scale"), "x": F.col("x") * F.col("scale")})


def leave_one_edge_out(edges: DataFrame, sums: Sequence[str], every: int = 4) -> DataFrame:
    """(dropped, edges, sums..) of what is left without each ``every``-th edge (by
    ``edge_id``): totals minus the edge, so a scenario costs one row."""
    total = edges.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums])
    dropped = edges.where(F.pmod(F.col("edge_id"), F.lit(every)) == 0).crossJoin(F.broadcast(total))  # one row
    return dropped.select(F.col("edge_id").alias("dropped"), (F.col("_n") - 1).alias("edges"), *[(F.col(f"_{c}") - F.coalesce(c, F.lit(0.0))).alias(c) for c in sums])


def leave_one_out_stamps(edges: DataFrame, every: int = 4) -> DataFrame:
    """(dropped, i, j, re, im): the entries of the admittance matrix that dropping an
    edge changes, as they are then; all others are those of ``laplacian``."""
    whole = laplacian(edges).select("i", "j", F.col("re").alias("_re"), F.col("im").alias("_im"))
    own = laplacian(edges.where(F.pmod(F.col("edge_id"), F.lit(every)) == 0).withColumn("dropped", F.col("edge_id")), ["dropped"])
    return own.join(whole, ["i", "j"]).select("dropped", "i", "j", (F.col("_re") - F.col("re")).alias("re"), (F.col("_im") - F.col("im")).alias("im"))


def bootstrap_weights(df: DataFrame, rid: Column, replicates: int, seed: int = 42) -> DataFrame:
    """Rows times replicates with Poisson(1) counts drawn from the row identity."""
    from lucidform.sources.grids import uniform

    d = df.withColumn("replicate", F.explode(F.array(*[F.lit(i) for i in range(replicates)])))
    u = uniform(seed, F.concat_ws("/", rid, "replicate"))
    # Cumulative Poisson(1) probabilities for 0, 1, 2, ...
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]
    w = reduce(lambda acc, c: acc + F.when(F.col("_u") >= c, 1).otherwise(0), cdf, F.lit(0))
    return d.withColumn("_u", u).withColumn("weight", w).where(F.col("weight") > 0).drop("_u")
