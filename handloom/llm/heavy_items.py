"""Most frequent codes of a huge column in bounded memory: code-based identification.

A code is hashed to one of G groups, in R repetitions. Its 66 bits are 11 symbols of 6 bits, lengthened by a
Reed-Solomon code over GF(64) to 15. Per (repetition, group, position, symbol) the weight is tracked; every partition
keeps only symbols that are heavy in their group. A code that is heavy over all leaves a heavy symbol at each position
of its group; those are decoded, two wrong symbols being corrected, and the candidates are counted exactly.

Completeness is proved, not assumed: a code of weight phi * total that was not found would leave its group, in every
repetition, with at least that much weight beyond the candidates'. Where such groups remain in all repetitions, another
round over their rows alone, with other hashes, follows; after ``ROUNDS`` the few rows still open are counted outright.

Memory per task: R * G * 15 * 64 counters of 8 bytes, and a third of that again while adding. G is 4 / phi, but at most
``MOST_GROUPS``, so a task stays under 150 MB however small the share: more codes then fall into a group, and more rounds
follow. To the driver come only groups over the threshold, at most R / phi.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handloom.functions.codes import legacy_code, plain_code
from handloom.runtime import materialise, sendable

SYMBOLS, DATA, LENGTH = 64, 11, 15
REPEATS = 3
ROUNDS = 6
MOST_GROUPS = 4096
#: Rows for each group that a task counts, where there are so many: noise then stays below KEEP and is not passed on.
ROWS_PER_GROUP = 2048
#: A partition passes on symbols of at least this part of their group's weight there.
KEEP = 1 / 16
BUFFER_ROWS = 200_000


def _field() -> tuple[np.ndarray, np.ndarray]:
    """Powers and logarithms in GF(64), modulus x^6 + x + 1."""
    powers, logs, x = np.zeros(126, np.int64), np.zeros(64, np.int64), 1
    for i in range(63):
        powers[i] = powers[i + 63] = x
        logs[x] = i
        x <<= 1
        if x & 64:
            x ^= 0b1000011
    return powers, logs


POWERS, LOGS = _field()


def times(a, b):
    a, b = np.asarray(a), np.asarray(b)
    return np.where((a == 0) | (b == 0), 0, POWERS[LOGS[a] + LOGS[b]])


def _parity_matrix() -> np.ndarray:
    """Parity symbols of each unit message: remainders by the generator with roots 1, a, a^2, a^3."""
    gen = np.array([1])
    for r in range(LENGTH - DATA):
        gen = np.append(gen, 0) ^ np.append(0, times(gen, POWERS[r]))
    rows = []
    for j in range(DATA):
        word = np.zeros(LENGTH, np.int64)
        word[j] = 1
        for i in range(DATA):
            if word[i]:
                word[i : i + len(gen)] ^= times(gen, word[i])
        rows.append(word[DATA:])
    return np.array(rows)


PARITY = _parity_matrix()
TIMES = times(np.arange(64)[:, None], np.arange(64)[None, :]).astype(np.uint8)


def encode(bend: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Codes as rows of 15 symbols."""
    out = np.empty((len(bend), LENGTH), np.uint8)
    for j in range(7):
        out[:, j] = (bend >> (6 * j)) & 63
    out[:, 7] = ((bend >> 42) & 7) | ((spread & 7) << 3)
    for j in range(8, DATA):
        out[:, j] = (spread >> (3 + 6 * (j - 8))) & 63
    for p in range(LENGTH - DATA):
        out[:, DATA + p] = np.bitwise_xor.reduce(TIMES[PARITY[:, p][None, :], out[:, :DATA]], axis=1)
    return out


def _message(word: np.ndarray) -> tuple[int, int]:
    low = sum(int(word[j]) << (6 * j) for j in range(7)) | ((int(word[7]) & 7) << 42)
    high = (int(word[7]) >> 3) | sum(int(word[j]) << (3 + 6 * (j - 8)) for j in range(8, DATA))
    return low, high


def _syndromes(word: np.ndarray) -> list[int]:
    """Values at the generator's roots; position j stands for the power LENGTH - 1 - j."""
    return [int(np.bitwise_xor.reduce(times(word, POWERS[(r * np.arange(LENGTH - 1, -1, -1)) % 63]))) for r in range(4)]


def correct(word: np.ndarray) -> np.ndarray | None:
    """The code word within two symbols of ``word``, or None."""
    s = _syndromes(word)
    if not any(s):
        return word
    inverse = lambda v: int(POWERS[(63 - LOGS[v]) % 63])
    for i in range(LENGTH):
        x = int(POWERS[LENGTH - 1 - i])
        if s[0] and all(int(times(s[k], x)) == s[k + 1] for k in range(3)):
            fixed = word.copy()
            fixed[i] ^= s[0]
            return fixed
        for j in range(i + 1, LENGTH):
            y = int(POWERS[LENGTH - 1 - j])
            b = int(times(s[1] ^ int(times(s[0], x)), inverse(x ^ y)))
            a = s[0] ^ b
            if all(
                int(times(a, POWERS[(LOGS[x] * k) % 63])) ^ int(times(b, POWERS[(LOGS[y] * k) % 63])) == s[k] for k in (2, 3)
            ):
                fixed = word.copy()
                fixed[i] ^= a
                fixed[j] ^= b
                return fixed
    return None


_BASE64 = np.full(256, 64, np.uint8)
_BASE64[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)] = np.arange(64)
BITS = 66


def _texts(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """The bytes of texts that are all of ``size`` bytes, a row each."""
    data = column.take(pa.array(rows)).cast(pa.large_binary())
    start = data.offset * size
    flat = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    first = int(np.frombuffer(data.buffers()[1], np.int64)[data.offset]) if len(rows) else start
    return flat[first : first + len(rows) * size].reshape(-1, size)


def _numbers(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(m_bend, m_spread) of rows of 66 bits."""
    wide = np.zeros((len(bits), 128), np.uint8)
    wide[:, :45], wide[:, 64:85] = bits[:, :45], bits[:, 45:]
    pair = np.packbits(wide, axis=1, bitorder="little").view(np.int64)
    return pair[:, 0], pair[:, 1]


def decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a whole code in either form, m_bend, m_spread)."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.nonzero(size == BITS)[0]
    plain = _texts(column, at, BITS) - ord("0")
    good = (plain <= 1).all(axis=1)
    rows, bits = [at[good]], [plain[good]]
    at = np.nonzero(size == 13)[0]
    old = _texts(column, at, 13)
    sextets = _BASE64[old[:, :12]]
    good = (sextets < 64).all(axis=1) & (old[:, 12] == ord("\n"))
    at, sextets = at[good], sextets[good]
    eights = np.unpackbits(sextets, axis=1).reshape(-1, 12, 8)[:, :, 2:].reshape(-1, 9, 8)[:, :, ::-1].reshape(-1, 72)
    good = ~eights[:, BITS:].any(axis=1)
    rows.append(at[good])
    bits.append(eights[good][:, :BITS])
    return np.concatenate(rows), *_numbers(np.concatenate(bits))


def usable_counts(rows: DataFrame) -> DataFrame:
    """``(file, m_bend, m_spread, cnt)`` of rows with a whole code and a count; re-deliveries are still there."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, bend, spread = decoded(b.column("bitstring"))
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column("file").take(at), pa.array(bend), pa.array(spread), b.column("cnt").take(at)], ["file", "m_bend", "m_spread", "cnt"]
            )

    slim = rows.select("file", "bitstring", F.col("cnt").cast("bigint").alias("cnt")).filter("bitstring is not null and cnt is not null")
    return slim.mapInArrow(decode, "file string, m_bend bigint, m_spread bigint, cnt bigint")


def written_as(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose text is one of the wanted codes in either form: a comparison of texts, nothing is decoded."""
    m = F.col("m_bend"), F.col("m_spread")
    forms = wanted.select(F.explode(F.array(plain_code(*m), legacy_code(*m))).alias("bitstring"))
    return rows.join(sendable(forms), "bitstring", "left_semi")


def once(counts: DataFrame) -> DataFrame:
    """Each (file, code) once. Deliveries that differ count with the greater cnt."""
    return counts.groupBy("file", "m_bend", "m_spread").agg(F.max("cnt").alias("cnt"))


def _group(seed: int, groups: int):
    return F.pmod(F.xxhash64(F.lit(seed), "m_bend", "m_spread"), F.lit(groups)).cast("int")


def _seeds(turn: int) -> list[int]:
    return [turn * REPEATS + r for r in range(REPEATS)]


def counters(weights: DataFrame, groups: int, turn: int, tasks: int) -> DataFrame:
    """``(rep, grp, pos, sym, w)``, counted in ``tasks`` tasks; pos -1 holds the whole weight of the group, which is exact."""
    slim = weights.select("m_bend", "m_spread", "cnt", *(_group(s, groups).alias(f"g{r}") for r, s in enumerate(_seeds(turn))))
    slim = slim.coalesce(tasks)

    def track(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((REPEATS, groups, LENGTH, SYMBOLS))

        def add(parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts)
            bend, spread, w = (t.column(c).to_numpy() for c in ("m_bend", "m_spread", "cnt"))
            cells = encode(bend, spread).astype(np.int64) + SYMBOLS * np.arange(LENGTH)
            heavy = np.repeat(w.astype(float), LENGTH)
            for r in range(REPEATS):
                at = cells + (t.column(f"g{r}").to_numpy().astype(np.int64) * (LENGTH * SYMBOLS))[:, None]
                table[r] += np.bincount(at.ravel(), heavy, groups * LENGTH * SYMBOLS).reshape(groups, LENGTH, SYMBOLS)

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BUFFER_ROWS:
                add(held)
                held, n = [], 0
        if held:
            add(held)
        whole = table[:, :, 0, :].sum(axis=2)
        r, g, p, s = np.nonzero((table > 0) & (table >= KEEP * whole[:, :, None, None]))
        rr, gg = np.nonzero(whole)
        cols = [np.append(a, b) for a, b in ((r, rr), (g, gg), (p, np.full(len(rr), -1)), (s, np.zeros(len(rr))))]
        w = np.append(table[r, g, p, s], whole[rr, gg])
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c.astype(np.int32)) for c in cols), pa.array(w.astype(np.int64))], ["rep", "grp", "pos", "sym", "w"]
        )

    kept = slim.mapInArrow(track, "rep int, grp int, pos int, sym int, w bigint")
    return kept.groupBy("rep", "grp", "pos", "sym").agg(F.sum("w").alias("w"))


def decode_group(heavy: pd.DataFrame) -> list[tuple[int, int]]:
    """Codes whose symbols are in ``heavy`` (pos, sym, w): take the heaviest at each position, correct, subtract, again."""
    left = np.zeros((LENGTH, SYMBOLS))
    left[heavy.pos, heavy.sym] = heavy.w
    least, found = heavy.w.min() if len(heavy) else 0, []
    while (left.max(axis=1) >= least).sum() >= DATA + 2:
        word = correct(left.argmax(axis=1))
        if word is None:
            break
        at = left[np.arange(LENGTH), word]
        found.append(_message(word))
        left[np.arange(LENGTH), word] = np.maximum(at - np.median(at[at > 0]), 0) if (at > 0).any() else 0
        left[left < least] = 0
        if len(found) > SYMBOLS:
            break
    return found


def candidates(counted: DataFrame, at_least: float) -> DataFrame:
    """``(m_bend, m_spread)`` decoded from symbols of weight ``at_least``. At most total / at_least symbols a position."""
    heavy = counted.filter((F.col("pos") >= 0) & (F.col("w") >= at_least))

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(decode_group(pdf), columns=["m_bend", "m_spread"], dtype="int64")

    return heavy.groupBy("rep", "grp").applyInPandas(decode, "m_bend bigint, m_spread bigint").distinct()


def heavy_codes(rows: DataFrame, share: float) -> DataFrame:
    """``(bitstring, m_bend, m_spread, frames, total)``: every code with at least ``share`` of all frames.

    * null, cut-off or foreign codes and null counts: left out of codes and total; a null file is a recording too;
    * (file, code) delivered again, in either form: once; ties at the threshold: all in;
    * empty input: no row; further columns of ``rows`` are ignored. Negative counts are not expected.
    """
    groups = min(MOST_GROUPS, 1 << int(np.ceil(np.log2(4 / share))))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // (ROWS_PER_GROUP * groups))
    raw = usable_counts(rows)
    inside, total, parts = F.lit(True), None, []
    for turn in range(ROUNDS):
        seen = materialise(counters(once(raw.filter(inside)), groups, turn, tasks), "counters")
        sums = seen.filter("pos = -1")
        if total is None:
            total = int(sums.filter("rep = 0").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])
            if total <= 0:
                break
        wanted = materialise(candidates(seen, share * total / 2), "candidates")
        exact = materialise(
            once(usable_counts(written_as(rows, wanted)))
            .groupBy("m_bend", "m_spread")
            .agg(F.sum("cnt").alias("frames")),
            "exact",
        )
        parts.append(exact)
        known = exact.filter(inside).select(
            F.col("frames"), F.posexplode(F.array(*(_group(s, groups) for s in _seeds(turn)))).alias("rep", "grp")
        )
        known = known.groupBy("rep", "grp").agg(F.sum("frames").alias("found"))
        rest = sums.join(known, ["rep", "grp"], "left").filter(F.col("w") - F.coalesce("found", F.lit(0)) >= share * total)
        open_groups = [[] for _ in range(REPEATS)]
        for r in rest.select("rep", "grp").collect():  # at most 1 / share a repetition
            open_groups[r.rep].append(r.grp)
        if not all(open_groups):
            break
        for s, gs in zip(_seeds(turn), open_groups, strict=True):
            inside &= _group(s, groups).isin(gs)
    else:
        parts.append(once(raw.filter(inside)).groupBy("m_bend", "m_spread").agg(F.sum("cnt").alias("frames")))
    spark = rows.sparkSession
    if not parts:
        found = spark.createDataFrame([], "m_bend bigint, m_spread bigint, frames bigint")
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = found.distinct().filter(F.col("frames") >= share * total)
    return found.select(
        plain_code(F.col("m_bend"), F.col("m_spread")).alias("bitstring"),
        "m_bend",
        "m_spread",
        "frames",
        F.lit(total).cast("bigint").alias("total"),
    )
