"""A log-bilinear language model, trained with noise-contrastive estimation in numpy.

The next token's vector is predicted from those of the two tokens before it, each weighted by position, and scored against
all units. Units are the most frequent tokens and classes of the others by their first bytes. A token's probability is that
of its unit and, in a class, its share there; tokens that training lacks are together one type of their class, whose
share follows from the tokens seen once. Products of all contexts with all units give the exact normaliser of each context
once, so that the log-probability of every token is a dot product less a table entry.

Counts cover all training documents. Each text is cut into units once, in a stored table that training and scoring read. Every
training document is in one round and in one shard of it, by a hash; shards have about SHARD_TOKENS tokens, so that their
number grows with the input, and a replica is trained on each. Replicas are averaged by their tokens, a tree of sums, after each
round. Neither partitions nor cores change a score. Only what a constant bounds comes to the driver: the FREQUENT most frequent
tokens, the parameters and figures of classes. Counts of all other tokens stay a table that the documents' rare tokens are
joined with.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize

#: No word has a line feed in it.
END = "\n"
#: Own units are the most frequent tokens that make up UNIT_SHARE of all, MAX_OWN at most: exact normalisers take the cube of units.
UNIT_SHARE, MAX_OWN, CLASSES, WIDTH = 0.7, 960, 64, 16
FREQUENT = 200_000
#: Rounds, each over its share of the documents, passes over every chunk of a round, and tokens of a chunk and of a shard.
ROUNDS, PASSES, CHUNK, SHARD_TOKENS = 3, 3, 1 << 16, 1 << 20
BATCH, NOISE, RATE, SEED = 1024, 48, 0.3, 7
#: Sums of replicas that one task adds up.
FAN = 16
#: Distinct tokens that a task counts before it hands on what it has.
HELD = 400_000


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END.encode()]


def _class(token: bytes) -> int:
    return zlib.crc32(token[:3]) % CLASSES


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over all rows of a text column; counts are added up in each task first."""

    def partial(batches):
        own: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                own.update(tokens(text))
                if len(own) > HELD:
                    yield _counted(own)
                    own.clear()
        if own:
            yield _counted(own)

    return materialize(texts.mapInArrow(partial, "token string, n long").groupBy("token").agg(F.sum("n").alias("c")), "counts")


def _counted(own: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t.decode() for t in own], pa.string()), pa.array(own.values(), pa.int64())], ["token", "n"])


@dataclass
class Vocabulary:
    """Frequent tokens with their counts and units, figures of classes, and totals."""

    index: dict[bytes, int]
    count: np.ndarray
    unit: np.ndarray
    class_total: np.ndarray
    class_unknown: np.ndarray
    unit_count: np.ndarray
    total: int
    distinct: int
    own: int

    @property
    def units(self) -> int:
        return self.own + CLASSES

    @property
    def log_total(self) -> float:
        return float(np.log10(self.total + 0.1 * (self.distinct + 1)))

    def share(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 of a token's share of its class from its count, 0 for a token that training lacks."""
        known = np.log10(np.maximum((1 - self.class_unknown[k]) * c / np.maximum(self.class_total[k], 1), 1e-300))
        return np.where(c > 0, known, np.log10(self.class_unknown[k]))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # a count so high that at most FREQUENT tokens have it, from at most a few hundred steps of counts
    step = F.floor(F.log2("c") * 8).cast("int")
    least, taken = 1, 0
    for s, n in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):
        if taken + n > FREQUENT:
            least = int(2 ** ((s + 1) / 8) - 1e-9) + 1
            break
        taken += n
    rows = [(t.encode(), c) for t, c in counts.where((F.col("c") >= least) | (F.col("token") == END)).select("token", "c").collect()]
    rows.sort(key=lambda r: (r[0] != END.encode(), -r[1], r[0]))
    if not rows or rows[0][0] != END.encode():
        rows.insert(0, (END.encode(), 0))
    index = {t: i for i, (t, _) in enumerate(rows)}
    count = np.array([c for _, c in rows], np.int64)
    own = min(MAX_OWN, len(rows), 1 + int(np.searchsorted(np.cumsum(count), UNIT_SHARE * int(total))))
    unit = np.array([i if i < own else own + _class(t) for i, (t, _) in enumerate(rows)], np.int64)
    head = [t.decode() for t, _ in rows[:own]]
    k = (F.crc32(F.substring(F.col("token").cast("binary"), 1, 3)) % CLASSES).alias("k")
    classes = counts.where(~F.col("token").isin(head)).groupBy(k).agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).collect()
    class_total, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes:
        class_total[r["k"]], once[r["k"]] = r["c"], r["once"]
    unknown = np.where(class_total > 0, (once + 0.5) / (class_total + 1), 1.0)
    unit_count = np.concatenate([count[:own], class_total]).astype(float)
    return Vocabulary(index, count, unit, class_total, unknown, unit_count, int(total), int(distinct), own)


@dataclass
class Parameters:
    context: np.ndarray
    target: np.ndarray
    position: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.context.ravel(), self.target.ravel(), self.position.ravel(), self.bias]).astype(np.float64)

    @staticmethod
    def of(x: np.ndarray) -> Parameters:
        n = (len(x) - 2 * WIDTH) // (2 * WIDTH + 1)
        a, b = n * WIDTH, 2 * n * WIDTH
        x = x.astype(np.float32)
        return Parameters(x[:a].reshape(n, WIDTH).copy(), x[a:b].reshape(n, WIDTH).copy(), x[b : b + 2 * WIDTH].reshape(2, WIDTH).copy(), x[b + 2 * WIDTH :].copy())


def noise_of(v: Vocabulary) -> np.ndarray:
    return (v.unit_count + 0.5) / (v.unit_count.sum() + 0.5 * v.units)


def start(v: Vocabulary) -> Parameters:
    r, n = np.random.default_rng(SEED), v.units
    return Parameters(r.normal(0, 0.3, (n, WIDTH)).astype(np.float32), r.normal(0, 0.1, (n, WIDTH)).astype(np.float32), np.ones((2, WIDTH), np.float32), np.log(noise_of(v)).astype(np.float32))


def contexts(unit: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the units of some texts in a row: text number and the units one and two before, the end where a text has none."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return text, np.where(place >= 1, np.roll(unit, 1), 0), np.where(place >= 2, np.roll(unit, 2), 0)


def units_of(v: Vocabulary, texts: list[str | None]):
    """All tokens of some texts in a row, how many each text has, index of a frequent token or -1, unit, and places of rare ones."""
    lists = [tokens(t) for t in texts]
    flat = list(itertools.chain.from_iterable(lists))
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    index = np.fromiter(map(v.index.get, flat, itertools.repeat(-1)), np.int64, len(flat))
    unit = v.unit[index]
    rare = np.flatnonzero(index < 0)
    if len(rare):
        unit[rare] = v.own + np.fromiter((_class(flat[i]) for i in rare.tolist()), np.int64, len(rare))
    return flat, sizes, index, unit, rare


class Replica:
    """Noise-contrastive training with AdaGrad steps; noise is drawn from the units' shares, the same for a batch."""

    def __init__(self, p: Parameters, noise: np.ndarray, seed: int):
        self.p, self.r = p, np.random.default_rng(seed)
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.cut = np.cumsum(noise)
        self.sums = [np.full_like(x, 1e-4) for x in (p.context, p.target, p.position, p.bias)]

    def _step(self, k: int, x: np.ndarray, grad: np.ndarray) -> None:
        self.sums[k] += grad * grad
        x += RATE * grad / np.sqrt(self.sums[k])

    def _scatter(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        # places of 16 bits are sorted by counting
        order = np.argsort(at.astype(np.uint16), kind="stable")
        own = at[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out = np.zeros((len(self.cut), rows.shape[1]), np.float32)
        out[own[first]] = np.add.reduceat(rows[order], first, axis=0)
        return out

    def learn(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        mixed = self.r.permutation(len(unit))
        for i in range(0, len(mixed), BATCH):
            at = mixed[i : i + BATCH]
            self.batch(unit[at], one[at], two[at])

    def batch(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, n = self.p, len(unit)
        noise = np.minimum(np.searchsorted(self.cut, self.r.random(NOISE)), len(self.cut) - 1)
        a, b = p.context[one], p.context[two]
        guess = p.position[0] * a + p.position[1] * b
        own = p.target[unit]
        good = 1 / (1 + np.exp(np.einsum("ij,ij->i", guess, own) + p.bias[unit] - self.log_noise[unit]))
        other = p.target[noise]
        bad = guess @ -other.T
        bad -= p.bias[noise] - self.log_noise[noise]
        with np.errstate(over="ignore"):
            np.exp(bad, out=bad)
        bad += 1
        np.reciprocal(bad, out=bad)
        d_guess = good[:, None] * own - bad @ other
        d_target = self._scatter(unit, good[:, None] * guess)
        np.subtract.at(d_target, noise, bad.T @ guess)
        d_bias = (np.bincount(unit, good, len(self.cut)) - np.bincount(noise, np.ones(len(bad), np.float32) @ bad, len(self.cut))).astype(np.float32)
        d_context = self._scatter(np.concatenate([one, two]), np.concatenate([d_guess * p.position[0], d_guess * p.position[1]]))
        d_position = np.stack([np.einsum("ij,ij->j", d_guess, a), np.einsum("ij,ij->j", d_guess, b)])
        for k, (x, g) in enumerate(((p.context, d_context), (p.target, d_target), (p.position, d_position), (p.bias, d_bias))):
            self._step(k, x, g / n)


def _replicas(held, noise):
    """Rows (shard, units), those of a shard together, to one row (shard, n, x) for each shard: tokens and parameters times tokens."""

    def trained(batches):
        rows = ((s, u) for b in batches for s, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for shard, own in itertools.groupby(rows, lambda r: r[0]):
            replica, n, kept, size = Replica(Parameters.of(held.value), noise.value, SEED + shard), 0, [], 0

            def learn(kept, replica=replica):
                units = [np.frombuffer(u, "<u2").astype(np.int64) for u in kept]
                unit = np.concatenate(units)
                _, one, two = contexts(unit, np.fromiter(map(len, units), np.int64, len(units)))
                for _ in range(PASSES):
                    replica.learn(unit, one, two)

            for _, u in own:
                kept.append(u)
                size += len(u) // 2
                if size >= CHUNK:
                    learn(kept)
                    n, kept, size = n + size, [], 0
            if kept:
                learn(kept)
                n += size
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n": pa.array([n], pa.int64()), "x": pa.array([(replica.p.flat() * n).astype("<f8").tobytes()], pa.binary())})

    return trained


SUMS = "shard long, n long, x binary"


def _added(key, rows):
    order = np.argsort(rows["shard"].to_numpy(zero_copy_only=False))
    x = np.sum([np.frombuffer(rows["x"][int(i)].as_py(), "<f8") for i in order], axis=0)
    return pa.table({"shard": [key[0].as_py()], "n": [sum(rows["n"].to_pylist())], "x": pa.array([x.astype("<f8").tobytes()], pa.binary())}, schema=pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("x", pa.binary())]))


def train(known: DataFrame, v: Vocabulary) -> Parameters:
    """Parameters after ROUNDS rounds; known has the units and the hash (units, h) of every training document."""
    spark = known.sparkSession
    noise, now = spark.sparkContext.broadcast(noise_of(v)), start(v)
    shards = max(1, math.ceil(v.total / ROUNDS / SHARD_TOKENS))
    for r in range(ROUNDS):
        held = spark.sparkContext.broadcast(now.flat())
        own = known.where(F.pmod("h", F.lit(ROUNDS)) == r).select(F.pmod(F.floor(F.col("h") / ROUNDS), F.lit(shards)).alias("shard"), "units", "h")
        # rows in one order, whatever partitions they come from
        dealt = own.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "h", "units").select("shard", "units")
        sums, n = dealt.mapInArrow(_replicas(held, noise), SUMS), shards
        while n > FAN:
            n = math.ceil(n / FAN)
            sums = sums.groupBy(F.pmod("shard", F.lit(n)).alias("shard_")).applyInArrow(_added, SUMS)
        got = sorted(sums.collect())
        if got:
            now = Parameters.of(np.sum([np.frombuffer(row["x"], "<f8") for row in got], axis=0) / sum(row["n"] for row in got))
        held.unpersist()
    noise.unpersist()
    return now


def normalisers(spark: SparkSession, p: Parameters) -> np.ndarray:
    """Log of the sum over all units for each pair of units before; a row of the table is one product of matrices."""
    flat, n = p.flat(), len(p.bias)

    def rows(batches):
        q = Parameters.of(flat)
        first = q.position[0] * q.context
        for b in batches:
            for two in b.column(0).to_pylist():
                s = (first + q.position[1] * q.context[two]) @ q.target.T + q.bias
                top = s.max(1, keepdims=True)
                z = np.log(np.exp(s - top).sum(1)) + top[:, 0]
                yield pa.RecordBatch.from_pydict({"two": pa.array([two], pa.int32()), "z": pa.array([z.astype(np.float32)], pa.list_(pa.float32()))})

    got = dict(spark.range(n).mapInArrow(rows, "two int, z array<float>").collect())
    return np.array([got[i] for i in range(n)], np.float32)


UNITS = "units binary, n_tokens long, n_known long, base double, inside double, rare array<struct<token: string, m: long>>"


def _cut(words):
    """Rows of a text, and others, to the others and UNITS: units and what frequent tokens add to figures."""

    def rows(batches):
        v = words.value
        base = np.log10(v.count + 0.1) - v.log_total
        inside = np.where(v.unit < v.own, 0.0, v.share(v.count, np.maximum(v.unit - v.own, 0)))
        for b in batches:
            texts, others = b.column(0).to_pylist(), b.columns[1:]
            for k in range(0, len(texts), 256):
                part = texts[k : k + 256]
                flat, sizes, index, unit, rare = units_of(v, part)
                text, known = np.repeat(np.arange(len(part)), sizes), index >= 0
                add = lambda w, text=text, n=len(part): np.bincount(text, w, n)
                lists: list[Counter] = [Counter() for _ in part]
                for i in rare.tolist():
                    lists[text[i]][flat[i]] += 1
                ends = np.cumsum(sizes) * 2
                packed = unit.astype("<u2").tobytes()
                made = [
                    pa.array([packed[e - 2 * n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()),
                    pa.array(sizes), pa.array(add((known & (v.count[index] > 0)).astype(float)).astype(np.int64)),
                    pa.array(add(np.where(known, base[index], 0.0))), pa.array(add(np.where(known, inside[index], 0.0))),
                    pa.array([[{"token": t.decode(), "m": m} for t, m in c.items()] for c in lists], pa.list_(pa.struct([("token", pa.string()), ("m", pa.int64())]))),
                ]
                yield pa.RecordBatch.from_arrays([*(c[k : k + 256] for c in others), *made], [*b.schema.names[1:], "units", "n_tokens", "n_known", "base", "inside", "rare"])

    return rows


def _scored(params, table):
    """Rows (row, units) to (row, score): log10 of the probability of a text's units."""

    def rows(batches):
        p, z = Parameters.of(params.value), table.value
        first, second = p.position[0] * p.context, p.position[1] * p.context
        for b in batches:
            own, units = b.column(0), b.column(1).to_pylist()
            for k in range(0, len(units), 256):
                part = [np.frombuffer(u, "<u2").astype(np.int64) for u in units[k : k + 256]]
                unit = np.concatenate(part)
                text, one, two = contexts(unit, np.fromiter(map(len, part), np.int64, len(part)))
                s = np.einsum("ij,ij->i", first[one] + second[two], p.target[unit]) + p.bias[unit] - z[two, one]
                yield pa.RecordBatch.from_arrays([own[k : k + 256], pa.array(np.bincount(text, s.astype(np.float64), len(part)) / np.log(10))], ["row", "of_units"])

    return rows


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    A null text counts as empty and has the end token alone. Texts are scored whole. Rows with equal ids are rows of their
    own; those with equal texts as well have equal scores. Without training documents every token is unknown. An empty table
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), (crc_mod(F.col(id_col), 10) == 0).alias("held_out"), F.xxhash64(id_col, text_col).alias("h"))
    counts = count_tokens(rows.where(~F.col("held_out")).select("text"))
    v = vocabulary(counts)
    send = spark.sparkContext.broadcast
    made = rows.mapInArrow(_cut(send(v)), f"id {dict(rows.dtypes)['id']}, held_out boolean, h long, {UNITS}")
    made = materialize(made.withColumn("row", F.monotonically_increasing_id()), "units")
    p = train(made.where(~F.col("held_out")), v)
    scores = made.select("row", "units").mapInArrow(_scored(send(p.flat()), send(normalisers(spark, p))), "row long, of_units double")
    rare = made.select("row", F.inline("rare")).join(counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    k = F.crc32(F.substring(F.col("token").cast("binary"), 1, 3)) % CLASSES + 1
    total, unknown = (F.element_at(F.array(*[F.lit(float(x)) for x in xs]), k.cast("int")) for xs in (v.class_total, v.class_unknown))
    share = F.when(F.col("c") > 0, F.log10((1 - unknown) * F.col("c") / total)).otherwise(F.log10(unknown))
    sums = rare.groupBy("row").agg(F.sum(F.col("m") * (F.log10(F.col("c") + 0.1) - v.log_total)).alias("b"), F.sum(F.col("m") * share).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("m"))).alias("n"))
    out = made.drop("rare", "units").join(scores, "row").join(sums, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("n", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("of_units") + F.col("inside") + F.coalesce("s", zero)).alias("score"),
    )
