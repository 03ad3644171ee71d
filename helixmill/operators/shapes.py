"""Search for spaced shapes that tell mutations well: proposals on the driver, evaluation of many shapes in one Spark job."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.dna import Shape


def valid(shape: Shape, take: int, gaps: int) -> bool:
    return shape.k == take and shape.gaps == gaps and shape.palindromic and shape.text[0] == "X"


def propose(rng: random.Random, take: int, gaps: int) -> Shape:
    """A random symmetric shape that begins and ends with a taken position."""
    if take < 2 or (take % 2 and gaps % 2):
        raise ValueError("no symmetric shape: an odd number of both kinds has no middle, and both ends are taken")
    middle = "X" if take % 2 else "_" if gaps % 2 else ""
    half = ["X"] * (take // 2 - 1) + ["_"] * (gaps // 2)
    rng.shuffle(half)
    left = "X" + "".join(half)
    return Shape(left + middle + left[::-1])


def alter(rng: random.Random, shape: Shape) -> Shape:
    """A gap and a taken position of the left half change places, and likewise on the right."""
    half = len(shape) // 2
    left = list(shape.text[:half])
    gaps, taken = [i for i in range(1, half) if left[i] == "_"], [i for i in range(1, half) if left[i] == "X"]
    if not gaps or not taken:
        return shape
    i, j = rng.choice(gaps), rng.choice(taken)
    left[i], left[j] = left[j], left[i]
    return Shape("".join(left) + shape.text[half : len(shape) - half] + "".join(reversed(left)))


def _bits(n: int, of: Callable[[int], Column]) -> Column:
    return F.aggregate(F.array(*[of(j) for j in range(n)]), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def evaluate(spark: SparkSession, shapes: list[Shape], anis: list[float], bits: int, samples: int, seed: int = 1) -> DataFrame:
    """(shape, ani, tp, fp, fn, sensitivity): random reads of `samples` windows for each shape and identity, whose mutations
    are told from the hits and misses of `bits` k-mers. A mutation that is told is always there, so fp is 0."""
    spans = [bits + len(s) - 1 for s in shapes]
    if max(spans) > 62:
        raise ValueError("a window does not fit a long")
    rows = [(s.text, a, span, [sum(1 << (i + o) for o in s.take) for i in range(bits)]) for s, span in zip(shapes, spans, strict=True) for a in anis]
    top = max(spans)
    t = spark.createDataFrame(rows, "shape string, ani double, span int, masks array<bigint>").repartition(len(rows))
    t = t.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    hit = lambda j: F.pmod(F.xxhash64("shape", "ani", "sample", F.lit(j), F.lit(seed)), F.lit(1 << 20)) >= F.col("ani") * (1 << 20)
    t = t.withColumn("mutated", _bits(top, lambda j: F.when(hit(j) & (F.col("span") > j), F.lit(1 << j)).otherwise(F.lit(0)).cast("long")))
    zero = F.lit(0).cast("long")
    covered = F.aggregate(F.filter("masks", lambda m: F.col("mutated").bitwiseAND(m) == 0), zero, lambda acc, m: acc.bitwiseOR(m))
    t = t.withColumn("free", F.bitwise_not(covered))
    own = F.transform(F.filter("masks", lambda m: F.col("mutated").bitwiseAND(m) != 0), lambda m: m.bitwiseAND(F.col("free")))
    told = F.aggregate(F.filter(own, lambda x: F.bit_count(x) == 1), zero, lambda acc, x: acc.bitwiseOR(x))
    t = t.withColumn("told", told)
    count = lambda c: F.sum(F.bit_count(c)).cast("long")
    out = t.groupBy("shape", "ani").agg(
        count(F.col("told").bitwiseAND(F.col("mutated"))).alias("tp"), count(F.col("told").bitwiseAND(F.bitwise_not("mutated"))).alias("fp"), count(F.col("mutated").bitwiseAND(F.bitwise_not("told"))).alias("fn")
    )
    return out.withColumn("sensitivity", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))))


def search(spark: SparkSession, take: int, gaps: int, bits: int, rounds: int, width: int = 8, samples: int = 200, anis: tuple[float, ...] = (0.95, 0.97, 0.99), seed: int = 1, better: Callable[[float, float], bool] = lambda new, old: new > old) -> tuple[Shape, float, list[tuple[str, float]]]:
    """The best shape found, its mean sensitivity, and all that were tried; each round alters the best shape `width` times
    and evaluates the proposals in one job."""
    rng = random.Random(seed)
    best, score, tried = None, -1.0, []
    for _ in range(rounds):
        pool = list({s.text: s for s in ([propose(rng, take, gaps) for _ in range(width)] if best is None else [alter(rng, best) for _ in range(width)] + [propose(rng, take, gaps)])}.values())
        found = evaluate(spark, pool, list(anis), bits, samples, seed).groupBy("shape").agg(F.avg(F.coalesce("sensitivity", F.lit(0.0))).alias("mean")).collect()
        for r in sorted(found, key=lambda r: r.shape):
            tried.append((r.shape, r["mean"]))
            if better(r["mean"], score):
                best, score = Shape(r.shape), r["mean"]
    return best, score, tried


def load(spark: SparkSession, path: str) -> Shape:
    """The shape of a file: its first line that is one, X and _ (bars between are allowed and dropped)."""
    rows = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"\|", "").alias("s")).filter(F.col("s").rlike("^[X_]+$")).head(1)
    if not rows:
        raise ValueError(f"no shape in {path}")
    return Shape(rows[0].s)


def save(table: DataFrame, tried: list[tuple[str, float]], path: str) -> None:
    """Artefacts of a search: the pattern table as Parquet, and the shapes tried with their scores as text."""
    table.write.parquet(f"{path}/patterns")
    history = table.sparkSession.createDataFrame([(i, s, float(v)) for i, (s, v) in enumerate(tried)], "place int, shape string, sensitivity double")
    history.coalesce(1).sortWithinPartitions("place").write.csv(f"{path}/history", sep="\t", header=True)


def truth_counts(told: DataFrame, truth: DataFrame, by: list[str], position: str = "position") -> DataFrame:
    """(by, tp, fp, fn) of the told positions of each group against its true ones, both as sets."""
    mark = lambda df, name: df.select(*by, position).distinct().withColumn(name, F.lit(True))
    both = mark(told, "t").join(mark(truth, "m"), [*by, position], "full_outer")
    t, m = F.col("t").isNotNull(), F.col("m").isNotNull()
    return both.groupBy(*by).agg(F.count_if(t & m).alias("tp"), F.count_if(t & ~m).alias("fp"), F.count_if(~t & m).alias("fn"))


def missed_by_position(told: DataFrame, truth: DataFrame, read: list[str], position: str = "position") -> DataFrame:
    """(position, missed): in how many reads a true mutation at that position of the read was not told."""
    left = truth.select(*read, position).distinct().join(told.select(*read, position).distinct(), [*read, position], "left_anti")
    return left.groupBy(position).agg(F.count(F.lit(1)).alias("missed"))


def synthetic_reads(spark: SparkSession, n: int, length: int, mutations: int | None = None, rate: float = 0.0, third: float = 0.8, seed: int = 1) -> DataFrame:
    """(read, position) of mutated positions of n reads, the same for the same seed.

    With `mutations`, every read has that many at places drawn without replacement. Else each position mutates by chance:
    three times `rate`, of which the third base of a codon takes the share `third` and the two others halve the rest; where
    codons begin is drawn for each read."""
    unit = lambda *of: F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    reads = spark.range(n).withColumnRenamed("id", "read")
    each = reads.select("read", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("position")) if length else reads.select("read", F.lit(0).alias("position")).limit(0)
    if mutations is not None:
        if mutations > length:
            raise ValueError("more mutations than positions")
        drawn = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(max(length, 1) - 1)), lambda p: F.struct(unit(F.col("read"), p).alias("u"), p.alias("p")))), 1, max(mutations, 1))
        return reads.filter(F.lit(mutations > 0)).select("read", F.explode(drawn).alias("d")).select("read", F.col("d.p").alias("position"))
    frame = F.floor(unit(F.col("read"), F.lit("frame")) * 3)
    chance = 3 * rate * F.when(F.pmod("position", F.lit(3)) == frame, third).otherwise((1 - third) / 2)
    return each.filter(unit(F.col("read"), F.col("position"), F.lit("base")) < chance)


def distances(spark: SparkSession, size: int, k: int) -> DataFrame:
    """(distances array<int>): all k gaps of 0 or more that place k mutations, the first at the first gap, within `size`
    positions: their sum plus k is below `size`. One join for each gap, each with the sums that are still allowed."""
    rows = spark.range(1).select(F.array().cast("array<int>").alias("distances"), F.lit(0).alias("total"))
    most = size - k - 1
    for _ in range(k):
        rows = rows.filter(F.col("total") <= most).select("distances", "total", F.explode(F.sequence(F.lit(0), F.lit(most) - F.col("total"))).alias("d"))
        rows = rows.select(F.concat("distances", F.array("d")).alias("distances"), (F.col("total") + F.col("d")).alias("total"))
    return rows.select("distances") if most >= 0 and k > 0 else rows.select("distances").limit(0)


def told_by_limit(table: DataFrame, bits: int) -> DataFrame:
    """(mutations, patterns, share): patterns of a trained table that tell so many positions, and their share of all
    2 ** bits - 1 patterns that have a miss. Summed up to a limit it says what a table cut off there would still tell."""
    n = table.groupBy(F.size("mutations").alias("mutations")).agg(F.count(F.lit(1)).alias("patterns"))
    return n.withColumn("share", F.col("patterns") / float((1 << bits) - 1))


def told_by_candidates(table: DataFrame, bits: int) -> DataFrame:
    """(candidates, patterns, told, share) of variants.trained(): patterns that leave so many positions open, the positions they tell,
    and their share of all 2 ** bits - 1 patterns that have a miss."""
    n = table.groupBy("candidates").agg(F.count(F.lit(1)).alias("patterns"), F.sum(F.size("mutations")).alias("told"))
    return n.withColumn("share", F.col("patterns") / float((1 << bits) - 1))


def sensitivity_by_limit(spark: SparkSession, table: DataFrame, shape: Shape, bits: int, counts: list[int], limits: list[int], length: int = 100, reads: int = 1000, seed: int = 1, of: str = "told") -> DataFrame:
    """(mutations, told_at_most, tp, fn, sensitivity): reads with so many mutations, told by those patterns of the table that
    tell at most so many positions, or with of="candidates" (and a table of variants.trained()) leave at most so many open; the
    column is then candidates_at_most."""
    from .variants import call

    out = None
    last = length - len(shape)
    for c in counts:
        truth = synthetic_reads(spark, reads, length, c, seed=seed + c)
        covers = F.array(*[F.lit(o) for o in shape.take])
        missed = truth.select("read", F.explode(F.transform(covers, lambda o: F.col("position") - o)).alias("pos")).filter(F.col("pos").between(0, last)).distinct().withColumn("hit", F.lit(False))
        rows = spark.range(reads).select(F.col("id").alias("read"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("pos")).join(missed, ["read", "pos"], "left").withColumn("hit", F.coalesce("hit", F.lit(True)))
        for limit in limits:
            size = F.col("candidates") if of == "candidates" else F.size("mutations")
            told = call(rows, table.filter(size <= limit), "read", shape, bits)
            n = truth_counts(told, truth, ["read"]).agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"))
            n = n.select(F.lit(c).alias("mutations"), F.lit(limit).alias(f"{of}_at_most"), "tp", "fn", (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("sensitivity"))
            out = n if out is None else out.union(n)
    return out
