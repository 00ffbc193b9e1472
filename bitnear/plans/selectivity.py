"""How much of a table a ball holds, which physical strategy to take, and whether a table may be broadcast."""

from itertools import combinations
from math import comb
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

# The published selectivity model is clamp(1e-9 * 4^d, 1e-10, 0.5), and 0 below d = 0; 4 is the distance it assumes where none is known.
MODEL_BASE, MODEL_STEP, MODEL_LEAST, MODEL_MOST, MODEL_DISTANCE = 1e-9, 4.0, 1e-10, 0.5, 4

#: Rows, and bytes of them, that a join broadcasts at once; beyond either they go in blocks or by another way.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: A side of so few rows is compared with everything: less work than any shuffle of the other side.
FEW_ROWS = 1_000
#: Cost of making and moving one probe, in comparisons.
PROBE_COST = 30
#: Rows of the other side that blocks are chosen for.
TYPICAL_ROWS = 2_000_000
#: Most probes a row may be expanded to.
MOST_PROBES = 12_000
#: A share of all pairs from which meeting in blocks is no better than comparing everything.
HEAVY_PAIRS = 0.02


def uniform_share(distance: int) -> float:
    """The exact share of uniform hashes within a distance."""
    return sum(comb(64, i) for i in range(min(distance, 64) + 1)) / 2**64 if distance >= 0 else 0.0


def model_selectivity(distance: int | None) -> float:
    """The published estimate, for callers that compare plans by it."""
    d = MODEL_DISTANCE if distance is None else distance
    if d < 0:
        return 0.0
    return min(max(MODEL_BASE * MODEL_STEP ** min(d, 64), MODEL_LEAST), MODEL_MOST)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory: 8 for each fixed-width column, the lengths of the others."""

    def width(f) -> Column:
        if isinstance(f.dataType, (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)):
            return F.lit(8)
        text = df[f.name] if isinstance(f.dataType, (StringType, BinaryType)) else F.to_json(F.struct(df[f.name]))
        return F.coalesce(F.octet_length(text), F.lit(0)) + 24

    return sum((width(f) for f in df.schema.fields), F.lit(16))


def few_rows(df: DataFrame, most: int) -> int | None:
    """The number of rows if it is `most` or less, else None; no more rows than that are counted."""
    n = df.limit(most + 1).count()
    return n if n <= most else None


def fits(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """May df be broadcast whole? By rows and by bytes, both measured, reading no more rows than the bound."""
    most = rows or BROADCAST_ROWS
    seen = df.select(row_bytes(df).alias("b")).limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return seen["n"] <= most and (seen["b"] or 0) <= (size or BROADCAST_BYTES)


def bit_blocks(n: int, seed: int = 64) -> list[int]:
    """The 64 bits dealt out to n blocks of about equal size, as signed masks that add up to all bits.

    Bits are dealt in a shuffled order, so that hashes with a common run of bits, as small integers have, still differ in
    every block.
    """
    order = Random(seed).sample(range(64), 64)
    masks = (sum(1 << b for b in order[64 * i // n : 64 * (i + 1) // n]) for i in range(n))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _ways(bits: int, flips: int) -> int:
    return sum(comb(bits, i) for i in range(flips + 1))


def band_cost(distance: int, blocks: int, rows: int) -> tuple[float, int]:
    """(cost of one row of the probing side in comparisons, its probes) against so many evenly spread rows."""
    flips = distance // blocks
    sizes = [64 * (i + 1) // blocks - 64 * i // blocks for i in range(blocks)]
    probes = sum(_ways(b, flips) for b in sizes)
    return PROBE_COST * probes + rows * sum(_ways(b, flips) / 2**b for b in sizes), probes


def band_plan(distance: int, rows: int = TYPICAL_ROWS) -> int | None:
    """The number of blocks to cut hashes into; None where comparing everything is cheaper.

    Of n blocks one differs in at most distance // n bits, so one side is probed with that many bits of each block flipped
    in all ways. Few long blocks need many probes, many short ones select little.
    """
    if not 0 <= distance < 64:
        return None
    costs = {n: band_cost(distance, n, rows) for n in range(1, min(distance + 1, 16) + 1)}
    best = min((c, n) for n, (c, probes) in costs.items() if probes <= MOST_PROBES or n == distance + 1) if costs else (rows, 1)
    return best[1] if best[0] < rows else None


def flip_masks(mask: int, flips: int) -> list[int]:
    """All signed masks of at most `flips` bits of the block."""
    own = [1 << b for b in range(64) if mask >> b & 1]
    found = [sum(chosen) for k in range(flips + 1) for chosen in combinations(own, k)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def parts(column: Column, blocks: int) -> Column:
    """array<struct<band, part>>: the bits of each block."""
    return F.array(*[F.struct(F.lit(i).alias("band"), column.bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(bit_blocks(blocks))])


def probes(band: Column, part: Column, blocks: int, flips: int) -> Column:
    """array<bigint>: the part of a band with up to `flips` bits flipped in all ways."""
    masks = F.lit(None).cast("array<bigint>")
    for i, m in enumerate(bit_blocks(blocks)):
        masks = F.when(band == i, F.split(F.lit(",".join(map(str, flip_masks(m, flips)))), ",").cast("array<bigint>")).otherwise(masks)
    return F.transform(masks, lambda x: x.bitwiseXOR(part))


def own_probes(distance: Column, band: Column, part: Column, blocks: int, most: int) -> Column:
    """array<bigint>: the part of a band with up to (distance - band) // blocks bits flipped, in all ways; null if that is negative.

    distance is `most` at most.
    """
    masks = F.lit(None).cast("array<bigint>")
    for i, m in enumerate(bit_blocks(blocks)):
        for flips in range((most - i) // blocks + 1):
            own = F.split(F.lit(",".join(map(str, flip_masks(m, flips)))), ",").cast("array<bigint>")
            masks = F.when((band == i) & (distance - i).between(flips * blocks, flips * blocks + blocks - 1), own).otherwise(masks)
    return F.transform(masks, lambda x: x.bitwiseXOR(part))


def class_plan(balls: dict[int, int], rows: int) -> list[tuple[int, int, int]]:
    """(least distance, most, blocks) of one or two classes in which balls, given by distance, are searched at least cost."""

    def best(own: list[int]) -> tuple[float, int]:
        def cost(n: int) -> tuple[float, int]:
            sizes, total, widest = [64 * (i + 1) // n - 64 * i // n for i in range(n)], float(PROBE_COST * rows * n), 0
            for d in own:
                ways = [(_ways(b, (d - i) // n), b) for i, b in enumerate(sizes) if d >= i]
                widest = max(w for w, _ in ways + [(widest, 0)])
                total += balls[d] * sum(w * (PROBE_COST + rows / 2**b) for w, b in ways)
            return total, widest

        costs = {n: cost(n) for n in range(1, min(own[-1] + 1, 16) + 1)}
        return min((c, n) for n, (c, widest) in costs.items() if widest <= MOST_PROBES or n == own[-1] + 1)

    seen = sorted(balls)
    if not seen:
        return []
    plans = [[seen], *([seen[:i], seen[i:]] for i in range(1, len(seen)))]
    chosen = min(plans, key=lambda plan: sum(best(own)[0] for own in plan))
    return [(own[0], own[-1], best(own)[1]) for own in chosen]


def candidate_pairs(left: DataFrame, right: DataFrame, a: str, b: str, distance: int, blocks: int) -> tuple[float, float]:
    """(pairs that meet in some band, all pairs), exactly: two aggregations with map-side combine and a join of counts."""

    def counts(df: DataFrame, c: str, name: str) -> DataFrame:
        own = df.where(F.col(c).isNotNull()).select(F.inline(parts(F.col(c), blocks)))
        return own.groupBy("band", "part").agg(F.count(F.lit(1)).cast("double").alias(name))

    flips = distance // blocks
    n, m = counts(left, a, "n"), counts(right, b, "m")
    if flips:
        m = m.select("band", F.explode(probes(F.col("band"), F.col("part"), blocks, flips)).alias("part"), "m")
        m = m.hint("merge")  # Spark doesn't see that explode made it larger, and might broadcast it
    met = n.join(m, ["band", "part"]).agg(F.sum(F.col("n") * F.col("m")).alias("x")).first()["x"] or 0.0
    rows = [counts_of.agg(F.sum(x)).first()[0] or 0.0 for counts_of, x in ((n.where("band = 0"), "n"), (counts(right, b, "m").where("band = 0"), "m"))]
    return met, rows[0] * rows[1]


def choose(left: DataFrame, right: DataFrame, a: str, b: str, distance: int) -> str:
    """'scan' or 'bands'. A few rows on either side scan, and so do wide balls, and tables whose bands are skewed."""
    if distance == 0:
        return "bands"
    blocks = band_plan(distance)
    if blocks is None or uniform_share(distance) >= HEAVY_PAIRS:
        return "scan"
    if few_rows(right, FEW_ROWS) is not None or few_rows(left, FEW_ROWS) is not None:
        return "scan"
    met, pairs = candidate_pairs(left, right, a, b, distance, blocks)
    return "bands" if met <= HEAVY_PAIRS * pairs else "scan"
