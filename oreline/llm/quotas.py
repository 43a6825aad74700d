"""Problem 5: a sample that matches target category proportions.

Categories are counted, integer quotas are allotted by largest remainder with minimum floors and
availability caps, and the smallest random keys of each category are taken. The cells are those of
the target table (a few dozen rows); the records are only ever aggregated or filtered by a cut-off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .splits import clean_label

FIELDS = ("data_split", "answerability_label", "difficulty")
#: Target tables above this many cells are refused: quotas are allotted on the driver.
MAX_CELLS = 100_000
#: The sample's part of all ids.
SHARE = 0.25


def cells_of(targets: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``cell_id, target_permille, min_rows`` and the cleaned ``fields`` of every target cell, as a local table
    of at most :data:`MAX_CELLS` rows that may be broadcast; more are refused."""
    kept = targets.select("cell_id", F.coalesce("target_permille", F.lit(0)).alias("target_permille"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"), *(clean_label(F.col(f)).alias(f) for f in fields))
    rows = kept.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target cells")
    return targets.sparkSession.createDataFrame(rows, kept.schema)


def with_cell(records: DataFrame, cells: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``id, cell_id`` for the distinct pairs of records whose fields are all non-null (trimmed, lower
    case; blank is null) and form one of ``cells`` (:func:`cells_of`); ``cell_id`` is null where no cell
    matches."""
    keyed = records.select("id", *(clean_label(F.col(f)).alias(f) for f in fields)).dropna(subset=[*fields]).where("id is not null").distinct()
    return cut_lineage(keyed.join(F.broadcast(cells.select("cell_id", *fields)), list(fields), "left").select("id", "cell_id"))


def short_cells(records: DataFrame, targets: DataFrame) -> DataFrame:
    """``cell_id`` of every cell whose allocation reports a shortfall: fewer ids than max(``min_rows``,
    floor(n x permille / 1000)).

    Repeated deliveries of an id count once; records with a null field are in no cell; an empty
    table leaves every cell with a positive need short. Extra columns on either side are ignored."""
    return allocate(records, targets).where("shortfall > 0").select("cell_id")


def largest_remainder(total: int, cells: list[tuple[int, float, int, int]]) -> dict[int, int]:
    """Integer quotas for ``(cell, weight, floor, available)`` summing to ``total`` where possible.

    Shares follow the weights at the one level at which, held between their floor (at most what is
    available) and what is available, they sum to the total; whole parts come first, then the largest
    remainders, ties by cell. Floors beyond ``total`` stand; without room the sum falls short."""
    low = {c: min(floor, available) for c, _, floor, available in cells}
    high = {c: available if w > 0 else low[c] for c, w, _, available in cells}
    weight = {c: w for c, w, _, _ in cells}
    if total <= sum(low.values()):
        return low
    if total >= sum(high.values()):
        return high
    level = lambda x: {c: min(max(x * weight[c], low[c]), high[c]) for c in weight}
    least, most = 0.0, max(high[c] / weight[c] for c in weight if weight[c] > 0)
    for _ in range(200):  # the level at which the clamped shares sum to the total
        middle = (least + most) / 2
        least, most = (middle, most) if sum(level(middle).values()) < total else (least, middle)
    share = level(most)
    quota = {c: max(low[c], int(share[c] + 1e-9)) for c in share}
    order = sorted((c for c in quota if quota[c] < high[c]), key=lambda c: (quota[c] - share[c] if share[c] > quota[c] + 1e-9 else 0.0, c))
    for c in order[: total - sum(quota.values())]:
        quota[c] += 1
    return quota


def one_cell(celled: DataFrame) -> DataFrame:
    """Each id once, in the smallest of its cells."""
    return celled.where("cell_id is not null").groupBy("id").agg(F.min("cell_id").alias("cell_id"))


def _allotted(celled: DataFrame, cells: DataFrame) -> DataFrame:
    spark: SparkSession = celled.sparkSession
    available = {r.cell_id: r.n for r in celled.where("cell_id is not null").groupBy("cell_id").agg(F.countDistinct("id").alias("n")).collect()}  # a row per cell at most
    own = {r.cell_id: r.n for r in one_cell(celled).groupBy("cell_id").agg(F.count("*").alias("n")).collect()}
    n = celled.agg(F.floor(F.countDistinct("id") * SHARE).cast("bigint").alias("n")).first().n or 0
    rows = cells.select("cell_id", "target_permille", "min_rows").collect()
    quota = largest_remainder(n, [(r.cell_id, float(r.target_permille), r.min_rows, own.get(r.cell_id, 0)) for r in rows])
    out = []
    for r in rows:
        needed = max(r.min_rows, n * r.target_permille // 1000)
        out.append((r.cell_id, r.target_permille, r.min_rows, available.get(r.cell_id, 0), quota[r.cell_id], needed, max(0, needed - available.get(r.cell_id, 0))))
    return spark.createDataFrame(out, "cell_id int, target_permille int, min_rows int, available bigint, quota bigint, needed bigint, shortfall bigint")


def allocate(records: DataFrame, targets: DataFrame) -> DataFrame:
    """``cell_id, target_permille, min_rows, available, quota, needed, shortfall`` per cell: how many ids it
    has, how many it gives to a sample of a quarter of all ids, and how many are missing to what it needs.
    Null targets and floors are 0. Quotas are capped by the ids left to a cell when an id of several cells
    counts in the smallest."""
    cells = cells_of(targets)
    return _allotted(with_cell(records, cells), cells)


def draw(records: DataFrame, targets: DataFrame, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """``id, cell_id`` of the sample: per cell the ``quota`` ids with the smallest hash of (seed, id).

    The cut is found from counts per (cell, hash range), so ids of lower ranges are taken by a filter
    and only the range that holds the cut is ranked: no cell is gathered in one task. An id found
    under several labels belongs to its smallest cell. Equal hashes are ordered by id."""
    cells = cells_of(targets)
    celled = with_cell(records, cells)
    quotas = _allotted(celled, cells).select("cell_id", "quota")
    key = F.xxhash64(F.lit(seed), "id")
    shift = 64 - (buckets - 1).bit_length()
    keyed = one_cell(celled).select("id", "cell_id", key.alias("k")).withColumn("b", F.shiftright("k", shift))
    sizes = keyed.groupBy("cell_id", "b").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("cell_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.withColumn("before", before).join(F.broadcast(quotas), "cell_id").where("before < quota").select("cell_id", "b", (F.col("quota") - F.col("before")).alias("want"), "m")
    picked = keyed.join(ranges, ["cell_id", "b"])
    whole = picked.where("m <= want").select("id", "cell_id")
    cut = picked.where("m > want").withColumn("r", F.row_number().over(Window.partitionBy("cell_id", "b").orderBy("k", "id"))).where("r <= want").select("id", "cell_id")
    return whole.unionByName(cut)
