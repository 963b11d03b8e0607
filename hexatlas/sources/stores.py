"""Store layouts. Every writer spreads a large key over several tasks and files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexatlas.functions.systems import CellSystem, whole_quotient
from hexatlas.operators.tiling import PRUNE_RES

ROWS_PER_FILE = 20_000_000


def write_model_cells(cells: DataFrame, path: str) -> None:
    """Model-oriented layout, ``mdl_id=<id>/``, for reading one model.

    Rebalancing by id lets adaptive execution split an oversized model and join small
    ones, so one model with a third of all rows is several tasks and several files.
    """
    (cells.hint("rebalance", F.col("mdl_id"))
     .sortWithinPartitions("mdl_id", "cell_id")
     .write.partitionBy("mdl_id").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path))


def read_model(spark: SparkSession, path: str, mdl_id: int) -> DataFrame:
    """One model's partition as a grid layer; the filter prunes to one directory."""
    return (spark.read.parquet(path).where(F.col("mdl_id") == int(mdl_id))
            .select("cell_id", F.col("val").cast("double").alias("value")))


def grid_block(cell: Column, columns: int, step: int) -> Column:
    """Folder of a grid cell: the square of ``step`` cells a side that it lies in.

    Ids count from 1 along rows of ``columns`` cells.
    """
    at = cell.cast("long") - 1
    row, col = whole_quotient(whole_quotient(at, columns), step), whole_quotient(at % columns, step)
    return row * -(-columns // step) + col


def write_cell_models(cells: DataFrame, path: str, columns: int, step: int) -> None:
    """Cell-oriented layout of the same rows, ``block=<square>/``, for reading an area.

    An area opens the squares that it touches and, in them, the row groups of its cells. The
    range includes the model, so a cell shared by every model can still be split.
    """
    order = ["block", "cell_id", "mdl_key"]
    (cells.withColumn("block", grid_block(F.col("cell_id"), columns, step))
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .write.partitionBy("block").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path))


def write_blocks(rows: DataFrame, path: str, system: CellSystem, folders: list[str] | None = None,
                 order: list[str] | None = None, prune_res: int = PRUNE_RES, blocks: bool = True) -> None:
    """Rows with ``hex_prune``, in folders by ``folders`` and coarse block, for reading tiles.

    Within a block, files follow a curve through the coarse cells, so a file is a compact piece
    of the map, and a file's rows are sorted by ``order`` (else along the curve). Rows coarser
    than the prune column have no block. The range goes on over ``order``, so that a coarse cell
    with a third of all rows is several files.
    """
    folders, order = [*(folders or []), *(["block"] if blocks else [])], order or []
    curve = system.curve(F.col("hex_prune"))
    placed = rows.withColumn("block", system.block(F.col("hex_prune"), prune_res)) if blocks else rows
    keys = order or [curve, "cell_id"]
    (placed.repartitionByRange(*folders, curve, *(order or ["cell_id"])).sortWithinPartitions(*folders, *keys)
     .write.partitionBy(*folders).option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path))


def write_occurrence_store(store: DataFrame, path: str, system: CellSystem) -> None:
    """Folders by resolution and block; a file's rows by taxonomy, so a taxon skips row groups."""
    taxonomy = [c for c in ("phylum", "class", "order", "family", "genus", "species", "aphiaid")
                if c in store.columns]
    write_blocks(store, path, system, ["res"], [*taxonomy, "hex_prune", "cell_id"])


def write_cell_index(index: DataFrame, path: str, system: CellSystem) -> None:
    """Folders by resolution and block; rows along the curve, so a tile skips row groups."""
    write_blocks(index, path, system, ["res"])


def write_taxon_index(index: DataFrame, path: str, system: CellSystem) -> None:
    """Folders by rank and resolution, files along the curve, a file's rows by taxon.

    Ranks and resolutions are some twenty folders already; a tile skips files by the range
    of ``hex_prune`` that their footers give.
    """
    write_blocks(index, path, system, ["rank", "res"], ["taxon", "hex_prune", "cell_id"], blocks=False)


def write_tile_documents(documents: DataFrame, path: str) -> None:
    """Tile documents in folders by zoom; files are ranges of tiles, so one tile skips the rest."""
    order = ["z", "x", "y", "part"]
    documents.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("z").parquet(path)


def serve(spark: SparkSession, path: str, view: str) -> DataFrame:
    """A view over a store's files: nothing is copied, filters reach the files."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(view)
    return df


def write_release(df: DataFrame, base: str, release: str) -> str:
    """Write one immutable release, ``release=<name>/``, and make it the current one.

    The commit comes last: a release whose writer failed is never current.
    """
    path = f"{base}/release={release}"
    df.write.mode("error").parquet(path)
    make_current(df.sparkSession, base, release)
    return path


_COMMIT = "seq long, release string"


def _commits(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(_COMMIT).parquet(f"{base}/commits")


def make_current(spark: SparkSession, base: str, release: str) -> None:
    """Point "current" at a release, a new one or an earlier one, by one more commit record.

    Records are only added, so a reader sees the old release or the new one, never neither.
    """
    try:
        seq = 1 + (_commits(spark, base).agg(F.max("seq").alias("s")).first()["s"] or 0)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        seq = 1
    (spark.range(1).select(F.lit(seq).cast("long").alias("seq"), F.lit(release).alias("release"))
     .coalesce(1).write.mode("append").parquet(f"{base}/commits"))


def current_release(spark: SparkSession, base: str) -> str:
    """Name in the last commit record; of two written at once, the greater name."""
    last = _commits(spark, base).orderBy(F.desc("seq"), F.desc("release")).first()
    if last is None:
        raise ValueError(f"no release has been committed below {base}")
    return last["release"]


def read_release(spark: SparkSession, base: str, release: str | None = None) -> DataFrame:
    """The named release, or the current one. Only that release's folder is listed and read."""
    name = current_release(spark, base) if release is None else release
    return spark.read.option("basePath", base).parquet(f"{base}/release={name}")
