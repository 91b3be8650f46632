"""CSV, JSON and JSON-lines files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import schemas
from paperloom.operators.corpus import last_wins
from paperloom.sources.store import Versions

CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
BOM = "﻿"


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.EXAM_RAW) -> DataFrame:
    """Records with quoted line breaks and doubled quotes; a byte order mark is dropped. Columns are matched by name, so an index column in front does no harm."""
    df = spark.read.options(**CSV).csv(path)
    names = {re.sub(BOM, "", c): c for c in df.columns}
    return df.select(*[(F.col(f"`{names[f.name]}`").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """A folder of CSV files, each with a header. With bom each begins with a byte order mark, as spreadsheets want it: it is written as part of the first column's name."""
    out = df.toDF(BOM + df.columns[0], *df.columns[1:]) if bom else df
    out.write.mode("overwrite").options(header="true", escape='"').csv(path)


def export_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """One file on the driver, for hand-over of small tables. Rows stream partition by partition; write_csv writes large ones."""
    import csv

    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(tuple("" if v is None else v for v in row) for row in df.toLocalIterator())


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of documents (schemas.CORPUS), in a file, a folder of files, or one that write_corpus keeps; content stays JSON text.

    A missing file is an error, damaged records are left out.
    """
    _, record = Versions(spark, path).latest()
    place = f"{path.rstrip('/')}/{record['folders'][0]}" if record else path
    return spark.read.schema(schemas.CORPUS).option("multiLine", "true").json(place).filter("doc_id is not null")


def corpus_by_id(corpus: DataFrame) -> DataFrame:
    """One row an id of what read_corpus gives; of equal ids the last in file order counts.

    That is by the part's number, the file's name and the place in the file, which one task reads in order; the order in which Spark
    deals files to tasks is another, as it goes by their size.
    """
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long")
    placed = corpus.select("*", part.alias("_part"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_pos"))
    return last_wins(placed, ["doc_id"], ["_part", "_file", "_pos"]).drop("_part", "_file", "_pos")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines label log; blank lines are skipped, a missing list is empty."""
    rows = spark.read.schema(schemas.LABELS).json(path).filter("id is not null")
    return rows.withColumn("gold_doc_ids", F.coalesce("gold_doc_ids", F.array().cast("array<string>")))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines. path must not be one that df reads."""
    df.write.mode("overwrite").json(path)


def write_corpus(df: DataFrame, path: str) -> int:
    """Make df the corpus at path, as a new version, and give its number. Each file is a JSON array, one record a line; non-ASCII characters stay.

    df may read path itself. What was there counts until the new version's files and record are whole, and stays readable for one version more.
    """

    def lines(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            rows = [("[" if first and not k else ",") + x for k, x in enumerate(batch.column(0).to_pylist())]
            first = first and not rows
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], names=["value"])

    versions = Versions(df.sparkSession, path)
    base, _ = versions.latest()
    folder = versions.folder("corpus")
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(lines, "value string").write.text(versions.full(folder))
    return versions.commit(base, {"folders": [folder]})


def corpus_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """The corpus at path; where nothing is there, or nothing that can be read, an empty one to start from."""
    try:
        return read_corpus(spark, path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.CORPUS)


def read_predictions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """id, model, answer of several prediction files, one a model."""
    parts = [read_csv(spark, p, schemas.PREDICTIONS).withColumn("model", F.lit(m)) for m, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "model", "answer")


def latest_checkpoint(names: DataFrame, column: str = "path") -> DataFrame:
    """The path that ends in checkpoint-N with the highest N."""
    n = F.regexp_extract(F.col(column), r"checkpoint-(\d+)/?$", 1).try_cast("int")
    return names.withColumn("_n", n).filter("_n is not null").agg(F.max_by(F.col(column), F.col("_n")).alias(column))


def read_pairs(manifest: DataFrame) -> DataFrame:
    """name, exam_text, sheet_text, error for manifest(name, exam, sheet), a table of paths.

    Tasks read the files, each row's by itself; a file that can't be read, or is no UTF-8, gives no text, and error names it and why. The rest goes on.
    A byte order mark is dropped. Errors of both files of a row are joined by a line break.
    """

    def read(batches):
        import pyarrow as pa

        from paperloom.sources.remote import read_bytes

        def text_of(path: str | None) -> tuple[str | None, str | None]:
            if path is None:
                return None, "no path"
            try:
                return read_bytes(path).decode("utf-8-sig"), None
            except (OSError, ValueError, pa.ArrowException) as e:
                return None, f"{path}: {type(e).__name__}"

        for batch in batches:
            exam, sheet = ([text_of(x) for x in batch.column(k).to_pylist()] for k in (1, 2))
            errors = ["\n".join(x for x in (a[1], b[1]) if x) or None for a, b in zip(exam, sheet, strict=True)]
            columns = [batch.column(0), *(pa.array(x, pa.string()) for x in ([a[0] for a in exam], [b[0] for b in sheet], errors))]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "exam_text", "sheet_text", "error"])

    return manifest.select(F.col("name").cast("string"), F.col("exam").cast("string"), F.col("sheet").cast("string")).mapInArrow(read, "name string, exam_text string, sheet_text string, error string")
