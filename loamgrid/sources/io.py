"""Readers and writers of the formats that document pipelines exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = "Engine string, Corrected string, Dataset string, Image_File string, Font string, Template string, Tables_Expected string, Tables_Found string, GT_Rows string, GT_Cols string, Pred_Rows string, Pred_Cols string, Cell_Accuracy string, Cell_Content_Recall string, Table_CER string, Numeric_Cell_Accuracy string, Numeric_Khmer_Digit_Slips string, Empty_Cell_Precision string, Text_CER string, Document_CER string, Paragraph_Recall string, Paragraph_Leak string, Error string"
TRUTH = "font_family string, template string, document_type string, table_index int, data array<array<string>>, paragraphs array<string>, tables array<struct<data:array<array<string>>>>, footer string, scoring_scope string, text_gt_available boolean, needs_review_rows array<int>"
CORRECTION = "image string, text string, origin string, provenance struct<prediction:string,flags:array<string>,confidence:double,source:string,page:int,table:int,row:int,col:int,bbox:array<int>,engine:string,timestamp:string>"
COCO = "images array<struct<id:long,file_name:string,width:long,height:long>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int,score:double>>, categories array<struct<id:long,name:string>>"


def results(spark: SparkSession, *paths: str) -> DataFrame:
    """Benchmark rows of CSV files and folders, every column as text; blank is not measured. Paths that are missing are skipped."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)]
    if not there:
        return spark.createDataFrame([], RESULTS)
    return spark.read.schema(RESULTS).option("header", True).option("multiLine", True).csv(there)


def truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth JSON, one document a file, with ``name``: the file's stem."""
    df = spark.read.schema(TRUTH).option("multiLine", True).json(path)
    return df.withColumn("name", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(_ground_truth)?\.json$", 1))


def truth_grid(tables: Column, data: Column) -> Column:
    """The first table's grid, else the plain grid."""
    return F.coalesce(F.get(tables, 0)["data"], data)


def truth_lines(paragraphs: Column, footer: Column) -> Column:
    """Non-empty lines of the paragraphs and the footer."""
    parts = F.concat(F.coalesce(paragraphs, F.array().cast("array<string>")), F.array(F.coalesce(footer, F.lit(""))))
    return F.filter(F.flatten(F.transform(parts, lambda p: F.split(p, "\n"))), lambda x: F.trim(x) != "")


def corrections(spark: SparkSession, path: str, flags: Sequence[str] | None = None) -> DataFrame:
    """Correction records of JSON lines; with ``flags`` those that carry one of them."""
    df = spark.read.schema(CORRECTION).json(path)
    return df if flags is None else df.where(F.arrays_overlap("provenance.flags", F.array(*[F.lit(f) for f in flags])))


def coco_boxes(df: DataFrame) -> DataFrame:
    """(file_name, width, height, label, bbox): annotations of COCO files; images without any keep one row, unused categories go."""
    image = df.select(F.explode("images").alias("i"), "annotations", "categories")
    own = image.withColumn("a", F.filter("annotations", lambda a: a["image_id"] == F.col("i.id")))
    out = own.select("i.*", "categories", F.explode_outer("a").alias("a"))
    name = F.filter("categories", lambda c: c["id"] == F.col("a.category_id"))
    return out.select("file_name", "width", "height", F.get(name, 0)["name"].alias("label"), F.col("a.bbox").alias("bbox"))


def yolo_boxes(lines: DataFrame, value: str, width: float, height: float, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., class, x0, y0, x1, y1) in pixels of ``class cx cy w h`` lines; shorter lines are skipped."""
    p = F.split(F.trim(value), r"\s+")
    d = lines.withColumn("__p", p).where(F.size("__p") >= 5)
    at = lambda i: F.get("__p", i).cast("double")
    return d.select(*keep, F.col("__p")[0].cast("int").alias("class"), ((at(1) - at(3) / 2) * width).alias("x0"), ((at(2) - at(4) / 2) * height).alias("y0"), ((at(1) + at(3) / 2) * width).alias("x1"), ((at(2) + at(4) / 2) * height).alias("y1"))


def route_by_suffix(name: Column) -> Column:
    """``pdf`` or ``image`` by the file name's suffix; null for anything else."""
    return F.when(F.lower(name).rlike(r"\.pdf$"), "pdf").when(F.lower(name).rlike(r"\.(png|jpe?g|tiff?|bmp|webp)$"), "image")


def auto_dpi(densities: DataFrame, by: str, density: str) -> DataFrame:
    """(by, dpi): 200 where every page image has 250 pixels an inch or none was measured, else 300."""
    return densities.groupBy(by).agg(F.when(F.min(density) < 250, 300).otherwise(200).alias("dpi"))


def text_class(khmer: Column, latin: Column, total: Column) -> Column:
    """What a page's text layer is: scanned, khmer, mixed or latin."""
    ratio = khmer / F.greatest(khmer + latin, F.lit(1))
    return F.when(total < 100, "scanned").when(ratio >= 0.5, "khmer").when(ratio >= 0.15, "mixed").otherwise("latin")


def append(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends rows whose key the Parquet table at ``path`` does not have yet."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df = df.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    df.write.mode("append").parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """One folder for each split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def sheet_name(name: Column) -> Column:
    """A workbook's sheet name: without what such names cannot hold, 31 characters at most."""
    return F.substring(F.regexp_replace(name, r"[\[\]:*?/\\]", "_"), 1, 31)
