"""Readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a schema, so nothing is inferred and only the columns in use are parsed."""
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str, header: str | None = None) -> DataFrame:
    """With a header line. `header` also drops every row whose first column starts with it, as joined files have."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows if header is None else rows.where(~F.coalesce(F.col(rows.columns[0]).cast("string").startswith(header), F.lit(False)))


def csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Types from a pass over the file."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def points(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an id and numbers: (id string, vec array<double>, file)."""
    part = F.split("value", ",")
    return spark.read.text(path).where("value <> ''").select(part[0].alias("id"), F.transform(F.slice(part, 2, F.size(part)), lambda x: x.cast("double")).alias("vec"), F.input_file_name().alias("file"))


def chunks(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The points of each file of a folder, in the order of the files' names."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = jvm.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().toString() for f in files if f.isFile() and f.getPath().getName()[0] not in "._")
    return [points(spark, n) for n in names]


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def json_map(spark: SparkSession, path: str, value: str = "int") -> DataFrame:
    """One JSON object a file, as rows (key, value)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One file, for results that are read by hand."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_model(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """The column `line` of ordered rows as one text file: a report, read by hand."""
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)


def quoted(items) -> Column:
    return F.concat(F.lit("'"), F.array_join(items, "', '"), F.lit("'"))


def object_line(row: DataFrame) -> DataFrame:
    """(line): the one row as a JSON object with sorted keys."""
    return row.select(F.to_json(F.struct(*sorted(row.columns)), {"ignoreNullFields": "false"}).alias("line"))


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """(size, line): the itemsets of each size in one line, in order."""
    one = F.concat(F.lit("("), quoted("items"), F.lit(")"))
    rows = itemsets.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("items", one.alias("s")))).alias("r"))
    return rows.select("size", F.array_join(F.transform("r", lambda x: x["s"]), ",").alias("line")).orderBy("size")


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """(line): candidates and frequent itemsets under their titles, an empty line after each size."""
    parts = []
    for k, (title, sets) in enumerate((("Candidates:", candidates), ("Frequent Itemsets:", frequent))):
        parts.append(sets.sparkSession.createDataFrame([(k, 0, title)], "part int, size int, line string"))
        rows = itemset_lines(sets).select(F.lit(k).alias("part"), "size", F.explode(F.array("line", F.lit(""))).alias("line"))
        parts.append(rows)
    return reduce(DataFrame.unionAll, parts).orderBy("part", "size", F.desc("line")).select("line")


def comparison_lines(compared: DataFrame) -> DataFrame:
    """(line): the sizes of two sets of itemsets and of what they share."""
    return compared.select(F.explode(F.array(*(F.concat(F.lit(t), F.col(c).cast("string")) for t, c in (("First: ", "n_first"), ("Second: ", "n_second"), ("Intersection: ", "n_both"))))).alias("line"))


def betweenness_lines(values: DataFrame) -> DataFrame:
    """(line): edges and their values, the largest first, equal ones by name."""
    pair = F.concat(F.lit("('"), F.col("a").cast("string"), F.lit("', '"), F.col("b").cast("string"), F.lit("'), "), F.col("value").cast("string"))
    return values.orderBy(F.desc("value"), F.col("a").cast("string"), F.col("b").cast("string")).select(pair.alias("line"))


def chunk_lines(report: DataFrame) -> DataFrame:
    """(line): the counts of BFR after each chunk, under a header."""
    names = ["round_id", "nof_cluster_discard", "nof_point_discard", "nof_cluster_compression", "nof_point_compression", "nof_point_retained"]
    rows = report.select(F.col("chunk").alias("k"), F.concat_ws(", ", *(F.col(c).cast("string") for c in ("discard", "n_discard", "compressed", "n_compressed", "retained"))).alias("line"))
    rows = rows.select("k", F.concat((F.col("k") + 1).cast("string"), F.lit(", "), "line").alias("line"))
    head = report.sparkSession.createDataFrame([(-1, ",".join(names))], "k int, line string")
    return head.unionAll(rows).orderBy("k").select("line")


def label_object(labels: DataFrame, key: str = "id", value: str = "cluster") -> DataFrame:
    """(line): one JSON object of id to label, in the order of ids; for results that are read by hand."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return labels.agg(F.to_json(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"].cast("string"), p["v"])))).alias("line"))


def sample_lines(sampled: DataFrame, ranks: int = 3) -> DataFrame:
    """(line): how many records the reservoir has seen, and its tags with one of the `ranks` highest counts."""
    levels = F.slice(F.sort_array(F.array_distinct(F.transform("tags", lambda t: t["n"])), asc=False), 1, ranks)
    held = F.array_sort(F.filter("tags", lambda t: F.array_contains(levels, t["n"])), lambda x, y: F.when((x["n"] > y["n"]) | ((x["n"] == y["n"]) & (x["tag"] < y["tag"])), -1).otherwise(1))
    lines = F.concat(F.array(F.concat(F.lit("The number of records with tags from the beginning: "), F.col("seen").cast("string"))), F.transform(held, lambda t: F.concat(t["tag"], F.lit(" : "), t["n"].cast("string"))), F.array(F.lit("")))
    return sampled.orderBy("seen").select(F.explode(lines).alias("line"))


def averages_object(averages: DataFrame, mean: DataFrame) -> DataFrame:
    """(json): one object of id to average, with the mean of all under UNK."""
    rows = averages.select(F.col("id").cast("string").alias("k"), F.col("avg").alias("v")).unionAll(mean.select(F.lit("UNK"), "avg"))
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("json"))


def community_lines(members: DataFrame) -> DataFrame:
    """(size, line) of each community, members quoted and in order."""
    rows = members.groupBy("community").agg(F.sort_array(F.collect_list(F.col("id").cast("string"))).alias("m"))
    return rows.select(F.size("m").alias("size"), F.concat(F.lit("'"), F.array_join("m", "', '"), F.lit("'")).alias("line")).orderBy("size", "line")
