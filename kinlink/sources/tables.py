"""Readers and writers of the tables that the engine exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

RECORD = Y.StructType([Y.StructField(c, Y.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = Y.StructType([Y.StructField("source1_entity_id", Y.StringType()), Y.StructField("matched_entity_ids", Y.StringType())])


def read_tsv(spark: SparkSession, path: str | list[str], schema: Y.StructType = RECORD, null_tokens: list[str] | None = None) -> DataFrame:
    """A tab-separated table with a header, without quotes. Extra cells are dropped, missing ones null.

    Strings of ``null_tokens`` (such as :data:`kinlink.functions.vocabulary.NULL_TOKENS`) are read as null.
    """
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    if null_tokens is None:
        return rows
    return rows.select(*[F.when(~F.col(c).isin(null_tokens), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def find_first(spark: SparkSession, roots: list[str], name: str) -> str:
    """The path of the first file called ``name`` below the first root that has one, in any store that Spark reads."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for root in roots:
        path = files.Path(root)
        store = path.getFileSystem(conf)
        if not store.exists(path):
            continue
        listed, found = store.listFiles(path, True), []
        while listed.hasNext():
            one = listed.next().getPath()
            if one.getName() == name:
                found.append(one.toString())
        if found:
            return min(found)
    raise FileNotFoundError(f"no file {name} below {', '.join(roots)}")


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The spine (s1_id) and the links (s1_id, cand_id) of a truth table; empty, null and nan mean no link."""
    rows = read_tsv(spark, path, TRUTH).withColumnRenamed("source1_entity_id", "s1_id")
    return rows.select("s1_id").distinct(), links_of(rows, "matched_entity_ids")


def links_of(rows: DataFrame, column: str) -> DataFrame:
    """s1_id and cand_id of comma-joined ids: trimmed, without empty ones."""
    joined = F.when(~F.lower(F.trim(column)).isin("nan", ""), F.col(column))
    ids = F.filter(F.transform(F.split(joined, ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("s1_id", F.explode(ids).alias("cand_id"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank values of the first cell of a tab-separated table with a header."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return rows.select(F.trim(F.col(f"`{rows.columns[0]}`")).alias("cand_id")).where("cand_id <> ''").distinct()


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path and megabytes of the files of a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.round(F.col("length") / 1e6, 2).alias("megabytes"))


def table_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table, files and megabytes of named tables (files or folders). Only the files' lengths are read."""
    out = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        one = files.agg(F.lit(name).alias("table"), F.count("*").alias("files"), F.round(F.sum("length") / 1e6, 2).alias("megabytes"))
        out = one if out is None else out.unionByName(one)
    return out


def joined_links(spine: DataFrame, links: DataFrame, order: str | None = None) -> DataFrame:
    """s1_id and the comma-joined ids of every entity: by ``order`` descending, ties and otherwise by id."""
    key = F.struct((-F.col(order)).alias("o"), F.col("cand_id").alias("cand_id")) if order else F.struct("cand_id")
    per = links.groupBy("s1_id").agg(F.array_sort(F.collect_set(key)).alias("ids"))
    return spine.select("s1_id").join(per, "s1_id", "left").select("s1_id", F.coalesce(F.array_join(F.transform("ids", lambda x: x["cand_id"]), ","), F.lit("")).alias("ids"))


def write_pairs(rows: DataFrame, path: str, header: tuple[str, str]) -> None:
    """Entity and joined ids as tab-separated text without quotes; an empty list is an empty cell."""
    rows.select(F.col("s1_id").alias(header[0]), F.col("ids").alias(header[1])).write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").mode("overwrite").csv(path)


def write_outputs(spine: DataFrame, matches: DataFrame, candidates: DataFrame, folder: str, order: str | None = "prob") -> None:
    """The two tables of a run, matches and candidates, each with one row for every entity of the spine.

    Both come from the same spine, so they have the same entities; matches are ordered by ``order`` descending.
    """
    write_pairs(joined_links(spine, matches, order if order in matches.columns else None), f"{folder}/matches", ("source1_entity_id", "matched_entity_ids"))
    write_pairs(joined_links(spine, candidates, order if order in candidates.columns else None), f"{folder}/candidates", ("source1_entity_id", "candidate_entity_ids"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A table of experiments, written over an older one."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a log; only the part that starts the log has the header."""
    store = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    old = store.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(store)
    (rows if old else rows.coalesce(1)).write.mode("append").option("header", not old).csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a log. Header lines hold the columns' names, so the first cell tells them from rows."""
    first = spark.createDataFrame([], schema).columns[0]
    rows = spark.read.schema(", ".join(f"{c} string" for c in spark.createDataFrame([], schema).columns)).csv(path)
    types = dict(spark.createDataFrame([], schema).dtypes)
    return rows.where(F.col(first) != first).select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """place and line of a report table: title, header, rule and one line a row, by the columns' order.

    Lines are made where the rows are; place orders rows by all cells after the three head lines.
    """
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    head = [f"### {title}", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    top = rows.sparkSession.createDataFrame(list(enumerate(head)), "place long, line string")
    ordered = Window.orderBy("line")  # reports are short: a row a column, strategy, policy or class
    return top.unionByName(rows.select(cells.alias("line")).select((F.row_number().over(ordered) + 2).cast("long").alias("place"), "line"))
