"""Writers: JSON lines, reports, group sheets, resumable results, and replacement in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.session import drop_table


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON object a line, characters as they are. An existing folder is an error unless overwrite is set."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_messages(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Training rows: messages is the only key."""
    write_jsonl(df.select("messages"), path, overwrite)


def report_json(counts: DataFrame, **parts: object) -> str:
    """A small table of counts and given parts as a JSON text; the table is an aggregate."""
    rows = [r.asDict(recursive=True) for r in counts.collect()]
    return json.dumps(parts | {"counts": rows}, ensure_ascii=False, indent=2, sort_keys=True)


def write_groups(df: DataFrame, path: str, digits: int = 6) -> None:
    """A CSV with a header, doubles rounded; one file, since the rows are groups."""
    cols = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_results(new: DataFrame, path: str, key: str) -> DataFrame:
    """Append results whose key is not there yet; what a broken run has written is not done again."""
    spark = new.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
        done = spark.read.schema(new.schema).parquet(path)
        new = new.join(done.select(key), key, "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap: the old table is moved away and the new one to its place.

    A table is complete wherever it has the target's name; between the two renames nothing has it, so a reader that opens the
    target then must try again. If the second rename fails, the old table is put back and the error raised; it is only
    deleted when the new one stands.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    beside, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    df.write.parquet(beside)
    fs = at(path).getFileSystem(conf)
    there = fs.exists(at(path))
    if there and not fs.rename(at(path), at(old)):
        drop_table(spark, beside)
        raise OSError(f"{path} could not be moved away; it is as it was")
    if not fs.rename(at(beside), at(path)):
        if there and not fs.rename(at(old), at(path)):
            raise OSError(f"{path} could not be replaced; the old table is in {old}, the new one in {beside}")
        raise OSError(f"{path} could not be replaced; the new table is in {beside}")
    if there:
        drop_table(spark, old)


def score_markdown(slices: DataFrame) -> str:
    """A Markdown table of accuracies by slice (an aggregate)."""
    head = "| slice | value | n | accuracy | 95 % |\n|---|---|---:|---:|---|\n"
    row = lambda r: f"| {r['slice']} | {r['value']} | {r['n']} | {r['accuracy'] * 100:.2f} | {r['low'] * 100:.2f}–{r['high'] * 100:.2f} |"
    return head + "\n".join(row(r) for r in slices.orderBy("slice", "value").collect())


def evaluation_export(records: DataFrame, metadata: DataFrame, unit: str = "unit_hash") -> DataFrame:
    """Questions in the evaluation layout with metadata recovered by hash; the first row of a hash gives it, else defaults."""
    first = metadata.groupBy(unit).agg(F.min_by(F.struct("exam_type", "exam_class", "exam_subject", "question_type"), "row_id").alias("m"))
    d = records.join(first, unit, "left")
    kind = F.when(F.length("gold") > 1, "多项选择题").otherwise("单项选择题")
    pick = lambda c, default: F.when(F.col("m").isNull(), default).otherwise(F.coalesce(f"m.{c}", F.lit(""))).alias(c)
    option = F.map_from_entries(F.transform("options", lambda o: F.struct(o["letter"], o["text"])))
    return d.select(F.col("sample_id").alias("id"), pick("exam_type", F.lit("医学")), pick("exam_class", F.lit("")), pick("exam_subject", F.lit("")), "question", pick("question_type", kind), option.alias("option"), F.trim("gold").alias("answer"))
