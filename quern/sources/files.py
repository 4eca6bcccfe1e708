"""Readers and writers: corpora as JSON arrays, divider documents, binary directories, YAML and JSON contracts, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import urls
from quern.sources.scratch import create_once, names_in

CHUNKS = (
    "chunk_id string, section_title string, heading_level string, heading_id string, parent_section string, source_url string, document_type string, "
    "start_line int, end_line int, block_comment string, instruction string, total_test_cases int, page_start int, has_encoding_table boolean, document_text string"
)
INSTRUCTIONS = "name string, xlen int, num_registers int, instructions array<struct<mnemonic string, format string, opcode string, funct3 string, funct7b5 int>>"
MANIFEST = "slug string, file_hash string"


#: A table with less than this for each core is dealt over all cores, as the row groups of its few files can't be split.
SMALL_BYTES_A_CORE = 4 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder. Large ones are read as they lie, without a shuffle."""
    out, cores = spark.read.parquet(f"{folder}/{name}.parquet"), spark.sparkContext.defaultParallelism
    size = int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of the files; runs no job
    return out.repartition(cores) if size < cores * SMALL_BYTES_A_CORE else out


def stream_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A Parquet table of a folder as a stream of its files, be the table one file or a folder of parts. The path is a pattern
    that fits this name alone, as only of a pattern may Spark's file stream find a file."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _slug(suffix: str):
    return F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*){suffix}$", 1)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """slug and the chunk columns of all *_chunks.json in a folder, each a JSON array."""
    return spark.read.schema(CHUNKS).option("multiLine", True).json(f"{folder}/*_chunks.json").select(_slug("_chunks\\.json").alias("slug"), "*")


def read_views(spark: SparkSession, folder: str) -> DataFrame:
    """slug, text of all *_full_doc.md in a folder."""
    return spark.read.text(f"{folder}/*_full_doc.md", wholetext=True).select(_slug("_full_doc\\.md").alias("slug"), F.col("value").alias("text"))


def read_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """slug, file_hash of the chunk files."""
    return spark.read.format("binaryFile").load(f"{folder}/*_chunks.json").select(F.regexp_extract("path", r"([^/]*)_chunks\.json$", 1).alias("slug"), F.md5("content").alias("file_hash"))


def read_tree(spark: SparkSession, folder: str, max_depth: int = 4) -> DataFrame:
    """path, name, source_type, file_slug, text of a directory tree, deeper files and files to skip left out."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.substr("path", F.locate(folder.split("://")[-1].rstrip("/"), F.col("path")) + len(folder.split("://")[-1].rstrip("/")) + 1)
    d = d.withColumn("depth", F.size(F.split(below, "/")) - 1).filter(F.col("depth") <= max_depth)
    name = F.element_at(F.split("path", "/"), -1)
    d = d.withColumns({"name": name, "source_type": urls.source_type(F.col("path")), "file_slug": urls.file_slug(name)}).filter("source_type <> 'SKIP'")
    return d.select("path", "name", "source_type", "file_slug", F.decode("content", "UTF-8").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """slug, file_hash; a manifest that isn't there is empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Written after everything that it vouches for."""
    manifest.select("slug", "file_hash").coalesce(1).write.mode("overwrite").parquet(path)


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """ord, mnemonic, format, opcode, funct3, funct7b5 of an instruction set's JSON; a path that isn't there fails."""
    d = spark.read.schema(INSTRUCTIONS).option("multiLine", True).json(path)
    return d.select(F.posexplode("instructions").alias("ord", "i")).select("ord", "i.*")


def read_yaml(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Rows of the list under `key` of a small YAML document; needs PyYAML, which is optional."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the package PyYAML") from e
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(yaml.safe_load(text)[key], schema)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """A folder by slug; a slug that is written again replaces its rows."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def divider_document(chunks: DataFrame) -> DataFrame:
    """slug, text: chunks (slug, ord, chunk_id, section_title, document_text) behind their dividers, in order."""
    part = F.concat(F.lit("\n\n---\n<!-- chunk_id="), "chunk_id", F.lit(" | "), "section_title", F.lit(" -->\n\n"), "document_text")
    return chunks.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("t")))), lambda x: x["t"]), "").alias("text"))


def write_texts(rows: DataFrame, path: str, by: str) -> None:
    """One folder of text for each value of `by`; rows: by, text."""
    rows.select(by, F.col("text").alias("value")).write.mode("overwrite").partitionBy(by).option("lineSep", "\n").text(path)


def claim_version(spark: SparkSession, path: str, version: int | None = None) -> int:
    """The next version of a folder of runs, or the one asked for, for this writer alone: of writers at the same time each
    gets its own. A version that is claimed and never committed stays unused."""
    if version is not None:
        if not create_once(spark, f"{path}/_claims/{version:09d}"):
            raise ValueError(f"version {version} of {path} is taken")
        return version
    version = max([int(n) for n in names_in(spark, f"{path}/_claims")], default=0) + 1
    while not create_once(spark, f"{path}/_claims/{version:09d}"):
        version += 1
    return version


def write_run(results: DataFrame, path: str, version: int | None = None) -> int:
    """Results of an evaluation under version=N; earlier versions stay. Returns N."""
    version = claim_version(results.sparkSession, path, version)
    results.write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version


def run_report(stats: DataFrame, title: str) -> DataFrame:
    """One row, text: a Markdown table of (name, value), in order of name."""
    line = F.concat(F.lit("| "), "name", F.lit(" | "), F.col("value").cast("string"), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("l")))), lambda x: x["l"]), "\n")
    return stats.agg(F.concat(F.lit(f"# {title}\n\n| name | value |\n| --- | --- |\n"), rows).alias("text"))


RUN_LINES = "artifact string, ord long, line string"


def write_run_tables(artifacts: DataFrame, path: str, version: int | None, when: str, label: str) -> str:
    """One run: its artifacts (artifact, ord, line) as a table for each, and then one empty file in the list of runs, which
    vouches for them: a run whose writer fails before is never read. Without a version the next free one is claimed.
    Returns the run's name."""
    spark = artifacts.sparkSession
    run = f"run_v{claim_version(spark, path, version):03d}_{when}_{label}"
    artifacts.select("artifact", F.col("ord").cast("long").alias("ord"), "line").write.partitionBy("artifact").parquet(f"{path}/artifacts/run={run}")
    create_once(spark, f"{path}/_runs/{run}")
    return run


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """run, version, at, label of the runs that are whole."""
    names = spark.createDataFrame([(n,) for n in names_in(spark, f"{path}/_runs")], "run string")
    part = lambda i: F.regexp_extract("run", r"^run_v(\d+)_([^_]*)_(.*)$", i)
    return names.select("run", part(1).cast("int").alias("version"), part(2).alias("at"), part(3).alias("label"))


def read_latest_run(spark: SparkSession, path: str) -> DataFrame:
    """run, artifact, ord, line of the whole run whose name is the last by its text; none: no row."""
    names = names_in(spark, f"{path}/_runs")
    if not names:
        return spark.createDataFrame([], f"run string, {RUN_LINES}")
    rows = spark.read.schema(RUN_LINES).parquet(f"{path}/artifacts/run={names[-1]}")
    return rows.select(F.lit(names[-1]).alias("run"), "artifact", "ord", "line")


FACTS = "alu_operations array<string>, memory_sizes array<string>, immediate_formats array<string>, writeback_sources array<string>, branch_conditions array<string>"


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """kind, pos, item of a facts JSON: the vocabularies, by the kinds that contracts know them by; missing lists give no rows."""
    from quern.operators.contract import FACTS as names

    d = spark.read.schema(FACTS).option("multiLine", True).json(path)
    lists = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("items")) for k, c in names.items()))
    return d.select(F.explode(lists).alias("l")).select("l.kind", F.posexplode("l.items").alias("pos", "item")).select("kind", F.col("pos").cast("int").alias("pos"), "item")


SPANS = "doc string, page int, seq int, text string, size double"


def read_spans(spark: SparkSession, folder: str) -> DataFrame:
    """doc, seq, text, size, page of text spans that a PDF reader has written as JSON lines, one file or more a document:
    blank spans go."""
    return spark.read.schema(SPANS).json(folder).filter(F.trim("text") != "").select("doc", "seq", "text", "size", "page")


def hierarchy(spark: SparkSession, folder: str, manifest_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One job over a folder of chunk files, views and a manifest: (parents, children of all sources, children of the sources
    that are new or changed by their hash). The manifest is written by the caller, after what it vouches for."""
    from quern.operators import incremental

    parents = read_chunks(spark, folder)
    kids = incremental.children(parents, read_views(spark, folder))
    new = incremental.changed_sources(read_hashes(spark, folder), read_manifest(spark, manifest_path)).filter("is_new").select("slug")
    return parents, kids, kids.join(new, "slug", "left_semi")
