"""Readers and writers: tables, text and the bioinformatics formats, all by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_dataframe(spark: SparkSession, path: str, sep: str = "infer", header: bool = True) -> DataFrame:
    """Parquet, JSON, or delimited text (plain, gz or bz2) by the file's name."""
    name = path.removesuffix(".gz").removesuffix(".bz2")
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".json"):
        return spark.read.json(path)
    return spark.read.csv(path, sep=("," if name.endswith(".csv") else "\t") if sep == "infer" else sep, header=header, inferSchema=True)


def write_dataframe(df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    if path.endswith(".parquet"):
        w.parquet(path, compression=compression)
    else:
        w.csv(path, sep="," if ".csv" in path else "\t", header=True, compression=compression)


def read_wide(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A labelled matrix file in long form."""
    wide = read_dataframe(spark, path)
    key = key or wide.columns[0]
    return wide.melt([key], [c for c in wide.columns if c != key], "attr", "v").withColumnRenamed(key, "obs").withColumn("v", F.col("v").cast("double"))


def read_textfile(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines with their numbers in each file."""
    return read_textfile_raw(spark, path).withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", ""))


def read_textfile_raw(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line`` (from 0) and ``value``; a file is read in splits of any number, whose lines are counted first."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    sizes = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))  # a row a split
    before = sizes.select("file", "start", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "start").orderBy("id")) - 1
    return lines.withColumn("at", inside).join(before, ["file", "start"]).select("file", (F.col("before") + F.col("at")).cast("int").alias("line"), "value")


def read_fasta(spark: SparkSession, path: str, description: bool = False, case: str = "upper") -> DataFrame:
    """``seq_id`` and ``seq``; without descriptions an id is its first word.  A record begins with ``>`` at the start of a line."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where("length(trim(value)) > 0")
    head = F.regexp_replace(F.trim(F.substring_index("value", "\n", 1)), r"\s+$", "")
    body = F.regexp_replace(F.expr("substr(value, length(substring_index(value, '\n', 1)) + 2)"), r"\s", "")
    seq = {"upper": F.upper, "lower": F.lower}.get(case, lambda c: c)(body)
    return records.select((head if description else F.regexp_extract(head, r"^\S*", 0)).alias("seq_id"), seq.alias("seq"))


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


BLAST = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"


def read_blast(spark: SparkSession, path: str, more: str = "", query_lengths: DataFrame | None = None) -> DataFrame:
    """Tabular hits, best bit score first; with query lengths (``qseqid``, ``qlength``), the covered share ``qratio``."""
    hits = spark.read.csv(path, sep="\t", schema=f"{BLAST}, {more}" if more else BLAST)
    if query_lengths is not None:
        hits = hits.join(query_lengths, "qseqid", "left").withColumn("qratio", (F.col("qend") - F.col("qstart")) / F.col("qlength"))
    return hits.orderBy(F.desc("bitscore"))


GFF = "seq_record string, source string, seq_type string, pos_start long, pos_end long, score string, sense string, phase string, data_fields string"


def read_gff(spark: SparkSession, path: str, kind: str = "gff3", seq_type: str | None = None) -> DataFrame:
    """Annotations with their fields as a map: ``k=v;`` (gff3) or ``k "v";`` (gtf)."""
    rows = spark.read.csv(path, sep="\t", schema=GFF, comment="#", quote="")
    fields = F.rtrim(F.col("data_fields"))
    parts = F.filter(F.transform(F.split(fields, ";"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    mark = "=" if kind == "gff3" else " "
    entry = lambda p: F.struct(F.substring_index(p, mark, 1).alias("k"), F.replace(F.substr(p, F.length(F.substring_index(p, mark, 1)) + 2), F.lit('"'), F.lit("")).alias("v"))
    rows = rows.withColumn("fields", F.map_from_entries(F.transform(parts, entry)))
    return rows.where(F.col("seq_type") == seq_type) if seq_type else rows


def read_distmat(spark: SparkSession, path: str) -> DataFrame:
    """A square distance matrix of aligned sequences a file, as cells."""
    lines = read_textfile(spark, path).where("length(value) > 0 and value not like '#%' and not value rlike '^[0-9]+$'")
    parts = F.split(F.regexp_replace("value", r"^\d+:\s+", ""), r"\s+")
    rows = lines.select("file", F.row_number().over(Window.partitionBy("file").orderBy("line")).alias("i"), parts.alias("p"))
    names = rows.select("file", (F.col("i") - 1).alias("j"), F.col("p")[0].alias("attr"))
    cells = rows.select("file", F.col("p")[0].alias("obs"), F.posexplode(F.slice("p", F.lit(2), F.size("p") - 1)).alias("j", "v"))
    return cells.join(names, ["file", "j"]).select("obs", "attr", F.col("v").cast("double").alias("v"))


def read_hierarchy_json(spark: SparkSession, path: str) -> DataFrame:
    """A four-level nested hierarchy (``name``, ``children``) flattened, with ids and names of its leaves."""
    leaf = "struct<name:string>"
    schema = f"name string, children array<struct<name:string,children:array<struct<name:string,children:array<struct<name:string,children:array<{leaf}>>>>>>>"
    x = spark.read.json(path, schema=schema, multiLine=True)
    for k, at in ((1, "children"), (2, "c1.children"), (3, "c2.children"), (4, "c3.children")):
        x = x.withColumn(f"c{k}", F.explode(at))
    full = F.col("c4.name")
    ident = F.substring_index(full, " ", 1)
    rest = F.trim(F.expr("substr(c4.name, length(substring_index(c4.name, ' ', 1)) + 2)"))
    named = F.when(ident.rlike("^(M|RM|N)"), rest).when(ident.startswith("K"), F.trim(F.substring_index(full, ";", -1))).otherwise(F.raise_error(F.concat(F.lit("unknown identifier "), ident)))
    return x.select(F.col("c1.name").alias("level_1"), F.col("c2.name").alias("level_2"), F.col("c3.name").alias("level_3"), full.alias("level_4"), ident.alias("id"), named.alias("name"))


def read_sample_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Keys and values of sample records: ``data[].attributes`` lists of key and value."""
    schema = "data array<struct<id:string,attributes:struct<`sample-metadata`:array<struct<key:string,value:string>>,key:string,value:string>,relationships:struct<sample:struct<data:struct<id:string>>>>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("data").alias("d"))
    return rows.select(F.col("d.relationships.sample.data.id").alias("sample"), F.col("d.attributes.key").alias("key"), F.col("d.attributes.value").alias("value"))


def read_module_record(spark: SparkSession, path: str) -> DataFrame:
    """Sections of a flat record, in order: a keyword at the line's start carries forward."""
    lines = read_textfile_raw(spark, path)
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    key = F.when(F.col("value").rlike(r"^\S"), F.regexp_extract("value", r"^(\S+)", 1))
    body = F.trim(F.when(F.col("value").rlike(r"^\S"), F.regexp_replace("value", r"^\S+", "")).otherwise(F.col("value")))
    rows = lines.where("value not like '///%' and length(trim(value)) > 0").select("file", "line", F.last(key, ignorenulls=True).over(w).alias("section"), body.alias("value"))
    return rows.groupBy("file", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda r: r["value"]).alias("values"))


def ortholog_set(definition):
    """The members named in a module's definition."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.translate(definition, "(+ -)", ",,,,,"), ","), lambda p: F.length(p) > 0)))


def expand_modules(modules: DataFrame) -> DataFrame:
    """Members (``module``, ``members``) with nested modules replaced by their orthologs, one level; others than K and M drop out."""
    flat = modules.select("module", F.explode("members").alias("member"))
    inner = flat.select(F.col("module").alias("member"), F.col("member").alias("nested")).where("nested like 'K%'")
    own = flat.where("member like 'K%'")
    nested = flat.where("member like 'M%'").join(inner, "member").select("module", F.col("nested").alias("member"))
    return own.unionByName(nested).groupBy("module").agg(F.array_sort(F.collect_set("member")).alias("members"))


def read_quality_table(spark: SparkSession, path: str, kind: int = 8) -> DataFrame:
    """Genome quality: kind 2 is a table, sorted by completeness and contamination; kind 8 has a row a marker gene and ORF."""
    if kind == 2:
        rows = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
        rows = rows.toDF(*[c.strip().lower().replace(" ", "_").replace("#_", "n_") for c in rows.columns])
        return rows.orderBy(F.desc("completeness"), "contamination")
    rows = spark.read.csv(path, sep="\t", schema="bin string, orfs string, markers string")
    orfs = rows.select("bin", F.explode(F.split("orfs", "&&")).alias("orf"), F.split("markers", ";").alias("markers"))
    return orfs.withColumn("contig", F.regexp_replace("orf", "_[^_]*$", ""))


def read_synopses(spark: SparkSession, pattern: str) -> DataFrame:
    """Synopsis tables below a directory, with the submodel from the folder's name."""
    rows = spark.read.csv(pattern, sep="\t", header=True, inferSchema=True).withColumn("__file", F.input_file_name())
    folder = F.element_at(F.split("__file", "/"), -2)
    return rows.withColumn("submodel", F.element_at(F.split(folder, "_"), 2)).drop("__file")


def accuracy_trace(spark: SparkSession, path: str) -> DataFrame:
    """Baseline and the accuracies of a log, in order."""
    lines = read_textfile(spark, path).where("value like '%Accuracy=%' or value like '%Baseline=%'")
    num = lambda k: F.nullif(F.regexp_extract("value", rf"{k}=([0-9.eE+-]+)", 1), F.lit("")).cast("double")
    rows = lines.select("file", "line", num("Accuracy").alias("a"), num("Baseline").alias("b"))
    return rows.groupBy("file").agg(F.min_by("b", F.when(F.col("b").isNotNull(), F.col("line"))).alias("baseline"), F.transform(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("line", "a")))), lambda r: r["a"]).alias("trace"))


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """GMT lines (name, description, features) as ``set_name``, ``feature``."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("set_name"), F.explode(F.slice(parts, F.lit(3), F.size(parts) - 2)).alias("feature"))


def read_xml_attributes(spark: SparkSession, path: str, row: str = "BioSample") -> DataFrame:
    """Attributes of sample records in XML: ``id``, ``name``, ``value``."""
    schema = "_accession string, Attributes struct<Attribute:array<struct<_VALUE:string,_attribute_name:string>>>"
    rows = spark.read.format("xml").options(rowTag=row).schema(schema).load(path)
    return rows.select(F.col("_accession").alias("id"), F.explode("Attributes.Attribute").alias("a")).select("id", F.col("a._attribute_name").alias("name"), F.col("a._VALUE").alias("value"))


def read_hits_table(spark: SparkSession, path: str) -> DataFrame:
    """Profile hits in blank-separated columns with ``#`` comments: target, query, e-value, score and description."""
    p = F.split(F.trim("value"), r"\s+", 19)
    rows = spark.read.text(path).where("value not like '#%' and length(trim(value)) > 0").select(p.alias("p"))
    at = lambda k: F.col("p")[k]
    return rows.select(at(0).alias("target"), at(1).alias("target_accession"), at(2).alias("query"), at(3).alias("query_accession"), at(4).cast("double").alias("evalue"), at(5).cast("double").alias("score"), at(18).alias("description"))


def read_key_value_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``key |<tab>value`` of an alignment log."""
    rows = read_textfile(spark, path).where("instr(value, '|') > 0")
    return rows.select("file", F.trim(F.substring_index("value", "|", 1)).alias("key"), F.trim(F.regexp_replace("value", r"^[^|]*\|", "")).alias("value"))


def read_marker_genes(spark: SparkSession, path: str) -> DataFrame:
    """Marker lists: gene, accession and source of their profile."""
    return spark.read.csv(path, sep="\t", header=True).toDF("gene", "accession", "source")


def database(spark: SparkSession, folder: str, name: str | None = None):
    """A Parquet table of a folder, or the names of all."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    names = sorted(f.getPath().getName().removesuffix(".parquet") for f in files if f.getPath().getName().endswith(".parquet"))
    return names if name is None else spark.read.parquet(f"{folder}/{name}.parquet")
