"""Readers for the library's inputs; a missing optional source is an empty table, not an error."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, author, text) of text files named ``Title -- Author.ext``; other suffixes get an error column."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    parts = F.split(F.url_decode(name), " -- ", 2)
    return files.select(
        "path", F.trim(F.get(parts, 0)).alias("title"), F.nullif(F.trim(F.get(parts, 1)), F.lit("")).alias("author"),
        F.when(kind.isin("txt", "text", "md"), F.col("value")).alias("text"), F.when(~kind.isin("txt", "text", "md"), F.concat(F.lit("unsupported format: "), kind)).alias("error"),
    )


def csv_table(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A CSV or TSV file with a given schema; a byte-order mark is dropped. A row that does not fit stays, as text in column ``broken``."""
    reader = spark.read.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
    return reader.option("encoding", "UTF-8").csv(path, sep=sep, header=header, enforceSchema=True)


def surnames(spark: SparkSession, path: str) -> DataFrame:
    rows = csv_table(spark, path, "name string, rank int")
    return rows.where("rank <> 0 and name is not null and not contains(trim(name), ' ')").select(F.lower(F.trim("name")).alias("name")).distinct()


def places(spark: SparkSession, path: str) -> DataFrame:
    rows = csv_table(spark, path, "id string, name string, ascii string", sep="\t", header=False)
    return rows.where("ascii is not null and not contains(trim(ascii), ' ')").select(F.lower(F.trim("ascii")).alias("name")).distinct()


def gazetteer(**kinds: DataFrame) -> DataFrame:
    """(name, kind) of all sources."""
    out = None
    for kind, rows in kinds.items():
        part = rows.select("name", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def lexicon(spark: SparkSession, path: str, lemmas: DataFrame, language: str = "en") -> DataFrame:
    """(word, pos, ipas) of a JSON-lines dictionary dump, for the words of ``lemmas`` (lemma) only; ``broken_lines`` has the rest."""
    schema = "word string, lang_code string, pos string, sounds array<struct<ipa string>>"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).where(F.col("lang_code") == language)
    rows = rows.join(lemmas.select(F.col("lemma").alias("word")), "word", "left_semi")
    ipas = F.filter(F.transform(F.coalesce("sounds", F.array().cast("array<struct<ipa string>>")), lambda s: s["ipa"]), lambda x: x.isNotNull())
    return rows.select("word", "pos", F.explode_outer(ipas).alias("ipa")).groupBy("word", "pos").agg(F.sort_array(F.collect_set("ipa")).alias("ipas"))


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a JSON-lines file that are no JSON objects."""
    return spark.read.text(path).where(F.try_parse_json("value").isNull() & (F.trim("value") != "")).select(F.col("value").alias("line"))


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the same schema where there is none."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def html_sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, section, title, text): text cut at h1 to h3 headings; scripts and styles dropped, blank sections skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from html.parser import HTMLParser

        class Sections(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.parts, self.hidden, self.heading = [[None, []]], 0, False

            def handle_starttag(self, tag, attrs):
                if tag in ("script", "style"):
                    self.hidden += 1
                elif tag in ("h1", "h2", "h3"):
                    self.parts.append(["", []])
                    self.heading = True

            def handle_endtag(self, tag):
                if tag in ("script", "style"):
                    self.hidden = max(0, self.hidden - 1)
                elif tag in ("h1", "h2", "h3"):
                    self.heading = False

            def handle_data(self, data):
                if self.hidden or not data.strip():
                    return
                if self.heading:
                    self.parts[-1][0] += data.strip()
                else:
                    self.parts[-1][1].append(data.strip())

        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = Sections()
                p.feed(text or "")
                p.close()
                n = 0
                for title, lines in p.parts:
                    if lines:
                        n += 1
                        out.append((k, n, title if title and len(title) <= 80 else f"Section {n}", "\n".join(lines)))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[key, "section", "title", "text"])

    return pages.select(F.col(key).cast("long").alias(key), html).mapInArrow(run, f"{key} long, section int, title string, text string")
