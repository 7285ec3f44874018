"""Corpora in: text files, CSV, labelled tables, category lists; and a cache of prepared ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.order import numbered
from ..operators.sample import balanced_sample

# The eight categories of the Reuters R8 subset.
R8 = ("earn", "acq", "money-fx", "grain", "crude", "trade", "interest", "ship")
# The class names of two public datasets, by class number.
LABELS = {
    "ag_news": ("World", "Sports", "Business", "Sci/Tech"),
    "dbpedia_14": tuple(
        """Company EducationalInstitution Artist Athlete OfficeHolder MeanOfTransportation Building NaturalPlace
        Village Animal Plant Album Film WrittenWork""".split()
    ),
}


def text_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``doc_id, path, text``: whole files, numbered by path."""
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return numbered(files, "path", name="doc_id").select("doc_id", "path", "text")


def csv_texts(spark: SparkSession, path: str, content: str = "content") -> DataFrame:
    """Rows of a CSV file with a header and quoted line ends; rows without content are dropped."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').dropna(subset=[content])


def labelled(train: DataFrame, test: DataFrame, names: tuple[str, ...], text: str = "text", label: str = "label") -> DataFrame:
    """Both splits in one: stripped texts that are not blank, class numbers made names."""
    both = train.select(text, label).unionByName(test.select(text, label))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col(label).cast("int") + 1)
    return both.select(strip(F.col(text)).alias("text"), name.alias("label")).filter("text <> ''")


def topic_list(topics: Column) -> Column:
    """A literal list of strings ("['earn', 'acq']") as an array; anything else is empty."""
    return F.coalesce(F.from_json(F.replace(topics, F.lit("'"), F.lit('"')), "array<string>"), F.array().cast("array<string>"))


def one_category(rows: DataFrame, text: str = "text", topics: str = "topics", wanted: tuple[str, ...] = R8, blank: bool = False) -> DataFrame:
    """Rows with exactly one of the wanted categories (and any others): text, label. Blank texts are dropped unless ``blank``."""
    lists = F.col(topics) if rows.schema[topics].dataType.typeName() == "array" else topic_list(F.coalesce(F.col(topics), F.lit("[]")))
    hits = F.filter(F.transform(lists, F.lower), lambda c: c.isin(*wanted))
    out = rows.select(strip(F.coalesce(F.col(text), F.lit(""))).alias("text"), hits.alias("hits"))
    return out.filter((F.size("hits") == 1) & (F.lit(blank) | (F.col("text") != ""))).select("text", F.col("hits")[0].alias("label"))


def corpus_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated corpus: text, split and optional label."""
    rows = spark.read.csv(path, sep="\t", quote="")
    return rows.toDF(*["text", "split", "label"][: len(rows.columns)])


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ag_news": lambda s, p: labelled(s.read.parquet(f"{p}/train"), s.read.parquet(f"{p}/test"), LABELS["ag_news"]),
    "dbpedia_14": lambda s, p: labelled(s.read.parquet(f"{p}/train"), s.read.parquet(f"{p}/test"), LABELS["dbpedia_14"], "content"),
    "reuters_r8": lambda s, p: one_category(s.read.parquet(f"{p}/train").unionByName(s.read.parquet(f"{p}/test"))),
    "octis": lambda s, p: corpus_tsv(s, f"{p}/corpus.tsv"),
}


def load_dataset(spark: SparkSession, name: str, path: str, n_docs: int | None = None, seed: int = 42, cache: str | None = None) -> DataFrame:
    """A dataset by name, below ``path``; ``n_docs`` takes a sample balanced by class.

    With ``cache`` (a folder), what was prepared is kept there as Parquet, in a folder for each way of calling,
    and read from there the next time.
    """
    if name not in LOADERS:
        raise ValueError(f"dataset must be one of {sorted(LOADERS)}")
    asked = {"dataset": name, "docs": "all" if n_docs is None else n_docs, "seed": seed}
    at = "/".join([cache.rstrip("/"), *(f"{k}-{v}" for k, v in asked.items())]) if cache else None
    if at and _exists(spark, f"{at}/_SUCCESS"):
        return spark.read.parquet(at)
    rows = LOADERS[name](spark, path)
    if n_docs is not None and "label" in rows.columns:
        rows = balanced_sample(rows, n_docs, key="text", seed=seed)
    if at:
        rows.write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)
    return rows


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
