"""Sources and sinks: CSV, JSON, JSON lines, parquet tables of an index, and small reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text as X

# Names under which book fields come.
ALIASES = {
    "id": ("bookId", "book_id", "id", "bookID"), "title": ("title", "book_title", "name"), "author": ("author", "authors", "writer"),
    "description": ("description", "descriptions", "summary", "text"), "genres": ("genres", "genre"), "characters": ("characters", "character"), "languages": ("languages", "language"),
    "publish_date": ("publish_date", "publication_date", "publishedDate", "published"), "num_pages": ("num_pages", "pages", "number_of_pages"), "avg_rating": ("avg_rating", "average_rating", "rating"),
}
LISTS = ("genres", "characters", "languages")
PRODUCT_COLUMNS = ("product_id", "title", "product_text", "image_path")
QUERY_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("query_id", "query_text", "query_image_path", "query_type", "split")])
SPARSE_SCHEMA = "product_id string, indices array<int>, values array<float>, error string"
INDEX_NAMES = ("postings", "doc_lengths", "field_stats", "tiers")


def books_of(df: DataFrame) -> DataFrame:
    """Book records of a table with any of the known column names, the first that isn't empty counting.

    Without an identifier column, rows are numbered in file order.
    """
    lower = {}
    for i, c in enumerate(df.columns):
        lower.setdefault(c.lower().lstrip("﻿"), i)
    t = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])

    def first(name: str):
        found = [F.nullif(F.col(f"__c{lower[a.lower()]}").cast("string"), F.lit("")) for a in dict.fromkeys(x.lower() for x in ALIASES[name]) if a in lower]
        return F.coalesce(*found, F.lit(None).cast("string")) if found else F.lit(None).cast("string")

    t = _numbered(t) if not any(a.lower() in lower for a in ALIASES["id"]) else t.withColumn("__row", F.monotonically_increasing_id())
    cols = [F.coalesce(first("id"), F.col("__row").cast("string")).alias("id")]
    cols += [(X.split_list(first(n)) if n in LISTS else F.coalesce(first(n), F.lit(""))).alias(n) for n in ALIASES if n != "id"]
    return t.select(*cols)


def _numbered(t: DataFrame) -> DataFrame:
    """Row numbers from 0 in file order: rows are counted per partition, then each partition starts where the one before ends."""
    t = t.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    from pyspark.sql import Window as W

    n = t.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    n = n.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return t.join(F.broadcast(n), "__p").withColumn("__row", F.col("__before") + F.col("__i")).drop("__p", "__i", "__before")  # a row per input partition


def read_books_csv(spark: SparkSession, path: str) -> DataFrame:
    """Book records of a CSV with header; a byte-order mark, quotes and line breaks in fields are handled."""
    return books_of(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def prepare(spark: SparkSession, csv: str, raw: str, preprocessed: str) -> None:
    """The CSV's records as JSON lines, raw and with index terms in place of the searchable fields."""
    books = read_books_csv(spark, csv)
    books.write.mode("overwrite").json(raw)
    preprocess_books(books).write.mode("overwrite").json(preprocessed)


def preprocess_books(books: DataFrame) -> DataFrame:
    """Searchable fields as term lists; ``descriptions`` fills a missing description."""
    t = books
    if "descriptions" in t.columns:
        joined = F.array_join("descriptions", " ") if dict(t.dtypes)["descriptions"].startswith("array") else F.col("descriptions")
        t = t.withColumn("description", F.coalesce(F.nullif(F.col("description"), F.lit("")), joined) if "description" in t.columns else joined)
    kinds = dict(t.dtypes)
    return t.withColumns({n: X.terms(X.stringify(F.col(n), kinds[n].startswith("array"))) for n in ("title", "description", "descriptions", "author", "genres", "characters") if n in kinds})


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_records(spark: SparkSession, path: str, schema: str = "id string, title string, description string") -> DataFrame:
    """Records of a JSON file that holds a list, an object with data/books/records/items, or an object of records.

    Records without title or description go. Lists of tokens are joined by spaces.
    """
    raw = spark.read.text(path, wholetext=True).select("value")
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]
    rec = f"struct<{', '.join(f'{f}:string' for f in fields)}>"
    listed = F.from_json("value", f"array<{rec}>")
    keyed = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), f"array<{rec}>") for k in ("data", "books", "records", "items")])
    values = F.map_values(F.from_json("value", f"map<string,{rec}>"))
    t = raw.select(F.inline(F.coalesce(F.when(F.trim("value").startswith("["), listed), keyed, values)))
    for f in fields:
        tokens = F.from_json(F.col(f), "array<string>")
        t = t.withColumn(f, F.when(F.col(f).startswith("["), F.coalesce(F.array_join(F.transform(tokens, lambda x: F.trim(x)), " "), F.col(f))).otherwise(F.col(f)))
    return t.where(" and ".join(f"trim(coalesce({f}, '')) <> ''" for f in ("title", "description") if f in fields))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines don't count."""
    r = spark.read
    return (r.schema(schema) if schema else r).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_catalog(spark: SparkSession, path: str, required: Sequence[str] = PRODUCT_COLUMNS) -> DataFrame:
    t = spark.read.parquet(path)
    if missing := sorted(set(required) - set(t.columns)):
        raise ValueError(f"the catalog lacks columns: {missing}")
    return t


def query_violations(q: DataFrame) -> DataFrame:
    """(query_id, violation) of query records: a known type, and the text or image that it needs."""
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    msgs = F.array_compact(F.array(
        F.when(~some("query_id"), "query_id is missing"), F.when(~F.coalesce(F.col("query_type").isin("text", "image", "image_text"), F.lit(False)), "unknown query_type"),
        F.when(F.col("query_type").isin("text", "image_text") & ~some("query_text"), "query_text is missing"), F.when(F.col("query_type").isin("image", "image_text") & ~some("query_image_path"), "query_image_path is missing"), F.when(~some("split"), "split is missing")))
    return q.select("query_id", F.explode(msgs).alias("violation"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    q = spark.read.schema(QUERY_SCHEMA).json(path)
    if bad := query_violations(q).limit(30).collect():
        raise ValueError("invalid queries:\n" + "\n".join(f"{r['query_id']}: {r['violation']}" for r in bad))
    return q


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPARSE_SCHEMA).json(path)


def sparse_long(df: DataFrame, id_col: str = "product_id") -> DataFrame:
    """(id, dim, weight) of rows with indices and values; failed rows have none."""
    z = F.arrays_zip(F.col("indices").alias("dim"), F.col("values").alias("weight"))
    return df.select(F.col(id_col).alias("id"), F.inline(z)).select("id", "dim", F.col("weight").cast("double").alias("weight"))


def index_path(root: str, table: str) -> str:
    if table not in INDEX_NAMES:
        raise ValueError(f"no index table {table!r}; there are {INDEX_NAMES}")
    return f"{root.rstrip('/')}/{table}"


def write_index(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as parquet, partitioned by field, so a search reads the fields with weight only."""
    for name, t in tables.items():
        t.write.mode("overwrite").partitionBy("field").parquet(index_path(root, name))


def read_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(index_path(root, n)) for n in INDEX_NAMES}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is at ``path``, on any file system that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first of ``paths`` that is there; none raises an error instead of giving a default."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError(f"none of {list(paths)} exists")


def index_exists(spark: SparkSession, root: str) -> bool:
    return all(exists(spark, index_path(root, n)) for n in INDEX_NAMES)


def write_manifest(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON row of build parameters with the time of writing."""
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at")).coalesce(1).write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row per run and query type


def write_pool(pool: DataFrame, path: str) -> None:
    pool.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """An annotated pool; empty cells stay empty strings."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, content) of the image files below ``path``, found by their base names."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png,webp}").load(path)
    return t.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", "content")


def resolve_images(df: DataFrame, images: DataFrame, path_col: str) -> DataFrame:
    """``df`` with ``resolved``, the path of the image of the same base name, or null."""
    one = images.groupBy("name").agg(F.min("path").alias("resolved"))
    return df.withColumn("__n", F.regexp_extract(path_col, r"([^/\\]+)$", 1)).join(one, F.col("__n") == F.col("name"), "left").drop("__n", "name")


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A small table as Markdown; over ``limit`` rows raise an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a report is for small tables")
    show = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(x) for x in r) + " |" for r in rows]) + "\n"
