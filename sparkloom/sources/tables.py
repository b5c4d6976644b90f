"""Reading and writing the engine's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from posixpath import normpath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import materialise

#: The curated pages, as doc_id, page and category.
_SITE = "https://scikit-learn.org/stable/"
CURATED = [
    ("supervised_linear_models", "modules/linear_model.html", "supervised_learning"),
    ("supervised_support_vector_machines", "modules/svm.html", "supervised_learning"),
    ("supervised_decision_trees", "modules/tree.html", "supervised_learning"),
    ("supervised_ensemble_methods", "modules/ensemble.html", "supervised_learning"),
    ("supervised_nearest_neighbors", "modules/neighbors.html", "supervised_learning"),
    ("model_selection_cross_validation", "modules/cross_validation.html", "model_selection_evaluation"),
    ("model_selection_hyperparameter_tuning", "modules/grid_search.html", "model_selection_evaluation"),
    ("model_selection_metrics", "modules/model_evaluation.html", "model_selection_evaluation"),
    ("model_selection_curves", "modules/learning_curve.html", "model_selection_evaluation"),
    ("composite_estimators_pipelines", "modules/compose.html", "pipelines_and_composites"),
    ("preprocessing_data_transforms", "modules/preprocessing.html", "preprocessing_and_transforms"),
    ("preprocessing_imputation", "modules/impute.html", "preprocessing_and_transforms"),
    ("best_practices_common_pitfalls", "common_pitfalls.html", "common_pitfalls"),
    ("api_logistic_regression", "modules/generated/sklearn.linear_model.LogisticRegression.html", "api_reference"),
    ("api_random_forest_classifier", "modules/generated/sklearn.ensemble.RandomForestClassifier.html", "api_reference"),
    ("api_pipeline", "modules/generated/sklearn.pipeline.Pipeline.html", "api_reference"),
    ("api_column_transformer", "modules/generated/sklearn.compose.ColumnTransformer.html", "api_reference"),
    ("api_standard_scaler", "modules/generated/sklearn.preprocessing.StandardScaler.html", "api_reference"),
    ("api_grid_search_cv", "modules/generated/sklearn.model_selection.GridSearchCV.html", "api_reference"),
]

BENCHMARK = "question_id string, query string, expected_intent string, expected_complexity string, expected_strategy string, ground_truth_chunk_ids array<string>, target_doc_ids array<string>, reference_answer string, source_urls array<string>"


def curated_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, _SITE + p, c) for d, p, c in CURATED], "doc_id string, url string, category string")


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name), url and html of every .html file below path, where a fetcher has left them."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.html$", 1)
    return rows.select(name.alias("doc_id"), F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


FETCHED = "doc_id string, url string, html string, error string"


def fetch_pages(sources: DataFrame, path: str, fetcher: Callable[[str], str], force: bool = False) -> DataFrame:
    """doc_id, url, html and error of each source (doc_id, url), from the pages kept at path where they are, else fetched and kept.

    fetcher(url) gives a page's html and runs on the executors; a page that it fails on has an error, isn't kept, and so is
    tried again the next time. With force all are fetched anew, and the newest copy of a page counts.
    """
    spark = sources.sparkSession
    wanted = sources.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("url").cast("string").alias("url"))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    numbers = sorted(int(n.partition("=")[2]) for n in names if n.startswith("fetch="))
    number = max(numbers, default=0) + 1

    def read(numbers: list[int]) -> DataFrame:
        schema = f"{FETCHED}, fetch int"
        if not numbers:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/fetch={n}" for n in numbers))

    kept = read(numbers)
    missing = wanted if force else wanted.join(kept.select("doc_id"), "doc_id", "left_anti")

    def one(url: str | None) -> tuple[str | None, str | None]:
        try:
            return fetcher(url), None
        except Exception as e:  # a page's failure is its row's result
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[k] for g in got], pa.string()) for k in (0, 1))], names=["doc_id", "url", "html", "error"])

    now = materialise(missing.mapInArrow(run, FETCHED), "fetched")
    now.where("error is null").write.parquet(f"{path}/fetch={number}")
    newest = Window.partitionBy("doc_id").orderBy(F.desc("fetch"))
    known = read([*numbers, number]).withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "fetch")
    return known.join(wanted.select("doc_id"), "doc_id", "left_semi").unionByName(now.where("error is not null"))


def write_documents(documents: DataFrame, path: str, kind: str = "parquet") -> None:
    """Structured documents, as Parquet or JSON; the write is committed as a whole."""
    documents.write.mode("errorifexists").format(kind).save(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Structured documents from JSON lines; lines that can't be read are left out, as is the manifest."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    names = [c for c in rows.columns if c != "_bad"]
    good = rows.where(F.col("_metadata.file_name") != "manifest.json").select(*names, "_bad")
    return good.where(F.col("_bad").isNull() & F.col("doc_id").isNotNull()).select(*names)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("errorifexists").partitionBy("strategy").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def manifest(documents: DataFrame) -> DataFrame:
    """Per category, and for all as '(all)': documents, characters and words."""
    figures = [F.count("*").alias("documents"), F.sum("char_count").alias("chars"), F.sum("word_count").alias("words")]
    return documents.rollup("category").agg(*figures, F.grouping("category").alias("_all")).select(F.when(F.col("_all") == 1, "(all)").otherwise(F.coalesce("category", F.lit(""))).alias("category"), "documents", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("words", F.lit(0)).alias("words"))


def ingestion_report(documents: DataFrame) -> DataFrame:
    """One row over cleaned pages: totals, failures, headings and sections; a failed page doesn't stop the others."""
    good = F.col("error").isNull()
    return documents.agg(
        F.count("*").alias("total_sources"),
        F.sum(good.cast("int")).alias("processed"),
        F.sum((~good).cast("int")).alias("failed"),
        F.coalesce(F.sum(F.when(good, F.col("char_count"))), F.lit(0)).alias("total_chars"),
        F.coalesce(F.sum(F.when(good, F.col("word_count"))), F.lit(0)).alias("total_words"),
        F.coalesce(F.sum(F.when(good, F.size("headings"))), F.lit(0)).alias("total_headings"),
        F.coalesce(F.sum(F.when(good, F.size("sections"))), F.lit(0)).alias("total_sections"),
    )


def failed_sources(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("error").isNotNull()).select("doc_id", "error")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark questions from a JSON array or object of questions; an empty file raises."""
    rows = spark.read.schema(BENCHMARK).option("multiLine", True).json(path)
    if rows.isEmpty():
        raise ValueError(f"no questions in {path}")
    return rows


def filter_benchmark(questions: DataFrame, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The questions with these ids, then the first `limit` by question_id; a limit below 1 counts as none."""
    if ids:
        questions = questions.where(F.col("question_id").isin(ids))
    return questions.orderBy("question_id").limit(limit) if limit and limit > 0 else questions


def clean_path(path: Column) -> Column:
    """A path without empty and `.` steps, a step before `..` gone with it; what is above the start stays there."""
    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda kept, x: F.when((x == "") | (x == "."), kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(steps, "/"))


def output_problem(outputs: Column, protected: Column) -> Column:
    """What is wrong with an array of output paths: two are the same or one is among the protected; null if nothing is."""
    own, kept = F.transform(outputs, clean_path), F.transform(protected, clean_path)
    bad = F.array_sort(F.array_intersect(own, kept))
    return F.when(F.size(F.array_distinct(own)) < F.size(own), "outputs must differ").when(F.size(bad) > 0, F.concat(F.lit("protected input: "), F.get(bad, F.lit(0))))


def check_outputs(*outputs: str, protected: tuple[str, ...] = ()) -> None:
    """Raise if two outputs are the same path or one is a protected input."""
    clean = [normpath(p) for p in outputs]
    if len(set(clean)) < len(clean):
        raise ValueError("outputs must differ")
    if bad := set(clean) & set(map(normpath, protected)):
        raise ValueError(f"protected input: {sorted(bad)[0]}")


def stamped(results: DataFrame, benchmark: DataFrame) -> DataFrame:
    """results with benchmark_fingerprint, that of the benchmark (one row) where a result has none yet."""
    own = benchmark.select(F.col("fingerprint").alias("_now"))
    met = results.crossJoin(own)  # one row
    given = F.col("benchmark_fingerprint") if "benchmark_fingerprint" in results.columns else F.lit(None).cast("string")
    return met.withColumn("benchmark_fingerprint", F.coalesce(given, F.col("_now"))).drop("_now")


def write_results(results: DataFrame, path: str, benchmark: DataFrame | None = None) -> None:
    """A table of results; readers see all of it or nothing. An existing one is left and raises. With a benchmark's fingerprint it is stamped."""
    (results if benchmark is None else stamped(results, benchmark)).write.mode("errorifexists").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary, a row a system, as JSON; an existing one is left and raises."""
    summary.coalesce(1).write.mode("errorifexists").json(path)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Sample questions, by kind.
SAMPLES = [
    ("fact", "What does the tol parameter of LogisticRegression mean?"),
    ("explanation", "Why should features be scaled before fitting an SVC?"),
    ("procedure", "How do I set up a ColumnTransformer for mixed columns?"),
    ("comparison", "When is RandomForestClassifier a better choice than GradientBoostingClassifier?"),
    ("troubleshooting", "My GridSearchCV ends with a NotFittedError, what is wrong?"),
    ("multi_concept", "How do imputation, scaling and cross-validation fit into one Pipeline?"),
]


def sample_questions(spark: SparkSession) -> DataFrame:
    """question_id, kind, query: questions to begin with, one a kind."""
    return spark.createDataFrame([(f"sample_{i:02d}", k, q) for i, (k, q) in enumerate(SAMPLES, 1)], "question_id string, kind string, query string")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results with the schema given; columns that an older table lacks are null."""
    return spark.read.schema(schema).parquet(path)
