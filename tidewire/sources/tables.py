"""Tables from files and to files: labelled CSV sets, task sequences, TSV sets, reports, and an append-only task log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.corpora import encode_categories, finite_or_zero, impute_mean

# Columns that identify rows, and the one that leaks the label, in public intrusion sets.
FLOW_IDS = ("Flow ID", "Source IP", "Destination IP", "Timestamp")
LEAKS = ("attack_cat",)


def labelled_csv(spark: SparkSession, path: str, label: str | None = None, drop: tuple[str, ...] = (), share: float | None = None) -> DataFrame:
    """A CSV set with a header: the label column (the last unless named) as label, numbers imputed by their means."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    label = label or df.columns[-1]
    df = df.drop(*drop).withColumnRenamed(label, "label")
    df = df.sample(share, seed=7) if share else df
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float") and f.name != "label"]
    return impute_mean(df, numbers) if numbers else df


def flow_set(spark: SparkSession, path: str) -> DataFrame:
    """Flow statistics: identifiers go, infinities and nulls become 0, the column Label becomes label: 1 for anything but BENIGN."""
    df = spark.read.csv(path, header=True, inferSchema=True, ignoreLeadingWhiteSpace=True)
    df = df.toDF(*[c.strip() for c in df.columns]).drop(*FLOW_IDS)
    own = next(c for c in df.columns if c.lower() == "label")
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name != own]
    out = finite_or_zero(df, numbers)
    return out.select(*[c for c in out.columns if c != own], (F.trim(F.col(own).cast("string")) != "BENIGN").cast("int").alias("label"))


def connection_set(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows without a header and with the given names: texts as codes, label is 1 for anything but normal, difficulty goes."""
    df = spark.read.csv(path, inferSchema=True).toDF(*names)
    df = df.withColumn("label", (F.col("label") != "normal").cast("int")).drop("difficulty")
    for c in [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]:
        df = encode_categories(df, c).drop(c).withColumnRenamed("code", c)
    return df


def attack_set(spark: SparkSession, path: str) -> DataFrame:
    """A set with a label column; its id and the category that leaks the label go, texts become codes, infinities 0."""
    df = spark.read.csv(path, header=True, inferSchema=True).drop("id", *LEAKS)
    assert not set(LEAKS) & set(df.columns)
    for c in [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name != "label"]:
        df = encode_categories(df, c).drop(c).withColumnRenamed("code", c)
    return finite_or_zero(df, [f.name for f in df.schema.fields if f.dataType.typeName() == "double"])


def labelled_tsv(spark: SparkSession, path: str) -> DataFrame:
    """label, text_a, and text_b or logits (as numbers) where the header has them."""
    df = spark.read.csv(path, sep="\t", header=True)
    df = df.withColumn("label", F.col("label").cast("int"))
    return df.withColumn("logits", F.split("logits", " ").cast("array<double>")) if "logits" in df.columns else df


def sequence_text(value: Column) -> Column:
    """Labels of a sequence written with ->, arrows, commas, semicolons or line breaks, also full-width ones."""
    return F.filter(F.transform(F.split(value, r"->|→|[,;\n，；、]"), lambda x: F.trim(x)), lambda x: x != "")


def task_sequences(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines of task sequences without comments and blank ones: a column seq."""
    own = lines.where(~F.trim(text).startswith("#") & (F.trim(text) != ""))
    return own.select("*", sequence_text(F.col(text)).alias("seq")).where(F.size("seq") > 0)


#: Keys under which a file of task sequences may hold them, the first that isn't empty counts; and those of its map of action ids.
TASK_KEYS, MAP_KEYS = ("sequences", "normal_sequences", "task_sequences", "normal_templates", "training_sequences", "templates"), ("actions", "action_map")


def _entry(entry: Column) -> Column:
    """The labels of an entry of JSON text: a list of values, or an object that has one as sequence or actions; null for neither."""
    labels = lambda c: F.from_json(c, "array<string>")
    return F.when(entry.startswith("["), labels(entry)).when(entry.startswith("{"), F.coalesce(labels(F.get_json_object(entry, "$.sequence")), labels(F.get_json_object(entry, "$.actions"))))


def task_sequences_json(text: Column, known: Column | None = None) -> Column:
    """Sequences of a JSON text: a list of entries, or an object that has one under a usual key. An entry is a list of labels or an object.

    Labels are trimmed, blank ones and entries without any left out. Ids that the text's own map of actions has, or else `known` (a
    map column), become its labels; a number is found with and without decimals (3, 3.0).
    """
    whole = F.trim(text)
    lists = [F.from_json(F.get_json_object(whole, f"$.{k}"), "array<string>") for k in TASK_KEYS]
    own = F.when(whole.startswith("["), F.from_json(whole, "array<string>")).otherwise(F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists]))
    maps = [F.from_json(F.get_json_object(whole, f"$.{k}"), "map<string,string>") for k in MAP_KEYS]
    names = F.coalesce(*[F.when(F.size(m) > 0, m) for m in maps], *([known] if known is not None else []))
    label = lambda x: F.coalesce(names[F.trim(x)], names[F.regexp_replace(F.trim(x), r"^(-?[0-9]+)\.0+$", "$1")], F.trim(x))
    cleaned = F.transform(F.filter(F.transform(own, _entry), lambda e: e.isNotNull()), lambda e: F.filter(F.transform(F.array_compact(e), lambda x: F.trim(label(x))), lambda x: x != ""))
    return F.filter(cleaned, lambda e: F.size(e) > 0)


# The sequences that stand for a task file where there is none, of those whose labels are all known.
DEFAULT_TASKS = [["hello", "walk", "step"], ["hello", "jump"], ["walk", "step", "jump"]]


def default_tasks(labels: DataFrame, column: str = "label") -> DataFrame:
    """seq: the default sequences whose labels are all among the given ones; if there are none, one sequence of all different labels in order.

    Labels are a vocabulary; no labels give no sequence.
    """
    spark, own = labels.sparkSession, labels.select(F.col(column).alias("label")).where("label IS NOT NULL").distinct()
    tasks = spark.createDataFrame([(i, t) for i, t in enumerate(DEFAULT_TASKS)], "i int, seq array<string>")
    held = tasks.select("i", F.explode("seq").alias("label")).join(own, "label").groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    usable = tasks.join(held, "i").where(F.col("n") == F.size("seq")).select("i", "seq")
    all_ = own.agg(F.lit(len(DEFAULT_TASKS)).alias("i"), F.sort_array(F.collect_list("label")).alias("seq")).where(F.size("seq") > 0)
    both = usable.unionByName(all_).withColumn("least", F.min("i").over(Window.partitionBy()))
    return both.where((F.col("i") < len(DEFAULT_TASKS)) | (F.col("least") == len(DEFAULT_TASKS))).select("seq")


def write_report(df: DataFrame, folder: str, by: tuple[str, ...] = (), kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    writer.option("header", "true").format(kind).save(folder)


def write_splits(df: DataFrame, folder: str, columns: tuple[str, ...] = ("label", "text_a")) -> None:
    """A TSV set for each split, and the test set again without labels."""
    df.select("split", *columns).write.mode("overwrite").partitionBy("split").option("sep", "\t").option("header", "true").csv(f"{folder}/labelled")
    df.where("split = 'test'").select(*[c for c in columns if c != "label"]).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(f"{folder}/unlabelled")


def preview(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The first n rows of the columns that exist: numbers rounded to 6 digits, nulls as blanks, and the total count."""
    own = [c for c in columns if c in df.columns]
    kinds = dict(df.dtypes)
    shown = [F.round(c, 6).alias(c) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in own]
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.select(*shown).limit(n).crossJoin(F.broadcast(total))


def latest_tasks(log: DataFrame) -> DataFrame:
    """The state of each task of an append-only log: its last row, the first created_at, the last report that isn't null."""
    last = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("seq"))
    kept = log.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "created_at", "report")
    more = log.groupBy("id").agg(F.min("created_at").alias("created_at"), F.max_by("report", F.when(F.col("report").isNotNull(), F.struct("updated_at", "seq"))).alias("report"))
    return kept.join(more, "id")


def find_tasks(tasks: DataFrame, module: str | None = None, owner: int | None = None, keyword: str | None = None, since: str | None = None) -> DataFrame:
    """Tasks by module, owner, words of the title and day, newest first."""
    out = tasks
    out = out.where(F.col("module") == module) if module else out
    out = out.where(F.col("owner") == owner) if owner is not None else out
    out = out.where(F.lower("title").contains(keyword.lower())) if keyword else out
    out = out.where(F.col("created_at") >= F.lit(since)) if since else out
    return out.orderBy(F.desc("created_at"), "id")


def page(tasks: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """Rows of a page, pages from 1."""
    return tasks.orderBy(*order).offset((number - 1) * size).limit(size)


def low_confidence(df: DataFrame, confidence: str, order: list[str], least: float = 50.0, n: int = 10) -> DataFrame:
    """The first n rows, in order, whose confidence is below the given one; nulls aren't."""
    return df.where(F.col(confidence) < least).orderBy(*order).limit(n)


def combine_dimensions(key: str, parts: dict[str, DataFrame], failed: str = "ERROR") -> DataFrame:
    """key and a status for each part: parts are (key, status) tables joined in full; a part without a row for a key failed there."""
    out = None
    for name, part in parts.items():
        own = part.select(key, F.col("status").alias(name))
        out = own if out is None else out.join(own, key, "full")
    return out.select(key, *[F.coalesce(name, F.lit(failed)).alias(name) for name in parts])


# Names of the risk levels of a task.
HIGH_RISK, TO_CONFIRM, NO_RISK = "高风险", "待确认", "正常"


def task_risk(module: Column, summary: Column) -> Column:
    """The risk of a task by its module and its summary as JSON: the status of conformance tasks, else ratios and counts of what was found."""
    get = lambda k: F.get_json_object(summary, f"$.{k}")
    number = lambda *keys: F.coalesce(*[get(k).try_cast("double") for k in keys], F.lit(0.0))
    ratio, status = number("high_or_critical_ratio", "ratio"), get("status")
    conformance = F.when(status == "ANOMALY", HIGH_RISK).when(status == "UNKNOWN_VALIDITY", TO_CONFIRM).otherwise(NO_RISK)
    other = F.when((ratio >= 0.15) | (number("invalid_transition_count") > 0), HIGH_RISK).when((ratio >= 0.05) | (number("abnormal") > 0), TO_CONFIRM).otherwise(NO_RISK)
    return F.when(module == "papb", conformance).otherwise(other)


def evidence_rows(violations: DataFrame, transitions: DataFrame) -> DataFrame:
    """seq_id, at, kind, detail: rows of violations (seq_id, at, reason), and of transitions (see transition_analysis) that deviate or are forbidden."""
    own = violations.select("seq_id", F.col("at").cast("int").alias("at"), F.lit("violation").alias("kind"), F.col("reason").alias("detail"))
    risky = transitions.where(F.col("decision").isin("ANOMALY", "DEVIATION")).select("seq_id", F.col("pos").cast("int").alias("at"), F.when(F.col("level") == "forbidden", "forbidden").otherwise("transition").alias("kind"), F.concat_ws(" -> ", "previous", "actual").alias("detail"))
    return own.unionByName(risky)


def timeline(labels: Column, starts: Column, ends: Column) -> Column:
    """Segments (label, first, last) of three arrays of one length."""
    return F.transform(F.arrays_zip(labels.alias("label"), starts.alias("first"), ends.alias("last")), lambda x: F.struct(x["label"].alias("label"), x["first"].alias("first"), x["last"].alias("last")))


def flat_features(features: dict[str, Column], lists: tuple[str, ...] = ()) -> Column:
    """An array of doubles of a fixed list of features: those named in lists are arrays and give their mean (0 if empty); nulls give 0."""
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / F.size(a)).otherwise(0.0)
    return F.array(*[F.coalesce(mean(v) if k in lists else v.cast("double"), F.lit(0.0)) for k, v in features.items()])


def first_of_group(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """key, first (the n least values in order), more (how many others there are); rows past the n-th of a task aren't shuffled."""
    few = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(value))).where(F.col("_r") <= n)
    lists = few.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("first"))
    return df.groupBy(key).agg(F.greatest(F.count(value) - n, F.lit(0)).alias("more")).join(lists, key, "left").select(key, "first", "more")
