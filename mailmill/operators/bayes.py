"""Multinomial Bayes over the words of messages, as counts and whole-number log sums.

Training is one aggregation: messages per category, and how often each word stands in
each category. A message's score for a category is the log share of the category, plus,
for each of its words that training has seen, the log of (count + 1) over (words of the
category + size of the vocabulary). Logs are rounded to whole billionths, so sums do not
depend on the order in which a cluster adds them; of equal scores the first category by
name wins. Words not seen in training say nothing.

The same counts, kept by fold, give the model of every fold's remainder by subtraction:
cross-validation counts each word once and scores each message once.

The HOT words that messages have most often are looked up by broadcast where the message
lies and add up there; only the others go through a shuffle. `id` tells messages apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import or_empty
from .bounded import kept

# A word is a run of letters and digits; logs are counted in billionths.
WORD = r"[\p{L}\p{N}]+"
UNIT = 1_000_000_000
# So many words are broadcast with their logs.
HOT = 20_000

COUNTS = StructType([
    StructField("category", StringType()), StructField("word", StringType()), StructField("n", LongType()),
])
CLASSES = StructType([StructField("category", StringType()), StructField("messages", LongType())])


def message_text(body: str = "body_text") -> Column:
    return F.concat(or_empty(F.col("subject")), F.lit("\n"), or_empty(F.col(body)))


def each_word(df: DataFrame, *keep: str, text: Column | None = None) -> DataFrame:
    """(keep, word): every word of every row."""
    text = message_text() if text is None else text
    return df.select(*keep, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word"))


def words_of(df: DataFrame, *keep: str, text: Column | None = None) -> DataFrame:
    """(keep, word, k): how often each word stands in each group of rows."""
    return each_word(df, *keep, text=text).groupBy(*keep, "word").agg(F.count("*").alias("k"))


def _log(value: Column) -> Column:
    return F.round(F.ln(value) * F.lit(float(UNIT))).cast("bigint")


def _log_rows(told: DataFrame) -> list:
    """Per fold and category the log share and the log of its size; as few as there are categories."""
    size = F.coalesce("words", F.lit(0)) + F.coalesce("vocabulary", F.lit(0))
    return told.select(
        "fold", "category", _log(F.col("messages") / F.col("everything")).alias("share"),
        _log(F.greatest(size, F.lit(1)).cast("double")).alias("size"),
    ).orderBy("fold", "category").collect()


@dataclass(frozen=True)
class BayesModel:
    """Counts of a training set; `fold` is 0.

    `counts` has (fold, category, word, n), `classes` (fold, category, messages).
    """

    counts: DataFrame
    classes: DataFrame

    def class_rows(self) -> list:
        words = self.counts.where("n > 0")
        sizes = words.groupBy("fold", "category").agg(F.sum("n").alias("words"))
        vocabulary = words.groupBy("fold").agg(F.count_distinct("word").alias("vocabulary"))
        own = self.classes.where("messages > 0")
        everything = own.groupBy("fold").agg(F.sum("messages").alias("everything"))
        told = own.join(F.broadcast(everything), "fold").join(F.broadcast(sizes), ["fold", "category"], "left")
        return _log_rows(told.join(F.broadcast(vocabulary), "fold", "left"))

    def gains(self, categories: list[str]) -> DataFrame:
        """(word, gains): of each word, for the one fold, the logs of its counts in the order of the categories."""
        count = [F.sum(F.when(F.col("category") == c, F.col("n"))) for c in categories]
        logs = F.array(*[_log((F.coalesce(n, F.lit(0)) + 1).cast("double")) for n in count])
        return self.counts.where("n > 0").groupBy("word").agg(F.array(logs).alias("gains"))


@dataclass(frozen=True)
class FoldModel:
    """For each of the folds 0 to `folds` - 1 the model of all other rows, from the counts of each fold's own.

    `words` has a row for each word: its counts in each category (`totals`) and those in each
    fold and category (`own`), categories in the order of `categories`; `classes` has the few
    (fold, category, messages, words).
    """

    words: DataFrame
    classes: list
    categories: list[str]
    folds: int

    def class_rows(self) -> list:
        messages = {(r.fold, r.category): r.messages for r in self.classes}
        sizes = {(r.fold, r.category): r.words for r in self.classes}
        others = [sum((n for (g, _), n in messages.items() if g != f)) for f in range(self.folds)]
        rows = []
        for f in range(self.folds):
            for c in self.categories:
                left, words = (sum(n for (g, k), n in of.items() if g != f and k == c) for of in (messages, sizes))
                if left:
                    rows.append((f, c, left, others[f], words))
        if not rows:
            return []
        # A word is in the vocabulary of a fold's model if another fold has it.
        known = self.words.agg(*[F.count_if(self._elsewhere(f)).alias(f"_{f}") for f in range(self.folds)]).first()
        schema = "fold int, category string, messages long, everything long, words long, vocabulary long"
        spark = self.words.sparkSession
        return _log_rows(spark.createDataFrame([(*row, known[row[0]]) for row in rows], schema))

    def met(self) -> DataFrame:
        """(word, n): how often all rows together have each word."""
        return self.words.select("word", reduce(add, [F.col("totals")[i] for i in range(len(self.categories))], F.lit(0)).alias("n"))

    def _left(self, fold: int) -> list[Column]:
        return [F.col("totals")[i] - F.col("own")[fold][i] for i in range(len(self.categories))]

    def _elsewhere(self, fold: int) -> Column:
        return reduce(add, self._left(fold)) > 0

    def gains(self, categories: list[str]) -> DataFrame:
        """(word, gains): of each word, for each fold, the logs of its counts in all others; null where they lack it."""
        at = [self.categories.index(c) for c in categories]
        logs = []
        for f in range(self.folds):
            left = self._left(f)
            logs.append(F.when(self._elsewhere(f), F.array(*[_log((left[i] + 1).cast("double")) for i in at])))
        return self.words.select("word", F.array(*logs).alias("gains"))


def train_bayes(examples: DataFrame, label: str = "category", text: Column | None = None) -> BayesModel:
    """The model of all rows that have a label."""
    rows = examples.where(F.col(label).isNotNull()).withColumnRenamed(label, "category").withColumn("fold", F.lit(0))
    counts = words_of(rows, "fold", "category", text=text).withColumnRenamed("k", "n")
    classes = rows.groupBy("fold", "category").agg(F.count("*").alias("messages"))
    return BayesModel(counts, classes)


def train_folds(examples: DataFrame, folds: int, text: Column | None = None) -> FoldModel:
    """For each of the folds 0 to `folds` - 1 the model of all other rows, from one count of the words.

    The counts are written to the work folder, a row for each word.
    """
    rows = examples.where(F.col("category").isNotNull())
    messages = rows.groupBy("fold", "category").agg(F.count("*").alias("messages")).collect()
    categories = sorted({r.category for r in messages})
    counts = words_of(rows, "fold", "category", text=text)

    def counted(*tests: Column) -> Column:
        return F.coalesce(F.sum(F.when(reduce(and_, tests), F.col("k"))), F.lit(0))

    totals = F.array(*[counted(F.col("category") == c) for c in categories])
    own = F.array(*[F.array(*[counted(F.col("category") == c, F.col("fold") == f) for c in categories]) for f in range(folds)])
    if not categories:
        return FoldModel(counts.select("word"), [], [], folds)
    words = kept(counts.groupBy("word").agg(totals.alias("totals"), own.alias("own")), "fold-words")
    places = [(f, i) for f in range(folds) for i in range(len(categories))]
    sizes = words.agg(*[F.coalesce(F.sum(F.col("own")[f][i]), F.lit(0)).alias(f"_{f}_{i}") for f, i in places]).first()
    size = {(f, categories[i]): sizes[f"_{f}_{i}"] for f, i in places}
    classes = [Row(fold=r.fold, category=r.category, messages=r.messages, words=size.get((r.fold, r.category), 0)) for r in messages]
    return FoldModel(words, classes, categories, folds)


def predict_bayes(
    messages: DataFrame, model: BayesModel | FoldModel, text: Column | None = None, key: str = "id", met: DataFrame | None = None
) -> DataFrame:
    """(key, category): of each message the likeliest category. A `fold` column chooses the model.

    `met` says in `n` how often the messages have each word, where that is known.
    """
    known = model.class_rows()
    if not known:
        return messages.select(key, F.lit(None).cast("string").alias("category"))
    if "fold" not in messages.columns:
        messages = messages.withColumn("fold", F.lit(0))
    categories = sorted({r.category for r in known})
    gains = model.gains(categories)
    words = each_word(messages, key, "fold", text=text)
    if met is None:
        met = words.groupBy("word").agg(F.count("*").alias("n"))
    frequent = F.broadcast(met.orderBy(F.desc("n"), "word").limit(HOT).select("word"))
    own = F.get("gains", F.col("fold")).alias("_gains")

    def summed(found: DataFrame) -> DataFrame:
        found = found.select(key, own)
        sums = [F.sum(F.col("_gains")[i]).alias(f"_sum{i}") for i in range(len(categories))]
        return found.groupBy(key).agg(F.count("_gains").alias("_seen"), *sums)

    hot = summed(words.join(F.broadcast(gains.join(frequent, "word", "left_semi")), "word"))
    # A word that the messages have often and training lacks is not dealt by its hash either.
    cold = summed(words.join(frequent, "word", "left_anti").join(gains, "word"))
    parts = ["_seen", *[f"_sum{i}" for i in range(len(categories))]]
    by_message = hot.unionByName(cold).groupBy(key).agg(*[F.sum(c).alias(c) for c in parts])
    scored = messages.select(key, "fold").join(by_message, key, "left")
    zero = F.lit(0).cast("bigint")
    parts = []
    for row in known:
        i = categories.index(row.category)
        score = (F.lit(row.share) + F.coalesce(F.col(f"_sum{i}"), zero) - F.coalesce("_seen", zero) * F.lit(row.size)).cast("bigint")
        # The least of negated scores is the greatest score, of equal ones the first by name.
        parts.append(F.when(F.col("fold") == row.fold, F.struct((-score).alias("score"), F.lit(row.category).alias("category"))))
    best = F.array_min(F.array_compact(F.array(*parts)))
    return scored.select(key, best["category"].alias("category"))


class BayesScorer:
    """A model as a scorer."""

    def __init__(self, model: BayesModel):
        self.model = model

    def __call__(self, inputs: DataFrame) -> DataFrame:
        inputs = inputs.drop("category", "reason", "error")
        guessed = predict_bayes(inputs, self.model, message_text("scored_body"))
        scored = inputs.join(guessed, "id", "left")
        told = F.when(F.col("category").isNotNull(), F.lit("words of labelled messages"))
        return scored.withColumns({
            "reason": told,
            "error": F.when(F.col("category").isNull(), F.lit("nothing to learn from")),
        })


def save_bayes(model: BayesModel, path: str) -> None:
    """The counts as tables; for models of folds there is no such form."""
    model.counts.where("fold = 0").select(*COUNTS.names).write.mode("errorifexists").parquet(f"{path}/counts")
    model.classes.where("fold = 0").select(*CLASSES.names).write.mode("errorifexists").parquet(f"{path}/classes")


def load_bayes(spark: SparkSession, path: str) -> BayesModel:
    fold = F.lit(0).alias("fold")
    return BayesModel(
        spark.read.schema(COUNTS).parquet(f"{path}/counts").select(fold, *COUNTS.names),
        spark.read.schema(CLASSES).parquet(f"{path}/classes").select(fold, *CLASSES.names),
    )
