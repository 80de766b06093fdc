"""Mail-shaped views over the given tables, so that every job can run on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import epoch_millis, local_iso

# 2024-01-01 00:00 UTC; message n is sent n minutes later.
_START_MILLIS = 1_704_067_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _category() -> Column:
    size = F.col("n_chars")
    by_size = (
        F.when(size < 800, "ADS").when(size < 1500, "JOB_OPPORTUNITIES")
        .when(size < 3000, "OTHERS").otherwise("BANK_STATEMENTS")
    )
    return F.when(F.coalesce("toxic", F.lit(0)) == 0, by_size)


def _label_ids() -> Column:
    quality, source = F.col("quality"), F.col("source")
    tests = (
        ("INBOX", source != "src0"),
        ("SENT", source == "src0"),
        ("UNREAD", quality.isNull()),
        ("CATEGORY_PROMOTIONS", source.isin("src3", "src7")),
        ("CATEGORY_UPDATES", source == "src5"),
        ("CATEGORY_PERSONAL", F.col("lang") == "es"),
        ("Label_q1", quality == 1),
        ("Label_t1", F.col("toxic") == 1),
        ("Label_c1", (F.col("category") == "ADS") & (quality == 1)),
        ("Label_c2", (F.col("category") == "OTHERS") & (quality == 1)),
        ("Label_c3", (F.col("category") == "ADS") & (quality == 0)),
    )
    held = [F.when(test, name) for name, test in tests]
    return F.array_compact(F.array(*held, F.concat(F.lit("Label_"), F.col("lang"))))


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per document; the labels table gives read state and tags."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    millis = F.lit(_START_MILLIS) + F.col("doc_id") * 60_000
    return (
        documents.join(labels, "doc_id", "left")
        .withColumn("category", _category())
        .select(
            F.col("doc_id").cast("string").alias("id"),
            local_iso(millis).alias("date"),
            F.timestamp_millis(millis).alias("internal_ts"),
            F.col("source").alias("from"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("subject"),
            F.col("text").alias("body_text"),
            _label_ids().alias("label_ids"),
            "category",
            F.concat(F.lit("size "), F.col("n_chars")).alias("reason"),
            "doc_id", "lang", "n_chars", "quality", "toxic",
        )
    )


def label_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels in use with their names, in the order they were first used.

    `Label_t1` has no entry, two ids are named ADS, and two categories have no label.
    """
    used = mail(spark, sf_dir).select("doc_id", F.explode("label_ids").alias("label_id"))
    first = used.groupBy("label_id").agg(F.min("doc_id").alias("scan_order"))
    label = F.col("label_id")
    name = (
        F.when(label.isin("Label_c1", "Label_c3"), "ADS").when(label == "Label_c2", "OTHERS")
        .when(label == "Label_q1", "GOOD")
        .when(label.startswith("Label_"), F.concat(F.lit("LANG_"), F.upper(F.substring(label, 7, 9))))
        .otherwise(label)
    )
    named = first.where(label != "Label_t1")
    return named.select("label_id", name.alias("label_name"), "scan_order")


def _part(mime: str, text: Column) -> Column:
    data = F.base64(text.cast("binary"))
    # Spark breaks base64 into lines; a mail API does not.
    for found, put in (("\r\n", ""), ("+", "-"), ("/", "_")):
        data = F.replace(data, F.lit(found), F.lit(put))
    return F.struct(F.lit(mime).alias("mimeType"), F.struct(data.alias("data")).alias("body"))


def _nested(part: Column, levels: int) -> Column:
    return F.concat(F.lit('{"parts":[' * levels), F.to_json(part), F.lit("]}" * levels))


# Deeper than the depth read by schema.
_DEEP = 9


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing records of the mail view.

    A document with a page is text and HTML side by side inside another part;
    documents of one source lie deeper than the payload schema; others are plain.
    """
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    rows = mail(spark, sf_dir).join(pages, "doc_id", "left")

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    headers = F.to_json(F.array(
        header("Received", F.lit("by relay")), header("FROM", F.col("from")),
        header("From", F.lit("second")), header("subject", F.col("subject")),
    ))
    plain = _part("text/plain", F.col("body_text"))
    both = F.struct(
        F.lit("multipart/alternative").alias("mimeType"),
        F.array(plain, _part("text/html", F.col("html"))).alias("parts"),
    )
    inner = (
        F.when(F.col("html").isNotNull(), _nested(both, 1))
        .when(F.col("from") == "src9", _nested(plain, _DEEP))
        .otherwise(_nested(plain, 1))
    )
    payload = F.concat(
        F.lit('{"mimeType":"multipart/mixed","headers":'), headers,
        F.lit(',"parts":['), inner, F.lit("]}"),
    )
    return rows.select(
        "id",
        F.col("label_ids").alias("labelIds"),
        F.unix_millis("internal_ts").cast("string").alias("internalDate"),
        payload.alias("payload"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail view as a scored table: category by size, none where the document is toxic."""
    rows = mail(spark, sf_dir)
    has_category = F.col("category").isNotNull()
    return rows.withColumns(
        {
            "reason": F.when(has_category, F.col("reason")),
            "error": F.when(~has_category, F.lit("invalid answer")),
        }
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected labels. Column names carry spaces, as in files edited by hand."""
    labels = table(spark, sf_dir, "labels")
    label = F.when(F.col("quality") == 1, " good ").when(F.col("toxic") == 0, "BAD")
    return labels.select(
        F.col("doc_id").cast("string").alias("id "),
        label.alias(" main_label"),
        F.concat(F.lit("quality "), F.col("quality")).alias(" reason "),
    )


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old labels for the same ids: long texts good, short ones bad, middle ones without any."""
    size = F.col("n_chars")
    label = F.when(size > 1500, "good").when(size < 500, "BAD")
    return mail(spark, sf_dir).select("id", label.alias("main_label"))


def by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled messages whose category is their language."""
    return mail(spark, sf_dir).select("id", "subject", "body_text", F.col("lang").alias("category"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a model may give them: valid, of no known category, cut, too long, not JSON."""
    size, category = F.col("n_chars"), F.coalesce("category", F.lit("OTHERS"))

    def answer(category: Column, reason: Column) -> Column:
        return F.to_json(F.struct(category.alias("category"), reason.alias("reason_short")))

    response = (
        F.when(F.col("toxic") == 1, "I cannot answer that")
        .when(F.col("lang") == "fr", answer(F.lit("NO_SUCH"), F.col("reason")))
        .when(F.col("lang") == "de", answer(category, F.lit(None).cast("string")))
        .when(size < 600, answer(category, F.repeat(F.lit("x"), F.lit(81))))
        .when(size < 700, F.concat(F.lit('{"category":"ADS","reason_short":'), size, F.lit("}")))
        .otherwise(answer(category, F.col("reason")))
    )
    return mail(spark, sf_dir).select("id", response.alias("response"))


def event_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as epoch milliseconds in text, the form a landing record has."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    millis = F.timestamp_diff("MILLISECOND", start, F.col("ts").cast("timestamp_ntz"))
    events = table(spark, sf_dir, "events").select("event_id", millis.cast("string").alias("sent"))
    return events.withColumn("millis", epoch_millis(F.col("sent")))
