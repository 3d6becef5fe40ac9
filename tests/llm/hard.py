"""Documents that operators must survive: nulls, empty and very long texts, ties, repeated rows, clashing names."""

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(40_000))
TEXTS = [
    (1, "The cat sat on the mat. It was a good day for all of us and we went on to the sea. We then came home again."),
    (2, None), (3, ""), (4, " \n\t \r\n"), (5, "one"), (6, "one two three"), (7, "one two three four"),
    (8, "The cat sat on the mat. It was a good day for all of us and we went on to the sea. We then came home again."),
    (9, "Été à la plage.\nÉté à la plage.\nUne ligne\x0bde plus \U0001f600 avec des mots."),
    (10, LONG), (11, LONG + " tail."), (12, "Home | About | Contact | Help\nAll rights reserved.\n" + "A plain line of words that goes on. " * 5),
    (13, "no break space wide and \u0085 next"), (14, "A B a b A B a b A B a b\n" * 8), (None, "A text without an id that is long enough to have some words."),
]


def documents(spark: SparkSession, extra: bool = True) -> DataFrame:
    rows = [Row(doc_id=i, text=t, lang=None, source=None if k % 3 == 0 else f"s{k % 3}", n_chars=None) for k, (i, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    if extra:
        for name in ("h", "size", "hash", "key", "count", "piece", "copy", "a.b"):
            df = df.withColumn(name, df["doc_id"])
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def sample(spark: SparkSession) -> DataFrame:
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
