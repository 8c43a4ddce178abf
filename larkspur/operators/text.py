"""Text features as column expressions and aggregations: tokens, TF-IDF, word weights, vocabularies."""

from __future__ import annotations

from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, Word2Vec
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame, quoted
from larkspur.operators.base import Operator
from larkspur.storage import stored

SEPARATOR = " [SEP] "


def tokens_en(text: Column, stop_words: list[str] = ()) -> Column:
    """Lower-case tokens of letters and digits without numbers that stand alone; null has none."""
    # a part without a letter is empty or a number
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+"), lambda w: w.rlike("[A-Za-z]"))
    words = F.transform(kept, F.lower)
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def tokens_ru(text: Column, stop_words: list[str] = ()) -> Column:
    """Lower-case words of two letters and more, of one letter dropped, with yo as ye and a negation joined to the word after it."""
    clean = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е")
    clean = F.trim(F.regexp_replace(clean, "[^a-zа-я]+", " "))
    clean = F.regexp_replace(clean, "(^| )(не|ни) +", "$1$2")
    words = F.filter(F.split(clean, " +"), lambda w: F.length(w) >= 2)
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def concatenated(columns: list[str], separator: str = SEPARATOR) -> Column:
    """Texts joined by a separator; null is an empty text."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def vocabulary(df: DataFrame, tokens: str, least: int = 1, most: int | None = None) -> DataFrame:
    """token, n and df (documents that have it), the commonest first, ties by token. Documents need no numbers: their different tokens are counted beside all."""
    every = df.select(F.explode(tokens).alias("token"), F.lit(1).alias("n"), F.lit(0).alias("df"))
    once = df.select(F.explode(F.array_distinct(tokens)).alias("token"), F.lit(0).alias("n"), F.lit(1).alias("df"))
    out = every.unionByName(once).groupBy("token").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).filter(F.col("n") >= least)
    return out.orderBy(F.desc("n"), "token").limit(most) if most else out


def tf_idf(df: DataFrame, key: str, tokens: str, least_df: int = 5, most: int | None = None) -> DataFrame:
    """key, token and weight: count times ln((1 + N) / (1 + df)) + 1, scaled to length 1 in each document.

    Tokens in fewer than ``least_df`` documents are left out, and beyond ``most``, if given, the rarer
    ones. Tokens are counted once and the counts are stored.
    """
    tf = stored(df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf")))
    words = tf.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).filter(F.col("df") >= least_df)
    if most:
        words = words.orderBy(F.desc("n"), "token").limit(most)
    idf = words.crossJoin(F.broadcast(df.agg(F.count("*").alias("docs")))).select("token", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(idf, "token").select(key, "token", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "token", (F.col("w") / length).alias("weight"))


class TfIdfVectors:
    """The same weights as sparse vectors for models: ``fit`` learns the vocabulary of the ``most`` commonest tokens, which the driver holds, ``transform`` adds the vectors."""

    def __init__(self, tokens: str, output: str, least_df: int = 5, most: int = 1 << 18):
        self.tokens, self.output, self.least_df, self.most = tokens, output, least_df, most

    def fit(self, df: DataFrame) -> TfIdfVectors:
        counts = CountVectorizer(inputCol=self.tokens, outputCol="tf__", minDF=self.least_df, vocabSize=self.most)
        self.counter = counts.fit(df)
        self.idf = IDF(inputCol="tf__", outputCol="idf__").fit(self.counter.transform(df))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.idf.transform(self.counter.transform(df))
        return Normalizer(inputCol="idf__", outputCol=self.output, p=2.0).transform(out).drop("tf__", "idf__")


def word_weights(df: DataFrame, tokens: str, kind: str = "idf", alpha: float = 0.001, key: str | None = None) -> DataFrame:
    """token and weight: ln(1 + (N + 1) / (df + 1)), or alpha / (alpha + (df + 1) / (N + 1)), or 1.

    N is the number of rows, df that of the rows with the token, or of their different values of ``key`` if it is given.
    """
    each = df.select(*([quoted(key)] if key else []), F.explode(F.array_distinct(tokens)).alias("token"))
    counts = each.groupBy("token").agg((F.count_distinct(quoted(key)) if key else F.count("*")).alias("df")).crossJoin(F.broadcast(df.agg(F.count("*").alias("docs"))))
    n, d = F.col("docs") + 1, F.col("df") + 1
    weight = {"idf": F.log1p(n / d), "sif": alpha / (alpha + d / n), "1": F.lit(1.0)}[kind]
    return counts.select("token", weight.alias("weight"))


def document_vectors(df: DataFrame, key: str, tokens: str, vectors: DataFrame, weights: DataFrame, size: int) -> DataFrame:
    """key and vector: the weighted sum of the word vectors (token, vector) over the number of tokens found; zeros for none."""
    found = df.select(key, F.explode(tokens).alias("token")).join(vectors, "token").join(weights, "token")
    sums = [F.sum(F.col("vector")[k] * F.col("weight")).alias(f"s{k}") for k in range(size)]
    each = found.groupBy(F.col(key).alias("k_")).agg(F.count("*").alias("n_"), *sums)
    made = F.array(*[F.coalesce(F.col(f"s{k}") / F.col("n_"), F.lit(0.0)) for k in range(size)])
    return df.select(key).join(each, F.col(key) == F.col("k_"), "left").select(key, made.alias("vector"))


def learned_word_vectors(df: DataFrame, tokens: str, size: int = 32, least: int = 5, seed: int = 42) -> DataFrame:
    """token and vector, by skip-grams."""
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, minCount=least, seed=seed, inputCol=tokens, outputCol="v").fit(df)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))


def scaled(vector: Column, norm: str = "l2") -> Column:
    """The vector over its l1 or l2 length; a zero vector stays."""
    size = F.aggregate(vector, F.lit(0.0), lambda a, x: a + (F.abs(x) if norm == "l1" else x * x))
    length = size if norm == "l1" else F.sqrt(size)
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))


def content_hash(text: Column) -> Column:
    return F.xxhash64(text)


def token_places(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, place and token."""
    return df.select(key, F.posexplode(tokens).alias("place", "token"))


def inverse_sigmoid(p: Column) -> Column:
    p = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7)))
    return F.log(p / (1 - p))


class TextScores(Operator):
    """``text__<column>``: the out-of-fold score of :class:`TextScore` for each text feature, and ``words__<column>``, its number of words.

    Texts are tokenised as English; a null is an empty text. ``targets`` names several targets, each with a score of its own.
    """

    def __init__(self, folds: int = 5, binary: bool = True, targets: list[str] | None = None, least_df: int = 5):
        self.folds, self.binary, self.targets, self.least_df = folds, binary, targets, least_df

    def inputs(self, frame: Frame) -> list[str]:
        return [c for c in frame.features if frame.roles[c].name == "text"]

    def tokenised(self, frame: Frame) -> DataFrame:
        return frame.df.withColumns({f"tokens__{c}": tokens_en(F.coalesce(F.col(quoted(c)), F.lit(""))) for c in self.inputs(frame)})

    def finished(self, df: DataFrame, frame: Frame) -> Frame:
        columns = self.inputs(frame)
        df = df.withColumns({f"words__{c}": F.size(f"tokens__{c}").cast("double") for c in columns}).drop(*[f"tokens__{c}" for c in columns])
        made = [*(s.name for s in self.scorers), *(f"words__{c}" for c in columns)]
        return Frame(df, frame.roles | dict.fromkeys(made, R.numeric()), frame.keys).select(made)

    def fit_transform(self, frame: Frame) -> Frame:
        targets, fold = self.targets or [frame.attribute("target")], frame.attribute("folds")
        df, self.scorers = self.tokenised(frame), []
        for c in self.inputs(frame):
            for k, target in enumerate(targets):
                name = f"text__{c}" if len(targets) == 1 else f"text_{k}__{c}"
                self.scorers.append(TextScore(f"tokens__{c}", target, name, self.binary, self.least_df))
                df = self.scorers[-1].fit_predict(df, fold, self.folds)
        return self.finished(df, frame)

    def transform(self, frame: Frame) -> Frame:
        df = self.tokenised(frame)
        for scorer in self.scorers:
            df = scorer.predict(df)
        return self.finished(df, frame)


class TextScore:
    """A text column as one number: the out-of-fold prediction of a linear model over its TF-IDF vectors.

    ``fit_predict`` gives each row the score of the model that hasn't seen its fold, ``predict`` the mean of all models.
    """

    def __init__(self, tokens: str, target: str, name: str, binary: bool = True, least_df: int = 5, penalty: float = 1e-2):
        self.tokens, self.target, self.name, self.binary, self.penalty = tokens, target, name, binary, penalty
        self.vectors, self.models = TfIdfVectors(tokens, "vector__", least_df), []

    def scored(self, model, df: DataFrame, name: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = model.transform(df)
        value = vector_to_array("probability")[1] if self.binary else F.col("prediction")
        return out.withColumn(name, value).select(*df.columns, name)

    def fit_predict(self, df: DataFrame, fold: str, folds: int) -> DataFrame:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.regression import LinearRegression

        made = stored(self.vectors.fit(df).transform(df))
        kind = LogisticRegression if self.binary else LinearRegression
        parts = []
        for k in range(folds):
            self.models.append(kind(featuresCol="vector__", labelCol=self.target, regParam=self.penalty, maxIter=30).fit(made.filter(F.col(fold) != k)))
            parts.append(self.scored(self.models[-1], made.filter(F.col(fold) == k), self.name).drop("vector__"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        made, names = self.vectors.transform(df), []
        for k, model in enumerate(self.models):
            names.append(f"{self.name}__{k}")
            made = self.scored(model, made, names[-1])
        return made.withColumn(self.name, sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop("vector__", *names)
