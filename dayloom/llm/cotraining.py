"""Quality classifier by co-training of two views: the text's content, and the page's metadata.

Each view has its own logistic regression. In every round both score all unlabelled
documents; what one view is most confident about becomes pseudo-labels (of less weight) for the
other. Labelled documents kept apart from training calibrate the views: a regression on both
log-odds gives the final score, which weighs a view by what it is worth. A document is good
if it is labelled of quality 1 and not toxic.

Models are fitted on ``LABELLED`` labelled documents at most, chosen by hash, of which every fourth
only calibrates, and in each round on the ``PSEUDO`` most confident of all unlabelled documents,
dealt to both kinds as among the labelled ones; beyond three digits of confidence a hash decides, so that
copies of one page do not fill them. The vocabulary is what most documents of the whole table hold. All
documents are scored, by built-in functions and Spark's models inside the JVM.

Defined cases: a text that is null or has no word scores 0 and is not kept; null metadata is a
value of its own; labels without a document, or with a null, are ignored, several labels of
one doc_id count as the worst; with labels of one kind only, that kind is the answer; without
labels every document with words is kept with score 1; repeated rows are scored alike; other
columns are kept, and columns named score, text_score, meta_score or keep are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.corpus import written

LABELLED = 10_000
PSEUDO = 5_000
ROUNDS = 2
CONFIDENT = 0.97
PSEUDO_WEIGHT = 0.3
VOCABULARY, MIN_DOCS = 1 << 14, 4
THRESHOLD = 0.5
#: Tasks of a fit, whose rows are bounded: up to four are added up without a shuffle in each iteration.
FIT_TASKS = 4
#: Hashes that are sorted by the driver rather than counted once more.
FEW = 10_000
_TEXT, _META = ["counts", "style"], ["meta"]
_ADDED = ["score", "text_score", "meta_score", "keep"]


def _share(text: Column, drop: str) -> Column:
    """Share of characters that a pattern takes out."""
    return 1 - F.length(F.regexp_replace(text, drop, "")) / F.greatest(F.length(text), F.lit(1))


def features(docs: DataFrame) -> DataFrame:
    """Columns of both views beside the given ones: _words, _kinds (each of them once), _style_*, _source, _lang, _size, _both."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    source, lang = (F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("source", "lang"))
    size = F.floor(F.log2(F.coalesce(F.col("n_chars"), F.lit(0)) + 1)).cast("string")
    out = docs.withColumn("_words", words).withColumn("_kinds", F.array_distinct("_words"))
    n = F.greatest(F.size("_words"), F.lit(1))
    return out.withColumns(
        {
            "_style_upper": _share(text, r"\p{Lu}+"),
            "_style_mark": _share(text, r"[^\p{L}\p{N}\s.,;:'()-]+"),
            "_style_kinds": F.size("_kinds") / F.pow(n, 0.8),
            "_style_length": F.length(text) / n / 20,
            "_style_blank": (F.size("_words") == 0).cast("double"),
            "_source": source,
            "_lang": lang,
            "_size": size,
            "_both": F.concat_ws("|", source, lang),
        }
    )


_STYLE = ["_style_upper", "_style_mark", "_style_kinds", "_style_length", "_style_blank"]


def vocabulary(rows: DataFrame, size: int = VOCABULARY, least: int = MIN_DOCS) -> list[str]:
    """At most ``size`` words that most of the rows hold, each in at least ``least`` of them.

    Words enter by whole steps of frequency (64 to each doubling), so that a histogram tells which are in; only those
    reach the driver.
    """
    held = rows.select(F.explode("_kinds").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    held = written(held.withColumn("step", F.floor(F.log2("n") * 64).cast("int")), "word_counts")
    total, floor = 0, None
    for r in sorted(held.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.step):
        total += r.n
        if total > size:
            break
        floor = r.step
    words = held.where(F.col("step") >= floor).collect() if floor is not None else []
    return [r.w for r in sorted(words, key=lambda r: (-r.n, r.w))]


def _views(words: list[str]) -> tuple[PipelineModel, PipelineModel]:
    """Features of both views; the words are fixed, the hashes of metadata need no fit. Only whether a row holds a word counts, so each is given once."""
    counts = CountVectorizerModel.from_vocabulary(words or ["\0"], inputCol="_kinds", outputCol="counts").setBinary(True)
    text = PipelineModel([counts, VectorAssembler(inputCols=["counts", *_STYLE], outputCol="_text_features", handleInvalid="keep")])
    meta = PipelineModel([FeatureHasher(inputCols=["_source", "_lang", "_size", "_both"], outputCol="_meta_features", numFeatures=2048)])
    return text, meta


def _unnamed(df: DataFrame, vectors: Sequence[str]) -> DataFrame:
    """Vector columns that keep their length but not a name for each of their elements, which every file and plan would repeat."""
    for c in vectors:
        size = df.schema[c].metadata.get("ml_attr", {}).get("num_attrs")
        if size is not None:
            df = df.withMetadata(c, {"ml_attr": {"num_attrs": size}})
    return df


def _fit(df: DataFrame, view: str) -> LogisticRegressionModel:
    """Text has many useless words: an L1 share drops them."""
    reg, mix = (0.0008, 0.9) if view == "text" else (0.002, 0.0)
    return LogisticRegression(
        featuresCol=f"_{view}_features", labelCol="good", weightCol="weight", rawPredictionCol=f"_{view}_raw", probabilityCol=f"_{view}_probability",
        predictionCol=f"_{view}_prediction", maxIter=25, regParam=reg, elasticNetParam=mix,
    ).fit(df)


def _log_odds(view: str) -> Column:
    p = F.least(F.greatest(vector_to_array(f"_{view}_probability")[1], F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _sample(df: DataFrame, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows at most, the same ones for the same doc_ids."""
    n = df.count()
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)  # 63 bits
    return df if n <= bound else df.where(place <= ((1 << 63) - 1) * 97 * bound // (100 * n))


def _place() -> Column:
    """63 bits of a row's hash, which order rows of equal confidence."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 1)


def _nth(places: DataFrame, n: int, few: int = FEW) -> int:
    """The n-th smallest value of ``place``: histograms of 12 bits narrow it down until at most ``few`` values are left, which are sorted."""
    prefix = 0
    for shift in (51, 39, 27, 15, 3, 0):
        cells = places.groupBy(F.shiftright("place", shift).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()  # 4,096 at most
        for r in sorted(cells, key=lambda r: r.cell):
            if n <= r.n:
                prefix, held = r.cell, r.n
                break
            n -= r.n
        if not shift:
            break
        places = places.where(F.shiftright("place", shift) == prefix)
        if held <= few:
            return sorted(r.place for r in places.collect())[n - 1]
    return prefix


def pseudo_labels(scored: DataFrame, p: Column, shares: dict[float, float], bound: int = PSEUDO) -> DataFrame:
    """Rows of ``scored`` with ``good`` set and less weight: of each kind its share of ``bound`` rows, the most confident ones.

    Confidences and hashes are written, and histograms of them tell which row is the last; no rows reach the driver.
    """

    # a filter on the row number stays above the projection, so that the confidence is worked out once a row
    rows = scored.withColumns({"_p": p, "_row": F.monotonically_increasing_id(), "_place": _place()}).where("_row >= 0")
    x = F.col("_p")
    kind = F.when(x >= CONFIDENT, 1.0).when(1 - x >= CONFIDENT, 0.0)
    sure = F.round(F.greatest(x, 1 - x) * 1000).cast("int")
    narrow = written(rows.select(kind.alias("kind"), sure.alias("sure"), F.col("_place").alias("place")).where("kind is not null"), "confidence")
    cells = narrow.groupBy("kind", "sure").agg(F.count(F.lit(1)).alias("n")).collect()  # 62 at most
    cuts = {}
    for good in (1.0, 0.0):
        left, cut = max(1, int(bound * shares.get(good, 0.0))), (0, -1)
        for r in sorted((c for c in cells if c.kind == good), key=lambda c: -c.sure):
            if r.n > left:
                cut = (r.sure, _nth(narrow.where((F.col("kind") == good) & (F.col("sure") == r.sure)).select("place"), left) if left else -1)
                break
            left -= r.n
        cuts[good] = cut

    good = F.lit(None).cast("double")
    for g, (least, last) in cuts.items():
        good = F.when((kind == g) & ((sure > least) | ((sure == least) & (F.col("_place") <= last))), g).otherwise(good)
    return rows.withColumn("good", good).where("good is not null").withColumn("weight", F.lit(PSEUDO_WEIGHT)).drop("_p", "_row", "_place")


class QualityModel:
    """Both fitted views and their calibration; ``only`` is set when the labels are of one kind."""

    def __init__(self, text: PipelineModel, meta: PipelineModel, by_text, by_meta, weights: tuple[float, float, float], only: float | None = None):
        self.text, self.meta, self.by_text, self.by_meta, self.weights, self.only = text, meta, by_text, by_meta, weights, only

    def score(self, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """All columns, text_score, meta_score and score (0 to 1), and keep."""
        kept = [c for c in docs.columns if c not in _ADDED]
        df = features(docs.select(*kept))
        spoken = F.size("_words") > 0
        if self.only is not None:
            made = {c: F.lit(self.only) for c in _ADDED[:3]}
        else:
            df = self.by_meta.transform(self.meta.transform(self.by_text.transform(self.text.transform(df))))
            df = df.withColumns({"_lt": _log_odds("text"), "_lm": _log_odds("meta")})
            a, b, c = self.weights
            made = {
                "score": 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("_lt") + F.lit(c) * F.col("_lm")))),
                "text_score": 1 / (1 + F.exp(-F.col("_lt"))),
                "meta_score": 1 / (1 + F.exp(-F.col("_lm"))),
            }
        made = {k: F.when(spoken, v).otherwise(F.lit(0.0)) for k, v in made.items()}
        return df.withColumns(made).withColumn("keep", F.col("score") >= threshold).select(*kept, *_ADDED)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS) -> QualityModel:
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double")
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    view = features(docs.select("doc_id", "text", "lang", "source", "n_chars")).drop("text")
    some = F.broadcast(_sample(known, labelled, 1))  # bounded by ``labelled`` rows
    told_rows = view.join(some, "doc_id").select("good", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0).alias("calibrates"))
    counts = {(r.good, r.calibrates): r["count"] for r in told_rows.groupBy("good", "calibrates").count().collect()}
    kinds = {g: {c for h, c in counts if h == g} for g, _ in counts}
    if len(kinds) < 2:
        return QualityModel(None, None, None, None, (0.0, 0.0, 0.0), only=next(iter(kinds), 1.0))
    shares = {g: sum(n for (h, _), n in counts.items() if h == g) / sum(counts.values()) for g in kinds}
    tasks = min(FIT_TASKS, max(1, int(docs.sparkSession.sparkContext.defaultParallelism)))
    text_model, meta_model = _views(vocabulary(view))
    made = meta_model.transform(text_model.transform(view.join(some, "doc_id", "left")))
    made = made.withColumns({"weight": F.lit(1.0), "calibrates": F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0})
    made = _unnamed(made.select("doc_id", "good", "weight", "calibrates", "_text_features", "_meta_features"), ["_text_features", "_meta_features"])
    rows = written(made, "views")
    labelled_rows, others = written(rows.where("good is not null"), "labelled").coalesce(tasks), rows.where("good is null")
    seed = labelled_rows.where("not calibrates")
    told = {"text": seed, "meta": seed}
    models = {v: _fit(told[v], v) for v in told}
    for step in range(rounds):
        for mine, other in (("text", "meta"), ("meta", "text")):
            sure = pseudo_labels(models[mine].transform(others), vector_to_array(f"_{mine}_probability")[1], shares, pseudo)
            told[other] = written(seed.unionByName(sure.select(*rows.columns)), f"told_{other}_{step}").coalesce(tasks)
        models = {v: _fit(told[v], v) for v in told}
    both = all(len(v) == 2 for v in kinds.values())  # either kind is among the calibrating rows too
    judge = labelled_rows.where("calibrates" if both else "true")
    judge = models["meta"].transform(models["text"].transform(judge)).select("good", _log_odds("text").alias("lt"), _log_odds("meta").alias("lm"))
    joined = VectorAssembler(inputCols=["lt", "lm"], outputCol="features").transform(judge)
    fitted = LogisticRegression(labelCol="good", maxIter=60, regParam=1e-4).fit(joined)
    a, (b, c) = float(fitted.intercept), map(float, fitted.coefficients)
    return QualityModel(text_model, meta_model, models["text"], models["meta"], (a, b, c))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with its scores and whether to keep it, by a model trained on the labelled rows."""
    return train(docs, labels).score(docs)
